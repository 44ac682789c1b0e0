"""Made-up people: names, places, numbers and dates drawn from a row's key, the same on every run and executor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import numbered

FIRST = ("Ada", "Ben", "Chloé", "Dara", "Eli", "Fay", "Gus", "Hana", "Ivo", "June", "Kai", "Lea")
LAST = ("Abbot", "Brandt", "Castro", "Dufour", "Ekman", "Farrow", "Garnier", "Holt", "Iverson", "Jensen", "Keller", "Lindqvist")
NICKNAMES = {"Ada": "Addie", "Ben": "Benny", "Eli": "Lee", "Fay": "Faye", "June": "Junie", "Lea": "Lee"}
CITIES = ("Northfield", "Easton", "Westbrook", "Southgate", "Millbrook", "Riverton")
STREETS = ("Oak", "Maple", "Cedar", "Lake", "Hill", "Park", "Mill")
SUFFIXES = ("Street", "Avenue", "Road", "Lane")
STATES = (("CA", "California"), ("NY", "New York"), ("OH", "Ohio"), ("PA", "Pennsylvania"), ("TX", "Texas"), ("VT", "Vermont"))
DOMAINS = ("mail.example.com", "post.example.net", "inbox.example.org")
#: Genders, relations, insurers and their prefixes, titles (weighted), and what a hospital's name ends with.
GENDERS = ("male", "female", "non_binary")
RELATIONS = ("spouse", "parent", "sibling", "child", "friend")
PLANS = ("BCBS", "UHC", "AETNA", "CIGNA", "HUM")
INSURERS = ("Blue Cross Blue Shield", "United Healthcare", "Aetna", "Cigna", "Humana")
TITLES = ("Dr.", "Dr.", "Dr.", "NP", "PA")
HOSPITALS = ("Medical Center", "Hospital", "Health System", "Regional Medical Center")
#: Characters of vehicle identifiers, and the forms in which dates are written.
VIN = "ABCDEFGHJKLMNPRSTUVWXYZ0123456789"
DATE_FORMS = (
    "MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "MMMM dd, yyyy", "dd MMMM yyyy", "MMM dd, yyyy", "MM-dd-yyyy", "yyyy/MM/dd", "dd MMMM, yyyy", "MMMM dd yyyy", "dd-MMMM-yyyy",
)


class Draw:
    """Values drawn by a digest of a row's key, a seed and a name for each draw. Every method gives a column."""

    def __init__(self, *key: Column, seed: int = 0):
        self.key = [*(k.cast("string") for k in key), F.lit(str(seed))]

    def number(self, name: str) -> Column:
        """60 bits of a digest."""
        return F.conv(F.substring(F.md5(F.concat_ws("|", *self.key, F.lit(name))), 1, 15), 16, 10).cast("long")

    def pick(self, values: tuple[str, ...], name: str) -> Column:
        return F.element_at(F.array(*(F.lit(v) for v in values)), (self.number(name) % len(values) + 1).cast("int"))

    def between(self, low: int, high: int, name: str) -> Column:
        return self.number(name) % (high - low + 1) + low

    def digits(self, n: int, name: str) -> Column:
        """Exactly n digits, the first of which isn't 0."""
        return self.between(10 ** (n - 1), 10**n - 1, name).cast("string")

    def first_name(self, name: str = "first") -> Column:
        return self.pick(FIRST, name)

    def last_name(self, name: str = "last") -> Column:
        return self.pick(LAST, name)

    def full_name(self, name: str = "") -> Column:
        return F.concat_ws(" ", self.first_name(f"{name}first"), self.last_name(f"{name}last"))

    def nickname(self, first: Column, name: str = "nickname") -> Column:
        """A nickname for about half of those whose first name has one, else an empty string."""
        own = None
        for k, v in NICKNAMES.items():
            own = F.when(first == k, v) if own is None else own.when(first == k, v)
        return F.when(self.number(name) % 2 == 1, F.coalesce(own, F.lit(""))).otherwise("")

    def gender(self) -> Column:
        return self.pick(GENDERS, "gender")

    def street(self, name: str = "street") -> Column:
        return F.concat_ws(" ", self.between(1, 9999, f"{name}-number").cast("string"), self.pick(STREETS, name), self.pick(SUFFIXES, f"{name}-suffix"))

    def city(self, name: str = "city") -> Column:
        return self.pick(CITIES, name)

    def state(self, name: str = "state", whole: bool = False) -> Column:
        return self.pick(tuple(s[whole] for s in STATES), name)

    def zip(self) -> Column:
        return self.digits(5, "zip")

    def address(self) -> Column:
        """A whole address in one of five forms."""
        street, city, state, code = self.street(), self.city(), self.state(), self.zip()
        tail = F.concat(city, F.lit(", "), state, F.lit(" "), code)
        forms = (
            F.concat(street, F.lit(", "), tail), F.concat(street, F.lit(" | "), tail), F.concat(street, F.lit(", "), city, F.lit(" "), state, F.lit(" "), code),
            F.concat_ws(" / ", street, city, self.state(whole=True), code), F.concat(street, F.lit("; "), tail),
        )
        return self.one_of(forms, "address-form")

    def one_of(self, forms: tuple[Column, ...], name: str) -> Column:
        out, n = None, self.number(name) % len(forms)
        for i, f in enumerate(forms):
            out = F.when(n == i, f) if out is None else out.when(n == i, f)
        return out

    def day(self, low: int, high: int, name: str) -> Column:
        """A date of the years low to high, 28 days in each month."""
        part = lambda a, b, n: F.lpad(self.between(a, b, f"{name}-{n}").cast("string"), 2, "0")
        return F.concat_ws("-", self.between(low, high, f"{name}-year").cast("string"), part(1, 12, "month"), part(1, 28, "day")).cast("date")

    def date(self, low: int = 1950, high: int = 2024, name: str = "date") -> Column:
        """A date in one of eleven forms."""
        day = self.day(low, high, name)
        return self.one_of(tuple(F.date_format(day, f) for f in DATE_FORMS), f"{name}-form")

    def datetime(self, year: int = 2024, name: str = "datetime") -> Column:
        part = lambda b, n: F.lpad(self.between(0, b, f"{name}-{n}").cast("string"), 2, "0")
        return F.concat(F.date_format(self.day(year, year, name), "MM/dd/yyyy"), F.lit(" "), part(23, "hour"), F.lit(":"), part(59, "minute"))

    def phone(self, name: str = "phone") -> Column:
        """A phone number in one of three forms."""
        a, b, c = self.between(200, 999, f"{name}-area").cast("string"), self.digits(3, f"{name}-office"), self.digits(4, f"{name}-line")
        forms = (F.concat(F.lit("+1"), a, b, c), F.concat(F.lit("+1 "), F.concat_ws("-", a, b, c)), F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c))
        return self.one_of(forms, f"{name}-form")

    def fax(self, name: str = "fax") -> Column:
        return F.concat_ws("-", self.between(200, 999, f"{name}-area").cast("string"), self.digits(3, f"{name}-office"), self.digits(4, f"{name}-line"))

    def domain(self) -> Column:
        return self.pick(DOMAINS, "domain")

    def email(self) -> Column:
        return F.concat(F.lower(self.first_name("email-first")), self.digits(2, "email-number"), F.lit("@"), self.domain())

    def ssn(self) -> Column:
        """A social security number with hyphens, blanks or neither."""
        parts = (self.digits(3, "ssn-1"), self.digits(2, "ssn-2"), self.digits(4, "ssn-3"))
        return self.one_of(tuple(F.concat_ws(sep, *parts) for sep in ("-", " ", "")), "ssn-form")

    def mrn(self) -> Column:
        return F.concat(F.lit("MRN-"), self.digits(6, "mrn"))

    def health_plan(self) -> Column:
        return F.concat(self.pick(PLANS, "plan"), F.lit("-"), self.digits(9, "plan-number"))

    def account(self) -> Column:
        return F.concat(F.lit("ACCT-"), self.digits(8, "account"))

    def drivers_license(self) -> Column:
        return F.concat(self.state("license-state"), F.lit("-"), self.digits(8, "license"))

    def vehicle(self) -> Column:
        """17 characters of an alphabet of 33."""
        return F.concat(*(F.substring(F.lit(VIN), (self.number(f"vin-{i}") % len(VIN) + 1).cast("int"), 1) for i in range(17)))

    def plate(self) -> Column:
        letters = F.concat(*(F.chr(self.number(f"plate-{i}") % 26 + 65) for i in range(3)))
        return F.concat(letters, F.lit("-"), self.digits(4, "plate"))

    def device(self) -> Column:
        return F.concat(F.lit("(01)"), self.digits(14, "device"), F.lit("(17)"), self.digits(6, "device-date"))

    def url(self) -> Column:
        return F.concat(F.lit("https://www."), self.domain(), F.lit("/"))

    def portal(self) -> Column:
        return F.concat(F.lit("https://portal."), F.lower(self.last_name("portal-1")), F.lower(self.last_name("portal-2")), F.lit(".org/patient"))

    def ip(self) -> Column:
        return F.concat_ws(".", *(self.between(0, 255, f"ip-{i}").cast("string") for i in range(4)))

    def provider(self) -> Column:
        return F.concat_ws(" ", self.pick(TITLES, "title"), self.full_name("provider-"))

    def hospital(self) -> Column:
        return F.concat_ws(" ", self.city("hospital-city"), self.pick(HOSPITALS, "hospital"))


def context(draw: Draw, as_of: Column) -> Column:
    """A patient's whole made-up context as one struct; everything in it follows from the draw's key."""
    first, last, born, form = draw.first_name(), draw.last_name(), draw.day(1939, 1998, "dob"), "dob-form"
    before = F.struct(F.month(as_of), F.dayofmonth(as_of)) < F.struct(F.month(born), F.dayofmonth(born))
    group = lambda **fields: F.struct(*(c.alias(k) for k, c in fields.items()))
    return group(
        first_name=first, last_name=last, full_name=F.concat_ws(" ", first, last), nickname=draw.nickname(first), dob=draw.one_of(tuple(F.date_format(born, f) for f in DATE_FORMS), form),
        age=F.year(as_of) - F.year(born) - before.cast("int"), gender=draw.gender(), ssn=draw.ssn(), mrn=draw.mrn(), phone=draw.phone(), email=draw.email(),
        address=group(street=draw.street(), city=draw.city(), state=draw.state(), zip=draw.zip()),
        emergency_contact=group(name=draw.full_name("contact-"), phone=draw.phone("contact-phone"), relationship=draw.pick(RELATIONS, "relation")),
        insurance=group(plan_id=draw.health_plan(), provider=draw.pick(INSURERS, "insurer")), drivers_license=draw.drivers_license(),
        provider=group(name=draw.provider(), phone=draw.phone("provider-phone"), fax=draw.fax("provider-fax")), facility=group(name=draw.hospital(), phone=draw.phone("facility-phone"), fax=draw.fax("facility-fax")),
        encounter_date=draw.date(2024, 2024, "encounter"), encounter_datetime=draw.datetime(2024, "encounter-time"),
    )


#: The fields that are added to a patient's record, in order; those that nothing is drawn for stay empty.
INJECTED = (
    "email", "fax", "health_plan_id", "account_number", "vehicle_id", "license_plate", "ip_address", "patient_portal_url", "emergency_contact_name", "emergency_contact_phone",
    "emergency_contact_relationship", "provider_fax", "provider_email", "facility_name", "facility_phone", "facility_fax", "device_id", "scanner_id",
)
#: The placeholder that stands for each field of a record.
PLACEHOLDERS = {
    "full_name": "NAME", "first_name": "FIRST_NAME", "last_name": "LAST_NAME", "birth_date": "DOB", "age": "AGE", "gender": "GENDER", "ssn": "SSN", "mrn": "MRN", "drivers_license": "DRIVERS_LICENSE",
    "passport": "PASSPORT", "phone": "PHONE", "address_line": "ADDRESS", "city": "CITY", "state": "STATE", "zip_code": "ZIP", "full_address": "FULL_ADDRESS", "email": "EMAIL", "fax": "FAX",
    "health_plan_id": "HEALTH_PLAN_ID", "account_number": "ACCOUNT_NUMBER", "vehicle_id": "VEHICLE_ID", "license_plate": "LICENSE_PLATE", "ip_address": "IP_ADDRESS", "patient_portal_url": "URL",
    "emergency_contact_name": "EMERGENCY_CONTACT_NAME", "emergency_contact_phone": "EMERGENCY_CONTACT_PHONE", "device_id": "DEVICE_ID", "provider_name": "PROVIDER_NAME", "provider_phone": "PROVIDER_PHONE",
    "provider_fax": "PROVIDER_FAX", "facility_name": "FACILITY_NAME", "facility_phone": "FACILITY_PHONE", "facility_fax": "FACILITY_FAX", "encounter_date": "ENCOUNTER_DATE", "encounter_datetime": "ENCOUNTER_DATETIME",
}


def injected(draw: Draw, first: Column, last: Column, provider: Column, location: Column) -> Column:
    """What a clinical record lacks, as a struct of INJECTED: drawn once for each row, so a second injection gives the same.

    The mail address is made of what there is of the name. The facility is the provider's name, else the place's, else made up.
    """
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    named = F.nullif(F.concat_ws(".", F.lower(some(first)), F.lower(some(last))), F.lit(""))
    values = {
        "email": F.coalesce(F.concat(named, F.lit("@"), draw.domain()), draw.email()), "fax": draw.fax(), "health_plan_id": draw.health_plan(), "account_number": draw.account(),
        "vehicle_id": draw.vehicle(), "license_plate": draw.plate(), "ip_address": draw.ip(), "facility_name": F.coalesce(some(provider), some(location), draw.hospital()),
        "facility_phone": draw.phone("facility-phone"), "facility_fax": draw.fax("facility-fax"),
    }
    return F.struct(*(values.get(k, F.lit("")).alias(k) for k in INJECTED))


def placeholder_map() -> Column:
    """map<field, `{{PLACEHOLDER}}`>."""
    return F.create_map(*(F.lit(x) for k, v in PLACEHOLDERS.items() for x in (k, "{{" + v + "}}")))


def vocabulary(words: DataFrame, column: str) -> DataFrame:
    """(place, word, size): the different values of a column, numbered from 0 in their order over all tasks; size is their number.

    Null isn't a word. A vocabulary of any size: nothing of it passes through one task or the driver but its length.
    """
    own = words.select(F.col(column).cast("string").alias("word")).filter("word IS NOT NULL").distinct()
    placed = numbered(own.withColumn("all", F.lit(1)), ["all"], ["word"], "n").select((F.col("n") - 1).alias("place"), "word")
    return placed.join(F.broadcast(own.agg(F.count("*").alias("size"))))


def drawn(df: DataFrame, known: DataFrame, number: Column, name: str) -> DataFrame:
    """df with a word of a vocabulary for each row, by a number of the row; null where the vocabulary is empty."""
    size = F.broadcast(known.agg(F.max("size").alias("__size")))
    rows = df.join(size).withColumn("__place", F.when(F.col("__size") > 0, number % F.col("__size")))
    return rows.join(known.select(F.col("place").alias("__place"), F.col("word").alias(name)), "__place", "left").drop("__place", "__size")
