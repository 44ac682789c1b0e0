"""Queries of clinical bundles, made-up people, injection, note writing and files.

Bundles here vary with the customer: k % 3 + 1 encounters of several classes, with and without reasons, a note as an
attachment, and references with and without a prefix.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fhir as H, people as P, synth as Y, writing as N
from ..sources import files as FS
from ..sources.files import spread, table
from .catalogue import query

_CLASSES = ("ambulatory", "inpatient", "wellness", "emergency")
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _customers(spark, d):
    return spread(table(spark, d, "customer").select("c_custkey"), "c_custkey")


def _varied(spark, d):
    """(c_custkey, bundle) as JSON text."""
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))

    def encounter(n: int):
        kind = F.element_at(F.array(*map(F.lit, _CLASSES)), ((k + n) % 4 + 1).cast("int"))
        er = (k % 5 == 0) & F.lit(n == 0)
        reason = F.when((k + n) % 2 == 0, text('"reasonCode":[{"coding":[{"code":"r","display":"Reason ', k % 4, '"}]},{"coding":[{"display":"Also"}]}],')).otherwise("")
        provider = F.when(k % 7 != 0, text('"serviceProvider":{"display":"Clinic ', k % 7, '"},')).otherwise("")
        return text(
            '{"fullUrl":"urn:uuid:e', str(n), "-", k, '","resource":{"resourceType":"Encounter","id":"e', str(n), "-", k, '","class":{"code":"', kind, '"},"type":[{"coding":[{"code":"', F.when(er, "50849002").otherwise(f"18{n}"),
            '","display":"', F.when(er, "Emergency room admission").otherwise(f"Visit {n}"), '"}]}],', reason, provider, '"location":[{"location":{"display":"Ward ', k % 6, '"}},{"location":{"display":"Hall"}}],',
            '"participant":[{"type":[{"coding":[{"code":"PPRF"}]}],"individual":{"display":"Dr Stone7"}}],"period":{"start":"2024-0', str(n + 1), '-15T14:05:00+00:00","end":"2024-0', str(n + 1), '-15T15:00:00+00:00"}}}',
        )

    patient = text(
        '{"fullUrl":"urn:uuid:p', k, '","resource":{"resourceType":"Patient","id":"p', k, '","gender":"male","birthDate":"1970-01-0', k % 9 + 1, '","name":[{"use":"official","family":"Hale3","given":["Ida', k, '"]},{"use":"usual","given":["Ids"]}],',
        '"address":[{"line":["', k, ' Elm"],"city":"', F.when(k % 2 == 0, "Erie").otherwise(""), '","state":"PA","country":"US"}],"extension":[{"url":"', H.RACE, '","extension":[{"url":"x","valueCoding":{"display":"Race ', k % 3, '"}},{"url":"text","valueString":"R', k % 3, '"}]},',
        '{"url":"', H.BIRTH_PLACE, '","valueAddress":{"city":"Lund","state":"S', k % 4, '","country":"SE"}},{"url":"', H.MAIDEN, '","valueString":"Moe', k, '"}]}}',
    )
    note = F.regexp_replace(F.base64(F.encode(F.concat(F.lit("Note on "), k.cast("string"), F.repeat(F.lit(" été"), 150)), "utf-8")), r"\s", "")
    document = text('{"resource":{"resourceType":"DocumentReference","id":"d', k, '"', F.when(k % 4 != 0, text(',"type":{"coding":[{"display":"Note ', k % 4, '"}]}')).otherwise(""), ',"content":[{"attachment":{"data":"', note, '"}},{"attachment":{}}]}}')
    condition = lambda i: text('{"resource":{"resourceType":"Condition","id":"c', str(i), "-", k, '","code":{"coding":[{"code":"c","display":"Condition ', str(i), '"}]},"encounter":{"reference":"urn:uuid:e', k % 3, "-", k, '"},"onsetDateTime":"2024-01-01"}}')
    doctor = text('{"resource":{"resourceType":"Practitioner","id":"t', k, '","name":[{"prefix":["Dr."],"given":["Eve"],"family":"Stone7"}]}}')
    entries = [patient, encounter(0), F.when(k % 3 >= 1, encounter(1)), F.when(k % 3 == 2, encounter(2)), document, *(condition(i) for i in range(6)), doctor]
    return _customers(spark, d).select("c_custkey", F.concat(F.lit('{"entry":['), F.concat_ws(",", *entries), F.lit("]}")).alias("bundle"))


def _rows(spark, d):
    return H.resources(_varied(spark, d), "c_custkey")


_VISITS = f"""SELECT c_custkey AS k, n, {_LIST(_CLASSES)}[((c_custkey + n) % 4 + 1)::INT] AS class, c_custkey % 5 = 0 AND n = 0 AS er,
CASE WHEN (c_custkey + n) % 2 = 0 THEN 'Reason ' || c_custkey % 4 END AS reason FROM customer, range(3) r(n) WHERE n <= c_custkey % 3"""


@query(f"""WITH v AS (SELECT *, CASE WHEN er THEN '50849002' ELSE '18' || n END AS code, CASE WHEN er THEN 'Emergency room admission' ELSE 'Visit ' || n END AS display FROM ({_VISITS})),
r AS (SELECT *, row_number() OVER (PARTITION BY code, display, class ORDER BY k, n) AS r FROM v)
SELECT code, display, class, count(*) AS n, array_to_string(list_sort(list_distinct(list(coalesce(reason, 'N/A')) FILTER (r <= 5))), '|') AS reasons,
CASE WHEN code = '50849002' THEN 'emergency_dept' WHEN class = 'ambulatory' THEN 'progress_note' WHEN class = 'inpatient' THEN 'discharge_summary' WHEN class = 'wellness' THEN 'wellness_visit' ELSE 'general_note' END AS template FROM r GROUP BY code, display, class""")
def encounter_groups(spark, d):
    return H.encounter_groups(H.encounters(_rows(spark, d), "c_custkey"), "c_custkey").withColumn("reasons", F.array_join("reasons", "|"))


@query(f"""SELECT k AS c_custkey, n, CASE WHEN er THEN 'Emergency room admission' ELSE 'Visit ' || n END AS type_display, coalesce(reason || ', Also', '') AS reason_display, class,
'2024-0' || (n + 1) || '-15, 02:05 PM' AS start_at, 'Ward ' || k % 6 || ', Hall' AS location, CASE WHEN k % 7 > 0 THEN 'Clinic ' || k % 7 ELSE '' END AS provider, 'Dr Stone' AS practitioner FROM ({_VISITS})""")
def encounter_details(spark, d):
    out = H.encounters(_rows(spark, d), "c_custkey")
    return out.select("c_custkey", F.col("n").cast("long").alias("n"), "type_display", "reason_display", "class", "start_at", "location", "provider", "practitioner")


@query("SELECT CASE WHEN c_custkey % 4 = 0 THEN 'Unknown' ELSE 'Note ' || c_custkey % 4 END AS type, count(*) AS n FROM customer GROUP BY 1")
def document_types(spark, d):
    return H.document_types(_rows(spark, d))


@query("SELECT c_custkey, 0::INT AS part, left('Note on ' || c_custkey || repeat(' été', 150), 500) AS text, length('Note on ' || c_custkey || repeat(' été', 150)) > 500 AS more FROM customer")
def document_previews(spark, d):
    return H.previews(_rows(spark, d), "c_custkey").drop("pos")


@query("SELECT c_custkey, k AS asked, 'Encounter' AS kind FROM customer, (VALUES ('plain'), ('prefixed')) v(k) UNION ALL SELECT c_custkey, 'absent', NULL FROM customer")
def resolved_references(spark, d):
    rows = _rows(spark, d)
    k = F.col("c_custkey").cast("string")
    asked = lambda name, ref: _customers(spark, d).select("c_custkey", F.lit(name).alias("asked"), ref.alias("ref"))
    wanted = asked("plain", F.concat(F.lit("e0-"), k)).union(asked("prefixed", F.concat(F.lit("urn:uuid:e0-"), k))).union(asked("absent", F.concat(F.lit("zz"), k)))
    found = H.referenced(H.index(rows, "c_custkey"), wanted, "c_custkey")
    return found.select("c_custkey", "asked", F.get_json_object("resource", "$.resourceType").alias("kind"))


@query(f"""SELECT c_custkey, 'Race ' || c_custkey % 3 AS race, 'Moe' || c_custkey AS maiden, 'Lund, S' || c_custkey % 4 AS birth_place, 'Ids' AS nicknames, CASE WHEN c_custkey % 2 = 0 THEN 'Erie, PA' ELSE 'PA' END AS address_city_and_state,
'PA, US' AS address_state_and_country, 'Lund, S' || c_custkey % 4 AS birth_city_and_state, 'S' || c_custkey % 4 || ', SE' AS birth_state_and_country, 'Lund, S' || c_custkey % 4 || ', SE' AS birth_city_state_and_country FROM customer""")
def patient_extensions(spark, d):
    names = ("nicknames", "address_city_and_state", "address_state_and_country", "birth_city_and_state", "birth_state_and_country", "birth_city_state_and_country")
    urls = {"__race": H.RACE, "__maiden": H.MAIDEN, "__birth_place": H.BIRTH_PLACE}
    out = H.patients_extended(_rows(spark, d), "c_custkey", F.lit("2024-03-01").cast("date"), urls)
    return out.select("c_custkey", *(F.col(n).alias(n[2:]) for n in urls), *names)


_K = "c_custkey"
_CONTEXT = f"""'## Patient Information' || chr(10) || chr(10) || array_to_string(['Patient ID: p' || {_K}, 'First Name: Ida', 'Nicknames: Ids', 'Last Name: Hale', 'Full Name: Ida Hale', 'Gender: male', 'Date of Birth: 1970-01-0' || ({_K} % 9 + 1), 'Age: 54 years old',
'Address Line: ' || {_K} || ' Elm', CASE WHEN {_K} % 2 = 0 THEN 'City: Erie' END, 'State: PA', 'Country: US', 'Full Address: ' || {_K} || ' Elm, ' || CASE WHEN {_K} % 2 = 0 THEN 'Erie, ' ELSE '' END || 'PA', 'Race: R' || {_K} % 3,
'Birth City: Lund', 'Birth State: S' || {_K} % 4, 'Birth Country: SE', 'Mother''s Maiden Name: Moe'], chr(10)) || chr(10) || chr(10) || '## Conditions' || chr(10) || array_to_string(list_transform(range(5), lambda i: '- Condition ' || i), chr(10))
|| chr(10) || chr(10) || '## Provider Information' || chr(10) || chr(10) || 'Provider ID: t' || {_K} || chr(10) || 'Provider Name: Dr. Eve Stone7' || chr(10) || chr(10) || chr(10) || chr(10) || '## Encounter Information' || chr(10) || chr(10)"""


@query(f"""WITH l AS (SELECT * FROM ({_VISITS}) WHERE n = k % 3) SELECT {_K}, md5({_CONTEXT} || array_to_string(['Encounter Type: ' || CASE WHEN er THEN 'Emergency room admission' ELSE 'Visit ' || n END, 'Encounter Class: ' || class, 'Reason: ' || reason || ', Also',
'Start Date/Time: 2024-0' || (n + 1) || '-15, 02:05 PM', 'End Date/Time: 2024-0' || (n + 1) || '-15, 03:00 PM', 'Location: Ward ' || k % 6 || ', Hall', CASE WHEN k % 7 > 0 THEN 'Provider: Clinic ' || k % 7 END, 'Primary Practitioner: Dr Stone'], chr(10)) || chr(10) || chr(10)) AS text_md5,
(k % 3 + 1)::INT AS n_encounters, 6::INT AS n_clinical FROM customer JOIN l ON k = {_K}""")
def full_context(spark, d):
    out = H.full_context(_rows(spark, d), "c_custkey", F.lit("2024-03-01").cast("date"))
    return out.select("c_custkey", F.md5(H.context_text(out)).alias("text_md5"), F.size("encounters").alias("n_encounters"), F.size("clinical").alias("n_clinical"))


@query("""SELECT c_custkey, coalesce(nullif(array_to_string(list_filter(['conditions', 'devices'], lambda c: (c_custkey % 2 = 0 OR c <> 'conditions') AND (c_custkey % 3 = 0 OR c <> 'devices')), '+'), ''), 'none') AS sections,
CASE WHEN c_custkey % 2 = 0 THEN least(2, c_custkey % 4) ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 ELSE 0 END AS n_lines FROM customer WHERE c_custkey % 4 > 0 AND (c_custkey % 2 = 0 OR c_custkey % 3 = 0)""")
def clinical_limits(spark, d):
    """Two categories with up to three items; at most two conditions are listed, all devices are."""
    items = F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 4).cast("int")), lambda i: F.concat(F.lit("item "), i.cast("string")))
    none = F.array().cast("array<string>")
    displays = lambda kind: F.when((F.col("c_custkey") % {"Condition": 2, "Device": 3}.get(kind, 1) == 0) & F.lit(kind in ("Condition", "Device")), items).otherwise(none)
    rows = _customers(spark, d).filter("c_custkey % 4 > 0 AND (c_custkey % 2 = 0 OR c_custkey % 3 = 0)").withColumn("t", N.clinical_text(displays, N.Settings(max_conditions=2, max_devices=None)))
    heads = F.lower(F.array_join(F.regexp_extract_all("t", F.lit(r"## (\w+)"), 1), "+"))
    return rows.select("c_custkey", heads.alias("sections"), F.size(F.regexp_extract_all("t", F.lit("(- item)"), 1)).cast("long").alias("n_lines"))


# --- made-up people ---------------------------------------------------------------------------------------------------


def _n(name: str, key: str = "c_custkey") -> str:
    """60 bits of a digest of key, seed and name."""
    return f"(('0x' || substr(md5({key} || '|0|{name}'), 1, 15))::BIGINT)"


def _pick(values, name: str, key: str = "c_custkey") -> str:
    return f"{_LIST(values)}[({_n(name, key)} % {len(values)} + 1)::INT]"


def _int(low: int, high: int, name: str, key: str = "c_custkey") -> str:
    return f"({_n(name, key)} % {high - low + 1} + {low})"


def _dig(n: int, name: str, key: str = "c_custkey") -> str:
    return _int(10 ** (n - 1), 10**n - 1, name, key)


def _day(low: int, high: int, name: str, key: str = "c_custkey") -> str:
    return f"make_date({_int(low, high, name + '-year', key)}, {_int(1, 12, name + '-month', key)}, {_int(1, 28, name + '-day', key)})"


_FORMS = ("%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d", "%B %d, %Y", "%d %B %Y", "%b %d, %Y", "%m-%d-%Y", "%Y/%m/%d", "%d %B, %Y", "%B %d %Y", "%d-%B-%Y")


def _date(low: int, high: int, name: str, key: str = "c_custkey") -> str:
    day, n = _day(low, high, name, key), f"{_n(name + '-form', key)} % {len(_FORMS)}"
    return "CASE " + " ".join(f"WHEN {n} = {i} THEN strftime({day}, '{f}')" for i, f in enumerate(_FORMS)) + " END"


def _phone(name: str, key: str = "c_custkey") -> str:
    a, b, c, n = _int(200, 999, f"{name}-area", key), _dig(3, f"{name}-office", key), _dig(4, f"{name}-line", key), f"{_n(name + '-form', key)} % 3"
    return f"CASE {n} WHEN 0 THEN '+1' || {a} || {b} || {c} WHEN 1 THEN '+1 ' || {a} || '-' || {b} || '-' || {c} ELSE '(' || {a} || ') ' || {b} || '-' || {c} END"


def _fax(name: str) -> str:
    return f"{_int(200, 999, name + '-area')} || '-' || {_dig(3, name + '-office')} || '-' || {_dig(4, name + '-line')}"


_STREET = f"{_int(1, 9999, 'street-number')} || ' ' || {_pick(P.STREETS, 'street')} || ' ' || {_pick(P.SUFFIXES, 'street-suffix')}"
_CITY, _ST, _ZIP = _pick(P.CITIES, "city"), _pick([s for s, _ in P.STATES], "state"), _dig(5, "zip")
_STATE = _pick([s for _, s in P.STATES], "state")
_SSN = f"{_dig(3, 'ssn-1')} || s || {_dig(2, 'ssn-2')} || s || {_dig(4, 'ssn-3')}"
_VIN_SQL = " || ".join(f"'{P.VIN}'[({_n(f'vin-{i}')} % {len(P.VIN)} + 1)::INT]" for i in range(17))
_PLATE = " || ".join(f"chr(({_n(f'plate-{i}')} % 26 + 65)::INT)" for i in range(3))
_IP = " || '.' || ".join(_int(0, 255, f"ip-{i}") for i in range(4))
_PLAN = f"{_pick(P.PLANS, 'plan')} || '-' || {_dig(9, 'plan-number')}"
_HOSPITAL = f"{_pick(P.CITIES, 'hospital-city')} || ' ' || {_pick(P.HOSPITALS, 'hospital')}"


@query(f"""SELECT c_custkey, CASE {_n('address-form')} % 5 WHEN 0 THEN street || ', ' || tail WHEN 1 THEN street || ' | ' || tail WHEN 2 THEN street || ', ' || city || ' ' || st || ' ' || zip WHEN 3 THEN street || ' / ' || city || ' / ' || {_STATE} || ' / ' || zip ELSE street || '; ' || tail END AS address,
{_date(1950, 2024, 'date')} AS date, {_phone('phone')} AS phone, {_fax('fax')} AS fax, {_SSN} AS ssn, 'MRN-' || {_dig(6, 'mrn')} AS mrn, {_PLAN} AS health_plan, 'ACCT-' || {_dig(8, 'account')} AS account,
{_pick([s for s, _ in P.STATES], 'license-state')} || '-' || {_dig(8, 'license')} AS drivers_license, {_VIN_SQL} AS vehicle, {_PLATE} || '-' || {_dig(4, 'plate')} AS plate, '(01)' || {_dig(14, 'device')} || '(17)' || {_dig(6, 'device-date')} AS device,
{_IP} AS ip, {_pick(P.TITLES, 'title')} || ' ' || {_pick(P.FIRST, 'provider-first')} || ' ' || {_pick(P.LAST, 'provider-last')} AS provider, {_HOSPITAL} AS hospital,
'https://portal.' || lower({_pick(P.LAST, 'portal-1')}) || lower({_pick(P.LAST, 'portal-2')}) || '.org/patient' AS portal, 'https://www.' || {_pick(P.DOMAINS, 'domain')} || '/' AS url,
strftime({_day(2024, 2024, 'datetime')}, '%m/%d/%Y') || ' ' || lpad({_int(0, 23, 'datetime-hour')}::VARCHAR, 2, '0') || ':' || lpad({_int(0, 59, 'datetime-minute')}::VARCHAR, 2, '0') AS datetime
FROM (SELECT *, street, city, st, zip, city || ', ' || st || ' ' || zip AS tail FROM (SELECT c_custkey, {_STREET} AS street, {_CITY} AS city, {_ST} AS st, ({_ZIP})::VARCHAR AS zip, ['-', ' ', ''][({_n('ssn-form')} % 3 + 1)::INT] AS s FROM customer))""")
def generators(spark, d):
    g = P.Draw(F.col("c_custkey"))
    names = ("address", "date", "phone", "fax", "ssn", "mrn", "health_plan", "account", "drivers_license", "vehicle", "plate", "device", "ip", "provider", "hospital", "portal", "url", "datetime")
    return _customers(spark, d).select("c_custkey", *(getattr(g, n)().alias(n) for n in names))


@query(f"""WITH b AS (SELECT c_custkey, {_day(1939, 1998, 'dob')} AS born FROM customer)
SELECT c_custkey, {_pick(P.FIRST, 'first')} || ' ' || {_pick(P.LAST, 'last')} AS full_name, (2024 - year(born) - CASE WHEN (3, 1) < (month(born), day(born)) THEN 1 ELSE 0 END)::INT AS age, {_pick(P.GENDERS, 'gender')} AS gender,
CASE WHEN {_n('nickname')} % 2 = 1 THEN CASE {_pick(P.FIRST, 'first')} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in P.NICKNAMES.items())} ELSE '' END ELSE '' END AS nickname,
{_pick(P.FIRST, 'contact-first')} || ' ' || {_pick(P.LAST, 'contact-last')} AS contact, {_pick(P.RELATIONS, 'relation')} AS relationship, {_PLAN} AS plan_id, {_pick(P.INSURERS, 'insurer')} AS insurer, {_date(2024, 2024, 'encounter')} AS encounter_date,
CASE {' '.join(f"WHEN {_n('dob-form')} % 11 = {i} THEN strftime(born, '{f}')" for i, f in enumerate(_FORMS))} END AS dob FROM b""")
def patient_context(spark, d):
    c = _customers(spark, d).withColumn("p", P.context(P.Draw(F.col("c_custkey")), F.lit("2024-03-01").cast("date")))
    return c.select(
        "c_custkey", "p.full_name", "p.age", "p.gender", "p.nickname", F.col("p.emergency_contact.name").alias("contact"), "p.emergency_contact.relationship", "p.insurance.plan_id",
        F.col("p.insurance.provider").alias("insurer"), "p.encounter_date", "p.dob",
    )


_OWN = "CASE c_custkey % 4 WHEN 0 THEN 'ann.lee@' || {d} WHEN 1 THEN 'ann@' || {d} WHEN 2 THEN 'lee@' || {d} ELSE lower({f}) || {n} || '@' || {d} END"


@query(f"""SELECT c_custkey, {_OWN.format(d=_pick(P.DOMAINS, 'domain'), f=_pick(P.FIRST, 'email-first'), n=_dig(2, 'email-number'))} AS email, {_VIN_SQL} AS vehicle_id, {_IP} AS ip_address, '' AS patient_portal_url,
CASE c_custkey % 3 WHEN 0 THEN 'Clinic' WHEN 1 THEN 'Ward' ELSE {_HOSPITAL} END AS facility_name, {_fax('facility-fax')} AS facility_fax, 18::INT AS n_fields FROM customer""")
def injected_record(spark, d):
    k = F.col("c_custkey")
    first, last = F.when(k % 4 < 2, "Ann"), F.when(k % 4 % 2 == 0, "Lee")
    rows = _customers(spark, d).withColumn("i", P.injected(P.Draw(k), first, F.when(k % 4 != 1, last), F.when(k % 3 == 0, "Clinic").otherwise(""), F.when(k % 3 < 2, "Ward")))
    fields = ("email", "vehicle_id", "ip_address", "patient_portal_url", "facility_name", "facility_fax")
    return rows.select("c_custkey", *(f"i.{f}" for f in fields), F.lit(len(rows.schema["i"].dataType.fields)).alias("n_fields"))


_PLACES = "SELECT * FROM (VALUES ('full_name', '{{NAME}}'), ('first_name', '{{FIRST_NAME}}'), ('last_name', '{{LAST_NAME}}'), ('birth_date', '{{DOB}}'), ('age', '{{AGE}}'), ('gender', '{{GENDER}}'), ('ssn', '{{SSN}}'), ('mrn', '{{MRN}}'), ('drivers_license', '{{DRIVERS_LICENSE}}'), ('passport', '{{PASSPORT}}'), ('phone', '{{PHONE}}'), ('address_line', '{{ADDRESS}}'), ('city', '{{CITY}}'), ('state', '{{STATE}}'), ('zip_code', '{{ZIP}}'), ('full_address', '{{FULL_ADDRESS}}'), ('email', '{{EMAIL}}'), ('fax', '{{FAX}}'), ('health_plan_id', '{{HEALTH_PLAN_ID}}'), ('account_number', '{{ACCOUNT_NUMBER}}'), ('vehicle_id', '{{VEHICLE_ID}}'), ('license_plate', '{{LICENSE_PLATE}}'), ('ip_address', '{{IP_ADDRESS}}'), ('patient_portal_url', '{{URL}}'), ('emergency_contact_name', '{{EMERGENCY_CONTACT_NAME}}'), ('emergency_contact_phone', '{{EMERGENCY_CONTACT_PHONE}}'), ('device_id', '{{DEVICE_ID}}'), ('provider_name', '{{PROVIDER_NAME}}'), ('provider_phone', '{{PROVIDER_PHONE}}'), ('provider_fax', '{{PROVIDER_FAX}}'), ('facility_name', '{{FACILITY_NAME}}'), ('facility_phone', '{{FACILITY_PHONE}}'), ('facility_fax', '{{FACILITY_FAX}}'), ('encounter_date', '{{ENCOUNTER_DATE}}'), ('encounter_datetime', '{{ENCOUNTER_DATETIME}}')) v(field, placeholder)"


@query(f"WITH m AS (SELECT field, placeholder, row_number() OVER (ORDER BY field) - 1 AS i, count(*) OVER () AS n FROM ({_PLACES}) v(field, placeholder)) SELECT c_custkey, field, placeholder FROM customer JOIN m ON c_custkey % n = i")
def placeholder_map(spark, d):
    """A field for each customer in turn, with the placeholder that stands for it."""
    entries = F.array_sort(F.map_entries(P.placeholder_map()))
    own = F.element_at(entries, (F.col("c_custkey") % F.size(entries) + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", own.alias("e")).select("c_custkey", F.col("e.key").alias("field"), F.col("e.value").alias("placeholder"))


@query(f"""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{{3,11}}')) AS word FROM documents)),
v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i, count(*) OVER () AS n FROM w)
SELECT c_custkey, a.word AS first_name, b.word AS last_name FROM customer JOIN v a ON a.i = {_n('first')} % a.n JOIN v b ON b.i = {_n('last')} % b.n""")
def vocabulary_names(spark, d):
    """Names drawn from a vocabulary table: the capitalised words of all documents."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,11})"), 1)).alias("word"))
    known = P.vocabulary(words, "word")
    draw = P.Draw(F.col("c_custkey"))
    rows = P.drawn(table(spark, d, "customer").select("c_custkey"), known, draw.number("first"), "first_name")
    return P.drawn(rows, known, draw.number("last"), "last_name")


_LETTER = "Dear {{NAME}}, your visit on {{DOB}} in {{CITY}} is noted. Call {{PHONE}} or write to {{EMAIL}}."
_KEY3 = "(c_custkey || '|letter|' || copy)"
_LETTER_SQL = f"""'Dear ' || {_pick(P.FIRST, 'first', _KEY3)} || ' ' || {_pick(P.LAST, 'last', _KEY3)} || ', your visit on ' || {_date(1940, 2005, 'dob', _KEY3)} || ' in ' || {_pick(P.CITIES, 'city', _KEY3)} || ' is noted. Call ' || {_phone('phone', _KEY3)}
|| ' or write to ' || lower({_pick(P.FIRST, 'first', _KEY3)}) || '.' || lower({_pick(P.LAST, 'last', _KEY3)}) || '@' || {_pick(P.DOMAINS, 'domain', _KEY3)} || '.'"""


@query(f"SELECT c_custkey, copy::INT AS copy, {_LETTER_SQL} AS text, 5::INT AS n_entities, 2::INT AS n_copies FROM customer, range(1, 3) r(copy)")
def synthetic_notes(spark, d):
    templates = spark.range(1).select(F.lit("letter").alias("template"), F.lit(_LETTER).alias("text"))
    out = Y.notes(_customers(spark, d), "c_custkey", templates, 2)
    return out.select("c_custkey", "copy", "text", F.size("phi_entities").alias("n_entities"), F.lit(2).alias("n_copies"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'NT' ELSE upper(left(k, 2)) END || '_' || lpad(doc_id::VARCHAR, 6, '0') AS numbered, CASE WHEN doc_id % 7 = 0 THEN 'NT' ELSE upper(left(k, 2)) END || '_20240105093007' AS timed,
CASE WHEN doc_id % 7 = 0 OR k = 'other_note' THEN 'Write as an experienced clinical writer.' WHEN k = 'radiology_report' THEN 'Write as the radiologist who reads the images and answers the referring colleague.' ELSE 'Write as a doctor of internal medicine on the morning round.' END AS role,
array_to_string(CASE WHEN doc_id % 2 = 0 THEN ['emergency_dept', 'discharge_summary', 'progress_note', 'radiology_report', 'telehealth_consult'] WHEN k = 'other_note' THEN ['progress_note'] ELSE [k, 'progress_note'] END, '+') AS kinds
FROM (SELECT *, ['radiology_report', 'progress_note', 'other_note'][(doc_id % 3 + 1)::INT] AS k FROM documents)""")
def note_identity(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("radiology_report", "progress_note", "other_note"))), (F.col("doc_id") % 3 + 1).cast("int"))
    own = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(kind)
    asked = F.when(F.col("doc_id") % 2 == 0, "ALL").otherwise(F.concat(F.initcap(kind), F.lit(" , nothing,progress_note")))
    at = F.lit("2024-01-05 09:30:07").cast("timestamp")
    return table(spark, d, "documents").select("doc_id", N.note_id(own, F.col("doc_id")).alias("numbered"), N.note_id(own, at=at).alias("timed"), N.role(own).alias("role"), F.array_join(N.kinds_of(asked), "+").alias("kinds"))


@query("SELECT c_custkey, 'letter' AS template, json_extract_string(m, '$.note_type') AS note_type, 3 AS n_placeholders FROM (SELECT c_custkey, '{\"note_type\": \"letter ' || c_custkey % 3 || '\"}' AS m FROM customer)")
def template_manifests(spark, d):
    notes = _customers(spark, d).withColumn("text", F.lit("{{B}} of {{A}} and {{B}}, {{C}}"))
    out = Y.manifest(notes, "c_custkey", F.concat(F.lit("letter "), (F.col("c_custkey") % 3).cast("string")), F.lit("2024-01-01"), template=True)
    names = F.from_json(F.get_json_object("manifest", "$.placeholders"), "array<string>")
    return out.select("c_custkey", F.lit("letter").alias("template"), F.get_json_object("manifest", "$.note_type").alias("note_type"), F.size(names).alias("n_placeholders"))
