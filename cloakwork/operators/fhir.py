"""Patient, encounter and clinical context from FHIR bundles, by schema-on-read over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import age, joined, lookup, marital, readable, rounded, strip_digits
from . import writing

#: Extension addresses.
RACE = "http://hl7.org/fhir/us/core/StructureDefinition/us-core-race"
ETHNICITY = "http://hl7.org/fhir/us/core/StructureDefinition/us-core-ethnicity"
MAIDEN = "http://hl7.org/fhir/StructureDefinition/patient-mothersMaidenName"
BIRTH_PLACE = "http://hl7.org/fhir/StructureDefinition/patient-birthPlace"
DALY = "http://synthetichealth.github.io/synthea/disability-adjusted-life-years"
QALY = "http://synthetichealth.github.io/synthea/quality-adjusted-life-years"

CODING = "array<struct<system:string,code:string,display:string>>"
PATIENT = (
    f"struct<id:string,gender:string,birthDate:string,deceasedDateTime:string,identifier:array<struct<type:struct<coding:{CODING}>,system:string,value:string>>,"
    "name:array<struct<use:string,family:string,given:array<string>>>,telecom:array<struct<system:string,value:string>>,"
    "address:array<struct<line:array<string>,city:string,state:string,postalCode:string,country:string>>,"
    "extension:array<struct<url:string,extension:array<struct<url:string,valueString:string>>,valueAddress:struct<city:string,state:string,country:string>,valueString:string,valueDecimal:double>>,"
    f"maritalStatus:struct<coding:{CODING}>>"
)


def resources(bundles: DataFrame, key: str, json: str = "bundle") -> DataFrame:
    """(key, pos, kind, id, full_url, resource): a row for each entry, in bundle order. Bad JSON gives none."""
    rows = bundles.select(key, F.posexplode(F.try_variant_get(F.try_parse_json(json), "$.entry", "array<variant>")).alias("pos", "e"))
    get = lambda p, t="string": F.try_variant_get("e", p, t)
    return rows.select(key, "pos", get("$.resource.resourceType").alias("kind"), get("$.resource.id").alias("id"), get("$.fullUrl").alias("full_url"), get("$.resource", "variant").alias("resource"))


def _first(items: Column, test) -> Column:
    return F.get(F.filter(items, test), 0)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def patients(rows: DataFrame, key: str, as_of: Column) -> DataFrame:
    """The first patient of each bundle; strings are empty where missing."""
    return _first_patients(rows, key).select(key, *_person(F.col("p"), as_of))


def _first_patients(rows: DataFrame, key: str) -> DataFrame:
    """(key, j, p): the first patient of each bundle as JSON text and as PATIENT."""
    first = rows.filter("kind = 'Patient'").groupBy(key).agg(F.min_by(F.to_json("resource"), "pos").alias("j"))
    return first.withColumn("p", F.from_json("j", PATIENT))


def _person(p: Column, as_of: Column) -> list[Column]:
    code = lambda c: _text(_first(p["identifier"], lambda i: F.exists(i["type"]["coding"], lambda x: x["code"] == c))["value"])
    ext = lambda u: _first(p["extension"], lambda x: x["url"] == u)
    given = strip_digits(F.array_join(_first(p["name"], lambda n: n["use"] == "official")["given"], " "))
    last = strip_digits(F.get(p["name"], 0)["family"])
    at, born = F.get(p["address"], 0), ext(BIRTH_PLACE)["valueAddress"]
    line, city, state, country, code_ = _text(F.get(at["line"], 0)), _text(at["city"]), _text(at["state"]), _text(at["country"]), _text(at["postalCode"])
    day = lambda c: F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return [
        _text(p["id"]).alias("id"), code("MR").alias("mrn"), code("SS").alias("ssn"), code("DL").alias("drivers_license"), code("PPN").alias("passport"),
        given.alias("first_name"), last.alias("last_name"), F.trim(F.concat_ws(" ", given, last)).alias("full_name"), _text(p["gender"]).alias("gender"), _text(p["birthDate"]).alias("birth_date"),
        age(day(p["birthDate"]), F.coalesce(day(p["deceasedDateTime"]), as_of)).alias("age"), line.alias("address_line"), city.alias("city"), state.alias("state"), country.alias("country"), code_.alias("zip_code"),
        joined(line, city, state, code_).alias("full_address"), joined(city, state).alias("address_city_and_state"), joined(state, country).alias("address_state_and_country"), joined(city, state, country).alias("city_state_country"),
        _text(F.array_join(_first(p["name"], lambda n: n["use"] == "usual")["given"], " ")).alias("nicknames"), _text(_first(p["telecom"], lambda t: t["system"] == "phone")["value"]).alias("phone"),
        _text(F.get(ext(RACE)["extension"], 1)["valueString"]).alias("race"), _text(F.get(ext(ETHNICITY)["extension"], 1)["valueString"]).alias("ethnicity"), strip_digits(ext(MAIDEN)["valueString"]).alias("mothers_maiden_name"),
        _text(born["city"]).alias("birth_city"), _text(born["state"]).alias("birth_state"), _text(born["country"]).alias("birth_country"),
        joined(_text(born["city"]), _text(born["state"])).alias("birth_city_and_state"), joined(_text(born["state"]), _text(born["country"])).alias("birth_state_and_country"),
        joined(_text(born["city"]), _text(born["state"]), _text(born["country"])).alias("birth_city_state_and_country"), rounded(ext(DALY)["valueDecimal"]).alias("disability_adjusted_life_years"),
        rounded(ext(QALY)["valueDecimal"]).alias("quality_adjusted_life_years"), marital(F.get(p["maritalStatus"]["coding"], 0)["code"]).alias("marital_status"),
    ]


ENCOUNTER = (
    f"struct<type:array<struct<coding:{CODING}>>,reasonCode:array<struct<coding:{CODING}>>,location:array<struct<location:struct<display:string>>>,"
    f"participant:array<struct<type:array<struct<coding:{CODING}>>,individual:struct<display:string>>>>"
)


def encounters(rows: DataFrame, key: str) -> DataFrame:
    """A row for each encounter, n counts from 0 in bundle order; strings are empty where missing.

    display and code are the first type's, type_display and reason_display join all, reason is the first, else N/A; start_at and
    end_at are readable times; practitioner is the primary performer, without digits.
    """
    out = rows.filter("kind = 'Encounter'").withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("pos")) - 1).withColumn("e", F.from_json(F.to_json("resource"), ENCOUNTER))
    return out.select(key, "pos", "n", *_visit())


def _visit() -> list[Column]:
    """What encounters() has of `id` and `resource`, whose JSON as ENCOUNTER is `e`."""
    get = lambda p: _text(F.try_variant_get("resource", p, "string"))
    every = lambda c: F.array_join(F.flatten(F.transform(F.col(f"e.{c}"), lambda t: F.filter(t["coding"]["display"], lambda d: d.isNotNull()))), ", ")
    primary = _first(F.col("e.participant"), lambda p: F.exists(p["type"], lambda t: F.exists(t["coding"], lambda c: c["code"] == "PPRF")))
    return [
        F.col("id"), get("$.status").alias("status"), get("$.class.code").alias("class"), get("$.type[0].coding[0].code").alias("code"), get("$.type[0].coding[0].display").alias("display"),
        get("$.period.start").alias("start"), get("$.period.end").alias("end"), get("$.serviceProvider.display").alias("provider"), _text(every("type")).alias("type_display"),
        _text(every("reasonCode")).alias("reason_display"), F.coalesce(F.try_variant_get("resource", "$.reasonCode[0].coding[0].display", "string"), F.lit("N/A")).alias("reason"),
        readable(get("$.period.start")).alias("start_at"), readable(get("$.period.end")).alias("end_at"), _text(F.array_join(F.col("e.location.location.display"), ", ")).alias("location"),
        strip_digits(primary["individual"]["display"]).alias("practitioner"),
    ]


#: What a note of an encounter could be, by its type's code, else by its class.
BY_CODE = {"50849002": "emergency_dept", "308646001": "death_certificate"}
BY_CLASS = {"ambulatory": "progress_note", "inpatient": "discharge_summary", "wellness": "wellness_visit"}


def suggestion(code: Column, kind: Column) -> Column:
    return F.coalesce(lookup(BY_CODE, code), lookup(BY_CLASS, kind), F.lit("general_note"))


def encounter_groups(found: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(code, display, class, n, reasons, template): the different reasons of the first encounters of each type and class.

    `unknown` and `Unknown` stand for what is missing. Rows are combined before the shuffle; of reasons, only the first
    `most` encounters of each part are kept.
    """
    named = found.select(key, "pos", "reason", *(F.coalesce(F.nullif(c, F.lit("")), F.lit(v)).alias(c) for c, v in (("code", "unknown"), ("display", "Unknown"), ("class", "unknown"))))
    groups = named.groupBy("code", "display", "class").agg(F.count("*").alias("n"))
    w = W.partitionBy("code", "display", "class").orderBy(key, "pos")
    few = named.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most)
    reasons = few.groupBy("code", "display", "class").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return groups.join(reasons, ["code", "display", "class"]).withColumn("template", suggestion(F.col("code"), F.col("class"))).orderBy("code", "display", "class")


def chosen(found: DataFrame, key: str, index: int = -1) -> DataFrame:
    """The encounter at an index of each bundle; -1 the last one. Out of range: none."""
    n = F.count("*").over(W.partitionBy(key))
    return found.withColumn("__n", n).filter(F.col("n") == (F.col("__n") + index if index < 0 else F.lit(index))).drop("__n")


#: kind: (code or name, display, date) paths of clinical resources.
CLINICAL = {
    "Condition": ("$.code.coding[0].code", "$.code.coding[0].display", ("$.onsetDateTime",)),
    "Procedure": ("$.code.coding[0].code", "$.code.coding[0].display", ("$.performedDateTime", "$.performedPeriod.start")),
    "MedicationRequest": ("$.status", "$.medicationCodeableConcept.coding[0].display", ()),
    "Immunization": ("$.vaccineCode.coding[0].code", "$.vaccineCode.coding[0].display", ("$.occurrenceDateTime",)),
    "ImagingStudy": ("$.modality[0].code", "$.description", ("$.started",)),
    "Device": ("$.udiCarrier[0].deviceIdentifier", "$.type.coding[0].display", ()),
}


def clinical(rows: DataFrame, key: str, encounter: DataFrame | int | None = None) -> DataFrame:
    """(key, pos, kind, code, display, date) of clinical resources; with encounter only those whose reference contains its id, and all devices.

    encounter is a row (key, id) for each bundle, or an index of its encounters (-1 the last), which needs no second look at the bundles. A
    medication that is only referenced takes its name from the referenced resource of the bundle.
    """
    items = _named(rows, key)
    if isinstance(encounter, int):
        bundle, visit = W.partitionBy(key), F.col("kind") == "Encounter"
        items = items.withColumn("__n", F.count_if(visit).over(bundle.orderBy("pos")) - 1).withColumn("__all", F.count_if(visit).over(bundle))
        at = F.col("__all") + encounter if encounter < 0 else F.lit(encounter)
        items = items.withColumn("__enc", F.max(F.when(visit & (F.col("__n") == at), F.col("id"))).over(bundle))
    out = items.filter(F.col("kind").isin(*CLINICAL)).select("*", *_item())
    if encounter is not None:
        if not isinstance(encounter, int):
            out = out.join(encounter.select(key, F.col("id").alias("__enc")).hint("merge"), key, "left")
        out = out.filter(f"kind = 'Device' OR {_BELONGS}")
    return out.select(key, "pos", "kind", "code", "display", "date")


#: Whether a clinical resource belongs to the encounter whose id is __enc.
_BELONGS = "__enc IS NULL OR contains(__ref, __enc)"


def _named(rows: DataFrame, key: str) -> DataFrame:
    """rows with `__name`, the name of the resource of the bundle that a clinical one refers to as its medication; of equal ids the last.

    Every resource goes out once as it is and once as what can be referred to, so that names are found in one pass over the bundles.
    """
    get = lambda p: F.try_variant_get("resource", p, "string")
    med = F.when(F.col("kind").isin(*CLINICAL), F.regexp_replace(get("$.medicationReference.reference"), "^(urn:uuid:|.*/)", ""))
    side = lambda own, ref: F.struct(F.lit(own).alias("own"), ref.alias("ref"))
    both = rows.withColumn("__s", F.explode(F.array(side(True, med), side(False, F.col("id"))))).filter("__s.own OR __s.ref IS NOT NULL")
    both = both.select(key, "pos", "kind", "id", F.col("__s.own").alias("__own"), F.col("__s.ref").alias("__to"), F.when(F.col("__s.own"), F.col("resource")).alias("resource"), F.when(~F.col("__s.own"), get("$.code.coding[0].display")).alias("__display"))
    name = F.max_by("__display", F.when(~F.col("__own"), F.col("pos"))).over(W.partitionBy(key, "__to"))
    return both.withColumn("__name", name).filter("__own").drop("__own", "__to", "__display")


def _item() -> list[Column]:
    """code, display, date and __ref of a clinical resource with `__name`."""
    get = lambda p: F.try_variant_get("resource", p, "string")
    by = lambda i: F.coalesce(*(F.when(F.col("kind") == k, _text(F.coalesce(*map(get, (v[i] if i == 2 else (v[i],)))) if v[i] else F.lit(""))) for k, v in CLINICAL.items()))
    display = F.when(by(1) == "", _text(F.col("__name"))).otherwise(by(1))
    return [by(0).alias("code"), display.alias("display"), by(2).alias("date"), _text(get("$.encounter.reference")).alias("__ref")]


def providers(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter("kind = 'Practitioner'").select(key, "pos", "id", *_provider())


def _provider() -> list[Column]:
    parts = F.from_json(F.to_json("resource"), "struct<name:array<struct<prefix:array<string>,given:array<string>,family:string>>>")["name"]
    n = F.get(parts, 0)
    return [F.trim(F.concat_ws(" ", _text(F.array_join(n["prefix"], " ")), _text(F.array_join(n["given"], " ")), _text(n["family"]))).alias("name")]


def organizations(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter("kind = 'Organization'").select(key, "pos", "id", *_organization())


def _organization() -> list[Column]:
    r = F.from_json(F.to_json("resource"), "struct<name:string,telecom:array<struct<system:string,value:string>>,address:array<struct<line:array<string>,city:string,state:string,postalCode:string>>>")
    at = F.get(r["address"], 0)
    return [_text(r["name"]).alias("name"), _text(_first(r["telecom"], lambda t: t["system"] == "phone")["value"]).alias("phone"), _text(F.array_join(at["line"], ", ")).alias("address"), _text(at["city"]).alias("city"), _text(at["state"]).alias("state"), _text(at["postalCode"]).alias("zip_code")]


def affiliations(rows: DataFrame, key: str) -> DataFrame:
    """(key, provider, organization): every practitioner of a bundle with every organisation of it, as structs, in one pass over the bundles."""
    kind = lambda k, cols: _listed(F.col("kind") == k, ["pos", "id", *cols])
    wanted = rows.filter("kind IN ('Practitioner', 'Organization')")
    both = wanted.groupBy(key).agg(kind("Practitioner", _provider()).alias("p"), kind("Organization", _organization()).alias("o"))
    return both.select(key, "o", F.explode("p").alias("provider")).select(key, "provider", F.explode("o").alias("organization"))


def _listed(which: Column, cols: list) -> Column:
    """The rows of a group for which a condition holds, as structs in order of their first column."""
    return F.array_sort(F.collect_list(F.when(which, F.struct(*cols))))


def resource_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def document_types(rows: DataFrame) -> DataFrame:
    """(type, n) of document references, most first."""
    kind = F.coalesce(F.try_variant_get("resource", "$.type.coding[0].display", "string"), F.lit("Unknown"))
    return document_references(rows).groupBy(kind.alias("type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def document_references(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'DocumentReference'")


def previews(rows: DataFrame, key: str, most: int = 500) -> DataFrame:
    """(key, pos, part, text, more): the first characters of each attachment of the document references; null where it can't be decoded."""
    content = F.from_json(F.to_json("resource"), "struct<content:array<struct<attachment:struct<data:string>>>>")["content"]
    parts = document_references(rows).select(key, "pos", F.posexplode(content).alias("part", "c")).filter("c.attachment.data IS NOT NULL")
    text = F.try_validate_utf8(F.try_to_binary("c.attachment.data", F.lit("base64")).cast("string"))
    return parts.select(key, "pos", "part", text.alias("__t")).select(key, "pos", "part", F.left("__t", F.lit(most)).alias("text"), (F.length("__t") > most).alias("more"))


def index(rows: DataFrame, key: str) -> DataFrame:
    """(key, ref, resource): every resource by its id and by its full URL; of equal ones the last in the bundle."""
    refs = rows.select(key, "pos", "resource", F.explode(F.array_distinct(F.array_compact(F.array("id", "full_url")))).alias("ref"))
    return refs.groupBy(key, "ref").agg(F.max_by(F.to_json("resource"), "pos").alias("resource"))


def referenced(index_: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted (key, ref and more) with `resource`, what it refers to: as the reference is, else with `urn:uuid:` before it.

    Whatever is indexed can so be asked for by up to two names. Resources are shuffled, never broadcast: Spark takes bundles for much
    smaller than they are.
    """
    prefix = "urn:uuid:"
    short = F.when(F.col("ref").startswith(prefix), F.substr("ref", F.lit(len(prefix) + 1)))
    side = lambda plain, ref: F.struct(F.lit(plain).alias("plain"), ref.alias("ref"))
    names = index_.select(key, "resource", F.explode(F.array(side(True, F.col("ref")), side(False, short))).alias("s")).filter("s.ref IS NOT NULL")
    of = lambda plain: F.first(F.when(F.col("s.plain") == plain, F.col("resource")), ignorenulls=True)
    found = names.groupBy(key, F.col("s.ref").alias("ref")).agg(F.coalesce(of(True), of(False)).alias("resource"))
    return wanted.join(found.hint("merge"), [key, "ref"], "left")


EXTENSION = "struct<url:string,extension:array<struct<valueCoding:struct<display:string>,valueString:string>>,valueString:string,valueAddress:struct<city:string,state:string>>"


def extension_value(extensions: Column, url: str) -> Column:
    """The value of the first extension with that address that has one: nested coding or string, own string, or `city, state`. extensions: array of EXTENSION."""

    def value(x: Column) -> Column:
        nested = F.get(F.filter(F.transform(x["extension"], lambda n: F.when(n["valueCoding"].isNotNull(), _text(n["valueCoding"]["display"])).otherwise(n["valueString"])), lambda v: v.isNotNull()), 0)
        at = F.when(x["valueAddress"].isNotNull(), F.concat(_text(x["valueAddress"]["city"]), F.lit(", "), _text(x["valueAddress"]["state"])))
        return F.coalesce(nested, x["valueString"], at)

    return F.get(F.filter(F.transform(F.filter(extensions, lambda x: x["url"] == url), value), lambda v: v.isNotNull()), 0)


def patients_extended(rows: DataFrame, key: str, as_of: Column, extensions: dict[str, str]) -> DataFrame:
    """patients(), and for each name of extensions (name: address) the extension's value."""
    first = _first_patients(rows, key).withColumn("x", F.from_json(F.get_json_object("j", "$.extension"), f"array<{EXTENSION}>"))
    return first.select(key, *(extension_value(F.col("x"), url).alias(n) for n, url in extensions.items()), *(c for c in _person(F.col("p"), as_of)))


def full_context(rows: DataFrame, key: str, as_of: Column, encounter: int = -1) -> DataFrame:
    """(key, patient, encounters, current_encounter, clinical, providers, organizations) of each bundle with a patient.

    clinical holds what belongs to the chosen encounter (all where there is none). All parts are grouped by bundle in one pass, so
    no more than one bundle is in a row.
    """
    is_ = lambda k: F.col("kind") == k
    every = _named(rows, key).withColumn("e", F.when(is_("Encounter"), F.from_json(F.to_json("resource"), ENCOUNTER)))
    parts = every.groupBy(key).agg(
        F.min_by(F.when(is_("Patient"), F.to_json("resource")), F.when(is_("Patient"), F.col("pos"))).alias("j"),
        _listed(is_("Encounter"), ["pos", *_visit()]).alias("v"),
        _listed(F.col("kind").isin(*CLINICAL), ["pos", "kind", *_item()]).alias("c"),
        _listed(is_("Practitioner"), ["pos", "id", *_provider()]).alias("providers"),
        _listed(is_("Organization"), ["pos", "id", *_organization()]).alias("organizations"),
    )
    parts = parts.filter("j IS NOT NULL").withColumn("p", F.from_json("j", PATIENT))
    fields = [c.name for c in parts.schema["v"].dataType.elementType.fields if c.name != "pos"]
    numbered = F.transform("v", lambda v, n: F.struct(v["pos"].alias("pos"), n.alias("n"), *(v[c].alias(c) for c in fields)))
    parts = parts.withColumn("encounters", numbered)
    at = F.size("encounters") + encounter if encounter < 0 else F.lit(encounter)
    parts = parts.withColumn("current_encounter", F.get("encounters", at))
    enc = F.col("current_encounter.id")
    own = F.filter("c", lambda c: (c["kind"] == "Device") | enc.isNull() | F.contains(c["__ref"], enc))
    parts = parts.withColumn("clinical", F.transform(own, lambda c: F.struct(*(c[n].alias(n) for n in ("pos", "kind", "code", "display", "date")))))
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return parts.select(key, F.struct(*_person(F.col("p"), as_of)).alias("patient"), some("encounters"), "current_encounter", some("clinical"), some("providers"), some("organizations"))


def context_text(context: DataFrame, settings: writing.Settings = writing.Settings()) -> Column:  # noqa: B008
    """What full_context() gives as text: patient, clinical categories, providers, and the current encounter."""
    none = F.array().cast("array<string>")
    displays = lambda kind: F.coalesce(F.transform(F.filter("clinical", lambda c: c["kind"] == kind), lambda c: c["display"]), none)
    people = F.transform("providers", lambda p: writing.labelled(writing.PROVIDER_LABELS, lambda f: p[f]))
    visit = writing.labelled(writing.ENCOUNTER_LABELS, lambda f: F.col(f"current_encounter.{f}"))
    visits = F.when(F.col("current_encounter").isNotNull(), F.array(visit)).otherwise(none)
    return writing.whole_text(writing.labelled(writing.PATIENT_LABELS, lambda f: F.col(f"patient.{f}")), writing.clinical_text(displays, settings), F.coalesce(people, none), visits)
