"""Synthetic notes: templates, their values and where each value ended up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import not_in_word, quoted, starts
from .people import Draw

#: So many templates are broadcast at once.
BROADCAST_TEMPLATES = 10_000
#: Shares of the keys beyond that.
SALTS = 64
PLACEHOLDER = r"\{\{([A-Z_]+)\}\}"
#: Manifest types of placeholders; others are OTHER.
TYPES = {
    "NAME": "NAME", "FIRST_NAME": "NAME", "LAST_NAME": "NAME", "DOB": "DATE", "AGE": "DATE", "SSN": "SSN", "MRN": "MRN", "PHONE": "PHONE", "EMAIL": "EMAIL", "ADDRESS": "ADDRESS", "CITY": "ADDRESS",
    "STATE": "ADDRESS", "ZIP": "ADDRESS", "DRIVERS_LICENSE": "LICENSE", "HEALTH_PLAN_ID": "HEALTH_PLAN_ID", "ACCOUNT_NUMBER": "ACCOUNT_NUMBER", "EMERGENCY_CONTACT_NAME": "NAME",
    "EMERGENCY_CONTACT_PHONE": "PHONE", "PROVIDER_NAME": "NAME", "PROVIDER_PHONE": "PHONE", "PROVIDER_FAX": "FAX", "FACILITY_NAME": "OTHER", "FACILITY_PHONE": "PHONE", "DATE": "DATE",
    "ENCOUNTER_DATE": "DATE", "DEVICE_ID": "DEVICE_ID", "IP_ADDRESS": "IP_ADDRESS", "URL": "URL", "FAX": "FAX", "VEHICLE_ID": "VEHICLE_ID",
}


def placeholders(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), 1)))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """The template with its known placeholders replaced, all at once: a value that looks like a placeholder stays."""
    pieces, names = F.split(template, PLACEHOLDER, -1), F.regexp_extract_all(template, F.lit(PLACEHOLDER), 1)

    def value(name: Column) -> Column:
        out = None
        for k, v in values.items():
            out = F.when(name == k, v) if out is None else out.when(name == k, v)
        return F.coalesce(out, F.concat(F.lit("{{"), name, F.lit("}}")))

    filled = F.zip_with(F.slice(pieces, 1, F.size(names)), F.transform(names, value), lambda a, b: F.concat(a, b))
    return F.concat(F.array_join(filled, ""), F.element_at(pieces, -1))


def located(text: Column, values: dict[str, Column], whole: bool = False) -> Column:
    """array<struct<type, value, start, end>> of every place of each value of two or more characters, by start.

    whole: only where no word character touches the value, else anywhere.
    """
    parts = []
    for name, v in values.items():
        at = starts(text, not_in_word(v) if whole else quoted(v), length=F.length(v))
        rows = _typed(at, TYPES.get(name, "OTHER"), v)
        parts.append(F.when(F.length(v) >= 2, rows).otherwise(F.array().cast("array<struct<start:int,end:int,type:string,value:string>>")))
    by = F.array_sort(F.concat(*parts))
    return F.transform(by, lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end")))


def _typed(at: Column, kind: str, value: Column) -> Column:
    return F.transform(at, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("type"), value.alias("value")))


def patient(draw: Draw) -> dict[str, Column]:
    """Values for placeholders, drawn from the row's key."""
    first, last = draw.first_name(), draw.last_name()
    return {
        "NAME": F.concat_ws(" ", first, last), "FIRST_NAME": first, "LAST_NAME": last, "DOB": draw.date(1940, 2005, "dob"), "SSN": draw.ssn(), "MRN": draw.mrn(), "PHONE": draw.phone(), "FAX": draw.fax(),
        "CITY": draw.city(), "ZIP": draw.zip(), "ADDRESS": draw.street(), "EMAIL": F.concat(F.lower(first), F.lit("."), F.lower(last), F.lit("@"), draw.domain()), "ACCOUNT_NUMBER": draw.account(),
        "HEALTH_PLAN_ID": draw.health_plan(), "DRIVERS_LICENSE": draw.drivers_license(), "DEVICE_ID": draw.device(), "IP_ADDRESS": draw.ip(), "PROVIDER_NAME": draw.provider(), "FACILITY_NAME": draw.hospital(),
        "VEHICLE_ID": draw.vehicle(), "URL": draw.url(), "ENCOUNTER_DATE": draw.date(2024, 2024, "encounter"), "AGE": draw.between(25, 85, "age").cast("string"),
    }


def paired(keys: DataFrame, templates: DataFrame) -> DataFrame:
    """Every key row with every template.

    Few templates are broadcast. More are dealt into chunks of BROADCAST_TEMPLATES, copied for each of SALTS shares of the keys, so the rows of
    a chunk are joined in as many tasks.
    """
    chunks = 1 + templates.count() // BROADCAST_TEMPLATES
    if chunks == 1:
        return keys.join(F.broadcast(templates))
    share = F.pmod(F.xxhash64(*keys.columns), F.lit(SALTS))
    rows = keys.withColumns({"__salt": share, "__chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))})
    dealt = templates.withColumns({"__chunk": F.pmod(F.xxhash64("template", "text"), F.lit(chunks)).cast("int"), "__salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))})
    return rows.join(dealt.withColumn("__salt", F.col("__salt").cast("long")), ["__chunk", "__salt"]).drop("__chunk", "__salt")


def notes(keys: DataFrame, key: str, templates: DataFrame, count: int = 1, seed: int = 0) -> DataFrame:
    """(key, template, copy, text, phi_entities): count notes of every template (template, text) for each key.

    Only values of placeholders that some template has are drawn; all templates' names are one row that comes to the driver.
    """
    rows = paired(keys.select(key), templates).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(count))))
    used = templates.agg(F.array_distinct(F.flatten(F.collect_set(placeholders(F.col("text")))))).first()[0] or []
    values = {k: v for k, v in patient(Draw(F.col(key), F.col("template"), F.col("copy"), seed=seed)).items() if k in used}
    rows = rows.select(key, "template", "copy", "text", F.struct(F.lit(0).alias("__"), *(v.alias(k) for k, v in values.items())).alias("v"))
    own = {k: F.col(f"v.{k}") for k in values}
    out = rows.select(key, "template", "copy", fill(F.col("text"), own).alias("text"), "v")
    return out.withColumn("phi_entities", located(F.col("text"), own) if own else F.array().cast("array<struct<type:string,value:string,start:int,end:int>>")).drop("v")


def manifest(notes: DataFrame, id_col: str, kind: Column, at: Column, template: bool = False, source: Column | None = None) -> DataFrame:
    """notes with a manifest as JSON: id, type, time and what is in it; of a template its placeholders."""
    if template:
        body = F.struct(F.col(id_col).cast("string").alias("note_id"), kind.alias("note_type"), at.alias("generated_at"), F.lit(True).alias("is_template"), placeholders(F.col("text")).alias("placeholders"))
    else:
        body = F.struct(F.col(id_col).cast("string").alias("note_id"), kind.alias("note_type"), at.alias("generated_at"), F.col("phi_entities"), *([source.alias("source_template")] if source is not None else []))
    return notes.withColumn("manifest", F.to_json(body))
