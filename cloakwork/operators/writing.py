"""What a note is written from: types, ids, settings, prompts and the context of a record as text."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .calls import Caller

#: Types of notes, and the role a writer takes for each.
ROLES = {
    "emergency_dept": "Write as the doctor on duty in an emergency room, right after the patient was seen.",
    "discharge_summary": "Write as the ward doctor who sends a patient home and informs the next practice.",
    "progress_note": "Write as a doctor of internal medicine on the morning round.",
    "radiology_report": "Write as the radiologist who reads the images and answers the referring colleague.",
    "telehealth_consult": "Write as a family doctor who has just ended a video visit.",
}
OTHER_ROLE = "Write as an experienced clinical writer."
#: What is asked for; the reference data follow.
PROMPTS = {
    "emergency_dept": "Write an emergency department note: complaint, history, examination, course and disposition.",
    "discharge_summary": "Write a discharge summary: reason for admission, hospital course, medication and follow-up.",
    "progress_note": "Write a daily progress note: what changed, findings, assessment and plan.",
    "radiology_report": "Write a radiology report: indication, technique, findings and impression.",
    "telehealth_consult": "Write a note of a telehealth visit: reason, history, advice and plan.",
}
AS_TEMPLATE = "Put a placeholder such as {{NAME}}, {{DOB}}, {{MRN}}, {{PHONE}}, {{EMAIL}}, {{ADDRESS}} or {{DATE}} wherever a value of the reference data would stand."


@dataclass(frozen=True)
class Settings:
    """How many items of each clinical category are used (None: all), and which encounter (-1: the last)."""

    max_conditions: int | None = 5
    max_medications: int | None = 5
    max_procedures: int | None = 5
    max_allergies: int | None = 5
    max_immunizations: int | None = 5
    max_observations: int | None = 10
    max_imaging_studies: int | None = 5
    max_devices: int | None = 5
    encounter_index: int = -1

    def __post_init__(self):
        if self.encounter_index < -1:
            raise ValueError("encounter_index must be -1 or more")
        for k, v in vars(self).items():
            if k.startswith("max_") and v is not None and v < 0:
                raise ValueError(f"{k} must be None or 0 or more")

    def limits(self) -> dict[str, int | None]:
        return {k.removeprefix("max_"): v for k, v in vars(self).items() if k.startswith("max_")}


def note_types(asked: str) -> list[str]:
    """The types in a comma-separated list, or all; unknown ones are left out."""
    if asked.lower() == "all":
        return list(ROLES)
    return [t for t in (x.strip() for x in asked.lower().split(",")) if t in ROLES]


def kinds_of(asked: Column) -> Column:
    """The same for a column of lists."""
    every = F.array(*(F.lit(t) for t in ROLES))
    parts = F.filter(F.transform(F.split(F.lower(asked), ","), lambda t: F.trim(t)), lambda t: t.isin(*ROLES))
    return F.when(F.lower(asked) == "all", every).otherwise(parts)


def note_id(kind: Column, number: Column | None = None, at: Column | None = None) -> Column:
    """`ED_000012` by a number, or `ED_20240105093007` by a time; a note of no known type is `NT`."""
    prefix = F.when(F.coalesce(kind, F.lit("unknown")) == "unknown", "NT").otherwise(F.upper(F.substring(kind, 1, 2)))
    tail = F.lpad(number.cast("string"), 6, "0") if number is not None else F.date_format(at, "yyyyMMddHHmmss")
    return F.concat(prefix, F.lit("_"), F.when(F.length(number.cast("string")) > 6, number.cast("string")).otherwise(tail) if number is not None else tail)


def role(kind: Column) -> Column:
    out = F.lit(None)
    for k, v in ROLES.items():
        out = F.when(kind == k, v).otherwise(out)
    return F.coalesce(out, F.lit(OTHER_ROLE))


def prompt(kind: str, template: bool = False) -> str:
    if kind not in PROMPTS:
        raise ValueError(f"no prompt for notes of type {kind}")
    return PROMPTS[kind] + ("\n\n" + AS_TEMPLATE if template else "")


def included(value: Column, zero: bool = False) -> Column:
    """Whether a value goes into a context: not null, not blank, and not 0 unless allowed (as for an age)."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return (text != "") if zero else (text != "") & (text != "0")


def lines(fields: list[tuple[str, Column]], zero: tuple[str, ...] = ("Age",)) -> Column:
    """`Label: value` lines of the values that are included."""
    return F.concat_ws("\n", *(F.when(included(v, k in zero), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields))


#: Labels of a patient's, an encounter's and a provider's fields, in the order in which they are given.
PATIENT_LABELS = {
    "id": "Patient ID", "mrn": "MRN", "ssn": "SSN", "drivers_license": "Driver's License", "passport": "Passport", "first_name": "First Name", "nicknames": "Nicknames", "last_name": "Last Name",
    "full_name": "Full Name", "gender": "Gender", "birth_date": "Date of Birth", "age": "Age", "phone": "Phone", "address_line": "Address Line", "city": "City", "state": "State", "zip_code": "Zip Code",
    "country": "Country", "full_address": "Full Address", "race": "Race", "ethnicity": "Ethnicity", "marital_status": "Marital Status", "birth_city": "Birth City", "birth_state": "Birth State",
    "birth_country": "Birth Country", "mothers_maiden_name": "Mother's Maiden Name", "disability_adjusted_life_years": "Disability Adjusted Life Years",
    "quality_adjusted_life_years": "Quality Adjusted Life Years",
}
ENCOUNTER_LABELS = {
    "type_display": "Encounter Type", "class": "Encounter Class", "reason_display": "Reason", "start_at": "Start Date/Time", "end_at": "End Date/Time", "location": "Location", "provider": "Provider",
    "practitioner": "Primary Practitioner",
}
PROVIDER_LABELS = {"id": "Provider ID", "name": "Provider Name"}
#: Headers of the clinical categories, in order, and their setting.
CATEGORIES = {
    "Condition": ("Conditions", "conditions"), "MedicationRequest": ("Medications", "medications"), "Procedure": ("Procedures", "procedures"), "Immunization": ("Immunizations", "immunizations"),
    "ImagingStudy": ("Imaging Studies", "imaging_studies"), "Device": ("Devices", "devices"),
}


def labelled(labels: dict[str, str], value: Callable[[str], Column], zero: tuple[str, ...] = ("age",)) -> Column:
    """The lines of a record's fields; an age has `years old` after it."""
    rows = []
    for field, name in labels.items():
        v = value(field)
        text = F.concat(v.cast("string"), F.lit(" years old")) if field == "age" else v.cast("string")
        rows.append(F.when(included(v, field in zero), F.concat(F.lit(f"{name}: "), text)))
    return F.concat_ws("\n", *rows)


def category(items: Column, header: str, most: int | None) -> Column:
    """A header and a line for each of the first items (0 or None: all); null without items."""
    kept = F.slice(items, 1, most) if most else items
    return F.when(F.size(items) > 0, F.concat(F.lit(f"## {header}\n"), F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), "\n")))


def clinical_text(displays: Callable[[str], Column], settings: Settings = Settings()) -> Column:  # noqa: B008
    """The categories that have items, parted by blank lines. displays(kind): their names, array<string>."""
    limits = settings.limits()
    return F.concat_ws("\n\n", *(category(displays(k), header, limits[name]) for k, (header, name) in CATEGORIES.items()))


def whole_text(patient: Column, clinical: Column, providers: Column, encounters: Column) -> Column:
    """The sections that aren't empty, parted by blank lines; providers and encounters: array<string>, each with a blank line after it."""
    after = lambda items, header: F.when(F.size(items) > 0, F.concat_ws("\n\n", F.lit(header), F.array_join(F.flatten(F.transform(F.filter(items, lambda x: x != ""), lambda x: F.array(x, F.lit("")))), "\n\n")))
    own = F.when(patient != "", F.concat(F.lit("## Patient Information\n\n"), patient))
    return F.concat_ws("\n\n", own, F.nullif(clinical, F.lit("")), after(providers, "## Provider Information"), after(encounters, "## Encounter Information"))


def _note(text: str) -> str:
    if not isinstance(text, str) or not text.strip():
        raise ValueError("no text")
    return text


def written(
    tasks: DataFrame, write: Callable[[str, str], str], prompt_col: str = "prompt", role_col: str = "role", per_minute: int = 150,
    partitions: int = 8, sleep: Callable[[float], None] = time.sleep, window: int = 8, budget: int = 100,
) -> DataFrame:
    """tasks with `note`, `retries` and `error` from a writer: write(role, prompt). An error or an empty note marks its row.

    A task has `window` calls in flight and shares `budget` retries. Its share of per_minute is per_minute over the partitions, so all tasks
    together keep the limit, however many run at once.
    """
    schema = T.StructType([*tasks.schema.fields, T.StructField("note", T.StringType()), T.StructField("retries", T.IntegerType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]):
        caller = Caller(write, _note, window, budget=budget, per_minute=per_minute / partitions, sleep=sleep)
        for b in batches:
            out = list(caller.all(zip(b[role_col], b[prompt_col], strict=True)))
            yield b.assign(note=[o.value for o in out], retries=[o.retries for o in out], error=[o.error for o in out])

    return tasks.repartition(partitions).mapInPandas(run, schema)
