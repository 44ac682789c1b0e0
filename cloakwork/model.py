"""Vocabularies and schemas: entity types, their codes, order and labels, and the shapes of files and state rows."""

from __future__ import annotations

from pyspark.sql import types as T

#: Short codes of a compact detection, in its order, and the entity types they stand for.
SHORT_CODES = {
    "nam": "person_name", "adr": "address", "dat": "date", "phn": "phone_number", "fax": "fax_number", "eml": "email", "ssn": "ssn", "mrn": "medical_record_number",
    "hpb": "health_plan_beneficiary_number", "acc": "account_number", "lic": "certificate_or_license_number", "vin": "vehicle_identifier", "dev": "device_identifier",
    "url": "url", "ip": "ip_address", "bio": "biometric_identifier", "img": "photographic_image", "oth": "other",
}
#: The order in which types are redacted; unknown types follow, by name.
TYPE_ORDER = (
    "medical_record_number", "ssn", "device_identifier", "vehicle_identifier", "health_plan_beneficiary_number", "account_number", "certificate_or_license_number", "email", "url",
    "ip_address", "phone_number", "fax_number", "person_name", "address", "biometric_identifier", "photographic_image", "date", "other",
)
#: Labels of types in tags with a template; others are upper-cased.
TAG_LABELS = {
    "person_name": "NAME", "address": "ADDR", "date": "DATE", "phone_number": "PHONE", "fax_number": "FAX", "email": "EMAIL", "ssn": "SSN", "social_security_number": "SSN",
    "medical_record_number": "MRN", "health_plan_beneficiary_number": "HPBN", "account_number": "ACCOUNT", "certificate_or_license_number": "LICENSE", "vehicle_identifier": "VIN",
    "device_identifier": "DEVICE", "url": "URL", "ip_address": "IP", "biometric_identifier": "BIOMETRIC", "photographic_image": "PHOTO", "age": "AGE", "other": "OTHER",
}
#: Manifest types that predicted types are compared with; others are upper-cased.
MANIFEST_TYPES = {
    "person_name": "NAME", "date": "DATE", "phone_number": "PHONE", "fax_number": "FAX", "email": "EMAIL", "postal_address": "ADDRESS", "ssn": "SSN", "medical_record_number": "MRN",
    "health_plan_beneficiary_number": "HEALTH_PLAN_ID", "account_number": "ACCOUNT_NUMBER", "certificate_or_license_number": "LICENSE", "vehicle_identifier": "VEHICLE_ID",
    "device_identifier": "DEVICE_ID", "url": "URL", "ip_address": "IP_ADDRESS", "biometric_identifier": "BIOMETRIC_ID", "photographic_image": "PHOTO", "other": "OTHER",
}
#: Types whose counters a new batch starts with at 0.
SEEDED_TYPES = (
    "person_name", "address", "date", "other", "phone_number", "certificate_or_license_number", "vehicle_identifier", "medical_record_number", "health_plan_beneficiary_number",
    "account_number", "email", "ssn", "fax_number", "device_identifier", "ip_address", "biometric_identifier", "unknown",
)
#: Marital status codes.
MARITAL = {"A": "Annulled", "D": "Divorced", "I": "Interlocutory", "L": "Legally Separated", "M": "Married", "C": "Common Law", "P": "Polygamous", "T": "Domestic Partner", "U": "Unmarried", "S": "Never Married", "W": "Widowed"}

MAX_CHARS = 20_000

ENTITY = T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])
POSITION = T.StructType([*ENTITY.fields, T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
COMPACT = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in SHORT_CODES])
RESPONSE = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("language", T.StringType()), T.StructField("pii_types", T.ArrayType(T.StringType())), T.StructField("max_entities", T.IntegerType()),
    T.StructField("response", T.StructType([T.StructField("pii_entities", T.ArrayType(ENTITY)), T.StructField("compacted", COMPACT)])),
])
POSITIONS_FILE = T.StructType([T.StructField("pii_entities", T.ArrayType(POSITION))])
MANIFEST = T.StructType([
    T.StructField("note_id", T.StringType()), T.StructField("note_type", T.StringType()), T.StructField("generated_at", T.StringType()), T.StructField("phi_entities", T.ArrayType(POSITION)),
    T.StructField("is_template", T.BooleanType()), T.StructField("placeholders", T.ArrayType(T.StringType())), T.StructField("source_template", T.StringType()),
])
FORMAT = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "template", "id_scheme", "created")])
