"""Clinical bundles at size: nothing of them is broadcast, they are made in tasks of bounded size, and a bundle is looked at once."""

import json

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import fhir as H
from cloakwork.plans import catalogue
from cloakwork.sources.files import spread


def bundles(spark, *entries):
    text = [(k, json.dumps({"entry": [{"resource": r} | ({"fullUrl": r.pop("fullUrl")} if "fullUrl" in r else {}) for r in e]})) for k, e in enumerate(entries)]
    return H.resources(spark.createDataFrame(text, "k long, bundle string"), "k")


def visit(i, **more):
    return {"resourceType": "Encounter", "id": i} | more


def condition(name, ref):
    return {"resourceType": "Condition", "code": {"coding": [{"code": "c", "display": name}]}, "encounter": {"reference": ref}}


def request(ref):
    return {"resourceType": "MedicationRequest", "status": "active", "medicationReference": {"reference": ref}}


def drug(i, name):
    return {"resourceType": "Medication", "id": i} | ({"code": {"coding": [{"display": name}]}} if name else {})


ODD = [
    [visit("e1"), visit("e2"), condition("A", "urn:uuid:e1"), condition("B", "urn:uuid:e2"), {"resourceType": "Device", "type": {"coding": [{"display": "Pump"}]}}],
    [condition("C", "x")],  # no encounter: all belong
    [visit(None), condition("D", "")],  # an encounter without id: all belong
    [request("urn:uuid:m"), drug("m", "old"), drug("m", "new"), request("Medication/n"), drug("n", "kept"), drug("n", None), request("gone"), request(None)],
]


@pytest.mark.parametrize("at", [-1, -2, 0, 1, 5])
def test_an_index_is_as_good_as_a_table_of_encounters(spark, at):
    rows = bundles(spark, *ODD)
    by_table = H.clinical(rows, "k", H.chosen(H.encounters(rows, "k"), "k", at))
    got = sorted(map(tuple, H.clinical(rows, "k", at).collect()))
    assert got == sorted(map(tuple, by_table.collect()))
    assert ("Pump" in {r[4] for r in got}) and ("A" in {r[4] for r in got if r[0] == 0}) == (at in (-2, 0, 5))


def test_medications_take_the_last_name_of_their_reference(spark):
    got = [r.display for r in H.clinical(bundles(spark, *ODD), "k").filter("k = 3").orderBy("pos").collect()]
    assert got == ["new", "", "", ""]  # the last resource of id n has no name


def resolved(spark, url, ref):
    rows = bundles(spark, [drug("a", "one") | {"fullUrl": url}, drug("b", "two") | {"fullUrl": "urn:uuid:b2"}, drug("urn:uuid:a", "three")])
    wanted = spark.createDataFrame([(0, ref, "x"), (0, ref, "x"), (1, ref, "y")], "k long, ref string, tag string")
    return [(r.k, r.tag, r.name) for r in H.referenced(H.index(rows, "k"), wanted, "k").select("k", "tag", F.get_json_object("resource", "$.code.coding[0].display").alias("name")).orderBy("k").collect()]


@pytest.mark.parametrize(("ref", "name"), [("a", "one"), ("urn:uuid:a", "three"), ("b2", "two"), ("urn:uuid:b2", "two"), ("b", "two"), ("zz", None)])
def test_references_resolved(spark, ref, name):
    assert resolved(spark, "urn:uuid:zzz", ref) == [(0, "x", name), (0, "x", name), (1, "y", None)]


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """9,000 customers in a small file."""
    d = str(tmp_path_factory.mktemp("customers"))
    spark.range(9_000).coalesce(1).select(F.col("id").alias("c_custkey")).write.parquet(f"{d}/customer.parquet")
    return d


@pytest.mark.parametrize("name", ["fhir_clinical", "resolved_references", "full_context", "fhir_providers", "patient_extensions"])
def test_no_bundle_is_broadcast(spark, customers, name):
    plan = catalogue.QUERIES[name](spark, customers)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


@pytest.mark.parametrize("name", ["fhir_clinical", "fhir_providers", "patient_extensions", "fhir_patient", "full_context", "fhir_encounters", "encounter_details", "document_previews"])
def test_bundles_of_a_small_file_are_made_in_several_tasks(spark, customers, name):
    """One pass over the bundles, which need no shuffle themselves: only keys are dealt out."""
    df = catalogue.QUERIES[name](spark, customers)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() == 3 and plan.count("Scan parquet") == plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["document_types", "resource_types", "encounter_types", "encounter_groups"])
def test_counts_of_bundles_are_made_in_several_tasks(spark, customers, name):
    assert "REPARTITION_BY_NUM" in catalogue.QUERIES[name](spark, customers)._jdf.queryExecution().executedPlan().toString()


def test_spread(spark):
    assert spread(spark.range(25), "id", 10).rdd.getNumPartitions() == 3 and spread(spark.range(0), "id", 10).rdd.getNumPartitions() == 1
    assert spread(spark.range(25), "id", 10).count() == 25


def test_affiliations_pair_all_of_a_bundle(spark):
    doctor = lambda n: {"resourceType": "Practitioner", "name": [{"family": n}]}
    place = lambda n: {"resourceType": "Organization", "name": n}
    got = H.affiliations(bundles(spark, [doctor("A"), place("X"), doctor("B"), place("Y")], [doctor("C")], [place("Z")]), "k")
    assert sorted((r.k, r.provider.name, r.organization.name) for r in got.collect()) == [(0, "A", "X"), (0, "A", "Y"), (0, "B", "X"), (0, "B", "Y")]


def test_context_of_odd_bundles(spark):
    """Parts that a bundle lacks are null; a bundle without a patient has no row; n counts encounters in bundle order."""
    patient = {"resourceType": "Patient", "id": "p", "extension": [{"url": H.MAIDEN, "valueString": "Moe"}]}
    rows = bundles(spark, [patient], [visit("e")], [visit("e1"), patient, visit("e2"), condition("A", "e1"), condition("B", "e2")])
    got = {r.k: r for r in H.full_context(rows, "k", F.lit("2024-03-01").cast("date")).collect()}
    assert set(got) == {0, 2} and got[0].patient.id == "p" and got[0].patient.mothers_maiden_name == "Moe"
    assert [got[0][c] for c in ("encounters", "current_encounter", "clinical", "providers", "organizations")] == [None] * 5
    assert [(v.n, v.id) for v in got[2].encounters] == [(0, "e1"), (1, "e2")] and got[2].current_encounter.id == "e2"
    assert [c.display for c in got[2].clinical] == ["B"]
