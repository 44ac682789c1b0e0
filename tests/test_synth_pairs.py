"""Keys and templates: all pairs, broadcast and beyond the bound."""

from cloakwork.operators import synth as Y


def test_pairs_beyond_the_broadcast_bound(spark, monkeypatch):
    keys = spark.range(30).selectExpr("id", "concat('k', id) name")
    templates = spark.range(7).selectExpr("concat('t', id) template", "concat('text ', id % 3) text")
    few = sorted(map(tuple, Y.paired(keys, templates).collect()))
    monkeypatch.setattr(Y, "BROADCAST_TEMPLATES", 2)
    monkeypatch.setattr(Y, "SALTS", 5)
    many = Y.paired(keys, templates)
    assert sorted(map(tuple, many.select("id", "name", "template", "text").collect())) == few and len(few) == 210
    assert "Cartesian" not in many._jdf.queryExecution().executedPlan().toString()
