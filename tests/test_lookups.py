"""Look-ups on planted rows: ties, empty sides, both directions."""

from tessera.operators import lookups

FACT = "s string, p string, o string, seq long"


def test_first_places(spark):
    table = spark.createDataFrame
    facts = table([("entity:b", "with", "entity:x", 0), ("entity:b", "http://x/onto#LocatedIn", "entity:y", 2), ("entity:a", "in", "entity:z", 1)], FACT)
    goals = table([(1, None), (2, "B"), (3, "concept:thing"), (4, "concept:none"), (5, " ")], "goal_id long, entity_type string")
    types, above = table([("entity:b", "concept:tool")], "id string, type string"), table([("concept:tool", "concept:thing")], "child string, parent string")
    got = {r.goal_id: (r.s, r.p, r.o) for r in lookups.first_places(goals, facts, types, above, ["in", "locatedIn"]).collect()}
    a, b = ("entity:a", "in", "entity:z"), ("entity:b", "locatedin", "entity:y")
    assert got == {1: a, 2: b, 3: b, 5: a}


def test_temporal_answers(spark):
    table = spark.createDataFrame
    facts = table([("entity:a", "before", "entity:b", 0.9, 1), ("entity:a", "before", "concept:c", 0.9, 2), ("entity:a", "before", "entity:a", 0.9, 3), ("entity:d", "after", "entity:e_f", 0.9, 4), ("entity:d", "after", "entity:g", 0.9, 5)], "s string, p string, o string, conf double, seq long")
    goals = table([(1, "before", "entity:a", None), (2, "http://x#After", "entity:d", None), (3, "before", None, "entity:b"), (4, "during", "entity:a", None)], "goal_id long, predicate string, subject string, object string")
    got = {(r.goal_id, r.answer, r.best) for r in lookups.temporal_answers(goals, facts).collect()}
    assert got == {(1, "entity:b", True), (2, "entity:e_f", True), (2, "entity:g", False), (3, "entity:a", True)}


def test_predicates_between(spark):
    table = spark.createDataFrame
    rules = table([(("x", "p", "y"), ("b", "http://x#Causes", "a"), 1), (("x", "p", "y"), ("c", "later", "a"), 0)], "ant struct<s string, p string, o string>, con struct<s string, p string, o string>, seq long")
    pairs = table([("a", "b"), ("a", "c"), ("a", "d")], "a string, b string")
    got = {(r.a, r.b, r.p, r.way) for r in lookups.predicates_between(pairs, table([("c", "http://x#With", "a", 9), ("a", "on", "c", 10)], FACT), rules).collect()}
    assert got == {("a", "b", "causes", "rule"), ("a", "c", "with", "fact"), ("a", "d", None, None)}


def test_label_links_and_faults(spark):
    table = spark.createDataFrame
    labels = table([("i:1", "Main Pump"), ("i:2", "Valve")], "iri string, label string")
    phrases = table([(1, "main_pump"), (2, "valve"), (3, "bus"), (4, None)], "key long, phrase string")
    known = table([("concept:main_pump",), ("entity:main_pump",)], "symbol string")
    assert [tuple(r) for r in lookups.label_links(phrases, labels, known).collect()] == [(1, "i:1", "entity:main_pump")]
    rows = table([("i", "w", "0.5", "weight"), ("i", "w", "half", "weight"), ("i", "w", None, "weight"), ("i", "t", "{object}", "template"), ("i", "t", "x", "template"), ("i", "t", "{object}", "subject_template")], "iri string, annotation string, value string, kind string")
    assert sorted((r.value or "", r.fault) for r in lookups.annotation_faults(rows).collect()) == [("", "not a number"), ("half", "not a number"), ("x", "no placeholder"), ("{object}", "no subject")]
