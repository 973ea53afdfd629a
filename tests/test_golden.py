"""Golden rows worked out by hand for single operators."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.operators import diagnose, linking, ontology, paths, query, rules, scoring, store, text

FACT = "s string, p string, o string, conf double, seq long"
GOAL = "goal_id long, subject string, predicate string, object string, expected_type string"


def facts(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], FACT)


def ways(spark, *rows):
    return spark.createDataFrame(list(rows), "p string, p2 string, swap boolean, qmatch double")


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def axioms(spark, names, symmetric=(), inverse=(), sub=()):
    return query.rewrites(
        spark.createDataFrame([(n,) for n in names], "p string"), spark.createDataFrame([(n, True, False) for n in symmetric], "p string, symmetric boolean, transitive boolean"),
        spark.createDataFrame(list(inverse), "p string, inv string"), spark.createDataFrame(list(sub), "child string, parent string"),
    )


@pytest.mark.parametrize(
    "fact,goal,answer,score",
    [
        (("man", "wear", "hat", 0.9), (1, "man", "wear", None, None), "hat", 0.75),
        (("man", "wear", "hat", 0.9), (1, None, "wear", "hat", None), "man", 0.75),
        (("man", "wear", "hat", 0.9), (1, "hat", "under", None, None), "man", 0.725),
    ],
)
def test_relation_scores(spark, fact, goal, answer, score):
    rewrite = axioms(spark, ["wear", "under"], inverse=[("on", "under")], sub=[("wear", "on")])
    got = one(query.relation_query(spark.createDataFrame([goal], GOAL), facts(spark, fact), rewrite).filter("qmatch >= 0.9"))
    assert got["answer"] == answer
    head = spark.range(1).select(exprs.mean_score(F.lit(got["qmatch"]), F.lit(0.5), F.lit(got["conf"]), F.lit(0.6)).alias("x")).first()["x"]
    assert math.isclose(head, score, abs_tol=1e-9)


def test_symmetric(spark):
    rewrite = axioms(spark, ["with"], symmetric=["with"])
    got = one(query.relation_query(spark.createDataFrame([(1, "man", "with", None, None)], GOAL), facts(spark, ("woman", "with", "man", 0.9)), rewrite))
    assert got["answer"] == "woman" and got["qmatch"] == 1.0  # head 0.75


def test_yes_no_and_count(spark):
    rewrite = ways(spark, ("on", "wear", False, 1.0))
    goals = spark.createDataFrame([(1, "man", "on", "hat", None), (2, "woman", "on", "hat", None)], GOAL)
    got = {r["goal_id"]: (r["answer"], r["score"]) for r in query.yes_no(goals, facts(spark, ("man", "wear", "hat", 0.9)), rewrite).collect()}
    assert got[1][0] == "Yes, man on hat" and math.isclose(got[1][1], 0.95) and got[2] == ("Unknown.", None)
    counted = query.count_query(goals, spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "goal_id long, answer string"))
    assert {(r["goal_id"], r["n"]) for r in counted.collect()} == {(1, 2), (2, 0)}


def test_location_chain(spark):
    own = facts(spark, ("apple", "inside", "basket", 0.9), ("basket", "locatedIn", "kitchen", 0.9))
    got = {r["subject"]: r for r in query.location_chain(own, exprs.LOCATION_FAMILY).collect()}["apple"]
    assert (got["terminal"], got["predicate"], got["hops"]) == ("kitchen", "locatedIn", 2)
    head = (1 + 1 + 1 + got["conf"] + 0.6) / 5
    assert math.isclose(got["conf"], 0.95) and math.isclose(head, 0.91)


def test_location_chain_follows_the_first_edge_and_ends_in_cycles(spark):
    own = facts(spark, ("book", "in", "bag", 0.5), ("book", "in", "shelf", 1.0), ("bag", "in", "car", 0.9), ("car", "in", "bag", 0.9))
    got = {r["subject"]: r["terminal"] for r in query.location_chain(own, exprs.LOCATION_FAMILY).collect()}
    assert got["book"] == "car" and got["car"] == "bag"


@pytest.mark.parametrize("rule,score", [(rules.catalogue()[2], 0.81), (rules.meta_rules(["locatedIn"], [], [])[0], 0.825)])
def test_rule_action(spark, rule, score):
    own = facts(spark, ("a", "locatedIn", "b", 0.9), ("b", "locatedIn", "c", 0.9))
    got = one(rules.apply(own, rule))
    assert (got["s"], got["p"], got["o"], got["conf"]) == ("a", "locatedIn", "c", rule.weight) and math.isclose(got["score"], score)
    assert got["evidence"] == ["a locatedIn b", "b locatedIn c"]


def test_forward_chain(spark):
    rule = spark.createDataFrame([((("motor", "fail", "true", 0.9)), ("device", "stop", "true", 0.9), 0.85, 1)], "ant struct<s:string,p:string,o:string,conf:double>, con struct<s:string,p:string,o:string,conf:double>, conf double, seq long")
    got = one(rules.forward_chain(facts(spark, ("motor", "fail", "true", 0.2)), rule))
    assert (got["s"], got["p"], got["o"]) == ("device", "stop", "true") and math.isclose(got["score"], 0.875)


def test_catalogue():
    own = rules.catalogue()
    assert len(own) == 39 and sum(not r.enabled for r in own) == 2 and len(rules.usable(own)) == 37


def test_closure_is_idempotent_and_independent_of_order(spark):
    own = facts(spark, ("man", "in", "room", 1.0), ("woman", "with", "man", 0.9), ("room", "in", "house", 1.0), ("man", "wear", "hat", 0.8))
    first = rules.propagate(own, rules.catalogue()).select("s", "p", "o")
    again = rules.propagate(first.withColumn("conf", F.lit(1.0)).repartition(3), rules.catalogue()).select("s", "p", "o")
    assert {tuple(r) for r in first.collect()} == {tuple(r) for r in again.collect()}
    assert ("woman", "in", "room") in {tuple(r) for r in first.collect()} and ("hat", "in", "house") in {tuple(r) for r in first.collect()}


def test_softmax_and_rank(spark):
    got = scoring.rank(scoring.softmax(spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.1)], "goal_id long, answer string, score double"))).collect()
    prob = {r["answer"]: r["prob"] for r in got}
    assert math.isclose(prob["a"], 0.689974, abs_tol=1e-6) and math.isclose(sum(prob.values()), 1.0)
    tie = spark.createDataFrame([(1, "x", 0.5, 1.0), (1, "y", 0.5, 0.0)], "goal_id long, answer string, score double, ontology_support double")
    assert scoring.rank(tie).filter("rank = 1").first()["answer"] == "y"  # less support ranks first


def test_specificity(spark):
    rows = [("entity:wheel_motor", 1.10), ("entity:power_system", 0.75), ("entity:loss_of_control", 0.85), ("concept:true", 0.55)]
    for r in spark.createDataFrame(rows, "x string, v double").select("v", exprs.specificity(F.col("x")).alias("got")).collect():
        assert math.isclose(r["got"], r["v"], abs_tol=1e-9)


def test_hashed_trigram(spark):
    got = one(linking.hashed_vectors(spark.createDataFrame([("abc",)], "label string")))
    assert (got["slot"], got["w"]) == (98, 1.0)


def test_intent(spark):
    own = spark.createDataFrame([(1, "What is the man wearing?")], "id long, text string").select("id", text.features(F.col("text")).alias("features"))
    got = one(text.intents(own, "id"))
    assert got["intent"] == "question" and got["score"] == 0.84  # has_wh, has_what and the question mark


def test_temporal_support(spark):
    own = facts(spark, ("spikes", "before", "failure", 0.9))
    pairs = spark.createDataFrame([("spikes", "failure"), ("failure", "spikes")], "cause string, effect string")
    got = {r["cause"]: r["support"] for r in diagnose.temporal_support(pairs, own).collect()}
    assert got == {"spikes": 0.4, "failure": 0.2}


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    assert ontology.closure(edges, "child", "parent").count() == 9


def test_clusters(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51)], "a long, b long")
    got = {r["node"]: r["cluster"] for r in ontology.clusters(edges).collect()}
    assert all(got[k] == 0 for k in range(31)) and got[51] == 50


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("a", "d", 3), ("d", "c", 4)], "s string, o string, seq long")
    got = one(paths.shortest_paths(edges, spark.createDataFrame([("a", "c")], "a string, b string")))
    assert got["path"] == "a > b > c" and got["hops"] == 2
    best = paths.best_chains(spark.createDataFrame([("a", "b", 0.5), ("b", "c", -0.25), ("a", "c", 0.1)], "s string, o string, w double"), spark.createDataFrame([("a",)], "start string"))
    assert {r["node"]: r["path"] for r in best.collect()} == {"b": "a > b", "c": "a > b > c"}


def test_insert_if_new_keeps_the_first_confidence(spark):
    known = facts(spark, ("a", "p", "b", 0.9))
    new = facts(spark, ("a", "p", "b", 0.1), ("c", "p", "d", 0.3), ("c", "p", "d", 0.7))
    got = one(store.insert_if_new(known, new))
    assert (got["s"], got["conf"]) == ("c", 0.3)


def test_surface_patterns(spark):
    said = [(1, "The man is in the room."), (2, "The woman is wearing a red hat"), (3, "A cat is an animal."), (4, "no pattern here"), (5, None), (6, "The box is next to the wall.")]
    got = {r["id"]: (r["s"], r["p"], r["o"]) for r in text.surface_facts(spark.createDataFrame(said, "id long, text string"), "id").collect()}
    assert got == {1: ("entity:man", "in", "entity:room"), 2: ("entity:woman", "wear", "entity:red_hat"), 3: ("entity:cat", "rdf:type", "concept:animal"), 6: ("entity:box", "nextTo", "entity:wall")}


def test_expansion_and_conjunction(spark):
    own = spark.createDataFrame([("entity:loss_of_power", "cause", "entity:stop", 0.9), ("entity:rover", "control", "concept:false", 0.9)], "s string, p string, o string, conf double")
    got = {(r["s"], r["p"], r["conf"]) for r in text.expanded(own).collect()}
    assert got == {("entity:power", "cause", 0.9), ("entity:power", "fail", 0.8), ("entity:rover", "control", 0.9), ("entity:rover", "fail", 0.8)}
    both = text.conjoined(spark.createDataFrame([("entity:man_and_boy", "at", "entity:table")], "s string, p string, o string"))
    assert {r["s"] for r in both.collect()} == {"entity:man", "entity:boy"}


def test_aliases(spark):
    known = spark.createDataFrame([("entity:power_bus",), ("entity:main_power_bus",), ("concept:motor",), ("concept:motors",), ("entity:bus",)], "symbol string")
    got = {tuple(r) for r in ontology.aliases(known, known).select("symbol", "alias").collect()}
    assert ("entity:power_bus", "entity:main_power_bus") in got and ("concept:motor", "concept:motors") in got and ("entity:bus", "entity:power_bus") not in got


def test_axiom_lines(spark):
    """Malformed lines, comments and blanks are no axioms; escapes, languages and types are read."""
    from tessera.sources import axioms

    rdfs, owl, rdf = axioms.RDFS, axioms.OWL, axioms.RDF
    text = [f"<a> <{rdfs}subClassOf> <b> .", f"<a> <{rdfs}subClassOf> <b> .", rf'<a> <{rdfs}label> "say \"x\" \\ y"@en .', f"<p> <{rdf}type> <{owl}TransitiveProperty> .", f"<p> <{rdf}type> <c> .", '<a> <size> "4"^^<int> .', "# comment", "", None, "<a> <b>", '<a> <e> "" .']
    got = {tuple(r) for r in axioms.tables(axioms.triples(spark.createDataFrame([(x,) for x in text], "value string"))).select("kind", "s", "o").collect()}
    assert got == {("subclass", "a", "b"), ("label", "a", 'say "x" \\ y'), ("transitive", "p", owl + "TransitiveProperty"), ("target", "p", "c"), ("annotation", "a", "4"), ("annotation", "a", "")}


def test_canonical_types(spark):
    from tessera.operators import ontology

    labels = spark.createDataFrame([("http://a/1", "Old Ring"), ("http://syn/9", "old_ring"), ("http://a/2", "Box"), ("http://a/0", "box")], "iri string, label string")
    types = spark.createDataFrame([("concept:old_ring",), ("entity:box",), ("concept:thing",), ("concept:lamp",)], "type string")
    assert dict(map(tuple, ontology.canonical_types(types, labels, "http://syn/").collect())) == {"concept:old_ring": "http://syn/9", "entity:box": "http://a/0", "concept:thing": None, "concept:lamp": "concept:lamp"}
