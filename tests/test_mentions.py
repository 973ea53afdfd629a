"""Phrases, mentions, states and linking against plain versions; how many pairs are looked at."""

import random
import re
from functools import partial

import pytest
from pyspark.sql import functions as F

from tessera.operators import answers, linking, mentions, ontology, query

SYLLABLES = ["ba", "ri", "to", "ken", "mu", "sol", "an", "dre", "lix", "po", "qua", "ver", "zin", "hol", "em", "ti", "gra", "fen", "os", "wy"]


def plain(text):
    return " " + re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).strip() + " "


def test_automaton_and_join_find_the_same(spark):
    """Nested, overlapping and repeated phrases, nulls, empty texts; one automaton or a join beyond its bound."""
    rng = random.Random(1)
    phrases = ["a", "a b", "b a", "a b a", "c", "c c", "long phrase here", " ", "B, a!"]
    texts = [(1, None), (2, ""), (3, "a"), (4, "A b, a B a; c-c c"), *((10 + k, " ".join(rng.choices(["a", "b", "c", "long", "phrase", "here"], k=20))) for k in range(30))]
    own, known = spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")
    expected = []
    for key, text in texts:
        for p in {plain(p).strip() for p in phrases} - {""}:
            at = plain(text).find(f" {p} ")
            while at >= 0:
                expected.append((key, p, at + 1))
                at = plain(text).find(f" {p} ", at + 1)
    for most in (mentions.MOST_PHRASES, 3):
        assert sorted(map(tuple, mentions.occurrences(own, known, most).collect())) == sorted(expected)


def test_states_go_to_the_nearest(spark):
    texts = spark.createDataFrame([(1, "The pump works, the valve is down."), (2, "valve: down pump"), (3, "down"), (4, None), (5, "pump pump works")], "key long, text string")
    resources = spark.createDataFrame([("r:pump", "Pump"), ("r:valve", "valve"), ("r:valve", "the valve")], "resource string, phrase string")
    markers = spark.createDataFrame([("works", 1), ("down", -1)], "phrase string, status int")
    got = {(r.key, r.resource, r.status, r.distance) for r in mentions.nearest_states(texts, resources, markers).collect()}
    assert got == {(1, "r:pump", 1, 5), (1, "r:valve", -1, 9), (2, "r:pump", -1, 5), (5, "r:pump", 1, 5)}
    facts = spark.createDataFrame([("r:pump", "unavailable", "x", 0.9, 5), ("r:pump", "hasAttribute", "ok", 0.9, 3), ("r:valve", "near", "ok", 0.9, 1)], "s string, p string, o string, conf double, seq long")
    asked = spark.createDataFrame([(1, "r:pump"), (1, "r:valve"), (3, "r:valve")], "key long, resource string")
    roles = spark.createDataFrame([("ok", "resource_available")], "id string, role string")
    got = {tuple(r) for r in mentions.availability(asked, facts, roles, texts, resources, markers).collect()}
    assert got == {(1, "r:pump", 1, "role"), (1, "r:valve", -1, "text"), (3, "r:valve", 0, "none")}


def test_mentioned_questions(spark):
    known = spark.createDataFrame([("entity:main_pump", "main pump"), ("entity:relay", "relay"), ("entity:old_valve", "old valve"), ("entity:ox", "ox")], "symbol string, surface string")
    asked = [(1, "What is the relationship between the main pump and a relay?", None, None), (2, "Under what conditions does relay stop old valve near ox", None, None), (3, "main pumps and nothing", "entity:x", None), (4, None, None, "entity:y"), (5, "relationship between this and that", None, None)]
    got = {(r.key, r.symbol, r.way) for r in mentions.mentioned(spark.createDataFrame(asked, "key long, text string, subject string, object string"), known).collect()}
    assert got == {(1, "entity:main_pump", "phrase"), (1, "entity:relay", "phrase"), (2, "entity:old_valve", "phrase"), (2, "entity:relay", "surface"), (3, "entity:main_pump", "phrase"), (3, "entity:x", "side"), (4, "entity:y", "side")}


def test_mention_facts_need_two_mentions(spark):
    facts = spark.createDataFrame([("entity:a", "with", "entity:b", 0.9, 3), ("entity:b", "contains", "entity:a", 0.9, 4), ("entity:a", "powers", "entity:b", 0.9, 1), ("entity:a", "on", "entity:a", 0.9, 1), ("entity:a", "in", "entity:c", 0.9, 2)], "s string, p string, o string, conf double, seq long")
    said = spark.createDataFrame([(1, "concept:a"), (1, "entity:bs"), (2, "entity:a"), (2, "concept:a"), (3, None)], "goal long, symbol string")
    known = spark.createDataFrame([("entity:a",), ("entity:b",), ("entity:c",)], "symbol string")
    got = sorted((r.goal, r.place, r.line) for r in mentions.mention_facts(said, facts, known).collect())
    assert got == [(1, 1, "entity:b contains entity:a"), (1, 2, "entity:a with entity:b"), (2, 1, "entity:a on entity:a")]


def test_phrases_do_not_overlap_themselves_in_counts(spark, tmp_path):
    """As in the SQL: "the the the" has "the the" once, four of them have it twice; other phrases may overlap."""
    from tessera.plans import mention_queries
    from tessera.sources.facts import Tables

    spark.createDataFrame([(1, "The the cat")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    said = [(1, 0, "u", "the the the cat"), (1, 1, "u", "the, the. The the"), (1, 2, "u", "the"), (2, 0, "u", "cat the the. Cat the the"), (2, 1, "u", None)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.conv_id, r.turn, r.phrase, r.first, r.n) for r in mention_queries.phrase_occurrences(Tables(spark, str(tmp_path))).collect())
    assert got == [(1, 0, "cat", 13, 1), (1, 0, "the the", 1, 1), (1, 1, "the the", 1, 2), (2, 0, "cat", 1, 2), (2, 0, "the the", 5, 2)]


def join_rows(df):
    """Rows that the joins of a query made, largest first."""
    df.collect()
    # Rows that a join looks at and then drops by a condition on the text are not among those it makes.
    assert not re.search(r"Join \[.*substring", df._jdf.queryExecution().executedPlan().toString())
    nodes, made = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if "Join" in name:
            made.append(node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif "QueryStage" in name:
            nodes.append(node.plan())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return sorted(made, reverse=True)


def test_phrases_that_begin_alike_are_not_all_looked_at(spark):
    """Many phrases of one first word, joined: rows behind the join are those found, and the runs are in proportion to the words."""
    texts = spark.range(2000).selectExpr("id AS key", "concat('part ', id, ' is down, part ', id + 1, ' works') AS text")
    phrases = spark.range(2000).selectExpr("concat('part ', id) AS phrase").union(spark.createDataFrame([("down",)], "phrase string"))
    df = mentions.occurrences(texts, phrases, most=0)
    assert df.count() == 2000 + 2000 + 1999
    assert 0 < join_rows(df)[0] <= 6000


def test_named_signals_that_begin_alike_are_not_all_looked_at(spark, monkeypatch):
    """Signals beyond one automaton, all of one first word: each text's own signal is its answer, and no join pairs texts with all signals."""
    monkeypatch.setattr(mentions, "occurrences", partial(mentions.occurrences, most=0))
    texts = spark.range(300).selectExpr("id AS goal", "concat('Seen: click ', id) AS text")
    roles = spark.range(300).selectExpr("concat('entity:click_', id) AS id", "'evidence_signal' AS role")
    none = spark.createDataFrame([], "goal long, kind string, node string"), spark.createDataFrame([], "goal long, s string, p string, o string, seq long")
    df = answers.signal_answers(texts, none[0], none[1], roles, spark.createDataFrame([], "p string, weight double"))
    assert {(r.goal, r.node, r.tier) for r in df.collect()} == {(i, f"entity:click_{i}", 0) for i in range(300)}
    assert join_rows(df)[0] <= 600


def test_mention_facts_write_no_pairs(spark, monkeypatch):
    """A goal of 30 subjects and 30 objects, each twice: nothing that is written grows with the square of the mentions."""
    written = []
    cut = mentions.cut
    monkeypatch.setattr(mentions, "cut", lambda df: (own := cut(df), written.append(own.count()))[0])
    facts = spark.range(30).selectExpr("concat('entity:a', id) AS s", "'with' AS p", "concat('entity:b', (id + 1) % 30) AS o", "0.9D AS conf", "id AS seq")
    said = spark.range(120).selectExpr("1L AS goal", "concat('entity:', CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END, id % 60 div 2) AS symbol")
    known = facts.selectExpr("explode(array(s, o)) AS symbol").distinct()
    got = sorted((r.place, r.line) for r in mentions.mention_facts(said, facts, known).collect())
    assert got == [(i + 1, f"entity:a{i} with entity:b{i + 1}") for i in range(5)]
    assert max(written, default=0) <= 120


def rows_shuffled(df):
    """Rows of the largest shuffle of a query."""
    df.collect()
    nodes, most = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "Exchange":
            most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif "QueryStage" in name:
            nodes.append(node.plan())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return most


@pytest.mark.parametrize("kind", ["string", "long"])
def test_mention_facts_shuffle_no_pairs(spark, monkeypatch, kind):
    """20 goals of 30 subjects and 30 objects: a row per mention is shuffled, not one per pair, by names or by numbers; pairs do as well."""
    end = lambda x: f"({x})" if kind == "long" else f"concat('entity:x', {x})"
    facts = spark.range(30).selectExpr(f"{end('id * 70000')} AS s", "'with' AS p", f"{end('(id + 1) % 30 * 70000 + 1')} AS o", "id AS seq").union(spark.sql(f"SELECT {end('0')}, 'powers', {end('1')}, 0L"))
    said = spark.range(1200).selectExpr("id div 60 AS goal", f"{end('id % 60 div 2 * 70000 + id % 2')} AS mention")
    aliases = said.select("mention", F.col("mention").alias("symbol")).distinct()
    assert aliases.count() == 60
    name = (lambda x: F.concat(F.lit("entity:x"), x.cast("string"))) if kind == "long" else lambda x: x
    expected = [(g, i + 1, f"entity:x{i * 70000} with entity:x{(i + 1) * 70000 + 1}") for g in range(20) for i in range(5)]
    for most in (10_000, 0):
        monkeypatch.setattr(mentions, "LISTED", most)
        df = mentions.lines_between(said, aliases, facts, name)
        assert sorted((r.goal, r.place, r.line) for r in df.collect()) == expected
        assert (rows_shuffled(df) <= 1200) == (most > 0)


def test_ngram_tags_never_broadcast_the_texts(spark, monkeypatch):
    """A small dictionary is broadcast, a large one is not; what is exploded from the texts never is, however small their file."""
    texts = spark.range(300).selectExpr("id AS key", "concat('say big ring ', id, ' or ring') AS text")
    terms = spark.createDataFrame([("big ring",), ("ring",), ("or",)], "term string")
    results, plans = [], []
    for most in (100_000, 2):
        monkeypatch.setattr(ontology, "MOST_ROWS", most, raising=False)
        df = linking.ngram_tags(texts, terms)
        results.append(sorted(tuple(r) for r in df.collect()))
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert results[0] == results[1] and len(results[0]) == 900
    assert all(side not in plans[0] for side in ("BuildLeft", "SortMergeJoin")) and "BroadcastHashJoin" in plans[0]
    assert "BroadcastHashJoin" not in plans[1]


def test_predicates_from_wording(spark):
    vocabulary = spark.createDataFrame([("operate",), ("cause",), ("power",), ("backupfor",)], "predicate string")
    asked = [(1, "Does it function", "is"), (2, "what powered it", None), (3, "explain the power", "12"), (4, "x", "uses"), (5, "nothing", None), (6, "the backup for systems", ""), (7, None, None)]
    got = {tuple(r) for r in mentions.asked_predicate(spark.createDataFrame(asked, "key long, text string, predicate string"), vocabulary).collect()}
    assert got == {(1, "operate", "wording"), (2, "power", "word"), (3, "cause", "wording"), (4, "uses", "given"), (5, None, None), (6, "backupfor", "wording"), (7, None, None)}


def plain_scored(phrases, symbols):
    one = lambda w: w[:-1] if w.endswith("s") and not w.endswith("ss") else w
    out = {}
    for phrase in phrases:
        form = re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", phrase.lower().strip()))
        for symbol in symbols:
            bare = re.sub(r"^(entity|concept):", "", symbol)
            if form and set(form.split("_")) & set(bare.lower().split("_")):
                score = 2.0 if bare == form else 1.6 if one(bare) == one(form) else 0.0
                score = round(score + 0.8 * (form in bare) + 0.6 * (one(form) in bare), 6)
                if score >= 0.8:
                    out[phrase] = max(out.get(phrase, (0, "")), (score, symbol))
    return {(p, s, x) for p, (x, s) in out.items()}


def test_scored_linking_equals_all_pairs(spark):
    rng = random.Random(6)
    names = ["ring", "rings", "old", "cold", "gold", "s", "glass"]
    symbols = sorted({rng.choice(["entity:", "concept:"]) + "_".join(rng.choices(names, k=rng.randint(1, 3))) for _ in range(60)})
    phrases = sorted({" ".join(rng.choices(names, k=rng.randint(1, 3))) for _ in range(40)} | {"", "!", "Old Ring"})
    got = linking.scored(spark.createDataFrame([(p,) for p in phrases], "phrase string"), spark.createDataFrame([(s,) for s in symbols], "symbol string"))
    assert {tuple(r) for r in got.collect()} == plain_scored(phrases, symbols)


def test_a_common_token_pairs_nothing(spark):
    """2,000 symbols and 2,000 phrases with one common token: rows before the choice grow with the rows, not their product."""
    symbols = spark.range(2_000).select(F.concat(F.lit("entity:ring_"), F.col("id").cast("string")).alias("symbol"))
    phrases = spark.range(2_000).select(F.concat(F.lit("ring "), F.col("id").cast("string")).alias("phrase"))
    got = linking.scored(phrases, symbols)
    assert got.count() == 2_000 and got.filter("score = 3.4").count() == 2_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_nearest_label_recall_and_pairs(spark):
    """Misspelt names among 500 and 2,000: recall at least 0.9, and what is looked at doesn't grow with the names."""
    rng, looked = random.Random(7), []
    for n in (500, 2_000):
        names = sorted({" ".join("".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(2)) for _ in range(n)})
        asked = sorted({x[:i] + rng.choice("abcxyz") + x[i + rng.randint(0, 1) :] for x in rng.sample(names, 100) for i in [rng.randrange(len(x))]})
        known = linking.hashed_vectors(spark.createDataFrame([(x,) for x in names], "label string")).cache()
        own = spark.createDataFrame([(x,) for x in asked], "query string")
        exact = {tuple(r) for r in linking.exact_nearest_label(own, known).collect()}
        got = {tuple(r) for r in linking.nearest_label(own, known).collect()}
        assert len(got & exact) >= 0.9 * len(exact) and len(got) == len(exact)
        looked.append(linking.candidate_labels(linking.hashed_vectors(own.select(F.col("query").alias("label"))), known).count() / len(asked))
    assert looked[1] < 2 * looked[0] and looked[1] < 0.3 * 2_000


def test_a_hot_object_bridges_asked_pairs_only(spark):
    facts = spark.range(100_000).selectExpr("concat('n', id) AS s", "'during' AS p", "'now' AS o").unionByName(spark.createDataFrame([("n1", "before", "x"), ("n2", "before", "x"), ("m", "after", "y")], "s string, p string, o string"))
    asked = spark.createDataFrame([("n1", "n2"), ("n1", "m"), ("n5", "n99999"), ("n3", "n3")], "a string, b string")
    assert {tuple(r) for r in query.temporal_bridge(facts, asked).collect()} == {("n1", "n2", "now"), ("n1", "n2", "x"), ("n5", "n99999", "now")}


def test_runs_of_words_are_made_without_a_window(spark, monkeypatch):
    """No sorting of a text's words; batches end within a text, and a long text is whole."""
    monkeypatch.setattr(mentions, "RUNS", 7)
    texts = spark.createDataFrame([(1, " " + "é b c " * 50), (2, " b c é "), (3, "  ")], "key long, text string")
    got = mentions.by_words(texts, spark.createDataFrame([("é b",), ("c",), ("b c é b",)], "phrase string"))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    expected = [(1, "é b", 1 + 6 * i) for i in range(50)] + [(1, "c", 5 + 6 * i) for i in range(50)] + [(1, "b c é b", 3 + 6 * i) for i in range(49)] + [(2, "c", 3)]
    assert sorted(map(tuple, got.select("key", "phrase", "at").collect())) == sorted(expected)
