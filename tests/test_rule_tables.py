"""Rules as rows against the rules as objects, and the reading of a rule table."""

import random

from tessera.operators import rule_tables, rules

FACT = "s string, p string, o string, conf double"


def table(spark, own):
    return spark.createDataFrame([(k, r.name, r.enabled, None, None, [tuple(p) for p in r.patterns], tuple(r.action), r.weight) for k, r in enumerate(own)], rule_tables.RULES)


def test_same_rows_as_rule_objects(spark):
    """The catalogue and rules of property flags over random facts."""
    rng = random.Random(2)
    own = [*rules.catalogue(), *rules.meta_rules(["partOf"], ["near"], [("before", "after")])]
    names = ["in", "inside", "locatedIn", "with", "wear", "near", "partOf", "poweredBy", "chargedBy", "before", "after", "on", "under"]
    facts = spark.createDataFrame([(f"n{rng.randint(0, 14)}", rng.choice(names), f"n{rng.randint(0, 14)}", 0.5) for _ in range(40)], FACT)
    for most in (1, 3):
        got = rule_tables.propagate(facts, table(spark, own), most)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rules.propagate(facts, own, most).collect()))


def plain(facts, own, rounds):
    known = {f[:3] for f in facts}
    for _ in range(rounds):
        new = set()
        for r in own:
            bindings = [{}]
            for pattern in r.patterns:
                grown = []
                for b in bindings:
                    for f in known:
                        here = dict(b)
                        if all(here.setdefault(t, v) == v if t.startswith("?") else t == v for t, v in zip(pattern, f)):
                            grown.append(here)
                bindings = grown
            new |= {tuple(b.get(t, t) for t in r.action) for b in bindings}
        known |= new
    return known


def test_constants_and_repeated_variables(spark):
    """Constants in patterns and actions, a variable twice in a pattern, two shared variables, all pairs of sides."""
    own = [
        rules.Rule("same", (("?a", "p", "?a"),), ("?a", "self", "yes")), rules.Rule("constant", (("?a", "p", "n1"), ("?a", "q", "?b")), ("?b", "r", "?a")), rules.Rule("both", (("?a", "p", "?b"), ("?b", "q", "?a")), ("?a", "pair", "?b")),
        rules.Rule("ss", (("?a", "p", "?b"), ("?a", "q", "?c")), ("?b", "ss", "?c")), rules.Rule("oo", (("?a", "p", "?b"), ("?c", "q", "?b")), ("?a", "oo", "?c")), rules.Rule("os", (("?a", "ss", "?b"), ("?b", "q", "?c")), ("?c", "p", "?a")),
        rules.Rule("apart", (("?a", "p", "?b"), ("?c", "q", "?d")), ("?a", "never", "?d")),
    ]
    rng = random.Random(8)
    facts = [(f"n{rng.randint(0, 5)}", rng.choice("pq"), f"n{rng.randint(0, 5)}", 0.5) for _ in range(16)]
    got = {tuple(r)[:3] for r in rule_tables.propagate(spark.createDataFrame(facts, FACT), table(spark, own), 2).collect()}
    assert got == plain(facts, own[:-1], 2)


def test_closure_by_classes_has_the_same_facts(spark):
    """Random facts and the catalogue; rules that use what is carried, or make facts to carry along, as they are."""
    rng = random.Random(4)
    names = ["in", "inside", "locatedIn", "with", "wear", "near", "partOf", "poweredBy", "chargedBy"]
    more = [[], [rules.Rule("uses", (("?a", "in", "?b"),), ("?b", "has", "?a"))], [rules.Rule("makes", (("?a", "in", "?b"),), ("?a", "near", "?b"))]]
    for extra in more:
        facts = spark.createDataFrame([(f"n{rng.randint(0, 24)}", rng.choice(names), f"n{rng.randint(0, 24)}", 0.5) for _ in range(30)], FACT)
        own = [*rules.catalogue(), *extra]
        got = [tuple(r) for r in rule_tables.closed(facts, table(spark, own)).collect()]
        assert sorted(got) == sorted(tuple(r)[:3] for r in rules.propagate(facts, own).collect())


def test_closure_carries_no_place_along_every_fact(spark, monkeypatch):
    """What is bound in the rounds grows with the places and not with places times facts to carry along."""
    from tessera.plans import rule_queries
    from tessera.sources.facts import Tables

    bound, derive = [], rule_tables.derive
    monkeypatch.setattr(rule_tables, "derive", lambda *args: (out := derive(*args), bound.append(out.count()))[0])
    tables = Tables(spark, "/root/testdata/sf0.001")
    assert rule_queries.propagation_closure(tables).count() > 0
    assert sum(bound) <= 4 * (tables.customer.count() + tables.supplier.count())


def test_definitions(spark):
    a, b = ("?x", "p", "?y"), ("?x", "q", "?y")
    rows = [
        (1, "first", None, None, None, [a], b, None), (2, "again", True, "pattern_match", {}, [a], b, 0.9), (3, "off", False, None, None, [a], b, 0.5), (4, None, None, "Ranker", {"k": "1", "a": "2"}, None, None, None),
        (5, "same", None, "RANKER", {"a": "2", "k": "1"}, None, None, 0.1), (6, "no action", None, None, None, [a], None, 0.5), (7, "no pattern", None, None, None, [("?x", None, "?y"), None], b, 0.5), (8, "half", None, None, None, [a, ("?x", "q", None)], a, 0.4),
    ]
    got = {(r.seq, r.name, r.executor, r.weight, len(r.patterns)) for r in rule_tables.definitions(spark.createDataFrame(rows, rule_tables.RULES)).collect()}
    assert got == {(1, "first", "PATTERN_MATCH", 0.7, 1), (4, "rule_4", "RANKER", 0.7, 0), (8, "half", "PATTERN_MATCH", 0.4, 1)}
    assert rule_tables.definitions(spark.createDataFrame([], rule_tables.RULES)).count() == 0
