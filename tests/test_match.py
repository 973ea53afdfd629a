"""Match scores against a plain version over random goals."""

import random

from tessera.operators import match


def test_against_plain(spark):
    rng = random.Random(9)
    kinds = ["concept:a", "concept:b", "concept:c", "concept:d"]
    up = {"concept:a": {"concept:a", "concept:b", "concept:c"}, "concept:b": {"concept:b", "concept:c"}, "concept:c": {"concept:c"}, "concept:d": {"concept:d"}}
    types = [("x1", "concept:a"), ("x2", "concept:b"), ("x2", "concept:d"), ("x3", "concept:d")]
    predicates = ["in", "with", "http://p/1", "http://p/2", "http://p/3", None]
    ranges = [("http://p/1", "concept:a"), ("http://p/2", "concept:d")]
    pick = lambda xs: rng.choice([*xs, None])
    goals = [(k, rng.choice(["RELATION", "WHERE"]), pick(["x1", "x2"]), pick(["x3"]), rng.choice(predicates), rng.choice([*kinds, " ", None]), pick(kinds), pick(kinds)) for k in range(150)]
    candidates = [(k, pick(["x1", "x2", "x3", "x9"]), pick(["x1", "x2", "x9"]), rng.choice(predicates), pick(["x3", "x4"])) for k in range(150) for _ in range(3)]
    said = {("http://p/1", "http://p/2"), ("http://p/1", "http://p/3"), ("http://p/3", "http://p/1"), ("http://p/3", "http://p/2")}  # 2 below 1, 3 inverse of 1
    expected = []
    for gid, answer, s, p, o in candidates:
        _, gtype, subject, object_, predicate, wanted, entity, range_ = goals[gid]

        def fit(thing, want):
            own = [t for i, t in types if i == thing]
            return 0.8 if not want or not want.strip() or not own else 1.0 if any(want in up[t] for t in own) else 0.2

        within = any(range_ in up[r] for q, r in ranges if q == p) if range_ else False
        iri = bool(p and p.startswith("http"))
        if gtype == "WHERE":
            scores = fit(s or subject, entity), 1.0 if p == "in" else (1.0 if within else 0.6) if range_ and iri else 0.7, 0.8 if not range_ else 1.0 if p == "in" or iri and within else 0.2
        else:
            same = (subject and subject == s) or (object_ and object_ == o)
            scores = 1.0 if same else 0.8, 1.0 if p and (p == predicate or (predicate, p) in said) else 0.7, fit(answer, wanted)
        expected.append((gid, answer, s, p, o, *scores, round(scores[0] * scores[1] * scores[2], 9)))
    table = spark.createDataFrame
    got = match.match_scores(
        table(candidates, "goal_id long, answer string, s string, p string, o string"),
        table(goals, "goal_id long, gtype string, subject string, object string, predicate string, expected_type string, entity_type string, expected_range string"), table(types, "id string, type string"),
        table([("concept:a", "concept:b"), ("concept:a", "concept:c"), ("concept:b", "concept:c")], "child string, parent string"), table([("http://p/2", "http://p/1")], "child string, parent string"),
        table([("http://p/3", "http://p/1")], "p string, q string"), table(ranges, "p string, range string"),
    )
    found = [(r.goal_id, r.answer, r.s, r.p, r.o, r.entity_match, r.relation_match, r.type_match, round(r.match, 9)) for r in got.collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    for column in (5, 6, 7):
        assert len({e[column] for e in expected}) >= 3
