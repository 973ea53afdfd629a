"""Triple-pattern rules as joins, rule application, forward chaining, closure to a fixpoint."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ontology import cut

Pattern = tuple[str, str, str]


@dataclass(frozen=True)
class Rule:
    name: str
    patterns: tuple[Pattern, ...]
    action: Pattern
    weight: float = 0.7
    enabled: bool = True


COLOCATION = ["with", "wear", "carry", "hold", "possess", "have", "opposite", "partOf", "wornBy", "near", "beside", "alongside", "nextTo", "colocation"]


def catalogue() -> list[Rule]:
    """The pattern rules by shape; terms beginning with ? are variables. The weights are fixed values."""
    chain = lambda name, p, q, r, w: Rule(name, (("?a", p, "?b"), ("?b", q, "?c")), ("?a", r, "?c"), w)
    found = [chain(f"transitive-{p}", p, p, p, 0.72) for p in ("in", "inside", "locatedIn")]
    for x in COLOCATION:
        found.append(Rule(f"{x}-location-transfer", (("?a", x, "?b"), ("?a", "in", "?c")), ("?b", "in", "?c"), 0.7))
        found.append(chain(f"{x}-location-reverse", x, "in", "in", 0.7))
    found += [Rule(f"{x}-location-transfer", (("?a", x, "?b"), ("?b", "in", "?c")), ("?a", "in", "?c"), 0.68, enabled=False) for x in ("on", "under")]
    found += [chain("poweredBy-transitive", "poweredBy", "poweredBy", "poweredBy", 0.74), chain("poweredBy-chargedBy", "poweredBy", "chargedBy", "poweredBy", 0.74), chain("chargedBy-transitive", "chargedBy", "chargedBy", "chargedBy", 0.74)]
    found += [Rule(f"{x}-to-in", (("?a", x, "?b"),), ("?a", "in", "?b"), 0.72) for x in ("inside", "locatedIn")]
    return [*found, Rule("wear-to-on", (("?a", "wear", "?b"),), ("?a", "on", "?b"), 0.68)]


def meta_rules(transitive: list[str], symmetric: list[str], inverse: list[tuple[str, str]]) -> list[Rule]:
    """Rules that follow from the flags of properties."""
    found = [Rule(f"transitive:{p}", (("?a", p, "?b"), ("?b", p, "?c")), ("?a", p, "?c"), 0.75) for p in transitive]
    found += [Rule(f"symmetric:{p}", (("?a", p, "?b"),), ("?b", p, "?a"), 0.65) for p in symmetric]
    for p, q in inverse:
        found += [Rule(f"inverse:{p}", (("?a", p, "?b"),), ("?b", q, "?a"), 0.7), Rule(f"inverse:{q}", (("?a", q, "?b"),), ("?b", p, "?a"), 0.7)]
    return found


def usable(rules: list[Rule]) -> list[Rule]:
    """Enabled rules with patterns, each signature once."""
    seen: dict = {}
    for r in rules:
        if r.enabled and r.patterns and r.action:
            seen.setdefault((r.patterns, r.action), r)
    return list(seen.values())


def connected(patterns: tuple[Pattern, ...]) -> list[Pattern]:
    """The patterns in an order in which each shares a variable with those before it; a rule without one would pair all facts."""
    waiting, order, bound = list(patterns), [], set()
    while waiting:
        names = [{x for x in p if x.startswith("?")} for p in waiting]
        at = next((i for i, own in enumerate(names) if not order or own & bound), None)
        if at is None:
            raise ValueError(f"patterns {waiting} share no variable with the others")
        bound |= names[at]
        order.append(waiting.pop(at))
    return order


def match(facts: DataFrame, patterns: tuple[Pattern, ...]) -> DataFrame:
    """Bindings of the patterns' variables (columns named without ?), with conf (mean) and evidence (array)."""
    patterns, joined = connected(patterns), None
    for i, pattern in enumerate(patterns):
        rows, names = facts, {}
        for column, term in zip("spo", pattern):
            if not term.startswith("?"):
                rows = rows.filter(F.col(column) == term)
            elif term[1:] in names:
                rows = rows.filter(F.col(column) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = column
        own = rows.select(*[F.col(c).alias(v) for v, c in names.items()], F.col("conf").alias(f"conf{i}"), F.concat_ws(" ", "s", "p", "o").alias(f"evidence{i}"))
        shared = [v for v in names if joined is not None and v in joined.columns]
        joined = own if joined is None else joined.join(own, shared)
    n = len(patterns)
    kept = [c for c in joined.columns if not c.startswith(("conf", "evidence"))]
    conf = sum((F.col(f"conf{i}") for i in range(1, n)), F.col("conf0")) / n
    return joined.select(*kept, conf.alias("conf"), F.array(*[f"evidence{i}" for i in range(n)]).alias("evidence"))


def apply(facts: DataFrame, rule: Rule) -> DataFrame:
    """(s, p, o, conf: the rule's weight, score, rule, evidence): the action of every binding."""
    bound = match(facts, rule.patterns)
    term = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
    return bound.select(
        *[term(x).alias(c) for c, x in zip("spo", rule.action)], F.lit(rule.weight).alias("conf"),
        F.least(F.lit(1.0), (F.lit(rule.weight) + F.col("conf")) / 2).alias("score"), F.lit(rule.name).alias("rule"), "evidence",
    )


def best_per_fact(candidates: DataFrame) -> DataFrame:
    """One derivation per (s, p, o): the highest score, then the rule's name."""
    more = [c for c in candidates.columns if c not in ("s", "p", "o", "score", "rule")]
    best = candidates.groupBy("s", "p", "o").agg(F.min(F.struct((-F.col("score")).alias("less"), "rule", *more)).alias("x"))
    return best.select("s", "p", "o", (-F.col("x.less")).alias("score"), *[f"x.{c}" for c in ("rule", *more)]).select(*candidates.columns)


#: pairs of one end and block that meet in one list
LISTED = 1_000_000


def packed(list: Column) -> Column:
    """A sorted list of longs as their lower 16 bits and what to add to these: once where that is the same for all, else for each."""
    rest = F.transform(list, lambda x: F.shiftleft(F.shiftright(x, 16), 16) + 32_768)
    one = F.get(rest, F.lit(0)) == F.get(rest, F.size(list) - 1)
    return F.struct(F.transform(list, lambda x: (x.bitwiseAND(65_535) - 32_768).cast("smallint")).alias("low"), F.when(one, F.get(rest, F.lit(0))).alias("base"), F.when(~one, rest).alias("rest"))


def unpacked(pack: Column) -> Column:
    each = F.transform(pack["low"], lambda x, i: F.get(pack["rest"], i) + x)
    return F.when(pack["base"].isNotNull(), F.transform(pack["low"], lambda x: pack["base"] + x)).otherwise(each)


def chain_ends(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, ends): the distinct c behind (a, b) of `first` and (b, c) of `second`, in one list, or several that share none.

    The ends of a b are listed once and lists are what is shuffled, packed if they hold longs, not a row per (a, b, c). Where
    an a may have more than LISTED of them, ends are dealt over blocks, which are listed apart.
    """
    most = [df.groupBy(key).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"] for df, key in ((first, "a"), (second, "b"))]
    block = F.pmod(F.xxhash64("c"), F.lit(most[0] * most[1] // LISTED + 1))
    longs = second.schema["c"].dataType.typeName() == "long"
    # Both sides are dealt by b once; without the hint one may be broadcast, as Spark rates it by its file.
    lists = second.repartition("b").groupBy("b", block.alias("block")).agg((packed(F.sort_array(F.collect_set("c"))) if longs else F.collect_set("c")).alias("list"))
    met = first.repartition("b").distinct().join(lists.hint("shuffle_hash"), "b").select("a", "block", "list").repartition("a")
    each = met.groupBy("a", "block").agg(F.collect_list("list").alias("lists"))
    return each.select("a", F.array_distinct(F.flatten(F.transform("lists", unpacked) if longs else F.col("lists"))).alias("ends"))


def conclusions(facts: DataFrame, rule: Rule) -> DataFrame:
    """(s, p, o): what a rule concludes, each once; rules of the shape a-b, b-c to a-c by lists of ends."""
    chained = len(rule.patterns) == 2 and all(x.startswith("?") for s, p, o in rule.patterns for x in (s, o)) and not any(p.startswith("?") for _, p, _ in (*rule.patterns, rule.action))
    (a, p, b), (b2, q, c) = rule.patterns if chained else ((None,) * 3,) * 2
    if not chained or b != b2 or len({a, b, c}) < 3 or (rule.action[0], rule.action[2]) != (a, c):
        return apply(facts, rule).select("s", "p", "o").distinct()
    side = lambda name, s, o: facts.filter(F.col("p") == name).select(F.col("s").alias(s), F.col("o").alias(o))
    first, second = side(p, "a", "b"), side(q, "b", "c")
    # Lists hold no nulls.
    bare = first.join(second.filter("c IS NULL"), "b").select("a", "c").distinct()
    ends = chain_ends(first, second).select("a", F.explode("ends").alias("c")).unionByName(bare)
    return ends.select(F.col("a").alias("s"), F.lit(rule.action[1]).alias("p"), F.col("c").alias("o"))


def forward_chain(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Consequents of ground rules (ant, con, conf) whose antecedent is a fact and whose consequent is not.

    The score averages the rule's confidence with that of the antecedent inside the rule.
    """
    flat = rules.select("ant.*", F.col("con.s").alias("cs"), F.col("con.p").alias("cp"), F.col("con.o").alias("co"), F.col("conf").alias("rule_conf"))
    known = facts.select("s", "p", "o").distinct()
    ready = flat.join(known, ["s", "p", "o"], "left_semi")
    new = ready.select(F.col("cs").alias("s"), F.col("cp").alias("p"), F.col("co").alias("o"), F.least(F.lit(1.0), (F.col("rule_conf") + F.col("conf")) / 2).alias("score"))
    return new.join(known, ["s", "p", "o"], "left_anti").groupBy("s", "p", "o").agg(F.max("score").alias("score"))


def close_kinds(facts: DataFrame, rules: DataFrame, most_rounds: int = 4) -> DataFrame:
    """Facts (s, p, o, conf, seq) that recorded rules (p, o, p2, o2, weight) derive from `facts`: who has p o has p2 o2.

    Semi-naive, `most_rounds` rounds at most; a fact keeps its first round's largest weight and the seq of its cause.
    """
    known = delta = cut(facts.select("s", "p", "o", "conf", "seq"))
    found = None
    for _ in range(most_rounds):
        new = delta.join(rules, ["p", "o"]).groupBy("s", F.col("p2").alias("p"), F.col("o2").alias("o")).agg(F.max("weight").alias("conf"), F.min("seq").alias("seq"))
        delta = cut(new.join(known.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select(*known.columns))
        if delta.isEmpty():
            break
        known, found = known.unionByName(delta), delta if found is None else found.unionByName(delta)
    return delta if found is None else found


def grouped(rules: list[Rule]) -> list[tuple[tuple, tuple, dict]]:
    """Rules of one shape that differ in one predicate of the first pattern, to be run as one join.

    (patterns with the first predicate left out, action, {predicate: weight}).
    """
    shapes: dict = {}
    for r in rules:
        (s, p, o), *rest = r.patterns
        shapes.setdefault(((s, o), tuple(rest), r.action), {})[p] = r.weight
    return [(k[0], k[1:], v) for k, v in shapes.items()]


def propagate(facts: DataFrame, rules: list[Rule], most_rounds: int | None = None) -> DataFrame:
    """(s, p, o, conf, round): facts with everything the rules derive; rules of one or two patterns.

    Semi-naive: in a two-pattern rule one side is last round's delta; in the first round that is all facts, which meet once.
    Rules of one shape share a join, and those are left out whose predicates the delta hasn't. A derived fact's confidence is its rule's weight; of several, the largest.
    """
    known = cut(facts.groupBy("s", "p", "o").agg(F.max("conf").alias("conf")).withColumn("round", F.lit(0)))
    delta, rounds = known, 0
    shapes = grouped(usable(rules))
    asked = sorted({p for _, (rest, _), weights in shapes for p in (*weights, *(q for _, q, _ in rest))})
    while most_rounds is None or rounds < most_rounds:
        rounds += 1
        made = []
        there = {r["p"] for r in delta.filter(F.col("p").isin(asked)).select("p").distinct().collect()}
        for (s, o), (rest, action), weights in shapes:
            weight = F.element_at(F.create_map(*[x for p, w in weights.items() for x in (F.lit(p), F.lit(w))]), F.col("p0"))

            def first(df):
                return df.filter(F.col("p").isin(list(weights))).select(F.col("s").alias(s[1:]), F.col("o").alias(o[1:]), F.col("p").alias("p0"))

            if rest:
                (s2, p2, o2), = rest
                second = lambda df: df.filter(F.col("p") == p2).select(F.col("s").alias(s2[1:]), F.col("o").alias(o2[1:]))  # noqa: E731,B023
                on = [next(v for v in (s2[1:], o2[1:]) if v in (s[1:], o[1:]))]
                bounds = [first(delta).join(second(known), on)] * bool(there & set(weights))
                bounds += [first(known).join(second(delta), on)] * (rounds > 1 and p2 in there)
            else:
                bounds = [first(delta)] * bool(there & set(weights))
            made += [bound.select(F.col(action[0][1:]).alias("s"), (F.lit(action[1]) if action[1] != "?p" else F.col("p0")).alias("p"), F.col(action[2][1:]).alias("o"), weight.alias("conf")) for bound in bounds]
        if not made:
            break
        new = made[0]
        for more in made[1:]:
            new = new.unionByName(more)
        new = new.groupBy("s", "p", "o").agg(F.max("conf").alias("conf"))
        delta = cut(new.join(known.select("s", "p", "o"), ["s", "p", "o"], "left_anti").withColumn("round", F.lit(rounds)))
        if delta.isEmpty():
            break
        known = known.unionByName(delta)
    return known
