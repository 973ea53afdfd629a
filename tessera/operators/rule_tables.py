"""Rules as rows: read with defaults, without duplicates, and run by one plan for all rules of one or two patterns.

A rule's row carries the names of its terms; a binding is the array of the values that stand in their places.
Whether equal names have equal values, and what the action says, are expressions over the two arrays, so rules are
data: the plan doesn't change when rules are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules as given
from .ontology import clusters, counted, cut

TRIPLE = "struct<s:string,p:string,o:string>"
RULES = f"seq long, name string, enabled boolean, executor string, params map<string,string>, patterns array<{TRIPLE}>, action {TRIPLE}, weight double"
PATTERN_MATCH = "PATTERN_MATCH"
#: Rounds after which what is known is written as one table.
COMPACT_ROUNDS = 4


def catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue of pattern rules as a table, disabled ones included."""
    rows = [(k, r.name, r.enabled, None, None, [tuple(p) for p in r.patterns], tuple(r.action), r.weight) for k, r in enumerate(given.catalogue())]
    return spark.createDataFrame(rows, RULES)


def whole(triple: Column) -> Column:
    return triple.isNotNull() & triple["s"].isNotNull() & triple["p"].isNotNull() & triple["o"].isNotNull()


def definitions(rows: DataFrame) -> DataFrame:
    """Rules (of RULES's columns) as they count.

    Enabled unless they say otherwise, executor PATTERN_MATCH unless named (upper case), weight 0.7 unless given, a
    missing name from `seq`. Incomplete triples are no patterns; pattern rules without pattern or action go, and of
    rules of one executor, params, patterns and action all but the first by seq.
    """
    executor = F.upper(F.coalesce("executor", F.lit(PATTERN_MATCH)))
    patterns = F.filter(F.coalesce("patterns", F.array().cast(f"array<{TRIPLE}>")), whole)
    own = rows.filter(F.coalesce("enabled", F.lit(True))).select(
        "seq", F.coalesce("name", F.concat(F.lit("rule_"), F.col("seq").cast("string"))).alias("name"), executor.alias("executor"),
        F.array_sort(F.map_entries(F.coalesce("params", F.create_map().cast("map<string,string>")))).alias("params"), patterns.alias("patterns"),
        F.when(whole(F.col("action")), F.col("action")).alias("action"), F.coalesce("weight", F.lit(0.7)).alias("weight"),
    )
    sound = own.filter((F.col("executor") != PATTERN_MATCH) | (F.size("patterns") > 0) & F.col("action").isNotNull())
    first = sound.groupBy("executor", "params", "patterns", "action").agg(F.min_by(F.struct("seq", "name", "weight"), "seq").alias("x"))
    return first.select("x.seq", "x.name", "executor", F.map_from_entries("params").alias("params"), "patterns", "action", "x.weight")


def variable(term: Column) -> Column:
    return term.startswith("?")


def runnable(definitions_: DataFrame) -> DataFrame:
    """(name, p1, p2, side1, side2, terms, checked, p, s_at, o_at, action, weight) of pattern rules of one or two patterns with fixed predicates.

    The two patterns meet in a variable on side1 of the first and side2 of the second; a rule whose patterns share
    none would pair all facts, and isn't run. `checked` says that meeting is not all there is to agree on: constants,
    or names that stand more than once besides. s_at and o_at are the places of the action's variables, null for constants.
    """
    own = definitions_.filter((F.col("executor") == PATTERN_MATCH) & F.size("patterns").isin(1, 2))
    a, b = F.get("patterns", F.lit(0)), F.get("patterns", F.lit(1))
    own = own.filter(~variable(a["p"]) & ~F.coalesce(variable(b["p"]), F.lit(False)) & ~variable(F.col("action.p")))
    meets = [(x, y) for x in "so" for y in "so"]
    side = lambda k: F.coalesce(*[F.when((a[m[0]] == b[m[1]]) & variable(a[m[0]]), m[k]) for m in meets])
    terms = F.array(a["s"], a["o"], b["s"], b["o"])
    names = F.array_compact(terms)
    checked = F.exists(names, lambda x: ~variable(x)) | (F.size(F.array_distinct(names)) != F.when(F.size("patterns") == 1, 2).otherwise(3))
    at = lambda term: F.when(variable(term), F.array_position(terms, term).cast("int") - 1)
    shaped = own.select("name", a["p"].alias("p1"), b["p"].alias("p2"), side(0).alias("side1"), side(1).alias("side2"), terms.alias("terms"), checked.alias("checked"), at(F.col("action.s")).alias("s_at"), at(F.col("action.o")).alias("o_at"), "action", "weight")
    # An action about a variable that no pattern binds concludes nothing.
    return shaped.filter("(p2 IS NULL OR side1 IS NOT NULL) AND coalesce(s_at, 0) >= 0 AND coalesce(o_at, 0) >= 0")


def sides(facts: DataFrame) -> DataFrame:
    """(p, side, node, s, o): every fact by both of its ends."""
    ends = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("node")) for c in "so"])
    return facts.select("s", "p", "o", F.explode(ends).alias("x")).select("p", "x.side", "x.node", "s", "o")


RULE = ["name", "terms", "checked", "s_at", "o_at", "action", "weight"]


def concluded(bound: DataFrame) -> DataFrame:
    """(s, p, o, conf, rule) of bindings (RULE's columns and values) whose values agree with their terms."""
    first = lambda term: F.element_at("values", F.array_position("terms", term).cast("int"))
    agree = F.forall(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get("terms", i).isNull() | (F.get("values", i) == F.when(variable(F.get("terms", i)), first(F.get("terms", i))).otherwise(F.get("terms", i))))
    value = lambda at, term: F.when(F.col(at).isNull(), term).otherwise(F.get("values", F.col(at)))
    made = bound.filter(~F.col("checked") | agree)
    return made.select(value("s_at", F.col("action.s")).alias("s"), F.col("action.p").alias("p"), value("o_at", F.col("action.o")).alias("o"), F.col("weight").alias("conf"), F.col("name").alias("rule"))


def derive(delta: DataFrame, known: DataFrame, rules: DataFrame) -> DataFrame:
    """(s, p, o, conf, rule) that the rules conclude from facts of which at least one is in `delta`."""
    none = F.lit(None).cast("string")
    single = rules.filter("p2 IS NULL").select(*RULE, F.col("p1").alias("p"))
    one = delta.join(single, "p").withColumn("values", F.array("s", "o", none, none))
    double = rules.filter("p2 IS NOT NULL")

    def met(mine: int, other: int) -> DataFrame:
        own = delta.join(double.withColumnRenamed(f"p{mine}", "p"), "p").withColumn("node", F.when(F.col(f"side{mine}") == "s", F.col("s")).otherwise(F.col("o")))
        own = own.select(*RULE, F.col(f"p{other}").alias("p"), F.col(f"side{other}").alias("side"), "node", F.col("s").alias("s0"), F.col("o").alias("o0"))
        both = own.join(sides(known), ["p", "side", "node"])
        order = ["s0", "o0", "s", "o"] if mine == 1 else ["s", "o", "s0", "o0"]
        return both.withColumn("values", F.array(*order))

    columns = [*RULE, "values"]
    return concluded(one.select(*columns).unionByName(met(1, 2).select(*columns)).unionByName(met(2, 1).select(*columns)))


def propagate(facts: DataFrame, rows: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(s, p, o, conf, round): facts with everything that a table of rules derives, as `rules.propagate`.

    Semi-naive; a derived fact's confidence is the largest weight of the rules of its round that conclude it.
    """
    return spread(facts, cut(runnable(definitions(rows))), most_rounds)


def spread(facts: DataFrame, shapes: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """`propagate` for rules as `runnable` gives them."""
    known = delta = cut(facts.groupBy("s", "p", "o").agg(F.max("conf").alias("conf")).withColumn("round", F.lit(0)))
    rounds = 0
    while most_rounds is None or rounds < most_rounds:
        rounds += 1
        new = derive(delta.select("s", "p", "o"), known.select("s", "p", "o"), shapes).groupBy("s", "p", "o").agg(F.max("conf").alias("conf"))
        delta = cut(new.join(known.select("s", "p", "o"), ["s", "p", "o"], "left_anti").withColumn("round", F.lit(rounds)))
        if delta.isEmpty():
            break
        known = known.unionByName(delta)
        known = cut(known) if rounds % COMPACT_ROUNDS == 0 else known
    return known


def closed(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """(s, p, o): all that `propagate` derives, each once, without confidences and rounds.

    Where rules carry a predicate q along others both ways (a x b and a q c give b q c, and the reverse), nodes that such
    facts connect have the same objects of q. They are one class, whose objects are derived once and not along every
    fact. That holds if q is in no other rule's patterns but its own transitive one, and no rule makes facts to carry
    along; else, or if several predicates are carried, the rules run as they are.
    """
    shapes = cut(runnable(definitions(rows)))
    ends = "NOT checked AND p2 = action.p AND side2 = 's' AND o_at = 3"
    carries = f"{ends} AND p1 <> p2 AND (side1 = 's' AND s_at = 1 OR side1 = 'o' AND s_at = 0)"
    both = shapes.filter(carries).groupBy("p1", "p2").agg(F.count_distinct("side1").alias("n")).filter("n = 2").select("p1", "p2")
    found = both.select("p2").distinct().limit(2).collect()
    if len(found) != 1:
        return spread(facts, shapes).select("s", "p", "o")
    q = found[0]["p2"]
    along = cut(both.select("p1"))
    transitive = f"{ends} AND p1 = p2 AND side1 = 'o' AND s_at = 0"
    is_q = F.col("p2") == q
    own = shapes.join(along.withColumn("along", F.lit(True)), "p1", "left")
    rest = cut(own.filter(~F.coalesce(is_q & F.expr(carries) & F.col("along"), F.lit(False)) & ~F.coalesce(is_q & F.expr(transitive), F.lit(False))).select(*shapes.columns))
    touched = rest.filter((F.col("p1") == q) | F.coalesce(is_q, F.lit(False)))
    made = rest.select(F.col("action.p").alias("p1")).join(along, "p1", "left_semi")
    if not touched.isEmpty() or not made.isEmpty():
        return spread(facts, shapes).select("s", "p", "o")
    used = counted(rest.select(F.explode(F.array_compact(F.array("p1", "p2"))).alias("p")).distinct(), "p")
    derived = spread(facts.join(used, "p", "left_semi"), rest).filter("round > 0").select("s", "p", "o")
    every = facts.select("s", "p", "o").unionByName(derived)
    others = every.filter(F.col("p") != q).distinct()

    classes = clusters(facts.join(counted(along.withColumnRenamed("p1", "p"), "p"), "p", "left_semi").select(F.col("s").alias("a"), F.col("o").alias("b")))
    named = lambda df, end, name: df.join(classes.withColumnRenamed("node", end), end, "left").withColumn(name, F.coalesce("cluster", end)).drop("cluster")
    base = cut(named(every.filter(F.col("p") == q).select("s", "o"), "s", "c").select("c", "o").distinct())
    known = base
    if not shapes.filter(is_q & F.expr(transitive)).isEmpty():
        via = cut(named(base.select("o").distinct(), "o", "via"))
        delta = base
        while True:
            step = delta.join(via, "o").select("c", "via").join(base.select(F.col("c").alias("via"), "o"), "via").select("c", "o").distinct()
            delta = cut(step.join(known, ["c", "o"], "left_anti"))
            if delta.isEmpty():
                break
            known = known.unionByName(delta)
    shared = counted(known.join(classes.select(F.col("cluster").alias("c")).distinct(), "c", "left_semi"), "o")
    inside = classes.withColumnRenamed("cluster", "c").join(shared, "c").select(F.col("node").alias("s"), "o")
    alone = known.join(classes.select(F.col("node").alias("c")), "c", "left_anti").select(F.col("c").alias("s"), "o")
    return inside.unionByName(alone).select("s", F.lit(q).alias("p"), "o").unionByName(others)
