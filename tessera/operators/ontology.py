"""Closures over axiom tables, equivalence clusters, labels, aliases.

Loops are semi-naive: each round joins only what the round before found, drops what is known with an
anti join, and checkpoints the round's delta to the shared folder so that lineage stays short.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to `spark.checkpoint.dir`; where that is unset to the warehouse, which a cluster shares too.

    Only where driver and executors are one process (`local[n]`, as in tests) a temporary folder is made.
    """
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if context.getCheckpointDir() is None:
        one = context.master == "local" or context.master.startswith("local[")
        own = tempfile.mkdtemp(prefix="spark-") if one else f"{conf.get('spark.sql.warehouse.dir')}/checkpoints"
        context.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or own)
    return df.checkpoint(eager=True)


#: Rows of a table that is broadcast after it was counted, and characters of its texts.
MOST_ROWS, MOST_CHARACTERS = 100_000, 8 << 20


def counted(df: DataFrame, text: str) -> DataFrame:
    """`df`, written and counted, as the side of a join that is broadcast if it is small; else the join sorts both sides.

    Spark rates what arrays are exploded to no larger than the file they come from, so by its own estimate it would broadcast that.
    """
    return sized(cut(df), text)


def sized(own: DataFrame, text: str | F.Column) -> DataFrame:
    """`counted` for what is written already."""
    few = own.limit(MOST_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters")).first()
    return F.broadcast(own) if few["n"] <= MOST_ROWS and few["characters"] <= MOST_CHARACTERS else own.hint("merge")


def closure(edges: DataFrame, a: str, b: str, most_rounds: int | None = None) -> DataFrame:
    """All (a, b) with a path of one edge or more; cycles end because known pairs are not followed again."""
    base = edges.select(F.col(a), F.col(b)).distinct()
    delta = cut(base)
    found, rounds = [delta], 1
    while most_rounds is None or rounds < most_rounds:
        known = found[0]
        for more in found[1:]:
            known = known.unionByName(more)
        step = delta.alias("d").join(base.alias("e"), F.col(f"d.{b}") == F.col(f"e.{a}")).select(F.col(f"d.{a}").alias(a), F.col(f"e.{b}").alias(b)).distinct()
        delta = cut(step.join(known, [a, b], "left_anti"))
        if delta.isEmpty():
            return known
        found.append(delta)
        rounds += 1
    known = found[0]
    for more in found[1:]:
        known = known.unionByName(more)
    return known


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, dist): least distance from each start, up to `depth` edges (s, o)."""
    seen = cut(starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("dist")))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("s")).select("start", F.col("o").alias("node"), F.lit(d).alias("dist")).distinct()
        frontier = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def family(members: DataFrame, subprop_closure: DataFrame, inverse: DataFrame) -> DataFrame:
    """(family, p): members, what is below them, and the inverses of all those with what is below."""
    below = lambda df: df.unionByName(df.join(subprop_closure, F.col("p") == F.col("parent")).select("family", F.col("child").alias("p")))
    own = below(members.select("family", "p"))
    pairs = inverse.select(F.col("p").alias("q"), "inv").union(inverse.select(F.col("inv"), F.col("p"))).distinct()
    turned = own.join(pairs, F.col("p") == F.col("q")).select("family", F.col("inv").alias("p"))
    return own.unionByName(below(turned)).distinct()


def compatible_types(subclass_closure: DataFrame, hypernyms: DataFrame, exact: DataFrame) -> DataFrame:
    """Distinct (a, b): b is above a, reachable by hypernyms, or an exact match either way."""
    both = exact.select("a", "b").union(exact.select("b", "a"))
    return subclass_closure.select(F.col("child").alias("a"), F.col("parent").alias("b")).union(hypernyms.select("a", "b")).union(both).filter("a <> b").distinct()


def clusters(edges: DataFrame) -> DataFrame:
    """(node, cluster): connected components of undirected (a, b); a cluster is named by its least node.

    Each round a node takes the least name among itself, its neighbours and its name's name (pointer
    jumping), so long chains need few rounds. Names are never broadcast: each round would send them through the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    name = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(name.hint("merge"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("c").alias("n"))
        low = name.join(near.hint("merge"), F.col("node") == F.col("a")).select("node", F.least("c", "n").alias("c"), F.col("c").alias("old"))
        up = low.select(F.col("node").alias("k"), F.col("c").alias("jump"))
        step = cut(low.join(up.hint("merge"), F.col("c") == F.col("k"), "left").select("node", F.least("c", F.coalesce("jump", "c")).alias("c"), "old"))
        changed = not step.filter("c <> old").isEmpty()
        name = step.select("node", "c")
        if not changed:
            return name.withColumnRenamed("c", "cluster")


def label_index(labels: DataFrame) -> DataFrame:
    """(label, iri, key): with the search form of the label."""
    return labels.withColumn("key", exprs.normal_search(F.col("label")))


def dictionary(labels: DataFrame, own_prefix: str) -> DataFrame:
    """(term, iri): one IRI per mapper-form label; our own namespace first, then the least IRI."""
    keyed = labels.withColumn("term", exprs.normal_mapper(F.col("label")))
    order = Window.partitionBy("term").orderBy((~F.col("iri").startswith(own_prefix)).cast("int"), "iri")
    return keyed.withColumn("n", F.row_number().over(order)).filter("n = 1").select("term", "iri")


def canonical_types(types: DataFrame, labels: DataFrame, synsets: str) -> DataFrame:
    """(type, iri): a type by its bare label: an IRI that starts with `synsets` first, then the least IRI, else itself.

    entity, concept and thing say nothing about what a thing is: null.
    """
    bare = types.select("type").distinct().withColumn("key", exprs.normal_search(exprs.strip_namespace(F.col("type"))))
    best = label_index(labels).groupBy("key").agg(F.min_by("iri", F.struct(~F.col("iri").startswith(synsets), "iri")).alias("iri"))
    none = F.col("key").isin("entity", "concept", "thing")
    return bare.join(best, "key", "left").select("type", F.when(~none, F.coalesce("iri", "type")).alias("iri"))


def annotation_values(asked: DataFrame, annotations: DataFrame) -> DataFrame:
    """(iri, annotation, value, number): the least value of each asked (iri, annotation), null if it has none; number if it reads as one."""
    own = annotations.groupBy("iri", "annotation").agg(F.min("value").alias("value"))
    return asked.select("iri", "annotation").distinct().join(own, ["iri", "annotation"], "left").withColumn("number", F.expr("try_cast(value AS double)"))


def property_ranges(properties: DataFrame, axioms: DataFrame) -> DataFrame:
    """(p, range): the named classes in range axioms (kind, s, o) of the asked properties; a property without one has no row."""
    ranges = axioms.filter("kind = 'range'").select(F.col("s").alias("p"), F.col("o").alias("range")).distinct()
    return ranges.join(properties.select("p").distinct(), "p", "left_semi")


def alias_keys(symbol) -> F.Column:
    """Keys under which a symbol may be known: itself, its other namespace, singular and plural in both."""
    bare = exprs.strip_namespace(symbol)
    forms = F.array_distinct(F.array(bare, exprs.singular(bare), exprs.plural(bare)))
    return F.flatten(F.transform(forms, lambda f: F.array(F.concat(F.lit("entity:"), f), F.concat(F.lit("concept:"), f))))


def aliases(symbols: DataFrame, known: DataFrame, least_suffix: int = 2) -> DataFrame:
    """(symbol, alias): known symbols under one of the keys, or longer ones that end with all its tokens (2 or more).

    Suffixes are made by exploding every token suffix of the known symbols, so both parts are equi-joins.
    """
    keyed = symbols.select("symbol", F.explode(alias_keys(F.col("symbol"))).alias("alias")).join(known.select(F.col("symbol").alias("alias")), "alias", "left_semi")
    parts = F.split(exprs.strip_namespace(F.col("symbol")), "_")
    ends = known.select(F.col("symbol").alias("alias"), F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))).alias("suffix"))
    whole = symbols.select("symbol", exprs.strip_namespace(F.col("symbol")).alias("suffix")).filter(F.size(F.split("suffix", "_")) >= least_suffix)
    return keyed.select("symbol", "alias").union(whole.join(ends, "suffix").select("symbol", "alias")).filter("symbol <> alias").distinct()
