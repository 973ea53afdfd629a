"""Queries on sources, sinks and the fact store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import store
from ..sources import axioms, facts
from ..sources.facts import SQL, Tables, with_views
from ..streaming.ingest import shared_folder
from .register import Register

query = Register()


@query("fact_lookup", with_views("places") + " SELECT s, p, o, conf, lower(p) AS p_local, regexp_replace(s, '^(entity|concept):', '') AS bare FROM places WHERE p = 'locatedIn' AND o = 'entity:nation_3'")
def fact_lookup(t: Tables):
    found = store.find(facts.places(t), p="locatedIn", o="entity:nation_3")
    return found.select("s", "p", "o", "conf", exprs.local_name(F.col("p")).alias("p_local"), exprs.strip_namespace(F.col("s")).alias("bare"))


@query("fact_by_subject", with_views("attributes") + " SELECT s, p, o FROM attributes WHERE s = 'entity:part_7'")
def fact_by_subject(t: Tables):
    return store.find(facts.attributes(t), s="entity:part_7").select("s", "p", "o")


@query(
    "entity_upsert",
    """SELECT 'entity:' || replace(p_name, ' ', '_') AS id, arg_min('part_' || p_partkey, p_partkey) AS surface,
  array_to_string(list_sort(list_distinct(list('concept:' || replace(lower(p_type), ' ', '_')))), ',') AS types FROM part GROUP BY 1""",
)
def entity_upsert(t: Tables):
    """Parts of one name are one entity: the first surface form, all types."""
    rows = t.part.select(facts.named(F.col("p_name")).alias("id"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("surface"), facts.concept(F.col("p_type")).alias("type"), F.col("p_partkey").alias("seq"))
    return store.upsert_entities(rows).withColumn("types", F.array_join("types", ","))


@query("type_assertions", "SELECT 'concept:' || replace(lower(p_type), ' ', '_') AS type, count(*) AS n FROM part GROUP BY 1")
def type_assertions(t: Tables):
    typed = facts.fact(t.part, facts.symbol("part", F.col("p_partkey")), "rdf:type", facts.concept(F.col("p_type")), F.lit(0.9), F.col("p_partkey"))
    return store.typed_by_facts(facts.union(typed, facts.attributes(t))).groupBy("type").agg(F.count("*").alias("n"))


@query(
    "insert_if_new",
    with_views("pairs")
    + """, line AS (SELECT 'entity:part_' || l_partkey AS s, 'with' AS p, 'entity:supplier_' || l_suppkey AS o, l_discount AS conf, l_orderkey * 10 + l_linenumber AS seq, l_returnflag FROM lineitem),
  known AS (SELECT DISTINCT s, p, o FROM line WHERE l_returnflag = 'R'),
  fresh AS (SELECT *, row_number() OVER (PARTITION BY s, p, o ORDER BY seq, conf DESC) AS n FROM line WHERE l_returnflag <> 'R')
SELECT s, o, conf FROM fresh f WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.s = f.s AND k.o = f.o)""",
)
def insert_if_new(t: Tables):
    """Pairs of lines that were not returned, unless the returned lines have them already."""
    line = t.lineitem.select(
        facts.symbol("part", F.col("l_partkey")).alias("s"), F.lit("with").alias("p"), facts.symbol("supplier", F.col("l_suppkey")).alias("o"),
        F.col("l_discount").alias("conf"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_returnflag",
    )
    return store.insert_if_new(line.filter("l_returnflag = 'R'"), line.filter("l_returnflag <> 'R'")).select("s", "o", "conf")


@query("derived_split", with_views("places") + ", two AS (SELECT a.s, b.o FROM places a JOIN places b ON a.o = b.s) SELECT s, 'in' AS p, o FROM two WHERE (s, o) NOT IN (SELECT s, o FROM places WHERE p = 'in') GROUP BY ALL")
def derived_split(t: Tables):
    """Facts that follow from two places in a row, less those asserted."""
    known = facts.places(t)
    two = known.alias("a").join(known.alias("b"), F.col("a.o") == F.col("b.s")).select(F.col("a.s").alias("s"), F.lit("in").alias("p"), F.col("b.o").alias("o"))
    return store.derived(two, known)


AXIOM_SQL = """SELECT DISTINCT 'subclass' AS kind, 'urn:type/' || p_type AS s, 'urn:type/product' AS o FROM part UNION SELECT 'target', 'urn:' || p_brand, 'urn:type/' || p_type FROM part
  UNION SELECT 'range', 'urn:makes/' || p_brand, 'urn:type/' || p_type FROM part UNION SELECT 'subproperty', 'urn:makes/' || p_brand, 'urn:makes' FROM part UNION SELECT 'inverse', 'urn:makes/' || p_brand, 'urn:madeBy/' || p_brand FROM part
  UNION SELECT CASE WHEN p_size % 2 = 0 THEN 'symmetric' ELSE 'transitive' END, 'urn:sized/' || p_size, CASE WHEN p_size % 2 = 0 THEN 'http://www.w3.org/2002/07/owl#SymmetricProperty' ELSE 'http://www.w3.org/2002/07/owl#TransitiveProperty' END FROM part
  UNION SELECT 'label', 'urn:part/' || p_partkey, p_name || ' "' || p_size || '" \\ ' || p_brand FROM part UNION SELECT 'annotation', 'urn:part/' || p_partkey, CAST(p_size AS VARCHAR) FROM part"""


def axiom_lines(t: Tables):
    """Lines about parts, brands and types, every axiom as often as a part states it, between comments."""
    made = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    even = F.col("p_size") % 2 == 0
    rows = lambda s, p, o, is_iri=True: t.part.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(is_iri).alias("is_iri"))
    makes, kind = made("urn:makes/", "p_brand"), made("urn:type/", "p_type")
    every = facts.union(
        rows(kind, f"{axioms.RDFS}subClassOf", F.lit("urn:type/product")), rows(made("urn:", "p_brand"), "urn:madeAs", kind), rows(makes, f"{axioms.RDFS}range", kind),
        rows(makes, f"{axioms.RDFS}subPropertyOf", F.lit("urn:makes")), rows(makes, f"{axioms.OWL}inverseOf", made("urn:madeBy/", "p_brand")),
        rows(made("urn:sized/", "p_size"), f"{axioms.RDF}type", F.when(even, f"{axioms.OWL}SymmetricProperty").otherwise(f"{axioms.OWL}TransitiveProperty")),
        rows(made("urn:part/", "p_partkey"), f"{axioms.RDFS}label", F.concat("p_name", F.lit(' "'), F.col("p_size").cast("string"), F.lit('" \\ '), "p_brand"), False),
        rows(made("urn:part/", "p_partkey"), "urn:size", F.col("p_size").cast("string"), False),
    )
    return axioms.lines(every).union(t.part.select(F.concat(F.lit("# "), "p_name")))


@query("axiom_load", AXIOM_SQL)
def axiom_load(t: Tables):
    """Axiom rows written as text files and read back into tables by kind."""
    folder = shared_folder(t.spark, "axioms")
    axiom_lines(t).write.text(folder)
    return axioms.tables(axioms.triples(t.spark.read.text(folder))).select("kind", "s", "o")


@query(
    "pack_merge",
    """WITH a AS (SELECT p_brand AS iri, 'size' AS annotation, CAST(p_size AS VARCHAR) AS value, p_partkey % 3 AS pack_no FROM part)
SELECT iri, annotation, value, pack_no FROM (SELECT *, row_number() OVER (PARTITION BY iri, annotation ORDER BY pack_no, value) AS n FROM a) WHERE n = 1""",
)
def pack_merge(t: Tables):
    """Brands are annotated with sizes by three packs; the first pack with a value wins."""
    return store.merge_packs(t.part.select(F.col("p_brand").alias("iri"), F.lit("size").alias("annotation"), F.col("p_size").cast("string").alias("value"), (F.col("p_partkey") % 3).alias("pack_no")))


LINES_SQL = """lines AS (
  SELECT o_orderkey AS file, 0 AS line_no, '# statements' AS line FROM orders
  UNION ALL SELECT l_orderkey, l_linenumber, l_linenumber || '. part ' || l_partkey || ' is with supplier ' || l_suppkey FROM lineitem
  UNION ALL SELECT o_orderkey, 1000, '# questions' FROM orders
  UNION ALL SELECT l_orderkey, 1000 + l_linenumber, 'where is part ' || l_partkey FROM lineitem)"""


def order_lines(t: Tables):
    """A sectioned text per order: its lines as statements, then as questions, a blank line between."""
    line, own = F.col("l_linenumber").cast("long"), F.col("l_orderkey").alias("file")
    part, with_ = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    head = lambda at, text: t.orders.select(F.col("o_orderkey").alias("file"), F.lit(at).cast("long").alias("line_no"), F.lit(text).alias("line"))
    return facts.union(
        head(0, "# statements"),
        t.lineitem.select(own, line.alias("line_no"), F.concat(line.cast("string"), F.lit(". part "), part, F.lit(" is with supplier "), with_).alias("line")),
        head(999, " "),
        head(1000, "# questions"),
        t.lineitem.select(own, (line + 1000).alias("line_no"), F.concat(F.lit("where is part "), part).alias("line")),
    )


@query("dataset_sections", f"WITH {LINES_SQL} SELECT file, line_no, CASE WHEN line_no < 1000 THEN 'statements' ELSE 'questions' END AS section, regexp_replace(line, '^[0-9]+\\. ', '') AS text FROM lines WHERE line NOT LIKE '#%'")
def dataset_sections(t: Tables):
    return store.sections(order_lines(t))


@query("load_counts", f"WITH {LINES_SQL} SELECT CASE WHEN line_no < 1000 THEN 'statements' ELSE 'questions' END AS section, count(*) AS n FROM lines WHERE line NOT LIKE '#%' GROUP BY 1")
def load_counts(t: Tables):
    return store.sections(order_lines(t)).groupBy("section").agg(F.count("*").alias("n"))


CASES_SQL = """cases AS (SELECT l_orderkey AS file, l_partkey AS n, 'where is part ' || l_partkey AS question, string_agg('supplier ' || l_suppkey, '|' ORDER BY l_suppkey) AS expected
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) GROUP BY 1, 2)"""


def case_lines(t: Tables):
    """A text of `## Qn` blocks per order: where is a part, and the suppliers that the order has it from, a line each."""
    own = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("from"))
    part = F.col("l_partkey").cast("string")
    head = F.array(F.concat(F.lit("## Q"), part), F.concat(F.lit("where is part "), part))
    block = F.concat(head, F.transform("from", lambda x: F.concat(F.lit("supplier "), x.cast("string"))), F.array(F.lit(" ")))
    each = own.select(F.col("l_orderkey").alias("file"), "l_partkey", F.posexplode(block).alias("i", "line"))
    return each.select("file", F.row_number().over(Window.partitionBy("file").orderBy("l_partkey", "i")).alias("line_no"), "line")


@query("diagnostic_cases", f"WITH {CASES_SQL} FROM cases")
def diagnostic_cases(t: Tables):
    return store.cases(case_lines(t)).withColumn("expected", F.array_join("expected", "|"))


@query("lru_entities", "SELECT user_id, event_type, place FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC, event_type) AS place FROM events GROUP BY 1, 2) WHERE place <= 3")
def lru_entities(t: Tables):
    """The three event types that each user touched last."""
    return store.recent(t.events, "user_id", "event_type", "event_id", 3).select("user_id", "event_type", "place")


@query("recent_history", "SELECT conv_id, text, place FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY max(turn) DESC, text) AS place FROM conversations GROUP BY 1, 2) WHERE place <= 50")
def recent_history(t: Tables):
    return store.recent(t.conversations, "conv_id", "text", "turn", 50).select("conv_id", "text", "place")


@query("memory_snapshot", "SELECT conv_id, count(DISTINCT role) AS roles, least(count(DISTINCT text), 50) AS facts, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def memory_snapshot(t: Tables):
    """What a session remembers: active roles, recent distinct facts, last turn."""
    entities = store.recent(t.conversations, "conv_id", "role", "turn", 100).groupBy("conv_id").agg(F.count("*").alias("roles"))
    remembered = store.recent(t.conversations, "conv_id", "text", "turn", 50).groupBy("conv_id").agg(F.count("*").alias("facts"), F.max("last").alias("last_turn"))
    return entities.join(remembered, "conv_id")


@query(
    "predicate_partitions",
    "WITH " + SQL["places"] + ", " + SQL["pairs"] + ", " + SQL["attributes"] + " SELECT lower(p) AS p_local, count(*) AS n, round(avg(conf), 6) AS conf FROM (SELECT * FROM places UNION ALL SELECT * FROM pairs UNION ALL SELECT * FROM attributes) GROUP BY 1",
)
def predicate_partitions(t: Tables):
    """The fact table by its partition column."""
    own = facts.union(facts.places(t), facts.part_with_supplier(t), facts.attributes(t))
    return own.groupBy(exprs.local_name(F.col("p")).alias("p_local")).agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("conf"))


QUERIES, ORACLES = query.queries, query.oracles
