"""Queries on closures, rules, labels and aliases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import ontology, rule_tables, rules
from ..sources import facts
from ..sources.facts import SQL, Tables, with_views
from .register import Register

query = Register()

MADE_SQL = """made AS (
  SELECT DISTINCT 'madeBy_' || p_brand AS child, 'madeBy_' || substr(p_brand, 1, 7) AS parent FROM part
  UNION SELECT DISTINCT 'madeBy_' || substr(p_brand, 1, 7), 'madeBy' FROM part)"""
CLOSURE_SQL = "cl AS (SELECT child, parent FROM {0} UNION SELECT c.child, e.parent FROM cl c JOIN {0} e ON c.parent = e.child)"


def made(t: Tables):
    """Property hierarchy: made by a brand, by its maker, by anyone."""
    brand = F.concat(F.lit("madeBy_"), "p_brand")
    maker = F.concat(F.lit("madeBy_"), F.substring("p_brand", 1, 7))
    return t.part.select(brand.alias("child"), maker.alias("parent")).union(t.part.select(maker, F.lit("madeBy"))).distinct()


@query("subclass_closure", "WITH RECURSIVE " + SQL["subclass"] + ", " + CLOSURE_SQL.format("subclass") + " SELECT child, parent FROM cl")
def subclass_closure(t: Tables):
    return ontology.closure(facts.subclass(t), "child", "parent")


@query("subproperty_closure", f"WITH RECURSIVE {MADE_SQL}, {CLOSURE_SQL.format('made')} SELECT child, parent FROM cl")
def subproperty_closure(t: Tables):
    return ontology.closure(made(t), "child", "parent")


@query(
    "family_expansion",
    f"WITH RECURSIVE {MADE_SQL}, {CLOSURE_SQL.format('made')} SELECT 'making' AS family, 'madeBy' AS p UNION SELECT 'making', child FROM cl WHERE parent = 'madeBy' UNION SELECT 'making', 'makes'",
)
def family_expansion(t: Tables):
    members = t.spark.createDataFrame([("making", "madeBy")], "family string, p string")
    inverse = t.spark.createDataFrame([("madeBy", "makes")], "p string, inv string")
    return ontology.family(members, ontology.closure(made(t), "child", "parent"), inverse)


@query(
    "hypernym_path",
    """SELECT DISTINCT p_name AS start, node, dist FROM (SELECT p_name, p_name AS node, 0 AS dist FROM part UNION ALL SELECT p_name, split_part(p_name, ' ', 2), 1 FROM part UNION ALL SELECT p_name, 'thing', 2 FROM part)""",
)
def hypernym_path(t: Tables):
    """A name's hypernym is its noun, a noun's is `thing`."""
    noun = F.split("p_name", " ")[1]
    edges = t.part.select(F.col("p_name").alias("s"), noun.alias("o")).union(t.part.select(noun, F.lit("thing"))).distinct()
    return ontology.reachable(edges, t.part.select(F.col("p_name").alias("start")).distinct(), 4)


@query("type_compatibility", "WITH RECURSIVE " + SQL["subclass"] + ", " + CLOSURE_SQL.format("subclass") + " SELECT child AS a, parent AS b FROM cl UNION SELECT 'concept:' || lower(r_name), 'concept:region' FROM region UNION SELECT 'concept:region', 'concept:' || lower(r_name) FROM region")
def type_compatibility(t: Tables):
    sub = ontology.closure(facts.subclass(t), "child", "parent")
    exact = t.region.select(F.concat(F.lit("concept:"), F.lower("r_name")).alias("a"), F.lit("concept:region").alias("b"))
    return ontology.compatible_types(sub, sub.select(F.col("child").alias("a"), F.col("parent").alias("b")), exact)


@query("equivalence_clusters", "SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS cluster FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_type, p_size) > 1")
def equivalence_clusters(t: Tables):
    """Parts alike in brand, type and size, linked one to the next: a cluster each."""
    after = F.lead("p_partkey").over(Window.partitionBy("p_brand", "p_type", "p_size").orderBy("p_partkey"))
    return ontology.clusters(t.part.select(F.col("p_partkey").alias("a"), after.alias("b")).filter("b IS NOT NULL"))


@query("pattern_match", with_views("requires", "pairs") + " SELECT x.o AS b, count(*) AS n, round(avg((r.conf + x.conf) / 2), 6) AS conf FROM requires r JOIN pairs x ON r.o = x.s GROUP BY 1")
def pattern_match(t: Tables):
    """Orders that require a part that is with a supplier."""
    own = facts.union(facts.order_requires(t), facts.part_with_supplier(t))
    got = rules.match(own, (("?a", "requires", "?m"), ("?m", "with", "?b")))
    return got.groupBy("b").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("conf"))


@query(
    "rule_action",
    with_views("places", "pairs") + " SELECT x.s, 'in' AS p, n.o, 0.7::DOUBLE AS conf, round(max(least(1, (0.7 + (x.conf + n.conf) / 2) / 2)), 6) AS score FROM pairs x JOIN (SELECT s, o, conf FROM places) n ON x.o = n.s GROUP BY ALL",
)
def rule_action(t: Tables):
    """One rule: a part is in the nation of a supplier it is with; the best derivation of each fact."""
    placed = facts.places(t).withColumn("p", F.lit("in"))
    rule = rules.Rule("with-location-reverse", (("?a", "with", "?b"), ("?b", "in", "?c")), ("?a", "in", "?c"))
    got = rules.best_per_fact(rules.apply(facts.union(placed, facts.part_with_supplier(t)), rule))
    return got.select("s", "p", "o", "conf", F.round("score", 6).alias("score"))


GROUND_SQL = """ground AS (SELECT id AS s, 'entity:event_' || nxt AS cs, 0.5 + (event_id % 5)::DOUBLE / 10 AS rule_conf, event_id FROM ev WHERE nxt IS NOT NULL)"""


def ground_rules(t: Tables):
    """If an event fails, then the next one of its user fails."""
    each = facts.event_order(t)
    ant = F.struct(F.col("s"), F.lit("fail").alias("p"), F.lit("concept:true").alias("o"), F.lit(0.8).alias("conf"))
    con = F.struct(F.col("o").alias("s"), F.lit("fail").alias("p"), F.lit("concept:true").alias("o"), F.lit(0.8).alias("conf"))
    return each.select(ant.alias("ant"), con.alias("con"), (0.5 + (F.col("seq") % 5) / 10).alias("conf"), "seq")


@query(
    "forward_chain",
    with_views("ev") + ", " + GROUND_SQL + ", bad AS (SELECT id FROM ev WHERE event_type = 'error') SELECT cs AS s, round(least(1, (rule_conf + 0.8) / 2), 6) AS score FROM ground WHERE s IN (FROM bad) AND cs NOT IN (FROM bad)",
)
def forward_chain(t: Tables):
    return rules.forward_chain(facts.event_failures(t), ground_rules(t)).select("s", F.round("score", 6).alias("score"))


@query(
    "propagation_closure",
    "WITH RECURSIVE " + SQL["places"] + ", " + SQL["pairs"]
    + """, up AS (SELECT s, o FROM places WHERE p = 'in'),
  cl AS (SELECT s, o FROM places UNION SELECT * FROM (
    SELECT c.s, u.o FROM cl c JOIN up u ON c.o = u.s
    UNION ALL SELECT x.s, c.o FROM cl c JOIN pairs x ON x.o = c.s
    UNION ALL SELECT x.o, c.o FROM cl c JOIN pairs x ON x.s = c.s))
SELECT s, o FROM cl""",
)
def propagation_closure(t: Tables):
    """All the catalogue's rules, read as a table, to a fixpoint: where everything is."""
    own = facts.union(facts.places(t), facts.part_with_supplier(t))
    return rule_tables.closed(own, rule_tables.catalogue(t.spark)).filter("p = 'in'").select("s", "o")


@query(
    "meta_rules",
    "WITH RECURSIVE " + SQL["ev"] + """ SELECT 'after' AS p, count(*) AS n FROM ev WHERE nxt IS NOT NULL UNION ALL SELECT 'before', count(*) FROM ev WHERE nxt IS NOT NULL
UNION ALL SELECT 'with', 2 * count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)""",
)
def meta_rules(t: Tables):
    """Symmetric and inverse rules made from property flags, one round."""
    own = facts.union(facts.event_order(t), facts.part_with_supplier(t))
    got = rules.propagate(own, rules.meta_rules([], ["with"], [("before", "after")]), most_rounds=1)
    return got.groupBy("p").agg(F.count("*").alias("n"))


@query("rule_table", with_views("places", "pairs") + " SELECT 'with-location-reverse' AS name, count(*) AS facts FROM pairs UNION ALL SELECT 'with-location-transfer', count(*) FROM pairs UNION ALL SELECT 'transitive-in', count(*) FROM places WHERE p = 'in' UNION ALL SELECT 'transitive-locatedIn', count(*) FROM places WHERE p = 'locatedIn' UNION ALL SELECT 'locatedIn-to-in', count(*) FROM places WHERE p = 'locatedIn'")
def rule_table(t: Tables):
    """Usable rules of the catalogue and the facts that their first pattern has; rules without facts left out."""
    table = t.spark.createDataFrame([(r.name, r.patterns[0][1]) for r in rules.usable(rules.catalogue())], "name string, p string")
    own = facts.union(facts.places(t), facts.part_with_supplier(t)).groupBy("p").agg(F.count("*").alias("facts"))
    return own.join(F.broadcast(table), "p").select("name", "facts")


@query(
    "rule_definitions",
    """WITH raw AS (SELECT p_partkey AS seq, CASE WHEN p_size % 7 <> 0 THEN p_brand || '-rule' END AS name, CASE p_size % 4 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS enabled, CASE WHEN p_size % 5 = 0 THEN 'ranker' WHEN p_size % 5 = 1 THEN 'pattern_match' END AS executor,
    CASE WHEN p_size % 6 > 0 THEN 'has' || p_brand END AS term, CASE WHEN p_size % 11 > 0 THEN 'is' || p_type END AS action, CASE WHEN p_size % 3 > 0 THEN p_size / 100.0 END AS weight FROM part),
  sound AS (SELECT seq, coalesce(name, 'rule_' || seq) AS name, upper(coalesce(executor, 'PATTERN_MATCH')) AS executor, term, action, coalesce(weight, 0.7) AS weight FROM raw WHERE coalesce(enabled, TRUE))
SELECT name, executor, term AS predicate, action, round(weight, 6)::DOUBLE AS weight, seq FROM sound WHERE executor <> 'PATTERN_MATCH' OR term IS NOT NULL AND action IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY executor, term, action ORDER BY seq) = 1""",
)
def rule_definitions(t: Tables):
    """A rule per part, many of them alike, disabled, incomplete or without weight: those that count, with defaults filled in."""
    size = F.col("p_size")
    triple = lambda s, p, o: F.struct(F.lit(s).alias("s"), p.alias("p"), F.lit(o).alias("o"))
    raw = t.part.select(
        F.col("p_partkey").alias("seq"), F.when(size % 7 != 0, F.concat("p_brand", F.lit("-rule"))).alias("name"), F.when(size % 4 == 0, False).when(size % 4 == 1, True).alias("enabled"),
        F.when(size % 5 == 0, "ranker").when(size % 5 == 1, "pattern_match").alias("executor"), F.lit(None).cast("map<string,string>").alias("params"),
        F.array(triple("?a", F.when(size % 6 > 0, F.concat(F.lit("has"), "p_brand")), "?b")).alias("patterns"), triple("?a", F.when(size % 11 > 0, F.concat(F.lit("is"), "p_type")), "?b").alias("action"),
        F.when(size % 3 > 0, size / 100).alias("weight"),
    )
    got = rule_tables.definitions(raw)
    return got.select("name", "executor", F.get("patterns", F.lit(0))["p"].alias("predicate"), F.col("action.p").alias("action"), F.round("weight", 6).alias("weight"), "seq")


@query(
    "user_rule",
    with_views("requires", "pairs") + " SELECT r.s, x.o FROM requires r JOIN pairs x ON r.o = x.s GROUP BY ALL",
)
def user_rule(t: Tables):
    """A rule given as data: an order depends on the suppliers of its parts. Keys stay numbers until the facts are made."""
    rule = rules.Rule("order-depends", (("?a", "requires", "?b"), ("?b", "with", "?c")), ("?a", "dependsOn", "?c"), 0.9)
    told = lambda s, p, o: t.lineitem.select(F.col(s).alias("s"), F.lit(p).alias("p"), F.col(o).alias("o"))
    own = told("l_orderkey", "requires", "l_partkey").unionByName(told("l_partkey", "with", "l_suppkey"))
    return rules.conclusions(own, rule).select(facts.symbol("order", F.col("s")).alias("s"), facts.symbol("supplier", F.col("o")).alias("o"))


LABELS_SQL = """labels AS (
  SELECT 'http://a.example/part/' || p_partkey AS iri, p_name AS label FROM part UNION ALL SELECT 'http://b.example/nation/' || n_nationkey, n_name FROM nation
  UNION ALL SELECT DISTINCT 'http://b.example/thing/' || replace(p_name, ' ', '-'), upper(p_name) FROM part)"""


def labels(t: Tables):
    return facts.union(
        t.part.select(F.concat(F.lit("http://a.example/part/"), F.col("p_partkey").cast("string")).alias("iri"), F.col("p_name").alias("label")),
        t.nation.select(F.concat(F.lit("http://b.example/nation/"), F.col("n_nationkey").cast("string")).alias("iri"), F.col("n_name").alias("label")),
        t.part.select(F.concat(F.lit("http://b.example/thing/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("iri"), F.upper("p_name").alias("label")).distinct(),
    )


@query("label_to_iri", f"WITH {LABELS_SQL} SELECT regexp_replace(replace(lower(trim(label)), '_', ' '), '\\s+', ' ', 'g') AS key, count(*) AS n, min(iri) AS first FROM labels GROUP BY 1")
def label_to_iri(t: Tables):
    return ontology.label_index(labels(t)).groupBy("key").agg(F.count("*").alias("n"), F.min("iri").alias("first"))


@query("term_mapping", f"WITH {LABELS_SQL}, k AS (SELECT replace(regexp_replace(lower(trim(label)), '[^a-z0-9_ ]', '', 'g'), ' ', '_') AS term, iri FROM labels) SELECT term, arg_min(iri, (NOT starts_with(iri, 'http://b.example'), iri)) AS iri FROM k GROUP BY 1")
def term_mapping(t: Tables):
    return ontology.dictionary(labels(t), "http://b.example")


@query("user_dictionary", f"WITH {LABELS_SQL}, d AS (SELECT DISTINCT replace(lower(label), ' ', '_') AS term FROM labels) SELECT p_name AS text, term IS NOT NULL AS exact FROM (SELECT DISTINCT p_name FROM part) LEFT JOIN d ON term = replace(p_name, ' ', '_')")
def user_dictionary(t: Tables):
    """Names looked up in a user's dictionary table by mapper form; exact or not found."""
    own = ontology.dictionary(labels(t), "http://b.example")
    return t.part.select(F.col("p_name").alias("text"), exprs.normal_mapper(F.col("p_name")).alias("term")).distinct().join(own, "term", "left").select("text", F.col("iri").isNotNull().alias("exact"))


@query(
    "canonical_type",
    f"""WITH {LABELS_SQL}, k AS (SELECT replace(lower(label), '_', ' ') AS key, arg_min(iri, (NOT starts_with(iri, 'http://b.example/thing'), iri)) AS iri FROM labels GROUP BY 1),
  t AS (SELECT DISTINCT 'concept:' || replace(p_name, ' ', '_') AS type, p_name AS key FROM part UNION SELECT DISTINCT 'concept:' || lower(p_type), lower(p_type) FROM part UNION SELECT DISTINCT 'concept:' || lower(n_name), lower(n_name) FROM nation UNION SELECT DISTINCT 'concept:thing', 'thing' FROM part)
SELECT type, CASE WHEN t.key = 'thing' THEN NULL ELSE coalesce(iri, type) END AS iri FROM t LEFT JOIN k ON k.key = replace(t.key, '_', ' ')""",
)
def canonical_type(t: Tables):
    """Names of parts have two IRIs, nations one, types of parts none, and thing is no type."""
    types = facts.union(
        t.part.select(facts.concept(F.col("p_name")).alias("type")), t.part.select(facts.concept(F.col("p_type")).alias("type")),
        t.nation.select(F.concat(F.lit("concept:"), F.lower("n_name")).alias("type")), t.part.select(F.lit("concept:thing").alias("type")),
    )
    return ontology.canonical_types(types, labels(t), "http://b.example/thing")


@query(
    "annotation_lookup",
    """WITH a AS (SELECT p_name AS iri, 'size' AS annotation, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_name, 'brand', p_brand FROM part),
  q AS (SELECT DISTINCT p_name AS iri, unnest(['size', 'brand', 'colour']) AS annotation FROM part)
SELECT iri, annotation, min(value) AS value, try_cast(min(value) AS DOUBLE) AS number FROM q LEFT JOIN a USING (iri, annotation) GROUP BY 1, 2""",
)
def annotation_lookup(t: Tables):
    """Three annotations of every name: one reads as a number, one doesn't, one is nowhere."""
    notes = t.part.select(F.col("p_name").alias("iri"), F.lit("size").alias("annotation"), F.col("p_size").cast("string").alias("value")).union(t.part.select("p_name", F.lit("brand"), "p_brand"))
    asked = t.part.select(F.col("p_name").alias("iri"), F.explode(F.array(*[F.lit(x) for x in ("size", "brand", "colour")])).alias("annotation"))
    return ontology.annotation_values(asked, notes)


@query("property_ranges", "SELECT DISTINCT 'urn:makes/' || p_brand AS p, 'urn:type/' || p_type AS range FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 10)")
def property_ranges(t: Tables):
    """What the makers of large parts make, by the range axioms of the line text; other predicates have none."""
    from ..sources import axioms
    from .store_queries import axiom_lines

    large = t.part.filter("p_size > 10")
    asked = large.select(F.concat(F.lit("urn:makes/"), "p_brand").alias("p")).union(large.select(F.concat(F.lit("urn:"), "p_brand")))
    return ontology.property_ranges(asked, axioms.tables(axioms.triples(axiom_lines(t))))


ALIAS_SQL = """sym AS (SELECT DISTINCT 'entity:' || replace(p_name, ' ', '_') AS symbol, split_part(p_name, ' ', 2) AS noun FROM part),
  known AS (SELECT symbol FROM sym UNION SELECT 'concept:' || noun FROM sym UNION SELECT 'concept:' || noun || 's' FROM sym UNION SELECT 'entity:old_' || substr(symbol, 8) FROM sym)"""


def known_symbols(t: Tables):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    noun = F.split("p_name", " ")[1]
    return facts.union(
        t.part.select(F.concat(F.lit("entity:"), name).alias("symbol")), t.part.select(F.concat(F.lit("concept:"), noun).alias("symbol")),
        t.part.select(F.concat(F.lit("concept:"), noun, F.lit("s")).alias("symbol")), t.part.select(F.concat(F.lit("entity:old_"), name).alias("symbol")),
    ).distinct()


@query(
    "alias_expansion",
    f"WITH {ALIAS_SQL} SELECT symbol, 'entity:old_' || substr(symbol, 8) AS alias FROM sym UNION SELECT 'concept:' || noun, 'concept:' || noun || 's' FROM sym UNION SELECT 'concept:' || noun || 's', 'concept:' || noun FROM sym",
)
def alias_expansion(t: Tables):
    """Names, nouns, their plurals, and older names that end the same."""
    known = known_symbols(t)
    return ontology.aliases(known, known)


@query("relationship_aliases", "SELECT DISTINCT 'control_' || split_part(p_name, ' ', 2) AS symbol, split_part(p_name, ' ', 2) || '_control' AS alias FROM part")
def relationship_aliases(t: Tables):
    """control_x is known as x_control."""
    noun = F.split("p_name", " ")[1]
    known = t.part.select(F.concat(noun, F.lit("_control")).alias("alias")).distinct()
    asked = t.part.select(F.concat(F.lit("control_"), noun).alias("symbol")).distinct()
    return asked.withColumn("alias", F.concat(F.regexp_replace("symbol", "^control_", ""), F.lit("_control"))).join(known, "alias", "left_semi").select("symbol", "alias")


@query("type_bridge", "WITH RECURSIVE " + SQL["types"] + ", " + SQL["subclass"] + ", " + CLOSURE_SQL.format("subclass") + " SELECT id, type FROM types UNION SELECT id, parent FROM types JOIN cl ON type = child")
def type_bridge(t: Tables):
    """Entities with their types and everything above those."""
    up = ontology.closure(facts.subclass(t), "child", "parent")
    own = facts.entity_types(t)
    return own.union(own.join(up, F.col("type") == F.col("child")).select("id", F.col("parent").alias("type"))).distinct()


QUERIES, ORACLES = query.queries, query.oracles
