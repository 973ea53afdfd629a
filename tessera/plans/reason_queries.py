"""Queries on asserted winners, causes, focus, typed answers, mapping, traces; inputs reach every branch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import paths, reason, rules
from ..operators import query as ask
from ..sources import facts
from ..sources.facts import SQL, Tables, with_views
from . import answer_queries, diagnose_queries
from .diagnose_queries import ALIGN, CHAIN_SQL, EV
from .register import Register
from .rule_queries import GROUND_SQL, ground_rules

query = Register()


def step_sql(number: int) -> str:
    """A round of asserting: candidates of what is known but not asserted yet, the best of each user."""
    known = "(SELECT s FROM bad" + "".join(f" UNION ALL SELECT s FROM w{k}" for k in range(1, number)) + ")"
    return f"""c{number} AS (SELECT user_id AS goal, cs AS s, max(round(least(1.0, (rule_conf + 0.8) / 2), 9)) AS score FROM g WHERE s IN (SELECT s FROM {known}) AND cs NOT IN (SELECT s FROM {known}) GROUP BY 1, 2),
  w{number} AS (SELECT goal, s, score, {number} AS round FROM c{number} QUALIFY row_number() OVER (PARTITION BY goal ORDER BY score DESC, s) = 1)"""


@query(
    "assert_and_reason",
    f"{EV}, {GROUND_SQL}, g AS (SELECT ground.*, user_id FROM ground JOIN events USING (event_id)), bad AS (SELECT id AS s FROM ev WHERE event_type = 'error'), {step_sql(1)}, {step_sql(2)}, {step_sql(3)} "
    "SELECT goal, s, round(score, 6) AS score, round FROM (FROM w1 UNION ALL FROM w2 UNION ALL FROM w3)",
)
def assert_and_reason(t: Tables):
    """A user's best conclusion is inserted and the rules run again, three times; its failing events are given."""
    goals = t.events.select(F.col("user_id").alias("goal"), facts.event_symbol(F.col("event_id")).alias("s"))
    exact = ground_rules(t).withColumn("conf", F.round("conf", 9))
    got = reason.assert_and_reason(facts.event_failures(t), exact, goals, 3)
    return got.select("goal", "s", F.round("score", 6).alias("score"), "round")


@query(
    "effect_causes",
    EV + """, n AS (SELECT id, event_type, 'entity:event_' || nxt AS o FROM ev WHERE nxt IS NOT NULL), k AS (SELECT id, event_type AS next_type FROM ev),
  every AS (SELECT id AS cause, o AS effect, 'cause' AS way FROM n WHERE event_type = 'error' UNION SELECT n.id, o, 'causedBy' FROM n JOIN k ON o = k.id WHERE next_type = 'purchase' UNION SELECT id, o, 'rule' FROM n)
SELECT effect, count(*) AS n, min(cause) AS first, string_agg(way, ',' ORDER BY way) AS ways FROM every GROUP BY 1""",
)
def effect_causes(t: Tables):
    """Why an event: told causes, told effects the other way round (purchases), and rules that conclude it."""
    kinds = t.events.select(facts.event_symbol(F.col("event_id")).alias("o"), "event_type")
    told = facts.event_order(t).join(kinds.filter("event_type = 'purchase'"), "o", "left_semi").select(F.col("o").alias("s"), F.lit("causedBy").alias("p"), F.col("s").alias("o"), "conf", "seq")
    got = reason.cause_candidates(facts.union(facts.event_causes(t), told), ground_rules(t))
    return got.groupBy("effect").agg(F.count("*").alias("n"), F.min("cause").alias("first"), F.array_join(F.array_sort(F.collect_list("way")), ",").alias("ways"))


@query(
    "rule_ancestry_rules",
    EV + """, c AS (SELECT id AS cause, 'entity:event_' || nxt AS effect FROM ev WHERE nxt IS NOT NULL), t AS (SELECT id AS target FROM ev WHERE event_type = 'purchase'),
  a1 AS (SELECT target, cause AS node, 1 AS dist FROM t JOIN c ON target = effect), a2 AS (SELECT target, c.cause AS node, 2 AS dist FROM a1 JOIN c ON node = effect), a3 AS (SELECT target, c.cause AS node, 3 AS dist FROM a2 JOIN c ON node = effect)
SELECT target, arg_max(node, dist) AS cause, max(dist) AS dist FROM (FROM a1 UNION ALL FROM a2 UNION ALL FROM a3) GROUP BY 1""",
)
def rule_ancestry_rules(t: Tables):
    """Backwards from each purchase over the rules that conclude it, three steps."""
    targets = t.events.filter("event_type = 'purchase'").select(facts.event_symbol(F.col("event_id")).alias("target"))
    return paths.ancestry(reason.rule_causes(ground_rules(t)), targets)


ACTIVE = "active AS (SELECT id FROM (SELECT 'entity:part_' || l_partkey AS id, l_orderkey AS k FROM lineitem UNION ALL SELECT 'entity:supplier_' || l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1 ORDER BY max(k) DESC, id LIMIT 100)"


def active(t: Tables):
    """The working memory: the 100 things named last, parts by any line and suppliers by returns."""
    named = facts.union(
        t.lineitem.select(facts.symbol("part", F.col("l_partkey")).alias("id"), F.col("l_orderkey").alias("k")),
        t.lineitem.filter("l_returnflag = 'R'").select(facts.symbol("supplier", F.col("l_suppkey")).alias("id"), F.col("l_orderkey").alias("k")),
    )
    return named.groupBy("id").agg(F.max("k").alias("k")).orderBy(F.desc("k"), "id").limit(100)


@query(
    "memory_focus",
    with_views("pairs") + f""", {ACTIVE}, asked AS (
  SELECT CAST(substr(s, 13) AS BIGINT) AS goal_id, o AS answer, s AS subject, NULL AS object, conf FROM pairs UNION ALL SELECT -1 - CAST(substr(o, 17) AS BIGINT), s, NULL, o, conf FROM pairs)
SELECT goal_id, answer, CAST(CASE WHEN answer IN (FROM active) THEN 1.0 WHEN subject IN (FROM active) THEN 0.9 WHEN object IN (FROM active) THEN 0.8 ELSE 0.6 END AS DOUBLE) AS focus,
  round(least(1, (2 + conf + CASE WHEN answer IN (FROM active) THEN 1.0 WHEN subject IN (FROM active) THEN 0.9 WHEN object IN (FROM active) THEN 0.8 ELSE 0.6 END) / 4), 6) AS head_score FROM asked""",
)
def memory_focus(t: Tables):
    """Scores follow the conversation: answers, subjects and objects named lately count more."""
    by_part = answer_queries.part_goals(t)
    by_supplier = answer_queries.goal(t.supplier, -1 - F.col("s_suppkey"), None, "with", facts.symbol("supplier", F.col("s_suppkey")), F.lit("concept:product"))
    goals = by_part.unionByName(by_supplier)
    found = ask.relation_query(goals, facts.part_with_supplier(t), answer_queries.axioms(t))
    got = reason.with_focus(found, goals, active(t))
    return got.select("goal_id", "answer", "focus", F.round(exprs.mean_score(F.col("qmatch"), F.lit(1.0), F.col("conf"), F.col("focus")), 6).alias("head_score"))


TYPED = """ty AS (SELECT 'entity:supplier_' || s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'http://x.example/Supplier' ELSE 'concept:supplier' END AS type FROM supplier WHERE s_suppkey % 3 < 2),
  asked AS (SELECT l_partkey AS goal_id, 'entity:supplier_' || l_suppkey AS answer, l_suppkey, CASE l_partkey % 5 WHEN 1 THEN 'concept:thing' WHEN 2 THEN 'http://x.example/Company' WHEN 3 THEN 'http://x.example/Person' WHEN 4 THEN 'http://x.example/Other' END AS expected FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))"""


def supplier_types(t: Tables):
    """A third of the suppliers has an IRI as type, a third a concept, a third none."""
    kind = F.when(F.col("s_suppkey") % 3 == 0, "http://x.example/Supplier").otherwise("concept:supplier")
    return t.supplier.filter("s_suppkey % 3 < 2").select(facts.symbol("supplier", F.col("s_suppkey")).alias("id"), kind.alias("type"))


def wider(t: Tables):
    rows = [("http://x.example/Supplier", "http://x.example/Supplier"), ("http://x.example/Supplier", "http://x.example/Company"), ("concept:supplier", "concept:supplier")]
    return t.spark.createDataFrame(rows, "type string, wider string")


def expected(key):
    return F.when(key % 5 == 1, "concept:thing").when(key % 5 == 2, "http://x.example/Company").when(key % 5 == 3, "http://x.example/Person").when(key % 5 == 4, "http://x.example/Other")


@query(
    "type_filter",
    f"""WITH {TYPED} SELECT goal_id, count(*) AS n, count(*) FILTER (WHERE CASE WHEN expected IS NULL THEN TRUE WHEN l_suppkey % 3 = 2 THEN FALSE WHEN expected = 'concept:thing' THEN TRUE
  WHEN l_suppkey % 3 = 1 THEN expected <> 'http://x.example/Person' ELSE expected = 'http://x.example/Company' END) AS passing FROM asked GROUP BY 1""",
)
def type_filter(t: Tables):
    """Answers that may stand for what is asked for: all five cases of expectation and knowledge."""
    asked = facts.pairs(t).select(F.col("l_partkey").alias("goal_id"), facts.symbol("supplier", F.col("l_suppkey")).alias("answer"), expected(F.col("l_partkey")).alias("expected_type"))
    got = reason.passes_type(asked, supplier_types(t), wider(t))
    return got.groupBy("goal_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("passes"), 1)).alias("passing"))


@query(
    "typed_count",
    f"""WITH {TYPED}, people AS (SELECT 'entity:customer_' || c_custkey AS id, c_nationkey AS n FROM customer UNION ALL SELECT 'entity:supplier_' || s_suppkey, s_nationkey FROM supplier)
SELECT CAST(n AS BIGINT) AS goal_id, count(*) AS found FROM people LEFT JOIN ty USING (id) WHERE CASE n % 3 WHEN 0 THEN id LIKE 'entity:customer%' WHEN 1 THEN coalesce(type IN ('concept:supplier', 'http://x.example/Supplier'), FALSE)
  ELSE id LIKE 'entity:customer%' OR type IS NOT NULL END GROUP BY 1""",
)
def typed_count(t: Tables):
    """How many people, suppliers or companies are in nation N?"""
    people = t.customer.select(facts.symbol("customer", F.col("c_custkey")).alias("id"), F.lit("concept:person").alias("type"))
    both = facts.union(
        t.customer.select(F.col("c_nationkey").cast("long").alias("goal_id"), facts.symbol("customer", F.col("c_custkey")).alias("answer")),
        t.supplier.select(F.col("s_nationkey").cast("long").alias("goal_id"), facts.symbol("supplier", F.col("s_suppkey")).alias("answer")),
    )
    kind = F.when(F.col("goal_id") % 3 == 0, "concept:person").when(F.col("goal_id") % 3 == 1, "supplier").otherwise("http://x.example/Company")
    got = reason.counted_type(both.withColumn("expected_type", kind), people.unionByName(supplier_types(t)), wider(t))
    return got.groupBy("goal_id").agg(F.count_distinct("answer").alias("found"))


@query(
    "predicate_only_sides",
    f"""WITH {TYPED} SELECT CASE WHEN goal_id % 7 = 0 THEN 'entity:part_' || goal_id ELSE answer END AS answer, count(*) AS n FROM asked WHERE l_suppkey % 3 = 0 OR goal_id % 7 = 0 GROUP BY 1""",
)
def predicate_only_sides(t: Tables):
    """What is `with` what, asked for a company: the part where it has no IRI type, else the supplier where that is one."""
    own = facts.part_with_supplier(t).select(F.lit(0).alias("goal_id"), F.lit("http://x.example/Company").alias("expected_type"), "s", "p", "o")
    plain = t.part.filter("p_partkey % 7 = 0").select(facts.symbol("part", F.col("p_partkey")).alias("id"), F.lit("concept:part").alias("type"))
    strict = supplier_types(t).filter(exprs.is_iri(F.col("type")))
    other = t.part.filter("p_partkey % 7 <> 0").select(facts.symbol("part", F.col("p_partkey")).alias("id"), F.lit("http://x.example/Part").alias("type"))
    got = reason.fitting_side(own, facts.union(strict, plain, other), wider(t))
    return got.groupBy("answer").agg(F.count("*").alias("n"))


@query(
    "property_targets",
    """SELECT p, count(*) AS n, min(o) AS first FROM (
  SELECT DISTINCT 'locatedIn' AS p, 'http://x.example/supplier/' || s_suppkey AS s, 'http://x.example/nation/' || s_nationkey AS o FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT DISTINCT 'seeAlso', 'http://x.example/part/' || p_partkey, 'http://x.example/brand/' || p_brand FROM part WHERE p_partkey % 2 = 0) GROUP BY 1""",
)
def property_targets(t: Tables):
    """Targets of object properties: named suppliers' places, and annotations of parts that are IRIs and not text."""
    iri = lambda kind, key: F.concat(F.lit(f"http://x.example/{kind}/"), key.cast("string"))
    place = F.when(F.col("s_suppkey") % 2 == 0, iri("nation", F.col("s_nationkey"))).otherwise(F.concat(F.lit("entity:nation_"), F.col("s_nationkey").cast("string")))
    told = t.supplier.select(iri("supplier", F.col("s_suppkey")).alias("s"), F.lit("locatedIn").alias("p"), place.alias("o"))
    value = F.when(F.col("p_partkey") % 2 == 0, iri("brand", F.col("p_brand"))).otherwise(F.col("p_type"))
    notes = t.part.select(iri("part", F.col("p_partkey")).alias("iri"), F.lit("seeAlso").alias("annotation"), value.alias("value"))
    return reason.property_targets(told, notes).groupBy("p").agg(F.count("*").alias("n"), F.min("o").alias("first"))


@query("annotation_reverse", "SELECT 'kind' AS annotation, lower(p_type) AS value, count(*) AS n, min('part_' || p_partkey) AS first FROM part WHERE p_size % 2 = 0 GROUP BY 2")
def annotation_reverse(t: Tables):
    """Entities that carry an annotation's value, however it is written."""
    notes = t.part.filter("p_size % 2 = 0").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("iri"), F.lit("kind").alias("annotation"), F.concat(F.lit(" "), F.upper("p_type")).alias("value"))
    wanted = t.part.select(F.lit("kind").alias("annotation"), F.col("p_type").alias("value")).distinct()
    return reason.annotated_with(notes, wanted).groupBy("annotation", "value").agg(F.count("*").alias("n"), F.min("iri").alias("first"))


def hashed_sql(name: str, labels: str) -> str:
    """The hashed trigram vectors of a query's labels, as common table expressions."""
    code = "(961 * ascii(substr(f, i, 1)) + 31 * ascii(substr(f, i + 1, 1)) + ascii(substr(f, i + 2, 1)))"
    return f"""{name}_v AS (SELECT label, {code} % 256 AS slot, sum(CASE WHEN {code} % 2 = 0 THEN 1 ELSE -1 END) AS w FROM (SELECT label, f, unnest(range(1, length(f) - 1)) AS i FROM (SELECT label, replace(lower(label), ' ', '_') AS f FROM ({labels}))) GROUP BY 1, 2),
  {name} AS (SELECT label, slot, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS w FROM {name}_v WHERE w <> 0)"""


TERMS = "SELECT DISTINCT p_name AS q FROM part UNION SELECT DISTINCT p_name || 'ish' FROM part UNION SELECT DISTINCT event_type || ' zzz' FROM events"


@query(
    "mapper_fallback",
    f"""WITH {hashed_sql('h', 'SELECT DISTINCT p_name AS label FROM part')}, {hashed_sql('g', f'SELECT q AS label FROM ({TERMS}) WHERE q NOT IN (SELECT p_name FROM part)')},
  d AS (SELECT g.label AS query, h.label, round(sum(g.w * h.w), 9) AS score FROM g JOIN h USING (slot) GROUP BY 1, 2), b AS (SELECT query, max({{'score': score, 'label': label}}).label AS label FROM d WHERE score >= 0.6 GROUP BY 1)
SELECT q AS query, CASE WHEN q IN (SELECT p_name FROM part) THEN q ELSE label END AS label, CASE WHEN q IN (SELECT p_name FROM part) THEN 0 WHEN label IS NOT NULL THEN 1 ELSE 2 END AS tier FROM ({TERMS}) LEFT JOIN b ON q = query""",
)
def mapper_fallback(t: Tables):
    """Names are found by label, misspelt ones by their nearest vector, others not at all."""
    names = t.part.select(F.explode(F.array("p_name", F.concat("p_name", F.lit("ish")))).alias("query"))
    terms = names.union(t.events.select(F.concat("event_type", F.lit(" zzz"))))
    return reason.map_terms(terms.distinct(), t.part.select(F.col("p_name").alias("label")).distinct())


@query(
    "word_vectorizer",
    """WITH l AS (SELECT DISTINCT p_name AS label FROM part), w AS (SELECT label, unnest(string_split(label, ' ')) AS slot FROM l), v AS (SELECT label, slot, 1 / sqrt(count(*) OVER (PARTITION BY label)) AS w FROM (SELECT DISTINCT * FROM w)),
  q AS (SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS query FROM part), qw AS (SELECT query, unnest(string_split(query, ' ')) AS slot FROM q), qv AS (SELECT query, slot, 1 / sqrt(count(*) OVER (PARTITION BY query)) AS w FROM (SELECT DISTINCT * FROM qw)),
  d AS (SELECT query, label, round(sum(qv.w * v.w), 9) AS score FROM qv JOIN v USING (slot) GROUP BY 1, 2) SELECT query, max({'score': score, 'label': label}).label AS label, 1 AS tier FROM d WHERE score >= 0.6 AND query NOT IN (SELECT label FROM l) GROUP BY 1
UNION ALL SELECT query, query, 0 FROM q WHERE query IN (SELECT label FROM l)""",
)
def word_vectorizer(t: Tables):
    """A user's own vectorizer, of words: it takes the place of the hashed trigrams and finds names with their words turned round."""
    def by_words(labels):
        each = labels.select("label", F.explode(F.array_distinct(F.split("label", " "))).alias("slot"))
        return each.join(each.groupBy("label").agg(F.count("*").alias("n")), "label").select("label", "slot", (1 / F.sqrt("n")).alias("w"))

    turned = t.part.select(F.concat_ws(" ", F.split("p_name", " ")[1], F.split("p_name", " ")[0]).alias("query")).distinct()
    return reason.map_terms(turned, t.part.select(F.col("p_name").alias("label")).distinct(), vectorizer=by_words)


@query(
    "goal_mapping",
    """SELECT CASE event_type WHEN 'click' THEN 'http://x.example/click' WHEN 'view' THEN 'http://x.example/view' ELSE event_type || 'ed' END AS predicate, CASE WHEN event_id % 2 = 0 THEN 'entity:event_' || event_id ELSE 'concept:event' END AS subject,
  CASE WHEN event_id % 3 = 0 THEN 'http://x.example/view' WHEN event_id % 3 = 1 THEN 'concept:person' END AS expected_type, event_id AS goal_id FROM events""",
)
def goal_mapping(t: Tables):
    """Goals in plain words get namespaces and IRIs: `clicked` by its stem, `view` by its label, others stay."""
    labels = t.spark.createDataFrame([("click", "http://x.example/click"), ("view", "http://x.example/view")], "label string, iri string")
    said = F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(F.concat("event_type", F.lit("ed")))
    subject = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("event_"), F.col("event_id").cast("string"))).otherwise("concept:event")
    kind = F.when(F.col("event_id") % 3 == 0, "concept:View").when(F.col("event_id") % 3 == 1, "concept:person")
    goals = t.events.select(F.col("event_id").alias("goal_id"), subject.alias("subject"), said.alias("predicate"), F.lit(None).cast("string").alias("object"), kind.alias("expected_type"))
    return reason.map_goal(goals, labels).select("goal_id", "subject", "predicate", "expected_type")


@query(
    "chain_expansion",
    f"""{CHAIN_SQL}, s AS ({diagnose_queries.ROLE_LIST}), b AS (SELECT user_id AS goal, max({{'hops': hops, 'score': round(score, 6) + 0.0, 'node': node}}) AS x FROM ch JOIN ev ON start = id GROUP BY 1)
SELECT s.goal, CASE WHEN n <= 2 AND coalesce(x.hops > n, FALSE) THEN x.hops ELSE n END AS lines, n <= 2 AND coalesce(x.hops > n, FALSE) AS replaced, CASE WHEN n <= 2 AND x.hops > n THEN x.node END AS last FROM s LEFT JOIN b USING (goal)""",
)
def chain_expansion(t: Tables):
    """A user's chain of one or two lines gives way to the longest path from one of the user's failures."""
    chains = paths.best_chains(diagnose_queries.weighted(t), diagnose_queries.errors(t, "start"), depth=3)
    users = t.events.select(facts.event_symbol(F.col("event_id")).alias("start"), F.col("user_id").alias("goal"))
    own = chains.join(users, "start").select("goal", "hops", (F.round("score", 6) + 0.0).alias("score"), "node")
    return reason.expand_short(diagnose_queries.structured_chain(t).select("goal", "n"), own)


@query(
    "failure_outcome_path",
    f"""{CHAIN_SQL}{ALIGN.removeprefix(EV)}, o AS (SELECT id AS node FROM ev WHERE event_type = 'purchase')
SELECT goal, round(max(round(ch.score, 9) + round(al.score, 9)), 6) AS score FROM ch JOIN o USING (node) JOIN al ON al.failure = ch.start GROUP BY 1""",
)
def failure_outcome_path(t: Tables):
    """Of a user's failures the chain to an outcome that is best by its weights and the failure's evidence."""
    chains = paths.best_chains(diagnose_queries.weighted(t), diagnose_queries.errors(t, "start"), depth=3)
    outcomes = t.events.filter("event_type = 'purchase'").select(facts.event_symbol(F.col("event_id")).alias("node"))
    aligned = diagnose_queries.aligned(t).select("goal", F.col("failure").alias("start"), F.col("score").alias("support"))
    both = chains.join(outcomes, "node", "left_semi").join(aligned, "start")
    return both.groupBy("goal").agg(F.round(F.max(F.col("score") + F.col("support")), 6).alias("score"))


RULED = SQL["pairs"] + ", " + SQL["places"]


@query(
    "rule_families",
    f"""WITH {RULED}, pw AS (SELECT s, o FROM pairs), ch AS (SELECT s, o FROM places WHERE s LIKE 'entity:supplier%'), up AS (SELECT s, o FROM places WHERE p = 'in'),
  ch2 AS (SELECT ch.s, up.o FROM ch JOIN up ON ch.o = up.s), cl AS (SELECT s, o FROM ch UNION SELECT s, o FROM up UNION SELECT s, o FROM ch2),
  po AS (SELECT s, o FROM pw UNION SELECT pw.s, cl.o FROM pw JOIN cl ON pw.o = cl.s), wear AS (SELECT 'entity:customer_' || c_custkey AS s, 'concept:' || lower(c_mktsegment) AS o FROM customer)
SELECT 'poweredBy' AS p, count(*) AS n FROM po UNION ALL SELECT 'chargedBy', count(*) FROM cl UNION ALL SELECT 'wear', count(*) FROM wear UNION ALL SELECT 'on', count(*) FROM wear""",
)
def rule_families(t: Tables):
    """Parts are powered by suppliers, these charged by places within places; what is worn is on."""
    charged = facts.places(t).filter("s LIKE 'entity:supplier%' OR p = 'in'").withColumn("p", F.lit("chargedBy"))
    worn = facts.fact(t.customer, facts.symbol("customer", F.col("c_custkey")), "wear", F.concat(F.lit("concept:"), F.lower("c_mktsegment")), F.lit(0.9), F.col("c_custkey"))
    some = [r for r in rules.catalogue() if r.name.startswith(("poweredBy", "chargedBy", "wear-to"))]
    got = rules.propagate(facts.union(facts.part_powered_by(t), charged, worn), some, most_rounds=5)
    return got.groupBy("p").agg(F.count("*").alias("n"))


@query(
    "disabled_rules",
    """WITH b AS (SELECT DISTINCT p_brand, p_type FROM part) SELECT 'in' AS p, (SELECT count(*) FROM b) + (SELECT count(*) FROM part JOIN b USING (p_brand) WHERE p_partkey % 2 = 0) AS n
UNION ALL SELECT 'on', count(*) FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'under', count(*) FROM part WHERE p_partkey % 2 = 1""",
)
def disabled_rules(t: Tables):
    """Rules that are kept off: `on` passes on a place when its rule is switched on, `under` stays off."""
    put = facts.fact(t.part, facts.symbol("part", F.col("p_partkey")), "on", facts.concept(F.col("p_brand")), F.lit(0.9), F.col("p_partkey")).withColumn("p", F.when(F.substring("s", 13, 20).cast("long") % 2 == 0, "on").otherwise("under"))
    shelf = t.part.select(facts.concept(F.col("p_brand")).alias("s"), F.lit("in").alias("p"), facts.concept(F.col("p_type")).alias("o")).distinct().withColumns({"conf": F.lit(0.9), "seq": F.lit(0).cast("long")})
    some = [rules.Rule(r.name, r.patterns, r.action, r.weight, r.name.startswith("on-")) for r in rules.catalogue() if not r.enabled]
    got = rules.propagate(facts.union(put, shelf), some, most_rounds=2)
    return got.groupBy("p").agg(F.count("*").alias("n"))


@query(
    "meta_transitive",
    EV + """, e AS (SELECT event_id AS s, nxt AS o FROM ev WHERE nxt IS NOT NULL), two AS (SELECT a.s, b.o FROM e a JOIN e b ON a.o = b.s) SELECT 'before' AS p, (SELECT count(*) FROM e) + (SELECT count(*) FROM two) AS n""",
)
def meta_transitive(t: Tables):
    """The rule of a transitive property, one round over the order of events."""
    got = rules.propagate(facts.event_order(t), rules.meta_rules(["before"], [], []), most_rounds=1)
    return got.groupBy("p").agg(F.count("*").alias("n"))


@query(
    "trace_explain",
    f"WITH {answer_queries.SCORED}, x AS (SELECT goal_id, answer, rank, s || ' with ' || answer AS evidence, conf, round(prob, 6) AS prob FROM ranked WHERE rank <= 2) SELECT goal_id, answer, rank, evidence, 'conf' AS part, round(conf, 6) AS value FROM x UNION ALL SELECT goal_id, answer, rank, evidence, 'prob', prob FROM x",
)
def trace_explain(t: Tables):
    """Every ranked candidate is written to the trace table; the explanation reads the first two back, with the parts of their score."""
    from ..streaming.ingest import shared_folder

    folder = shared_folder(t.spark, "trace")
    parts = F.create_map(F.lit("conf"), F.round("conf", 6), F.lit("prob"), F.round("prob", 6))
    ranked = answer_queries.scored(t, answer_queries.part_goals(t)).select("goal_id", "answer", "rank", F.concat_ws(" ", "s", "p", "o").alias("evidence"), parts.alias("breakdown"))
    reason.write_trace(ranked, folder)
    return reason.explain(t.spark.read.parquet(folder), 2)


@query(
    "rule_append",
    EV + """, r AS (SELECT id, 'entity:event_' || nxt AS c, event_id AS seq FROM ev WHERE nxt IS NOT NULL) SELECT count(*) AS n, sum(seq) AS seqs FROM r""",
)
def rule_append(t: Tables):
    """Rules added again keep their first row; new ones join the table."""
    own = ground_rules(t)
    even, again = own.filter("seq % 2 = 0"), own.withColumn("seq", F.col("seq") + 1_000_000_000)
    kept = reason.append_rules(reason.append_rules(even, own.filter("seq % 2 = 1")), again)
    return kept.agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query("losses", "SELECT CAST(e.event_id AS BIGINT) AS key, e.event_type = 'error' AS loss, round(1.0 + least(0.4, 0.05 * CASE WHEN event_type = 'view' THEN 4 ELSE 3 END) - CASE WHEN event_type = 'error' THEN 0.3 ELSE 0 END - 0.35 * CASE event_type WHEN 'view' THEN 3 ELSE 1 END, 6)::DOUBLE AS specific FROM events e")
def losses(t: Tables):
    """Names with a loss, with one container word or three."""
    word = F.when(F.col("event_type") == "error", "loss_of").when(F.col("event_type") == "view", "system_device").otherwise("gain_of")
    name = F.when(F.col("event_type") == "view", F.concat(F.lit("entity:x_"), word, F.lit("_event"))).otherwise(F.concat(F.lit("entity:"), word, F.lit("_event")))
    return t.events.select(F.col("event_id").cast("long").alias("key"), exprs.has_loss(name).alias("loss"), F.round(exprs.specificity(name), 6).alias("specific"))


QUERIES, ORACLES = query.queries, query.oracles
