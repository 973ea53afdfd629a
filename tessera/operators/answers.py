"""Answers to diagnostic questions: what failed, what is ruled out, which signal, who restored, on what it depends.

A goal is one question over its own facts. Facts are (goal, s, p, o, seq), targets (goal, target, modifier), roles
(id, role), and candidates (goal, kind, node) with the kinds below. Work grows with the facts: nothing is paired with
everything of its goal, best nodes are aggregates, and the first k of a goal are taken in two steps, so that a goal
with very many rows isn't one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from . import diagnose, mentions
from .ontology import cut
from .store import by_predicate
from .text import clause

#: kinds of candidates
COMPONENT, SUBSYSTEM, LOSS, PRECURSOR, EVIDENCE, AGENT = "component", "subsystem", "loss", "precursor", "evidence", "agent"
# Names of the predicates that restore a target.
RESTORING = ["restore", "regain"]
#: parts that the rows of one group are dealt over before its first rows are taken
PARTS = 32


def top(df: DataFrame, by: list[str], order: list[Column], spread: Column, keep: int, place: str = "place") -> DataFrame:
    """The first `keep` rows of a group with their place; first of each of PARTS parts of the group, then of what those leave."""
    part = Window.partitionBy(*by, "_part").orderBy(*order)
    some = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(PARTS))).withColumn(place, F.row_number().over(part)).filter(F.col(place) <= keep)
    return some.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(place) <= keep).drop("_part")


def specific(node: Column) -> Column:
    return F.round(exprs.specificity(node), 6)


def best_specific(df: DataFrame, by: list[str], without_losses: bool) -> DataFrame:
    """(by, node): the most specific node of a group, the least name of equal ones; losses only where there is nothing else, if asked."""
    late = F.when(exprs.has_loss(F.col("node")), 1).otherwise(0) if without_losses else F.lit(0)
    return df.groupBy(*by).agg(F.min(F.struct(late.alias("late"), (-specific(F.col("node"))).alias("less"), "node")).alias("x")).select(*by, "x.node")


def local(facts: DataFrame) -> DataFrame:
    return facts.withColumn("p", exprs.local_name(F.col("p")))


def with_role(roles: DataFrame, *names: str) -> DataFrame:
    """(node): the ids that have one of the roles."""
    has = F.lit(False)
    for name in names:
        has = has | exprs.role_match(F.col("role"), name)
    return roles.filter(has).select(F.col("id").alias("node")).distinct()


def recovery_facts(facts: DataFrame, roles: DataFrame) -> DataFrame:
    """Facts `during` or `after` a recovery phase."""
    return local(facts).filter(F.col("p").isin("during", "after")).join(with_role(roles, "recovery_phase").withColumnRenamed("node", "o"), "o", "left_semi")


def candidates(facts: DataFrame, rules: DataFrame, targets: DataFrame, roles: DataFrame, weights: DataFrame) -> DataFrame:
    """(goal, kind, node), each once: failures of components and, with rules (goal, ant, con), of subsystems, lost
    capabilities, precursors (subjects of weighted facts at the target), evidence (those and the target, if it is the
    subject of one), recovery agents."""
    own, flag = local(facts), exprs.boolean_concept(F.col("o"))
    said = local(rules.select("goal", "con.s", "con.p", "con.o", F.lit(True).alias("con")).unionByName(rules.select("goal", "ant.s", "ant.p", "ant.o", F.lit(False).alias("con"))))
    told = own.select("goal", "s", "p", "o", F.lit(True).alias("con"))
    fails = (F.col("p") == "fail") & (flag | (F.col("s") == F.col("o"))) | F.col("con") & F.col("p").isin(diagnose.NEGATED) & ~flag
    lost = F.col("con") & (F.col("p") == "control") & ~flag
    node = lambda df, kind: df.select("goal", F.lit(kind).alias("kind"), F.col("s").alias("node"))
    weighted = by_predicate(own, weights.filter("weight > 0").select(exprs.local_name(F.col("p")).alias("p")).distinct(), "left_semi")
    pointing = weighted.join(targets.select("goal", F.col("target").alias("o")), ["goal", "o"], "left_semi")
    itself = weighted.join(targets.select("goal", F.col("target").alias("s")), ["goal", "s"], "left_semi")
    agents = recovery_facts(facts, roles).join(with_role(roles, "evidence_signal", "temporal_marker").withColumnRenamed("node", "s"), "s", "left_anti")
    parts = [node(told.filter(fails), COMPONENT), node(told.unionByName(said).filter(fails), SUBSYSTEM), node(told.unionByName(said).filter(lost), LOSS)]
    for df, kind in ((pointing, PRECURSOR), (pointing.unionByName(itself), EVIDENCE), (agents, AGENT)):
        parts.append(node(df, kind))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.distinct()


def of_kind(found: DataFrame, *kinds: str) -> DataFrame:
    return found.filter(F.col("kind").isin(*kinds)).select("goal", "node").distinct()


def primary_outcomes(facts: DataFrame, roles: DataFrame) -> DataFrame:
    """(goal, node): of the effects (objects of cause, subjects of causedBy) with the role outcome the most specific."""
    own = local(facts)
    effects = own.filter("p = 'cause'").select("goal", F.col("o").alias("node")).unionByName(own.filter("p = 'causedby'").select("goal", F.col("s").alias("node")))
    return best_specific(effects.join(with_role(roles, "outcome"), "node", "left_semi"), ["goal"], False)


def outcome_targets(targets: DataFrame, primary: DataFrame, roles: DataFrame) -> DataFrame:
    """(goal, target, outcome): a target that is an outcome or under control stays; signals, markers and losses give way
    to the primary outcome, all others too where a chain is asked for (modifier `chain` or `evidence`)."""
    stays, marks = with_role(roles, "control_target", "outcome"), with_role(roles, "evidence_signal", "temporal_marker")
    flags = lambda df, name: df.select(F.col("node").alias("target"), F.lit(True).alias(name))
    own = targets.join(flags(stays, "stays"), "target", "left").join(flags(marks, "marks"), "target", "left").join(primary.withColumnRenamed("node", "primary"), "goal", "left")
    gives = F.col("marks").isNotNull() | exprs.has_loss(F.col("target")) | F.coalesce(F.lower("modifier"), F.lit("")).rlike("chain|evidence")
    return own.select("goal", "target", F.when(F.col("stays").isNotNull(), F.col("target")).when(gives, F.coalesce("primary", "target")).otherwise(F.col("target")).alias("outcome"))


def supported(nodes: DataFrame, sources: DataFrame, facts: DataFrame) -> DataFrame:
    """(goal, node, support): temporal support of each of `nodes` (goal, node) summed over the goal's `sources` (goal, node).

    A source s supports n by 0.4 per fact s to n or `n after s`, 0.2 per `n before s`, and 0.2 per other `during` fact
    of either. The last part is counted as each side's `during` facts, so no source is paired with a node that
    no fact joins it to.
    """
    own = local(facts).filter(F.col("p").isin(diagnose.TEMPORAL)).select("goal", "s", "p", "o")
    during = own.filter("p = 'during'").groupBy("goal", F.col("s").alias("node")).agg(F.count("*").alias("times"))
    from_ = sources.join(during, ["goal", "node"], "left").groupBy("goal").agg(F.count("*").alias("sources"), F.coalesce(F.sum("times"), F.lit(0)).alias("told"))
    there = own.join(sources.withColumnRenamed("node", "s"), ["goal", "s"], "left_semi").select("goal", F.col("o").alias("node"), F.when(F.col("p") == "during", 0.2).otherwise(0.4).alias("w"))
    back = own.filter("s <> o AND p <> 'during'").join(sources.withColumnRenamed("node", "o"), ["goal", "o"], "left_semi").select("goal", F.col("s").alias("node"), F.when(F.col("p") == "after", 0.4).otherwise(0.2).alias("w"))
    links = there.unionByName(back).groupBy("goal", "node").agg(F.sum("w").alias("links"))
    both = nodes.join(from_, "goal").join(during, ["goal", "node"], "left").join(links, ["goal", "node"], "left").join(sources.withColumn("own", F.lit(1)), ["goal", "node"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = zero("links") + 0.2 * (F.col("told") + (F.col("sources") - zero("own")) * zero("times"))
    return both.select("goal", "node", F.round(total, 6).alias("support"))


def alignment(failures: DataFrame, found: DataFrame, targets: DataFrame, facts: DataFrame) -> DataFrame:
    """(goal, node, score) of failures (goal, node): 0.6 and 0.4 of the precursors' support for the failure and for the
    target, 0.4 and 0.2 of the evidence's, 0.2 more where the modifier asks for a sequence."""
    asked = targets.select("goal", F.col("target").alias("node"))
    total = failures.select("goal", "node")
    for kind, to_failure, to_target in ((PRECURSOR, 0.6, 0.4), (EVIDENCE, 0.4, 0.2)):
        sources = of_kind(found, kind)
        mine = supported(failures, sources, facts).select("goal", "node", (to_failure * F.col("support")).alias(f"{kind}_failure"))
        its = supported(asked, sources, facts).select("goal", (to_target * F.col("support")).alias(f"{kind}_target"))
        total = total.join(mine, ["goal", "node"], "left").join(its, "goal", "left")
    score = F.lit(0.0)
    for kind in (PRECURSOR, EVIDENCE):
        score = score + F.coalesce(f"{kind}_failure", F.lit(0.0)) + F.coalesce(f"{kind}_target", F.lit(0.0))
    more = targets.select("goal", F.when(F.lower("modifier").contains("sequence"), 0.2).otherwise(0.0).alias("more"))
    return total.join(more, "goal").select("goal", "node", F.round(score + F.col("more"), 6).alias("score"))


def timed(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds `timed`: whether a temporal fact of the goal has the node at either end."""
    own = local(facts).filter(F.col("p").isin(diagnose.TEMPORAL))
    there = own.select("goal", F.explode(F.array("s", "o")).alias("node")).distinct().withColumn("timed", F.lit(True))
    return nodes.join(there, ["goal", "node"], "left").withColumn("timed", F.coalesce("timed", F.lit(False)))


def aligned_failure(found: DataFrame, targets: DataFrame, facts: DataFrame, looked_at: int = 25) -> DataFrame:
    """(goal, node, score): of a goal's most specific failures the one that the evidence fits best: alignment, 0.3 of
    its specificity, 0.4 if it has a temporal context and 0.2 if the target has. Losses are not scored; a goal of losses only has its most specific one, without a score."""
    failures = of_kind(found, COMPONENT, SUBSYSTEM)
    some = top(failures, ["goal"], [F.desc(specific(F.col("node"))), F.col("node")], F.col("node"), looked_at).select("goal", "node")
    named = some.filter(~exprs.has_loss(F.col("node")))
    goals = timed(targets.select("goal", F.col("target").alias("node")), facts).select("goal", F.col("timed").alias("target_timed"))
    scored = timed(alignment(named, found, targets, facts), facts).join(goals, "goal")
    score = F.round(F.col("score") + 0.3 * specific(F.col("node")) + F.when(F.col("timed"), 0.4).otherwise(0.0) + F.when(F.col("target_timed"), 0.2).otherwise(0.0), 6)
    best = cut(scored.groupBy("goal").agg(F.min(F.struct((-score).alias("less"), "node")).alias("x")).select("goal", "x.node", (-F.col("x.less")).alias("score")))
    rest = best_specific(failures, ["goal"], True).join(best, "goal", "left_anti").select("goal", "node", F.lit(None).cast("double").alias("score"))
    return best.unionByName(rest)


def ruled_out(found: DataFrame, targets: DataFrame, facts: DataFrame, keep: int = 3) -> DataFrame:
    """(goal, node, score): failures with an alignment below 0.2, the first `keep` by name, of goals whose best is below
    0.3; a failure with a temporal context counts as 0.4 for the best, so a goal with one rules out nothing."""
    failures = of_kind(found, COMPONENT, SUBSYSTEM).filter(~exprs.has_loss(F.col("node")))
    scored = cut(timed(alignment(failures, found, targets, facts), facts))
    best = scored.groupBy("goal").agg(F.max(F.greatest("score", F.when(F.col("timed"), 0.4).otherwise(0.0))).alias("best")).filter("best < 0.3")
    low = scored.filter("score < 0.2").join(best.select("goal"), "goal", "left_semi")
    return top(low, ["goal"], [F.col("node")], F.col("node"), keep).select("goal", "node", "score")


def restorers(found: DataFrame, outcomes: DataFrame, facts: DataFrame) -> DataFrame:
    """(goal, node, tier): the most specific recovery agent, else who restored or regained the outcome."""
    agents = of_kind(found, AGENT).withColumn("tier", F.lit(0))
    doing = local(facts).filter(F.col("p").isin(RESTORING)).join(outcomes.select("goal", F.col("outcome").alias("o")), ["goal", "o"], "left_semi")
    every = agents.unionByName(doing.select("goal", F.col("s").alias("node"), F.lit(1).alias("tier")))
    return every.groupBy("goal").agg(F.min(F.struct("tier", (-specific(F.col("node"))).alias("less"), "node")).alias("x")).select("goal", "x.node", "x.tier")


def signal_answers(texts: DataFrame, found: DataFrame, facts: DataFrame, roles: DataFrame, weights: DataFrame) -> DataFrame:
    """(goal, node, tier) for texts (goal, text): the most specific evidence signal that the text names; else the node
    with the most weight and specificity of the goal's weighted facts; else the best signal among precursors and evidence."""
    signals = with_role(roles, "evidence_signal")
    names = signals.select("node", F.trim(mentions.plain_text(exprs.display(F.col("node")))).alias("phrase")).filter("phrase <> ''")
    said = mentions.occurrences(texts.select(F.col("goal").alias("key"), "text"), names.select("phrase").distinct())
    in_text = said.select(F.col("key").alias("goal"), "phrase").distinct().join(names, "phrase").select("goal", "node", specific(F.col("node")).alias("score"), F.lit(0).alias("tier"))
    weighted = by_predicate(local(facts), weights.select(exprs.local_name(F.col("p")).alias("p"), "weight")).groupBy("goal", F.col("s").alias("node")).agg(F.max("weight").alias("weight"))
    in_graph = weighted.select("goal", "node", F.round(F.col("weight") + specific(F.col("node")), 6).alias("score"), F.lit(1).alias("tier"))
    explained = of_kind(found, PRECURSOR, EVIDENCE).join(signals, "node", "left_semi").select("goal", "node", specific(F.col("node")).alias("score"), F.lit(2).alias("tier"))
    every = in_text.unionByName(in_graph).unionByName(explained).join(texts.select("goal"), "goal", "left_semi")
    return every.groupBy("goal").agg(F.min(F.struct("tier", (-F.col("score")).alias("less"), "node")).alias("x")).select("goal", "x.node", "x.tier")


def sentence(s: str | Column, p: str | Column, o: str | Column) -> Column:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return clause(as_column(s), as_column(p), as_column(o), F.lit(None).cast("string"))


def structured_chains(found: DataFrame, targets: DataFrame, facts: DataFrame, roles: DataFrame, most: int = 6) -> DataFrame:
    """(goal, lines): precursor, failures, lost capability, outcome, recovery, then evidence up to `most` lines.

    Failures are the two most specific components and one subsystem (the one that the evidence fits best, if that is a
    subsystem's), or two subsystems where no component failed. The recovery line comes if the modifier asks for it or
    the outcome speaks of stability. Last, the facts in time between the failure in focus and the outcome.
    """
    # What several lines start from is written once; otherwise each line would plan and run all of it again.
    outcomes = cut(outcome_targets(targets, primary_outcomes(facts, roles), roles))
    components = of_kind(found, COMPONENT)
    subsystems = of_kind(found, SUBSYSTEM).join(targets.select("goal", F.col("target").alias("node")), ["goal", "node"], "left_anti")
    fit = cut(aligned_failure(found, targets, facts).select("goal", "node"))
    fit_component = fit.join(components, ["goal", "node"], "left_semi")
    fit_subsystem = fit.join(components, ["goal", "node"], "left_anti")
    focus = cut(fit_component.unionByName(best_specific(components, ["goal"], True).join(fit_component, "goal", "left_anti")))
    order = [F.when(exprs.has_loss(F.col("node")), 1).otherwise(0), F.desc(specific(F.col("node"))), F.col("node")]
    first = lambda df: top(df, ["goal"], order, F.col("node"), 2).select("goal", "node", "place")
    chosen = cut(first(components))
    other = best_specific(subsystems.join(focus, ["goal", "node"], "left_anti"), ["goal"], True).join(fit_subsystem, "goal", "left_anti")
    third = fit_subsystem.unionByName(other).join(chosen.select("goal").distinct(), "goal", "left_semi").join(chosen, ["goal", "node"], "left_anti")
    failed = chosen.unionByName(first(subsystems.join(components.select("goal").distinct(), "goal", "left_anti"))).unionByName(third.withColumn("place", F.lit(3)))
    focus = focus.unionByName(fit_subsystem.join(focus, "goal", "left_anti"))
    name, node = exprs.display(F.col("node")), F.col("node")
    line = lambda df, at, text: df.select("goal", F.lit(at).alias("at"), text.alias("line"))
    failure = F.when(F.col("place") == 1, F.concat(F.lit("The "), name, F.lit(" failed."))).otherwise(F.concat(F.lit("This caused the "), name, F.lit(" to fail.")))
    said_loss = sentence(node, F.lit("control"), F.lit("concept:false"))
    goals = outcomes.join(targets.select("goal", "modifier"), "goal").withColumn("low", F.lower("outcome"))
    steady = ~F.col("low").contains("instability") & F.col("low").rlike("stable|stability")
    recovers = goals.filter(steady | F.coalesce(F.lower("modifier"), F.lit("")).contains("recovery")).select("goal")
    controlled = with_role(roles, "control_target").select(F.col("node").alias("outcome"), F.lit("loss of ").alias("lost"))
    ended = goals.join(controlled, "outcome", "left").select("goal", F.col("outcome").alias("node"), F.coalesce("lost", F.lit("")).alias("lost"))
    evidence = top(of_kind(found, PRECURSOR, EVIDENCE), ["goal"], [node], node, most).select("goal", "node")
    own = local(facts).filter(F.col("p").isin("before", "after"))
    pairs = focus.join(outcomes.select("goal", "outcome"), "goal")
    there = pairs.select("goal", F.col("node").alias("s"), F.col("outcome").alias("o"))
    between = own.join(there.unionByName(there.select("goal", F.col("o").alias("s"), F.col("s").alias("o"))).distinct(), ["goal", "s", "o"], "left_semi")
    main = [
        line(best_specific(of_kind(found, PRECURSOR), ["goal"], True), 0, F.concat(F.lit("Precursor signal was "), name, F.lit("."))),
        failed.select("goal", F.col("place").alias("at"), failure.alias("line")),
        line(best_specific(of_kind(found, LOSS), ["goal"], False), 4, said_loss),
        line(ended, 5, F.concat(F.lit("Outcome: "), "lost", name, F.lit("."))),
        line(restorers(found, outcomes, facts).join(recovers, "goal", "left_semi"), 6, F.concat(F.lit("Recovery: "), name, F.lit(" was active during recovery."))),
        line(evidence, 7, F.concat(F.lit("Evidence: "), name, F.lit("."))),
        line(between, 8, sentence("s", "p", "o")).distinct(),
    ]
    rows = main[0]
    for more in main[1:]:
        rows = rows.unionByName(more)
    # At most 7 lines, `most` of evidence and 4 sentences a goal meet here.
    all_ = rows.groupBy("goal").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
    of = lambda test: F.transform(F.filter("x", lambda r: test(r["at"])), lambda r: r["line"])
    told, proof, last = of(lambda a: a < 7), of(lambda a: a == 7), of(lambda a: a == 8)
    return all_.select("goal", F.concat(told, F.slice(proof, F.lit(1), F.greatest(F.lit(0), most - F.size(told))), last).alias("lines"))


def dependencies(facts: DataFrame) -> DataFrame:
    return local(facts).filter(F.col("p").isin([d.lower() for d in diagnose.DEPENDENCY]))


def dependency_contrasts(asked: DataFrame, facts: DataFrame, types: DataFrame, above: DataFrame, recovered: DataFrame, roles: DataFrame, most: int = 4) -> DataFrame:
    """(goal, lines) for mentions (goal, place, symbol): two recovery facts of the goal, then what the mentioned things, or
    the things of a mentioned type, depend on; `most` lines; with both, the inference that the recovery didn't depend on it.

    facts are of all goals (s, p, o, seq), recovered the goals' own; above (child, parent) is the closed type hierarchy. The
    first lines of a mention are found once for all goals that ask for it.
    """
    needs = dependencies(facts).select("s", "seq", sentence("s", "p", "o").alias("line"))
    symbols = asked.select("symbol").distinct()
    kinds = types.select(F.col("id").alias("s"), F.col("type").alias("symbol"))
    kinds = kinds.unionByName(kinds.join(above.select(F.col("child").alias("symbol"), "parent"), "symbol").select("s", F.col("parent").alias("symbol")))
    covers = kinds.join(symbols, "symbol", "left_semi").unionByName(symbols.select(F.col("symbol").alias("s"), "symbol")).distinct()
    lines = needs.join(covers, "s").groupBy("symbol", "line").agg(F.min("seq").alias("seq"))
    first = top(lines, ["symbol"], [F.col("seq"), F.col("line")], F.col("line"), most).select("symbol", "line", "seq")
    mine = asked.select("goal", "symbol").distinct().join(first, "symbol").groupBy("goal", "line").agg(F.min("seq").alias("seq"))
    again = top(recovery_facts(recovered, roles).select("goal", "seq", sentence("s", "p", "o").alias("line")), ["goal"], [F.col("seq"), F.col("line")], F.col("line"), 2).select("goal", "line", "seq")
    again = again.join(asked.select("goal").distinct(), "goal", "left_semi")
    # At most 2 + `most` lines a mention of the goal meet here.
    both = again.withColumn("kind", F.lit(0)).unionByName(mine.withColumn("kind", F.lit(1))).groupBy("goal").agg(F.array_sort(F.collect_list(F.struct("kind", "seq", "line"))).alias("x"), F.count_distinct("kind").alias("kinds"))
    label = asked.groupBy("goal").agg(exprs.display(F.min_by("symbol", "place")).alias("label"))
    lines_ = F.slice(F.transform("x", lambda r: r["line"]), 1, most)
    inferred = F.concat(F.lit("This suggests the recovery likely did not depend on "), "label", F.lit("."))
    return both.join(label, "goal").select("goal", F.when(F.col("kinds") == 2, F.array_append(lines_, inferred)).otherwise(lines_).alias("lines"))


def condition_contrasts(asked: DataFrame, resources: DataFrame, facts: DataFrame) -> DataFrame:
    """(goal, answer, way): if one thing is gone and the other remains, what fails and what still works.

    By the first dependency of a goal's first two mentions (goal, place, symbol); for goals with fewer than two, by its
    resources (goal, place, resource, status): the first unavailable and the first available one, else the first
    two, with the most specific dependent of the one and the first other dependent of the other.
    """
    needs = dependencies(facts)
    answer = lambda gone, kept, fails, works: F.concat(F.lit("If "), exprs.display(F.col(gone)), F.lit(" is unavailable but "), exprs.display(F.col(kept)), F.lit(" remains available, then "), exprs.display(F.col(fails)), F.lit(" may fail while "), exprs.display(F.col(works)), F.lit(" can operate."))
    named = top(asked.groupBy("goal", "symbol").agg(F.min("place").alias("at")), ["goal"], [F.col("at"), F.col("symbol")], F.col("symbol"), 2)
    two = named.groupBy("goal").agg(F.min_by("symbol", "place").alias("fails"), F.max_by("symbol", "place").alias("works"), F.count("*").alias("n")).filter("n = 2")
    sides = named.select(F.col("symbol").alias("s")).distinct()
    first = needs.join(sides, "s", "left_semi").groupBy("s").agg(F.min_by("o", F.struct("seq", "o")).alias("o"))
    by_mention = two.join(first.select(F.col("s").alias("fails"), F.col("o").alias("gone")), "fails").join(first.select(F.col("s").alias("works"), F.col("o").alias("kept")), "works")
    at = F.struct("place", "resource")
    pick = lambda test: F.min(F.when(test, at))["resource"]
    ends = F.array_sort(F.collect_list(F.struct("place", "resource")))
    least = top(resources.join(two, "goal", "left_anti"), ["goal"], [F.col("place"), F.col("resource")], F.col("resource"), 2, "_n").groupBy("goal").agg(ends.alias("x")).filter("size(x) = 2")
    state = resources.groupBy("goal").agg(pick(F.col("status") < 0).alias("down"), pick(F.col("status") > 0).alias("up"))
    known = F.col("down").isNotNull() & F.col("up").isNotNull()
    sided = least.join(state, "goal").select("goal", F.when(known, F.col("down")).otherwise(F.col("x")[0]["resource"]).alias("gone"), F.when(known, F.col("up")).otherwise(F.col("x")[1]["resource"]).alias("kept"))
    used = sided.select(F.explode(F.array("gone", "kept")).alias("o")).distinct()
    users = needs.join(used, "o", "left_semi").groupBy(F.col("o").alias("resource"), F.col("s").alias("node")).agg(F.min("seq").alias("seq"))
    best = best_specific(users, ["resource"], True).select(F.col("resource").alias("kept"), F.col("node").alias("works"))
    early = top(users, ["resource"], [F.col("seq"), F.col("node")], F.col("node"), 2, "_n").select(F.col("resource").alias("gone"), F.col("node").alias("fails"), "_n")
    by_resource = sided.join(best, "kept").join(early, "gone").filter("fails <> works").groupBy("goal", "gone", "kept", "works").agg(F.min_by("fails", "_n").alias("fails"))
    cols = lambda df, way: df.select("goal", answer("gone", "kept", "fails", "works").alias("answer"), F.lit(way).alias("way"))
    return cols(by_mention, "mention").unionByName(cols(by_resource, "resource"))


def predicate_lines(goals: DataFrame, facts: DataFrame, rules: DataFrame, recovered: DataFrame, roles: DataFrame, dynamic: DataFrame, most: int = 3) -> DataFrame:
    """(goal, lines) for goals (goal, predicate, subject, object) with a subject or an object: facts of the predicate by
    specificity of both ends and the predicate's weight, then rules whose consequent fits, then, for restore
    and regain, what was during or after the recovery; `most` distinct lines in all.

    The first facts of a (predicate, subject, object) are found once for all goals that ask the same.
    """
    asked = goals.withColumn("predicate", exprs.local_name(F.col("predicate"))).filter("subject IS NOT NULL OR object IS NOT NULL")
    keys = asked.select("predicate", "subject", "object").distinct()
    rule = F.concat(F.lit("If "), F.regexp_replace(sentence("ant.s", "ant.p", "ant.o"), r"^The (.*)\.$", "the $1"), F.lit(", then "), F.regexp_replace(sentence("con.s", "con.p", "con.o"), r"^The (.*)\.$", "the $1"), F.lit("."))
    told = local(facts).select("s", "p", "o", F.lit(0).alias("tier"), sentence("s", "p", "o").alias("line"))
    said = rules.select("con.s", exprs.local_name(F.col("con.p")).alias("p"), "con.o", F.lit(1).alias("tier"), rule.alias("line"))
    rows = by_predicate(told.unionByName(said), dynamic.select(exprs.local_name(F.col("p")).alias("p"), "weight"), "left")
    rows = rows.withColumn("less", F.round(-(specific(F.col("s")) + specific(F.col("o")) + F.coalesce("weight", F.lit(0.0))), 6))
    cols = ["predicate", "subject", "object", "tier", "less", "line"]
    by_s = keys.filter("subject IS NOT NULL").join(rows, (F.col("subject") == F.col("s")) & (F.col("predicate") == F.col("p"))).filter("object IS NULL OR object = o").select(*cols)
    by_o = keys.filter("subject IS NULL").join(rows, (F.col("object") == F.col("o")) & (F.col("predicate") == F.col("p"))).select(*cols)
    some = by_s.unionByName(by_o).groupBy("predicate", "subject", "object", "line").agg(F.min(F.struct("tier", "less")).alias("x")).select("predicate", "subject", "object", "x.*", "line")
    order = [F.col("tier"), F.col("less"), F.col("line")]
    first = top(some, ["predicate", "subject", "object"], order, F.col("line"), most).select(*cols)
    same = asked.alias("a").join(first.alias("f"), F.col("a.predicate").eqNullSafe(F.col("f.predicate")) & F.col("a.subject").eqNullSafe(F.col("f.subject")) & F.col("a.object").eqNullSafe(F.col("f.object")))
    restoring = asked.filter(F.col("predicate").isin(RESTORING)).select("goal")
    again = top(recovery_facts(recovered, roles).select("goal", F.lit(2).alias("tier"), F.col("seq").cast("double").alias("less"), sentence("s", "p", "o").alias("line")), ["goal"], order, F.col("line"), most).select("goal", "tier", "less", "line")
    rows = same.select("a.goal", "f.tier", "f.less", "f.line").unionByName(again.join(restoring, "goal", "left_semi"))
    return rows.groupBy("goal").agg(F.array_sort(F.collect_list(F.struct("tier", "less", "line"))).alias("x")).select("goal", F.slice(F.array_distinct(F.transform("x", lambda r: r["line"])), 1, most).alias("lines"))
