"""Copies of a parent session's records in forked sessions.

Sessions are put into levels, parents before children, and a level's rows are decided together: what the levels before have
proven (fingerprint to fact) comes by a join on ancestor and fingerprint, and what happens inside a session is windows over its
rows. A fork's row with just one inherited fact is a copy of it. There are as many rounds as the longest line of forks has
members; each reads its own level's rows and the proofs that an heir can ask for, and is written to the shared folder.

A session whose line of parents is broken (no metadata, contradicting metadata, a parent that isn't there, a circle) proves
nothing, and so do its descendants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch, kept, stored
from .graph import component_labels

ORDER = ("occurred_at_ms", "ordinal", "evidence_id")
#: So many levels' proofs are read as tables of their own before they are written as one.
MOST_TABLES = 16
RESULT = ("evidence_id", "fact_id", "session_native_id", "code")


def sessions(evidence: DataFrame) -> DataFrame:
    """(session, parent, is_fork, conflict) from all session records, own and carried."""
    own = evidence.where("harness = 'codex'").select(F.explode(F.concat(F.array(F.struct("ordinal", "data", "diagnostics")), "context")).alias("c")).select("c.data", "c.diagnostics").where(F.contains("data", F.lit("session_meta"))).distinct()
    at = lambda p: F.nullif(F.trim(F.get_json_object("data", f"$.payload.{p}")), F.lit(""))
    parents = F.array_distinct(F.array_compact(F.array(at("forked_from_id"), at("parent_thread_id"), at("source.subagent.thread_spawn.parent_thread_id"))))
    metas = own.where(F.get_json_object("data", "$.type") == "session_meta").select(at("id").alias("session"), parents.alias("parents"), F.array_contains("diagnostics", "native_subagent_present").alias("sub")).where("session is not null")
    metas = metas.select("session", F.when(F.size("parents") > 0, F.element_at("parents", -1)).otherwise("").alias("parent"), ((F.size("parents") > 0) | F.coalesce("sub", F.lit(False))).alias("is_fork"), (F.size("parents") > 1).alias("split"))
    return metas.groupBy("session").agg(F.max("parent").alias("parent"), F.max("is_fork").alias("is_fork"), (F.max("split") | (F.min("parent") != F.max("parent")) | (F.min("is_fork") != F.max("is_fork"))).alias("conflict"))


def _met_first(circled: DataFrame, used: DataFrame) -> DataFrame:
    """(session): of each circle of parents the one at which a walk from the smallest used session comes in. circled: sessions
    (session, parent) whose line of parents ends in a circle."""
    ring, n = circled, circled.count()
    while True:  # without those that no one has for a parent, until only circles are left
        ring = kept(ring.join(ring.select(F.col("parent").alias("session")).distinct(), "session", "left_semi"))
        before, n = n, ring.count()
        if n == before:
            break
    labels = component_labels(ring.select(F.col("session").alias("node")), ring.select(F.col("session").alias("child"), "parent"))
    landed = front = kept(ring.join(labels, ring["session"] == labels["node"]).select("session", F.col("session").alias("landing"), "component"))
    while not front.isEmpty():
        next_ = circled.join(front.select(F.col("session").alias("parent"), "landing", "component"), "parent").select("session", "landing", "component")
        front = kept(next_.join(landed, "session", "left_anti"))
        landed = kept(landed.unionByName(front))
    first = landed.join(used, "session", "left_semi").groupBy("component").agg(F.min(F.struct("session", "landing")).alias("x"))
    return first.select(F.col("x.landing").alias("session")).distinct()


def levels(metas: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(session, is_fork, problem, level) of all sessions, those of `used` (session) without metadata too; (session, ancestor) for
    sessions that inherit; and the number of levels. Only sessions that inherit have a level above 0."""
    metas = kept(metas)
    there = metas.select(F.col("session").alias("parent"), F.lit(True).alias("__there"))
    linked = metas.join(there, "parent", "left").withColumn("__linked", F.col("is_fork") & F.coalesce("__there", F.lit(False))).drop("__there")
    problem = F.when(F.col("is_fork"), "missing_parent").when(F.col("conflict"), "conflicting_parent").otherwise("")
    front = kept(linked.where("not __linked").select("session", "is_fork", problem.alias("problem"), F.lit(0).alias("level")))
    rest, placed, lines, level = kept(linked.where("__linked").drop("__linked")), [front], [], 0
    while not rest.isEmpty():
        level += 1
        above = front.select(F.col("session").alias("parent"), F.col("problem").alias("__above"))
        own = F.when(F.col("__above") != "", "unresolved_parent").when(F.col("conflict"), "conflicting_parent").otherwise("")
        found = kept(rest.join(above, "parent").select("session", "parent", "is_fork", own.alias("problem")))
        if found.isEmpty():
            break
        heirs = found.where("problem <> 'unresolved_parent'").select("session", F.col("parent").alias("ancestor"))
        lines.append(kept(heirs.unionByName(heirs.withColumnRenamed("ancestor", "__p").join(lines[-1].withColumnRenamed("session", "__p"), "__p").select("session", "ancestor")) if lines else heirs))
        front = found.select("session", "is_fork", "problem", F.when(F.col("problem") == "unresolved_parent", 0).otherwise(level).alias("level"))
        placed.append(front)
        rest = kept(rest.join(found.select("session"), "session", "left_anti"))
    if not rest.isEmpty():
        entry = _met_first(rest.select("session", "parent"), used).withColumn("__entry", F.lit(True))
        placed.append(rest.join(entry, "session", "left").select("session", "is_fork", F.when(F.col("__entry"), "ancestry_cycle").otherwise("unresolved_parent").alias("problem"), F.lit(0).alias("level")))
    out, closure = placed[0], lines[0] if lines else metas.limit(0).select("session", F.col("parent").alias("ancestor"))
    for p in placed[1:]:
        out = out.unionByName(p)
    for line in lines[1:]:
        closure = closure.unionByName(line)
    unknown = used.distinct().join(metas, "session", "left_anti").select("session", F.lit(False).alias("is_fork"), F.lit("missing_session_context").alias("problem"), F.lit(0).alias("level"))
    return kept(out.unionByName(unknown)), kept(closure), len(lines) + 1


def _inherited(rows: DataFrame, closure: DataFrame, proofs: DataFrame) -> DataFrame:
    """What rows of a level inherit, to be put beside them: (session, fingerprint, facts, original): how many facts of ancestors have the
    fingerprint, and the least of them; and (session, turn, in_turn): an ancestor has a proof in the turn. Sessions ask their
    ancestors, not the other way round: what goes through a shuffle are a session's rows for each of its ancestors, however many heirs these have."""
    asked = lambda key: rows.select("session", key).join(closure, "session").distinct()
    owned = proofs.select(F.col("session").alias("ancestor"), "fingerprint", "fact_id")
    same = asked("fingerprint").where(F.length("fingerprint") > 0).join(owned, ["ancestor", "fingerprint"])
    facts = same.groupBy("session", "fingerprint").agg(F.count("*").alias("facts"), F.min(F.struct("fact_id", F.col("ancestor").alias("session"))).alias("original"))
    # A turn's name may hold colons, and a message's begins with that of its turn and a colon.
    parts = F.split("turn", ":")
    turns = proofs.where("turn <> ''").select(F.col("session").alias("ancestor"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ":"))).alias("turn")).distinct()
    met = asked("turn").join(turns, ["ancestor", "turn"], "left_semi").select("session", "turn").distinct().withColumn("in_turn", F.lit(True))
    return facts.unionByName(met, allowMissingColumns=True).withColumn("inherited", F.lit(True))


def _decided(rows: DataFrame, inherited: DataFrame | None, more: tuple[str, ...]) -> DataFrame:
    """One level's rows with RESULT's columns, those of `more` and what a proof needs. A session's rows and what they inherit meet once:
    all windows run over the partitions of one shuffle."""
    if inherited is None:
        rows = rows.repartition("session").withColumns({"facts": F.lit(None).cast("long"), "original": F.when(F.lit(False), F.struct("fact_id", "session")), "in_turn": F.lit(None).cast("boolean")})
    else:
        print_, turn = Window.partitionBy("session", "fingerprint"), Window.partitionBy("session", "turn")
        rows = rows.withColumn("inherited", F.lit(False)).unionByName(inherited, allowMissingColumns=True).repartition("session")
        rows = rows.withColumns({"facts": F.max("facts").over(print_), "original": F.max("original").over(print_)}).withColumn("in_turn", F.max("in_turn").over(turn)).where("not inherited")
    rows = rows.withColumn("__copy", F.coalesce(F.col("facts") == 1, F.lit(False)))
    # The first row of a fact is its head; only heads of the session's own rows move marks.
    of_fact, line = Window.partitionBy("session", "__copy", "fact_id").orderBy(*ORDER), Window.partitionBy("session", "__copy").orderBy(*ORDER)
    rows = rows.withColumn("__head", F.row_number().over(of_fact) == 1)
    of_heads = lambda c: F.when(F.col("__head"), c)
    last = F.last(of_heads(F.struct("turn")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__last", last).withColumn("__new", F.coalesce(of_heads(F.col("turn") != F.col("__last.turn")).cast("int"), F.lit(0)))
    # A fork's mark starts anew with each turn. The mark before a row is the largest sum so far; of that sum the last counters are compared.
    rows = rows.withColumn("__run", F.when(F.col("is_fork"), F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0))).otherwise(0))
    before = Window.partitionBy("session", "__copy", "__run").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__stale", F.coalesce(F.col("counters.sum") < F.max(of_heads(F.col("counters.sum"))).over(before), F.lit(False)))
    rows = rows.withColumn("__same", F.coalesce(F.last(of_heads(F.when(~F.col("__stale"), F.col("counters"))), ignorenulls=True).over(before) == F.col("counters"), F.lit(False)))
    code = (
        F.when(F.col("__same"), "known_duplicate").when(F.col("__stale"), "stale_snapshot").when(F.col("problem") != "", F.col("problem"))
        .when(F.length("fingerprint") == 0, F.coalesce(F.nullif("code", F.lit("")), F.lit("unverifiable_snapshot"))).when(F.col("facts") > 1, "ambiguous_parent_fact").when(F.col("in_turn"), "uncertain_replay_boundary").otherwise(F.col("code"))
    )
    rows = rows.withColumn("__code", F.first(code).over(of_fact))
    copy, head = F.col("__copy"), F.col("__head")
    out = rows.select(
        "evidence_id", F.when(copy, F.col("original.fact_id")).otherwise(F.col("fact_id")).alias("fact_id"), F.when(copy, F.col("original.session")).otherwise(F.col("session")).alias("session_native_id"),
        F.when(copy, "known_duplicate").when(head, F.col("__code")).otherwise(F.coalesce(F.nullif("__code", F.lit("")), "code")).alias("code"), *more, "session", "fingerprint", "turn", (head & ~copy & F.col("has_heirs")).alias("proves"),
    )
    # A repeated id proves nothing of its own, and what no heir can ask for isn't written.
    proof = F.col("proves") & (F.col("code") == "") & (F.length("fingerprint") > 0)
    return out.select(*RESULT, *more, F.when(proof, F.struct("session", "fingerprint", "fact_id", "turn")).alias("proof"))


def _counters(cumulative: str) -> Column:
    """What is compared of a row's cumulative counters (-1: absent), and their sum: input, output, reasoning and the larger cache counter."""
    i, o, r, total = (F.col(f"{cumulative}.{c}") for c in ("input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"))
    cache = F.greatest(f"{cumulative}.cached_input_tokens", f"{cumulative}.cache_read_input_tokens")
    above = [F.greatest(x, F.lit(0)) for x in (i, cache, o, r)]
    return F.when(F.col(cumulative).isNotNull(), F.struct((above[0] + above[1] + above[2] + above[3]).alias("sum"), i.alias("input"), cache.alias("cache"), o.alias("output"), r.alias("reasoning"), total.alias("total")))


def decide(rows: DataFrame, metas: DataFrame, more: tuple[str, ...] = (), keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """RESULT, and the columns of `more`, for rows (session, evidence_id, fact_id, ordinal, occurred_at_ms, turn, fingerprint, counters, code)
    by the sessions' ancestry. Ids and fingerprints may be text or binary. keep: writes a level's decisions."""
    placed, closure, n = levels(metas, rows.select("session").distinct())
    with Scratch() as own:
        heirs = closure.select(F.col("ancestor").alias("session")).distinct().withColumn("has_heirs", F.lit(True))
        rows = rows.join(placed.join(heirs, "session", "left").withColumn("has_heirs", F.coalesce("has_heirs", F.lit(False))), "session")
        if n > 1:  # where a session is alone, only whether there is a fingerprint counts
            asks = F.col("has_heirs") | (F.col("level") > 0)
            rows = own.dealt(rows.withColumn("fingerprint", F.when(asks, F.col("fingerprint")).otherwise(F.substring("fingerprint", 1, 1))), "level")
        done, proofs = [], []
        for level in range(n):
            at, inherited = rows.where(F.col("level") == level), None
            if proofs:
                known = proofs[0]
                for p in proofs[1:]:
                    known = known.unionByName(p)
                if len(proofs) == MOST_TABLES:
                    known = own.stored(known)
                    proofs = [known]
                inherited = _inherited(at, closure, known)
            found = keep(_decided(at, inherited, more))
            done.append(found.select(*RESULT, *more))
            proofs.append(found.where("proof is not null").select("proof.*"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def resolve_copies(candidates: DataFrame, evidence: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """The harness's candidates, without what only proofs need, with fact_id, session_native_id and code as its sessions' ancestry decides.
    Hashes are 32 bytes on the way, and a candidate's other columns go with it, so that nothing is joined afterwards."""
    more = [c for c in candidates.columns if c not in (*RESULT, "turn", "cumulative", "fingerprint")]
    binary = lambda c: F.unhex(c).alias(c)
    rows = candidates.select(F.col("session_native_id").alias("session"), binary("evidence_id"), binary("fact_id"), "turn", binary("fingerprint"), _counters("cumulative").alias("counters"), "code", *more)
    found = decide(rows, sessions(evidence), tuple(more), keep)
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("evidence_id", "fact_id")})
