"""Mixing sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that each belongs to). A flow carries words from the
patterns through their sources to the sources' quotas; a pattern offers its words up to `copies` times, and every further
copy costs more than the one before, so repetition is spread as evenly as the quotas allow. The flow of a pattern, over
its size, gives whole copies of all its documents and a remainder, which goes to documents in a seeded hash order.

The driver holds one row for each pattern, which max_patterns bounds. Documents need no shuffle: whether one is taken
depends on its hash and its pattern's threshold. The threshold is found from sums over 4096 hash ranges of each pattern,
then exactly inside the one range where it lies. Documents too large for the gap that remains are set aside, and the next ones
close it as their sizes fit, by the same search as long as they are many, until no document that fits is left.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows with equal ids are taken
alike; an empty table gives an empty result; a document without words is taken no times; other columns play no part.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import WORD, whole_row, whole_text
from .store import cut

#: A range of hashes is what has these high bits.
RANGE_SHIFT = 52


def sizes_of(text: Column) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def target_words(sizes: dict[str | None, int], copies: int = 3) -> dict[str | None, Fraction]:
    """Shares of all words by weights 1, 2, 3 and so on, in code point order with null last; none above copies * size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    out: dict[str | None, Fraction] = {}
    rest = Fraction(sum(sizes.values()))
    free = set(order)
    while free:
        unit = rest / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > copies * sizes[s]}
        if not full:
            return {s: out.get(s, unit * weight[s]) for s in order}
        for s in full:
            out[s] = Fraction(copies * sizes[s])
            rest -= out[s]
        free -= full
    return {s: out[s] for s in order}


def whole_quotas(targets: dict[str | None, Fraction]) -> dict[str | None, int]:
    """Whole numbers with the same sum, by largest remainder."""
    out = {s: int(t) for s, t in targets.items()}
    left = round(sum(targets.values())) - sum(out.values())
    for s in sorted(targets, key=lambda s: (out[s] - targets[s], s is None, s or ""))[:left]:
        out[s] += 1
    return out


def min_cost_flow(patterns: list[tuple[tuple[str | None, ...], int]], quotas: dict[str | None, int], copies: int = 3) -> list[dict[str | None, int]]:
    """Words of each pattern that go to each of its sources. Successive cheapest augmenting paths; copy c costs c * c."""
    sources = list(quotas)
    n, at = 2 + len(patterns) + len(sources), {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    heads: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            heads[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
        return len(to) - 2

    ways = []
    for i, (members, size) in enumerate(patterns):
        for c in range(copies):
            arc(0, 2 + i, size, c * c)
        ways.append({s: arc(2 + i, at[s], copies * size, 0) for s in members if s in at})
    for s in sources:
        arc(at[s], 1, quotas[s], 0)
    while True:
        best, via, queue, waits = {0: 0}, {}, deque([0]), {0}
        while queue:
            waits.discard(a := queue.popleft())
            for e in heads[a]:
                if room[e] and (p := best[a] + cost[e]) < best.get(to[e], p + 1):
                    best[to[e]], via[to[e]] = p, e
                    if to[e] not in waits:
                        waits.add(to[e])
                        queue.append(to[e])
        if 1 not in best:
            return [{s: room[e ^ 1] for s, e in way.items()} for way in ways]
        path, a = [], 1
        while a:
            path.append(via[a])
            a = to[via[a] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount


@dataclass(frozen=True)
class Mix:
    """sources: rows (source, size, target). plan: rows (key, base, above, close, spans, skip): documents of the pattern are
    taken base times, and once more if their hash is at most `above` or one of `close`, or lies in one of `spans`, (after,
    upto, most), with a size of at most `most` and not in `skip`."""

    sources: list[tuple[str | None, int, float]]
    plan: list[tuple[str, int, int | None, list[int], list[tuple[int | None, int, int]], list[int]]]


def order_hash(id_col: Column, seed: int) -> Column:
    return F.xxhash64(id_col, F.lit(seed))


def _key(members: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(members)))


def sized(docs: DataFrame, members: Column, id_col: str, text_col: str, seed: int) -> DataFrame:
    """One narrow row for each document, written once: the only pass over the texts."""
    rows = docs.select(F.col(id_col).alias("__id"), members.alias("__members"), _key(members).alias("__key"), sizes_of(F.col(text_col)).alias("__size"), order_hash(F.col(id_col), seed).alias("__hash"))
    return cut(rows, "mix-sizes")


def plan_mix(rows: DataFrame, copies: int = 3, max_patterns: int = 100_000) -> Mix:
    """rows: from sized()."""
    found = rows.groupBy("__key").agg(F.sum("__size").alias("size"), F.first("__members").alias("members")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = sorted((r["__key"], tuple(dict.fromkeys(r["members"])), r["size"]) for r in found)
    sizes: dict[str | None, int] = {}
    for _, members, size in patterns:
        for s in members:
            sizes[s] = sizes.get(s, 0) + size
    # Shares are of the words there are; a document of several sources counts once.
    total, scale = sum(size for *_, size in patterns), Fraction(1)
    targets = target_words(sizes, copies)
    if (counted := sum(sizes.values())) > total > 0:
        scale = Fraction(total, counted)
    targets = {s: t * scale for s, t in targets.items()}
    flow = min_cost_flow([(m, size) for _, m, size in patterns], whole_quotas(targets), copies)
    want = {key: divmod(sum(f.values()), size) if size else (0, 0) for (key, _, size), f in zip(patterns, flow, strict=True)}
    return Mix([(s, sizes[s], float(t)) for s, t in targets.items()], _thresholds(rows, want))


def _fill(gap: int, sizes: list[tuple[int, int]]) -> tuple[list[int], int]:
    """Of (hash, size), hashes of those whose sizes come near gap, the largest that still fit first; and the gap that is left."""
    chosen = []
    for h, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        if size <= gap:
            chosen.append(h)
            gap -= size
    return chosen, gap


def _open(rows: DataFrame, state: dict[str, tuple[int | None, int]], fitting: bool) -> DataFrame:
    """rows of the patterns in state, (hash reached, room), beyond that hash; with fitting only those not larger than the room."""
    at = F.broadcast(rows.sparkSession.createDataFrame([(k, *x) for k, x in state.items()], "__key string, __at long, room long"))
    out = rows.join(at, "__key").where((F.col("__size") > 0) & F.coalesce(F.col("__hash") > F.col("__at"), F.lit(True)))
    return out.where(F.col("__size") <= F.col("room")) if fitting else out


def _prefix(rows: DataFrame) -> dict[str, tuple[int, int]]:
    """rows: from _open(). For each pattern the last hash up to which all sizes together fit in the room, and their sum; none
    where the first doesn't fit."""
    ranged = rows.withColumn("__range", F.shiftright("__hash", RANGE_SHIFT))
    upto = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)  # 4096 rows a pattern at most
    sums = ranged.groupBy("__key", "__range").agg(F.sum("__size").alias("size"), F.max("__hash").alias("last"), F.first("room").alias("room")).withColumn("upto", F.sum("size").over(upto))
    fits = F.col("upto") <= F.col("room")
    found = sums.groupBy("__key").agg(F.max(F.when(fits, F.col("last"))).alias("last"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("before"), F.min(F.when(~fits, F.col("__range"))).alias("edge")).collect()
    out = {r["__key"]: (r["last"], r["before"]) for r in found if r["last"] is not None}
    if edges := [(r["__key"], r["edge"], r["before"]) for r in found if r["edge"] is not None]:
        at = F.broadcast(rows.sparkSession.createDataFrame(edges, "__key string, __range long, before long"))
        inside = Window.partitionBy("__key").orderBy("__hash").rangeBetween(Window.unboundedPreceding, 0)
        near = ranged.join(at, ["__key", "__range"]).withColumn("run", F.col("before") + F.sum("__size").over(inside)).where(F.col("run") <= F.col("room"))
        out |= {r["__key"]: (r["hash"], r["run"]) for r in near.groupBy("__key").agg(F.max("__hash").alias("hash"), F.max("run").alias("run")).collect()}
    return out


def _picked(hash_: Column, size: Column) -> Column:
    """Whether __close, __pick_spans or __pick_skip of the pattern's plan take a document beyond the threshold."""
    within = F.exists("__pick_spans", lambda s: F.coalesce(hash_ > s["after"], F.lit(True)) & (hash_ <= s["upto"]) & (size <= s["most"])) & ~F.array_contains("__pick_skip", hash_)
    return F.coalesce(F.array_contains("__close", hash_), F.lit(False)) | F.coalesce((F.size("__pick_spans") > 0) & within, F.lit(False))


def _thresholds(rows: DataFrame, want: dict[str, tuple[int, int]], closing: int = 64) -> list[tuple[str, int, int | None, list[int], list[tuple[int | None, int, int]], list[int]]]:
    """closing: how many documents of a pattern the driver gets at once to close its gap. Where so many that fit can't fill it,
    the threshold search goes on beyond the last hash, over documents that fit; all this until none that fits is left."""
    rest = {k: (None, r) for k, (_, r) in want.items() if r}
    if not rest:
        return [(k, base, None, [], [], []) for k, (base, _) in want.items()]
    first = _prefix(_open(rows, rest, False))
    above = {k: h for k, (h, _) in first.items()}
    gaps = {k: r - first.get(k, (None, 0))[1] for k, (_, r) in rest.items()}
    close, spans, skip = ({k: [] for k in rest} for _ in range(3))
    state = {k: (above.get(k), gap) for k, gap in gaps.items() if gap}
    # Rows with equal hashes are one document here; `least` is the smallest of them.
    beyond = cut(_open(rows, state, False).groupBy("__key", "__hash").agg(F.sum("__size").alias("__size"), F.min("__size").alias("least")), "mix-rest") if state else None
    number = F.row_number().over(Window.partitionBy("__key").orderBy("__hash"))
    while state:
        following: dict[str, list[tuple[int, int]]] = {k: [] for k in state}
        for r in _open(beyond, state, True).withColumn("number", number).where(F.col("number") <= closing).collect():
            following[r["__key"]].append((r["__hash"], r["__size"]))
        short = {}
        for k, found in following.items():
            at, gap = state.pop(k)
            if len(found) == closing and sum(size for _, size in found) < gap:
                short[k] = (at, gap)
                continue
            chosen, gaps[k] = _fill(gap, found)
            close[k] += chosen
            if len(found) == closing and gaps[k]:
                state[k] = (max(h for h, _ in found), gaps[k])
        if short:
            reached = _prefix(_open(beyond, short, True))
            for k, (upto, run) in reached.items():
                at, gap = short[k]
                spans[k].append((at, upto, gap))
                gaps[k] = gap - run
                if gaps[k]:
                    state[k] = (upto, gaps[k])
            mixed = beyond.where(F.col("least") < F.col("__size"))
            for r in _open(mixed, short, False).where((F.col("least") <= F.col("room")) & (F.col("__size") > F.col("room"))).select("__key", "__hash").collect():
                if r["__hash"] <= reached[r["__key"]][0]:
                    skip[r["__key"]].append(r["__hash"])
    # What isn't taken is larger than the gap that is left; the smallest may still bring the sum nearer.
    if left := {k: (above.get(k), gap) for k, gap in gaps.items() if gap}:
        plan = F.broadcast(_plan_table(rows.sparkSession, [(k, 0, above.get(k), close[k], spans[k], skip[k]) for k in left]))
        over = _open(beyond, left, False).where(F.col("__size") - F.col("room") < F.col("room")).join(plan, F.col("__key") == F.col("__plan")).where(~_picked(F.col("__hash"), F.col("__size")))
        for r in over.groupBy("__key").agg(F.min(F.struct("__size", "__hash")).alias("best")).collect():
            close[r["__key"]].append(r["best"]["__hash"])
    return [(k, base, above.get(k), close.get(k, []), spans.get(k, []), skip.get(k, [])) for k, (base, _) in want.items()]


def _plan_table(spark: SparkSession, plan: list[tuple]) -> DataFrame:
    return spark.createDataFrame(plan, "__plan string, __base int, __above long, __close array<long>, __pick_spans array<struct<after: long, upto: long, most: long>>, __pick_skip array<long>")


def with_copies(df: DataFrame, mix: Mix, key: Column, hash_: Column, size: Column) -> DataFrame:
    """df with __copies: how many times each row is taken."""
    plan = F.broadcast(_plan_table(df.sparkSession, mix.plan))
    more = F.coalesce(hash_ <= F.col("__above"), F.lit(False)) | _picked(hash_, size)
    return df.join(plan, key == F.col("__plan"), "left").withColumn("__copies", F.coalesce(F.col("__base"), F.lit(0)) + more.cast("int")).drop("__plan", "__base", "__above", "__close", "__pick_spans", "__pick_skip")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, copies: int = 3) -> DataFrame:
    """For each document of one source: id, size, source_size, target and taken words."""
    rows = sized(docs, F.array(source_col), id_col, text_col, seed)
    mix = plan_mix(rows, copies)
    sources = F.broadcast(docs.sparkSession.createDataFrame(mix.sources, "__source string, source_size long, target double"))
    taken = with_copies(rows, mix, F.col("__key"), F.col("__hash"), F.col("__size")).withColumn("__own", F.col("__members")[0])
    out = taken.join(sources, F.col("__own").eqNullSafe(F.col("__source")), "left")
    return out.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", (F.col("__copies") * F.col("__size")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", members: Column | None = None, source_col: str = "source", seed: int = 17, copies: int = 3) -> DataFrame:
    """docs with every row as often as the mix takes it, in docs' columns. members: an array of the sources that a row
    belongs to (unset: the one in source_col)."""
    members = F.array(source_col) if members is None else members
    mix = plan_mix(sized(docs, members, id_col, text_col, seed), copies)
    # The row travels as one value, so that none of its columns can clash with those of the plan.
    rows = docs.select(whole_row(docs).alias("__row"), _key(members).alias("__key"), order_hash(F.col(id_col), seed).alias("__hash"), sizes_of(F.col(text_col)).alias("__size"))
    taken = with_copies(rows, mix, F.col("__key"), F.col("__hash"), F.col("__size")).where("__copies > 0 AND __size > 0")
    return taken.select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__copies"))).alias("__n")).select("__row.*")
