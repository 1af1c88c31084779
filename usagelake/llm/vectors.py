"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a random product code: the coordinates, after a fixed random rotation, fall into blocks, each with
its own random directions, and a direction of the whole space is one choice from each block. A vector is list-decoded to
all directions whose cap holds it: partial sums over the first blocks go on only while the best of the remaining blocks
can still reach the cap's edge. Vectors meet in a shuffle on their filters and are verified in double precision there.

The number of filters follows the number of vectors, so that the mean of vectors in a filter stays at `load`; the caps
follow from it, and with them how many filters a vector needs for the wanted recall at the threshold itself (pairs above
it share more). A vector in fewer filters than that is decoded again with wider caps. Equal vectors are one row. A filter
with many vectors is compared chunk by chunk. A pair is counted in the smallest filter that both have, and no pair
is a row: a chunk gives counts for its vectors and the edges of a forest.

Defined cases: vectors that are null, empty or zero, or hold nulls or non-finite numbers, have no links and are their own
component; vectors of different lengths have none between them; repeated rows link with each other; an empty table gives
an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import cut

CHUNK = 512


@dataclass(frozen=True)
class Code:
    """blocks x per_block directions; a cap holds what has at least `edge` standard deviations along its direction."""

    blocks: int
    per_block: int
    edge: float
    least: int
    seed: int = 11

    @staticmethod
    def for_(n: int, threshold: float, load: int = 128, misses: float = 0.002) -> Code:
        normal, filters = NormalDist(), 64.0
        for _ in range(20):
            # A vector needs `lists` filters so that one as near as the threshold shares one of them but for `misses`.
            lists = 8.0
            for _ in range(20):
                edge = normal.inv_cdf(1 - min(0.3, lists / filters))
                inside = edge + 1 / (edge + 1)
                meet = 1 - normal.cdf((edge - threshold * inside) / math.sqrt(1 - threshold**2))
                lists = math.log(1 / misses) / -math.log(1 - min(0.95, meet)) * 1.5
            filters = max(64.0, n * lists / load)
        blocks = max(2, math.ceil(math.log2(filters) / 8))
        return Code(blocks, math.ceil(filters ** (1 / blocks)), edge, max(3, int(lists / 2)))

    def directions(self, d: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The rotation, and each block's directions as rows."""
        rng = np.random.default_rng([self.seed, d])
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        out = []
        for columns in np.array_split(np.arange(d), self.blocks):
            x = rng.standard_normal((self.per_block, max(1, len(columns))))[:, : len(columns)]
            out.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) * math.sqrt(len(columns) / d))
        return turn, out


def decode(x: np.ndarray, code: Code, parts: tuple[np.ndarray, list[np.ndarray]]) -> list[np.ndarray]:
    """For each unit vector its filters, sorted."""
    turn, directions = parts
    turned, at, scores = x @ turn, 0, []
    for c in directions:
        scores.append(turned[:, at : at + c.shape[1]] @ c.T)
        at += c.shape[1]
    # What the later blocks can add at most.
    best = np.cumsum([s.max(axis=1) for s in scores][::-1], axis=0)[::-1]
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(x)
    rows, edge = np.arange(len(x)), code.edge / math.sqrt(x.shape[1])
    while len(rows):
        row, total, name = rows, np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        for b, s in enumerate(scores):
            later = best[b + 1][row] if b + 1 < len(scores) else 0.0
            reach = total[:, None] + s[row]
            i, j = np.nonzero(reach + (later[:, None] if b + 1 < len(scores) else 0.0) >= edge)
            row, total, name = row[i], reach[i, j], name[i] * code.per_block + j
        order = np.lexsort((name, row))
        row, name = row[order], name[order]
        ends = np.searchsorted(row, rows, side="right")
        starts = np.searchsorted(row, rows, side="left")
        again = []
        for r, a, z in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
            out[r] = name[a:z]
            if z - a < code.least:
                again.append(r)
        rows, edge = np.array(again, np.int64) if edge > -1 else np.empty(0, np.int64), edge - 0.25 / math.sqrt(x.shape[1])
    return out


def usable(v: str) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(v).isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filtered(vectors: DataFrame, code: Code) -> DataFrame:
    """(filter, rep, size, v, filters) for each vector and each of its filters; v as the table's own floats or doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                lengths = batch.column(2).value_lengths().to_numpy()
                for d in np.unique(lengths).tolist():
                    index = np.flatnonzero(lengths == d)
                    own = batch.column(2).take(pa.array(index)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    if d not in made:
                        made[d] = code.directions(d)
                    lists = decode(_unit(own.astype(np.float64)), code, made[d])
                    n = [len(names) for names in lists]
                    take = pa.array(np.repeat(index, n))
                    kept = [pa.array(np.concatenate(lists) * 4096 + d % 4096), batch.column(0).take(take), batch.column(1).take(take)]
                    data = [pa.array([b[i] for i, k in enumerate(n) for _ in range(k)], pa.binary()) for b in ([v.tobytes() for v in own], [f.tobytes() for f in lists])]
                    yield pa.RecordBatch.from_arrays(kept + data, ["filter", "rep", "size", "v", "filters"])

    return vectors.select("rep", "size", "v").mapInArrow(run, "filter long, rep long, size long, v binary, filters binary")


def _links(groups: DataFrame, threshold: float, number: type) -> DataFrame:
    """groups: (filter, a, b, mine, rep, size, v, filters), chunk a against chunk b. Rows (rep, n): n more links of rep's
    vectors; rows (rep, other): an edge."""

    def compare(f: int, same: bool, rows: list[tuple]) -> tuple[list, list, list]:
        name, rep, size, mine = f // 4096, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[4] for r in rows])
        x = _unit(np.frombuffer(b"".join(r[2] for r in rows), number).reshape(len(rows), -1).astype(np.float64))
        near = x @ x.T >= threshold
        near &= np.tril(np.ones_like(near), -1) if same else (mine[:, None] > mine[None, :])
        i, j = np.nonzero(near)
        if not len(i):
            return [], [], []
        # Pairs that share a smaller filter are counted there.
        own = [np.frombuffer(r[3], np.int64) for r in rows]
        smaller = [o[o < name] for o in own]
        vocabulary, place = np.unique(np.concatenate(smaller), return_inverse=True)
        has = np.zeros((len(rows), len(vocabulary)), np.float32)
        has[np.repeat(np.arange(len(rows)), [len(s) for s in smaller]), place] = 1
        first = (has @ has.T)[i, j] == 0
        counts = np.bincount(i[first], weights=size[j[first]], minlength=len(rows)) + np.bincount(j[first], weights=size[i[first]], minlength=len(rows))
        top, edges = list(range(len(rows))), []

        def find(k: int) -> int:
            while top[k] != k:
                top[k] = k = top[top[k]]
            return k

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(a), find(b)
            if p != q:
                top[p] = q
                edges.append((int(rep[a]), int(rep[b])))
        some = np.flatnonzero(counts)
        return rep[some].tolist() + [a for a, _ in edges], counts[some].astype(np.int64).tolist() + [0] * len(edges), [None] * len(some) + [b for _, b in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for f, a, b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (f, a, b):
                    if len(held) > 1:
                        for o, more in zip(out, compare(key[0], key[1] == key[2], held), strict=True):
                            o.extend(more)
                    key, held = (f, a, b), []
                held.append(tuple(row))
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["rep", "n", "other"])
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in compare(key[0], key[1] == key[2], held)], ["rep", "n", "other"])

    dealt = groups.repartition("filter", "a", "b").sortWithinPartitions("filter", "a", "b")
    return dealt.select("filter", "a", "b", "rep", "size", "v", "filters", "mine").mapInArrow(run, "rep long, n long, other long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, load: int = 128, misses: float = 0.002) -> DataFrame:
    """For each row: id, n_links, component_id (smallest id reachable by links) and kept (id = component_id)."""
    # Single-precision vectors travel as such, half the size; they are compared in double precision all the same.
    single = dict(vectors.select(F.col(vector_col).alias("v")).dtypes)["v"] == "array<float>"
    rows = cut(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v")), "vectors")
    good = rows.where(usable("v"))
    distinct = cut(good.groupBy("v").agg(F.min("row").alias("rep"), F.count("*").alias("size")), "vector-classes")
    code = Code.for_(max(1, distinct.count()), threshold, load, misses)
    filtered = cut(_filtered(distinct, code), "vector-filters")
    counts = cut(filtered.groupBy("filter").agg(F.count("*").alias("n")).where("n > 1"), "vector-counts")
    # Chunk i of c meets chunks i to c - 1, in groups of two chunks.
    chunks = F.ceil(F.col("n") / CHUNK)
    mine = F.pmod(F.xxhash64("rep"), "chunks")
    placed = filtered.join(counts.withColumn("chunks", chunks), "filter").withColumn("mine", mine)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("yours")
    groups = placed.select("filter", "rep", "size", "v", "filters", "mine", every).select("*", F.least("mine", "yours").alias("a"), F.greatest("mine", "yours").alias("b"))
    found = cut(_links(groups, threshold, np.float32 if single else np.float64), "vector-links")
    edges = found.where(F.col("other").isNotNull()).select(F.col("rep").alias("a"), F.col("other").alias("b"))
    links = found.where("n > 0").groupBy("rep").agg(F.sum("n").alias("links"))
    roots = components(edges).select(F.col("node").alias("rep"), "root")
    reps = cut(distinct.join(links, "rep", "left").join(roots, "rep", "left").select("v", "rep", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "vector-reps")
    own = good.select("row", "id", "v").join(reps, "v", "left").select("row", "id", "n_links", "root")
    own = cut(own.unionAll(rows.where(~usable("v")).select("row", "id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("root"))), "vector-rows")
    least = cut(own.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("least")), "vector-least")
    out = own.join(least, "root", "left").select(F.col("id").alias(id_col), "n_links", F.coalesce("least", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
