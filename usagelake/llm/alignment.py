"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A text is encoded by both, and each token is an interval of bytes. The ends of B's tokens are a static, sorted index; a
bisection finds for each A token the first and the last B token that it overlaps, which are its links. Between two tokens
where no interval of either side spans the gap a group ends. Many texts are aligned at once, one behind the other: no
token goes across two texts.

How often an id pair is linked in the whole corpus comes from a shuffle of the pairs of a block of texts, each pair once
with its number of links, and goes back to the blocks in a second one. What the blocks say of their texts waits in a table
in the shared folder, links as numbers of the block's pairs: texts are encoded once, no shuffle carries a row for a token,
and nothing that grows with the corpus is broadcast or collected. No row is larger than a text's: a block is aligned in parts,
and its counts come back as rows of their own, sorted before its texts, so that a task holds one block's counts at a time.

Defined cases: texts that are null or empty, or whose tokens' bytes of either side aren't the text behind a space, have no
tokens: counts are 0 and the digest is empty; special tokens' strings in a text are text; repeated rows count as often as they
stand there; an empty table gives an empty result; ids may be of any type, nulls too; other columns play no part. A text
longer than BLOCK is a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import _release
from .store import cut, scratch
from .tokens import Encoder, encoder
from .wordhash import bounded

#: Bytes of texts whose pairs are numbered and counted together, and of those that are aligned at once.
BLOCK, AT_ONCE = 4_000_000, 500_000
#: Rows of pairs in an Arrow batch; the first number of a block's texts, behind those of all pairs.
ROWS, _DOCS = 10_000, 1 << 40
#: Pieces that each of a worker's two memos holds: two workers and a JVM that uses its whole heap share an executor.
PIECES = 250_000
_DOC = "id {}, n_a long, n_b long, n_groups long, n_links long, groups string"


class Vocabulary:
    """The bytes of an encoder's ids, in one array."""

    def __init__(self, own: Encoder):
        parts = own.token_bytes()
        self.length = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens in a row."""
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of `count` values."""
    so_far = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(count)
    return so_far[ends] - so_far[ends - count]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, behind the last) of the B tokens that each A token overlaps; both cover the same bytes, from 0 on."""
    starts_a, starts_b = (np.concatenate([[0], e[:-1]]) if len(e) else e for e in (ends_a, ends_b))
    return np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")


class Aligned:
    """Texts (bytes, each with the space before it) with the ids of both sides; what isn't covered by both has no tokens."""

    def __init__(self, texts: list[bytes], a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], bytes_a: Vocabulary, bytes_b: Vocabulary):
        size = np.array([len(t) for t in texts], np.int64)
        covered = size > 1
        for (ids, count), own in ((a, bytes_a), (b, bytes_b)):
            covered &= _sums(own.length[ids], count) == size
        for (ids, count), own in ((a, bytes_a), (b, bytes_b)):
            which = np.flatnonzero(covered)
            same = own.joined(ids[np.repeat(covered, count)]) == np.frombuffer(b"".join(texts[i] for i in which), np.uint8)
            covered[which[_sums(~same, size[which]) > 0]] = False
        self.a, self.b = (ids[np.repeat(covered, count)].astype(np.int64) for ids, count in (a, b))
        self.n_a, self.n_b = (np.where(covered, count, 0) for _, count in (a, b))
        ends_a, ends_b = np.cumsum(bytes_a.length[self.a]), np.cumsum(bytes_b.length[self.b])
        first, behind = overlaps(ends_a, ends_b)
        n = behind - first
        self.n_links = _sums(n, self.n_a)
        link_a = np.repeat(np.arange(len(self.a)), n)
        link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        self.links = self.a[link_a] << 32 | self.b[link_b]
        # The group of each token: how many gaps that neither side spans lie before it.
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self._group_a, self._group_b = np.searchsorted(shared, ends_a, "left"), np.searchsorted(shared, ends_b, "left")
        self.n_groups = np.where(covered, _sums(np.isin(ends_a, shared, assume_unique=True), self.n_a), 0)

    def digests(self, names: list[str]) -> list[str]:
        """SHA-256 of each text's groups, ids by their decimal names: `a,a|b;a|b,b`. A group's tokens stand in a row, those of A first."""
        before_b = np.searchsorted(self._group_b, self._group_a, "left")  # B tokens of earlier groups
        before_a = np.searchsorted(self._group_a, self._group_b, "right")  # A tokens up to the own group
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (self._group_a, self._group_b))
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + before_b] = self.a * 3 + last_a
        order[np.arange(len(self.b)) + before_a] = self.b * 3 + 2 * last_b
        words, out, begin = [names[i] for i in order.tolist()], [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append(hashlib.sha256("".join(words[begin : begin + n])[:-1].encode()).hexdigest() if n else "")
            begin += n
        return out


def _vocabularies(a: Encoder, b: Encoder) -> tuple[Vocabulary, Vocabulary, list[str]]:
    if not hasattr(a, "_aligned"):
        own = Vocabulary(a), Vocabulary(b)
        a._aligned = *own, [f"{i}{end}" for i in range(max(len(v.length) for v in own)) for end in ",|;"]
    return a._aligned


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_a, n_b, n_groups, n_links, groups (SHA-256 of the groups' ids, or empty), n_best (links whose pair
    is linked as often as any of its B id in the corpus), count_sum (how often the pairs of all links are linked there)."""
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    doc = _DOC.format(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (encoder(t, "gaps", plain=True, max_pieces=PIECES) for t in (tokenizer_a, tokenizer_b))
        bytes_a, bytes_b, names = _vocabularies(a, b)
        task, blocks = TaskContext.get().partitionId(), 0

        def aligned(ids: list[pa.Array], texts: list[bytes]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Columns of the texts, how many links each has, the different pairs, how many links each has, and each link's pair."""
            both = Aligned(texts, a.encode(texts), b.encode(texts), bytes_a, bytes_b)
            pairs, link, n = np.unique(both.links, return_inverse=True, return_counts=True)
            columns = [pa.concat_arrays(ids), *(pa.array(x.astype(np.int64)) for x in (both.n_a, both.n_b, both.n_groups, both.n_links)), pa.array(both.digests(names), pa.string())]
            return columns, both.n_links, pairs, n, link.reshape(-1).astype(np.uint32)

        def block(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal blocks
            number, blocks = task << 32 | blocks, blocks + 1
            pairs, place = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
            place = place.reshape(-1)
            n = np.bincount(place, np.concatenate([p[3] for p in parts]), len(pairs)).astype(np.int64)
            order = np.argsort(-n, kind="stable")  # frequent pairs get small numbers
            ranks = np.empty(len(pairs), "<u2" if len(pairs) <= 1 << 16 else "<u4")
            ranks[order] = np.arange(len(pairs))
            none = lambda rows, kinds: [pa.nulls(rows, k) for k in kinds]
            own = [*(c.type for c in parts[0][0]), pa.binary()]
            for i in range(0, len(order), ROWS):
                some = order[i : i + ROWS]
                numbers = pa.array(np.full(len(some), number)), pa.array(np.arange(i, i + len(some)))
                yield pa.RecordBatch.from_arrays([*numbers, pa.array(pairs[some]), pa.array(n[some]), *none(len(some), own)], names=columns_of)
            at = _DOCS
            for columns, n_links, pairs_of, _, link in parts:
                codes = ranks[place[: len(pairs_of)]][link]
                place = place[len(pairs_of) :]
                ends = np.concatenate([[0], np.cumsum(n_links)])
                rows, texts = len(n_links), pa.array([codes[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, number)), pa.array(np.arange(at, at + rows)), *none(rows, [pa.int64()] * 2), *columns, texts], names=columns_of)
                at += rows

        ids, texts, size, parts, held = [], [], 0, [], 0
        for batch in batches:
            raw = [b" " + t if t else b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for part in bounded(raw, min(BLOCK, AT_ONCE)):
                ids.append(batch.column(0).slice(part.start, part.stop - part.start))
                texts += [t or b" " for t in raw[part]]
                size += sum(map(len, raw[part]))
                if size >= min(BLOCK, AT_ONCE):
                    parts.append(aligned(ids, texts))
                    held += size
                    ids, texts, size = [], [], 0
                    if held >= BLOCK:
                        yield from block(parts)
                        parts, held = [], 0
                        _release()
        if texts:
            parts.append(aligned(ids, texts))
        if parts:
            yield from block(parts)
        _release()

    columns_of = ["block", "at", "pair", "n", *(c.split()[0] for c in doc.split(", ")), "codes"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with scratch():
        blocks = cut(rows.mapInArrow(run, f"block long, at long, pair long, n long, {doc}, codes binary"), "aligned", result=True)
        linked = blocks.where("pair is not null").select("block", "at", "pair", "n")
        counts = cut(linked.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts", result=True)
        most = counts.groupBy((F.col("pair").bitwiseAND(0xFFFFFFFF)).alias("b")).agg(F.max("count").alias("most"))
        known = counts.join(most, F.col("pair").bitwiseAND(0xFFFFFFFF) == F.col("b")).select("pair", (2 * F.col("count") + (F.col("count") == F.col("most")).cast("long")).alias("known"))
        back = linked.select("block", "at", "pair").join(known, "pair").select("block", "at", "known")
    texts_of = blocks.where("codes is not null").drop("pair", "n")
    # A block's counts come first, in the order of its pairs' numbers, and its texts after them.
    both = back.unionByName(texts_of, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "at")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts, known = None, [], np.empty(0, np.int64)
        for batch in batches:
            own = batch.column("block").to_numpy()
            edges = [*np.flatnonzero(np.diff(own, prepend=own[:1] - 1)).tolist(), len(own)] if len(own) else []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if own[i] != of:
                    of, counts, known = own[i], [], np.empty(0, np.int64)
                here = batch.slice(i, j - i)
                first = here.column("codes").null_count
                if first:
                    counts.append(here.column("known").slice(0, first).to_numpy(zero_copy_only=False).astype(np.int64))
                if first == here.num_rows:
                    continue
                if counts:
                    known, counts = np.concatenate([known, *counts]), []
                rows = here.slice(first)
                n = rows.column("n_links").to_numpy()
                codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), "<u2" if len(known) <= 1 << 16 else "<u4")
                found = known[codes]
                sums = [pa.array(_sums(found & 1, n)), pa.array(_sums(found >> 1, n))]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links", "groups")), *sums], ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"])

    return both.mapInArrow(scored, f"{doc}, n_best long, count_sum long").withColumnRenamed("id", id_col)
