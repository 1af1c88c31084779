"""N-gram Jaccard join by PartEnum signatures.

A document's set is that of its distinct word shingles; equal sets are one node. Sets that reach the threshold differ in
few elements: at most k, which follows from their sizes. Sizes are put into bands; a set signs for its own band and for
those above that hold sizes it can still match. For a band, the domain is cut by hash into first-level parts, and each
part into three; with n1 = floor(k / 2) + 1 + spare parts, spare + 1 of them differ in one element at most, so leaving
out one third at a time gives a signature that both sets share.

A signature of COLD nodes at most is cold and gives their pairs, at most COLD / 2 for each of its rows. One of more nodes is
hot, as passages that many documents share and large groups of near copies make them, and gives none. A part of a set is
thin if one of its signatures is hot or empty; two sets that match share signatures in spare + 1 parts, so a cold one finds
them unless both have more than `spare` thin parts. Only such sets sign a second time, by single elements: with all elements
in one order, the rarest first, the smaller set of a pair has one of the larger one's first few elements among its own still
fewer ones (the two prefixes below). What many share comes last in that order, so sets that have a passage in common and
little else don't meet at all, however many they are. The order needs no exact counts: any order finds all pairs. An element
that opens more than COLD sets makes a star of its sets (one for all elements that have the same smallest node), and the
connected groups of these stars are candidates.

Candidates are thinned by sketches: a bit for each element or so, whose differences can't exceed the sets'. What is left
forms small groups, and only their sets are fetched and compared, in chunks: within chunks, then between representatives of
what has been found, and last between chunks of different components, so that a large group of near copies costs in
proportion to its size. The hot groups' sketches are compared in the same way. Every comparison is exact on the sets of
64-bit shingle hashes; nodes are 64-bit hashes of sets, checked for collisions against a second hash, with another seed if
there is one.

Defined cases: a text with fewer words than a shingle is one shingle; a null or blank one has none, links with nothing
and is its own component; repeated rows share a component; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import WORD, whole_row
from .graph import components
from .memory import tidy
from .store import cut, scratch
from .wordhash import Words, bounded, mix, windows

#: A chunk of sets that are compared in a task: so many of them, or fewer if they come to more than CHUNK * WEIGHT_BYTES.
CHUNK, WEIGHT_BYTES = 256, 1 << 16
#: Sketches are so much smaller that a chunk holds so many times more of them.
SKETCHES = 16
#: What is signed at once, in bytes of text.
BLOCK_BYTES = 1_000_000
#: A signature of more nodes than this is hot.
COLD = 32
#: Shingles whose signatures one task of the shuffle gets, about.
SHINGLES_A_TASK = 1_000_000
#: Nodes go by these low bits of theirs where only candidates are found; nodes of one short name share candidates.
NAME = np.uint64((1 << 40) - 1)
#: Kinds of rows that signatures give, and what is added to a node's name for the middle of a star.
PAIR, THIN, STAR, MIDDLE = 0, 1, 2, 1 << 41
#: Elements are counted in so many cells, which only decide their order: 4 MB that the tasks are sent.
CELLS = 1 << 20
#: Of an element that more sets have than this, the rows behind the short prefix are dealt out, and the others go to each part.
SALTED = 250_000
#: A table of this many rows of one or two numbers (16 MB in memory) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


class Bands:
    """Bands of set sizes for a threshold; each spans the ratio between a size and what it can match, so that a set
    signs for its own band and the next one at most."""

    def __init__(self, threshold: Fraction):
        self.t, self.low, self.high = threshold, [], []
        self._grow(1000)

    def _grow(self, size: int) -> None:
        while not self.high or self.high[-1] < size:
            low = self.high[-1] + 1 if self.high else 1
            self.low.append(low)
            self.high.append(max(low, int(low / self.t)))
        self.lows = np.array(self.low)
        k = [int(2 * h * (1 - self.t) / (1 + self.t)) for h in self.high]
        self.k = np.array(k)
        self.spare = np.array([1 + x // 12 if x else 0 for x in k])
        self.parts = np.array([x // 2 + 1 + s if x else 1 for x, s in zip(k, self.spare, strict=True)])

    def own(self, sizes: np.ndarray) -> np.ndarray:
        """Each size's band; the next one is known too."""
        self._grow(int(sizes.max(initial=1) / self.t**2) + 2)
        return np.searchsorted(self.lows, sizes, side="right") - 1

    def of(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(which sets, their band), one pair for each band above the own one that any set needs."""
        if not len(sizes):
            return []
        most = np.array([int(s / self.t) for s in sizes.tolist()])
        self._grow(int(most.max()))
        own = np.searchsorted(self.lows, sizes, side="right") - 1
        last = np.searchsorted(self.lows, most, side="right") - 1
        return [(which, own[which] + step) for step in range(int((last - own).max()) + 1) if len(which := np.flatnonzero(own + step <= last))]


def shingle_sets(texts: list[bytes], n: int, seed: int) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes."""
    words = Words(texts, lower=True, seed=seed)
    every = windows(words.hashes, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        out.append(np.unique(every[a : b - n + 1]) if b - a >= n else windows(words.hashes[a:b], b - a, seed=1) if b > a else np.empty(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        return tuple(int(x) for x in (mix(np.array([mix(s ^ np.uint64(c)).sum(dtype=np.uint64) + np.uint64(len(s))])).view(np.int64)[0] for c in (0x1234567, 0xABCDEF0123)))  # type: ignore[return-value]


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which set, signature, its part with the band's lowest bit below, whether nothing of the set is in it) for all sets of a batch at once."""
    sizes = np.array([len(s) for s in sets])
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]]
    with np.errstate(over="ignore"):
        for which, band in bands.of(sizes):
            elements = np.concatenate([sets[i] for i in which])
            owner = np.repeat(np.arange(len(which)), sizes[which])
            parts = bands.parts[band]
            spread = mix(elements + np.uint64(0x5851F42D4C957F2D))
            part = ((spread >> np.uint64(33)).astype(np.int64) * parts[owner]) >> 31
            sub = (spread & np.uint64(0xFFFF)).astype(np.int64) % 3
            base = np.concatenate([[0], np.cumsum(parts)])
            cell = (base[owner] + part) * 3 + sub
            cells = int(base[-1]) * 3
            value = mix(elements ^ np.uint64(0x2545F4914F6CDD1D))
            halves = [np.bincount(cell, weights=h.astype(np.float64), minlength=cells).astype(np.uint64) for h in (value & np.uint64(0xFFFFFFFF), value >> np.uint64(32))]
            total = (halves[0] + (halves[1] << np.uint64(32))).reshape(-1, 3)
            count = np.bincount(cell, minlength=cells).reshape(-1, 3)
            rest, n_rest = total.sum(axis=1, dtype=np.uint64)[:, None] - total, count.sum(axis=1)[:, None] - count
            doc = np.repeat(np.arange(len(which)), parts)
            place = np.arange(int(base[-1])) - base[doc]
            at, omitted = np.nonzero((bands.k[band][doc] > 0)[:, None] & np.ones((1, 3), bool))  # if nothing may differ, equal sets are one node already
            key = band[doc[at]].astype(np.uint64) << np.uint64(40) | place[at].astype(np.uint64) << np.uint64(2) | omitted.astype(np.uint64)
            out[0].append(which[doc[at]])
            out[1].append(mix(rest[at, omitted] + mix(key)))
            out[2].append(place[at].astype(np.uint64) << np.uint64(1) | (band[doc[at]] & 1).astype(np.uint64))
            out[3].append((n_rest[at, omitted] == 0).astype(np.uint64))
    return tuple(np.concatenate(x) for x in out)  # type: ignore[return-value]


def sketch(s: np.ndarray) -> bytes:
    """The set's size (4 bytes) and, of each hash class, whether it holds an odd number of elements: a bit for an element or so,
    64 at least. Bits of two sketches differ in no more places than the sets do."""
    width = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((mix(s ^ np.uint64(0x3C6EF372FE94F82B)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return len(s).to_bytes(4, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches' bits (rows of 64-bit words) as narrower sketches have them."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_link(x: bytes, y: bytes, threshold: Fraction) -> bool:
    """False only if the sets of two sketches can't reach the threshold."""
    a, b = int.from_bytes(x[:4], "little"), int.from_bytes(y[:4], "little")
    bits, other = (int.from_bytes(z[4:], "little") for z in ((x, y) if len(x) >= len(y) else (y, x)))
    wide, narrow = 8 * max(len(x) - 4, len(y) - 4), 8 * min(len(x) - 4, len(y) - 4)
    while wide > narrow:
        wide //= 2
        bits = (bits >> wide) ^ (bits & ((1 << wide) - 1))
    apart = max((bits ^ other).bit_count(), abs(a - b))
    return apart * (threshold.denominator + threshold.numerator) <= (a + b) * (threshold.denominator - threshold.numerator)


def linked_sketches(sketches: list[bytes], threshold: Fraction) -> list[tuple[int, int]]:
    """Pairs of sketches whose sets may reach the threshold, as many as it takes to hold each connected group together."""
    sizes = np.array([int.from_bytes(x[:4], "little") for x in sketches])
    by_words: dict[int, list[int]] = {}
    for i, x in enumerate(sketches):
        by_words.setdefault((len(x) - 4) // 8, []).append(i)
    bits = {w: np.frombuffer(b"".join(sketches[i][4:] for i in rows), "<u8").reshape(len(rows), w) for w, rows in by_words.items()}
    out, label = [], np.arange(len(sketches))
    least, most = threshold.denominator - threshold.numerator, threshold.denominator + threshold.numerator
    for w, rows in by_words.items():
        for narrow in (x for x in by_words if x <= w):
            mine, theirs, other = _folded(bits[w], narrow), bits[narrow], np.array(by_words[narrow])
            for place, i in enumerate(rows):
                end = place if narrow == w else len(other)
                apart = np.maximum(np.bitwise_count(theirs[:end] ^ mine[place]).sum(axis=1, dtype=np.int64), np.abs(sizes[other[:end]] - sizes[i]))
                near = other[:end][apart * most <= (sizes[other[:end]] + sizes[i]) * least]
                for group in np.unique(label[near]).tolist():
                    if group != label[i]:
                        out.append((i, int(near[label[near] == group][0])))
                        label[label == group] = label[i]
    return out


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [t or b"" for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def _nodes(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """A narrow row for each document: id, hash of the text, node and check hash of its set, number of shingles, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            for part in bounded(texts, BLOCK_BYTES):
                sets = shingle_sets(texts[part], n, seed)
                keys = np.array([node_of(s) for s in sets], np.int64).reshape(-1, 2)
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())], ["id", "text_hash", "node", "check", "n", "sketch"])

    kind = dict(docs.dtypes)["id"]
    return cut(docs.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(tidy(run), f"id {kind}, text_hash long, node long, check long, n long, sketch binary"), "jaccard-nodes")


def _planes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of each number, all lowest ones first: those that hardly vary then compress well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:n].tobytes()


def _unplaned(data: bytes, n: int, rows: int) -> np.ndarray:
    out = np.zeros((rows, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(n, rows).T
    return out.view("<u8").ravel()


def _pairs(node: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Distinct pairs of nodes of one cold signature, given the sizes of consecutive groups, each COLD at most."""
    out, starts = [np.empty((2, 0), np.uint64)], np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for g in np.unique(sizes[sizes > 1]).tolist():
        members = node[starts[sizes == g][:, None] + np.arange(g)]
        i, j = np.triu_indices(g, 1)
        out.append(np.unique(np.stack([members[:, i].ravel(), members[:, j].ravel()]), axis=1))
    return np.unique(np.concatenate(out, axis=1), axis=1)


def _shards(docs: DataFrame, shingles: int) -> tuple[int, int]:
    """(tasks, shards) for signatures of sets of so many shingles together."""
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // SHINGLES_A_TASK))
    return partitions, 4 * partitions


def _packed(sig: np.ndarray, name: np.ndarray, place: np.ndarray, shards: int) -> pa.RecordBatch:
    """Signature rows, a binary value for each shard."""
    shard = ((sig >> np.uint64(44)) * np.uint64(shards)) >> np.uint64(20)
    sig = sig & NAME
    order = np.lexsort((sig, shard))
    shard, sig, name, place = shard[order], sig[order], name[order], place[order]
    starts = np.flatnonzero(np.diff(shard, prepend=np.uint64(shards)))
    spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(shard)], strict=True))
    data = [_planes(sig[a:b], 5) + _planes(name[a:b], 5) + _planes(place[a:b], 4) for a, b in spans]
    return pa.RecordBatch.from_arrays([pa.array(shard[starts].astype(np.int32)), pa.array(data, pa.binary())], ["shard", "data"])


def _unpacked(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, name, place) of a shard's blocks."""
    columns: list[list[np.ndarray]] = [[], [], []]
    for block in blocks:
        rows, at = len(block) // 14, 0
        for column, width in zip(columns, (5, 5, 4), strict=True):
            column.append(_unplaned(block[at : at + width * rows], width, rows))
            at += width * rows
    return tuple(np.concatenate(c) for c in columns)  # type: ignore[return-value]


def _by_shard(dealt: DataFrame, partitions: int, shared: Callable[[list[bytes]], pa.RecordBatch], label: str) -> DataFrame:
    """shared() of each shard's blocks: rows (kind, a, b)."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, blocks = None, []
        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != shard and blocks:
                    yield shared(blocks)
                    blocks = []
                shard = s
                blocks.append(data)
        if blocks:
            yield shared(blocks)

    return cut(dealt.repartition(partitions, "shard").sortWithinPartitions("shard").mapInArrow(tidy(met), "kind int, a long, b long"), label)


def _rows_of(*kinds: tuple[int, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    kind = np.repeat(np.array([k for k, _, _ in kinds], np.int32), [len(a) for _, a, _ in kinds])
    a, b = (np.concatenate([x[i] for x in kinds]).astype(np.int64) for i in (1, 2))
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], ["kind", "a", "b"])


def _signed(docs: DataFrame, n: int, threshold: Fraction, seed: int, shingles: int) -> DataFrame:
    """Rows (kind, a, b). PAIR: short names of two nodes that share a cold signature. THIN: node a has a hot or empty signature at its
    part b (the lowest bit is that of the band). shingles: the sum of the sets' sizes."""
    (partitions, shards), most = _shards(docs, shingles), COLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(threshold)
        for batch in batches:
            texts = list(set(_texts(batch)))
            for part in bounded(texts, BLOCK_BYTES):
                sets = [s for s in shingle_sets(texts[part], n, seed) if len(s)]
                which, sig, place, empty = signatures(sets, bands)
                if len(sig):
                    name = np.array([node_of(s)[0] for s in sets], np.int64)[which].view(np.uint64) & NAME
                    yield _packed(sig, name, place << np.uint64(1) | empty, shards)

    def shared(blocks: list[bytes]) -> pa.RecordBatch:
        sig, name, place = _unpacked(blocks)
        order = np.argsort(sig)
        sig = sig[order]
        new = np.diff(sig, prepend=sig[:1] + np.uint64(1)) != 0
        several = ~new
        several[:-1] |= ~new[1:]
        several |= (place[order] & np.uint64(1)) > 0
        order, sig = order[several], sig[several]
        name, place = name[order], place[order]
        order = np.lexsort((name, sig))
        sig, name, place = sig[order], name[order], place[order]
        once = (np.diff(sig, prepend=sig[:1] + np.uint64(1)) != 0) | (np.diff(name, prepend=name[:1] + np.uint64(1)) != 0)
        sig, name, place = sig[once], name[once], place[once]  # equal sets of several blocks
        starts = np.flatnonzero(np.diff(sig, prepend=sig[:1] + np.uint64(1)))
        sizes = np.diff(np.append(starts, len(sig)))
        hot = np.repeat(sizes > most, sizes) | ((place & np.uint64(1)) > 0)
        left = np.flatnonzero(np.diff(sig[~hot], prepend=sig[~hot][:1] + np.uint64(1)))
        cold = _pairs(name[~hot], np.diff(np.append(left, int((~hot).sum()))))
        return _rows_of((PAIR, cold[0], cold[1]), (THIN, name[hot], place[hot] >> np.uint64(1)))

    return _by_shard(docs.select("text").mapInArrow(tidy(run), "shard int, data binary"), partitions, shared, "jaccard-signatures")


def _rarity(docs: DataFrame, n: int, seed: int) -> bytes:
    """How many sets have an element, counted in CELLS cells by hash: little-endian unsigned 32-bit numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(CELLS, np.int64)
        for batch in batches:
            texts = list(set(_texts(batch)))
            for part in bounded(texts, BLOCK_BYTES):
                found += np.bincount(np.concatenate([np.empty(0, np.int64), *map(_cells, shingle_sets(texts[part], n, seed))]), minlength=CELLS)
        yield _counts(found)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(CELLS, np.int64)
        for batch in batches:
            for data in batch.column(1).to_pylist():
                found += np.frombuffer(zlib.decompress(data), "<u4")
        yield _counts(found)

    schema = "part int, counts binary"
    parts = docs.select("text").mapInArrow(tidy(count), schema)
    for tasks in (16, 1):
        parts = parts.repartition(tasks, "part").mapInArrow(tidy(add), schema)
    return zlib.decompress(parts.first()["counts"])


def _cells(elements: np.ndarray) -> np.ndarray:
    return (mix(elements ^ np.uint64(0x243F6A8885A308D3)) & np.uint64(CELLS - 1)).astype(np.int64)


def _counts(found: np.ndarray) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(found.clip(0, 2**32 - 1).astype("<u4").tobytes(), 1)], pa.binary())], ["part", "counts"])


def prefixes(sets: list[np.ndarray], counts: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which set, element, whether it stands behind the short prefix) for the long prefix of each set, by rising counts. Of two sets that
    reach the threshold, the long prefix of the larger one and the short one of the other share an element: both hold the
    first of the common ones, behind which all the others must still have room."""
    sizes = np.array([len(s) for s in sets])
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((elements, counts[_cells(elements)], owner))
    place = np.arange(len(elements)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    up, down = threshold.numerator, threshold.denominator
    long, short = (sizes + n // d + 1 for n, d in ((-up * sizes, down), (-2 * up * sizes, up + down)))
    keep = place < np.repeat(long, sizes)
    return owner[keep], elements[order][keep], (place >= np.repeat(short, sizes))[keep]


def _prefixed(docs: DataFrame, n: int, threshold: Fraction, seed: int, shingles: int, counts: bytes) -> DataFrame:
    """Rows (kind, a, b). PAIR: short names of two nodes of which one has an element in its short prefix and the other in its long one.
    STAR: node b has in its prefix an element that is in too many short ones; a is the smallest node of those that have it."""
    (partitions, shards), most, salted = _shards(docs, shingles), COLD, SALTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(counts, "<u4")
        for batch in batches:
            texts = list(set(_texts(batch)))
            for part in bounded(texts, BLOCK_BYTES):
                sets = [s for s in shingle_sets(texts[part], n, seed) if len(s)]
                if sets:
                    which, element, far = prefixes(sets, frequent, threshold)
                    name = np.array([node_of(s)[0] for s in sets], np.int64)[which].view(np.uint64) & NAME
                    salts = 1 + frequent[_cells(element)].astype(np.int64) // salted
                    times = np.where(far, 1, salts)
                    at = np.repeat(np.arange(len(element)), times)
                    salt = np.where(far[at], name[at] % salts[at].astype(np.uint64), np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
                    yield _packed(mix(element[at] + mix(salt + np.uint64(0x9E3779B97F4A7C15))), name[at], far[at].astype(np.uint64), shards)

    def shared(blocks: list[bytes]) -> pa.RecordBatch:
        sig, name, far = _unpacked(blocks)
        order = np.lexsort((far, name, sig))
        sig, name, far = sig[order], name[order], far[order]
        once = (np.diff(sig, prepend=sig[:1] + np.uint64(1)) != 0) | (np.diff(name, prepend=name[:1] + np.uint64(1)) != 0)
        sig, name, far = sig[once], name[once], far[once]
        group = np.cumsum(np.diff(sig, prepend=sig[:1]) != 0) if len(sig) else sig.astype(np.int64)
        size, near = np.bincount(group), np.bincount(group, weights=far == 0)
        live = (size[group] > 1) & (near[group] > 0) if len(sig) else np.empty(0, bool)
        name, far, group = name[live], far[live], group[live]
        star = near[group] > most
        first = np.diff(group, prepend=-1) != 0
        least = name[np.maximum.accumulate(np.where(first, np.arange(len(name)), 0))]
        pairs, rest = [np.empty((2, 0), np.uint64)], np.flatnonzero(~star)
        starts = rest[np.diff(group[rest], prepend=-1) != 0]
        for a, g in zip(starts.tolist(), group[starts].tolist(), strict=True):
            own, short = name[a : a + size[g]], far[a : a + size[g]] == 0
            x, y = np.broadcast_arrays(own[short][:, None], own[None, :])
            pairs.append(np.stack([np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]]))
        near_pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
        stars = np.unique(np.stack([least[star], name[star]]), axis=1)
        return _rows_of((PAIR, near_pairs[0], near_pairs[1]), (STAR, stars[0], stars[1]))

    return _by_shard(docs.select("text").mapInArrow(tidy(run), "shard int, data binary"), partitions, shared, "jaccard-prefixes")


def _near_sketches(signed: DataFrame, nodes: DataFrame, threshold: Fraction) -> DataFrame:
    """Edges (a, b) between nodes that share a cold signature and whose sketches may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(x, y, threshold) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    pairs = signed.where(F.col("kind") == PAIR).select("a", "b").distinct()
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("name").alias(x), F.col("node").alias(f"node_{x}"), F.col("sketch").alias(f"sketch_{x}")), x)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "sketch_a", "sketch_b").mapInArrow(tidy(run), "a long, b long")


def _thin(signed: DataFrame, nodes: DataFrame, threshold: Fraction) -> DataFrame:
    """(name): nodes with more thin parts than spare ones, which cold signatures may miss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(threshold)
        for batch in batches:
            odd, thin, size, least = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
            own = bands.own(size)
            keep = (thin > bands.spare[own + ((own & 1) != odd)]) | (size != least)
            yield batch.select([0]).filter(pa.array(keep))

    thin = signed.where(F.col("kind") == THIN).groupBy(F.col("a").alias("name"), (F.col("b") % 2).alias("odd")).agg(F.count_distinct("b").alias("thin"))
    sized = thin.join(nodes.groupBy("name").agg(F.max("n").alias("n"), F.min("n").alias("least")), "name").select("name", "odd", "thin", "n", "least")
    return cut(sized.mapInArrow(tidy(run), "name long").distinct(), "jaccard-thin")


def _hot_edges(docs: DataFrame, signed: DataFrame, nodes: DataFrame, n: int, threshold: Fraction, seed: int) -> DataFrame:
    """Edges (a, b) between nodes that cold signatures may miss, by the elements that open their sets."""
    thin = _thin(signed, nodes, threshold)
    if thin.isEmpty():
        return thin.select(F.col("name").alias("a"), F.col("name").alias("b"))
    members = cut(nodes.join(thin, "name", "left_semi").select("node", "name", "text_hash", "n", F.length("sketch").alias("size")), "jaccard-members")
    texts = _having(docs, members.select("text_hash"))
    prefixed = _prefixed(texts, n, threshold, seed, members.agg(F.sum("n")).first()[0], _rarity(texts, n, seed))
    edges = _near_sketches(prefixed, nodes, threshold)
    stars = prefixed.where(F.col("kind") == STAR)
    if stars.isEmpty():
        return edges
    # A star's middle stands for its elements, not for the node it is named after.
    met = components(stars.select((F.col("a") + MIDDLE).alias("a"), "b").distinct())
    grouped = members.join(met.withColumnRenamed("node", "name"), "name").select("node", "root", _weight(F.col("size")).alias("weight"))
    return edges.unionAll(_verified(grouped, nodes.select("node", F.col("sketch").alias("elements")), threshold, linked_sketches, SKETCHES * CHUNK))


def _having(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text) of the documents whose text's hash is wanted (text_hash)."""
    keyed = docs.select("text", F.xxhash64("text").alias("text_hash"))
    small = wanted.count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(wanted) if small else wanted, "text_hash", "left_semi").select("text")


def _sets(docs: DataFrame, wanted: DataFrame, n: int, seed: int) -> DataFrame:
    """(node, elements) of the wanted (text_hash) documents; rows of one node may repeat across tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = _texts(batch)
            for part in bounded(texts, BLOCK_BYTES):
                found = {node_of(s)[0]: s for s in shingle_sets(texts[part], n, seed)}
                fresh = [k for k in found if k not in seen]
                seen.update(fresh)
                yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.int64()), pa.array([found[k].tobytes() for k in fresh], pa.binary())], ["node", "elements"])

    return _having(docs, wanted).mapInArrow(tidy(run), "node long, elements binary")


def linked(elements: list[bytes], threshold: Fraction) -> list[tuple[int, int]]:
    """Pairs of sets that reach the threshold."""
    sets = [np.frombuffer(s, np.uint64) for s in elements]
    n, sizes = len(sets), np.array([len(s) for s in sets])
    shared = np.zeros((n, n), np.int64)
    if n <= 6:
        for i in range(n):
            for j in range(i):
                if min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]):
                    shared[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        owner = np.repeat(np.arange(n), sizes)
        _, element, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.argsort(element, kind="stable")
        owner, df = owner[order], df[element[order]]
        for d in np.unique(df).tolist():
            if d == 1:
                continue
            group = owner[df == d].reshape(-1, d)
            if d <= 12:
                for i in range(d):
                    for j in range(i):
                        np.add.at(shared, (group[:, i], group[:, j]), 1)
                        np.add.at(shared, (group[:, j], group[:, i]), 1)
            else:
                for part in (group[i : i + 4096] for i in range(0, len(group), 4096)):
                    has = np.zeros((n, len(part)), np.float32)
                    has[part.ravel(), np.repeat(np.arange(len(part)), d)] = 1
                    shared += (has @ has.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - shared
    ok = threshold.denominator * shared >= threshold.numerator * union
    return [(i, j) for i, j in np.argwhere(np.tril(ok, -1)).tolist()]


def _compare(groups: DataFrame, threshold: Fraction, pairs_of: Callable[[list, Fraction], list[tuple[int, int]]]) -> DataFrame:
    """Edges (a, b) of a forest over each group's links. groups: (group, node, elements); a node may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(nodes: list[int], sets: list[bytes]) -> list[tuple[int, int]]:
            own = dict(zip(nodes, sets, strict=True))
            names, out = list(own), []
            top = list(range(len(names)))

            def find(i: int) -> int:
                while top[i] != i:
                    top[i] = i = top[top[i]]
                return i

            for i, j in pairs_of(list(own.values()), threshold):
                a, b = find(i), find(j)
                if a != b:
                    top[a] = b
                    out.append((names[i], names[j]))
            return out

        held: tuple[int, list[int], list[bytes]] | None = None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for group, node, elements in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0] == group:
                    held[1].append(node)
                    held[2].append(elements)
                else:
                    found += edges(*held[1:]) if held else []
                    held = group, [node], [elements]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        found = edges(*held[1:]) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return groups.repartition("group").sortWithinPartitions("group").select("group", "node", "elements").mapInArrow(tidy(run), "a long, b long")


def _weight(size: Column) -> Column:
    """How many ordinary sets one of so many bytes counts for."""
    return F.greatest(F.lit(1), F.ceil(size / WEIGHT_BYTES)).cast("long")


def _chunk(size: str, most: int) -> Column:
    """A hash chunk of about `most` nodes for a node of a group of the given size (the sum of weights)."""
    return F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col(size) / most))


def _verified(candidates: DataFrame, sets: DataFrame, threshold: Fraction, pairs_of: Callable[[list, Fraction], list[tuple[int, int]]], most: int) -> DataFrame:
    """All links, as edges whose components are those of the exact links. candidates: (node, root, weight). most: weight of a chunk."""
    sizes = candidates.groupBy("root").agg(F.sum("weight").alias("size"))
    members = cut(candidates.join(sizes, "root"), "jaccard-groups")
    edges = cut(_compare(members.join(sets, "node").select(F.xxhash64("root", _chunk("size", most)).alias("group"), "node", "elements"), threshold, pairs_of), "jaccard-edges")
    large = members.where(F.col("size") > most).select("node", F.col("root").alias("top"), "weight")
    if large.isEmpty():
        return edges
    while True:  # representatives of the components so far, group by group, until those of a group fit in a chunk or link no more
        found = components(edges)
        labels = cut(large.join(found, "node", "left").select("node", "top", "weight", F.coalesce("root", "node").alias("label")), "jaccard-labels")
        reps = labels.where(F.col("node") == F.col("label")).select("node", "top", "weight")
        counts = reps.groupBy("top").agg(F.sum("weight").alias("reps"), F.count("*").alias("n"))
        open_ = cut(reps.join(counts.where(F.col("n") > 1), "top"), "jaccard-reps")
        if open_.isEmpty():
            return edges
        more = cut(_compare(open_.join(sets, "node").select(F.xxhash64("top", _chunk("reps", most), F.lit("reps")).alias("group"), "node", "elements"), threshold, pairs_of), "jaccard-edges")
        if more.isEmpty():
            break
        edges = cut(edges.unionAll(more), "jaccard-edges")
        if open_.where(F.col("reps") > most).isEmpty():
            found = components(edges)
            labels = cut(large.join(found, "node", "left").select("node", "top", "weight", F.coalesce("root", "node").alias("label")), "jaccard-labels")
            break
    return edges.unionAll(_across(labels, sets, threshold, pairs_of, most))


def _across(labels: DataFrame, sets: DataFrame, threshold: Fraction, pairs_of: Callable[[list, Fraction], list[tuple[int, int]]], most: int) -> DataFrame:
    """What may still link different components of one candidate group: chunks of one component aren't compared with each other."""
    sized = labels.groupBy("top", "label").agg(F.sum("weight").alias("of_label"))
    rest = sized.groupBy("top").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("of_label") <= most, F.col("of_label")).otherwise(0)).alias("rest"))
    placed = cut(sized.join(rest.where(F.col("labels") > 1), "top"), "jaccard-placed")
    # Small components share chunks (mark -1), a large one has its own (mark: its label).
    small = F.col("of_label") <= most
    own = labels.join(placed, ["top", "label"])
    chunk = F.when(small, F.pmod(F.xxhash64("label", F.lit(3)), F.ceil(F.col("rest") / most))).otherwise(F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("of_label") / most)))
    own = cut(own.select("node", "top", small.alias("mixed"), F.when(small, F.lit(0)).otherwise(F.col("label")).alias("mark"), chunk.alias("chunk")), "jaccard-chunks")
    chunks = cut(own.select("top", "mixed", "mark", "chunk").distinct(), "jaccard-chunk-list")
    a, b = (chunks.select("top", *(F.col(c).alias(f"{c}_{x}") for c in ("mixed", "mark", "chunk"))) for x in "ab")
    key = lambda x: F.struct(*(F.col(f"{c}_{x}").alias(c) for c in ("mixed", "mark", "chunk")))
    useful = F.col("mixed_a") | F.col("mixed_b") | (F.col("mark_a") != F.col("mark_b"))
    pairs = a.join(b, "top").where((key("a") <= key("b")) & useful).withColumn("group", F.xxhash64("top", key("a"), key("b")))
    sent = pairs.select("top", "group", F.explode(F.array(key("a"), key("b"))).alias("k")).select("top", "group", "k.*").distinct()
    return _compare(own.join(sent, ["top", "mixed", "mark", "chunk"]).join(sets, "node").select("group", "node", "elements"), threshold, pairs_of)


def _rooted(rows: DataFrame, n: int, threshold: Fraction | float, seeds: int) -> DataFrame:
    """(id, text_hash, n, root) for each of rows (id, text)."""
    threshold = Fraction(threshold).limit_denominator(1000)
    with scratch():
        for seed in range(seeds):
            nodes = _nodes(rows, n, seed)
            if nodes.groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").isEmpty():
                break
        else:
            raise ValueError("sets collide in their 64-bit hashes with every seed")
        distinct = cut(nodes.where("n > 0").groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumn("name", F.col("node").bitwiseAND(int(NAME))), "jaccard-distinct")
        signed = _signed(rows, n, threshold, seed, distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        candidates = components(_near_sketches(signed, distinct, threshold).unionAll(_hot_edges(rows, signed, distinct, n, threshold, seed)))
        candidates = cut(candidates.join(distinct, "node").select("node", "root", "text_hash", _weight(8 * F.col("n")).alias("weight")), "jaccard-candidates")
        sets = cut(_sets(rows, candidates.select("text_hash"), n, seed), "jaccard-sets")
        roots = components(_verified(candidates, sets, threshold, linked, CHUNK))
        return cut(nodes.join(roots, "node", "left").select("id", "text_hash", "n", F.coalesce("root", "node").alias("root")), "jaccard-roots", result=True)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: Fraction | float = Fraction(4, 5), seeds: int = 3) -> DataFrame:
    """For each row: id, n_shingles and component_id (the smallest id reachable by links; without shingles its own)."""
    joined = _rooted(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), n, threshold, seeds)
    least = cut(joined.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id")), "jaccard-least")
    out = joined.join(least, "root", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: Fraction | float = Fraction(4, 5), seeds: int = 3) -> DataFrame:
    """docs with one row of each component, that of the smallest id (of equal ids, the smallest hash of the text), in docs'
    columns. Rows without shingles stay."""
    joined = _rooted(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), n, threshold, seeds)
    first = joined.where("n > 0").groupBy("root").agg(F.min(F.struct("id", "text_hash")).alias("k")).select("k.id", "k.text_hash")
    kept = cut(first.select(F.col("id").alias("__kept"), F.col("text_hash").alias("__kept_hash")), "jaccard-kept")
    # The row travels as one value, so that none of its columns can clash with these.
    rows = docs.select(whole_row(docs).alias("__row"), F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.coalesce(F.col(text_col), F.lit("")).rlike(WORD).alias("__words"))
    same = F.col("__id").eqNullSafe(F.col("__kept")) & (F.col("__hash") == F.col("__kept_hash"))
    out = rows.join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, same, "left_semi")
    again = joined.join(kept, joined["id"].eqNullSafe(F.col("__kept")) & (F.col("text_hash") == F.col("__kept_hash")), "left_semi").groupBy("id", "text_hash").count().where("count > 1")
    if not again.isEmpty():  # only rows that agree in id and text are left to tell apart
        out = out.dropDuplicates(["__id", "__hash"])
    if not joined.where("n = 0").isEmpty():
        out = out.unionAll(rows.where("NOT __words"))
    return out.select("__row.*")
