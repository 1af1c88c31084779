"""Substring dedup by suffix automata of reference shards.

The corpus is its own reference. Its shards are made so that both places of any repeated window of `window` words meet in
one: each window is filed under its smallest k-gram hash (its anchor), and neighbouring windows with one anchor make a
region. Anchors that occur once are dropped; a shard is the distinct regions of one anchor. Its suffix automaton is built
in the task that gets the shard (a broadcast would have to grow with the corpus), and the shard's regions are streamed
through it for matching statistics: the longest suffix at each word that occurs twice or more in the shard. Spans of at
least `window` words are removed. Whole words are compared, never hashes. A region with two equal occurrences needs no
automaton, all its windows are repeated; where a task sees both, it says so at once and sends the region once without its
places, so that a passage of very many documents costs a row for each task.

The repeated anchors are sent to the tasks as a Bloom filter of at most `filter_bits` bits (the driver gets as many, once);
what passes it wrongly is found to be alone in its shard. Where that is less than BITS_AN_ANCHOR for each, the texts are
gone through several times, each time with the filter of one share of the anchors, so that none ever fills. Documents are told apart by id and a hash of the text, and rows that agree in both are
treated alike.

Defined cases: a null or blank text has no words, an empty text and nothing removed; repeated rows lose all windows, as
each repeats the other; places that overlap count as two; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import tidy
from .store import cut
from .wordhash import Words, bounded, mix, windows

_PROBES, BITS_AN_ANCHOR = 4, 8


class SuffixAutomaton:
    """Of several word sequences; a state's count is in how many places (by the weights given) its words end."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, steps: dict[bytes, int]) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.length) - 1

    def _branch(self, state: int, word: bytes, target: int) -> int:
        """The state for state's longest words and then word, where target also has longer ones: a copy of target is split off."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list[bytes], weight: int = 1) -> None:
        at = 0
        for word in words:
            target = self.next[at].get(word)
            if target is not None:
                at = target if self.length[target] == self.length[at] + 1 else self._branch(at, word, target)
            else:
                new, up = self._state(self.length[at] + 1, 0, {}), at
                while up >= 0 and word not in self.next[up]:
                    self.next[up][word] = new
                    up = self.link[up]
                if up >= 0:
                    target = self.next[up][word]
                    self.link[new] = target if self.length[target] == self.length[up] + 1 else self._branch(up, word, target)
                at = new
            self.count[at] += weight

    def close(self) -> SuffixAutomaton:
        """Adds each state's count to those of its suffixes."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.count[self.link[state]] += self.count[state]
        return self

    def matching(self, words: list[bytes], times: int = 2) -> Iterator[int]:
        """For each word the length of the longest suffix there that ends in so many places at least."""
        at, length = 0, 0
        for word in words:
            while at and word not in self.next[at]:
                at = self.link[at]
                length = self.length[at]
            if word in self.next[at]:
                at, length = self.next[at][word], length + 1
            while at and self.count[at] < times:
                at = self.link[at]
                length = self.length[at]
            yield length


def _regions(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, text, first window's first word, number of windows) of every region; words count over the batch."""
    n = len(words.hashes) - window + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none, none, none
    with np.errstate(over="ignore"):
        grams = windows(words.hashes, k)
    span, reach = window - k + 1, 1
    best = np.arange(len(grams))
    while reach < span:  # the leftmost smallest of `reach` grams from each place on, then of up to twice as many
        step = min(reach, span - reach)
        left, right = best[:-step], best[step:]
        best = np.where(grams[left] <= grams[right], left, right)
        reach += step
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    starts = np.flatnonzero(text[:n] == text[window - 1 :])
    if not len(starts):
        return none.view(np.uint64), none, none, none
    anchor, owner = best[starts], text[starts]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    at = np.flatnonzero(new)
    return grams[anchor[at]], owner[at], starts[at], np.diff(np.concatenate([at, [len(starts)]]))


def _probes(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [mix(anchors + np.uint64(i * 0x632BE59BD9B4E019 % (1 << 64))) & np.uint64(bits - 1) for i in range(_PROBES)]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]


def _repeated_anchors(docs: DataFrame, window: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            for part in bounded(texts):
                anchors, n = np.unique(_regions(Words(texts[part]), window, k)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    counted = docs.select("text").mapInArrow(tidy(run, whole=True), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return cut(counted.where("n > 1").select("anchor"), "substring-anchors")


def _share(anchors: np.ndarray, shares: int) -> np.ndarray:
    return (anchors >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)


def _bloom(anchors: DataFrame, count: int, filter_bits: int, share: int, shares: int) -> tuple[int, bytes]:
    """The size in bits and the bits of the filter of one share of the anchors. The driver gets a row for each of its 64-bit words at most."""
    bits = min(filter_bits, 1 << max(10, (2 * BITS_AN_ANCHOR * count // shares).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(_probes(own[_share(own, shares) == share], bits)))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

    table = anchors.mapInArrow(tidy(run, whole=True), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[table["word"].to_numpy()] = table["mask"].to_numpy()
    return bits, out.tobytes()


def _shards(docs: DataFrame, window: int, k: int, bits: int, bloom: bytes, kind: str, share: int, shares: int) -> DataFrame:
    """Of the share's anchors, rows (anchor, content, id, text_hash, start, n): a region of n windows from word start; without content: its windows are
    known to be repeated; without n: a region that this task has found repeated."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.frombuffer(sent.value, np.uint64)
        for batch in batches:
            texts = _texts(batch)
            found: dict[tuple[int, bytes], tuple[int, int, int] | None] = {}
            sure: list[tuple[int, int, int]] = []
            for part in bounded(texts):
                words = Words(texts[part])
                anchors, owner, start, n = _regions(words, window, k)
                hit = _share(anchors, shares) == share
                for p in _probes(anchors, bits):
                    hit &= (has[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
                begin, end = words.begin[start[hit]], words.end[start[hit] + n[hit] + window - 2]
                place = start[hit] - words.first[owner[hit]]
                for a, o, s, c, x, y in zip(anchors[hit].view(np.int64).tolist(), (owner[hit] + part.start).tolist(), place.tolist(), n[hit].tolist(), begin.tolist(), end.tolist(), strict=True):
                    key = a, b" ".join(words.buffer[x:y].split())
                    if key not in found:
                        found[key] = o, s, c
                    else:
                        if found[key]:
                            sure.append(found[key])
                            found[key] = None
                        sure.append((o, s, c))
            rows = [(a, content, *(at or (None, None, None))) for (a, content), at in found.items()] + [(None, None, *at) for at in sure]
            take = pa.array([r[2] for r in rows], pa.int64())
            fixed = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([*fixed, batch.column(0).take(take), batch.column(1).take(take), *(pa.array([r[i] for r in rows], pa.int64()) for i in (3, 4))], ["anchor", "content", "id", "text_hash", "start", "n"])

    return cut(docs.mapInArrow(tidy(run, whole=True), f"anchor long, content binary, id {kind}, text_hash long, start long, n long"), "substring-regions")


def repeated_spans(contents: dict[bytes, int], window: int) -> dict[bytes, list[tuple[int, int]]]:
    """For regions and how often each occurs: the (start, end) spans, in words, of windows that occur twice or more among them."""
    automaton, out = SuffixAutomaton(), {}
    split = {c: c.split(b" ") for c in contents}
    for c, times in contents.items():
        automaton.add(split[c], times)
    automaton.close()
    for c, words in split.items():
        spans: list[tuple[int, int]] = []
        for i, length in enumerate(automaton.matching(words)):
            if length >= window:
                if spans and spans[-1][1] >= i + 1 - length:
                    spans[-1] = min(spans[-1][0], i + 1 - length), i + 1
                else:
                    spans.append((i + 1 - length, i + 1))
        out[c] = spans
    return out


def _matched(regions: DataFrame, window: int, kind: str) -> DataFrame:
    """(id, text_hash, start, end): spans to remove, in words of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(rows: list[tuple]) -> list[tuple]:
            counts: dict[bytes, int] = {}
            for content, *_, n in rows:
                counts[content] = counts.get(content, 0) + (1 if n is not None else 2)
            alone = [c for c, times in counts.items() if times == 1]
            spans = repeated_spans(counts, window) if alone and len(counts) > 1 else {}
            out = []
            for content, id_, text_hash, start, n in rows:
                if n is None:
                    continue
                if counts[content] > 1:
                    out.append((id_, text_hash, start, start + n + window - 1))
                else:
                    out += [(id_, text_hash, start + a, start + b) for a, b in spans.get(content, ())]
            return out

        key, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for anchor, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != key:
                    out += shard(held) if len(held) > 1 else []
                    key, held = anchor, []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
        out = shard(held) if len(held) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    names, types = ["id", "text_hash", "start", "end"], [pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64(), *[pa.int64()] * 3]
    dealt = regions.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.select("anchor", "content", "id", "text_hash", "start", "n").mapInArrow(tidy(run, whole=True), f"id {kind}, text_hash long, start long, end long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, filter_bits: int = 1 << 28) -> DataFrame:
    """For each row: id, n_words, n_removed and text (the kept words, joined by one space)."""
    k = max(1, window // 4)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    anchors = _repeated_anchors(rows, window, k)
    count = anchors.count()
    shares = max(1, -(-BITS_AN_ANCHOR * count // filter_bits))
    found = reduce(DataFrame.unionAll, [_shards(rows, window, k, *_bloom(anchors, count, filter_bits, i, shares), kind, i, shares) for i in range(shares)])
    matched = _matched(found.where(F.col("content").isNotNull()), window, kind)
    sure = found.where(F.col("content").isNull()).select("id", "text_hash", "start", (F.col("start") + F.col("n") + (window - 1)).alias("end"))
    spans = matched.unionAll(sure).groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = cut(spans.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "spans"), "substring-spans")
    joined = rows.join(spans, rows["id"].eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left").select("id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone = [], [], []
            for text, spans in zip(_texts(batch), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                kept, at = [], 0
                for s in sorted(spans or (), key=lambda s: s["start"]):
                    kept += words[at : s["start"]] if s["start"] > at else []
                    at = max(at, s["end"])
                kept = kept + words[at:] if at else words
                texts.append(b" ".join(kept))
                counts.append(len(words))
                gone.append(len(words) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "text"])

    return joined.mapInArrow(tidy(remove, whole=True), f"id {kind}, n_words long, n_removed long, text string").withColumnsRenamed({"id": id_col, "text": text_col})
