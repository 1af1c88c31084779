"""Token ids in files of patched frame-of-reference blocks.

Documents are dealt by ranges of their id (ties by a hash of the text, so that one id with many rows is dealt out too)
and sorted; every task writes its ids to files of about shard_ids ids and reports them. A file:

    magic "PFR1", then the counts of documents, ids and blocks, the start in the task's range, and the exceptions' count
    document ids (8 bytes each), null flags (1), numbers of ids (8)
    of each block: minimum (4), width (1), number of exceptions (2), start of its bits in the body (8)
    exceptions: place in the block (2), value above the minimum (4)
    body: the ids above their block's minimum, in width bits each

A block is BLOCK ids. Its width is that which the given percentile of them fits in; what doesn't fit is an exception,
whose low bits stand in the body all the same. Files have names of their own for each attempt; only those of attempts
that Spark committed are in the manifest, which is written to the shared folder before anything reads it.

Defined cases: a null text is empty and has the end id only; ids that aren't whole numbers are refused, null ids come
first; repeated rows are written one by one; an empty table gives no file; other columns play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import tidy
from .store import cut, new_folder
from .tokens import binaries, encoded, encoder

MAGIC, BLOCK, PERCENTILE, _AT_ONCE = b"PFR1", 128, 0.9, 4096


def _bits(x: np.ndarray) -> np.ndarray:
    """How many bits each number needs, 0 for 0."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def _parts(which: np.ndarray) -> list[np.ndarray]:
    return [which[i : i + _AT_ONCE] for i in range(0, len(which), _AT_ONCE)]


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(minimum, width, number of exceptions, start of bits) of each block, exceptions' places and values, and the body."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1] if len(ids) else 0
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.empty(0, np.uint32)
    above = rows - low[:, None]
    width = _bits(np.partition(above, int(PERCENTILE * BLOCK) - 1, axis=1)[:, int(PERCENTILE * BLOCK) - 1]) if blocks else np.empty(0, np.uint8)
    patched = (above.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    _, place = np.nonzero(patched)
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    body = np.zeros(int(starts[-1]) // 8, "<u8")
    for w in (np.unique(width[width > 0])).tolist():
        # Of each block, the words that its bits fill: sums of shifted numbers, and what a number has beyond its word's end.
        bit = np.arange(BLOCK) * w
        shift, word = (bit & 63).astype(np.uint64), bit >> 6
        firsts, over = np.searchsorted(word, np.arange(2 * w)), np.flatnonzero((bit & 63) + w > 64)
        for part in _parts(np.flatnonzero(width == w)):
            kept = above[part].astype(np.uint64) & np.uint64((1 << w) - 1)
            words = np.add.reduceat(kept << shift, firsts, axis=1)
            words[:, word[over] + 1] += kept[:, over] >> (np.uint64(64) - shift[over])
            body[(starts[part][:, None] // 8 + np.arange(2 * w)).ravel()] = words.ravel()
    return low, width, patched.sum(axis=1).astype("<u2"), starts[:-1], place.astype("<u2"), above[patched], body.tobytes()


def unpack_blocks(low: np.ndarray, width: np.ndarray, n_patched: np.ndarray, starts: np.ndarray, place: np.ndarray, value: np.ndarray, body: np.ndarray, n: int) -> np.ndarray:
    rows = np.zeros((len(low), BLOCK), np.uint32)
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    at = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # eight bytes from any byte on
    for w in (np.unique(width[width > 0])).tolist():
        bit = np.arange(BLOCK) * w
        for part in _parts(np.flatnonzero(width == w)):
            rows[part] = at[starts[part][:, None] + (bit >> 3)] >> (bit & 7).astype(np.uint64) & np.uint64((1 << w) - 1)
    rows[np.repeat(np.arange(len(low)), n_patched), place] = value
    return (rows + low[:, None]).ravel()[:n]


def to_bytes(keys: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray, start: int) -> bytes:
    low, width, n_patched, starts, place, value, body = pack_blocks(ids)
    head = np.array([len(keys), len(ids), len(low), start, len(place)], "<i8")
    known = keys.astype("<i8"), null.astype("u1"), counts.astype("<i8")
    blocks = low.astype("<u4"), width, n_patched, starts.astype("<i8"), place, value.astype("<u4")
    return b"".join([MAGIC, *(x.tobytes() for x in (head, *known, *blocks)), body])


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(document ids, which of them are null, their numbers of ids, all ids, start in the task's range)."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    at = 4

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    docs, n, blocks, start, patched = take("<i8", 5).tolist()
    keys, null, counts = take("<i8", docs), take("u1", docs), take("<i8", docs)
    low, width, n_patched, starts, place, value = take("<u4", blocks), take("u1", blocks), take("<u2", blocks), take("<i8", blocks), take("<u2", patched), take("<u4", patched)
    ids = unpack_blocks(low, width, n_patched, starts, place, value, np.frombuffer(data, np.uint8, offset=at), n)
    return keys, null.astype(bool), counts, ids, start


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, tokenizer: str, cut_by: str = "words", id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_ids: int = 2_000_000) -> DataFrame:
    """Writes the files; returns the manifest: part, path, n_ids (of the file). A file holds whole documents, so the longest one bounds memory too."""
    folder, end = new_folder(docs.sparkSession, "tokens"), end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, attempt = encoder(tokenizer, cut_by), TaskContext.get().partitionId(), uuid.uuid4().hex
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        held, size, start, done = [], 0, 0, []

        def flush() -> None:
            nonlocal held, size, start
            name = f"{path}/part-{part:06d}-{len(done):05d}-{attempt}.pfr"
            with store.open_output_stream(name) as f:
                f.write(to_bytes(*(np.concatenate(c) for c in zip(*held, strict=True)), start))
            done.append((name, size))
            start, held, size = start + size, [], 0

        for batch in batches:
            for keys, ids, counts in encoded(batch, own, end_id):
                held.append((keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False), counts, ids))
                size += len(ids)
                if size >= shard_ids:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(done), pa.int32()), pa.array([n for n, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["part", "path", "n_ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if (kind := dict(rows.dtypes)["id"]) not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} is {kind}; the files hold whole numbers")
    rows, tie = rows.withColumn("id", F.col("id").cast("long")), F.xxhash64("text")
    dealt = rows.repartitionByRange("id", tie).sortWithinPartitions("id", tie, "text")
    return cut(dealt.mapInArrow(tidy(run), "part int, path string, n_ids long"), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """From the files: id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    spark = manifest.sparkSession
    before, total = {}, 0
    for r in sorted(manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["part"]):  # a row for each task that wrote
        before[r["part"]], total = total, total + r["n"]
    root = new_folder(spark, "unused")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(root)[0]
        for batch in batches:
            for part, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(path) as f:
                    keys, null, counts, ids, start = from_bytes(f.read())
                ends = np.cumsum(counts)
                for i in range(0, len(keys), 1000):
                    n = counts[i : i + 1000]
                    last = ends[i : i + 1000]
                    own = binaries(ids[last[0] - n[0] : last[-1]], n)
                    at = before[part] + start + last - n
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 1000], pa.int64(), mask=null[i : i + 1000]), pa.array(at, pa.int64()), pa.array(n, pa.int64()), own], ["id", "start", "n_tokens", "ids"])

    return manifest.select("part", "path").repartition("path").mapInArrow(tidy(run), "id long, start long, n_tokens long, ids binary")
