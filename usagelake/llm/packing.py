"""Packing by power-of-two decomposition.

A document's ids, with the end id, are cut into as many pieces of the longest length as fit and then into pieces of the
powers of two in what is left. Each piece is a sequence of its own: a sequence holds one document only and needs no padding.
Equal lengths share a bucket, the highest bits of a sequence id, and `batches` draws batches of equal shape from a bucket.
Packing is one pass without a shuffle; a block of documents' ids is in memory at once, and a longer document alone.

Defined cases: a null text is empty and gives one piece with the end id; repeated rows are packed one by one; an empty
table gives an empty result; ids may be of any type, nulls too; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import tidy
from .tokens import binaries, encoded, encoder

#: A sequence id: bucket above BUCKET_BIT, task above TASK_BIT, place in the task.
BUCKET_BIT, TASK_BIT = 58, 32


def cut_lengths(n: np.ndarray, longest: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(which document, length) of all pieces, document by document in falling order: powers of two that add up to n."""
    bits = np.arange(longest.bit_length() - 2, -1, -1)
    rest, bit = np.nonzero((n % longest)[:, None] >> bits & 1)
    whole = np.repeat(np.arange(len(n)), n // longest)
    doc = np.concatenate([whole, rest])
    length = np.concatenate([np.full(len(whole), longest, np.int64), np.int64(1) << bits[bit]])
    order = np.argsort(doc, kind="stable")
    return doc[order], length[order]


def pack(docs: DataFrame, tokenizer: str, cut: str = "gaps", id_col: str = "doc_id", text_col: str = "text", longest: int = 1024, end_id: int = 0) -> DataFrame:
    """One row for each piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket (log2 of the length),
    sequence_id and offset (0). Sequence ids are ordered by bucket, then by task and place in it; a task's input is the
    same when it is run again, and so are its ids."""
    if longest & (longest - 1):
        raise ValueError("longest isn't a power of two")
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, so_far = encoder(tokenizer, cut), TaskContext.get().partitionId(), 0
        for batch in batches:
            for keys, ids, count in encoded(batch, own, end_id):
                doc, length = cut_lengths(count, longest)
                ends = np.cumsum(length)
                start = ends - length - (np.cumsum(count) - count)[doc]
                bucket = np.log2(length).astype(np.int64)
                sequence = bucket << BUCKET_BIT | task << TASK_BIT | (so_far + np.arange(len(doc)))
                so_far += len(doc)
                columns = [keys.take(pa.array(doc)), pa.array(start), pa.array(length), binaries(ids, length), pa.array(count[doc]), pa.array(bucket.astype(np.int32)), pa.array(sequence), pa.array(np.zeros(len(doc), np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(tidy(run), f"id {kind}, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def batches(pieces: DataFrame, tokens: int = 65_536, seed: int = 0) -> DataFrame:
    """pack's rows with batch: pieces of one bucket, `tokens` tokens to a batch (fewer in the last one of each task), drawn in a
    seeded random order. Buckets are dealt over all tasks, so that a bucket with most of the pieces isn't one task's."""
    order = F.xxhash64("sequence_id", F.lit(seed))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for frame in frames:
            bucket = frame.column(frame.schema.get_field_index("bucket")).to_numpy()
            at = np.empty(len(bucket), np.int64)
            for b in np.unique(bucket).tolist():
                which = np.flatnonzero(bucket == b)
                at[which] = (seen.get(b, 0) + np.arange(len(which))) // max(1, tokens >> b)
                seen[b] = seen.get(b, 0) + len(which)
            batch = bucket.astype(np.int64) << BUCKET_BIT | task << TASK_BIT | at
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(batch)], [*frame.schema.names, "batch"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return pieces.repartitionByRange("bucket", order).sortWithinPartitions("bucket", order).mapInArrow(tidy(run), f"{kinds}, batch long")
