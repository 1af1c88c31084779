"""Rows in batches for delivery: consecutive rows of a queue, as many as both limits allow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS, MOST_BYTES = 256, 1 << 20


def batched(rows: DataFrame, queue: Column, sequence: str, size: Column, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(queue, sequence, batch): batches are numbered from 0 in each queue, in the order of sequence. Where a batch begins depends
    on all before it, so a task reads its queues in order and keeps three numbers for each; rows pass through without their
    content. A row beyond the byte limit stands alone."""
    narrow = rows.select(queue.cast("string").alias("queue"), F.col(sequence).cast("bigint").alias("sequence"), size.cast("bigint").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, held, held_bytes = object(), 0, 0, 0
        for batch in batches:
            out = []
            for name, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != at:
                    at, number, held, held_bytes = name, 0, 0, 0
                elif held == most_rows or held_bytes + (n or 0) > most_bytes:
                    number, held, held_bytes = number + 1, 0, 0
                held, held_bytes = held + 1, held_bytes + (n or 0)
                out.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["queue", "sequence", "batch"])

    return narrow.repartition("queue").sortWithinPartitions("queue", "sequence").mapInArrow(run, "queue string, sequence long, batch long")


def admitted(rows: DataFrame, component: str, size: Column, most_bytes: int = MOST_BYTES, workers: int = 16) -> DataFrame:
    """(component, bytes, worker, round): components dealt to workers, each of which takes as many in a round as the limit holds, in the
    order of their ids; one beyond the limit has a round of its own. A component's bytes are summed before anything is dealt."""
    sums = rows.groupBy(F.col(component).alias("component")).agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))
    worker = F.pmod(F.col("component"), F.lit(workers)).cast("string")
    dealt = batched(sums, worker, "component", F.col("bytes"), 2**62, most_bytes)
    rounds = dealt.select(F.col("sequence").alias("component"), F.col("queue").alias("worker"), F.col("batch").alias("round"))
    return sums.join(rounds, "component")
