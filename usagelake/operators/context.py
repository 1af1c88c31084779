"""Order-dependent operators over a source's records: carried context, late context, cumulative counters."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, kinds: dict[str, Column], value: Column, by: tuple[str, ...] = ("source_id", "lineage"), order: str = "ordinal") -> DataFrame:
    """rows with, for each kind, the value of the latest earlier record of that kind (its own excluded) as last_<kind>."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("*", *(F.last(F.when(test, value), ignorenulls=True).over(before).alias(f"last_{name}") for name, test in kinds.items()))


def next_value(rows: DataFrame, test: Column, value: Column, name: str, by: tuple[str, ...] = ("source_id", "lineage"), order: str = "ordinal") -> DataFrame:
    """rows with the value of the nearest later record that passes the test. The window runs from the last record to the first, so
    that its frame only grows: Spark would compute a frame that shrinks from scratch for each row."""
    after = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(test, value), ignorenulls=True).over(after))


def first_seen(rows: DataFrame, key: str, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """rows with is_first: no earlier row of the group has the same key."""
    return rows.withColumn("is_first", F.row_number().over(Window.partitionBy(*by, key).orderBy(*order)) == 1)


def high_water(rows: DataFrame, session: str = "session_id", order: tuple[str, ...] = ("occurred_at_ms", "ordinal", "evidence_id"), counter: str = "cumulative", turn: str = "turn", fork: str = "is_fork") -> DataFrame:
    """rows with code: known_duplicate where the cumulative counter equals the mark, stale_snapshot where it is below it,
    else empty, and the counter becomes the mark. A fork's mark starts anew with each turn. Rows without counter pass.

    A skipped row doesn't move the mark, and an accepted one sets it to the largest value so far; so the mark before a row
    is the running maximum, which a window has: no fold is needed."""
    part = [session, F.when(F.col(fork), F.coalesce(F.col("__run"), F.lit(0))).otherwise(0)]
    turns = Window.partitionBy(session).orderBy(*order)
    changed = F.coalesce((~F.col(turn).eqNullSafe(F.lag(turn).over(turns))).cast("int"), F.lit(0))
    numbered = rows.withColumn("__changed", changed).withColumn("__run", F.sum("__changed").over(turns.rowsBetween(Window.unboundedPreceding, 0)))
    mark = F.max(counter).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    code = F.when(F.col(counter) == mark, "known_duplicate").when(F.col(counter) < mark, "stale_snapshot").otherwise("")
    return numbered.withColumn("code", code).drop("__changed", "__run")


def distinct_over(rows: DataFrame, key: str, order: str, value: str, preceding: int, name: str) -> DataFrame:
    """(key, order, name): the distinct values, sorted, of a row and the `preceding` rows before it under its key; nulls don't count.
    A value is counted when it enters the frame and when it leaves, so a row costs no more than what it shows: a frame collected
    anew for each row would cost its length. A key's rows are in one task, in order; what is held is one frame."""
    kinds = dict(rows.select(F.col(key).alias("k"), F.col(order).alias("o")).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, frame, counts, present = object(), deque(), Counter(), []
        for batch in batches:
            out = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != at:
                    at, frame, counts, present = k, deque(), Counter(), []
                if len(frame) > preceding and (gone := frame.popleft()) is not None:
                    counts[gone] -= 1
                    if not counts[gone]:
                        del counts[gone], present[bisect_left(present, gone)]
                frame.append(v)
                if v is not None:
                    counts[v] += 1
                    if counts[v] == 1:
                        insort(present, v)
                out.append(list(present))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], ["k", "o", "values"])

    narrow = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).cast("string").alias("v"))
    found = narrow.repartition("k").sortWithinPartitions("k", "o").mapInArrow(run, f"k {kinds['k']}, o {kinds['o']}, values array<string>")
    return found.select(F.col("k").alias(key), F.col("o").alias(order), F.col("values").alias(name))
