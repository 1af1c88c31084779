"""What is still to be delivered: evidence with gapless sequence numbers, requests as they were first built, acknowledgements.

A stream's numbers follow the order of its records and leave no gap, without a window over all of them: sorted ranges number
their own rows, and each begins where the counts of those before it end. A request is built once and saved; whatever is sent
again is the saved body, byte for byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import kept
from .delivery import MOST_BYTES, MOST_ROWS, batched
from .facts import LOCATION

#: Names of a record's parts in a request, and versions of the protocol.
_NAMES = {"harness": "harness", "format": "format", "source_id": "sourceId", "lineage": "lineage", "ordinal": "ordinal"}
_PLACES = dict(zip(LOCATION, ("directoryKey", "directoryName", "repositoryKey", "repositoryName", "repositorySource"), strict=True))
PROTOCOL, EXTRACTOR = 3, 1
#: Bytes that a request needs besides its entries, at most: six names of 256 bytes, numbers, punctuation.
ENVELOPE = 2048
ORDER = ("source_id", "lineage", "ordinal", "evidence_id")


def numbered(rows: DataFrame, order: tuple[str, ...], after: int = 0) -> DataFrame:
    """rows with sequence: after + 1 and so on in the order given, which should be total. The ranges are written before they are
    counted, so that a lost executor can't deal them anew; the driver sees one count for each."""
    dealt = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    starts, total = [], after
    for r in sorted(dealt.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):
        starts.append((r["part"], total))
        total += r["count"]
    before = rows.sparkSession.createDataFrame(starts, "__part long, __before long")
    return dealt.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("sequence", F.col("__before") + place + 1).drop("__at", "__part", "__before")


def enqueue(outbox: DataFrame | None, evidence: DataFrame) -> DataFrame:
    """The rows that a stream's outbox gains: (sequence, evidence_id, record) for evidence that it doesn't hold yet."""
    fresh, last = evidence.dropDuplicates(["evidence_id"]), 0
    if outbox is not None:
        fresh = fresh.join(outbox.select("evidence_id"), "evidence_id", "left_anti")
        last = outbox.agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]
    return numbered(fresh.select(*ORDER, record_json().alias("record")), ORDER, last).select("sequence", "evidence_id", "record")


def record_json() -> Column:
    """A record of evidence as requests hold it; data is JSON already."""
    names = F.to_json(F.struct(*(F.col(c).alias(n) for c, n in _NAMES.items())))
    context = F.transform("context", lambda c: F.concat(F.lit('{"ordinal":'), c["ordinal"].cast("string"), F.lit(',"data":'), c["data"], F.lit(',"diagnostics":'), F.to_json(c["diagnostics"]), F.lit("}")))
    place = F.to_json(F.struct(*(F.nullif(F.col(c), F.lit("")).alias(n) for c, n in _PLACES.items())))
    parts = [
        F.substring(names, 2, 1 << 30).substr(F.lit(1), F.length(names) - 2), F.concat(F.lit('"data":'), F.col("data")), F.when(F.size("context") > 0, F.concat(F.lit('"context":['), F.array_join(context, ","), F.lit("]"))),
        F.when(place != "{}", F.concat(F.lit('"location":'), place)), F.when(F.size("diagnostics") > 0, F.concat(F.lit('"diagnostics":'), F.to_json("diagnostics"))),
    ]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def requests(rows: DataFrame, stream: str, database_id: str, dataset_id: str, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(stream_id, batch_id, from_sequence, to_sequence, body) for outbox rows of which none is in a request yet: consecutive rows, as many
    as both limits allow. The result is to be saved before anything of it is sent."""
    entry = F.concat(F.lit('{"sequence":'), F.col("sequence").cast("string"), F.lit(',"record":'), F.col("record"), F.lit("}"))
    entries = kept(rows.select("sequence", entry.alias("entry")))
    dealt = batched(entries, F.lit(stream), "sequence", F.octet_length("entry") + 1, most_rows, most_bytes - ENVELOPE)
    grouped = entries.join(dealt.select("sequence", "batch"), "sequence").groupBy("batch").agg(F.min("sequence").alias("from_sequence"), F.max("sequence").alias("to_sequence"), F.array_sort(F.collect_list(F.struct("sequence", "entry"))).alias("e"))
    batch_id = F.concat(F.lit("batch-"), F.col("from_sequence").cast("string"), F.lit("-"), F.col("to_sequence").cast("string"))
    head = F.to_json(F.struct(F.lit(PROTOCOL).alias("protocolVersion"), F.lit(EXTRACTOR).alias("extractorVersion"), F.lit(database_id).alias("databaseId"), F.lit(dataset_id).alias("datasetId"), F.lit(stream).alias("streamId"), batch_id.alias("batchId"), F.col("from_sequence").alias("fromSequence"), F.col("to_sequence").alias("toSequence")))
    body = F.concat(F.substring(head, 1, 1 << 30).substr(F.lit(1), F.length(head) - 1), F.lit(',"entries":['), F.array_join(F.transform("e", lambda x: x["entry"]), ","), F.lit("]}"))
    return grouped.select(F.lit(stream).alias("stream_id"), batch_id.alias("batch_id"), "from_sequence", "to_sequence", body.cast("binary").alias("body"))


def open_requests(saved: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Saved requests that no receipt acknowledges, in the order in which they are to be sent (again). acknowledged: (request_hash), of
    receipts that name the body's hash; another hash acknowledges nothing."""
    known = acknowledged.select("request_hash").distinct()
    return saved.withColumn("request_hash", F.sha2("body", 256)).join(known, "request_hash", "left_anti").orderBy("stream_id", "from_sequence")


def pending(outbox: DataFrame, saved: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """One row: how many records wait for a receipt."""
    done = saved.withColumn("request_hash", F.sha2("body", 256)).join(acknowledged.select("request_hash").distinct(), "request_hash", "left_semi")
    delivered = done.agg(F.coalesce(F.sum(F.col("to_sequence") - F.col("from_sequence") + 1), F.lit(0)).alias("delivered"), F.lit(1).alias("one"))
    return outbox.agg(F.count("*").alias("n"), F.lit(1).alias("one")).join(delivered, "one").select((F.col("n") - F.col("delivered")).alias("pending"))
