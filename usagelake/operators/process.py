"""Evidence to facts, estimates and outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch, stored
from .ancestry import resolve_copies
from .facts import estimate_rows, fact_rows
from .interpret import claude, codex, evidence_id, identified, opencode, pi
from .resolve import contributions, estimates, provenance, resolve

#: What records are made of; nothing that candidates become holds it.
RAW = ("data", "context", "diagnostics")
#: Written and shuffled as 32 bytes each.
HASHES = ("evidence_id", "fact_id", "session_id", "payload_hash")


@dataclass(frozen=True)
class Projection:
    """facts and estimates have the columns of their tables."""

    facts: DataFrame
    estimates: DataFrame
    outcomes: DataFrame
    provenance: DataFrame


def _narrow(candidates: DataFrame) -> DataFrame:
    return candidates.drop(*RAW)


def process(evidence: DataFrame, dataset: str = "default", generation: int = 1, revision: int = 0) -> Projection:
    """All of a dataset's evidence at once; equal rows of evidence count once."""
    # Written once each: everything below reads them several times. Each goes as soon as nothing reads it any more.
    # The number of parts is given, because AQE would put a small batch of records into one task, and each takes long.
    keys = ["harness", "format", "source_id", "lineage", "ordinal", "data"]
    with Scratch() as own:
        with Scratch() as first:
            rows = first.stored(evidence.repartition(int(evidence.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).dropDuplicates(keys))
            plain = own.stored(_narrow(pi(rows).unionByName(claude(rows)).unionByName(opencode(rows))))
            copies = first.stored(_narrow(identified(codex(rows))))
            context = rows.where("not is_usage").select(evidence_id(), F.lit("context").alias("disposition"), F.lit("").alias("code"))
            bad = plain.where("not usable").select("evidence_id").unionByName(copies.where("not usable").select("evidence_id"))
            without = stored(context.unionByName(bad.select("evidence_id", F.lit("ambiguous").alias("disposition"), F.lit("unusable_usage").alias("code"))))
            good = resolve_copies(copies.where("usable"), rows, own.stored)
        usable = identified(plain.where("usable"))
        usable = usable.unionByName(good.select(*usable.columns)).withColumns({c: F.unhex(c) for c in HASHES})
        resolved = stored(resolve(usable).drop("payload_hash")).withColumns({c: F.lower(F.hex(c)) for c in HASHES if c != "payload_hash"})
    outcomes = without.select("evidence_id", F.lit("").alias("fact_id"), "disposition", "code").unionByName(resolved.select("evidence_id", "fact_id", "disposition", F.col("outcome_code").alias("code")))
    at = (dataset, generation, revision)
    return Projection(fact_rows(contributions(resolved), *at), estimate_rows(estimates(resolved), *at), outcomes, provenance(resolved))
