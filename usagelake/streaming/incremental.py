"""Facts kept up to date as evidence arrives.

Every batch adds new evidence (by identity; a batch seen before adds nothing), finds the groups of scopes that it touches,
interprets those groups anew from all their evidence, and replaces just their rows in every table that interpretation makes:
facts, estimates, outcomes and provenance change in one revision. All tables lie in buckets of their scope (or other key), and
only buckets that the batch touches are read and written.

Groups of scopes are kept, not recomputed: each scope's label is a table, and so are each label's members. A batch's new
edges join labels, and only what they join is relabelled. Late evidence is never dropped.

What is visible is named by manifests, one file for each revision, of which the highest counts; a file appears whole or not at
all, so an interrupted batch changes nothing, and of two writers of one revision the second fails: what it has computed came
from a state that is no longer the last one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.graph import component_labels
from ..operators.process import Projection
from ..operators.relational import replace_scopes
from ..storage import kept

#: Rows lie in so many buckets; a bucket of more parts is written as one.
BUCKETS, MOST_PARTS = 64, 16
#: What interpretation makes of evidence: one table, or several by name. All have a scope column.
Tables = DataFrame | dict[str, DataFrame]


class Conflict(ValueError):
    """A batch was sent again with other content."""


class Store:
    """Parquet tables below a folder of any file system that Spark reads, with a manifest that names their current versions."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _revisions(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.folder}/manifest-*.json")) or []
        return sorted(int(str(f.getPath().getName())[len("manifest-") : -len(".json")]) for f in found)

    def _manifest_path(self, revision: int):
        return self._path(f"{self.folder}/manifest-{revision:012d}.json")

    def manifest(self) -> dict:
        """The highest revision's."""
        if not (known := self._revisions()):
            return {"generation": 1, "revision": 0, "tables": {}}
        stream = self._fs.open(self._manifest_path(known[-1]))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def publish(self, manifest: dict, keep: int = 100) -> None:
        """Adds the manifest of the next revision by a rename; Conflict if that revision is there already. The last `keep` stay."""
        final = self._manifest_path(manifest["revision"])
        new = self._path(f"{self.folder}/.new-{uuid.uuid4().hex}")
        stream = self._fs.create(new)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(new, final):
            self._fs.delete(new, False)
            raise Conflict(f"revision {manifest['revision']} was written by another")
        for old in self._revisions()[:-keep]:
            self._fs.delete(self._manifest_path(old), False)

    def read(self, name: str, manifest: dict | None = None) -> DataFrame | None:
        """The table as of the manifest: a reader that keeps one sees a single state throughout."""
        entry = (manifest or self.manifest())["tables"].get(name)
        return self._load(entry, [p for parts in entry["buckets"].values() for p in parts]) if entry and entry["buckets"] else None

    def lookup(self, entry: dict | None, keys: DataFrame) -> DataFrame | None:
        """The rows of the keys (scope), from their buckets only."""
        parts = [p for b in self._touched(keys) for p in (entry or {"buckets": {}})["buckets"].get(b, [])]
        return self._load(entry, parts).join(keys.select("scope").distinct(), "scope", "left_semi") if entry and parts else None

    def append(self, entry: dict | None, rows: DataFrame, name: str) -> dict:
        """The entry with rows added. A bucket of more than MOST_PARTS parts is written anew as one."""
        schema, new = _ddl(rows), self._write(rows, name)
        buckets = {b: [*parts, *new.pop(b, [])] for b, parts in (entry or {"buckets": {}})["buckets"].items()} | new
        full = [p for parts in buckets.values() if len(parts) > MOST_PARTS for p in parts]
        if full:
            merged = self._write(self._load({"schema": schema}, full), name)
            buckets = {b: merged.get(b, parts) if len(parts) > MOST_PARTS else parts for b, parts in buckets.items()}
        return {"schema": schema, "buckets": buckets}

    def replace(self, entry: dict | None, rows: DataFrame, scopes: DataFrame, name: str) -> dict:
        """The entry with rows in place of the scopes' rows. Only buckets of these scopes are read and written."""
        touched, buckets = self._touched(scopes), dict((entry or {"buckets": {}})["buckets"])
        old = [p for b in touched for p in buckets.pop(b, [])]
        if old:
            rows = replace_scopes(self._load(entry, old), rows, scopes)
        return {"schema": _ddl(rows), "buckets": buckets | self._write(rows, name)}

    def _load(self, entry: dict, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(entry["schema"]).parquet(*paths)

    def _touched(self, keys: DataFrame) -> list[str]:
        return sorted(str(r["b"]) for r in keys.select(_bucket().alias("b")).distinct().collect())  # BUCKETS rows at most

    def _write(self, rows: DataFrame, name: str) -> dict[str, list[str]]:
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        rows.withColumn("bucket", _bucket()).repartition("bucket", "scope").write.partitionBy("bucket").parquet(path)
        found = [str(f.getPath().getName())[len("bucket=") :] for f in self._fs.globStatus(self._path(f"{path}/bucket=*")) or []]
        return {b: [f"{path}/bucket={b}"] for b in found}


def _bucket() -> Column:
    return F.pmod(F.xxhash64("scope"), F.lit(BUCKETS)).cast("int")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


class Incremental:
    """interpret: evidence rows to tables; evidence has scope and evidence_id and may have parents (array of scopes that it depends
    on). processor: raised when interpretation changes; a store of an older one is interpreted anew, a newer one refused."""

    def __init__(self, store: Store, interpret: Callable[[DataFrame], Tables], processor: int = 1):
        self.store, self.interpret, self.processor = store, interpret, processor

    def accept(self, batch: DataFrame, batch_id: str, also: Callable[[dict, dict], dict] | None = None, known: str = "compare") -> dict:
        """Adds a batch and returns the manifest that shows it. Conflict: the batch's number has come with other rows, or an
        evidence id with other content, here or before. also: given the manifest before and the tables so far, further tables of
        the same revision. known: "ignore" takes no notice of what else comes with an evidence id that is known."""
        m, columns = self._current(), sorted(batch.columns)
        whole = F.xxhash64(*columns)
        digest = batch.agg(F.count("*").alias("n"), F.sum(whole.cast("decimal(38,0)")).alias("x")).first()
        number = self.store.spark.createDataFrame([(batch_id, f"{digest['n']}:{digest['x']}")], "scope string, content string")
        before = self.store.lookup(m["tables"].get("batches"), number)
        if before is not None and (found := before.collect()):
            if found[0]["content"] != number.first()["content"]:
                raise Conflict(f"batch {batch_id} has other content than before")
            return m
        ids = kept(batch.select(F.col("evidence_id").alias("scope"), whole.alias("content")))
        stored = self.store.lookup(m["tables"].get("ids"), ids)
        seen = ids if stored is None else ids.unionByName(stored)
        if known == "compare" and not seen.groupBy("scope").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b").isEmpty():
            raise Conflict("an evidence id has come with other content")
        fresh = batch.dropDuplicates(["evidence_id"])
        if stored is not None:
            fresh = fresh.join(stored.select(F.col("scope").alias("evidence_id")), "evidence_id", "left_anti").select(*batch.columns)
        fresh = kept(fresh)
        tables = dict(m["tables"])
        tables["batches"] = self.store.append(tables.get("batches"), number, "batches")
        if not fresh.isEmpty():
            tables["ids"] = self.store.append(tables.get("ids"), fresh.select(F.col("evidence_id").alias("scope"), whole.alias("content")), "ids")
            tables["evidence"] = self.store.append(tables.get("evidence"), fresh, "evidence")
            touched = self._group(tables, fresh)
            self._project(tables, self.store.lookup(tables["evidence"], touched), touched)
        if also:
            tables |= also(m, tables)
        after = m | {"revision": m["revision"] + 1, "processor": self.processor, "tables": tables}
        if tables.get("evidence") != m["tables"].get("evidence"):
            after["input_revision"] = after["revision"]
        self.store.publish(after)
        return after

    def _current(self) -> dict:
        m = self.store.manifest()
        made_by = m.get("processor", self.processor)
        if made_by > self.processor:
            raise Conflict(f"the store was written by processor {made_by}, this is {self.processor}")
        return self.reprocess() if made_by < self.processor else m

    def _project(self, tables: dict, evidence: DataFrame | None, scopes: DataFrame) -> None:
        made = self.interpret(evidence)
        for name, rows in (made if isinstance(made, dict) else {"facts": made}).items():
            tables[name] = self.store.replace(tables.get(name), rows, scopes, name)

    def _group(self, tables: dict, fresh: DataFrame) -> DataFrame:
        """(scope) of all members of the groups that new evidence belongs to. Labels and members are brought up to date: the cost
        follows the batch and the groups that it joins."""
        own = fresh.select("scope").distinct()
        if "parents" not in fresh.columns:
            return kept(own)
        edges = kept(fresh.select(F.col("scope").alias("child"), F.explode("parents").alias("parent")).where("parent is not null").distinct())
        ends = kept(own.unionByName(edges.select(F.col("parent").alias("scope"))).distinct())
        known = self.store.lookup(tables.get("labels"), ends)
        label = ends.withColumn("component", F.col("scope")) if known is None else ends.join(known, "scope", "left").select("scope", F.coalesce("component", "scope").alias("component"))
        label = kept(label)
        at = lambda c: label.select(F.col("scope").alias(c), F.col("component").alias(f"of_{c}"))
        joined = edges.join(at("child"), "child").join(at("parent"), "parent").select(F.col("of_child").alias("child"), F.col("of_parent").alias("parent"))
        merged = component_labels(label.select(F.col("component").alias("node")).distinct(), joined)  # (node: a label before, component: the one now)
        old = merged.select(F.col("node").alias("scope"))
        members = self.store.lookup(tables.get("members"), old)
        all_ = label.select("component", F.col("scope").alias("member"))
        if members is not None:
            all_ = all_.unionByName(members.select(F.col("scope").alias("component"), "member")).distinct()
        now = kept(all_.join(merged.select(F.col("node").alias("component"), F.col("component").alias("now")), "component").select(F.col("now").alias("scope"), "member"))
        tables["members"] = self.store.replace(tables.get("members"), now, old.unionByName(now.select("scope")).distinct(), "members")
        labels = now.select(F.col("member").alias("scope"), F.col("scope").alias("component"))
        tables["labels"] = self.store.replace(tables.get("labels"), labels, labels.select("scope"), "labels")
        return kept(now.select(F.col("member").alias("scope")).distinct())

    def reprocess(self, interpret: Callable[[DataFrame], Tables] | None = None) -> dict:
        """A new generation from all evidence; the old one stays visible until the manifest is swapped."""
        m = self.store.manifest()
        self.interpret = interpret or self.interpret
        evidence, tables = self.store.read("evidence", m), dict(m["tables"])
        if evidence is not None:
            made = self.interpret(evidence)
            for name, rows in (made if isinstance(made, dict) else {"facts": made}).items():
                tables[name] = self.store.append(None, rows, name)
        after = m | {"generation": m["generation"] + 1, "revision": m["revision"] + 1, "processor": self.processor, "tables": tables}
        self.store.publish(after)
        return after

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes all that the stream has now, batch by batch; a batch that is run again is recognized by its number."""
        take = lambda batch, number: self.accept(batch, f"stream-{number}")
        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def projected(made: Projection, evidence: DataFrame) -> dict[str, DataFrame]:
    """A projection as tables for Incremental: outcomes and provenance lie with the scope of their evidence."""
    scopes = evidence.select("evidence_id", "scope")
    return {"facts": made.facts, "estimates": made.estimates, "outcomes": made.outcomes.join(scopes, "evidence_id"), "provenance": made.provenance.join(scopes, "evidence_id")}
