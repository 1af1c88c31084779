"""Progress that collectors publish: attempts with leases, as state of a stream, and what is seen of them at an instant.

Messages of one instance meet in one task, because each answer depends on all before; it holds at most MOST_ATTEMPTS attempts. In a
stream it also holds the instance's messages of a micro-batch (the source's rate limit bounds them); a table's are sorted by Spark and
gone through. Both give a log: a row for each message with its answer, and one for each attempt that time interrupted or forgot.
`snapshot` and `visible` are plain aggregations of such a log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.view import ACTIVE, STAGES
from ..schemas import HARNESSES, SAFE_INTEGER

#: How long a lease and the memory of an ended attempt last, and how many attempts an instance has.
LEASE_MS, RETENTION_MS, MOST_ATTEMPTS = 15_000, 300_000, 32
#: States of a harness within an attempt, and why an attempt ended badly.
HARNESS_STATES = ("waiting", "running", "complete", "failed", "skipped")
ERRORS = ("collection_failed", "submission_failed", "cancelled", "publisher_lost")
ENDED = ("accepted", "failed", "interrupted")
_ID = r"^(?:[a-f0-9]{32}|[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12})\z"

MESSAGE = "instance_id string, received_at_ms long, position long, operation string, attempt_id string, stage string, harnesses map<string,string>, acknowledged_batches long, acknowledged_entries long, pending long, error_code string"
#: Messages apply in this order; those with equal instants and positions are told apart by what they want.
_ORDER = ("received_at_ms", "position", "operation", "attempt_id")
_STATE = "stage string, harnesses string, acknowledged_batches long, acknowledged_entries long, pending long, error_code string, started_at_ms long, updated_at_ms long, expires_at_ms long, finished_at_ms long, revision long"
_FIELDS = [f.split()[0] for f in _STATE.split(", ")]
_LOG = f"instance_id string, attempt_id string, at_ms long, position long, cause string, answer string, {_STATE}"
_LOG_FIELDS = [f.split()[0] for f in _LOG.split(", ")]
#: Columns of an attempt in a log and in what is made of it.
ATTEMPT = ("stage", "harnesses", "acknowledged_batches", "acknowledged_entries", "pending", "error_code", "started_at_ms", "updated_at_ms", "expires_at_ms", "finished_at_ms")


def valid() -> Column:
    """Whether a message can be one; texts are '' and counts 0 where unset, and pending is null where unknown. The operation
    interrupt_all, which stands for the end of an instance's service, has no attempt."""
    c = F.col
    blank = (c("stage") == "") & (F.size("harnesses") == 0) & c("pending").isNull()
    uncounted = (c("acknowledged_batches") == 0) & (c("acknowledged_entries") == 0) & (c("error_code") == "")
    shaped = (
        F.when(c("operation") == "begin", c("stage").isin("", "waiting") & uncounted).when(c("operation") == "heartbeat", blank & uncounted).when(c("operation") == "update", c("stage").isin(*ACTIVE) & (c("error_code") == ""))
        .when(c("operation") == "finish", c("stage").isin(*ENDED) & ((c("stage") == "accepted") == (c("error_code") == ""))).when(c("operation") == "interrupt_all", blank & uncounted & (c("attempt_id") == "")).otherwise(False)
    )
    counted = c("acknowledged_batches").between(0, SAFE_INTEGER) & c("acknowledged_entries").between(0, SAFE_INTEGER) & F.coalesce(c("pending").between(0, SAFE_INTEGER), F.lit(True))
    known = F.forall(F.map_keys("harnesses"), lambda h: h.isin(*HARNESSES)) & F.forall(F.map_values("harnesses"), lambda s: F.coalesce(s.isin(*HARNESS_STATES), F.lit(False)))
    named = (c("operation") == "interrupt_all") | c("attempt_id").rlike(_ID)
    return F.coalesce(shaped & counted & known & named & c("error_code").isin("", *ERRORS), F.lit(False))


class Attempts:
    """One instance's attempts. log: what happened since it was made."""

    def __init__(self, instance: str, held: dict[str, dict]):
        self.instance, self.held, self.log = instance, held, []
        self.clock = max((a["updated_at_ms"] for a in held.values()), default=0)

    def _wrote(self, name: str, at: int, cause: str, answer: str, position: int = -1) -> str:
        self.log.append({"instance_id": self.instance, "attempt_id": name, "at_ms": at, "position": position, "cause": cause, "answer": answer, **self.held.get(name, {})})
        return answer

    def _end(self, name: str, at: int, cause: str, position: int = -1) -> None:
        a = self.held[name]
        a.update(stage="interrupted", error_code="publisher_lost", updated_at_ms=at, finished_at_ms=at, revision=a["revision"] + 1)
        self._wrote(name, at, cause, "", position)

    def _forget(self, name: str, at: int) -> None:
        self.held[name]["revision"] += 1
        self._wrote(name, at, "forgotten", "")
        del self.held[name]

    def pass_time(self, now: int) -> None:
        """Interrupts what lost its lease by now, and forgets what ended long ago."""
        for name in [n for n, a in self.held.items() if a["stage"] in ACTIVE and a["expires_at_ms"] <= now]:
            self._end(name, self.held[name]["expires_at_ms"], "expired")
        for name in [n for n, a in self.held.items() if a["stage"] in ENDED and a["finished_at_ms"] + RETENTION_MS <= now]:
            self._forget(name, self.held[name]["finished_at_ms"] + RETENTION_MS)

    def deadline(self) -> int | None:
        """The next instant at which time alone changes something."""
        return min((a["expires_at_ms"] if a["stage"] in ACTIVE else a["finished_at_ms"] + RETENTION_MS for a in self.held.values()), default=None)

    def take(self, m: dict) -> str:
        """Applies a message and returns its answer. The instance's clock doesn't run backwards."""
        now = self.clock = max(self.clock, m["received_at_ms"])
        name, say = m["attempt_id"], lambda answer: self._wrote(m["attempt_id"], now, m["operation"], answer, m["position"])
        if not m["fine"]:
            return say("invalid")
        self.pass_time(now)
        if m["operation"] == "interrupt_all":
            for active in [n for n, a in self.held.items() if a["stage"] in ACTIVE]:
                self._end(active, now, "interrupt_all", m["position"])
            return "accepted"
        if (answer := self._begun(name, now) if m["operation"] == "begin" else self._open(name)) != "accepted":
            return say(answer)
        a = self.held[name]
        if m["operation"] != "heartbeat":
            if m["acknowledged_batches"] < a["acknowledged_batches"] or m["acknowledged_entries"] < a["acknowledged_entries"]:
                return say("conflict")
            a.update({k: m[k] for k in ("harnesses", "acknowledged_batches", "acknowledged_entries", "pending", "error_code")}, stage=m["stage"] or a["stage"])
        a.update(updated_at_ms=now, expires_at_ms=now + LEASE_MS, finished_at_ms=now if m["operation"] == "finish" else 0, revision=a["revision"] + 1)
        return say("accepted")

    def _open(self, name: str) -> str:
        return "missing" if name not in self.held else "conflict" if self.held[name]["stage"] in ENDED else "accepted"

    def _begun(self, name: str, now: int) -> str:
        if name in self.held:
            return "conflict"
        if len(self.held) >= MOST_ATTEMPTS:
            ended = [(a["finished_at_ms"], n) for n, a in self.held.items() if a["stage"] in ENDED]
            if not ended:
                return "busy"
            self._forget(min(ended)[1], now)
        self.held[name] = dict.fromkeys(_FIELDS, 0) | {"stage": "waiting", "harnesses": "{}", "pending": None, "error_code": "", "started_at_ms": now}
        return "accepted"


def _frame(log: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(log, columns=_LOG_FIELDS, dtype=object)
    whole = [c for c, kind in (f.split() for f in _LOG.split(", ")) if kind == "long"]
    return out.where(out.notna(), None).astype(dict.fromkeys(whole, "Int64"))


def _messages(part: pd.DataFrame) -> list[dict]:
    return part.astype(object).where(part.notna(), None).to_dict("records")


def _through(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The log of rows that are sorted by instance and time."""
    attempts = Attempts("", {})
    for part in parts:
        log = []
        for m in _messages(part):
            if m["instance_id"] != attempts.instance:
                log += attempts.log
                attempts = Attempts(m["instance_id"], {})
            attempts.take(m)
        yield _frame(log + attempts.log)
        attempts.log.clear()


class Leases(StatefulProcessor):
    """Keeps each instance's attempts in a map, and one timer at its next deadline."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.map = handle.getMapState("attempts", "attempt_id string", _STATE)

    def _load(self, key: tuple) -> Attempts:
        return Attempts(key[0], {name[0]: dict(zip(_FIELDS, value, strict=True)) for name, value in self.map.iterator()})

    def _save(self, attempts: Attempts) -> Iterator[pd.DataFrame]:
        for name in dict.fromkeys(row["attempt_id"] for row in attempts.log):
            if name in attempts.held:
                self.map.updateValue((name,), tuple(attempts.held[name][f] for f in _FIELDS))
            elif self.map.containsKey((name,)):
                self.map.removeKey((name,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        if (at := attempts.deadline()) is not None:
            self.handle.registerTimer(at)
        if attempts.log:
            yield _frame(attempts.log)

    def handleInputRows(self, key, rows, timerValues):
        attempts = self._load(key)
        for m in sorted((m for part in rows for m in _messages(part)), key=lambda m: [m[c] for c in _ORDER]):
            attempts.take(m)
        yield from self._save(attempts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        attempts = self._load(key)
        attempts.pass_time(timerValues.getCurrentProcessingTimeInMs())
        yield from self._save(attempts)

    def close(self) -> None:
        pass


def follow(messages: DataFrame) -> DataFrame:
    """The log of messages, a stream or a table of MESSAGE's columns; others play no part. In a stream those of a micro-batch apply in
    order of (received_at_ms, position), and timers run on the cluster's clock; in a table all do, and time passes with them. Null texts
    and counts are unset; a message without an instance or an instant is dropped. A stream needs the RocksDB state store."""
    text, count = ("operation", "attempt_id", "stage", "error_code"), ("acknowledged_batches", "acknowledged_entries", "position")
    empty = F.create_map().cast("map<string,string>")
    filled = messages.where("instance_id is not null and received_at_ms is not null").select(
        "instance_id", "received_at_ms", "pending", *(F.coalesce(c, F.lit("")).alias(c) for c in text), *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in count), F.coalesce("harnesses", empty).alias("harnesses")
    )
    judged = filled.withColumn("fine", valid()).withColumn("harnesses", F.to_json("harnesses"))
    if messages.isStreaming:
        log = judged.groupBy("instance_id").transformWithStateInPandas(Leases(), outputStructType=_LOG, outputMode="append", timeMode="processingTime")
    else:
        log = judged.repartition("instance_id").sortWithinPartitions("instance_id", *_ORDER).mapInPandas(_through, _LOG)
    return log.withColumn("harnesses", F.from_json("harnesses", "map<string,string>"))


def snapshot(log: DataFrame, now_ms: int, retention_ms: int = RETENTION_MS) -> DataFrame:
    """The attempts that an instance has at now_ms by its log, whether or not a timer has spoken yet."""
    happened = log.where((F.col("answer").isin("accepted", "") & F.col("stage").isNotNull()) & (F.col("at_ms") <= now_ms))
    newest = happened.groupBy("instance_id", "attempt_id").agg(F.max_by(F.struct("cause", *ATTEMPT), F.struct("started_at_ms", "revision")).alias("a"))
    lost = F.col("stage").isin(*ACTIVE) & (F.col("expires_at_ms") <= now_ms)
    ended_at = lambda c: F.when(lost, F.col("expires_at_ms")).otherwise(F.col(c)).alias(c)
    changed = {
        "stage": F.when(lost, "interrupted").otherwise(F.col("stage")).alias("stage"), "error_code": F.when(lost, "publisher_lost").otherwise(F.col("error_code")).alias("error_code"),
        "updated_at_ms": ended_at("updated_at_ms"), "finished_at_ms": ended_at("finished_at_ms"),
    }
    rows = newest.where("a.cause <> 'forgotten'").select("instance_id", "attempt_id", "a.*").select("instance_id", "attempt_id", *(changed.get(c, F.col(c)) for c in ATTEMPT))
    return rows.where(F.col("stage").isin(*ACTIVE) | (F.col("finished_at_ms") + retention_ms > now_ms))


def visible(attempts: DataFrame) -> DataFrame:
    """Of each instance all active attempts and the one that ended last, with a label."""
    active = F.col("stage").isin(*ACTIVE)
    last = Window.partitionBy("instance_id", active).orderBy(F.desc("updated_at_ms"), F.desc("started_at_ms"), F.desc("attempt_id"))
    named = F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair))
    label = F.when(F.col("error_code") == "submission_failed", "Submission failed").otherwise(F.coalesce(named[F.col("stage")], F.lit("")))
    return attempts.withColumns({"__n": F.row_number().over(last), "label": label}).where(active | (F.col("__n") == 1)).drop("__n")


def messages_of_json(bodies: DataFrame, body: str = "body") -> DataFrame:
    """MESSAGE's columns from published bodies; rows keep instance_id, received_at_ms and position. A body that isn't one object of
    these fields becomes a message without an operation, which is invalid."""
    fields = "operation string, attemptId string, stage string, harnesses map<string,string>, acknowledgedBatches long, acknowledgedEntries long, pendingKnown boolean, pending long, errorCode string"
    m = F.from_json(body, fields, {"mode": "PERMISSIVE"})
    known = F.coalesce(m["pendingKnown"], F.lit(False))
    unset = F.coalesce(m["pending"], F.lit(0)) == 0
    # A number of pending entries that isn't known must not be given: -1 can't be valid.
    pending = F.when(known, F.coalesce(m["pending"], F.lit(0))).when(~unset, F.lit(-1)).cast("bigint")
    return bodies.select(
        "instance_id", "received_at_ms", "position", m["operation"].alias("operation"), m["attemptId"].alias("attempt_id"), m["stage"].alias("stage"), m["harnesses"].alias("harnesses"),
        m["acknowledgedBatches"].alias("acknowledged_batches"), m["acknowledgedEntries"].alias("acknowledged_entries"), pending.alias("pending"), m["errorCode"].alias("error_code"),
    )
