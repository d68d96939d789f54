"""The event table: identity, deduplicated writes, retention, capacity, statistics.

A table is a DataFrame of stored events; a write gives the table's next state, which ``EventStore`` commits as one job.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import instant
from ..sources.shared import stash
from .ordering import numbered, running

# The fields that make up an event's content.
HASHED = (
    "schema_version", "timestamp", "source_type", "severity", "event_type", "message", "service", "application",
    "environment", "host", "source", "trace_id", "correlation_id", "user_id",
)
OVERHEAD = 256


def content_hash(events: DataFrame, extra: tuple[str, ...] = ()) -> Column:
    """SHA-256 of an event's content: equal for equal instants and values, whatever came in from where.

    ``extra`` adds columns, such as file and line, that shall tell events apart.
    """
    columns = [c for c in (*HASHED, *extra) if c in events.columns]
    fields = [F.coalesce(F.unix_micros(F.col(c).cast("timestamp")).cast("string") if c == "timestamp" else F.col(c).cast("string"), F.lit("\x00")).alias(c) for c in columns]
    if "tags" in events.columns:
        fields.append(F.coalesce(F.array_join("tags", "\x1f"), F.lit("\x00")).alias("tags"))
    if "attributes" in events.columns:
        fields.append(F.coalesce(F.col("attributes").cast("string"), F.lit("\x00")).alias("attributes"))
    return F.sha2(F.to_json(F.struct(*fields)).cast("binary"), 256)


def estimated_size(events: DataFrame) -> Column:
    """Bytes of an event as JSON, and a fixed share."""
    columns = [F.col(c) for c in events.columns if c not in ("id", "sequence", "inserted_at", "content_hash", "estimated_size_bytes")]
    return (F.octet_length(F.to_json(F.struct(*columns))) + OVERHEAD).cast("long")


def with_identity(events: DataFrame, policy: str = "existing_or_generated", batch_id: str | None = None, now: Column | None = None) -> DataFrame:
    """Adds id, inserted_at, content_hash, estimated_size_bytes and source_batch_id.

    ``policy``: an event's own event_id where it has one, a new one for all, or one made of the content's hash.
    """
    out = events.withColumns({"content_hash": content_hash(events), "estimated_size_bytes": estimated_size(events)})
    made = F.concat(F.lit("evt_"), F.regexp_replace(F.uuid(), "-", ""))
    own = F.concat(F.lit("evt_"), F.regexp_replace("event_id", "^evt_|-", "")) if "event_id" in events.columns else F.lit(None).cast("string")
    choice = {"existing_or_generated": F.coalesce(own, made), "generated": made, "content_hash": F.concat(F.lit("evt_"), F.left("content_hash", F.lit(32)))}
    return out.withColumns({"id": choice[policy], "inserted_at": now if now is not None else F.current_timestamp(), "source_batch_id": F.lit(batch_id).cast("string")})


class ConflictError(ValueError):
    """An id that stands for another content."""


@dataclass(frozen=True)
class Write:
    """The table after a write, what became of each incoming row (id, outcome), and the rows that are new to the table
    or took a stored one's place."""

    table: DataFrame
    outcomes: DataFrame
    fresh: DataFrame
    changed: DataFrame | None = None


def in_batch_first(incoming: DataFrame, order: Column) -> DataFrame:
    """Marks (duplicate) all but the first row of each content."""
    firsts = incoming.groupBy("content_hash").agg(F.min(F.struct(order.alias("order"), F.col("id").alias("id"))).alias("first"))
    return incoming.join(firsts, "content_hash").withColumn("duplicate", F.struct(order.alias("order"), F.col("id").alias("id")) != F.col("first")).drop("first")


#: Incoming rows up to which stored rows are looked up by broadcast of ids and hashes, some 100 bytes a row.
BATCH = 100_000


def write(stored: DataFrame, incoming: DataFrame, policy: str = "ignore", order: str = "arrival", last: int | None = None) -> Write:
    """Adds events that are not stored yet; new ones get the next sequence numbers, in the order of column ``order``.

    Events are the same if their content is. ``ignore`` leaves a stored event as it is, ``reject`` fails on any
    duplicate, ``replace`` puts the new event in the place (id and sequence) of the stored one. An id that is stored,
    or comes in again, with another content is an error in all cases.

    A batch of at most BATCH rows is sent to the stored rows, which are read in place; a larger one is joined by a
    shuffle. ``last`` is the last sequence number given, if that is known.
    """
    if policy not in ("ignore", "reject", "replace"):
        raise ValueError(f"unknown policy {policy}")
    incoming = stash(incoming)  # read several times below
    sent = F.broadcast if incoming.count() <= BATCH else lambda rows: rows
    known = stored.select("id", F.col("content_hash").alias("known_hash"))
    if not known.join(sent(incoming.select("id", "content_hash")), "id").filter("content_hash != known_hash").isEmpty():
        raise ConflictError("an id is stored with another content")
    several = incoming.groupBy("id").agg(F.min("content_hash").alias("one"), F.max("content_hash").alias("other")).filter("one != other")
    if not several.isEmpty():
        raise ConflictError("an id of the batch stands for several contents")
    marked = in_batch_first(incoming, F.col(order))
    # of the stored rows, only those of contents that come in are grouped
    met = stored.select("id", "sequence", "content_hash").join(sent(incoming.select("content_hash").distinct()), "content_hash", "left_semi")
    old = met.groupBy("content_hash").agg(F.min_by("id", "sequence").alias("old_id"), F.min("sequence").alias("old_sequence"))
    judged = marked.join(old, "content_hash", "left")
    outcome = F.when(F.col("duplicate"), "ignored").when(F.col("old_id").isNotNull(), "replaced" if policy == "replace" else "ignored").otherwise("inserted")
    judged = stash(judged.withColumn("outcome", outcome))  # read several times below
    if policy == "reject" and not judged.filter("outcome != 'inserted'").isEmpty():
        raise ConflictError("the batch holds duplicates")
    if last is None:
        last = stored.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("last")).first()[0]
    fresh = numbered(judged.filter("outcome = 'inserted'"), [order, "id"], "added")
    columns, changed = stored.columns, None
    fresh = fresh.withColumn("sequence", F.lit(last) + F.col("added")).select(*columns)
    if policy == "replace":
        changed = judged.filter("outcome = 'replaced'").withColumns({"id": F.col("old_id"), "sequence": F.col("old_sequence")}).select(*columns)
        stored = stored.join(sent(changed.select("id")), "id", "left_anti").select(*columns).unionByName(changed)
    return Write(stored.unionByName(fresh), judged.select("id", "outcome"), fresh, changed)


def get(stored: DataFrame, id_: str) -> DataFrame:
    return stored.filter(F.col("id") == id_)


def delete(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("id").distinct(), "id", "left_anti")


def retained(stored: DataFrame, seconds: float, now: datetime, basis: str = "inserted_at") -> DataFrame:
    """Events at most ``seconds`` old, by the time they came in or their own."""
    return stored.filter(F.col(basis) >= instant(now - timedelta(seconds=seconds)))


def within_capacity(stored: DataFrame, events: int | None = None, size: int | None = None, policy: str = "oldest_inserted") -> DataFrame:
    """The latest events that fit both a count and a size; the oldest, as few as need be, go."""
    if policy == "reject_new":
        row = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum("estimated_size_bytes"), F.lit(0))).first()
        if (events is not None and row[0] > events) or (size is not None and row[1] > size):
            raise ConflictError("the store is full")
        return stored
    rows = stored.withColumns({"_late": -F.col("sequence"), "_at": -F.unix_micros(F.col("timestamp").cast("timestamp"))})
    order = ["_late"] if policy == "oldest_inserted" else ["_at", "_late"]
    summed = running(rows, order, {"_n": F.lit(1).cast("long"), "_bytes": F.col("estimated_size_bytes")})
    keep = F.lit(True)
    if events is not None:
        keep = keep & (F.col("_n") <= events)
    if size is not None:
        keep = keep & (F.col("_bytes") <= size)
    return summed.filter(keep).select(*stored.columns)


def statistics(stored: DataFrame) -> DataFrame:
    """One row: events, bytes, different contents, first and last times, last sequence."""
    return stored.agg(
        F.count(F.lit(1)).alias("event_count"), F.coalesce(F.sum("estimated_size_bytes"), F.lit(0)).alias("total_bytes"), F.count_distinct("content_hash").alias("contents"),
        F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event"), F.coalesce(F.max("sequence"), F.lit(0)).alias("last_sequence"),
    )


class StaleError(RuntimeError):
    """Somebody else has committed a version since the one that this write began from."""


#: What is counted over all writes, and never starts anew.
COUNTERS = ("inserted", "ignored", "replaced", "evicted", "expired", "writes", "deletes", "clears")


class EventStore:
    """Stored events in a folder: Parquet parts, partitioned by a bucket of the content's hash, and a small file for each
    version that names the part folders of each bucket, the counters so far and the last sequence number.

    A write adds a part with its new rows; where rows are replaced or deleted, only their buckets are written anew. The
    version file is made last, and only if there is none of that number: of two writers that began from one version one
    commits, and the other begins again from the new version. A write that fails or loses its driver leaves parts that
    no version names. Parts and versions stay until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, buckets: int = 64):
        self.spark, self.folder, self.schema, self.buckets = spark, folder.rstrip("/"), schema, buckets
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        return sorted(n for n in self._named() if self._load(n) is not None)

    def _named(self) -> list[int]:
        if not self.files.exists(self.path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(self.path(self.folder)) if f.isFile()]
        return [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]

    def _load(self, number: int) -> dict | None:
        """A version's content; None while it is being written."""
        stream = self.files.open(self.path(f"{self.folder}/v{number}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("\n") else None

    def state(self, number: int | None = None) -> dict:
        """number, parts (folders by bucket), counters and last of a version, by default the newest."""
        found = self.versions()
        number = number if number is not None else found[-1] if found else 0
        loaded = self._load(number) if number else {"parts": {}, "counters": dict.fromkeys(COUNTERS, 0), "last": 0}
        return loaded | {"number": number}

    def read(self, state: dict | None = None, buckets: list[str] | None = None) -> DataFrame:
        """The events of a version, or of some of its buckets."""
        state = state or self.state()
        paths = [f"{self.folder}/{part}/bucket={b}" for b, parts in state["parts"].items() if buckets is None or b in buckets for part in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def counters(self) -> dict[str, int]:
        return self.state()["counters"]

    def _part(self, rows: DataFrame) -> dict[str, list[str]]:
        """Writes a part; its folder for each bucket that it has."""
        name = f"part-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("content_hash"), F.lit(self.buckets)).cast("int")
        dealt = rows.select(*self.schema.names).withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "content_hash")
        dealt.write.option("parquet.bloom.filter.enabled#content_hash", "true").option("parquet.bloom.filter.enabled#id", "true").partitionBy("bucket").parquet(f"{self.folder}/{name}")
        made = [f.getPath().getName() for f in self.files.listStatus(self.path(f"{self.folder}/{name}"))]
        return {m.removeprefix("bucket="): [name] for m in made if m.startswith("bucket=")}

    def _commit(self, state: dict, parts: dict[str, list[str]], last: int | None = None, **counts: int) -> int:
        """Publishes the version after ``state``."""
        number = state["number"] + 1
        counters = {k: state["counters"][k] + counts.get(k, 0) for k in COUNTERS}
        content = json.dumps({"parts": {b: p for b, p in parts.items() if p}, "counters": counters, "last": state["last"] if last is None else last}) + "\n"
        if number in self._named():
            raise StaleError(f"version {number} is there already")
        try:
            stream = self.files.create(self.path(f"{self.folder}/v{number}"), False)
        except Py4JJavaError as error:
            raise StaleError(f"version {number} is there already") from error
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()
        return number

    def _again(self, attempt: Callable[[dict], Any], tries: int = 5) -> Any:
        for k in range(tries):
            try:
                return attempt(self.state())
            except StaleError:
                if k == tries - 1:
                    raise
        return None

    def commit(self, table: DataFrame, **counts: int) -> int:
        """Makes ``table`` the newest version, in parts of its own. It must have been made from the version that is the
        newest; a StaleError tells that it is not so any more."""
        state = self.state()
        return self._commit(state, self._part(table), **counts)

    def _without(self, state: dict, gone: DataFrame, instead: DataFrame | None = None) -> dict[str, list[str]]:
        """Parts of a version in which the rows of some ids are left out, or others stand for them; only the buckets of
        these are written. ``gone`` has id and content_hash."""
        bucket = F.pmod(F.xxhash64("content_hash"), F.lit(self.buckets)).cast("string")
        touched = [r[0] for r in gone.select(bucket).distinct().collect()]  # at most ``buckets``
        if not touched:
            return dict(state["parts"])
        left = self.read(state, touched).join(gone.select("id"), "id", "left_anti")
        made = self._part(left.unionByName(instead.select(*left.columns)) if instead is not None else left)
        return {b: p for b, p in state["parts"].items() if b not in touched} | made

    def add(self, incoming: DataFrame, policy: str = "ignore", order: str = "arrival") -> dict[str, int]:
        """Writes events, and tells how many became what."""

        def attempt(state: dict) -> dict[str, int]:
            done = write(self.read(state), incoming, policy, order, state["last"])
            told = {"inserted": 0, "replaced": 0, "ignored": 0} | {r.outcome: r["count"] for r in done.outcomes.groupBy("outcome").count().collect()}
            parts = self._without(state, done.changed.select("id", "content_hash"), done.changed) if told["replaced"] else dict(state["parts"])
            if told["inserted"]:
                for b, made in self._part(done.fresh).items():
                    parts[b] = [*parts.get(b, []), *made]
            self._commit(state, parts, state["last"] + told["inserted"], writes=1, **told)
            return told

        return self._again(attempt)

    def delete(self, ids: DataFrame, reason: str | None = None) -> int:
        """Removes events, and tells how many; ``reason`` is ``evicted`` or ``expired`` where capacity or age asks for it."""

        def attempt(state: dict) -> int:
            gone = stash(self.read(state).select("id", "content_hash").join(ids.select("id").distinct(), "id", "left_semi"))
            n = gone.count()
            self._commit(state, self._without(state, gone), deletes=0 if reason else 1, **({reason: n} if reason else {}))
            return n

        return self._again(attempt)

    def retain(self, seconds: float, now: datetime, basis: str = "inserted_at") -> int:
        """Removes events that are older, and tells how many."""
        rows = self.read()
        return self.delete(rows.filter((F.col(basis) < instant(now - timedelta(seconds=seconds))) | F.col(basis).isNull()), "expired")

    def evict(self, events: int | None = None, size: int | None = None, policy: str = "oldest_inserted") -> int:
        """Removes the oldest events until the others fit, and tells how many."""
        rows = self.read()
        return self.delete(rows.join(within_capacity(rows, events, size, policy).select("id"), "id", "left_anti"), "evicted")

    def clear(self) -> int:
        """Removes all events; counters and sequence numbers go on."""
        return self._again(lambda state: self._commit(state, {}, clears=1))

    def vacuum(self, keep: int = 1) -> int:
        """Removes all versions but the newest ``keep``, and parts that these do not name; nobody may be reading or writing
        them."""
        found = self.versions()
        old, kept = found[:-keep], found[-keep:]
        named = {part for n in kept for parts in self.state(n)["parts"].values() for part in parts}
        for number in old:
            self.files.delete(self.path(f"{self.folder}/v{number}"), True)
        for f in self.files.listStatus(self.path(self.folder)):
            if f.getPath().getName().startswith("part-") and f.getPath().getName() not in named:
                self.files.delete(f.getPath(), True)
        return len(old)
