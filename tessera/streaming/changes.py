"""Change feeds: typed events, feeds over Structured Streaming, and a manager with a pull interface."""

from __future__ import annotations

import uuid
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryParseError
from ..plans.filters import compile_filter

TYPES = ("insert", "update", "delete", "replace", "drop", "invalidate")
EVENT = "id string, change_type string, namespace string, document_id string, full_document string, update_description string, cluster_time bigint, ts timestamp"


def watch(events: DataFrame, namespace: str | None = None, types: list[str] | None = None, query: dict | None = None) -> DataFrame:
    """Events of a batch or a stream by namespace prefix, type and filter; stateless, so nothing is shuffled."""
    if unknown := set(types or ()) - set(TYPES):
        raise QueryParseError(f"no change is of type {sorted(unknown)}")
    if namespace is not None:
        events = events.where(F.col("namespace").startswith(namespace))
    if types is not None:
        events = events.where(F.col("change_type").isin(types))
    if query:
        events = events.where(compile_filter(query, events.schema, where=True))
    return events


def latest(events: DataFrame, buffer: int = 10_000) -> DataFrame:
    """The newest ``buffer`` events of a batch, oldest first: what a bounded queue that drops its oldest would hold."""
    return events.orderBy(F.desc("cluster_time")).limit(buffer).orderBy("cluster_time")


def source(spark: SparkSession, path: str, schema: T.StructType | str = EVENT, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def deliver(stream: DataFrame, to: str, checkpoint: str) -> None:
    """Append what is new since the checkpoint as Parquet, then stop; the checkpoint is the resume token."""
    q = stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def each_batch(stream: DataFrame, handle, checkpoint: str):
    """Hand each micro-batch, ordered by cluster time, to ``handle(batch, epoch)``; returns the running query."""
    return stream.writeStream.foreachBatch(lambda b, e: handle(b.orderBy("cluster_time"), e)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass
class ChangeStream:
    """One reader of a feed: what it asks for, how far it has read, and events fetched ahead."""

    namespace: str | None = None
    types: list[str] | None = None
    query: dict | None = None
    after: int = 0
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    active: bool = True
    resume_token: str | None = None
    ahead: deque = field(default_factory=deque)


class ChangeFeed:
    """A feed in a folder: events are appended with rising cluster times, and streams pull them in batches.

    A stream that falls more than ``buffer`` events behind loses the oldest of them, as a bounded
    queue would. Its place is a cluster time, so a new stream can resume after any event's id.
    """

    def __init__(self, spark: SparkSession, path: str, buffer: int = 10_000):
        self.spark, self.path, self.buffer = spark, path, buffer
        self.streams: dict[str, ChangeStream] = {}

    def events(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).parquet(self.path)

    def newest(self) -> int:
        return self.events().agg(F.max("cluster_time")).first()[0] or 0

    def broadcast(self, events: list[dict]) -> int:
        """Append events, in their order, with the next cluster times; returns the last."""
        at, rows = self.newest(), []
        for e in events:
            if e["change_type"] not in TYPES:
                raise QueryParseError(f"no change is of type {e['change_type']}")
            at += 1
            rows.append((e.get("id") or str(uuid.uuid4()), e["change_type"], e["namespace"], e.get("document_id"), e.get("full_document"), e.get("update_description"), at))
        if rows:
            df = self.spark.createDataFrame(rows, "id string, change_type string, namespace string, document_id string, full_document string, update_description string, cluster_time bigint")
            df.withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)
        return at

    def emit(self, change_type: str, namespace: str, document_id: str | None = None, full_document: str | None = None) -> int:
        return self.broadcast([{"change_type": change_type, "namespace": namespace, "document_id": document_id, "full_document": full_document}])

    def open(self, namespace: str | None = None, types: list[str] | None = None, query: dict | None = None, resume_after: str | None = None) -> ChangeStream:
        """A stream of what comes from now on, or of what came after the event of an id."""
        after = self.newest()
        if resume_after is not None:
            row = self.events().where(F.col("id") == resume_after).select("cluster_time").first()
            if row is None:
                raise QueryParseError(f"no event {resume_after} to resume after")
            after = row[0]
        s = ChangeStream(namespace, types, query, after)
        self.streams[s.id] = s
        return s

    def _waiting(self, s: ChangeStream) -> DataFrame:
        """The stream's unread events, the filter on their time reaching the scan."""
        return latest(watch(self.events().where(F.col("cluster_time") > s.after), s.namespace, s.types, s.query), self.buffer)

    def next_batch(self, s: ChangeStream, most: int = 101) -> list[Row]:
        if not s.active:
            return []
        if len(s.ahead) < most:
            last = s.ahead[-1]["cluster_time"] if s.ahead else s.after
            s.ahead.extend(self._waiting(s).where(F.col("cluster_time") > last).limit(most - len(s.ahead)).collect())
        out = [s.ahead.popleft() for _ in range(min(most, len(s.ahead)))]
        if out:
            s.after, s.resume_token = out[-1]["cluster_time"], out[-1]["id"]
        return out

    def next(self, s: ChangeStream) -> Row | None:
        got = self.next_batch(s, 1)
        return got[0] if got else None

    def pending(self, s: ChangeStream) -> int:
        return self._waiting(s).count() if s.active else 0

    def has_events(self, s: ChangeStream) -> bool:
        return s.active and (bool(s.ahead) or self._waiting(s).limit(1).count() > 0)

    def close(self, s: ChangeStream) -> None:
        s.active = False
        s.ahead.clear()

    def cleanup(self) -> int:
        """Forget closed streams; returns those that stay."""
        self.streams = {i: s for i, s in self.streams.items() if s.active}
        return len(self.streams)
