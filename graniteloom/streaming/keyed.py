"""Keyed state of a stream: the first of equal and nearly equal texts of a bucket, kept over batches and restarts.

Each bucket (a repository, file and label, say) has a map from content key to what was kept: its group, its shingles and
when it came. A row passes if its bucket knows neither its content nor, from another group, a text of a higher similarity
than allowed. Entries go by event-time timers when they are older than the time to live, so state is bounded by what comes
within it. Spark keeps the state in RocksDB, changes go to the checkpoint, and a lost executor's buckets are loaded from it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graniteloom.operators.curation import content_key, tokens

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Similarity above which texts of other groups are the same, tokens of a shingle.
SIMILARITY, SHINGLE = 0.95, 5


def jaccard_above(a: set[int], b: set[int], similarity: float) -> bool:
    """Whether the shared part of two sets is more than `similarity` of all; sizes alone often tell."""
    if not a or not b or min(len(a), len(b)) <= similarity * max(len(a), len(b)):
        return False
    shared = len(a & b)
    return shared > similarity * (len(a) + len(b) - shared)


class FirstOfBucket(StatefulProcessor):
    """Emits (id, verdict): kept, same (content) or near (another group's text)."""

    def __init__(self, live_ms: int, similarity: float):
        self.live_ms, self.similarity = live_ms, similarity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "content string", "grp string, shingles array<long>, at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Rows of a bucket come in any order within a batch; the earliest goes first, then the smallest id.
        for row in sorted(rows, key=lambda r: (r["at"], str(r["id"]))):
            verdict = self._verdict(row)
            if verdict == "kept":
                self.kept.updateValue((row["content"],), (row["grp"], list(row["shingles"]), row["at"]))
                self.handle.registerTimer(row["at"] + self.live_ms)
            yield Row(id=row["id"], verdict=verdict)

    def _verdict(self, row: Row) -> str:
        known = self.kept.getValue((row["content"],)) if self.kept.containsKey((row["content"],)) else None
        if known is not None and row["at"] - known[2] < self.live_ms:
            return "same"
        own = set(row["shingles"])
        for _, (grp, shingles, at) in self.kept.iterator():
            if grp != row["grp"] and row["at"] - at < self.live_ms and jaccard_above(own, set(shingles), self.similarity):
                return "near"
        return "kept"

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = expiredTimerInfo.getExpiryTimeInMs() - self.live_ms
        for (content,) in [c for c, (_, _, at) in self.kept.iterator() if at <= until]:
            self.kept.removeKey((content,))
        return iter(())

    def close(self) -> None:
        pass


def with_rocksdb(spark: SparkSession) -> None:
    """The state store that timers and maps need; a stream takes the session's when it starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def first_texts(stream: DataFrame, id: str, text: str, bucket: list[str], group: str, ts: str = "ts", *, live: str = "30 days", late: str = "1 day", similarity: float = SIMILARITY) -> DataFrame:
    """(id, verdict) of each row of a stream: see FirstOfBucket. Needs with_rocksdb(). Null texts count as empty, null parts
    of a bucket or group as "". `live` is an interval of days, hours, minutes or seconds."""
    amount, unit = live.split()
    live_ms = int(float(amount) * {"d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1000}[unit[0]])
    body = F.coalesce(F.col(text), F.lit(""))
    words = tokens(body)
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, SHINGLE), " ")))
    rows = stream.withWatermark(ts, late).select(
        F.concat_ws("\x01", *(F.coalesce(F.col(b).cast("string"), F.lit("")) for b in bucket)).alias("bucket"),
        F.col(id).alias("id"),
        content_key(body).alias("content"),
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp"),
        F.array_distinct(windows).alias("shingles"),
        F.unix_millis(ts).alias("at"),
        F.col(ts),
    )
    kind = stream.schema[id].dataType.simpleString()
    return rows.groupBy("bucket").transformWithState(FirstOfBucket(live_ms, similarity), f"id {kind}, verdict string", "Append", "EventTime")
