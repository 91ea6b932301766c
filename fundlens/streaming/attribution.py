"""Campaign attribution as keyed state: one record a visitor, which ends with its lifetime."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import urls as L
from ..operators import web as W
from ..session import package_on_workers

_NAMES = L.ATTRIBUTION_PARAMS
_PARAMS = ", ".join(f"{n} string" for n in _NAMES)
_VALUES = [StructField(n, StringType()) for n in _NAMES]  # state schemas, which workers build without a session
_RECORD = StructType([StructField("at", LongType()), *_VALUES])
_VISIT = StructType([StructField("at", LongType()), StructField("visit_id", LongType()), *_VALUES])
_RESOLVED = f"visitor_id bigint, visit_id bigint, at bigint, origin string, {_PARAMS}"
OUTPUT = f"visitor_id bigint, visit_id bigint, ts timestamp, origin string, {_PARAMS}"
LIFE_MICROS = W.ATTRIBUTION_DAYS * 86_400_000_000


def _hour_after(micros: int) -> int:
    """The end of its hour in milliseconds."""
    return -(-micros // 3_600_000_000) * 3_600_000


class AttributionState(StatefulProcessor):
    """Visits wait until the watermark has passed them and are then resolved in order, so the order of arrival does not
    matter. The earliest that waits has a timer; the call that it makes resolves all that the watermark has passed and
    sets the next one, so the calls go by visitors and batches, not by visits. A timer clears the record when its 30 days
    are over; a visitor without one holds no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _VISIT)
        self.record = handle.getValueState("record", _RECORD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        visits = [(row["at"], row["visit_id"], *(row[n] for n in _NAMES)) for row in rows]
        self.waiting.appendList(visits)
        self.handle.registerTimer(_hour_after(min(v[0] for v in visits)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        visits = [tuple(v) for v in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((v for v in visits if v[0] <= passed), key=lambda v: v[:2])
        at, values = (None, ()) if not self.record.exists() else ((r := self.record.get())[0], r[1:])
        out, last = [], at
        for moment, visit, *own in ready:
            alive = at is not None and moment < at + LIFE_MICROS
            known = values if alive else (None,) * len(_NAMES)
            explicit = any(v is not None for v in own)
            if explicit:
                at, values = moment, tuple(o if o is not None else k for o, k in zip(own, known))
                known = values
            origin = "url" if explicit else "stored" if alive else "none"
            out.append(Row(visitor_id=key[0], visit_id=visit, at=moment, origin=origin, **dict(zip(_NAMES, known))))
        if ready:
            rest = [v for v in visits if v[0] > passed]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(_hour_after(min(v[0] for v in rest)))  # later than the watermark
            else:
                self.waiting.clear()
        if at is not None and at + LIFE_MICROS <= passed:
            self.record.clear()  # visits that still wait are later than its end
        elif at != last:
            self.record.update((at, *values))
            self.handle.registerTimer(_hour_after(at + LIFE_MICROS))
        return iter(out)

    def close(self) -> None:
        pass


def attribution_stream(visits: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Attribution of a stream of visits (visitor_id, visit_id, ts, url), equal to ``resolve_attribution`` for visits
    that come within ``delay`` of the newest one; later ones are dropped with the watermark.

    The state of a visitor is one record and the visits of the last ``delay``. Needs the RocksDB state store
    (``use_rocksdb``).
    """
    package_on_workers(visits.sparkSession)
    parsed = W.visit_params(visits.filter(F.col("visitor_id").isNotNull())).drop("url")
    timed = parsed.withWatermark("ts", delay).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    resolved = timed.groupBy("visitor_id").transformWithState(
        statefulProcessor=AttributionState(), outputStructType=StructType.fromDDL(_RESOLVED), outputMode="Append", timeMode="EventTime")
    return resolved.select("visitor_id", "visit_id", F.timestamp_micros("at").alias("ts"), "origin", *_NAMES)


def use_rocksdb(spark: SparkSession) -> None:
    """State on the executors' disks with checkpoints in the shared folder, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
