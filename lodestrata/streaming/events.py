"""Event streams: windows with watermarks, sessions, deduplication, and upserts of micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lodestrata.operators.relations import upsert


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """events with a timestamp that a watermark can be set on."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(events: DataFrame, size: str, slide: str | None = None, by: tuple[str, ...] = (), ts: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    """Counts and sums by tumbling or sliding windows; late: how long a stream waits for late events."""
    rows = events.withWatermark(ts, late) if late else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return _sums(rows.groupBy(w, *by), by, value)


def sessions(events: DataFrame, gap: str, by: tuple[str, ...], ts: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return _sums(rows.groupBy(F.session_window(ts, gap).alias("window"), *by), by, value)


def _sums(grouped, by: tuple[str, ...], value: str) -> DataFrame:
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", "total")


def first_seen(events: DataFrame, keys: list[str], late: str, ts: str = "ts") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def running(events: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, n, total, highest) for each key in every micro-batch that has events of it: counts and sums since the stream began, kept as the key's state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def each(k: tuple, frames, state: GroupState):
        import pandas as pd

        n, total, highest = state.get if state.exists else (0, 0.0, float("-inf"))
        for frame in frames:
            n, total, highest = n + len(frame), total + float(frame[value].fillna(0).sum()), max(highest, float(frame[value].fillna(float("-inf")).max()))
        state.update((n, total, highest))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total], "highest": [highest]})

    kind = dict(events.dtypes)[key]
    return events.select(key, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(each, f"{key} {kind}, n bigint, total double, highest double", "n bigint, total double, highest double", "update", GroupStateTimeout.NoTimeout)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def idle_sessions(events: DataFrame, key: str, idle_seconds: int, late: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """(key, started, ended, n, total): of each key the stretches of events no more than idle_seconds apart, each once, when it is over: by an event that comes later than that, or by a timer when the watermark is idle_seconds past
    its last event. A stretch that is over leaves no state and no timer. Events without a time or a key have no part; null values count 0.

    Typed state of transformWithState; the session must keep state in RocksDB, which is set here where it isn't."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    spark, setting = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(setting, "") or ""):
        spark.conf.set(setting, ROCKSDB)
    kind, gap = dict(events.dtypes)[key], idle_seconds * 1000
    name = key
    ms, amount = f"{key}_{ts}_ms", f"{key}_{ts}_amount"

    class Idle(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("stretch", "started bigint, ended bigint, n bigint, total double")

        def _row(self, k, stretch) -> pd.DataFrame:
            started, ended, n, total = stretch
            return pd.DataFrame({name: [k], "started": pd.to_datetime([started], unit="ms"), "ended": pd.to_datetime([ended], unit="ms"), "n": [n], "total": [total]})

        def handleInputRows(self, key, rows, timerValues):
            now = tuple(self.state.get()) if self.state.exists() else None
            had = now[1] + gap if now else None
            listed = sorted((int(t), float(v)) for frame in rows for t, v in zip(frame[ms], frame[amount].fillna(0), strict=True))
            for t, v in listed:
                if now and t > now[1] + gap:
                    yield self._row(key[0], now)
                    now = None
                now = (min(now[0], t), max(now[1], t), now[2] + 1, now[3] + v) if now else (t, t, 1, v)
            if had is not None:
                self.handle.deleteTimer(had)
            self.handle.registerTimer(now[1] + gap)
            self.state.update(now)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.state.exists():
                now = tuple(self.state.get())
                if now[1] + gap <= expiredTimerInfo.getExpiryTimeInMs():
                    self.state.clear()
                    yield self._row(key[0], now)

        def close(self) -> None:
            pass

    rows = events.filter(F.col(ts).isNotNull() & F.col(key).isNotNull()).withWatermark(ts, late).select(key, ts, F.unix_millis(ts).alias(ms), F.col(value).cast("double").alias(amount))
    return rows.groupBy(key).transformWithStateInPandas(Idle(), f"`{key}` {kind}, started timestamp, ended timestamp, n bigint, total double", "append", "eventTime")


def upsert_stream(stream: DataFrame, read_base, write_base, keys: list[str], order: Column) -> DataStreamWriter:
    """Each micro-batch replaces the rows of its keys in a table; of repeated keys the greatest in order wins. read_base() and write_base(df) give the table's versions."""

    def apply(batch: DataFrame, _: int) -> None:
        write_base(upsert(read_base(), batch, keys, order=order))

    return stream.writeStream.foreachBatch(apply)
