"""Streaming: flows by event-time timers, windowed rollups with watermarks, suppression with keyed state, an append-only sink."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOW_SCHEMA = "src string, dst string, start_time double, last_time double, packet_count long, total_bytes double, tcp_flags_seen int, is_idle_expired boolean, is_active_expired boolean"
_STATE = "start double, last double, n long, bytes double, flags int"


def assemble_flows(packets: DataFrame, idle: float, active: float, lateness: str = "10 seconds") -> DataFrame:
    """packets: src, dst (strings), ts (double), event_time (timestamp), packet_len (double), tcp_flags. A flow ends at a gap of idle,
    at the age active, or when the watermark is past its last packet by idle. Packets later than `lateness` are dropped by Spark,
    which counts them in its progress reports."""

    def close(key: tuple, s: list, idle_end: bool, active_end: bool) -> tuple:
        return (key[0], key[1], s[0], s[1], s[2], s[3], s[4], idle_end, active_end)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        s = list(state.get) if state.exists else None
        if state.hasTimedOut:
            if s:
                out.append(close(key, s, True, False))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
            for ts, size, flags in zip(rows["ts"], rows["packet_len"], rows["tcp_flags"]):
                if s and ts - s[1] >= idle:
                    out.append(close(key, s, True, False))
                    s = None
                elif s and ts - s[0] >= active:
                    out.append(close(key, s, False, True))
                    s = None
                s = [ts, ts, 1, float(size), int(flags)] if s is None else [s[0], max(s[1], ts), s[2] + 1, s[3] + float(size), s[4] | int(flags)]
            state.update(tuple(s))
            state.setTimeoutTimestamp(max(int((s[1] + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        names = [c.strip().split(" ")[0] for c in FLOW_SCHEMA.split(",")]
        yield pd.DataFrame(out, columns=names)

    from pyspark.sql.streaming.state import GroupStateTimeout

    marked = packets.withWatermark("event_time", lateness)
    return marked.groupBy("src", "dst").applyInPandasWithState(step, FLOW_SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_rollup(packets: DataFrame, width: str, lateness: str, keys: list[str]) -> DataFrame:
    """Tumbling windows of packets per key, given out when the watermark has passed them."""
    return packets.withWatermark("event_time", lateness).groupBy(F.window("event_time", width), *keys).agg(F.count(F.lit(1)).alias("packets"), F.sum("packet_len").alias("bytes")).select(F.col("window.start").alias("start"), *keys, "packets", "bytes")


def suppress_hits(hits: DataFrame, quiet: float, lateness: str = "10 seconds") -> DataFrame:
    """hits: detector, entity, ts, event_time. Those at least `quiet` after the last one kept of their key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        kept = []
        for ts in sorted(pd.concat(list(batches))["ts"]):
            if last is None or ts - last >= quiet:
                last = ts
                kept.append((*key, ts))
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + quiet) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(kept, columns=["detector", "entity", "ts"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return hits.withWatermark("event_time", lateness).groupBy("detector", "entity").applyInPandasWithState(step, "detector string, entity string, ts double", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def append_alerts(alerts: DataFrame, path: str, checkpoint: str, id_column: str = "alert_id"):
    """Start writing alerts to a Parquet log, in a folder per batch. An id is written once: those that earlier batches have, or that come
    twice, are left out. A batch that is run again replaces its own rows and looks at those before it only."""

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([id_column])
        if number:
            try:
                known = batch.sparkSession.read.parquet(path).filter(F.col("batch") < number).select(id_column)
                fresh = fresh.join(known, id_column, "left_anti")
            except AnalysisException as e:  # no batch before had a row
                if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
        fresh.select(batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def rates(progress: list[dict]) -> dict[str, float | None]:
    """Rows per second and batch-time percentiles of a query's recent progress reports; null without any."""
    if not progress:
        return {"rows_per_second": None, "p50_ms": None, "p95_ms": None, "p99_ms": None}
    times = pd.Series([p["durationMs"].get("triggerExecution", 0) for p in progress])
    seconds = max(1e-3, times.sum() / 1000)
    return {"rows_per_second": sum(p["numInputRows"] for p in progress) / seconds} | {f"p{q}_ms": float(times.quantile(q / 100)) for q in (50, 95, 99)}
