"""Streams: resumable judging, carried state per document, sessions (the last two go beyond batch parity)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def judge_stream(source: DataFrame, judge, path: str, key: list[str], checkpoint: str):
    """Each micro-batch's unseen rows are judged and appended once; a restart judges nothing twice."""
    from quillstone.sources.sinks import append_new

    def batch(rows: DataFrame, _: int) -> None:
        append_new(judge(rows), path, key)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def carried_state(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key, order, value, state``: the last non-null value of a key, kept across batches."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for o, v in zip(rows[order], rows[value]):
            if v is not None and v == v:
                last = v
            out.append((k[0], o, v, last))
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, order, value, "state"])

    t = {c: stream.schema[c].dataType.simpleString() for c in (key, order, value)}
    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(run, f"{key} {t[key]}, {order} {t[order]}, {value} {t[value]}, state {t[value]}", f"last {t[value]}", "append", GroupStateTimeout.NoTimeout)


def sessions(stream: DataFrame, user: str, when: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of a user less than ``gap`` apart, counted once the watermark passes."""
    return stream.withWatermark(when, late).groupBy(user, F.session_window(when, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def fresh(rows: DataFrame, fetched: str, now, hours: int = 24) -> DataFrame:
    """Cached rows not older than a day."""
    return rows.where(F.col(fetched) >= F.lit(now) - F.expr(f"interval {hours} hours"))
