"""Extensions over streams: scoring of pages as they arrive, and ordered log rules with state by id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def score_arrivals(pages: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Score each batch of arriving page pairs with the batch operators, and append the verdicts as Parquet.

    Verdicts depend on one page pair each, so no state is kept; a batch's files bear its number, so that one that runs
    again replaces its own.
    """

    def batch(rows: DataFrame, number: int) -> None:
        score(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dangling_refs(log: DataFrame) -> DataFrame:
    """(id, line) of references on a stream (id, line long, defines boolean) that come before their id's definition.

    State is one line number an id. Within a batch lines are taken in order; a line that arrives in a later batch than
    a greater one is judged by what is known then.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("line")
        bad = []
        for line, defines in zip(rows["line"], rows["defines"], strict=True):
            if defines:
                first = int(line) if first is None else min(first, int(line))
            elif first is None or first >= line:
                bad.append(int(line))
        if first is not None:
            state.update((first,))
        yield pd.DataFrame({"id": [key[0]] * len(bad), "line": bad})

    return log.groupBy("id").applyInPandasWithState(step, "id string, line long", "first long", "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, value) of tumbling windows; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(
        F.col("window.start").alias("window_start"), "event_type", "n", "value"
    )
