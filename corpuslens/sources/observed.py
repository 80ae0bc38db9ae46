"""Counts that come from the job that writes, not from a second pass over the data.

Spark adds the counts up while rows pass by on their way to the table, and the driver receives one row of numbers. A
task that is repeated counts once. In a stream every micro-batch reports its own numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from corpuslens.sources.store import write_table


def outcome_counts(outcome: str, outcomes: list[str]) -> dict[str, Column]:
    """Rows, rows of each outcome, and rows whose outcome is none of them (null included)."""
    counts = {o: F.count_if(F.col(outcome) == o) for o in outcomes}
    other = ~F.coalesce(F.col(outcome).isin(outcomes), F.lit(False))
    return {"rows": F.count(F.lit(1)), **counts, "other": F.count_if(other)}


def dimension_counts(vector: str, expected: int) -> dict[str, Column]:
    """Rows, rows without a vector, vectors of another length than expected, shortest and longest (null: none)."""
    size = F.when(F.col(vector).isNotNull(), F.size(vector))
    return {"rows": F.count(F.lit(1)), "missing": F.count_if(F.col(vector).isNull()),
            "mismatched": F.count_if(size != expected), "shortest": F.min(size), "longest": F.max(size)}


def write_observed(df: DataFrame, name: str, counts: dict[str, Column],
                   write: Callable[[DataFrame], Any] | None = None) -> tuple[Any, dict[str, Any]]:
    """(what ``write`` returns, the counts over all written rows); the default writes a table ``name`` of the work folder.

    ``write`` must run its one job over the whole frame it is given.
    """
    seen = Observation(name)
    watched = df.observe(seen, *[c.alias(n) for n, c in counts.items()])
    out = write(watched) if write else write_table(watched, name)
    return out, seen.get


def observe_stream(stream: DataFrame, name: str, counts: dict[str, Column]) -> DataFrame:
    """``stream`` with counts for each micro-batch, which a ``BatchCounts`` listener of that name receives."""
    return stream.observe(name, *[c.alias(n) for n, c in counts.items()])


class BatchCounts(StreamingQueryListener):
    """Hands ``each(batch_id, counts)`` the counts ``name`` of every micro-batch.

    Add it to ``spark.streams`` before the query starts. A batch that Spark repeats after a restart is reported again
    under the same number, so keep the newest of a number.
    """

    def __init__(self, name: str, each: Callable[[int, dict[str, Any]], None]):
        self.name, self.each = name, each

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.each(event.progress.batchId, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
