"""Counts of rows and bytes by stage, taken while a plan or a stream runs: no second pass over the data."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Before a stage's name in a stream's metrics.
PREFIX = "stage "


def _bytes(df: DataFrame) -> Column:
    """Bytes of the text and binary columns of a row."""
    text = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    return sum(text, F.lit(0)).cast("long")


def _metrics(df: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_bytes(df)), F.lit(0)).alias("bytes")]


class Counters:
    """Of a batch: wrap what a stage gives in counted(); counts() has the figures once an action has run over it."""

    def __init__(self):
        self._seen: dict[str, Observation] = {}

    def counted(self, df: DataFrame, stage: str) -> DataFrame:
        self._seen[stage] = Observation(f"{PREFIX}{stage}")
        return df.observe(self._seen[stage], *_metrics(df))

    def counts(self) -> dict[str, dict[str, int]]:
        """stage to rows and bytes; waits for an action over each stage."""
        return {k: {m: int(v) for m, v in o.get.items()} for k, o in self._seen.items()}


def observed(stream: DataFrame, stage: str) -> DataFrame:
    """A stream whose rows and bytes are counted, batch by batch, for a Heartbeat."""
    return stream.observe(f"{PREFIX}{stage}", *_metrics(stream))


class Heartbeat(StreamingQueryListener):
    """Counts of the streams of a session, and a sign of life for each batch.

    say: called with (query, stage, rows so far, bytes so far, seconds since the query began); a query that waits for rows says so once
    its source has been idle, with the stage None. Add it by spark.streams.addListener().
    """

    def __init__(self, say: Callable[..., None] | None = None):
        self.say, self.totals, self._began = say, {}, {}

    def _tell(self, query: str, stage: str | None, rows: int, size: int) -> None:
        if self.say:
            self.say(query, stage, rows, size, time.monotonic() - self._began.get(query, time.monotonic()))

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._began[str(event.id)] = time.monotonic()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        query = str(event.progress.id)
        for name, row in (event.progress.observedMetrics or {}).items():
            if name.startswith(PREFIX):
                key = (query, name.removeprefix(PREFIX))
                rows, size = self.totals.get(key, (0, 0))
                self.totals[key] = (rows + row["rows"], size + row["bytes"])
                self._tell(query, key[1], *self.totals[key])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        own = [v for (q, _), v in self.totals.items() if q == str(event.id)]
        self._tell(str(event.id), None, sum(r for r, _ in own), sum(s for _, s in own))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._began.pop(str(event.id), None)

    def counts(self, query: str | None = None) -> dict[str, tuple[int, int]]:
        """stage to (rows, bytes), of one query or of all."""
        out: dict[str, tuple[int, int]] = {}
        for (q, stage), (rows, size) in self.totals.items():
            if query in (None, q):
                r, s = out.get(stage, (0, 0))
                out[stage] = (r + rows, s + size)
        return out
