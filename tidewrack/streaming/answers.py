"""Streamed model answers put together as their lines come, each with a deadline of wall-clock time.

State is kept by answer: the pieces so far, and that it has been given out. An answer is given out once: when its last line
comes, when a line comes that is later than the deadline, or when its timer fires at the deadline, without a further line.

Defined cases: pieces are in order of ord, whatever order their lines come in; lines after an answer has been given out change
nothing (for FORGET, then it would be a new answer); the deadline counts from `asked`, or from the first line where that is null;
an answer without text is empty, but late if its time is up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import columns as C
from ..sources import chunks

#: Milliseconds after which it is forgotten that an answer was given out.
FORGET = 24 * 3600 * 1000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "answer string, text string, status string"
# What ends an answer, in each dialect.
LAST = {"choices": ("data:", "[DONE]"), "blocks": ("data:", '"message_stop"')}


class _Answers(StatefulProcessor):
    def __init__(self, deadline: float):
        self.deadline = deadline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "ord long, piece string")
        self.given = handle.getValueState("given", "yes boolean", FORGET)
        self.due = handle.getValueState("due", "at long")

    def _give(self, key, late: bool) -> Iterator[pd.DataFrame]:
        text = "".join(p for _, p in sorted(tuple(x) for x in self.pieces.get()))
        self.pieces.clear()
        self.given.update((True,))
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        yield pd.DataFrame({"answer": [key[0]], "text": [text], "status": ["late" if late else "ok" if text else "empty"]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        late = done = False
        got, asked = [], None
        for pdf in rows:
            for o, piece, last, ms, seconds in zip(pdf["ord"], pdf["piece"], pdf["last"], pdf["asked"], pdf["seconds"], strict=True):
                if isinstance(piece, str):
                    got.append((int(o), piece))
                done, late = done or bool(last), late or seconds > self.deadline
                asked = int(ms) if asked is None and ms == ms and ms is not None else asked
        if self.given.exists():
            return
        for x in got:
            self.pieces.appendValue(x)
        now = timerValues.getCurrentProcessingTimeInMs()
        if done or late:
            yield from self._give(key, late)
        elif not self.due.exists():
            at = (now if asked is None else asked) + int(self.deadline * 1000)
            if at <= now:
                yield from self._give(key, True)
            else:
                self.due.update((at,))
                self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.given.exists():
            self.due.clear()
            yield from self._give(key, True)

    def close(self) -> None:
        pass


def fold_stream(lines: DataFrame, dialect: str, deadline: float) -> DataFrame:
    """answer, text, status (ok, empty, late) of a stream of lines: answer, ord, line, seconds (since the answer was asked for; null: in time) and asked
    (timestamp). The session's state store must be RocksDB (PROVIDER, ROCKSDB)."""
    start, end = LAST[dialect]
    t = C.strip(F.col("line"))
    d = lines.select(
        F.col("answer").cast("string").alias("answer"), F.col("ord").cast("long").alias("ord"), chunks.piece(F.col("line"), dialect).alias("piece"),
        F.coalesce(t.startswith(start) & t.contains(end), F.lit(False)).alias("last"), F.unix_millis("asked").alias("asked"), F.coalesce(F.col("seconds").cast("double"), F.lit(0.0)).alias("seconds"),
    )
    return d.groupBy("answer").transformWithStateInPandas(_Answers(deadline), OUT, "Append", "ProcessingTime")
