"""Citations that wait for their document: relinked when it arrives, reported when they age, with timers in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000
CHUNK = 10_000
_OUT = "key string, ref string, cited long, outcome string, document string, at long"


class _Placeholders(StatefulProcessor):
    """State of one key: its document, if it has come, and what waits for it, by the day on which the next age is reached."""

    def __init__(self, ages: tuple[int, ...]):
        self.ages = ages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.document = handle.getValueState("document", "document string, at long")
        self.waiting = handle.getMapState("waiting", "due long, n long", "ref string, cited long, stage int")
        self.count = handle.getValueState("count", "n long")

    def _wait(self, ref: str | None, cited: int, stage: int) -> None:
        due = -(-(cited + self.ages[stage] * DAY) // DAY) * DAY  # one timer a day, however many citations
        n = self.count.get()[0] + 1 if self.count.exists() else 0
        self.count.update((n,))
        self.waiting.updateValue((due, n), (ref, cited, stage))
        self.handle.registerTimer(due)

    def _frames(self, key: str, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key, *r) for r in rows], columns=["key", "ref", "cited", "outcome", "document", "at"]).astype({"cited": "int64", "at": "int64"})

    def _some(self, until: int | None) -> list[tuple]:
        out = []
        for place, value in self.waiting.iterator():
            if until is None or place[0] <= until:
                out.append((tuple(place), tuple(value)))
                if len(out) == CHUNK:
                    break
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for is_document, value, at in pdf.sort_values(["at", "is_document"])[["is_document", "value", "at"]].itertuples(index=False):
                at = int(at)
                if not is_document:
                    if self.document.exists():
                        out.append((value, at, "resolved", self.document.get()[0], at))
                    else:
                        self._wait(value, at, 0)
                    continue
                if not self.document.exists() or self.document.get()[1] <= at:
                    self.document.update((value, at))
                while some := self._some(None):
                    for place, (ref, cited, _) in some:
                        self.waiting.removeKey(place)
                        out.append((ref, cited, "relinked", value, at))
                    yield self._frames(key[0], out)
                    out = []
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.count.clear()
            if out:
                yield self._frames(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        while some := self._some(now):
            out = []
            for place, (ref, cited, stage) in some:
                self.waiting.removeKey(place)
                out.append((ref, cited, f"aged {self.ages[stage]}", None, cited + self.ages[stage] * DAY))
                if stage + 1 < len(self.ages):
                    self._wait(ref, cited, stage + 1)
            yield self._frames(key[0], out)
        if not next(iter(self.waiting.keys()), None):
            self.count.clear()

    def close(self) -> None:
        pass


def placeholders(citations: DataFrame, documents: DataFrame, ages: tuple[int, ...] = (30, 60), late: str = "1 day") -> DataFrame:
    """(key, ref, cited_at, outcome, document, at) of streams of citations (key, ref, cited_at) and documents (key, document, arrived_at).

    A citation is ``resolved`` where its document is known, else it waits: ``relinked`` when the document arrives, and ``aged`` with the number of days each time the
    watermark has passed an age without it, to the day. What has reached the last age is handed to review and waits no more, so its state ends; an arriving document ends it too,
    and its timers. A known document stays as one row of state. Rows without a key or time are left out.

    Needs the RocksDB state store. A key's state is read and written entry by entry, so a key that many citations share does not have to fit in memory.
    """
    at = lambda df, t: df.withWatermark(t, late).filter(F.col("key").isNotNull() & F.col(t).isNotNull())
    c = at(citations, "cited_at").select("key", F.lit(False).alias("is_document"), F.col("ref").cast("string").alias("value"), F.unix_millis("cited_at").alias("at"), F.col("cited_at").alias("time"))
    d = at(documents, "arrived_at").select("key", F.lit(True).alias("is_document"), F.col("document").cast("string").alias("value"), F.unix_millis("arrived_at").alias("at"), F.col("arrived_at").alias("time"))
    out = c.unionByName(d).groupBy("key").transformWithStateInPandas(_Placeholders(ages), _OUT, "append", "EventTime")
    return out.select("key", "ref", F.timestamp_millis("cited").alias("cited_at"), "outcome", "document", F.timestamp_millis("at").alias("at"))
