"""Reviewer feedback as a stateful stream: links and rejections that wait are kept as state, feedback acts as it comes.

Links are dealt by hash into ``SLOTS`` groups. A group reads its state once in a batch, changes it row by row and writes it
once: calls of the state, batches of output and timers grow with the slots, not with the links.

The batch form is ``operators.feedback.process``; after all rows both have closed the same links and queued the same
sources. Feedback may come before its link: it waits in the slot's state, and a timer reports it as ``unknown`` when the
link has not come within ``patience`` of event time.

Defined results: the first rejection of a current link closes it, others change nothing; rows without a link id are left
out; feedback other than ``rejected`` is counted as handled; a link that comes again while it is known is ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

INPUT = "link_id string, kind string, at timestamp, source_id string, source_type string, target_type string, is_current boolean, signal string"
OUTPUT = "link_id string, action string, entity_id string, entity_type string, target_type string"
#: Part of the state's form: another number needs a new checkpoint. A batch reads the slots it touches whole.
SLOTS = 4096
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
#: Times that pandas can hold: those before and after count as these for the watermark.
_FIRST, _LAST = "1678-01-01 00:00:00Z", "2262-01-01 00:00:00Z"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(links: DataFrame, feedback: DataFrame) -> DataFrame:
    """Links (link_id, source_id, source_type, target_type, is_current, created_at) and feedback (link_id, signal, created_at) as one input."""
    one = links.selectExpr("link_id", "'link' AS kind", "created_at AS at", "source_id", "source_type", "target_type", "is_current", "CAST(NULL AS string) AS signal")
    none = [f"CAST(NULL AS {t}) AS {c}" for c, t in (("source_id", "string"), ("source_type", "string"), ("target_type", "string"), ("is_current", "boolean"))]
    return one.unionByName(feedback.selectExpr("link_id", "'feedback' AS kind", "created_at AS at", *none, "signal"))


def _read(state) -> dict:
    held = state.get()
    return json.loads(held[0]) if held else {}


def _text(held: dict) -> str:
    return json.dumps(held, separators=(",", ":"))


def _actions(idents: list[str], action: str, closed: list[tuple[str, str]]) -> pd.DataFrame:
    """Rows of ``OUTPUT``: these links with the action and without a source, then those closed."""
    none = [None] * len(idents)
    ends = zip(*(json.loads(text) for _, text in closed), strict=True) if closed else ((), (), ())
    columns = [idents + [i for i, _ in closed], [action] * len(idents) + ["closed"] * len(closed), *(none + list(c) for c in ends)]
    return pd.DataFrame(dict(zip(_COLUMNS, columns, strict=True)), dtype=object)


class Feedback(StatefulProcessor):
    """State of a slot: its links, rejections that wait for theirs, and when the first of these is due.

    ``links`` is a JSON object from link_id to the text of [source_id, source_type, target_type], or to null once a link cannot
    be closed any more; ``waiting`` one from link_id to [rejected, due].
    """

    def __init__(self, patience_ms: int) -> None:
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.links, self.waiting = handle.getValueState("links", "links string"), handle.getValueState("waiting", "waiting string")
        self.alarm = handle.getValueState("alarm", "due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Rows are (link_id, what, ms): ``what`` is ``rejected`` or ``noted`` of feedback, ``shut`` or the text to keep of a link, empty of other rows."""
        now = timerValues.getCurrentWatermarkInMs()
        links, waiting = _read(self.links), _read(self.waiting)
        waited, links_changed, waiting_changed, fresh = bool(waiting), False, False, {}
        for frame in rows:
            handled, closed = [], []
            for ident, what, ms in zip(frame["link_id"].tolist(), frame["what"].tolist(), frame["ms"].tolist(), strict=True):
                rejected = what == "rejected"
                if rejected or what == "noted":
                    handled.append(ident)
                elif what and ident not in links:
                    links[ident], links_changed = None if what == "shut" else what, True
                    fresh.pop(ident, None)
                    if ident in waiting:
                        rejected, waiting_changed = waiting.pop(ident)[0], True
                if ident in links:
                    if rejected and links[ident] is not None:
                        closed.append((ident, links[ident]))
                        links[ident], links_changed = None, True
                    continue
                before, due = waiting.get(ident), max(ms, now) + self.patience
                if before is None or ident in fresh:
                    due = fresh[ident] = max(due, fresh.get(ident, due))
                else:
                    due = before[1]
                waiting[ident], waiting_changed = (rejected or bool(before and before[0]), due), True
            if handled or closed:
                yield _actions(handled, "handled", closed)
        if links_changed:
            self.links.update((_text(links),))
        if waiting_changed:
            self._keep(waiting, waited)
        if fresh:
            self._wake(min(fresh.values()))

    def _keep(self, waiting: dict, waited: bool) -> None:
        if waiting:
            self.waiting.update((_text(waiting),))
        elif waited:
            self.waiting.clear()

    def _wake(self, due: int) -> None:
        """A timer at ``due``, unless one comes before it."""
        if not self.alarm.exists() or due < self.alarm.get()[0]:
            self.handle.registerTimer(due)
            self.alarm.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        if not self.alarm.exists() or self.alarm.get()[0] > reached:
            return
        self.alarm.clear()
        waiting = _read(self.waiting)
        over = [ident for ident, (_, due) in waiting.items() if due <= reached]
        for ident in over:
            del waiting[ident]
        if over:
            self._keep(waiting, True)
            yield _actions(over, "unknown", [])
        if waiting:
            self._wake(min(due for _, due in waiting.values()))

    def close(self) -> None:
        pass


def actions(stream: DataFrame, late: str = "1 day", patience: str = "7 days") -> DataFrame:
    """(link_id, action, entity_id, entity_type, target_type): ``handled``, ``closed`` (its source is queued again), ``unknown``.

    The state store must be RocksDB: this sets it in the session where the default is still set.
    """
    spark = stream.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    wait = int(spark.sql(f"SELECT CAST(unix_millis(timestamp_seconds(0) + INTERVAL {patience}) AS long)").first()[0])
    seen = F.expr(f"CASE WHEN at < TIMESTAMP'{_FIRST}' THEN TIMESTAMP'{_FIRST}' WHEN at > TIMESTAMP'{_LAST}' THEN TIMESTAMP'{_LAST}' ELSE at END")
    kept = "to_json(array(source_id, source_type, target_type))"
    what = F.expr(f"CASE kind WHEN 'link' THEN IF(is_current, {kept}, 'shut') WHEN 'feedback' THEN IF(signal = 'rejected', 'rejected', 'noted') ELSE '' END")
    slot, ms = F.pmod(F.hash("link_id"), F.lit(SLOTS)), F.expr("coalesce(unix_millis(at), 0)")
    rows = stream.where(F.col("link_id").isNotNull()).select(slot.alias("slot"), "link_id", what.alias("what"), ms.alias("ms"), seen.alias("at"))
    return rows.withWatermark("at", late).groupBy("slot").transformWithStateInPandas(Feedback(wait), OUTPUT, "append", "eventTime")
