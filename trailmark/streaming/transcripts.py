"""Transcripts from streams of recognition events: a partial result replaces the one before, a
final one ends the transcript, and silence for longer than the gap ends it with the last partial.

Events: (key, ts, kind, text, code); kind is partial, final or error. Errors with a code of a
cancellation mean nothing; another error ends a transcript without text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import shared
from ..operators import ordered

# Codes of a cancelled recognition, and the wait for a final result.
BENIGN_CODES = [216, 301]
WAIT_MS = 1_500
OUTPUT = "key string, text string, ended_by string"


def meaningful(events: DataFrame) -> DataFrame:
    """Events without benign errors."""
    return events.where(~((F.col("kind") == "error") & F.coalesce(F.col("code").isin(BENIGN_CODES), F.lit(False))))


def sessions(events: DataFrame, gap_seconds: float, by: list[str]) -> DataFrame:
    """Events with the number of their session: a new one begins after a final event or a longer gap.

    A key of any size may span ranges of events: each range numbers its own, and the sessions before a
    border are added to those behind it.
    """
    wait, order = int(gap_seconds * 1e6), ["ts", "event_id"]
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    known = events.withColumn("_us", F.coalesce(micros, F.lit(0))).withColumn("_final", F.coalesce(F.col("kind") == "final", F.lit(False)))
    begins = lambda now, before: (now["_us"] - before["_us"] > wait) | before["_final"]
    placed = shared.written(ordered.count_begins(ordered.by_ranges(known, by, order), begins, ["_us", "_final"], "_local"), "sessions")
    last = F.max(F.struct("ts", "event_id", "_us", "_final"))
    edges = ordered.border_runs(placed, order, F.min("_us").alias("first"), last.alias("last"), F.max("_local").alias("n"))
    along = Window.partitionBy(ordered.KEY).orderBy(ordered.RANGE)  # a row a range
    before = F.lag("last").over(along)
    new = before.isNull() | (F.col("first") - before["_us"] > wait) | before["_final"]
    edges = edges.withColumn("_new", new.cast("int")).withColumn("_offset", F.sum(F.col("_new") + F.col("n")).over(along) - F.col("n"))
    offsets = F.broadcast(edges.select(ordered.RANGE, ordered.KEY, "_offset"))  # two rows a range at most
    out = placed.join(offsets, [ordered.RANGE, ordered.KEY], "left").withColumn("session", F.coalesce("_offset", F.lit(1)) + F.col("_local"))
    return out.select(*events.columns, "session")


def transcripts(events: DataFrame, gap_seconds: float, by: list[str]) -> DataFrame:
    """One row a session: the last text, and whether a final event or the wait ended it."""
    found = sessions(meaningful(events), gap_seconds, by).where("kind <> 'error'")
    last = F.max(F.struct("ts", "event_id", "kind", "text"))
    out = found.groupBy(*by, "session").agg(last.alias("l"), F.count("*").alias("n_events"))
    return out.select(*by, "session", F.col("l.text").alias("text"), F.when(F.col("l.kind") == "final", "final").otherwise("timeout").alias("ended_by"), "n_events")


def latest(events: DataFrame) -> DataFrame:
    """The transcript as it stands for each key, for update mode."""
    return events.where("kind in ('partial', 'final')").groupBy("key").agg(F.max_by("text", "ts").alias("text"))


class Finisher(StatefulProcessor):
    """Keeps a key's last partial; emits at a final event, or when the timer runs out."""

    def __init__(self, wait_ms: int = WAIT_MS):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.text = handle.getValueState("text", "text string")

    def _forget(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ended, text = None, self.text.get()[0] if self.text.exists() else None
        events = pd.concat(rows).sort_values("ts", kind="stable")
        for kind, said in zip(events["kind"], events["text"], strict=True):
            if kind == "error":
                ended, text = "error", ""
            else:
                text = said
                ended = "final" if kind == "final" else None
            if ended:
                break
        self._forget()
        if ended:
            self.text.clear()
            yield pd.DataFrame({"key": [key[0]], "text": [text], "ended_by": [ended]})
        else:
            self.text.update((text,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.text.exists():
            text = self.text.get()[0]
            self.text.clear()
            yield pd.DataFrame({"key": [key[0]], "text": [text], "ended_by": ["timeout"]})

    def close(self) -> None:
        pass


def finish(stream: DataFrame, wait_ms: int = WAIT_MS) -> DataFrame:
    """A stream of finished transcripts. Needs the RocksDB state store (see use_rocksdb)."""
    return meaningful(stream).groupBy("key").transformWithStateInPandas(Finisher(wait_ms), OUTPUT, "Append", "ProcessingTime")


_WAITING = pa.schema([("us", pa.int64()), ("event_id", pa.int64()), ("kind", pa.string()), ("text", pa.string())])


def _packed(*columns) -> tuple[bytes]:
    """Events as one row of a list state: every row of a state is a call and a record of its own."""
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, _WAITING, strict=True)], schema=_WAITING)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _WAITING) as out:
        out.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(rows) -> list[tuple]:
    return [e for (blob,) in rows for e in zip(*(c.to_pylist() for c in pa.ipc.open_stream(bytes(blob)).read_next_batch().columns), strict=True)]


class EventFinisher(StatefulProcessor):
    """Sessions of a key by event time: a final event ends one, or a gap that the next event or the watermark shows.

    Events wait until the watermark has passed them, as until then others may come before them; they
    are then taken in order. Those that come together wait as one row of the state.
    """

    def __init__(self, wait_us: int):
        self.wait_us = wait_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "session long, us long, final boolean, text string, n long")
        self.waiting = handle.getListState("waiting", "events binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            if len(part):
                self.waiting.appendValue(_packed(*(part[c] for c in _WAITING.names)))
                self.handle.registerTimer(int(part["us"].min()) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        waiting = _unpacked(self.waiting.get())
        session, us, final, text, n = self.state.get() or (0, 0, True, None, 0)
        for at, _, kind, said in sorted((e for e in waiting if e[0] <= passed), key=lambda e: e[:2]):
            if final or at - us > self.wait_us:
                if n:
                    out.append((session, text, "timeout", n))
                session, text, n = session + 1, None, 0
            us, final = at, kind == "final"
            if kind != "error":
                text, n = said, n + 1
            if final:
                out.append((session, text, "final", n))
                n = 0
        if n and passed > us + self.wait_us:
            out.append((session, text, "timeout", n))
            final, n = True, 0  # whatever comes begins another
        self.state.update((session, us, final, text, n))
        rest = [e for e in waiting if e[0] > passed]
        if rest:
            self.waiting.put([_packed(*zip(*rest, strict=True))])
        elif waiting:
            self.waiting.clear()
        if rest:
            self.handle.registerTimer(min(e[0] for e in rest) // 1000 + 1)
        if n:
            self.handle.registerTimer((us + self.wait_us) // 1000 + 1)
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["key", "session", "text", "ended_by", "n_events"])

    def close(self) -> None:
        pass


def finish_by_event_time(stream: DataFrame, gap_seconds: float, late: str = "0 seconds") -> DataFrame:
    """A stream of finished transcripts, those of transcripts(): stream(key, event_id, ts, kind, text, code).

    Events may be late by so much; a session without a final event ends once the watermark is a gap
    beyond its last event. Needs the RocksDB state store (see use_rocksdb).
    """
    seen = meaningful(stream).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    rows = seen.select(ordered.key_text(["key"]).alias("key"), "ts", "us", "event_id", "kind", "text")  # a text is never null
    out = rows.groupBy("key").transformWithStateInPandas(EventFinisher(int(gap_seconds * 1e6)), "key string, session long, text string, ended_by string, n_events long", "Append", "EventTime")
    return out.withColumn("key", F.from_json("key", "k0 string")["k0"].cast(stream.schema["key"].dataType))


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# R4: a screen's states and what events do to them; input is refused while an answer is made or spoken.
STATES = {("idle", "listen"): "listening", ("listening", "stop"): "processing", ("idle", "ask"): "processing", ("processing", "answer"): "speaking", ("processing", "fail"): "error", ("speaking", "done"): "idle", ("error", "reset"): "idle"}


def step(state: Column, event: Column) -> Column:
    """The state after an event; one that doesn't fit changes nothing."""
    out = state
    for (s, e), to in STATES.items():
        out = F.when((state == s) & (event == e), to).otherwise(out)
    return out


def final_state(events: DataFrame) -> DataFrame:
    """(key, state) after a key's events in order of ts, from idle.

    An event maps every state to another; maps are composed within ranges of a key's events first, then
    across them, so a key may have any number of events.
    """
    states = sorted({*(s for s, _ in STATES), *STATES.values()})
    kinds = sorted({e for _, e in STATES})
    table = np.array([[states.index(STATES.get((s, e), s)) for s in states] for e in [*kinds, None]], np.int32)
    maps = ordered.composed(ordered.by_ranges(events.select("key", "ts", "event"), ["key"], ["ts", "event"]), "event", table, kinds)
    along = F.sort_array(F.collect_list(F.struct(ordered.RANGE, "map")))  # a row a range
    at = F.aggregate(along, F.lit(states.index("idle")), lambda s, m: F.get(m["map"], s))
    ended = maps.groupBy(ordered.KEY).agg(F.get(F.array(*map(F.lit, states)), at).alias("state"))
    return ended.select(F.from_json(ordered.KEY, "k0 string")["k0"].cast(events.schema["key"].dataType).alias("key"), "state")
