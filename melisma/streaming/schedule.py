"""A station's broadcast schedule as a stateful stream operator: what the schedule needs to go on is state, and outlives the process."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from melisma.operators import recommend

#: What arrives: tracks of a station's pool (kind track: item, artist, dur_sec, weight; a weight of 0 takes a track out), links between
#: tracks (kind link: item, other, weight), and requests to have the schedule reach a time (kind extend: until_ms).
INPUT = "station string, kind string, item long, artist long, dur_sec long, weight double, other long, until_ms long"
OUTPUT = "station string, place long, item long, start_ms long, dur_sec long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Scheduler(StatefulProcessor):
    """Per station: the generator's seed, slot, clock and last track; the pool; links; and in which slot tracks and artists were played.

    Memories of tracks and artists live for `remember_ms` after their last play, so a station that falls silent begins anew.
    """

    def __init__(self, seed: int, start_ms: int, remember_ms: int | None):
        self.seed, self.start_ms, self.remember_ms = seed, start_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "seed long, slot long, place long, item long, start_ms long, dur_sec long")
        self.pool = handle.getMapState("pool", "item long", "artist long, dur_sec long, weight double")
        self.links = handle.getMapState("links", "item long, other long", "strength double")
        self.tracks = handle.getMapState("tracks", "item long", "slot long", self.remember_ms)
        self.artists = handle.getMapState("artists", "artist long", "slot long", self.remember_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        until = None
        for frame in rows:
            for r in frame[frame["kind"] == "track"].itertuples():
                if r.weight > 0:
                    self.pool.updateValue((int(r.item),), (int(r.artist), int(r.dur_sec), float(r.weight)))
                elif self.pool.containsKey((int(r.item),)):
                    self.pool.removeKey((int(r.item),))
            for r in frame[frame["kind"] == "link"].itertuples():
                self.links.updateValue((int(r.item), int(r.other)), (float(r.weight),))
            asked = frame.loc[frame["kind"] == "extend", "until_ms"]
            if len(asked):
                until = max(until or 0, int(asked.max()))
        if until is not None:
            made = self._extend(until)
            if made:
                out = pd.DataFrame(made, columns=["place", "item", "start_ms", "dur_sec"])
                out.insert(0, "station", key[0])
                yield out

    def _extend(self, until: int) -> list[tuple]:
        pool = sorted(({"item": k[0], "artist": v[0], "dur": v[1], "weight": v[2]} for k, v in self.pool.iterator()), key=lambda x: x["item"])
        near: dict = {}
        for (item, other), (strength,) in self.links.iterator():
            near.setdefault(item, {})[other] = strength
        last, place, state = [], 0, {"seed": self.seed}
        if self.clock.exists():
            seed, slot, place, item, start, dur = self.clock.get()
            last, state = [(item, start, dur)], {"seed": seed, "slot": slot}
        state["tracks"] = {k[0]: v[0] for k, v in self.tracks.iterator()}
        state["artists"] = {k[0]: v[0] for k, v in self.artists.iterator()}
        entries, after = recommend.extend(pool, near, last, state, until, self.start_ms)
        new = entries[len(last) :]
        if not new:
            return []
        for kept, old, now in ((self.tracks, state["tracks"], after["tracks"]), (self.artists, state["artists"], after["artists"])):
            for k in old.keys() - now.keys():
                kept.removeKey((k,))
            for k, slot in now.items():
                if old.get(k) != slot:
                    kept.updateValue((k,), (slot,))
        item, start, dur = new[-1]
        self.clock.update((after["seed"], after["slot"], place + len(new), item, start, dur))
        return [(place + n, int(i), int(s), int(d)) for n, (i, s, d) in enumerate(new, 1)]


def schedule(stream: DataFrame, start_ms: int, seed: int = 1, remember_ms: int | None = None) -> DataFrame:
    """The entries that each request of a stream (INPUT) adds to its station's schedule (OUTPUT).

    Tracks, links and requests of one micro-batch take effect in this order; the schedule doesn't depend on how requests are cut into
    batches, as long as tracks and links come before them. Needs the state store of with_state().
    """
    return stream.groupBy("station").transformWithStateInPandas(Scheduler(seed, start_ms, remember_ms), OUTPUT, "append", "ProcessingTime" if remember_ms else "None")


def with_state(spark: SparkSession) -> None:
    """State of several columns needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
