"""Jumps of trackers over a stream of frames, with keyed state.

The state of a tracker (an episode's hand) is what is left to compare with: of each unbroken run of frame numbers seen so far its
two ends.  A frame is compared with its neighbours when the later of the two arrives, so the events are the same however the
frames are cut into batches and in whatever order they come.  Trackers share the keys of the state by a hash: a fleet has far
more trackers than a batch should have calls, and a call goes over all trackers of a key at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "trackers binary"
EVENTS = "tracker string, frame long, hits array<string>, xyz_step double, xyz_hit boolean"
#: Fixed value: rows of one key that are held before they are compared, unless its state is longer.
HELD = 65_536


def advance(runs: tuple, frames: np.ndarray, values: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray]:
    """The runs (lo, hi, first, last) after frames with their values (a row each), and the steps this completes: the later
    frame's number and the absolute differences.  Of a frame that comes again the first one counts."""
    lo, hi, first, last = runs
    frames, at = np.unique(frames, return_index=True)
    values = values[at]
    run = np.searchsorted(lo, frames, side="right") - 1
    new = ~((run >= 0) & (frames <= hi[run])) if len(lo) else np.ones(len(frames), bool)
    # points: the ends of the runs, then the new frames; a run of one frame has one end
    wide = hi > lo
    number = np.concatenate([lo, hi[wide], frames[new]])
    value = np.vstack([first, last[wide], values[new]])
    known = np.arange(len(number)) < len(lo) + wide.sum()
    order = np.argsort(number, kind="stable")
    number, value, known = number[order], value[order], known[order]
    near = (np.diff(number) == 1) & ~(known[1:] & known[:-1])
    later = np.flatnonzero(near) + 1
    steps = np.abs(value[later] - value[later - 1])
    # a point goes on with the one before it if they are neighbours or the ends of one run
    on = np.diff(number) == 1
    on |= known[1:] & known[:-1] & np.isin(number[:-1], lo[wide])
    begins = np.concatenate([[True], ~on]) if len(number) else np.zeros(0, bool)
    ends = np.concatenate([~on, [True]]) if len(number) else np.zeros(0, bool)
    return (number[begins], number[ends], value[begins], value[ends]), number[later], steps


def places(owner: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place for each pair of an owner and a number, in their order: places follow each other directly where the numbers of
    one owner do, and nowhere else.  Also the places in order and where each is among the pairs."""
    order = np.lexsort((number, owner))
    o, n = owner[order], number[order]
    same = o[1:] == o[:-1]
    steps = np.where(same & (n[1:] == n[:-1]), 0, np.where(same & (n[1:] - 1 == n[:-1]), 1, 2))
    ranked = np.concatenate([np.zeros(min(len(o), 1), np.int64), np.cumsum(steps)])
    place = np.empty(len(order), np.int64)
    place[order] = ranked
    return place, ranked, order


class Trackers:
    """Many trackers: their names, the newest time of each, and the runs of all, by tracker and frame number."""

    def __init__(self, axes: int):
        self.names, self.newest, self.owner = np.empty(0, object), np.empty(0, np.int64), np.empty(0, np.int64)
        self.runs = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, axes)), np.empty((0, axes)))

    def pack(self) -> bytes:
        return pickle.dumps((self.names.tolist(), self.newest, self.owner.astype(np.int32), self.runs), protocol=5)

    def unpack(self, data: bytes) -> Trackers:
        names, self.newest, owner, self.runs = pickle.loads(data)
        self.names, self.owner = np.array(names, object), owner.astype(np.int64)
        return self

    def forget(self, before: int) -> None:
        """Drop the trackers whose newest frame is older."""
        live = self.newest >= before
        if not live.all():
            keep = live[self.owner]
            self.owner = (np.cumsum(live) - 1)[self.owner[keep]]
            self.names, self.newest, self.runs = self.names[live], self.newest[live], tuple(x[keep] for x in self.runs)

    def advance(self, names: np.ndarray, ms: np.ndarray, frames: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take frames in; the steps that this completes: tracker's name, the later frame's number, the absolute differences."""
        known, n = len(self.names), len(self.owner)
        code, self.names = pd.factorize(np.concatenate([self.names, names]))
        own = code[known:].astype(np.int64)
        self.newest = np.concatenate([self.newest, np.full(len(self.names) - known, np.iinfo(np.int64).min)])
        np.maximum.at(self.newest, own, ms)
        owner, number = np.concatenate([self.owner, self.owner, own]), np.concatenate([*self.runs[:2], frames])
        place, ranked, order = places(owner, number)
        (lo, hi, first, last), at, steps = advance((place[:n], place[n : 2 * n], *self.runs[2:]), place[2 * n :], values)
        pair = lambda p: order[np.searchsorted(ranked, p)]
        begin, later = pair(lo), pair(at)
        self.owner, self.runs = owner[begin], (number[begin], number[pair(hi)], first, last)
        return self.names[owner[later]], number[later], steps


def track(frames: DataFrame, axis_limits: dict[str, float], norm_limit: float, time: str | None = None, expiry: str = "6 hours", keys: int = 1024) -> DataFrame:
    """A stream of frames (episode long, frame long, hand string and one double column an axis) as a stream of jumps: episode,
    hand, frame, hits, xyz_step, xyz_hit, the rows that trajectory.tracker_jumps gives for the whole table.

    Steps are between consecutive frame numbers.  Frames without a number or an axis's value don't count.  Without gaps a
    tracker's state is two frames, with gaps two a run.  Where frames have a time, a column of timestamps, those that lie the
    time of expiry behind the newest frame of all trackers are too late, and a tracker without newer ones is forgotten; without
    it, none is.  The state has this many keys, as long as a checkpoint lives; one task holds the trackers of one key at a time.
    """
    axes = list(axis_limits)
    limits = np.array([axis_limits[a] for a in axes], float)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        trackers, waiting = Trackers(len(axes)), []
        if state.exists:
            trackers.unpack(state.get[0])
        if time is not None:
            trackers.forget(state.getCurrentWatermarkMs() - 1)

        def compare() -> Iterator[pd.DataFrame]:
            pdf = pd.concat(waiting, ignore_index=True)
            waiting.clear()
            names, at, steps = trackers.advance(pdf["tracker"].to_numpy(object), pdf["ms"].to_numpy(np.int64), pdf["frame"].to_numpy(np.int64), pdf[axes].to_numpy(float))
            norm = np.sqrt((steps**2).sum(axis=1))
            hit = (steps >= limits).any(axis=1) | (norm >= norm_limit)
            hits = [[a for a, over in zip(axes, row, strict=True) if over] for row in steps[hit] >= limits]
            if hit.any():
                yield pd.DataFrame({"tracker": names[hit], "frame": at[hit], "hits": hits, "xyz_step": norm[hit], "xyz_hit": norm[hit] >= norm_limit})

        for pdf in batches:
            waiting.append(pdf)
            # as many new rows as old runs, so that going over these adds no more than the rows' own work
            if sum(map(len, waiting)) >= max(HELD, len(trackers.owner)):
                yield from compare()
        if waiting:
            yield from compare()
        state.update((trackers.pack(),))
        if time is not None:
            state.setTimeoutTimestamp(max(int(trackers.newest.max(initial=0)), state.getCurrentWatermarkMs()) + 1)

    if time is not None:
        frames = frames.where(F.col(time).isNotNull()).withWatermark(time, expiry)
    ms = F.unix_millis(time) if time is not None else F.lit(0).cast("long")
    # one text for both parts of a tracker's name, whichever of them is null
    tracker = F.to_json(F.struct(F.col("episode").cast("long").alias("episode"), F.col("hand").cast("string").alias("hand")))
    rows = frames.select(*([time] if time is not None else []), ms.alias("ms"), tracker.alias("tracker"), F.col("frame").cast("long").alias("frame"), *[F.col(a).cast("double").alias(a) for a in axes]).dropna(subset=["frame", *axes])
    keyed = rows.withColumn("key", F.pmod(F.xxhash64("tracker"), F.lit(keys))).groupBy("key")
    jumps = keyed.applyInPandasWithState(follow, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout if time is None else GroupStateTimeout.EventTimeTimeout)
    return jumps.select(F.from_json("tracker", "episode long, hand string").alias("t"), "*").select("t.*", *[c.split()[0] for c in EVENTS.split(", ")[1:]])
