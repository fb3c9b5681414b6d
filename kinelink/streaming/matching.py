"""Causal matching and filters on streams, with the decision rules of the batch operators."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kinelink.operators.assignment import hungarian, solve_each
from kinelink.operators.grouped import madgwick_step


def update_history(history: dict[str, list[float]], scores: dict[str, list[float]], decay: float, threshold: float, keep_low: bool) -> None:
    """One window's evidence: a new track starts with its scores; a known one is passed over up to the threshold of confidence."""
    for track, now in scores.items():
        ordered = sorted(now)
        confidence = ordered[-1] - ordered[-2] if len(now) > 1 else abs(now[0])
        if track not in history:
            history[track] = list(now)
        elif not (keep_low and confidence <= threshold):
            history[track] = [(1 - decay) * h + s for h, s in zip(history[track], now)]


def decide(evidence: list[np.ndarray]) -> list[np.ndarray]:
    """The best assignment of each window, from its evidence by sensor and active track: a track's place for every sensor, -1 for none. All windows are solved together."""
    if not all(np.isfinite(m).all() for m in evidence):
        return [hungarian(m) for m in evidence]
    sizes = np.array([m.size for m in evidence])
    taken = solve_each(np.concatenate([m.ravel() for m in evidence]), sizes, np.array([m.shape[1] for m in evidence]), "hungarian")
    return np.split(taken, np.cumsum([len(m) for m in evidence])[:-1])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_processor(grouped: GroupedData, processor: StatefulProcessor, schema: str) -> DataFrame:
    """The processor's rows for each key, on event time; its kinds of state need the RocksDB store, which is set for the session."""
    grouped.session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return grouped.transformWithState(processor, schema, "append", "eventTime")


#: Rows of a key that share one entry of its state, and windows that share one emitted row.
BLOCK = 4096


class _Waiting(StatefulProcessor):
    """Rows of a key that wait in a list until the watermark reaches them, and one timer: at the first of them, or where the key is idle.

    An entry of the list holds up to `BLOCK` rows of one batch, column by column. A subclass says what becomes of rows that are due
    (`pass_on`, in order of time) and which other state goes with an idle key (`forget`). A key is idle when the watermark has moved
    on by `idle_ms` since its last rows passed and none waits.
    """

    def __init__(self, columns: str, idle_ms: int):
        self.columns, self.idle_ms = [tuple(c.split(" ", 1)) for c in ("at_ms long", *columns.split(", "))], idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{name} array<{kind}>" for name, kind in self.columns))
        self.timer = handle.getValueState("timer", "at_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        new = (tuple(r[name] for name, _ in self.columns) for r in rows)
        while block := list(islice(new, BLOCK)):
            self.waiting.appendList(_entries(block))
            first = min(r[0] for r in block) if first is None else min(first, *(r[0] for r in block))
        if first is not None:
            set_to = self.timer.get()
            if set_to is None or first < set_to[0]:
                self.set_timer(first)
        return iter(())

    def set_timer(self, at: int | None) -> None:
        """One timer at a time: the old one goes."""
        old = self.timer.get()
        if old is not None:
            self.handle.deleteTimer(old[0])
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        every = [r for entry in self.waiting.get() for r in zip(*entry)] if self.waiting.exists() else []
        due, rest = [r for r in every if r[0] <= mark], [r for r in every if r[0] > mark]
        out = self.pass_on(key, sorted(due, key=lambda r: r[0])) if due else []
        if rest:
            self.waiting.put(_entries(rest))
        elif due:
            self.waiting.clear()
        else:
            self.forget()
        self.set_timer(min(r[0] for r in rest) if rest else mark + self.idle_ms if due else None)
        return iter(out)

    def close(self) -> None:
        pass


def _entries(rows: list[tuple]) -> list[tuple]:
    """Entries of the list of waiting rows."""
    return [tuple(map(list, zip(*rows[i : i + BLOCK]))) for i in range(0, len(rows), BLOCK)]


_DECISIONS = "session string, names array<string>, window_end_ms array<long>, imu_idx array<long>, place array<int>, accumulated array<double>"


class _Matcher(_Waiting):
    """Evidence by track in a map: a batch reads a session's tracks once and writes those that its windows touched.

    A row's cells come and wait as JSON, which is one value instead of three for each cell; an emitted row has the decisions of up to `BLOCK` windows.
    """

    def __init__(self, idle_ms: int, decay: float, threshold: float, keep_low: bool):
        super().__init__("cells string", idle_ms)
        self.rule = decay, threshold, keep_low

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.history = handle.getMapState("history", "track string", "evidence array<double>")

    def pass_on(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        known = {k[0]: list(v[0]) for k, v in self.history.iterator()} if self.history.exists() else {}
        touched, windows, out = set(), [], []
        for end, pieces in groupby(rows, key=lambda r: r[0]):
            now = window_scores([c for _, text in pieces for c in zip(*json.loads(text).values())])
            update_history(known, now, *self.rule)
            touched |= now.keys()
            tracks = sorted(now)
            windows.append((end, tracks, np.array([known[t] for t in tracks], float).T))
            if len(windows) == BLOCK:
                out.append(_decided(key[0], windows))
                windows = []
        if windows:
            out.append(_decided(key[0], windows))
        for track in touched:
            self.history.updateValue((track,), (known[track],))
        return out

    def forget(self) -> None:
        self.history.clear()


def _decided(session: str, windows: list[tuple[int, list[str], np.ndarray]]) -> Row:
    """One row of decisions: a sensor's track is a place in the names, -1 for none."""
    names = sorted({t for _, tracks, _ in windows for t in tracks})
    number = {t: i for i, t in enumerate(names)}
    ends, imus, places, evidence = [], [], [], []
    for (end, tracks, matrix), taken in zip(windows, decide([m for _, _, m in windows])):
        for imu, c in enumerate(taken.tolist()):
            ends.append(end)
            imus.append(imu)
            places.append(number[tracks[c]] if c >= 0 else -1)
            evidence.append(matrix[imu, c] if c >= 0 else 0.0)
    return Row(session=session, names=names, window_end_ms=np.array(ends, np.int64), imu_idx=np.array(imus, np.int64), place=np.array(places, np.int32), accumulated=np.array(evidence, float))


def window_scores(cells: list[tuple[int, str, float]]) -> dict[str, list[float]]:
    """The scores of one window by track, one for each sensor up to the last; a sensor without one has 0."""
    sensors = 1 + max(imu for imu, _, _ in cells)
    out: dict[str, list[float]] = {}
    for imu, track, score in cells:
        out.setdefault(track, [0.0] * sensors)[imu] = float(score)  # JSON has NaN as text
    return out


def realtime_match(scores: DataFrame, delay: str = "10 seconds", decay: float = 0.0, threshold: float = 0.0, keep_low: bool = True, idle: str = "1 hour") -> DataFrame:
    """Decisions per session and window from a stream of scores (session, window_end timestamp, imu_idx, track, score).

    Rows wait until the watermark passes their window's end, so a window is decided once, whole and in order; later rows
    are dropped. A session without rows while the watermark moves on by `idle` loses its state; a new session starts without one.
    imu_idx, track and score may be arrays of the same length, the cells of a row; few rows with many cells are cheaper than a row for each cell.
    """
    kinds = {"imu_idx": "long", "track": "string", "score": "double"}
    packed = dict(scores.dtypes)["score"].startswith("array")
    cells = [F.col(c).cast(f"array<{k}>") if packed else F.array(F.col(c).cast(k)) for c, k in kinds.items()]
    timed = scores.withWatermark("window_end", delay).select("session", "window_end", F.unix_millis("window_end").alias("at_ms"), F.to_json(F.struct(*(c.alias(name) for c, name in zip(cells, kinds)))).alias("cells"), F.size(cells[0]).alias("_n")).filter("_n > 0").drop("_n")
    blocks = with_processor(timed.groupBy("session"), _Matcher(_milliseconds(idle), decay, threshold, keep_low), _DECISIONS)
    each = blocks.select("session", "names", F.explode(F.arrays_zip("window_end_ms", "imu_idx", "place", "accumulated")).alias("_x"))
    known = lambda c: F.when(F.col("_x.place") >= 0, c)
    return each.select("session", "_x.window_end_ms", "_x.imu_idx", known(F.get("names", F.col("_x.place"))).alias("track"), known(F.col("_x.accumulated")).alias("accumulated"))


def _milliseconds(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def window_stream(frames: DataFrame, keys: list[str], ts: str, size: str, slide: str, delay: str, *aggregates) -> DataFrame:
    """Sliding windows of a stream, emitted when the watermark has passed their end; rows later than the delay are dropped."""
    grouped = frames.withWatermark(ts, delay).groupBy(F.window(ts, size, slide), *keys).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(c for c in grouped.columns if c != "window"))


def join_streams(imu: DataFrame, tracks: DataFrame, key: str, ts: str, within: str, delay: str) -> DataFrame:
    """Sensor and track rows of one key whose times differ by at most `within`; both sides' state ends with the watermark."""
    a = imu.withWatermark(ts, delay).withColumnsRenamed({ts: "imu_ts", key: "imu_key"})
    b = tracks.withWatermark(ts, delay).withColumnsRenamed({ts: "track_ts", key: "track_key"})
    near = F.expr(f"imu_key = track_key and track_ts between imu_ts - interval {within} and imu_ts + interval {within}")
    return a.join(b, near)


def session_stream(frames: DataFrame, keys: list[str], ts: str, gap: str, delay: str) -> DataFrame:
    """(session_start, session_end, keys, n): runs of rows no further apart than the gap, for streams without session ids."""
    return frames.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")


class _Attitude(_Waiting):
    """One attitude, its time and the last good step for each device."""

    def __init__(self, idle_ms: int, beta: float):
        super().__init__("acc array<double>, gyro array<double>, quat array<double>", idle_ms)
        self.beta = beta

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.attitude = handle.getValueState("attitude", "q array<double>, last_ms long, good double")

    def pass_on(self, key: tuple, rows: list[tuple]) -> list[Row]:
        q, last, good = self.attitude.get() or (None, None, 1 / 30)
        out = []
        for t, acc, gyro, quat in sorted(rows):
            if q is None:
                q = (np.array(quat) / max(np.linalg.norm(quat), 1e-12)).tolist()
            else:
                dt = (t - last) / 1000
                good = dt if 0 < dt < 1 else good
                turned = madgwick_step(np.array(q), np.array(gyro), np.array(acc), good, self.beta)
                q = (turned if turned @ np.array(q) >= 0 else -turned).tolist()
            last = t
            out.append(Row(device=key[0], ts_ms=t, quat_w=q[0], quat_x=q[1], quat_y=q[2], quat_z=q[3]))
        self.attitude.update((q, last, good))
        return out

    def forget(self) -> None:
        self.attitude.clear()


def madgwick_stream(samples: DataFrame, device: str, ts: str, acc: list[str], gyro: list[str], quat: list[str], beta: float = 0.033, delay: str = "1 second", idle: str = "1 hour") -> DataFrame:
    """(device, ts_ms, quat_*): attitude per device, carried over batches.

    Samples wait for the watermark and pass in order of time. A step outside (0, 1) s takes the last good one, 1/30 s before
    there is any; the batch filter takes the median, which a stream cannot know. A device without samples while the
    watermark moves on by `idle` loses its state and starts anew from its next sample's quaternion.
    """
    vector = lambda names: F.array(*(F.col(c).cast("double") for c in names))
    timed = samples.withWatermark(ts, delay).select(F.col(device).cast("string").alias("device"), ts, F.unix_millis(ts).alias("at_ms"), vector(acc).alias("acc"), vector(gyro).alias("gyro"), vector(quat).alias("quat"))
    found = with_processor(timed.groupBy("device"), _Attitude(_milliseconds(idle), beta), "device string, ts_ms long, quat_w double, quat_x double, quat_y double, quat_z double")
    return found.withColumnRenamed("device", device)
