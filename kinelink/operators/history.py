"""Decisions over time: evidence per tracklet, per segment, and their use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelink.operators.accuracy import frame_assignment_counts
from kinelink.operators.assignment import DIGITS, SMALL, all_sums, assign, assignment_of, best_two, chosen_each, matrices, rounded_key, solve_each
from kinelink.operators.joins import nearest_join
from kinelink.operators.scans import affine_scan
from kinelink.operators.storage import checkpointed
from kinelink.operators.windows import window_frames


def column_confidence(scores: DataFrame, keys: list[str], track: str, score: str, mode: str = "margin", scale: float = 3.0) -> DataFrame:
    """Adds confidence: lead of a track's best sensor over its second (absolute value of a single one), or its sigmoid."""
    ranked = F.sort_array(F.collect_list(score).over(Window.partitionBy(*keys, track)), asc=False)
    margin = F.when(F.size(ranked) == 1, F.abs(F.get(ranked, F.lit(0)))).otherwise(F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)))
    if mode not in ("margin", "sigmoid_margin"):
        raise ValueError("mode is 'margin' or 'sigmoid_margin'")
    return scores.withColumn("confidence", margin if mode == "margin" else 1 / (1 + F.exp(-scale * margin)))


def history_scores(scores: DataFrame, session: list[str], window: str, track: str = "track", imu: str = "imu_idx", score: str = "score", decay: float = 0.0, threshold: float = 0.0, mode: str = "margin", keep_low: bool = True) -> DataFrame:
    """Adds accumulated: the evidence of every sensor and track up to a window.

    A track's first sight counts always; later ones up to the threshold of confidence are passed over if keep_low.
    Without decay this is a running sum; with decay each window is a map of the evidence before it, and a segmented
    scan (`affine_scan`) composes them, so a long track is dealt out. With decay windows are whole numbers.
    """
    if not 0 <= decay <= 1 or threshold < 0:
        raise ValueError("decay lies in [0, 1] and the threshold is not negative")
    sure = column_confidence(scores, [*session, window], track, score, mode)
    w = Window.partitionBy(*session, track, imu).orderBy(window)
    marked = sure.withColumn("_first", F.row_number().over(w) == 1)
    taken = F.col("_first") | (F.lit(True) if not keep_low else F.col("confidence") > threshold)
    marked = marked.withColumn("status", F.when(F.col("_first"), "initialized").when(taken, "updated").otherwise("preserved")).withColumn("_x", F.when(taken, F.col(score)).otherwise(0.0)).withColumn("_t", taken)
    if decay == 0:
        return marked.withColumn("accumulated", F.sum("_x").over(w)).drop("_first", "_x", "_t")
    factor = F.when(F.col("_first"), 0.0).when(F.col("_t"), 1 - decay).otherwise(1.0)
    return affine_scan(marked, [*session, track, imu], window, factor, F.col("_x"), "accumulated").drop("_first", "_x", "_t")


def _ranked(labels: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each label's place among the distinct ones in order (nulls last), and these."""
    coded = labels.dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[coded.indices.to_numpy()], coded.dictionary.take(order)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values in sorted columns begins."""
    return np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))[: len(columns[0])]


class _Evidence:
    """Evidence of every sensor and track, block by block of whole windows in order; the last session's goes on into the next block."""

    def __init__(self, decay: float, threshold: float, mode: str, keep_low: bool, scale: float = 3.0):
        self.decay, self.threshold, self.mode, self.keep_low, self.scale = decay, threshold, mode, keep_low, scale
        self.known: dict[tuple, float] = {}

    def confident(self, window: np.ndarray, track: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Whether a cell's track leads by more than the threshold in its window."""
        by = np.lexsort((-score, track, window))
        first = np.flatnonzero(_starts(window[by], track[by]))
        sizes = np.diff(np.append(first, len(by)))
        best, second = score[by[first]], score[by[np.minimum(first + 1, len(by) - 1)]]
        lead = np.where(sizes == 1, np.abs(best), best - second)
        sure = lead if self.mode == "margin" else 1 / (1 + np.exp(-self.scale * lead))
        out = np.empty(len(by), bool)
        out[by] = np.repeat(sure > self.threshold, sizes)
        return out

    def add(self, session: np.ndarray, window: np.ndarray, track: np.ndarray, imu: np.ndarray, score: np.ndarray, names: tuple[list, list], last: int) -> np.ndarray:
        """Each cell's evidence up to its window. Session 0 is the one of the block before, `last` the one that goes on; the n-th cells of all series are taken together."""
        taken = self.confident(window, track, score) if self.keep_low else np.ones(len(score), bool)
        by = np.lexsort((window, imu, track, session))
        first = _starts(session[by], track[by], imu[by])
        series, at = np.cumsum(first) - 1, np.flatnonzero(first)
        turn = np.arange(len(by)) - at[series]
        head = by[at]
        keys = [(names[0][t], names[1][i]) for t, i in zip(track[head].tolist(), imu[head].tolist())]
        old = np.array([n == 0 and k in self.known for n, k in zip(session[head].tolist(), keys)], bool)
        held = np.array([self.known[k] if o else 0.0 for o, k in zip(old, keys)], float)
        by_turn = np.argsort(turn, kind="stable")
        ends = np.cumsum(np.bincount(turn))
        out = np.empty(len(score))
        for n, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist())):
            cell, line = by[by_turn[a:b]], series[by_turn[a:b]]
            now = held[line]
            more = np.where(taken[cell], (1 - self.decay) * now + score[cell], now)
            held[line] = out[cell] = more if n else np.where(old[line], more, score[cell])
        kept = {k: h for k, h, n in zip(keys, held.tolist(), session[head].tolist()) if n == last}
        self.known = self.known | kept if last == 0 else kept
        return out


def _decided(block: pa.RecordBatch, starts: np.ndarray, evidence: _Evidence, keys: list[str], digits: int | None) -> pa.RecordBatch:
    """One row for each window: its sensors, its tracks and both assignments."""
    new, heads = block["_new"].to_numpy(zero_copy_only=False), np.flatnonzero(starts)
    window = np.repeat(np.cumsum(starts) - 1, block["_score"].value_lengths().to_numpy())
    score = block["_score"].flatten().to_numpy(zero_copy_only=False).astype(float)
    if not np.isfinite(score).all():
        raise ValueError("scores must be finite")
    (imu, imus), (track, tracks) = (_ranked(block[c].flatten()) for c in ("_imu", "_track"))
    by = np.lexsort((track, imu, window))
    window, imu, track, score = window[by], imu[by], track[by], score[by]
    sums = evidence.add(np.cumsum(new[heads])[window], window, track, imu, score, (tracks.to_pylist(), imus.to_pylist()), int(new.sum()))
    many = len(heads)
    row = _starts(window, imu)
    by_track = np.lexsort((track, window))
    col = by_track[_starts(window[by_track], track[by_track])]
    cells, rows, cols = (np.bincount(x, minlength=many) for x in (window, window[row], window[col]))
    if (rows * cols != cells).any() or not _starts(window, imu, track).all():
        raise ValueError("a score matrix lacks cells or has some twice")
    lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)
    made = [lists(rows, imus.take(pa.array(imu[row]))), lists(cols, tracks.take(pa.array(track[col])))]
    made += [lists(rows, pa.array(solve_each(v, cells, cols, "hungarian", digits), pa.int32())) for v in (score, sums)]
    return pa.RecordBatch.from_arrays([*(block[k].take(pa.array(heads)) for k in keys), *made], [*keys, "rows", "cols", "_a0", "_a1"])


def session_decisions(scores: DataFrame, session: list[str], window: str, digits: int | None = DIGITS, decay: float = 0.0, threshold: float = 0.0, mode: str = "margin", keep_low: bool = True) -> DataFrame:
    """(session, window, imu_idx, track_now, track_history): assignments by the window's scores and by accumulated ones; sums equal to `digits` decimals are ties.

    Evidence is that of history_scores. A session's windows pass one task in order, in blocks that carry the evidence on, so memory does not
    grow with its length. imu_idx, track and score may be arrays of the same length, the cells of a row; few rows with many cells are cheaper.
    """
    if not 0 <= decay <= 1 or threshold < 0:
        raise ValueError("decay lies in [0, 1] and the threshold is not negative")
    if mode not in ("margin", "sigmoid_margin"):
        raise ValueError("mode is 'margin' or 'sigmoid_margin'")
    keys, packed = [*session, window], dict(scores.dtypes)["score"].startswith("array")
    cell = lambda c, kind: F.col(c).cast(f"array<{kind}>" if packed else kind) if kind else F.col(c)
    several = lambda c: F.coalesce(c, F.array()) if packed else F.array(c)
    cells = scores.select(*keys, *(several(cell(c, kind)).alias(name) for c, kind, name in (("imu_idx", None, "_imu"), ("track", None, "_track"), ("score", "double", "_score"))))
    w = Window.partitionBy(*session).orderBy(window)
    in_order = cells.withColumns({"_new": F.row_number().over(w) == 1, "_rank": F.dense_rank().over(w)})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, held, rank = _Evidence(decay, threshold, mode, keep_low), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ranks = batch["_rank"].to_numpy()
            starts = np.append(ranks[0] != rank, ranks[1:] != ranks[:-1]) | batch["_new"].to_numpy(zero_copy_only=False)
            rank, cut = ranks[-1], np.flatnonzero(starts)
            # the last window may go on in the next batch
            if len(cut):
                held.append((batch.slice(0, cut[-1]), starts[: cut[-1]]))
                if sum(len(s) for _, s in held):
                    yield _decided(pa.concat_batches([b for b, _ in held]), np.concatenate([s for _, s in held]), evidence, keys, digits)
                held = [(batch.slice(cut[-1]), starts[cut[-1] :])]
            else:
                held.append((batch, starts))
        if held:
            yield _decided(pa.concat_batches([b for b, _ in held]), np.concatenate([s for _, s in held]), evidence, keys, digits)

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"rows {kinds['_imu']}", f"cols {kinds['_track']}", "_a0 array<int>", "_a1 array<int>"])
    return chosen_each(in_order.mapInArrow(decide, schema), keys, "imu_idx", ["track_now", "track_history"])


def on_frames(decided: DataFrame, centres: DataFrame, frames: DataFrame, session: list[str], window: str, track: str) -> DataFrame:
    """(session, frame_idx, imu_id, track): every frame takes the decision of the window with the nearest centre.

    decided(session, window, imu_idx, track), centres(session, window, centre), frames(session, frame_idx).
    """
    cells = decided.groupBy(*session, window).agg(F.collect_list(F.struct(F.col("imu_idx").alias("imu_id"), F.col(track).alias("track"))).alias("_cells"))
    known = cells.join(centres.select(*session, window, "centre"), [*session, window])
    near = nearest_join(frames.select(*session, "frame_idx"), known, session, "frame_idx", "centre", ["_cells"])
    return near.select(*session, "frame_idx", F.explode("_cells").alias("_x")).select(*session, "frame_idx", "_x.imu_id", "_x.track")


def tracked_session_decisions(scores: DataFrame, windows: DataFrame, visible: DataFrame, frames: DataFrame, gt_map: DataFrame, session: list[str], window: str, digits: int | None = None, **history) -> DataFrame:
    """(session, rule, correct, total): decisions by the window's scores and by accumulated ones, counted frame by frame.

    windows(session, window, window_start, window_end), visible(session, frame_idx, track): a track is active in a window if it
    is seen in any of its frames; other tracks' scores don't count there, and a window without an active track decides
    nothing. gt_map as in frame_assignment_counts. Sums of scores are compared as they are, unless digits rounds them.
    """
    keys = [*session, window]
    active = window_frames(windows.select(*keys, "window_start", "window_end"), visible.select(*session, "frame_idx", "track"), session).select(*keys, "track").distinct()
    decided = session_decisions(scores.join(active, [*keys, "track"], "left_semi"), session, window, digits, **history)
    centres = windows.select(*keys, ((F.col("window_start") + F.col("window_end") - 1) / 2).alias("centre"))
    counted = [frame_assignment_counts(gt_map, on_frames(decided, centres, frames, session, window, c), session).withColumn("rule", F.lit(c.removeprefix("track_"))) for c in ("track_now", "track_history")]
    return counted[0].unionByName(counted[1])


def segment_decisions(cosine: DataFrame, pair: DataFrame, windows: DataFrame, frames: DataFrame, gt_map: DataFrame, clip: list[str], window: str, cosine_weight: float = 1.0, pair_weight: float = 0.0, digits: int | None = None) -> DataFrame:
    """(clip, correct, total): one assignment per window of the weighted scores, carried to frames by the nearest centre; session_rollup sums it up.

    Sums of scores are compared as they are, unless digits rounds them.
    """
    keys = [*clip, window]
    mixed = mixed_scores(cosine, pair, [*keys, "imu_idx", "track"], cosine_weight, pair_weight)
    decided = assign(mixed, keys, "imu_idx", "track", "score", digits=digits)
    centres = windows.select(*keys, ((F.col("window_start") + F.col("window_end") - 1) / 2).alias("centre"))
    return frame_assignment_counts(gt_map, on_frames(decided, centres, frames, clip, window, "track"), clip)


def mixed_scores(a: DataFrame, b: DataFrame, keys: list[str], cosine_weight: float = 1.0, pair_weight: float = 0.0) -> DataFrame:
    """Weighted sum of two score tables; a pair that b lacks counts 0."""
    return a.join(b.select(*keys, F.col("score").alias("_b")), keys, "left").withColumn("score", cosine_weight * F.col("score") + pair_weight * F.coalesce("_b", F.lit(0.0))).drop("_b")


def _evidence_type(scores: DataFrame, row: str, col: str) -> str:
    kinds = dict(scores.dtypes)
    cell = f"row:{kinds[row]},col:{kinds[col]},mean:double,total:double,n:bigint,winner:{kinds[col]},margin:double,consistency:double"
    return f"struct<windows:bigint,best:double,gap:double,cells:array<struct<{cell}>>>"


def _leads(cells: pd.DataFrame) -> pd.DataFrame:
    """Of many segments' cells (i, row, col, centre, score): one row for each (i, row, col) with its mean, and its row's winner, margin and consistency."""
    out = cells.groupby(["i", "row", "col"], sort=True)["score"].agg(["mean", "sum", "count"]).reset_index()
    out["key"] = rounded_key(out["mean"].to_numpy(), 12)
    first = out.sort_values(["i", "row", "key", "col"], ascending=[True, True, False, True], kind="stable").drop_duplicates(["i", "row"])
    out = out.drop(columns="key").merge(first[["i", "row", "col"]].rename(columns={"col": "winner"}), on=["i", "row"])
    each = cells.merge(first[["i", "row", "col"]].rename(columns={"col": "winner"}), on=["i", "row"])
    won = each["col"] == each["winner"]
    by = [each["i"], each["row"], each["centre"]]
    lead = (each["score"].where(won).groupby(by).max() - each["score"].mask(won).groupby(by).max()).rename("lead").reset_index()
    rows = lead.groupby(["i", "row"])["lead"]
    lead["off"] = (lead["lead"] - rows.transform("median")).abs()
    lead["ahead"] = (lead["lead"] > 0).astype(float)
    told = lead.groupby(["i", "row"]).agg(middle=("lead", "median"), off=("off", "median"), consistency=("ahead", "mean"))
    told["margin"] = told["middle"] - told["off"]
    out = out.merge(told[["margin", "consistency"]].reset_index(), on=["i", "row"])
    alone = out.groupby(["i", "row"])["col"].transform("size") == 1
    return out.assign(margin=out["margin"].mask(alone, np.inf), consistency=out["consistency"].mask(alone, 1.0))


def _two_sums(means: pd.DataFrame, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, best sum and second best sum of every segment's matrix of means, which come in order of segment, row and column."""
    cells = np.bincount(means["i"], minlength=many)
    rows = np.bincount(means.drop_duplicates(["i", "row"])["i"], minlength=many)
    cols = np.bincount(means.drop_duplicates(["i", "col"])["i"], minlength=many)
    if (rows * cols != cells).any():
        raise ValueError("a score matrix lacks cells or has some twice")
    values, at = means["mean"].to_numpy(), np.cumsum(cells) - cells
    best, second = np.full(many, np.nan), np.full(many, np.nan)
    few = (rows == cols) & (rows > 1) & (rows <= SMALL)
    for n in np.unique(rows[few]).tolist():
        same = np.flatnonzero(few & (rows == n))
        sums = np.sort(all_sums(values[at[same, None] + np.arange(n * n)].reshape(-1, n, n)), axis=1)
        best[same], second[same] = sums[:, -1], sums[:, -2]
    for i in np.flatnonzero(~few & (rows > 0)):
        best[i], second[i] = best_two(values[at[i] : at[i] + cells[i]].reshape(rows[i], cols[i]))
    return rows, best, second


def _segments(scores: DataFrame, keys: list[str], centre: str, frames: int, min_windows: int, row: str, col: str, score: str) -> DataFrame:
    """(keys, segment, best, gap, cells): one row for each segment that counts, or for all windows of a recording as segment -1.

    The scores meet once, by segment; what is told of a segment comes from its own cells, many segments at a time. Of a recording without a large
    segment the sums of its small ones are added up.
    """
    if frames <= 0 or min_windows <= 0:
        raise ValueError("frames and min_windows must be positive")
    kind = _evidence_type(scores, row, col)

    @F.arrow_udf(kind)
    def told(cells: pa.Array) -> pa.Array:
        lengths = cells.value_lengths().to_numpy(zero_copy_only=False)
        flat = cells.flatten()
        frame = pd.DataFrame({name: flat.field(name).to_pandas() for name in ("row", "col", "centre", "score")})
        frame.insert(0, "i", np.repeat(np.arange(len(cells)), lengths))
        rows = _leads(frame)
        sides, best, second = _two_sums(rows, len(cells))
        windows = frame.drop_duplicates(["i", "centre"]).groupby("i").size().reindex(range(len(cells)), fill_value=0)
        ends = np.append(0, np.cumsum(np.bincount(rows["i"], minlength=len(cells))))
        names = {"row": "row", "col": "col", "mean": "mean", "total": "sum", "n": "count", "winner": "winner", "margin": "margin", "consistency": "consistency"}
        own = pa.StructArray.from_arrays([pa.array(rows[c], flat.field("row").type if n == "row" else flat.field("col").type if n in ("col", "winner") else pa.int64() if n == "n" else pa.float64()) for n, c in names.items()], list(names))
        gap = (best - second) / np.maximum(sides, 1)
        return pa.StructArray.from_arrays([pa.array(windows.to_numpy(), pa.int64()), pa.array(best), pa.array(gap), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own)], ["windows", "best", "gap", "cells"])

    cell = F.struct(F.col(row).alias("row"), F.col(col).alias("col"), F.col(centre).alias("centre"), F.col(score).cast("double").alias("score"))
    held = scores.groupBy(*keys, F.floor(F.col(centre) / frames).cast("long").alias("segment")).agg(F.collect_list(cell).alias("_cells"))
    every = checkpointed(held.select(*keys, "segment", told("_cells").alias("_t")).select(*keys, "segment", "_t.*"))
    large = every.filter(F.col("windows") >= min_windows).drop("windows")
    few = every.groupBy(*keys).agg(F.max("windows").alias("_most")).filter(F.col("_most") < min_windows).select(*keys)
    rest = every.join(few, keys, "left_semi").select(*keys, F.explode("cells").alias("x")).groupBy(*keys, "x.row", "x.col").agg((F.sum("x.total") / F.sum("x.n")).alias("mean"), F.sum("x.total").alias("total"), F.sum("x.n").alias("n"))
    means = rest.select(*keys, F.lit(-1).cast("long").alias("segment"), "row", "col", "mean")
    by = [*keys, "segment"]
    winners = means.groupBy(*by, "row").agg(F.max_by("col", F.struct(F.round("mean", 12), -F.col("col"))).alias("winner"))
    whole = means.join(winners, [*by, "row"]).join(segment_gaps(means, by), by).withColumns({"margin": F.lit(0.0), "consistency": F.lit(1.0)})
    return large, whole


def segment_evidence(scores: DataFrame, keys: list[str], centre: str, frames: int, min_windows: int, row: str = "row", col: str = "col", score: str = "score") -> DataFrame:
    """(keys, segment, row, col, mean) with the row's winner, its robust margin and consistency, and the segment's gap.

    Segments with fewer windows don't count; if none is left there is one segment -1 of all windows, with margins 0
    and consistency 1. Margins are median minus median absolute deviation of the winner's leads.
    """
    large, whole = _segments(scores, keys, centre, frames, min_windows, row, col, score)
    told = ["mean", "winner", "margin", "consistency"]
    each = large.select(*keys, "segment", "best", "gap", F.explode("cells").alias("x"))
    names = lambda x: [F.col(f"{x}row").alias(row), F.col(f"{x}col").alias(col), *(F.col(f"{x}{c}").alias(c) for c in told)]
    return each.select(*keys, "segment", *names("x."), "best", "gap").unionByName(whole.select(*keys, "segment", *names(""), "best", "gap"))


def segment_gaps(means: DataFrame, by: list[str], row: str = "row", col: str = "col", score: str = "mean") -> DataFrame:
    """(by, best, gap): best assignment's sum and its lead over the second best, by rows."""

    @F.pandas_udf("struct<best:double,gap:double>")
    def lead(flat: pd.Series, columns: pd.Series) -> pd.DataFrame:
        out = []
        for x, n in zip(flat, columns):
            m = np.asarray(x, float).reshape(-1, int(n))
            best, second = best_two(m)
            out.append((best, (best - second) / len(m)))
        return pd.DataFrame(out, columns=["best", "gap"])

    solved = matrices(means, by, row, col, score).withColumn("_g", lead("flat", F.size("cols")))
    return solved.select(*by, F.col("_g.best").alias("best"), F.col("_g.gap").alias("gap"))


def offline_policy(scores: DataFrame, keys: list[str], centre: str, method: str, frames: int = 600, min_windows: int = 2, top_k: int = 3) -> DataFrame:
    """(keys, row, col): one assignment for a whole recording by one of five methods."""
    if method == "global_all_windows":
        return assign(scores.groupBy(*keys, "row", "col").agg(F.avg("score").alias("score")), keys).select(*keys, "row", "col")
    if method == "window_hungarian_all":
        won = assign(scores, [*keys, centre]).filter("col is not null").groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).cast("double").alias("votes"))
        cells = scores.select(*keys, "row", "col").distinct()
        votes = cells.join(won, [*keys, "row", "col"], "left").withColumn("score", F.coalesce("votes", F.lit(0.0)))
        return assign(votes, keys).select(*keys, "row", "col")
    if method not in ("global_best_segment", "local_top1_segment", "local_topk_segment"):
        raise ValueError(f"unknown method {method!r}")
    large, whole = _segments(scores, keys, centre, frames, min_windows, "row", "col", "score")
    if method == "global_best_segment":
        order = F.struct(F.when(F.isnan("gap"), F.lit(float("-inf"))).otherwise(F.round("gap", 7)), -F.col("segment"))
        best = large.groupBy(*keys).agg(F.max_by("cells", order).alias("cells")).select(*keys, F.explode("cells").alias("x")).select(*keys, "x.row", "x.col", "x.mean")
        return assign(best.unionByName(whole.select(*keys, "row", "col", "mean")), keys, score="mean").select(*keys, "row", "col")
    k = 1 if method == "local_top1_segment" else top_k
    # a segment's row travels with its columns' means
    lines = large.select(*keys, "segment", F.explode("cells").alias("x")).groupBy(*keys, "segment", "x.row", "x.margin").agg(F.collect_list(F.struct("x.col", "x.mean")).alias("_cols"))
    by_row = Window.partitionBy(*keys, "row")
    chosen = lines.withColumn("_k", F.row_number().over(by_row.orderBy(F.desc("margin"), "segment"))).filter(F.col("_k") <= k)
    top = F.max("margin").over(by_row)
    weight = F.when(F.col("margin") == top, 1.0).otherwise(F.exp(F.col("margin") - top))
    cells = chosen.withColumn("_w", weight).select(*keys, "row", "_w", F.explode("_cols").alias("x")).select(*keys, "row", "_w", "x.col", "x.mean")
    mixed = cells.unionByName(whole.select(*keys, "row", F.lit(1.0).alias("_w"), "col", "mean")).groupBy(*keys, "row", "col").agg((F.sum(F.col("_w") * F.col("mean")) / F.sum("_w")).alias("score"))
    return assign(mixed, keys).select(*keys, "row", "col")


__all__ = ["assignment_of", "column_confidence", "history_scores", "mixed_scores", "offline_policy", "on_frames", "segment_decisions", "segment_evidence", "segment_gaps", "session_decisions", "tracked_session_decisions"]
