"""Decisions over time and linking against trying everything, on small tables without ties."""

import math
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelink.operators import history, linking


def best(cells):
    """Columns of rows 0 to 2 with the largest sum of a 3 by 3 table {(row, col): score}."""
    return max(permutations(range(3)), key=lambda p: sum(cells[r, c] for r, c in enumerate(p)))


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(11)
    return {(s, w): {(r, c): float(rng.random() + (0.3 if (r + s) % 3 == c else 0)) for r in range(3) for c in range(3)} for s in range(4) for w in range(13)}


def mean(tables):
    return {k: float(np.mean([t[k] for t in tables])) for k in tables[0]}


def test_session_decisions(spark, scores):
    rows = [(s, w, r, f"t{c}", v) for (s, w), t in scores.items() for (r, c), v in t.items()]
    df = spark.createDataFrame(rows, "session int, window_idx int, imu_idx int, track string, score double")
    got = {(r.session, r.window_idx, r.imu_idx): (r.track_now, r.track_history) for r in history.session_decisions(df, ["session"], "window_idx", decay=0.25, keep_low=False).collect()}
    for s in range(4):
        total = None
        for w in range(13):
            total = dict(scores[s, w]) if total is None else {k: 0.75 * v + scores[s, w][k] for k, v in total.items()}
            now, past = best(scores[s, w]), best(total)
            assert [got[s, w, r] for r in range(3)] == [(f"t{now[r]}", f"t{past[r]}") for r in range(3)]


def test_offline_policies(spark, scores):
    rows = [(s, w, r, c, v) for (s, w), t in scores.items() for (r, c), v in t.items()]
    df = spark.createDataFrame(rows, "session int, centre int, row int, col int, score double")
    run = lambda *a: {(r.session, r.row): r.col for r in history.offline_policy(df, ["session"], "centre", *a).collect()}
    votes, segment_best, top1 = run("window_hungarian_all"), run("global_best_segment", 4, 3), run("local_top1_segment", 4, 3)
    for s in range(4):
        count = Counter((r, c) for w in range(13) for r, c in enumerate(best(scores[s, w])))
        sums = sorted((sum(count[r, c] for r, c in enumerate(p)), p) for p in permutations(range(3)))
        if sums[-1][0] > sums[-2][0]:
            assert tuple(votes[s, r] for r in range(3)) == sums[-1][1]
        segments = [mean([scores[s, w] for w in range(a, a + 4)]) for a in (0, 4, 8)]
        gaps = []
        for t in segments:
            totals = sorted(sum(t[r, c] for r, c in enumerate(p)) for p in permutations(range(3)))
            gaps.append(totals[-1] - totals[-2])
        assert tuple(segment_best[s, r] for r in range(3)) == best(segments[int(np.argmax(gaps))])
        chosen = {}
        for r in range(3):
            margins = []
            for k, t in enumerate(segments):
                winner = max(range(3), key=lambda c: t[r, c])
                leads = [scores[s, w][r, winner] - max(scores[s, w][r, c] for c in range(3) if c != winner) for w in range(4 * k, 4 * k + 4)]
                margins.append(np.median(leads) - np.median(np.abs(np.array(leads) - np.median(leads))))
            chosen |= {(r, c): segments[int(np.argmax(margins))][r, c] for c in range(3)}
        assert tuple(top1[s, r] for r in range(3)) == best(chosen)


def test_links_until_so_many_people_are_left(spark):
    rng = np.random.default_rng(2)
    tracks = [(v, t) for v in range(3) for t in range(12)]
    links = [(v, int(a), int(b), float(rng.random())) for v in range(3) for a, b in rng.integers(0, 12, (14, 2)) if a != b]
    stats = spark.createDataFrame(tracks, "video int, track_id long")
    edges = spark.createDataFrame(links, "video int, src long, dst long, score double")
    for people in (None, 5):
        got = defaultdict(lambda: defaultdict(set))
        for r in linking.link_tracklets(stats, edges, ["video"], people).collect():
            got[r.video][r.new_id].add(r.track_id)
        for v in range(3):
            groups = [{t} for t in range(12)]
            for _, a, b in sorted((x, a, b) for w, a, b, x in links if w == v):
                if people is not None and len(groups) <= people:
                    break
                one = [g for g in groups if a in g or b in g]
                groups = [g for g in groups if g not in one] + [set().union(*one)]
            assert sorted(map(sorted, got[v].values())) == sorted(map(sorted, groups))
            assert [min(got[v][k]) for k in sorted(got[v])] == sorted(min(g) for g in groups)


def test_merged_series_are_filled(spark):
    rows = [(1, 10, f, float(f)) for f in (0, 1, 4)] + [(1, 11, f, 100.0 + f) for f in (4, 6)] + [(1, 12, 3, 5.0)]
    series = spark.createDataFrame(rows, "video int, track_id long, frame_id long, x double")
    groups = spark.createDataFrame([(1, 10, 0), (1, 11, 0), (1, 12, 1)], "video int, track_id long, new_id int")
    out = linking.merge_track_series(series, groups, ["video"], ["x"], True).collect()
    got = {(r.new_id, r.frame_id): r.x for r in out}
    want = {(0, 0): 0, (0, 1): 1, (0, 2): 1 + 103 / 3, (0, 3): 1 + 206 / 3, (0, 4): 104, (0, 5): 105, (0, 6): 106, (1, 3): 5}
    assert got.keys() == want.keys() and all(math.isclose(got[k], v) for k, v in want.items())


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("decay, keep_low, mode", [(0.0, True, "margin"), (0.25, True, "sigmoid_margin"), (0.25, False, "margin")])
def test_session_decisions_carry_evidence_over_blocks(spark, packed, decay, keep_low, mode):
    """Three tracks that come and go, blocks of a few rows that cut windows, and one exchange for the whole job."""
    rng = np.random.default_rng(13)
    rows = [(s, w, i, f"t{t}", float(rng.random())) for s, n in ((0, 40), (1, 1), (2, 1), (3, 25)) for w in range(n) for t in range(3) if (w + t) % 4 for i in range(3)]
    df = spark.createDataFrame(rows, "session int, window_idx int, imu_idx int, track string, score double")
    told = history.history_scores(df, ["session"], "window_idx", decay=decay, threshold=0.2, mode=mode, keep_low=keep_low).collect()
    want = defaultdict(dict)
    for r in told:
        want[r.session, r.window_idx][r.imu_idx, r.track] = r.accumulated
    cells = df.groupBy("session", "window_idx").agg(*(F.collect_list(c).alias(c) for c in ("imu_idx", "track", "score"))) if packed else df
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        made = history.session_decisions(cells.repartition(3), ["session"], "window_idx", decay=decay, threshold=0.2, mode=mode, keep_low=keep_low)
        plan = made._jdf.queryExecution().executedPlan().toString()
        got = defaultdict(dict)
        for r in made.collect():
            got[r.session, r.window_idx][r.imu_idx] = r.track_history
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and plan.count("Exchange hashpartitioning(session") == (2 if packed else 1)
    for key, table in want.items():
        tracks = sorted({t for _, t in table})
        sums = {p: sum(table[i, tracks[c]] for i, c in enumerate(p) if c < len(tracks)) for p in permutations(range(3))}
        taken = got[key]
        assert sum(table[i, t] for i, t in taken.items() if t is not None) == pytest.approx(max(sums.values()))
        assert sorted(t for t in taken.values() if t is not None) == tracks


def test_windows_without_cells_decide_nothing(spark):
    rows = [(1, 0, [0, 1], ["a", "b"], [0.3, 0.9]), (1, 1, [], [], []), (2, 0, None, None, None), (3, 4, [1, 0], ["b", "b"], [0.5, 0.1])]
    df = spark.createDataFrame(rows, "session int, w int, imu_idx array<int>, track array<string>, score array<double>")
    with pytest.raises(Exception, match="lacks cells"):
        history.session_decisions(df, ["session"], "w").collect()
    found = history.session_decisions(df.filter("session > 1"), ["session"], "w").collect()
    assert sorted(map(tuple, found)) == [(3, 4, 0, None, None), (3, 4, 1, "b", "b")]
