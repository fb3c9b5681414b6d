"""One-to-one assignment for many small score matrices at once."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Decimals to which sums are rounded before they are compared; None compares them as they are.
DIGITS = 9
#: Groups up to this size can be solved by trying all permutations.
SMALL = 4
_ORDERS = {n: np.array(list(permutations(range(n)))) for n in range(1, SMALL + 1)}


def rounded_key(total: np.ndarray, digits: int | None) -> np.ndarray:
    """What sums are compared by: rounded half away from zero, as SQL rounds."""
    if digits is None:
        return total
    scaled = np.asarray(total, float) * 10.0**digits
    whole = np.trunc(scaled)
    return whole + np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0.0)


def _square(scores: np.ndarray) -> np.ndarray:
    rows, cols = scores.shape
    out = np.zeros((max(rows, cols),) * 2)
    out[:rows, :cols] = scores
    return out


def hungarian(scores: np.ndarray, digits: int | None = DIGITS) -> np.ndarray:
    """Row-to-column assignment with the largest sum; -1 is unmatched.

    Of the assignments whose sums are equal after rounding the one whose columns come first in row order is taken. Groups of at most four
    try all permutations; larger ones go by shortest augmenting paths with potentials, and there digits=None means equal up to
    the error of the sum.
    """
    rows, cols = scores.shape
    if not rows or not cols:
        return np.full(rows, -1)
    square = _square(scores)
    out = (_tried(square, digits) if len(square) <= SMALL else _first_best(square, digits))[:rows]
    return np.where(out < cols, out, -1)


def _tried(square: np.ndarray, digits: int | None) -> np.ndarray:
    """The first best permutation of each of the matrices."""
    return _ORDERS[square.shape[-1]][np.argmax(rounded_key(all_sums(square), digits), axis=-1)]


def all_sums(square: np.ndarray) -> np.ndarray:
    """The sums of all permutations of each of the small square matrices, made in row order."""
    n = square.shape[-1]
    total = 0.0
    for row in range(n):
        total = total + square[..., row, _ORDERS[n][:, row]]
    return total


def _first_best(square: np.ndarray, digits: int | None) -> np.ndarray:
    match, reduced = _solved(square)
    n = len(match)
    noise = 4e-16 * n * max(1.0, float(np.abs(square).max()) * n)
    total = lambda m: float(square[np.arange(n), m].sum())
    least = total(match)
    as_good = lambda m: total(m) >= least - noise or (digits is not None and rounded_key(total(m), digits) >= rounded_key(least, digits))
    tight = reduced <= max(noise, 0.0 if digits is None else 1.001 * 10.0**-digits + noise)
    for row in range(n):
        for col in np.flatnonzero(tight[row, : match[row]]):
            other = _switch(tight, match, row, int(col))
            if other is not None and not as_good(other):
                other = _completed(square, match, row, int(col))
            if other is not None and as_good(other):
                match = other
                break
    return match


def _completed(square: np.ndarray, match: np.ndarray, row: int, col: int) -> np.ndarray:
    """The best assignment with row at col and the rows before it as they are."""
    out = match.copy()
    out[row] = col
    rest = np.setdiff1d(np.arange(len(match)), out[: row + 1])
    if len(rest):
        out[row + 1 :] = rest[_solved(square[np.ix_(np.arange(row + 1, len(match)), rest)])[0]]
    return out


def _solved(square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column of each row, reduced costs) of a best assignment; the costs are 0 on it and not below 0 elsewhere."""
    n, cost = len(square), -square
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, n)
    for row in range(n):
        owner[n], col = row, n
        low, back, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while True:
            done[col] = True
            free = ~done[:n]
            reach = cost[owner[col]] - u[owner[col]] - v[:n]
            better = free & (reach < low)
            low[better], back[better] = reach[better], col
            nearest = int(np.argmin(np.where(free, low, np.inf)))
            step = low[nearest]
            used = np.flatnonzero(done)
            u[owner[used]] += step
            v[used] -= step
            low[free] -= step
            col = nearest
            if owner[col] == n:
                break
        while col != n:
            owner[col] = owner[back[col]]
            col = back[col]
    match = np.empty(n, int)
    match[owner[:n]] = np.arange(n)
    return match, np.maximum(cost - u[:n, None] - v[None, :n], 0.0)


def _switch(tight: np.ndarray, match: np.ndarray, row: int, col: int) -> np.ndarray | None:
    """A perfect matching on tight edges with row at col and the rows before it as they are, if there is one."""
    n, out = len(match), match.copy()
    holder = int(np.flatnonzero(match == col)[0])
    if holder < row:
        return None
    goal, seen, came = match[row], {col}, {}
    queue = [holder]
    while queue:
        r = queue.pop()
        for c in np.flatnonzero(tight[r]):
            c = int(c)
            if c in seen:
                continue
            came[c] = r
            seen.add(c)
            if c == goal:
                while True:
                    r = came[c]
                    before = out[r]
                    out[r] = c
                    if r == holder:
                        out[row] = col
                        return out
                    c = before
            nxt = int(np.flatnonzero(match == c)[0])
            if nxt > row:
                queue.append(nxt)
    return None


def greedy(scores: np.ndarray) -> np.ndarray:
    """Rows with the widest lead choose first; a single column's lead is its score. -1 where no column is left."""
    n, m = scores.shape
    if not m:
        return np.full(n, -1)
    best = np.sort(scores, axis=1)[:, ::-1]
    turn = np.lexsort((np.arange(n), -(best[:, 0] - best[:, 1] if m > 1 else best[:, 0])))
    open_scores, chosen = scores.astype(float), np.full(n, -1)
    for row in turn[:m]:
        chosen[row] = np.argmax(open_scores[row])
        open_scores[:, chosen[row]] = -np.inf
    return chosen


SOLVERS = {"hungarian": hungarian, "greedy": greedy}


def solve(flat: np.ndarray, columns: int, method: str, digits: int | None = DIGITS) -> np.ndarray:
    if not np.isfinite(flat).all():
        raise ValueError("scores must be finite")
    scores = flat.reshape(-1, columns)
    return hungarian(scores, digits) if method == "hungarian" else SOLVERS[method](scores)


def best_two(scores: np.ndarray) -> tuple[float, float]:
    """Sums of the best assignment and of the best other one, by one solve; the second is NaN unless square with two rows or more.

    Another assignment moves rows round a cycle, each to the next one's column, and costs the reduced costs on its way; shortest
    paths between all rows give the cheapest cycle.
    """
    n = len(scores)
    if n < 2 or scores.shape != (n, n):
        taken = hungarian(scores)
        return float(scores[np.flatnonzero(taken >= 0), taken[taken >= 0]].sum()), float("nan")
    match, reduced = _solved(np.asarray(scores, float))
    way = reduced[:, match]  # from each row to the one that holds the column
    np.fill_diagonal(way, np.inf)
    for k in range(n):
        np.minimum(way, way[:, k, None] + way[k], out=way)
    best = float(scores[np.arange(n), match].sum())
    return best, best - float(way.diagonal().min())


def matrices(scores: DataFrame, group: list[str], row: str = "row", col: str = "col", score: str = "score", **more: str) -> DataFrame:
    """One row per group: its row and column labels in order and the flat matrix; `more` names matrices of other scores. Every cell must be there once."""
    values = {"flat": score, **more}
    cell = F.struct(F.col(row).alias("r"), F.col(col).alias("c"), *(F.col(v).cast("double").alias(name) for name, v in values.items()))
    grouped = scores.groupBy(*group).agg(F.array_sort(F.collect_list(cell)).alias("_cells")).select(*group, *(F.array_sort(F.array_distinct(F.col(f"_cells.{x}"))).alias(y) for x, y in (("r", "rows"), ("c", "cols"))), "_cells")
    whole = F.assert_true(F.size("_cells") == F.size("rows") * F.size("cols"), F.lit("a score matrix lacks cells or has some twice"))
    flat = [F.when(whole.isNull(), F.col(f"_cells.{name}")).alias(name) for name in values]
    return grouped.select(*group, "rows", "cols", *flat)


def solve_each(values: np.ndarray, lengths: np.ndarray, columns: np.ndarray, method: str, digits: int | None = DIGITS) -> np.ndarray:
    """The assigned columns of many flat matrices, one after the other; small ones of one shape are tried together."""
    if not np.isfinite(values).all():
        raise ValueError("scores must be finite")
    rows = np.where(columns > 0, lengths // np.maximum(columns, 1), 0)
    at, place = np.cumsum(lengths) - lengths, np.cumsum(rows) - rows
    out = np.full(int(rows.sum()), -1)
    left = np.flatnonzero(rows > 0)
    if method == "hungarian":
        small = (rows[left] <= SMALL) & (columns[left] <= SMALL)
        for r, c in set(zip(rows[left][small].tolist(), columns[left][small].tolist())):
            same = left[small & (rows[left] == r) & (columns[left] == c)]
            square = np.zeros((len(same), max(r, c), max(r, c)))
            square[:, :r, :c] = values[at[same, None] + np.arange(r * c)].reshape(-1, r, c)
            taken = _tried(square, digits)[:, :r]
            out[place[same, None] + np.arange(r)] = np.where(taken < c, taken, -1)
        left = left[~small]
    for i in left:
        out[place[i] : place[i] + rows[i]] = solve(values[at[i] : at[i] + lengths[i]], int(columns[i]), method, digits)
    return out


def assignment_of(method: str = "hungarian", digits: int | None = DIGITS):
    """Column function (flat, number of columns) -> assigned column of each row, -1 for none."""
    if method not in SOLVERS:
        raise ValueError(f"method is one of {sorted(SOLVERS)}, not {method!r}")

    @F.arrow_udf("array<int>")
    def assigned(flat: pa.Array, columns: pa.Array) -> pa.Array:
        lengths, wide = flat.value_lengths().to_numpy(zero_copy_only=False), columns.to_numpy(zero_copy_only=False)
        taken = solve_each(flat.flatten().to_numpy(zero_copy_only=False).astype(float), lengths, wide, method, digits)
        ends = np.cumsum(np.where(wide > 0, lengths // np.maximum(wide, 1), 0))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(taken, pa.int32()))

    return assigned


def assign(scores: DataFrame, group: list[str], row: str = "row", col: str = "col", score: str = "score", method: str = "hungarian", digits: int | None = DIGITS) -> DataFrame:
    """(group, row, col, score): the chosen column of every row; an unmatched row has null. `digits` says when sums are equal."""
    solved = matrices(scores, group, row, col, score).withColumn("_a", assignment_of(method, digits)("flat", F.size("cols")))
    return _chosen(solved, group, row, col, score)


def best_permutation(flat: str, rows: Column, cols: Column, n: int, zero_is_none: bool = False) -> Column:
    """Column function: assigned column of each row of a matrix of at most n rows and columns, -1 for none, by trying all permutations.

    A smaller matrix counts as one of n by n with zeros beyond its ends. Of equal sums the first permutation counts. With zero_is_none a cell of 0
    is no pair: its row has none, and none comes after all columns.
    """
    perms = list(permutations(range(n)))
    table = F.array(*(F.array(*map(F.lit, p)) for p in perms))
    cell = lambda p, r: F.when((r < rows) & (F.get(p, r) < cols), F.get(flat, r * cols + F.get(p, r))).otherwise(0.0)
    total = lambda p: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, r: s + cell(p, r))
    order = lambda p, i: F.transform(p, lambda c, r: F.when(cell(p, r) > 0, -c).otherwise(-n)) if zero_is_none else -i
    best = F.array_max(F.transform(table, lambda p, i: F.struct(F.round(total(p) * 10.0**DIGITS).alias("s"), order(p, i).alias("o"), (-i).alias("i"))))
    paired = lambda c, r: (c < cols) & (F.get(flat, r * cols + c) > 0) if zero_is_none else c < cols
    return F.transform(F.slice(F.get(table, -best["i"]), 1, rows), lambda c, r: F.when(paired(c, r), c).otherwise(-1))


def _chosen(solved: DataFrame, group: list[str], row: str, col: str, score: str) -> DataFrame:
    """(group, row, col, score) of matrices with their assignment _a."""
    each = solved.select(*group, "cols", "flat", F.posexplode(F.arrays_zip("rows", "_a")).alias("_i", "_x"))
    taken = F.when(F.col("_x._a") >= 0, F.col("_x._a"))
    return each.select(*group, F.col("_x.rows").alias(row), F.get("cols", taken).alias(col), F.get("flat", F.col("_i") * F.size("cols") + taken).alias(score))


def assign_small(scores: DataFrame, group: list[str], n: int, row: str = "row", col: str = "col", score: str = "score") -> DataFrame:
    """assign for the square groups of n <= 4 alone, without Python."""
    if n > SMALL:
        raise ValueError("permutations are for groups of at most four")
    square = matrices(scores, group, row, col, score).filter((F.size("rows") == n) & (F.size("cols") == n))
    return _chosen(square.withColumn("_a", best_permutation("flat", F.size("rows"), F.size("cols"), n)), group, row, col, score)


def assign_by_size(scores: DataFrame, group: list[str], row: str = "row", col: str = "col", score: str = "score", zero_is_none: bool = False) -> DataFrame:
    """assign, with groups of at most four rows and columns solved without Python; both parts read one shuffle.

    With zero_is_none scores are not negative and a score of 0 is no pair; of equal sums the one whose rows have the first columns in row
    order counts, a row without a pair coming last.
    """
    every = matrices(scores, group, row, col, score)
    small = (F.size("rows") <= SMALL) & (F.size("cols") <= SMALL)
    few = every.filter(small).withColumn("_a", best_permutation("flat", F.size("rows"), F.size("cols"), SMALL, zero_is_none))
    more = every.filter(~small)
    if zero_is_none:
        # columns of 0 at the end are what a row without a pair takes
        wide = F.flatten(F.transform(F.sequence(F.lit(0), F.size("rows") - 1), lambda r: F.concat(F.transform(F.slice("flat", r * F.size("cols") + 1, F.size("cols")), lambda s: F.when(s > 0, s).otherwise(-1.0)), F.array_repeat(F.lit(0.0), F.size("rows")))))
        more = more.withColumn("_a", F.transform(assignment_of()(wide, F.size("cols") + F.size("rows")), lambda c: F.when(c < F.size("cols"), c).otherwise(-1)))
    else:
        more = more.withColumn("_a", assignment_of()("flat", F.size("cols")))
    return _chosen(few.unionByName(more), group, row, col, score)


def assign_each(scores: DataFrame, group: list[str], row: str, col: str, chosen: dict[str, str], digits: int | None = DIGITS) -> DataFrame:
    """(group, row, and a column for each entry of chosen): assignments by several scores of the same cells, from one shuffle; chosen maps names to scores."""
    flats = {f"_flat{i}": score for i, score in enumerate(chosen.values())}
    solver = assignment_of(digits=digits)
    solved = matrices(scores, group, row, col, next(iter(chosen.values())), **flats).withColumns({f"_a{i}": solver(f, F.size("cols")) for i, f in enumerate(flats)})
    return chosen_each(solved, group, row, list(chosen))


def chosen_each(solved: DataFrame, group: list[str], row: str, names: list[str]) -> DataFrame:
    """(group, row, names): the chosen column of every row by each of the assignments _a0, _a1 and so on."""
    each = solved.select(*group, "cols", F.explode(F.arrays_zip("rows", *(f"_a{i}" for i in range(len(names))))).alias("_x"))
    taken = lambda a: F.get("cols", F.when(F.col(a) >= 0, F.col(a)))
    return each.select(*group, F.col("_x.rows").alias(row), *(taken(f"_x._a{i}").alias(name) for i, name in enumerate(names)))
