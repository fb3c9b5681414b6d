"""Operator 10: a hidden Markov language model.

Words have classes: the most frequent training words and the end mark are classes of their own, all others
share the classes of their last bytes. The model's states emit classes, and a class emits its words by
their training counts plus one, with one more share for a word that training never saw; so

    P(text) = sum over state paths of prod P(state | state before) * P(class | state) * P(word | class)

1. Documents are dealt into blocks. Each block sends its distinct words' training counts to shards
   by word hash; the shards send the totals over all blocks back.
2. Each block looks its words up and keeps, per document, the word classes and what does not depend on
   states. This table is checkpointed.
3. Baum-Welch: every pass over all training documents sums expected counts over all partitions; the
   driver only sees those sums, whose size follows from the model's alone. Documents train whole.
4. Scoring: the scaled forward recursion over a whole text gives its exact likelihood.

Texts of more than two stretches are worked stretch by stretch, all stretches at once: their scaled transfer
matrices tell what enters and leaves each stretch, so the results are those of one recursion over the whole text
and memory does not follow its length.

Words are told apart by a 64-bit hash. Nulls: a null text has only its end mark; a null id's text is
empty, so it trains. Rows that repeat are documents of their own. With no training rows every count is
zero. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelink.llm import words as W
from kinelink.llm.tables import checkpointed, in_blocks, row_slices

BLOCK_BYTES = 8 << 20
BLOCKS_A_SHARD = 8
_END = 0


@dataclass(frozen=True)
class Shape:
    states: int = 4
    frequent: int = 1023
    endings: int = 1024
    passes: int = 8
    stretch: int = 256

    @property
    def classes(self) -> int:
        return 1 + self.frequent + self.endings


def ending_class(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, endings: int) -> np.ndarray:
    """Class of each word by its last three bytes and whether it begins with a capital."""
    code = np.zeros(len(starts), W.U64)
    for back in (1, 2, 3):
        at = ends - back
        code = code * W.U64(257) + np.where(at >= starts, data[np.maximum(at, 0)].astype(W.U64) + W.U64(1), W.U64(0))
    return (W.mix(code + W.U64(1)) % W.U64(endings)).astype(np.int16)


def is_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def _block_words(table: pa.Table, endings: int):
    """(distinct word hashes, their ending classes, training counts, per slice the rows' bounds and word numbers)."""
    train = np.array([is_training(d) for d in table.column("doc_id").to_pylist()], bool)
    parts, hashes, classes = [], [], []
    for first, end, raw, offsets in W.text_slices(table.column("text")):
        data = W.FOLD[raw]
        starts, ends, bounds = W.word_spans(data, offsets)
        hashes.append(W.word_hashes(data, starts, ends))
        classes.append(ending_class(data, starts, ends, endings))
        parts.append((first, end, bounds))
    every = np.concatenate(hashes or [np.empty(0, W.U64)])
    distinct, at, number = np.unique(every, return_index=True, return_inverse=True)
    kinds = np.concatenate(classes or [np.empty(0, np.int16)])[at]
    counts = np.zeros(len(distinct), np.int64)
    done = 0
    for first, end, bounds in parts:
        used = np.repeat(train[first:end], np.diff(bounds))
        counts += np.bincount(number[done : done + len(used)][used], minlength=len(distinct)) if len(used) else 0
        done += len(used)
    return train, distinct, kinds, counts, parts, number


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes, so a block's sorted hashes fall into them in order."""
    return ((hashes >> W.U64(32)) * W.U64(shards) >> W.U64(32)).astype(np.int64)


_SHARD = "block int, shard long, hashes binary, counts binary, kinds binary"
_TOTALS = "block int, shard long, totals binary, kind int, n long, types long, hash long"


def _send(shape: Shape, shards: int):
    def send(table: pa.Table) -> pa.Table:
        _, distinct, kinds, counts, _, _ = _block_words(table, shape.endings)
        edges = np.searchsorted(_shard_of(distinct, shards), np.arange(shards + 1))
        full = np.flatnonzero(np.diff(edges))
        cut = lambda x: pa.array([x[edges[s] : edges[s + 1]].tobytes() for s in full], pa.binary())
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array(np.full(len(full), block, np.int32)), "shard": full, "hashes": cut(distinct), "counts": cut(counts.astype(np.int32)), "kinds": cut(kinds)})

    return send


def _total(shape: Shape):
    def total(table: pa.Table) -> pa.Table:
        """For each block the totals of its words; totals by class and the shard's most frequent words."""
        hashes = [np.frombuffer(x, W.U64) for x in table.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("counts").to_pylist()])
        kinds = np.concatenate([np.frombuffer(x, np.int16) for x in table.column("kinds").to_pylist()])
        distinct, at, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        sums = np.bincount(number, weights=counts).astype(np.int64)
        sent = np.split(sums[number], np.cumsum([len(h) for h in hashes])[:-1])
        kind = kinds[at].astype(np.int64)
        n = np.bincount(kind, weights=sums, minlength=shape.endings).astype(np.int64)
        types = np.bincount(kind[sums > 0], minlength=shape.endings)
        order = np.lexsort((distinct, -sums))[: shape.frequent]
        top = order[sums[order] > 0]
        rows, a, b = len(sent), shape.endings, len(top)
        none = lambda m, t: pa.nulls(m, t)
        shard = table.column("shard")[0].as_py()
        return pa.table({
            "block": pa.concat_arrays([table.column("block").combine_chunks(), pa.array(np.full(a + b, -1, np.int32))]),
            "shard": pa.array(np.full(rows + a + b, shard)),
            "totals": pa.concat_arrays([pa.array([s.tobytes() for s in sent], pa.binary()), none(a + b, pa.binary())]),
            "kind": pa.concat_arrays([none(rows, pa.int32()), pa.array(np.arange(a, dtype=np.int32)), pa.array(kind[top].astype(np.int32))]),
            "n": pa.concat_arrays([none(rows, pa.int64()), pa.array(n), pa.array(sums[top])]),
            "types": pa.concat_arrays([none(rows, pa.int64()), pa.array(types.astype(np.int64)), none(b, pa.int64())]),
            "hash": pa.concat_arrays([none(rows + a, pa.int64()), pa.array(distinct[top].view(np.int64))]),
        })

    return total


@dataclass(frozen=True)
class Vocabulary:
    """Frequent words by sorted hash, and counts and types of the ending classes without them."""

    hashes: np.ndarray
    numbers: np.ndarray
    left: np.ndarray
    types: np.ndarray
    tokens: int
    distinct: int


def _vocabulary(totals: DataFrame, docs_in_training: int, shape: Shape) -> Vocabulary:
    extra = totals.filter("block = -1")
    by_kind = extra.filter("hash is null").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect()
    n, types = np.zeros(shape.endings, np.int64), np.zeros(shape.endings, np.int64)
    for r in by_kind:
        n[r.kind], types[r.kind] = r.n, r.types
    top = extra.filter("hash is not null").orderBy(F.desc("n"), "hash").limit(shape.frequent).collect()
    tokens, distinct = int(n.sum()) + docs_in_training, int(types.sum()) + (docs_in_training > 0)
    for r in top:
        n[r.kind] -= r.n
        types[r.kind] -= 1
    hashes = np.array([r.hash for r in top], np.int64).view(W.U64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], (1 + order).astype(np.int16), n, types, tokens, distinct)


def _encode(shape: Shape, vocabulary: Vocabulary, docs_in_training: int):
    v, floor = vocabulary, np.log10(vocabulary.tokens + vocabulary.distinct + 1.0)

    def encode(table: pa.Table, totals: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "within": pa.array([], pa.float64()), "classes": pa.array([], pa.binary())})
        train, distinct, kinds, _, parts, number = _block_words(table, shape.endings)
        order = np.argsort(np.asarray(totals.column("shard"))) if len(totals) else []
        counts = np.concatenate([np.frombuffer(totals.column("totals")[int(i)].as_py(), np.int64) for i in order] or [np.empty(0, np.int64)])
        base = np.log10(counts + 1.0) - floor
        kind = kinds.astype(np.int64)
        within = np.log10(counts + 1.0) - np.log10(v.left[kind] + v.types[kind] + 1.0)
        classes = (1 + shape.frequent + kind).astype(np.int16)
        if len(v.hashes) and len(distinct):
            at = np.minimum(np.searchsorted(v.hashes, distinct), len(v.hashes) - 1)
            own = v.hashes[at] == distinct
            classes[own], within[own] = v.numbers[at[own]], 0.0
        end_base = float(np.log10(docs_in_training + 1.0) - floor)
        known_end = int(docs_in_training > 0)
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "within", "classes")}
        done = 0
        for first, end, bounds in parts:
            own = number[done : done + bounds[-1]]
            done += int(bounds[-1])
            add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[own])])[bounds])
            out["n_tokens"] += (np.diff(bounds) + 1).tolist()
            out["n_known"] += (add((counts > 0).astype(np.int64)) + known_end).tolist()
            out["base_score"] += (add(base) + end_base).tolist()
            out["within"] += add(within).tolist()
            coded = classes[own]
            out["classes"] += [np.append(coded[a:b], np.int16(_END)).astype("<i2").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.table({"doc_id": table.column("doc_id"), "held_out": pa.array(~train), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()), "base_score": pa.array(out["base_score"], pa.float64()), "within": pa.array(out["within"], pa.float64()), "classes": pa.array(out["classes"], pa.binary())})

    return encode


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states


def first_model(shape: Shape) -> Model:
    """States that like to stay, each with its own tilt towards classes; the same every time."""
    k, m = shape.states, shape.classes
    tilt = W.mix(np.arange(m * k, dtype=W.U64) + W.U64(12345)).astype(np.float64).reshape(m, k) / 2.0**64 + 0.5
    move = np.full((k, k), 0.1 / max(k - 1, 1)) if k > 1 else np.ones((1, 1))
    if k > 1:
        np.fill_diagonal(move, 0.9)
    return Model(np.full(k, 1 / k), move, tilt / tilt.sum(axis=0))


@dataclass(frozen=True)
class Stretches:
    """Class numbers of texts one after the other, and each stretch's start, length and text."""

    symbols: np.ndarray
    start: np.ndarray
    length: np.ndarray
    row: np.ndarray

    def __getitem__(self, at) -> Stretches:
        return Stretches(self.symbols, self.start[at], self.length[at], self.row[at])


def stretches(column: pa.Array, size: int) -> Stretches:
    """Texts of up to twice the size are one stretch, longer ones several of the size, the last up to that."""
    texts = [np.frombuffer(x, "<i2") for x in column.to_pylist()]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lengths) - lengths
    own = np.where(lengths <= 2 * size, np.maximum(lengths, 1), size)
    count = -(-lengths // own)
    row = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(own[row], lengths[row] - nth * own[row])
    return Stretches(np.concatenate(texts or [np.empty(0, "<i2")]).astype(np.int64), begin[row] + nth * own[row], length, row)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=0)


#: Steps between scalings of the transfer matrices.
_SCALED = 16


def transfers(part: Stretches, model: Model) -> np.ndarray:
    """For every stretch (last axis) the matrix, up to a factor, from states entering it (second axis) to those at its end (first)."""
    order = np.argsort(-part.length, kind="stable")
    start, length, k = part.start[order], part.length[order], len(model.start)
    out, emit = np.empty((k, k, len(order))), np.ascontiguousarray(model.emit.T)
    if len(order):
        now = np.eye(k)[:, :, None] * emit[:, part.symbols[start]][:, None, :]
        for t in range(1, int(length[0]) + 1):
            n = int(np.searchsorted(-length, -t))
            if n < now.shape[2]:
                out[:, :, n : now.shape[2]] = now[:, :, n:]
                now = np.ascontiguousarray(now[:, :, :n])
            if n:
                now = (model.move.T @ now.reshape(k, k * n)).reshape(k, k, n) * emit[:, part.symbols[start[:n] + t]][:, None, :]
                if t % _SCALED == 0:
                    now /= now.sum(axis=(0, 1))
    out /= out.sum(axis=(0, 1))
    back = np.empty_like(out)
    back[:, :, order] = out
    return back


def rims(part: Stretches, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(states entering each stretch, weights of the states at its end for what follows), up to factors, states first."""
    n, k = len(part.row), len(model.start)
    enters, leaves = np.tile(model.start[:, None], (1, n)), np.ones((k, n))
    first = np.flatnonzero(np.concatenate([[True], part.row[1:] != part.row[:-1]])) if n else np.empty(0, np.int64)
    count = np.diff(np.append(first, n))
    first, count = first[count > 1], count[count > 1]
    if len(first):
        several = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        where = np.empty(n, np.int64)
        where[several] = np.arange(len(several))
        matrices = transfers(part[several], model)
        for nth in range(1, int(count.max())):
            at = first[count > nth] + nth
            enters[:, at] = _unit(model.move.T @ np.einsum("jin,in->jn", matrices[:, :, where[at - 1]], enters[:, at - 1]))
            at = (first + count - 1)[count > nth] - nth
            leaves[:, at] = _unit(model.move @ np.einsum("jin,jn->in", matrices[:, :, where[at + 1]], leaves[:, at + 1]))
    return enters, leaves


def _forward(part: Stretches, enters: np.ndarray, model: Model):
    """(how many stretches are longer than t, first place of each t, symbols, emissions, scaled alphas, scales) of stretches from long to short."""
    steps = int(part.length[0])
    active = np.searchsorted(-part.length, -np.arange(steps + 1), "left")
    place = np.concatenate([[0], np.cumsum(active[:steps])])
    seen = np.concatenate([part.symbols[part.start[: active[t]] + t] for t in range(steps)])
    emit = np.ascontiguousarray(model.emit.T)[:, seen]
    alpha, scale = np.empty_like(emit), np.empty(len(seen))
    for t in range(steps):
        a, n = place[t], active[t]
        now = (model.move.T @ alpha[:, place[t - 1] : place[t - 1] + n] if t else enters[:, :n]) * emit[:, a : a + n]
        now.sum(axis=0, out=scale[a : a + n])
        np.divide(now, scale[a : a + n], out=alpha[:, a : a + n])
    return active, place, seen, emit, alpha, scale


def _long_to_short(part: Stretches) -> Iterator[np.ndarray]:
    """Stretches from long to short, in runs of about `_PART` symbols."""
    order = np.argsort(-part.length, kind="stable")
    run = np.cumsum(part.length[order]) // _PART
    for k in np.unique(run):
        yield order[run == k]


def expected_counts(part: Stretches, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected starts, moves and emissions over the whole texts, and their log likelihood."""
    k, m = len(model.start), len(model.emit)
    enters, leaves = rims(part, model)
    ends, firsts = np.empty_like(enters), np.empty_like(enters)
    first, moves, emits, log = np.zeros(k), np.zeros((k, k)), np.zeros((m, k)), 0.0
    head = np.concatenate([[True], part.row[1:] != part.row[:-1]])
    for at in _long_to_short(part):
        own = part[at]
        active, place, seen, emit, alpha, scale = _forward(own, enters[:, at], model)
        log += float(np.log(scale).sum())
        last = place[own.length - 1] + np.arange(len(at))
        ends[:, at] = alpha[:, last]
        out = leaves[:, at] / (alpha[:, last] * leaves[:, at]).sum(axis=0)
        beta, after = np.empty_like(alpha), np.divide(emit, scale, out=emit)
        for t in range(len(active) - 2, -1, -1):
            a, n, longer = place[t], active[t], active[t + 1]
            beta[:, a + longer : a + n] = out[:, longer:n]
            if longer:
                b = place[t + 1]
                later = after[:, b : b + longer]
                beta[:, a : a + longer] = model.move @ later
                moves += alpha[:, a : a + longer] @ later.T
            after[:, a : a + n] *= beta[:, a : a + n]
        firsts[:, at] = after[:, : len(at)]
        gamma = np.multiply(alpha, beta, out=beta)
        first += gamma[:, : len(at)][:, head[at]].sum(axis=1)
        for s in range(k):
            emits[:, s] += np.bincount(seen, weights=gamma[s], minlength=m)
    inner = np.flatnonzero(~head)
    return first, (moves + ends[:, inner - 1] @ firsts[:, inner].T) * model.move, emits, log


def log_likelihoods(part: Stretches, rows: int, model: Model) -> np.ndarray:
    """Natural log of each text's probability."""
    out, (enters, _) = np.zeros(rows), rims(part, model)
    for at in _long_to_short(part):
        active, _, _, _, _, scale = _forward(part[at], enters[:, at], model)
        owner = np.concatenate([part.row[at[:n]] for n in active[:-1]])
        out += np.bincount(owner, weights=np.log(scale), minlength=rows)
    return out


#: Symbols worked at once, and bytes of coded texts read at once (a text of more by itself).
_PART = 1 << 19
_CODED_BYTES = 1 << 20


def train(coded: DataFrame, shape: Shape) -> Model:
    """Baum-Welch over all training rows of the coded table."""
    spark, model, k, m = coded.sparkSession, first_model(shape), shape.states, shape.classes
    rows = coded.filter("not held_out").select("classes")
    for _ in range(shape.passes):
        broadcast = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], broadcast=broadcast) -> Iterator[pa.RecordBatch]:
            now, sums = broadcast.value, np.zeros(k + k * k + m * k)
            for batch in row_slices(batches, "classes", _CODED_BYTES):
                first, moves, emits, _ = expected_counts(stretches(batch.column("classes"), shape.stretch), now)
                sums += np.concatenate([first, moves.ravel(), emits.ravel()])
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"place": at, "value": sums[at]})

        sums = np.zeros(k + k * k + m * k)
        for r in rows.mapInArrow(count, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
            sums[r.place] = r.value
        first, moves, emits = sums[:k] + 1e-3, sums[k : k + k * k].reshape(k, k) + 1e-3, sums[k + k * k :].reshape(m, k)
        share = (emits.sum(axis=1) + 1.0) / (emits.sum() + m)
        emits = emits + 10.0 * share[:, None]
        model = Model(first / first.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    return model


def encoded(docs: DataFrame, shape: Shape = Shape(), block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Vocabulary]:
    """The documents as class numbers with base scores, checkpointed; and the vocabulary."""
    rows = in_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), block_bytes)
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    stats = rows.agg(F.count(F.when(F.crc32(ids) % 7 != 2, 1)).alias("train"), F.max("block").alias("last")).first()
    shards = max(1, -(-((stats["last"] or 0) + 1) // BLOCKS_A_SHARD))
    blocks = rows.groupBy("block")
    totals = checkpointed(blocks.applyInArrow(_send(shape, shards), _SHARD).groupBy("shard").applyInArrow(_total(shape), _TOTALS))
    vocabulary = _vocabulary(totals, stats["train"], shape)
    back = totals.filter("block >= 0").select("block", "shard", "totals")
    coded = blocks.cogroup(back.groupBy("block")).applyInArrow(_encode(shape, vocabulary, stats["train"]), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary")
    return checkpointed(coded), vocabulary


def score(docs: DataFrame, shape: Shape = Shape(), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    coded, vocabulary = encoded(docs, shape, block_bytes)
    broadcast = docs.sparkSession.sparkContext.broadcast(train(coded, shape))

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, "classes", _CODED_BYTES):
            logs = log_likelihoods(stretches(part.column("classes"), shape.stretch), len(part), broadcast.value)
            score = logs / np.log(10) + np.asarray(part.column("within"))
            kept = {c: part.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")}
            yield pa.RecordBatch.from_pydict(kept | {"score": score})

    scored = coded.mapInArrow(likelihood, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(vocabulary.tokens).cast("long"))
