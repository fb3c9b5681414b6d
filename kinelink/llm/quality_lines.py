"""Operator 1: quality rules with cross-document line frequency.

Lines are normalised (ASCII lower case, white space collapsed) and hashed. For each host the
documents that hold a line are counted, without `count_copies` each text once, which leaves copies of whole documents
to a near-duplicate stage. A line is above its host's limit if more than
max(min_docs, share * documents of the host) documents hold it; the limit follows the host's size, so
a host behaves alike at every scale. Such a line is removed everywhere but in the document with the
smallest id that holds it, and a document that this leaves with too few words is rejected.

Rules of each text (words are runs of anything but ASCII white space): word counts, symbol counts,
repeated lines and words in repeated windows; see `text_statistics`.

Nulls: a null text has no words and fails the base rule; a null host is a host of its own; a null id
is never the one that keeps a line. Rows that repeat (same id, host and text) share one verdict.
Columns of the input named like the results are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelink.llm import words as W
from kinelink.llm.tables import checkpointed, free_names, row_key, row_slices

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

_STATS = "doc_id long, host string, key long, fingerprint long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def repeat_words(numbers: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text, how many of its words, given by number, lie in windows that the text has twice or more."""
    n, out = len(numbers), np.zeros(len(bounds) - 1, np.int64)
    starts = np.flatnonzero(W.inside(bounds, window, n))
    if not len(starts):
        return out
    text = np.repeat(np.arange(len(out)), np.diff(bounds))
    names = W.window_names(numbers, window)[starts] * len(out) + text[starts]
    _, place, times = np.unique(names, return_inverse=True, return_counts=True)
    twice = times[place] > 1
    if twice.any():
        np.add.at(out, text[W.covered(starts[twice], window, n)], 1)
    return out


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def _lines(text: str) -> tuple[int, list[int], list[int]]:
    """(lines equal to an earlier one, hashes of the distinct normalised lines, words under each)."""
    seen, repeated, found = set(), 0, {}
    for line in text.split("\n"):
        raw = line.encode()
        tokens = raw.split()
        if not tokens:
            continue
        repeated += line in seen
        seen.add(line)
        h = xxhash.xxh64_intdigest(b" ".join(raw.lower().split()))
        h -= (h >> 63) << 64
        found[h] = found.get(h, 0) + len(tokens)
    return repeated, list(found), list(found.values())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for first, end, _, _ in W.text_slices(texts):
            rows = [t or "" for t in texts.slice(first, end - first).to_pylist()]
            tokens = [t.encode().split() for t in rows]
            bounds = np.cumsum([0, *map(len, tokens)])
            repeats = repeat_words(W.numbered(tokens), bounds)
            lines = [_lines(t) for t in rows]
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c).slice(first, end - first) for c in ("doc_id", "host", "key", "fingerprint")},
                "n_words": np.diff(bounds),
                "word_chars": pa.array([len(t) - sum(map(t.count, " \t\n\x0b\x0c\r")) for t in rows], pa.int64()),
                "n_symbols": pa.array([sum(map(t.count, SYMBOLS)) for t in rows], pa.int64()),
                "n_dup_lines": pa.array([x[0] for x in lines], pa.int64()),
                "n_repeat_words": repeats,
                "lines": pa.array([x[1] for x in lines], pa.list_(pa.int64())),
                "line_words": pa.array([x[2] for x in lines], pa.list_(pa.int32())),
            })


def text_statistics(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rules' counts of each text, its distinct line hashes and the words under each."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), row_key("doc_id", host, "text").alias("key"), F.xxhash64("text").alias("fingerprint"), "text")
    return keyed.mapInArrow(_measure, _STATS)


def frequent_lines(stats: DataFrame, min_docs: int, share: float, count_copies: bool = True) -> DataFrame:
    """(host, line, keeper): lines above the host's limit and the smallest id that holds each.

    Documents are told apart by their id and text, without count_copies by their text.
    """
    one = ["fingerprint", "key"] if count_copies else ["fingerprint"]
    held = stats.select("host", *one, "doc_id", F.explode("lines").alias("line"))
    counted = held.groupBy("host", "line", *one).agg(F.min("doc_id").alias("doc_id")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("keeper"))
    hosts = stats.groupBy("host", *one).agg(F.lit(1)).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    busy = counted.filter(F.col("n_docs") > min_docs).alias("l").join(hosts.alias("h"), F.col("l.host").eqNullSafe(F.col("h.host")))
    return busy.filter(F.col("n_docs") > F.col("host_docs") * share).select("l.host", "line", "keeper")


def _removals(stats: DataFrame, frequent: DataFrame) -> DataFrame:
    """(key, doc_id, removed_words, removed_lines): what each document loses."""
    held = stats.select("key", "doc_id", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("key", "doc_id", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("n"))
    lost = held.alias("a").join(frequent.alias("f"), (F.col("a.line") == F.col("f.line")) & F.col("a.host").eqNullSafe(F.col("f.host")))
    lost = lost.filter(~F.col("a.doc_id").eqNullSafe(F.col("f.keeper"))).select("a.key", "a.doc_id", "a.line", "a.n").distinct()
    return lost.groupBy("key", "doc_id").agg(F.sum("n").alias("removed_words"), F.collect_list("line").alias("removed_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, host: str = "source", min_docs: int = 20, share: float = 0.005, min_left: int = MIN_WORDS, min_left_share: float = 0.3, count_copies: bool = True) -> DataFrame:
    """One row for each row of docs: counts, base_failed, removed words and lines, kept."""
    stats = checkpointed(text_statistics(docs, host))
    removed = _removals(stats, frequent_lines(stats, min_docs, share, count_copies))
    judged = stats.drop("lines", "line_words").alias("s").join(removed.alias("r"), (F.col("s.key") == F.col("r.key")) & F.col("s.doc_id").eqNullSafe(F.col("r.doc_id")), "left").select("s.*", F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"), "removed_lines")
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < min_left) | (left < min_left_share * F.col("n_words")))
    return judged.withColumn("base_failed", base_failed()).withColumn("depleted", depleted).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def _drop_lines(gone: str):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for i, lines in enumerate(batch.column(gone).to_pylist()):
                if lines and texts[i]:
                    hashes = set(lines)
                    texts[i] = "\n".join(x for x in texts[i].split("\n") if _signed(normal_line(x.encode())) not in hashes)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return drop


def _signed(line: bytes) -> int | None:
    if not line:
        return None
    h = xxhash.xxh64_intdigest(line)
    return h - ((h >> 63) << 64)


def filter_documents(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """docs without rejected documents, frequent lines removed; same columns, whatever they are called (n_chars follows the text)."""
    key, gone = free_names(docs, "_key", "_removed_lines")
    verdicts = judge(docs, host, **limits).filter("kept").groupBy("key", "doc_id").agg(F.first("removed_lines").alias("removed_lines"))
    keyed = docs.withColumn(key, row_key("doc_id", host, "text"))
    kept = keyed.alias("d").join(verdicts.alias("v"), (F.col(f"d.{key}") == F.col("v.key")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("v.doc_id"))).select("d.*", F.col("v.removed_lines").alias(gone))
    out = kept.mapInArrow(_drop_lines(gone), kept.schema).drop(key, gone)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
