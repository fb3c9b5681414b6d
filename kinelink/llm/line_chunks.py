"""Operator 9: line dedup by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines decides where chunks end, so boundaries follow the
content and shift with it. Chunks of two lines or more that stand at several places are removed
everywhere but at the first (smallest id, then place), after their bytes have been compared: chunks are
matched by digest, and a digest counts only if all its chunks are equal byte for byte.

With `words`, runs of lines of so many words or more that stand at several places go too, wherever chunks end: from every line
runs the shortest window of lines with so many words, and to every line one runs back, so these windows cover
every such run whole, one long line as well as many short ones. Windows are matched by 128-bit hash, bytes are not
compared. A place that overlaps the first in the same text is no second place.

Nulls: a null text has no lines. Rows that repeat (same id and text) are one document: what one keeps the
other keeps. Null ids come last. A chunk of blank lines stays. Other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kinelink.llm import words as W
from kinelink.llm.tables import checkpointed, free_names, heavy_join, row_key, row_slices

DIVISOR = 4
MOST_LINES = 32
#: The pipeline removes repeated runs of lines of so many words.
PASSAGE_WORDS = 50


def chunk_bounds(lines: list[bytes], divisor: int = DIVISOR, most: int = MOST_LINES) -> list[int]:
    """Ends of the chunks, in lines."""
    n = len(lines)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, lines), W.U64, n)
    before = np.concatenate([np.zeros(1, W.U64), hashes[:-1]])
    rolled = W.mix(hashes * W.U64(0x9E3779B97F4A7C15) + before)
    ends, last = [], 0
    for end in [*(np.flatnonzero(rolled % W.U64(divisor) == 0) + 1).tolist(), n]:
        while end - last > most:
            last += most
            ends.append(last)
        if end > last:
            ends.append(end)
            last = end
    return ends


def chunks(text: str | None) -> list[tuple[int, int, bytes]]:
    """(first line, end line, bytes) of every chunk."""
    if text is None:
        return []
    lines = text.encode().split(b"\n")
    out, last = [], 0
    for end in chunk_bounds(lines):
        out.append((last, end, b"\n".join(lines[last:end])))
        last = end
    return out


def _several(first: int, end: int, raw: bytes) -> bool:
    return end - first > 1 and bool(raw.strip(W.SPACES))


def passages(text: str | None, words: int = PASSAGE_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(first line, end line, bytes) of the shortest run of lines with `words` words from each line on, and back from each."""
    if text is None:
        return
    lines = text.encode().split(b"\n")
    total = np.concatenate([[0], np.cumsum([len(line.split()) for line in lines])])
    ends = np.searchsorted(total, total[:-1] + words)
    firsts = np.searchsorted(total, total[1:] - words, "right") - 1
    found = {(i, e) for i, e in enumerate(ends.tolist()) if e <= len(lines)} | {(f, i + 1) for i, f in enumerate(firsts.tolist()) if f >= 0}
    for first, end in sorted(found):
        yield first, end, b"\n".join(lines[first:end])


def _digests(words: int | None):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            rows, place, ends, digest = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                spans = [(first, end, hashlib.sha256(raw).digest()) for first, end, raw in chunks(text) if _several(first, end, raw)]
                if words:
                    spans += [(first, end, xxhash.xxh3_128_digest(raw)) for first, end, raw in passages(text, words)]
                rows += [i] * len(spans)
                for values, part in zip((place, ends, digest), zip(*spans)):
                    values += part
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(take), "key": batch.column("key").take(take), "place": pa.array(place, pa.int32()), "end": pa.array(ends, pa.int32()), "digest": pa.array(digest, pa.binary())})

    return make


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chunks at the given places."""
    for batch in row_slices(batches):
        digest, raws = [], []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
            wanted = {p["place"] for p in places or ()}
            for first, _, raw in chunks(text) if wanted else ():
                if first in wanted:
                    digest.append(hashlib.sha256(raw).digest())
                    raws.append(raw)
        yield pa.RecordBatch.from_pydict({"digest": pa.array(digest, pa.binary()), "raw": pa.array(raws, pa.binary())})


def _keyed(docs: DataFrame, doc_id: str, key: str) -> DataFrame:
    return docs.withColumn(doc_id, F.col("doc_id").cast("long")).withColumn(key, row_key("text"))


def _with_places(keyed: DataFrame, doc_id: str, key: str, listed: str, places: DataFrame, how: str) -> DataFrame:
    """keyed, with the columns doc_id and key of its rows, and the places of each in the column `listed`."""
    lists = places.groupBy("doc_id", "key").agg(F.collect_list(F.struct("place", "end")).alias("places"))
    same = (F.col(f"d.{key}") == F.col("p.key")) & F.col(f"d.{doc_id}").eqNullSafe(F.col("p.doc_id"))
    return keyed.alias("d").join(lists.alias("p"), same, how).select("d.*", F.col("p.places").alias(listed))


def repeated_chunks(docs: DataFrame, words: int | None = None) -> DataFrame:
    """(doc_id, key, place, end): lines of the chunks to remove, bytes compared, and with `words` of the passages."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("text").alias("key"), "text")
    places = checkpointed(source.mapInArrow(_digests(words), "doc_id long, key long, place int, end int, digest binary").distinct())
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "place")
    several = checkpointed(places.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1"))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    keeps = own & (F.col("place") < F.col("first.place") + F.col("end") - F.col("place"))
    shared = checkpointed(heavy_join(places, several, "digest", "n").withColumn("keeps", keeps).drop("first"))
    is_chunk = F.octet_length("digest") == 32
    raw = _with_places(source, "doc_id", "key", "places", shared.filter(is_chunk), "inner").mapInArrow(_bytes, "digest binary, raw binary")
    sure = raw.groupBy("digest", "raw").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("forms"), F.max("n").alias("n")).filter("forms = 1").select("digest", "n")
    gone = heavy_join(shared.filter(is_chunk & ~F.col("keeps")), checkpointed(sure), "digest", "n").select("doc_id", "key", "place", "end")
    return gone.unionByName(shared.filter(~is_chunk & ~F.col("keeps")).select("doc_id", "key", "place", "end")) if words else gone


_COUNTS = ("_lines", "_chunks", "_gone_chunks", "_gone_lines")


def remove_chunks(docs: DataFrame, counts: bool = False, words: int | None = None) -> DataFrame:
    """docs with repeated chunks, and with `words` repeated passages, removed from their texts; n_chars, if there, follows.

    The counts are of chunks and go without `words`.
    """
    if counts and words:
        raise ValueError("counts are of chunks only")
    doc_id, key, listed = free_names(docs, "_id", "_key", "_places")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            at = batch.schema.get_field_index("text")
            texts, seen = batch.column(at).to_pylist(), []
            for i, places in enumerate(batch.column(listed).to_pylist()):
                if places:
                    lines = texts[i].encode().split(b"\n")
                    left = np.ones(len(lines), bool)
                    for p in places:
                        left[p["place"] : p["end"]] = False
                if counts:
                    gone, own = {p["place"] for p in places or ()}, chunks(texts[i])
                    seen.append((own[-1][1] if own else 0, len(own), len(gone), sum(e - f for f, e, _ in own if f in gone)))
                if places:
                    texts[i] = b"\n".join(lines[k] for k in np.flatnonzero(left)).decode()
            out = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            for k, name in enumerate(_COUNTS if counts else ()):
                out = out.append_column(name, pa.array([x[k] for x in seen], pa.int64()))
            yield out

    marked = _with_places(_keyed(docs, doc_id, key), doc_id, key, listed, repeated_chunks(docs, words), "left")
    schema = StructType([*marked.schema.fields, *(StructField(name, LongType()) for name in (_COUNTS if counts else ()))])
    out = marked.mapInArrow(clean, schema).drop(listed, doc_id, key)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def report(docs: DataFrame) -> DataFrame:
    """One row per document: lines, chunks, what was removed, length and digest of what stays."""
    out = remove_chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), counts=True)
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_chunks").alias("n_chunks"), F.col("_gone_chunks").alias("n_removed_chunks"), F.col("_gone_lines").alias("n_removed_lines"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
