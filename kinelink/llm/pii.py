"""Operator 7: personal data, and terms that reveal it, by information-theoretic sanitisation.

Base rules find emails, IP addresses, card and phone numbers. Every value found is a protected entity
e. The words of its texts are candidate terms t. Over all documents, with N documents, n(e) that hold e, n(t) that
hold t and n(e, t) that hold both, a term discloses e as far as

    PMI(e; t) = log2(n(e, t) * N / (n(e) * n(t)))

reaches the entity's information content IC(e) = log2(N / n(e)). A term whose share PMI / IC is at
least `threshold`, and which `min_texts` different texts hold together with e, is a span of its own wherever it
stands in a text that holds e. Spans are generalised to their kind or removed.

Values that stand once in a corpus co-occur with nothing twice, so opaque strings (OPAQUE: long runs that mix letters and digits, of
SECRET_BITS or more by their own characters' entropy) are pooled into one entity, `secret`. A word that discloses that entity, such as the name a
credential is assigned to, makes each opaque string near it a span of kind `secret` (near: among the NEAR_WORDS words on either side, within
NEAR_CHARS characters); opaque strings that no word gives away stay.

Co-occurrence is that of whole texts: every word of a text that no span touches is a candidate term. Entities that fewer than `min_texts` texts hold
can have no term, so only texts with another entity are read again. n(t) is counted for all words in one
pass over the documents, summed inside each task before it is shuffled, and joined to the candidate terms.

Nulls: a null text is empty. Rows that repeat count as documents each (but as one text) and get equal
answers. A null id does no harm. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelink.llm.decontaminate import normal_words
from kinelink.llm.tables import checkpointed, free_names, row_key, row_slices

KINDS = ("email", "ip", "card", "phone", "secret", "term")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number's first digit follows no digit, or a later start would only fail again: this keeps runs of digits linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
OPAQUE = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])")
SECRET_BITS = 60
SECRET = "secret:"
NEAR_WORDS = 5
NEAR_CHARS = 160


def emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        floor = at + 1
        if found:
            yield start, found.end()
            floor = found.end()
        at = text.find("@", floor)


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind."""
    found = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m.group())) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def near_words(text: str, span: tuple[int, int, str]) -> set[str]:
    """The words close to a span."""
    s, e, _ = span
    lo, hi = max(0, s - NEAR_CHARS), min(len(text), e + NEAR_CHARS)
    left = [m.group() for m in _TERM.finditer(text, lo, s) if lo == 0 or m.start() > lo]
    right = [m.group() for m in _TERM.finditer(text, e, hi) if hi == len(text) or m.end() < hi]
    return {w.lower() for w in left[-NEAR_WORDS:] + right[:NEAR_WORDS]}


def free_words(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) of every word of two characters or more that no span touches."""
    cuts, at = sorted(spans), 0
    reach = 0  # where the spans begun so far end
    for m in _TERM.finditer(text):
        while at < len(cuts) and cuts[at][0] < m.end():
            reach, at = max(reach, cuts[at][1]), at + 1
        if m.end() - m.start() > 1 and reach <= m.start():
            yield m.group().lower(), m.start(), m.end()


def entity_of(text: str, span: tuple[int, int, str]) -> str:
    """The entity that a span stands for: its value, or the pooled one of opaque strings."""
    return SECRET if span[2] == "secret" else f"{span[2]}:{text[span[0] : span[1]].lower()}"


def near_terms(text: str, spans: list[tuple[int, int, str]], only: set[str] | None = None) -> Iterator[tuple[str, str, int, int]]:
    """(entity, term, start, end) of every word of the text that no span touches, for each entity of the spans (or those of `only`)."""
    entities = {entity_of(text, x) for x in spans}
    entities = sorted(entities if only is None else entities & only)
    for word, start, end in free_words(text, spans) if entities else ():
        for entity in entities:
            yield entity, word, start, end


def opaque_spans(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The opaque strings that no base span touches."""
    out = []
    for m in OPAQUE.finditer(text):
        value = m.group()
        if any(c in "0123456789" for c in value) and any(c.isalpha() for c in value) and not any(m.start() < e and s < m.end() for s, e, _ in spans):
            bits = sum(n * math.log2(len(value) / n) for n in Counter(value).values())
            if bits >= SECRET_BITS:
                out.append((m.start(), m.end(), "secret"))
    return out


_SPAN = "start:int,end:int,kind:string"
_FOUND = f"doc_id long, key long, spans array<struct<{_SPAN}>>, entities array<string>, text string"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def _named(spans: list[tuple[int, int, str]]) -> list[dict]:
    return [dict(zip(("start", "end", "kind"), x)) for x in spans]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and entities of every text; texts with an entity go along, so that no later step needs the others."""
    for batch in batches:
        spans, entities = [], []
        for text in batch.column("text").to_pylist():
            own = base_spans(text or "")
            held = {entity_of(text, x) for x in [*own, *(opaque_spans(text, own) if text else ())]}
            spans.append(_named(own))
            entities.append(sorted(held))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "spans": pa.array(spans, _SPANS), "entities": pa.array(entities, pa.list_(pa.string())), "text": pa.array([t if held else None for t, held in zip(batch.column("text").to_pylist(), entities)], pa.string())})


def _terms_beside(batches: Iterator[pa.RecordBatch], near: bool) -> Iterator[pa.RecordBatch]:
    """(entity, term, doc_id, key) of each text's entities and words, a word once; with `near` also words close to opaque strings that a span touches."""
    for batch in row_slices(batches):
        for text, doc, key, held in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "key", "held"))):
            own = base_spans(text)
            wanted = set(held) - {SECRET}
            told = {x[:2] for x in near_terms(text, own, wanted)}
            if SECRET in held:
                hidden = opaque_spans(text, own)
                told |= {x[:2] for x in near_terms(text, own + hidden, {SECRET})}
                told |= {(SECRET, w) for x in hidden for w in near_words(text, x)} if near else set()
            entities, terms = zip(*sorted(told)) if told else ((), ())
            yield pa.RecordBatch.from_pydict({"entity": pa.array(entities, pa.string()), "term": pa.array(terms, pa.string()), "doc_id": pa.array([doc] * len(terms), pa.int64()), "key": pa.array([key] * len(terms), pa.int64())})


def _told_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, terms): the places of disclosing words, and the opaque strings that such words give away."""
    for batch in row_slices(batches):
        out = []
        for text, held in zip(batch.column("text").to_pylist(), batch.column("held").to_pylist()):
            own = base_spans(text)
            hidden = opaque_spans(text, own)
            telling = {x["term"] for x in held if x["entity"] == SECRET}
            pairs = {(x["entity"], x["term"]) for x in held}
            terms = sorted({(s, e, "term") for entity, w, s, e in near_terms(text, own, {x[0] for x in pairs}) if (entity, w) in pairs})
            out.append(_named(terms + [x for x in hidden if telling & near_words(text, x)]))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "terms": pa.array(out, _SPANS)})


#: Different words that a task counts before it hands their sums on.
COUNTED_WORDS = 200_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many of the texts each word stands."""
    seen: Counter = Counter()
    give = lambda: pa.RecordBatch.from_pydict({"term": pa.array([t.decode() for t in seen], pa.string()), "n": pa.array(seen.values(), pa.int64())})
    for batch in row_slices(batches):
        for text in batch.column("text").to_pylist():
            if text:
                seen.update(set(normal_words(text.lower())))
                if len(seen) > COUNTED_WORDS:
                    yield give()
                    seen.clear()
    yield give()


def term_documents(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_term): how many documents hold each of the terms. Tasks' sums are added up first, so the join sees a word once."""
    counted = docs.select("text").mapInArrow(_count_words, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return terms.join(counted, "term")


def _with_held(found: DataFrame, held: DataFrame) -> DataFrame:
    """The rows with an entity and what is held by their id and key."""
    docs = found.filter(F.size("entities") > 0).select("doc_id", "key", "text")
    same = (F.col("d.key") == F.col("h.key")) & F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))
    return docs.alias("d").join(held.alias("h"), same).select("d.doc_id", "d.key", "d.text", "h.held")


def words_beside(found: DataFrame, held: DataFrame, near: bool = False) -> DataFrame:
    """(entity, term, doc_id, key): the words of every text, for each of its entities held."""
    return _with_held(found, held).mapInArrow(partial(_terms_beside, near=near), "entity string, term string, doc_id long, key long")


def disclosing_terms(docs: DataFrame, found: DataFrame, threshold: float, min_texts: int) -> DataFrame:
    """(entity, term) above the disclosure threshold."""
    n_docs = found.count()
    each = found.select("doc_id", "key", F.explode("entities").alias("entity"))
    entities = checkpointed(each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.count_distinct("key").alias("texts")).filter(F.col("texts") >= min_texts).drop("texts"))
    held = each.join(entities, "entity", "left_semi").groupBy("doc_id", "key").agg(F.collect_set("entity").alias("held"))
    both = checkpointed(words_beside(found, held).groupBy("entity", "term", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= min_texts))
    terms = term_documents(docs, both.select("term").distinct())
    content = F.log2(F.lit(float(n_docs)) / F.col("n_entity"))
    pmi = F.log2(F.col("n_both") * F.lit(float(n_docs)) / (F.col("n_entity") * F.col("n_term")))
    return both.join(entities, "entity").join(terms, "term").filter((content > 0) & (pmi >= threshold * content)).select("entity", "term")


def held_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, key, held): the disclosing (entity, term) that both stand in a text. Words of the texts meet the terms; terms of an entity never meet all its texts."""
    telling = found.select("doc_id", "key", F.explode("entities").alias("entity")).join(terms.select("entity").distinct(), "entity", "left_semi").groupBy("doc_id", "key").agg(F.collect_set("entity").alias("held"))
    told = words_beside(found, telling, near=True).join(terms, ["entity", "term"], "left_semi")
    return told.groupBy("doc_id", "key").agg(F.collect_set(F.struct("entity", "term")).alias("held"))


def find_private(docs: DataFrame, threshold: float = 0.9, min_texts: int = 3) -> DataFrame:
    """doc_id, key (of id and text), base spans and all spans of every row."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("text").alias("key"), "text")
    found = checkpointed(keyed.mapInArrow(_find, _FOUND))
    held = held_terms(found, checkpointed(disclosing_terms(keyed, found, threshold, min_texts)))
    told = _with_held(found, held).dropDuplicates(["doc_id", "key"]).mapInArrow(_told_spans, f"doc_id long, key long, terms array<struct<{_SPAN}>>")
    f, t = found.select("doc_id", "key", "spans").alias("f"), told.alias("t")
    joined = f.join(t, (F.col("f.key") == F.col("t.key")) & F.col("f.doc_id").eqNullSafe(F.col("t.doc_id")), "left")
    kinds = f"array({', '.join(map(repr, KINDS))})"
    order = f"(a, b) -> cast(case when a.start <> b.start then a.start - b.start when a.kind = b.kind then a.end - b.end else array_position({kinds}, a.kind) - array_position({kinds}, b.kind) end as int)"
    every = F.concat("spans", F.coalesce("terms", F.expr(f"cast(array() as array<struct<{_SPAN}>>)")))
    return joined.select("f.doc_id", "f.key", F.col("spans").alias("base"), every.alias("every")).withColumn("every", F.expr(f"array_sort(every, {order})"))


def span_string(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, **limits) -> DataFrame:
    found = find_private(docs, **limits)

    def count(column: str, kind: str) -> Column:
        return F.size(F.filter(column, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count("base", kind) for kind in KINDS[:4]), F.sha2(span_string("base").cast("binary"), 256).alias("base_sha256"), span_string("every").alias("spans"), count("every", "secret"), count("every", "term"))


def sanitise(docs: DataFrame, generalise: bool = True, **limits) -> DataFrame:
    """docs with every span generalised to its kind, or removed; same columns."""
    found = find_private(docs, **limits).filter(F.size("every") > 0).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "every")
    key, listed = free_names(docs, "_key", "_spans")
    same = (F.col(f"d.{key}") == F.col("f.key")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("f.doc_id"))
    joined = docs.withColumn(key, row_key("text")).alias("d").join(found.alias("f"), same, "left").select("d.*", F.col("f.every").alias(listed))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(listed).to_pylist()):
                if spans and texts[i]:
                    out, done = [], 0
                    for s in spans:
                        if s["start"] >= done:
                            out += [texts[i][done : s["start"]], f"[{s['kind'].upper()}]" if generalise else ""]
                        done = max(done, s["end"])
                    texts[i] = "".join([*out, texts[i][done:]])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return joined.mapInArrow(clean, joined.schema).drop(key, listed)
