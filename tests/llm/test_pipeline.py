"""The corpus pipeline stage by stage against brute force, each stage on what its predecessor kept."""

import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from kinelink.llm import line_chunks, queries

SMALL = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
MASK = (1 << 64) - 1


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each, as dictionaries by id."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out, columns = [docs.collect()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        at = str(tmp_path_factory.mktemp("stage"))
        docs.write.mode("overwrite").parquet(at)
        docs = spark.read.parquet(at)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        out.append(docs.collect())
    return out


def texts_of(rows):
    return {r.doc_id: r.text for r in rows}


def test_quality_stage(stages):
    before = {r.doc_id: r for r in stages[0]}
    host_texts, holders = defaultdict(set), defaultdict(set)
    line_of = lambda line: " ".join(SPACED.findall(fold(line)))
    for r in before.values():
        host_texts[r.source].add(r.text)
        for line in r.text.split("\n"):
            if SPACED.search(line):
                holders[r.source, line_of(line)].add((r.text, r.doc_id))
    want = {}
    for d, r in before.items():
        w = SPACED.findall(r.text)
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        repeated = len({i + j for p in at.values() if len(p) > 1 for i in p for j in range(8)})
        kept, lost = [], 0
        for line in r.text.split("\n"):
            have = holders.get((r.source, line_of(line)), set())
            n = len({t for t, _ in have})
            if SPACED.search(line) and n > 20 and n > 0.005 * len(host_texts[r.source]) and min(i for _, i in have) != d:
                lost += len(SPACED.findall(line))
            else:
                kept.append(line)
        left = len(w) - lost
        if len(w) >= 20 and 100 * repeated <= 30 * len(w) and not (lost and (left < 20 or left < 0.3 * len(w))):
            want[d] = "\n".join(kept) if lost else r.text
    assert texts_of(stages[1]) == want and all(r.n_chars == len(r.text) for r in stages[1])


def brute_bounds(lines):
    """Ends of content-defined chunks with whole numbers, line by line."""

    def mix(h):
        h = (h ^ h >> 31) * 0x7FB5D329728EA185 & MASK
        h = (h ^ h >> 27) * 0x81DADEF4BC2DD44D & MASK
        return h ^ h >> 33

    ends, last, before = [], 0, 0
    for i, line in enumerate(lines):
        h = xxhash.xxh64_intdigest(line)
        if mix((h * 0x9E3779B97F4A7C15 + before) & MASK) % line_chunks.DIVISOR == 0 or i + 1 - last == line_chunks.MOST_LINES or i + 1 == len(lines):
            ends.append(i + 1)
            last = i + 1
        before = h
    return ends


def test_line_stage(stages):
    places = defaultdict(list)
    before = texts_of(stages[1])
    lines_of = {d: t.encode().split(b"\n") for d, t in before.items()}
    for d, lines in lines_of.items():
        assert line_chunks.chunk_bounds(lines) == brute_bounds(lines)
        begin = 0
        for end in brute_bounds(lines):
            raw = b"\n".join(lines[begin:end])
            if end - begin > 1 and raw.strip(b" \t\n\x0b\x0c\r"):
                places["chunk", raw].append((d, begin, end))
            begin = end
        words, runs = [len(x.split()) for x in lines], set()
        for i in range(len(lines)):
            ahead = next((e for e in range(i, len(lines) + 1) if sum(words[i:e]) >= 50), None)
            back = next((f for f in range(i, -1, -1) if sum(words[f : i + 1]) >= 50), None)
            runs |= ({(i, ahead)} if ahead is not None else set()) | ({(back, i + 1)} if back is not None else set())
        for i, e in runs:
            places["run", b"\n".join(lines[i:e])].append((d, i, e))
    gone = defaultdict(set)
    for found in places.values():
        first = min(found)
        for d, i, e in found:
            if d != first[0] or i >= first[1] + e - i:
                gone[d] |= set(range(i, e))
    want = {d: b"\n".join(x for i, x in enumerate(lines) if i not in gone[d]).decode() for d, lines in lines_of.items()}
    assert texts_of(stages[2]) == want and any(gone.values())


def simhash(text, k=3):
    w = SPACED.findall(fold(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicate_stage(stages):
    """One document of every group linked by three bits or by five-word Jaccard of 0.8, found by comparing all pairs."""
    before = texts_of(stages[2])
    prints = {d: simhash(t) for d, t in before.items()}
    words = {d: SPACED.findall(fold(t)) for d, t in before.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    root = {d: d for d in before}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(before), 2):
        common = len(sets[a] & sets[b])
        if (prints[a] ^ prints[b]).bit_count() <= 3 or common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {d: t for d, t in before.items() if find(d) == d}
    assert texts_of(stages[3]) == want and len(want) < len(before)


def test_decontamination_stage(spark, stages):
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    known = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = rule.findall(fold(r.text or ""))
        known |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    clean = {}
    for d, t in texts_of(stages[3]).items():
        w = rule.findall(fold(t))
        if not any(tuple(w[i : i + z]) in known for z in {len(x) for x in known} for i in range(len(w) - z + 1)):
            clean[d] = t
    assert texts_of(stages[4]) == clean and clean


def test_packing_stage_and_run(spark, stages):
    tokenizer, own, bins = Tokenizer.from_file(queries.VOCABULARY), defaultdict(list), defaultdict(list)
    for r in stages[5]:
        own[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for d, t in texts_of(stages[4]).items():
        ids, at = [*tokenizer.encode(t, add_special_tokens=False).ids, 2], 0
        for r in sorted(own.pop(d), key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not own
    for places in bins.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024
    plain = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert plain(corpus_pipeline.run(spark, SMALL).collect()) == plain(stages[5])


def test_stages_of_empty_and_odd_documents(spark):
    """No rows, and rows with null ids and hosts, empty and repeated texts: every stage keeps its columns and what is clean."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    clean = lambda c: " ".join(f"{c}{i}" for i in range(60))
    odd = [(None, clean("a"), None, None, None), (None, clean("b"), "x", None, 1), (3, clean("c"), None, "h", None), (3, clean("c"), None, "h", None), (4, None, None, None, None), (None, None, None, None, None), (5, "", "x", "h", 0), (None, clean("a"), None, "h", None)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, columns)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            found = docs.collect()
            if name != "packing":
                assert docs.columns == [c.split()[0] for c in columns.split(", ")]
                want = {"quality rules": 5, "line dedup": 5, "near-dedup": 3, "decontamination": 3}[name]
                assert len(found) == (want if rows else 0)
            else:
                assert len(found) == (3 if rows else 0)
