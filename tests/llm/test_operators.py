"""The ten operators against brute force, and their defined results for awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinelink.llm import chat_format, decontaminate, hmm_lm, line_chunks, packing, phrase_dedup, pii, pretokens, quality_lines, queries, simhash, token_counts
from kinelink.llm import words as W
from kinelink.operators.graphs import connected_components

SMALL = "/root/testdata/sf0.001"
LONG = "lorem " * 30000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, key long, word string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "a b c"), (5, "a b c"), (None, "x y\nz w\n"), (6, passage), (7, f"start {passage} end"), (None, None), (8, "é" * 5000), (9, "mail a@b.c"), (9, "mail a@b.c")]
    return spark.createDataFrame([(i, t, None, None, None, "k", 5, None) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1


def brute_repeats(text, k=8):
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - k + 1):
        at[tuple(w[i : i + k])].append(i)
    return len({i + j for p in at.values() if len(p) > 1 for i in p for j in range(k)})


def test_quality_counts(docs, texts):
    for d, r in by_id(quality_lines.judge(docs)).items():
        w = WORD.findall(texts[d])
        lines = [x for x in texts[d].split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), brute_repeats(texts[d]))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", texts[d]))
        assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w))


def test_quality_removes_frequent_lines_and_depleted_documents(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, f"Shared  LINE of the host\n{own(i)}", "h") for i in range(10)] + [(50, "shared line of the host\n" + " ".join(f"q{j}" for j in range(16)), "h"), (60, f"shared line of the host\n{own(60)}", "other"), (61, own(0), "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = by_id(quality_lines.judge(df, min_docs=5, share=0.1))
    assert judged[0].removed_words == 0 and judged[3].removed_words == 5 and judged[60].removed_words == 0
    assert not judged[50].base_failed and not judged[50].kept and judged[3].kept
    out = by_id(quality_lines.filter_documents(df, min_docs=5, share=0.1))
    assert out[3].text == own(3) and out[0].text.startswith("Shared") and 50 not in out and out[60].text.startswith("shared")
    assert out.keys() == set(range(10)) | {60, 61}
    # copies of a whole document count each, or once on request
    copies = spark.createDataFrame([(i, f"copied line of the host\n{own(1)}", "h") for i in range(8)] + [(20 + i, own(20 + i), "h") for i in range(8)], "doc_id long, text string, source string")
    kept = lambda **k: {r.doc_id for r in quality_lines.judge(copies, min_docs=5, share=0.1, **k).filter("kept").collect()}
    assert kept() == {0, *range(20, 28)} and kept(count_copies=False) == {*range(8), *range(20, 28)}


def test_quality_awkward(awkward, empty):
    judged = quality_lines.judge(awkward)
    assert judged.count() == awkward.count() and quality_lines.judge(empty).count() == 0
    assert {r.doc_id for r in judged.filter("kept").collect()} <= {6, 7}
    assert quality_lines.filter_documents(awkward).columns == awkward.columns


# 2


def test_decontamination_spans(spark):
    items = spark.createDataFrame([(1, "Alpha BETA gamma"), (2, " ".join(f"t{i}" for i in range(12))), (3, None), (4, "?!"), (5, "beta gamma")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "x alpha, beta-gamma y"), (2, "z " + " ".join(f"T{i}" for i in range(1, 12))), (3, "alpha beta"), (4, None), (None, "")], "doc_id long, text string")
    for chars in (10**6, 60):
        got = by_id(decontaminate.report(rows, items, max_chars=chars))
        assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].items_sha256) == (5, 3, 2, hashlib.sha256(b"1,5").hexdigest())
        assert (got[2].n_hit, got[2].n_items) == (11, 1) and not got[3].contaminated and got[4].n_words == 0
    assert {r.doc_id for r in decontaminate.decontaminate(rows, items).collect()} == {3, 4, None}
    cut = by_id(decontaminate.decontaminate(rows, items, remove="spans"))
    assert cut[1].text == "x  y" and cut[2].text == "z " and cut[3].text == "alpha beta"


def test_decontamination_awkward(spark, awkward, empty):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontaminate.report(awkward, items).count() == awkward.count()
    assert decontaminate.report(empty, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(awkward, items.limit(0)).collect())
    assert decontaminate.decontaminate(awkward, items).columns == awkward.columns


def brute_hits(texts, items, k=10):
    """Per text: words that an item's window covers, and the items."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    known = defaultdict(set)
    for i, t in items:
        w = words(t)
        for j in range(len(w) - min(k, len(w)) + 1 if w else 0):
            known[tuple(w[j : j + k])].add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for z in {len(x) for x in known}:
            for j in range(len(w) - z + 1):
                if tuple(w[j : j + z]) in known:
                    hit |= set(range(j, j + z))
                    found |= known[tuple(w[j : j + z])]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("chars", [8_000_000, 20_000])
def test_decontamination_of_documents(spark, docs, texts, chars):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = dict(zip(texts, brute_hits(texts.values(), [(str(r.item_id), r.text) for r in items.collect()])))
    got = by_id(decontaminate.report(docs, items.unionByName(items), max_chars=chars))
    for d, (n, hit, found) in want.items():
        assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].items_sha256) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest())
    assert any(hit for _, hit, _ in want.values())


# 3 and 5


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.VOCABULARY)


def test_token_counts_equal_the_library(docs, texts, tokenizer):
    got = by_id(token_counts.token_counts(docs, queries.VOCABULARY))
    for d, t in texts.items():
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len(t.encode()), n, n > 1024)


@pytest.mark.parametrize("point", [0x558, 0x88F, 0xC5C, 0x208F, 0x3D000, 0x3FC3F])
def test_token_counts_of_code_points_of_later_unicode(point):
    tokenizer = Tokenizer.from_file(queries.VOCABULARY)
    texts = [f"{chr(point)}'s", f"a{chr(point)}", f"1{chr(point)}", f"!{chr(point)} {chr(point)}"]
    got = token_counts.count_tokens(pa.array(texts), *token_counts._store(queries.VOCABULARY))
    assert got.tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["'s", "'ll", " ", "  ", "\n", "<|endoftext|>", "aaaa", "----", "\u00a0", "1", "é", "漢", "😀", "'"]), st.text(max_size=4))))
def test_token_counts_of_any_text(parts):
    tokenizer = test_token_counts_of_any_text.__dict__.setdefault("t", Tokenizer.from_file(queries.VOCABULARY))
    texts = ["".join(parts), "", "".join(reversed(parts))]
    got = token_counts.count_tokens(pa.array(texts), *token_counts._store(queries.VOCABULARY))
    assert got.tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_tokens_awkward(awkward, empty):
    for f in (lambda d: token_counts.token_counts(d, queries.VOCABULARY), lambda d: packing.pack_documents(d, queries.VOCABULARY)):
        assert f(empty).count() == 0
        assert {r.doc_id for r in f(awkward).collect()} == {r.doc_id for r in awkward.collect()}


def test_packing_pieces_and_places(docs, texts, tokenizer):
    rows = packing.pack_documents(docs, queries.VOCABULARY).collect()
    own, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for d, t in texts.items():
        ids, at = [*tokenizer.encode(t, add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(own[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (len(ids) <= 1024) == (len(own[d]) == 1)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) and (k == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = [r.length for r in rows]
    assert len(bins) <= brute_best_fit(lengths, 1024) and len(bins) <= math.ceil(sum(lengths) / 1024) * 1.02 + 1


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = min((r for r in rooms if r >= n), default=None)
        if best is None:
            rooms.append(capacity - n)
        else:
            rooms.remove(best)
            rooms.append(best - n)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_equals_best_fit_one_by_one(lengths):
    seen = Counter()
    fill, got = defaultdict(list), Counter()
    for length, lo, hi, first, each, at in packing.plan(Counter(lengths), 40):
        assert lo == got[length] and hi > lo
        got[length] = hi
        for rank in range(lo, hi):
            fill[first + (rank - lo) // each].append((at + (rank - lo) % each * length, length))
            seen[length] += 1
    assert seen == Counter(lengths) and len(fill) == brute_best_fit(lengths, 40)
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 40


# 4


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "User", "a:b", "#"]), st.text(alphabet="\\#</turn>\n: ab", max_size=30))))
def test_chat_round_trip(turns):
    t = chat_format.Template()
    whole = "".join(s for role, text in turns for s, _ in chat_format.segments(role, text, t))
    assert chat_format.read_back(whole, t) == turns


OTHER = {
    "pipes": chat_format.Template(open="<|{role}|>", close="<|end|>\n"),
    "runs": chat_format.Template(open="== {role} ==\n", close="====\n", names={}),
    "one sign": chat_format.Template(open="[{role}]", close="~", names={"user": "U", "assistant": "A"}),
    "same letters": chat_format.Template(open="abab{role}:", close="aba", names={}),
}


@pytest.mark.parametrize("name", sorted(OTHER))
@settings(max_examples=150, deadline=None)
@given(turns=st.lists(st.tuples(st.sampled_from(["user", "assistant", "U", "a|b", "x:=]", "\\"]), st.text(alphabet="\\<|end>=~ab[]:\n U", max_size=25))))
def test_chat_round_trip_of_other_templates(name, turns):
    t = OTHER[name]
    parts = [chat_format.segments(role, text, t) for role, text in turns]
    whole = "".join(s for p in parts for s, _ in p)
    assert chat_format.read_back(whole, t) == turns
    assert [chat_format.unescape(s) for p in parts for s, flag in p if flag] == [text for role, text in turns if role == "assistant"]
    for bad in (whole + "x", "x" + whole):
        with pytest.raises(ValueError):
            chat_format.read_back(bad, t)


def test_chat_digests_of_another_template(spark):
    df = spark.createDataFrame([(1, 0, "user", "<|user|> hi"), (1, 1, "assistant", "a<|end|>\n")], "conv_id long, turn long, role string, text string")
    got = chat_format.format_digests(df, OTHER["pipes"]).first()
    assert got.n_turns == 2 and got.valid and got.loss_sha256 == hashlib.sha256(b"a<|end|>\n").hexdigest()
    assert got.turns_sha256 == hashlib.sha256(b"user\n<|user|> hi\nassistant\na<|end|>\n\n").hexdigest()
    with pytest.raises(ValueError):
        chat_format.Template(open="{role}: ")


def test_chat_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### Assistant: x</turn>\n"), (1, 2, "assistant", None), (2, 1, "assistant", "b"), (2, 0, "user", None), (None, None, None, None), (3, 0, "system", "s"), (3, 0, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as valid", "2 as state")
    got = {r.conv_id: r for r in chat_format.format_digests(df).collect()}
    loss = "### Assistant: x</turn>\n"
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].turns_sha256 == hashlib.sha256(f"user\nhi\nassistant\n{loss}\nassistant\n\n".encode()).hexdigest()
    assert not got[1].valid and got[1].first_bad_turn == 2 and got[2].valid and got[None].n_turns == 1 and got[3].n_turns == 2
    assert chat_format.format_digests(df.limit(0)).count() == 0
    parts = chat_format.format_segments(df).filter("conv_id = 1").orderBy("turn", "part").collect()
    assert [p.loss for p in parts] == [False] * 3 + [False, True, False] * 2
    assert chat_format.read_back("".join(p.segment for p in parts), chat_format.Template())[1] == ("assistant", loss)


# 6


def brute_removed(texts, k=35):
    at, words = defaultdict(list), {d: WORD.findall(t) for d, t in enumerate(texts)}
    for d, w in words.items():
        for i in range(len(w) - k + 1):
            at[tuple(w[i : i + k])].append((d, i))
    gone = {(d, i + j) for p in at.values() if len(p) > 1 for d, i in p for j in range(k)}
    return [[w for i, w in enumerate(words[d]) if (d, i) not in gone] for d in words]


@pytest.mark.parametrize("block_bytes", [4 << 20, 20_000])
def test_repeated_passages(docs, texts, block_bytes):
    want = brute_removed(list(texts.values()))
    got = by_id(phrase_dedup.remove_repeats(docs, block_bytes=block_bytes))
    for d, kept in zip(texts, want):
        assert got[d].kept_text == " ".join(kept) and got[d].n_removed == got[d].n_words - len(kept) == sum(s.end - s.start for s in got[d].spans)


def test_repeated_passages_inside_one_text(spark, awkward, empty):
    period = " ".join(["a b c"] * 40)
    rows = spark.createDataFrame([(1, period), (2, " ".join(f"u{i}" for i in range(80)))], "doc_id long, text string")
    got = by_id(phrase_dedup.remove_repeats(rows))
    assert (got[1].n_removed, got[2].n_removed) == (120, 0)
    got = by_id(phrase_dedup.remove_repeats(awkward))
    assert got[6].n_removed == 60 and got[7].kept_text == "start end" and got[4].kept_text == "" and got[5].kept_text == "a b c"
    assert phrase_dedup.remove_repeats(awkward).count() == awkward.count() and phrase_dedup.remove_repeats(empty).count() == 0


def test_only_what_the_automaton_finds_is_removed():
    passage = [f"w{i}" for i in range(60)]
    texts = [[x.encode() for x in t] for t in (passage, ["x", "y", *passage], ["x", *passage[:34], "z", *passage[34:]], [*passage[20:], *passage[:20]])]
    shard = phrase_dedup._Shard([" ".join(passage), " ".join(passage[:40])], 35, 8, 5)
    gone = shard.locate(texts)
    assert [int(x.sum()) for x in np.split(gone, np.cumsum([len(t) for t in texts])[:-1])] == [60, 60, 0, 40]
    shard.automaton = phrase_dedup.ahocorasick.Automaton(phrase_dedup.ahocorasick.STORE_ANY, phrase_dedup.ahocorasick.KEY_SEQUENCE)
    shard.automaton.add_word((10**6,) * 8, 0)
    shard.automaton.make_automaton()
    assert shard.locate(texts).sum() == 0


def test_a_wrong_passage_removes_nothing(spark, monkeypatch):
    """Windows that meet in their hash only: words decide."""
    monkeypatch.setattr(W, "secret", lambda: 0)
    one, two = "DFU6ciZ6Po3EePm0", "Q9n7vWK6yXPOnog8"  # equal without a key
    data = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    h = W.word_hashes(data, *W.word_spans(data, np.array([0, len(data)]))[:2])
    assert h[0] == h[1]
    common = " ".join(f"c{i}" for i in range(34))
    df = spark.createDataFrame([(i, f"{common} {(one, two)[i]}") for i in range(2)], "doc_id long, text string")
    shard = phrase_dedup._Shard([f"{common} {one}"], 35, 8, 0)
    assert shard.locate([f"{common} {two}".encode().split()]).sum() == 0
    monkeypatch.undo()
    assert [r.n_removed for r in phrase_dedup.remove_repeats(df).collect()] == [0, 0]
    seven = " ".join(f"c{i}" for i in range(7))
    text = f"{seven} {one} {seven} {two}"
    judged = quality_lines.judge(spark.createDataFrame([(1, text, "h")], "doc_id long, text string, source string")).first()
    assert judged.n_repeat_words == brute_repeats(text) == 0


# 7


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            double = [int(d) for d in digits[::-1]]
            luhn = sum(double[::2]) + sum(sum(divmod(2 * d, 10)) for d in double[1::2])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn % 10 == 0 or kind == "phone" and 10 <= len(digits) <= 15:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a@.b_c%+-0123456789 ().Z\né", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_of_documents(docs, texts):
    got = by_id(pii.report(docs))
    for d, t in texts.items():
        own = brute_spans(t)
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in own)
        assert got[d].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got[d].n_email == sum(k == "email" for *_, k in own)
        every = got[d].spans.split(",") if got[d].spans else []
        assert [x for x in every if not x.startswith("term:")] == [x for x in joined.split(",") if x]
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a." * 100_000) == []


def test_disclosing_terms(spark):
    rows = [(i, f"note {i} contact Zorblat at z@mail.org about item {i}") for i in range(5)] + [(10 + i, f"note {i} contact the office at once about item {i} or q{i}@mail.org") for i in range(40)] + [(90, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans")
    got = by_id(pii.report(df))
    assert got[0].spans == "term:15:22,email:26:36" and got[0].n_term == 1 and got[10].n_term == 0 and got[90].spans == ""
    assert by_id(pii.sanitise(df))[1].text == "note 1 contact [TERM] at [EMAIL] about item 1"
    assert by_id(pii.sanitise(df, generalise=False))[1].text == "note 1 contact  at  about item 1"


def brute_terms(texts, threshold, min_texts):
    """Term spans of every text by counting words, values and both together over all texts."""
    near = [[(e, w, s, t) for e, w, s, t in pii.near_terms(x, pii.base_spans(x))] for x in texts]
    words = [set(w.decode() for w in decontaminate.normal_words(x.lower())) for x in texts]
    out, told = [], set()
    for e in {e for n in near for e, *_ in n}:
        have = [k for k, n in enumerate(near) if any(x[0] == e for x in n)]
        for w in {w for n in near for x, w, *_ in n if x == e}:
            both = [k for k in have if any(x[:2] == (e, w) for x in near[k])]
            if len({texts[k] for k in both}) >= min_texts:
                content = math.log2(len(texts) / len(have))
                pmi = math.log2(len(both) * len(texts) / (len(have) * sum(w in ws for ws in words)))
                if content > 0 and pmi >= threshold * content:
                    told.add((e, w))
    for n in near:
        out.append(sorted({(s, t) for e, w, s, t in n if (e, w) in told}))
    return out


def test_terms_equal_counting(spark, monkeypatch):
    """Quasi-identifiers planted near values: all are found, and all spans are those of counting by hand."""
    monkeypatch.setattr(pii, "COUNTED_WORDS", 20)
    rng, rows, planted = np.random.default_rng(9), [], []
    common = [f"word{i}" for i in range(60)]
    for e in range(12):
        for c in range(int(rng.integers(3, 7))):
            w = list(rng.choice(common, 14))
            w[6:8] = [f"nickname{e}", f"person{e}@mail.org"]
            planted.append((len(rows), f"nickname{e}"))
            rows.append(" ".join(w))
    rows += [" ".join(rng.choice(common, 30)) + (f" p{i}@x.org" if i % 5 == 0 else "") for i in range(80)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = by_id(pii.report(df))
    want = brute_terms(rows, 0.9, 3)
    for k, spans in enumerate(want):
        assert [x for x in got[k].spans.split(",") if x.startswith("term:")] == [f"term:{s}:{t}" for s, t in spans]
    assert all(any(rows[k][s:t] == w for s, t in want[k]) for k, w in planted)


def test_private_awkward(awkward, empty):
    assert pii.report(awkward).count() == awkward.count() and pii.report(empty).count() == 0
    assert sorted(r.spans for r in pii.report(awkward).filter("doc_id = 9").collect()) == ["email:5:10"] * 2


def test_secrets_that_a_word_gives_away(spark):
    """Opaque strings beside a word that stands nowhere else go; those that no word gives away, and plain long words, stay."""
    rng = np.random.default_rng(1)
    digest = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    filler = lambda i: " ".join(f"w{rng.integers(0, 300)}" for _ in range(30))
    rows, want = [], {}
    for i in range(60):
        head, secret = filler(i), digest()
        if i < 12:
            text = f'{head} apikey = "{secret}" {filler(i)}'
            want[i] = f"secret:{text.index(secret)}:{text.index(secret) + 40}"
        elif i < 20:
            text = f"{head} {secret} {filler(i)} averylongwordwithoutanydigitsinit"
        else:
            text = f"{head} {filler(i)}"
        rows.append((i, text))
    got = by_id(pii.report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {d: r.spans for d, r in got.items() if r.spans} == want and all(r.n_secret == (d in want) for d, r in got.items())
    clean = by_id(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")))
    assert "[SECRET]" in clean[0].text and clean[15].text == rows[15][1]


# 8


def brute_print(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids, root = list(prints), {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("limit", [4096, 2])
def test_near_duplicates(docs, texts, limit):
    want = {d: brute_print(t) for d, t in texts.items()}
    roots = brute_components(want)
    for d, r in by_id(simhash.near_duplicates(docs, bucket_limit=limit)).items():
        assert r.fp % (1 << 64) == want[d] and r.component_id == roots[d]


def test_links_keep_all_components(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 4)
    prints = {i: int(seeds[i % 4]) ^ sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 5))) for i in range(300)}
    df = spark.createDataFrame([(x,) for x in set(prints.values())], "fp long")
    want = brute_components({x: x for x in set(prints.values())})
    for limit in (4096, 8):
        roots = {r.node: r.root for r in connected_components(simhash.links(df, limit)).collect()}
        groups = lambda m: {frozenset(k for k in want if m.get(k, k) == v) for v in {m.get(k, k) for k in want}}
        assert groups(roots) == groups(want)


def test_near_duplicates_awkward(awkward, empty):
    got = simhash.near_duplicates(awkward).collect()
    assert len(got) == awkward.count() and {r.component_id for r in got if r.fp == 0} == {1} and simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each_group(awkward)
    assert kept.columns == awkward.columns and Counter(r.doc_id for r in kept.collect())[5] == 1


def test_one_row_of_each_group_whatever_the_ids(spark):
    """Null ids and equal ids with different texts lose nothing; copies leave the smallest id, null last."""
    own = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(None, own("a")), (None, own("b")), (None, own("b")), (7, own("c")), (7, own("d")), (3, own("d")), (7, own("e")), (None, own("f")), (9, own("f")), (9, own("f")), (8, own("g")), (8, own("g"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter([(None, own("a")), (None, own("b")), (7, own("c")), (3, own("d")), (7, own("e")), (9, own("f")), (8, own("g"))])
    for n in (1, 7):
        assert Counter(tuple(r) for r in simhash.one_of_each_group(df.repartition(n)).collect()) == want


def test_texts_of_one_template_lose_no_link(spark):
    """160 texts of one template, any two of them just below 0.8 but for 80 pairs above it: all meet in crowded buckets and every pair is found."""
    base = [f"t{i}" for i in range(400)]
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    jaccard = lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    rows = []
    for g in range(80):
        one = list(base)
        for i in (3, 60, 120, 180, 240, 300):
            one[i] = f"g{g}x{i}"
        for side in (0, 1):
            text = list(one)
            for i in (30, 150, 210, 350):
                text[i] = f"g{g}s{side}y{i}"
            rows.append((2 * g + side, text))
    assert jaccard(rows[0][1], rows[1][1]) >= 0.8 > jaccard(rows[0][1], rows[2][1]) > 0.7
    prints = [brute_print(" ".join(w)) for _, w in rows]
    root = list(range(160))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(160), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3 or a // 2 == b // 2:
            root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each_group(df, similarity=0.8).collect()}
    assert kept == {find(i) for i in range(160)} and len(kept) > 10


def test_similar_texts_leave_one(spark):
    """Pairs at five-word Jaccard 0.8 or more beyond three bits are linked; those below stay, chains and many copies give one."""
    rng, rows, want, beyond = np.random.default_rng(3), [], set(), 0
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    jaccard = lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    for g in range(30):
        base = [f"g{g}w{i}" for i in rng.integers(0, 500, 150)]
        alike, unlike = list(base), list(base)
        for i in (20, 70, 120)[: 1 + g % 3]:
            alike[i] = f"new{g}x{i}"
        for i in range(5, 150, 20):
            unlike[i] = f"far{g}x{i}"
        assert jaccard(base, alike) >= 0.8 > jaccard(base, unlike) and jaccard(alike, unlike) < 0.8
        rows += [(10 * g, base), (10 * g + 1, alike), (10 * g + 2, unlike)]
        prints = [brute_print(" ".join(w)) for w in (base, alike, unlike)]
        beyond += (prints[0] ^ prints[1]).bit_count() > 3
        want |= {10 * g} | ({10 * g + 2} if min((prints[2] ^ p).bit_count() for p in prints[:2]) > 3 else set())
    hot = [f"h{i}" for i in range(150)]
    rows += [(1000 + c, [*hot[:75], f"copy{c}", *hot[76:]]) for c in range(40)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(2000, None), (2001, "")], "doc_id long, text string")
    assert beyond >= 5
    assert {r.doc_id for r in simhash.one_of_each_group(df, similarity=0.8).collect()} == want | {1000, 2000}


# 9


def test_repeated_chunks(docs, texts):
    got = by_id(line_chunks.report(docs))
    seen, order = {}, sorted(texts)
    for d in order:
        kept, gone = [], 0
        for first, end, raw in line_chunks.chunks(texts[d]):
            if end - first > 1 and raw.strip():
                if raw in seen:
                    gone += 1
                    continue
                seen[raw] = d
            kept.append(raw)
        assert got[d].n_removed_chunks == gone and got[d].kept_sha256 == hashlib.sha256(b"\n".join(kept)).hexdigest()


@given(st.lists(st.text(alphabet="ab \n", max_size=6), max_size=50))
def test_chunks_are_the_text(parts):
    text = "\n".join(parts)
    assert b"\n".join(raw for *_, raw in line_chunks.chunks(text)) == text.encode()


def test_chunks_shift(spark):
    lines = [f"line number {i} of the passage" for i in range(60)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new first", *lines])), (3, None), (None, "\n".join(lines))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as place", "length(text) as n_chars")
    out = by_id(line_chunks.remove_chunks(df))
    assert out[1].text == "\n".join(lines) and len(out[2].text) < 0.5 * len(out[1].text) and out[3].text is None and out[None].n_chars == len(out[None].text)


def test_repeated_passages_of_lines_go_whole(spark):
    """Passages of 50 words in 1 to 6 lines, planted among own lines; short runs and first places stay."""
    rows, want = [], {}
    for n in range(1, 7):
        passage = [" ".join(f"p{n}x{j}" for j in range(50) if j % n == i) for i in range(n)]
        for d in (10 * n, 10 * n + 1, 10 * n + 2):
            before, after = [f"before {d} {i}" for i in range(d % 10)], [f"after {d}"]
            rows.append((d, "\n".join([*before, *passage, *after])))
            want[d] = "\n".join([*before, *(passage if d % 10 == 0 else []), *after])
    short, tail = " ".join(f"s{j}" for j in range(49)), " ".join(f"t{j}" for j in range(60))
    rows += [(90, f"{short}\nown 90"), (91, f"{short}\nown 91"), (92, f"{tail}\nx\ny\nz 92"), (93, f"{tail}\nx\ny\nz 93"), (94, "\n".join(["ten words of one line that comes again and again"] * 23)), (None, f"{tail}\nlast")]
    want |= {90: rows[-6][1], 91: rows[-5][1], 92: rows[-4][1], 93: "z 93", 94: "\n".join(["ten words of one line that comes again and again"] * 5), None: "last"}
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    got = line_chunks.remove_chunks(df, words=50).collect()
    assert len(got) == len(df.collect()) and {r.doc_id: r.text for r in got} == want


def test_chunks_awkward(awkward, empty):
    assert line_chunks.report(awkward).count() == awkward.count() and line_chunks.report(empty).count() == 0
    assert line_chunks.remove_chunks(awkward).columns == awkward.columns


# 10


def brute_forward(classes, model):
    total, alpha = 0.0, model.start * model.emit[classes[0]]
    for c in [*classes[1:], None]:
        total += math.log(alpha.sum())
        alpha = alpha / alpha.sum()
        if c is not None:
            alpha = alpha @ model.move * model.emit[c]
    return total


def test_language_model(docs, texts):
    shape = hmm_lm.Shape(states=3, frequent=50, endings=40, passes=3, stretch=16)
    coded, vocabulary = hmm_lm.encoded(docs, shape, block_bytes=50_000)
    model = hmm_lm.train(coded, shape)
    tokens = {d: [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t)), None] for d, t in texts.items()}
    c = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    assert (vocabulary.tokens, vocabulary.distinct) == (n, v)
    within = {r.doc_id: (r.within, np.frombuffer(r.classes, "<i2")) for r in coded.collect()}
    assert model.emit.sum(axis=0) == pytest.approx(1) and model.move.sum(axis=1) == pytest.approx(1) and (model.emit > 0).all()
    got = by_id(hmm_lm.score(docs, shape, block_bytes=50_000))
    for d, ws in tokens.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, zlib.crc32(str(d).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score == pytest.approx(brute_forward(within[d][1], model) / math.log(10) + within[d][0], rel=1e-9)


def brute_counts(texts, model):
    """Expected starts, moves and emissions by forward and backward recursion over each whole text."""
    k = len(model.start)
    first, moves, emits, log = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape), 0.0
    for classes in texts:
        alphas, scales = [], []
        for t, c in enumerate(classes):
            now = (alphas[-1] @ model.move if t else model.start) * model.emit[c]
            scales.append(now.sum())
            alphas.append(now / now.sum())
        betas = [np.ones(k)]
        for t in range(len(classes) - 1, 0, -1):
            betas.insert(0, model.move @ (model.emit[classes[t]] * betas[0]) / scales[t])
        for t, c in enumerate(classes):
            emits[c] += alphas[t] * betas[t]
            if t:
                moves += np.outer(alphas[t - 1], model.emit[c] * betas[t] / scales[t]) * model.move
        first += alphas[0] * betas[0]
        log += np.log(scales).sum()
    return first, moves, emits, log


@pytest.mark.parametrize("size", [1, 3, 8, 500])
@pytest.mark.parametrize("part", [5, 1 << 19])
def test_expected_counts_are_those_of_whole_texts(size, part, monkeypatch):
    monkeypatch.setattr(hmm_lm, "_PART", part)
    rng, shape = np.random.default_rng(1), hmm_lm.Shape(states=3, frequent=6, endings=5)
    texts = [rng.integers(0, shape.classes, n).astype("<i2") for n in (1, 2, 5, 16, 17, 40, 1, 3)]
    start = hmm_lm.first_model(shape)
    model = hmm_lm.Model(np.array([0.5, 0.3, 0.2]), start.move + rng.random((3, 3)) * 0.1, start.emit)
    model = hmm_lm.Model(model.start, model.move / model.move.sum(axis=1, keepdims=True), model.emit)
    cut = hmm_lm.stretches(pa.array([t.tobytes() for t in texts], pa.binary()), size)
    for got, want in zip(hmm_lm.expected_counts(cut, model), brute_counts(texts, model)):
        assert got == pytest.approx(want)
    assert hmm_lm.log_likelihoods(cut, len(texts), model) == pytest.approx([brute_forward(t, model) for t in texts])


def test_training_is_baum_welch(docs):
    """One pass over the partitions is one step by brute force over all training texts, and raises the likelihood."""
    shape = hmm_lm.Shape(states=2, frequent=20, endings=10, passes=1, stretch=16)
    coded, _ = hmm_lm.encoded(docs, shape, block_bytes=50_000)
    texts = [np.frombuffer(r.classes, "<i2") for r in coded.filter("not held_out").collect()]
    first, moves, emits, before = brute_counts(texts, hmm_lm.first_model(shape))
    model, k, m = hmm_lm.train(coded, shape), shape.states, shape.classes
    share = (emits.sum(axis=1) + 1) / (emits.sum() + m)
    assert model.start == pytest.approx((first + 1e-3) / (first + 1e-3).sum())
    assert model.move == pytest.approx((moves + 1e-3) / (moves + 1e-3).sum(axis=1, keepdims=True))
    assert model.emit == pytest.approx((emits + 10 * share[:, None]) / (emits + 10 * share[:, None]).sum(axis=0))
    assert sum(brute_forward(t, model) for t in texts) > before


def test_language_model_beats_counts_on_held_out_text(docs):
    held = [r for r in hmm_lm.score(docs).filter("held_out").collect()]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_awkward(awkward, empty):
    got = hmm_lm.score(awkward).collect()
    assert len(got) == awkward.count() and all(math.isfinite(r.score) and r.score < 0 for r in got) and hmm_lm.score(empty).count() == 0


# shared

INTERNAL = ["_id", "_key", "_places", "_spans", "_items", "_removed_lines", "removed_lines", "places", "spans", "items", "key", "host", "fingerprint", "every", "near", "D", "_KEY", "doc", "fp", "root", "first", "size", "bands", "lines", "raw", "digest", "last"]
STAGE = {
    "quality": lambda d, b: quality_lines.filter_documents(d),
    "lines": lambda d, b: line_chunks.remove_chunks(d, words=50),
    "near": lambda d, b: simhash.one_of_each_group(d, similarity=0.8),
    "benchmark": lambda d, b: decontaminate.decontaminate(d, b),
    "benchmark spans": lambda d, b: decontaminate.decontaminate(d, b, remove="spans"),
    "private": lambda d, b: pii.sanitise(d),
}


@pytest.mark.parametrize("stage", sorted(STAGE))
def test_clashing_names_pass_through(stage, spark, docs):
    """Columns named like anything used inside keep their values, and the result is that without them."""
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    names = [n for n in INTERNAL if n.lower() not in {m.lower() for m in INTERNAL[: INTERNAL.index(n)]}]
    wide = docs.select("*", *(docs.doc_id.cast("string").alias(n) for n in names))
    out = STAGE[stage](wide, items)
    assert out.columns == wide.columns
    rows = out.collect()
    assert all(r[n] == str(r.doc_id) for r in rows for n in names)
    assert {(r.doc_id, r.text) for r in rows} == {(r.doc_id, r.text) for r in STAGE[stage](docs, items).collect()}


def test_word_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"one two  one\ttwo", np.uint8)
    starts, ends, _ = W.word_spans(data, np.array([0, len(data)]))
    h = W.word_hashes(data, starts, ends)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    two = W.window_hashes(h, 2)
    assert two[0] == two[2] != two[1]


def thue_morse(a, b, n):
    """Two words whose sums over powers of any odd base agree modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.mark.parametrize("pair", [("a", "b", 1024), ("t", "h", 2048), ("e", "x", 4096)])
def test_structured_words_are_told_apart(pair, spark, tokenizer):
    one, two = thue_morse(*pair)
    data = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    h = W.word_hashes(data, *W.word_spans(data, np.array([0, len(data)]))[:2])
    assert h[0] != h[1]
    texts = [one, two, one + " " + two]
    got = token_counts.count_tokens(pa.array(texts), *token_counts._store(queries.VOCABULARY))
    assert got.tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    pieces = list(packing.pieces_of(pa.array(texts), *packing._store(queries.VOCABULARY), 1 << 20, 2))
    assert [p[4] for p in pieces] == [zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for t in texts]
    common = " ".join(f"c{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{common} {one}"), (2, f"{common} {two}")], "doc_id long, text string")
    assert [r.n_removed for r in phrase_dedup.remove_repeats(df).collect()] == [0, 0]


def test_store_compares_bytes(monkeypatch):
    """With a hash that always collides the store still answers each pre-token by itself."""
    monkeypatch.setattr(W, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), W.U64))
    store = pretokens.Store(lambda pieces: (np.array([len(p) for p in pieces]), np.array([ord(c) for p in pieces for c in p])))
    data = np.frombuffer(b"abcdefghijXbcdefghijklab", np.uint8)
    starts, ends = np.array([0, 10, 20, 22, 0]), np.array([10, 20, 22, 24, 9])
    for _ in range(2):
        places = store.find(data, starts, ends)
        assert bytes(store.ragged(places).astype(np.uint8)) == b"".join(data[a:b].tobytes() for a, b in zip(starts, ends))


def test_pretokens_of_every_code_point(tokenizer):
    points = [chr(c) for c in range(0, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1{c}!{c}{c} b" for c in points]
    got = token_counts.count_tokens(pa.array(texts), *token_counts._store(queries.VOCABULARY))
    assert got.tolist() == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert pretokens.special_tokens(queries.VOCABULARY) == {t: tokenizer.token_to_id(t) for t in ["<|endoftext|>"]}


def test_row_slices_keep_every_row_whole():
    import pyarrow as pa

    from kinelink.llm.tables import row_slices

    texts = ["a" * 9, None, "", "é" * 30, "b", "c" * 10, None]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts), "n": list(range(7))}), pa.RecordBatch.from_pydict({"text": pa.array([], pa.string()), "n": pa.array([], pa.int64())})]
    for size in (1, 10, 70, 1000):
        parts = list(row_slices(iter(batches), size=size))
        assert [x for p in parts for x in p.column("text").to_pylist()] == texts
        assert all(len(p) == 1 or sum(len((x or "").encode()) for x in p.column("text").to_pylist()) <= size for p in parts)
    assert len(list(row_slices(iter(batches[:1]), size=1000))) == 1
