"""Crowded buckets of near-dedup are decided in bounded cells, not as rows of pairs."""

from itertools import combinations

import numpy as np
import pytest

from kinelink.llm import similar
from kinelink.llm.tables import checkpointed
from kinelink.operators.graphs import connected_components


@pytest.mark.parametrize("few_pairs", [0, 64, 10**9])
def test_common_counts(monkeypatch, few_pairs):
    monkeypatch.setattr(similar, "FEW_PAIRS", few_pairs)
    monkeypatch.setattr(similar, "PRODUCT", 300)
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 1000, rng.integers(1, 90))).astype(np.uint64) for _ in range(n)] for n in (40, 25))
    assert (similar.common_counts(left, right) == [[len(np.intersect1d(a, b)) for b in right] for a in left]).all()


def test_a_bucket_of_several_groups_loses_no_link(spark, monkeypatch):
    """One bucket of 130 texts in groups of about 20: the links join what all pairs join, and no text meets another as a row."""
    monkeypatch.setattr(similar, "CELL_TEXTS", 20)
    words = [f"t{i}" for i in range(200)]
    texts = []
    for g in range(65):
        one = list(words)
        for i in (10, 60, 110, 160, 35, 85):
            one[i] = f"g{g}x{i}"
        other = list(one)
        other[135] = f"g{g}y"
        texts += [" ".join(one), " ".join(other)] if g < 50 else [" ".join(words + [f"z{g}"]), " ".join(words + [f"u{g}"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = docs.selectExpr("doc_id", "xxhash64(text) AS key", "doc_id AS fp", "200 AS size")
    rooted = checkpointed(keyed.selectExpr("1L AS bucket", "key", "fp", "size", "if(fp >= 100 and fp < 115, 100L, fp) AS root"))
    cells = similar._cells(rooted)
    assert cells.count() <= 130 * 10 and {r.n for r in cells.selectExpr("count(distinct key) AS n").collect()} == {130}
    found = similar._Decider(docs, keyed, 3, 0.8).cell_links(rooted)
    chain = spark.range(100, 115).selectExpr("100L AS a", "id AS b")
    got = {r.node: r.root for r in connected_components(found.unionByName(chain)).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    alike = [(a, b) for a, b in combinations(range(130), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert all(got.get(a, a) == got.get(b, b) for a, b in alike) and len({got.get(i, i) for i in range(130)}) == 51
    assert found.count() < 130
