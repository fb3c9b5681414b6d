"""Queries over groups of four vectors where some groups have fewer."""

import duckdb
import pytest

from kinelink.plans import catalog
from test_queries import SF, text


@pytest.mark.parametrize("name", ["assign_hungarian", "frame_acc"])
@pytest.mark.parametrize("kept", ["vec_id < 10", "vec_id < 17 AND vec_id <> 5"])
def test_groups_that_lack_vectors(spark, tmp_path, name, kept):
    at = f"{tmp_path}/embeddings.parquet"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE {kept}) TO '{at}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}'")
    df, rel = catalog.QUERIES[name](spark, str(tmp_path)), con.sql(catalog.ORACLES[name])
    want = sorted(tuple(text(dict(zip(rel.columns, r))[c]) for c in sorted(rel.columns)) for r in rel.fetchall())
    assert sorted(tuple(text(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want
