"""Registered queries against their SQL, and the pipeline against brute force, on the smallest tables."""

import os
import re
from collections import Counter

import duckdb
import pytest

from lumenquery.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = Q.queries()[name](spark, SF).toPandas(), con.execute(Q.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    text = lambda df: sorted(map(str, df[cols].astype(str).itertuples(index=False, name=None)))
    assert text(got) == text(want)


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.toPandas()
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = P.cut(docs)
        after = docs.toPandas()
        if name == "near_dup":
            assert sorted(after.doc_id) == sorted(x for x, keep in Q.op10_near_dup(spark, SF).select("doc_id", "kept").toPandas().itertuples(index=False) if keep)
        if name == "substring_dedup":
            seen, words = Counter(), {r.doc_id: (r.text or "").encode().split() for r in before.itertuples()}
            for w in words.values():
                seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
            for r in after.itertuples():
                w = words[r.doc_id]
                gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
                assert r.text.encode().split() == [x for p, x in enumerate(w) if p not in gone]
        if name == "decontamination":
            plain = lambda t: " ".join(re.sub(r"[!-/:-@\[-`{-~]", "", t.lower()).split())
            items = [plain(t) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text]
            assert not [1 for t in after.text for i in items if f" {i} " in f" {plain(t)} "]
        before = after
    out = P.mixing(spark, docs, SF).toPandas()
    assert len(out) == len(before) and (out.taken <= 2 * out["size"]).all()
