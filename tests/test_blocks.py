"""Operators on all pairs, blocked: brute force, and what leaves their tasks."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lumenquery.operators import blocks, cluster, dupes, search
from lumenquery.plans import catalogue


def vectors(n, width=8, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_attach_meets_in_blocks(spark):
    """Best person by all pairs, with rejections, ties of equal vectors, other widths and nulls; no join makes all pairs."""
    x, e = vectors(700), vectors(600, seed=2)
    e[300:] = e[:300]  # copies of a smaller person's exemplars tie
    person = [i % 40 if i < 300 else 100 + i % 40 for i in range(600)]
    no = [(i, p) for i in range(0, 700, 3) for p in (i % 40, 7, 139)]
    f = spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(x)], (900, None), (901, [1.0, 0.0]), (902, [1.0])], "face_id long, vector array<double>")
    c = spark.createDataFrame([*[(p, v.tolist()) for p, v in zip(person, e, strict=True)], (5, [1.0, 0.0]), (6, None)], "person_id long, vector array<double>")
    got = cluster.attach(f, c, spark.createDataFrame(no, "face_id long, person_id long"), 0.3)
    d, barred, want = 1 - x @ e.T, set(no), {901: 5}
    for i in range(700):
        left = [(round(d[i, j], 12), p) for j, p in enumerate(person) if d[i, j] <= 0.3 and (i, p) not in barred]
        if left:
            want[i] = min(left)[1]
    assert {r.face_id: r.person_id for r in got.collect()} == want and 100 < len(want)
    assert "Join Inner" not in plan(got)


def embeddings(tmp_path, n):
    """A folder with embeddings of n vectors, its last video short of frames."""
    x = vectors(n, 64, 5)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (vec_id BIGINT, embedding FLOAT[], label INT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, v.tolist(), i % 10) for i, v in enumerate(x)])
    con.execute(f"COPY t TO '{tmp_path}/embeddings.parquet'")
    con.execute("CREATE VIEW embeddings AS SELECT * FROM t")
    return con


@pytest.mark.parametrize("name", ["video_similarity", "pair_report", "near_dup_pairs", "near_dup_groups", "exemplar_attach"])
def test_queries_match_sql_with_a_short_last_video(spark, tmp_path, name):
    con = embeddings(tmp_path, 601)
    got = catalogue.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


@pytest.mark.parametrize("asks", ["shorter", "first"])
def test_videos_by_brute_force(spark, asks):
    """Lengths and widths differ, times repeat."""
    r = np.random.default_rng(4)
    long = [vectors(int(r.integers(1, 9)), 4, 100 + i) for i in range(30)] + [vectors(60, 4, 8), vectors(40, 4, 9)]
    videos = {i: [(float(t // 2), v) for t, v in enumerate(x)] for i, x in enumerate(long)}
    videos[40] = [(0.0, np.array([1.0, 0.0])), (1.0, long[3][0])]
    videos[41] = [(0.0, np.array([0.8, 0.6])), (5.0, long[3][0])]
    rows = [(a, t, v.tolist()) for a, f in videos.items() for t, v in f]
    f = spark.createDataFrame(rows, "asset_id long, ts_secs double, vector array<double>").repartition(3)
    got = {(x.a, x.b): x.score for x in dupes.video_similarity(f, 0.2, asks, block=40).collect()}
    want = {}
    for a in videos:
        for b in videos:
            if a < b:
                p, q = (a, b) if asks == "first" or len(videos[a]) <= len(videos[b]) else (b, a)
                best = {}
                for t, v in videos[p]:
                    best[t] = max([best.get(t, -np.inf)] + [float(v @ w) if len(v) == len(w) else dupes.LOWEST for _, w in videos[q]])
                if (s := float(np.mean(list(best.values())))) >= 0.2:
                    want[a, b] = s
    assert got.keys() == want.keys() and len(want) > 50 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tiles_cut_through_videos(monkeypatch):
    x = vectors(90, 4, 8)
    ids, ts = np.sort(np.random.default_rng(1).integers(0, 9, 90)), np.arange(90) // 2.0
    clips = dupes._Clips(pa.table({"asset_id": ids, "ts": ts, "vector": pa.array(x.tolist(), pa.list_(pa.float64()))}), -1)
    scores = lambda: np.vstack([s[np.argsort(v)] for v, s in dupes._ask(clips, clips) if len(v)])
    whole = scores()
    for tile in (1, 7, 32):
        monkeypatch.setattr(dupes, "TILE", tile)
        assert whole.shape == (9, 9) and np.allclose(scores(), whole, atol=1e-12)


def test_each_vector_is_sent_as_often_whatever_the_size(spark):
    assert {blocks.count_blocks(n) for n in (10_000, 50_000, 300_000, 1_000_000)} == {blocks.SIDES}
    assert blocks.self_blocks(spark.range(9000), "id", blocks.count_blocks(9000)).count() == 9000 * blocks.SIDES


def test_links_grow_with_the_vectors(spark):
    """600 near copies are 179,700 pairs; a star per two blocks joins them just as well."""
    x = np.vstack([vectors(1, 8, 3) + 0.001 * vectors(600, 8, 4), vectors(400, 8, 6)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "asset_id long, vector array<double>").cache()
    links = dupes.similar_links(v, 0.9, block=250)
    assert links.count() <= 4 * 1000
    key = lambda g: sorted(map(tuple, g.collect()))
    assert key(dupes.groups(links)) == key(dupes.groups(dupes.similar_pairs(v, 0.9)))


def test_retrieval_eval_meets_in_blocks(spark):
    """Ranks by all pairs with copies of targets, an absent target and a query without a vector; no join makes all pairs."""
    x = vectors(900, 8, 2)
    x[600:] = x[:300]  # copies score the same as the target
    images = spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(x)], (900, None), (901, [1.0, 0.0])], "asset_id long, vector array<double>")
    asked = [(i, (3 * i + 7) % 900) for i in range(0, 900, 4)]
    q = spark.createDataFrame([*[(i, t, x[i].tolist()) for i, t in asked], (1000, 5000, x[0].tolist()), (1001, 3, None)], "query_id long, target long, vector array<double>")
    s = np.round(x @ x.T, 12)
    ranks = [1 + int((np.delete(s[i], t) > s[i, t]).sum()) for i, t in asked] + [1]
    got = search.retrieval_eval(q, images)
    r = got.first()
    assert r.n == len(ranks) and [r.recall_1, r.recall_5, r.recall_10] == pytest.approx([np.mean(np.array(ranks) <= k) for k in (1, 5, 10)])
    assert r.mrr == pytest.approx(np.mean(1 / np.array(ranks)))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_sweeps_over_a_scratch_file():
    """Labels as whispers has them, component by component, from rows in any order; a node's neighbours come in parts."""
    r = np.random.default_rng(9)
    n, edges = 90, {}
    for lo, hi in ((0, 50), (50, 80), (80, 86)):
        for _ in range(hi - lo):
            i, j = sorted(r.integers(lo, hi, 2).tolist())
            if i != j:
                edges[i, j] = float(np.float32(r.uniform(0.3, 1)))
    want = {}
    for lo, hi in ((0, 50), (50, 80), (80, 86)):
        e = [(i, j, w) for (i, j), w in edges.items() if lo <= i < hi]
        want |= cluster.whispers(sorted({x for a, b, _ in e for x in (a, b)}), e, n)
    rows = {}
    for (i, j), w in edges.items():
        rows.setdefault((i, j // 7), []).append((j, w))
        rows.setdefault((j, i // 7), []).append((i, w))
    rows = [(i, part, sorted(x)) for (i, part), x in rows.items()]
    rows = [rows[k] for k in r.permutation(len(rows))]
    batch = lambda x: pa.RecordBatch.from_pydict({"i": [a for a, _, _ in x], "part": [b for _, b, _ in x], "js": pa.array([[j for j, _ in c] for _, _, c in x], pa.list_(pa.int64())), "ws": pa.array([[w for _, w in c] for _, _, c in x], pa.list_(pa.float32()))})
    nodes, label = cluster.sweep_stored(iter([batch(rows[:40]), batch(rows[40:])]), n)
    assert dict(zip(nodes.tolist(), label.tolist(), strict=True)) == want and 2 < len(set(want.values())) < len(want)


def test_ids_are_ranked_without_one_task(spark):
    ids = np.random.default_rng(2).permutation(5000) * 3 - 4000
    ranked = cluster.ranked_ids(spark.createDataFrame([(int(i),) for i in ids], "face_id long").repartition(6))
    assert [tuple(r) for r in ranked.orderBy("face_id").collect()] == [(int(f), i) for i, f in enumerate(np.sort(ids))]
