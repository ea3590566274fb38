"""Small fixtures with answers known by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquery.functions import media as M
from lumenquery.functions import text as T
from lumenquery.functions import vectors as V
from lumenquery.operators import cluster, dupes, library, places, search, signal, store, timeline
from lumenquery.operators.timeline import EditError, Hit, Slot


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def unit(*v):
    a = np.array(v, float)
    return (a / np.linalg.norm(a)).tolist()


def test_topk_and_width(spark):
    rows = [(0, None, [0.0, 1.0]), (1, None, [1.0, 0.0]), (2, None, unit(1, 1)), (3, None, [1.0, 0.0, 0.0])]
    pool = spark.createDataFrame(rows, "asset_id long, ts_secs double, vector array<double>")
    assert [r.asset_id for r in search.vector_topk(pool, [1.0, 0.0], 2).collect()] == [1, 2]
    none = pool.limit(0).select("asset_id")
    assert search.vector_topk(pool, [1.0, 0.0], 2, none).count() == 0


def test_vector_codec(spark):
    df = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<float>")
    back = df.select(V.decode_f32(V.encode_f32("v")).alias("v")).collect()
    assert back[0].v == [1.0, -2.5] and back[1].v is None


def test_haversine(spark):
    d = one(spark, M.haversine(F.lit(37.7749), F.lit(-122.4194), F.lit(40.7128), F.lit(-74.006)))
    assert abs(d / 1000 - 4135) < 15


@pytest.mark.parametrize(("s", "want"), [("+28.6139+077.2090+216.000/", (28.6139, 77.209)), ("+99.0+077.2/", None), ("junk", None), ("-33.5-070.6/", (-33.5, -70.6))])
def test_iso6709(spark, s, want):
    got = one(spark, M.parse_iso6709(F.lit(s)))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(("s", "want"), [("30000/1001", 30000 / 1001), ("25", 25.0), ("0/0", None), ("1/0", None), ("-5/1", None)])
def test_rational(spark, s, want):
    assert one(spark, M.parse_rational(F.lit(s))) == (pytest.approx(want) if want else None)


@pytest.mark.parametrize(("d", "n"), [(1.0, 1), (4.0, 2), (10.0, 5), (60.0, 5), (None, 1)])
def test_even_samples(spark, d, n):
    got = one(spark, M.even_samples(F.lit(d).cast("double")))
    assert len(got) == n
    if d == 60.0:
        assert got[0] == pytest.approx(6) and got[-1] == pytest.approx(54)


def test_scene_samples(spark):
    f = lambda d, *s: one(spark, M.scene_samples(F.lit(d), F.array(*[F.lit(x) for x in s])))
    assert f(10.0, 4.0, 7.0) == [2.0, 5.5, 8.5]
    assert f(10.0, 0.2) == [pytest.approx(5.1)]


@pytest.mark.parametrize(("s", "want"), [("cut", ("cut", 0.0)), ("crossfade", ("crossfade", 0.5)), ("crossfade:0.8", ("crossfade", 0.8)), ("dip", ("dip_to_black", 0.7)), ("slide:9", None), ("slide:x", None), ("spin", None)])
def test_transition(spark, s, want):
    got = one(spark, M.parse_transition(F.lit(s)))
    assert (got and tuple(got)) == want


def test_text_functions(spark):
    assert one(spark, T.percent_encode(F.lit("a b~*é"))) == "a%20b~%2A%C3%A9"
    assert one(spark, T.xml_escape(F.lit("<a & 'b'>"))) == "&lt;a &amp; &apos;b&apos;&gt;"
    assert one(spark, T.extension_badge(F.lit("x.jpg"))) == "JPG" and one(spark, T.extension_badge(F.lit("x"))) == "FILE"
    assert one(spark, T.format_distance(F.lit(1500.0))) == "1.5 km" and one(spark, T.format_distance(F.lit(20.4))) == "20 m"
    assert T.query_terms('say "hello" world-wide') == ["say", "hello", "world", "wide"]


def test_dupes(spark):
    v = spark.createDataFrame([(1, unit(1, 0.01, 0)), (2, unit(1, 0.012, 0)), (3, unit(0.2, 1, 0.3)), (4, [1.0, 0.0])], "asset_id long, vector array<double>")
    got = dupes.similar_pairs(v, block=2).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)] and got[0].score > 0.999
    g = dupes.groups(spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "a long, b long"))
    assert sorted(map(tuple, g.collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]


def test_truncated_video(spark):
    f = lambda s: unit(s, s / 2, 1)
    rows = [(1, float(i), f(s)) for i, s in enumerate((0.1, 0.5, 0.9, 1.3, 1.7))] + [(2, float(i), f(s)) for i, s in enumerate((0.1, 0.5))] + [(3, 0.0, unit(-1, 1, 0))]
    got = dupes.video_similarity(spark.createDataFrame(rows, "asset_id long, ts_secs double, vector array<double>")).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)] and got[0].score > 0.999
    assert dupes.video_threshold(0.985) == pytest.approx(0.97) and dupes.video_threshold(0.2) == 0.5


def test_clusters(spark):
    face = lambda i, base, k: (i, unit(*(np.array(base) + 0.02 * k * np.array([1, 0.5, 0]))), 0.95)
    rows = [face(i, (1, 0, 0), i) for i in range(4)] + [face(10 + i, (0, 0, 1), i) for i in range(3)] + [(99, [0.0, 1.0, 0.0], 0.95)]
    f = spark.createDataFrame(rows, "face_id long, vector array<double>, score double")
    none = spark.createDataFrame([], "face_a long, face_b long")
    got = sorted(map(tuple, cluster.propose(f, none, none).collect()))
    assert got == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 10), (2, 11), (2, 12)]
    tied = spark.createDataFrame([(0, 10)], "face_a long, face_b long")
    assert {c for c, _ in map(tuple, cluster.propose(f, tied, none).collect())} == {1}


def test_exemplars_and_attach(spark):
    x = np.array([unit(1, i / 10, 0) for i in range(8)])
    assert cluster.choose_exemplars(x[:3], 5) == [0, 1, 2]
    assert len(cluster.choose_exemplars(x, 5)) == 5
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "person_id long, vector array<double>")
    f = spark.createDataFrame([(5, unit(1, 0.1)), (6, unit(-1, -1)), (7, unit(0.2, 1))], "face_id long, vector array<double>")
    no = spark.createDataFrame([(7, 2)], "face_id long, person_id long")
    assert [(r.face_id, r.person_id) for r in cluster.attach(f, e, no).collect()] == [(5, 1)]


def brute_exemplars(x, k):
    """Indices by all pairs, as the reference has it; infinite between widths."""
    far = lambda a, b: 1 - float(np.dot(a, b)) if len(a) == len(b) else float("inf")
    n = len(x)
    if n <= k:
        return list(range(n))
    got = [min(range(n), key=lambda i: (round(sum(far(x[i], x[j]) for j in range(n) if j != i), 9), i))]
    while len(got) < k:
        got.append(max((i for i in range(n) if i not in got), key=lambda i: (round(min(far(x[i], x[c]) for c in got), 12), i)))
    return sorted(got)


@pytest.mark.parametrize("most", [2000, 20])
def test_exemplars_use_all_faces_of_a_person(spark, most):
    r = np.random.default_rng(3)
    people = {1: [unit(*(r.standard_normal(8) + (1, 0, 0, 0, 0, 0, 0, 0))) for _ in range(150)], 2: [unit(*r.standard_normal(8)) for _ in range(21)], 3: [unit(*r.standard_normal(8)) for _ in range(20)], 4: [unit(1, 2)] * 3}
    people[5] = [people[2][0]] * 15 + people[2][:8] + [people[2][3]] * 15  # copies tie
    people[6] = [unit(*r.standard_normal(2 + i % 2)) for i in range(30)]
    rows = [(p, 1000 * p + i, [float(y) for y in v]) for p, x in people.items() for i, v in enumerate(x)]
    f = spark.createDataFrame([*rows, (None, 1, [1.0, 0.0]), (1, 2, None)], "person_id long, face_id long, vector array<double>").repartition(5)
    got = cluster.exemplars(f, 5, most).collect()
    assert sorted((r.person_id, r.face_id) for r in got) == [(p, 1000 * p + i) for p, x in people.items() for i in brute_exemplars(x, 5)]
    assert all(list(r.vector) == [float(y) for y in people[r.person_id][r.face_id % 1000]] for r in got)


def test_suppression(spark):
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 1.0, 10.0, 10.0, 0.8), (1, 3, 50.0, 50.0, 5.0, 5.0, 0.7)], "img long, box_id long, x double, y double, w double, h double, score double")
    assert sorted(r.box_id for r in cluster.suppress(b, "img").collect()) == [1, 3]


def test_nearest_place(spark):
    c = spark.createDataFrame([(1, 32.53, 75.97, "Dalhousie"), (2, 32.22, 76.32, "Dharamsala"), (3, 37.77, -122.42, "San Francisco"), (4, None, 1.0, "nowhere")], "line_no long, lat double, lon double, place string")
    p = spark.createDataFrame([(1, 32.539, 75.972), (2, -60.0, 10.0), (3, None, 10.0)], "key long, lat double, lon double")
    got = {r.key: r for r in places.nearest_place(p, c).collect()}
    assert got[1].place == "Dalhousie" and got[1].distance_m < 5000 and got[2].place is not None and got[3].place is None


@pytest.mark.parametrize("n", [3, 60, 3000])
def test_nearest_place_equals_brute_force(spark, n):
    """Both hemispheres, the poles and the date line."""
    r = np.random.default_rng(n)
    lat = np.degrees(np.arcsin(r.uniform(-1, 1, n)))
    lon = r.uniform(-180, 180, n)
    lat[:2], lon[:2] = (89.9, -89.9), (10.0, 179.99)
    plat = np.concatenate([np.degrees(np.arcsin(r.uniform(-1, 1, 300))), [90.0, -90.0, 89.0, 0.0, 0.0, lat[2]]])
    plon = np.concatenate([r.uniform(-180, 180, 300), [0.0, 0.0, -170.0, 180.0, -180.0, lon[2]]])
    c = spark.createDataFrame([(i, float(lat[i]), float(lon[i]), f"p{i}") for i in range(n)], "line_no long, lat double, lon double, place string")
    p = spark.createDataFrame([(i, float(plat[i]), float(plon[i])) for i in range(len(plat))], "key long, lat double, lon double")
    a, b = np.radians(plat)[:, None], np.radians(lat)[None, :]
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon[None, :] - plon[:, None]) / 2) ** 2
    want = 2 * 6_371_000 * np.arcsin(np.minimum(1, np.sqrt(h)))
    got = {x.key: x for x in places.nearest_place(p, c).collect()}
    assert len(got) == len(plat)
    for i in range(len(plat)):
        assert got[i].distance_m == pytest.approx(want[i].min(), abs=0.01) and want[i, got[i].line_no] == pytest.approx(want[i].min(), abs=0.01)


def test_slots_about_hits():
    """A hit of unknown length is held to no end; pins go before unpins; a swap keeps to its media."""
    assert timeline.fill_span(Hit("a", 1.0, 30.0), 2.0).start == 29.0
    base = [timeline.Slot("a", "video", 0.0, 5.0, 9.0), timeline.Slot("b", "video", 0.0, 5.0, 9.0)]
    out = timeline.apply_ops(base, [{"op": "unpin", "slot": 1}, {"op": "pin", "slot": 1}])
    assert not out[0].pinned
    out = timeline.apply_ops(base, [{"op": "swap", "slot": 1}], {1: [Hit("short", 1.0, 1.0, 3.0)]})
    assert out[0].asset == "short" and out[0].duration == 3.0


def clicks(bpm, secs=30, seed=1):
    r = np.random.default_rng(seed)
    x = 0.002 * r.standard_normal(secs * signal.RATE)
    for t in np.arange(0.5, secs - 0.1, 60 / bpm):
        a = int(t * signal.RATE)
        x[a : a + 800] += 0.8 * np.sin(2 * np.pi * 880 * np.arange(800) / signal.RATE)
    return x


@pytest.mark.parametrize("bpm", [90, 120, 150])
def test_beats(bpm):
    g = signal.beat_grid(clicks(bpm))
    assert abs(g["bpm"] - bpm) / bpm < 0.04
    phase = (np.array(g["beats"]) - 0.5) % (60 / bpm)
    assert np.median(np.minimum(phase, 60 / bpm - phase)) < 0.08


def test_no_beats_and_energy():
    assert signal.beat_grid(np.zeros(100)) is None
    quiet, hot = np.full(10 * signal.RATE, 0.005), np.full(10 * signal.RATE, 0.3)
    assert signal.loud_spans(np.concatenate([quiet, hot])) == [(10.0, 20.0)]
    assert signal.loud_spans(np.full(20 * signal.RATE, 0.4)) == []


def test_sharpness():
    board = np.kron(np.indices((16, 16)).sum(axis=0) % 2, np.ones((8, 8))) * 210 + 20
    assert signal.laplacian_variance(board) > 1000
    assert signal.laplacian_variance(np.full((20, 20), 7.0)) == 0 and signal.laplacian_variance(board[:2, :2]) == 0


def test_similarity_transform():
    src = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.2]])
    a = 0.3
    rot = 2 * np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
    m = signal.similarity_transform(src, src @ rot.T + [3, 4])
    assert np.allclose(m, np.hstack([rot, [[3], [4]]]))


def test_plan():
    hits = [Hit(str(i), 0.5) for i in range(10)]
    slots = timeline.plan(hits, 10)
    assert len(slots) == 3 and sum(s.duration for s in slots) == 9
    assert [h.score for h in timeline.strong_prefix([Hit("a", 0.5), Hit("b", 0.1), Hit("c", 0.4)])] == [0.5]
    assert timeline.clip_bounds(Hit("v", 1, ts=9, duration=10)) == (7.5, 2.5)
    assert timeline.clip_bounds(Hit("v", 1, ts=9, duration=20, scenes=[8, 11])) == (8, 3)


def test_beat_spans_and_sync():
    beats = [i * 0.5 for i in range(40)]
    spans = timeline.beat_spans(beats, [(4.0, 8.0)], 20.0)
    assert {round(b - a, 3) for a, b in spans if 4 <= a < 8} == {1.0} and spans[0] == (0.0, 2.0)
    hits = [Hit(f"p{i}", 0.9 - i / 100) for i in range(12)]
    slots = timeline.plan_synced(hits, beats, [(4.0, 8.0)], 20.0)
    assert slots[2].asset == "p0" and slots[2].joint == ("crossfade", 0.5)


def test_speech_spans():
    s = timeline.speech_spans([(0, 1, "a"), (1, 4, "b"), (4, 30, "c")], 20)
    assert s[0] == (0.0, 4, "a b") and s[-1][1] == 20 and all(b - a <= 8.0001 for a, b, _ in s)


def test_edits():
    base = [Slot(f"a{i}", "photo", 0, 3) for i in range(4)]
    out = timeline.apply_ops(base, [{"op": "drop", "slot": 2}, {"op": "reorder", "order": [4, 3, 1]}, {"op": "retime", "slot": 1, "secs": 1.5}])
    assert [s.asset for s in out] == ["a3", "a2", "a0"] and out[2].duration == 1.5 and base[0].duration == 3
    for bad in ([{"op": "drop", "slot": 9}], [{"op": "pin", "slot": 1}, {"op": "drop", "slot": 1}], [{"op": "reorder", "order": [1, 2]}], [{"op": "drop", "slot": i} for i in (1, 2, 3, 4)], [{"op": "retime", "slot": 1, "secs": 0.1}]):
        with pytest.raises(EditError):
            timeline.apply_ops(base, bad)
    swapped = timeline.apply_ops(base, [{"op": "swap", "slot": 1}], {1: [Hit("a1", 1.0), Hit("new", 0.5)]})
    assert swapped[0].asset == "new" and swapped[0].duration == 3


def test_project_round_trip():
    slots = [Slot("v", "video", 1.0, 2.0, 9.0, ("crossfade", 0.5), True)]
    assert timeline.load_project(timeline.save_project(slots)) == slots
    with pytest.raises(ValueError, match="newer"):
        timeline.load_project('{"version": 2, "slots": []}')
    clip = timeline.export_otio("x", slots)["tracks"]["children"][0]["children"][0]
    assert clip["source_range"]["duration"]["value"] == 60


def test_store(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    u = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    assert sorted(map(tuple, store.upsert(t, u, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, store.insert_ignore(t, u, ["k"], "v").collect())) == [(1, "a"), (2, "b"), (3, "C")]
    s = spark.createDataFrame([(1, 3.0), (1, 1.0), (1, -5.0)], "asset_id long, ts_secs double")
    owners = spark.createDataFrame([(1,), (2,)], "asset_id long")
    assert {r.asset_id: r.scenes for r in store.scene_lists(store.with_sentinel(s, owners)).collect()} == {1: [1.0, 3.0], 2: []}


def test_resolve(spark):
    a = spark.createDataFrame([("x" * 8, "ab" * 32, "p/1.jpg", "1.jpg"), ("y", "cd" * 32, "p/2.jpg", "1.jpg")], "id string, hash string, storage_path string, original_filename string")
    assert library.resolve(a, "AB" * 32).count() == 1 and library.resolve(a, "1.jpg").count() == 2 and library.resolve(a, "p/2.jpg").count() == 1
