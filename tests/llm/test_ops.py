"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquery.llm import ann, chat, components, decontaminate, html_main, io, kernels, lang_id, mixing, near_dup, substring_dedup, token_count, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __row long"


def docs_of(spark, texts, **more):
    """Documents with a column that clashes with an inner name."""
    rows = [(i, t, more.get("lang", {}).get(i, "en"), more.get("source", {}).get(i, "s1"), len(t or ""), 7) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def words(r, n, vocab=400):
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    base = [words(r, n) for n in (60, 80, 200, 40, 300, 7, 4, 1)]
    texts = [*base, base[0], base[0], base[2].upper(), "", None, "  \t ", "é" + base[1], base[4] + " " + base[0]]
    for t in (base[1], base[2], base[4]):
        w = t.split()
        for k in range(6):
            v = list(w)
            for j in range(k):
                v[(17 * j + 5) % len(v)] = f"x{k}{j}"
            texts.append(" ".join(v))
    texts += [words(r, 50) + " " + " ".join(base[4].split()[20:70]) for _ in range(4)] + ["same " * 90, ("a b c d e f g " * 4000).strip()]
    return [(i if i != 9 else 8, t) for i, t in enumerate(texts)] + [(None, base[3]), (None, "only here once and never again today")]


# ---- kernels ----


def test_word_and_window_hashes():
    texts = [b"a b  c\n d a b c", None, b"", b" A b c ", ("x" * 700_000 + " a b c").encode()]
    h = kernels.word_hashes(texts)
    assert [len(x) for x in h] == [7, 0, 0, 3, 4]
    assert (kernels.window_hashes(h[0], 3)[[0, 4]] == kernels.window_hashes(h[4], 3)[1]).all()
    low = kernels.word_hashes(texts, lower=True)
    assert kernels.window_hashes(low[3], 3)[0] == kernels.window_hashes(h[0], 3)[0]
    assert len(set(kernels.span_hash(h[0], np.array([0, 4]), np.array([3, 7])))) == 1
    assert len(kernels.shingle_set(h[3])) == 1 and len(kernels.shingle_set(h[1])) == 0


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (7, 7), (None, 1)], "a long, b long")
    assert sorted(map(tuple, components.components(e).collect())) == [(3, 3), (4, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    assert {r.comp for r in components.components(chain).collect()} == {0}


# ---- 10 near duplicates ----


def brute_groups(rows):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    out = []
    for m in members.values():
        ids = [rows[i][0] for i in m if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids, default=None), rows[i][0] == min(ids, default=None)) for i in m]
    return sorted(out, key=str)


def test_near_duplicates(spark, corpus):
    got = near_dup.near_duplicates(docs_of(spark, corpus)).collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(corpus)
    kept = near_dup.keep_one_each(docs_of(spark, corpus))
    assert kept.columns == docs_of(spark, corpus).columns and kept.count() == sum(r[3] for r in brute_groups(corpus))


@pytest.mark.parametrize("broadcast", [True, False])
def test_one_row_of_each_component_stays(spark, monkeypatch, broadcast):
    import corpus_pipeline as P

    if not broadcast:
        monkeypatch.setattr(near_dup, "BROADCAST_ROWS", -1)
    r = random.Random(8)
    a, b, c, d, e, f = (words(r, 60, 10_000) for _ in range(6))
    near = " ".join([*d.split()[:-1], "end"])
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (None, d), (None, near), (5, c), (5, c), (6, c), (7, e), (7, " ".join([*e.split()[:-1], "end"])), (7, f), (8, ""), (8, None), (8, "")]
    kept = near_dup.keep_one_each(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    kept = P.cut(kept)
    start = lambda t: (t or "")[:40]
    assert sorted(((x.doc_id, start(x.text)) for x in kept.collect()), key=str) == sorted([(1, start(a)), (None, start(b)), (None, start(d)), (5, start(c)), (7, start(e)), (7, start(f)), *[(8, "")] * 3], key=str)
    before = {(x.doc_id, x.text) for x in kept.collect()}
    assert {(x.doc_id, x.text) for x in P.passages(spark, kept, "").collect()} == before
    flags = near_dup.near_duplicates(docs_of(spark, rows))
    assert flags.columns == ["doc_id", "n_shingles", "component_id", "kept"] and sorted(map(tuple, flags.collect()), key=str) == brute_groups(rows)


def versions(r, n, size=120):
    """Texts that each differ a little from the one before and much from the first."""
    base, out = words(r, size, 5000).split(), []
    for i in range(n):
        out.append(" ".join(base))
        for j in range(2):
            base[(29 * i + 53 * j) % size] = f"v{i}{j}"
    return out


@pytest.mark.parametrize("centres", [(0, 0), (3, 1)])
def test_near_duplicates_beyond_the_star(spark, monkeypatch, centres):
    """Members that the centre of a bucket isn't linked with, by the prefix filter alone and after more centres."""
    monkeypatch.setattr(near_dup, "CENTRES", centres)
    r = random.Random(8)
    texts = versions(r, 12) + versions(r, 9, 40) + ["one line that many share " + t for t in ("a", "b c", "d e f", "g")] * 2 + ["one line that many share"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_dup.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(rows)


def test_prefix_filter_finds_all_links_of_a_hot_bucket(spark):
    """One bucket, mostly of members that are unlike each other."""
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 200, r.integers(1, 60))) for _ in range(150)]
    sets += [np.sort(np.append(s[1:], 1000 + i)) for i, s in enumerate(sets[:60]) if len(s) > 1]
    n = len(sets)
    opened = spark.createDataFrame([(1, i, i % 40, bool(i % 40)) for i in range(n)], "key long, cls long, comp long, stray boolean")
    vals = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "cls long, vals array<long>")
    pairs = near_dup._by_prefix(opened, vals, 75)
    got = {tuple(x) for x in near_dup._confirm(pairs, vals, 75).collect()}
    want = {(i, j) for j in range(n) for i in range(j) if i % 40 != j % 40 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert got == want and len(want) > 20 and pairs.count() < n * n / 16


def test_sets_of_one_hash_are_told_apart(spark):
    s = spark.createDataFrame([(1, 5, 1), (2, 5, 2), (3, 5, 1), (4, 6, 1), (5, None, None)], "doc_id long, cls long, alt long")
    got = {r.doc_id: r.cls for r in near_dup._told_apart(s).collect()}
    assert got[1] == got[3] != got[2] and got[4] == 6 and got[5] is None


def test_rows_that_differ_in_nulls_only_are_kept_apart(spark):
    rows = spark.createDataFrame([(5, None), (None, "5"), (5, "5"), (None, None)], "doc_id long, text string")
    assert rows.select(io.row_key().alias("k")).distinct().count() == 4


# ---- 5 repeated passages ----


def brute_repeats(rows):
    seen = Counter()
    split = [WORD.findall(t or "") for _, t in rows]
    for w in split:
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        left = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), left))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_remove_repeats(spark, corpus, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", -1)
    out = substring_dedup.remove_repeats(docs_of(spark, corpus).withColumn("n_words", F.lit(-1)))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()]
    assert sorted(got, key=str) == brute_repeats(corpus)
    assert {"source", "lang"} <= set(out.columns)


# ---- 2 mixing ----


def brute_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(size.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * size[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2 * size[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mix(spark):
    r = random.Random(3)
    texts = [(i, words(r, r.randrange(0, 80))) for i in range(300)] + [(5, None), (None, "a b c"), (None, "a b c"), (301, "")]
    src = {i: ("hot" if i % 3 == 0 else f"s{i % 7}") for i, _ in texts if i is not None} | {None: None}
    d = docs_of(spark, texts, source=src)
    out = mixing.mix(d, depth=2).collect()
    assert len(out) == len(texts)
    size, taken = Counter(), Counter()
    for x in out:
        size[x.source] += x.size
        taken[x.source] += x.taken
        assert 0 <= x.taken <= 2 * x.size and x.taken == sum(s.words for s in x.shards)
    want = brute_targets(size)
    for x in out:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == size[x.source]
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in size)
    again = mixing.mix(d.repartition(7), depth=2).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    shards = Counter(s.shard for x in out for s in x.shards)
    assert set(shards) == {0, 1, 2, 3}


def test_split_quotas_are_exact(spark):
    q = spark.createDataFrame([("a", 1000), ("b", 37), (None, 500), ("c", 0)], "source string, quota long")
    rows = mixing.split_quotas(q, 3).collect()
    assert {s: sum(r.quota for r in rows if r.source == s) for s in ("a", "b", None, "c")} == {"a": 1000, "b": 37, None: 500, "c": 0}
    per = Counter()
    for r in rows:
        per[r.shard] += r.quota
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 1
    a = [r.quota for r in rows if r.source == "a"]
    assert 90 < min(a) and max(a) < 160  # a quarter of a standard deviation's worth of luck would be odd; far tails odder


# ---- 3 token counts ----


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    r = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "é", "<s>", "</s>", "<unk>", "▁", "ing", "\t", "日", "🎉", "\x00", ".", "T", "."]
    texts = [(i, "".join(r.choice(parts) for _ in range(r.randrange(0, 30)))) for i in range(400)] + [(900, None), (None, "x y"), (5, "dup"), (901, "long text " * 50_000)]
    got = {r.doc_id: r for r in token_count.token_counts(docs_of(spark, [(i, t) for i, t in texts if i != 5]), P.path("piece_bpe_32k.model")).collect()}
    for i, t in texts:
        if i != 5:
            n = len(sp.encode(t or ""))
            assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096)


# ---- 1 nearest neighbours ----


def test_nearest(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(40, 16))
    x = centres[r.integers(0, 40, 3000)] + 0.4 * r.normal(size=(3000, 16))
    x[100:140] = x[100]
    rows = [(i, x[i].tolist()) for i in range(3000)] + [(3000, None), (3050, [0.0] * 16), (3100, [float("nan")] * 16), (3150, [None] * 16), (None, [1.0] * 16), (3200, [1.0, 2.0]), (7, x[7].tolist()), (150, x[150].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = {}
    for q in ann.nearest(df).collect():
        got.setdefault(q.query_id, []).append((q["rank"], q.vec_id, q.score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    assert sorted(got[150])[0][:2] == sorted(got[150])[1][:2] == (1, 150) and len(got[150]) == 10  # two rows of one id find each other
    for i in range(0, 3000, 50):
        if i == 150:
            continue
        s = unit[i] @ unit.T
        s[i] = -9
        want = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        found = sorted(got[i])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        hit += len({f[1] for f in found} & set(want.tolist()))
    assert hit / (5 * 59) >= 0.9
    assert [v for _, v, _ in sorted(got[100])] == [101, 102, 103, 104, 105]
    assert not set(got) & {3000, 3050, 3100, 3150, 3200}


# ---- 9 chat ----


def test_templates_round_trip():
    r = random.Random(5)
    parts = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "<\\|", "\n", "a", "<\\\\|", ">", "assistant"]
    for _ in range(3000):
        turns = [(r.choice(["user", "assistant", "sys\nt\\em", "<|x"]), "".join(r.choice(parts) for _ in range(r.randrange(9)))) for _ in range(r.randrange(1, 5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]


def test_reply_trees(spark):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "a"), (1, 3, 1, 5.0, "assistant", "b"), (1, 4, 3, None, None, None), (1, 5, 2, 1.0, "user", "c"), (2, 1, 9, 0.0, "user", "orphan"), (3, 1, 2, 0.0, "u", "loop"), (3, 2, 1, 0.0, "u", "loop"), (None, 1, None, 0.0, "user", "n"), (1, 2, 1, 1.0, "assistant", "a"), (4, None, None, 0.0, "u", "x")]
    m = spark.createDataFrame(rows, "conv_id long, node_id long, parent_id long, score double, role string, text string").withColumn("leaf", F.lit(0))
    best = {r.conv_id: chat.parse(r.formatted) for r in chat.format_conversations(m).collect()}
    assert best == {1: [("user", "q"), ("assistant", "b"), ("", "")], 2: [("user", "orphan")], None: [("user", "n")]}
    assert chat.format_conversations(m, branches=None).count() == 4
    assert sorted(chat.reply_paths(m, None).columns) == ["back", "conv", "conv_id", "leaf", "node_id"]
    deep = spark.createDataFrame([(1, i, i - 1 if i else None, 0.0, "user", str(i)) for i in range(70)], m.drop("leaf").schema)
    assert [t for _, t in chat.parse(chat.format_conversations(deep).first().formatted)] == [str(i) for i in range(70)]


def test_ranked_branches_equal_brute_force(spark):
    """Random trees with scores, several branches kept."""
    r = random.Random(3)
    rows, up = [], {}
    for c in range(12):
        for i in range(r.randrange(1, 40)):
            p = r.randrange(i) if i and r.random() < 0.95 else None
            up[c, i] = p
            rows.append((c, i, p, float(r.randrange(-3, 4)), r.choice(["user", "assistant"]), f"t{c}.{i}"))
    m = spark.createDataFrame(rows, "conv_id long, node_id long, parent_id long, score double, role string, text string")
    of = {(x[0], x[1]): x for x in rows}
    want = set()
    for c in range(12):
        inner = {p for (k, _), p in up.items() if k == c}
        paths = []
        for i in [n for k, n in up if k == c and n not in inner]:
            path, at = [], i
            while at is not None:
                path.append(at)
                at = up[c, at]
            paths.append((-sum(of[c, x][3] for x in path), -len(path), i, path[::-1]))
        for _, _, leaf, path in sorted(paths)[:2]:
            want.add((c, leaf, chat.render([of[c, x][4:6] for x in path])[0]))
    assert {(x.conv_id, x.leaf, x.formatted) for x in chat.format_conversations(m, branches=2).collect()} == want


def test_plain_conversations(spark):
    """Null roles, null and repeated turns, very long texts and a clashing column, through the query's steps."""
    rows = [(1, 1, "user", "a"), (1, 0, None, None), (1, 1, "user", "a"), (1, None, "assistant", "x"), (2, 0, "assistant", "<|im_end|> é" * 50_000), (None, 0, "user", "n")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("leaf", F.lit(1)).withColumn("node_id", F.lit(5))
    got = {x.conv_id: x for x in chat.digests(chat.format_conversations(chat.linear_messages(m))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (4, sha("assistant\nx\n\n\nuser\na\nuser\na\n"), 1)
    assert got[2].loss_chars == 600_000 and got[2].loss_sha256 == sha("<|im_end|> é" * 50_000) and got[None].n_turns == 1


# ---- 7 decontamination ----


def test_contaminated(spark):
    r = random.Random(6)
    items = [(i, words(r, 30, 3000)) for i in range(6)] + [(6, "two words"), (7, None), (8, "")]
    held = items[0][1].split()
    edited = [w if i % 6 else f"zz{i}" for i, w in enumerate(held)]
    texts = [(1, words(r, 80, 3000)), (2, words(r, 30, 3000) + " " + items[1][1].upper() + ", " + words(r, 30, 3000)), (3, "pre " + " ".join(edited) + " post"), (4, None), (5, ""), (None, items[2][1]), (7, "so Two. words! here"), (8, " ".join(held[:9]) + " " + words(r, 40, 3000)), (9, words(r, 20000, 3000))]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs_of(spark, texts), b).collect()}
    assert got == {(2, 1), (3, 0), (None, 2), (7, 6)}
    clean = decontaminate.decontaminate(docs_of(spark, texts), b)
    assert sorted(x.doc_id for x in clean.collect()) == [1, 4, 5, 8, 9] and clean.columns == docs_of(spark, texts).columns


def test_alignment():
    def slow(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h)) / (2 * len(a))

    r = np.random.default_rng(1)
    for _ in range(100):
        a, b = r.integers(0, 5, r.integers(1, 12)), r.integers(0, 5, r.integers(1, 30))
        assert decontaminate.align(a, b) == pytest.approx(slow(a, b))


# ---- 6 html ----


def test_main_text():
    page = '<html lang=en><head><title>T</title><script>if (a<b) x("</p>")</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies, see our policy.</div><article><h1>Big &amp; news</h1><p>First  para\n with <b>bold</b>, and more text here.<p>Second&nbsp;one, it ends.<ul><li>one thing<li>another thing</ul></article><section class="comments"><p>Great read, thanks for it.</p></section><footer>&copy; Someone, all rights.</footer></body></html>'
    assert html_main.main_text(page) == "Big & news\nFirst para with bold, and more text here.\nSecond one, it ends.\none thing\nanother thing"
    for odd in ("", "<", "plain", "</p></div>", "<a href='", "<!-- x", "<p>" * 3000, "<div>" * 3000 + "x"):
        html_main.main_text(odd)


def test_hostile_pages_take_linear_time():
    start = time.perf_counter()
    for piece in ('<a "x', "<b></i>", "<b>", "<span><hr>", "<!x", "<p><li>", "</div>", "<a href='", "<td><p>", "&lt;<"):
        html_main.Page(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - start < 60
    half = "<b>" * 100_000
    start = time.perf_counter()
    html_main.Page(half + "</i>" * 100_000)
    assert time.perf_counter() - start < 5


#: Pages of other makes than training_pages writes, labelled by hand.
LABELLED = [
    ("<!doctype html><html><body><header><a href=/>Daily</a></header><main><h1>Harvest</h1><p>The fields are dry this year, and the farmers wait for rain.</p><table><tr><td>Wheat<td>12 tons</table></main><aside><h3>Most read</h3><a href=/1>Ten tips</a></aside><footer>All rights reserved.</footer></body></html>", "Harvest\nThe fields are dry this year, and the farmers wait for rain.\nWheat\n12 tons"),
    ("<div id=page><div id=menu><ul><li><a href=a>Start</a></li><li><a href=b>Contact</a></li></ul></div><div id=content><h2>On bridges</h2><p>A bridge spans a river, a road or a valley; it carries people &amp; goods.</p><blockquote>Stone outlasts iron, they say.</blockquote></div><form><input name=q><button>Search</button></form></div>", "On bridges\nA bridge spans a river, a road or a valley; it carries people & goods.\nStone outlasts iron, they say."),
]


@pytest.mark.parametrize("page,text", LABELLED)
def test_pages_labelled_by_hand(page, text):
    assert html_main.main_text(page) == text


def test_held_out_pages():
    wrong = total = 0
    model = html_main.trained()
    for page, y in html_main.training_pages(60, seed=99):
        p = model.marginals(page)
        for node, _, text in page.runs:
            if text.strip():
                total += 1
                wrong += (p[node] > 0.5) != y[node]
    assert wrong / total < 0.02


def test_messages_equal_brute_force():
    """Marginals by enumeration of all labellings of a small tree."""
    import itertools

    page, model = html_main.Page("<body><div class=content><p>Some words, here.</p></div><nav><a>x</a></nav></body>"), html_main.trained()
    ev = [model.evidence(f) for f in page.features()]
    total = np.zeros((len(page.tag), 2))
    for y in itertools.product((0, 1), repeat=len(page.tag)):
        p = np.prod([ev[i][y[i]] for i in range(len(y))]) * np.prod([model.pair.get(html_main._kind(page.tag[i]), model.any_pair)[y[page.parent[i]], y[i]] for i in range(1, len(y))])
        for i, v in enumerate(y):
            total[i, v] += p
    assert np.allclose(model.marginals(page), total[:, 1] / total.sum(axis=1))


def test_extract_nulls(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<article><p>Hello there, world.</p></article>")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_main.extract(df).collect()}
    assert got == {1: ("", 0), 2: ("", 0), None: ("Hello there, world.", 19)}


# ---- 8 toxicity ----


def test_toxicity(spark):
    r = random.Random(2)
    texts, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        t = words(r, r.randrange(20, 120)).split()
        for _ in range(3 * bad):
            t.insert(r.randrange(len(t)), r.choice(["vile", "idiot", "v1le", "rotten"]))
        texts.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    texts += [(5000, None), (5001, ""), (None, "hello"), (5002, "word " * 100_000)]
    lab = spark.createDataFrame([*labels, (5001, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs_of(spark, texts), lab).collect()
    assert len(got) == len(texts) and all(0 <= x.score <= 1 for x in got)
    truth = dict(labels)
    held = [(x.score, truth[x.doc_id]) for x in got if x.held_out and x.doc_id in truth]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([p > n for p in pos for n in neg]) > 0.95
    none = toxicity.toxicity(docs_of(spark, texts[:3]), lab.limit(0)).collect()
    assert [x.score for x in none] == [0.0] * 3


def test_calibration_equals_brute_force():
    """The knots are the least-squares rising fit: means over blocks by the min-max rule."""
    from lumenquery.llm.boosting import isotonic

    r = np.random.default_rng(4)
    p = np.sort(r.random(60))
    y = (r.random(60) < p).astype(float)
    want = [max(min(y[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    got = np.interp(p, *isotonic(p, y))
    assert np.abs(got - want).mean() < 0.02 and (np.diff(got) >= -1e-12).all()


def test_trees_fit_a_rule():
    from lumenquery.llm.boosting import Boosted

    r = np.random.default_rng(5)
    x = r.random((800, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    p = Boosted().fit(x[:600], y[:600]).predict(x[600:])
    assert ((p > 0.5) == (y[600:] > 0.5)).mean() > 0.95


# ---- 4 language ----


def test_fusion_equals_brute_force(spark):
    """Posterior of text, declaration, host and suffix, without the row's own share, in plain Python."""
    model = lang_id.TextModel(["de", "en"], np.zeros((2, lang_id.BUCKETS)))
    g = lang_id._grams(np.frombuffer("the und with nicht ".encode(), np.uint8))
    model.logs[g[:6], 1] += 0.4
    model.logs[g[8:], 0] += 0.3
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["the", "und", "with", "nicht"]) for _ in range(r.randrange(0, 7))), r.choice(["h1", "h2", None]), r.choice(["de", "com", None]), r.choice(["de", "en-GB", "xx", None, ""])) for i in range(60)] + [(99, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, host string, suffix string, told string")
    got = {x.doc_id: x for x in lang_id.identify(d, model, F.col("host"), F.col("suffix"), F.col("told")).collect()}
    p = {x[0]: model.posterior(x[1].encode() if x[1] is not None else None) for x in rows}
    told = {x[0]: None if not x[4] else x[4].split("-")[0] if x[4].split("-")[0] in ("de", "en") else "other" for x in rows}
    have = [x for x in rows if p[x[0]] is not None]
    add = lambda xs: sum((p[x[0]] for x in xs), np.zeros(2))
    world = add(have) + 1
    world /= world.sum()
    names = ["de", "en", "other"]
    table = np.array([add([x for x in have if told[x[0]] == t]) + [4.0 if t == lang else 0.5 for lang in ("de", "en")] for t in names])
    table /= table.sum(axis=0)
    for i, _, host, suffix, _ in rows:
        at = [x for x in have if x[3] == suffix]
        sp = world
        if at and suffix is not None:
            sp = add(at) + lang_id.SUFFIX_ROWS * world
            sp /= sp.sum()
        mine = [x for x in have if (x[2], x[3]) == (host, suffix)]
        if not mine:
            base = world
        elif host is None:
            base = sp
        else:
            base = np.maximum(add(mine) + lang_id.HOST_ROWS * sp - (p[i] if p[i] is not None else 0), 1e-9)
            base /= base.sum()
        f = base * (p[i] if p[i] is not None else 1) * (table[names.index(told[i])] if told[i] else 1)
        if p[i] is None and told[i] is None and host is None and suffix is None:
            assert got[i].lang_id is None
        else:
            assert got[i].posterior == pytest.approx(f.max() / f.sum())


def test_language(spark):
    r = random.Random(9)
    voc = {"en": ["the", "and", "thing", "with", "there"], "de": ["und", "der", "schön", "nicht", "über"], "fr": ["être", "les", "avec", "français", "où"]}
    texts, lang, source = [], {}, {}
    for i in range(300):
        g = ("en", "de", "fr")[i % 3]
        texts.append((i, " ".join(r.choice(voc[g]) for _ in range(r.randrange(6, 60)))))
        lang[i], source[i] = g, f"h{g}"
    texts += [(400, None), (401, ""), (402, "12345 !!"), (403, "the " * 100_000), (None, "und der nicht")]
    d = docs_of(spark, texts, lang=lang, source=source)
    got = {x.doc_id: x for x in lang_id.identify_documents(d).collect()}
    assert np.mean([got[i].lang_id == lang[i] for i in range(300)]) > 0.99
    assert [got[i].accepted for i in (400, 401, 402, 403, None)] == [False, False, False, True, True]
    kept = lang_id.keep_accepted(d)
    assert kept.columns == d.columns and kept.count() == 302
    html = [(1, "http://a.fr/x", "<html lang='fr'><p>zz</p>"), (2, "http://b.de/y", "<html><p>und der nicht schön</p>"), (3, None, None)]
    pages = spark.createDataFrame(html, "page_id long, url string, html string")
    out = {x.page_id: x.lang_id for x in lang_id.identify_pages(pages, d).collect()}
    assert out[1] == "fr" and out[2] == "de"


# ---- empty tables ----


def test_empty_tables(spark):
    d = docs_of(spark, [(1, "x")]).limit(0)
    empty = lambda schema: spark.createDataFrame([], schema)
    assert near_dup.near_duplicates(d).count() == 0
    assert substring_dedup.remove_repeats(d).count() == 0
    assert mixing.mix(d).count() == 0
    assert decontaminate.contaminated(d, empty("item_id long, text string")).count() == 0
    assert lang_id.identify_documents(d).count() == 0
    assert toxicity.toxicity(d, empty("doc_id long, toxic int")).count() == 0
    assert ann.nearest(empty("vec_id long, embedding array<float>")).count() == 0
    assert chat.format_conversations(empty("conv_id long, node_id long, parent_id long, score double, role string, text string")).count() == 0
    assert chat.digests(chat.format_conversations(chat.linear_messages(empty("conv_id long, turn long, role string, text string")))).count() == 0
    assert lang_id.keep_accepted(d).count() == 0 and near_dup.keep_one_each(d).count() == 0 and decontaminate.decontaminate(d, empty("item_id long, text string")).count() == 0
    assert html_main.extract(empty("page_id long, url string, html string")).count() == 0


def test_sha_of_kept_text(spark):
    out = substring_dedup.remove_repeats(docs_of(spark, [(1, "a  b\nc")])).select(F.sha2("kept_text", 256).alias("h")).first()
    assert out.h == hashlib.sha256(b"a b c").hexdigest()


def test_texts_travel_once(spark):
    """Columns come back as they were, whatever the type and name of the text and of the columns beside it."""
    text, long = "a b  c", " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "x"), (2, None, None), (3, long, "y"), (4, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, Text string, doc string")
    bench = spark.createDataFrame([(1, "nothing of the kind is anywhere here")], "item_id long, text string")
    for d in (docs, docs.withColumn("Text", F.col("Text").cast("binary")), docs.select("doc_id", "Text"), docs.select("doc", "Text", "doc_id")):
        want = sorted(map(str, d.collect()))
        out = substring_dedup.remove_repeats(d)
        assert out.columns == [*d.columns, "n_words", "n_removed", "kept_text"]
        assert sorted(map(str, out.select(*d.columns).collect())) == want
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out.collect()} == {1: (3, 0, "a b c"), 2: (0, 0, ""), 3: (40, 40, ""), 4: (40, 40, "")}
        clean = decontaminate.decontaminate(d, bench)
        assert clean.schema.names == d.columns and sorted(map(str, clean.collect())) == want
