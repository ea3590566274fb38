"""Language identification by Bayesian evidence fusion.

The evidence of a document is its text, the language that its markup declares, and where
it comes from. Text gives likelihoods under byte-trigram models, tempered so that a long
text can't drown the rest. Declarations weigh by how often, over the whole corpus, texts
of a language declare one (a grouped aggregation). The prior of a host is smoothed
towards that of its address suffix, and that towards the corpus; both come from grouped
aggregation of the text posteriors, without the document's own share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .io import as_bytes, chunks, cut, row_key

#: Most labelled texts that the text models are fitted on, in equal shares of the languages.
SAMPLE = 4_000
BUCKETS = 1 << 16
#: Trigrams whose evidence a text may bring, and rows' worth of prior at each level.
TEMPER, SUFFIX_ROWS, HOST_ROWS = 60, 20.0, 10.0
#: Least posterior of an accepted language.
ACCEPT = 0.5
#: Rows that may be broadcast: hosts with their priors, or keys of rejected rows.
BROADCAST_ROWS = 200_000

#: The language that an html tag declares.
_DECLARED = r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)"""

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[:33] = 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _grams(raw: np.ndarray) -> np.ndarray:
    b = _FOLD[raw]
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
    return (h >> np.uint32(9)) & np.uint32(BUCKETS - 1)


class TextModel:
    """Log probabilities of byte trigrams per language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        """langs in code-point order and the trigram counts of each, one row of BUCKETS."""
        self.langs = langs
        n = counts + 0.1
        self.logs = np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32).T.copy()

    def posterior(self, text: bytes | None) -> np.ndarray | None:
        """Posterior from the text alone under equal priors; None where it has no letters."""
        if not text or not self.langs:
            return None
        total, n, letters = np.zeros(len(self.langs)), 0, False
        for at in range(0, len(text), 1 << 20):
            raw = np.frombuffer(text[at : at + (1 << 20) + 2], np.uint8)
            letters = letters or bool(_LETTER[raw].any())
            if len(raw) < 3:
                raw = np.concatenate([[32], raw, [32, 32]]).astype(np.uint8)
            g = _grams(raw)
            total += self.logs[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        if not letters:
            return None
        x = total * (min(n, TEMPER) / n)
        p = np.exp(x - x.max())
        return p / p.sum()


def _trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in chunks(batches):
        for lang, t in zip(b.column(0).to_pylist(), as_bytes(b), strict=True):
            if len(t) >= 3:
                n = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for at in range(0, len(t), 1 << 20):
                    raw = np.frombuffer(t[at : at + (1 << 20) + 2], np.uint8)
                    if len(raw) >= 3:
                        n += np.bincount(_grams(raw), minlength=BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "gram", "n"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> TextModel:
    """Fit on about sample distinct texts of labelled(text, lang), read whole.

    Each language gives an equal share, those of least hash, so copies of a text count once
    and a rare language is heard. A first pass counts the distinct texts of each language;
    the second takes the texts whose hash is below the share of that number. Trigrams are
    counted where the texts are: only one count per language and trigram reaches the driver,
    however long the texts. Rows with a null text or language take no part.
    """
    rows = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    h = F.xxhash64("text")
    there = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(h, 0.02).alias("n")).collect()}
    langs = sorted(there)
    counts = np.zeros((len(langs), BUCKETS))
    if langs:
        share = max(1, sample // len(langs))
        part = {x: min(1.0, 1.1 * share / max(n, 1)) for x, n in there.items()}
        most = F.create_map(*[F.lit(v) for x in langs for v in (x, int(part[x] * (1 << 62)))])[F.col("lang")]
        low = rows.where(F.shiftrightunsigned(h, 2) <= most).groupBy("lang", h.alias("h")).agg(F.any_value("text").alias("text"))
        order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 2), "h")
        chosen = low.withColumn("r", F.row_number().over(order)).where(F.col("r") <= share).select("lang", "text")
        got = chosen.mapInArrow(_trigram_counts, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
        counts[np.searchsorted(np.array(langs, object), got["lang"].to_numpy(object)), got["gram"]] = got["n"]
    return TextModel(langs, counts)


def _scored(evidence: DataFrame, model: TextModel) -> DataFrame:
    """The columns of evidence but the text, and p, the text's posterior (null without letters)."""
    shared = evidence.sparkSession.sparkContext.broadcast(model)
    cols = [c for c in evidence.columns if c != "__text"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "__text"):
            p = [shared.value.posterior(t) for t in as_bytes(b, "__text")]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(p, pa.list_(pa.float64()))], names=[*cols, "__p"])

    return evidence.select(*cols, "__text").mapInArrow(emit, evidence.select(*cols).schema.add("__p", ArrayType(DoubleType())))


def _add(n: int, name: str = "__p") -> list[Column]:
    return [F.coalesce(F.sum(F.element_at(name, i + 1)), F.lit(0.0)).alias(f"n{i}") for i in range(n)]


def _vec(n: int) -> Column:
    return F.array(*[F.col(f"n{i}") for i in range(n)])


def _smooth(counts: Column, prior: Column, rows: float, own: Column | None = None) -> Column:
    """(counts - own + rows * prior), made to sum to 1."""
    x = F.zip_with(counts, prior, lambda c, q: c + rows * q)
    if own is not None:
        x = F.zip_with(x, F.coalesce(own, F.transform(counts, lambda _: F.lit(0.0))), lambda c, o: F.greatest(c - o, F.lit(1e-9)))
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return F.transform(x, lambda v: v / total)


def identify(docs: DataFrame, model: TextModel, host: Column | None = None, suffix: Column | None = None, declared: Column | None = None) -> DataFrame:
    """All columns of docs but text, with lang_id, posterior and accepted.

    host, suffix and declared are expressions over docs; a null one is no evidence of its
    kind. A text that is null or has no letters brings no text evidence; where nothing is
    known of a row at all, or no language reaches ACCEPT, lang_id is null or the likeliest
    and accepted is false. Null ids and repeated rows stay as they are; columns of docs
    named like a result are replaced; an empty table gives no rows.
    """
    made = ("lang_id", "posterior", "accepted")
    k = len(model.langs)
    plain = lambda c: F.lit(None).cast("string") if c is None else F.lower(F.trim(c.cast("string")))
    known = F.array(*[F.lit(x) for x in model.langs]) if k else F.array().cast("array<string>")
    told = plain(declared)
    told = F.when(told == "", None).when(F.array_contains(known, F.substring_index(told, "-", 1)), F.substring_index(told, "-", 1)).when(told.isNotNull(), F.lit("other"))
    evidence = docs.select(F.struct(*[c for c in docs.columns if c != "text" and c.lower() not in made]).alias("doc"), plain(host).alias("__host"), plain(suffix).alias("__suffix"), told.alias("__told"), F.col("text").cast("string").alias("__text"))
    if not k:
        return evidence.select("doc.*", F.lit(None).cast("string").alias("lang_id"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("accepted"))
    scored = cut(_scored(evidence, model))
    hosts = cut(scored.where("__p is not null").groupBy("__host", "__suffix", "__told").agg(*_add(k)))
    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]
    root = np.array([x or 0.0 for x in hosts.agg(*sums).first()]) + 1.0
    world = F.array(*[F.lit(float(x)) for x in root / root.sum()])
    # P(declared | language), with a row's worth of prior for an honest declaration: one row per language and "other".
    said = {r["__told"]: np.array([r[f"n{i}"] for i in range(k)]) for r in hosts.where("__told is not null").groupBy("__told").agg(*sums).collect()}
    names = [*model.langs, "other"]
    table = np.array([said.get(d, np.zeros(k)) for d in names]) + np.array([[4.0 if d == lang else 0.5 for lang in model.langs] for d in names])
    table /= table.sum(axis=0)
    spoken = F.create_map(*[x for d, row in zip(names, table, strict=True) for x in (F.lit(d), F.array(*[F.lit(float(v)) for v in row]))])
    suffixes = hosts.groupBy("__suffix").agg(*sums).select(F.col("__suffix").alias("s"), _vec(k).alias("sv"))
    prior = hosts.groupBy("__host", "__suffix").agg(*sums).select("__host", "__suffix", _vec(k).alias("hv"))
    prior = cut(prior.join(suffixes, F.col("__suffix").eqNullSafe(F.col("s"))).select(F.col("__host").alias("h"), F.col("__suffix").alias("s"), "hv", F.when(F.col("s").isNull(), world).otherwise(_smooth(F.col("sv"), world, SUFFIX_ROWS)).alias("sp")))
    if prior.count() <= BROADCAST_ROWS:
        prior = F.broadcast(prior)
    both = scored.join(prior, F.col("__host").eqNullSafe(F.col("h")) & F.col("__suffix").eqNullSafe(F.col("s")), "left")
    flat = F.array(*[F.lit(1.0)] * k)
    base = F.when(F.col("hv").isNull(), world).when(F.col("__host").isNull(), F.col("sp")).otherwise(_smooth(F.col("hv"), F.col("sp"), HOST_ROWS, F.col("__p")))
    fused = F.zip_with(F.zip_with(F.coalesce("__p", flat), base, lambda a, b: a * b), F.coalesce(spoken[F.col("__told")], flat), lambda a, b: a * b)
    both = both.withColumn("__f", fused).withColumn("__sum", F.aggregate("__f", F.lit(0.0), lambda a, v: a + v))
    blank = F.col("__p").isNull() & F.col("__told").isNull() & F.col("__host").isNull() & F.col("__suffix").isNull()
    top = F.array_max("__f")
    post = F.when(blank, None).otherwise(top / F.col("__sum"))
    out = both.select("doc", F.when(~blank, F.element_at(known, F.array_position(F.col("__f"), top).cast("int"))).alias("lang_id"), post.alias("posterior"), F.col("__p").isNotNull().alias("__text"))
    return out.select("doc.*", "lang_id", "posterior", (F.col("__text") & (F.coalesce(F.col("posterior"), F.lit(0.0)) >= ACCEPT)).alias("accepted"))


def identify_documents(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """identify over documents: text models come from labelled rows of docs itself.

    The source is the host, what follows its last dot the address suffix (none without a
    dot), and the declared language that of an html tag in the text (none in plain text).
    """
    return identify(docs, fit(docs, sample), **_evidence())


def _evidence() -> dict[str, Column]:
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    told = F.when(text.contains("<html") | text.contains("<HTML"), F.regexp_extract(text, _DECLARED, 1))
    return {"host": source, "suffix": F.when(source.contains("."), F.substring_index(source, ".", -1)), "declared": told}


def identify_pages(pages: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """identify over web pages(url, html): visible text, declared html language, host and address suffix."""
    html = F.col("html").cast("string")
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|title)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    host = F.expr(r"regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)")
    host = F.when(host != "", host)
    told = F.regexp_extract(html, _DECLARED, 1)
    return identify(pages.withColumn("text", body), fit(labelled, sample), host=host, suffix=F.substring_index(host, ".", -1), declared=told)


def keep_accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose language is accepted, with their columns; rejected rows are found by id and text.

    Rows with null or empty texts or texts without letters are rejected; a null id or source
    is allowed; rows equal in id, text and source fare alike.
    """
    key = row_key("doc_id", "text", "source")
    said = identify(docs.select("text", "source", key.alias("row_key")), fit(docs, sample), **_evidence())
    gone = cut(said.where("not accepted").select(F.col("row_key").alias("__key")).distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.select(F.struct("*").alias("doc"), key.alias("__key")).join(gone, "__key", "left_anti").select("doc.*")
