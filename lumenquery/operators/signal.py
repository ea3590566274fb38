"""Array kernels over sound and images, applied per row in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

#: Fixed values of the beat tracker: window, hop and bins at 16 kHz; tempo range; gates.
RATE, WIN, HOP, BINS = 16_000, 1024, 256, 512
STEP = HOP / RATE
BPM_LOW, BPM_HIGH, PRIOR_PERIOD, GATE, TIGHT = 60.0, 180.0, 0.5, 0.25, 100.0


def _half_up(x: float) -> int:
    return int(np.floor(x + 0.5))


def onset_envelope(pcm: np.ndarray) -> np.ndarray:
    """Rectified log-spectral flux, less its moving mean, at unit RMS."""
    n = (len(pcm) - WIN) // HOP + 1
    frames = np.lib.stride_tricks.sliding_window_view(pcm, WIN)[::HOP][:n]
    hann = np.sin(np.pi * np.arange(WIN) / WIN) ** 2
    mag = np.log1p(100.0 * np.abs(np.fft.rfft(frames * hann, axis=1))[:, :BINS])
    flux = np.maximum(np.diff(mag, axis=0, prepend=np.zeros((1, BINS))), 0).sum(axis=1)
    half = int(0.25 / STEP)
    total = np.concatenate([[0.0], np.cumsum(flux)])
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    e = np.maximum(flux - (total[hi] - total[lo]) / (hi - lo), 0)
    rms = np.sqrt((e**2).mean())
    return e / rms if rms > 0 else e


def beat_grid(pcm: np.ndarray) -> dict | None:
    """bpm, beats in seconds, downbeats as places among them, and loud spans; None without a clear pulse (ALG6)."""
    if len(pcm) < 8192:
        return None
    e = onset_envelope(np.asarray(pcm, float))
    low, high = _half_up(60 / BPM_HIGH / STEP), _half_up(60 / BPM_LOW / STEP)
    n = len(e)
    if n < 2 * high:
        return None
    x = e - e.mean()
    r0 = (x * x).mean()
    if r0 <= 0:
        return None
    lags = np.arange(low, high + 1)
    r = np.array([(x[k:] * x[: n - k]).sum() / (n - k) / r0 for k in lags])
    score = r * np.exp(-0.5 * np.log2(lags * STEP / PRIOR_PERIOD) ** 2)
    best = int(score.argmax())
    if r[best] < GATE:
        return None
    period = int(lags[best])
    total, back = e.copy(), np.full(n, -1)
    near, far = _half_up(period / 2), 2 * period
    gaps = np.arange(far, near - 1, -1)
    penalty = TIGHT * np.log(gaps / period) ** 2
    for t in range(near, n):
        ok = gaps <= t
        value = total[t - gaps[ok]] - penalty[ok]
        k = int(value.argmax())
        if value[k] > 0:
            total[t] += value[k]
            back[t] = t - gaps[ok][k]
    tail = total[max(0, n - far) :]
    at = n - 1 - int(tail[::-1].argmax())
    beats = []
    while at >= 0:
        beats.append(at)
        at = int(back[at])
    beats = np.array(beats[::-1])
    if len(beats) < 4:
        return None
    strong = e[beats]
    anchor = len(beats) - 1 - int(strong[::-1].argmax())
    return {"bpm": 60.0 / (period * STEP), "beats": (beats * STEP).tolist(), "downbeats": list(range(anchor % 4, len(beats), 4)), "high_energy": [{"start": a, "end": b} for a, b in loud_spans(pcm)]}


def loud_spans(pcm: np.ndarray, shortest: float = 3.0) -> list[tuple[float, float]]:
    """Half-open seconds whose level stands above the track's quiet and loud levels (ALG7, AG16, W6, G23)."""
    x = np.asarray(pcm, float)
    if len(x) < 4 * RATE:
        return []
    rms = np.array([np.sqrt((x[i : i + RATE] ** 2).mean()) for i in range(0, len(x), RATE)])
    s = np.sort(rms)
    quiet, loud = s[len(s) // 10], s[4 * len(s) // 5]
    if quiet <= 1e-9 or loud < 1.3 * quiet:
        return []
    hot = np.concatenate([[False], rms > np.sqrt(quiet * loud), [False]])
    edges = np.flatnonzero(hot[1:] != hot[:-1])
    return [(float(a), float(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= shortest]


def laplacian_variance(gray: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian inside the border; 0 under 3x3 (AG17)."""
    g = np.asarray(gray, float)
    if g.ndim != 2 or min(g.shape) < 3:
        return 0.0
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var())


def similarity_transform(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 2x3 matrix of rotation, scale and shift that maps points src closest to dst."""
    a, b = src - src.mean(axis=0), dst - dst.mean(axis=0)
    u, s, vt = np.linalg.svd(b.T @ a / len(src))
    flip = np.diag([1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    rot = u @ flip @ vt
    scale = (s * np.diag(flip)).sum() / (a**2).sum(axis=1).mean()
    return np.hstack([scale * rot, (dst.mean(axis=0) - scale * rot @ src.mean(axis=0))[:, None]])


BEATS = StructType().add("bpm", DoubleType()).add("beats", ArrayType(DoubleType())).add("downbeats", ArrayType(IntegerType())).add("high_energy", ArrayType(StructType().add("start", DoubleType()).add("end", DoubleType())))
SPANS = ArrayType(StructType().add("start", DoubleType()).add("end", DoubleType()))


@F.pandas_udf(BEATS)
def beats(pcm: pd.Series) -> pd.DataFrame:
    """beat_grid of a PCM column."""
    got = [beat_grid(np.asarray(p)) if p is not None else None for p in pcm]
    return pd.DataFrame({k: [g and g[k] for g in got] for k in ("bpm", "beats", "downbeats", "high_energy")})


@F.pandas_udf(SPANS)
def loud(pcm: pd.Series) -> pd.Series:
    """loud_spans of a PCM column."""
    return pcm.map(lambda p: [] if p is None else [{"start": a, "end": b} for a, b in loud_spans(np.asarray(p))])


@F.pandas_udf(DoubleType())
def sharpness(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """laplacian_variance of grey pixels in row order."""
    return pd.Series([None if p is None else laplacian_variance(np.asarray(p).reshape(-1, int(w))) for p, w in zip(pixels, width, strict=True)])


def audible(pcm: Column) -> Column:
    """At least a second, and louder than a whisper."""
    return (F.size(pcm) >= RATE) & (F.sqrt(F.aggregate(pcm, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(pcm)) > 0.01)


def level_spans(levels: DataFrame, key: str, at: str, level: str, shortest: int = 3) -> DataFrame:
    """Runs of consecutive steps whose level is over the geometric mean of the key's quiet and loud levels.

    levels(key, at, level) holds one row per step. Percentiles are by index of the sorted
    levels; a key without contrast has no runs. The same rule as loud_spans, on columns.
    """
    q = levels.groupBy(key).agg(F.sort_array(F.collect_list(level)).alias("s"), F.count(F.lit(1)).alias("n"))
    q = q.select(key, F.element_at("s", (F.floor(F.col("n") / 10) + 1).cast("int")).alias("quiet"), F.element_at("s", (F.floor(4 * F.col("n") / 5) + 1).cast("int")).alias("loud"))
    q = q.where((F.col("quiet") > 1e-9) & (F.col("loud") >= 1.3 * F.col("quiet")))
    hot = levels.join(q, key).where(F.col(level) > F.sqrt(F.col("quiet") * F.col("loud")))
    island = F.col(at) - F.row_number().over(Window.partitionBy(key).orderBy(at))
    runs = hot.withColumn("__i", island).groupBy(key, "__i").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end"))
    return runs.where(F.col("end") - F.col("start") >= shortest).select(key, "start", "end")
