"""Approximate nearest neighbours over learned partitions.

On a bounded sample a k-nearest-neighbour graph is cut into balanced parts, and a small
classifier learns which parts hold a vector and its neighbours. Every vector is filed in
its likeliest part; a query visits its most probable parts and reranks what it finds by
exact cosine. How many parts to visit is measured on the sample against brute force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .io import cut

#: Vectors that the partition and the classifier are fitted on (more where parts are many), of each part at least; neighbours in the graph.
SAMPLE, SAMPLE_PER_PART, GRAPH = 8192, 8, 10
#: Vectors per part that are aimed at, bounds on the number of parts (33 million vectors; parts are larger beyond), and vectors or queries of one task's block.
PER_PART, LEAST_PARTS, MOST_PARTS, BLOCK = 4096, 8, 8192, 1024
#: One in so many sampled vectors is kept from fitting; the number of visited parts reaches RECALL on these.
HELD_OUT = 8
#: Recall on the held-out vectors from which the number of visited parts is taken.
RECALL = 0.97


def _knn(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), int)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _halves(x: np.ndarray, rows: np.ndarray, parts: int) -> list[np.ndarray]:
    """Split rows into equal parts by the median along the leading direction, again and again."""
    if parts == 1:
        return [rows]
    y = x[rows] - x[rows].mean(axis=0)
    v = np.linalg.svd(y.T @ y)[0][:, 0]
    order = rows[np.argsort(y @ v, kind="stable")]
    half = len(order) // 2
    return _halves(x, order[:half], parts // 2) + _halves(x, order[half:], parts // 2)


def partition_graph(x: np.ndarray, parts: int, sweeps: int = 6, slack: float = 1.1) -> tuple[np.ndarray, np.ndarray]:
    """Balanced parts of the neighbour graph (no part over slack times the mean), and the graph.

    Starts from halvings and moves vertices to the part that most of their neighbours are
    in while there is room.
    """
    k = min(GRAPH, len(x) - 1)
    graph = _knn(x, k) if k > 0 else np.zeros((len(x), 0), int)
    part = np.zeros(len(x), int)
    for i, rows in enumerate(_halves(x, np.arange(len(x)), parts)):
        part[rows] = i
    room = int(np.ceil(slack * len(x) / parts))
    size = np.bincount(part, minlength=parts)
    back = [[] for _ in range(len(x))]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    near = [np.concatenate([row, b]).astype(int) for row, b in zip(graph, back, strict=True)]
    for _ in range(sweeps):
        moved = 0
        for i in range(len(x)):
            votes = np.bincount(part[near[i]], minlength=parts)
            best = int(np.where((size < room) | (np.arange(parts) == part[i]), votes, -1).argmax())
            if votes[best] > votes[part[i]]:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < len(x) / 200:
            break
    return part, graph


class Router:
    """A two-layer classifier from unit vectors to parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 5):
        r = np.random.Generator(np.random.PCG64(seed))
        d, parts = x.shape[1], target.shape[1]
        self.w = [r.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at : at + 256]
                h = np.maximum(x[rows] @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                g = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
                gh = (g @ self.w[2].T) * (h > 0)
                step += 1
                for i, grad in enumerate((x[rows].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad**2
                    self.w[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, likeliest first."""
        z = np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        return np.argsort(-z, axis=1, kind="stable")


class Index:
    """Partition, classifier, and the number of parts to visit for RECALL on vectors that neither was fitted on."""

    def __init__(self, x: np.ndarray, parts: int, k: int):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.parts = parts
        test = np.arange(0, len(x), HELD_OUT)
        fitted = np.delete(x, test, axis=0)
        part, graph = partition_graph(fitted, parts)
        target = np.eye(parts)[part]
        if graph.shape[1]:
            target = 0.5 * target + 0.5 * np.eye(parts)[part[graph]].mean(axis=1)
        self.router = Router(fitted, target)
        home = self.router.order(x)[:, 0]
        test = test[:2000]
        s = x[test] @ x.T
        s[np.arange(len(test)), test] = -np.inf
        near = min(k, len(x) - 1)
        best = np.argpartition(-s, near - 1, axis=1)[:, :near] if near > 0 else np.zeros((len(test), 0), int)
        place = np.argsort(self.router.order(x[test]), axis=1)  # rank of each part for each query
        ranks = np.take_along_axis(place, home[best], axis=1) if best.shape[1] else np.zeros((1, 1))
        self.visit = next((m for m in range(1, parts + 1) if (ranks < m).mean() >= RECALL), parts)

    def route(self, x: np.ndarray) -> np.ndarray:
        return self.router.order(x / np.linalg.norm(x, axis=1, keepdims=True))


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    """row (a number of its own), vec_id and v: vectors that are not null, not zero and finite throughout."""
    v = F.col(column).cast("array<double>")
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & fine).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def _matrix(col) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _best(t: pa.Table, k: int) -> pa.Table:
    """The k nearest candidates of each query of one block, by cosine in double precision."""
    query = t.column("q").to_numpy()
    rows, ids, x = t.column("row").to_numpy(), t.column("vec_id").to_numpy(), _matrix(t.column("v"))
    cand, ask = np.flatnonzero(~query), np.flatnonzero(query)
    out = ([], [], [], [])
    if len(cand) and len(ask):
        cand = cand[np.argsort(ids[cand], kind="stable")]
        norm = np.sqrt((x * x).sum(axis=1))
        rough = (x[ask] / norm[ask, None]) @ (x[cand] / norm[cand, None]).T
        rough[rows[ask][:, None] == rows[cand][None, :]] = -np.inf
        keep = min(k, len(cand))
        floor = np.partition(rough, len(cand) - keep, axis=1)[:, len(cand) - keep] - 1e-9
        for row, i in enumerate(ask):
            near = cand[(rough[row] >= floor[row]) & (rough[row] > -np.inf)]
            s = (x[near] * x[i]).sum(axis=1) / (norm[near] * norm[i])
            top = np.argsort(-s, kind="stable")[:k]  # candidates lie by id, so ties go to the smaller
            out[0].append(np.full(len(top), ids[i]))
            out[1].append(ids[near[top]])
            out[2].append(s[top])
            out[3].append(np.full(len(top), rows[i]))
    col = lambda a, kind: pa.array(np.concatenate(a).astype(kind) if a else np.empty(0, kind))
    return pa.table({"query_id": col(out[0], np.int64), "vec_id": col(out[1], np.int64), "score": col(out[2], np.float64), "row": col(out[3], np.int64)})


def _search(vectors: DataFrame, queries: Column, k: int) -> DataFrame:
    """Search of one table (vec_id, v) of equally long vectors."""
    n = vectors.count()
    parts = int(min(MOST_PARTS, max(LEAST_PARTS, 2 ** np.ceil(np.log2(max(n, 1) / PER_PART)))))
    most = max(SAMPLE, SAMPLE_PER_PART * parts)
    # Rows are chosen by a hash below a bound first, so that the driver sees a little more than it keeps.
    bound = int(min(1.0, 1.3 * most / max(n, 1)) * (1 << 52))
    some = vectors.where(F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1 << 52)) <= bound).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most)
    sample = np.array([r["v"] for r in some.select("v").collect()])
    if len(sample) < 4 * parts:
        parts = 1
    index = vectors.sparkSession.sparkContext.broadcast(Index(sample, parts, k) if parts > 1 else None)

    def file(batches):
        for b in batches:
            if b.num_rows:
                m = index.value
                x = _matrix(b.column(2))
                order = m.route(x)[:, : m.visit] if m else np.zeros((len(x), 1), int)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))], names=["row", "vec_id", "v", "route"])

    filed = cut(vectors.mapInArrow(file, "row long, vec_id long, v array<double>, route array<int>"))
    home = F.element_at("route", 1)
    # One row per part, at most MOST_PARTS.
    size = {r["p"]: r["n"] for r in filed.groupBy(home.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    asks = filed.where(queries)
    asked = {r["p"]: r["n"] for r in asks.select(F.explode("route").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = lambda of: F.create_map(*[F.lit(int(x)) for p in range(parts) for x in (p, -(-of.get(p, 0) // BLOCK) or 1)])
    spread = lambda p, of, salt: F.pmod(F.xxhash64(F.lit(salt), "row"), blocks(of)[p]).cast("int")
    every = lambda p, of: F.explode(F.sequence(F.lit(0), blocks(of)[p] - 1))
    cand = filed.select(F.lit(False).alias("q"), "row", "vec_id", "v", home.alias("part")).select("*", spread(F.col("part"), size, 1).alias("cb")).select("*", every(F.col("part"), asked).alias("qb"))
    asks = asks.select(F.lit(True).alias("q"), "row", "vec_id", "v", F.explode("route").alias("part")).select("*", spread(F.col("part"), asked, 2).alias("qb")).select("*", every(F.col("part"), size).alias("cb"))
    found = cand.unionByName(asks).groupBy("part", "cb", "qb").applyInArrow(lambda t: _best(t, k), "query_id long, vec_id long, score double, row long")
    rank = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each vector whose id is divisible by every.

    Nearest is the largest cosine, ties to the smaller id; a vector isn't its own
    neighbour. Null and zero vectors and those that hold a null or non-finite component
    take no part, nor do null ids; rows that share an id are rows of their own, as queries
    and as candidates; vectors are compared with those of their own length. Fewer candidates than k give fewer rows,
    an empty table none. Further columns are dropped.
    """
    rows = cut(_usable(vectors, column))
    lengths = [r["n"] for r in rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy("n").collect()]
    out = None
    for n in lengths:
        got = _search(rows.where(F.size("v") == n), F.col("vec_id") % every == 0, k)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
