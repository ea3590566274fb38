"""Identity assignment: exemplars, attachment of faces to people, and proposals of new people."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, dot
from ..session import cut
from .blocks import exact_dot, matrix, meet, slack, tiles
from .dupes import groups, similar_pairs

#: Width of the ranges that a node's neighbours are dealt to, one row each; a neighbour in a scratch file.
NEIGHBOURS, EDGE = 4096, np.dtype([("j", "<i8"), ("w", "<f4")])


@dataclass(frozen=True)
class Params:
    """Distances and sizes of the clustering; the values are fixed defaults."""

    attach: float = 0.5
    link: float = 0.4
    min_faces: int = 3
    seed_score: float = 0.8
    exemplars: int = 5


def choose_exemplars(x: np.ndarray, k: int) -> list[int]:
    """The medoid, then the farthest from those chosen; all when there are at most k (K7, AG13, G13).

    First medoid on ties, last farthest on ties; ascending order. Dot products are taken
    row by row, so that equal vectors tie exactly.
    """
    n = len(x)
    if n <= k:
        return list(range(n))
    # The sum of distances to the others is n - 1 less this.
    chosen = [int(((x * x.sum(axis=0)).sum(axis=1) - (x * x).sum(axis=1)).argmax())]
    gap = 1.0 - (x * x[chosen[0]]).sum(axis=1)
    while len(chosen) < k:
        gap[chosen] = -np.inf
        far = n - 1 - int(gap[::-1].argmax())
        chosen.append(far)
        gap = np.minimum(gap, 1.0 - (x * x[far]).sum(axis=1))
    return sorted(chosen)


def exemplars(faces: DataFrame, k: int = 5, most: int = 2000) -> DataFrame:
    """person_id, face_id and vector of the exemplars of each person with faces.

    All faces of a person count, however many. A person of at most most faces is one group
    of a task; the others, and those whose vectors differ in width, take a round of grouped
    maxima per exemplar (wide_exemplars), so that no task holds all faces of one person.
    """
    rows = faces.where("person_id is not null and vector is not null").select("person_id", "face_id", "vector")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("face_id")
        return pdf.iloc[choose_exemplars(np.array(pdf["vector"].tolist(), float), k)][["person_id", "face_id", "vector"]]

    size = rows.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), (F.min(F.size("vector")) < F.max(F.size("vector"))).alias("mixed"))
    sized = rows.join(size, "person_id")
    every = sized.where(F.col("n") <= k).select("person_id", "face_id", "vector")
    one_task = (F.col("n") <= most) & ~F.col("mixed")
    small = sized.where((F.col("n") > k) & one_task).select("person_id", "face_id", "vector").groupBy("person_id").applyInPandas(pick, "person_id long, face_id long, vector array<double>")
    return every.unionByName(small).unionByName(wide_exemplars(sized.where((F.col("n") > k) & ~one_task), k))


def wide_exemplars(sized: DataFrame, k: int) -> DataFrame:
    """choose_exemplars for people of any number of faces: sized(person_id, face_id, vector, n, mixed), n over k.

    A face's summed distance to the others is n - 1 less its dot product with the sum of the
    others, so the medoid is a grouped sum and a grouped maximum; each farthest face is
    another maximum against those chosen. People of so many faces are few: their rows are
    broadcast and the maxima are combined before the shuffle. Where widths differ all sums
    are infinite, and the first face is the medoid.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(p, np.array(v.tolist(), float).sum(axis=0)) for (p, _), v in pdf["vector"].groupby([pdf["person_id"], pdf["vector"].map(len)])]
            yield pd.DataFrame({"person_id": [p for p, _ in out], "total": [t for _, t in out]})

    part = sized.select("person_id", "vector").mapInPandas(sums, "person_id long, total array<double>")
    part = part.select("person_id", F.posexplode("total").alias("at", "x")).groupBy("person_id", "at").agg(F.sum("x").alias("x"))
    total = part.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("total"))
    own = F.when(F.col("mixed"), 0.0).otherwise(dot(F.col("vector"), F.col("total")) - dot(F.col("vector"), F.col("vector")))
    face = F.struct("face_id", F.col("vector").cast("array<double>").alias("vector"))
    first = sized.join(F.broadcast(total), "person_id").groupBy("person_id").agg(F.max_by(face, F.struct(own, -F.col("face_id"))).alias("face"))
    chosen = first.select("person_id", F.array("face").alias("chosen"))
    for _ in range(k - 1):
        left = sized.join(F.broadcast(chosen), "person_id").where(~F.exists("chosen", lambda c: c["face_id"] == F.col("face_id")))
        gap = F.array_min(F.transform("chosen", lambda c: cosine_distance(F.col("vector"), c["vector"])))
        far = left.groupBy("person_id").agg(F.max_by(face, F.struct(gap, F.col("face_id"))).alias("face"), F.first("chosen").alias("chosen"))
        chosen = far.select("person_id", F.array_append("chosen", F.col("face")).alias("chosen"))
    return chosen.select("person_id", F.explode("chosen").alias("c")).select("person_id", "c.face_id", "c.vector")


def attach(unassigned: DataFrame, chosen: DataFrame, rejections: DataFrame, limit: float = 0.5) -> DataFrame:
    """face_id, person_id and distance of the nearest person within limit that the face wasn't rejected for.

    Blocks of faces meet blocks of exemplars; one row per face and block leaves a task, and
    the best is a grouped minimum. Rejected people travel with their face. Ties go to the smaller person.
    """
    no = rejections.where("person_id is not null").groupBy("face_id").agg(F.collect_set("person_id").alias("no"))
    faces = unassigned.select("face_id", "vector").join(no, "face_id", "left")

    def nearest(ft: pa.Table, et: pa.Table, width: int) -> pa.Table:
        faces, people = ft.column("face_id").to_numpy(), et.column("person_id").to_numpy()
        x, y = matrix(ft.column("vector"), width), matrix(et.column("vector"), width)
        barred = [(i, n) for i, n in enumerate(ft.column("no").to_pylist()) if n]
        eps = slack(x, y)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for r, c, s in tiles(x, y):
            s[np.isnan(s)] = -np.inf
            for i, n in barred:
                if r <= i < r + len(s):
                    s[i - r, np.isin(people[c : c + s.shape[1]], n)] = -np.inf
            i, j = np.nonzero((s >= s.max(axis=1, keepdims=True) - eps) & (s >= 1 - limit - eps))
            i, j = i + r, j + c
            d = 1 - exact_dot(x, i, y, j)
            out.append((i[d <= limit], people[j[d <= limit]], d[d <= limit]))
        i, person, d = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        best = np.lexsort((person, d, i))
        best = best[np.unique(i[best], return_index=True)[1]]
        return pa.table({"face_id": pa.array(faces[i[best]], pa.int64()), "person_id": pa.array(person[best], pa.int64()), "distance": d[best]})

    near = meet(faces, "face_id", chosen.where("person_id is not null").select("person_id", "vector"), "vector", nearest, "face_id long, person_id long, distance double")
    best = near.groupBy("face_id").agg(F.min(F.struct("distance", "person_id")).alias("b"))
    return best.select("face_id", "b.person_id", "b.distance")


def permutations(n: int, sweeps: int):
    """The shuffles of the sweeps, one generator running through all (fixed constants of its recurrence)."""
    state, wrap = 0x5EED, (1 << 64) - 1
    for _ in range(sweeps):
        order = list(range(n))
        for i in range(n - 1, 0, -1):
            state = (state * 6364136223846793005 + 1442695040888963407) & wrap
            j = (state >> 33) % (i + 1)
            order[i], order[j] = order[j], order[i]
        yield order


def whispers(nodes: list[int], edges: list[tuple[int, int, float]], n: int, sweeps: int = 20) -> dict[int, int]:
    """Labels of one component's nodes (global indices) after label propagation in the global order (ALG4, G9)."""
    near: dict[int, list[tuple[int, np.float32]]] = {i: [] for i in nodes}
    for i, j, w in edges:
        near[i].append((j, np.float32(w)))
        near[j].append((i, np.float32(w)))
    label = {i: i for i in nodes}
    for order in permutations(n, sweeps):
        changed = False
        for i in order:
            if not near.get(i):
                continue
            votes: dict[int, np.float32] = {}
            for j, w in sorted(near[i]):
                votes[label[j]] = np.float32(votes.get(label[j], np.float32(0)) + w)
            best = min(votes, key=lambda k: (-votes[k], k))
            if best != label[i]:
                label[i], changed = best, True
        if not changed:
            break
    return label


def ranked_ids(faces: DataFrame) -> DataFrame:
    """face_id and idx, its place among all in order, counted from 0: ranges are numbered apart, then shifted."""
    part = cut(faces.select("face_id").repartitionByRange("face_id").withColumn("part", F.spark_partition_id()))
    before, start = [], 0
    for r in part.groupBy("part").count().orderBy("part").collect():
        before.append((r["part"], start))
        start += r["count"]
    shift = faces.sparkSession.createDataFrame(before, "part int, start long")
    at = F.row_number().over(Window.partitionBy("part").orderBy("face_id")) - 1
    return cut(part.withColumn("at", at).join(F.broadcast(shift), "part").select("face_id", (F.col("at") + F.col("start")).alias("idx")))


def sweep_stored(batches: Iterator[pa.RecordBatch], n: int, sweeps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and labels as whispers has them, of whole components given as rows (i, part, js, ws).

    Neighbours lie in a scratch file of the task, removed with it, and are read a node at a
    time, so that memory grows with the nodes and not with the edges. Components in one task
    don't touch each other, so they are swept together.
    """
    node, part, start, size, at = [], [], [], [], 0
    with tempfile.TemporaryFile() as file:
        for b in batches:
            js, ws = b.column("js"), b.column("ws")
            count = pc.list_value_length(js).to_numpy(zero_copy_only=False)
            both = np.empty(int(count.sum()), EDGE)
            both["j"], both["w"] = js.flatten().to_numpy(zero_copy_only=False), ws.flatten().to_numpy(zero_copy_only=False)
            file.write(both.tobytes())
            node.append(b.column("i").to_numpy(zero_copy_only=False))
            part.append(b.column("part").to_numpy(zero_copy_only=False))
            start.append(at + np.cumsum(count) - count)
            size.append(count)
            at += len(both)
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        file.flush()
        node, part, start, size = (np.concatenate(x) for x in (node, part, start, size))
        order = np.lexsort((part, node))
        nodes, first = np.unique(node[order], return_index=True)
        last = np.r_[first[1:], len(order)]
        start, size = start[order], size[order]
        place = np.full(n, -1, np.int64)
        place[nodes] = np.arange(len(nodes))
        label, votes = np.arange(n), np.zeros(n, np.float32)
        for turn in permutations(n, sweeps):
            changed = False
            for i in turn:
                k = place[i]
                if k < 0:
                    continue
                rows = [os.pread(file.fileno(), int(size[r]) * EDGE.itemsize, int(start[r]) * EDGE.itemsize) for r in range(first[k], last[k])]
                edges = np.frombuffer(b"".join(rows), EDGE)
                theirs = label[edges["j"]]
                votes[theirs] = 0
                np.add.at(votes, theirs, edges["w"])
                sums = votes[theirs]
                best = theirs[sums == sums.max()].min()
                if best != label[i]:
                    label[i], changed = best, True
            if not changed:
                break
        return nodes, label[nodes]


def propose(faces: DataFrame, must: DataFrame, must_not: DataFrame, params: Params | None = None) -> DataFrame:
    """cluster_id and face_id of the people proposed among unassigned faces (ALG5, AG12, J17).

    Pairs within params.link and without a must-not link make a graph; each component is
    swept on its own with the order of all faces. Labels and must links are united; groups
    of min_faces with one face of seed_score stay, largest first, then by first face.
    """
    p = params or Params()
    indexed = ranked_ids(faces)
    n = indexed.count()
    pairs = similar_pairs(faces.select(F.col("face_id").alias("asset_id"), "vector"), 1 - p.link).select("a", "b", "score")
    bar = must_not.select(F.least("face_a", "face_b").alias("a"), F.greatest("face_a", "face_b").alias("b"))
    pairs = cut(pairs.join(bar, ["a", "b"], "left_anti"))
    comp = groups(pairs)
    i = indexed.select(F.col("face_id").alias("a"), F.col("idx").alias("i"))
    j = indexed.select(F.col("face_id").alias("b"), F.col("idx").alias("j"))
    e = pairs.join(i, "a").join(j, "b").select(F.explode(F.array(F.struct("i", "j", "score"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "score"))).alias("e")).select("e.i", "e.j", F.col("e.score").cast("float").alias("w"))
    near = e.groupBy("i", F.expr(f"j div {NEIGHBOURS}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("near"))
    member = indexed.join(comp.select(F.col("asset_id").alias("face_id"), "group_id"), "face_id").select(F.col("idx").alias("i"), "group_id")
    rows = near.join(member, "i").select("group_id", "i", "part", F.transform("near", lambda x: x["j"]).alias("js"), F.transform("near", lambda x: x["w"]).alias("ws"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, label = sweep_stored(batches, n)
        if len(nodes):
            yield pa.RecordBatch.from_pydict({"i": nodes, "l": label})

    swept = rows.repartition("group_id").drop("group_id").mapInArrow(sweep, "i long, l long")
    labels = swept.join(indexed.select(F.col("idx").alias("i"), "face_id"), "i").join(indexed.select(F.col("idx").alias("l"), F.col("face_id").alias("label")), "l").select("face_id", "label")
    there = faces.select("face_id")
    tied = must.join(there.select(F.col("face_id").alias("face_a")), "face_a").join(there.select(F.col("face_id").alias("face_b")), "face_b")
    united = groups(labels.select(F.col("face_id").alias("a"), F.col("label").alias("b")).unionByName(tied.select(F.col("face_a").alias("a"), F.col("face_b").alias("b"))))
    g = united.select(F.col("asset_id").alias("face_id"), "group_id").join(faces.select("face_id", "score"), "face_id")
    good = g.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.min("face_id").alias("first")).where((F.col("n") >= p.min_faces) & (F.col("best") >= p.seed_score))
    ranked = good.withColumn("cluster_id", F.row_number().over(Window.orderBy(F.desc("n"), "first")))
    return g.join(ranked.select("group_id", "cluster_id"), "group_id").select("cluster_id", "face_id")


def suppress(boxes: DataFrame, key: str, limit: float = 0.3) -> DataFrame:
    """Greedy suppression per key: boxes(key, box_id, x, y, w, h, score) that overlap a better one go (K8)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "box_id"], ascending=[False, True])
        b = pdf[["x", "y", "w", "h"]].to_numpy(float)
        kept: list[int] = []
        for i in range(len(b)):
            k = b[kept]
            ix = np.maximum(0, np.minimum(k[:, 0] + k[:, 2], b[i, 0] + b[i, 2]) - np.maximum(k[:, 0], b[i, 0]))
            iy = np.maximum(0, np.minimum(k[:, 1] + k[:, 3], b[i, 1] + b[i, 3]) - np.maximum(k[:, 1], b[i, 1]))
            union = k[:, 2] * k[:, 3] + b[i, 2] * b[i, 3] - ix * iy
            if not (ix * iy > limit * union).any():
                kept.append(i)
        return pdf.iloc[kept]

    return boxes.groupBy(key).applyInPandas(one, boxes.schema)


def distinct_faces(faces: DataFrame, limit: float = 0.9) -> DataFrame:
    """Per asset, faces whose vector is within limit of a better-scored one go (K9)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "face_id"], ascending=[False, True])
        x = np.array(pdf["vector"].tolist(), float)
        kept: list[int] = []
        for i in range(len(x)):
            if not kept or (x[kept] @ x[i]).max() <= limit:
                kept.append(i)
        return pdf.iloc[kept]

    return faces.groupBy("asset_id").applyInPandas(one, faces.schema)
