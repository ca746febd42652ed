"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are split in halves; each half has a codebook of its own, and the product grid of both codebooks, for each
label, is the index. From its own cell a vector visits other cells in the order of the multi-sequence, nearest first: both halves'
centroids are sorted by distance, and a heap of pairs yields the cells one by one. The visit stops where the target recall is reached;
members of visited cells are verified by cosine in double precision.

The distance that orders cells is the least one by which a vector must move to enter the cell (to its side of the
plane between both centroids, in either half). No vector within the threshold needs a longer move than the radius that the threshold allows, so
a target recall of 1 stops there and loses no link. Below 1 the visit stops at the move that this share of vectors at the threshold's very
distance need, in all directions alike, or of the linked pairs in the sample if that is longer.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roiforge.llm.common import block_tasks, components, forest, sliced, spread_tasks, stored

#: Vectors that codebooks are fitted on, at most; members of a cell that are wished for; rows of a block.
SAMPLE, CELL, BLOCK = 65_536, 32, 512
#: Centroids of a half, at most: 16 sampled vectors each. Beyond 16 million cells for each label cells grow, and blocks take them.
MOST_CENTROIDS = SAMPLE // 16


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0)


def codebook(points: np.ndarray, k: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """k-means centroids of points, from a seeded choice of them, a block of points at a time."""
    k = min(k, len(points))
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmin(_squares(points[j : j + 4096], centroids), axis=1) for j in range(0, len(points), 4096)])
        n = np.bincount(near, minlength=k)
        for d in range(points.shape[1]):
            centroids[:, d] = np.where(n > 0, np.bincount(near, points[:, d], minlength=k) / np.maximum(n, 1), centroids[:, d])
    return centroids


def moves(half: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and for every centroid the least move into its region."""
    d2 = _squares(half, centroids)
    near = np.argmin(d2, axis=1)
    gap = d2 - d2[np.arange(len(half)), near][:, None]
    between = np.sqrt(_squares(centroids[near], centroids))
    return near, np.where(between > 0, np.maximum(gap, 0) / (2 * np.where(between > 0, between, 1)), 0.0)


def multi_sequence(a: np.ndarray, b: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) by ascending a[i] + b[j], as far as the sum is at most `most`."""
    p, q = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    x, y = a[p].tolist(), b[q].tolist()
    heap = [(x[0] + y[0], 0, 0)]
    while heap and heap[0][0] <= most:
        _, i, j = heapq.heappop(heap)
        yield p[i], q[j]
        # each pair is pushed once: along j from its predecessor, along i only from the first of a row
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


def visited(vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray], radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each row's own cell, and the cells whose distance is within radius, nearest first."""
    half = vectors.shape[1] // 2
    (n1, m1), (n2, m2) = moves(vectors[:, :half], books[0]), moves(vectors[:, half:], books[1])
    k2, most = len(books[1]), radius**2 + 1e-9
    cells = []
    for a, b in zip(m1**2, m2**2, strict=True):
        near, far = np.flatnonzero(a <= most), np.flatnonzero(b <= most)
        cells.append(np.array([near[i] * k2 + far[j] for i, j in multi_sequence(a[near], b[far], most)], dtype=np.int64))
    return n1 * k2 + n2, cells


def _reach(vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float, target: float) -> float:
    """The move at which the target share of vectors as far away as the threshold allows is found, and of the sample's linked pairs."""
    radius = math.sqrt(2 - 2 * threshold)
    if target >= 1 or vectors.shape[1] < 2:
        return radius
    half, found = vectors.shape[1] // 2, []

    def needed(from_: np.ndarray, to: np.ndarray) -> np.ndarray:
        n1, n2 = moves(to[:, :half], books[0])[0], moves(to[:, half:], books[1])[0]
        rows = np.arange(len(to))
        return np.hypot(moves(from_[:, :half], books[0])[1][rows, n1], moves(from_[:, half:], books[1])[1][rows, n2])

    rng = np.random.default_rng(9)
    for k in range(0, min(len(vectors), 8000), 500):
        u = vectors[k : k + 500]
        side = rng.normal(size=u.shape)
        side -= (side * u).sum(1, keepdims=True) * u
        side /= np.maximum(np.sqrt((side**2).sum(1, keepdims=True)), 1e-12)
        found.append(needed(u, threshold * u + math.sqrt(1 - threshold**2) * side))
    reach = float(np.quantile(np.concatenate(found), target))
    linked = []
    for k in range(0, min(len(vectors), 8000), 500):
        u = vectors[k : k + 500]
        a, b = np.nonzero(u @ vectors[:8000].T >= threshold)
        keep = a + k != b
        if keep.any():
            linked.append(needed(u[a[keep]], vectors[b[keep]]))
    if linked:
        reach = max(reach, float(np.quantile(np.concatenate(linked), target)))
    return min(radius, reach + 1e-6)


def near_duplicates(rows: DataFrame, threshold: float = 0.98, target_recall: float = 1.0) -> DataFrame:
    """rows (vec_id, embedding, label) -> vec_id, n_links, component_id, kept: a row for each row.

    Vectors link where labels (and lengths) are equal and the cosine is at least threshold. Null, empty and zero vectors, those with null
    or non-finite components and those without label or id link with nothing: n_links 0, component_id = vec_id, kept. Equal vectors form
    a class, counted but searched once, so that copies cost nothing. Repeated rows count as vectors of their own. Columns other than these
    three are ignored. Codebooks are fitted on SAMPLE classes at most; all vectors are indexed and all of them search.
    """
    spark = rows.sparkSession
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    sound = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    key = ["h", "label", "embedding"]
    good = base.where(sound).withColumn("h", F.xxhash64("embedding"))
    classes = good.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = stored(classes.withColumn("dim", F.size("embedding")), "vector-classes")
    shapes = {r["dim"]: r for r in reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels")).collect()}
    books: dict[int, tuple] = {}
    for dim, r in shapes.items():
        k = max(1, min(MOST_CENTROIDS, int(math.sqrt(r["n"] / r["labels"] / CELL)))) if dim > 1 else 1
        drawn = reps.where(F.col("dim") == dim).orderBy(F.xxhash64(F.lit(1), "rep")).limit(min(SAMPLE, max(2000, 64 * k))).select("embedding").collect()
        sample = np.array([x[0] for x in drawn])
        sample = sample / np.sqrt((sample**2).sum(1))[:, None]
        pair = (codebook(sample[:, : dim // 2], k), codebook(sample[:, dim // 2 :], k, seed=6)) if dim > 1 else (np.zeros((1, 0)), np.zeros((1, 1)))
        books[dim] = (pair, _reach(sample, pair, threshold, target_recall))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1000):
            dims = b.column(4).to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                flat = np.asarray(part.column(3).flatten()).astype("<f8").reshape(-1, int(dim))
                pair, reach = books[int(dim)]
                own, cells = visited(flat / np.sqrt((flat * flat).sum(1))[:, None], pair, reach)
                # a pair of vectors in different cells is met twice; the visit of the one in the later cell counts
                others = [c[c < o] for c, o in zip(cells, own, strict=True)]
                at = np.repeat(np.arange(len(own)), [len(c) + 1 for c in others])
                cell = np.concatenate([np.concatenate([[o], c]) for c, o in zip(others, own, strict=True)]).astype(np.int64)
                role = np.where(cell == own[at], 0, 1).astype(np.int32)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(np.full(len(at), dim, dtype=np.int32)), pa.array(cell), pa.array(role)], names=["rep", "h", "label", "dim", "cell", "role"])

    dealt = stored(reps.select("rep", "h", "label", "embedding", "dim").mapInArrow(deal, "rep long, h long, label long, dim int, cell long, role int"), "vector-visits")
    tasks = block_tasks(dealt, ["label", "dim", "cell"], ["rep", "h"], BLOCK).drop("role")
    tasks = spread_tasks(tasks.join(reps.select("rep", "h", "label", "copies", "embedding"), ["rep", "h", "label"]), ["label", "dim", "cell"])

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        side = table.column("side").to_numpy()
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        raw = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        mine, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = key[3].as_py() == key[4].as_py()
        if same:
            other = mine
        v = raw / np.sqrt((raw * raw).sum(1))[:, None]
        cos = v[other] @ v[mine].T
        near = cos >= threshold - 1e-12
        if same:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        close = np.flatnonzero(np.abs(cos[a, b] - threshold) < 1e-9)
        if len(close):  # rounding of the product may decide: the plain formula does instead
            keep = np.ones(len(a), dtype=bool)
            for k in close:
                x, y = raw[other[a[k]]].tolist(), raw[mine[b[k]]].tolist()
                dot = math.fsum(p * q for p, q in zip(x, y, strict=True))
                keep[k] = dot / (math.sqrt(math.fsum(p * p for p in x)) * math.sqrt(math.fsum(q * q for q in y))) >= threshold
            a, b = a[keep], b[keep]
        a, b = other[a], mine[b]
        links = np.bincount(a, copies[b], minlength=len(rep)) + np.bincount(b, copies[a], minlength=len(rep))
        some = np.flatnonzero(links)
        u, w = forest(rep[a], rep[b])
        return pa.table({"rep": pa.array(np.concatenate([rep[some], u])), "links": pa.array(np.concatenate([links[some], np.zeros(len(u))]).astype(np.int64)), "other": pa.array([None] * len(some) + w.tolist(), pa.int64())})

    found = stored(tasks.groupBy("label", "dim", "cell", "x", "i").applyInArrow(verify, "rep long, links long, other long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    verdicts = reps.select(*key, "rep", "copies").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(verdicts, key).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.union(base.where(~sound).select("vec_id", F.lit(0).cast("long"), F.col("vec_id"), F.lit(True)))
