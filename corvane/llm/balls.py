"""Ball k-means: exact Lloyd rounds over integer vectors that skip the distances which balls rule out.

Vectors are packed into blocks of at most BLOCK; a block is a row with its vectors, the cluster and squared distance of each,
and its own sums, counts and radii by cluster. So a round is one pass without a shuffle, and what the driver gets of it is a
sum over blocks: k rows. Blocks are written to the shared folder after each pass, those of the pass before are removed.

A cluster is a ball: its centroid and a radius that covers all members. After centroids have moved the radius is at most the
old one plus the move, in integers rounded up. Clusters whose centroid lies within twice the radius are its neighbours; no
member can be nearer to another one. Members nearer to their centroid than half the way to the nearest neighbour are the
stable core: they stay without any comparison. The others lie in annuli bounded by half the ways to the neighbours, in rising
order; a member of the i-th is compared exactly with the first i neighbours alone. The first pass takes all vectors for one
ball around centroid 0. All is integer arithmetic on squared distances, with equality always compared, so that clusters,
distances and centroids are those of the plain method, ties to the smaller number.

Only vectors of exactly `dim` components, none null or non-finite, are kept. Scaled components are held within
-2**27 to 2**27, so that squared distances fit a long. Repeated rows are vectors each; of equal ids the smaller vector begins;
rows with a null id are members and come last as first centroids. Fewer vectors than k give as many clusters; an empty table
gives no rows. Other columns, of any name, pass unread.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import drop, schema_of, table, tune

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Vectors in a block; size that a scaled component is held to.
BLOCK, LARGEST = 4096, 1 << 27

BLOCKS = "ids array<long>, vectors array<int>, clusters array<int>, distances array<long>, counts array<long>, sums array<long>, radii array<long>, inertia array<long>, compared long"


def kept(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as integers."""
    e = F.col("embedding")
    ok = e.isNotNull() & (F.size(e) == dim) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x.cast("double")) | x.cast("double").isin(float("inf"), float("-inf")))
    whole = F.transform(e, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * scale))).cast("int"))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(rows: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors whose ids have the smallest hash, in its order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return np.array([r.v for r in rows.select("v", key.alias("key")).orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()], np.int64)


@dataclass
class Balls:
    """Centroids [k, d], radii (rounded up; None: unknown), and each centroid's neighbours in rising distance."""

    centroids: np.ndarray
    radii: list[int | None]

    def __post_init__(self):
        gaps = ((self.centroids[:, None] - self.centroids[None]) ** 2).sum(2)
        self.neighbours, self.gaps = [], []
        for c, radius in enumerate(self.radii):
            order = np.argsort(gaps[c], kind="stable")
            near = [int(j) for j in order if j != c and (radius is None or int(gaps[c, j]) <= 4 * radius * radius)]
            self.neighbours.append(near)
            self.gaps.append(gaps[c, near])

    def assign(self, vectors: np.ndarray, clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """New clusters and squared distances of vectors that were in the given clusters, and how many were computed."""
        distance = ((vectors - self.centroids[clusters]) ** 2).sum(1)
        best, where, compared = distance.copy(), clusters.copy(), len(vectors)
        for c in np.unique(clusters):
            members = np.flatnonzero(clusters == c)
            for j, gap in zip(self.neighbours[c], self.gaps[c], strict=True):
                members = members[4 * distance[members] >= gap]  # the core, and annuli that this neighbour doesn't reach
                if not len(members):
                    break
                d = ((vectors[members] - self.centroids[j]) ** 2).sum(1)
                compared += len(members)
                to = (d < best[members]) | ((d == best[members]) & (j < where[members]))
                best[members[to]], where[members[to]] = d[to], j
        return where, best, compared


def _blocks(rows: DataFrame, balls: Balls, block: int) -> DataFrame:
    """Blocks of rows(vec_id, v), all of them taken for members of cluster 0, assigned."""
    schema = to_arrow_schema(schema_of(BLOCKS))
    dim = balls.centroids.shape[1]
    tune(rows.sparkSession)

    def run(batches):
        ids, flat, n = [], [], 0
        for batch in batches:
            ids.append(batch.column(0))
            flat.append(batch.column(1).flatten().to_numpy())
            n += batch.num_rows
            if n >= block:
                yield _packed(schema, pa.concat_arrays(ids), np.concatenate(flat).reshape(-1, dim), np.zeros(n, np.int64), balls)
                ids, flat, n = [], [], 0
        if n:
            yield _packed(schema, pa.concat_arrays(ids), np.concatenate(flat).reshape(-1, dim), np.zeros(n, np.int64), balls)

    return rows.mapInArrow(run, schema_of(BLOCKS))


def _packed(schema: pa.Schema, ids: pa.Array, vectors: np.ndarray, clusters: np.ndarray, balls: Balls) -> pa.RecordBatch:
    k, dim = balls.centroids.shape
    whole = vectors.astype(np.int64)
    clusters, distances, compared = balls.assign(whole, clusters)
    counts, sums, radii, inertia = np.bincount(clusters, minlength=k), np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
    np.add.at(sums, clusters, whole)
    np.maximum.at(radii, clusters, distances)
    np.add.at(inertia, clusters, distances)
    one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, type=t.value_type)).cast(t)
    columns = (ids, vectors.ravel(), clusters, distances, counts, sums.ravel(), radii, inertia)
    return pa.RecordBatch.from_arrays([*(one(x, t) for x, t in zip(columns, schema.types[:-1], strict=True)), pa.array([compared])], schema=schema)


def _again(blocks: DataFrame, balls: Balls) -> DataFrame:
    """Blocks assigned anew from the clusters that they hold."""
    schema = to_arrow_schema(schema_of(BLOCKS))
    dim = balls.centroids.shape[1]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vectors, clusters = (batch.column(c)[i].values for c in range(3))
                yield _packed(schema, ids, vectors.to_numpy().reshape(-1, dim), clusters.to_numpy().astype(np.int64), balls)

    return blocks.select("ids", "vectors", "clusters").mapInArrow(run, schema_of(BLOCKS))


def _totals(blocks: DataFrame, column: str, how) -> np.ndarray:
    """Sums or maxima over all blocks of each place of an array column; only that column is read."""
    got = blocks.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(how("x").alias("x")).collect()  # k or k x d rows
    return np.array([r.x for r in sorted(got, key=lambda r: r["at"])], object)


def _root(x: int) -> int:
    """Square root, rounded up."""
    return isqrt(x) + (isqrt(x) ** 2 < x)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """Blocks with the assignment to the centroids after `rounds` rounds, and those centroids; null blocks if no vector is kept."""
    rows = kept(vectors, dim, scale)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return None, centroids
    now = table(_blocks(rows, Balls(centroids, [None] * len(centroids)), block), "balls")
    for _ in range(rounds):
        counts, sums, radii = _totals(now, "counts", F.sum), _totals(now, "sums", F.sum).reshape(centroids.shape), _totals(now, "radii", F.max)
        moved = np.array([[int(s) // int(n) for s in row] if n else old.tolist() for row, n, old in zip(sums, counts, centroids, strict=True)], np.int64)
        shift = ((moved - centroids) ** 2).sum(1)
        centroids, before = moved, now
        now = table(_again(before, Balls(centroids, [_root(int(r)) + _root(int(s)) for r, s in zip(radii, shift, strict=True)])), "balls")
        drop(before)
    return now, centroids


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def ball_k_means(vectors: DataFrame, **settings) -> DataFrame:
    """A row for each kept vector: its cluster, squared distance, the sums of them, and its centroid's digest."""
    blocks, centroids = cluster(vectors, **settings)
    if blocks is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    inertia = np.array(_totals(blocks, "inertia", F.sum), np.int64)
    digests = np.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids], object)
    total, schema = int(inertia.sum()), to_arrow_schema(schema_of(RESULT))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, clusters, distances = (batch.column(c)[i].values for c in range(3))
                at = clusters.to_numpy()
                yield pa.RecordBatch.from_arrays([ids, clusters, distances, pa.array(inertia[at]), pa.array(np.full(len(at), total)), pa.array(digests[at], pa.string())], schema=schema)

    return blocks.select("ids", "clusters", "distances").mapInArrow(run, schema_of(RESULT))
