"""Exact top-k by inner product: an impact-ordered index, processed score at a time.

Vectors are rows of integers floor(scale * x). They are dealt into blocks of BLOCK; each block is indexed by dimension:
for each dimension two posting lists, by falling and by rising component, cut into segments of equal quantised impact, of
which there are LEVELS at most; an impact counts from the other end of the list and is rounded up. A query adds segments in
falling order of weight times impact. The sum over dimensions of weight times the impact of the next segment bounds what
any vector can still gain. Every few segments the k best so far are scored exactly; only a vector whose bound stays below
the k-th best exact score is out, and once few enough may still be in, those are scored exactly. So results are exact.

Queries are the stated set of rows against all rows, block by block. Each query first meets one block: queries are dealt over as
many blocks as give each about FIRST of them, so no task holds them all. Its k-th best exact score there is a bound that each
other block begins with, so that it stops sooner and reports only what may still be among the k best. Then queries, packed
into batches of about BATCH in a row, come to all other blocks, after the block's vectors, so that a task holds one index and one
batch. A vector is shuffled into its block once, and once more where that is among the first. The best k of all reports are
the answer.

Vectors that are null, hold a null or a non-finite component, or have no id take no part, neither as query nor as
candidate. Queries meet the vectors of their own length; vectors without components score 0 among each other. Ties go to
the smaller id; repeated ids are candidates each, and a query never meets rows of its own id; rows that repeat a query's
id and vector are one query. An empty table gives no rows. Other columns, of any name, pass unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import schema_of, table, tune

SCALE, K = 1024, 10
#: Vectors in a block, levels of quantised impact.
BLOCK, LEVELS = 8192, 48
#: Queries that meet a block first, about, and queries of a batch that goes to all blocks.
FIRST, BATCH = 2048, 256
#: Segments come in so many batches of falling impact; the bounds are looked at after each.
CHECKS = 8
#: Scored exactly once at most this share of a block may still be in.
FEW = 0.06


class ImpactIndex:
    """Index of one block of integer vectors [n, d]."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.v = vectors.astype(np.float64)  # sums of products stay far below 2**53, so they are exact
        n, d = vectors.shape
        self.lo, self.hi = vectors.min(0), vectors.max(0)
        width = np.maximum(1, -(-(self.hi - self.lo + 1) // levels))
        # side 0 is for weights above 0: gain counts from the least component; side 1 for those below: from the largest.
        self.ids, self.gain, self.ends, self.impact = [], [], [], []
        for low in (vectors - self.lo, self.hi - vectors):
            order = np.argsort(-(low // width), axis=0, kind="stable").T.astype(np.int32).copy()
            gain = np.minimum((np.take_along_axis((low // width).T, order, 1) + 1) * width[:, None] - 1, (self.hi - self.lo)[:, None])
            ends = [np.r_[np.flatnonzero(g[1:] != g[:-1]) + 1, n] for g in gain]
            self.ids.append(order)
            self.gain.append(gain)
            self.ends.append(ends)  # of the segments of each dimension
            self.impact.append([g[e - 1] for g, e in zip(gain, ends, strict=True)])

    def top(self, q: np.ndarray, k: int, least_wanted: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of all vectors that may be among the k best and score least_wanted or more."""
        n = len(self.v)
        if n <= 4 * k or not len(q):
            return np.arange(n), (self.v @ q).astype(np.int64)
        fixed = int((np.where(q > 0, self.lo, self.hi) * q).sum())
        dims = [(abs(int(w)), int(w < 0), j) for j, w in enumerate(q) if w]
        impacts = np.sort(np.concatenate([self.impact[side][j] * w for w, side, j in dims]))[::-1] if dims else np.zeros(1)
        got, done, may = np.zeros(n, np.int64), [0] * len(dims), np.arange(n)
        for least in impacts[np.linspace(0, len(impacts) - 1, CHECKS + 1).astype(int)[1:]]:
            rest = fixed
            for i, (w, side, j) in enumerate(dims):  # all segments whose impact is `least` or more
                impact, ends = self.impact[side][j], self.ends[side][j]
                m = int(np.searchsorted(-impact * w, -least, "right"))
                if m and (to := int(ends[m - 1])) > done[i]:
                    got[self.ids[side][j, done[i] : to]] += self.gain[side][j, done[i] : to] * w
                    done[i] = to
                if m < len(impact):
                    rest += int(impact[m]) * w
            # A vector gains its quantised impact at most where its segment has come, the next segment's elsewhere.
            upper = got + rest
            best = np.argpartition(upper, n - k)[n - k :]
            may = np.flatnonzero(upper >= max(least_wanted, (self.v[best] @ q).min()))
            if len(may) <= max(8 * k, FEW * n):
                break
        return may, (self.v[may] @ q).astype(np.int64)


def _clean(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and integer components of the rows that take part."""
    e = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x.cast("double")) | x.cast("double").isin(float("inf"), float("-inf"))) 
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


class Block:
    """One block of vectors, indexed when the first query comes."""

    def __init__(self):
        self.ids, self.vectors, self.index = [], [], None

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids.append(ids)
        self.vectors.append(vectors)

    def best(self, q_ids: np.ndarray, queries: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score): for each query the k best of the block, of other ids than its own and not under its bar,
        ties to the smaller id."""
        if self.index is None:
            ids = np.concatenate(self.ids)
            order = np.argsort(ids, kind="stable")
            self.ids, self.index = ids[order], ImpactIndex(np.ascontiguousarray(np.concatenate(self.vectors)[order]))
        ids, out = self.ids, []
        for one, q, bar in zip(q_ids, queries, bars, strict=True):
            own = int(np.searchsorted(ids, one, "right") - np.searchsorted(ids, one, "left"))
            at, score = self.index.top(q, k + own, bar)
            keep = (ids[at] != one) & (score >= bar)
            at, score = at[keep], score[keep]
            best = np.lexsort((ids[at], -score))[:k]
            out.append((np.full(len(best), one), ids[at[best]], score[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


FOUND = "query_id long, vec_id long, score long"


def _search(vectors: DataFrame, batches_: DataFrame, k: int) -> DataFrame:
    """vectors (d, cb, vec_id, v) and batches of queries (d, cb, qs: first block, vec_id, v and bar of each) for each
    block (d, cb): the k best of each block for each query of which it isn't the first."""
    schema = to_arrow_schema(schema_of(FOUND))
    one = F.array(F.struct(F.lit(-1).alias("own"), "vec_id", "v", F.lit(None).cast("long").alias("bar")))
    both = vectors.select("d", "cb", F.lit(0).alias("side"), one.alias("qs")).unionAll(batches_.select("d", "cb", F.lit(1).alias("side"), "qs"))
    packed = both.select("d", "cb", "side", "qs.own", "qs.vec_id", "qs.bar", F.flatten("qs.v").alias("v"))
    tune(vectors.sparkSession)

    def run(batches):
        now, block = None, Block()
        for batch in batches:
            for i in range(batch.num_rows):
                d, cb, side = (batch.column(c)[i].as_py() for c in range(3))
                own, ids = (batch.column(c)[i].values.to_numpy() for c in (3, 4))
                bar, v = batch.column(5)[i].values.to_numpy(zero_copy_only=False).astype(float), batch.column(6)[i].values.to_numpy().reshape(len(ids), d)
                if (d, cb) != now:
                    now, block = (d, cb), Block()
                if side == 0:
                    block.add(ids, v)
                elif len(block.ids) and (there := own != cb).any():
                    got = block.best(ids[there], v[there], np.where(np.isnan(bar), -np.inf, bar)[there], k)
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in got], schema=schema)

    return packed.repartition("d", "cb").sortWithinPartitions("d", "cb", "side").mapInArrow(run, schema_of(FOUND))


def _batches(asked: DataFrame, size: int, *by: str) -> DataFrame:
    """asked(d, vec_id, v, own, bar, ...) in rows of about `size` queries of one length, and of equal `by`: qs."""
    n = asked.groupBy("d", *by).agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
    dealt = asked.join(n if by else F.broadcast(n), ["d", *by]).withColumn("_batch", F.pmod(F.xxhash64("vec_id", "v"), F.col("_n")))
    return dealt.groupBy("d", *by, "_batch").agg(F.collect_list(F.struct("own", "vec_id", "v", "bar")).alias("qs"))


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, block: int = BLOCK, first: int = FIRST, batch: int = BATCH) -> DataFrame:
    """query_id, rank, vec_id, score; is_query is a condition on vec_id that states the queries."""
    rows = _clean(vectors, scale).withColumn("d", F.size("v"))
    blocks = F.broadcast(rows.groupBy("d").agg(F.ceil(F.count("*") / block).cast("int").alias("n")))  # a row for each length that vectors have
    dealt = rows.join(blocks, "d").withColumn("cb", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int"))
    asked = rows.where(is_query).dropDuplicates(["vec_id", "v"])
    # The first blocks of each length: 0 to begin - 1.
    begin = F.broadcast(asked.groupBy("d").agg(F.ceil(F.count("*") / first).cast("int").alias("begin")).join(blocks, "d").select("d", "n", F.least("begin", "n").alias("begin")))
    asked = table(asked.join(begin, "d").withColumn("first", F.pmod(F.xxhash64("v", "vec_id"), F.col("begin")).cast("int")), "queries")
    none = asked.withColumn("own", F.lit(-1)).withColumn("bar", F.lit(None).cast("long"))
    met = _batches(none.withColumn("cb", F.col("first")), batch, "cb")
    found = table(_search(dealt.join(F.broadcast(begin.select("d", "begin")), "d").where(F.col("cb") < F.col("begin")), met, k), "first-blocks")
    # The k-th best of the first block, where a query's id stands for one vector; else it begins without a bar.
    bars = found.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("bar")).where(F.col("found") == k).select(F.col("query_id").alias("vec_id"), "bar")
    others = asked.where("n > 1").withColumn("own", F.col("first")).join(bars, "vec_id", "left")
    sent = _batches(others, batch).join(F.broadcast(blocks.where("n > 1")), "d").withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    found = found.unionAll(_search(dealt.where("n > 1"), sent, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
