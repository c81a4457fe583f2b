"""Leakage-safe train, dev and test splits, stratified by registry size and source.

The unit is a query: all its rows go where its first row's stratum sends it. Sealed queries are test whatever the quota.
Inside a stratum the order is a hash of seed and query, so it depends neither on partitions nor on the engine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grams as G
from ..functions.labels import hash_order
from ..sources import store

#: Different n-grams of all items up to which queries give only those (8 bytes each).
MOST_KEYS = 1_000_000

#: Hex digits of the hash by which the queries of a stratum are dealt into buckets: 65,536 of them.
BUCKET_DIGITS = 4


def first_stratum(rows: DataFrame) -> DataFrame:
    """(query, stratum) of each query's first row by ord."""
    return rows.groupBy("query").agg(F.min_by("stratum", "ord").alias("stratum"))


def assign(rows: DataFrame, sealed: DataFrame | None = None, test: float = 0.1, dev: float = 0.1, seed: int = 42) -> DataFrame:
    """(query, stratum, split) over rows(query, stratum, ord). Of the n open queries of a stratum, the first
    max(1, n * test) by hash are test, the next max(1, n * dev) dev, the rest train; fewer than 3 are all train."""
    firsts = first_stratum(rows)
    if sealed is not None:
        names = sealed.select("query").distinct().withColumn("_sealed", F.lit(True))
        firsts = firsts.join(names, "query", "left").withColumn("_sealed", F.coalesce("_sealed", F.lit(False)))
    else:
        firsts = firsts.withColumn("_sealed", F.lit(False))
    # Queries are dealt into BUCKETS by the first digits of their hash, so that no task sorts a whole stratum: a rank is what
    # the buckets before hold, which tasks count first, and the place in its own.
    order = hash_order(seed, F.col("query"))
    keyed = firsts.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    group = ["stratum", "_sealed"]
    counts = keyed.groupBy(*group, "_bucket").agg(F.count("*").alias("_k"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).withColumn("_n", F.sum("_k").over(Window.partitionBy(*group))).drop("_k")
    place = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy("_order", "query"))
    share = lambda r: F.greatest(F.lit(1), (F.col("_n") * F.lit(r)).cast("long"))
    ranked = keyed.withColumn("_place", place).join(counts, [*group, "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_place"))
    split = (
        F.when(F.col("_sealed"), "test").when(F.col("_n") < 3, "train")
        .when(F.col("_rank") <= share(test), "test").when(F.col("_rank") <= share(test) + share(dev), "dev").otherwise("train")
    )
    return ranked.select("query", "stratum", split.alias("split"))


def label(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every row with the split of its query; train if the manifest doesn't have it."""
    return rows.join(manifest.select("query", "split"), "query", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def sizes(labelled: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return labelled.groupBy("split").agg(F.count("*").alias("n")).withColumn("percent", F.round(100 * F.col("n") / total, 2))


def by_stratum(labelled: DataFrame) -> DataFrame:
    """Rows of each stratum by split, 0 where there are none."""
    return labelled.groupBy("stratum").pivot("split", ["train", "dev", "test"]).count().na.fill(0)


def leaks(manifest: DataFrame) -> DataFrame:
    """Queries in more than one split: none, if the manifest is sound."""
    return manifest.groupBy("query").agg(F.count_distinct("split").alias("n")).where("n > 1")


def without_overlap(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """Training rows whose query isn't held out."""
    return train.join(held_out.select("query").distinct(), "query", "left_anti")


def holding(rows: DataFrame, held_out: DataFrame, most_keys: int = MOST_KEYS) -> DataFrame:
    """Rows whose query holds the whole text of a held-out item(text), or is it; an empty item is in none.

    An inverted index of n-grams: an item of SIZE characters or more is known by one of its n-grams that the fewest queries
    have (of a long item the least n-grams of its windows are enough to choose from, so queries give about one in eight);
    a shorter one is its own n-gram. Queries give their n-grams once, equal keys join, and what has a key in common is
    compared. Where all items have at most most_keys keys, queries give only these, else all."""
    items = held_out.where("text <> ''").select(F.col("text").alias("_item")).distinct()
    items = items.withColumn("_size", F.char_length("_item"))
    lengths = [r._size for r in items.select(F.least("_size", F.lit(G.LONG)).alias("_size")).distinct().collect()]  # at most LONG
    short, every, windows = tuple(n for n in lengths if n < G.SIZE), any(G.SIZE <= n < G.LONG for n in lengths), G.LONG in lengths

    def own(text: str) -> np.ndarray:
        return (G.Keys((len(text),)) if len(text) < G.SIZE else G.Keys(every=len(text) < G.LONG, windows=True))(text)

    known = items.withColumn("_key", F.explode(G.keyed(F.col("_item"), own)))
    different = known.select("_key").distinct()
    wanted = np.sort(np.array([r._key for r in different.collect()], np.int64)) if different.count() <= most_keys else None

    # Keys travel with a digest of the query, not with its text; the text meets the items that it may hold.
    named = rows.withColumn("_digest", F.md5(F.col("query").cast("binary")))
    met = named.select(F.col("_digest").alias("_of"), F.explode(G.keyed(F.col("query"), G.Keys(short, every, windows, wanted))).alias("_key"))
    met = met if wanted is None else store.table(met, "query-keys")
    common = met.groupBy("_key").agg(F.count("*").alias("_n"))
    rarest = F.min_by("_key", F.struct(F.coalesce("_n", F.lit(0)), "_key")).alias("_key")
    chosen = store.table(known.join(common, "_key", "left").groupBy("_item").agg(rarest), "item-keys")
    near = met.join(chosen, "_key").select("_of", "_item").distinct()
    return named.join(near, (F.col("_digest") == F.col("_of")) & F.contains("query", "_item"), "left_semi").drop("_digest")
