"""Exact ranked lexical search: MaxScore over the postings of each shard.

A term is a run of ASCII letters, digits and characters from U+0080 on, A-Z lower-cased. Each task deals the documents that
it reads into shards of at most SHARD_DOCS documents and about SHARD_BYTES of text; a shard is one row of the index, with the
postings (document, occurrences) of each term and the documents' lengths, so the index is built without a shuffle. Document
frequencies, the number of documents and of terms are sums over all shards. Where all items together have at most MAX_TERMS
different terms, only these are indexed; else every term is, with the same results.

A shard bounds a term's part of any score by the largest one in its list. An item's lists come by falling bound. While a
document found in none of the lists so far could still be among the k best, the next list is essential, and all its postings
are added. As soon as the bounds of all lists to come add up to less than the k-th best score, they are non-essential: these
are probed for documents only that still can qualify, fewer after each list. The k-th best score so far is carried from
shard to shard of a task. Each task reports k documents of an item at most; those are ranked by item, in groups of tasks
first where there are many tasks.

Items come in rounds of about ROUND_ROWS (item, term) rows, which is what a task holds of them; a round reads the index once.

Null, empty and term-less texts match nothing and aren't counted. Texts are read whole, however long. Repeated rows are
documents of their own, rows with a null id too, which come last among equal scores. Rows that repeat an item's id and text
are one item; texts that share an id are ranked each. Items without a known term, and empty tables, give no rows. Other
columns, of any name, pass unread.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_columns, schema_of, table, texts, tune

K = 20
#: Documents and bytes of text in a shard.
SHARD_DOCS, SHARD_BYTES = 8192, 32 << 20
#: Different terms of all items up to which the index is restricted to them; (item, term) rows of a round.
MAX_TERMS, ROUND_ROWS = 1_000_000, 500_000
#: Tasks whose reports are ranked together before all of an item are.
TASKS = 512

_TERM_BYTES = bytes(c | 0x20 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms(data: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order, with repeats."""
    return data.translate(_TERM_BYTES).split()


INDEX = "n_docs long, n_terms long, terms array<string>, dfs array<int>, positions array<int>, tfs array<int>, ids array<long>, lengths array<long>"


class ShardWriter:
    """Collects the postings of one shard."""

    def __init__(self):
        self.postings: dict[bytes, tuple[list[int], list[int]]] = {}
        self.ids, self.lengths, self.bytes = [], [], 0

    def add(self, doc_id: int | None, data: bytes, wanted: frozenset[bytes] | None) -> None:
        words = terms(data)
        self.bytes += len(data)
        if not words:
            return
        at = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        for term, tf in Counter(words if wanted is None else filter(wanted.__contains__, words)).items():
            found = self.postings.get(term)
            if found is None:
                found = self.postings[term] = ([], [])
            found[0].append(at)
            found[1].append(tf)

    def row(self) -> list:
        known = sorted(self.postings)
        flat = lambda i: [x for t in known for x in self.postings[t][i]]
        return [len(self.ids), sum(self.lengths), [t.decode() for t in known], [len(self.postings[t][0]) for t in known], flat(0), flat(1), self.ids, self.lengths]


def index(docs: DataFrame, wanted: frozenset[bytes] | None = None, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each shard; wanted: the only terms to keep postings of."""
    schema = to_arrow_schema(schema_of(INDEX))
    tune(docs.sparkSession)

    def row(shard: ShardWriter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(shard.row(), schema.types, strict=True)], schema=schema)

    def run(batches):
        shard = ShardWriter()
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                shard.add(doc_id, data, wanted)
                if len(shard.ids) >= shard_docs or shard.bytes >= shard_bytes:
                    yield row(shard)
                    shard = ShardWriter()
        if shard.ids:
            yield row(shard)

    return texts(docs).mapInArrow(run, schema_of(INDEX))


class Shard:
    """One shard as it is searched."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.lengths = row["lengths"]
        norm = 75 + 25 * self.lengths * n_docs // n_terms
        self.ends = np.cumsum(row["dfs"])
        self.at = {t: i for i, t in enumerate(row["terms"])}
        self.positions = row["positions"]
        tf = row["tfs"].astype(np.int64)
        self.parts = 1_000_000_000 * tf // (1000 * tf + 12 * norm[self.positions])
        self.most = np.maximum.reduceat(self.parts, np.r_[0, self.ends[:-1]]) if len(self.ends) else self.ends

    def top(self, query: list[tuple[str, int]], bar: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of all documents that may be among the k best and score bar or more; query: terms with their
        weights, repeats included."""
        lists = sorted(((int(self.most[i]) * w, i, w) for t, w in query if w > 0 and (i := self.at.get(t)) is not None), reverse=True)
        rest = np.cumsum([0, *(bound for bound, _, _ in reversed(lists))])[::-1].tolist()  # bounds of this list and all to come
        score, may, n = np.zeros(len(self.lengths), np.int64), None, len(self.lengths)
        for j, (_, i, w) in enumerate(lists):
            of = slice(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))
            found, part = self.positions[of], self.parts[of]
            if may is None and rest[j] >= bar:  # essential: documents in none of the lists so far may still qualify
                score[found] += w * part
                if n >= k and rest[j + 1] < score.max():
                    bar = max(bar, int(np.partition(score, n - k)[n - k]))
                continue
            if may is None:
                may = np.flatnonzero(score)
            may = may[score[may] + rest[j] >= bar]
            if not len(may):
                break
            spot = np.minimum(np.searchsorted(found, may), len(found) - 1)
            hit = found[spot] == may
            score[may[hit]] += w * part[spot[hit]]
            if len(may) >= k:
                bar = max(bar, int(np.partition(score[may], len(may) - k)[len(may) - k]))
        may = np.flatnonzero(score) if may is None else may
        may = may[score[may] >= bar]
        return may, score[may]


FOUND = "item long, doc_id long, score long"


def _search(shards: DataFrame, asked: list[tuple[int, list[tuple[str, int]]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score) of the k best documents of each task for each asked (item, query)."""
    schema = to_arrow_schema(schema_of(FOUND))

    def run(batches):
        best = {}
        for batch in batches:
            for i in range(batch.num_rows):
                get = {name: batch.column(j)[i].values for j, name in enumerate(batch.schema.names)}
                ids, nulls = get["ids"].fill_null(0).to_numpy(), get["ids"].is_null().to_numpy(zero_copy_only=False)
                shard = Shard({"terms": get["terms"].to_pylist()} | {c: get[c].to_numpy() for c in ("dfs", "positions", "tfs", "lengths")}, n_docs, n_terms)
                for item, query in asked:
                    had = best.get(item)
                    at, score = shard.top(query, max(1, int(had[0][-1])) if had and len(had[0]) == k else 1, k)
                    if len(at):
                        new = (score, nulls[at], ids[at])
                        new = new if had is None else tuple(map(np.concatenate, zip(had, new, strict=True)))
                        order = np.lexsort((new[2], new[1], -new[0]))[:k]
                        best[item] = tuple(x[order] for x in new)
        for item, (score, null, ids) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids, mask=null), pa.array(score)], schema=schema)

    return shards.select("terms", "dfs", "positions", "tfs", "ids", "lengths").mapInArrow(run, schema_of(FOUND))


def _ranked(found: DataFrame, k: int, *more: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item", *more).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = K, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES, max_terms: int = MAX_TERMS, round_rows: int = ROUND_ROWS, tasks: int = TASKS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of docs(doc_id, text) for each of items(item_id, text)."""

    def counted():
        def f(item, text):
            rows = [(i, t.decode(), n) for i, x in zip(item, text, strict=True) for t, n in Counter(terms(x.encode())).items()]
            return [list(c) for c in zip(*rows, strict=True)] if rows else None

        return f

    each = table(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    asked = table(map_columns(each.select("item", "text"), "item long, term string, times long", counted), "item-terms")
    known = asked.select("term").distinct()
    wanted = frozenset(r.term.encode() for r in known.collect()) if known.count() <= max_terms else None
    shards = table(index(docs, wanted, shard_docs, shard_bytes), "shards")
    total = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("t")).first()
    dfs = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    dfs = (dfs.join(known, "term", "left_semi") if wanted is None else dfs).groupBy("term").agg(F.sum("df").alias("df"))
    weighed = table(asked.join(dfs, "term"), "weights")
    rounds, parts = -(-weighed.count() // round_rows), []
    for i in range(max(1, rounds)):
        queries: dict[int, list[tuple[str, int]]] = {}
        for r in weighed.where(F.pmod(F.xxhash64("item"), F.lit(max(1, rounds))) == i).collect():  # about round_rows rows
            queries.setdefault(r.item, []).append((r.term, r.times * math.floor(1000 * math.log((2 * total.n + 2) / (2 * r.df + 1)))))
        parts.append(_search(shards, list(queries.items()), total.n, total.t, k))
    found = reduce(DataFrame.unionAll, parts)
    if shards.rdd.getNumPartitions() > tasks:
        found = _ranked(found.withColumn("group", F.floor(F.spark_partition_id() / tasks)), k, "group").drop("rank", "group")
    return _ranked(found, k).join(each.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
