"""Best-fit packing of tokenised documents into sequences of a fixed length.

The plan is made over counts, not documents: a histogram of piece lengths (at most `size` of them) goes to the driver;
best fit by descending length runs on ranges of equal sequences, so its work doesn't grow with the documents. A piece
then takes the planned slot of its rank among the pieces of its length. Ranks come from counts by (length, salt) and a row
number inside each (length, salt): a length has a salt for every GROUP of its pieces, so no group grows with the corpus.
A piece of full size fills a sequence by itself and needs neither rank nor shuffle.

Null text is read as empty, one end token. Repeated rows are packed each. Only documents longer than `size` are cut. Ties
within a length are taken by id, piece, start and checksum. Texts are tokenised whole, however long; an empty table gives
no rows. Other columns pass unread.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import map_columns, table

SIZE, END_ID = 4096, 1
#: Pieces of one length that a task ranks, about.
GROUP = 500_000


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit, longest first. Rows (length, rank from, rank to, first sequence, pieces in a sequence, offset); sequences."""
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges (first sequence, how many)
    free: list[int] = []
    rows, sequences = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                bisect.insort(free, left)
                room[left] = []
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                left = size
                first, n = sequences, -(-todo // (size // length))
                sequences += n
            else:
                left = free[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left]
                    free.pop(at)
            each = left // length
            used = min(n, -(-todo // each))
            put(left, first + used, n - used)
            took = min(todo, used * each)
            full, rest = divmod(took, each)
            rows.append((length, rank, rank + took, first, each, size - left))
            put(left - each * length, first, full)
            if rest:
                put(left - rest * length, first + full, 1)
            rank, todo = rank + took, todo - took
    return rows, sequences


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of at most `size` ids, the end id included."""
    last, step = np.array([end], "<u4").tobytes(), 4 * size

    def finish(_, i: int, code: bytes) -> list[tuple]:
        code += last
        return [(i, k // step, k // 4, len(part := code[k : k + step]) // 4, zlib.crc32(part)) for k in range(0, len(code), step)]

    return bpe.encode_with(docs, path, finish, "doc_id long, piece int, start long, length long, ids_crc32 long")


COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")


def pack_pieces(cut: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to size; cut must give the same rows when read again.

    Full pieces are numbered below zero, from the partition and row that they are read at."""
    spark = cut.sparkSession
    whole = cut.where(F.col("length") == size).select(*COLUMNS, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    total = {r.length: r["count"] for r in cut.where(F.col("length") < size).groupBy("length").count().collect()}  # at most `size` rows
    if not total:
        return whole
    salts = {n: -(-c // group) for n, c in total.items()}
    of = F.broadcast(spark.createDataFrame(list(salts.items()), "length long, _salts long"))  # at most `size` rows
    salted = cut.where(F.col("length") < size).join(of, "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), "_salts").cast("int"))
    # Counts by length and salt: a row for every GROUP of pieces. First place of each (length, salt) in one array.
    first = dict(zip(salts, np.cumsum([0, *salts.values()])[:-1].tolist(), strict=True))
    count = np.zeros(sum(salts.values()), np.int64)
    for r in salted.groupBy("length", "_salt").count().collect():
        count[first[r.length] + r["_salt"]] = r["count"]
    before = np.concatenate([np.cumsum(c) - c for c in np.split(count, list(first.values())[1:])])
    start_of = np.zeros(size + 1, np.int64)
    start_of[list(first)] = list(first.values())
    rows, _ = plan(total, size)
    slots = np.array(rows, np.int64).reshape(len(rows), 6)
    # Each (length, rank from) as one number, ascending, so that one binary search finds a piece's row.
    shift = max(total.values()) + 1
    slots = slots[np.argsort(slots[:, 0] * shift + slots[:, 1])]
    keys = slots[:, 0] * shift + slots[:, 1]

    def make():
        def f(doc_id, piece, start, length, crc, salt, number):
            n = np.array(length, np.int64)
            rank = before[start_of[n] + np.array(salt)] + np.array(number, np.int64) - 1
            row = slots[np.searchsorted(keys, n * shift + rank, "right") - 1]
            k = rank - row[:, 1]
            return [doc_id, piece, start, length, crc, row[:, 3] + k // row[:, 4], row[:, 5] + k % row[:, 4] * n]

        return f

    ranked = salted.withColumn("_number", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")))
    return whole.unionAll(map_columns(ranked.select(*COLUMNS, "_salt", "_number"), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", make))


def best_fit(docs: DataFrame, path: str, size: int = SIZE, end: int = END_ID) -> DataFrame:
    return pack_pieces(table(pieces(docs, path, size, end), "pieces"), size)
