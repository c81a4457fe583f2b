"""Hidden Markov language model over word classes, trained by Baum-Welch across partitions, scored by scaled forward.

A token is a word (runs of bytes other than 0x20 and 0x09-0x0D, A-Z in lower case) or the end that closes each text. The
model says  P(text) = P_hmm(classes) * product of P(token | class):  states emit one of CLASSES classes (a fixed hash of a
short word, or of a longer word's ending; the end has class 0), and within its class a token has (c + 1) / (N_class +
V_class + 1), one share being left for words never seen. So unknown words need no list, and the state tables are bounded.

1. One pass over the texts writes, in blocks of bounded size, each text as numbers into its block's word list, and the
   list with its counts over training texts.
2. Counts of a word are summed over blocks, tasks first, which is the exact count of every word; totals by class go to the
   driver.
3. The counts of all training tokens by class, varied a little, start the states; then ROUNDS of Baum-Welch see every
   training text: each task sums its expected counts, Spark adds them by class.
4. Each block meets the counts of its words again: the exact likelihood by the forward recursion in double precision,
   the word terms and the base score.

Null text is read as empty: it has the end alone. Texts are scored whole, however long. Repeated rows count each; no ties
arise. With no training text all counts are 0 and the states untrained; an empty table gives no rows. Other columns pass unread.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import crc_of_id, map_columns, schema_of, table, texts, tune

STATES, CLASSES, ROUNDS = 8, 2048, 4
#: A block is closed at so many different words or so many tokens; a task gathers so many tokens for one recursion.
BLOCK_WORDS, BLOCK_TOKENS, GATHER = 250_000, 2_000_000, 2_000_000


def class_of(word: bytes) -> int:
    """0 is the end's, which no word has."""
    if not word:
        return 0
    return 1 + zlib.crc32(word if len(word) <= 4 else b" " + word[-3:]) % (CLASSES - 1)


class Words(dict):
    """Numbers words in the order they first occur."""

    def __init__(self):
        super().__init__()
        self.classes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.classes.append(class_of(word))
        return n


def planes(ids: np.ndarray) -> bytes:
    """uint32 numbers as their lowest bytes, then the next ones, and so on: small numbers leave long runs of zeros, which
    the shuffle and the table pack."""
    return ids.view(np.uint8).reshape(-1, 4).T.tobytes()


def whole(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


NUMBERED = "block long, doc_id long, held boolean, ids binary, classes binary, word binary, at int, class int, n long"


def numbered(docs: DataFrame) -> DataFrame:
    """Rows of texts (word is null) and rows of word lists (ids is null), by block."""
    schema = to_arrow_schema(schema_of(NUMBERED))

    def run(batches):
        from pyspark import TaskContext

        block, words, counts, tokens = TaskContext.get().partitionId() << 24, Words(), np.zeros(0, np.int64), 0

        def listed():
            names, kinds = list(words), words.classes
            for a in range(0, len(names), 20_000):
                k = len(names[a : a + 20_000])
                empty = [pa.nulls(k, t) for t in schema.types]
                empty[0], empty[5], empty[6], empty[7], empty[8] = pa.array([block] * k, pa.int64()), pa.array(names[a : a + k], pa.binary()), pa.array(range(a, a + k), pa.int32()), pa.array(kinds[a : a + k], pa.int32()), pa.array(counts[a : a + k], pa.int64())
                yield pa.RecordBatch.from_arrays(empty, schema=schema)

        for batch in batches:
            rows: list[tuple] = []
            for i, text, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = text.encode("utf-8", "surrogatepass").lower().split()
                found.append(b"")
                ids = np.fromiter(map(words.__getitem__, found), np.uint32, len(found))
                if len(counts) < len(words):
                    counts = np.concatenate([counts, np.zeros(max(len(words), 2 * len(counts)) - len(counts), np.int64)])
                if not held:
                    np.add.at(counts, ids, 1)
                rows.append((block, i, held, planes(ids), ids))
                tokens += len(ids)
                if len(words) >= BLOCK_WORDS or tokens >= BLOCK_TOKENS:
                    yield _texts(rows, words, schema)
                    yield from listed()
                    rows, words, counts, tokens = [], Words(), np.zeros(0, np.int64), 0
                    block += 1
            if rows:
                yield _texts(rows, words, schema)
        if words:
            yield from listed()

    tune(docs.sparkSession)
    return texts(docs).withColumn("held", crc_of_id() % 7 == 2).mapInArrow(run, schema_of(NUMBERED))


def packed(listed: DataFrame, rows: int = 250_000) -> DataFrame:
    """Rows (of, at, class, c) as (of, data): what each task has for a block, many rows at a time, as at, class, and the low
    and high halves of c."""
    schema = to_arrow_schema(schema_of("of long, data binary"))

    def run(batches):
        held, n = [], 0

        def out():
            of, at, kind, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(of, kind="stable")
            of, values = of[order], np.stack([at, kind, c & 0xFFFFFFFF, c >> 32]).astype(np.uint32)[:, order]
            edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            parts = [planes(np.ascontiguousarray(v).ravel()) for v in np.split(values, edges[1:], axis=1)]
            return pa.RecordBatch.from_arrays([pa.array(of[edges]), pa.array(parts, pa.binary())], schema=schema)

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                n += batch.num_rows
            if n >= rows:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return listed.mapInArrow(run, schema_of("of long, data binary"))


def _texts(rows: list[tuple], words: Words, schema: pa.Schema) -> pa.RecordBatch:
    kinds = np.array(words.classes, np.uint16)
    out = [pa.nulls(len(rows), t) for t in schema.types]
    for at in range(4):
        out[at] = pa.array([r[at] for r in rows], schema.types[at])
    out[4] = pa.array([kinds[r[4]].tobytes() for r in rows], pa.binary())
    return pa.RecordBatch.from_arrays(out, schema=schema)


class Hmm:
    """begin [states], move [states, states], emit [classes, states]; each distribution sums to 1."""

    def __init__(self, begin: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.begin, self.move, self.emit = begin, move, emit

    @classmethod
    def start(cls, counts: np.ndarray, states: int = STATES, noise: float = 0.5, stay: float = 0.95) -> Hmm:
        """States that emit the classes as often as all training tokens do (counts by class), each made a little different by
        fixed random numbers, and that mostly stay: what belongs together in the texts then draws them apart."""
        emit = (counts + 0.1)[:, None] * np.exp(noise * np.random.default_rng(7).standard_normal((len(counts), states)))
        move = np.full((states, states), (1 - stay) / max(1, states - 1))
        np.fill_diagonal(move, stay if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def of_counts(cls, begin: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Hmm:
        emit = emit + 0.02 + 0.5 * (emit.sum(1) / max(1.0, emit.sum()))[:, None]
        move, begin = move + 0.1, begin + 0.1
        return cls(begin / begin.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def by_step(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts of one or more tokens, longest first, laid out step by step: order of the texts, how many have a step t,
        where step t begins, and the tokens in that layout."""
        n = np.array([len(d) for d in docs])
        order = np.argsort(-n, kind="stable")
        n = n[order]
        live = len(n) - np.searchsorted(n[::-1], np.arange(1, n[0] + 1), "left")
        starts = np.concatenate([[0], np.cumsum(live)])
        flat = np.empty(starts[-1], np.int64)
        for rank, i in enumerate(order):
            flat[starts[: n[rank]] + rank] = docs[i]
        return order, live, starts, flat

    def expect(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts (begin, move, emit by class) and log-likelihood of the texts, by scaled forward-backward."""
        classes, k = self.emit.shape
        _, live, at, x = self.by_step(docs)
        emit, move, begin = self.emit.astype(np.float32), self.move.astype(np.float32), self.begin.astype(np.float32)
        alpha, scale = np.empty((len(x), k), np.float32), np.empty(len(x), np.float32)
        for t, c in enumerate(live):
            a = at[t]
            f = emit[x[a : a + c]]
            f *= begin if not t else alpha[at[t - 1] : at[t - 1] + c] @ move
            s = f.sum(1)
            scale[a : a + c] = s
            np.divide(f, s[:, None], out=alpha[a : a + c])
        moved = np.zeros((k, k))
        beta = np.ones((live[-1], k), np.float32)
        for t in range(len(live) - 1, -1, -1):
            a, c = at[t], live[t]
            if t + 1 < len(live):
                now = np.ones((c, k), np.float32)
                now[: len(beta)] = beta
                beta = now
            if t:
                g = emit[x[a : a + c]]
                g *= beta
                g /= scale[a : a + c, None]
                moved += alpha[at[t - 1] : at[t - 1] + c].T @ g
                after = g @ move.T
            alpha[a : a + c] *= beta
            if t:
                beta = after
        return alpha[: live[0]].sum(0), moved * self.move, np.stack([np.bincount(x, alpha[:, h], classes) for h in range(k)], 1), float(np.log(scale.astype(np.float64)).sum())

    def likelihood(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text's classes, exactly, in double precision."""
        order, live, at, x = self.by_step(docs)
        out, f = np.zeros(len(docs)), None
        for t, c in enumerate(live):
            f = self.emit[x[at[t] : at[t] + c]] * (self.begin if f is None else f[:c] @ self.move)
            s = f.sum(1)
            f /= s[:, None]
            out[:c] += np.log10(s)
        back = np.empty(len(docs))
        back[order] = out
        return back


def _round(train: DataFrame, model: Hmm) -> Hmm:
    """One round of Baum-Welch: rows (class, expected count by state); -1 - s: moves from s; -1 - STATES: begins."""
    k = len(model.begin)

    def make():
        total = [np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)]
        held: list[np.ndarray] = []

        def add():
            if held:
                for into, got in zip(total, model.expect(held), strict=False):
                    into += got
                held.clear()

        def f(classes):
            for c in classes:
                held.append(np.frombuffer(c, np.uint16))
            if sum(map(len, held)) >= GATHER:
                add()

        def last():
            add()
            used = np.flatnonzero(total[2].sum(1) > 0)
            if len(used):
                rows = np.concatenate([total[2][used], total[1], total[0][None]])
                yield [[*used.tolist(), *(-1 - np.arange(k + 1)).tolist()], *rows.T]

        f.close = last
        return f

    columns = [f"s{h}" for h in range(k)]
    got = map_columns(train.select("classes"), "class int, " + ", ".join(f"{c} double" for c in columns), make).groupBy("class").agg(*(F.sum(c).alias(c) for c in columns)).collect()
    begin, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)
    for r in got:
        row = np.array(r[1:])
        if r[0] >= 0:
            emit[r[0]] = row
        elif r[0] >= -k:
            move[-1 - r[0]] = row
        else:
            begin = row
    return Hmm.of_counts(begin, move, emit)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, hmm_score double, score double"


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    import pandas as pd

    base = table(numbered(docs), "numbered")
    text, listed = base.where("ids IS NOT NULL"), base.where("word IS NOT NULL")
    # One row for each word after tasks have added up their own; the join back to the blocks may be split where it is skewed.
    words = table(listed.groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("c")), "words")
    sums = words.groupBy("class").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).collect()
    listed = listed.select(F.col("block").alias("of"), "at", "word").join(words, "word").select("of", "at", "class", "c")
    listed = packed(listed)
    blocks = max(1, text.agg(F.countDistinct("block")).head()[0])
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        n_class[r["class"]], v_class[r["class"]] = r.n, r.v
    total, distinct = int(n_class.sum()), int(v_class.sum())

    train = text.where("NOT held").select("classes")
    model = Hmm.start(n_class, states)
    for _ in range(rounds if total else 0):
        model = _round(train, model)

    def block(rows: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({c.split()[0]: [] for c in SCORES.split(", ")})
        at, kinds, low, high = np.concatenate([whole(x).reshape(4, -1) for x in words["data"]], 1)
        c, kind = np.zeros(len(at)), np.zeros(len(at), np.int64)
        c[at], kind[at] = low + high * float(1 << 32), kinds
        plain, inside = np.log10((c + 1) / (total + distinct + 1)), np.log10((c + 1) / (n_class[kind] + v_class[kind] + 1))
        ids = [whole(x) for x in rows["ids"]]
        hmm = np.concatenate([model.likelihood([kind[d] for d in ids[a : a + 4096]]) for a in range(0, len(ids), 4096)])
        word = np.array([inside[d].sum() for d in ids])
        return pd.DataFrame({
            "doc_id": rows["doc_id"], "held_out": rows["held"], "n_tokens": [len(d) for d in ids], "n_known": [int(np.count_nonzero(c[d])) for d in ids], "train_tokens": total,
            "base_score": [plain[d].sum() for d in ids], "hmm_score": hmm, "score": hmm + word,
        })

    # As many partitions as blocks, so that a task holds one block or a few, however large the corpus.
    rows = text.select("block", "doc_id", "held", "ids").repartition(blocks, "block")
    return rows.groupBy("block").cogroup(listed.repartition(blocks, "of").groupBy("of")).applyInPandas(block, SCORES)
