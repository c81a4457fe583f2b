"""The wrong tools that look most like the right one, by an index of keywords.

A tool's score for a row is twice the words that it shares with the query, less those that it shares with the correct tool; the
best are the highest scores, then the first in registry order. A registry's tools are dealt into blocks of at most TOOLS, its
rows into groups of about ROWS; each group meets each block in one task, as an index: the tools that have a word, by word. A row
adds up the lists of its words, rarest first, until the words to come can't lift a tool that it hasn't met above the k-th best;
then it looks further words up for the tools that still may be among the best. Tools that share no word score 0 or
less: only where fewer than k tools are above that, they are taken from the front of the registry's order. So no row meets all
tools, whatever the size of a registry, and the result is that of every score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

#: Tools of a block, rows of a group.
TOOLS, ROWS = 65_536, 20_000
#: Tools looked through at once in registry order, at first.
CHUNK = 64


class ToolIndex:
    """Tools (pos, name, words) of one block by word."""

    def __init__(self, pos: list[int], names: list[str], words: list[list[str]]):
        order = sorted(range(len(pos)), key=lambda i: (pos[i], names[i]))
        self.pos, self.names = [pos[i] for i in order], [names[i] for i in order]
        lists: dict[str, list[int]] = {}
        self.named: dict[str, list[int]] = {}
        for at, i in enumerate(order):
            self.named.setdefault(names[i], []).append(at)
            for w in set(words[i] or ()):
                lists.setdefault(w, []).append(at)
        self.lists = {w: np.array(x, np.int32) for w, x in lists.items()}
        self.score = np.zeros(len(order), np.int32)

    def _in(self, of: np.ndarray, word: np.ndarray) -> np.ndarray:
        return word[np.minimum(np.searchsorted(word, of), len(word) - 1)] == of

    def best(self, asked: list[str], own: list[str], correct: str, k: int) -> list[tuple[int, int]]:
        """(place, score) of the k best tools of another name."""
        n, asked_, own_ = len(self.pos), set(asked), set(own)
        without = np.array(self.named.get(correct, ()), np.int32)
        weigh = {w: 2 * (w in asked_) - (w in own_) for w in asked_ | own_ if w in self.lists}
        every = sum(x for w, x in weigh.items() if len(self.lists[w]) == n)  # words of all tools change no order
        few = {w: x for w, x in weigh.items() if len(self.lists[w]) < n}
        gains = sorted(((self.lists[w], x) for w, x in few.items() if x > 0), key=lambda g: len(g[0]))
        losses = [self.lists[w] for w, x in few.items() if x < 0]
        rest = np.cumsum([0, *(x for _, x in reversed(gains))])[::-1].tolist()

        def met(upto: int) -> np.ndarray:
            found = np.unique(np.concatenate([g for g, _ in gains[:upto]])) if upto else np.empty(0, np.int32)
            return found[~np.isin(found, without)]

        def whole(of: np.ndarray, done: int) -> np.ndarray:
            out = self.score[of].astype(np.int64)
            for g, x in gains[done:]:
                out += x * self._in(of, g)
            for g in losses:
                out -= self._in(of, g)
            return out

        bar, done, read = None, 0, 0
        for done, (g, x) in enumerate(gains):
            if bar is not None and rest[done] < bar:
                break
            self.score[g] += x
            read += len(g)
            # The bar is worth its price before a list that is longer than all so far.
            if done + 1 < len(gains) and len(gains[done + 1][0]) > read and len(now := met(done + 1)) >= k:
                top = now[np.argpartition(-self.score[now], k - 1)[:k]]
                least = int(whole(top, done + 1).min())
                bar = least if bar is None else max(bar, least)
        else:
            done = len(gains)
        may = met(done)
        if bar is not None:
            may = may[self.score[may] + rest[done] >= bar]
        scores = whole(may, done)
        for g, _ in gains[:done]:
            self.score[g] = 0
        found = sorted(zip((-scores).tolist(), may.tolist(), strict=True))[:k]
        if done == len(gains) and (len(found) < k or found[-1][0] >= 0):  # of the others, none is above 0
            found = sorted(found + self._others([g for g, _ in gains], losses, without, k))[:k]
        return [(at, every - s) for s, at in found]

    def _others(self, gains: list[np.ndarray], losses: list[np.ndarray], without: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(-score, place) of the k best tools that are in no gain, from the front of the order until k have no loss either."""
        best, at, step, clear = [], 0, CHUNK, 0
        while at < len(self.pos) and clear < k:
            end = min(len(self.pos), at + step)
            lost, out = np.zeros(end - at, np.int64), np.zeros(end - at, bool)
            for g in [*gains, without]:
                out[g[np.searchsorted(g, at) : np.searchsorted(g, end)] - at] = True
            for g in losses:
                lost[g[np.searchsorted(g, at) : np.searchsorted(g, end)] - at] += 1
            left = np.flatnonzero(~out)
            clear += int((lost[left] == 0).sum())
            best = sorted(best + list(zip(lost[left].tolist(), (left + at).tolist(), strict=True)))[:k]
            at, step = end, 2 * step
        return best


def best_candidates(rows: DataFrame, words: DataFrame, k: int, tools: int = TOOLS, group: int = ROWS) -> DataFrame:
    """(traj_id, name, pos, score) of the k best tools of each block of the row's registry. rows(traj_id, registry, correct_tool,
    asked, own), the last two arrays of words; words(registry, name, pos, words)."""
    blocks = words.groupBy("registry").agg(F.ceil(F.count("*") / tools).cast("int").alias("_blocks"))
    groups = rows.groupBy("registry").agg(F.ceil(F.count("*") / group).cast("int").alias("_groups"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = words.where("name IS NOT NULL").join(blocks, "registry").join(groups, "registry").select("registry", F.pmod(F.xxhash64("pos", "name"), "_blocks").cast("int").alias("block"), upto("_groups").alias("part"), "name", F.col("pos").cast("long").alias("pos"), "words")
    asking = rows.join(blocks, "registry").join(groups, "registry").select("registry", upto("_blocks").alias("block"), F.pmod(F.xxhash64("traj_id"), "_groups").cast("int").alias("part"), "traj_id", "correct_tool", "asked", "own")
    schema = StructType().add("traj_id", rows.schema["traj_id"].dataType).add("name", StringType()).add("pos", LongType()).add("score", LongType())
    arrow = to_arrow_schema(schema)

    def meet(some_rows: pa.Table, some_tools: pa.Table) -> pa.Table:
        out = {c: [] for c in arrow.names}
        if some_rows.num_rows and some_tools.num_rows:
            index = ToolIndex(*(some_tools.column(c).to_pylist() for c in ("pos", "name", "words")))
            for traj_id, correct, asked, own in zip(*(some_rows.column(c).to_pylist() for c in ("traj_id", "correct_tool", "asked", "own")), strict=True):
                for at, score in index.best(asked or [], own or [], correct, k) if correct is not None else ():
                    for c, x in zip(arrow.names, (traj_id, index.names[at], index.pos[at], score), strict=True):
                        out[c].append(x)
        return pa.table(out, schema=arrow)

    keys = ("registry", "block", "part")
    return asking.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(meet, schema)
