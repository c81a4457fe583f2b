"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

Shingles are five words in lower case (all words of a shorter text). A shingle weighs tf * (1 + IDF * idf / idf_max) with
idf = ln(1 + N / df), rounded to a geometric grid, so that the rarest shingle weighs twice as much as one that all have. The
1 smoothes: in a large group of near copies what is common has a high df and what each copy has of its own a low one, and
idf alone would push copies apart that share nearly all their words. df comes from a count sketch of fixed size over all documents, where a shingle rarer than about one in
a few thousand documents counts as that rare, at any corpus size.

1. Texts that are equal as lower-case words are one node. Each node gets SAMPLES consistent samples (Ioffe's scheme:
   r, c ~ Gamma(2, 1), beta ~ U(0, 1) for shingle and sample, from a table that the shingle's hash points into) and BANDS
   keys of ROWS samples each. At similarity 0.8 all keys differ about once in 11,000 pairs: bands share samples.
2. In each bucket, every member meets the bucket's most central member (that with the largest buckets in all). A pair is
   verified by exact weighted Jaccard similarity of its whole shingle sets, unless so few of its samples agree as a pair
   that is similar enough has about once in a million (agreeing(); agree=0 verifies every candidate).
3. Connected components of the verified links. Where a bucket then still holds several components, its members outside
   the centre's component meet all members of the bucket inside tasks, and links that join further components are found
   exactly. A member is dealt once to its bucket, whatever the bucket's size up to CELL bytes, and once for each further
   CELL bytes; tasks report a member once. So no candidate pair is left out, and no group becomes rows of its pairs.
4. Components of all links are the classes; a class is named by its smallest doc_id.

Counts by bucket are pre-aggregated and buckets that hold a thousandth of all rows or more are salted; links are joined
with tables, so that a hot centre can be split. A text without words (null, empty, blank) is a class of its own. Repeated
rows are copies. Rows are told apart by a hash of id and text, so null ids are linked like others and ids that several
texts share do no harm; a class whose ids are all null has a null class_id. Of ties for the centre the larger node hash is
taken, of rows that may name a class that with the smallest id, then the smallest hash. Texts are hashed and compared
whole, however long. An empty table gives no rows. Other columns, of any name, pass unread.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textstats as ts
from .common import drop, fresh, map_columns, table, texts

SHINGLE, SIMILAR = 5, 0.8
SAMPLES, BANDS, ROWS = 48, 24, 4
#: The sketch has DEPTH rows of WIDTH counters, added up in parts of PART counters.
DEPTH, WIDTH, PART = 2, 1 << 19, 1 << 14
#: How much the rarest shingle weighs more than one that all documents have.
IDF = 1.0
#: Grid of weights: exp(STEP * level), level in the lowest BITS of a packed shingle; entries of the table of random draws.
STEP, BITS, LEVELS, DRAWS = 0.08, 8, 1 << 8, 1 << 13
#: Copies of a hot bucket's row; bytes of members that meet in one cell, on either side; members compared at once.
SALTS, CELL, BLOCK = 64, 16 << 20, 256
_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 62, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_LOW = np.uint64(0xFFFFFFFF)


def shingles(text: str) -> tuple[bytes | None, np.ndarray, np.ndarray]:
    """Key of the text as lower-case words (None without words), its different shingles, ascending, and how often each occurs."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return None, np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    s = np.sort(ts.windows(h, min(SHINGLE, len(h))))
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    return hashlib.md5(b" ".join(words)).digest(), s[at], np.diff(np.r_[at, len(s)])


def cells(s: np.ndarray, row: int) -> np.ndarray:
    return ((s * _SKETCH[row]) >> np.uint64(64 - WIDTH.bit_length() + 1)).astype(np.int64)


class Weights:
    """Levels of TF-IDF weights from the sketch of document frequencies."""

    def __init__(self, sketch: np.ndarray, documents: int):
        n = max(1, documents)
        self.idf = np.log1p(IDF * np.log1p(n / np.maximum(1, sketch)) / np.log1p(n)).astype(np.float32)  # ln of the weight at tf 1, by counter

    def levels(self, s: np.ndarray, tf: np.ndarray) -> np.ndarray:
        ln = np.maximum(self.idf[0][cells(s, 0)], self.idf[1][cells(s, 1)]) + np.log(tf)
        return np.clip(np.round(ln / STEP).astype(np.int64), 0, LEVELS - 1)


_TABLE: list[np.ndarray] = []


def draws() -> np.ndarray:
    """ln a of every level and draw, as the upper 32 bits of a number that sorts alike."""
    if not _TABLE:
        rng = np.random.default_rng(5)
        r, c, beta = rng.gamma(2, 1, DRAWS), rng.gamma(2, 1, DRAWS), rng.random(DRAWS)
        ln_w = STEP * np.arange(LEVELS)[:, None]
        t = np.floor(ln_w / r + beta)
        ln_a = np.log(c) - r * (t - beta) - r
        _TABLE.append((np.clip((ln_a + 64) / 128, 0, 1 - 2**-32) * 2**32).astype(np.uint64).ravel() << np.uint64(32))
    return _TABLE[0]


def samples(s: np.ndarray, level: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[texts, SAMPLES]: the least draw of each text's shingles; equal for two texts with the chance of their similarity."""
    shift = np.uint64(DRAWS.bit_length() - 1)
    from_, table_, out = level.astype(np.uint64) << shift, draws(), np.empty((len(starts), SAMPLES), np.uint64)
    for k in range(SAMPLES):
        p = s * _MULTIPLIERS[k]
        v = table_[from_ | (p >> (np.uint64(64) - shift))]
        p &= _LOW
        v |= p
        out[:, k] = np.minimum.reduceat(v, starts)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    """[texts, BANDS]: neighbouring samples for one half of the bands, samples far apart for the other."""
    half = SAMPLES // ROWS
    both = np.concatenate([sample.reshape(-1, half, ROWS), sample.reshape(-1, ROWS, half).transpose(0, 2, 1)], 1)
    h = np.full(both.shape[:2], 0, np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        h = (h ^ both[:, :, i]) * ts._ODD
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def document_frequencies(docs: DataFrame) -> Weights:
    """The sketch over all documents; tasks add up their own, and its parts are added up in parallel."""

    def make():
        count, n = np.zeros((DEPTH, WIDTH), np.int32), [0]

        def f(text):
            found = [shingles(t)[1] for t in text]
            n[0] += len(found)
            together = np.concatenate(found)
            for row in range(DEPTH):
                count[row] += np.bincount(cells(together, row), minlength=WIDTH).astype(np.int32)

        def last():
            parts = count.reshape(-1, PART)
            used = np.flatnonzero(parts.any(1))
            yield [[-1, *used.tolist()], [np.array(n, np.int64).tobytes(), *(p.astype(np.int64).tobytes() for p in parts[used])]]

        f.close = last
        return f

    def add():
        total: dict[int, np.ndarray] = {}

        def f(part, data):
            for k, x in zip(part, data, strict=True):
                x = np.frombuffer(x, np.int64)
                total[k] = total[k] + x if k in total else x

        f.close = lambda: [[list(total), [x.tobytes() for x in total.values()]]] if total else []
        return f

    partial = map_columns(docs.select("text"), "part int, data binary", make)
    whole = map_columns(partial.repartition("part"), "part int, data binary", add).collect()
    sketch, n = np.zeros((DEPTH * WIDTH // PART, PART), np.int64), 0
    for r in whole:
        if r.part < 0:
            n = int(np.frombuffer(r.data, np.int64)[0])
        else:
            sketch[r.part] = np.frombuffer(r.data, np.int64)
    return Weights(sketch.reshape(DEPTH, WIDTH), n)


def agreeing(similar: float) -> int:
    """The least number of samples that agree, below which a candidate isn't verified: 5 standard deviations under the mean
    of a pair that is just similar enough."""
    return max(0, int(SAMPLES * similar - 5 * (SAMPLES * similar * (1 - similar)) ** 0.5))


def marked(docs: DataFrame) -> DataFrame:
    """texts() with a hash of each row's id and text, which tells rows apart."""
    return texts(docs).withColumn("mark", _mark())


def _mark():
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")), F.lit("row"))


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, mark, node (null without words), sample (16 bits of each), keys."""

    def make():
        def f(ids, text, marks):
            nodes, sig, keys, part, size = [], [None] * len(ids), [None] * len(ids), [], 0

            def flush():
                starts = np.cumsum([0] + [len(p[1]) for p in part])[:-1]
                got = samples(np.concatenate([p[1] for p in part]), np.concatenate([p[2] for p in part]), starts)
                for p, g, k in zip(part, ((got * ts._MIX) >> np.uint64(48)).astype(np.uint16), band_keys(got), strict=True):
                    sig[p[0]], keys[p[0]] = g.tobytes(), k.tolist()
                part.clear()

            for i, t in enumerate(text):
                node, s, tf = shingles(t)
                nodes.append(node)
                if node is not None:
                    part.append((i, s, weights.levels(s, tf)))
                    size += len(s)
                    if size > 30_000:
                        flush()
                        size = 0
            if part:
                flush()
            return [ids, marks, nodes, sig, keys]

        return f

    return map_columns(docs.select("doc_id", "text", "mark"), "doc_id long, mark long, node binary, sample binary, keys array<long>", make)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed shingle sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    shift, mask = np.uint64(BITS), np.uint64(LEVELS - 1)
    wx, wy = _GRID[(x & mask).astype(np.int64)], _GRID[(y & mask).astype(np.int64)]
    at = np.minimum(np.searchsorted(y >> shift, x >> shift), len(y) - 1)
    both = (y[at] >> shift) == (x >> shift)
    low = np.minimum(wx[both], wy[at[both]]).sum()
    return float(low / (wx.sum() + wy.sum() - low))


_GRID = np.exp(STEP * np.arange(LEVELS))


def packed(text: str, weights: Weights) -> tuple[bytes | None, bytes]:
    """Node and its shingles, ascending, each with its level in the lowest BITS."""
    node, s, tf = shingles(text)
    return node, ((s & ~np.uint64(LEVELS - 1)) | weights.levels(s, tf).astype(np.uint64)).tobytes()


def shingle_sets(docs: DataFrame, weights: Weights, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, as a table; docs has marks, and one row of each node is read."""
    rows = nodes.join(wanted, "node", "left_semi").select("mark").distinct()

    def pack():
        def f(text):
            got = [packed(t, weights) for t in text]
            return [[g[0] for g in got], [g[1] for g in got]]

        return f

    sets = map_columns(docs.join(rows, "mark", "left_semi").select("text"), "node binary, shingles binary", pack).where("node IS NOT NULL")
    return table(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingles")


def verified(docs: DataFrame, weights: Weights, nodes: DataFrame, pairs: DataFrame, similar: float, agree: int) -> DataFrame:
    """The pairs (a, b, sample_a, sample_b) whose similarity is `similar` or more, as a table of (a, b)."""

    def likely():
        def f(a, b, x, y):
            if not a:
                return None
            same = (np.frombuffer(b"".join(x), np.uint16) == np.frombuffer(b"".join(y), np.uint16)).reshape(len(a), -1).sum(1)
            keep = np.flatnonzero(same >= agree)
            return [[a[i] for i in keep], [b[i] for i in keep]]

        return f

    pairs = table(map_columns(pairs.select("a", "b", "sample_a", "sample_b"), "a binary, b binary", likely), "pairs")
    sets = shingle_sets(docs, weights, nodes, pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct())

    def check():
        def f(a, b, x, y):
            keep = [i for i in range(len(a)) if similarity(x[i], y[i]) >= similar]
            return [[a[i] for i in keep], [b[i] for i in keep]]

        return f

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    links = table(map_columns(both.select("a", "b", "x", "y"), "a binary, b binary", check), "links")
    drop(pairs, sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, root being the smallest node of its component: alternating large and small
    stars, each a minimum by node and a join with it, until nothing changes."""
    edges = table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "stars")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = table(large.where("u <> v").distinct(), "edges")
        drop(edges, least)
        least = table(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(least, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = table(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(large, least)
        # A round that changes nothing leaves stars: as many edges as nodes that aren't roots, with the same sum.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == before:
            roots = table(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select("v", "v").distinct()), "roots")
            drop(edges)
            return roots
        before = now


def classes(docs: DataFrame, similar: float = SIMILAR, agree: int | None = None) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), and whether it is the one named so."""
    return _classes(docs, similar, agree).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("representative"))


def _first():
    """Which of several rows names its class: ids before nulls, the smallest first."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))


def _classes(docs: DataFrame, similar: float, agree: int | None) -> DataFrame:
    """doc_id, mark, and class_id and class_mark: id and mark of the row that names the class."""
    docs, agree = marked(docs), agreeing(similar) if agree is None else agree
    weights = document_frequencies(docs)
    signed = table(signatures(docs, weights), "signatures")
    first = signed.where("node IS NOT NULL").groupBy("node").agg(_first().alias("rep"), F.first("sample").alias("sample"), F.first("keys").alias("keys"))
    nodes = table(first.select("node", "rep.doc_id", "rep.mark", "sample", "keys"), "nodes")
    total = nodes.count()

    rows = nodes.select("node", F.explode("keys").alias("key"))
    counts = table(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    hot = F.broadcast(counts.where(F.col("n") >= max(1000, total // 1000)).select("key", F.lit(True).alias("hot")))  # at most 1000 * BANDS rows

    def salted(df: DataFrame, *by: str) -> DataFrame:
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
        return df.join(hot, "key", "left").withColumn("salt", salt).drop("hot")

    def copies(df: DataFrame) -> DataFrame:
        all_ = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        return df.join(hot, "key", "left").withColumn("salt", F.explode(all_)).drop("hot")

    members = table(salted(rows, "node").join(copies(counts), ["key", "salt"]), "members")
    central = members.groupBy("node").agg(F.sum("n").alias("size"))
    centres = members.join(central, "node").groupBy("key").agg(F.max(F.struct("size", "node")).getField("node").alias("centre"))
    centres = table(centres, "centres")
    star = members.select("node", "key", "salt").join(copies(centres), ["key", "salt"])
    star = table(star.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "star")

    named = nodes.select("node", F.col("doc_id").alias("class_id"), F.col("mark").alias("class_mark"))
    if not star.isEmpty():
        named = _named(docs, weights, nodes, members, centres, star, copies, salted, similar, agree)
    found = signed.where("node IS NOT NULL").select("doc_id", "mark", "node").join(named, "node").select("doc_id", "mark", "class_id", "class_mark")
    return found.unionAll(signed.where("node IS NULL").select("doc_id", "mark", F.col("doc_id").alias("class_id"), F.col("mark").alias("class_mark")))


def _named(docs: DataFrame, weights: Weights, nodes: DataFrame, members: DataFrame, centres: DataFrame, star: DataFrame, copies, salted, similar: float, agree: int) -> DataFrame:
    """(node, class_id, class_mark) from the candidate pairs with the centres, and then from those among the rest of their buckets."""

    def with_samples(pairs: DataFrame) -> DataFrame:
        one = nodes.select(F.col("node").alias("a"), F.col("sample").alias("sample_a"))
        two = nodes.select(F.col("node").alias("b"), F.col("sample").alias("sample_b"))
        return pairs.join(one, "a").join(two, "b")

    links = verified(docs, weights, nodes, with_samples(star), similar, agree)
    roots = components(links)

    # Buckets in which a member isn't in the centre's component.
    rooted = members.select("node", "key", "salt").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    at_centre = centres.join(roots.withColumnRenamed("node", "centre"), "centre", "left").select("key", F.coalesce("root", "centre").alias("centre_root"))
    rooted = table(rooted.join(copies(at_centre), ["key", "salt"]).withColumn("out", F.col("root") != F.col("centre_root")).drop("centre_root"), "rooted")
    open_ = table(rooted.groupBy("key").agg(F.count_if("out").alias("n_out")).where("n_out > 0").select("key"), "open")
    if not open_.isEmpty():
        rest = salted(rooted.drop("salt"), "node").join(copies(open_), ["key", "salt"]).select("key", "node", "root", "out")
        rest = table(rest.join(nodes.select("node", F.col("sample").alias("value")), "node"), "rest")
        live = table(_met(rest, lambda *x: _alike(*x, agree), "key long, node binary").dropDuplicates(["key", "node"]), "live")
        if not live.isEmpty():
            sets = shingle_sets(docs, weights, nodes, live.select("node").distinct())
            rest = table(rest.drop("value").join(live, ["key", "node"], "left_semi").join(sets.withColumnRenamed("shingles", "value"), "node"), "rest")
            more = table(_met(rest, lambda *x: _linked(*x, similar), "a binary, b binary").dropDuplicates(["a", "b"]), "more")
            if not more.isEmpty():
                roots = components(links.unionAll(more))

    named = table(nodes.select("node", "doc_id", "mark").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    least = table(named.groupBy("root").agg(_first().alias("rep")).select("root", F.col("rep.doc_id").alias("class_id"), F.col("rep.mark").alias("class_mark")), "least")
    return table(named.join(least, "root").select("node", "class_id", "class_mark"), "classes")


def deduplicate(docs: DataFrame, similar: float = SIMILAR, agree: int | None = None) -> DataFrame:
    """The rows that name their class, with their columns as they are; of rows that repeat such a one's id and text, that whose
    other columns come first as JSON text."""
    rest = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    key, number = fresh(docs, "_class_mark"), fresh(docs, "_copy")
    named = _classes(docs, similar, agree).where("mark = class_mark").select(F.col("mark").alias(key)).distinct()
    kept = docs.withColumn(key, _mark()).join(named, key, "left_semi")
    copy = F.row_number().over(Window.partitionBy(key).orderBy(F.to_json(F.struct(*rest)) if rest else F.lit(0)))
    return kept.withColumn(number, copy).where(F.col(number) == 1).select(*docs.columns)


def _met(rest: DataFrame, meet, ddl: str, cell: int = CELL) -> DataFrame:
    """meet(bucket, left, right) for the members outside the centre's component and all members of their bucket; left and
    right are lists of (node, root, value), and the result rows of ddl.

    rest: key, node, root, out, value, a table. A bucket is one cell unless its values have more than `cell` bytes; else
    those outside are dealt into rows of cells and all members into columns, so that a task holds one cell at a time."""
    size = F.octet_length("value") + 64
    parts = rest.groupBy("key").agg(*(F.ceil(F.sum(x) / cell).cast("int").alias(c) for x, c in ((F.when(F.col("out"), size).otherwise(0), "is"), (size, "js"))))
    hash_, i, j = F.xxhash64("node"), F.col("i"), F.col("j")
    wide = rest.join(parts, "key").withColumn("i", F.pmod(hash_, F.greatest("is", F.lit(1))).cast("int")).withColumn("j", F.pmod(F.xxhash64(hash_), F.greatest("js", F.lit(1))).cast("int"))

    def cells(n: str, make):
        return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), make)

    def at(x, y, left, right):
        return F.struct(x.alias("i"), y.alias("j"), left.alias("left"), right.alias("right"))

    across = F.filter(cells("js", lambda y: at(i, y, F.lit(True), y == j)), lambda _: F.col("out"))
    down = F.filter(cells("is", lambda x: at(x, j, F.lit(False), F.lit(True))), lambda c: ~(F.col("out") & (c["i"] == i)))
    dealt = wide.select("key", "node", "root", "value", F.explode(F.concat(across, down)).alias("c")).select("key", "node", "root", "value", "c.*")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def make():
        now: list = [None, [], []]

        def met():
            return meet(now[0][0], now[1], now[2]) if now[1] and now[2] else []

        def f(key, node, root, value, i, j, left, right):
            out = []
            for at, row, a, b in zip(zip(key, i, j, strict=True), zip(node, root, value, strict=True), left, right, strict=True):
                if at != now[0]:
                    out += met()
                    now[:] = [at, [], []]
                if a:
                    now[1].append(row)
                if b:
                    now[2].append(row)
            return list(map(list, zip(*out, strict=True))) if out else None

        def last():
            out = met()
            return [list(map(list, zip(*out, strict=True)))] if out else []

        f.close = last
        return f

    return map_columns(dealt, ddl, make)


def _alike(key: int, left: list[tuple], right: list[tuple], agree: int) -> list[tuple]:
    """(bucket, node) of those that have a partner of another component of which `agree` samples or more agree, each once."""
    names = {r: n for n, r in enumerate({r[1] for r in (*left, *right)})}
    table_ = np.frombuffer(b"".join(r[2] for r in right), np.uint16).reshape(len(right), -1)
    roots, hit, out = np.array([names[r[1]] for r in right]), np.zeros(len(right), bool), set()
    for node, root, sample in left:
        one = ((table_ == np.frombuffer(sample, np.uint16)).sum(1) >= agree) & (roots != names[root])
        if one.any():
            out.add(node)
            hit |= one
    out.update(right[k][0] for k in np.flatnonzero(hit))
    return [(key, node) for node in sorted(out)]


def _linked(_, left: list[tuple], right: list[tuple], similar: float, columns: int = 4096, block: int = BLOCK) -> list[tuple]:
    """Links that join different components, as many as it takes to join them: a pair that earlier links have joined adds
    nothing. Blocks of members are bounded at once, by products of roots of weights over the shingles that both sides have,
    which is no less than the sum of the smaller weights; only pairs whose bound reaches `similar` are computed exactly."""
    root = {r[1]: r[1] for r in (*left, *right)}

    def find(r: bytes) -> bytes:
        while root[r] != r:
            root[r] = root[root[r]]
            r = root[r]
        return r

    out = []
    for a in range(0, len(left), block):
        for b in range(0, len(right), block):
            one, two = left[a : a + block], right[b : b + block]
            for i, j in _likely(one, two, similar, columns):
                x, y = find(one[i][1]), find(two[j][1])
                if x != y and similarity(one[i][2], two[j][2]) >= similar:
                    root[x] = y
                    out.append((one[i][0], two[j][0]))
    return out


def _likely(left: list[tuple], right: list[tuple], similar: float, columns: int) -> np.ndarray:
    """Positions (left, right) of all pairs that may be similar enough."""
    sides = []
    for rows in (left, right):
        parts = [np.frombuffer(r[2], np.uint64) for r in rows]
        of = np.repeat(np.arange(len(rows)), list(map(len, parts)))
        flat = np.concatenate(parts)
        sides.append((flat >> np.uint64(BITS), np.sqrt(_GRID[(flat & np.uint64(LEVELS - 1)).astype(np.int64)]), of))
    both = np.intersect1d(sides[0][0], sides[1][0])
    total, least = [np.bincount(of, w * w, len(rows)) for (_, w, of), rows in zip(sides, (left, right), strict=True)], np.zeros((len(left), len(right)))
    spots = []
    for h, w, of in sides:
        at = np.searchsorted(both, h)
        in_ = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == h) if len(both) else np.zeros(len(h), bool)
        order = np.argsort(at[in_], kind="stable")
        spots.append((at[in_][order], w[in_][order], of[in_][order]))
    for a in range(0, len(both), columns):
        dense = []
        for (at, w, of), rows in zip(spots, (left, right), strict=True):
            x, y = np.searchsorted(at, [a, a + columns])
            m = np.zeros((len(rows), min(columns, len(both) - a)))
            m[of[x:y], at[x:y] - a] = w[x:y]
            dense.append(m)
        least += dense[0] @ dense[1].T
    return np.argwhere(least >= (similar - 1e-9) * (total[0][:, None] + total[1] - least))
