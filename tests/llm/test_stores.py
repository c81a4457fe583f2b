"""WARC archives, exact top-k and near-duplicates."""

import gzip
import hashlib
import io
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import impact, neardup, warc

from .conftest import prose

PAGES = "page_id long, url string, html string, digest string, salt int, n int"


@pytest.fixture(scope="module")
def pages(spark):
    big, small = "<p>é</p>" * 40, "<p>x</p>"
    rows = [(3, "http://a/é b\r\nX: y", big), (1, None, big), (2, "u", big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (8, "u", "z" * 99), (9, "u", "z" * 99), (10, "u", "z" * 100), (11, "u", "z" * 100), (1, None, big), (None, "u", big)]
    return spark.createDataFrame([(*r, "d", 1, 2) for r in rows], PAGES).repartition(3)


def test_archives_round_trip(pages):
    index = warc.write(pages, archive_bytes=600)
    assert index.count() > 3
    got = warc.read(index).collect()
    rows = pages.collect()
    first = {}
    for r in rows:
        h = r.html or ""
        if len(h.encode()) >= 100 and r.page_id is not None:
            first[h] = min(first.get(h, r.page_id), r.page_id)
    want = Counter()
    for r in rows:
        body = (r.html or "").encode()
        to = first.get(r.html or "")
        to = to if to is not None and r.page_id is not None and r.page_id > to else None
        want[r.page_id, len(body), hashlib.sha256(body).hexdigest(), "response" if to is None else "revisit", to] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    html = {r.page_id: (r.html or "").encode() for r in rows}
    assert all(r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html[r.page_id] for r in got)
    assert {r.url for r in got if r.page_id == 3} == {"http://a/%C3%A9%20b%0D%0AX:%20y"}


def test_no_pages(spark):
    assert warc.read(warc.write(spark.createDataFrame([], PAGES))).collect() == []
    assert warc.resolved(warc.read(warc.write(spark.createDataFrame([], PAGES)))).collect() == []


def test_each_archive_is_a_task(pages):
    index = warc.write(pages, archive_bytes=600)
    assert warc.read(index).rdd.getNumPartitions() == index.count()


def test_revisits_get_their_payload_back(spark, pages):
    got = warc.read(warc.write(pages))
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    full = warc.resolved(got).collect()
    assert len(full) == pages.count() and all(bytes(r.payload) == html[r.page_id] and r.found for r in full) and any(r.record_type == "revisit" for r in full)
    lost = warc.resolved(got.where("record_type = 'revisit'")).collect()
    assert lost and not any(r.found or r.payload for r in lost)


def test_long_payloads_come_in_batches(spark):
    long = "".join(chr(97 + i * i % 26) for i in range(300_000))
    df = spark.createDataFrame([(i, None, long + str(i)) for i in range(80)], "page_id long, url string, html string")
    got = warc.read(warc.write(df)).collect()
    assert {(r.page_id, bytes(r.payload)) for r in got} == {(i, (long + str(i)).encode()) for i in range(80)}


def test_reader_is_incremental_and_strict():
    data = warc.record(1, "u", b"hello" * 5000, None) + warc.record(2, "u", b"hello" * 5000, 1)
    found = [warc.parse(m) for m in warc.members(io.BytesIO(data).read, chunk=7)]
    assert [f["warc-type"] for f, _ in found] == ["response", "revisit"] and found[0][1].endswith(b"hello" * 5000)
    with pytest.raises(ValueError, match="inside a gzip member"):
        list(warc.members(io.BytesIO(data[:-5]).read))
    plain = gzip.decompress(warc.record(1, "u", b"hello", None))
    with pytest.raises(ValueError, match="digest"):
        warc.parse(plain.replace(b"hello", b"hellO"))
    with pytest.raises(ValueError, match="length"):
        warc.parse(plain.replace(b"Content-Length: 7", b"Content-Length: 8", 1) if b"Content-Length: 7" in plain else plain[:-1])


def plain_top(rows, k=10):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in {(q, tuple(v)) for q, v in ok if q % 100 == 0}:
        best = sorted((-int(np.dot(v, w)), i) for i, w in ok if i != q)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [50, 8192])
def test_top_k_is_exact(spark, block):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(900, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 700]]) for i in range(900)]
    rows += [(901, None), (902, [None] * 8), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (905, [1.0]), (906, []), (None, [1.0] * 8), (1000, [0.0] * 8)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, score int, cb int").repartition(3)
    got = impact.top_k(df, F.col("vec_id") % 100 == 0, block=block).collect()
    assert {tuple(r) for r in got} == plain_top(rows) and len(got) == 100


def test_queries_are_split_over_blocks(spark):
    """With many queries and blocks no task holds all queries, and what is sent to the blocks is batches."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    every = F.col("vec_id") % 3 == 0
    want = Counter(tuple(r) for r in impact.top_k(df, every).collect())
    held = []
    whole = impact._search

    def watched(vectors, batches, k):
        held.append(batches.groupBy("d", "cb").agg(F.count("*").alias("rows"), F.sum(F.size("qs")).alias("n"), F.max(F.size("qs")).alias("most")).collect())
        return whole(vectors, batches, k)

    impact._search = watched
    try:
        assert Counter(tuple(r) for r in impact.top_k(df, every, block=100, first=60, batch=25).collect()) == want
    finally:
        impact._search = whole
    assert len(held[0]) == 7 and max(r.n for r in held[0]) < 120 and sum(r.n for r in held[0]) == 400
    assert len(held[1]) == 12 and all(r.n == 400 and r.rows == 16 and r.most < 60 for r in held[1])


def test_lengths_meet_their_own(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=3 if i % 3 else 5)]) for i in range(700)] + [(700, []), (701, []), (200, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ints = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows]
    want = set()
    for q in range(0, 701, 100):
        best = sorted({(-int(v @ w), i, n) for n, (i, w) in enumerate(ints) if i != q for a, v in ints if a == q and len(v) == len(w)})
        best = sorted((s, i) for s, i, _ in best)[:10]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    for block in (40, 8192):
        assert {tuple(r) for r in impact.top_k(df, F.col("vec_id") % 100 == 0, block=block).collect()} == want


def test_bar_only_drops_what_is_under_it():
    rng = np.random.default_rng(4)
    v = rng.integers(-900, 900, (400, 6))
    index = impact.ImpactIndex(v)
    for _ in range(20):
        q = rng.integers(-900, 900, 6)
        score = v @ q
        bar = float(np.sort(score)[-25])
        at, got = index.top(q, 10, bar)
        assert set(np.sort(score)[-10:]) <= set(got.tolist()) and (got == score[at]).all()


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert impact.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0, 2.0]), (7, [3.0, -1.0])], schema)
    assert [tuple(r) for r in impact.top_k(two, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 7, 1024 * 1024)]
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(300)], schema)
    got = impact.top_k(same, F.col("vec_id") % 100 == 0).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(10))


def plain_classes(rows, weights):
    """Components of weighted similarity over all pairs of different texts; texts without words stand alone."""
    sets, of = {}, {}
    for i, (doc, text) in enumerate(rows):
        node, packed = neardup.packed(text or "", weights)
        of[i] = node if node is not None else i
        if node is not None:
            sets[node] = packed
    nodes = list(sets)
    root = {n: n for n in of.values()}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x in range(len(nodes)):
        for y in range(x):
            if neardup.similarity(sets[nodes[x]], sets[nodes[y]]) >= 0.8:
                root[find(nodes[x])] = find(nodes[y])
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(of[i])] = min(least.get(find(of[i]), doc), doc)
    return Counter((doc, least.get(find(of[i]))) for i, (doc, _) in enumerate(rows))


def copies():
    r = random.Random(9)
    rows, n = [], 0
    for g in range(12):
        words = prose(100 + g, 120).split()
        for _ in range(r.choice([1, 2, 5, 25])):
            w = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4, 9])):
                w[r.randrange(len(w))] = f"w{r.random()}"
            rows.append((n, " ".join(w)))
            n += 1
    return rows


def test_classes_against_all_pairs(spark, docs):
    rows = copies() + [(None if r.doc_id is None else 1000 + r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, node string, key int").repartition(4)
    weights = neardup.document_frequencies(neardup.texts(df))
    got = neardup.classes(df)
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == plain_classes(rows, weights)


def test_links_inside_a_task_join_what_all_pairs_join():
    r = random.Random(3)
    weights = neardup.Weights(np.ones((2, neardup.WIDTH), np.int64), 100)
    base, rows = prose(1, 120).split(), []
    for k in range(40):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 5])):
            w[r.randrange(120)] = f"w{r.random()}"
        node, packed = neardup.packed(" ".join(w) + " a a a a a a a" * (k % 5 == 0), weights)
        rows.append((node, node, packed))

    def joined(pairs):
        root = {x[0]: x[0] for x in rows}

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in pairs:
            root[find(a)] = find(b)
        return [[find(x[0]) == find(y[0]) for x in rows] for y in rows]

    links = neardup._linked(0, rows[:20], rows, 0.8, columns=64, block=7)
    plain = [(a[0], b[0]) for a in rows[:20] for b in rows if a[0] != b[0] and neardup.similarity(a[2], b[2]) >= 0.8]
    assert joined(links) == joined(plain) and 0 < len(links) <= len(plain)


def test_one_of_each_group_stays(spark, docs, no_docs):
    out = neardup.deduplicate(docs)
    assert out.schema == docs.schema
    kept = [r.doc_id for r in out.collect()]
    assert kept.count(5) == 1 and 6 not in kept and 100 not in kept and 102 not in kept and {0, 1, 2, 3, 4, 7, 8, 9} <= set(kept) and None in kept
    assert neardup.deduplicate(no_docs).collect() == [] and neardup.classes(no_docs).collect() == []


def test_samples_agree_as_often_as_sets_are_similar():
    level = lambda x: (x >> np.uint64(20)).astype(np.int64) % 6 + 10
    off = []
    for seed in range(40):
        s = np.sort(np.random.default_rng(seed).integers(0, 1 << 62, 4000, dtype=np.uint64))
        a, b = s[:3000], s[600:]
        got = np.mean(neardup.samples(a, level(a), np.array([0])) == neardup.samples(b, level(b), np.array([0])))
        w = np.exp(neardup.STEP * level(s))
        off.append(got - w[600:3000].sum() / w[:4000].sum())
    assert abs(np.mean(off)) < 0.04


def test_null_and_clashing_ids_are_linked_by_row(spark):
    base = prose(41, 200).split()

    def near(k):
        w = list(base)
        w[k] = "changed"
        return " ".join(w)

    rows = [(None, near(5)), (None, near(50)), (1, near(90)), (5, near(120)), (5, prose(42, 80)), (5, prose(42, 80)), (None, prose(43, 80)), (None, None), (6, near(3) + " " + prose(44, 9000)), (7, near(4) + " " + prose(44, 9000))]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, mark int").repartition(3)
    got = Counter((r.doc_id, r.class_id) for r in neardup.classes(df).collect())
    assert got == Counter({(None, 1): 2, (1, 1): 1, (5, 1): 1, (5, 5): 2, (None, None): 2, (6, 6): 1, (7, 6): 1})
    kept = neardup.deduplicate(df)
    assert kept.schema == df.schema and sorted(((r.doc_id or 0), (r.text or "")[:30]) for r in kept.collect()) == sorted([(1, near(90)[:30]), (5, prose(42, 80)[:30]), (0, prose(43, 80)[:30]), (0, ""), (6, near(3)[:30])])


@pytest.mark.parametrize("cell", [1 << 20, 3000])
def test_members_meet_in_cells_of_any_size(spark, cell):
    rows = [(k % 2, f"n{k}".encode(), b"r0" if k % 3 else f"n{k}".encode(), k % 3 == 0, bytes(300)) for k in range(60)]
    df = spark.createDataFrame(rows, "key long, node binary, root binary, out boolean, value binary")
    got = neardup._met(df, lambda key, left, right: [(key, x[0], y[0]) for x in left for y in right], "key long, a binary, b binary", cell).collect()
    want = Counter((k, a, b) for k, a, _, out, _ in rows if out for j, b, *_ in rows if j == k)
    assert Counter((r.key, bytes(r.a), bytes(r.b)) for r in got) == want


def test_members_are_named_once():
    rows = [(f"n{k}".encode(), f"n{k}".encode(), np.full(48, k % 3, np.uint16).tobytes()) for k in range(40)]
    got = neardup._alike(7, rows[:20], rows, 24)
    assert sorted(got) == sorted((7, r[0]) for r in rows)
    assert neardup._alike(7, rows[:1], rows[:2], 24) == [] and neardup.agreeing(0.8) == 24


def test_components_of_chains_and_stars(spark):
    pairs = [(f"a{i}", f"a{i + 1}") for i in range(30)] + [("b0", f"b{i}") for i in range(1, 40)] + [("c1", "c2"), ("c2", "c1"), ("d", "d")]
    df = spark.createDataFrame([(a.encode(), b.encode()) for a, b in pairs], "a binary, b binary")
    got = {bytes(r.node).decode(): bytes(r.root).decode() for r in neardup.components(df).collect()}
    assert {v for k, v in got.items() if k[0] == "a"} == {"a0"} and {v for k, v in got.items() if k[0] == "b"} == {"b0"} and got["c2"] == "c1" and len(got) == 31 + 40 + 2


def test_the_copy_that_stays_is_the_same_however_rows_lie(spark):
    rows = [(1, prose(1, 50), lang, n) for lang in ("b", "a", None) for n in (2, 1)] + [(2, prose(2, 50), "x", 0)]
    for parts in (1, 3, 6):
        df = spark.createDataFrame(random.Random(parts).sample(rows, len(rows)), "doc_id long, text string, lang string, n int").repartition(parts)
        assert {(r.doc_id, r.lang, r.n) for r in neardup.deduplicate(df).collect()} == {(1, "a", 1), (2, "x", 0)}
