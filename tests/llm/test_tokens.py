"""BPE by tree concatenation against the library, packing, and language-model scoring."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from corvane.llm import bpe, hmm, packing


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary)


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def test_any_text_as_the_library(vocabulary, library):
    encoder, r = bpe.load(vocabulary), random.Random(2)
    letters = "abcdeABC   '''!!.<|>_0123éèñßΣİ́\x1c\x85\n\t中文\U0001f600ﬁ"
    for _ in range(2000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 40))) + r.choice(["", "<|endoftext|>a", "'re", "'LL x"])
        want = library.encode(t, add_special_tokens=False).ids
        assert ids_of(encoder, t) == want
        assert encoder.decode(want) == library.decode(want, skip_special_tokens=False)


def test_halves_of_runs_and_texts(vocabulary, library):
    encoder, r = bpe.WordBpe(vocabulary, long_run=8), random.Random(3)
    for _ in range(600):
        run = "".join(r.choice(r.choice(["abcdefghijklmnopqrstuvwxyz", "ab", "etaoin", "!?.-", "éèaß中"])) for _ in range(r.randint(9, 300)))
        assert ids_of(encoder, run) == library.encode(run, add_special_tokens=False).ids
        text = run[:60] + " the " + run[60:].replace("a", " ") + " <|endoftext|>x"
        size = r.choice([2, 5, 16])
        leaves = [(text[k : k + size], encoder.encode(text[k : k + size])) for k in range(0, len(text), size)]
        assert np.frombuffer(encoder.join_all(leaves), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(12))
def test_cut_runs_are_joined_by_windows(vocabulary, library, seed):
    """Long runs of letters cut into leaves: the same ids as in one go, and few letters encoded anew."""
    encoder, r = bpe.WordBpe(vocabulary, long_run=16), random.Random(seed)
    run = lambda: "".join(r.choice(r.choice(["abcdefghijklmnopqrstuvwxyz", "ab", "etaoin", "AbC", "aaaa"])) for _ in range(r.randint(17, 500)))
    text = r.choice(["", "x ", "a'", "é", "7", "<|"]) + run() + r.choice(["", " ", "'s", "\u0301", ".", "|>", "é"]) + run() + r.choice(["", "!", " end"])
    want = library.encode(text, add_special_tokens=False).ids
    for size in (3, 20, 57, 200):
        leaves = [(text[k : k + size], encoder.encode(text[k : k + size])) for k in range(0, len(text), size)]
        assert np.frombuffer(encoder.join_all(leaves), "<u4").tolist() == want


def test_joining_a_long_run_is_cheaper_than_encoding_it(vocabulary, library):
    encoder, r = bpe.WordBpe(vocabulary), random.Random(1)
    text = "".join(r.choice("etaoinshrdlucmfwyp") for _ in range(300_000))
    leaves = [(text[k : k + bpe.LEAF], encoder.encode(text[k : k + bpe.LEAF])) for k in range(0, len(text), bpe.LEAF)]
    done, direct = [], encoder._direct
    encoder._direct = lambda run, last: done.append(len(run)) or direct(run, last)
    got = encoder.join_all(leaves)
    assert sum(done) < len(text) / 100
    assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [64, bpe.LEAF])
def test_digest_contract(docs, no_docs, vocabulary, library, leaf):
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digest(docs, vocabulary, leaf).collect())) == want
    assert bpe.digest(no_docs, vocabulary).collect() == []


def test_encode_then_decode(docs, vocabulary, library):
    got = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == library.decode(library.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False)


def test_packing(docs, no_docs, vocabulary, library):
    got = packing.best_fit(docs, vocabulary).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want[r.doc_id, k // 4096, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    check_sequences(got)
    assert packing.best_fit(no_docs, vocabulary).collect() == []


@pytest.mark.parametrize("group", [7, 500_000])
def test_ranks_in_groups_of_any_size(spark, group):
    r = random.Random(6)
    rows = [(i // 3, i % 3, 0, r.choice([4096, 4096, 1, 2000, r.randint(1, 4095)]), i) for i in range(900)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(5).cache()
    got = packing.pack_pieces(cut, group=group).collect()
    assert Counter(tuple(x)[:5] for x in got) == Counter(rows)
    least = math.ceil(sum(x[3] for x in rows) / 4096)
    assert least <= check_sequences(got) <= 1.05 * least + 1
    assert packing.pack_pieces(cut.where("length = 4096"), group=group).select("sequence_id").distinct().count() == sum(x[3] == 4096 for x in rows)


def check_sequences(rows, size=4096):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= size
    return len(by)


def test_plan_is_near_the_least():
    rng = np.random.default_rng(0)
    for _ in range(20):
        counts = Counter(rng.integers(1, rng.integers(2, 4097), 2000).tolist())
        rows, n = packing.plan(counts)
        least = math.ceil(sum(k * v for k, v in counts.items()) / 4096)
        assert least <= n <= 1.03 * least + 1
        assert sum(hi - lo for _, lo, hi, *_ in rows) == 2000
    assert packing.plan({}) == ([], 0)


def test_scores_against_plain_counts(docs, no_docs):
    got = hmm.score(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    tokens = [(r.doc_id, zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2, (r.text or "").encode().lower().split() + [b""]) for r in rows]
    c = Counter(w for _, held, ws in tokens if not held for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, held, ws in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.score(no_docs).collect() == []


def test_only_held_out_rows(docs):
    held = docs.where("doc_id = 2").limit(1)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
    from pyspark.sql import functions as F

    row = hmm.score(held.withColumn("doc_id", F.lit(ids[0]).cast("long"))).head()
    assert row.train_tokens == 0 and row.n_known == 0 and np.isfinite(row.score)


def small_model(rng, states=3, classes=5):
    return hmm.Hmm(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(classes), states).T)


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(4)
    model = small_model(rng)
    docs = [rng.integers(0, 5, n) for n in (1, 4, 2, 6, 3)]
    for d, got in zip(docs, model.likelihood(docs), strict=True):
        total = sum(model.begin[p[0]] * np.prod([model.move[a, b] for a, b in itertools.pairwise(p)]) * np.prod([model.emit[x, s] for x, s in zip(d, p, strict=True)]) for p in itertools.product(range(3), repeat=len(d)))
        assert np.isclose(got, np.log10(total))


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 5, rng.integers(1, 40)) // (1 + i % 2) for i in range(60)]
    model, before = small_model(rng), -np.inf
    for _ in range(6):
        begin, move, emit, log = model.expect(docs)
        assert np.isclose(emit.sum(), sum(map(len, docs)), rtol=1e-4) and np.isclose(begin.sum(), len(docs), rtol=1e-4)
        assert np.isclose(log, model.likelihood(docs).sum() * np.log(10), rtol=1e-4)
        assert log > before - 1e-3
        before, model = log, hmm.Hmm(begin / begin.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
