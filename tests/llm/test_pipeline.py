"""The pipeline's stages, each against its operator applied plainly, and the whole against a version by brute force."""

import itertools
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from corvane.llm import lines, neardup, pii, pu
from corvane.llm.common import shared_path

from .conftest import prose
from .test_quality import plain_counts, plain_features
from .test_tokens import check_sequences


def best_tags(model, rows):
    gain = model.w[lines.binned(rows)].sum(1)
    value = lambda y: model.start[y[0]] + sum(g for g, v in zip(gain, y, strict=True) if v) + sum(model.trans[a, b] for a, b in itertools.pairwise(y))
    return max(itertools.product((0, 1), repeat=len(rows)), key=value)


def test_pipeline_against_brute_force(spark, vocabulary):
    """Row by row and pair by pair, with the models that the same rows train."""
    rows = [(i, prose(i, 40 + i % 30) + "\n" + prose(i + 500, 25)) for i in range(40)]
    rows += [(100 + i, rows[i][1].replace(rows[i][1].split()[9], "changed", 1)) for i in range(6)] + [(120, rows[3][1]), (121, None), (122, " \n "), (123, "### $$$ && | " * 40), (124, "x y z " * 60), (None, prose(77, 60)), (125, "mail joe.doe@mail.example.com or call +1 415 555 2671 " + prose(78, 40))]
    rows += [(130 + i, ("$$$ " if i % 2 else "!! ").join(prose(900 + i, 50).split())) for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(130 + i, 0, 0) for i in range(0, 12, 2)], "doc_id long, quality int, toxic int")
    folder = shared_path(spark, "tables")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    table = lambda some: spark.createDataFrame([(i, t) for i, t in some], "doc_id long, text string").repartition(2)

    model, kept = lines.train(docs, labels), []
    for i, t in rows:
        found = lines.line_rows((t or "").encode())
        n, _, _, _, repeated = plain_counts(t or "")
        if n >= 20 and 100 * repeated <= 30 * n and 2 * sum(r[0] for r, v in zip(found, best_tags(model, found), strict=True) if v == lines.CONTENT) >= n:
            kept.append((i, t))
    scorer = pu.train(table(kept), labels)
    good = [(i, t) for i, t in kept if scorer.score(np.array([plain_features(t)]))[0] >= 0.3]
    weights = neardup.document_frequencies(neardup.texts(table(good)))
    sets = [neardup.packed(t, weights)[1] for _, t in good]
    root = list(range(len(good)))
    for a in range(len(good)):
        for b in range(a):
            if neardup.similarity(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
                root = [root[b] if x == root[a] else x for x in root]
    single = [min((good[k] for k in range(len(good)) if root[k] == x), key=lambda d: (d[0] is None, d[0] or 0)) for x in sorted(set(root))]
    spans = pii.train(table(single))
    masked = [(i, pii.masked(t, pii.all_spans(t, pii.base_spans(t), spans))) for i, t in single]
    assert len(rows) > len(kept) > len(good) > len(masked) and any("[EMAIL]" in t for _, t in masked)

    library, want = Tokenizer.from_file(vocabulary), Counter()
    for i, t in masked:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    check_sequences(got)


def test_stages(spark, docs, labels):
    folder = shared_path(spark, "tables")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    now, columns = spark.read.parquet(f"{folder}/documents.parquet"), docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, folder).cache()
        kept[name] = now.count()
        if name != "best_fit_packing":
            assert now.columns == columns
        if name == "quality_rules":
            assert kept[name] == lines.quality_rules(before, labels).where("kept").count()
        if name == "quality_classifier":
            assert kept[name] == pu.quality_classifier(before, labels).where("predicted = 1").count()
        if name == "near_duplicates":
            assert now.select("doc_id").distinct().count() == kept[name] <= before.count()
        if name == "personal_data":
            assert now.where("text LIKE '%@mail.example.com%'").isEmpty() and kept[name] == before.count()
    assert check_sequences(now.collect()) >= 1
    assert corpus_pipeline.run(spark, folder).count() == kept["best_fit_packing"]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, no_docs, no_labels):
    folder = shared_path(spark, "tables")
    no_docs.write.parquet(f"{folder}/documents.parquet")
    no_labels.write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
