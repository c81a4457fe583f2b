"""Queries over whole tables: on rows made here."""

import hashlib
import re

import duckdb
import pytest

from corvane.config import STOP_WORDS
from corvane.plans import catalogue
from corvane.plans.views import Views


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    con = duckdb.connect()
    made = {
        "orders": "SELECT range AS o_orderkey FROM range(1, 6001)",
        "part": "SELECT range AS p_partkey, 'Brand#' || range % 3 AS p_brand, ['red', 'blue', 'old'][1 + range // 3 % 3] || ' ' || ['gear', 'bolt', 'cog', 'nut'][1 + range // 9 % 4] AS p_name, ['LARGE red', 'SMALL gear'][1 + range % 2] AS p_type, range % 7 AS p_size FROM range(60)",
        "documents": "SELECT range AS doc_id, CASE WHEN range % 30 = 7 THEN 'see item ' || range || ' here' ELSE 'plain ' || range END AS text, 'en' AS lang, 'src' || range % 2 AS source, 20 + range % 3 AS n_chars FROM range(300)",
        "benchmark": "SELECT * FROM (VALUES (1, 'item 7 '), (2, 'item 67 '), (3, 'plain 11'), (4, ''), (5, NULL)) t(item_id, text)",
    }
    for name, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{base}/{name}.parquet'")
    return str(base)


def test_adapter_takes_every_order(spark, tables):
    got = catalogue.QUERIES["adapter_funnel"](spark, tables).collect()
    assert sum(r.n_entries for r in got) == 6000
    assert catalogue.QUERIES["adapter_call_params"](spark, tables).where("n > 3000").count() > 0


def test_benchmark_is_sealed(spark, tables):
    run = lambda name: catalogue.QUERIES[name](spark, tables)
    want = {7, 67, 11} | set(range(110, 120))
    assert {r.ord for r in run("split_sealed_contains").collect()} == want
    assert {r.ord for r in run("split_sealed_exact").collect()} == {11}
    assert {r.ord for r in run("split_without_overlap").collect()} == set(range(300)) - want
    assert run("split_leakage_check").head().n == 0
    split = {r.query: r.split for r in run("split_assign").collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert {split[md5(t)] for t in ("see item 7 here", "see item 67 here", "plain 11", "plain 113")} == {"test"}


def test_every_tool_is_asked_about(spark, tables):
    """Against brute force: each other tool of the registry, scored by the words that it shares."""
    tools = [(r.registry, r.pos, r.name, r.description) for r in Views(spark, tables).tools().orderBy("pos").collect()]
    words = lambda text: set(re.findall("[a-z]{3,}", text.lower())) - set(STOP_WORDS)
    first = {}
    for registry, _, name, said in tools:
        first.setdefault((registry, name), said)
    assert len(first) == 36
    want = {
        (f"{registry}|{name}", other, pos): 2 * len(words(f"{other} {d}") & set(re.findall("[a-z]{3,}", f"please find a {said}".lower()))) - len(words(f"{other} {d}") & words(f"{name} {said}"))
        for (registry, name), said in first.items() for r, pos, other, d in tools if r == registry and other != name
    }
    run = lambda name: catalogue.QUERIES[name](spark, tables)
    assert {(r.traj_id, r.name, r.pos): r.score for r in run("neg_candidate_scores").collect()} == want
    best = {t: [k[1:] for k in sorted((k for k in want if k[0] == t), key=lambda k: (-want[k], k[2]))[:3]] for t in {k[0] for k in want}}
    got = {}
    for r in run("neg_top3").orderBy("rank").collect():
        got.setdefault(r.traj_id, []).append((r.name, r.pos))
    assert got == best
    wrong = {r.traj_id: r.wrong_tool for r in run("neg_wrong_tool_pairs").collect()}
    assert set(wrong) == set(best) and all(w in [n for n, _ in best[t]] for t, w in wrong.items())
    assert {r.negative_type: r.n for r in run("neg_type_counts").collect()} == {"wrong_tool": 36, "wrong_param": 36}
    assert run("neg_target_limit").count() == 9
