"""Commands from files to files."""

import json

import pytest

from corvane.__main__ import main

TOOLS = [{"name": n, "description": f"does {n}", "inputSchema": {"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"]}} for n in ("get_rain", "get_wind", "put_file", "ask_user", "end_call")]
PROMPT = "Choose of {num_tools} tools with <code> blocks."


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def said(tool, code='print(tools_registry.search("rain"))'):
    block = f"THOUGHT\n<code>\n{code}\n</code>"
    return [{"role": "system", "content": "<code>"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": block}, {"role": "user", "content": "[REPL OUTPUT]:\nold"}, {"role": "assistant", "content": f'FINAL({{"tool": "{tool}", "params": {{"k": 1}}}})'}]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    base = tmp_path_factory.mktemp("cli")
    (base / "small.json").write_text(json.dumps(TOOLS[:3]))
    (base / "large.json").write_text(json.dumps({"tools": TOOLS}))
    (base / "queries.json").write_text(json.dumps([{"query": "q1"}, {"query": "q2"}]))
    (base / "truth.json").write_text(json.dumps([{"query": "q1", "expected_tool": "get_rain"}, {"query": "q2", "expected_tool": "end_call"}]))
    (base / "prompt.txt").write_text(PROMPT)
    lines(base / "answers.jsonl", [{"level": 1, "registry": r, "query": q, "predicted_tool": "get_rain", "predicted_params": "{}", "code_validity": 1.0, "turns_used": 2, "success": True, "elapsed_seconds": 1.0} for r in ("small", "large") for q in ("q1", "q2")])
    rows = [{"traj_id": f"t{i}", "query": f"q{i}", "correct_tool": t, "registry": "small", "turns": 1, "messages": said(t)} for i, t in enumerate(["get_rain", "get_wind", "nothing"])]
    lines(base / "rows.jsonl", rows)
    return base


def test_evaluate_and_matrix(spark, files):
    given = ["--registries", f"{files}/{{small,large}}.json", "--queries", f"{files}/queries.json", "--truth", f"{files}/truth.json", "--answers", f"{files}/answers.jsonl"]
    main(["evaluate", *given, "--level", "1", "--registry", "large", "--output", f"{files}/e"], spark)
    one = json.loads(spark.read.text(f"{files}/e", wholetext=True).head().value)
    assert one["metrics"]["tool_selection_accuracy"] == 0.5 and len(one["results"]) == 2
    main(["matrix", *given, "--output", f"{files}/m"], spark)
    cells = json.loads(spark.read.text(f"{files}/m", wholetext=True).head().value)
    assert {k: v["total_queries"] for k, v in cells.items()} == {"level1_small": 1, "level1_large": 2}


def test_ground_and_verify(spark, files):
    raw = 'I look.\n<code>\nprint(tools_registry.search("rain"))\n</code>\nFINAL({"tool": "get_rain", "params": {"k": 1}})'
    replies = lines(files / "replies.jsonl", [{"traj_id": "a", "registry": "small", "query": "q", "raw": raw}])
    main(["ground", "--registries", f"{files}/small.json", "--replies", replies, "--prompt", f"{files}/prompt.txt", "--output", f"{files}/g"], spark)
    row = spark.read.json(f"{files}/g").head()
    assert row.predicted_tool == "get_rain" and "get_rain" in row.messages[3].content
    main(["verify", "--input", f"{files}/rows.jsonl", "--registries", f"{files}/small.json", "--output", f"{files}/v"], spark)
    out = {r.traj_id: r.reject_reason for r in spark.read.json(f"{files}/v").collect()}
    assert out == {"t0": None, "t1": None, "t2": "tool is not in the registry"}


def test_adapt(spark, files):
    tool = lambda n: {"type": "function", "function": {"name": f"srv-{n}", "description": "d", "parameters": {"type": "object"}}}
    call = json.dumps([{"role": "tool_call", "content": str({"name": "srv-a", "arguments": '{"n": 1}'})}])
    entries = [{"uuid": f"u{i}", "subset_name": "x", "question": "do a", "target_tools": "S::a", "tools": json.dumps([tool(n) for n in "abcde"]), "messages": call} for i in range(6)]
    main(["adapt", "--input", lines(files / "entries.jsonl", entries), "--max-examples", "4", "--output", f"{files}/a"], spark)
    made = spark.read.json(f"{files}/a").collect()
    assert len(made) == 4 and all(len(r.messages) == 7 for r in made)


def test_augment_negatives_split(spark, files):
    both = f"{files}/{{small,large}}.json"
    main(["augment", "--input", f"{files}/rows.jsonl", "--registries", both, "--order", "small", "large", "--output", f"{files}/u"], spark)
    stages = {r.stage for r in spark.read.json(f"{files}/u").collect()}
    assert stages == {0, 1, 2, 3}
    main(["negatives", "--positives", f"{files}/rows.jsonl", "--registries", f"{files}/small.json", "--target", "4", "--output", f"{files}/n"], spark)
    assert spark.read.json(f"{files}/n").count() == 4
    sealed = files / "sealed.json"
    sealed.write_text(json.dumps([{"query": " q1 "}]))
    main(["split", "--inputs", f"{files}/rows.jsonl", "--sealed", str(sealed), "--output", f"{files}/s"], spark)
    assert {r.query: r.split for r in spark.read.json(f"{files}/s/rows").collect()} == {"q0": "train", "q1": "test", "q2": "train"}


def test_cases_without_an_answer_count_as_failed(spark, files):
    lines(files / "few.jsonl", [{"level": 1, "registry": "large", "query": "q1", "predicted_tool": "get_rain", "predicted_params": "{}", "code_validity": 1.0, "turns_used": 2, "success": True, "elapsed_seconds": 1.0}])
    given = ["--registries", f"{files}/{{small,large}}.json", "--queries", f"{files}/queries.json", "--truth", f"{files}/truth.json", "--answers", f"{files}/few.jsonl"]
    main(["evaluate", *given, "--level", "1", "--registry", "large", "--output", f"{files}/e2"], spark)
    one = json.loads(spark.read.text(f"{files}/e2", wholetext=True).head().value)
    main(["matrix", *given, "--output", f"{files}/m2"], spark)
    cell = json.loads(spark.read.text(f"{files}/m2", wholetext=True).head().value)["level1_large"]
    main(["evaluate", *given, "--level", "1", "--registry", "large", "--rows", "--output", f"{files}/e3"], spark)
    assert spark.read.json(f"{files}/e3/results").count() == 2 and spark.read.json(f"{files}/e3/metrics").head().failure_rate == 0.5
    assert one["metrics"]["total_queries"] == 2 and one["metrics"]["failure_rate"] == 0.5 and {k: cell[k] for k in one["metrics"]} == one["metrics"]


def test_limits_from_settings(spark, files):
    (files / "limits.yaml").write_text("repl:\n  level_1:\n    max_turns: 0\n")
    main(["verify", "--input", f"{files}/rows.jsonl", "--registries", f"{files}/small.json", "--config", f"{files}/limits.yaml", "--output", f"{files}/v2"], spark)
    assert {r.reject_reason for r in spark.read.json(f"{files}/v2").collect()} == {"code error rate too high: 1/1"}


def test_adapt_a_dataset(spark, files):
    tool = lambda n: {"type": "function", "function": {"name": f"srv-{n}", "description": "d", "parameters": {"type": "object"}}}
    folder = files / "dataset"
    folder.mkdir()
    lines(folder / "a.jsonl", [{"uuid": f"u{i}", "subset_name": "x", "question": "do a", "target_tools": "S::a", "tools": json.dumps([tool(n) for n in "abcde"]), "messages": "[]"} for i in range(30)])
    for _ in range(2):
        main(["adapt", "--dataset", str(folder), "--max-examples", "7", "--output", f"{files}/ad"], spark)
    assert spark.read.parquet(f"{files}/ad/data").count() == 7
