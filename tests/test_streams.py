"""Verification of all stages on a stream, conversations from turns in any order, and splits written in seeded order."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from corvane.functions.labels import hash_order
from corvane.operators import repl, verify
from corvane.sources import sinks
from corvane.streaming import conversations as C
from corvane.streaming import verify as S
from corvane.streaming.append import AppendLog

TURNS = "conv_id long, turn long, role string, text string, last boolean, at timestamp"


def _run(spark, tmp_path, batches, wait=100, delay="0 seconds"):
    """Results of the batches of (conv_id, turn, last, second), one micro-batch each."""
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        text = "".join(json.dumps({"conv_id": c, "turn": t, "role": "user" if (t or 0) % 2 == 0 else "assistant", "text": f"{c}.{t}.{s}", "last": last, "at": f"2024-01-01T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}Z"}) + "\n" for c, t, last, s in rows)
        done = folder / f"{len(list(folder.iterdir())):03d}.json"
        done.write_text(text)
        stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).json(str(folder))
        S.run_available(C.assembled(stream, wait, delay), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.schema(C.RESULT).parquet(str(tmp_path / "out")).collect()
    return sorted(((r.conv_id, r.complete, [m.turn for m in r.messages], [m.content.split(".")[2] for m in r.messages]) for r in rows), key=str)


def test_conversations_close_on_their_last_turn_or_by_time(spark, tmp_path):
    got = _run(spark, tmp_path, [
        [(1, 2, True, 1000), (1, 0, False, 1001), (2, 0, False, 1000), (3, 0, True, 1000), (None, 0, True, 1000), (5, None, True, 1000), (6, 1, False, 1000)],
        [(1, 1, False, 1002), (1, 1, False, 1003), (3, 0, True, 1002), (2, 0, False, 1003), (4, 1, True, 1003), (6, 0, False, 1003)],  # 3 again: it was given
        [(9, 0, False, 2000)],  # time goes on: 2, 4 and 6 are given as they are
        [(9, 1, True, 2001)],
        [(4, 0, False, 5000)],  # after two waits 4 is new
        [(8, 0, True, 9000)],
        [(8, 0, True, 9001)],
    ])
    closed = {(c, ok): turns for c, ok, turns, _ in got}
    assert closed[1, True] == [0, 1, 2] and closed[3, True] == [0] and closed[2, False] == [0] and closed[6, False] == [0, 1] and closed[9, True] == [0, 1] and closed[8, True] == [0]
    assert sorted((c, ok, t) for c, ok, t, _ in got if c == 4) == [(4, False, [0]), (4, False, [1])]
    assert [c for c, *_ in got].count(1) == [c for c, *_ in got].count(3) == 1 and {c for c, *_ in got} == {1, 2, 3, 4, 6, 8, 9}
    assert next(said for c, _, _, said in got if c == 1) == ["1001", "1002", "1000"]  # of equal turns the first that came stays


SAID = "array<struct<role:string,content:string>>"


def _trajectories(spark):
    def one(i):
        tool = ("read_file", "ping", "unknown")[i % 3]
        code = "print(tools_registry.count())" if i % 4 else "import os"
        said = [("system", "p"), ("user", f"q{i}"), ("assistant", f"<code>{code}</code>"), ("user", "[REPL OUTPUT]:\nold"), ("assistant", 'FINAL({"tool": "%s", "params": {"k": %d}})' % (tool, i % 2))]
        return (f"t{i}", "r", f"q{i % 5}", tool, 1, said[: 3 if i % 7 == 0 else 5])

    return spark.createDataFrame([one(i) for i in range(60)], f"traj_id string, registry string, query string, correct_tool string, turns int, messages {SAID}")


def _tables(spark):
    tools = spark.createDataFrame([("r", 0, "read_file", "d", None, "{}", ["k"]), ("r", 1, "ping", "d", None, "{}", [])], "registry string, pos long, name string, description string, category string, schema string, required array<string>")
    expected = spark.createDataFrame([("q1", 0, '{"k": 5}'), ("q1", 1, '{"k": 1}'), ("q2", 0, "{}")], "query string, ord int, expected_params string")
    return tools, expected, spark.createDataFrame([("t1", False), ("t2", True)], "traj_id string, passed boolean")


def test_stream_gives_what_verification_gives(spark, tmp_path):
    rows, tables = _trajectories(spark), _tables(spark)
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    want = sorted((r.traj_id, r.reject_stage, r.reject_reason, str(r.messages)) for r in verify.verify(repl.executed(rows, tables[0]), *tables).collect())
    assert {stage for _, stage, *_ in want} == {None, 1, 2, 3}
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    assert S.append_verified(stream(), out, *tables) == 60 == S.append_verified(stream(), out, *tables)
    log = AppendLog(spark, out)
    got = log.read(f"traj_id string, reject_stage int, reject_reason string, messages {SAID}").collect()
    assert sorted((r.traj_id, r.reject_stage, r.reject_reason, str(r.messages)) for r in got) == want and len(log.commits()) == 3
    ready = repl.executed(rows, tables[0])
    ready.write.parquet(str(tmp_path / "ready"))
    whole = S.verified_whole(spark.readStream.schema(ready.schema).parquet(str(tmp_path / "ready")), *tables)
    S.run_available(whole, str(tmp_path / "whole"), str(tmp_path / "state")).awaitTermination()
    assert sorted((r.traj_id, r.reject_stage, r.reject_reason, str(r.messages)) for r in spark.read.parquet(str(tmp_path / "whole")).collect()) == want


@pytest.mark.parametrize("files", [1, 8])
def test_split_files_come_in_seeded_order(spark, tmp_path, files):
    rows = spark.createDataFrame([(i, f"q{i % 50}", ("train", "dev", "test")[min(2, i % 10)]) for i in range(400)], "ord int, query string, split string")
    sinks.write_splits(rows.repartition(files), rows.select("query", "split").distinct(), str(tmp_path), files=files)
    want = {}
    for r in rows.withColumn("_o", hash_order(42, F.to_json(F.struct("ord", "query", "split")))).orderBy("_o").collect():
        want.setdefault(r.split, []).append(r.ord)
    for split, ords in want.items():
        said = sorted(glob.glob(f"{tmp_path}/rows/split={split}/*.json"))
        assert [json.loads(line)["ord"] for f in said for line in open(f)] == ords != sorted(ords)
        assert len(said) == 1 or files > 1
    assert len(glob.glob(f"{tmp_path}/rows/*/*.json")) >= files
