"""The dataset as a shuffled stream, and appending it batch by batch."""

import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corvane.sources.dataset import ShuffledDataset, shuffled
from corvane.streaming.adapt import adapted, entries
from corvane.streaming.append import AppendLog

DDL = "uuid string, n long, missing string"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three Parquet files of several row groups, one with a column less, a JSONL file, and files that don't count."""
    base = tmp_path_factory.mktemp("dataset")
    for i in range(3):
        rows = [{"uuid": f"p{i}-{j}", "n": 1000 * i + j, "other": None} for j in range(250)]
        t = pa.Table.from_pylist(rows, schema=pa.schema([("uuid", pa.string()), ("n", pa.int32()), ("other", pa.string())]))
        pq.write_table(t.drop_columns("n") if i == 2 else t, base / f"part-{i}.parquet", row_group_size=100)
    (base / "more.jsonl").write_text("\n\n".join(json.dumps({"uuid": f"j-{j}", "n": j, "x": [j]}) for j in range(90)) + "\n")
    (base / "_SUCCESS").write_text("")
    (base / ".part.parquet.crc").write_text("x")
    (base / "readme.txt").write_text("not data")
    return str(base)


def _read(spark, folder, ddl=DDL, **options):
    rows = entries(spark, folder, ddl, stream=False, **options).collect()
    return sorted((r._position, r.uuid, r.n) for r in rows)


def test_order_is_the_same_for_any_partitions(spark, folder):
    one = _read(spark, folder, partitions=1, buffer=64)
    assert len(one) == 840 and [p for p, *_ in one] == list(range(840))
    assert _read(spark, folder, partitions=5, buffer=64) == one == _read(spark, "file:" + folder, partitions=99, buffer=64)
    other = _read(spark, folder, seed=7, buffer=64)
    assert other != one and sorted(u for _, u, _ in other) == sorted(u for _, u, _ in one)
    uuids = [u for _, u, _ in one]
    assert uuids != sorted(uuids) and {u for u in uuids if u.startswith("j")} == {f"j-{i}" for i in range(90)}
    assert all(n is None for _, u, n in one if u.startswith("p2")) and all(n is not None for _, u, n in one if not u.startswith("p2"))


@pytest.mark.parametrize("limit", [0, 1, 99, 130, 839, 5000])
def test_limit_takes_the_first_rows(spark, folder, limit):
    assert _read(spark, folder, limit=limit, buffer=64) == _read(spark, folder, buffer=64)[:limit]


def test_groups_beyond_a_limit_are_not_planned(spark, folder):
    reader = ShuffledDataset({"path": folder, "limit": "120", "buffer": "10"}).reader(spark.range(0).selectExpr("CAST(NULL AS string) AS uuid").schema)
    parts = [s for p in reader.partitions() for s in p.parts]
    assert sum(s.take for s in parts) == 120 and len(parts) <= 3


def test_without_places_nothing_is_counted(spark, folder):
    spark.dataSource.register(ShuffledDataset)
    got = spark.read.format("shuffled").schema("uuid string").load(folder)
    assert got.count() == 840 and got.distinct().count() == 840


def test_one_file_no_file_and_no_schema(spark, folder, tmp_path):
    assert len(_read(spark, f"{folder}/part-0.parquet")) == 250
    assert _read(spark, str(tmp_path / "none")) == []
    with pytest.raises(Exception, match="name the columns"):
        spark.read.format("shuffled").load(folder)


@pytest.mark.parametrize("buffer", [1, 2, 7, 50, 1000])
def test_buffer_is_bounded_and_cuts_do_not_matter(buffer):
    whole = pa.table({"x": list(range(300))})

    def cut(seed):
        r, at = random.Random(seed), 0
        while at < 300:
            n = r.randint(1, 40)
            yield whole.slice(at, n)
            at += n

    runs = [[x for t in shuffled(cut(seed), buffer, 5) for x in t.column("x").to_pylist()] for seed in (1, 2)]
    assert runs[0] == runs[1] and sorted(runs[0]) == list(range(300))
    # A row leaves at most `buffer` rows before its own place: only what came in could go out.
    assert all(x <= i + buffer + 1 for i, x in enumerate(runs[0])) and (buffer > 2 or runs[0] == list(range(300)) or buffer == 2)


def _stream(spark, folder, out, limit=None, rows=100):
    return entries(spark, folder, DDL, rows_per_batch=rows, buffer=64, progress=f"{out}/progress.json", limit=limit)


def test_stopped_and_started_again_gives_each_row_once(spark, folder, tmp_path):
    out, log = str(tmp_path), AppendLog(spark, str(tmp_path))
    seen = []

    def breaks(df, left):
        if len(seen) == 3:
            seen.append(None)
            raise RuntimeError("lost")
        seen.append(df.count())
        return df

    with pytest.raises(Exception, match="lost"):
        log.run(_stream(spark, folder, out), f"{out}/checkpoint", breaks)
    assert log.total() == 300 and log.read(f"{DDL}, _position long").count() == 300
    assert log.run(_stream(spark, folder, out), f"{out}/checkpoint") == 840
    got = sorted((r._position, r.uuid, r.n) for r in log.read(f"{DDL}, _position long").collect())
    assert got == _read(spark, folder, buffer=64)
    assert [c["rows"] for c in log.commits().values()] == [100] * 8 + [40]
    assert log.run(_stream(spark, folder, out), f"{out}/checkpoint") == 840  # nothing left


def test_broken_attempts_leave_nothing(spark, tmp_path):
    log, df = AppendLog(spark, str(tmp_path)), spark.range(5)
    spark.range(99).write.parquet(f"{tmp_path}/data/batch=0")  # of an attempt that never was committed
    assert log.read("id long").count() == 0 and log.total() == 0
    assert log.append(0, df) and not log.append(0, spark.range(7)) and log.append(1, spark.range(0)) and log.append(2, lambda left: spark.range(left), most=8)
    assert not log.append(2, lambda left: 1 / 0, most=8) and log.append(3, lambda left: 1 / 0, most=8)
    assert log.read("id long").count() == 8 == log.total()


def test_other_files_are_an_error(spark, tmp_path):
    data, out = tmp_path / "data", str(tmp_path / "out")
    data.mkdir()
    pq.write_table(pa.table({"uuid": [str(i) for i in range(50)], "n": list(range(50))}), data / "a.parquet")
    log = AppendLog(spark, out)
    assert log.run(_stream(spark, str(data), out, rows=30), f"{out}/checkpoint") == 50
    pq.write_table(pa.table({"uuid": ["x"] * 60, "n": [1] * 60}), data / "b.parquet")
    with pytest.raises(Exception, match="have changed"):
        log.run(_stream(spark, str(data), out, rows=30), f"{out}/checkpoint")


def test_adapting_stops_at_enough_examples(spark, tmp_path):
    tools = json.dumps([{"type": "function", "function": {"name": f"srv-fn_{i}", "description": "d", "parameters": {"type": "object"}}} for i in range(6)])
    rows = [{"uuid": None if i % 9 == 0 else str(i // 2), "subset_name": "irrelevant" if i % 4 == 0 else "x", "question": '["one", "two"]', "target_tools": "S::fn_1, S::fn_2", "tools": tools,
             "messages": json.dumps([{"role": "tool_call", "content": str({"name": "srv-fn_1", "arguments": json.dumps({"n": i})})}])} for i in range(200)]
    data = tmp_path / "data"
    data.mkdir()
    pq.write_table(pa.Table.from_pylist(rows), data / "a.parquet", row_group_size=40)
    out = str(tmp_path / "out")
    assert adapted(spark, str(data), out, 100, rows_per_batch=25) == 100 == adapted(spark, str(data), out, 100, rows_per_batch=25)
    log = AppendLog(spark, out)
    got = log.read("uuid string, turn int, query string, params string, _position long").orderBy("_position", "turn").collect()
    places = [r._position for r in entries(spark, str(data), stream=False).where("subset_name <> 'irrelevant'").orderBy("_position").collect()]
    assert [(r._position, r.turn) for r in got] == [(p, t) for p in places for t in (0, 1)][:100]
    assert all((json.loads(r.params) == {}) == (r.turn == 1) for r in got)  # rows that share an uuid, or have none, keep their own call
    assert len(log.commits()) < 8  # the rest of the dataset wasn't read
    with pytest.raises(Exception, match="filled to its limit"):
        adapted(spark, str(data), out, 1000, rows_per_batch=25)
    assert adapted(spark, str(data), str(tmp_path / "all"), 1000, rows_per_batch=25) == 300
