"""A dataset of Parquet or JSONL files as a shuffled stream of rows: a Python data source for batches and for streams.

The files' row groups (a JSONL file is one) come in the order of a hash of seed, file and group. Within a group rows pass a
shuffle buffer: once it is full, as many random rows leave as come in. That order is the dataset's order; it depends on seed,
buffer and files, but not on how many partitions read it, since each takes a stretch of it and a stretch that begins inside a
group draws that group's order from its start. A task holds `buffer` rows at most.

    spark.dataSource.register(ShuffledDataset)
    spark.read.format("shuffled").schema("uuid string, text string, _position long").option("limit", 1000).load(folder)

Options: seed (42), buffer (10,000 rows), partitions (8), limit (all); as a stream also rows_per_batch (all there is), and
progress, a file which tells a restarted stream how far batches had been planned. A column _position long, where the schema
has it, is the place in the dataset's order. Columns that a file lacks are null, others aren't read. A limit takes the first
rows of the order: no group beyond it is opened. Rows of Parquet groups are counted from metadata; JSONL files are counted by
reading, as far as a limit, a position or the batches of a stream need it. An empty folder gives no rows.

Paths are opened with pyarrow's file systems. A stream's files must stay as they are: offsets name a digest of the listing, and
another one is an error rather than another order.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.json
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

POSITION = "_position"
#: Bytes of a JSONL file that are parsed at once.
CHUNK = 8 << 20


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


class Group(NamedTuple):
    """A row group, or a whole JSONL file (group None)."""

    path: str
    group: int | None
    rows: int | None


class Stretch(NamedTuple):
    """`take` rows (None: all) of a group's order after `skip`; the first is row `position` of the dataset."""

    group: Group
    skip: int
    take: int | None
    position: int


class Stretches(InputPartition):
    def __init__(self, parts: list[Stretch]):
        self.parts = parts


def shuffled(batches: Iterator[pa.Table], buffer: int, seed: int) -> Iterator[pa.Table]:
    """The rows of all batches through a shuffle buffer; the same for any cut into batches."""
    pick, step = np.random.RandomState(seed), max(1, buffer // 2)
    held, waiting = None, None
    for batch in batches:
        waiting = batch if waiting is None else pa.concat_tables([waiting, batch])
        while waiting.num_rows >= step:
            new, waiting = waiting.slice(0, step), waiting.slice(step)
            pool = new if held is None else pa.concat_tables([held, new])
            if pool.num_rows + step <= buffer:
                held = pool
                continue
            order = pick.permutation(pool.num_rows)
            yield pool.take(order[:step])
            held = pool.take(order[step:]) if pool.num_rows > step else None
    last = [t for t in (held, waiting) if t is not None and t.num_rows]
    if last:
        pool = pa.concat_tables(last)
        yield pool.take(pick.permutation(pool.num_rows))


class _Dataset:
    """What batch and stream readers share."""

    def __init__(self, schema: StructType, options: dict):
        self.arrow = to_arrow_schema(schema)
        self.columns = [n for n in self.arrow.names if n != POSITION]
        self.path, self.seed = options["path"], str(options.get("seed", 42))
        self.buffer, self.parts = max(1, int(options.get("buffer", 10_000))), max(1, int(options.get("partitions", 8)))
        self.limit = int(options["limit"]) if options.get("limit") is not None else None

    def _hash(self, group: Group) -> bytes:
        return hashlib.md5(f"{self.seed}|{group.path.rpartition('/')[2]}|{group.group}|{group.path}".encode()).digest()

    def groups(self) -> list[Group]:
        """All groups in the dataset's order."""
        fs, root = opened(self.path)
        if fs.get_file_info(root).type == pyarrow.fs.FileType.File:
            files = [root]
        else:
            found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
            files = [f.path for f in found if f.type == pyarrow.fs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[len(root) :].split("/"))]
        out = []
        for f in files:
            if f.endswith(".parquet"):
                with fs.open_input_file(f) as opened_file:
                    meta = pq.ParquetFile(opened_file).metadata
                    out += [Group(f, g, meta.row_group(g).num_rows) for g in range(meta.num_row_groups)]
            elif f.endswith((".jsonl", ".json")):
                out.append(Group(f, None, None))
        return sorted(out, key=self._hash)

    def count(self, group: Group) -> int:
        return group.rows if group.rows is not None else sum(t.num_rows for t in self._tables(group, []))

    def _tables(self, group: Group, columns: list[str] | None = None) -> Iterator[pa.Table]:
        """The rows of a group as they stand, a bounded number at a time."""
        fs, columns = opened(self.path)[0], self.columns if columns is None else columns
        want = pa.schema([self.arrow.field(c) for c in columns])
        if group.group is not None:
            with fs.open_input_file(group.path) as f:
                file = pq.ParquetFile(f)
                have = [c for c in columns if c in file.schema_arrow.names]
                for batch in file.iter_batches(min(self.buffer, 8192), row_groups=[group.group], columns=have):
                    t = pa.Table.from_batches([batch])
                    arrays = [t.column(c).cast(want.field(c).type) if c in have else pa.nulls(t.num_rows, want.field(c).type) for c in columns]
                    yield pa.table(arrays, schema=want) if columns else t
            return
        with fs.open_input_stream(group.path) as f:
            rest = b""
            while data := f.read(CHUNK):
                head, mark, tail = (rest + data).rpartition(b"\n")
                rest = tail
                if mark and head.strip():
                    yield self._lines(head, want)
            if rest.strip():
                yield self._lines(rest, want)

    def _lines(self, text: bytes, want: pa.Schema) -> pa.Table:
        if not want.names:  # only the number of lines counts
            return pa.table({"n": pa.nulls(sum(1 for line in text.split(b"\n") if line.strip()))})
        parse = pyarrow.json.ParseOptions(explicit_schema=want, unexpected_field_behavior="ignore")
        return pyarrow.json.read_json(io.BytesIO(text), parse_options=parse, read_options=pyarrow.json.ReadOptions(block_size=len(text) + 1)).select(want.names)

    def read(self, partition: Stretches) -> Iterator[pa.RecordBatch]:
        for group, skip, take, position in partition.parts:
            at, until = 0, None if take is None else skip + take
            for t in shuffled(self._tables(group), self.buffer, int.from_bytes(self._hash(group)[:4], "big")):
                low, high = max(0, skip - at), t.num_rows if until is None else min(t.num_rows, until - at)
                if high > low:
                    part, first = t.slice(low, high - low), position + at + low - skip
                    arrays = [pa.array(np.arange(first, first + part.num_rows)) if c == POSITION else part.column(c) for c in self.arrow.names]
                    yield from pa.table(arrays, schema=self.arrow).combine_chunks().to_batches()
                at += t.num_rows
                if until is not None and at >= until:
                    break

    def between(self, low: int, high: int | None, groups: list[Group]) -> list[Stretch]:
        """Rows low to high of the order; groups after it aren't counted."""
        out, at = [], 0
        for g in groups:
            if high is not None and at >= high:
                break
            n = self.count(g)
            skip, end = max(0, low - at), n if high is None else min(n, high - at)
            if end > skip:
                out.append(Stretch(g._replace(rows=n), skip, end - skip, at + skip))
            at += n
        return out

    def dealt(self, stretches: list[Stretch]) -> list[Stretches]:
        """Stretches in about equal runs of whole ones, in order; an empty one if there is none."""
        n = max(1, min(self.parts, len(stretches)))
        return [Stretches(stretches[i * len(stretches) // n : (i + 1) * len(stretches) // n]) for i in range(n)]


class _Batch(_Dataset, DataSourceReader):
    def partitions(self) -> list[Stretches]:
        groups = self.groups()
        if self.limit is None and POSITION not in self.arrow.names:
            return self.dealt([Stretch(g, 0, None, 0) for g in groups])
        return self.dealt(self.between(0, self.limit, groups))


class _Stream(_Dataset, DataSourceStreamReader):
    """An offset is a number of rows of the order. The next one is rows_per_batch beyond the last batch that was planned;
    that is kept in the progress file before a batch runs, so that a restarted stream never looks behind its own start."""

    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.step = int(options["rows_per_batch"]) if options.get("rows_per_batch") else None
        self.progress, self.planned = options.get("progress"), None
        self._groups, self._total = None, None

    def _listing(self) -> tuple[list[Group], str]:
        if self._groups is None:
            self._groups = [g._replace(rows=self.count(g)) for g in self.groups()]
            self._total = sum(g.rows for g in self._groups)
            self._total = self._total if self.limit is None else min(self._total, self.limit)
        return self._groups, hashlib.md5(repr([self.seed, self.buffer, *self._groups]).encode()).hexdigest()

    def _offset(self, rows: int) -> dict:
        return {"rows": rows, "files": self._listing()[1]}

    def initialOffset(self) -> dict:
        self.planned = 0
        return self._offset(0)

    def latestOffset(self) -> dict:
        self._listing()
        if self.planned is None:
            if not self.progress:
                raise ValueError("a stream that is started again needs the option progress")
            fs, path = opened(self.progress)
            if fs.get_file_info(path).type == pyarrow.fs.FileType.File:
                with fs.open_input_stream(path) as f:
                    self.planned = json.loads(f.read())["rows"]
            else:
                self.planned = 0
        return self._offset(self._total if self.step is None else min(self._total, self.planned + self.step))

    def partitions(self, start: dict, end: dict) -> list[Stretches]:
        groups, files = self._listing()
        if {start["files"], end["files"]} != {files}:
            raise ValueError("the dataset's files, its seed or its buffer have changed since the stream began")
        self.planned = max(end["rows"], self.planned or 0)
        if self.progress:
            fs, path = opened(self.progress)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path + ".new") as f:
                f.write(json.dumps({"rows": self.planned}).encode())
            fs.move(path + ".new", path)
        return self.dealt(self.between(start["rows"], end["rows"], groups))

    def commit(self, end: dict) -> None:
        pass


class ShuffledDataset(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shuffled"

    def schema(self) -> str:
        raise ValueError("name the columns: .schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, self.options)
