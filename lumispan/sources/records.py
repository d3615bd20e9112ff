"""Spark data sources for clouds of fixed-length records behind a header: ``pcd`` and ``ply``.

Reading: ``spark.read.format("pcd").load(path)`` with a file, a folder or a pattern. Each file keeps its own header, which is
read by range. Binary records are cut into byte ranges of ``rows`` records (an option), one input partition each, so one file
makes as many tasks as it needs; ascii data are streamed by one task a file, compressed data are decoded by one (the format has
one block). A file with fewer records than its header says is an error. ``point_id`` counts on from file to file, in the order
of their paths; a folder without files is an empty cloud.

Writing: ``df.write.format("pcd").mode("append" | "overwrite").save(path)`` with the columns x, y, z, rgb (an int of packed
colours), for ``ply`` x, y, z, red, green, blue. Tasks write whole files of at most ``rows`` records to a hidden folder beside
the others; the commit moves those of the attempts that succeeded into place, an abort removes all, so readers see no part of an
unfinished job. With the option ``single`` the parts become one file behind one header, in the order of partitions; the driver
then copies them in blocks of bounded size, as these formats have one header with the count.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lumispan.functions.store import files, filesystem
from lumispan.sources import formats

ROWS = 1 << 20
BATCH = 1 << 16  # records of an Arrow batch
BLOCK = 1 << 24  # bytes that are copied at once


@dataclass
class Range(InputPartition):
    """Records ``first`` to ``last`` of a file, whose first record has the id ``base``."""

    uri: str
    path: str
    header: dict
    base: int
    first: int
    last: int

    def __post_init__(self):
        super().__init__(None)


def _headers(uri: str, kind: str) -> list[tuple[str, dict]]:
    system, _ = filesystem(uri)
    out = []
    for path in files(uri, f"*.{kind}"):
        with system.open_input_file(path) as f:
            out.append((path, formats.read_header(f, kind)))
    return out


class Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict, columns: list[str]):
        self.kind, self.uri, self.rows, self.columns = kind, options["path"], int(options.get("rows", ROWS)), columns

    def partitions(self) -> list[Range]:
        out, base = [], 0
        for path, header in _headers(self.uri, self.kind):
            n = header["points"]
            step = self.rows if header["data"] == "binary" else max(n, 1)
            out += [Range(self.uri, path, header, base, at, min(n, at + step)) for at in range(0, n, step)]
            base += n
        return out or [Range(self.uri, "", {}, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.last == part.first:
            return
        system, _ = filesystem(part.uri)
        with system.open_input_file(part.path) as f:
            yield from formats.decode(f, part.header, part.base, part.first, part.last, self.columns, BATCH)


@dataclass
class Written(WriterCommitMessage):
    no: int
    names: list[str]
    counts: list[int]


class Writer(DataSourceArrowWriter):
    def __init__(self, kind: str, options: dict, overwrite: bool):
        self.kind, self.uri, self.overwrite = kind, options["path"], overwrite
        self.rows, self.single = int(options.get("rows", ROWS)), str(options.get("single", "false")).lower() == "true"
        _, path = filesystem(self.uri)
        top = path.rstrip("/")
        self.hidden = (top.rpartition("/")[0] if self.single else top) + f"/_{self.kind}-{uuid.uuid4().hex}"
        if self.single and not overwrite:
            raise ValueError("one file can only be written anew")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        out = Written(context.partitionId(), [], [])
        system, _ = filesystem(self.uri)
        system.create_dir(self.hidden, recursive=True)
        dtype, held, n = formats.RECORDS[self.kind], [], 0

        def flush():
            name = f"{self.hidden}/part-{out.no:06d}-{context.taskAttemptId()}-{len(out.names):04d}.{self.kind}"
            with system.open_output_stream(name) as f:
                if not self.single:
                    f.write(formats.header_of(self.kind, n))
                for block in held:
                    f.write(block)
            out.names.append(name)
            out.counts.append(n)

        for batch in iterator:
            for at in range(0, batch.num_rows, self.rows):
                some = batch.slice(at, self.rows)
                if n and n + some.num_rows > self.rows:
                    flush()
                    held, n = [], 0
                records = np.empty(some.num_rows, dtype)
                for c in dtype.names:
                    records[c] = some.column(c).to_numpy(zero_copy_only=False)
                held.append(records.tobytes())
                n += some.num_rows
        if n:
            flush()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        system, path = filesystem(self.uri)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.no)
        if self.single:
            system.create_dir(self.hidden, recursive=True)
            whole = f"{self.hidden}/whole"
            with system.open_output_stream(whole) as out:
                out.write(formats.header_of(self.kind, sum(n for m in done for n in m.counts)))
                for name in (x for m in done for x in m.names):
                    with system.open_input_stream(name) as f:
                        while block := f.read(BLOCK):
                            out.write(block)
            system.move(whole, path)
        else:
            system.create_dir(path, recursive=True)
            old = files(self.uri, f"*.{self.kind}") if self.overwrite else []
            for name in (x for m in done for x in m.names):
                system.move(name, f"{path.rstrip('/')}/{self.hidden[-8:]}-{name.rpartition('/')[2]}")  # names differ from job to job
            for name in old:
                system.delete_file(name)
        self._clear(system)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(filesystem(self.uri)[0])

    def _clear(self, system) -> None:
        from pyarrow import fs

        if system.get_file_info(self.hidden).type == fs.FileType.Directory:
            system.delete_dir(self.hidden)


class PcdSource(DataSource):
    kind = "pcd"

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return formats.schema([h for _, h in _headers(self.options["path"], self.kind)], self.kind)

    def reader(self, schema) -> Reader:
        return Reader(self.kind, dict(self.options), schema.fieldNames()[1:])

    def writer(self, schema, overwrite: bool) -> Writer:
        lacking = set(formats.RECORDS[self.kind].names) - set(schema.fieldNames())
        if lacking:
            raise ValueError(f"{self.kind} needs the columns {sorted(lacking)}")
        return Writer(self.kind, dict(self.options), overwrite)


class PlySource(PcdSource):
    kind = "ply"


def from_bytes(content: bytes, kind: str, fields: list[str]) -> Iterator[pa.RecordBatch]:
    """The records of a file that is at hand whole: for stores that only Spark reads."""
    f = pa.PythonFile(io.BytesIO(content), "r")
    header = formats.read_header(f, kind)
    yield from formats.decode(f, header, 0, 0, header["points"], fields, BATCH)
