"""The audit ledger as a streaming source whose offsets hold what was read.

An offset is, for each file, the number of bytes up to the last whole line and the
SHA-256 of them. Before a batch is planned the bytes up to its start are read again: if there
are fewer, or others, the ledger was truncated or rewritten and the stream ends
with ``LedgerChanged`` instead of counting on. A last line without its end waits
until it is complete. Lines that are no JSON object come as ``corrupt`` with their
text. The batch is read by tasks, ``RANGE`` bytes each, cut at line ends.

The ledger is a file or a folder of files, whose names begin with neither ``_`` nor
``.``, at a path that pyarrow's file systems reach from driver and executors alike.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .audit import records, run_to_end

RANGE = 8 << 20
FIELDS = ("key", "from", "to", "by", "at")
SCHEMA = ", ".join(f"`{f}` string" for f in FIELDS) + ", corrupt string"


class LedgerChanged(RuntimeError):
    """What was read before is not there any more."""


def _found(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, at, system.get_file_info(at).type


def _open(path: str):
    from pyarrow import fs

    system, at, kind = _found(path)
    return system.open_input_file(at) if kind == fs.FileType.File else None


def ledger_files(path: str) -> list[str]:
    """The files of a ledger, by name."""
    from pyarrow import fs

    system, at, kind = _found(path)
    if kind != fs.FileType.Directory:
        return [path] if kind == fs.FileType.File else []
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names) if n[0] not in "_."]


def _digest(path: str, size: int) -> str | None:
    """Of the first ``size`` bytes; None if there are fewer."""
    h, left = hashlib.sha256(), size
    with _open(path) or _Nothing() as f:
        while left > 0:
            part = f.read(min(left, RANGE))
            if not part:
                return None
            h.update(part)
            left -= len(part)
    return h.hexdigest()


class _Nothing:
    """An empty file."""

    def __enter__(self) -> _Nothing:
        return self

    def __exit__(self, *_) -> None:
        pass

    def read(self, *_) -> bytes:
        return b""

    def size(self) -> int:
        return 0


def whole_lines(path: str) -> int:
    """Bytes up to the end of the last whole line."""
    with _open(path) or _Nothing() as f:
        end = f.size()
        while end:
            start = max(0, end - RANGE)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class LedgerReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": {f: [n := whole_lines(f), _digest(f, n)] for f in ledger_files(self.path)}}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        for offset in (start, end):  # a batch that is planned again must find what it was planned for
            for path, (size, digest) in offset["files"].items():
                if _digest(path, size) != digest:
                    raise LedgerChanged(f"LedgerChanged: the first {size} bytes of {path} are not those read before")
        spans = [(f, start["files"].get(f, [0])[0], size) for f, (size, _) in end["files"].items()]
        return [Range(f, a, min(a + RANGE, size)) for f, begin, size in spans for a in range(begin, size, RANGE)]

    def read(self, partition: Range) -> Iterator[tuple]:
        """The lines that begin within the range."""
        with _open(partition.path) as f:
            f.seek(max(0, partition.start - 1))
            held = f.read(partition.end - max(0, partition.start - 1))
            while held and not held.endswith(b"\n"):
                more = f.read(1 << 16)
                if not more:
                    break
                cut = more.find(b"\n")
                held += more if cut < 0 else more[: cut + 1]
        if partition.start:  # a line that began before is another task's
            held = held[held.find(b"\n") + 1 :] if b"\n" in held[: partition.end - partition.start + 1] else b""
        for line in held.split(b"\n"):
            if not line.strip():
                continue
            try:
                said = json.loads(line)
                if not isinstance(said, dict):
                    raise ValueError
            except ValueError:
                yield (*[None] * len(FIELDS), line.decode("utf-8", "replace"))
                continue
            yield (*[None if (v := said.get(k)) is None else v if isinstance(v, str) else json.dumps(v) for k in FIELDS], None)

    def commit(self, end: dict) -> None:
        pass


class LedgerSource(DataSource):
    """``spark.readStream.format("graphloom_ledger").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "graphloom_ledger"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LedgerReader:
        return LedgerReader(self.options["path"])


def ledger_stream(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(LedgerSource)
    return spark.readStream.format("graphloom_ledger").load(path)


def fold(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """``key, to, have``: the ledger's records so far, through the stream under
    ``folder``, which goes on where it ended. A ledger that has changed is folded
    anew from its beginning, under a new name."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tries = sorted(int(f.getPath().getName().removeprefix("fold-")) for f in files.listStatus(hadoop)) if files.exists(hadoop) else []
    last = tries[-1] if tries else 0
    stream = records(ledger_stream(spark, path))
    try:
        return run_to_end(stream, f"{folder}/fold-{last}")
    except Exception as e:
        if "LedgerChanged" not in str(e):
            raise
    return run_to_end(stream, f"{folder}/fold-{last + 1}")
