"""Growing log files as a stream: lines appended in place, files that shrink or are replaced."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes at the head of a file that tell whether it is still the same one.
HEAD = 64
#: Bytes one task reads at most.
PART = 64 << 20
#: Bytes read at a time.
CHUNK = 1 << 20
NAME = "growing_log"


class Range(InputPartition):
    """Lines of ``path`` that begin at ``start`` or later and before ``end``."""

    def __init__(self, path: str, start: int, end: int, stop: int) -> None:
        self.path, self.start, self.end, self.stop = path, start, end, stop


class GrowingLog(DataSource):
    """``file, value``: every line appended to the files of a folder, each once.

    The offset holds for every file how many bytes of whole lines were read and
    their first bytes, so what lies between two offsets follows from them alone.
    A file shorter than its offset, or one with another head, was truncated or
    replaced and is read from its beginning. A last line without its line end
    waits until that is written. Options: ``path`` (a
    folder; anything ``pyarrow.fs`` opens) and ``suffix`` (default ``.log``).
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, value string"

    def streamReader(self, schema) -> GrowingLogReader:
        return GrowingLogReader(self.options["path"], self.options.get("suffix", ".log"))


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str) -> None:
        self.folder, self.suffix = folder, suffix

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = opened(self.folder)
        found = {}
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name.endswith(self.suffix):
                with store.open_input_file(info.path) as file:
                    end = whole_lines(file, file.size())
                    file.seek(0)
                    found[info.base_name] = [end, file.read(min(end, HEAD)).hex()]
        return found

    def partitions(self, start: dict, end: dict) -> list[Range]:
        _, root = opened(self.folder)
        parts = []
        for name, (stop, head) in sorted(end.items()):
            begin, was = start.get(name, (0, ""))
            if begin > stop or not head.startswith(was):
                begin = 0
            parts += [Range(f"{root}/{name}", at, min(at + PART, stop), stop) for at in range(begin, stop, PART)]
        return parts

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.folder)
        name = partition.path.rsplit("/", 1)[-1]
        if store.get_file_info(partition.path).type != fs.FileType.File:
            return  # removed since it was planned
        with store.open_input_file(partition.path) as file:
            for lines in lines_of(file, partition.start, partition.end, partition.stop):
                texts = [t for line in lines if (t := line.decode("utf-8", "replace").rstrip("\r"))]
                if texts:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts)), pa.array(texts)], ["file", "value"])


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    return store, root.rstrip("/")


def whole_lines(file: pa.NativeFile, size: int) -> int:
    """Where the last whole line ends, looked for from the end of the file."""
    at = size
    while at > 0:
        begin = max(at - CHUNK, 0)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def lines_of(file: pa.NativeFile, start: int, end: int, stop: int) -> Iterator[list[bytes]]:
    """Lists of the lines that begin in ``[start, end)``; ``stop`` is where the last whole line ends.

    A range may begin inside a line, which then is its predecessor's.
    """
    at = start
    if start:
        file.seek(start - 1)
        if file.read(1) != b"\n":
            while at < stop:
                found = file.read(CHUNK).find(b"\n")
                if found >= 0:
                    at += found + 1
                    break
                at = min(at + CHUNK, stop)
    rest = b""
    begin = at  # where ``rest`` begins
    while begin < end and at < stop:
        file.seek(at)
        data = file.read(min(CHUNK, stop - at))
        if not data:
            break  # the file shrank since it was planned; its new lines come with the next offset
        at += len(data)
        *lines, rest = (rest + data).split(b"\n")
        took = []
        for line in lines:
            if begin >= end:
                break
            took.append(line)
            begin += len(line) + 1
        if took:
            yield took


def stream_growing(spark: SparkSession, folder: str, suffix: str = ".log") -> DataFrame:
    """All lines ever appended to the log files of ``folder``, as a stream."""
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format(NAME).option("path", folder).option("suffix", suffix).load()
