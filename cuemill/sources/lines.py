"""A stream source of lines, of text that comes in chunks which cut them anywhere.

A folder holds a folder for each process, and that its output so far as files,
whose names rise.  A line ends with a line feed or a carriage return, wherever
chunks end.  What follows the last end is held back: the offset of a process is
the place after its last whole line, so the rest is read again with what comes
later, and nothing but offsets is kept.

Files are reached through Arrow's file systems, from the driver (names and ends
of lines) and from tasks (the text), so the folder can be a local one or a URI.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cuemill.sources.zips import file_system

#: Bytes of text of a task, and bytes that are looked at at a time.
TASK_BYTES, STEP = 8 << 20, 1 << 16


class Stretch(InputPartition):
    """Whole lines of one process, as pieces of chunks (name, from, to), and the place of the first in its text."""

    def __init__(self, process: str, pieces: list[tuple[str, int, int]], offset: int):
        super().__init__(0)
        self.process, self.pieces, self.offset = process, pieces, offset


def _place(offsets: dict, process: str) -> tuple[str, int, int]:
    found = offsets.get(process, {})
    return found.get("chunk", ""), found.get("at", 0), found.get("done", 0)


def _last_end(system, path: str, start: int, stop: int) -> int | None:
    """The place after the last line end between two places of a file."""
    with system.open_input_file(path) as f:
        while stop > start:
            at = max(start, stop - STEP)
            f.seek(at)
            data = f.read(stop - at)
            found = max(data.rfind(b"\n"), data.rfind(b"\r"))
            if found >= 0:
                return at + found + 1
            stop = at
    return None


class LineReader(DataSourceStreamReader):
    """Offsets: for each process the chunk and the place in it up to which whole lines are read, and the bytes before it."""

    def __init__(self, path: str):
        self.path = path
        self.known: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {}

    def _chunks(self) -> dict[str, list[tuple[str, int]]]:
        """Each process's chunks (name, size) in order."""
        from pyarrow import fs

        system, root = file_system(self.path)
        out: dict[str, list] = {}
        for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            process, name = posixpath.split(posixpath.relpath(f.path, root))
            if f.type == fs.FileType.File and not name.startswith((".", "_")):
                out.setdefault(process, []).append((name, f.size))
        return {p: sorted(c) for p, c in sorted(out.items())}

    def latestOffset(self) -> dict:
        system, root = file_system(self.path)
        for process, chunks in self._chunks().items():
            name, at, done = _place(self.known, process)
            new = [(n, at if n == name else 0, size) for n, size in chunks if n >= name]
            for k in range(len(new) - 1, -1, -1):
                n, start, size = new[k]
                end = _last_end(system, posixpath.join(root, process, n), start, size)
                if end is not None:
                    self.known[process] = {"chunk": n, "at": end, "done": done + sum(z - a for _, a, z in new[:k]) + end - start}
                    break
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, root = file_system(self.path)
        parts = []
        for process, chunks in self._chunks().items():
            if process not in end:
                continue
            name, at, offset = _place(start, process)
            stop, to, _ = _place(end, process)
            pieces, size = [], 0
            for n, length in chunks:
                if not name <= n <= stop:
                    continue
                a, z = at if n == name else 0, to if n == stop else length
                while size + z - a >= TASK_BYTES:  # a task's text ends with a line
                    cut = _last_end(system, posixpath.join(root, process, n), a, min(z, a + max(TASK_BYTES - size, 1)))
                    if cut is None:
                        break
                    parts.append(Stretch(process, [*pieces, (n, a, cut)], offset))
                    offset += size + cut - a
                    pieces, size, a = [], 0, cut
                if a < z:
                    pieces.append((n, a, z))
                    size += z - a
            if pieces:
                parts.append(Stretch(process, pieces, offset))
        return parts

    def read(self, partition: Stretch) -> Iterator[tuple]:
        system, root = file_system(self.path)
        offset, held = partition.offset, b""
        for name, at, stop in partition.pieces:
            with system.open_input_file(posixpath.join(root, partition.process, name)) as f:
                f.seek(at)
                while at < stop:
                    data = f.read(min(STEP, stop - at))
                    if not data:
                        raise OSError(f"{partition.process}/{name} has become shorter")
                    at += len(data)
                    first, *more = data.replace(b"\r", b"\n").split(b"\n")
                    held += first
                    for following in more:
                        yield partition.process, offset, held.decode(errors="replace")
                        offset += len(held) + 1
                        held = following

    def commit(self, end: dict) -> None:
        pass


class Lines(DataSource):
    """``spark.readStream.format("process_lines").load(folder)``: (process, offset, line)."""

    @classmethod
    def name(cls) -> str:
        return "process_lines"

    def schema(self) -> str:
        return "process string, offset long, line string"

    def streamReader(self, schema) -> LineReader:
        return LineReader(self.options["path"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The stream of whole lines (process, offset, line) below a folder; ``offset`` is the byte at which the line begins in its process's text.

    An empty line is a line; so are both halves of a carriage return with a line
    feed.  Bytes that are no UTF-8 are replaced.  Chunks may grow and be added,
    but not change; a process without a whole line has no rows yet.
    """
    spark.dataSource.register(Lines)
    return spark.readStream.format("process_lines").load(path)


def percent(line: Column | str) -> Column:
    """The progress that a line of a progress bar tells, from 10 to 90; null for other lines."""
    found = F.regexp_extract(line, r"([0-9]+)%\|", 1)
    return F.when(found != "", 10 + F.floor(found.cast("long") * 0.8 + 0.5).cast("int"))
