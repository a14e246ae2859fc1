"""ZIP archives and plain files as a data source that is written in two phases.

A row is a piece of a file: (path, entry_no, entry, piece, content).  Tasks write
whole files into a folder of the job's own, streaming their pieces; when all
tasks have ended the driver moves them to their places, folders that are new as
a whole, and when one has failed it deletes the folder, so that a failed job
leaves nothing.  Reading gives pieces again, an entry at a time.  The driver
lists only the upper folders and tasks what is below: where :func:`sharded` puts
files into such folders, it never holds a file's name.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a piece that is read, files or folders that a task reads, tasks that reading aims at, and moves that the driver makes at once.
PIECE, ARCHIVES, TASKS, MOVES = 1 << 20, 64, 128, 16
SCHEMA = "path string, entry_no int, entry string, piece long, content binary, error string"


def file_system(path: str):
    """The Arrow file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    local = re.sub(r"^file:/*(?=/)", "", path)
    return fs.FileSystem.from_uri(path if ":" in local else f"file://{local}")


@dataclass
class Written(WriterCommitMessage):
    folder: str


class _Files:
    """One task's files, each open from its first piece to its last."""

    def __init__(self, system, root: str):
        self.system, self.root, self.paths = system, root, set()
        self.path = self.entry = self.out = self.zip = self.part = None

    def add(self, r: Row) -> None:
        if r["path"] != self.path or not self.paths:
            self.close()
            self._open(r["path"])
        if r["entry"] is None:
            self.out.write(r["content"])
            return
        if self.zip is None:
            self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        if (r["entry_no"], r["entry"]) != self.entry:
            if self.part:
                self.part.close()
            # no time of day: the same rows make the same bytes
            info = zipfile.ZipInfo(r["entry"])
            info.compress_type = zipfile.ZIP_DEFLATED
            self.entry, self.part = (r["entry_no"], r["entry"]), self.zip.open(info, "w", force_zip64=True)
        self.part.write(r["content"])

    def _open(self, path: str) -> None:
        if path in self.paths:
            raise ValueError(f"the pieces of {path} are not together")
        target = posixpath.join(self.root, path.lstrip("/"))
        self.system.create_dir(posixpath.dirname(target), recursive=True)
        self.path, self.entry, self.out = path, None, self.system.open_output_stream(target)
        self.paths.add(path)

    def close(self) -> None:
        for x in (self.part, self.zip, self.out):
            if x is not None:
                x.close()
        self.part = self.zip = self.out = None


class ZipWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = file_system(self.folder)
        at = posixpath.join(root, self.job, uuid.uuid4().hex)  # a task that runs twice has two folders, of which one is named
        files = _Files(system, at)
        try:
            for r in iterator:
                files.add(r)
        finally:
            files.close()
        return Written(posixpath.basename(at))

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, root = file_system(self.folder)

        def below(folder: str) -> list[str]:
            return [f.path for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True))]

        def move(path: str) -> list[str]:
            """Moves what has no place yet, or is a file; of a folder that is there, what it holds comes next."""
            target = posixpath.join(root, posixpath.relpath(path, at))
            if system.get_file_info(target).type == system.get_file_info(path).type == fs.FileType.Directory:
                return below(path)
            system.move(path, target)
            return []

        with ThreadPoolExecutor(MOVES) as pool:
            for m in filter(None, messages):
                at = posixpath.join(root, self.job, m.folder)
                paths = below(at)
                while paths:
                    paths = [x for more in pool.map(move, paths) for x in more]
        self._clear(system, root)

    def abort(self, messages: list) -> None:
        self._clear(*file_system(self.folder))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        at = posixpath.join(root, self.job)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


class _Archives(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class ZipReader(DataSourceReader):
    def __init__(self, folder: str, suffix: str, piece: int, plain: str):
        self.folder, self.suffix, self.piece, self.plain = folder, suffix, piece, plain

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = file_system(self.folder)
        found, folders = self._listed(system, root), True
        while folders and len(found) < TASKS:
            folders = [f for f in found if f.type == fs.FileType.Directory]
            found = [f for f in found if f.type == fs.FileType.File] + [x for f in folders for x in self._listed(system, f.path)]
        paths = sorted(posixpath.relpath(f.path, root) for f in found)
        size = max(1, min(ARCHIVES, len(paths) // TASKS))
        return [_Archives(paths[i : i + size]) for i in range(0, len(paths), size)] or [_Archives([])]

    def _listed(self, system, folder: str, recursive: bool = False) -> list:
        """What is in a folder: folders, archives and plain files, by name."""
        from pyarrow import fs

        ends = (self.suffix, self.plain) if self.plain else self.suffix
        found = system.get_file_info(fs.FileSelector(folder, recursive=recursive))
        kept = [f for f in found if "/_" not in "/" + posixpath.relpath(f.path, folder) and (f.type == fs.FileType.Directory or f.path.endswith(ends))]
        return sorted(kept, key=lambda f: f.path)

    def _files(self, system, root: str, paths: list[str]) -> Iterator[str]:
        from pyarrow import fs

        for path in paths:
            at = posixpath.join(root, path)
            if system.get_file_info(at).type == fs.FileType.Directory:
                yield from (posixpath.relpath(f.path, root) for f in self._listed(system, at, True) if f.type == fs.FileType.File)
            else:
                yield path

    def read(self, partition: _Archives) -> Iterator[tuple]:
        system, root = file_system(self.folder)
        for path in self._files(system, root, partition.paths):
            with system.open_input_file(posixpath.join(root, path)) as f:
                if self.plain and path.endswith(self.plain):
                    piece = 0
                    while (data := f.read(self.piece)) or not piece:
                        yield path, None, None, piece, data, None
                        piece += 1
                    continue
                try:
                    with zipfile.ZipFile(f) as z:
                        for no, info in enumerate(z.infolist()):
                            with z.open(info) as entry:
                                piece = 0
                                while (data := entry.read(self.piece)) or not piece:
                                    yield path, no, info.filename, piece, data, None
                                    piece += 1
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, ValueError) as e:
                    yield path, None, None, None, None, f"{type(e).__name__}: {e}"


class Zips(DataSource):
    """``format("zip_pieces")``; options ``path``, ``suffix`` (.zip), ``plain``, the suffix of files that are no archives, and ``piece``, the most bytes of a piece that is read."""

    @classmethod
    def name(cls) -> str:
        return "zip_pieces"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options["path"], self.options.get("suffix", ".zip"), int(self.options.get("piece", PIECE)), self.options.get("plain", ""))

    def writer(self, schema, overwrite: bool) -> ZipWriter:
        if overwrite:
            raise ValueError("files are added or replaced one by one; delete the folder to overwrite it")
        return ZipWriter(self.options["path"])


def sharded(pieces: DataFrame, shards: int) -> DataFrame:
    """Pieces whose paths have a folder in front, one of so many by the first folder of the path."""
    return pieces.withColumn("path", F.concat_ws("/", F.pmod(F.xxhash64(F.substring_index("path", "/", 1)), F.lit(shards)).cast("string"), "path"))


def write_pieces(pieces: DataFrame, folder: str, by: Column | str = "path") -> None:
    """Writes pieces (path, entry_no, entry, piece, content) as files below a folder that all executors see: all of them, or none if a task fails.

    A path with entries is a ZIP archive of them, in order of ``entry_no``; one
    whose entry is null is a plain file.  Pieces of a file are put together in
    order.  A file that is there is replaced.  ``by``: what tasks are dealt by.
    """
    pieces.sparkSession.dataSource.register(Zips)
    rows = pieces.select("path", F.col("entry_no").cast("int").alias("entry_no"), "entry", F.col("piece").cast("long").alias("piece"), "content")
    rows.repartition(F.col(by) if isinstance(by, str) else by).sortWithinPartitions("path", "entry_no", "entry", "piece").write.format("zip_pieces").mode("append").save(folder)


def read_pieces(spark: SparkSession, folder: str, suffix: str = ".zip", piece: int = PIECE, plain: str = "") -> DataFrame:
    """(path, entry_no, entry, piece, content, error) of the archives below a folder, and of the plain files with the suffix ``plain``, if given; an archive that can't be read has a row with the error."""
    spark.dataSource.register(Zips)
    return spark.read.format("zip_pieces").option("suffix", suffix).option("piece", piece).option("plain", plain).load(folder)
