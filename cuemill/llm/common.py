"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and U+0009..U+000D.
SPACE = r"[\x20\x09-\x0D]+"


class Scratch:
    """Owns the tables that :func:`staged` writes while it is the current one (``with Scratch() as s``).

    Leaving the block ends that, but deletes nothing, as results are lazy:
    :meth:`close` does, once what reads the tables is written.  Each thread has a
    current one of its own.  Tables staged outside any block belong to
    :data:`SESSION`: those of queries and stages that are called alone, until
    ``SESSION.close()``.
    """

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        self._before = _CURRENT.set(self)
        return self

    def __exit__(self, *_) -> None:
        _CURRENT.reset(self._before)

    def give(self) -> None:
        """Hand all tables to the scratch that is current here."""
        to = _CURRENT.get()
        for df in self.tables:
            df._cuemill_owner = to
        to.tables += self.tables
        self.tables = []

    def close(self) -> None:
        while self.tables:
            discard(self.tables[-1])


SESSION = Scratch()
_CURRENT: ContextVar[Scratch] = ContextVar("scratch", default=SESSION)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of the warehouse where that is unset.

    On a cluster a warehouse in a local folder is refused: executors would each write to their own disk.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if given:
        return given
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local = not re.match(r"\w+:", warehouse) or warehouse.startswith("file:")
    if local and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is a local folder")
    return warehouse + "/_cuemill"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage and keeps a costly result from being computed twice; the
    files survive the loss of any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cuemill_path, out._cuemill_owner = path, _CURRENT.get()
    out._cuemill_owner.tables.append(out)
    return out


def _folder(df: DataFrame):
    """The folder of a :func:`staged` table, and its file system."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cuemill_path)
    return path, path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def discard(df: DataFrame) -> None:
    """Delete the files of a :func:`staged` table that nothing reads any more."""
    path, fs = _folder(df)
    fs.delete(path, True)
    owned = df._cuemill_owner.tables
    owned[:] = [x for x in owned if x is not df]


def sliced(parts, text: int, size: int = 4 << 20, rows: int = 2000):
    """A task's Arrow batches in slices of at most ``size`` bytes of the column ``text`` (strings or lists; or one row) and ``rows`` rows."""
    for b in parts:
        col = b.column(text)
        each = pc.multiply(pc.list_value_length(col), 8) if pa.types.is_list(col.type) else pc.binary_length(col)
        ends = pc.cumulative_sum(pc.cast(pc.fill_null(each, 0), pa.int64())).to_numpy()
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            stop = min(max(at + 1, int(ends.searchsorted(before + size, "right"))), at + rows)
            yield b.slice(at, stop - at)
            at = stop


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until the table has no such column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of files, and rows, up to which a staged table is broadcast.
SMALL_BYTES, SMALL_ROWS = 8 << 20, 1_000_000


def small(df: DataFrame) -> bool:
    """Whether a :func:`staged` table may be broadcast: few bytes in its files, which are listed and not read, and few rows, which Parquet's footers count."""
    path, fs = _folder(df)
    return fs.getContentSummary(path).getLength() <= SMALL_BYTES and df.count() <= SMALL_ROWS


def with_small(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join that broadcasts ``right``, a :func:`staged` table, only if it is found to be :func:`small`.

    Beyond that Spark shuffles both sides; its adaptive execution then splits skewed keys.
    """
    return left.join(F.broadcast(right) if small(right) else right, on, how)


def salt_of(col: Column, salts: int) -> Column:
    """A salt from 0 to ``salts`` - 1 that depends on the row's id only."""
    return F.pmod(F.xxhash64(col), F.lit(salts)).cast("int")


def salt_bit(salt: Column) -> Column:
    """The salt as a bit of a long, so that bit_or() collects the salts of a group in a fixed-size buffer."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), salt)


def salts_in(mask: Column, salts: int) -> Column:
    """The salts whose bits are set, as an array."""
    return F.filter(F.array(*[F.lit(i) for i in range(salts)]), lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("long")) == 1)
