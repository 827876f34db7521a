"""Intermediate tables and stored tables in a folder that all executors share.

Iterative operators cut their lineage by writing a parquet table and reading it back.  The folder is the one
named by ``spark.checkpoint.dir``; only where that is unset and the master is local (tests, notebooks) a local one is
made.  A :class:`Spool` is scratch and goes at exit; a :class:`Home` is a folder the caller names and stays.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[object, object]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="talewind-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def is_local(master: str) -> bool:
    """Whether all tasks run in the driver's process."""
    return master == "local" or master.startswith("local[")


def _remove_all() -> None:
    for fs, path in _made:
        try:
            fs.delete(path, True)
        except Exception:  # the JVM may be gone already
            return


atexit.register(_remove_all)


class Home:
    """Tables and small texts below a folder of the caller's; nothing is deleted but by :meth:`remove`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(self.path(name)), True)

    # Small text files, committed atomically by a rename onto a name that does not exist yet.
    def commit_text(self, name: str, text: str) -> None:
        tmp = self._path(self.path(f".{name}-{uuid.uuid4().hex[:8]}"))
        out = self.fs.create(tmp, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        target = self._path(self.path(name))
        if self.fs.exists(target) or not self.fs.rename(tmp, target):
            self.fs.delete(tmp, False)
            raise RuntimeError(f"{name} was committed by another writer")

    def read_text(self, name: str) -> str:
        src = self.fs.open(self._path(self.path(name)))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(src)).decode("utf-8")
        finally:
            src.close()

    def names(self) -> list[str]:
        return self.names_in("")

    def names_in(self, folder: str) -> list[str]:
        here = self._path(self.path(folder) if folder else self.root)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(here)) if self.fs.exists(here) else []


class Spool(Home):
    """One run's scratch tables below the shared folder."""

    def __init__(self, spark: SparkSession, what: str):
        super().__init__(spark, f"{shared_dir(spark).rstrip('/')}/talewind-{what}-{uuid.uuid4().hex[:12]}")
        _made.append((self.fs, self._path(self.root)))
        self._n, self._cuts = 0, []

    def __enter__(self) -> Spool:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Delete all tables now; nothing may read them afterwards.  What is not closed goes at exit."""
        self.fs.delete(self._path(self.root), True)

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return it read back, without lineage."""
        self._n += 1
        where = self.path(f"{self._n:03d}-{name}")
        df.write.mode("error").parquet(where)
        back = self.spark.read.schema(df.schema).parquet(where)
        back._talewind_path = where
        self._cuts.append(back)
        return back

    def mark(self) -> int:
        """A point in time for :meth:`drop_since`."""
        return len(self._cuts)

    def drop_since(self, mark: int, *but: DataFrame) -> None:
        """Delete the tables cut since ``mark``, all but the given ones."""
        kept = {b._talewind_path for b in but}
        self.drop(*(t for t in self._cuts[mark:] if t._talewind_path not in kept))
        self._cuts[mark:] = [t for t in self._cuts[mark:] if t._talewind_path in kept]

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by :meth:`cut`; nothing may read them afterwards."""
        for df in tables:
            where = getattr(df, "_talewind_path", None)
            if where:
                self.fs.delete(self._path(where), True)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A side of a join within this many bytes on disk is sent to all tasks.
SMALL_BYTES = 32 << 20


def bytes_of(df: DataFrame) -> int:
    """Size on disk of a table made by :meth:`Spool.cut`."""
    where = df._talewind_path
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def small(df: DataFrame) -> DataFrame:
    """A table made by :meth:`Spool.cut`, marked for broadcast only where its size on disk is within the limit."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if bytes_of(df) <= SMALL_BYTES else df
