"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is named and all work is done in this
    process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(scratch_dir, "own", None)
        if folder is None:
            path = tempfile.mkdtemp(prefix="quaystone-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            folder = scratch_dir.own = f"file://{path}"
    return folder


#: Those who own the scratch that is made just now, outermost first.
_OWNERS: list[list[Scratch]] = []


@contextmanager
def owned() -> Iterator[list[Scratch]]:
    """Owns every ``Scratch`` that is made inside, whoever makes it, and removes it at the end: for one who stores a result
    inside, or has used it up."""
    made: list[Scratch] = []
    _OWNERS.append(made)
    try:
        yield made
    finally:
        _OWNERS.remove(made)
        for s in made:
            s.close()


class Scratch:
    """Intermediate tables in the shared folder.

    ``keep`` writes a DataFrame as parquet and reads it back: lineage ends there, so a lost executor costs at most
    the stage at work.  ``drop`` removes tables that nothing will read again.  Tables a lazy result still reads stay
    until ``close``, which the one who uses the result up may call (or ``with``), or the folder's owner empties it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{scratch_dir(spark)}/quaystone/{uuid.uuid4().hex}"
        if _OWNERS:
            _OWNERS[-1].append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self.remove(f"{self.base}/{name}")

    def remove(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        """Removes all tables of this object."""
        self.remove(self.base)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()
