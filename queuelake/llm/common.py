"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """A-Z only: lower() would fold other letters as well."""
    return F.translate(c, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local folder, if all runs on this machine as in tests."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not held:
        held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="queuelake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        held = f"file://{own}"
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


class written:  # noqa: N801
    """with written() as w: tables that ``materialize`` writes inside are removed at the end, but for those given to w.keep; these are the outer block's then."""

    _open = threading.local()

    def __init__(self):
        self.tables: list[DataFrame] = []
        self.kept: set[str] = set()

    @classmethod
    def blocks(cls) -> list[written]:
        if not hasattr(cls._open, "blocks"):
            cls._open.blocks = []
        return cls._open.blocks

    def __enter__(self) -> written:
        self.blocks().append(self)
        return self

    def keep(self, *tables: DataFrame) -> None:
        self.kept |= {t.written_to for t in tables}

    def __exit__(self, *_: object) -> None:
        self.blocks().remove(self)
        for t in self.tables:
            if t.written_to not in self.kept:
                path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_to)
                path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            elif self.blocks():
                self.blocks()[-1].tables.append(t)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage is cut, and a lost executor loses nothing.

    The rows are columnar and compressed there, unlike those of checkpoint(). ``written`` removes it; the folder's owner clears what is left.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if written.blocks():
        written.blocks()[-1].tables.append(out)
    return out
