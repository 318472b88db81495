"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Rows of whole texts are wide: with Spark's default of 10,000 a batch, the batches of all tasks of an executor are its largest buffers.
BATCH_ROWS, DEFAULT_ROWS = "1000", "10000"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, whatever folder the driver was started in, and keep Arrow batches small where the session has no size of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths and ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; one of our own where it names none."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not getattr(spark, "_palimpsest_folder", None):
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark._palimpsest_folder = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    return spark._palimpsest_folder


#: The tables of each open scratch().
_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that durable() writes within are deleted at the end: what reads them must be written by then."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.pop()
        for one in made:
            discard(one)


def durable(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and lost executors cost nothing. kept: an open scratch() leaves it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/palimpsest/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    if _scopes and not kept:
        _scopes[-1].append(out)
    return out


def discard(written: DataFrame) -> None:
    """Delete a table of durable() that nothing reads any more."""
    spark = written.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(written._palimpsest_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
