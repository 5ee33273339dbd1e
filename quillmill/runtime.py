"""Session-level helpers that every operator may use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the cluster's shared one, or on one machine (tests) a temporary one where none is named."""
    sc = spark.sparkContext
    held = sc.getCheckpointDir()
    if held:
        return held
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillmill-"))
    return sc.getCheckpointDir()


def _session_folder(spark: SparkSession) -> str:
    """A folder of this session among the checkpoints; Hadoop deletes it when the driver ends."""
    sc = spark.sparkContext
    held = getattr(sc, "_quillmill_folder", None)
    if held is None:
        held = f"{checkpoint_dir(spark)}/quillmill-{uuid.uuid4().hex}"
        where = sc._jvm.org.apache.hadoop.fs.Path(held)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
        sc._quillmill_folder = held
    return held


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there; survives the loss of executors.

    Written as Parquet rather than through RDD checkpoints, so that the rows are computed once, stay
    columnar and compressed, and later scans prune columns.
    """
    spark = df.sparkSession
    path = f"{_session_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def still_there(df: DataFrame) -> bool:
    """Whether the files that a table was read from still exist."""
    sc = df.sparkSession.sparkContext
    where = [sc._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()[:1]]
    return all(w.getFileSystem(sc._jsc.hadoopConfiguration()).exists(w) for w in where)


def latest_by_id(df: DataFrame, key: str = "id", order: str = "loaded_at") -> DataFrame:
    """One row per key: the one loaded last (null times come first). Ties are equal in content, so any of them will do."""
    if order not in df.columns:
        return df.dropDuplicates([key])
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("_row"))
    return picked.select(key, "_row.*").select(*df.columns)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers where their path does not already hold it."""
    root = Path(__file__).resolve().parent.parent
    on_path = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    sc = spark.sparkContext
    if str(root) in on_path or getattr(sc, "_quillmill_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quillmill-py-")  # on the driver only; Spark's file server hands it out
    archive = os.path.join(folder, "quillmill.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "quillmill").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(archive)
    sc._quillmill_shipped = True
