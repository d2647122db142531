"""Reading tables, and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import hashlib
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a folder of part files)."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that its functions run where it
    is not installed. The archive lies in the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_skarn_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(f.relative_to(root.parent))), f.read_bytes())
    path = f"{shared_dir(spark).rstrip('/')}/skarn_{hashlib.sha1(data.getvalue()).hexdigest()[:12]}_{uuid.uuid4().hex[:8]}.zip"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(path)
    sc._skarn_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Where the session names none, a temporary folder is made, but in local mode only: on a
    cluster a machine-local folder would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="skarn-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: the result depends on no executor and
    has no lineage but its files, whose sizes the planner then knows."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/skarn-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._skarn_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_skarn_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def content_order(*columns: str) -> Column:
    """A number that equal rows share, to decide between different rows of one time the same way
    in every run."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(2**62 - 1))


def newest(df: DataFrame, key: str, time: str | None = None) -> DataFrame:
    """One row per key, the one delivered last; rows without a key are left out.

    Of rows that share the newest time the one of the smallest content hash stays, so the choice
    does not depend on the order of reading. The rank filter is applied before the shuffle too (a
    group limit), so a key that is delivered very often costs no more than any other.
    """
    order = [F.col(time).desc_nulls_last()] if time else []
    kept = [c for c in df.columns]
    w = Window.partitionBy(key).orderBy(*order, content_order(*[c for c in kept if c not in (key, time)] or [key]))
    return df.filter(F.col(key).isNotNull()).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select(*kept)
