"""Session helpers: table access and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; column pruning and pushdown are left to Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can read and write.

    It is the session's ``spark.checkpoint.dir``; only where that is unset (local tests) a
    folder below the SQL warehouse takes its place.
    """
    found = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for one intermediate table."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet at ``path`` and read it back."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """:func:`written` at a fresh path in the shared folder, which cuts the lineage.

    Unlike a local checkpoint the files outlive the executor that wrote them.
    """
    return written(df, work_path(df.sparkSession, label))


def is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a work table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def move_path(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a folder of a work table; whether there was one."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(source):
        return False
    if not fs.rename(source, target):
        raise OSError(f"{path} can't be moved to {to}")
    return True


class Tables:
    """Work tables of one operator by name; each goes as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession, label: str):
        self._spark, self._label, self._paths = spark, label, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """:func:`materialize` under a name; a table of that name is forgotten, not dropped."""
        self._paths[name] = work_path(self._spark, f"{self._label}-{name}")
        return written(df, self._paths[name])

    def measured(self, name: str, df: DataFrame, *columns: str) -> tuple[DataFrame, tuple[int, int | None]]:
        """:meth:`write`, with the number of rows and the exclusive or of their hashes over ``columns``, both taken while writing."""
        seen = Observation()
        told = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("x")
        out = self.write(name, df.observe(seen, *told))
        return out, (seen.get["n"], seen.get["x"])

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self._paths:
                drop_path(self._spark, self._paths.pop(name))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once an application, so that Python workers can import them."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tessera-")
    target = Path(folder, "tessera-modules.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
