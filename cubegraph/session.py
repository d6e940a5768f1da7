"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime options the plans in this package rely on: measured sizes decide on
# broadcasts, and skewed join partitions are split even when the split costs
# one more exchange.
RUNTIME_OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows already dealt by one of a join's keys are not dealt again by all of them.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # What an action exchanged goes when it ends, not when the driver happens to collect its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

#: How stored tables are packed, unless another codec is asked for: they are large for their input, and read a few times.
TIGHT = "zstd"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cubegraph-ship-")) / "cubegraph.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    """Switch on adaptive execution and the early end of exchanged files, and ship the package; leaves sizes and partition counts alone."""
    ship(spark)
    for key, value in RUNTIME_OPTIONS.items():
        spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or where it is unset a folder in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stored"
    return root.rstrip("/")


_STORED: dict[str, list[str]] = {}
_TABLES: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; every call names another one."""
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/cubegraph/{app}/{label}-{uuid.uuid4().hex}"
    _STORED.setdefault(app, []).append(path)
    return path


def drop_stored(spark: SparkSession) -> int:
    """Delete every table this application stored; frames that read them are void afterwards. Returns how many."""
    for name in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    paths = _STORED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(path)
    return len(paths)


def _delete(path: str) -> None:
    fs, place = FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
    if fs.get_file_info(place).type == FileType.Directory:
        fs.delete_dir(place)


def materialise_table(df: DataFrame, label: str, partition_by: str | None = None, codec: str | None = TIGHT) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the stored table.

    Cuts the lineage: the stored rows survive the loss of executors, and
    several consumers read the same rows instead of recomputing them. Without a ``codec`` the session's holds.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    writer = df.write.mode("errorifexists")
    if codec:
        writer = writer.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def stored_paths(spark: SparkSession) -> list[str]:
    """Where this application's stored tables lie, in the order in which they were stored."""
    return list(_STORED.get(spark.sparkContext.applicationId, []))


def end_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete some stored tables; frames that read them are void afterwards."""
    known = _STORED.get(spark.sparkContext.applicationId, [])
    for path in paths:
        if path in known:
            known.remove(path)
            _delete(path)


def end_table(table: DataFrame) -> None:
    """Delete a table that ``materialise_table`` returned, once all that read it are stored."""
    end_paths(table.sparkSession, [table.stored_at])


def materialise_buckets(df: DataFrame, label: str, key: str, buckets: int, partition_by: str | None = None, parts: int = 1) -> DataFrame:
    """Like ``materialise_table``, dealt into ``buckets`` by ``key`` and sorted by it, within each value of ``partition_by``.

    Rows that meet on the key are in buckets of one number, so joins and groups on it need no exchange. The
    catalog entry lives as long as the stored rows. In several ``parts``, by a hash of ``partition_by``, rows are exchanged and
    written one part after the other.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    name = "stored_" + uuid.uuid4().hex
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(name)
    for part in range(parts):
        mine = df if parts == 1 else df.filter(F.pmod(F.xxhash64(partition_by), F.lit(parts)) == part)
        mode = "append" if part else "errorifexists"
        writer = mine.repartition(buckets, key).write.mode(mode).option("path", path).option("compression", TIGHT).format("parquet")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def sized(df: DataFrame, label: str) -> DataFrame:
    """Store a relation that is usually small, so the planner knows its real size.

    A join then broadcasts it if it is within the session's threshold, before the
    other side is shuffled, and shuffles both sides if it is not.
    """
    return materialise_table(df, f"sized-{label}")
