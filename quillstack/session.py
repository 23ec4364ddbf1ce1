"""Session helpers: a tuned local builder, shipping of this package to executors, shared work folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int | str = 8, app: str = "quillstack", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench. On a cluster, build the session yourself and pass it in."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (once per application), so that Python operators run on any cluster."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillstack-")) / "quillstack_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


_LOCAL_FOLDERS: dict[str, str] = {}
_OWNED: set[str] = set()


def work_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset and the
    master is local. The caller's settings stay as they are."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='quillstack-work-')}"
    return _LOCAL_FOLDERS[sc.applicationId]


def application_folder(spark: SparkSession) -> str:
    """This application's own folder inside the work folder; it is removed when the application ends."""
    path = f"{work_folder(spark).rstrip('/')}/quillstack/{spark.sparkContext.applicationId}"
    if path not in _OWNED:
        place, fs = hadoop_path(spark, path)
        fs.mkdirs(place)
        fs.deleteOnExit(place)
        _OWNED.add(path)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """(path, its file system), for the few steps on files that DataFrames have no words for."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def release(spark: SparkSession) -> None:
    """Remove what this application has written so far; results that still read it must have been used."""
    place, fs = hadoop_path(spark, application_folder(spark))
    fs.delete(place, True)
    fs.mkdirs(place)


#: Setting by which Spark removes the shuffle files of a query when it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Setting of the most rows that go to a Python worker, or come back, at once.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, label: str, tidy: bool = False, batch: int | None = None) -> DataFrame:
    """Write df as parquet in the application's folder and read it back: cuts lineage, survives lost executors.

    tidy: the shuffle files of the write are removed as soon as it ends, and not when the driver collects its garbage.
    batch: rows that Python workers get at once, for wide rows."""
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"
    settings = ({_TIDY: "true"} if tidy else {}) | ({_BATCH: str(batch)} if batch else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    _PLACES[table] = path
    return table


_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialise wrote; nothing may read them afterwards."""
    for table in tables:
        place, fs = hadoop_path(table.sparkSession, _PLACES.pop(table))
        fs.delete(place, True)


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Deal the rows evenly over the cluster before heavy work on each row, if the plan reads fewer files than that needs.

    A few parquet files with one row group each give a few tasks however large they are. A plan that reads two files a
    core, as on any large table, is left alone, so nothing is shuffled at scale. The exchange is round-robin: no hot
    value can end up in one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= 2 * cores:
        return df
    return df.repartition(max(cores * per_core, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))))
