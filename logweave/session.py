"""Session set-up and the shared working folder."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Cluster-wide settings that every job here relies on. Shuffle partition counts are left
# to AQE: it starts from a high number and coalesces down to the advisory size.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_SHIPPED: set[str] = set()


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; ``conf`` entries win."""
    builder = SparkSession.builder.appName("logweave")
    if master:
        builder = builder.master(master)
    settings = dict(RECOMMENDED_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per session.

    Functions that run there are pickled by reference, so they need the package wherever the
    program was started and whoever made the session. Not needed where the package is installed
    on all machines.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parent
    where = pathlib.Path(tempfile.mkdtemp(prefix="logweave-package-")) / "logweave.zip"  # read by the driver alone
    with zipfile.ZipFile(where, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(where))
    _SHIPPED.add(app)


def use_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are stored and compared in UTC."""
    if spark.conf.get("spark.sql.session.timeZone", "") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for checkpoints and intermediate tables.

    Lives under ``spark.checkpoint.dir`` so that it survives the loss of executors. Only a
    local master, where no such setting exists, falls back to a temporary folder.
    """
    ship_package(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="logweave-")
        base = _LOCAL_DIRS[app]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared working folder and read back: computed once, whoever loses an executor."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
