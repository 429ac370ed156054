"""Session plumbing shared by every operator: code shipping and intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def session(app: str = "lodestone", cpus: int | str = "*") -> SparkSession:
    """A local session for tests and benchmarks; a cluster passes its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LODESTONE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers of any executor, once per application.

    Unless the cluster says otherwise, batches between the JVM and Python hold BATCH_BYTES: texts are long, and the
    buffers of a batch of 10,000 would be memory that no heap setting bounds."""
    if spark.sparkContext.getConf().get(_BATCH) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("lodestone", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset and the master is local is a folder of our own made.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lodestone-shared-")
    sc.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, name: str = "") -> str:
    """A new path for name under this application's part of the shared folder; without one, that part."""
    base = f"{shared_dir(spark).rstrip('/')}/lodestone/{spark.sparkContext.applicationId}"
    return f"{base}/{name}-{uuid.uuid4().hex}" if name else base


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results not yet read from them are lost."""
    p = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write df under the shared folder and read it back: cuts lineage, survives lost executors.

    group_rows bounds the row groups where rows are long: a task holds a whole group as it writes, and as it reads, in
    batches of 4096 rows; Parquet's own bound is 128 MB after compression, first looked at after 100 rows."""
    spark = df.sparkSession
    ship(spark)  # functions of this package run in the plan
    path = scratch(spark, name)
    options = {"compression": "zstd"}
    if group_rows:
        options["parquet.block.row.count.limit"] = str(group_rows)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame returned by written(); it must not be used afterwards."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        if "/lodestone/" in f:
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished stages: it does so when the driver collects garbage.

    The last query's plan is held until another has run; hence the small one."""
    import gc

    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
