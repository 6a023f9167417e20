"""Sessions and tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. Spark opens the path, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for what a job writes and reads again: below spark.checkpoint.dir, which all executors share; in a local
    session that names none, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='tessera-')}/scratch-{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores, dealt out to all of them: for small inputs of much work a row.

    A large input has more splits than cores and is left as it is. Only for plain scans: the plan's splits are counted.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() <= cores else scan


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session: they may not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp()) / "tessera_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(path))  # the driver serves the file to them
    context._tessera_shipped = True
