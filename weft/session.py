"""Session helpers: building a session, naming the shared folder, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where the session names none, as in tests, a folder of this machine is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="weft-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage ends
    there, and the loss of an executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weft-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*makes: Callable[[], DataFrame], workers: int = 6) -> list[DataFrame]:
    """cut of each DataFrame that makes give, run at the same time: jobs that do not need one another fill one another's gaps."""
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(lambda make: cut(make()), makes))


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut, and how many rows were written, without another job."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
