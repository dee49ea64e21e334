"""Session settings and the shared folder for cut lineage and written tables."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .sources.files import Folder

CHECKPOINT_DIR = "spark.checkpoint.dir"
# The folder of the run that is going on, if any.
RUN = "contactloom.run"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("contactloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary one only in local mode."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    made = tempfile.mkdtemp(prefix="contactloom-")
    spark.conf.set(CHECKPOINT_DIR, made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder, below that of the run if one goes on."""
    return f"{spark.conf.get(RUN, None) or work_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def run(spark: SparkSession) -> Iterator[str]:
    """Whatever is written for later use inside goes below one folder, which is deleted at the end, also after an error.

    Results have to be saved or collected inside: they may read what goes. Runs may lie
    in each other. What a killed run leaves is found by ``sweep_runs``.
    """
    before = spark.conf.get(RUN, None)
    root = before or work_dir(spark)
    name = f"run-{uuid.uuid4().hex}"
    spark.conf.set(RUN, f"{root}/{name}")
    Folder(spark, f"{root}/{name}").create("started", str(int(time.time())))
    try:
        yield f"{root}/{name}"
    finally:
        if before:
            spark.conf.set(RUN, before)
        else:
            spark.conf.unset(RUN)
        Folder(spark, root).delete(name)


def sweep_runs(spark: SparkSession, older_than_hours: float = 24) -> list[str]:
    """Deletes the folders of runs in which nothing was written for so long: their programs are gone."""
    root, now, gone = Folder(spark, work_dir(spark)), int(time.time() * 1000), []
    for name in root.names():
        if name.startswith("run-") and root.newest_ms(name) <= now - older_than_hours * 3_600_000:
            root.delete(name)
            gone.append(name)
    return gone


def written(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: later uses share the result and survive lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
