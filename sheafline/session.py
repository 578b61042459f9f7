"""Session helpers: configuration, table reading, checkpoints in the shared folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "sheafline", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. A local one is chosen only on a single machine; a cluster without one is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(?:\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "sheafline-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, so that a lost executor costs a re-read and not a re-computation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A scan of few files over all cores, ahead of heavy work per row. Larger tables have their partitions already, so what
    is shuffled is at most one file split a core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that their Python workers can import it."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if getattr(sc, "_sheafline_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="sheafline-")
    archive = os.path.join(folder, "sheafline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(Path("sheafline") / path.relative_to(root)))
    sc.addPyFile(archive)
    sc._sheafline_shipped = True
