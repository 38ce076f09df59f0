"""Session settings and table access shared by all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings under which the operators were written. They are applied only to sessions made here; a session that is
#: handed in keeps its own.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", app: str = "quire", **settings: str) -> SparkSession:
    """A session with this engine's settings; `settings` (dots as double underscores) override them."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once per context, so that they need no path to it."""
    context = spark.sparkContext
    if getattr(context, "_quire_shipped", False):
        return
    import shutil
    import tempfile
    from pathlib import Path

    # only the driver reads this folder; executors get the archive from the driver's file server
    here = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="quire-"))
    shutil.copytree(here, folder / "tree" / here.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / "quire"), "zip", folder / "tree"))
    context._quire_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name` below `folder`.

    A table of so few files that most cores would idle (one small file, say) is spread over them first; a large table
    has more files than that and is read as it lies.
    """
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all executors share: spark.checkpoint.dir.

    Where that is unset, a session on one machine (tests) gets a local one, and any other is refused: a folder of one
    machine is no place for what all executors need.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="quire-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
