"""Session helpers: building a session, reading tables, cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import functools
import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "textloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with adaptive execution on; keyword names use ``__`` for dots."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is absent (tests, a laptop) a temporary folder is
    made and used for the rest of the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    made = "file://" + tempfile.mkdtemp(prefix="textloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


_written: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once as a table in the shared folder so that no later stage recomputes them.

    The table is columnar and compressed, so later stages read only the columns
    they use; it outlives lost executors and goes when the driver ends or
    ``release`` is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/textloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # Shuffle files of what came before go once the driver's collector finds them unused.
    gc.collect()
    spark._jvm.System.gc()
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables that ``cut`` wrote; results that still read them must have been used up."""
    while _written:
        spark, path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone, and its folder is the cluster's to clean
            continue


@contextlib.contextmanager
def temporary():
    """Tables that ``cut`` writes inside are deleted at the end; results must be used up or written by then.

    Long sessions that run many operators should use one per result, as the
    tables otherwise stay until the driver ends.
    """
    kept = _written[:]
    del _written[:]
    try:
        yield
    finally:
        release()
        _written.extend(kept)


def tokenizer_dir() -> str:
    """Folder of the public tokenizer files; TEXTLOOM_TOKENIZERS overrides the default."""
    return os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")


def ship_package(spark: SparkSession) -> None:
    """Let every executor import this package, wherever it was started; once per context."""
    context = spark.sparkContext
    if getattr(context, "_textloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="textloom-"), "textloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(target)
    context._textloom_shipped = True


def shipping(query):
    """The same query, run with the package available on the executors."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run
