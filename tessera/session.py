"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tessera", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session, which a cluster shares between
    executors. Only a local session (tests) may leave it unset; it then gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir is unset: the executors of {master or 'this session'} share no folder for intermediate tables")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Unlike a checkpoint the table is columnar and compressed, and neither statistics nor constraints of the old plan
    follow it, so iterations plan in constant time. The files survive the loss of an executor. ``release`` deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    df.coalesce(parallelism(spark)).write.parquet(path)
    cut = spark.read.schema(df.schema).parquet(path)
    cut._tessera_path = path
    _OPEN[path] = cut
    return cut


_OPEN: dict[str, DataFrame] = {}


def release_all() -> None:
    """Delete the tables of all ``cut_lineage`` calls of this process that were not released: those behind results, once
    the results are written."""
    release(*_OPEN.values())


def release(*cuts: DataFrame) -> None:
    """Delete the tables behind frames that ``cut_lineage`` made and nothing reads any more."""
    for df in list(cuts):
        jvm, path = df.sparkSession._jvm, df._tessera_path
        _OPEN.pop(path, None)
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def parallelism(spark: SparkSession) -> int:
    """Task slots worth planning for: shuffle partitions of the session, at least the default parallelism."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
