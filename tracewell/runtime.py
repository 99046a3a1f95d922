"""Session set-up and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "tracewell", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none and everything runs in one process (tests), a temporary
    folder is set as the context's checkpoint folder and used; a cluster has to name one.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not _in_one_process(spark):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def _in_one_process(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and "cluster" not in master


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, gives later plans exact
    sizes, and is deleted when the driver ends (or by release()).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _filesystem(spark, path)
    fs.deleteOnExit(at)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tracewell_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete tables written by materialize() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tracewell_path", None)
        if path:
            fs, at = _filesystem(df.sparkSession, path)
            fs.delete(at, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, or the same with underscores behind where df has such a column already (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python path has it already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    here = _in_one_process(spark) and os.path.realpath(os.getcwd()) == os.path.realpath(root)
    if here or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    if getattr(sc, "_tracewell_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tracewell-"), "tracewell.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "tracewell")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    sc.addPyFile(path)
    sc._tracewell_shipped = True
