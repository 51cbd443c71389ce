"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loglattice")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a fresh local one, which only a local master may use."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loglattice-"))
    return sc.getCheckpointDir().rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = filesystem(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it doesn't exist."""
    fs, p = filesystem(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def removed(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def created_alone(spark: SparkSession, path: str, content: str) -> bool:
    """Creates a file, whole, and says whether it was this call that did: of several writers one gets True.

    The content is written aside and then given its name: by a hard link on a
    local file system, elsewhere by a rename that refuses an existing name,
    which the file system must do atomically (as HDFS does).
    """
    sc = spark.sparkContext
    fs, p = filesystem(spark, path)
    aside = sc._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    fs.mkdirs(p.getParent())
    out = fs.create(aside, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(aside.toUri().getPath(), p.toUri().getPath())
                return True
            except FileExistsError:
                return False
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            files.rename(fs.makeQualified(aside), fs.makeQualified(p), sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
    finally:
        fs.delete(aside, False)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared root, in this application's own folder, which goes when the application ends."""
    own = f"{shared_root(spark)}/loglattice/{spark.sparkContext.applicationId}"
    fs, p = filesystem(spark, own)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by writing a table to the shared folder and reading it again."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Lets Python workers find this package wherever the session was started: as a zip archive of its modules."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(sc._temp_dir, "loglattice.zip")  # goes with the context; executors fetch it when they start
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(package):
            for path in (os.path.join(at, n) for n in names if n.endswith(".py")):
                z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
