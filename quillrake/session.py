"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest size of a side that the library broadcasts by its own hint.
BROADCAST_LIMIT_BYTES = 64 << 20


def build_session(cpus: int = 8, memory: str = "8g", name: str = "quillrake") -> SparkSession:
    """Local session with the settings that the library assumes."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made, which only a local session may use.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillrake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def workdir(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the shared folder; it goes when the application ends, or with ``discard`` before."""
    path = f"{shared_root(spark)}/quillrake-{tag}-{uuid.uuid4().hex}"
    p, fs = hadoop_path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    _made(spark).append(path)
    return path


def _made(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_quillrake_folders"):
        sc._quillrake_folders = []
    return sc._quillrake_folders


@contextlib.contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Delete at its end the work folders that were made inside: what was read from them must be done with."""
    held = len(_made(spark))
    try:
        yield
    finally:
        for path in _made(spark)[held:]:
            delete_path(spark, path)
        del _made(spark)[held:]


def small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the summed length of its values, and 64 bytes a row, are within the limit; as it is otherwise."""
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back: cuts the lineage and survives the loss of executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target, fs = hadoop_path(spark, path)
    fs.delete(target, True)


def hadoop_path(spark: SparkSession, path: str):
    """A path of the session's file systems, and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A JSON file of a file system; None if there is none."""
    p, fs = hadoop_path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def replace_json(spark: SparkSession, path: str, document: dict) -> None:
    """Put a JSON file in the place of the one at ``path``, if any, at once: readers see the old one or the new one."""
    jvm = spark.sparkContext._jvm
    (new, fs), (final, _) = hadoop_path(spark, f"{path}.new"), hadoop_path(spark, path)
    out = fs.create(new, True)
    try:
        out.write(bytearray(json.dumps(document).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(final).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(final), options)


@contextlib.contextmanager
def exclusive(spark: SparkSession, path: str) -> Iterator[None]:
    """Hold the file ``path`` as a lock; fails at once if another process holds it.

    A holder that died leaves its file, which names it: to be deleted by hand once that process is known to be gone.
    """
    p, fs = hadoop_path(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        raise RuntimeError(f"{path} is held by another writer") from e
    try:
        out.write(bytearray(spark.sparkContext.applicationId.encode()))
        out.close()
        yield
    finally:
        fs.delete(p, False)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, in case it isn't installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_quillrake_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillrake-")) / "quillrake.zip"  # the driver's own copy, to upload from
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(Path("quillrake") / f.relative_to(package)))
    sc.addPyFile(str(archive))
    sc._quillrake_shipped = True


def is_directory(spark: SparkSession, path: str) -> bool:
    """Whether a path of the session's file system is a folder."""
    p, fs = hadoop_path(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())
