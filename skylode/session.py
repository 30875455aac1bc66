"""Session helpers: a local session for tests and benches, and the shared folder for cut lineages."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: dict[str, str] = {}
#: Applications whose scratch folder is deleted when the driver's Python ends.
_SWEPT: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, in UTC, with adaptive execution on."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skylode")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor reaches: spark.checkpoint.dir; on a local master without one, a temporary folder."""
    if given := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIR:
        _LOCAL_DIR[app] = tempfile.mkdtemp(prefix="skylode-")
    return _LOCAL_DIR[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/skylode-{app}"
    if app not in _SWEPT:
        _SWEPT.add(app)
        atexit.register(_sweep, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _sweep(spark: SparkSession, root: str) -> None:
    try:
        drop_path(spark, root)
    except Exception:  # noqa: BLE001  the session was stopped before: the folder is left to whoever clears the shared one
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    return Scratch(df.sparkSession).write(df, name)


class Scratch:
    """Tables of one computation in the shared folder, dropped as soon as later ones have taken their place."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table, read back."""
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def keep(self, *tables: DataFrame) -> None:
        """Drop every table but these, which nothing later may read any more."""
        kept = [(t, p) for t, p in self.tables if any(t is k for k in tables)]
        for t, p in self.tables:
            if not any(t is k for k in tables):
                drop_path(self.spark, p)
        self.tables = kept


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file through the file system that holds the path; the path must not exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    stream.write(content)
    stream.close()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
