"""Session settings, table loading and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build(app: str = "docweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; a running session is reused."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | conf)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context: their Python need not have it on its path."""
    context = spark.sparkContext
    if getattr(context, "_docweave_sent", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="docweave-package-")) / "docweave.zip"  # read by the driver's own file server
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._docweave_sent = True


def prepare(spark: SparkSession) -> SparkSession:
    """Time stamps without zone are UTC here, so casts need a UTC session; and executors need this package."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir; a temporary one where that is unset and all runs in one process.

    On a cluster an unset folder is an error, as a folder of one machine would lose rows there.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='docweave-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What a query that is written inside shuffles is removed when it ends, and not only when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Written tables in the shared folder, to cut lineage in a way that survives lost executors.

    Each table is plain Parquet, so a later read needs no executor's memory or disk. They are
    removed by drop(), and what is left when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = prepare(spark)
        self.base = f"{shared_folder(spark)}/docweave-{label}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def has(self, name: str, part: str) -> bool:
        """Whether a table written with partition_by has rows in a part such as step=raked; a look at the folder, no job."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/{part}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, name: str) -> None:
        self._delete(self.path(name))

    def clear(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
