"""Session helpers: reading tables, cutting lineage, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of single-column key rows that may be broadcast (16 bytes a row: about 16 MB).
BROADCAST_ROWS = 1_000_000
#: Bytes of a row group in the tables that :func:`cut` writes.
ROW_GROUP = 8_388_608

_written: list[tuple[SparkSession, str]] = []


def session(app: str = "lodesift", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per context, so that they need no copy on their path."""
    context = spark.sparkContext
    if getattr(context, "_lodesift_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lodesift-")) / "lodesift.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._lodesift_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one parquet table (a file or a folder of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may do without and gets a fresh one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lodesift-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def clean() -> None:
    """Delete the tables that :func:`cut` has written so far. Results that still need them must be stored first."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


atexit.register(clean)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later stages start from files every executor can reach, so a lost executor costs one task and
    not the whole lineage, and a plan used twice is computed once. The files go with :func:`clean`, at
    interpreter exit at the latest.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodesift-{uuid.uuid4().hex}"
    # small row groups: whoever reads the table can share it out evenly
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def keep_keys(df: DataFrame, keys: DataFrame, column: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left semi join of ``df`` with distinct ``keys`` on ``column``.

    ``keys`` should be cheap to count (a cut table). Up to ``limit`` rows they are broadcast, so ``df``
    does not move; beyond it both sides are shuffled.
    """
    if keys.count() <= limit:
        keys = F.broadcast(keys)
    return df.join(keys, column, "left_semi")
