"""Session helpers: where intermediate tables go, and how they are written."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` names it.  Only where that is unset and the master is a
    single-JVM ``local`` one does a folder of this machine serve; on a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "at" not in _local:
        _local["at"] = "file://" + tempfile.mkdtemp(prefix="corvella-")
    return _local["at"]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    Cuts the lineage like a reliable checkpoint does, but columnar: later readers fetch only
    the columns they name, and a lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/corvella-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Words of 64 bits in a bitmap of keys: two megabytes, whatever the number of keys.
BITMAP_WORDS = 1 << 18


def marked(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``keys`` (its only column, of the same name): all that are, and some that are not.

    The keys become a bitmap of fixed size, the only thing that is sent around.  Put before a join it keeps most rows without a partner out of the
    shuffle; the join must follow, as rows that only share a bit pass.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(BITMAP_WORDS * 64))
    slots = keys.select(F.floor(bit / 64).cast("int").alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bits")).groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    every = keys.sparkSession.range(BITMAP_WORDS).select(F.col("id").cast("int").alias("slot")).join(slots, "slot", "left")
    bitmap = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("bitmap")).scalar()
    # a filter, not a join: the optimiser would move a semi join that follows below another join
    return df.where(F.call_function("shiftright", bitmap[F.floor(bit / 64).cast("int")], (bit % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``materialise`` wrote for this session."""
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for owner, path in [x for x in _written if x[0] is spark]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        _written.remove((owner, path))


@atexit.register
def _at_exit() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            release(spark)
        except Exception:  # the session or its JVM has already ended
            pass


def ensure_defaults(spark: SparkSession) -> SparkSession:
    """Settings that results depend on: UTC session time."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_defaults(spark).read.parquet(f"{sf_dir}/{name}.parquet")
