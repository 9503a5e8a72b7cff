"""What the corpus operators share: intermediate tables, names, partitions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of texts that an Arrow batch carries to a Python worker; a single text may be longer.
BATCH_BYTES = 16 << 20
#: Shuffle partitions for dealt groups, at most; beyond, a partition holds several groups, one after another.
MOST_PARTITIONS = 1 << 15

_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which driver and executors share; a temporary one in local mode where that isn't set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _temporary:
            _temporary[app] = "file://" + tempfile.mkdtemp(prefix="kinfold-")
        base = _temporary[app]
    return f"{base.rstrip('/')}/kinfold/{app}"


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables, shards and blocks that this application has written; results that weren't written elsewhere can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later uses don't recompute it, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def partitions(spark: SparkSession, groups: int) -> int:
    """Partitions to deal ``groups`` groups to: about one each, so that a task's share doesn't grow with the input."""
    return int(max(parallelism(spark), min(groups, MOST_PARTITIONS)))


def text_bytes(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """(rows, bytes of text), by one aggregation."""
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col(text_col).cast("string")))).first()
    return rows, size or 0


def free_name(taken, name: str, prefix: str) -> str:
    """``name``, or with ``prefix`` and underscores before it where a column is called so already (whatever the case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"{prefix}_{name}"
    return name


def free_names(taken, names, prefix: str) -> list[str]:
    """Names of an operator's own columns beside a caller's, which stay as they are."""
    return [free_name(taken, n, prefix) for n in names]


def held_out(id_col: str, mod: int, rest: int):
    """Whether crc32 of the id as text leaves ``rest`` modulo ``mod`` (null id: not)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))
