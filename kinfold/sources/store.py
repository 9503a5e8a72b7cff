"""Stage tables: where they are, how they are written, and resuming after a stop."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_temporary: dict[str, str] = {}
_made: dict[tuple[str, str], str] = {}


def session_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which driver and executors share; a temporary one in local mode where that isn't set."""
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _temporary.get(app) or _temporary.setdefault(app, "file://" + tempfile.mkdtemp(prefix="kinfold-"))
    return f"{base.rstrip('/')}/kinfold/{app}"


def once(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made and written when this application first asks for ``name``, and read from then on."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _made:
        path = f"{session_dir(spark)}/once-{uuid.uuid4().hex}"
        make().write.option("compression", "zstd").parquet(path)
        _made[key] = path
    return spark.read.parquet(_made[key])


@dataclass
class Store:
    """Tables of one run under a root that Spark can reach; country and src are partition columns."""

    spark: SparkSession
    root: str

    def path(self, kind: str, split: str = "", tag: str = "") -> str:
        return "/".join(p for p in (self.root.rstrip("/"), kind, split, tag) if p)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def done(self, path: str) -> bool:
        """Whether a table was written to its end."""
        fs, p = self._fs(f"{path}/_SUCCESS")
        return bool(fs.exists(p))

    def write(self, df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        self._put(f"{path}/_schema", df.schema.json())  # a table without rows has no file that tells it

    def read(self, path: str) -> DataFrame:
        text = self._get(f"{path}/_schema")
        reader = self.spark.read.schema(T.StructType.fromJson(json.loads(text))) if text else self.spark.read
        return reader.parquet(path)

    def _put(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _get(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(p), "UTF-8")

    def stage(self, path: str, make: Callable[[], DataFrame], by: tuple[str, ...] = (), force: bool = False) -> DataFrame:
        """The table at ``path``; made and written only if it isn't there or ``force`` is set."""
        if force or not self.done(path):
            self.write(make(), path, by)
        return self.read(path)

    def mark(self, path: str) -> None:
        """Note that what is at ``path`` (a model) was written to its end."""
        fs, p = self._fs(f"{path}/_DONE")
        fs.create(p, True).close()

    def marked(self, path: str) -> bool:
        fs, p = self._fs(f"{path}/_DONE")
        return bool(fs.exists(p))

    def countries(self, path: str) -> list[str]:
        """The values of the partition column country."""
        return sorted(r[0] for r in self.read(path).select("country").distinct().collect())

    def put_state(self, name: str, value: dict) -> None:
        self._put(self.path("state", f"{name}.json"), json.dumps(value, ensure_ascii=False))

    def get_state(self, name: str, default: dict | None = None) -> dict | None:
        text = self._get(self.path("state", f"{name}.json"))
        return default if text is None else json.loads(text)
