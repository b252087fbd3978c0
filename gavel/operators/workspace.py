"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; set here only where it is unset, in local runs."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gavel-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Workspace:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive executors.

    ``drop`` frees a table as soon as nothing reads it; what a returned DataFrame still reads goes at exit.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}", 0
        self.live: set[str] = set()
        atexit.register(self.drop, self.root)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.stored_at = path
        self.live.add(path)
        return back

    def write_over(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Writes a smaller version of a table and drops the old one."""
        back = self.write(new)
        self.drop(old)
        return back

    def drop_all_but(self, *tables: DataFrame) -> None:
        keep = {t.stored_at for t in tables}
        for path in self.live - keep:
            self.drop(path)
        self.live &= keep

    def drop(self, table: DataFrame | str) -> None:
        path = table if isinstance(table, str) else table.stored_at
        try:
            jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended: nothing is left to clean with
            pass
