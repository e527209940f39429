"""Dataset registry (re-aimed from "CSV text in one database cell").

Each version of a dataset is written as Parquet under ``<root>/data/<id>/<version>``, so a version stays
loadable, also while a later one is made from it; its catalogue entry and
version log are small JSON-lines tables under ``<root>/catalog/`` and ``<root>/versions/``
(one file per event, append-only, so concurrent writers never rewrite each other's rows).
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = ("id string, name string, source string, rows long, trust_score double, status string, "
                  "saved_at timestamp, deleted boolean")
VERSION_SCHEMA = "id string, label string, folder string, rows long, note string, saved_at timestamp"


class DatasetRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _event(self, sub: str, row: tuple, schema: str) -> None:
        path = f"{self.root}/{sub}/{uuid.uuid4().hex}"
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(path)

    def _read(self, sub: str, schema: str) -> DataFrame:
        """The events so far; the folder is looked up through Hadoop, so any file system works."""
        path = f"{self.root}/{sub}"
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{path}/*")

    def _write(self, ds_id: str, df: DataFrame) -> tuple[str, int]:
        """A new folder with the rows, and their number."""
        folder = uuid.uuid4().hex[:12]
        df.write.parquet(f"{self.root}/data/{ds_id}/{folder}")
        return folder, self.spark.read.parquet(f"{self.root}/data/{ds_id}/{folder}").count()

    def save(self, df: DataFrame, name: str, source: str = "upload", trust_score: float | None = None,
             status: str = "imported", label: str = "v1", note: str = "") -> str:
        """Write the data, then its catalogue entry and first version record."""
        ds_id = uuid.uuid4().hex[:12]
        folder, rows = self._write(ds_id, df)
        now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        self._event("catalog", (ds_id, name, source, rows, trust_score, status, now, False), CATALOG_SCHEMA)
        self._event("versions", (ds_id, label, folder, rows, note, now), VERSION_SCHEMA)
        return ds_id

    def list(self) -> DataFrame:
        """Live datasets, newest first (the latest event per id wins)."""
        cat = self._read("catalog", CATALOG_SCHEMA)
        latest = cat.groupBy("id").agg(F.max_by(F.struct(*[c for c in cat.columns]), "saved_at").alias("e"))
        return latest.select("e.*").filter(~F.col("deleted")).drop("deleted").orderBy(F.col("saved_at").desc())

    def load(self, ds_id: str, label: str | None = None) -> DataFrame:
        """The latest version, or the latest one with that label."""
        found = self._read("versions", VERSION_SCHEMA).filter(F.col("id") == ds_id)
        found = found if label is None else found.filter(F.col("label") == label)
        last = found.orderBy(F.col("saved_at").desc()).first()
        if last is None:
            raise KeyError(f"no version {label or ''} of dataset {ds_id}")
        return self.spark.read.parquet(f"{self.root}/data/{ds_id}/{last['folder']}")

    def add_version(self, ds_id: str, df: DataFrame, label: str, note: str = "") -> None:
        """A further version; the catalogue's row count follows it."""
        folder, rows = self._write(ds_id, df)
        now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        self._event("versions", (ds_id, label, folder, rows, note, now), VERSION_SCHEMA)
        cur = self.list().filter(F.col("id") == ds_id).first()
        if cur is not None:
            self._event("catalog", (ds_id, cur["name"], cur["source"], rows, cur["trust_score"], cur["status"], now, False),
                        CATALOG_SCHEMA)

    def versions(self, ds_id: str) -> DataFrame:
        return self._read("versions", VERSION_SCHEMA).filter(F.col("id") == ds_id).orderBy("saved_at")

    def delete(self, ds_id: str) -> None:
        """Tombstone the catalogue entry (the data folder is left for the storage lifecycle)."""
        cur = self.list().filter(F.col("id") == ds_id).first()
        if cur is None:
            return
        self._event("catalog", (ds_id, cur["name"], cur["source"], cur["rows"], cur["trust_score"], cur["status"],
                                _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), True), CATALOG_SCHEMA)
