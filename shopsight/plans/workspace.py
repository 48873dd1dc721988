"""Per-folder workspace: stand-in tables, the joined fact table, the cleaned table and
the model table, with the numbers and models fitted on them (S4, like the reference's
cached loader).

Everything kept belongs to one state of the input files: their paths, lengths and times
are listed whenever a workspace is asked for, and once they differ, tables are released
and fitted results forgotten.  The joined table is written once, as Parquet in the shared
checkpoint folder, and every fit and report reads the columns that it needs from there,
so that the joins shuffle the input once and not once a pass.  The tables made from it
are persisted (memory and disk) only if the input files hold at most
``persist_max_bytes``.  Beyond that the cleaned table is a projection of the joined one,
and the model table, which learners read many times, is written like it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shopsight.operators.clean import Cleaner, CleanModel
from shopsight.session import ensure_checkpoint_dir
from shopsight.sources.joined import join_facts
from shopsight.sources.standin import TABLES, load_tables

PERSIST_MAX_BYTES = 256 << 20
_WS_CACHE: dict[tuple[str, str], "Workspace"] = {}


def file_state(spark: SparkSession, paths: list[str]) -> tuple[tuple[str, int, int], ...]:
    """(path, length, time) of every data file below ``paths``, by Hadoop's listing, so
    any file system that Spark reads will do.  Names that Spark ignores are left out."""
    found = []
    for path in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


class Workspace:
    """``Workspace(spark, folder)`` gives the same object while the folder's files stay
    as they are."""

    def __new__(cls, spark: SparkSession, sf_dir: str, persist_max_bytes: int = PERSIST_MAX_BYTES):
        folder = sf_dir.rstrip("/")
        key = (spark.sparkContext.applicationId, folder)
        state = file_state(spark, [f"{folder}/{t}.parquet" for t in TABLES])
        ws = _WS_CACHE.get(key)
        if ws is not None and ws.state != state:
            ws.release()
            ws = None
        if ws is None:
            ws = super().__new__(cls)
            ws._init(spark, folder, state, persist_max_bytes)
            _WS_CACHE[key] = ws
        return ws

    def _init(self, spark: SparkSession, folder: str, state, persist_max_bytes: int):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.sf_dir = folder
        self.state = state
        self.tables = load_tables(spark, folder)
        self._persists = sum(length for _, length, _ in state) <= persist_max_bytes
        self._kept: list[DataFrame] = []
        self._written: list[str] = []
        self._made: dict[str, object] = {}

    def _table(self, name: str, make) -> DataFrame:
        """A table planned once and persisted where the input is small enough."""
        def kept():
            df = make()
            if self._persists:
                self._kept.append(df.persist())
            return df
        return self.fitted(name, kept)

    def _stored(self, name: str, make) -> DataFrame:
        """A table written once to the shared checkpoint folder and read from there."""
        def stored():
            df = make()
            path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/shopsight-tables/{name}-{uuid.uuid4().hex}"
            self._written.append(path)
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        return self.fitted(name, stored)

    def raw(self) -> DataFrame:
        """J1+J2: joined, not cleaned."""
        t = self.tables
        return self._stored("raw", lambda: join_facts(t["transactions"], t["customers"], t["products"]))

    def clean_model(self) -> CleanModel:
        return self.fitted("clean_model", lambda: Cleaner().fit(self.raw()))

    def clean(self) -> DataFrame:
        """the cleaned fact table every report reads."""
        return self._table("clean", lambda: self.clean_model().transform(self.raw()))

    def model_table(self) -> DataFrame:
        """Encoded features, target and split."""
        from shopsight.operators.features import label_encoded_features
        from shopsight.operators.sampling import train_validation_split
        def make():
            return train_validation_split(label_encoded_features(self.clean()), 20, 42)
        return self._table("model_table", make) if self._persists else self._stored("model_table", make)

    def fitted(self, name: str, make):
        """Memoise a fitted model, plan or small result for this state of the files."""
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def release(self) -> None:
        """Unpersist the tables, delete the written ones and forget what was fitted on them."""
        for df in self._kept:
            df.unpersist()
        for name in self._written:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self._written.clear()
        self._kept.clear()
        self._made.clear()
