"""Versioned Parquet snapshots and scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("entities", "relations", "runs", "run_entities", "run_relations")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where that is unset and Spark is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/lattica-{os.getpid()}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that loops keep short plans and lost executors cost a read."""
    path = f"{shared_dir(df.sparkSession)}/lattica/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class SnapshotStore:
    """Tables of a graph in versions; readers see the greatest version that is complete.

    A writer reads version N, writes its tables to a folder of its own, and claims N + 1 by creating the file
    COMMITS/N+1, which fails if another writer has done so: of two writers one is refused, and a write that ends early
    leaves nothing that readers see. That file lists where the parts of all tables lie; parts not written anew are those
    of the version before. Entities and relations are partitioned by namespace_id where they have it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        commits = self._path(f"{self.root}/COMMITS")
        if not self._fs.exists(commits):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(commits)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _commit(self, version: int) -> dict[str, str]:
        """Where each table of a version lies."""
        stream = self._fs.open(self._path(f"{self.root}/COMMITS/{version}"))
        try:
            lines = bytes(stream.readAllBytes()).decode().splitlines()
        finally:
            stream.close()
        return dict(line.split("\t") for line in lines if line)

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table of a version (the current one), or None; its parts may lie in folders of several versions."""
        at = self.version() if version is None else version
        where = [f"{self.root}/{p}" for key, p in self._commit(at).items() if key.split("@")[0] == name] if at else []
        out = None
        for path in where:
            part = self.spark.read.parquet(path)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def publish(self, tables: dict[str, DataFrame], base: int, *, namespaces: list[str] | None = None, append: tuple[str, ...] = ()) -> int:
        """Write version base + 1; refuses if another writer has published since base, and then writes nothing that is read.

        With namespaces, entities and relations are rows of these alone, and those of all others stay where they are.
        Tables in append are added to what there is.
        """
        if self.version() != base:
            raise RuntimeError(f"version {base} is no longer current")
        folder = f"data/{base + 1}-{uuid.uuid4().hex}"
        where = self._commit(base) if base else {}
        for name, df in tables.items():
            split = name in ("entities", "relations") and "namespace_id" in df.columns
            if split and namespaces is not None:
                # The namespace is also a column of the files, as a folder is read by itself.
                df.withColumn("_folder", df["namespace_id"]).write.partitionBy("_folder").parquet(f"{self.root}/{folder}/{name}")
                where = {k: v for k, v in where.items() if k not in {name, *(f"{name}@{n}" for n in namespaces)}}
                written = self._path(f"{self.root}/{folder}/{name}")
                held = {s.getPath().getName() for s in self._fs.listStatus(written)} if self._fs.exists(written) else set()
                # An empty namespace has no folder.
                where |= {f"{name}@{n}": f"{folder}/{name}/_folder={n}" for n in namespaces if f"_folder={n}" in held}
                continue
            (df.write.partitionBy("namespace_id") if split else df.write).parquet(f"{self.root}/{folder}/{name}")
            if name in append:
                where[f"{name}@{base + 1}"] = f"{folder}/{name}"
            else:
                where = {k: v for k, v in where.items() if k.split("@")[0] != name} | {name: f"{folder}/{name}"}
        target, temporary = self._path(f"{self.root}/COMMITS/{base + 1}"), self._path(f"{self.root}/{folder}/COMMIT")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray("".join(f"{n}\t{p}\n" for n, p in where.items()).encode()))
        stream.close()
        self._fs.mkdirs(self._path(f"{self.root}/COMMITS"))
        if self._claimed(target) or not self._move(temporary, target):
            raise RuntimeError(f"version {base} is no longer current")
        return base + 1

    def _claimed(self, target) -> bool:
        return self._fs.exists(target)

    def _move(self, temporary, target) -> bool:
        """Rename without overwriting: a local file system renames over files, so there a link is made, which never does."""
        if self._fs.getScheme() == "file":
            try:
                os.link(temporary.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return self._fs.rename(temporary, target)
