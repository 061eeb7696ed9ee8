"""The chunk index as a table: point ids, checks, upsert, replacement, purge."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.runtime import materialize

DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"  # fixed value: the name space of DNS names


def point_id(chunk_id: Column) -> Column:
    """The version-5 UUID of a chunk id."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(chunk_id, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def check_vectors(points: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(fit, unfit): points without a vector, or with one of another length, are errors."""
    good = F.coalesce(F.size("embedding") == dim, F.lit(False))
    return points.filter(good), points.filter(~good).withColumn("error", F.when(F.col("embedding").isNull(), "missing_vector").otherwise("wrong_dimension"))


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with all new points; of a point id the new row stays (of several new ones the last by chunk and text)."""
    last = Window.partitionBy("point_id").orderBy(F.desc("chunk_id"), F.desc("text"))
    fresh = new.withColumn("point_id", point_id(F.col("chunk_id"))).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    return index.join(fresh.select("point_id"), "point_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def write_index(index: DataFrame, path: str) -> None:
    """Replaces the partitions of the domains that index holds; others stay. The rows are written aside first, as index may
    read the same path."""
    held = materialize(index, "index")
    held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain").parquet(path)


def purge_files(files: DataFrame, domains: DataFrame, used: DataFrame, domain: str) -> DataFrame:
    """files(path) that go with a domain: named after it (the domain, or it and an underscore first), where no longer domain
    fits, and not used(domain, path) by another one."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    parts = files.select("path", name.alias("name")).withColumn("w", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", "_"))), lambda i: F.array_join(F.slice(F.split("name", "_"), 1, i), "_"))))
    owner = parts.join(domains.select(F.col("domain").alias("w")), "w").groupBy("path").agg(F.max_by("w", F.length("w")).alias("owner"))
    other = used.filter(F.col("domain") != domain).select("path")
    return owner.filter(F.col("owner") == domain).select("path").join(other, "path", "left_anti")


def purge_versions(registry: DataFrame, domain: str) -> DataFrame:
    return registry.filter(F.col("domain") != domain)


class IndexStore:
    """A chunk index below a folder, whose domains are folders of their own. A manifest names the folder of each domain, that of
    the registry of sources, and the last batch of each domain. A change writes new folders and then one manifest with the
    next number, by a rename: readers see the old or the new state, and a job that dies before that has changed nothing."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest manifest."""
        at = self._path(f"{self.root}/manifests")
        numbers = [int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(at) if f.getPath().getName().endswith(".json")] if self._fs.exists(at) else []
        if not numbers:
            return {"version": 0, "domains": {}, "registry": None, "batches": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{max(numbers)}.json", wholetext=True).first()[0])

    def index(self, domain: str | None = None) -> DataFrame | None:
        """The rows of all domains, or of one; None where there are none yet."""
        folders = [f for d, f in sorted(self.manifest()["domains"].items()) if domain in (None, d)]
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else None

    def registry(self) -> DataFrame:
        """(domain, path, hash, indexed_at) of the sources that are in the index."""
        folder = self.manifest()["registry"]
        return self.spark.read.schema(REGISTRY).parquet(f"{self.root}/{folder}") if folder else self.spark.createDataFrame([], REGISTRY)

    def write(self, rows: DataFrame, name: str) -> str:
        """A new folder with rows, which no manifest names yet."""
        folder = f"{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return folder

    def commit(self, manifest: dict) -> None:
        """Makes manifest, the changed copy of the one read, the newest; an error if another job was faster."""
        number = manifest["version"] + 1
        target, aside = self._path(f"{self.root}/manifests/{number}.json"), self._path(f"{self.root}/manifests/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(manifest | {"version": number}).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise RuntimeError(f"manifest {number} is there already: another job has changed the index")

    def purge(self, domain: str) -> None:
        """The domain's rows, its sources and its last batch go in one step; its folder goes after that."""
        manifest = self.manifest()
        registry = self.write(purge_versions(self.registry(), domain), "registry")
        folder = manifest["domains"].pop(domain, None)
        manifest["batches"].pop(domain, None)
        self.commit(manifest | {"registry": registry})
        if folder:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def vacuum(self) -> list[str]:
        """Deletes folders that the newest manifest doesn't name, which dead jobs and replaced states leave. No job may be
        writing, and no reader be on an older state."""
        manifest = self.manifest()
        named = {*manifest["domains"].values(), manifest["registry"], "manifests"}
        gone = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root)) if f.getPath().getName() not in named]
        for name in gone:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return sorted(gone)


REGISTRY = "domain string, path string, hash string, indexed_at timestamp"
