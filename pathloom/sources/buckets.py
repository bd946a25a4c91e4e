"""Tables in hashed buckets, of which a batch rewrites only those that it touches.

A table is a folder: data/<run>/bucket=<n>/ has the rows of a bucket as one run wrote them, and manifests/v<version>.json names
the run of each bucket. A version is there once its manifest is; a run that breaks off leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pathloom.sources.sinks import last_by, upserted


def _files(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def versions(spark: SparkSession, path: str) -> list[int]:
    files, folder = _files(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def read_manifest(spark: SparkSession, path: str, version: int) -> dict:
    lines = spark.read.text(f"{path}/manifests/v{version}.json", wholetext=True)
    return json.loads(lines.first()["value"])


def commit(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    """Writes the manifest aside and renames it; a version that is there already is an error."""
    files, folder = _files(spark, f"{path}/manifests")
    files.mkdirs(folder)
    aside, name = (_files(spark, f"{path}/manifests/{n}")[1] for n in (f".{uuid.uuid4().hex}", f"v{version}.json"))
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if files.exists(name) or not files.rename(aside, name):
        files.delete(aside, False)
        raise FileExistsError(f"version {version} of {path} is there already")


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create_buckets(spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64) -> None:
    """An empty table of version 0. keys tell rows apart, and buckets by their hash; there should be enough buckets that one suits a task."""
    commit(spark, path, 0, {"keys": keys, "buckets": buckets, "schema": json.loads(schema.json()), "runs": {}})


def read_buckets(spark: SparkSession, path: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of a version, the last one's if none is given; `only`: of these buckets. Other buckets' files aren't opened."""
    version = versions(spark, path)[-1] if version is None else version
    manifest = read_manifest(spark, path, version)
    wanted = manifest["runs"] if only is None else {b: r for b, r in manifest["runs"].items() if int(b) in only}
    folders = [f"{path}/data/{run}/bucket={b}" for b, run in sorted(wanted.items())]
    schema = StructType.fromJson(manifest["schema"])
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_buckets(spark: SparkSession, path: str, new: DataFrame, seq: str = "seq", version: int | None = None) -> int:
    """Puts rows over those of the same keys (within new the greatest seq wins) as the next version, or as `version`; returns it.

    Only buckets that new has rows for are read and written. A version that is there already stays as it is, so a batch that is run again
    under its number changes nothing; it is put over the highest version below.
    """
    known = versions(spark, path)
    version = known[-1] + 1 if version is None else version
    if version in known:
        return version
    manifest = read_manifest(spark, path, max(v for v in known if v < version))
    keys, buckets = manifest["keys"], manifest["buckets"]
    names = [f["name"] for f in manifest["schema"]["fields"]]
    new = last_by(new.select(*names), keys, seq)
    touched = sorted(r[0] for r in new.select(bucket_of(keys, buckets)).distinct().collect())  # buckets at most
    before = max(v for v in known if v < version)
    merged = upserted(read_buckets(spark, path, before, touched), new, keys, seq)
    run = f"v{version}-{uuid.uuid4().hex}"
    rows = merged.select(*names).withColumn("bucket", bucket_of(keys, buckets))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{run}")
    commit(spark, path, version, manifest | {"runs": manifest["runs"] | {str(b): run for b in touched}})
    return version


def delete_unnamed(spark: SparkSession, path: str) -> int:
    """Deletes runs that no manifest names, as broken runs leave them; nothing may be writing. Returns how many."""
    named = {run for v in versions(spark, path) for run in read_manifest(spark, path, v)["runs"].values()}
    files, folder = _files(spark, f"{path}/data")
    left = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName() not in named] if files.exists(folder) else []
    for p in left:
        files.delete(p, True)
    return len(left)
