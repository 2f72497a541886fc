"""Versions of a table in a folder: written beside the old ones, and current once the manifest says so."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


def _files(spark: SparkSession, path: str):
    """The folder's file system, by which a rename is one step, and a maker of its paths."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest complete manifest: {"current": name, "versions": {name: {"bucket", "buckets", "columns"}}}; None before the first version."""
    store, at = _files(spark, root)
    known = sorted(s.getPath().getName() for s in store.listStatus(at(root)) if s.getPath().getName().endswith(f".{MANIFEST}")) if store.exists(at(root)) else []
    if not known:
        return None
    stream = store.open(at(f"{root}/{known[-1]}"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_version(df: DataFrame, root: str, bucket: list[str], buckets: int = 64) -> str:
    """Writes df as a new version, in buckets of columns, and returns its name; readers keep to the old version until ``swap``."""
    spark, name = df.sparkSession, f"v_{uuid.uuid4().hex}"
    table = f"snapshot_{name}"
    df.repartition(buckets, *bucket).sortWithinPartitions(*bucket).write.bucketBy(buckets, *bucket).sortBy(*bucket).option("path", f"{root}/{name}").format("parquet").saveAsTable(table)
    spark.sql(f"drop table {table}")  # the files stay: the table is external
    store, at = _files(spark, root)
    out = store.create(at(f"{root}/{name}.json"))
    out.write(json.dumps({"bucket": bucket, "buckets": buckets, "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]}).encode())
    out.close()
    return name


def swap(spark: SparkSession, root: str, name: str) -> None:
    """Makes a written version current: a numbered manifest is written under another name and renamed, which fails if that number is taken."""
    store, at = _files(spark, root)
    stream = store.open(at(f"{root}/{name}.json"))
    try:
        own = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    old = manifest(spark, root) or {"number": 0, "versions": {}}
    new = {"number": old["number"] + 1, "current": name, "versions": old["versions"] | {name: own}}
    draft, final = at(f"{root}/.{uuid.uuid4().hex}"), at(f"{root}/{new['number']:09d}.{MANIFEST}")
    out = store.create(draft)
    out.write(json.dumps(new).encode())
    out.close()
    if store.exists(final) or not store.rename(draft, final):
        store.delete(draft, False)
        raise RuntimeError(f"another version of {root} became current meanwhile")


def read_version(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """A version, the current one by default, as a table in buckets: joins and groupings on its bucket columns don't shuffle it."""
    known = manifest(spark, root)
    if known is None:
        raise ValueError(f"{root} has no version")
    name = name or known["current"]
    own, table = known["versions"][name], f"snapshot_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f['name']}` {f['type']}" for f in own["columns"])
    by = ", ".join(f"`{c}`" for c in own["bucket"])
    spark.sql(f"create table {table} ({columns}) using parquet clustered by ({by}) sorted by ({by}) into {own['buckets']} buckets location '{root}/{name}'")
    out = spark.table(table)
    spark.sql(f"drop table {table}")
    return out


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes all but the ``keep`` newest versions that were current, and what was written and never became current before them."""
    known = manifest(spark, root)
    if known is None:
        return []
    store, at = _files(spark, root)
    stay = set(list(known["versions"])[-keep:]) | {known["current"]}
    gone = [s.getPath().getName() for s in store.listStatus(at(root)) if s.isDirectory() and s.getPath().getName().startswith("v_") and s.getPath().getName() not in stay]
    for name in gone:
        store.delete(at(f"{root}/{name}"), True)
        store.delete(at(f"{root}/{name}.json"), False)
    return gone
