"""Several tables committed at once: new folders for the rows, and one manifest that makes them visible.

Under a root, rows/ has a folder for each write and manifests/ a numbered file for each version. A version is visible when
its manifest is complete; the file is created exclusively, so of two writers one gets the number and the other a Conflict.
What stops before its manifest leaves folders that no manifest names: readers never see them, and vacuum() removes them.

A manifest has of every table its schema, its folders with the version that brought each, the number of rows and a digest:
the sum of the rows' hashes, so it does not depend on their order. Both are taken from what was written, not from the plan.
"""

from __future__ import annotations

import json
import uuid
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has taken the version."""


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    system, where = _at(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []


def measure(df: DataFrame) -> tuple[int, str]:
    """Number of rows and digest, in one pass."""
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    got = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(Decimal(0))).alias("sum")).first()
    return got.n, str(int(got.sum))


def stage(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> dict:
    """Writes tables to new folders, and measures them there. Nothing is visible yet."""
    out = {}
    for name, df in tables.items():
        folder = f"rows/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/{folder}")
        n, digest = measure(spark.read.schema(df.schema).parquet(f"{root}/{folder}"))
        out[name] = {"schema": df.schema.jsonValue(), "parts": [{"folder": folder, "rows": n, "digest": digest}]}
    return out


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers that are taken, complete or not."""
    return [int(n.removesuffix(".json")) for n in names_in(spark, f"{root}/manifests") if n.endswith(".json")]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """A version's manifest, or the newest complete one; one that was cut off while it was written counts as none."""
    for n in [version] if version is not None else reversed(versions(spark, root)):
        system, where = _at(spark, f"{root}/manifests/{n:09}.json")
        stream = system.open(where)
        try:
            found = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            continue
        finally:
            stream.close()
        if found.get("complete"):
            return found
    return None


def publish(spark: SparkSession, root: str, tables: dict, version: int) -> int:
    """Makes staged tables the given version, or raises Conflict."""
    for t in tables.values():
        for part in t["parts"]:
            part.setdefault("version", version)
    system, where = _at(spark, f"{root}/manifests/{version:09}.json")
    try:
        out = system.create(where, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            raise Conflict(f"version {version} of {root} exists") from e
        raise
    try:
        out.write(bytearray(json.dumps({"version": version, "tables": tables, "complete": True}).encode()))
    finally:
        out.close()
    return version


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """The given tables, and of the version before those that are not given, as the next version."""
    known = versions(spark, root)
    before = manifest(spark, root)
    staged = stage(spark, root, tables)
    return publish(spark, root, (before["tables"] if before else {}) | staged, max(known, default=0) + 1)


def append(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Rows behind what the tables have. Rows are written once; a writer that comes second takes the next version."""
    staged = stage(spark, root, tables)
    while True:
        known, before = versions(spark, root), manifest(spark, root)
        now = dict(before["tables"]) if before else {}
        for name, new in staged.items():
            if name in now and now[name]["schema"] != new["schema"]:
                raise ValueError(f"{name} has another schema")
            now[name] = {"schema": new["schema"], "parts": [*(now[name]["parts"] if name in now else []), *(dict(p) for p in new["parts"])]}
        try:
            return publish(spark, root, now, max(known, default=0) + 1)
        except Conflict:
            continue


def read(spark: SparkSession, root: str, name: str, version: int | None = None, added_in: str | None = None) -> DataFrame:
    """A table of a version (the newest); added_in names a column for the version that brought a row."""
    found = manifest(spark, root, version)
    if found is None or name not in found["tables"]:
        raise ValueError(f"{root} has no table {name}")
    schema = StructType.fromJson(found["tables"][name]["schema"])
    parts = found["tables"][name]["parts"]
    if added_in is None:
        return spark.read.schema(schema).parquet(*(f"{root}/{p['folder']}" for p in parts))
    one = [spark.read.schema(schema).parquet(f"{root}/{p['folder']}").withColumn(added_in, F.lit(p["version"])) for p in parts]
    out = one[0]
    for df in one[1:]:
        out = out.unionByName(df)
    return out


def broken(spark: SparkSession, root: str, version: int | None = None) -> list[str]:
    """Folders whose rows are not those that the manifest has measured."""
    found, out = manifest(spark, root, version), []
    for t in found["tables"].values() if found else []:
        for p in t["parts"]:
            try:
                same = measure(spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{root}/{p['folder']}")) == (p["rows"], p["digest"])
            except Exception:  # noqa: BLE001  a file that is gone or cut off is what is looked for
                same = False
            if not same:
                out.append(p["folder"])
    return out


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Removes folders that none of the newest `keep` complete versions names, and those versions' older manifests."""
    complete = [m for v in versions(spark, root) if (m := manifest(spark, root, v))]
    stay = complete[-keep:]
    used = {p["folder"].split("/")[1] for m in stay for t in m["tables"].values() for p in t["parts"]}
    gone = [f"rows/{n}" for n in names_in(spark, f"{root}/rows") if n not in used] + [f"manifests/{m['version']:09}.json" for m in complete[:-keep]]
    for path in gone:
        system, where = _at(spark, f"{root}/{path}")
        system.delete(where, True)
    return gone
