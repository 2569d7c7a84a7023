"""Versioned Parquet snapshots of the jobs table (S7), copy-on-write per bucket.

Rows live in ``n`` buckets by ``pmod(id, n)`` (ids never change, so a row stays in its
bucket). A version writes only the buckets it changes, under ``<root>/data/v=<version>/b=<b>``,
and then commits a manifest ``<root>/_manifest/v=<version>.json`` mapping every bucket to
the directory holding its current content (renamed into place, so readers see either the
old or the new version). A batch that touches a few buckets rewrites only those, whatever
the table size. Version numbers are micro-batch ids: a committed version is never written
again (R5). Files go through the session's Hadoop FileSystem (HDFS, object stores, local).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOBS_SCHEMA = (
    "id long, external_id string, title string, company string, url string, source string, "
    "search_keywords array<string>, description_raw string, location string, salary string, "
    "status string, filter_reason string, ai_score int, ai_summary string, "
    "ai_analysis_at timestamp_ntz, created_at timestamp_ntz, first_seen_at timestamp_ntz, "
    "last_seen_at timestamp_ntz, updated_at timestamp_ntz"
)
JOBS_COLUMNS = [c.split(" ")[0] for c in JOBS_SCHEMA.split(", ")]
DEFAULT_BUCKETS = 64


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    p = _path(spark, path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifest_dir(root: str) -> str:
    return f"{root.rstrip('/')}/_manifest"


def committed_versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, _manifest_dir(root))
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v=") and name.endswith(".json"):
            out.append(int(name[2:-5]))
    return sorted(out)


def latest_version(spark: SparkSession, root: str) -> int | None:
    v = committed_versions(spark, root)
    return v[-1] if v else None


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    v = latest_version(spark, root) if version is None else version
    if v is None:
        return {"version": None, "buckets": DEFAULT_BUCKETS, "files": {}}
    fs, p = _fs(spark, f"{_manifest_dir(root)}/v={v}.json")
    stream = fs.open(p)
    try:
        data = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(data)


def _commit_manifest(spark: SparkSession, root: str, doc: dict) -> None:
    final = f"{_manifest_dir(root)}/v={doc['version']}.json"
    tmp = f"{_manifest_dir(root)}/.v={doc['version']}.json.tmp"
    fs, p = _fs(spark, tmp)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(doc, sort_keys=True).encode("utf-8")))
    finally:
        out.close()
    if not fs.rename(p, _path(spark, final)):
        raise RuntimeError(f"could not commit manifest {final}")


def read(spark: SparkSession, root: str, version: int | None = None,
         buckets: list[int] | None = None) -> DataFrame:
    """The table at ``version`` (default latest), optionally only some buckets; an empty
    table when nothing is committed."""
    m = manifest(spark, root, version)
    files = m["files"]
    keys = sorted(files, key=int) if buckets is None else [str(b) for b in buckets if str(b) in files]
    if not keys:
        return spark.createDataFrame([], JOBS_SCHEMA)
    return spark.read.schema(JOBS_SCHEMA).parquet(*[f"{root.rstrip('/')}/{files[k]}" for k in keys])


def bucket_of(n: int):
    return F.pmod(F.col("id"), F.lit(n)).cast("int")


def _write_buckets(df: DataFrame, root: str, version: int, n: int) -> list[int]:
    spark = df.sparkSession
    data = f"{root.rstrip('/')}/data/v={version}"
    df.select(*JOBS_COLUMNS).withColumn("b", bucket_of(n)).write.mode("overwrite") \
        .partitionBy("b").parquet(data)
    fs, p = _fs(spark, data)
    written = []
    if fs.exists(p):
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if name.startswith("b="):
                written.append(int(name[2:]))
    return written


def write(df: DataFrame, root: str, version: int, buckets: int | None = None) -> bool:
    """Commit ``df`` as the whole table at ``version``. Returns False, writing nothing, when
    the version is already committed (a replayed batch)."""
    spark = df.sparkSession
    if version in committed_versions(spark, root):
        return False
    n = buckets or manifest(spark, root)["buckets"]
    written = _write_buckets(df, root, version, n)
    files = {str(b): f"data/v={version}/b={b}" for b in written}
    _commit_manifest(spark, root, {"version": version, "buckets": n, "files": files})
    return True


def write_changes(changed: DataFrame, root: str, version: int,
                  deleted_ids: DataFrame | None = None) -> bool:
    """Commit a version that replaces or adds the ``changed`` rows (by ``id``) and drops
    ``deleted_ids``: only the buckets holding them are rewritten (their old content minus the
    changed and deleted ids, plus the changed rows); the manifest keeps every other bucket
    where it was. The touched bucket numbers reach the driver (at most ``n`` of them)."""
    spark = changed.sparkSession
    if version in committed_versions(spark, root):
        return False
    m = manifest(spark, root)
    n = m["buckets"]
    ids = changed.select("id")
    if deleted_ids is not None:
        ids = ids.unionByName(deleted_ids.select("id"))
    touched = sorted(r.b for r in ids.select(bucket_of(n).alias("b")).distinct().collect())
    old = read(spark, root, buckets=touched)
    content = old.join(ids, "id", "left_anti").unionByName(changed.select(*JOBS_COLUMNS))
    written = set(_write_buckets(content, root, version, n)) if touched else set()
    files = dict(m["files"])
    for b in touched:
        if b in written:
            files[str(b)] = f"data/v={version}/b={b}"
        else:
            files.pop(str(b), None)  # the bucket became empty
    _commit_manifest(spark, root, {"version": version, "buckets": n, "files": files})
    return True


def prune(spark: SparkSession, root: str, retain: int = 3) -> list[int]:
    """Drop manifests older than the newest ``retain`` and the data directories no retained
    manifest refers to. Returns the dropped version numbers."""
    vs = committed_versions(spark, root)
    keep, gone = vs[-retain:] if retain > 0 else [], vs[:-retain] if retain > 0 else vs
    live = set()
    for v in keep:
        live |= {f.split("/")[1] for f in manifest(spark, root, v)["files"].values()}
    for v in gone:
        fs, p = _fs(spark, f"{_manifest_dir(root)}/v={v}.json")
        fs.delete(p, False)
        if f"v={v}" not in live:
            fs2, p2 = _fs(spark, f"{root.rstrip('/')}/data/v={v}")
            fs2.delete(p2, True)
    return gone
