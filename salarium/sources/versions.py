"""Table versions: data folders that are written once, and numbered manifests
that name the folders of each table.

A commit first writes its data into fresh folders and then makes one small
manifest visible by an atomic rename to the next number.  A job that dies in
between leaves folders that no manifest names: readers keep the last version,
and ``vacuum`` removes the leftovers.  A rename does not replace a manifest
that is there, so of two writers that start from one version the second fails
instead of undoing the first (on HDFS and POSIX; an object store must offer
such a rename through its committer).

A table is the union of its folders, so a commit may ``put`` a table anew or
``add`` a folder to it, and every reader sees all tables of one commit or
none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_versions"
DIGITS = 12


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, base: str) -> list[int]:
    """Committed versions, oldest first."""
    fs, folder = _fs(spark, f"{base}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, base: str, version: int | None = None) -> dict[str, list[str]]:
    """Folders of each table (relative to ``base``) in a version, the last
    one by default; no table where nothing was committed."""
    known = versions(spark, base)
    if not known:
        return {}
    version = known[-1] if version is None else version
    if version not in known:
        raise ValueError(f"{base} has no version {version}")
    fs, path = _fs(spark, f"{base}/{MANIFESTS}/{version:0{DIGITS}d}.json")
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read_table(spark: SparkSession, base: str, name: str, version: int | None = None, schema=None) -> DataFrame:
    """A table of a version."""
    folders = manifest(spark, base, version).get(name)
    if not folders:
        raise ValueError(f"{base} has no table {name}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*[f"{base}/{f}" for f in folders])


def stage(df: DataFrame, base: str, name: str, sort_within=None) -> str:
    """Write ``df`` into a fresh folder of table ``name``; no reader sees it
    before a commit.  The folder, relative to ``base``."""
    folder = f"data/{name}/{uuid.uuid4().hex}"
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    df.write.mode("errorifexists").parquet(f"{base}/{folder}")
    return folder


def commit(spark: SparkSession, base: str, put: dict[str, str] | None = None, add: dict[str, str] | None = None,
           after: int | None = None) -> int:
    """Make staged folders visible: ``put`` replaces a table, ``add`` extends
    it, all in one version.  ``after``: the version that the new one builds
    on (by default the last); if another commit came in between, this one
    fails."""
    known = versions(spark, base)
    last = known[-1] if known else 0
    if after is not None and after != last:
        raise RuntimeError(f"{base} is at version {last}, not {after}")
    tables = manifest(spark, base, last) if known else {}
    tables.update({name: [folder] for name, folder in (put or {}).items()})
    for name, folder in (add or {}).items():
        tables[name] = [*tables.get(name, []), folder]
    fs, target = _fs(spark, f"{base}/{MANIFESTS}/{last + 1:0{DIGITS}d}.json")
    _, draft = _fs(spark, f"{base}/{MANIFESTS}/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
    finally:
        out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # fails where the number is taken
    context.rename(fs.makeQualified(draft), fs.makeQualified(target), how)
    return last + 1


def vacuum(spark: SparkSession, base: str, keep: int = 2) -> int:
    """Remove all but the last ``keep`` versions and every data folder that
    none of those names; run it when no writer is at work.  The number of
    folders removed."""
    known = versions(spark, base)
    held = {f for v in known[-keep:] for folders in manifest(spark, base, v).values() for f in folders}
    for v in known[:-keep]:
        fs, path = _fs(spark, f"{base}/{MANIFESTS}/{v:0{DIGITS}d}.json")
        fs.delete(path, False)
    fs, data = _fs(spark, f"{base}/data")
    gone = 0
    for table in fs.listStatus(data) if fs.exists(data) else []:
        for folder in fs.listStatus(table.getPath()):
            if f"data/{table.getPath().getName()}/{folder.getPath().getName()}" not in held:
                fs.delete(folder.getPath(), True)
                gone += 1
    return gone
