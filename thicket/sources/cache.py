"""Symbol trees kept by the content they were made from.

An entry holds a file's tree, a fingerprint of what made it, and a manifest of
the hashes of all files it depends on. It is used only while all of that is the
same; what has no such entry is left to be made anew.
"""

from __future__ import annotations

import posixpath
import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.model import SYMBOL_SCHEMA

SCHEMA_VERSION = 1
ARTIFACT = "symbol_tree"
KEYS = ["schema_version", "artifact_kind", "adapter_id", "profile_id", "adapter_fingerprint", "workspace", "file"]


@dataclass(frozen=True)
class CachePolicy:
    """Where a reason says why, nothing is read or written."""

    adapter_id: str
    profile_id: str = "default"
    fingerprint: str = ""
    dependencies: tuple[str, ...] = ()
    disabled_reason: str = ""

    @property
    def enabled(self) -> bool:
        return not self.disabled_reason


def fingerprint(*parts: str) -> str:
    """Name, profile, behaviour version, server, its version, language."""
    return "|".join(parts)


def distinct_in_order(items: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(items))


def clangd_policy(root_has: list[str], fragments: list[dict] | None, bad_patterns: bool, **names: str) -> CachePolicy:
    """No entry where a configuration cannot be followed for sure."""
    reason = "configuration has patterns that cannot be compiled" if bad_patterns else ""
    for f in fragments or []:
        if f.get("CompileFlags", {}).get("CompilationDatabase", ["None"]) not in (["None"], []):
            reason = reason or "configuration names a compilation database of its own"
    known = distinct_in_order(x for x in (".clangd", "compile_commands.json", "compile_flags.txt") if x in root_has)
    return CachePolicy("clangd", dependencies=tuple(known), disabled_reason=reason, **names)


def entries(files: DataFrame, policy: CachePolicy, workspace: str = "") -> DataFrame:
    """Keys and manifest of ``files`` (file, content_hash) as they are now.
    Dependencies that are missing have an empty hash. They are a handful."""
    deps = [(r.file, r.content_hash) for r in files.where(F.col("file").isin(*policy.dependencies)).select("file", "content_hash").collect()] if policy.dependencies else []
    known = dict(deps)
    shared = [F.struct(F.lit(d).alias("path"), F.lit(known.get(d, "")).alias("hash")) for d in distinct_in_order(policy.dependencies)]
    own = F.struct(F.col("file").alias("path"), F.col("content_hash").alias("hash"))
    constant = {"schema_version": SCHEMA_VERSION, "artifact_kind": ARTIFACT, "adapter_id": policy.adapter_id, "profile_id": policy.profile_id, "adapter_fingerprint": policy.fingerprint, "workspace": workspace}
    return files.select(*[F.lit(v).alias(k) for k, v in constant.items()], "file", F.array_sort(F.array_distinct(F.array(own, *shared))).alias("manifest"))


def valid(cache: DataFrame, now: DataFrame) -> DataFrame:
    """Entries of ``cache`` (keys, manifest, payload) that still hold."""
    return cache.withColumn("manifest", F.array_sort("manifest")).join(now, [*KEYS, "manifest"], "left_semi")


def stale(cache: DataFrame, now: DataFrame) -> DataFrame:
    """What must be made anew: keys and manifests without a valid entry."""
    return now.join(cache.withColumn("manifest", F.array_sort("manifest")), [*KEYS, "manifest"], "left_anti")


_ENTRY = (
    "schema_version int, artifact_kind string, profile_id string, adapter_fingerprint string, workspace string, file string, "
    "manifest array<struct<path:string,hash:string>>, payload string, stored_at long, adapter_id string"
)


def store(trees: DataFrame, path: str) -> None:
    """Adds entries (keys, manifest, payload): a newer one of the same keys goes
    before an older, and whatever else is there stays. Spark's committer makes
    it all or nothing."""
    names = [c.split(" ")[0] for c in _ENTRY.split(", ")]
    trees.withColumn("stored_at", F.lit(time.time_ns())).select(*names).write.mode("append").partitionBy("adapter_id").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The newest entry of all keys; none if nothing was stored yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], _ENTRY).drop("stored_at")
    newest = spark.read.schema(_ENTRY).parquet(path).groupBy(*KEYS).agg(F.max_by(F.struct("manifest", "payload"), "stored_at").alias("e"))
    return newest.select(*KEYS, "e.manifest", "e.payload")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The newest entries alone, as a cache of their own."""
    store(load(spark, path), to)


_TREE = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in SYMBOL_SCHEMA.replace('array<struct<sl:int,sc:int,el:int,ec:int>>', 'ANC').split(', '))}>>".replace("ANC", "array<struct<sl:int,sc:int,el:int,ec:int>>")


def encode_trees(symbols: DataFrame) -> DataFrame:
    """``file, payload``: each file's symbols, in order, as JSON. A file's are
    gathered, which are bounded as files are."""
    names = [c.split(" ")[0] for c in SYMBOL_SCHEMA.split(", ")]
    row = F.struct("preorder", F.struct(*names).alias("s"))
    return symbols.groupBy("file").agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["s"])).alias("payload"))


def decode_trees(stored: DataFrame) -> DataFrame:
    """The symbols table out of ``payload``."""
    return stored.select(F.explode(F.from_json("payload", _TREE)).alias("s")).select("s.*")


def entry_path(root: Column, workspace: Column, adapter: Column, profile: Column, file: Column) -> Column:
    """Where an entry would be as a file of its own."""
    return F.concat_ws("/", root, F.sha2(workspace, 256), F.lit("shared"), F.lit("v1"), adapter, profile, F.lit(ARTIFACT), F.concat(F.sha2(file, 256), F.lit(".json")))


def cache_root(path: str) -> str:
    """Must be named, and by an absolute path."""
    path = path.strip()
    if not path:
        raise ValueError("cache root is required")
    if not posixpath.isabs(path):
        raise ValueError(f'cache root "{path}" must be absolute')
    return posixpath.normpath(path)


def adapter_dir(root: str, workspace: Column, adapter: str) -> Column:
    """Folder of files that an adapter keeps for a workspace."""
    if not adapter.strip():
        raise ValueError("adapter name is required")
    return F.concat_ws("/", F.lit(cache_root(root)), F.sha2(workspace, 256), F.lit("adapters"), F.lit(adapter))
