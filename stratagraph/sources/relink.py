"""Relinking a fleet: its snapshots found, read strictly and checked, and the links published together.

A repository's snapshot is a folder with ``manifest.json`` and the tables; a fleet is a folder of such folders.  Checks
are small jobs whose few offending rows make the message; tables are never collected.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions import columns as C

from .snapshot import SCHEMAS, read_table

#: Builds that aren't a repository's snapshot, allowed states, buckets, and the kinds that belong to a tenant.
ARTIFACTS = ("fleet_relink", "multi_repo")
STATUSES = ("canonical", "candidate", "demoted")
BUCKETS = ("builtin_or_stdlib", "code_inferred_external", "consumer_manifest_external", "candidate_internal", "candidate_internal_ambiguous", "unknown")
TENANT_KINDS = ("Repo", "Service", "CodeModule", "CodeSymbol", "ExternalPackage", "ExternalSymbol", "Endpoint", "Domain", "EnvVar", "EventChannel", "DeployTarget")
OUTPUTS = ("cross_repo_links", "cross_repo_link_evidence", "cross_repo_package_classifications", "cross_repo_package_coverage", "runtime_links", "runtime_link_evidence", "runtime_link_coverage")


class Folder:
    """Files of a folder by the cluster's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._at = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._at(f"{self.path}/{name}" if name else self.path))

    def is_folder(self, name: str = "") -> bool:
        at = self._at(f"{self.path}/{name}" if name else self.path)
        return self.fs.exists(at) and self.fs.getFileStatus(at).isDirectory()

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(self.path)))

    def text(self, name: str) -> str:
        stream = self.fs.open(self._at(f"{self.path}/{name}"))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._at(f"{self.path}/{name}"), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def move(self, name: str, to: str) -> None:
        if not self.fs.rename(self._at(f"{self.path}/{name}"), self._at(to)):
            raise OSError(f"cannot move {self.path}/{name} to {to}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(f"{self.path}/{name}"), True)


def manifest(folder: Folder) -> dict:
    """The folder's manifest, a JSON object."""
    try:
        out = json.loads(folder.text("manifest.json"))
    except ValueError as e:
        raise ValueError(f"{folder.path}/manifest.json is not valid JSON: {e}") from e
    if not isinstance(out, dict):
        raise ValueError(f"{folder.path}/manifest.json must contain a JSON object")
    return out


def kind_of(folder: Folder) -> str | None:
    """repo, artifact or invalid by the manifest; None without one."""
    if not folder.exists("manifest.json"):
        return None
    found = manifest(folder)
    if found.get("build_type") in ARTIFACTS:
        return "artifact"
    named = all(isinstance(found.get(k), str) and found[k] for k in ("repo_path", "commit_sha"))
    return "repo" if named and "build_type" not in found else "invalid"


def snapshot_folders(spark: SparkSession, paths: list[str], exclude: tuple[str, ...] = ()) -> list[str]:
    """The snapshots that the paths are, or hold one level down; invalid manifests fail, artifacts are passed over."""
    out: list[str] = []
    for path in paths:
        root = Folder(spark, path)
        if not root.exists():
            raise FileNotFoundError(f"snapshot folder does not exist: {path}")
        if not root.is_folder():
            raise NotADirectoryError(f"snapshot path must be a folder: {path}")
        children = {root.path: kind_of(root)}
        if children[root.path] != "repo":
            if children[root.path] == "invalid":
                raise ValueError(f"{path}/manifest.json: not a valid snapshot of a repository")
            inside = [f"{root.path}/{n}" for n in root.names() if root.is_folder(n)]
            children = {p: kind_of(Folder(spark, p)) for p in inside if p not in {e.rstrip("/") for e in exclude}}
        if bad := [p for p, k in children.items() if k == "invalid"]:
            raise ValueError(f"{bad[0]}/manifest.json: not a valid snapshot of a repository")
        found = [p for p, k in children.items() if k == "repo"]
        if not found:
            raise FileNotFoundError(f"no snapshot manifests found under: {path}")
        out += found
    if not out:
        raise ValueError("no snapshot folders given")
    return list(dict.fromkeys(out))


def _reject(rows: DataFrame, bad: Column, what: str, show: str) -> None:
    """Fail with some of the offending rows if there are any."""
    found = rows.where(bad).select(F.col(show).cast("string")).limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[r[0] for r in found]}")


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(name), F.lit("")) == ""


def checked_entities(rows: DataFrame, tenant: str) -> DataFrame:
    """``rows`` if every entity has a kind, a known status, an id of its own that follows from kind and identity, and the tenant."""
    _reject(rows, _blank("kind"), "entity kind must be a non-empty string", "entity_id")
    _reject(rows, ~F.col("canonical_status").isin(*STATUSES), "entity canonical_status is unsupported", "entity_id")
    made = C.stable_hash("ent_", "kind", C.canonical_json("identity"))
    _reject(rows, F.col("entity_id").isNull() | (F.col("entity_id") != made), "entity_id does not match kind and identity", "entity_id")
    _reject(rows.groupBy("entity_id").agg(F.count("*").alias("n")), F.col("n") > 1, "duplicate entity_id values", "entity_id")
    given = F.col("identity")["tenant_id"]
    _reject(rows, F.col("kind").isin(*TENANT_KINDS) & (F.coalesce(given, F.lit("")) == ""), "entity tenant_id must be a non-empty string", "entity_id")
    _reject(rows, given.isNotNull() & (given != tenant), f"entity tenant_id values do not match snapshot tenant_id {tenant}", "entity_id")
    return rows


def checked_facts(rows: DataFrame) -> DataFrame:
    """``rows`` if every fact has a predicate, both ends, a known status, and the id that follows from them."""
    for c in ("predicate", "subject_id", "object_id"):
        _reject(rows, _blank(c), f"fact {c} must be a non-empty string", "fact_id")
    _reject(rows, ~F.col("canonical_status").isin(*STATUSES), "fact canonical_status is unsupported", "fact_id")
    made = C.stable_hash("fact_", "predicate", "subject_id", "object_id", C.canonical_json(F.coalesce("qualifier", F.create_map().cast("map<string,string>"))))
    _reject(rows, F.col("fact_id").isNull() | (F.col("fact_id") != made), "fact_id does not match predicate, ends and qualifier", "fact_id")
    return rows


def checked_evidence(rows: DataFrame) -> DataFrame:
    """``rows`` if all evidence names its target, class, system and time."""
    _reject(rows, ~F.coalesce(F.col("target_type"), F.lit("")).isin("entity", "fact"), "evidence target_type is unsupported", "evidence_id")
    for c in ("target_id", "derivation_class", "source_system", "ingested_at"):
        _reject(rows, _blank(c), f"evidence {c} must be a non-empty string", "evidence_id")
    return rows


def checked_classifications(rows: DataFrame) -> DataFrame:
    """``rows`` if ids are there, unpadded and unique, and buckets known."""
    for c in ("classification_id", "entity_id"):
        _reject(rows, _blank(c) | (F.col(c) != F.trim(c)), f"{c} must be non-empty and not padded", c)
    _reject(rows.groupBy("classification_id").agg(F.count("*").alias("n")), F.col("n") > 1, "duplicate package classification_id", "classification_id")
    _reject(rows, ~F.coalesce(F.col("bucket"), F.lit("")).isin(*BUCKETS), "package classification bucket is unsupported", "bucket")
    return rows


def read_strict(spark: SparkSession, root: str, form: str = "parquet", tenant: str | None = None, repo_root: str | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """(manifest, tables) of one repository's snapshot, checked; with ``repo_root``, package manifests must be as they were recorded."""
    folder = Folder(spark, root)
    if not folder.exists("manifest.json"):
        raise FileNotFoundError(f"snapshot manifest does not exist: {root}/manifest.json")
    found = manifest(folder)
    for k in ("repo_path", "commit_sha"):
        if not isinstance(found.get(k), str) or not found[k]:
            raise ValueError(f"{root}/manifest.json: {k} must be a non-empty string")
    own = found.get("tenant_id", "default")
    if not isinstance(own, str) or not own.strip():
        raise ValueError("snapshot manifest tenant_id must be a non-empty string when present")
    if tenant is not None and tenant != own:
        raise ValueError(f"tenant override must match the snapshot's tenant_id, as ids are scoped by it: {tenant} != {own}")
    if repo_root is not None:
        files = Folder(spark, repo_root)
        for entry in found.get("package_manifests") or []:
            path = entry.get("path") or ""
            if not path or path.startswith("/") or ".." in path.split("/"):
                raise ValueError(f"{root}/manifest.json: package manifest path must stay inside the repository: {path}")
            if not files.exists(path) or hashlib.sha256(files.text(path).encode()).hexdigest() != entry.get("sha256"):
                raise ValueError(f"package manifest differs from its recorded hash: {path}")
    tables = {n: read_table(spark, root, n, form) if folder.exists(n) else spark.createDataFrame([], SCHEMAS[n]) for n in ("entities", "facts", "evidence")}
    checked_entities(tables["entities"], own)
    checked_facts(tables["facts"])
    checked_evidence(tables["evidence"])
    return found, tables


def unique_identities(manifests: list[dict]) -> None:
    """Fail unless all snapshots are of one tenant and of different repositories; a fleet's manifests fit the driver."""
    tenants = sorted({m.get("tenant_id", "default") for m in manifests})
    if len(tenants) > 1:
        raise ValueError(f"snapshots must belong to one tenant; found: {tenants}")
    names = [(m.get("owner"), m.get("repo_name") or m["repo_path"].rstrip("/").rsplit("/", 1)[-1]) for m in manifests]
    if twice := sorted({n for n in names if names.count(n) > 1}, key=str):
        raise ValueError(f"snapshots require unique repository identities; twice: {twice}")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], found: dict) -> None:
    """Write the tables and the manifest beside ``root``, then move all of them in; if a move fails, what was there comes back."""
    out = Folder(spark, root)
    out.fs.mkdirs(out._at(out.path))
    if wrong := [n for n in OUTPUTS if out.exists(n) and not out.is_folder(n)]:
        raise ValueError(f"cannot replace what is no table: {wrong}")
    staged = Folder(spark, f"{out.path}.staged-{uuid.uuid4().hex}")
    for name, rows in tables.items():
        rows.write.parquet(f"{staged.path}/{name}")
    staged.write("manifest.json", json.dumps(found, indent=2, sort_keys=True) + "\n")
    saved, moved = [], []
    try:
        for name in (*OUTPUTS, "manifest.json"):
            if out.exists(name):
                out.move(name, f"{staged.path}/old-{name}")
                saved.append(name)
        for name in (*tables, "manifest.json"):
            staged.move(name, f"{out.path}/{name}")
            moved.append(name)
    except Exception:
        for name in moved:
            out.delete(name)
        for name in saved:
            staged.move(f"old-{name}", f"{out.path}/{name}")
        raise
    finally:
        staged.fs.delete(staged._at(staged.path), True)
