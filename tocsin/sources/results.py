"""Result store: snapshots, batch checkpoints, schema gate, CSV export.

Data lie in folders of their own that are written once. A folder counts only when its manifest, a small file that is
written under another name and renamed last, stands in `_manifests`: what a broken run leaves behind is never read. A
manifest has the folder's schema, so folders of other schemas are told apart before any of them is read, and its files
with their lengths, so a damaged folder is passed over. A snapshot's manifest names the checkpoints that it contains;
these are never taken up again, whether or not they were deleted.
"""

from __future__ import annotations

import json
import time
import uuid
import warnings
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FINGERPRINT = "schema_fingerprint"
#: What the store adds to a row: the snapshot, or the run, its batch and when that was written.
SNAPSHOT, CHECKPOINT = ("run_ts",), ("run_id", "batch", "written")
_MANIFESTS = "_manifests"
#: Types that hold every value of these types.
_WIDER = {"tinyint": {"smallint", "int", "bigint", "float", "double"}, "smallint": {"int", "bigint", "float", "double"}, "int": {"bigint", "double"}, "float": {"double"}, "date": {"timestamp"}}


def fingerprint(of: DataFrame | StructType) -> str:
    """Digest of names and types, without nullability."""
    schema = of if isinstance(of, StructType) else of.schema
    return sha256(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields if f.name != FINGERPRINT).encode()).hexdigest()


def _path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _files(spark: SparkSession, path: str) -> dict[str, int]:
    """Lengths of the files right in a folder, by name."""
    folder, files = _path(spark, path)
    return {s.getPath().getName(): s.getLen() for s in files.listStatus(folder) if s.isFile()} if files.exists(folder) else {}


def _commit(spark: SparkSession, path: str, name: str, manifest: dict) -> None:
    """Show a folder by its manifest, as a whole; a manifest is never replaced."""
    target, files = _path(spark, f"{path}/{_MANIFESTS}/{name}.json")
    if files.exists(target):
        raise ValueError(f"the store has {name} already; its manifest exists")
    draft, _ = _path(spark, f"{path}/{_MANIFESTS}/.{name}.{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(json.dumps(manifest).encode())
    out.close()
    if not files.rename(draft, target):
        raise OSError(f"the manifest of {name} can't be renamed")


def _write(df: DataFrame, path: str, name: str, labels: dict[str, object], **more: object) -> None:
    spark, folder = df.sparkSession, f"data-{uuid.uuid4().hex}"
    marked = df.withColumns({**{c: F.lit(v) for c, v in labels.items()}, FINGERPRINT: F.lit(fingerprint(df))})
    marked.write.mode("errorifexists").parquet(f"{path}/{folder}")
    files = {n: size for n, size in _files(spark, f"{path}/{folder}").items() if n.endswith(".parquet")}
    _commit(spark, path, name, {"name": name, "folder": folder, "fingerprint": fingerprint(df), "schema": json.loads(marked.schema.json()), "files": files, **labels, **more})


def entries(spark: SparkSession, path: str) -> list[dict]:
    """Manifests of the complete and undamaged folders under a path, by name."""
    found = []
    for name in sorted(n for n in _files(spark, f"{path}/{_MANIFESTS}") if n.endswith(".json") and not n.startswith(".")):
        source, files = _path(spark, f"{path}/{_MANIFESTS}/{name}")
        stream = files.open(source)
        manifest = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        there = _files(spark, f"{path}/{manifest['folder']}")
        if all(there.get(n) == size for n, size in manifest["files"].items()):
            found.append(manifest)
        else:
            warnings.warn(f"{path}: {manifest['name']} has lost files and is passed over", stacklevel=2)
    return found


def save_results(results: DataFrame, path: str, run_ts: str, contains: tuple[str, ...] = ()) -> None:
    """Add a snapshot, which shows as a whole or not at all; one of that name is never replaced.

    contains names the checkpoints that are part of it.
    """
    if has_snapshot(results.sparkSession, path, run_ts):
        raise ValueError(f"a snapshot of {run_ts} exists already")
    _write(results, path, run_ts, {"run_ts": run_ts}, contains=sorted(contains))


def has_snapshot(spark: SparkSession, path: str, run_ts: str) -> bool:
    return f"{run_ts}.json" in _files(spark, f"{path}/{_MANIFESTS}")


def batch_digest(keys: list[str]):
    """An aggregate that names a set of scenarios, in whatever order its rows come."""
    one, two = F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys)
    return F.sha2(F.concat_ws(":", F.count("*"), F.sum(one.cast("decimal(38,0)")), F.sum(two.cast("decimal(38,0)")), F.bit_xor(two)), 256)


def append_checkpoint(batch: DataFrame, path: str, run_id: str, number: int, keys: list[str], digest: str | None = None) -> bool:
    """Add one batch of a run under a digest of its scenarios; False if the run has these scenarios already.

    digest: of the batch's scenarios by batch_digest(), else it is made of the batch's rows.
    """
    spark = batch.sparkSession
    digest = digest or batch.agg(batch_digest(keys)).first()[0]
    name = f"{run_id}.{digest[:24]}.{fingerprint(batch)[:8]}"
    if f"{name}.json" in _files(spark, f"{path}/{_MANIFESTS}"):
        return False
    _write(batch, path, name, {"run_id": run_id, "batch": number, "written": time.time_ns()})
    return True


def _fits(stored: StructType, wanted: StructType) -> bool:
    """Whether every common column can be read as wanted without loss."""
    types = {f.name: f.dataType.simpleString() for f in wanted.fields}
    return all(f.name not in types or f.dataType.simpleString() == types[f.name] or types[f.name] in _WIDER.get(f.dataType.simpleString(), ()) for f in stored.fields)


def admitted(found: list[dict], expected: StructType | None, policy: str = "continue") -> list[dict]:
    """Folders that pass the schema gate, judged one by one before any is read.

    expected: the schema that rows should have, or None for that of the newest folder. policy for folders of another one:
    quit raises, force drops them, continue keeps them; those with a column whose type can't be widened to the expected
    one are dropped even then.
    """
    if policy not in ("continue", "force", "quit"):
        raise ValueError(f"no such policy: {policy}")
    if not found:
        return []
    wanted = expected or StructType.fromJson(found[-1]["schema"])
    same = [m for m in found if expected is None or m["fingerprint"] == fingerprint(expected)]
    if policy == "quit" and len(same) < len(found):
        raise ValueError(f"stored results have another schema: {[m['name'] for m in found if m not in same]}")
    kept = same if policy == "force" else [m for m in found if _fits(StructType.fromJson(m["schema"]), wanted)]
    for m in found:
        if m not in kept:
            warnings.warn(f"{m['name']} has another schema and is left out", stacklevel=2)
    return kept


def _read(spark: SparkSession, path: str, chosen: list[dict], expected: StructType | None) -> DataFrame | None:
    """Rows of the chosen folders with all their columns, those of one schema in one read."""
    if not chosen:
        return None
    types = {f.name: f.dataType for f in (expected or StructType.fromJson(chosen[-1]["schema"])).fields}
    by_schema: dict[str, list[dict]] = {}
    for m in chosen:
        by_schema.setdefault(json.dumps(m["schema"]), []).append(m)
    out = None
    for schema, folders in by_schema.items():
        rows = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*(f"{path}/{m['folder']}" for m in folders))
        rows = rows.select(*(F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in rows.columns))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def stored(spark: SparkSession, path: str, expected: StructType | None = None, policy: str = "continue", without: frozenset[str] = frozenset()) -> DataFrame | None:
    """All that is stored under a path and passes the gate, but for the entries named in `without`; None if nothing is."""
    return _read(spark, path, admitted([m for m in entries(spark, path) if m["name"] not in without], expected, policy), expected)


def latest(snapshots: DataFrame, column: str = "run_ts") -> DataFrame:
    """Rows of the newest snapshot."""
    newest = snapshots.agg(F.max(column)).first()[0]
    return snapshots.where(F.col(column) == F.lit(newest))


def newest_rows(batches: DataFrame, keys: list[str], order: tuple[str, ...] = CHECKPOINT) -> DataFrame:
    """The rows of each key that were written last; a key may have several rows in one batch."""
    last = batches.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"))
    both = batches.alias("x").join(last.alias("y"), [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys] + [F.col(f"x.{c}") == F.col(f"y._last.{c}") for c in order])
    return both.select("x.*")


def load_checkpoints(spark: SparkSession, checkpoints: str, keys: list[str], expected: StructType | None = None, policy: str = "continue", without: frozenset[str] = frozenset()) -> DataFrame | None:
    """The newest checkpoint rows of each key that pass the gate, or None if there is none."""
    found = stored(spark, checkpoints, expected, policy, without)
    return None if found is None else newest_rows(found, keys).drop(*CHECKPOINT, FINGERPRINT)


def load_snapshot(spark: SparkSession, path: str, expected: StructType | None = None, policy: str = "continue") -> DataFrame | None:
    """The rows of the newest readable snapshot if it passes the gate, or None."""
    found = _read(spark, path, admitted(entries(spark, path)[-1:], expected, policy), expected)
    return None if found is None else found.drop(*SNAPSHOT, FINGERPRINT)


def contained(spark: SparkSession, path: str) -> frozenset[str]:
    """Checkpoints that the newest readable snapshot contains."""
    return frozenset(n for m in entries(spark, path)[-1:] for n in m["contains"])


def load_results(spark: SparkSession, path: str, checkpoints: str, keys: list[str], expected: StructType | None = None, policy: str = "continue") -> DataFrame | None:
    """The newest snapshot, else the newest checkpoint rows of each key, else None; see admitted() for the gate."""
    found = load_snapshot(spark, path, expected, policy)
    return load_checkpoints(spark, checkpoints, keys, expected, policy) if found is None else found


def compact(results: DataFrame, path: str, run_ts: str, checkpoints: str) -> None:
    """Save a snapshot that contains the checkpoints; only then are they deleted, each manifest before its data."""
    spark = results.sparkSession
    begun = entries(spark, checkpoints)
    save_results(results, path, run_ts, tuple(m["name"] for m in begun) + tuple(contained(spark, path)))
    for m in begun:
        for gone in (f"{_MANIFESTS}/{m['name']}.json", m["folder"]):
            folder, files = _path(spark, f"{checkpoints}/{gone}")
            files.delete(folder, True)


def export_csv(report: DataFrame, path: str, drop: tuple[str, ...] = ("noise_level",)) -> None:
    """One CSV file with a header, for a report that a reader opens by hand."""
    report.drop(*drop).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
