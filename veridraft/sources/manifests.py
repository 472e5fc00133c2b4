"""Provenance of artifacts: digests, sidecar manifests and pinned resources."""

from __future__ import annotations

import datetime
import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"
# The keys of a manifest.
REQUIRED = (
    "manifest_version", "artifact_schema_version", "artifact_kind", "artifact_id", "result_path", "result_sha256", "row_count", "created_at_utc", "benchmark_version", "model",
    "input_hashes", "evaluator_versions", "resource_hashes", "dependency_versions", "parameters", "command",
)


def sha256_file(path: str | Path) -> str:
    """Digest of a file, read in pieces."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def sha256_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256, length`` of every file under a path; each is read by one task and must fit it."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def manifest_path(result: str | Path) -> Path:
    return Path(result).with_suffix(".manifest.json")


def build_manifest(result: str | Path, kind: str, benchmark_version: str, model: str, **fields) -> dict:
    """The record of a result file; its id is its digest, blank lines are no rows."""
    digest = sha256_file(result)
    with open(result, encoding="utf-8") as f:
        rows = sum(1 for line in f if line.strip())
    out = {
        "manifest_version": VERSION, "artifact_schema_version": VERSION, "artifact_kind": kind, "artifact_id": digest, "result_path": str(result), "result_sha256": digest, "row_count": rows,
        "created_at_utc": datetime.datetime.now(datetime.UTC).isoformat(), "benchmark_version": benchmark_version, "model": model,
        "input_hashes": {}, "evaluator_versions": {}, "resource_hashes": {}, "dependency_versions": {}, "parameters": {}, "command": [],
    }
    unknown = set(fields) - set(out)
    if unknown:
        raise ValueError(f"no manifest fields: {sorted(unknown)}")
    return out | fields


def write_manifest(manifest: dict) -> Path:
    path = manifest_path(manifest["result_path"])
    path.write_text(json.dumps(manifest, ensure_ascii=False, sort_keys=True, indent=1), encoding="utf-8")
    return path


def load_manifest(result: str | Path) -> dict:
    """A result's manifest, if it is complete and the result is unchanged."""
    manifest = json.loads(manifest_path(result).read_text(encoding="utf-8"))
    missing = [k for k in REQUIRED if k not in manifest]
    if missing:
        raise ValueError(f"manifest lacks {missing}")
    if sha256_file(result) != manifest["result_sha256"]:
        raise ValueError("the result does not match its manifest")
    return manifest


# Fields in which runs must agree to be compared.
COMPARED = ("artifact_kind", "benchmark_version", "input_hashes", "evaluator_versions", "resource_hashes", "parameters")


def check_comparable(results: list[str], kind: str, allow_legacy: bool = False) -> list[dict]:
    """Manifests of runs that can be compared. Runs without a manifest pass only together and only if
    allowed; kinds and the compared fields must agree."""
    with_one = [r for r in results if manifest_path(r).exists()]
    if len(with_one) != len(results):
        if allow_legacy and not with_one:
            return []
        raise ValueError("results without a manifest" if not with_one else "results with and without manifests")
    manifests = [load_manifest(r) for r in results]
    if any(m["artifact_kind"] != kind for m in manifests):
        raise ValueError(f"not all results are of kind {kind}")
    for field in COMPARED:
        if len({json.dumps(m[field], sort_keys=True) for m in manifests}) > 1:
            raise ValueError(f"results differ in {field}")
    return manifests


def verify_resource(path: str | Path, sha256: str) -> str | None:
    """None if a pinned resource is there and unchanged, else what is wrong with it."""
    path = Path(path)
    if not path.exists():
        return f"{path.name} is missing"
    return None if sha256_file(path) == sha256 else f"{path.name} has another digest"


def load_calibration(path: str | Path) -> dict | None:
    """A frozen tree ensemble, or None where it is absent or not of the expected shape."""
    try:
        model = json.loads(Path(path).read_text(encoding="utf-8"))
        ok = len(model["features"]) == 5 and model["trees"] and {"base", "per_level"} <= set(model["score_mapping"])
        return model if ok and all(isinstance(t, list) and t for t in model["trees"]) and "init_value" in model and "learning_rate" in model else None
    except (OSError, ValueError, KeyError, TypeError):
        return None
