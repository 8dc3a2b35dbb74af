"""Content-addressed runs: dataset ids, manifests, reuse and audits (driver side; data checks are queries)."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import normalize as N
from tidewell.sources.jsonl import read_jsonl, write_partitioned

SCHEMA = "tidewell.normalized.1"


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_text(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def file_sha256(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def write_json(path: str | Path, value: Any) -> None:
    """Replaces a JSON file whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}.tmp")
    with part.open("x") as f:
        json.dump(value, f, indent=1, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def describe_inputs(files: list[Path]) -> list[dict]:
    return [{"path": str(f), "size": f.stat().st_size, "sha256": file_sha256(f)} for f in sorted(files)]


def dataset_id(inputs: list[dict], config: dict) -> str:
    """24 hex digits of schema, input contents and configuration."""
    return sha256_text(canonical_json({"schema": SCHEMA, "inputs": [[i["size"], i["sha256"]] for i in inputs], "config": config}))[:24]


def guard_roots(raw: Path, out: Path) -> None:
    """Outputs may not lie inside inputs, nor the other way round."""
    a, b = raw.resolve(), out.resolve()
    if a == b or a in b.parents or b in a.parents:
        raise ValueError("raw and output roots overlap")


def discover(raw: Path, most: int | None = None) -> list[Path]:
    files = sorted({p.resolve() for pattern in ("*.jsonl", "*.jsonl.gz") for p in raw.rglob(pattern)})
    return files[:most] if most else files


def run_normalize(spark: SparkSession, raw: str, out: str, config: dict | None = None) -> dict:
    """Normalizes all JSON lines below ``raw`` into ``out``; a finished run of the same inputs is reused."""
    raw_root, out_root = Path(raw), Path(out)
    guard_roots(raw_root, out_root)
    inputs = describe_inputs(discover(raw_root))
    if not inputs:
        raise FileNotFoundError(f"no JSON lines below {raw}")
    name = dataset_id(inputs, config or {})
    root, manifest = out_root / name, out_root / name / "manifest.json"
    if manifest.exists():
        problems = audit_dataset(spark, str(manifest))
        if not problems:
            return json.loads(manifest.read_text()) | {"status": "reused"}
    result = N.normalize(read_jsonl(spark, [i["path"] for i in inputs]))
    N.audit_quality(result.quality)
    counts = {}
    for table, rows in result.tables.items():
        dated = rows.withColumn("date", F.date_format(F.timestamp_micros((F.coalesce("event_ns", "recv_ns") / 1000).cast("long")), "yyyy-MM-dd")).withColumn("product", F.col("product_id"))
        write_partitioned(dated, str(root / table), ["product", "date"])
        counts[table] = spark.read.parquet(str(root / table)).count() if any((root / table).rglob("*.parquet")) else 0
    write_partitioned(result.quarantine, str(root / "quarantine"), ["reason"])
    result.sessions.write.mode("overwrite").parquet(str(root / "sessions"))
    if describe_inputs(discover(raw_root)) != inputs:
        raise RuntimeError("inputs changed while they were read")
    document = {"schema": SCHEMA, "dataset_id": name, "config": config or {}, "inputs": inputs, "tables": counts, "quality": result.quality.first().asDict(), "status": "completed"}
    write_json(manifest, document)
    return document


def audit_dataset(spark: SparkSession, manifest: str) -> list[str]:
    """What is wrong with a finished dataset: id, input hashes, row counts, reconciliation."""
    path = Path(manifest)
    doc = json.loads(path.read_text())
    wrong = []
    if doc.get("schema") != SCHEMA:
        wrong.append("unknown schema")
    if dataset_id(doc["inputs"], doc["config"]) != doc["dataset_id"] or path.parent.name != doc["dataset_id"]:
        wrong.append("the dataset id doesn't follow from inputs and configuration")
    for i in doc["inputs"]:
        f = Path(i["path"])
        if not f.exists() or f.stat().st_size != i["size"] or file_sha256(f) != i["sha256"]:
            wrong.append(f"input {i['path']} is missing or changed")
    for table, n in doc["tables"].items():
        at = path.parent / table
        have = spark.read.parquet(str(at)).count() if any(at.rglob("*.parquet")) else 0
        if have != n:
            wrong.append(f"{table} has {have} rows, not {n}")
    wrong += [f"{k} is {v}" for k, v in doc["quality"].items() if k.endswith("_difference") and v]
    return wrong


def audit_session(records: DataFrame, declared: list[dict]) -> DataFrame:
    """Declared files (path, rows) of a capture session against the files' own records: status per file."""
    spark = records.sparkSession
    found = records.groupBy("source_path").agg(F.count("*").alias("rows_found"), F.count_if(F.col("error").isNotNull()).alias("bad_rows"))
    said = spark.createDataFrame([(d["path"], int(d["rows"])) for d in declared], "path string, rows_declared bigint")
    both = found.join(said, F.col("source_path") == F.col("path"), "full")
    status = F.when(F.col("path").isNull(), "undeclared").when(F.col("source_path").isNull(), "missing").when(F.col("rows_found") != F.col("rows_declared"), "row_count_differs").when(F.col("bad_rows") > 0, "bad_rows").otherwise("ok")
    return both.select(F.coalesce("source_path", "path").alias("path"), "rows_found", "rows_declared", status.alias("status"))
