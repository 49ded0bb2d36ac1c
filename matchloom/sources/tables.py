"""Tables in and out: CSV with line breaks in cells, Parquet, and metadata files."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """All columns as strings; ``columns`` names them where the header need not be read first."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    return df.limit(limit) if limit is not None else df


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Quoted cells; arrays, maps and structs as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    cells = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    df.select(*cells).write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_metadata(metadata: dict[str, Any], path: str) -> None:
    Path(path).write_text(json.dumps(metadata, indent=2, sort_keys=True, default=str), encoding="utf-8")


def load_prompt(path: str, stripped: bool = False) -> str:
    text = Path(path).read_text(encoding="utf-8")
    return text.strip() if stripped else text


def model_metadata(name: str, folder: str, fetch: Callable[[str], dict[str, Any]]) -> dict[str, Any]:
    """name, sha, created_at and last_modified of a model, fetched once and kept as a JSON file."""
    path = Path(folder) / f"{name.replace('/', '_')}.json"
    if path.exists():
        found = json.loads(path.read_text(encoding="utf-8"))
        if not isinstance(found, dict):
            raise ValueError(f"cached metadata in {path} must be a mapping")
        return found
    got = fetch(name)
    found = {"name": name} | {k: got.get(k) for k in ("sha", "created_at", "last_modified")}
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(found, default=str), encoding="utf-8")
    return found


def endpoint_metadata(name: str, folder: str, fetch: Callable[[str], dict[str, Any]]) -> dict[str, Any]:
    """As ``model_metadata``; an endpoint whose model can't be looked up gets a stand-in."""
    try:
        return model_metadata(name, folder, fetch)
    except Exception as e:
        return {"name": name, "sha": "openai-compatible-endpoint", "created_at": None, "last_modified": None, "metadata_error": str(e)}
