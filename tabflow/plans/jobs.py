"""Whole jobs: read, transform, check, write."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..sources.paths import require_path
from ..sources.readers import read_table
from ..sources.writers import write_table
from .operations import apply_ops, require_columns
from .staging import Staging


def _read(spark: SparkSession, source: Mapping[str, Any]) -> DataFrame:
    source = dict(source)
    return read_table(spark, source.pop("path", None), source.pop("format", "csv"), **source)


def run_job(spark: SparkSession, spec: Mapping[str, Any]) -> str:
    """Run a job and return the path it wrote.

    ``spec`` has ``input`` (``path``, ``format``, and other arguments of
    ``read_table``), ``output`` (``path``, ``format``, ``mode``, ``options``) and
    ``operations``; also ``tables``, further inputs by alias, and
    ``required_columns`` of the result. Without an output path the result goes
    beside the input, and without an output format in that of the input.

    Tables that an operation would read several times, after a shuffle or with random
    values in them, are written once in shared storage, and removed at the end.
    """
    unknown = set(spec) - {"input", "output", "operations", "tables", "required_columns"}
    if unknown:
        raise ValueError(f"Unknown job settings: {sorted(unknown)}")
    source, sink = dict(spec.get("input") or {}), dict(spec.get("output") or {})
    require_path(source.get("path"))
    tables = {alias: _read(spark, s) for alias, s in (spec.get("tables") or {}).items()}
    staging = Staging(spark)
    try:
        result = apply_ops(
            _read(spark, source), spec.get("operations") or [], tables, staging=staging
        )
        require_columns(result, spec.get("required_columns") or [])
        return write_table(
            result,
            sink.get("path"),
            sink.get("format") or source.get("format") or "csv",
            sink.get("mode"),
            input_path=source["path"],
            options=sink.get("options"),
        )
    finally:
        staging.remove()
