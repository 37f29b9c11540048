"""Sinks."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from .paths import enriched_path, require_path
from .readers import CSV_OPTIONS, check_format, connector_errors

MODES = ("overwrite", "append", None)

# By default Spark cuts times to milliseconds in text formats, and trims CSV cells.
_FULL_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
_WRITE_OPTIONS = {
    "csv": {
        **CSV_OPTIONS,
        **_FULL_TIMES,
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    },
    "json": _FULL_TIMES,
}


def write_table(
    df: DataFrame,
    path: str | None = None,
    fmt: str = "csv",
    mode: str | None = None,
    *,
    input_path: str | None = None,
    options: Mapping[str, Any] | None = None,
) -> str:
    """Write ``df`` as a folder of part files, one per task; returns the path.

    Without ``path`` the result goes beside ``input_path`` under its enriched
    name. ``mode`` is overwrite or append; unset, existing output is an error.
    CSV gets a header row and doubled quotes; nulls are empty cells.
    """
    if path is None and input_path is not None:
        path = enriched_path(input_path)
    path = require_path(path)
    check_format(fmt)
    if mode not in MODES:
        raise ValueError(f"Unknown write mode {mode!r}; known: {list(MODES)}")
    writer = df.write.format(fmt).mode(mode or "errorifexists")
    writer = writer.options(**{**_WRITE_OPTIONS.get(fmt, {}), **dict(options or {})})
    with connector_errors(fmt):
        writer.save(path)
    return path
