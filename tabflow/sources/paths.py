"""Input and output paths."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

_SCHEME = re.compile(r"^([a-zA-Z][\w+.-]*:)//+")


def require_path(path: str | None) -> str:
    if path is None or not str(path).strip():
        raise ValueError("Missing input/output path")
    return str(path)


def enriched_path(input_path: str) -> str:
    """Default output for an input: ``d/f.csv`` gives ``d/f_enriched.csv``."""
    whole = PurePosixPath(require_path(input_path).replace("\\", "/"))
    scheme = _SCHEME.match(str(input_path))
    named = whole.with_name(f"{whole.stem}_enriched{whole.suffix or '.csv'}")
    # A path object merges the slashes of a URI.
    return str(named).replace(scheme[1] + "/", scheme[0], 1) if scheme else str(named)


def object_store_uri(account: str, container: str, path: str) -> str:
    """The Hadoop ``abfss`` URI of ``path`` in a storage account's container."""
    return f"abfss://{container}@{account}.dfs.core.windows.net/{path.lstrip('/')}"
