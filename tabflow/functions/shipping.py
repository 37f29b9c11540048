"""This package for executors that were started without it."""

from __future__ import annotations

import tempfile
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark import SparkContext


@lru_cache(maxsize=4)
def ship(context: SparkContext) -> None:
    """Add this package's code to a Spark application, once."""
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="tabflow-")) / "code.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
