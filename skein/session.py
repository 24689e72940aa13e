"""Session helpers: settings and shipping the package to executors."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def session(app: str = "skein", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application.

    Python workers import it from there, wherever the driver found it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    files = sorted(p for p in root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]
    path = os.path.join(tempfile.mkdtemp(prefix="skein-"), f"skein-{digest}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in files:
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
