"""Makes this package importable on executors that were started without it; folders and shuffles that go when they are done with."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.constraintPropagation.enabled": "false"}


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="factorspark-")) / "factorspark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``), deleted when the session's JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.gettempdir()
    own = f"{root.rstrip('/')}/factorspark/{what}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{own}/{what}"


@contextmanager
def storing(spark: SparkSession) -> Iterator[None]:
    """Actions in this block drop their shuffle files when they end, not when the driver happens to collect garbage.

    No filter is inferred from a join, so tables that are used twice stay equal and share their exchanges.
    """
    before = {k: spark.conf.get(k, None) for k in STORING}
    for k, v in STORING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
