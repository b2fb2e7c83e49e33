"""Session helpers: a tuned local session, and shipping this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine, as tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once a context, as ``--py-files`` would: their Python need not have it."""
    context = spark.sparkContext
    if not getattr(context, "_siltstone_shipped", False):
        package = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="siltstone-")) / "siltstone_src.zip"  # the driver serves it; executors fetch a copy
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, str(p.relative_to(package.parent)))
        context.addPyFile(str(to))
        context._siltstone_shipped = True
    return spark
