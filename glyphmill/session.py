"""Session settings that the library relies on."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.showConsoleProgress": "false",
}
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def is_local(master: str | None) -> bool:
    """Whether driver and executors are one process, so that a folder of this machine is shared by all."""
    return bool(re.fullmatch(r"local(\[.*\])?", master or ""))


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the library's settings; keyword names use underscores for dots.

    A local session gets a folder for checkpoints where none is set; on a cluster, spark.checkpoint.dir must name one
    that the driver and all executors share.
    """
    chosen = SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}
    if is_local(master) and "spark.checkpoint.dir" not in chosen:
        chosen["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="glyphmill-")
    builder = SparkSession.builder.appName("glyphmill").config(map=chosen)
    return (builder.master(master) if master else builder).getOrCreate()


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Let executors' Python find this package: by the driver's path in a local session, else as an archive that Spark sends them."""
    context = spark.sparkContext
    if is_local(context.master):
        known = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in known:
            context.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
    elif context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        archive = os.path.join(tempfile.mkdtemp(prefix="glyphmill-"), "glyphmill.zip")
        package = os.path.join(ROOT, "glyphmill")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(package):
                for name in sorted(files):
                    if name.endswith(".py"):
                        z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), ROOT))
        context.addPyFile(archive)
