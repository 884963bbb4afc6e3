"""Session factory with the settings that the operators assume."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "parley", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew-join splitting on; ``conf`` keys use ``_`` for ``.``.

    On one machine, where nothing else is named, steps between stages are written to a folder of the process, which goes with it.
    On a cluster ``spark.checkpoint.dir`` must name a folder that the driver and all executors share.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    if (master or "").startswith("local[") and not os.environ.get("SPARK_CONF_DIR"):
        own = tempfile.mkdtemp(prefix="parley-steps-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        settings.setdefault("spark.checkpoint.dir", f"file://{own}")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
