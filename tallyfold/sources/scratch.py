"""Folders for intermediate files that all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from . import sinks
from .bundle import EvidenceError

_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own if the session runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise EvidenceError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tallyfold-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path, removed when the program ends."""
    path = f"{scratch_root(spark)}/tallyfold/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _drop_all() -> None:
    for spark, path in _made:
        try:
            sinks.remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to clean
            return


atexit.register(_drop_all)
