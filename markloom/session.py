"""What a session needs before Python functions of this package run on executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Sends this package to executors, once a context, unless PYTHONPATH already has it."""
    home, sc = Path(__file__).resolve().parents[1], spark.sparkContext
    if str(home) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_markloom_sent", False):
        return
    made = tempfile.mkdtemp(prefix="markloom-")  # on the driver, whose file server hands the archive out
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    shutil.copytree(home / "markloom", f"{made}/at/markloom", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{made}/markloom-package", "zip", f"{made}/at"))
    sc._markloom_sent = True


def shared_folder(spark: SparkSession) -> str:
    """Where the driver and all executors can write: spark.checkpoint.dir, as the cluster names it; else a warehouse
    that isn't on a machine's own disk. Only a local master, whose executors share one disk, gets a new folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found
    if not spark.sparkContext.master.startswith("local"):
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith(("file:", "/")) or "://" not in warehouse:
            raise ValueError(f"set spark.checkpoint.dir: the warehouse {warehouse} may be each machine's own folder")
        return warehouse
    made = tempfile.mkdtemp(prefix="markloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made
