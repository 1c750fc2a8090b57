"""Session construction and the settings every plan relies on."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "touchline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow on; other settings stay the cluster's own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application, so that they need not have it installed.

    It goes through the shared folder; without one (a cluster that names none) workers must have it.
    """
    from touchline import files

    if spark.sparkContext.applicationId in _SHIPPED:
        return
    _SHIPPED.add(spark.sparkContext.applicationId)
    home = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, names in os.walk(home):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.relpath(path, os.path.dirname(home)))
    try:
        path = f"{_new_path(spark, 'package')}/touchline.zip"
    except RuntimeError:
        return
    files.write_bytes(spark, path, packed.getvalue())
    spark.sparkContext.addPyFile(path)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a data directory, a Parquet file or a folder of them."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, the unit of all fair-share rules."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests, a single
    machine) a temporary folder takes its place.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _OWN_DIR
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="touchline-")
    return f"file://{_OWN_DIR}"


_OWN_DIR: str | None = None


def _new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/touchline-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


#: Paths made since the innermost ``scratch`` began.
_OPEN: list[str] = []


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed by the ``scratch`` it is made in, or when the driver's Python ends."""
    path = _new_path(spark, label)
    _OPEN.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, all intermediate tables written within it; what is lazy must have run by then."""
    global _OPEN
    outer, _OPEN = _OPEN, []
    try:
        yield
    finally:
        for path in _OPEN:
            _remove(spark, path)
        _OPEN = outer


def scratched(run: Callable) -> Callable:
    """A function of a session that leaves no intermediate table behind."""

    @wraps(run)
    def call(spark: SparkSession, *given, **named):
        with scratch(spark):
            return run(spark, *given, **named)

    return call


def _remove(spark: SparkSession, path: str) -> None:
    from touchline import files

    try:
        files.delete(spark, path)
    except Exception:  # the JVM may have ended first; a local folder can still be removed
        if path.startswith("file://"):
            import shutil

            shutil.rmtree(path[len("file://") :], ignore_errors=True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a result that several branches read to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation above this point, and the
    branches scan narrow Parquet with statistics instead of repeating the work.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
