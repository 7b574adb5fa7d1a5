"""Lineage cuts that survive the loss of executors.

Iterative operators write each round to the folder that all executors share
(``spark.checkpoint.dir``) and read it back, so that no round is computed
twice and a lost executor costs one task, not the whole history.

Tables live below one folder per application. An operator deletes the rounds that
nothing reads again (``forget``); what its result still reads goes with ``release``,
which a caller may call once results are written and which runs when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
import warnings

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_FOLDERS: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, or one of our own if the session is local and names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="scarp-")
    return _OWN[app]


def _delete(folder: str) -> None:
    try:
        files, path = fs.FileSystem.from_uri(folder)
        if files.get_file_info(path).type == fs.FileType.Directory:
            files.delete_dir(path)
    except Exception as why:  # a table left behind is no reason to lose a result
        warnings.warn(f"scratch table {folder} was not deleted: {why}", stacklevel=2)


def release(spark: SparkSession | None = None) -> None:
    """Delete every table this driver has written; results that still read them are void."""
    for folder in sorted(_FOLDERS):
        _delete(folder)
    _FOLDERS.clear()


atexit.register(release)


class Scratch:
    """Tables written by one run of one operator, below one folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.tables: list[tuple[DataFrame, str]] = []
        self.lock = threading.Lock()
        _FOLDERS.add(self.folder)

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` and return it as a plain scan of what was written."""
        with self.lock:  # rounds may be written side by side
            self.count += 1
            path = f"{self.folder}/{self.count:03d}-{tag}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((saved, path))
        return saved

    def save_measured(self, df: DataFrame, tag: str, **measures) -> tuple[DataFrame, dict]:
        """As ``save``, with aggregates of the rows that were written (``n``: how many; alone it is read off the file footers).

        An ``Observation`` would take them while writing, but it ties a listener to the session that MLlib then fails to serialise.
        """
        saved = self.save(df, tag)
        return saved, saved.agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in measures.items()]).first().asDict()

    def forget(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing will read again."""
        for table in tables:
            for at, (saved, path) in enumerate(self.tables):
                if saved is table:
                    del self.tables[at]
                    _delete(path)
                    break
