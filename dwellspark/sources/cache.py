"""Tables derived from others, kept in a folder and built anew when what they derive from changes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(inputs: Sequence[DataFrame], version: str = "") -> str:
    """Of the names, lengths and times of change of the files that inputs read, and of a version of what is done with them. Spark's driver holds these
    listings anyway; no file is opened."""
    digest = hashlib.sha256(version.encode())
    for df in inputs:
        digest.update(b"|")
        for name in sorted(df.inputFiles()):
            where, files = _file_system(df.sparkSession, name)
            status = files.getFileStatus(where)
            digest.update(f"{name}:{status.getLen()}:{status.getModificationTime()};".encode())
    return digest.hexdigest()


def derived(spark: SparkSession, folder: str, name: str, inputs: Sequence[DataFrame], make: Callable[[], DataFrame], version: str = "") -> DataFrame:
    """The table of that name in a folder, as made from inputs in their present state. It is made if it isn't there, else read. A table is written
    beside its place and moved there when it is whole, so that no reader sees a part of one; of two makers the first one's stays. Tables of
    earlier states are left to whoever clears the folder."""
    path = f"{folder.rstrip('/')}/{name}-{fingerprint(inputs, version)[:24]}"
    place, files = _file_system(spark, path)
    if not files.exists(place):
        made = f"{path}.{uuid.uuid4().hex}"
        make().write.parquet(made)
        source = spark._jvm.org.apache.hadoop.fs.Path(made)
        # A move into a folder that is there would put this one inside it.
        if files.exists(place) or not files.rename(source, place):
            files.delete(source, True)
    return spark.read.parquet(path)
