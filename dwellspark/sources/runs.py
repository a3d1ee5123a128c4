"""Tables of runs in a folder, one file for each, and their sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """A CSV table of a given schema: nothing is read to infer one. Values that don't fit it are null."""
    return spark.read.csv(path, schema=schema, header=header, mode="PERMISSIVE")


def read_runs(spark: SparkSession, folder: str, file: str, schema: StructType | str, **levels: object) -> DataFrame:
    """All files of one name in the folders of runs, with the run's folder as sim_name, at given values of some columns. Runs without the
    file aren't there."""
    found = spark.read.csv(f"{folder}/*/{file}", schema=schema, header=True)
    named = found.withColumn("sim_name", F.element_at(F.split(F.input_file_name(), "/"), -2))
    for name, value in levels.items():
        named = named.where(F.col(name) == F.lit(value))
    return named


def nearest_links(beads: DataFrame, keys: Sequence[str], bead: str = "bead", linked: str = "is_loop") -> DataFrame:
    """left_neighbor, right_neighbor of each row: the last linked bead up to it and the first from it on, among its run's and frame's."""
    links = beads.where(F.col(linked) != 0).groupBy(*keys).agg(F.array_sort(F.collect_set(bead)).alias("_links"))
    own = beads.join(links, list(keys), "left")
    left = F.array_max(F.filter("_links", lambda b: b <= F.col(bead)))
    right = F.array_min(F.filter("_links", lambda b: b >= F.col(bead)))
    return own.withColumns({"left_neighbor": left, "right_neighbor": right}).drop("_links")


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], by: Sequence[str] = ()) -> None:
    """Parquet sorted by keys within files, in folders by some columns."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy(*by).mode("overwrite").parquet(path)


def claimed(spark: SparkSession, folder: str, prefix: str = "run") -> str:
    """A folder for a new run, numbered, that no other run has: the file that claims it can be created only once."""
    number = 0
    while True:
        path = f"{folder.rstrip('/')}/{prefix}.{number}"
        marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_claimed")
        if marker.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(marker):
            return path
        number += 1


def write_runs(df: DataFrame, params: DataFrame, folder: str, run: str = "sim_name") -> None:
    """CSV tables of runs, and of their parameters (run, key, value), in a folder for each run: what is written is what read_runs_with reads. Each run's rows
    lie together, and a run of many rows in several files. Rows without a run can't be told from others and aren't written."""
    df.where(F.col(run).isNotNull()).repartition(run).write.partitionBy(run).option("header", True).csv(f"{folder}/rows")
    params.where(F.col(run).isNotNull()).select(run, "key", "value").repartition(run).write.partitionBy(run).csv(f"{folder}/params")


def read_params(spark: SparkSession, folder: str, names: Sequence[str], run: str = "sim_name") -> DataFrame:
    """run, and a double for each named parameter: null where a run's file doesn't have it or its value is no number. Of a repeated key the largest text counts."""
    found = spark.read.csv(f"{folder}/params", schema=f"key string, value string, {run} string")
    return found.groupBy(run).agg(*(F.max(F.when(F.col("key") == n, F.col("value"))).try_cast("double").alias(n) for n in names))


def shared_params(spark: SparkSession, folder: str, run: str = "sim_name") -> DataFrame:
    """key, values, runs: of each parameter, how many values it has and in how many runs; one of more than one value is not shared."""
    found = spark.read.csv(f"{folder}/params", schema=f"key string, value string, {run} string")
    return found.groupBy("key").agg(F.countDistinct("value").alias("values"), F.countDistinct(run).alias("runs"))


def read_runs_with(spark: SparkSession, folder: str, schema: str, names: Sequence[str], where: str | None = None, run: str = "sim_name") -> DataFrame:
    """The rows of runs with their run and parameters as columns. where: a condition on the parameters. Runs are folders that Spark
    knows as partitions, so a condition on runs, or one on parameters by way of the join, keeps it from reading the others. Runs without parameters aren't there."""
    rows = spark.read.csv(f"{folder}/rows", schema=f"{schema}, {run} string", header=True)
    params = read_params(spark, folder, names, run)
    return rows.join(params if where is None else params.where(where), run)
