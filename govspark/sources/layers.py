"""Datasets in medallion layers: ``{root}/{layer}/{domain}/{dataset}/v=N``; a write never replaces a version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from govspark.vocabulary import LAYERS


def dataset_path(root: str, layer: str, domain: str, dataset: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}")
    return f"{root.rstrip('/')}/{layer}/{domain}/{dataset}"


def _numbers(spark: SparkSession, root: str, layer: str, domain: str, dataset: str) -> dict[int, bool]:
    """Version numbers in the folder, each with whether its job has committed."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(dataset_path(root, layer, domain, dataset))
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(base):
        return {}
    paths = [status.getPath() for status in files.listStatus(base)]
    return {
        int(path.getName()[2:]): files.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))
        for path in paths
        if path.getName().startswith("v=")
    }


def versions(spark: SparkSession, root: str, layer: str, domain: str, dataset: str) -> list[int]:
    """Completed versions in ascending order."""
    return sorted(n for n, done in _numbers(spark, root, layer, domain, dataset).items() if done)


def next_version(spark: SparkSession, root: str, layer: str, domain: str, dataset: str) -> int:
    """A number above all that were begun."""
    return max(_numbers(spark, root, layer, domain, dataset), default=0) + 1


def write_dataset(df: DataFrame, root: str, layer: str, domain: str, dataset: str, version: int | None = None) -> int:
    """Write the next version and return its number.

    The number of a failed write is not used again; of two writers of the same number one fails. A caller that repeats a write
    of its own gives the ``version``: one that was not finished is written anew, a finished one is never replaced.
    """
    spark = df.sparkSession
    number = version or next_version(spark, root, layer, domain, dataset)
    again = version is not None and _numbers(spark, root, layer, domain, dataset).get(number) is False
    mode = "overwrite" if again else "errorifexists"
    df.write.mode(mode).parquet(f"{dataset_path(root, layer, domain, dataset)}/v={number}")
    return number


def read_dataset(spark: SparkSession, root: str, layer: str, domain: str, dataset: str,
                 version: int | None = None) -> DataFrame:
    known = versions(spark, root, layer, domain, dataset)
    if not known:
        raise FileNotFoundError(dataset_path(root, layer, domain, dataset))
    number = known[-1] if version is None else version
    return spark.read.parquet(f"{dataset_path(root, layer, domain, dataset)}/v={number}")
