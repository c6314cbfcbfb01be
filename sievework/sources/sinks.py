"""Sinks: JSON records, upserts and downloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_json_records(df: DataFrame) -> DataFrame:
    """A single column ``value`` of JSON objects; null fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    to_json_records(df).write.mode("overwrite").text(path)


def _put(folder: str, name: str, value: bytes) -> None:
    files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/{name}") as out:
        out.write(value)


def write_files(df: DataFrame, folder: str, name_col: str = "file_name", value_col: str = "content") -> None:
    """Each row's ``value_col`` as a file of a folder that all executors share, written where the row is; a file of the same name is replaced."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, value in zip(b["name"], b["value"]):
                _put(folder, name, value)
            yield b[["name"]]

    df.select(F.col(name_col).alias("name"), F.col(value_col).cast("binary").alias("value")).mapInPandas(save, "name string").write.format("noop").mode("overwrite").save()


def write_json_files(df: DataFrame, folder: str, name_col: str) -> None:
    """One JSON file for each row, under the name in ``name_col``, which isn't part of the record; see ``write_files``."""
    record = F.to_json(F.struct(*(c for c in df.columns if c != name_col)), {"pretty": "true"})
    write_files(df.select(name_col, record.alias("content")), folder, name_col)


def present_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name) of the files in a folder, which need not exist."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "file_name string")
    names = spark.read.format("binaryFile").load(folder).select("path")
    return names.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file_name"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def upsert(new: DataFrame, path: str, target: str, key: str = "source", order: str | None = None) -> None:
    """Rows of ``path`` not replaced by key, and the new ones, written to ``target``.

    Of new rows with one key the last by ``order`` stays, without one any.
    Nothing need be at ``path`` yet; what is there and can't be read is an
    error, and never overwritten. Null keys are all kept.
    """
    if order:
        best = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
        new = best.unionByName(new.where(F.col(key).isNull()))
    else:
        new = new.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(new.where(F.col(key).isNull()))
    if exists(new.sparkSession, path):
        old = new.sparkSession.read.parquet(path)
        new = old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    new.write.mode("overwrite").parquet(target)


def download(pdfs: DataFrame, present: DataFrame, fetch: Callable[[str], bytes]) -> DataFrame:
    """(pdf_url, file_name, content, status) of new PDFs whose file is not present; a failed fetch is its row's status."""
    todo = pdfs.where("status = 'new'").join(present.select("file_name"), "file_name", "left_anti").select("pdf_url", "file_name")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, name in zip(b["pdf_url"], b["file_name"]):
                try:
                    rows.append((url, name, fetch(url), "downloaded"))
                except Exception as e:
                    rows.append((url, name, None, f"failed: {e}"))
            yield pd.DataFrame(rows, columns=["pdf_url", "file_name", "content", "status"])

    return todo.mapInPandas(run, "pdf_url string, file_name string, content binary, status string")
