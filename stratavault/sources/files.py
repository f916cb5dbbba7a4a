"""Files in and out, and tables as files."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_files(spark: SparkSession, path: str, user_id: int, pattern: str = "*") -> DataFrame:
    """(path, user_id, file_size, data) of the files under a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.lit(user_id).alias("user_id"), F.col("length").alias("file_size"), F.col("content").alias("data"))


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq, user_id, path, data): a document is a file, its source's number the user, its id the order."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.col("doc_id").alias("seq"), F.substring("source", 4, 10).cast("int").alias("user_id"), F.concat_ws("/", F.lit(""), "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("data"))


def write_files(chunks: DataFrame, folder: str, name: str = "name", data: str = "chunk") -> DataFrame:
    """Writes files from their chunks in order (each file's in one partition, as ``restore`` gives them); (path, file_size, sha256) as written.

    ``folder`` is a URI or path that all executors reach.  A file is written beside its
    place and moved there when whole, so a task that is run again leaves no halves.
    """
    schema = "path string, file_size long, sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        fs.create_dir(root, recursive=True)
        done: list[tuple[str, int, str]] = []
        now = out = part = None
        size, digest = 0, hashlib.sha256()

        def close() -> None:
            out.close()
            fs.move(part, f"{root}/{now}")
            done.append((f"{root}/{now}", size, digest.hexdigest()))

        for batch in batches:
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None or file != now:
                    if out is not None:
                        close()
                    now, part, size, digest = file, f"{root}/.{uuid.uuid4().hex}.part", 0, hashlib.sha256()
                    out = fs.open_output_stream(part)
                out.write(piece)
                digest.update(piece)
                size += len(piece)
        if out is not None:
            close()
        cols = list(zip(*done, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["path", "file_size", "sha256"])

    return chunks.select(F.col(name).cast("string"), data).mapInArrow(run, schema)


def read_clouds(spark: SparkSession, path: str) -> DataFrame:
    """(cloud, host, port) from a text file with one ip:port a line, counted from 0."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("cloud", "a"))
    return lines.select("cloud", F.split_part("a", F.lit(":"), F.lit(1)).alias("host"), F.split_part("a", F.lit(":"), F.lit(2)).cast("int").alias("port"))
