"""Directories, versions, recipes and restore."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import binary as B, paths as P


def inodes(files: DataFrame, path: str = "path", user: str = "user_id") -> DataFrame:
    """Adds the absolute path, names and fingerprints of a file and its directory; invalid paths go."""
    out = files.withColumn("full_path", P.absolute(F.col(path))).where("full_path is not null")
    out = out.withColumns({"dir": P.dirname(F.col("full_path")), "name": P.basename(F.col("full_path"))})
    return out.withColumns({"inode_fp": B.inode_fingerprint(F.col("full_path"), F.col(user)), "dir_fp": B.inode_fingerprint(F.col("dir"), F.col(user))})


def tree_edges(files: DataFrame, path: str = "full_path", user: str = "user_id") -> DataFrame:
    """(user_id, parent, child) for every directory and file, once each; / has no parent."""
    up = files.select(F.col(user).alias("user_id"), P.ancestors(F.col(path)).alias("up"), F.col(path).alias("leaf"))
    chain = up.select("user_id", F.concat("up", F.array("leaf")).alias("chain"))
    pairs = chain.select("user_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("chain") - 1), lambda i: F.struct(F.element_at("chain", i).alias("parent"), F.element_at("chain", i + 1).alias("child")))).alias("e"))
    return pairs.select("user_id", "e.parent", "e.child").distinct()


def children(edges: DataFrame) -> DataFrame:
    return edges.groupBy("user_id", "parent").agg(F.count("*").alias("num_children"))


def at_version(versions: DataFrame, by: list[str], version: str, back: int = 0) -> DataFrame:
    """The row ``back`` versions before the newest; files with fewer versions have none."""
    if back < 0:
        raise ValueError("back counts from 0")
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(version)))
    return versions.withColumn("__rank", rank).where(F.col("__rank") == back + 1).drop("__rank")


def complete_files(recipe: DataFrame, sizes: DataFrame, by: str = "doc_id") -> DataFrame:
    """Per file its secrets and bytes in the recipe, and whether they make up the file."""
    got = recipe.groupBy(by).agg(F.count("*").alias("num_shares"), F.sum("secret_size").alias("recipe_bytes"))
    return sizes.join(got, by, "left").select(by, F.coalesce("num_shares", F.lit(0)).alias("num_shares"), F.coalesce("recipe_bytes", F.lit(0)).alias("recipe_bytes"), (F.coalesce("recipe_bytes", F.lit(0)) == F.col("file_size")).alias("complete"))


def find_files(requests: DataFrame, files: DataFrame, user: str = "user_id", path: str = "path") -> DataFrame:
    """The files that (user, path) requests ask for, by inode fingerprint; found tells whether there is one."""
    asked = inodes(requests, path, user).select(*requests.columns, "inode_fp").withColumn("__asked", F.lit(True))
    known = files.select("inode_fp", *[c for c in files.columns if c not in {*requests.columns, "inode_fp"}]).withColumn("__known", F.lit(True))
    return asked.join(known, "inode_fp", "left").withColumn("found", F.col("__known").isNotNull()).drop("__asked", "__known")


def listing(edges: DataFrame, directory: str) -> DataFrame:
    """(user_id, name, is_dir) of what a directory holds, for every user that has it."""
    name = F.substring(F.col("child"), F.length("parent") + 1, F.length("child"))
    return edges.where(F.col("parent") == F.lit(directory)).select("user_id", name.alias("name"), F.col("child").endswith("/").alias("is_dir"))


def walk(edges: DataFrame, directory: str) -> DataFrame:
    """(user_id, path, depth) of everything below a directory.

    A path holds its ancestors' names, so what is below is known by prefix, without
    following the edges level by level.
    """
    below = edges.where(F.col("child").startswith(directory) & (F.col("child") != F.lit(directory)))
    rest = F.rtrim(F.substring(F.col("child"), F.lit(len(directory) + 1), F.length("child")), F.lit("/"))
    return below.select("user_id", F.col("child").alias("path"), F.size(F.split(rest, "/")).alias("depth"))


def restore(recipe: DataFrame, store: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, secret_id, chunk): each file's secrets from the store (fp, chunk), in order within a partition.  A missing share leaves the file out.

    Whole files are never put together in a row, so their size has no bound; sinks and
    ``digests`` take the chunks one after another.
    """
    joined = recipe.join(store, "fp", "left")
    broken = joined.where("chunk is null").select(by).distinct()
    return joined.join(broken, by, "left_anti").select(by, "secret_id", "chunk").repartition(by).sortWithinPartitions(by, "secret_id")


def digests(chunks: DataFrame, by: str = "doc_id", data: str = "chunk") -> DataFrame:
    """(by, sha256) of files given as chunks in order, each file's in one partition, as ``restore`` gives them."""
    schema = T.StructType([chunks.schema[by], T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list = []
        sums: list[str] = []
        now = digest = None
        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or name != now:
                    if digest is not None:
                        names.append(now)
                        sums.append(digest.hexdigest())
                    now, digest = name, hashlib.sha256()
                digest.update(piece)
        if digest is not None:
            names.append(now)
            sums.append(digest.hexdigest())
        kind = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array(names, kind[0].type), pa.array(sums, pa.string())], names=schema.names)

    return chunks.select(by, data).mapInArrow(run, schema)
