"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def valid(path: Column) -> Column:
    return F.coalesce((F.length(path) > 0) & ~path.startswith("./") & ~path.startswith("../"), F.lit(False))


def absolute(path: Column) -> Column:
    """With a leading slash; null if empty or relative upwards."""
    return F.when(valid(path), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def directory(name: Column) -> Column:
    """With a trailing slash; null if empty."""
    return F.when(F.length(name) > 0, F.when(name.endswith("/"), name).otherwise(F.concat(name, F.lit("/"))))


def joined(prefix: Column, name: Column) -> Column:
    """``name`` under ``prefix``; null for names that begin with /, ./ or ../."""
    return F.when(valid(name) & ~name.startswith("/"), F.concat(directory(prefix), name))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)([^/]*)$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)([^/]*)$", 2)


def ancestors(path: Column) -> Column:
    """Every directory above, from / downwards, each with its trailing slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.concat_ws("/", F.slice(parts, F.lit(1), n)), F.lit("/")))


def same_directory(a: Column, b: Column) -> Column:
    """Equal but for a leading ./ and the trailing slash."""
    norm = lambda c: directory(F.regexp_replace(c, r"^(\./)+", ""))
    return F.coalesce(norm(a) == norm(b), F.lit(False))
