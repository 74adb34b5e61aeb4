"""Writes entries as files. Names come from an archive and are not trusted."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inside(target: str, name: str) -> str:
    """The path of ``name`` below ``target``; ValueError if it would leave it."""
    root = os.path.abspath(target)
    path = os.path.abspath(os.path.join(root, name))
    if path == root or not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{name!r} leaves the target")
    return path


def make_parents(target: str, path: str) -> None:
    """Real folders from ``target`` down to ``path``'s parent; a link in the way is removed, not followed."""
    root = os.path.abspath(target)
    at = root
    os.makedirs(at, exist_ok=True)
    for segment in os.path.relpath(os.path.dirname(path), root).split("/"):
        if segment == ".":
            continue
        at = os.path.join(at, segment)
        if os.path.islink(at):
            os.unlink(at)
        os.makedirs(at, exist_ok=True)


def _write(target: str, row) -> None:
    path = inside(target, row["name"])
    make_parents(target, path)
    if row["kind"] == "dir":
        if os.path.islink(path):
            os.unlink(path)
        os.makedirs(path, exist_ok=True)
        return
    if os.path.islink(path) or os.path.isfile(path):
        os.unlink(path)
    if row["kind"] == "symlink":
        os.symlink(row["link"], path)
        return
    part = f"{path}.part{os.getpid()}"
    with open(part, "wb") as f:
        f.write(row["content"] or b"")
    os.chmod(part, (row["mode"] or 0o644) & 0o7777)
    if row["mtime_ns"]:
        os.utime(part, ns=(row["mtime_ns"], row["mtime_ns"]))
    os.replace(part, path)


def write_entries(rows: DataFrame, target: str, names: DataFrame | None = None) -> int:
    """Files and folders first, then links, then modes and times of folders, deepest first; returns how many.

    Contents are computed once, in the pass that writes them; ``names`` gives the same entries without contents for
    the later passes. A hard link is written as a file of its own and made a link if its target was restored too.
    """
    names = rows.drop("content") if names is None else names

    def write(batches):
        import pyarrow as pa

        for b in batches:
            n = 0
            for row in b.to_pylist():
                if row["kind"] != "symlink":
                    _write(target, row)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    def link(part):
        for row in part:
            if row["kind"] == "symlink":
                _write(target, {**row.asDict(), "content": None})
                continue
            path, first = inside(target, row["name"]), inside(target, row["link"])
            if os.path.isfile(first) and not os.path.islink(first):
                spare = f"{path}.link{os.getpid()}"
                os.link(first, spare)
                os.replace(spare, path)

    written = rows.mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    links = names.where(F.col("kind").isin("symlink", "hardlink") & F.col("link").isNotNull())
    links.foreachPartition(link)
    folders = names.where(F.col("kind") == "dir").select("name", "mode", "mtime_ns").orderBy(F.length("name").desc())
    for d in folders.toLocalIterator():
        path = inside(target, d["name"])
        os.chmod(path, (d["mode"] or 0o755) & 0o7777)
        if d["mtime_ns"]:
            os.utime(path, ns=(d["mtime_ns"], d["mtime_ns"]))
    return written + names.where(F.col("kind") == "symlink").count()
