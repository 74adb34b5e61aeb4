"""Command line: ``python -m cairnstore pack|unpack|list|info|verify ...``; a failure ends with status 1."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cairnstore")
    verbs = out.add_subparsers(dest="verb", required=True)
    pack = verbs.add_parser("pack", help="pack file trees into an archive")
    pack.add_argument("archive")
    pack.add_argument("paths", nargs="+")
    pack.add_argument("--mode", default="best")
    pack.add_argument("--exclude", action="append", default=[])
    unpack = verbs.add_parser("unpack", help="restore all entries, or those asked for")
    unpack.add_argument("archive")
    unpack.add_argument("asks", nargs="*")
    unpack.add_argument("--to", default=".")
    unpack.add_argument("--verify", action="store_true")
    for verb in ("list", "info", "verify"):
        verbs.add_parser(verb).add_argument("archive")
    return out


def main(arguments: list[str]) -> int:
    from cairnstore.plans import store
    from cairnstore.session import session
    from cairnstore.sources import fs_tree

    a = parser().parse_args(arguments)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    if a.verb == "pack":
        entries = fs_tree.tree_entries(spark, a.paths, a.exclude)
        store.pack(entries, a.archive, a.mode)
    archive = store.Archive(spark, a.archive)
    if a.verb == "unpack":
        missing = [r["ask"] for r in archive.unmatched(a.asks).collect()] if a.asks else []
        for ask in missing:
            print(f"nothing matches {ask}", file=sys.stderr)
        read: dict = {}
        n = store.unpack(spark, a.archive, a.to, a.asks, a.verify, read.update)
        print(f"{n} entries, {read['bytes']} bytes")
        return 1 if missing else 0
    if a.verb == "list":
        for r in archive.list(long=True).toLocalIterator():
            print(r["mode_string"], f"{r['human']:>10}", r["name"])
    if a.verb == "verify":
        wrong = 0
        for r in archive.verify().toLocalIterator():
            wrong += 1
            print(f"{r['what']} {r['id']}", file=sys.stderr)
        return 1 if wrong else 0
    if a.verb in ("pack", "info"):
        for key, value in archive.info().first().asDict().items():
            print(f"{key}: {value}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
