"""Relational operators on entries, chunks and asks: deduplication, selection, layout, verification."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cairnstore.functions import scalars as S
from cairnstore.lineage import checkpointed

#: Asks that are tested as literals.
FEW_ASKS = 200

# ---- entries from tables


def document_entries(docs: DataFrame) -> DataFrame:
    """Documents as files: name source/lang/id.txt, content of UTF-8 bytes."""
    name = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    content = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").alias("entry_id"), name.alias("name"), F.lit("file").alias("kind"), F.octet_length("text").cast("long").alias("size"), content.alias("content"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Pages as files named by host and path."""
    name = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"\?.*$", "")
    return pages.select(F.col("page_id").alias("entry_id"), name.alias("name"), F.lit("file").alias("kind"), F.octet_length("html").cast("long").alias("size"), F.col("html").cast("binary").alias("content"))


# ---- deduplication


def first_wins(rows: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row a key: the first by ``order``; combined before the shuffle, without a window."""
    first = F.min_by(F.struct(*keep), F.struct(*order))
    return rows.groupBy(key).agg(first.alias("first"), F.count("*").alias("n_refs")).select(key, "first.*", "n_refs")


def with_groups(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with the size ``n`` and the ``first`` member of their group; groups are counted, not gathered."""
    groups = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return rows.join(groups, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def changed_sizes(rows: DataFrame, size: str, content: str) -> DataFrame:
    """Rows whose content is not as long as it was said to be, with its ``actual`` length."""
    actual = F.octet_length(content)
    return rows.withColumn("actual", actual).where(actual != F.col(size))


def watched(rows: DataFrame, size: str) -> tuple[DataFrame, Observation]:
    """``rows`` and what a run over them counts as it goes: rows and bytes, without a run of its own."""
    seen = Observation()
    return rows.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")), seen


def dedup_report(entries: DataFrame, group: Column) -> DataFrame:
    """Files, distinct contents and bytes, in all and after deduplication, for each group."""
    unique = entries.groupBy(group.alias("grp"), S.content_hash(F.col("content")).alias("hash")).agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("one")
    )
    total = unique.groupBy("grp").agg(F.sum("n").alias("n_files"), F.count("*").alias("n_unique"), F.sum("bytes").alias("raw_bytes"), F.sum("one").alias("unique_bytes"))
    return total.withColumn("ratio", S.ratio(F.col("unique_bytes"), F.col("raw_bytes")))


def chunk_lists(refs: DataFrame) -> DataFrame:
    """(entry_id, chunk_ids) in the order of ``pos``."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "chunk_id")))
    return refs.groupBy("entry_id").agg(F.transform(pairs, lambda p: p["chunk_id"]).alias("chunk_ids"))


def assemble(parts: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """Parts of a key concatenated in order; strings and bytes alike."""
    return parts.groupBy(key).agg(F.expr(f"listagg({content}) WITHIN GROUP (ORDER BY {order})").alias(content))


def drop_duplicate_names(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The first row of each name."""
    w = Window.partitionBy(name).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def clean_path(path: Column) -> Column:
    """Without leading `./`s, repeated slashes and a trailing slash: `./a`, `a` and `a/` are one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^(\./)+", ""), "/+", "/"), "(?<=.)/$", "")


def resolve_links(rows: DataFrame, targets: DataFrame, link: str, name: str, keep: list[str]) -> DataFrame:
    """``rows`` with ``keep`` of the target that their link names; a row without a target keeps its own."""
    found = targets.select(F.col(name).alias("_target"), *[F.col(c).alias(f"_{c}") for c in keep])
    out = rows.join(found, F.col(link) == F.col("_target"), "left")
    for c in keep:
        out = out.withColumn(c, F.when(F.col("_target").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)))
    return out.drop("_target", *[f"_{c}" for c in keep])


def hard_links(rows: DataFrame, identity: list[str], order: str, name: str) -> DataFrame:
    """``link`` to the first name of the same identity; null on the first itself."""
    first = F.first_value(name).over(Window.partitionBy(*identity).orderBy(order))
    return rows.withColumn("link", F.when(first != F.col(name), first))


# ---- selection


def select_asked(entries: DataFrame, asks: DataFrame) -> DataFrame:
    """Entries that some ask matches, each once.

    Up to `FEW_ASKS` asks, as on a command line, are tested inside the scan. More are matched by equality joins on the
    name, the base name and each directory above, so any number of them scales.
    """
    ask = asks.select(S.normalise_ask(F.col("ask")).alias("ask")).distinct()
    if ask.limit(FEW_ASKS + 1).count() <= FEW_ASKS:
        few = F.array(*[F.lit(r["ask"]) for r in ask.collect()]).cast("array<string>")
        return entries.where(F.arrays_overlap(ask_keys(F.col("name")), few))
    keyed = entries.select("name", F.explode(ask_keys(F.col("name"))).alias("ask"))
    names = keyed.join(ask, "ask", "left_semi").select("name").distinct()
    return entries.join(names, "name", "left_semi")


def ask_keys(name: Column) -> Column:
    """What an ask may be to match a name: the name, its base name, each directory above it."""
    segments = F.split(name, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, 1, n), "/"))
    return F.array_distinct(F.concat(above, F.array(S.base_name(name))))


def unmatched(entries: DataFrame, asks: DataFrame) -> DataFrame:
    """Asks that match no entry."""
    keyed = entries.select(F.explode(ask_keys(F.col("name"))).alias("_ask")).distinct()
    return asks.join(keyed, S.normalise_ask(F.col("ask")) == F.col("_ask"), "left_anti")


def exclude_self(paths: DataFrame, output: DataFrame, column: str) -> DataFrame:
    return paths.join(output, column, "left_anti")


# ---- listing


def listing_totals(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count_if(F.col("kind").isin("file", "hardlink")).alias("n_files"),
        F.count_if(F.col("kind") == "dir").alias("n_dirs"),
        F.count_if(F.col("kind") == "symlink").alias("n_links"),
        F.sum("size").alias("total_size"),
    )


def list_long(entries: DataFrame) -> DataFrame:
    return entries.select("name", "size", S.human_size(F.col("size")).alias("human"), S.mode_string(F.col("mode"), F.col("kind")).alias("mode_string")).orderBy("name")


def archive_profile(chunks: DataFrame) -> DataFrame:
    """Stored and compressed chunks, their bytes and shares in one pass."""
    out = chunks.agg(
        F.count_if("stored").alias("n_stored"),
        F.count_if(~F.col("stored")).alias("n_compressed"),
        F.coalesce(F.sum(F.when(F.col("stored"), F.col("n_bytes"))), F.lit(0)).alias("stored_bytes"),
        F.coalesce(F.sum(F.when(~F.col("stored"), F.col("n_bytes"))), F.lit(0)).alias("compressed_bytes"),
    )
    return out.withColumn("stored_share", S.ratio(F.col("stored_bytes"), F.col("stored_bytes") + F.col("compressed_bytes")))


# ---- layout


def _sorted_once(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` sorted by range with `_part` and `_mono` (the place in the sort), computed once.

    What is numbered and what is counted must come from one and the same run of the sort: another run may cut the
    ranges elsewhere.
    """
    placed = rows.orderBy(*order).withColumn("_mono", F.monotonically_increasing_id())
    return checkpointed(placed).withColumn("_part", F.shiftright("_mono", 33).cast("int"))


def running_totals(rows: DataFrame, partition: list[str], order: str, value: str, column: str) -> DataFrame:
    """Running sum of ``value`` up to and with each row, in the order of ``order`` inside each partition key.

    Rows are sorted by range over (key, order), so a hot key is spread over many tasks; sums inside a task are added
    to the totals of the tasks before it, a number for each task and key. Null values count as 0.
    """
    placed = _sorted_once(rows, [*partition, order])
    inside = Window.partitionBy("_part", *partition).orderBy("_mono").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = placed.groupBy("_part", *partition).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    earlier = Window.partitionBy(*partition).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    before = before.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(partition)], "_before")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(partition):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    out = placed.withColumn("_own", own).join(before, same)
    return out.withColumn(column, F.col("_own") + F.col("_before")).select(*rows.columns, column)


def region_offsets(chunks: DataFrame, partition: list[str], order: str) -> DataFrame:
    """Exclusive running sum of bytes inside each region."""
    ran = running_totals(chunks, partition, order, "n_bytes", "region_offset")
    return ran.withColumn("region_offset", F.col("region_offset") - F.coalesce("n_bytes", F.lit(0)))


def dense_ids(rows: DataFrame, order: list[str], column: str) -> DataFrame:
    """Numbers 0.. in the order of ``order`` without a global window.

    Rows are sorted by range once; each partition's count is summed up on the driver (a number for each partition)
    and added to positions inside the partition.
    """
    spark = rows.sparkSession
    placed = _sorted_once(rows, order)
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    if not before:
        return rows.withColumn(column, F.lit(0).cast("long"))
    starts = spark.createDataFrame(before, "_p int, _before long")
    at = F.col("_mono").bitwiseAND((1 << 33) - 1) + F.col("_before")
    return placed.join(F.broadcast(starts), F.col("_part") == F.col("_p")).withColumn(column, at).select(*rows.columns, column)


def contiguous_groups(rows: DataFrame, number: str, total: Column, groups: int) -> DataFrame:
    """Groups of ceil(total / groups) neighbours, the last ones shorter."""
    per = F.ceil(total / groups)
    return rows.withColumn("group_id", F.floor(F.col(number) / per).cast("long"))


def compression_order(entries: DataFrame) -> DataFrame:
    """Extension, size bucket, path."""
    return entries.withColumn("ext", S.extension(F.col("name"))).withColumn("bucket", S.size_bucket(F.col("size"))).orderBy("ext", "bucket", "name")


def running_budget(rows: DataFrame, partition: list[str], order: str, size: str, limit: int, least: int = 0, most: int = 1 << 62) -> DataFrame:
    """Rows of fitting size whose running total up to and with them stays within ``limit``."""
    fitting = rows.where(F.col(size).between(least, most))
    return running_totals(fitting, partition, order, size, "running").where(F.col("running") <= limit)


def required_version(entries: DataFrame) -> DataFrame:
    """The newest feature decides: 8 plain, 9 sub-second or odd times, 11 hard links, 12 row-wise rasters."""
    need = (
        F.when(F.col("file_xform").isin(8, 9), 12)
        .when(F.col("kind") == "hardlink", 11)
        .when(~S.fits_old_time(F.col("mtime_ns")), 9)
        .otherwise(8)
    )
    return entries.agg(F.coalesce(F.max(need), F.lit(8)).alias("version"))


def scan_range(chunks: DataFrame, start: str, size: str) -> DataFrame:
    """How far a region must be read for these chunks."""
    return chunks.agg(F.coalesce(F.max(F.col(start) + F.col(size)), F.lit(0)).alias("scan_end"))


def some_names(rows: DataFrame, name: str, n: int = 3) -> str:
    """The first names and how many there are in all, for a message; empty for no rows."""
    total = rows.count()
    first = [r[0] for r in rows.select(name).orderBy(name).limit(n).collect()]
    return ", ".join(first) + (f" and {total} in all" if total > n else "")


def history_prefix(rows: DataFrame, order: str, size: str, least: int) -> DataFrame:
    """The first rows whose sizes reach ``least``, with the one that reaches it."""
    ran = running_totals(rows, [], order, size, "_ran")
    return ran.where(F.col("_ran") - F.col(size) < least).drop("_ran")


def tree_hash(rows: DataFrame, number: str, digest: str, fan: int = 4096) -> str:
    """A hash over all digests in the order of their numbers 0.., as a tree of ``fan`` children a node.

    No task sees more than ``fan`` digests. The hash of no rows is that of an empty string.
    """
    level = rows.select(F.col(number).alias("n"), F.col(digest).alias("d"))
    while True:
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "d"))), lambda x: x["d"]), "")
        level = level.groupBy(F.floor(F.col("n") / fan).alias("n")).agg(F.sha2(parts.cast("binary"), 256).alias("d"))
        level = checkpointed(level)
        found = level.limit(2).collect()
        if len(found) < 2:
            return found[0]["d"] if found else sha256(b"").hexdigest()


# ---- verification


def logical_mismatches(parents: DataFrame, children: DataFrame, key: str, expected: str, actual: str) -> DataFrame:
    """Parents whose own total differs from the sum of their children."""
    sums = children.groupBy(key).agg(F.sum(actual).alias("got"))
    return parents.join(sums, key, "left").withColumn("got", F.coalesce("got", F.lit(0))).where(F.col(expected) != F.col("got"))


def dangling(children: DataFrame, parents: DataFrame, *key: str) -> DataFrame:
    return children.join(parents.select(*key).distinct(), list(key), "left_anti")


def out_of_bounds(chunks: DataFrame, limit: int) -> DataFrame:
    return chunks.where((F.col("n_bytes") < 0) | (F.col("n_bytes") > limit))


def count_mismatches(expected: DataFrame, rows: DataFrame, key: str, column: str) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count("*").alias("got"))
    return expected.join(counts, key, "left").withColumn("got", F.coalesce("got", F.lit(0))).where(F.col(column) != F.col("got"))


# ---- choice


def argmin_candidate(candidates: DataFrame, key: str, size: str, order: str, keep: list[str]) -> DataFrame:
    """The smallest candidate of each key; of equals the first."""
    return candidates.groupBy(key).agg(F.min_by(F.struct(*keep), F.struct(size, order)).alias("best")).select(key, "best.*")


def common_root(paths: DataFrame, column: str) -> DataFrame:
    """The longest path that all parents of the cleaned paths share; `.` if none.

    One pass: the smallest and the largest parent, as lists of segments, share just what all share.
    """
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(column, r"(^|/)(\./)+", "$1"), "/+", "/"), "(?<=.)/$", "")
    segments = F.split(clean, "/")
    parent = F.slice(segments, 1, F.size(segments) - 1)
    ends = paths.agg(F.min(parent).alias("a"), F.max(parent).alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    indexes = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(indexes, lambda i: F.get("a", i) != F.get("b", i))
    shared = F.array_join(F.slice("a", F.lit(1), F.coalesce(F.array_min(differ), n)), "/")
    return ends.select(F.when(F.coalesce(shared, F.lit("")) == "", F.when(F.get("a", F.lit(0)) == "", "/").otherwise(".")).otherwise(shared).alias("root"))
