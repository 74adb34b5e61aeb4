"""The archive store: pack, list, info, verify, extract and unpack over Parquet tables.

An archive is a folder of versions, each with the tables `entries`, `chunks`, `blobs` and `archive`; the newest of
the files `_CURRENT-...` names the version that is published, so readers see a whole archive or the one before it. Listing and
profiling read no contents; extraction reads only the groups that the asked entries need.
"""

from __future__ import annotations

from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnstore.functions import chunking, codecs, transforms
from cairnstore.functions import scalars as S
from cairnstore.operators import catalog as C

#: Chunks compressed together; with the largest chunk of 256 KiB a group is 16 MiB at most.
GROUP_CHUNKS = 64
#: Names of published versions start so; the number orders them.
POINTER = "_CURRENT-"
# Transforms that are tried on a chunk, by codec.
CANDIDATES = {"zstd": (), "lzma2": (1, 2, 3, 4, 5), "cm": (3, 5)}


def _fields(entries: DataFrame) -> DataFrame:
    """Entries with every column that the store keeps; what is missing gets its neutral value."""
    defaults = {"kind": F.lit("file"), "mtime_ns": F.lit(0).cast("long"), "mode": F.lit(0o644), "link": F.lit(None).cast("string")}
    for name, value in defaults.items():
        if name not in entries.columns:
            entries = entries.withColumn(name, value)
    return entries.select("entry_id", "name", "kind", "mtime_ns", "mode", "link", "content")


def chunk_rows(entries: DataFrame, mode: str, least: int, most: int, bits: int) -> DataFrame:
    """(entry_id, file_xform, pos, n_bytes, hash, xform, body) of every chunk, in the order of each content.

    A raster is turned by rows as a whole if that makes it smaller, before it is cut.
    """
    codec = S.MODES[mode][1]

    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            for entry, content in zip(b.column("entry_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                data = content or b""
                whole, data = transforms.raster_choice(data, codecs.gate_size)
                head = transforms.sniff(data[:512]) if codec == "zstd" and not whole else -1
                rows = [(pos, data[s : s + n]) for pos, (s, n) in enumerate(chunking.cuts(data, least, most, bits))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([entry] * len(rows), pa.int64()),
                        pa.array([whole] * len(rows), pa.int32()),
                        pa.array([p for p, _ in rows], pa.int32()),
                        pa.array([len(x) for _, x in rows], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest()[:32] for _, x in rows], pa.string()),
                        pa.array([head] * len(rows), pa.int32()),
                        pa.array([x for _, x in rows], pa.binary()),
                    ],
                    names=["entry_id", "file_xform", "pos", "n_bytes", "hash", "xform", "body"],
                )

    files = entries.where(F.col("content").isNotNull()).select("entry_id", "content")
    return files.mapInArrow(run, "entry_id bigint, file_xform int, pos int, n_bytes bigint, hash string, xform int, body binary")


def choose(data: bytes, codec: str, sniffed: int) -> tuple[int, bytes, bool]:
    """(transform, transformed bytes, stored raw): the smallest candidate by the gate; of equals the first."""
    best = (sniffed if sniffed > 0 else 0, transforms.apply(sniffed, data) if sniffed > 0 else data)
    size = codecs.gate_size(best[1])
    if len(data) >= 4:
        for code in CANDIDATES[codec]:
            tried = transforms.apply(code, data)
            n = codecs.gate_size(tried)
            if n < min(size, len(data)):
                best, size = (code, tried), n
    stored = codecs.store_raw(codec, len(data), size, transforms.entropy(data))
    return (0, data, True) if stored else (*best, False)


def pack(entries: DataFrame, path: str, mode: str = "best", least: int = chunking.LEAST, most: int = chunking.MOST, bits: int = chunking.BITS) -> str:
    """Write entries (entry_id, name, content and what else `_fields` names) as a new version; returns its folder.

    A pack that fails leaves no folder and the version before it stays published.
    """
    if mode not in S.MODES:
        raise ValueError(f"modes are {', '.join(S.MODES)}")
    version = f"{path.rstrip('/')}/v-{uuid4().hex}"
    try:
        _write_version(entries, version, mode, least, most, bits)
        _publish(entries.sparkSession, path, version)
    except BaseException:
        where, fs, jvm = _files(entries.sparkSession, version)
        fs.delete(where, True)
        raise
    return version


def _write_version(entries: DataFrame, version: str, mode: str, least: int, most: int, bits: int) -> None:
    spark = entries.sparkSession
    codec = S.MODES[mode][1]
    kept = _fields(entries).withColumn("_kind", F.when(F.col("kind").isin("file", "hardlink"), 0).when(F.col("kind") == "dir", 1).otherwise(2))
    kept = C.drop_duplicate_names(kept, "name", ["_kind", "entry_id"]).drop("_kind")
    work = f"{version}/_work"
    with small_batches(spark, 16):
        chunk_rows(kept, mode, least, most, bits).write.parquet(f"{work}/parts")
    parts = spark.read.parquet(f"{work}/parts")
    refs = parts.select("entry_id", "pos", "hash", "n_bytes")
    # Bodies stay where they are until it is known which chunk comes first.
    unique = C.first_wins(refs, "hash", ["entry_id", "pos"], ["entry_id", "pos"]).drop("n_refs")
    numbered = C.dense_ids(unique, ["entry_id", "pos"], "chunk_id")
    numbered = numbered.withColumn("group_id", F.floor(F.col("chunk_id") / GROUP_CHUNKS).cast("long"))
    first = parts.join(numbered, ["hash", "entry_id", "pos"])

    def chosen(batches):
        import pyarrow as pa

        for b in batches:
            picked = [choose(x, codec, t) for x, t in zip(b.column("body").to_pylist(), b.column("xform").to_pylist(), strict=True)]
            columns = [b.column(c) for c in ("chunk_id", "group_id", "hash", "n_bytes")]
            columns += [pa.array([p[0] for p in picked], pa.int32()), pa.array([p[2] for p in picked], pa.bool_()), pa.array([p[1] for p in picked], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "group_id", "hash", "n_bytes", "xform", "stored", "body"])

    schema = "chunk_id bigint, group_id bigint, hash string, n_bytes bigint, xform int, stored boolean, body binary"
    with small_batches(spark, 64):
        first.select("chunk_id", "group_id", "hash", "n_bytes", "xform", "body").mapInArrow(chosen, schema).write.parquet(f"{work}/bodies")
    bodies = spark.read.parquet(f"{work}/bodies")
    here = Window.partitionBy("group_id", "stored").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)  # GROUP_CHUNKS rows at most
    placed = bodies.drop("body").withColumn("region_offset", F.coalesce(F.sum("n_bytes").over(here), F.lit(0)))
    placed.repartitionByRange("group_id").write.parquet(f"{version}/chunks")
    chunks = spark.read.parquet(f"{version}/chunks")
    wanted, got = refs.agg(F.count_distinct("hash")).first()[0], chunks.agg(F.count("*"), F.coalesce(F.max("chunk_id") + 1, F.lit(0))).first()
    if not wanted == got[0] == got[1]:
        raise RuntimeError(f"{wanted} chunks, but {got[0]} were written, numbered up to {got[1]}")

    dictionary = _dictionary(bodies, mode)

    def frames(pdf):
        import pandas as pd

        pdf = pdf.sort_values("chunk_id")
        data = b"".join(pdf["body"])
        frame = codecs.Frame("raw", data) if pdf["stored"].iloc[0] else codecs.compress(data, mode, dictionary)
        return pd.DataFrame({"group_id": [pdf["group_id"].iloc[0]], "stored": [bool(pdf["stored"].iloc[0])], "codec": [frame.codec], "raw_bytes": [len(data)], "frame_bytes": [len(frame.payload)], "payload": [frame.payload]})

    blobs = bodies.select("group_id", "stored", "chunk_id", "body").groupBy("group_id", "stored").applyInPandas(frames, "group_id bigint, stored boolean, codec string, raw_bytes bigint, frame_bytes bigint, payload binary")
    blobs.repartitionByRange("group_id").write.parquet(f"{version}/blobs")
    lists = C.chunk_lists(refs.join(chunks.select("hash", "chunk_id"), "hash"))
    sizes = parts.groupBy("entry_id").agg(F.sum("n_bytes").alias("size"), F.max("file_xform").alias("file_xform"))
    rows = kept.drop("content").join(lists, "entry_id", "left").join(sizes, "entry_id", "left")
    # A hard link has the chunks of the name that it points to.
    links, plain = rows.where("kind = 'hardlink'"), rows.where("kind <> 'hardlink'")
    targets = plain.where("kind = 'file'").select("name", "chunk_ids", "size", "file_xform")
    rows = plain.unionByName(C.resolve_links(links, targets, "link", "name", ["chunk_ids", "size", "file_xform"]))
    rows = rows.withColumn("size", F.coalesce("size", F.lit(0))).withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<bigint>")))
    rows.withColumn("file_xform", F.coalesce("file_xform", F.lit(0))).write.parquet(f"{version}/entries")
    written = spark.read.parquet(f"{version}/entries")
    numbers = F.lit(mode).alias("mode"), F.lit(C.tree_hash(chunks, "chunk_id", "hash")).alias("tree_hash"), F.lit(dictionary).cast("binary").alias("dictionary")
    totals = chunks.agg(F.count("*").alias("n_chunks")).crossJoin(written.agg(F.count("*").alias("n_entries"), F.sum("size").alias("total_bytes")))
    totals.crossJoin(C.required_version(written)).select("*", *numbers).write.parquet(f"{version}/archive")
    where, fs, jvm = _files(spark, work)
    fs.delete(where, True)


#: Chunks that a dictionary is trained on: of these sizes, so many and so many bytes at most.
SAMPLE_SIZES, SAMPLE_ROWS, SAMPLE_BYTES = (200, 128 << 10), 2000, 64 << 20


def _dictionary(bodies: DataFrame, mode: str) -> bytes | None:
    """A dictionary for the groups of a zstd mode, if it pays on the sample that it was trained on."""
    if S.MODES[mode][1] != "zstd" or mode == "fast":
        return None
    fitting = bodies.where(~F.col("stored") & F.col("n_bytes").between(*SAMPLE_SIZES))
    samples, held = [], 0
    for r in fitting.select("chunk_id", "body").orderBy("chunk_id").limit(SAMPLE_ROWS).toLocalIterator():
        held += len(r["body"])
        if held > SAMPLE_BYTES:
            break
        samples.append(bytes(r["body"]))
    found = codecs.train_dictionary(samples)
    groups = [b"".join(samples[k : k + GROUP_CHUNKS]) for k in range(0, len(samples), GROUP_CHUNKS)]
    return found if codecs.pays(found, groups, mode) else None


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def _pointers(fs, where) -> list[str]:
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n for n in names if n.startswith(POINTER))


def _publish(spark: SparkSession, path: str, version: str) -> None:
    """Make ``version`` the newest by one rename to a name that was not there; older pointers go afterwards.

    Readers take the newest pointer there is, so at any moment they see a whole version.
    """
    where, fs, jvm = _files(spark, path)
    before = _pointers(fs, where)
    number = int(before[-1][len(POINTER) :].split("-")[0]) + 1 if before else 1
    new = jvm.org.apache.hadoop.fs.Path(where, f"_new-{uuid4().hex}")
    fs.create(new, True).close()
    name = f"{POINTER}{number:012d}-{version.rsplit('/', 1)[1]}"
    if not fs.rename(new, jvm.org.apache.hadoop.fs.Path(where, name)):
        raise OSError(f"{version} could not be published")
    for old in before:
        fs.delete(jvm.org.apache.hadoop.fs.Path(where, old), False)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows for the jobs that run inside, as these rows carry whole contents."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Archive:
    """A published archive."""

    def __init__(self, spark: SparkSession, path: str):
        where, fs, jvm = _files(spark, path)
        pointers = _pointers(fs, where)
        if not pointers:
            raise FileNotFoundError(f"no archive at {path}")
        self.folder = f"{path.rstrip('/')}/{pointers[-1][len(POINTER) :].split('-', 1)[1]}"
        self.spark = spark

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def list(self, long: bool = False) -> DataFrame:
        entries = self.table("entries")
        return C.list_long(entries) if long else entries.select("name", "size", "kind").orderBy("name")

    def info(self) -> DataFrame:
        """One row: shares of stored and compressed chunks, counts, version, and the bytes of frames and dictionary."""
        frames = self.table("blobs").agg(F.coalesce(F.sum("frame_bytes"), F.lit(0)).alias("frame_bytes"))
        archive = self.table("archive").withColumn("dictionary_bytes", F.coalesce(F.octet_length("dictionary"), F.lit(0))).drop("dictionary")
        return C.archive_profile(self.table("chunks")).crossJoin(archive).crossJoin(frames)

    def _bodies(self, chunks: DataFrame | None = None) -> DataFrame:
        """(chunk_id, body, intact) of the wanted chunks, or of all; whole groups are decompressed, others are not read.

        A chunk whose group is lost or broken has an empty body and is not intact.
        """
        wanted, blobs = self.table("chunks"), self.table("blobs")
        if chunks is not None:
            wanted = wanted.join(chunks, "chunk_id", "left_semi")
            # Files and row groups of blobs are ranges of groups: bounds on the groups spare the rest of the scan.
            ends = wanted.agg(F.min("group_id").alias("low"), F.max("group_id").alias("high")).first()
            blobs = blobs.where(F.col("group_id").between(ends["low"], ends["high"])) if ends["low"] is not None else blobs.limit(0)
        members = wanted.groupBy("group_id", "stored").agg(F.collect_list(F.struct("chunk_id", "region_offset", "n_bytes", "xform", "hash")).alias("members"))
        groups = members.join(blobs, ["group_id", "stored"], "left")

        dictionary = self.table("archive").first()["dictionary"]
        dictionary = bytes(dictionary) if dictionary is not None else None

        def run(batches):
            import hashlib

            import pyarrow as pa

            for b in batches:
                for k in range(b.num_rows):  # a group of 16 MiB at a time
                    codec, payload, raw, members = (b.column(c)[k].as_py() for c in ("codec", "payload", "raw_bytes", "members"))
                    out: list[list] = [[], [], []]
                    try:
                        data = codecs.decompress(codecs.Frame(codec, payload), raw, dictionary) if codec is not None else b""
                    except ValueError:
                        data = b""
                    for m in members:
                        body = data[m["region_offset"] : m["region_offset"] + m["n_bytes"]]
                        body = transforms.apply(m["xform"], body, True) if len(body) == m["n_bytes"] else b""
                        out[0].append(m["chunk_id"])
                        out[1].append(body)
                        out[2].append(hashlib.sha256(body).hexdigest()[:32] == m["hash"])
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.bool_())], names=["chunk_id", "body", "intact"])

        return groups.select("codec", "payload", "raw_bytes", "members").mapInArrow(run, "chunk_id bigint, body binary, intact boolean")

    def entries(self, asks: list[str] | None = None) -> DataFrame:
        """The asked entries, or all, without contents."""
        entries = self.table("entries")
        return C.select_asked(entries, self.spark.createDataFrame([(a,) for a in asks], "ask string")) if asks else entries

    def extract(self, asks: list[str] | None = None, verify: bool = False) -> DataFrame:
        """(name, kind, mode, mtime_ns, link, content) of the asked entries, or of all.

        A file that does not come back in its full size is an error, with ``verify`` also a chunk of another hash.
        """
        entries = self.entries(asks)
        refs = entries.select("entry_id", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
        bodies = self._bodies(refs.select("chunk_id").distinct() if asks else None)
        if verify:
            bodies = bodies.withColumn("body", F.when(F.col("intact"), F.col("body")).otherwise(F.raise_error(F.lit("a chunk is broken"))))
        # A chunk that is lost leaves its file short.
        content = C.assemble(refs.join(bodies, "chunk_id"), "entry_id", "pos", "body").withColumnRenamed("body", "content")
        whole = entries.join(content, "entry_id", "left")
        is_file = F.col("kind").isin("file", "hardlink")
        content = F.when(is_file, F.coalesce("content", F.lit(b"")))
        short = F.raise_error(F.concat(F.lit("incomplete: "), "name")).cast("binary")
        content = F.when(is_file & (F.octet_length(content) != F.col("size")), short).otherwise(content)
        columns = ["name", "kind", "mode", "mtime_ns", "link", "content"]
        whole = whole.withColumn("content", content)

        def back(batches):
            import pyarrow as pa

            for b in batches:
                pairs = zip(b.column("file_xform").to_pylist(), b.column("content").to_pylist(), strict=True)
                turned = pa.array([transforms.apply(x, c, True) for x, c in pairs], pa.binary())
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns[:-1]], turned], names=columns)

        plain, turned = whole.where("file_xform = 0").select(*columns), whole.where("file_xform <> 0").select(*columns, "file_xform")
        return plain.unionByName(turned.mapInArrow(back, plain.schema))

    def unmatched(self, asks: list[str]) -> DataFrame:
        return C.unmatched(self.table("entries"), self.spark.createDataFrame([(a,) for a in asks], "ask string"))

    def verify(self) -> DataFrame:
        """(what, id) of everything that is wrong; no row means intact."""
        entries, chunks, blobs = (self.table(n) for n in ("entries", "chunks", "blobs"))
        refs = entries.select("entry_id", F.explode("chunk_ids").alias("chunk_id"))
        sums = refs.join(chunks.select("chunk_id", "n_bytes"), "chunk_id")
        files = entries.where(F.col("kind").isin("file", "hardlink")).select("entry_id", "size")
        wrong = [
            ("size", C.logical_mismatches(files, sums, "entry_id", "size", "n_bytes").select("entry_id")),
            ("chunk", C.dangling(refs, chunks, "chunk_id").select("chunk_id")),
            ("bound", C.out_of_bounds(chunks, 256 << 20).select("chunk_id")),
            ("group", C.dangling(chunks, blobs, "group_id", "stored").select("chunk_id")),
            ("content", self._bodies().where(~F.col("intact")).select("chunk_id")),
            ("count", self.table("archive").join(chunks.agg(F.count("*").alias("got")), F.col("got") != F.col("n_chunks")).select(F.col("got").cast("long"))),
            ("stream", self.table("archive").where(F.col("tree_hash") != C.tree_hash(chunks, "chunk_id", "hash")).select(F.lit(0).cast("long"))),
            ("name", entries.where(~S.safe_name(F.col("name"))).select("entry_id")),
        ]
        out = None
        for what, rows in wrong:
            named = rows.toDF("id").select(F.lit(what).alias("what"), "id")
            out = named if out is None else out.unionByName(named)
        return out


def unpack(spark: SparkSession, path: str, target: str, asks: list[str] | None = None, verify: bool = False, report=None) -> int:
    """Write entries below ``target``, a folder that every executor sees; returns how many.

    ``report`` is called with the rows and bytes that were read, counted in the same run.
    """
    from cairnstore.sources.restore import write_entries

    archive = Archive(spark, path)
    names = archive.entries(asks).select("name", "kind", "mode", "mtime_ns", "link")
    if bad := C.some_names(names.where(~S.safe_name(F.col("name"))), "name"):
        raise ValueError(f"unsafe names: {bad}")
    rows, seen = C.watched(archive.extract(asks, verify).withColumn("size", F.octet_length("content")), "size")
    with small_batches(spark, 16):
        written = write_entries(rows.drop("size"), target, names)
    if report:
        report(seen.get)
    return written
