"""The archive store, file trees and selection, against plain Python."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cairnstore.functions import scalars as S
from cairnstore.operators import catalog as C
from cairnstore.plans import store
from cairnstore.sources import fs_tree, restore


def entries_of(spark, contents):
    rows = [(i, name, bytearray(data)) for i, (name, data) in enumerate(contents.items())]
    return spark.createDataFrame(rows, "entry_id long, name string, content binary")


@pytest.fixture(scope="module")
def contents():
    rng = random.Random(4)
    shared = rng.randbytes(40_000)
    out = {f"d{i % 3}/f{i}.txt": ("line %d\n" % i * (i * 40)).encode() for i in range(12)}
    return out | {"a/one.bin": shared + b"x" * 900, "a/two.bin": shared + b"y" * 900, "empty": b"", "a.bin": shared}


@pytest.mark.parametrize("mode", ["fast", "max"])
def test_round_trip(spark, contents, tmp_path, mode):
    path = str(tmp_path / "archive")
    store.pack(entries_of(spark, contents), path, mode, 256, 4096, 10)
    archive = store.Archive(spark, path)
    assert {r["name"]: bytes(r["content"]) for r in archive.extract(verify=True).collect()} == contents
    assert archive.verify().count() == 0
    chunks = archive.table("chunks")
    total = sum(map(len, contents.values()))
    assert chunks.agg(F.sum("n_bytes")).first()[0] < total - 70_000  # the shared bytes are kept once
    assert [r["name"] for r in archive.list().collect()] == sorted(contents)
    info = archive.info().first()
    assert (info["n_entries"], info["total_bytes"]) == (len(contents), total)
    some = archive.extract(["a/", "f3.txt", "nothing"]).collect()
    assert {r["name"] for r in some} == {"a/one.bin", "a/two.bin", "d0/f3.txt"}
    assert [r["ask"] for r in archive.unmatched(["a/", "nothing"]).collect()] == ["nothing"]


def test_verify_finds_damage(spark, contents, tmp_path):
    path = str(tmp_path / "archive")
    version = store.pack(entries_of(spark, contents), path, "fast", 256, 4096, 10)
    blobs = spark.read.parquet(f"{version}/blobs").withColumn("payload", F.concat(F.substring("payload", 1, 30), F.lit(b"??")))
    blobs.write.parquet(f"{version}/new")
    import shutil

    shutil.rmtree(f"{version}/blobs")
    os.rename(f"{version}/new", f"{version}/blobs")
    assert store.Archive(spark, path).verify().where("what = 'content'").count() > 0


def move_blobs_aside(spark, version, keep):
    import shutil

    spark.read.parquet(f"{version}/blobs").where(keep).write.parquet(f"{version}/new")
    shutil.rmtree(f"{version}/blobs")
    os.rename(f"{version}/new", f"{version}/blobs")


def test_lost_blobs_are_noticed(spark, contents, tmp_path):
    """Each blob in turn: verify names its chunks, extraction fails, with or without verification."""
    rng = random.Random(9)
    mixed = contents | {f"r{k}": rng.randbytes(20_000) for k in range(6)}
    first = store.pack(entries_of(spark, mixed), str(tmp_path / "first"), "max", 8192, 16_384, 13)
    groups = [(r["group_id"], r["stored"]) for r in spark.read.parquet(f"{first}/blobs").collect()]
    assert len({s for _, s in groups}) == 2
    for n, (group, stored) in enumerate(groups[:4]):
        path = str(tmp_path / f"a{n}")
        version = store.pack(entries_of(spark, mixed), path, "max", 8192, 16_384, 13)
        move_blobs_aside(spark, version, (F.col("group_id") != group) | (F.col("stored") != stored))
        archive = store.Archive(spark, path)
        wrong = {r["what"] for r in archive.verify().collect()}
        assert {"group", "content"} <= wrong
        for verify in (False, True):
            with pytest.raises(Exception, match="incomplete|broken"):
                archive.extract(verify=verify).collect()


def test_wide_rows_keep_their_numbers(spark):
    """Numbers come from the run of the sort that is counted, at any width and under adaptive execution."""
    rows = spark.range(30_000).select(F.col("id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 24).alias("payload"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"))
    got = C.dense_ids(rows, ["k", "id"], "n").select("id", "k", "n").toPandas().sort_values("n")
    assert got["n"].tolist() == list(range(30_000))
    assert got.equals(got.sort_values(["k", "id"]))


def test_running_totals(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1, 5, 7])) for i in range(3000)]
    rows = spark.createDataFrame(data, "k string, i int, v long").repartition(7)
    want, total = {}, {}
    for k, i, v in data:
        total[k] = total.get(k, 0) + (v or 0)
        want[i] = total[k]
    assert {r["i"]: r["t"] for r in C.running_totals(rows, ["k"], "i", "v", "t").collect()} == want


def test_many_chunks(spark, tmp_path):
    rng = random.Random(3)
    contents = {f"f{k}": rng.randbytes(150_000) for k in range(8)}
    path = str(tmp_path / "archive")
    store.pack(entries_of(spark, contents), path, "fast", 16, 64, 4)
    archive = store.Archive(spark, path)
    assert archive.table("chunks").count() > 25_000
    assert {r["name"]: bytes(r["content"]) for r in archive.extract(verify=True).collect()} == contents
    assert archive.verify().count() == 0


def test_failed_packs_leave_nothing(spark, contents, tmp_path):
    path = str(tmp_path / "archive")
    store.pack(entries_of(spark, {"x": b"1"}), path, "fast")
    broken = entries_of(spark, contents).withColumn("content", F.when(F.col("name") == "empty", F.raise_error(F.lit("no")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        store.pack(broken, path, "fast")
    assert sum(n.startswith("v-") for n in os.listdir(path)) == 1
    assert [r["name"] for r in store.Archive(spark, path).list().collect()] == ["x"]


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_round_trip(spark, tmp_path, seed):
    rng = random.Random(seed)
    top = tmp_path / "top"
    top.mkdir()
    folders = [top]
    for k in range(6):
        folders.append(rng.choice(folders) / f"d{k} é")
        folders[-1].mkdir()
    files = []
    for k in range(20):
        files.append(rng.choice(folders) / f"f{k}.bin")
        files[-1].write_bytes(rng.randbytes(rng.choice([0, 10, 3000])) * rng.choice([1, 9]))
        os.chmod(files[-1], rng.choice([0o600, 0o644, 0o755]))
        os.utime(files[-1], ns=(10**18 + k, 10**18 + k * 7))
    os.link(files[0], top / "zz-hard")
    os.symlink("nowhere", top / "zz-soft")
    out = tmp_path / "out"
    store.pack(fs_tree.tree_entries(spark, [str(top)]), str(tmp_path / "archive"), "fast", 256, 4096, 10)
    n = store.unpack(spark, str(tmp_path / "archive"), str(out), verify=True)
    assert n == 1 + 6 + 20 + 2
    for f in files:
        new = out / f.relative_to(tmp_path)
        assert new.read_bytes() == f.read_bytes()
        assert (new.stat().st_mode, new.stat().st_mtime_ns) == (f.stat().st_mode, f.stat().st_mtime_ns)
    assert os.readlink(out / "top/zz-soft") == "nowhere"
    assert (out / "top/zz-hard").read_bytes() == files[0].read_bytes()
    assert (out / "top/zz-hard").stat().st_ino == (out / files[0].relative_to(tmp_path)).stat().st_ino
    assert store.Archive(spark, str(tmp_path / "archive")).verify().count() == 0


def bmp(width, height, rng):
    """An uncompressed 24-bit bitmap of a soft gradient."""
    import struct

    used = (width * 3 + 3) // 4 * 4
    rows = b"".join(bytes((x * 2 + y + c * 9 + rng.randrange(3)) % 256 for x in range(width) for c in range(3)).ljust(used, b"\0") for y in range(height))
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 0, 54, 40, width, height, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def test_rasters_are_turned_by_rows(spark, tmp_path):
    rng = random.Random(6)
    contents = {"a.bmp": bmp(67, 41, rng), "b.bmp": bmp(30, 90, rng), "c.txt": b"no raster"}
    path = str(tmp_path / "archive")
    store.pack(entries_of(spark, contents), path, "best", 256, 4096, 10)
    archive = store.Archive(spark, path)
    assert {r["name"]: r["file_xform"] > 0 for r in archive.table("entries").collect()} == {"a.bmp": True, "b.bmp": True, "c.txt": False}
    assert archive.info().first()["version"] == 12
    assert {r["name"]: bytes(r["content"]) for r in archive.extract(verify=True).collect()} == contents


def test_dictionaries(spark, tmp_path):
    rng = random.Random(7)
    phrases = ["".join(rng.choices("abcdefgh ", k=60)) for _ in range(400)]
    contents = {f"f{k}": " ".join(rng.choices(phrases, k=12)).encode() for k in range(300)}
    path = str(tmp_path / "archive")
    store.pack(entries_of(spark, contents), path, "best", 256, 4096, 10)
    archive = store.Archive(spark, path)
    assert {r["name"]: bytes(r["content"]) for r in archive.extract(verify=True).collect()} == contents
    from cairnstore.functions import codecs

    samples = [v for v in contents.values()]
    dictionary = codecs.train_dictionary(samples)
    assert dictionary and codecs.pays(dictionary, [s + b"!" for s in samples], "best") and not codecs.pays(dictionary, samples[:2], "best")
    frame = codecs.compress(samples[0], "best", dictionary)
    assert frame.codec == "zstd+dict" and codecs.decompress(frame, len(samples[0]), dictionary) == samples[0]


def test_tree_hash(spark):
    rows = spark.createDataFrame([(i, f"{i:04x}") for i in range(50)], "n long, d string").repartition(5)
    whole = C.tree_hash(rows, "n", "d", 8)
    assert whole == C.tree_hash(rows.orderBy(F.rand(3)), "n", "d", 8)
    assert whole != C.tree_hash(rows.withColumn("d", F.when(F.col("n") == 17, "x").otherwise(F.col("d"))), "n", "d", 8)
    assert len(C.tree_hash(rows.limit(0), "n", "d")) == 64
    assert C.some_names(rows.withColumn("d", F.col("d")), "d") == "0000, 0001, 0002 and 50 in all"


def test_groups_and_sizes(spark):
    rows = spark.createDataFrame([("a", 1, b"xy", 2), ("a", 2, b"x", 2), (None, 3, b"", 0), (None, 4, b"z", 1)], "k string, i int, c binary, n long")
    got = {r["i"]: (r["size"], r["first"]) for r in C.with_groups(rows.select("k", "i"), "k", "i").withColumnRenamed("n", "size").collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 3), 4: (2, 3)}
    assert [(r["i"], r["actual"]) for r in C.changed_sizes(rows, "n", "c").collect()] == [(2, 1)]
    seen_rows, seen = C.watched(rows, "n")
    assert seen_rows.count() == 4 and seen.get == {"rows": 4, "bytes": 5}


def test_links_without_a_target_keep_their_own(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "gone", 2), ("c", None, 3)], "name string, link string, n long")
    targets = spark.createDataFrame([("x", 9)], "name string, n long")
    assert {r["name"]: r["n"] for r in C.resolve_links(rows, targets, "link", "name", ["n"]).collect()} == {"a": 9, "b": 2, "c": 3}


@pytest.mark.parametrize("codec,size,gate,entropy,raw", [("zstd", 0, 0, 0, True), ("zstd", 9, 20, 8.0, False), ("cm", 9, 5, 7.99, True), ("lzma2", 9, 5, 7.99, False), ("lzma2", 9, 9, 7.99, True), ("lzma2", 9, 9, 7.0, False)])
def test_what_is_stored_raw(codec, size, gate, entropy, raw):
    from cairnstore.functions import codecs

    assert codecs.store_raw(codec, size, gate, entropy) is raw


def test_command_line(spark, tmp_path, capsys):
    from cairnstore.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello")
    archive, out = str(tmp_path / "archive"), tmp_path / "out"
    assert main(["pack", archive, str(tmp_path / "in"), "--mode", "fast"]) == 0
    assert main(["list", archive]) == 0 and main(["info", archive]) == 0 and main(["verify", archive]) == 0
    assert "in/a.txt" in capsys.readouterr().out
    assert main(["unpack", archive, "a.txt", "--to", str(out)]) == 0 and (out / "in/a.txt").read_text() == "hello"
    assert main(["unpack", archive, "nothing", "--to", str(out)]) == 1


def test_files_that_cannot_be_read(spark, tmp_path):
    rows = spark.createDataFrame([(str(tmp_path / "gone"),), (str(tmp_path),)], "full string")
    got = fs_tree.with_content(rows).collect()
    assert all(r["content"] is None and r["error"] for r in got) and len(got) == 2


def test_publishing_keeps_the_last(spark, contents, tmp_path):
    path = str(tmp_path / "archive")
    store.pack(entries_of(spark, contents), path, "fast")
    with pytest.raises(ValueError):
        store.pack(entries_of(spark, contents), path, "unknown")
    store.pack(entries_of(spark, {"x": b"1"}), path, "fast")
    assert [r["name"] for r in store.Archive(spark, path).list().collect()] == ["x"]


def test_file_tree(spark, tmp_path):
    top = tmp_path / "top"
    (top / "sub/empty").mkdir(parents=True)
    (top / ".hidden").write_text("h")
    (top / "sub/a.txt").write_text("abc")
    (top / "sub/b.tmp").write_text("no")
    (top / "skip").mkdir()
    (top / "skip/in").write_text("no")
    os.symlink("sub/a.txt", top / "link")
    os.link(top / "sub/a.txt", top / "hard")
    fs_tree.register(spark)
    read = spark.read.format("fs_tree").option("paths", f"{top}\n{top}/").option("exclude", "*.tmp\nskip").load()
    rows = {r["rel"]: r for r in read.collect()}
    assert set(rows) == {"top", "top/.hidden", "top/sub", "top/sub/empty", "top/sub/a.txt", "top/link", "top/hard"}
    assert rows["top/link"]["kind"] == "symlink" and rows["top/link"]["link"] == "sub/a.txt"
    assert rows["top/hard"]["ino"] == rows["top/sub/a.txt"]["ino"] and rows["top/sub/a.txt"]["size"] == 3
    linked = C.hard_links(read.where("kind = 'file'"), ["dev", "ino"], "rel", "rel").collect()
    assert {r["rel"]: r["link"] for r in linked}["top/sub/a.txt"] == "top/hard"


def test_unpack_is_safe(spark, tmp_path):
    target = tmp_path / "out"
    target.mkdir()
    outside = tmp_path / "outside"
    outside.mkdir()
    os.symlink(outside, target / "d")
    path = str(tmp_path / "archive")
    store.pack(entries_of(spark, {"d/f": b"in", "g": b"2"}), path, "fast")
    assert store.unpack(spark, path, str(target)) == 2
    assert (target / "d/f").read_bytes() == b"in" and not list(outside.iterdir())
    store.pack(entries_of(spark, {"../up": b"1"}), path, "fast")
    with pytest.raises(ValueError):
        store.unpack(spark, path, str(target))
    with pytest.raises(ValueError):
        restore.inside(str(target), "../x")


def test_asks_against_plain_python(spark):
    rng = random.Random(8)
    pool = ["a", "b", "c.txt", "d"]
    names = sorted({"/".join(rng.choices(pool, k=rng.randint(1, 4))) for _ in range(60)})
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    for ask in ["a", "a/b", "c.txt", "./d/", "/a", "b/c.txt/d", "x"]:
        norm = ask.removeprefix("./").removeprefix("/").rstrip("/")
        want = {n for n in names if n == norm or n.split("/")[-1] == norm or n.startswith(norm + "/")}
        asks = spark.createDataFrame([(ask,)], "ask string")
        assert {r["name"] for r in C.select_asked(rows, asks).collect()} == want
        assert C.unmatched(rows, asks).count() == (0 if want else 1)


@pytest.mark.parametrize(
    "glob,path,hit",
    [("*.o", "a/b.o", True), ("a*", "x/abc/y", True), ("b?d", "bcd", True), ("[a-c]x", "bx", True), ("[^a]x", "ax", False), ("[", "[", False), ("a\\*", "a*", True), ("a\\*", "ab", False), ("x/*", "x/y/z", True), ("*", "", True)],
)
def test_globs(spark, glob, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(S.excluded(F.col("p"), [glob])).first()[0] is hit


def test_sizes_and_modes(spark):
    rows = spark.createDataFrame([(0,), (1023,), (1024,), (1280,), (1 << 20,), (1 << 62,)], "n long")
    assert [r[0] for r in rows.select(S.human_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.0 MB", "4096.0 PB"]
    one = spark.createDataFrame([(0o754, "dir")], "m int, k string")
    assert one.select(S.mode_string(F.col("m"), F.col("k"))).first()[0] == "drwxr-xr--"


@pytest.mark.parametrize("paths,root", [(["/x/a", "/x/b"], "/x"), (["/a", "/b"], "/"), (["a/b/c", "a/b/d"], "a/b"), (["a", "b"], "."), (["/p/q/"], "/p"), (["/ab/c", "/abc/d"], "/")])
def test_common_root(spark, paths, root):
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert C.common_root(rows, "path").first()[0] == root


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "entry_id long, name string, kind string, size long, content binary")
    assert C.dedup_report(rows, F.col("kind")).count() == 0
    assert C.dense_ids(rows, ["name"], "n").count() == 0
    assert C.listing_totals(rows).first()["n_files"] == 0


def test_stream_keeps_first_arrivals(spark, tmp_path):
    from cairnstore.streaming import arrivals

    src = tmp_path / "in"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, t string").selectExpr("id", "timestamp'2024-01-01 00:00:00' AS ts", "cast(t AS binary) AS content").write.parquet(str(src))
    stream = spark.readStream.schema("id long, ts timestamp, content binary").parquet(str(src))
    q = arrivals.first_arrivals(stream, "ts").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 2
