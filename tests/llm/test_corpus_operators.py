"""Operators that compare documents, against brute force."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnstore.llm import bands, common, graph, linededup, neardup, suffixdedup, topk
from cairnstore.llm.queries import queries

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "same text here"), (5, "same text here"), (5, "same text here"), (None, "same text here"), (6, "q " * 3000), (7, "same  TEXT here")]


def odd_docs(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumn("row", F.lit(1)).withColumn("key", F.lit("x")).withColumn("gone_id", F.lit(3)).withColumn("bucket", F.lit(3))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- graph


@pytest.mark.parametrize("seed", range(1))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200)]
    got = graph.connected_components(spark.createDataFrame(links, "src long, dst long")).collect()
    links = [(a, b) for a, b in links if a != b]
    want = components({x for link in links for x in link}, links)
    assert {r["id"]: r["component"] for r in got} == want
    assert graph.connected_components(spark.createDataFrame([(None, 1)], "src long, dst long")).count() == 0


# ---- near duplicates


def brute_near(rows, words, percent):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = (t or "").translate(lower).encode().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    ids = sorted(sets)
    links = [
        (a, b)
        for n, a in enumerate(ids)
        for b in ids[n + 1 :]
        if sets[a] and sets[b] and 100 * (both := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - both)
    ]
    return {i: len(s) for i, s in sets.items()}, components(ids, links)


def test_near_duplicates_of_the_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    sizes, found = brute_near(rows, 3, 85)
    for r in queries()["op6_near_duplicates"](spark, DATA).collect():
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[i], found[i], found[i] == i)


def test_a_group_of_edited_copies(spark):
    """Copies too far from the smallest id and from each other, a late centre, and short texts."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    texts = []
    for k in range(160):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 7])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts.insert(140, " ".join(base))
    texts += [" ".join(rng.choices("abcd", k=rng.randint(1, 6))) for _ in range(60)]
    rows = list(enumerate(texts))
    sizes, found = brute_near(rows, 3, 85)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == found and {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert len(set(found.values())) > 20


def test_near_duplicates_of_odd_rows(spark):
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in neardup.near_duplicates(odd_docs(spark)).collect())
    assert got == [(0, 1, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 4, False)]
    kept = neardup.one_of_each(odd_docs(spark))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6] and kept.columns == odd_docs(spark).columns
    assert neardup.near_duplicates(odd_docs(spark).limit(0)).count() == 0


def test_rows_of_one_id(spark):
    """Rows of one doc_id are linked, whatever their texts."""
    a, b, c, d = ("alpha beta gamma delta", "one two three four", "red green blue white", "up down left right")
    rows = [(5, a), (7, a), (7, b), (9, b), (11, c), (11, d), (12, d), (13, c), (20, "alone and by itself"), (20, None)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, 7: 5, 9: 5, 11: 11, 12: 11, 13: 11, 20: 20}
    kept = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [5, 11, 11, 20, 20]


def test_sketches_estimate():
    rng = np.random.default_rng(1)
    both, one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (8000, 1000, 1000))
    a, b = (neardup.sketch(np.unique(np.concatenate([both, x]))) for x in (one, two))
    assert abs(neardup.estimate(a, b) - 0.8) < 0.1
    assert neardup.estimate(a, neardup.sketch(np.unique(rng.integers(0, 1 << 63, 9000, dtype=np.uint64)))) < 0.05


# ---- lines


def test_lines(spark):
    long = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew a very strange potion in an old tower by the sea, and nobody in the village ever asks them why they do it at night."
    edited = long.replace("village", "valley")
    docs = [(1, f"{long}\nunique one"), (2, f"first\n{edited}\n\n{long}"), (3, "first"), (4, None), (None, long), (5, ""), (6, "unique one more\n" + "z" * 5000), (7, "z" * 4990 + "yyyyyyyyyy")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("key", F.lit(1))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linededup.dedup_lines(rows).collect()}
    assert got[1] == (docs[0][1], 2, 0) and got[2] == ("first\n", 4, 2) and got[3] == ("", 1, 1)
    assert got[4] == (None, 0, 0) and got[None][2] == 0 and got[5] == ("", 1, 0) and got[6][2] == 0
    kept = linededup.without_repeated_lines(rows)
    assert kept.columns == rows.columns and {r["doc_id"]: r["n_chars"] for r in kept.collect()}.keys() == {1, 2, 4, None, 5, 6, 7}
    assert linededup.dedup_lines(odd_docs(spark)).count() == len(ODD)
    assert linededup.dedup_lines(odd_docs(spark).limit(0)).count() == 0


def test_equal_lines_of_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    lines = Counter(x for t in out.values() for x in t.split("\n") if x.strip())
    assert max(lines.values()) == 1
    before = {r["doc_id"]: r["text"].split("\n") for r in docs.collect()}
    assert all(set(t.split("\n")) <= {*before[i], ""} for i, t in out.items())
    assert sum(len(t) for t in out.values()) > 0.7 * sum(len("\n".join(x)) for x in before.values())


def brute_lines(rows, percent=80):
    """(doc_id, line_no) of the lines that go, from 5-character grams at every offset; lines of 5 characters or more."""
    lines = [(i, n, x) for i, t in sorted(rows) for n, x in enumerate(t.split("\n"))]
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} for _, _, x in lines]
    by_size = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    links = []
    for n, b in enumerate(by_size):
        for a in reversed(by_size[:n]):
            if not sets[a] or 100 * len(sets[a]) < percent * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    found = components(range(len(lines)), links)
    return {lines[k][:2] for k in found if found[k] != k}


def gone_lines(spark, rows):
    got = linededup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {(r["doc_id"], r["line_no"]) for r in got}


def test_lines_with_one_altered_character(spark):
    rng = random.Random(5)
    rows = []
    for k in range(240):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range((8, 12, 16, 20)[k % 4])]
        altered = list(words)
        at = rng.randrange(len(words))
        altered[at] = "#" + altered[at][1:]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(altered))]
    want = brute_lines(rows)
    assert len(want) > 200
    got = gone_lines(spark, rows)
    assert got <= want and len(got) >= 0.99 * len(want)


def lines_under_an_unlike_hub():
    """(rows, pairs): alike lines, of each pair of which all shared bands are under a typical line that is unlike both."""
    rng = random.Random(9)
    rows, pairs = [], []
    for k in range(40):
        passage, tail = ([["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(n)] for n in (14, 40)])
        altered = ["#" + w[1:] if i % 4 == 0 else w for i, w in enumerate(tail)]
        at = 10 * k
        rows += [(at + i, " ".join([*passage, str(i)])) for i in range(4)]
        rows += [(at + 4, " ".join(passage + tail)), (at + 5, " ".join(passage + altered))]
        pairs.append((at + 4, at + 5))
    return rows, pairs


@pytest.mark.parametrize("listed", [bands.LISTED, 2])
def test_lines_unlike_the_hub_of_their_band(spark, monkeypatch, listed):
    monkeypatch.setattr(bands, "LISTED", listed)
    rows, pairs = lines_under_an_unlike_hub()
    want = brute_lines(rows)
    assert {(b, 0) for _, b in pairs} <= want and not {(a, 0) for a, _ in pairs} & want
    banded = spark.createDataFrame(rows, "doc_id long, line string").select("doc_id", linededup._bands(F.col("line")).alias("bands"))
    bands_of = {r["doc_id"]: set(r["bands"]) for r in banded.collect()}
    met = {(b, 0) for a, b in pairs if bands_of[a] & bands_of[b]}
    got = gone_lines(spark, rows)
    assert len(met) >= 30 and met <= got <= want


def test_alike_lines_off_the_hub_are_not_paired(spark, monkeypatch):
    """80 alike lines under a typical line that is unlike them all: all but one go, with few pairs listed."""
    rng = random.Random(14)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage, tail = [word(10) for _ in range(14)], [word(10) for _ in range(40)]
    rows = [(i, " ".join([*passage, str(i)])) for i in range(40)]
    rows += [(100 + i, " ".join(passage + [f"#{w}" if j == i % 40 else w for j, w in enumerate(tail)] + [str(i)])) for i in range(80)]
    listed, listing = [], bands._listed

    def counted(members, percent):
        listed.append(listing(members, percent).count())
        return listing(members, percent)

    monkeypatch.setattr(bands, "_listed", counted)
    assert gone_lines(spark, rows) == brute_lines(rows) == {(i, 0) for i in (*range(1, 40), *range(101, 180))}
    assert sum(listed) <= 80


def test_lines_compared_in_parts(spark, monkeypatch):
    """Bands and pairs are dealt out in parts, each with no more rows than there are lines; the result is that of all pairs."""
    rows, pairs = lines_under_an_unlike_hub()
    whole = gone_lines(spark, rows)
    monkeypatch.setattr(bands, "PART_ROWS", 1)
    monkeypatch.setattr(linededup, "PART_LINES", len(rows) // 3)
    found, whole_part = [], bands.part

    def counted(members, column, k, parts):
        out = whole_part(members, column, k, parts)
        found.append((column, parts, out.count()))
        return out

    monkeypatch.setattr(bands, "part", counted)
    assert gone_lines(spark, rows) == whole
    assert any(column == "dst" and parts > 1 for column, parts, _ in found)
    assert len([1 for column, parts, _ in found if column == "band" and parts == 4]) >= 4
    assert sum(1 for column, parts, n in found if parts > 1 and n) > 5


def test_unbroken_lines(spark):
    """One character put in at any place of a long word; short lines with a few more characters; rulers."""
    rng = random.Random(8)
    rows = []
    for k in range(30):
        word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=200))
        at = (0, 100, 180)[k % 3]
        rows += [(2 * k, word), (2 * k + 1, f"{word[:at]}#{word[at:]}")]
    for k in range(30, 60):
        word = "".join(rng.choices("日本語のテキスト書類行文字長短前後", k=rng.randint(20, 70)))
        rows += [(2 * k, word), (2 * k + 1, word + "終わり")]
    rows += [(200, "=" * 9), (201, "=" * 70), (202, "=" * 900)]
    want = brute_lines(rows)
    assert len(want) == 62 and gone_lines(spark, rows) == want


def test_a_passage_in_many_lines(spark):
    """One passage in all lines, with other words of all lengths in front: what is far from the typical line too."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmno", k=rng.randint(3, 8)))
    passage = " ".join(word() for _ in range(40))
    rows = []
    for k in range(40):
        front = " ".join(word() for _ in range(rng.randint(1, 40)))
        rows.append((3 * k, f"{front} {passage}"))
        if k % 2:
            rows.append((3 * k + 1, f"{front} {word()} {passage}"))
    want = brute_lines(rows)
    got = gone_lines(spark, rows)
    assert len(want) >= 30 and got <= want and len(got) >= 0.95 * len(want)


def test_lines_of_the_tables_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()[:150]
    rows = [(r["doc_id"], r["text"]) for r in docs if len(r["text"] or "") < 20_000]
    lines = {x for _, t in rows for x in t.split("\n") if x.strip()}
    rows += [(10**6 + k, x[: len(x) // 2] + "#" + x[len(x) // 2 + 1 :]) for k, x in enumerate(sorted(lines)[::9])]
    seen, whole = set(), []
    for i, t in rows:  # every text of a line once: equal lines have a test of their own
        own = [x for x in t.split("\n") if x.strip() and not (x in seen or seen.add(x))]
        if own:
            whole.append((i, "\n".join(own)))
    want, got = brute_lines(whole), gone_lines(spark, whole)
    missed = [(i, n, dict(whole)[i].split("\n")[n]) for i, n in sorted(want - got)]
    assert not missed or len(missed) < 0.03 * len(want), missed
    assert len(want) > 50 and got <= want and len(got) >= 0.97 * len(want)


# ---- suffixes


@pytest.mark.parametrize("least", [5, 20, 64])
def test_suffix_intervals(least):
    rng = random.Random(least)
    base = [bytes(rng.choices(b"abc", k=120)) for _ in range(6)]
    pieces = [rng.choice(base)[rng.randrange(30) : rng.randrange(60, 120)] + bytes(rng.choices(b"abc", k=9)) for _ in range(40)] + [b"a" * 90, b"ab" * 50, b"q"]
    count = Counter(p[i : i + least] for p in pieces for i in range(len(p) - least + 1))
    want = [i <= len(p) - least and count[p[i : i + least]] > 1 for p in pieces for i in range(len(p) + 1)]
    assert suffixdedup.repeated_starts(pieces, least).tolist() == want


def brute_removed(texts, least=200):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + least] for r in raws for i in range(len(r) - least + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - least + 1):
            if count[r[i : i + least]] > 1:
                gone[i : i + least] = True
        gone = gone[:-1]
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [suffixdedup.CROWD, 3])
def test_removed_bytes(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixdedup, "CROWD", crowd)
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(suffixdedup, "STRIDE", 700)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abcdé fgh", k=n))
    passage, other = word(400), word(260)
    texts = [word(300) + passage[rng.randrange(150) : rng.randrange(360, 400)] + word(rng.randrange(300)) for _ in range(12)]
    texts += [other + word(50), word(20) + other, other * 3, None, "", "short", "x" * 500, "ab" * 300, texts[0], word(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("first", F.lit(1))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.digests(suffixdedup.remove_repeats(docs)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts)


def test_removed_bytes_of_odd_rows(spark):
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffixdedup.remove_repeats(odd_docs(spark)).collect())
    assert (6, 6000, 6000) in got and (1, 0, 0) in got and (5, 14, 0) in got and len(got) == len(ODD)
    assert suffixdedup.remove_repeats(odd_docs(spark).limit(0)).count() == 0


# ---- search


def brute_top(rows, k):
    out = []
    for q, x in rows:
        if q is None or q % 50 or x is None:
            continue
        scored = sorted((-int(np.dot(x, y)), i) for i, y in rows if i is not None and i != q and y is not None and len(y) == len(x))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [topk.ROW_BLOCK, 70])
def test_top_rows(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "ROW_BLOCK", block)
    rng = np.random.default_rng(2)
    vectors = [(i, [float(v) for v in rng.normal(size=6).astype(np.float32)]) for i in range(230)]
    vectors += [(300, [1.0] * 6), (301, [1.0] * 6), (302, [1.0] * 6), (350, None), (400, []), (450, [float("nan")] * 6), (500, [None] * 6), (None, [1.0] * 6), (550, [1.0, 2.0]), (551, [float("inf")] * 6), (552, [-3.0, 0.5]), (600, [0.0] * 6)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("width", F.lit("x"))
    ok = [(i, None if v is None or not v or any(x is None or not np.isfinite(x) for x in v) else np.floor(256 * np.array(v)).astype(int)) for i, v in vectors]
    got = topk.search(table, F.col("vec_id") % 50 == 0, 5)
    assert sorted(map(tuple, got.collect())) == brute_top(ok, 5)
    assert topk.search(table.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    if block == 70:
        with pytest.raises(Exception, match="too large"):
            topk.quantise(spark.createDataFrame([(1, [1e30, 1.0])], "vec_id long, embedding array<double>")).collect()


# ---- shared parts


def test_bounded_lookups(spark, monkeypatch):
    monkeypatch.setattr(common, "BITS", 4)
    rows = spark.createDataFrame([(i if i % 7 else None,) for i in range(50)], "a long")
    keys = spark.createDataFrame([(3,), (3,), (9,)], "a long")
    assert sorted(r["a"] for r in common.among(rows, "a", keys).collect()) == [3, 9]
    assert common.without(rows, "a", keys).count() == 48
    assert bands.connected_components is graph.connected_components


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA).collect()
    ids = [r["doc_id"] for r in out]
    assert len(set(ids)) == len(ids) > 100 and all(len(r["piece_ids"]) == 4 * r["n_tokens"] for r in out)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
        kept = stage(spark, docs, DATA)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count(), name


def test_line_stage_under_an_unlike_hub(spark):
    """A document whose one line is like that of another goes, also if both are unlike the hub of their bands."""
    import corpus_pipeline

    rows, pairs = lines_under_an_unlike_hub()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.dedup_lines(spark, docs, DATA).collect()}
    assert {a for a, _ in pairs} <= kept and sum(b not in kept for _, b in pairs) >= 30


def test_line_stage_on_alike_lines_of_unlike_words(spark):
    """A few words repeated over and over, and once with so many altered that most distinct words are of one line only."""
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for k in range(20):
        base = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(9)]
        words = rng.choices(base, k=240)
        altered = [f"{w[:3]}{i // 20}{w[4:]}" if i % 20 == 9 else w for i, w in enumerate(words)]
        both = len(set(words) & set(altered))
        assert 100 * both < 45 * len(set(words) | set(altered))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(altered))]
    want = {i for i, _ in brute_lines(rows)}
    assert len(want) == 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.dedup_lines(spark, docs, DATA).collect()}
    assert {i for i, _ in rows} - kept == want


def test_stages_on_odd_rows(spark):
    """Null, empty, very long and repeated rows, clashing columns, and no rows at all."""
    import corpus_pipeline

    line = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew a strange potion."
    passage = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first()["text"]
    texts = [(1, None), (2, ""), (3, line), (3, line), (4, line), (None, "no id at all"), (5, "word " * 30_000), (6, f"{line[::-1]} {passage} {line[::-1]}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("score", F.lit("x")).withColumn("__n_removed", F.lit(1)).withColumn("__word", F.lit("w"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        rows = out.collect()
        kept[name] = sorted(r["doc_id"] or 0 for r in rows)
        assert name == "encode" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert set(kept["quality"]) <= {0, 1, 2, 3, 4, 5, 6}
    assert kept["line_dedup"] == [0, 1, 2, 3, 3, 5, 6]  # rows of one id and text are one place
    assert kept["near_dedup"] == [0, 1, 2, 3, 3, 5, 6]
    assert kept["decontaminate"] == [0, 1, 2, 3, 3, 4, 5]
    assert kept["encode"] == [0, 1, 2, 3, 3, 4, 5, 6]


@pytest.mark.parametrize("name, column", [("quality", "counts"), ("near_dedup", "hashes")])
def test_stages_discard_their_tables(spark, name, column):
    """The sample of the quality stage and the sets of near-duplicates are not left in the shared folder."""
    import corpus_pipeline

    folder = Path(common.shared_folder(spark).removeprefix("file:"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {p.name for p in folder.iterdir()}
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, DATA)
    left = [p for p in folder.iterdir() if p.name not in before and any(p.glob("part-*"))]
    assert not any(column in spark.read.parquet(str(p)).columns for p in left)
    assert out.count() > 0
