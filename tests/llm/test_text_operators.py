"""Operators that read each document by itself, against brute force on whole small tables."""

import ctypes
import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnstore import lineage
from cairnstore.llm import decontaminate, htmltext, licences, quality, sentencepieces, toxicity
from cairnstore.llm.queries import piece_model, queries

DATA = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (5, "word"), (None, "no id"), (6, "long " * 5000),
    (7, "ÄÖ ▁x  two   spaces 　 \x00 end "), (8, "a" * 3000), (11, "   "), (9, "日本語のテキスト"), (10, "\n\n"),
]


def odd_docs(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumn("score", F.lit("clash")).withColumn("label", F.lit(1)).withColumn("bucket", F.lit("x"))


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# ---- encoding


@pytest.mark.parametrize("common", [sentencepieces.COMMON_ROWS, 40])
def test_pieces_equal_the_library(spark, monkeypatch, common):
    """Also with a broadcast table that holds few chunks, so that most are segmented where they stand."""
    import sentencepiece

    monkeypatch.setattr(sentencepieces, "COMMON_ROWS", common)
    monkeypatch.setattr(sentencepieces, "COUNTED", 1000)
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    docs = documents(spark).select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text"))
    texts = sorted((t or "" for _, t in (tuple(r) for r in docs.collect())))
    want = sorted((len(i := sp.encode(t, add_bos=True, add_eos=True)), np.array(i, "<u4").tobytes(), sp.decode(i)) for t in texts)
    got = sentencepieces.encode_decode(docs, piece_model()).collect()
    assert sorted((r["n_tokens"], bytes(r["piece_ids"]), r["decoded"]) for r in got) == want


def test_the_table_has_the_frequent_chunks(spark, monkeypatch):
    monkeypatch.setattr(sentencepieces, "COMMON_ROWS", 3)
    docs = spark.createDataFrame([(1, "a b b b c c c c d d d d d e f"), (2, None)], "doc_id long, text string")
    table = sentencepieces.chunk_table(docs.coalesce(1), piece_model()).collect()
    assert sorted(r["chunk"] for r in table) == ["▁b", "▁c", "▁d"]


def test_piece_digests(spark):
    got = {r["doc_id"]: r for r in sentencepieces.digests(sentencepieces.encode_decode(odd_docs(spark), piece_model())).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 2
    assert got[1]["ids_sha256"] == hashlib.sha256(np.array([1, 2], "<u4").tobytes()).hexdigest()
    assert sentencepieces.encode_decode(empty_docs(spark), piece_model()).count() == 0


def test_other_models_are_refused():
    class Crossing:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    with pytest.raises(ValueError):
        sentencepieces.check_chunkable(Crossing())


# ---- decontamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def windows_of(items, n=13):
    out: dict = {}
    for item, t in items:
        w = WORDS.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - n + 1)) if w and item is not None else ():
            out.setdefault(tuple(w[k : k + n]), set()).add(item)
    return out


def brute_hits(text, windows):
    words = WORDS.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for size in {len(w) for w in windows}:
        for at in range(len(words) - size + 1):
            if items := windows.get(tuple(words[at : at + size])):
                hit.update(range(at, at + size))
                found |= items
    return len(words), len(hit), sorted(map(str, found))


def test_hits_equal_brute_force(spark):
    items = [(1, "One two. THREE"), (2, " ".join(f"w{i}" for i in range(20))), (None, "four"), (3, None), (4, "—"), (5, "x " * 13), (5, "Été déjà")]
    texts = ["zero ONE, two three! one two three", "a w3 w4 " + " ".join(f"w{i}" for i in range(5, 18)), None, "", "x " * 40, "été déjà vu", "ÉTÉ DÉJÀ", "one two", "four —"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("items", F.lit(0))
    rows = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.scan_documents(docs, rows).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == brute_hits(t, windows_of(items))
    first = got[0]["spans"]
    assert [texts[0][s["start"] : s["end"]] for s in first] == ["ONE, two three! one two three"]


def test_contamination_on_the_tables(spark):
    windows = windows_of([tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    some = 0
    for r in queries()["op2_decontaminate"](spark, DATA).collect():
        n, h, found = brute_hits(texts[r["doc_id"]], windows)
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, h, len(found), digest)
        assert r["contaminated"] == (h > 0 and 20 * h >= n)
        some += r["contaminated"]
    assert some > 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(odd_docs(spark), empty).where("contaminated").count() == 0
    assert decontaminate.clean_rows(odd_docs(spark), empty).count() == len(ODD)
    assert decontaminate.decontaminate(empty_docs(spark), empty).count() == 0


def test_a_passage_in_a_long_text(spark):
    """Few hit words among many: `contaminated` goes by their share, `clean_rows` by any hit."""
    passage = " ".join(f"w{i}" for i in range(20))
    long = " ".join(f"x{i}" for i in range(2000))
    docs = spark.createDataFrame([(1, f"{long} {passage} {long}"), (2, long), (3, None), (3, passage)], "doc_id long, text string").withColumn("items", F.lit("x"))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert not decontaminate.decontaminate(docs, items).where("doc_id = 1").first()["contaminated"]
    kept = decontaminate.clean_rows(docs, items)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"]) == [(2, long)] and kept.count() == 2
    with pytest.raises(ValueError):
        decontaminate.benchmark_items(items, limit=10)


# ---- classifiers


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers_on_odd_rows(spark, operator):
    labels = labels_of(spark, [(2, 0, 0), (4, 1, 1), (4, 1, 1), (6, None, None), (None, 1, 1), (7, 0, 0), (99, 1, 1), (8, 1, 0), (9, 0, 1)])
    rows = operator.classify(odd_docs(spark), labels).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    nothing = operator.classify(odd_docs(spark), labels_of(spark, [])).collect()
    assert {r["score"] for r in nothing} == ({0.5} if operator is quality else {0.0})
    assert operator.classify(empty_docs(spark), labels_of(spark, [])).count() == 0


@pytest.mark.parametrize("name,label,least", [("op3_quality", "quality", 0.93), ("op4_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    data = DATA.replace("0.001", "0.01")
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in queries()[name](spark, data).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in rows) >= least * len(rows) > 50


@pytest.mark.parametrize("operator,label", [(quality, "quality"), (toxicity, "toxic")])
def test_labels_of_the_held_out_third_do_not_matter(spark, operator, label):
    docs, labels = documents(spark), spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col(label)).otherwise(F.col(label)))
    one, two = (sorted(map(tuple, operator.classify(docs, x).collect())) for x in (labels, turned))
    assert one == two


@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocks_have_no_seams(block):
    texts = ["", "a", "some words of text, and a-very-long-word" * 5 + "x" * 200 + " end \u3000 ü", " ".join(f"word{i}" for i in range(99))]
    for t in texts:
        whole = np.sort(quality.bucket_ids(t))
        parts = list(quality.bucket_blocks(t, block))
        assert np.array_equal(whole, np.sort(np.concatenate(parts) if parts else whole))
        ids, counts = quality.bucket_counts(t)
        assert np.array_equal(np.repeat(ids, counts), whole)


def test_very_long_texts(spark):
    """Over 2 Mi code points: read whole, without seams or caps."""
    t = "some plain words of a long text, " * 70_000
    assert abs(quality.score_text(t, np.arange(quality.BUCKETS, dtype=np.float32) / quality.BUCKETS, 0.0) - quality.score_text(t[: 33 * 3000], np.arange(quality.BUCKETS, dtype=np.float32) / quality.BUCKETS, 0.0)) < 1e-4
    ids, counts = quality.bucket_counts(t)
    assert counts.sum() == len(quality.bucket_ids(t)) > 7_000_000
    rows = spark.createDataFrame([(1, t + "w1 w2 w3"), (2, "<p>" + t)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    assert [r["n_hit"] for r in decontaminate.scan_documents(rows, items).orderBy("doc_id").collect()] == [3, 0]
    assert len(htmltext.main_text("<article><p>" + t)) == len(t) - 1


def good_docs(spark):
    good, bad = "plain and honest prose about the sea and the town ", "$$ %% ## @@ !! ~~ "
    rows = [(i, good * 3, "en") for i in range(40)] + [(100 + i, bad * 8, "en") for i in range(40)] + [(500, None, None), (501, "", "x"), (502, good, "x"), (502, good, "x"), (None, bad * 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, labels_of(spark, [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)])


def test_good_rows(spark):
    docs, labels = good_docs(spark)
    kept = quality.good_rows(docs, labels)
    scored = {(r["doc_id"], r["predicted"]) for r in quality.classify(docs, labels).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(502) == 2 and set(range(40)) <= set(ids) and not set(ids) & {None, *range(100, 140)}
    assert {(i, 1) for i in ids} <= scored
    assert quality.good_rows(docs.limit(0), labels).count() == 0


def test_driver_gives_its_memory_back(spark):
    """What the driver held of the sample does not stay with it for the stages that run after."""

    def held_mb():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    def text(i):
        rng = np.random.default_rng(i)
        return bytes(rng.integers(97, 123, 6_000, dtype=np.uint8)).decode()

    docs = spark.createDataFrame([(i, text(i)) for i in range(2_000)], "doc_id long, text string").repartition(4)
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(2_000)])
    quality.good_rows(docs.limit(50), labels)
    ctypes.CDLL(None).malloc_trim(0)
    before = held_mb()
    quality.good_rows(docs, labels)
    assert held_mb() - before < 40
    assert "rim native heap" in lineage.give_back(spark)


def test_disguises_are_restored():
    words = "the idiot is a stupid moron and a loser in trash you are such a thing ".split() * 50 + "other plain words of text".split() * 80
    text = " ".join(words)
    counts = np.ones(28**3)
    codes = [toxicity.EDGE if c == " " else toxicity.code_of(c) for c in text]
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        counts[(a * 28 + b) * 28 + c] += 1
    table = counts.reshape(784, 28)
    model = np.log(table / table.sum(1, keepdims=True)).ravel().tolist()
    readings = toxicity.restorer(model)
    for written, word in [("1d10t", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("l.o.s.e.r", "loser"), ("stuuuupid", "stupid"), ("tr@sh", "trash"), ("idiot!!!", "idiot"), ("(stupid),", "stupid")]:
        assert word in readings(written), (written, readings(written))
    for written, found in [("ѕtuріd", {"stupid"}), ("you,idiot", {"you", "idiot"}), ("|_|nd3r", set()), ("1d10t" * 100, {"idiot" * 100})]:
        assert found <= set(readings(written)), (written, readings(written))
    assert "loser" in toxicity.words_of("you l o s e r there", readings)
    assert {"a", "stupid"} <= toxicity.words_of("such a s t u p i d thing", readings)
    assert readings("1d10t" * 30_000)[-1] == "idiot" * 30_000
    assert toxicity.words_of(None, readings) == set() == toxicity.words_of(" ", readings)


# ---- pages


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("<p>", ""), ("<article><p>a &amp; b\n\t c<br>d</p><p>e</article>", "a & b c d\ne"),
        ("<article><p>one<p>two <b>bold</b> <a href='x'>link</a>", "one\ntwo bold link"),
        ("<nav><a href=1>m</a></nav><article><p>x</p><aside>s</aside><div class='comments'><p>c</p></div><p>y</p></article><footer>f</footer>", "x\ny"),
        ("<article><script>var a='<p>no</p>'</script><p>yes &lt;tag&gt; &#233;&eacute;</p><!-- <p>no</p> --></article>", "yes <tag> éé"),
        ('<article><p title="a > b">quoted</p></article>', "quoted"), ("<article><p>3 < 4 and 5 > 2</p></article>", "3 < 4 and 5 > 2"),
        ("<article><p>a</p><math>x</math><svg><p>b</p><p>c", "a\nx\nb\nc"),
        ("<article><h1>Head</h1><p>.</p></article><script>unclosed <p>x", "Head\n."), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
    ],
)
def test_main_text(html, text):
    assert htmltext.main_text(html) == text


PROSE = " ".join(f"word{i}" for i in range(50))
MENU = "".join(f"<li><a href='{i}'>Item {i}</a></li>" for i in range(5))


@pytest.mark.parametrize(
    "html,text",
    [
        (f"<div class=q><ul>{MENU}</ul></div><div class=zz><h2>Title of it</h2><div>{PROSE}</div><p>{PROSE}</p></div><div><a href=1>Imprint</a> <a href=2>About</a></div>", f"Title of it\n{PROSE}\n{PROSE}"),
        (f'<article class="post"><div class="share-story"><p>{PROSE}</p></div></article>', PROSE),
        (f'<article><div class="share"><a href=1>Send</a> <a href=2>Save</a></div><p>{PROSE}</p></article>', PROSE),
        (f'<article><div class="toc"><ul>{MENU}</ul></div><p>{PROSE}</p></article>', PROSE),
        (f"<article><p>{PROSE}</p><ul>{MENU}</ul><p>{PROSE}</p></article>", f"{PROSE}\n{PROSE}"),
        (f"<article><p>{PROSE}</p><section class='comments'><p>{PROSE}</p></section></article>", PROSE),
        (f"<div class=x><p>{PROSE}</p><p><a href=1>{PROSE}</a></p></div>", PROSE),
    ],
)
def test_blocks_are_judged_by_words_and_links(html, text):
    assert htmltext.main_text(html) == text


def test_the_tree_reads_more_than_the_region():
    def used(node):
        return {node[0]} | used(node[2]) | used(node[3]) if isinstance(node, tuple) else set()

    assert {0, 1, 2} < used(htmltext.tree())
    table = [line.split() for line in htmltext.LABELLED.strip().splitlines()]
    assert sum(len({r[-1] for r in table if r[0] == region}) == 2 for region in ("1", "0", "-1")) == 3


def test_articles_of_the_tables(spark):
    import html as library

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in queries()["op9_html_text"](spark, DATA).collect():
        body = source[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(library.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", body))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(None, None, None), (1, "u", None), (1, "u", None)], "page_id long, url string, html string")
    assert [r["text"] for r in htmltext.extract(odd.withColumn("text", F.lit(1))).collect()] == ["", "", ""]


# ---- licences


def test_licences(spark):
    texts = ["Plain words.\nReleased under the MIT License.\nMore.", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", None, "", "The river is under the hill.", "Some text, licensed under CC BY-NC 4.0. And more words of it."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("family", F.lit(1))
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in licences.scan(docs.unionByName(docs)).collect()}
    assert got == {(0, 1): "MIT", (1, 0): "Apache-2.0", (5, 0): "CC-BY-NC"}
    assert licences.scan(empty_docs(spark)).count() == 0
    assert licences.scan(odd_docs(spark)).count() == 0


def test_wrapped_licences(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    texts = [gpl, bsd, f"Some words.\n\n{gpl}\n\nReleased under the MIT License.", gpl.replace("\n", "\n\n"), "The river is under\nthe hill in\nthe north."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in licences.scan(docs).collect() if r["family"] != "unknown"}
    assert got == {(0, 0, "GPL"), (1, 0, "BSD"), (2, 2, "GPL"), (2, 7, "MIT")}


def test_unseen_wordings(spark):
    rows = [(k, f, t) for k, (f, t) in enumerate((f, t) for f, ts in licences.UNSEEN.items() for t in ts)]
    docs = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["family"] for r in licences.scan(docs).collect()}
    named = [(f, got.get(k)) for k, f, _ in rows]
    assert all(g in (f, "unknown") for f, g in named if f != "none") and all(g in (None, "unknown") for f, g in named if f == "none")
    assert sum(f == g for f, g in named) >= 12


def test_licence_lines_of_the_tables(spark):
    known = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Released under the MIT License.": "MIT"}
    data = DATA.replace("0.001", "0.01")
    want = {(r["doc_id"], i): known[x] for r in spark.read.parquet(f"{data}/documents.parquet").collect() for i, x in enumerate(r["text"].split("\n")) if x in known}
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in queries()["op10_licences"](spark, data).collect() if r["family"] != "unknown"}
    assert got == want and want
