"""Benchmark decontamination by one Aho-Corasick automaton.

Test items and documents are normalised alike: A-Z lower-cased, words are runs of digits, letters a-z and
non-ASCII characters. Every window of ``window`` consecutive item words (a shorter item is one window) is a pattern.
The automaton reads words, not letters: the benchmark's distinct words are numbered, and a document becomes a
sequence of these numbers, cut at every other word. Each whole text is scanned once, and hit words are mapped back
to offsets in the original text.

The benchmark is the side that is broadcast: its normalised words, `BENCHMARK_BYTES` at most, which is checked (a
larger benchmark is refused with an error, not cut). A Python worker builds the automaton once and keeps it for all
its tasks; it takes some 1.5 KB for each window. A document takes a list of its words and of their places, some
60 bytes a word.

Defined results: a null or empty text has no words; null item ids or texts take no part; items that share an id
count once; rows of one doc_id are judged one by one; a document is contaminated if at least one word and at least
1/``share`` of its words are hit; other columns of ``docs`` do not matter, `clean_rows` passes them through.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnstore.llm.common import filter_rows, map_columns

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of the benchmark's normalised words, at most.
BENCHMARK_BYTES = 64 << 20


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only, and a non-ASCII character is bytes of 0x80 and up."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def scanner(items: list[tuple[str, list[bytes]]], window: int):
    """A function from text to (number of words, [(start, end) in code points], sorted item ids, number of hit words)."""
    import ahocorasick
    import numpy as np

    number: dict[bytes, int] = {}
    patterns: dict[tuple, set] = {}
    for item, words in items:
        ids = [number.setdefault(w, len(number) + 1) for w in words]
        for i in range(max(1, len(ids) - window + 1)):
            patterns.setdefault(tuple(ids[i : i + window]), set()).add(item)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for pattern, ids in patterns.items():
        automaton.add_word(pattern, (len(pattern), ids))
    if patterns:
        automaton.make_automaton()
    # A word that the benchmark does not have takes the automaton back to its root: what is too short between two
    # of them holds no pattern.
    known = re.compile(b"\x01{%d,}" % min(map(len, patterns), default=1))

    def scan(text: str | None):
        words = words_of(text)
        if not words or not patterns:
            return len(words), [], [], 0
        ids = [*map(number.get, words)]
        found, hit_items = [], set()
        for run in known.finditer(bytes(map(bool, ids))):
            for end, (length, own) in automaton.iter(tuple(ids[run.start() : run.end()])):
                found.append((run.start() + end, length))
                hit_items |= own
        if not found:
            return len(words), [], [], 0
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for end, length in found:
            change[end + 1] -= 1
            change[end + 1 - length] += 1
        hit = np.cumsum(change)[:-1] > 0
        edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
        raw = text.encode("utf-8", "surrogatepass")
        places = [m.span() for m in WORD.finditer(raw.lower())]
        points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])
        runs = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)
        spans = [(int(points[places[a][0]]), int(points[places[b - 1][1]])) for a, b in runs]
        return len(words), spans, sorted(hit_items), int(hit.sum())

    return scan


def benchmark_items(benchmark: DataFrame, limit: int = BENCHMARK_BYTES) -> list[tuple[str, list[bytes]]]:
    """(item id, words) of the items that have words; ValueError beyond ``limit`` bytes."""
    out, held = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(text)
        if item is None or not words:
            continue
        held += sum(map(len, words)) + len(words)
        if held > limit:
            raise ValueError(f"the benchmark has over {limit} bytes of words; scan for its parts one after another")
        out.append((str(item), words))
    return out


#: The scanners of this Python worker, by the broadcast that they were built from; the last one is kept.
_BUILT: dict = {}


def _scanner_of(shared, window: int):
    key = (shared._jbroadcast_id if hasattr(shared, "_jbroadcast_id") else getattr(shared, "_path", None) or id(shared), window)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = scanner(shared.value, window)
    return _BUILT[key]


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) of every document row.

    ``spans`` are the maximal runs of hit words as [start, end) code points of the original text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(benchmark_items(benchmark))
    schema = "doc_id bigint, n_words bigint, n_hit bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"

    def make():
        scan = _scanner_of(shared, window)

        def work(ids, texts):
            found = [scan(t) for t in texts]
            return (
                ids,
                [f[0] for f in found],
                [f[3] for f in found],
                [[{"start": a, "end": b} for a, b in f[1]] for f in found],
                [f[2] for f in found],
            )

        return work

    return map_columns(docs, ["doc_id", "text"], make, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """`scan_documents` with ``contaminated``."""
    return scan_documents(docs, benchmark, window).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs, however long the text is."""
    shared = docs.sparkSession.sparkContext.broadcast(benchmark_items(benchmark))

    def make():
        scan = _scanner_of(shared, window)
        return lambda texts: [not scan(t)[3] for t in texts]

    return filter_rows(docs, ["text"], make)


def digests(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
