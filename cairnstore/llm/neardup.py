"""Near-duplicate documents by HyperMinHash.

Every whole text becomes its set of distinct word shingles (64-bit hashes) and a HyperMinHash sketch of it:
`REGISTERS` buckets, each the minimum hash that falls in it, kept as a leading-zero count and mantissa bits in
16 bits; empty buckets borrow from a fixed random sequence of others. Documents of equal sets are one class from
then on, so exact copies cost nothing further. Runs of registers are banded; classes that share a band are
candidates. A sketch estimate, corrected for register collisions, drops hopeless candidates, and the rest are
confirmed on full sets. Components come from a distributed union-find.

A band may hold any number of classes, so its pairs are never listed: see `bands.banded_components`, after which
every pair of a band is confirmed, refused or already connected, so components are exact for all candidates.
At similarity 0.85 a pair misses every band with probability 1e-6.

Defined results: a null or blank text has an empty set, linked with nothing; fewer words than a shingle are one
shingle; rows of one doc_id are one document for linking, whether their texts are equal or not, and stay or go
together; a null doc_id has no component and is kept; other columns do not matter, `one_of_each` passes them through.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnstore.llm.bands import banded_components, labelled
from cairnstore.llm.common import among, checkpointed, discard, map_columns, without
from cairnstore.llm.graph import connected_components

REGISTERS, ROWS, BANDS = 256, 7, 36
MANTISSA = 10
#: An estimate this far under the threshold is refused without a look at the sets: six standard errors.
MARGIN = 6 * 0.5 / REGISTERS**0.5

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PROBES = np.random.default_rng(11).integers(0, REGISTERS, size=(64, REGISTERS))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word; words are parted by ASCII white space, A-Z is lower-cased."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(lengths.sum(), dtype=np.int64) - np.repeat(offsets, lengths)
    letters = _mix((place.astype(np.uint64) << np.uint64(8)) | raw[inside].astype(np.uint64))
    return _mix(np.add.reduceat(letters, offsets) + lengths.astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(words, len(h))
    s = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        s = _mix(s * _B + h[k : len(h) - n + 1 + k])
    return np.unique(s)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a sorted set that is not empty."""
    shift = np.uint64(64 - (REGISTERS - 1).bit_length())
    edges = np.searchsorted(hashes >> shift, np.arange(REGISTERS + 1, dtype=np.uint64))
    full = edges[1:] > edges[:-1]
    least = hashes[np.minimum(edges[:-1], len(hashes) - 1)] << (np.uint64(64) - shift)
    _, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = ((zeros << np.uint64(MANTISSA)) | mantissa).astype("<u2")
    if not full.all():
        source = np.arange(REGISTERS)
        missing = np.flatnonzero(~full)
        for probe in _PROBES:
            found = full[probe[missing]]
            source[missing[found]] = probe[missing[found]]
            missing = missing[~found]
            if not len(missing):
                break
        if len(missing):
            there = np.flatnonzero(full)
            source[missing] = there[np.searchsorted(there, missing) % len(there)]
        out = out[source]
    return out


def band_keys(registers: np.ndarray) -> list[int]:
    rows = registers[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h * _B + rows[:, k])
    return h.view(np.int64).tolist()


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity from registers, less the expected share of unequal minima that collide."""
    chance = 0.1699 / (1 << MANTISSA)
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    def make():
        def work(ids, texts):
            out: list[list] = [[], [], [], []]
            for i, t in zip(ids, texts, strict=True):
                s = shingle_set(t, words)
                for column, value in zip(
                    out,
                    (
                        i,
                        len(s),
                        hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None,
                        band_keys(sketch(s)) if len(s) else None,
                    ),
                    strict=True,
                ):
                    column.append(value)
            return out

        return work

    schema = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"
    return map_columns(docs, ["doc_id", "text"], make, schema)


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, registers, hashes) of the documents in ``ids``."""

    def make():
        def work(ids, texts):
            sets = [shingle_set(t, words) for t in texts]
            return ids, [sketch(s).tobytes() if len(s) else b"" for s in sets], [s.astype("<u8").tobytes() for s in sets]

        return work

    rows = among(docs.select("doc_id", "text"), "doc_id", ids.select(F.col("id").alias("doc_id")))
    return map_columns(rows, ["doc_id", "text"], make, "id bigint, registers binary, hashes binary")


def _bits(grams: np.ndarray) -> list[int]:
    """Four longs with the bit (gram mod 256) set for each gram."""
    flags = np.zeros(256, dtype=np.uint8)
    flags[grams & np.uint64(255)] = 1
    return np.packbits(flags, bitorder="little").view("<i8").tolist()


def _measured(pairs: DataFrame, sets: DataFrame, percent: int, gate: bool) -> DataFrame:
    """(src, dst, a, r, both, bits) of ``pairs``; with ``gate`` without those that size or estimate show to be unlike."""
    one = sets.select(F.col("id").alias("src"), F.col("registers").alias("r1"), F.col("hashes").alias("h1"))
    two = sets.select(F.col("id").alias("dst"), F.col("registers").alias("r2"), F.col("hashes").alias("h2"))

    def make():
        def work(src, dst, r1, r2, h1, h2):
            out: list[list] = [[], [], [], [], [], []]
            for i, j, ra, rb, ha, hb in zip(src, dst, r1, r2, h1, h2, strict=True):
                if not ha or not hb:
                    continue
                x, y = np.frombuffer(ha, "<u8"), np.frombuffer(hb, "<u8")
                if gate and 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                if gate and estimate(np.frombuffer(ra, "<u2"), np.frombuffer(rb, "<u2")) < percent / 100 - MARGIN:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                bits = None if gate else _bits(np.setxor1d(x, y, assume_unique=True))
                for column, value in zip(out, (i, j, len(x) - both, len(y) - both, both, bits), strict=True):
                    column.append(value)
            return out

        return work

    # The smaller id is the hub of many pairs: it is joined first, while rows are narrow.
    joined = pairs.join(two, "dst").join(one, "src")
    schema = "src bigint, dst bigint, a bigint, r bigint, both bigint, bits array<bigint>"
    return map_columns(joined, ["src", "dst", "r1", "r2", "h1", "h2"], make, schema)


def _members(sets: DataFrame) -> DataFrame:
    """(id, gram), one row for each shingle of a set."""

    def make():
        def work(ids, hashes):
            out = [np.frombuffer(h, "<i8") for h in hashes]
            at = np.repeat(np.array(ids, dtype=np.int64), [len(h) for h in out])
            return at, np.concatenate(out) if out else at

        return work

    return map_columns(sets, ["id", "hashes"], make, "id bigint, gram bigint")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document row."""
    rows = checkpointed(_sketches(docs, words))
    classes = checkpointed(
        rows.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    )
    banded = classes.select("id", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where(F.col("hub") != F.col("last"))
    hubs = checkpointed(hubs.select("band", "hub"))
    met = checkpointed(among(banded, "band", hubs.select("band"), exact=False).join(hubs, "band").select("id", "band", "hub"))
    sets = checkpointed(_sets(docs, met.select("id").distinct(), words))

    def measure(pairs: DataFrame, gate: bool) -> DataFrame:
        return _measured(pairs, sets, percent, gate)

    labels = banded_components(met, measure, _members(sets), percent)
    discard(hubs, met, sets)
    # A doc_id whose rows have different sets joins their classes.
    own = rows.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
    many = checkpointed(own.agg(F.min("digest").alias("one"), F.max("digest").alias("two")).where("one <> two").select("doc_id"))
    if not many.isEmpty():
        named = rows.join(many, "doc_id", "left_semi").join(classes.select("digest", "id"), "digest")
        named = labelled(named.select("doc_id", "id"), labels, "id", "component")
        same = named.select("doc_id", "component").distinct()
        hubs = same.groupBy("doc_id").agg(F.min("component").alias("src"))
        more = same.join(hubs, "doc_id").select("src", F.col("component").alias("dst"))
        labels = connected_components(labels.select(F.col("id").alias("src"), F.col("component").alias("dst")).unionByName(more))
    named = labelled(classes.select("digest", "id"), labels, "id", "component_id").select("digest", "component_id")
    return (
        rows.select("doc_id", "n_shingles", "digest")
        .join(named, "digest", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without those that are not the first document of their component."""
    found = near_duplicates(docs, words, percent)
    return without(docs, "doc_id", found.where(~F.col("kept")).select("doc_id"))
