"""Removal of byte strings of `least` bytes and more that recur anywhere in the corpus.

The suffix structure of a corpus does not fit one task, so windows of ``least`` bytes are first dealt out by content.
The smallest hash among a window's `ANCHOR`-byte grams (the leftmost of equals) owns the window; equal windows have
equal owners at equal offsets, so they meet under one anchor, and an anchor seen once owns no repeat.
1. Anchors are counted over all documents, with the smallest and largest hash of their contexts (the bytes of all
   windows that the anchor owns at one place). Anchors seen once are done with; where all contexts are equal, all
   their windows recur.
2. The distinct contexts of the other anchors are concatenated in blocks of about `BLOCK_BYTES`, whole anchors
   together. A block's suffixes are sorted and its Burrows-Wheeler transform taken; breadth-first backward
   extension of suffix intervals then derives common prefixes by increasing length and stops at ``least``: what has
   no value by then has a common prefix of ``least`` or more, and both its suffixes start a repeated window.
3. Windows that recur are joined back to texts, and covered bytes removed.
An anchor with more than `CROWD` distinct contexts (a passage in very many documents) would not fit one task: its
windows are compared one by one instead, as 128-bit hashes in a distributed count that combines before it shuffles.

Anchors are looked up by two bitmaps of `BITS` bits whatever the corpus's size, then joined exactly. Texts are
shuffled only where some window recurs. What recurs is a property of the text alone, so texts are told apart by
128 bits of hash; contexts are by 128 bits too, those of the anchor and of the context. Row multiplicity counts, as
equal rows repeat each other.

Defined results: a null text counts as empty; texts under ``least`` bytes lose nothing; ids may be null or repeat;
other columns do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnstore.llm.common import checkpointed, map_columns, parted

LEAST = 200
ANCHOR = 64
BLOCK_BYTES = 1_000_000
CROWD = 4_000
BITS = 1 << 27
#: Bytes of one text handled at a time.
STRIDE = 1 << 20

_TABLE = np.random.default_rng(3).integers(0, 1 << 64, size=256, dtype=np.uint64)
_FACTORS = np.random.default_rng(4).integers(0, 1 << 63, size=16, dtype=np.uint64) | np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash for each run of ANCHOR bytes, doubled up from single bytes."""
    h, size, level = _TABLE[raw], 1, 0
    while size < ANCHOR:
        h = h[:-size] * _FACTORS[level] + (h[size:] ^ (h[size:] >> np.uint64(31)))
        size, level = size * 2, level + 1
    h ^= h >> np.uint64(29)
    h *= _FACTORS[15]
    return h ^ (h >> np.uint64(32))


def _window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` keys."""
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[: len(keys) - (width - size)], keys[width - size :]) if size < width else keys


def owners(raw: np.ndarray, least: int = LEAST):
    """(anchor hash, anchor place, first window, last window) arrays over a text's windows, in order."""
    parts = []
    for at in range(0, len(raw) - least + 1, STRIDE):
        piece = raw[at : at + STRIDE + least - 1]
        h = _gram_hashes(piece)
        keys = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        owner = (_window_minimum(keys, least - ANCHOR + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        last = np.append(first[1:], len(owner)) - 1
        parts.append((h[owner[first]].view(np.int64), owner[first] + at, first + at, last + at))
    if not parts:
        return (np.zeros(0, dtype=np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _contexts(text: str | None, least: int, hit: np.ndarray | None = None):
    """(anchors, context hashes, first windows, last windows, bytes) of a text, of anchors in a bitmap if one is given."""
    import xxhash

    raw = (text or "").encode("utf-8", "surrogatepass")
    found = owners(np.frombuffer(raw, dtype=np.uint8), least)
    if hit is not None:
        picked = np.flatnonzero(_hit(hit, found[0]))
        found = tuple(x[picked] for x in found)
    anchor, place, first, last = found
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(
        (digest(raw[s : e + least], seed=p - s) for p, s, e in zip(place.tolist(), first.tolist(), last.tolist(), strict=True)),
        dtype=np.uint64,
        count=len(anchor),
    ).view(np.int64)
    return anchor, hashes, first, last, raw


# ---- suffix intervals of a block


def suffix_array(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes of ``symbols`` in order; any two differ within ``longest`` symbols."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    span, order = 1, np.argsort(rank)
    while span < longest:
        follow = np.zeros(n, dtype=np.int64)
        follow[:-span] = rank[span:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        span *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


def repeated_starts(pieces: list[bytes], least: int = LEAST) -> np.ndarray:
    """For the concatenated pieces, true where a string of ``least`` bytes starts that also starts elsewhere.

    Pieces end in separators that equal nothing, so no string crosses from one piece into the next.
    """
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    symbols = np.zeros(n, dtype=np.int64)
    inside = np.ones(n, dtype=bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64) + len(pieces)
    symbols[ends] = np.arange(len(pieces))  # separators are smaller than every byte
    order = suffix_array(symbols, int(sizes.max()) + 1)
    before = symbols[order - 1]  # the transform; the first suffix is preceded by the last separator
    # Where the suffix with the preceding symbol in front stands in the order.
    by_symbol = np.argsort(before * n + np.arange(n))
    front = np.empty(n, dtype=np.int64)
    front[by_symbol] = np.arange(n)

    known = np.zeros(n + 1, dtype=bool)
    known[0] = known[n] = True
    known[: len(pieces) + 1] = True  # separators share nothing
    starts = np.flatnonzero(np.diff(symbols[order], prepend=-1))
    low, high = starts, np.append(starts[1:], n)
    known[high] = True
    for _ in range(1, least):
        if not len(low):
            break
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        j = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + low[which]
        symbol = before[j]
        real = symbol >= len(pieces)
        key, j = np.divmod(np.sort((which[real] * (256 + len(pieces)) + symbol[real]) * n + j[real]), n)
        head = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(np.append(head, len(key)))
        new_low = front[j[head]]
        new_high = new_low + count
        fresh = ~known[new_high]
        new_low, new_high = new_low[fresh], new_high[fresh]
        # Intervals of equally long strings are disjoint, so no boundary comes twice.
        known[new_high] = True
        low, high = new_low, new_high
    long = ~known  # the common prefix of suffixes i - 1 and i is `least` or more
    found = np.zeros(n, dtype=bool)
    found[order[long[:-1] | long[1:]]] = True
    return found


# ---- the distributed parts


def _bitmap(keys: DataFrame) -> np.ndarray:
    """One bit for each hash bucket that a key of ``keys`` (a) falls in; at most BITS / 8 bytes come to the driver."""
    bit = F.pmod("a", F.lit(BITS)) + 1  # Spark's bitmaps count from 1
    rows = keys.select(F.bitmap_bucket_number(bit).alias("at"), F.bitmap_bit_position(bit).alias("bit"))
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for r in rows.groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        start = (r["at"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _hit(bitmap: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    place = np.mod(anchors, BITS)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _text_keys():
    """Two independent 64-bit hashes of a text."""
    return F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))


def repeated_windows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(row, twin, first, last, mask): for each text by its two hashes, runs of windows of which some recur.

    A null mask says that all windows of the run recur; else it has one bit a window.
    """
    if least < ANCHOR:
        raise ValueError(f"strings of {ANCHOR} bytes at least")
    context = docs.sparkSession.sparkContext

    def emit(keep, schema, more):
        def make():
            def work(rows, twins, texts):
                out = [[] for _ in range(schema.count(",") + 1)]
                for row, twin, t in zip(rows, twins, texts, strict=True):
                    found = _contexts(t, least, None if keep is None else keep.value)
                    for column, value in zip(out, more((row, twin), found), strict=True):
                        column.append(value)
                return [
                    [x for part in column for x in part] if isinstance(column[0], list) else np.concatenate(column)
                    for column in out
                ]

            return work

        row, twin = _text_keys()
        rows = docs.where(F.octet_length("text") >= least).select(row.alias("row"), twin.alias("twin"), "text")
        return map_columns(rows, ["row", "twin", "text"], make, schema)

    counted = emit(None, "a bigint, c bigint", lambda row, f: (f[0], f[1]))
    anchors = counted.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2"))
    anchors = checkpointed(anchors.where(F.col("n") > 1).select("a", (F.col("c1") != F.col("c2")).alias("mixed")))
    seen = context.broadcast(_bitmap(anchors))
    mixed = context.broadcast(_bitmap(anchors.where("mixed")))

    def placed(row, f):
        n = len(f[0])
        body = np.full(n, None, dtype=object)
        for k in np.flatnonzero(_hit(mixed.value, f[0])).tolist():
            body[k] = f[4][f[2][k] : f[3][k] + least]
        return f[0], f[1], np.full(n, row[0], dtype=np.int64), np.full(n, row[1], dtype=np.int64), f[2], f[3], body

    # Texts are read once for both, the places of contexts and the bytes of those that differ.
    found = checkpointed(emit(seen, "a bigint, c bigint, row bigint, twin bigint, first bigint, last bigint, body binary", placed))
    places = found.groupBy("a", "c", "row", "twin", "first", "last").agg(F.lit(1).alias("one")).drop("one")
    places = checkpointed(places.join(anchors, "a"))
    contexts = found.where(F.col("body").isNotNull())
    contexts = contexts.groupBy("a", "c").agg(F.count("*").alias("n"), F.first("body").alias("body"))
    contexts = checkpointed(contexts.join(anchors.where("mixed").select("a"), "a", "left_semi"))
    crowded = contexts.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") > CROWD).select("a")
    crowded = checkpointed(crowded)

    masks = _block_masks(contexts.join(crowded, "a", "left_anti"), least).unionByName(
        _counted_masks(contexts.join(crowded, "a", "left_semi"), least)
    )
    masks = checkpointed(masks)
    whole = places.where(~F.col("mixed")).select("row", "twin", "first", "last", F.lit(None).cast("binary").alias("mask"))
    partly = places.where("mixed").join(masks, ["a", "c"]).select("row", "twin", "first", "last", "mask")
    return whole.unionByName(partly)


def _block_masks(contexts: DataFrame, least: int) -> DataFrame:
    """(a, c, mask) of contexts with windows that recur, from the suffix intervals of blocks of whole anchors."""
    dealt = contexts.repartition("a").sortWithinPartitions("a")

    def make():
        held: list[tuple] = []
        state = {"bytes": 0, "last": None}

        def done():
            if not held:
                return None
            found = repeated_starts([h[3] for h in held], least)
            out: list[list] = [[], [], []]
            at = 0
            for a, c, n, body in held:
                own = found[at : at + len(body) - least + 1]
                at += len(body) + 1
                if n > 1 or own.any():
                    out[0].append(a)
                    out[1].append(c)
                    out[2].append(None if n > 1 else np.packbits(own).tobytes())
            held.clear()
            state["bytes"] = 0
            return out

        def work(anchors, hashes, counts, bodies):
            out: list[list] = [[], [], []]
            for row in zip(anchors, hashes, counts, bodies, strict=True):
                if row[0] != state["last"] and state["bytes"] >= BLOCK_BYTES:
                    for column, more in zip(out, done(), strict=True):
                        column += more
                held.append(row)
                state["bytes"] += len(row[3])
                state["last"] = row[0]
            return out

        work.end = done
        return work

    return map_columns(dealt, ["a", "c", "n", "body"], make, "a bigint, c bigint, mask binary")


def _counted_masks(contexts: DataFrame, least: int) -> DataFrame:
    """The same for crowded anchors, by counting windows."""

    def make():
        import xxhash

        def work(anchors, hashes, counts, bodies):
            out: list[list] = [[], [], [], [], []]
            for a, c, n, body in zip(anchors, hashes, counts, bodies, strict=True):
                windows = len(body) - least + 1
                for s in range(windows):
                    h = xxhash.xxh3_128_digest(body[s : s + least])
                    out[3].append(int.from_bytes(h[:8], "little", signed=True))
                    out[4].append(int.from_bytes(h[8:], "little", signed=True))
                out[0] += [a] * windows
                out[1] += [c] * windows
                out[2] += range(windows)
            return out

        return work

    windows = map_columns(contexts, ["a", "c", "n", "body"], make, "a bigint, c bigint, at int, h1 bigint, h2 bigint")
    often = windows.groupBy("h1", "h2").agg(F.count("*").alias("times")).where(F.col("times") > 1)
    starts = windows.join(often.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("a", "c").agg(F.collect_set("at").alias("at"))

    def pack():
        def work(anchors, hashes, places):
            masks = []
            for at in places:
                own = np.zeros(max(at) + 1, dtype=bool)
                own[at] = True
                masks.append(np.packbits(own).tobytes())
            return anchors, hashes, masks

        return work

    single = map_columns(starts, ["a", "c", "at"], pack, "a bigint, c bigint, mask binary")
    twice = contexts.where(F.col("n") > 1).select("a", "c", F.lit(None).cast("binary").alias("mask"))
    return single.join(twice, ["a", "c"], "left_anti").unionByName(twice)


def _removed(raw: bytes, runs, least: int) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, maximal runs removed)."""
    change = np.zeros(len(raw) + 1, dtype=np.int64)
    for first, last, mask in runs:
        if mask is None:
            change[first] += 1
            change[last + least] -= 1
        else:
            own = np.flatnonzero(np.unpackbits(np.frombuffer(mask, dtype=np.uint8))[: last - first + 1]) + first
            np.add.at(change, own, 1)
            np.add.at(change, own + least, -1)
    gone = np.cumsum(change)[:-1] > 0
    spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
    return np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every document row."""
    runs = repeated_windows(docs, least).groupBy("row", "twin").agg(F.collect_list(F.struct("first", "last", "mask")).alias("runs"))
    runs = checkpointed(runs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near, rest = parted(rows, F.xxhash64("text"), runs, "row")
    row, twin = _text_keys()
    same = (row == F.col("row")) & (twin == F.col("twin"))
    near = near.join(runs, same, "left")

    def make():
        def work(ids, texts, found):
            raws = [t.encode("utf-8", "surrogatepass") for t in texts]
            out = [_removed(r, [(x["first"], x["last"], x["mask"]) for x in f or ()], least) for r, f in zip(raws, found, strict=True)]
            return ids, [len(r) for r in raws], [o[1] for o in out], [o[2] for o in out], [o[0] for o in out]

        return work

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    none = F.lit(0).cast("bigint")
    whole = rest.select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept")
    )
    return map_columns(near, ["doc_id", "text", "runs"], make, schema).unionByName(whole)


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
