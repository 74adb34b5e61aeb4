"""Quality classifier: supervised subword embeddings.

Words and character n-grams are hashed to buckets; every bucket has a learned vector; a document is the mean of
its vectors, passed through a softmax layer. Trained by numpy stochastic gradient descent on a bounded sample of
labelled rows (`TRAINING_ROWS` and `SAMPLE_BYTES`, by hash of doc_id), scored on every whole text. As the model is linear after the mean, scoring
needs one number a bucket: the difference of its vector's two logits.

Defined results: a null or empty text scores by the output bias alone; with no labelled row of both classes
every score is 0.5; null labels are not learned from; rows of one doc_id are scored one by one; other columns do not
matter, `good_rows` passes them through. A text of any length is read in blocks, with one array of its code points.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnstore.llm.common import checkpointed, discard, filter_rows, give_back, held_out, map_columns, training_rows

BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
WIDTH = 8
EPOCHS = 5
RATE = 0.4
#: Labelled documents that the model is fitted on, at most.
TRAINING_ROWS = 4_000
#: Bytes of the sample's buckets and counts that the driver holds, at most; documents of larger hash go unlearned.
SAMPLE_BYTES = 256 << 20
#: Code points handled at a time.
BLOCK = 1 << 20

_MIX = np.uint32(0x9E3779B1)
_STEP = np.uint32(16777619)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)) * _MIX
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0xC2B2AE35)) >> np.uint32(14)).astype(np.int32)


def bucket_blocks(text: str, block: int = BLOCK):
    """The buckets of a lower-cased text's words and character n-grams, one for each occurrence, in arrays.

    A block has the grams and words that start in it, so what reaches over a seam is counted once, whole.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = (codes != 32) & ((codes < 9) | (codes > 13))
    for at in range(0, len(codes), block):
        for n in GRAMS:
            own = codes[at : at + block + n - 1]
            if len(own) >= n:
                h = np.zeros(len(own) - n + 1, dtype=np.uint32)
                for k in range(n):
                    h = h * _STEP + own[k : len(own) - n + 1 + k]
                yield _bucket(h, n)
        first = at
        if at and inside[at - 1]:  # this word started in a block before
            first += _run(inside[at:])
        end = min(at + block, len(codes))
        if first >= end:
            continue
        if inside[end - 1]:
            end += _run(inside[end:])
        yield from _word_buckets(codes[first:end], inside[first:end])


def _run(inside: np.ndarray) -> int:
    """How many true values there are at the front, found without a look at all of them."""
    at, step = 0, 64
    while at < len(inside):
        gaps = np.flatnonzero(~inside[at : at + step])
        if len(gaps):
            return at + int(gaps[0])
        at, step = at + step, step * 2
    return len(inside)


def _word_buckets(codes: np.ndarray, inside: np.ndarray):
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts):
        place = np.arange(len(codes), dtype=np.uint32)
        first = np.repeat(starts.astype(np.uint32), ends - starts)
        powers = (place[inside] - first) * np.uint32(2654435761) ^ codes[inside]
        powers = (powers ^ (powers >> np.uint32(13))) * _MIX
        offsets = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
        yield _bucket(np.add.reduceat(powers, offsets, dtype=np.uint32), 1)


def bucket_ids(text: str) -> np.ndarray:
    parts = list(bucket_blocks(text))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and how often each occurs."""
    total = None
    for part in bucket_blocks(text):
        if total is None and len(part) < 50_000:
            return np.unique(np.concatenate([part, *list(bucket_blocks(text))[1:]]), return_counts=True)
        counts = np.bincount(part, minlength=BUCKETS)
        total = counts if total is None else total + counts
    if total is None:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), total[ids]


def _counted(rows: DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(doc_id, label, distinct buckets, counts) of the sample; texts stay on the executors."""

    def make():
        def work(ids, texts, labels):
            sparse = [bucket_counts(t) for t in texts]
            return (
                ids,
                labels,
                [i.astype("<i4").tobytes() for i, _ in sparse],
                [c.astype("<i4" if c.max(initial=0) >> 16 else "<u2").tobytes() for _, c in sparse],
                [crc32(i.astype("<i4").tobytes() + c.astype("<i4").tobytes()) for i, c in sparse],
            )

        return work

    schema = "doc_id bigint, label int, ids binary, counts binary, digest bigint"
    table = checkpointed(map_columns(rows, ["doc_id", "text", "label"], make, schema))
    size = (F.octet_length("ids") + F.octet_length("counts")).alias("size")
    sizes = table.select("doc_id", "label", "digest", size).orderBy(F.xxhash64("doc_id"), "doc_id", "label", "digest").collect()
    held = np.cumsum([r["size"] for r in sizes])
    kept = {(r["doc_id"], r["label"], r["digest"]) for r in sizes[: int(np.searchsorted(held, SAMPLE_BYTES, side="right"))]}
    out = []
    for r in table.toLocalIterator():
        if (r["doc_id"], r["label"], r["digest"]) in kept:
            ids = np.frombuffer(r["ids"], "<i4")
            wide = len(r["counts"]) == 4 * len(ids)
            out.append((r["doc_id"], int(r["label"] > 0), ids, np.frombuffer(r["counts"], "<i4" if wide else "<u2"), r["digest"]))
    discard(table)
    return [r[:4] for r in sorted(out, key=lambda r: (r[0], r[1], r[4]))]


def train(rows: DataFrame, seed: int = 7) -> tuple[np.ndarray, float]:
    """Fit on (doc_id, text, label); returns a logit for each bucket and the bias of label 1 against 0."""
    sample = [r for r in _counted(rows) if len(r[2])]
    if len({r[1] for r in sample}) < 2:
        return np.zeros(BUCKETS, dtype=np.float32), 0.0
    rng = np.random.default_rng(seed)
    table = ((rng.random((BUCKETS, WIDTH)) - 0.5) / WIDTH).astype(np.float32)
    layer, bias = (rng.random((WIDTH, 2)) - 0.5).astype(np.float32), np.zeros(2, dtype=np.float32)
    steps, step = EPOCHS * len(sample), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(sample)):
            _, label, ids, counts = sample[k]
            share = (counts / counts.sum()).astype(np.float32)
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = share @ table[ids]
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            # The gradient of a mean is small for each vector of a long text; scaled as if it had few features.
            table[ids] -= (rate * 16) * share[:, None] * back
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _model(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> tuple[np.ndarray, float]:
    """`train` on the bounded sample, whose memory the driver gives back before stages that run after it."""
    model = train(training_rows(docs, labels, label, bound))
    give_back(docs.sparkSession)
    return model


def score_text(text: str | None, logits: np.ndarray, bias: float) -> float:
    """Probability of label 1, from the mean over the whole text, read in blocks."""
    total, n = 0.0, 0
    for ids in bucket_blocks(text or ""):
        total += float(logits[ids].sum(dtype=np.float64))
        n += len(ids)
    x = bias + (total / n if n else 0.0)
    return float(1 / (1 + np.exp(-min(max(x, -500.0), 500.0))))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document row."""
    logits, bias = _model(docs, labels, label, bound)
    shared = docs.sparkSession.sparkContext.broadcast(logits)

    def make():
        weights = shared.value

        def work(ids, texts, out):
            scores = [score_text(t, weights, bias) for t in texts]
            return ids, out, scores, [int(s >= 0.5) for s in scores]

        return work

    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return map_columns(
        rows, ["doc_id", "text", "held_out"], make, "doc_id bigint, held_out boolean, score double, predicted int"
    )


def good_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that `classify` predicts as label 1."""
    logits, bias = _model(docs, labels, label, bound)
    shared = docs.sparkSession.sparkContext.broadcast(logits)

    def make():
        weights = shared.value
        return lambda texts: [score_text(t, weights, bias) >= 0.5 for t in texts]

    return filter_rows(docs, ["text"], make)
