"""SentencePiece encoding and decoding through a table of distinct chunks.

The model's pieces never cross a whitespace marker: a marker stands only at the start of a piece, or the piece
is markers alone (`check_chunkable` refuses a model where this does not hold). So a text can be cut before each
run of markers and every chunk segmented alone.
1. The chunks of all texts are counted, combined in each task before the shuffle; each of the `COMMON_ROWS` most
   frequent of `COMMON_BYTES` bytes at most is segmented once, and this table of distinct chunks is broadcast.
2. Each text is put together from the table by position. A chunk that is rarer is segmented where it stands and
   kept in the task's own table: joining every rare chunk to one global table by position would shuffle all texts and
   a tenth of their words twice. The ids are the same either way.

Defined results: a null text counts as empty; an empty text has only the begin and end ids; keys may be null or
repeat, each row is encoded; a chunk of any length is one chunk; other columns do not matter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnstore.llm.common import map_columns

MARK = "▁"
#: Chunks in the broadcast table, and the longest of them.
COMMON_ROWS, COMMON_BYTES = 100_000, 64
#: Distinct chunks that a task counts before it hands them on, and that it keeps of the rarer ones.
COUNTED = 300_000


def check_chunkable(processor) -> None:
    """Raise ValueError unless pieces cannot cross whitespace markers and the text is not normalised."""
    for i in range(processor.get_piece_size()):
        if MARK in processor.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} crosses a whitespace marker")
    if processor.piece_to_id(MARK) == processor.unk_id():
        raise ValueError("the whitespace marker is no piece")
    probe = "  ①ﬁ  é 　x "
    if processor.decode(processor.encode(probe)) != probe:
        raise ValueError("the model normalises texts")


def _cutter():
    """A function from text to its chunks, each with its markers in front."""
    chunks = re.compile(f"{MARK}+[^{MARK}]*").findall
    return lambda text: chunks(MARK + text.replace(" ", MARK)) if text else []


def _processor(model_path: str):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
    check_chunkable(processor)
    return processor


def _segmenter(processor):
    """A function from a chunk to its packed ids."""
    import numpy as np

    def ids_of(chunk: str) -> bytes:
        # The library puts one marker in front of any text, so a chunk goes in without its first one.
        # A marker alone, which only ends a text, would leave nothing to encode: it is its own piece.
        ids = processor.encode(chunk[1:]) if len(chunk) > 1 else [processor.piece_to_id(MARK)]
        return np.array(ids, dtype="<u4").tobytes()

    return ids_of


def chunk_table(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """(chunk, ids): the most frequent distinct chunks of all texts and their ids, packed.

    A chunk that stands once among those that a task has counted is not handed on: it is not frequent.
    """

    def count():
        cut, counts = _cutter(), {}

        def flush():
            often = [(c, n) for c, n in counts.items() if n > 1 and len(c.encode()) <= COMMON_BYTES]
            counts.clear()
            return [c for c, _ in often], [n for _, n in often]

        def work(texts):
            get = counts.get
            for t in texts:
                for chunk in cut(t or ""):
                    counts[chunk] = get(chunk, 0) + 1
            return flush() if len(counts) > COUNTED else None

        work.end = flush
        return work

    def segment():
        ids_of = _segmenter(_processor(model_path))
        return lambda chunks: (chunks, [ids_of(c) for c in chunks])

    counted = map_columns(docs, [text], count, "chunk string, n bigint").groupBy("chunk").agg(F.sum("n").alias("n"))
    return map_columns(counted.orderBy(F.desc("n"), "chunk").limit(COMMON_ROWS), ["chunk"], segment, "chunk string, ids binary")


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, piece_ids as packed little-endian unsigned 32-bit, decoded) of every whole text."""
    common = {r["chunk"]: bytes(r["ids"]) for r in chunk_table(docs, model_path, text).toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def make():
        import numpy as np

        processor, cut = _processor(model_path), _cutter()
        ids_of, known, rare = _segmenter(processor), shared.value, {}
        begin, end = (np.array([i], "<u4").tobytes() for i in (processor.bos_id(), processor.eos_id()))

        def segment(chunk: str) -> bytes:
            ids = rare.get(chunk)
            if ids is None:
                if len(rare) >= COUNTED:
                    rare.clear()
                ids = rare[chunk] = ids_of(chunk)
            return ids

        def encode(t: str) -> bytes:
            chunks = cut(t)
            parts = [*map(known.get, chunks)]
            for pos, ids in enumerate(parts):
                if ids is None:
                    parts[pos] = segment(chunks[pos])
            return b"".join([begin, *parts, end])

        def work(keys, texts):
            packed = [encode(t or "") for t in texts]
            decoded = [processor.decode(np.frombuffer(p, "<u4").tolist()) for p in packed]
            return keys, [len(p) // 4 for p in packed], packed, decoded

        return work

    kind = docs.schema[key].dataType.simpleString()
    return map_columns(docs, [key, text], make, f"`{key}` {kind}, n_tokens bigint, piece_ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The digest columns of `encode_decode`."""
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("piece_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
