"""Exact top-k inner-product search on a bit-sliced index.

Each component x becomes floor(256 * x). Rows are packed into blocks; inside a block every attribute is stored
as bit slices: bitmap b has a row's bit b of (attribute - its block minimum). A query's scores over a block are
a sum of those attributes times small integers; it is done on the slices alone, by shift-and-add of bitmaps
with carry-save adders, once for the positive and once for the negative digits of the query's components.
The top rows are then selected from the most significant score slice downward, which leaves a set of certain
rows and a set of boundary rows with equal score; boundary rows are resolved exactly by smaller vec_id.
Every block gives its own best k, and a window keeps the best k a query.

Blocks of rows meet blocks of queries through an equality join on the row block's number. Query blocks are the
stated query set, replicated for each row block; a join row holds one block of each kind, so memory is bounded
by the two block sizes whatever the table's size.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do null
ids; only vectors of the query's length are its candidates; rows that repeat an id are candidates each, and a
query row never meets rows of its own id; fewer than k candidates give fewer rows; an empty table gives none. A finite
component so large that a score could leave 64 bits (2^31 / (256 sqrt(width)) and more) is an error. Ties go to the
smaller vec_id; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnstore.llm.common import bounded_batches, checkpointed

#: Rows in a block of the index and queries in a block, both powers of two.
ROW_BLOCK = 16_384
QUERY_BLOCK = 256


def quantise(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, width, v array<bigint>) of the vectors that take part."""
    as_double = F.col(embedding).cast("array<double>")
    fits = ~F.exists(as_double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    # A score is a sum of ``size`` products; what could leave 64 bits is an error rather than a wrong score.
    most = F.sqrt(F.lit(2.0**62) / F.size(embedding)) / 256 - 1
    large = F.raise_error(F.concat(F.lit("components too large for 64-bit scores, id "), F.col(key).cast("string")))
    large = F.when(F.exists(as_double, lambda x: F.abs(x) > most), large.cast("boolean")).otherwise(F.lit(True))
    finite = F.when(fits, large).otherwise(F.lit(False))
    return vectors.where(F.col(key).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0)).where(finite).select(
        F.col(key).cast("bigint").alias("vec_id"),
        F.size(embedding).alias("width"),
        F.transform(as_double, lambda x: F.floor(x * 256)).alias("v"),
    )


def _blocks(rows: DataFrame, per_block: int, name: str) -> DataFrame:
    """Pack rows of a width into blocks: (width, name, ids binary, matrix binary), one row for each block."""
    spark = rows.sparkSession
    bounded_batches(spark)
    # Tasks number their own blocks; no count over all rows is needed.
    schema = f"width int, {name} string, ids binary, matrix binary"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[int, list] = {}
        made = 0

        def packed(width):
            nonlocal made
            ids, vs = zip(*held.pop(width), strict=True)
            made += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([width], pa.int32()),
                    pa.array([f"{part}-{made}"], pa.string()),
                    pa.array([np.array(ids, dtype="<i8").tobytes()], pa.binary()),
                    pa.array([np.array(vs, dtype="<i8").tobytes()], pa.binary()),
                ],
                names=["width", name, "ids", "matrix"],
            )

        for b in batches:
            for i, w, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(w, []).append((i, v))
                if len(held[w]) == per_block:
                    yield packed(w)
        for w in list(held):
            yield packed(w)

    return rows.select("vec_id", "width", "v").mapInArrow(run, schema)


class SlicedBlock:
    """The bit slices of a block's attributes; bitmaps are little-endian arrays of 64-bit words."""

    def __init__(self, matrix: np.ndarray):
        self.rows, self.width = matrix.shape
        self.least = matrix.min(axis=0)
        offset = (matrix - self.least).astype(np.uint64)
        self.words = -(-self.rows // 64)
        self.slices = []
        for d in range(self.width):
            bits = int(offset[:, d].max()).bit_length()
            self.slices.append([self._bitmap((offset[:, d] >> np.uint64(b)) & np.uint64(1)) for b in range(bits)])
        self.every = self._bitmap(np.ones(self.rows, dtype=np.uint8))

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, dtype=np.uint8)
        packed = np.packbits(flags.astype(np.uint8), bitorder="little")
        out[: len(packed)] = packed
        return out.view("<u8")

    def _sum(self, weights: list[tuple[int, int]]) -> list[np.ndarray]:
        """Slices of the sum over (attribute, factor >= 0) of factor * attribute."""
        columns: dict[int, list[np.ndarray]] = {}
        for d, factor in weights:
            for j in range(factor.bit_length()):
                if factor >> j & 1:
                    for b, bitmap in enumerate(self.slices[d]):
                        columns.setdefault(b + j, []).append(bitmap)
        out, at = [], 0
        while columns:
            column = columns.pop(at, [])
            carries = columns.setdefault(at + 1, []) if len(column) > 1 else None
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                x = a ^ b
                column.insert(0, x ^ c)
                carries.append((a & b) | (x & c))
            if len(column) == 2:
                a, b = column
                column = [a ^ b]
                carries.append(a & b)
            out.append(column[0] if column else np.zeros(self.words, dtype="<u8"))
            at += 1
        return out

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of (score - constant) as a two's complement number; the last slice is the sign."""
        up = self._sum([(d, int(q)) for d, q in enumerate(query) if q > 0])
        down = self._sum([(d, int(-q)) for d, q in enumerate(query) if q < 0])
        size = max(len(up), len(down)) + 1
        zero, ones = np.zeros(self.words, dtype="<u8"), np.full(self.words, ~np.uint64(0), dtype="<u8")
        carry, out = ones, []
        for k in range(size):
            a = up[k] if k < len(up) else zero
            b = ~down[k] if k < len(down) else ones
            x = a ^ b
            out.append(x ^ carry)
            carry = (a & b) | (x & carry)
        return out

    def top(self, query: np.ndarray, k: int, allowed: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Positions of the best k allowed rows."""
        slices = self.scores(query)
        certain, tied = np.zeros(self.words, dtype="<u8"), allowed.copy()
        slices[-1] = ~slices[-1]  # a set sign is the smaller number
        n_certain = 0
        for s in reversed(slices):
            higher = tied & s
            n = n_certain + int(np.bitwise_count(higher).sum())
            if n <= k:
                certain, n_certain = certain | higher, n
                tied = tied & ~s
                if n == k:
                    break
            else:
                tied = higher
        rows = self._positions(certain)
        if len(rows) < k:
            boundary = self._positions(tied)
            rows = np.concatenate([rows, boundary[np.argsort(ids[boundary], kind="stable")][: k - len(rows)]])
        return rows

    def _positions(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.rows])


def search(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` of all rows for every row where ``is_query`` holds."""
    rows = quantise(vectors)
    # About ROW_BLOCK rows a partition at any size; the count reads no vector.
    n = vectors.count()
    index = _blocks(rows.repartition(max(1, -(-n // ROW_BLOCK))), ROW_BLOCK, "row_block")
    index = checkpointed(index.withColumnRenamed("ids", "row_ids").withColumnRenamed("matrix", "row_matrix"))
    n_queries = max(1, rows.where(is_query).count())
    asked = _blocks(
        rows.where(is_query).repartition(max(1, -(-n_queries // QUERY_BLOCK))), QUERY_BLOCK, "query_block"
    )
    # Row-block names are a few bytes for each 16,384 rows.
    names = index.groupBy("width").agg(F.collect_list("row_block").alias("row_block"))
    asked = asked.join(names, "width").withColumn("row_block", F.explode("row_block"))
    pairs = asked.join(index, ["width", "row_block"]).select("width", "ids", "matrix", "row_block", "row_ids", "row_matrix")

    def run(batches):
        import pyarrow as pa

        last, block = None, None
        for b in batches:
            for width, ids, matrix, name, row_ids, row_matrix in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != last:
                    rows_of = np.frombuffer(row_matrix, "<i8").reshape(-1, width)
                    own_ids, block, last = np.frombuffer(row_ids, "<i8"), SlicedBlock(rows_of), name
                out: list[list] = [[], [], []]
                for q, query in zip(np.frombuffer(ids, "<i8"), np.frombuffer(matrix, "<i8").reshape(-1, width), strict=True):
                    own = own_ids == q
                    allowed = block.every & ~block._bitmap(own) if own.any() else block.every
                    best = block.top(query, k, allowed, own_ids)
                    out[0] += [int(q)] * len(best)
                    out[1] += own_ids[best].tolist()
                    out[2] += (rows_of[best] @ query).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
