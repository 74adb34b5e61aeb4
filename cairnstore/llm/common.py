"""What the operators of this package share: Arrow maps that keep nulls exact, a checkpoint folder, label splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnstore.lineage import checkpointed, discard, give_back, shared_folder  # noqa: F401  for the operators of this package

#: Rows and bytes of an Arrow batch; a batch has one row at least.
BATCH_ROWS, BATCH_BYTES = 256, "16m"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as rows here carry whole documents.

    The bounds are the same for all operators, so it does not matter which of several lazy plans runs first.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_columns(df: DataFrame, columns: list[str], make: Callable, schema: str) -> DataFrame:
    """Apply ``make()(*column_lists) -> tuple of lists`` to each Arrow batch of ``columns``.

    ``make`` runs once a task, so a task can hold caches or a loaded model. If the returned function has an
    attribute ``end``, it is called without arguments after the last batch and gives a last batch.
    """
    bounded_batches(df.sparkSession)
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        work = make()

        def packed(out):
            return pa.RecordBatch.from_arrays(
                [pa.array(v, type=f.type) for v, f in zip(out, target, strict=True)], schema=target
            )

        for batch in batches:
            out = work(*[c.to_pylist() for c in batch.columns])
            if out is not None and len(out[0]):
                yield packed(out)
        if (end := getattr(work, "end", None)) is not None:
            out = end()
            if out is not None and len(out[0]):
                yield packed(out)

    return df.select(*columns).mapInArrow(run, fields)


def filter_rows(df: DataFrame, columns: list[str], make: Callable) -> DataFrame:
    """The rows of ``df`` for which ``make()(*column_lists)`` gives true; ``make`` runs once a task."""
    bounded_batches(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        test = make()
        for batch in batches:
            yield batch.filter(pa.array(test(*[batch.column(c).to_pylist() for c in columns]), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def fresh(name: str, rows: DataFrame) -> str:
    """``name`` with as many underscores in front as tell it from all columns of ``rows``."""
    taken = {c.lower() for c in rows.columns}
    name = f"__{name}"
    while name in taken:
        name = f"_{name}"
    return name


def without(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``column`` (a long) is not in ``keys``; only rows that may be are shuffled."""
    keys = checkpointed(keys.distinct())
    near, rest = parted(rows, F.col(column), keys, column)
    return near.join(keys, column, "left_anti").unionByName(rest)


#: Bits of the bitmaps that tell which keys there are, and bits of a word.
BITS, WORD = 1 << 27, 64


def _bit(key):
    """(word, mask) of a key's bit; a null key has the bit of 0."""
    place = F.pmod(F.xxhash64(F.coalesce(key, F.lit(0).cast("bigint"))), F.lit(BITS))
    return F.floor(place / WORD).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(WORD)).cast("int"))


def parted(rows: DataFrame, key, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` (a long) may be in ``keys``, and those where it is not.

    What is broadcast is a bitmap by hash, in words: at most `BITS` / `WORD` rows of two numbers however many keys
    there are, 64 MB in memory. With many more keys than bits it spares no row any more, but drops none.
    """
    at, bits = fresh("word", rows), fresh("bits", rows)
    word, mask = _bit(F.col(column))
    words = F.broadcast(keys.groupBy(word.alias(at)).agg(F.bit_or(mask).alias(bits)))
    own, bit = _bit(key)
    hit = (own == F.col(at)) & (F.col(bits).bitwiseAND(bit) != 0)
    return rows.join(words, hit, "left_semi"), rows.join(words, hit, "left_anti")


def held_out(doc_id: str = "doc_id"):
    """True for the third of documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled documents outside the held-out third.

    The sample is the ``bound`` labelled ids of smallest hash; an id labelled twice counts once, with its
    larger label. Null ids, labels and texts are left out.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    return texts.join(F.broadcast(picked), "doc_id")


def among(rows: DataFrame, column: str, keys: DataFrame, exact: bool = True) -> DataFrame:
    """The rows whose ``column`` (a long) is in ``keys``: by `parted` first, then exactly."""
    near, _ = parted(rows, F.col(column), keys, column)
    return near.join(keys, column, "left_semi") if exact else near
