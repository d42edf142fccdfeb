"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.session import discard, materialise, scratch_path, ship_package, temporary  # noqa: F401

#: A word of every contract: a run of code points other than blank and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch, where the session has Spark's default, and bytes of texts handed to a function at once, beyond one text.
ARROW_KEY, ARROW_DEFAULT, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"
TEXT_BATCH = 4 << 20


def python_ready(spark: SparkSession) -> None:
    """Before Python stages: workers can import this package, and batches of whole texts stay small.

    The number of rows of a batch is a setting that Spark reads when the plan
    runs, so it can't be put back after the call: a session that still has the
    default of 10,000 is set to 1,000, one that was given a value keeps it.
    """
    ship_package(spark)
    if spark.conf.get(ARROW_KEY) == ARROW_DEFAULT:
        spark.conf.set(ARROW_KEY, ARROW_ROWS)


def per_text(df: DataFrame, text: Column, keep: list[str], fields: list[tuple[str, str]], work: Callable[[], Callable[[list], list[pa.Array]]], where: str | None = None) -> DataFrame:
    """Columns `keep` of df and one column per field, computed from the texts in Python.

    work() is called once a task and gives the function from texts to arrays.
    Kept columns travel as Arrow arrays that are passed on as they are, under
    names of their own inside, so no value changes its type (integers beside
    nulls stay exact) and no name can clash with the text's or the fields'.
    With `where` (a Boolean field) only rows for which it holds are returned,
    without the fields. Otherwise a field that is named like a kept column is
    an error.
    """
    names = [n for n, _ in fields]
    if where is None and set(names) & set(keep):
        raise ValueError(f"result columns {sorted(set(names) & set(keep))} would hide columns of the input: rename those first")
    python_ready(df.sparkSession)
    given = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], text.alias("t"))
    out = T.StructType(given.schema.fields[:-1] + ([] if where else [T.StructField(f"f{i}", T._parse_datatype_string(k)) for i, (_, k) in enumerate(fields)]))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = work()
        for b in batches:
            for part in text_slices(b, n):
                arrays = compute(part.column(n).to_pylist())
                if where is None:
                    yield pa.RecordBatch.from_arrays([*part.columns[:n], *arrays], names=out.names)
                else:
                    yield part.select(list(range(n))).filter(arrays[names.index(where)])

    got = given.mapInArrow(run, out)
    return got.toDF(*keep, *([] if where else names))


def text_slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in column `at` have about TEXT_BATCH bytes together."""
    if batch.num_rows < 2 or batch.column(at).nbytes <= TEXT_BATCH:
        yield batch
        return
    half = batch.num_rows // 2
    yield from text_slices(batch.slice(0, half), at)
    yield from text_slices(batch.slice(half), at)


def row_hash(df: DataFrame) -> Column:
    """128 bits that tell rows apart: a hash of all columns, twice. Equal rows have equal hashes."""
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    # a null doesn't change the running hash, so which columns are null is hashed too
    nulls = F.concat(*[F.col(f"`{f.name}`").isNull().cast("int").cast("string") for f in df.schema.fields])
    return F.struct(F.xxhash64(*columns, nulls).alias("a"), F.xxhash64(F.lit(1), *columns, nulls).alias("b"))


def word_count(text: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, modulus: int) -> Column:
    """Remainder of the CRC-32 of the id's decimal text; null ids have the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def hash_sample(df: DataFrame, key: Column, rows: int, bound: int, seed: int) -> DataFrame:
    """About `bound` of `rows` rows, chosen by a seeded hash of `key`, without a sort; all rows if fewer."""
    if rows <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(bound / rows * (1 << 30))))


#: Keys of rows are broadcast up to this many (about 50 bytes each); beyond it their join shuffles.
BROADCAST_KEYS = 1_000_000


def few(table: DataFrame, bound: int = BROADCAST_KEYS) -> DataFrame:
    """A written table with a broadcast hint if its counted rows are at most `bound`."""
    return F.broadcast(table) if table.count() <= bound else table


def without_rows(df: DataFrame, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """df without the rows whose `row_hash` is in gone (row); columns unchanged.

    Rows are told apart by all their columns, never by an id alone. Of equal
    rows with a hash in `once` (row) one stays. Both are written tables of
    distinct hashes, usually few beside the texts: while their counted number
    is small they are broadcast and no text is shuffled, but those of the rows
    in `once`. Column names that begin with two underscores are reserved.
    """
    out = df.withColumn("__row", row_hash(df)).join(few(gone.toDF("__gone")), F.col("__row") == F.col("__gone"), "left_anti")
    if once is not None and not once.isEmpty():
        ones, same = few(once.toDF("__one")), F.col("__row") == F.col("__one")
        one = out.join(ones, same, "left_semi").dropDuplicates(["__row"])
        out = out.join(ones, same, "left_anti").unionByName(one)
    return out.select(*[f"`{c}`" for c in df.columns])
