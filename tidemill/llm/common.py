"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Characters that separate words; everything else belongs to a word.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Broadcast a table only if it has been counted and has at most so many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of the session; a private one only in a local session (tests) that names none."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemill-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _row_bytes(schema: StructType) -> Column:
    """About how many bytes a row takes: eight for each plain value, the length of what is longer."""

    def of(value: Column, kind: DataType) -> Column:
        if isinstance(kind, StringType | BinaryType):
            return F.coalesce(F.octet_length(value), F.lit(0)) + 16
        if isinstance(kind, ArrayType):
            inner = kind.elementType
            if isinstance(inner, StringType | BinaryType | ArrayType | StructType):
                return F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(16), lambda n, x: n + of(x, inner).cast("int"))
            return F.coalesce(F.greatest(F.size(value), F.lit(0)), F.lit(0)) * 8 + 16
        if isinstance(kind, StructType):
            return sum((of(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
        return F.lit(8)

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields), F.lit(8))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a (cheap to compute) table for broadcast if its rows and bytes allow it; joins shuffle otherwise."""
    found = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(_row_bytes(df.schema)), F.lit(0))).first()
    return F.broadcast(df) if found[0] <= rows and found[1] <= size else df


def aside(docs: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """All columns of a table; those that are named like a result get `_input` behind their name, as often as needed."""
    taken = {c.lower() for c in (*docs.columns, *names)}
    out = []
    for c in docs.columns:
        name = c
        if c.lower() in {n.lower() for n in names}:
            while name.lower() in taken:
                name += "_input"
            taken.add(name.lower())
        out.append(F.col(f"`{c}`").alias(name))
    return out


def let(value: Column, body) -> Column:
    """Bind a value to a name inside an expression, so that it is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array of strings; empty for null and blank texts."""
    stripped = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(stripped), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.split(stripped, SPACE_CLASS + "+")
    )


def word_count(text: Column) -> Column:
    """Number of words; 0 for null and blank texts."""
    stripped = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(stripped), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.size(F.split(stripped, SPACE_CLASS + "+"))
    ).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def with_row_key(docs: DataFrame, id_col: str = "doc_id", key: str = "_tm_row") -> DataFrame:
    """Add a long column that tells rows apart and stands in the order of the id.

    A unique integer id serves as it is. Otherwise (null or repeated ids, other types) rows are
    sorted by id, nulls last, and then by their place in the table; their numbers are written to the
    shared folder, so that they survive a lost executor.
    """
    kind = dict(docs.dtypes)[id_col]
    if kind in ("bigint", "int", "smallint", "tinyint"):
        odd = docs.groupBy(F.col(id_col)).count().filter(F.col(id_col).isNull() | (F.col("count") > 1))
        if odd.limit(1).count() == 0:
            return docs.withColumn(key, F.col(id_col).cast("long"))
    order = [F.col(id_col).asc_nulls_last(), F.col(key)]
    placed = docs.withColumn(key, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(placed.withColumn(key, F.monotonically_increasing_id()))
