"""Shared helpers of the training-data operators: tables, shared scratch folders, hashing."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cairnlog.sources.scratch import shared_root

#: White space of the word contract: space, \t, \n, \v, \f and \r.
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile("[^ \t\n\x0b\x0c\r]+")
#: Characters that str.split() takes for white space and the word contract does not.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, pruned to the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/cairnlog-{uuid.uuid4().hex}/{name}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Spark's file system, if the session is still alive."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path).getParent()
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have gone before the interpreter
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes to the shared folder and reads back: cuts lineage with a copy that outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df.scratch_path)


def join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left.join(right, on, how) by sorting, for tables that grow with the rows. Spark takes the size of a table from its
    compressed files and counts an array as one element, so it may broadcast through the driver what is far too large."""
    return left.join(right.hint("merge"), on, how)


def with_columns(schema: StructType, ddl: str) -> StructType:
    """`schema` and the columns of `ddl`; names are never spliced into DDL, so they may hold any character."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z only."""
    return text.encode().lower().decode()


def words(text: str | None) -> list[str]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text."""
    if not text:
        return []
    return WORD.findall(text) if _ODD.search(text) else text.split()


def fold(doc_id, modulus: int):
    """crc32(doc_id as text) mod `modulus`, as a column."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def labelled_sample(labels: DataFrame, label: str, per_class: int, where=None) -> DataFrame:
    """(doc_id, y) of at most `per_class` labelled documents for each of 0 and 1, the first by a hash of doc_id.

    One label a document (the largest, if there are several); null ids and null labels are left out.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    first = lambda y: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return first(1).unionByName(first(0))


def sample_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(y, text) of the sampled documents: one row a doc_id, the least of its texts if it has several."""
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # a sample's size is a parameter
    return joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("y", "text")


def blank(column: str) -> Column:
    """Whether a text is null or has no word."""
    return F.length(F.translate(F.coalesce(F.col(column), F.lit("")), SPACE, "")) == 0


def map_arrow(df: DataFrame, run, schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any name, such as ones with dots or backquotes: `run` works by position."""
    short = lambda names: [f"c{k}" for k, _ in enumerate(names)]
    plain = StructType([StructField(n, f.dataType) for n, f in zip(short(schema.fields), schema.fields, strict=True)])
    return df.toDF(*short(df.columns)).mapInArrow(run, plain).toDF(*schema.names)


def columns(df: DataFrame) -> list[Column]:
    """All columns of `df`, whatever their names."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in df.columns]
