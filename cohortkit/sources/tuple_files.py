"""Dataset files of the original form: one JSON array of ``[html, page_type, summary]`` arrays per file.

A file of any size is read by many tasks: Spark's text reader splits it into blocks and cuts it at every ``]``, whatever white space stands
around. A cut is an element's end exactly if it stands outside of a string, that is if the number of unescaped quotes before it in the file is
even. Each block reports its parity and its number of ends under either parity at its beginning; a window over a file's blocks (one row each) gives
every block its state, and a window inside each block gives every cut its own. Elements of one piece, that is all without a ``]`` in their text,
are parsed where they are; the pieces of the others, which may go over a block's end, are put together by element.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("html", "page_type", "summary")


def write_tuple_files(samples: DataFrame, path: str) -> None:
    """Write (html, page_type, summary) as files of the original form, one per partition that holds rows."""
    elements = samples.select(F.to_json(F.array(*FIELDS)).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = "[", None
        for batch in batches:
            out = []
            for value in batch.column(0).to_pylist():
                if held is not None:
                    out.append(f"{before}{held},")
                    before = ""
                held = value
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([f"{before}{held}]"], pa.string())], names=["value"])

    elements.mapInArrow(run, "value string").write.text(path)


def _odd_quotes(text: Column) -> Column:
    """1 if the text holds an odd number of quotes that no backslash escapes."""
    bare = F.regexp_replace(text, r"(?s)\\.", "")
    return ((F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))) % 2).cast("long")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, value, odd): the text between two ``]``, in order by block and ``at``."""
    return spark.read.option("lineSep", "]").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value").withColumn("odd", _odd_quotes(F.col("value")))


def block_states(pieces: DataFrame) -> DataFrame:
    """(path, block, inside, ended): whether a block begins inside a string, and how many elements ended before it."""
    upto = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    per_block = pieces.select("path", "block", "at", "odd").withColumn("state", F.sum("odd").over(upto) % 2).groupBy("path", "block").agg(
        (F.sum("odd") % 2).alias("parity"), F.sum(1 - F.col("state")).alias("ends_outside"), F.sum("state").alias("ends_inside"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    states = per_block.withColumn("inside", F.coalesce(F.sum("parity").over(before) % 2, F.lit(0)))
    ends = F.when(F.col("inside") == 0, F.col("ends_outside")).otherwise(F.col("ends_inside"))
    return states.withColumn("ends", ends).select("path", "block", "inside", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("ended"))


def read_tuple_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, html, page_type, summary): the samples of the files under ``path``, with their place in the file.

    Elements without a value (``[]``) and text that is no array are left out; missing fields are null.
    """
    pieces = _pieces(spark, path)
    inside_block = Window.partitionBy("path", "block").orderBy("at")
    upto = inside_block.rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.join(block_states(pieces), ["path", "block"]).withColumn(
        "state", (F.col("inside") + F.sum("odd").over(upto)) % 2)
    placed = placed.withColumn("place", F.col("ended") + F.sum(1 - F.col("state")).over(upto) - (1 - F.col("state")))
    placed = placed.withColumn("whole", (F.col("state") == 0) & (F.col("odd") == 0))
    one = placed.where("whole").select("path", "place", "value")
    several = placed.where("NOT whole").groupBy("path", "place").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("s")).select(
        "path", "place", F.array_join(F.transform("s", lambda x: x["value"]), "]").alias("value"))
    # before its first string or value an element has brackets, commas and white space only
    text = F.concat(F.regexp_replace("value", r"^[\s,\[]*\[", "["), F.lit("]"))
    values = F.from_json(F.when(F.col("value").contains("["), text), "array<string>")
    found = one.unionByName(several).select("path", "place", values.alias("a")).where(F.size("a") > 0)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("place").cast("int").alias("place"),
                        *[F.get("a", F.lit(k)).alias(c) for k, c in enumerate(FIELDS)])
