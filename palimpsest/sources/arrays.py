"""Files that are one JSON array of objects each, of any size: executors read them in splits, and no task holds more than a batch and a record.

Text is read in pieces that end at each }. Whether such a } is outside strings, and which depth it leaves, follows from all text before, so a first pass tells of each split, for both states it may begin in (outside and
inside a string), how it changes strings and depth, and how many } leave which depth; sums over a file's splits, a row each, then say how each split really begins. The second pass cuts the elements, and those few that lie
across splits are put together by number. An element counts only if it is one object by the strict parser, and if nothing but the array's own brackets and commas is between elements, so what is taken is the file's whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.config import ConfigError
from ..plans.files import settled

SPLIT = ("file", "block", "bytes")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    m = lambda c: F.col(f"_metadata.{c}")
    return spark.read.text(path, lineSep="}").select(m("file_path").alias("file"), m("file_block_start").alias("block"), m("file_block_length").alias("bytes"), F.col("value").cast("binary").alias("value"))


def heads(spark: SparkSession, path: str) -> DataFrame:
    """file, its first character that is no white space, and its size: bytes, and one more if it does not end with a comma."""
    text = spark.read.text(path, lineSep=",").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    first = F.min_by(F.when(F.col("block") == 0, F.left(F.regexp_replace("value", r"^\s+", ""), F.lit(1))), F.when(F.col("block") == 0, F.col("id")))
    return text.groupBy("file").agg(first.alias("head"), F.sum(F.octet_length("value") + 1).alias("size"))


def _lexer():
    """What both passes share; built where it is used, so that executors need nothing but the function."""
    import re

    import numpy as np

    escape = re.compile(rb"\\[^}]")
    kinds, weight = np.zeros(256, np.uint8), np.array([0, 0, 1, -1, -1])
    for n, chars in enumerate((b'"', b"{[", b"]", b"}"), 1):
        kinds[list(chars)] = n

    def runs(batch, keys: int):
        """(split, values): pieces of a batch that lie in one split, 4 MB or a piece at a time."""
        n, column = batch.num_rows, batch.column(keys).to_pylist()
        named = list(zip(*[batch.column(i).to_pylist() for i in range(keys)], strict=True))
        at = size = 0
        for i in range(1, n + 1):
            size += len(column[i - 1])
            if i == n or size > 4 << 20 or named[i] != named[at]:
                yield named[at], column[at:i]
                at, size = i, 0

    def walk(values: list, odd: int, depth: int):
        """After each of values, which a } follows: whether that is in a string, and the depth that it leaves."""
        text = b"}".join(values) + b"}"
        if b"\\" in text:
            text = escape.sub(b"xx", text)
        marks = kinds[np.frombuffer(text, np.uint8)]
        marks = marks[marks > 0]
        inside = (np.cumsum(marks == 1) + odd) & 1
        depths = depth + np.cumsum(np.where(inside == 0, weight[marks], 0))
        # No } is escaped in JSON; where one is, it stays the end of its piece, and the parser refuses the element.
        ends = marks == 4
        return inside[ends], depths[ends]

    return runs, walk


def _spans():
    """Of each split, for a begin outside and inside a string: whether it has an odd number of quotes, by how much the depth changes, how many } leave which depth; and its size."""
    lexer = _lexer

    def run(batches):
        import numpy as np
        import pyarrow as pa

        runs, walk = lexer()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.int64(), pa.int64()), pa.map_(pa.int64(), pa.int64()), pa.int64()]
        names = ["file", "block", "bytes", "odd", "rise_0", "rise_1", "ends_0", "ends_1", "size"]
        split = None
        said = lambda: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([*split, odd, *rise, *[list(x.items()) for x in ends], size], kinds, strict=True)], names=names)
        for batch in batches:
            for own, values in runs(batch, 3):
                if own != split:
                    if split is not None:
                        yield said()
                    split, odd, rise, ends, size = own, 0, [0, 0], [{}, {}], 0
                size += sum(map(len, values)) + len(values)
                for begin in (0, 1):
                    inside, depths = walk(values, odd ^ begin, rise[begin])
                    for d, n in zip(*(x.tolist() for x in np.unique(depths[inside == 0], return_counts=True)), strict=True):
                        ends[begin][d] = ends[begin].get(d, 0) + n
                    rise[begin] = int(depths[-1])
                odd = int(inside[-1]) ^ 1
        if split is not None:
            yield said()

    return run


def _cut():
    """Elements by file and number, and what a split has of an element that begins before it or ends after it (whole is false): pieces with the } that follow them."""
    lexer = _lexer

    def run(batches):
        import numpy as np
        import pyarrow as pa

        runs, walk = lexer()
        kinds, names = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()], ["file", "block", "row", "whole", "text"]

        def made(first, flags, texts):
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([[split[0]] * n, [split[1]] * n, range(first, first + n), flags, texts], kinds, strict=True)], names=names)

        split, held = None, []
        for batch in batches:
            for own, values in runs(batch, 6):
                if own != split:
                    if held:
                        yield made(row, [False], [b"}".join(held) + b"}"])
                    split, held, (odd, depth, row) = own, [], own[3:]
                    # It begins within an element unless the split before ended with one.
                    whole = own[1] == 0 or (odd == 0 and depth == 1)
                inside, depths = walk(values, odd, depth)
                odd, depth, at, texts = int(inside[-1]), int(depths[-1]), 0, []
                for end in np.flatnonzero((inside == 0) & (depths == 1)).tolist():
                    texts.append(b"}".join([*held, *values[at : end + 1]]) + b"}")
                    held, at = [], end + 1
                held += values[at:]
                if texts:
                    yield made(row, [whole] + [True] * (len(texts) - 1), texts)
                    row, whole = row + len(texts), True
        if held:
            yield made(row, [False], [b"}".join(held) + b"}"])

    return run


def elements(spark: SparkSession, path: str) -> DataFrame:
    """file, row (from 0), text: the elements of each file's array with what stands before them. A file that cannot be an array of objects is an error; whether each element is an object shows when it is parsed."""
    spans = settled(_pieces(spark, path).mapInArrow(_spans(), "file string, block bigint, bytes bigint, odd bigint, rise_0 bigint, rise_1 bigint, ends_0 map<bigint,bigint>, ends_1 map<bigint,bigint>, size bigint"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("bigint"))
    begun = spans.withColumn("odd_in", so_far("odd") % 2)
    begun = begun.withColumns({c: F.when(F.col("odd_in") == 0, F.col(f"{c}_0")).otherwise(F.col(f"{c}_1")) for c in ("rise", "ends")}).withColumn("depth_in", so_far("rise"))
    begun = begun.withColumn("n", F.coalesce(F.element_at("ends", 1 - F.col("depth_in")), F.lit(0).cast("bigint"))).withColumn("row_in", so_far("n"))
    begun = settled(begun.select(*SPLIT, "odd", "rise", "n", "odd_in", "depth_in", "row_in", "size"))
    # The } that ends no piece, after the last, leaves -1. What ends with a } lacks that piece, and its size is by one less than by commas.
    files = settled(begun.groupBy("file").agg((F.sum("odd") % 2).alias("odd"), F.sum("rise").alias("depth"), F.sum("n").alias("elements"), F.sum("size").alias("size")))
    told = files.join(heads(spark, path).withColumnRenamed("size", "by_commas"), "file", "left")
    _refuse(told.where((F.col("odd") != 0) | (F.col("depth") != -1) | (F.coalesce("by_commas", "size") - F.col("size") == 1)))
    # A row for each split is sent to all. A split that the first pass did not have is an error, not a loss.
    lost = F.raise_error(F.concat(F.lit("read in other splits meanwhile: "), F.col("file"))).cast("bigint")
    cut = _pieces(spark, path).join(F.broadcast(begun.select(*SPLIT, "odd_in", "depth_in", "row_in")), list(SPLIT), "left").select(*SPLIT, F.coalesce("odd_in", lost).alias("odd_in"), "depth_in", "row_in", "value")
    cut = settled(cut.select(*SPLIT, "odd_in", "depth_in", "row_in", "value").mapInArrow(_cut(), "file string, block bigint, row bigint, whole boolean, text binary").withColumn("text", F.col("text").cast("string")))
    joined = cut.where("not whole").groupBy("file", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"))
    joined = joined.join(files.select("file", "elements"), "file")
    # What follows the last element, and the } that does not.
    empty = F.when(F.col("elements") == 0, F.col("text").rlike(r"^[ \t\r\n]*\[[ \t\r\n]*\][ \t\r\n]*\}\z")).otherwise(F.col("text").rlike(r"^[ \t\r\n]*\][ \t\r\n]*\}\z"))
    _refuse(joined.where((F.col("row") == F.col("elements")) & ~empty))
    # Written without what follows the last element: a caller's filter, which parses, may be moved before any other.
    across = settled(joined.where(F.col("row") < F.col("elements")).select("file", "row", "text"))
    return cut.where("whole").select("file", "row", "text").unionByName(across)


def _refuse(wrong: DataFrame) -> None:
    found = wrong.select("file").limit(1).collect()
    if found:
        raise ConfigError(f"not one array of objects: {found[0][0]}")
