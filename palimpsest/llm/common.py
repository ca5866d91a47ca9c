"""Small things that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: What a word is made of: everything but ASCII white space. bytes.split() cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a session on one machine gets a folder of our own; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and a lost executor costs no recomputation.

    The table is deleted when the application ends; its readers may be lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/palimpsest-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


#: The bytes up to which a table of a known number of rows is broadcast, and what a row of it may take.
BROADCAST, ROW = 64 << 20, 64


def hinted(small: DataFrame, rows: int) -> DataFrame:
    """small, which has `rows` rows of ROW bytes at most, broadcast if that is little enough."""
    return F.broadcast(small) if rows * ROW <= BROADCAST else small


#: Plans whose rows keep their order and partitions however often they are evaluated.
_STEADY = {"LogicalRelation", "Relation", "LocalRelation", "LogicalRDD", "Project", "Filter"}


def steady(df: DataFrame) -> DataFrame:
    """df, or a table of it if another evaluation (a second use, a lost executor) might deal its rows in another order, as after a shuffle."""
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in _STEADY and not node.nodeName().startswith("Scan"):
            return cut(df)
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return df


def discard(spark: SparkSession, tables: list[DataFrame]) -> None:
    """Deletes tables that cut() made and nothing reads any more, and lets Spark drop the shuffles of what is out of reach."""
    import gc

    jvm = spark.sparkContext._jvm
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def give_back() -> None:
    """Returns freed memory to the system: Python workers are reused by later stages and stand beside the executor's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def over_batches(make):
    """make(batches) for mapInArrow, tidied up after."""

    def run(batches):
        yield from make(batches)
        give_back()

    return run


def over_group(make):
    """make(table) for applyInArrow, tidied up after."""

    def run(table):
        out = make(table)
        give_back()
        return out

    return run


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column."""
    return int(df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


def buckets_for(size: int, each: int = 8 << 20, least: int = 16) -> int:
    """How many hash buckets keep a bucket's share of `size` bytes near `each`."""
    return max(least, -(-size // each))


def add_columns(df: DataFrame, fields: str, make, column: str = "text", also: tuple[str, ...] = (), piece: int = 3 << 20) -> DataFrame:
    """df with the columns of `fields` (DDL), which replace any of the same names.

    make(texts, *others) gets a pyarrow binary array of `column` (null: empty) and the arrays of `also`, in pieces of about `piece` bytes, and returns one
    pyarrow array for each field. Other columns pass through as Arrow buffers; Python never touches them.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(fields)
    rest = [f for f in df.schema.fields if f.name not in new.fieldNames()]
    schema = StructType(rest + new.fields)
    arrow, at = to_arrow_schema(schema), [df.columns.index(f.name) for f in rest]
    text_at, also_at = df.columns.index(column), [df.columns.index(c) for c in also]

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(text_at).cast(pa.large_binary()), b"")
            ends = pc.cumulative_sum(pc.binary_length(texts)).to_numpy(zero_copy_only=False)
            start = 0
            while start < len(texts):
                base = ends[start - 1] if start else 0
                end = max(start + 1, int(ends.searchsorted(base + piece, "right")))
                made = make(texts.slice(start, end - start), *[batch.column(i).slice(start, end - start) for i in also_at])
                old = [batch.column(i).slice(start, end - start).cast(arrow.field(k).type) for k, i in enumerate(at)]
                yield pa.RecordBatch.from_arrays([*old, *[m.cast(arrow.field(len(at) + k).type) for k, m in enumerate(made)]], schema=arrow)
                start = end

    return df.mapInArrow(over_batches(run), schema)


def ship(spark: SparkSession) -> None:
    """Lets Python workers that this session starts import the package from where it is here; a cluster gets it by --py-files or its image."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
