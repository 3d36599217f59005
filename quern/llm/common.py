"""Shared helpers: durable intermediates, skew-proof joins, Arrow batch slicing.

Intermediates that more than one branch reads are written as Parquet under the
folder named by ``spark.checkpoint.dir``, which every executor shares, so that a
lost executor never loses them.  Only where a session leaves that setting unset
(unit tests) is a folder chosen here.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ways a unique-keyed side is replicated so that one hot key is spread over as many tasks.
SALTS = 16
#: Rows of one key that a task may have, unless a corpus is so large that more than ``HOT_KEYS`` keys would have more.
HOT_ROWS, HOT_KEYS = 100_000, 4_096
#: Bytes of text that one NumPy step works on at a time.
SLICE_BYTES = 2 << 20

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediates; unset, a folder of its own in a local session, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quern-"))
    return _own_dir[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def documents(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the named columns, as doc_id and text, so that no other column can clash."""
    return df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"), *(df[c] for c in more))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(counts: DataFrame, on: Sequence[str], n: str, rows: int) -> DataFrame | None:
    """(on, __salts): the keys with so many of ``rows`` rows that one task should not have them all.

    ``counts`` has a row for each key with its number ``n`` of rows.  Fewer than
    ``HOT_KEYS`` keys can be hot, so these come to the driver and may be broadcast;
    None if there is none.
    """
    bound = max(HOT_ROWS, -(-rows // HOT_KEYS))
    hot = counts.where(F.col(n) > bound).select(*on, F.ceil(F.col(n) / bound).cast("int").alias("__salts"))
    found = hot.collect()
    return counts.sparkSession.createDataFrame(found, hot.schema) if found else None


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], salt: Column, how: str = "left", salts: int = SALTS, hot: DataFrame | None = None, measured: bool = False) -> DataFrame:
    """Join a side with hot keys to one with unique keys.

    ``salt`` is a stable hash of the big side's row.  With ``measured`` only the keys
    of ``hot``, see ``hot_keys``, are spread, each over as many tasks as it needs;
    without it every key's row of the small side is replicated ``salts`` times.
    """
    if measured and hot is None:
        return big.join(small, on, how)
    if measured:
        ways = F.coalesce("__salts", F.lit(1))
        left = big.join(F.broadcast(hot), on, "left").withColumn("__salt", F.pmod(salt, ways).cast("int")).drop("__salts")
        right = small.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), ways - 1))).drop("__salts")
    else:
        left = big.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int"))
        right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def slices(sizes: Sequence[int], limit: int = SLICE_BYTES, rows: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes and at most ``rows`` rows; a longer row is alone in its range."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > limit or i - start >= rows):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def field(df: DataFrame, name: str, alias: str | None = None) -> T.StructField:
    return T.StructField(alias or name, df.schema[name].dataType, True)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def hex64(column: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
