"""Shared folder, staged tables and the text conventions all operators use."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a run of anything but these characters; Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
EDGES = " \t\n\x0b\x0c\r"

_own: list[str] = []
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local session that names none, as in tests, gets a temporary folder of this
    process; on a cluster no local folder can take its place, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="planisphere-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def stage(df: DataFrame, name: str, partition_by: str | None = None, buckets: tuple[str, ...] = (), onto: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    Cuts the lineage so that a lost executor costs no more than the files it was
    writing, and gives Catalyst the table's real size for its join choices. With
    `buckets` the table is dealt by the hash of these columns into as many buckets as
    shuffles have partitions, sorted in each, so that joins and sums by these columns
    read it without a shuffle; `onto`, a table staged so before, gets the rows added (a
    union of such tables would lose their dealing). `discard` deletes a staged table.
    """
    spark, token = df.sparkSession, uuid.uuid4().hex
    path, entry = _paths.pop(onto) if onto is not None else (f"{shared_dir(spark)}/staged/{token}/{name}", f"staged_{token}")
    writer = df.write.mode("append" if onto is not None else "error")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if buckets:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        writer.bucketBy(n, *buckets).sortBy(*buckets).option("path", path).saveAsTable(entry)
        out = spark.table(entry)
    else:
        writer.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = (path, entry if buckets else None)
    return out


def discard(*staged: DataFrame) -> None:
    """Delete tables that `stage` returned and nothing will read again."""
    for df in staged:
        path, table = _paths.pop(df, (None, None))
        if table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        if path:
            jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def let(value: Column, body) -> Column:
    """body(value) with value worked out once for a row.

    A lambda that used the expression itself would work it out for each element, and the
    optimizer can bring that about by inlining a column into a filter.
    """
    return F.transform(F.array(value), body)[0]


_PER_BLOCK, _LEVELS = 48, 3


def before(lengths: Column, levels: int = _LEVELS) -> Column:
    """For each element of an array of numbers, the sum of all elements before it.

    A lambda cannot carry a sum along, so elements are summed in blocks, and the blocks'
    sums in blocks again: linear in the array's length up to 48^3 elements, and a
    hundred-thousandth of the square beyond.
    """
    zero = F.lit(0).cast("long")
    plain = lambda xs: F.transform(xs, lambda _, i: F.aggregate(F.slice(xs, 1, i), zero, lambda a, x: a + x))
    if levels <= 1:
        return let(lengths, plain)

    def of(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(_PER_BLOCK)), lambda at: F.slice(xs, at, F.lit(_PER_BLOCK)))

        def placed(b: Column) -> Column:
            starts = before(F.transform(b, lambda x: F.aggregate(x, zero, lambda a, v: a + v)), levels - 1)
            return let(starts, lambda st: F.flatten(F.transform(b, lambda x, k: F.transform(plain(x), lambda y: y + st[k]))))

        return F.when(F.size(xs) <= _PER_BLOCK, plain(xs)).otherwise(let(blocks, placed))

    return let(lengths, of)


def text_key(text: Column) -> Column:
    """128 bits of hash that stand for a text; null is the empty text."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit("second"), t).alias("b"))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(EDGES))


def words(text: Column) -> Column:
    """The words of a text, in order; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    return F.filter(parts, lambda w: w != "")


def n_words(text: Column) -> Column:
    """size(words(text)) without building the words: blanks are counted at word ends."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, GAP))).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels must not be learned: crc32(doc_id as text) mod 4 is 2 (null: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
