"""What the text operators share: scratch storage, white space, row keys."""

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import functions as F

from ..session import shared_dir

#: The separators of a word: space and the five ASCII control spaces.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: One folder for each driver process; it goes when the process ends.
RUN = uuid.uuid4().hex
_ROOTS = set()


def scratch_dir(spark):
    """The folder all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local session gets one of its own; on a cluster that is an
    error, as no machine's own folder would do.
    """
    root = f"{shared_dir(spark)}/millrace-{RUN}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(remove, spark, root)
    return root


def remove(spark, path):
    """Delete a folder; never an error, for what is left does no harm."""
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm or SparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)


def scratch_path(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df, name):
    """Write a frame to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


#: Rows of ids and links that one task handles at once, and that may be broadcast.
ROWS = 1 << 18


def sized(df, rows=None):
    """A stored frame in as few partitions as its counted rows ask for, so that rounds over few rows are few tasks."""
    rows = df.count() if rows is None else rows
    out = df.coalesce(max(1, -(-rows // ROWS)))
    out._millrace_path, out._millrace_rows = df._millrace_path, rows
    return out


def beside(df, of=None):
    """A side of a join that is broadcast if it (or the sized frame `of`, which has no fewer rows) holds at most ROWS, and else left to the planner.

    The planner's own estimate of a join's size is the product of its sides.
    """
    rows = rows_of(df if of is None else of)
    return F.broadcast(df) if rows is not None and rows <= ROWS else df


#: Most bits of a broadcast bitmap (64 MB); more rows than it has room for only let more others pass.
BITS = 1 << 29


def among(df, nodes, rows):
    """The rows of `df` whose node is one of `nodes`, a frame of the one column node and at most `rows` rows.

    Where these are too many to be broadcast, a bitmap of 16 bits or more for each is sent
    first, so that hardly any other row, with all its text, is moved for the exact join.
    """
    if rows <= ROWS:
        return df.join(F.broadcast(nodes), "node", "left_semi")
    return likely(df, nodes, rows).join(nodes, "node", "left_semi")


def likely(df, nodes, rows):
    """The rows of `df` whose node is one of `nodes`, and few others."""
    place = F.pmod(F.xxhash64("node"), F.lit(min(BITS, 1 << (16 * rows - 1).bit_length())))
    set_bits = nodes.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(at, F.lit(8)))), F.lit(2))
    return df.join(F.broadcast(set_bits), F.bitmap_bucket_number(place) == F.col("_bucket")).where(bit == 1).drop("_bucket", "_bits")


def rows_of(df):
    """How many rows a sized frame has; None for other frames."""
    return vars(df).get("_millrace_rows")


def discard(*frames):
    """Delete stored frames that nothing still to be run reads."""
    for df in frames:
        remove(df.sparkSession, df._millrace_path)


def text_or_empty(col="text"):
    return F.coalesce(F.col(col), F.lit(""))


def row_key(*cols):
    """Two longs naming a row by its content, null-safe, so rows that repeat an id but not a text stay apart."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(1), *cols).alias("k2")]


def held_out(id_col="doc_id"):
    """Rows whose labels no model may learn from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def ship(spark):
    """Give the Python workers this package, once per context; executors need no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._millrace_shipped = True
