"""Helpers shared by the corpus operators.

Text rules used everywhere: a null text counts as the empty text; words are
maximal runs of bytes outside space and \\t..\\r (``[^\\x20\\x09-\\x0D]+``), which on
UTF-8 bytes is the same as on code points; lower-casing touches A-Z only.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(WORD.encode())
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: A side of a join is broadcast only if its plan's estimate, for a materialized table
#: the size of its files, is at most this many bytes and a count finds at most so many
#: rows; above either the join shuffles both sides.
BROADCAST_BYTES = 24 << 20
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where a session on one machine names none (tests) a temporary folder is set as
    the checkpoint folder; on a cluster that is an error, since executors could not
    see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there.

    The files go when the session's JVM ends, or earlier with ``discard``.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    fs, path = _path(spark, folder)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    out._tessera_folder = folder
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``materialize`` returned and nothing reads any more."""
    fs, path = _path(df.sparkSession, df._tessera_folder)
    fs.delete(path, True)


def checked(small: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``small``, marked for broadcast if it has at most ``size`` bytes and ``rows`` rows.

    Give it materialized rows. A larger side is returned as it is and the join
    shuffles; adaptive execution then splits hot keys.
    """
    if int(str(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > size:
        return small
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def text_bytes(name: str = "text"):
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias("text")


def id_crc(name: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")))


def parts(df: DataFrame) -> int:
    """How many partitions a shuffle of ``df`` gets: the session's number."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 (two multiply-xorshift rounds)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root (smallest index) of each of ``n`` nodes under the links a-b, in memory."""
    root = np.arange(n)
    while a.size:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def labelled(labels: DataFrame, label: str, learn) -> DataFrame:
    """``(doc_id, label)`` of the rows a model may learn from; see sample_labels."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
    return rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def label_share(labels: DataFrame, label: str, learn) -> float | None:
    """Share of class 1 among all ids that sample_labels picks from; None without any."""
    return labelled(labels, label, learn).agg(F.avg("label")).first()[0]


def sample_labels(labels: DataFrame, label: str, learn, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class 0 and 1, picked by hash of the id.

    ``learn``: a condition on doc_id. Rows without id or label are left out; an id
    labelled twice counts once, with its larger label. The result has at most
    2 * per_class rows, so it may be broadcast.
    """
    rows = labelled(labels, label, learn)
    rows = rows.withColumn("h", F.xxhash64("doc_id"))
    some = [rows.where(F.col("label") == k).orderBy("h", "doc_id").limit(per_class) for k in (0, 1)]
    return F.broadcast(some[0].unionByName(some[1]).select("doc_id", "label"))
