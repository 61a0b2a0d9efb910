"""Comparing the members of each group without ever holding a whole group in one task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, materialize, parts

#: Members of a group compared in one piece; larger groups are dealt out in salts.
CHUNK = 4096


def chunk_pairs(rows: DataFrame, key: str, ident: str, chunk: int = CHUNK) -> DataFrame:
    """Deal the members of each group ``key`` out to chunk pairs; every pair of members meets.

    A group of n members gets s = ceil(n / chunk) salts by hash of ``ident``; the
    member of salt k goes to the pairs (min(k, j), max(k, j)) for each j < s, so no
    piece has more than about two chunks of members. Adds ``__i`` <= ``__j`` (the
    piece) and ``__k`` (the member's own salt). Group sizes come from a counted
    aggregate; only groups above ``chunk`` are joined back.
    """
    big = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > chunk)
    big = checked(materialize(big.select(key, F.ceil(F.col("__n") / chunk).cast("int").alias("__s")), "big-groups"))
    rows = rows.join(big, key, "left").withColumn("__s", F.coalesce("__s", F.lit(1)))
    rows = rows.withColumn("__k", F.pmod(F.xxhash64(F.lit(7), ident), F.col("__s")).cast("int"))
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__s") - 1)))
    return rows.withColumn("__i", F.least("__k", "__o")).withColumn("__j", F.greatest("__k", "__o")).drop("__s", "__o")


def by_piece(rows: DataFrame, key: str, work, schema: str) -> DataFrame:
    """Run ``work(table) -> table`` over Arrow tables that hold whole pieces.

    Pieces (key, __i, __j) are hashed to partitions and sorted there; tables are cut
    at piece borders, so many small pieces share one call and none is split.
    """
    cols = [key, "__i", "__j"]
    rows = rows.repartition(parts(rows), *cols).sortWithinPartitions(*cols)
    types = rows.schema

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last piece of a batch may go on in the next one.
            k, i, j = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in cols)
            other = ((k != k[-1]) | (i != i[-1]) | (j != j[-1])).nonzero()[0]
            border = int(other[-1]) + 1 if other.size else 0
            if held and border == 0:
                a = held[-1]
                last = tuple(a.column(a.schema.get_field_index(c))[a.num_rows - 1].as_py() for c in cols)
                if last == (k[-1], i[-1], j[-1]):
                    held.append(batch)
                    continue
            if border:
                held.append(batch.slice(0, border))
            if held:
                yield from work(pa.Table.from_batches(held)).to_batches()
            held = [batch.slice(border)]
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    del types
    return rows.mapInArrow(run, schema)
