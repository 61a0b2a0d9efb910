"""Immutable shards with size-tiered compaction and an atomically committed manifest.

A table is a folder of Parquet shards and numbered manifests. A manifest lists the
live shards with rows, bytes and tier; the highest number is the table's state. Writing
one is a rename that fails where the number exists, so of two writers one commits and
the other tries again on the new state. Shards are never changed.

``append`` adds an arrival as small shards. ``compact`` merges: shards of similar size
(one tier, a factor FANOUT wide) are gathered into runs, and a run that FANOUT shards
or a full target make up becomes one larger shard, until shards reach the target. Each
merged shard is written by one task from its own inputs, without a shuffle.

A writer marks its folder as pending before it writes and unmarks it once its manifest is
committed, so ``vacuum`` leaves shards alone that are written but not committed yet.

Rows are stored as they are: null and empty texts, rows without an id and repeated rows
all come back, an empty table is a version without shards, and any column names will do.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, unused

FANOUT = 4
#: Size of the lowest tier and of finished shards, in bytes of Parquet.
SMALL = 4 << 20
TARGET = 128 << 20
#: Merged shards written by one Spark job.
JOB = 64
#: After so many hours a pending mark is taken for one of a writer that died.
PENDING_HOURS = 72


class ShardedTable:
    """The table in folder ``root`` of any file system that Spark can write.

    Committing needs a file system whose rename fails where the target exists (HDFS
    and local folders do; object stores need a committer of their own).
    """

    def __init__(self, spark: SparkSession, root: str, small: int = SMALL, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.root, self.small, self.target, self.fanout = spark, root.rstrip("/"), small, target, fanout
        self.jvm = spark.sparkContext._jvm
        self.hadoop = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.hadoop)

    def version(self) -> int:
        """Number of the newest manifest; 0 for a table without one."""
        folder = self._path("manifest")
        if not self._fs().exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``{"version", "shards": [{"path", "rows", "bytes", "tier"}], "schema"}``."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "shards": [], "schema": None}
        stream = self._fs().open(self._path(f"manifest/v{version:012d}.json"))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def commit(self, manifest: dict, based_on: int) -> bool:
        """Publish ``manifest`` as the version after ``based_on``; False if another writer did."""
        manifest = manifest | {"version": based_on + 1}
        draft, final = self._path(f"manifest/.draft-{uuid.uuid4().hex}"), self._path(f"manifest/v{based_on + 1:012d}.json")
        out = self._fs().create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.hadoop)
        none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            context.rename(draft, final, options)
        except Exception:
            self._fs().delete(draft, False)
            if self._fs().exists(final):
                return False
            raise
        return True

    def tier(self, size: int) -> int:
        """0 below ``small`` bytes, then one more for each factor ``fanout``."""
        k, bound = 0, self.small
        while size >= bound:
            k, bound = k + 1, bound * self.fanout
        return k

    def _mark(self) -> str:
        """A new data folder, marked as pending."""
        folder = uuid.uuid4().hex
        self._fs().create(self._path(f"pending/{folder}"), False).close()
        return folder

    def _unmark(self, shards: list[dict]) -> None:
        for folder in {s["path"].split("/")[1] for s in shards}:
            self._fs().delete(self._path(f"pending/{folder}"), False)

    def _write(self, df: DataFrame, by: str | None = None) -> dict[str, list[dict]]:
        """Write each partition of ``df`` as one shard; their entries, for each value of column ``by``."""
        folder = self._mark()
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/data/{folder}")
        sizes, files = {}, self._fs().listFiles(self._path(f"data/{folder}"), True)
        while files.hasNext():
            status = files.next()
            name = status.getPath().toString().rsplit(f"/{folder}/", 1)[-1]
            if name.rsplit("/", 1)[-1].startswith("part-"):
                sizes[name] = status.getLen()
        # Row counts come from the Parquet footers.
        counts = self.spark.read.parquet(f"{self.root}/data/{folder}").groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")) if sizes else None
        rows = {r.f.rsplit(f"/{folder}/", 1)[-1]: r.n for r in counts.toLocalIterator()} if sizes else {}
        out: dict[str, list[dict]] = {}
        for name, size in sorted(sizes.items()):
            if rows.get(name):
                out.setdefault(name.split("/")[0] if by else "", []).append({"path": f"data/{folder}/{name}", "rows": rows[name], "bytes": size, "tier": self.tier(size)})
        return out

    def _compare(self, known: str | None, schema) -> None:
        plain = lambda text: [(f["name"], f["type"]) for f in json.loads(text)["fields"]]
        if known and plain(known) != plain(schema.json()):
            raise ValueError("names or types of the columns differ from the table's")

    def _add(self, shards: list[dict], schema) -> int:
        while True:
            now = self.manifest()
            self._compare(now["schema"], schema)
            if self.commit({"schema": now["schema"] or schema.json(), "shards": now["shards"] + shards}, now["version"]):
                return now["version"] + 1

    def append(self, df: DataFrame) -> int:
        """Add the rows of ``df`` as small shards; the version that has them.

        Columns must have the table's names and types, else a ValueError comes before
        anything is written.
        """
        return self.append_each(df)[0]

    def append_each(self, df: DataFrame, by: str | None = None) -> list[int]:
        """Add arrivals, one for each value of column ``by``, each a version of its own, in one pass over ``df``.

        The column itself is not stored.
        """
        schema = df.drop(by).schema if by else df.schema
        self._compare(self.manifest()["schema"], schema)
        made = self._write(df, by)
        versions = [self._add(shards, schema) for _, shards in sorted(made.items())] or [self._add([], schema)]
        for shards in made.values():
            self._unmark(shards)
        return versions

    def plan(self, shards: list[dict], final: bool = False) -> list[list[dict]]:
        """Runs of shards to merge, each of one tier and at most about the target in size.

        Shards of a tier are taken in manifest order; a run closes at the target. Runs
        under the target wait until they have ``fanout`` shards, unless ``final``:
        then the rest of all tiers, smallest first, is gathered as well.
        """
        open_ = [s for s in shards if s["bytes"] < self.target // 2]
        tiers = sorted({s["tier"] for s in open_})
        groups = [open_] if final else [[s for s in open_ if s["tier"] == t] for t in tiers]
        runs = []
        for group in groups:
            run, size = [], 0
            for s in sorted(group, key=lambda s: s["bytes"]) if final else group:
                if run and size + s["bytes"] > self.target:
                    runs.append(run)
                    run, size = [], 0
                run.append(s)
                size += s["bytes"]
            if len(run) >= (2 if final else self.fanout):
                runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self, final: bool = False) -> int:
        """Merge until no run is left to merge; the version that is current then.

        ``final`` also gathers what is left of lower tiers into shards near the target.
        Replaced files stay for readers of older versions until ``vacuum``.
        """
        while True:
            now = self.manifest()
            runs = self.plan(now["shards"], final)[:JOB]
            if not runs:
                return now["version"]
            schema = self._schema(now)
            read = lambda run: self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['path']}" for s in run]).coalesce(1)
            made = self._write(reduce(DataFrame.union, map(read, runs))).get("", [])
            while True:
                now = self.manifest()
                old = {s["path"] for run in runs for s in run}
                if not old <= {s["path"] for s in now["shards"]}:
                    break  # another writer merged some of them: plan again
                left = [s for s in now["shards"] if s["path"] not in old]
                if self.commit({"schema": now["schema"], "shards": left + made}, now["version"]):
                    break
            self._unmark(made)

    def vacuum(self, versions: int = 1, pending_hours: float = PENDING_HOURS) -> None:
        """Delete shards that none of the newest ``versions`` lists, and older manifests.

        Older versions can't be read after that. Folders are listed before marks and
        marks before manifests: a folder without a mark was committed, so the manifest
        read last has it unless it was replaced since.
        """
        fs, data, pending = self._fs(), self._path("data"), self._path("pending")
        folders = {s.getPath().getName() for s in fs.listStatus(data)} if fs.exists(data) else set()
        since = (time.time() - pending_hours * 3600) * 1000
        for status in fs.listStatus(pending) if fs.exists(pending) else ():
            if status.getModificationTime() >= since:
                folders.discard(status.getPath().getName())
            else:
                fs.delete(status.getPath(), False)
        newest = self.version()
        kept = range(max(1, newest - versions + 1), newest + 1)
        live = {s["path"] for k in kept for s in self.manifest(k)["shards"]}
        for folder in folders:
            files, dead, left = fs.listFiles(self._path(f"data/{folder}"), True), [], 0
            while files.hasNext():
                path = files.next().getPath()
                name = f"data/{folder}/" + path.toString().rsplit(f"/{folder}/", 1)[-1]
                if name in live:
                    left += 1
                elif path.getName().startswith("part-"):
                    dead.append(path)
            if not left:
                fs.delete(self._path(f"data/{folder}"), True)
            for path in dead if left else ():
                fs.delete(path, False)
        names = {f"v{k:012d}.json" for k in kept}
        for status in fs.listStatus(self._path("manifest")) if newest else ():
            if status.getPath().getName().startswith("v") and status.getPath().getName() not in names:
                fs.delete(status.getPath(), False)

    def _schema(self, manifest: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(manifest["schema"]))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; a table never written is an error, one without rows is empty."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError(f"no table at {self.root}")
        schema = self._schema(now)
        if not now["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['path']}" for s in now["shards"]])


ARRIVALS = 4


def arrival(ident: str = "doc_id"):
    """Which of ARRIVALS a row comes with, by md5 of its id; a null id counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(ident).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % ARRIVALS


def op4_size_tiered(spark, sf_dir: str) -> DataFrame:
    """documents in ARRIVALS arrivals, compacted after: one row per document with its shard.

    Returns doc_id, arrival, text_sha256, shard (number in the manifest), shard_rows,
    shard_bytes, tier and version; the rows are those read back from the shards.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = ShardedTable(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    (column,) = unused(docs, "arrival")
    table.append_each(docs.withColumn(column, arrival()), column)
    table.compact()
    table.compact(final=True)
    table.vacuum()
    now = table.manifest()
    entries = [(s["path"].rsplit("/", 1)[-1], k, s["rows"], s["bytes"], s["tier"], now["version"]) for k, s in enumerate(now["shards"])]
    # One row a shard: as many as the table has bytes / target, and some that wait for their tier.
    listed = spark.createDataFrame(entries, "name string, shard long, shard_rows long, shard_bytes long, tier int, version long")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = table.read().select("doc_id", arrival().alias("arrival"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), name.alias("name"))
    return rows.join(F.broadcast(listed), "name").drop("name")
