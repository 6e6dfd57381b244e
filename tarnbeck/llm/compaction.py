"""Sharding by size-tiered compaction.  DataFrame writes and reads only.

A store is a folder: ``data/`` holds immutable parquet shards, ``tables/`` the lists of live shards,
``manifests/v<N>`` a one-line file that names the list of version N.  An arrival is appended as small
shards, without a shuffle.  Shards below the target size fall into tiers by powers of ``fanout``; a tier
with ``fanout`` shards at least is merged into files of up to the target size, each by one task that reads
its shards one after another (again no shuffle, so no key can be hot), many of them at once.

A version becomes visible when its one-line file takes its name, which fails if the name is taken: by a
hard link on a local file system, by a rename without overwriting elsewhere (atomic on HDFS).  The loser of
a race starts again from the new version.  Readers keep the version that they began with.

A writer holds a lease, a file in ``leases/``, from before its first shard until its commit.  ``vacuum``
removes shards that no kept version names and whose writer holds no lease; it lists the data first, the
leases next and reads the versions last, so shards are under a lease or in a version whenever it looks.
What the version that a writer began with names is kept too.  A lease older than ``grace`` seconds is
that of a writer that died.

The driver holds the paths of the live shards while it plans a scan or a merge, as Spark does for any scan
of files: one for each ``target_bytes`` once they are compacted.
"""

from __future__ import annotations

import os
import time
import uuid
from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import passing, work_path

MANIFEST = "path string, bytes long, n_rows long, min_id long, max_id long, merged int, added long"
TARGET_BYTES = 128 << 20
GROUPS_A_JOB = 64
GRACE = 24 * 3600.0  # seconds


class Store:
    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", target_bytes: int = TARGET_BYTES, fanout: int = 4, least_bytes: int = 1 << 20, rows_a_shard: int = 4096):
        self.spark, self.path, self.id_col = spark, path.rstrip("/"), id_col
        self.target, self.fanout, self.least, self.rows = target_bytes, fanout, least_bytes, rows_a_shard
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.conf)

    def version(self) -> int:
        """The newest committed version; 0 for an empty store."""
        at = self._path("manifests")
        if not self._fs().exists(at):
            return 0
        names = [x.getPath().getName() for x in self._fs().listStatus(at)]
        return max([0, *(int(n[1:]) for n in names if n.startswith("v"))])

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/tables/{self._table(version)}")

    def _table(self, version: int) -> str:
        return self._get("manifests", f"v{version:08d}")

    def _get(self, *parts: str) -> str:
        source = self._fs().open(self._path(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8").strip()
        finally:
            source.close()

    def _put(self, text: str, *parts: str) -> None:
        out = self._fs().create(self._path(*parts), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def commit(self, base: int, live: DataFrame) -> bool:
        """Publish ``live`` as version ``base + 1``; False if that version exists by now."""
        name, fs = uuid.uuid4().hex, self._fs()
        live.coalesce(self.spark.sparkContext.defaultParallelism).write.parquet(f"{self.path}/tables/{name}")
        fs.mkdirs(self._path("manifests"))
        self._put(name, "staging", name)
        if self._publish(self._path("staging", name), self._path("manifests", f"v{base + 1:08d}")):
            return True
        if self.version() <= base:
            raise RuntimeError(f"version {base + 1} could not be written")
        fs.delete(self._path("tables", name), True)
        fs.delete(self._path("staging", name), False)
        return False

    def _publish(self, made, to) -> bool:
        """Give a file its name in one step, unless the name is taken."""
        made, to = self._fs().makeQualified(made), self._fs().makeQualified(to)
        if to.toUri().getScheme() == "file":
            try:
                os.link(*(unquote(urlsplit(x.toUri().toString()).path) for x in (made, to)))
            except FileExistsError:
                return False
            self._fs().delete(made, False)
            return True
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.conf)
        how = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(made, to, how)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            return False

    def _lease(self) -> str:
        name = uuid.uuid4().hex
        self._put(str(self.version()), "leases", name)
        return name

    def _release(self, name: str) -> None:
        self._fs().delete(self._path("leases", name), False)

    def _write(self, df: DataFrame, lease: str, merged: int, added: int, **options) -> DataFrame:
        """Write shards; their manifest rows, read back from the files' own statistics and ids."""
        folder = f"{self.path}/data/{lease}-{uuid.uuid4().hex}"
        df.write.options(compression="zstd", **options).parquet(folder)
        rows = self.spark.read.schema(df.schema).parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col(self.id_col).cast("long").alias("id"))
        return rows.groupBy("path", "bytes").agg(F.count("*").alias("n_rows"), F.min("id").alias("min_id"), F.max("id").alias("max_id")).withColumn("merged", F.lit(merged)).withColumn("added", F.lit(added).cast("long"))

    def append(self, df: DataFrame) -> int:
        """Add an arrival as small shards; the new version (the old one if the arrival has no rows)."""
        lease, new = self._lease(), None
        try:
            while True:
                base = self.version()
                new = self._write(df, lease, 0, base + 1, maxRecordsPerFile=self.rows) if new is None else new
                if new.isEmpty():
                    return base
                if self.commit(base, self.manifest(base).unionByName(new.withColumn("added", F.lit(base + 1).cast("long")))):
                    return base + 1
        finally:
            self._release(lease)

    def plan(self, version: int) -> DataFrame:
        """``path, tier, part``: which shards are merged together."""
        small = self.manifest(version).where(F.col("bytes") < self.target / 2)
        tier = F.floor(F.log(float(self.fanout), F.greatest(F.col("bytes") / self.least, F.lit(1.0))))
        small = small.withColumn("tier", tier.cast("int"))
        full = small.groupBy("tier").count().where(F.col("count") >= self.fanout).select("tier")
        small = small.join(full, "tier", "left_semi")
        so_far = F.sum("bytes").over(Window.partitionBy("tier").orderBy("min_id", "path"))
        return small.withColumn("part", F.floor((so_far - F.col("bytes")) / self.target).cast("long")).select("path", "tier", "part")

    def compact(self, schema) -> int:
        """Merge tiers until none has ``fanout`` shards; the newest version.  ``schema``: of the rows."""
        while True:
            base = self.version()
            plan = self.plan(base).groupBy("tier", "part").agg(F.sort_array(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1).orderBy("tier", "part").collect()
            if not plan:
                return base
            lease = self._lease()
            try:
                gone, made = [p for r in plan for p in r["paths"]], None
                for at in range(0, len(plan), GROUPS_A_JOB):
                    files = [self.spark.read.schema(schema).parquet(*r["paths"]).coalesce(1) for r in plan[at : at + GROUPS_A_JOB]]
                    one = self._write(reduce(DataFrame.union, files), lease, 1, base + 1)
                    made = one if made is None else made.unionByName(one)
                old = self.manifest(base).join(self.spark.createDataFrame([(p,) for p in gone], "path string"), "path", "left_anti")
                self.commit(base, old.select(*made.columns).unionByName(made))
            finally:
                self._release(lease)

    def read(self, schema, version: int | None = None, shard: str = "_shard") -> DataFrame:
        """The rows of a version, with the file that each is in as column ``shard``."""
        paths = [r["path"] for r in self.manifest(version).select("path").orderBy("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn(shard, F.lit(None).cast("string"))
        return self.spark.read.schema(schema).parquet(*paths).withColumn(shard, F.col("_metadata.file_path"))

    def _names(self, *parts: str) -> list[str]:
        at = self._path(*parts)
        return [x.getPath().getName() for x in self._fs().listStatus(at)] if self._fs().exists(at) else []

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> None:
        """Remove data files that none of the newest ``keep`` versions names and no writer is about to name, and older versions."""
        fs = self._fs()
        folders = self._names("data")
        held = {n for n in self._names("leases") if not n.startswith(".") and self._age(n) < grace}
        newest = self.version()
        oldest = max(1, min([newest - keep + 1, *(self._begun(n, newest) for n in held)]))
        kept = [v for v in range(oldest, newest + 1) if fs.exists(self._path("manifests", f"v{v:08d}"))]
        live = {r["path"].rsplit("/data/", 1)[1] for v in kept for r in self.manifest(v).select("path").collect()}
        for name in folders:
            if name.split("-")[0] in held:
                continue
            files = self._names("data", name)
            if not any(f"{name}/{f}" in live for f in files):
                fs.delete(self._path("data", name), True)
                continue
            for f in files:
                if f.startswith("part-") and f"{name}/{f}" not in live:
                    fs.delete(self._path("data", name, f), False)
        for v in range(1, oldest):
            if fs.exists(self._path("manifests", f"v{v:08d}")):
                table = self._table(v)
                fs.delete(self._path("manifests", f"v{v:08d}"), False)
                fs.delete(self._path("tables", table), True)

    def _begun(self, lease: str, newest: int) -> int:
        """The version that a lease's writer began with (the newest, if it is done by now)."""
        return int(self._get("leases", lease) or 0) if self._fs().exists(self._path("leases", lease)) else newest

    def _age(self, lease: str) -> float:
        at = self._path("leases", lease)
        return time.time() - self._fs().getFileStatus(at).getModificationTime() / 1000 if self._fs().exists(at) else 0.0


def compact_arrivals(docs: DataFrame, id_col: str = "doc_id", arrivals: int = 4, path: str | None = None, **sizes) -> DataFrame:
    """Append ``docs`` in ``arrivals`` ranges of ids, compacting after each; the rows of the newest version.

    All columns of ``docs``, and ``shard_rows, shard_bytes, shard_merged, shard_min_id, shard_max_id``
    (which replace columns of these names) of the file that each row ended up in.  Rows with a null id
    come with the first arrival; repeated rows stay repeated; a row is never cut, so a very long text makes
    its shard larger than the target; an empty table gives no rows.
    """
    spark = docs.sparkSession
    about = {"n_rows": "shard_rows", "bytes": "shard_bytes", "merged": "shard_merged", "min_id": "shard_min_id", "max_id": "shard_max_id"}
    docs = docs.drop(*(set(about.values()) - {id_col}))
    store = Store(spark, path or passing(spark, work_path(spark, "shards")), id_col, **sizes)
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    if low is None:
        store.append(docs)
    else:
        step = -(-(high - low + 1) // arrivals)
        for k in range(arrivals):
            at = F.col(id_col)
            mine = (at >= low + k * step) & (at < low + (k + 1) * step)
            store.append(docs.where(mine | at.isNull() if k == 0 else mine))
            store.compact(docs.schema)
            store.vacuum()
    shard = "_shard"
    while any(c.lower() == shard for c in docs.columns):
        shard = "_" + shard
    shards = store.manifest().select(F.col("path").alias(shard), *[F.col(a).alias(b) for a, b in about.items()])
    return store.read(docs.schema, shard=shard).join(shards, shard).drop(shard)


OP7_SQL = "select doc_id, sha1(text) as text_sha1, lang, source, n_chars, true as id_in_range, true as shard_fits from documents"
