"""Size-tiered compaction of shards, in DataFrame operations only.

A store is a folder. ``append`` writes arrivals as small immutable shards, one directory each. ``compact``
puts shards in tiers by size (each tier's sizes are within a factor of ``FAN``), cuts each tier's shards, in
order, into runs of about the target size, and writes each run of two or more as one shard; shards that are
large enough, or alone in their run, stay where they are. Shards are never changed or deleted, so readers
of an older version are not disturbed; ``expire`` says which are no longer in the newest one.

Each step ends by committing a manifest, a table under a name of its own. The commit itself is one small file named by
the version. It is written whole under another name and then put in place by ``put_if_absent``: of two writers one
wins, the other raises, and a reader sees a whole manifest or none. A job that dies before leaves files that no manifest
names; a commit file that cannot be read (of a store that lacks that step) is passed over, and its number is not used
again. On file systems ``put_if_absent`` is a hard link (local) or a rename that doesn't overwrite (others); an object
store with a conditional put gives its own.

Runs are planned on the shards' sizes by windows over zones of ``ZONE`` shards, so the plan does not meet in
one task. Sizes are the bytes of the text. Rows with a null id are one arrival, -1; rows of one arrival are
rebalanced over tasks, so an arrival may hold a third of all rows. Null texts are 0 bytes. Repeated rows are
all kept. All columns are kept whatever their names: the store's own two get names that no column has. An empty
table makes a store without shards.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lispmill.llm.common import shared_dir, table

ARRIVAL_ROWS, BASE, FAN, TARGET, ZONE = 500, 1 << 20, 4, 32 << 20, 4096
#: Names of live shards that a reader puts in its scan's filter; more are semi-joined.
LISTED = 2000
#: Of the query: one arrival in so many comes after the first compaction.
LATE = 4
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Held by a store while it has that setting changed.
CONF = threading.Lock()
MANIFEST = "shard string, arrival long, batch string, tier int, n_rows long, n_bytes long, state string"


def tier_of(size: Column, base: int = BASE, fan: int = FAN, target: int = TARGET) -> Column:
    """0 below the base, and one more for each factor; shards of the target size and more are the last tier."""
    return sum((F.when(size >= x, 1).otherwise(0) for x in tier_edges(base, fan, target)), F.lit(0)).cast("int")


def tier_edges(base: int = BASE, fan: int = FAN, target: int = TARGET) -> list[int]:
    edges, x = [], base
    while x < target:
        edges.append(x)
        x *= fan
    return [*edges, target]


def put_if_absent(spark: SparkSession, made: str, to: str) -> bool:
    """Gives the whole file ``made`` the name ``to`` unless that exists already, in one step; whether it did."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(made), jvm.org.apache.hadoop.fs.Path(to)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    try:
        if source.getFileSystem(conf).getScheme() == "file":
            files, local = jvm.java.nio.file.Files, lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            files.createLink(local(target), local(source))
        else:
            keep = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
            keep[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(source, target, keep)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, text_col: str = "text", base: int = BASE, fan: int = FAN, target: int = TARGET, put: Callable[[SparkSession, str, str], bool] = put_if_absent) -> None:
        self.spark, self.root, self.text_col = spark, root.rstrip("/"), text_col
        self.base, self.fan, self.target, self.put = base, fan, target, put
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- manifest
    def _commits(self) -> dict[int, str]:
        """Manifest's name by version; empty for a commit file that cannot be read."""
        at = self._path(f"{self.root}/commits")
        out = {}
        for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
            if s.getPath().getName().isdigit():
                out[int(s.getPath().getName())] = self._read(s.getPath())
        return out

    def _read(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return stream.readUTF()
        except Py4JJavaError:
            return ""
        finally:
            stream.close()

    def versions(self) -> list[int]:
        return sorted(v for v, name in self._commits().items() if name)

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live shards of a version, the newest by default."""
        known = {v: name for v, name in self._commits().items() if name}
        if version is not None and version not in known:
            raise ValueError(f"no version {version}")
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{known[max(known) if version is None else version]}")

    def commit(self, manifest: DataFrame, expected: int) -> int:
        """Makes the next version; raises if another writer has made one since the version ``expected``."""
        name = uuid.uuid4().hex
        manifest.select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.parquet(f"{self.root}/manifests/{name}")
        made = self._path(f"{self.root}/commits/.{name}")
        stream = self._fs.create(made, False)
        stream.writeUTF(name)
        stream.close()
        commits = self._commits()
        version = max([expected, *commits]) + 1  # numbers of unreadable commits are not used again
        later = [v for v, held in commits.items() if held and v > expected]
        ok = not later and self.put(self.spark, made.toString(), f"{self.root}/commits/{version:08d}")
        self._fs.delete(made, False)
        if not ok:
            raise RuntimeError(f"a version after {expected} exists: another writer was first")
        return version

    # --- steps
    def names(self, columns: list[str]) -> tuple[str, str]:
        """(arrival, shard): the store's columns beside the given ones, which partition discovery may not tell by case."""
        low, tail = {c.lower() for c in columns}, ""
        while low & {f"__{name}{tail}" for name in ("arrival", "shard", "batch", "run")}:
            tail += "_"
        return f"__arrival{tail}", f"__shard{tail}"

    def _write(self, rows: DataFrame, batch: str) -> None:
        """Rows whose last two columns are arrival and shard."""
        of = self._batch_name(rows.columns[-1])
        # the shuffle's files go when the write ends, not when the driver next collects its garbage
        with CONF:
            before = self.spark.conf.get(CLEANUP, "false")
            self.spark.conf.set(CLEANUP, "true")
            try:
                rows.write.option("compression", "zstd").partitionBy(rows.columns[-1]).parquet(f"{self.root}/data/{of}={batch}")
            finally:
                self.spark.conf.set(CLEANUP, before)

    @staticmethod
    def _batch_name(shard: str) -> str:
        return "__batch" + shard.removeprefix("__shard")

    def _stored(self, batches: list[str]) -> DataFrame:
        """The batches' rows in one scan, with arrival, shard and batch as the last columns."""
        dirs = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/data"))]
        paths = [f"{self.root}/data/{d}" for d in dirs if d.partition("=")[2] in batches]
        rows = self.spark.read.option("basePath", f"{self.root}/data").parquet(*sorted(paths))
        *plain, arrival, batch, shard = rows.columns
        return rows.select(*plain, arrival, F.col(shard).cast("string").alias(shard), F.col(batch).cast("string").alias(batch))

    def _sizes(self, batch: str) -> DataFrame:
        rows = self._stored([batch])
        arrival, shard = rows.columns[-3:-1]
        n = F.coalesce(F.octet_length(self.text_col), F.lit(0)).cast("long")
        by = rows.groupBy(F.col(shard).alias("shard"), F.col(arrival).alias("arrival")).agg(F.count("*").alias("rows"), F.sum(n).alias("bytes"))
        merged = by.groupBy("shard").agg(F.min("arrival").alias("arrival"), F.sum("rows").alias("n_rows"), F.sum("bytes").alias("n_bytes"))
        size = F.col("n_bytes")
        return merged.select("shard", "arrival", F.lit(batch).alias("batch"), tier_of(size, self.base, self.fan, self.target).alias("tier"), "n_rows", "n_bytes", F.lit("live").alias("state"))

    def append(self, rows: DataFrame, arrival: Column) -> int:
        """Writes the rows as one shard for each arrival number and commits."""
        known = self.versions()
        batch = f"b{uuid.uuid4().hex[:12]}"
        of, shard = self.names(rows.columns)
        named = rows.select("*", F.coalesce(arrival.cast("long"), F.lit(-1)).alias(of)).withColumn(shard, F.concat(F.lit("a"), F.col(of)))
        if not rows.isEmpty():
            self._write(named.hint("rebalance", F.col(shard)), batch)
            new = self._sizes(batch)
        else:
            new = self.spark.createDataFrame([], MANIFEST)
        return self.commit(self.manifest().unionByName(new), known[-1] if known else 0)

    def plan(self) -> DataFrame:
        """(shard, batch, run): the run each live shard below the target size is to be merged in; runs have two or more."""
        zone = F.floor(F.col("arrival") / ZONE)
        order = Window.partitionBy("tier", zone).orderBy("arrival", "shard", "batch").rowsBetween(Window.unboundedPreceding, -1)
        ahead = F.coalesce(F.sum("n_bytes").over(order), F.lit(0))
        small = self.manifest().where(F.col("n_bytes") < self.target).withColumn("zone", zone).withColumn("slot", F.floor(ahead / self.target))
        run = small.groupBy("tier", "zone", "slot").agg(F.count("*").alias("members"), F.min("arrival").alias("least")).where("members > 1")
        return small.join(run, ["tier", "zone", "slot"]).select("shard", "batch", F.concat(F.lit("m"), "tier", F.lit("x"), "least").alias("run"))

    def compact(self) -> int:
        """Merges the planned runs and commits; without any, nothing is committed."""
        version = self.versions()[-1]
        live, plan = self.manifest(version), self.plan()
        batches = sorted(r["batch"] for r in plan.select("batch").distinct().collect())
        if not batches:
            return version
        to = f"b{uuid.uuid4().hex[:12]}"
        rows = self._live(batches, plan)
        *plain, arrival, shard, batch = rows.columns
        run = f"__run{shard.removeprefix('__shard')}"
        runs = plan.select(F.col("shard").alias(shard), F.col("batch").alias(batch), F.col("run").alias(run))
        merged = rows.join(runs, [shard, batch]).select(*plain, arrival, F.col(run).alias(shard))
        self._write(merged.repartition(F.col(shard)), to)
        kept = live.join(plan.select("shard", "batch"), ["shard", "batch"], "left_anti")
        return self.commit(kept.unionByName(self._sizes(to)), version)

    def _live(self, batches: list[str], live: DataFrame) -> DataFrame:
        """Rows of the batches' shards in ``live`` (shard, batch): up to ``LISTED`` names prune the scan, more are joined."""
        rows = self._stored(batches)
        shard, batch = rows.columns[-2:]
        few = live.select("shard", "batch").limit(LISTED + 1).collect()
        if len(few) > LISTED:
            return rows.join(live.select(F.col("shard").alias(shard), F.col("batch").alias(batch)), [shard, batch], "left_semi").select(*rows.columns)
        return rows.where(F.concat_ws("/", batch, shard).isin([f"{r['batch']}/{r['shard']}" for r in few]))

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version, with arrival and shard as the last columns; None of a store without shards."""
        live = self.manifest(version).select("shard", "batch")
        batches = sorted(r["batch"] for r in live.select("batch").distinct().collect())
        rows = self._live(batches, live) if batches else None
        return rows.drop(rows.columns[-1]) if batches else None

    def expire(self) -> DataFrame:
        """(shard, batch) of older versions that the newest has no more."""
        names = [name for _, name in sorted(self._commits().items()) if name]
        new = self.manifest().select("shard", "batch")
        if len(names) < 2:
            return new.limit(0)
        old = self.spark.read.schema(MANIFEST).parquet(*[f"{self.root}/manifests/{n}" for n in names[:-1]]).select("shard", "batch")
        return old.distinct().join(new, ["shard", "batch"], "left_anti")


def op9_compact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended by ranges of ids in two steps, compacted after each, and read back from the newest version's shards."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    arrival = F.floor(F.col("doc_id") / ARRIVAL_ROWS)
    late = F.coalesce(F.pmod(arrival, F.lit(LATE)) == LATE - 1, F.lit(True))
    for part in (docs.where(~late), docs.where(late)):
        store.append(part, arrival)
        store.compact()
    rows = store.read()
    if rows is None:
        rows = docs.limit(0).select("*", F.lit(0).cast("long").alias("__arrival"), F.lit("").alias("__shard"))
    of, shard = rows.columns[-2:]
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return rows.select("doc_id", F.col(of).alias("arrival"), F.col(shard).alias("shard"), n.alias("n_bytes"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def oracle() -> str:
    """Both rounds of the plan on the arrivals' sizes."""
    tier = " + ".join(f"(n_bytes >= {x})::INT" for x in tier_edges())

    def planned(shards: str) -> str:
        """(shard, run): the run that a shard is merged in, of (shard, arrival, n_bytes) rows."""
        return f"""SELECT shard, CASE WHEN members > 1 THEN 'm' || tier || 'x' || least END AS run FROM (
          SELECT shard, tier, count(*) OVER w AS members, min(arrival) OVER w AS least FROM (
            SELECT *, floor(coalesce(sum(n_bytes) OVER (PARTITION BY tier, zone ORDER BY arrival, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {TARGET}) AS slot
            FROM (SELECT *, {tier} AS tier, floor(arrival / {ZONE}) AS zone FROM {shards}) WHERE n_bytes < {TARGET})
          WINDOW w AS (PARTITION BY tier, zone, slot))"""

    return f"""
      WITH d AS (SELECT doc_id, coalesce(doc_id // {ARRIVAL_ROWS}, -1)::BIGINT AS arrival, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, md5(coalesce(text, '')) AS text_md5 FROM documents),
      s AS (SELECT 'a' || arrival AS shard, arrival, sum(n_bytes)::BIGINT AS n_bytes, arrival < 0 OR arrival % {LATE} = {LATE - 1} AS late FROM d GROUP BY arrival),
      early AS (SELECT shard, arrival, n_bytes FROM s WHERE NOT late),
      p1 AS ({planned("early")}),
      r1 AS (SELECT e.arrival AS own, coalesce(run, e.shard) AS shard, e.n_bytes FROM early e LEFT JOIN p1 USING (shard) UNION ALL SELECT arrival, shard, n_bytes FROM s WHERE late),
      s2 AS (SELECT shard, min(own) AS arrival, sum(n_bytes)::BIGINT AS n_bytes FROM r1 GROUP BY shard),
      p2 AS ({planned("s2")})
      SELECT doc_id, d.arrival, coalesce(run, shard) AS shard, d.n_bytes, text_md5 FROM d JOIN r1 ON d.arrival = r1.own LEFT JOIN p2 USING (shard)"""
