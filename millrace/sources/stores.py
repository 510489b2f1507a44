"""Stores on a shared file system: hash-chained event logs, classifier journals, ledgers, held-out suites, blobs, data shards.

All of them only ever add files, each addition a table of its own, so a store is read as one table and a
failed write leaves what was there. Whoever writes must be the only writer.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import classify, control, eventlog, ledger
from ..operators.fold import fold


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def _next(spark: SparkSession, folder: str) -> str:
    """The folder of the next addition; additions are numbered in the order of their writing."""
    place, files = _place(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return f"{folder}/part={sum(n.startswith('part=') for n in names):08d}"


class EventLog:
    """Hash chains as lines of JSON. Opening verifies every chain; what a broken last line held is cut off, any other fault raises."""

    SCHEMA = eventlog.COLUMNS

    def __init__(self, spark: SparkSession, folder: str, check: bool = True):
        self.spark, self.folder = spark, folder
        if check and exists(spark, folder):
            fault = eventlog.verify(self.events()).limit(1).collect()
            if fault:
                raise ValueError(f"event {fault[0].seq} of chain {fault[0].chain}: {fault[0].fault}")

    def events(self) -> DataFrame:
        """All events. A line that is no event is left out if it is the last one of its file, else it raises."""
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], self.SCHEMA)
        return eventlog.read_jsonl(self.spark, f"{self.folder}/part=*", self.SCHEMA)

    def append(self, records: DataFrame) -> None:
        """Adds ``(chain, pos, timestamp, event_type, payload)``, each chain after its last event."""
        last = self.events().groupBy("chain").agg(F.max_by(F.struct("seq", "hash"), "seq").alias("last"))
        rows = records.join(last, "chain", "left").select("chain", "pos", "timestamp", "event_type", "payload", (F.coalesce("last.seq", F.lit(-1)) + 1).alias("first_seq"), F.coalesce("last.hash", F.lit(eventlog.GENESIS)).alias("first_prev"))

        def link(state, r):
            seq, prev = state or (r.first_seq, r.first_prev)
            event = eventlog.event(r.chain, seq, prev, r.timestamp, r.event_type, r.payload)
            return (seq + 1, event[3]), [event]

        made = fold(rows, "chain", "pos", self.SCHEMA, lambda key: None, link)
        made.select(F.to_json(F.struct(*made.columns)).alias("value")).write.text(_next(self.spark, self.folder))


class Journal:
    """Documents and scores of a classifier as lines of JSON, replayed in the order of their writing."""

    SCHEMA = "event_type string, pos long, content_hash string, text string, quality float, safety float"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _events(self) -> DataFrame:
        lines = self.spark.read.text(f"{self.folder}/part=*") if exists(self.spark, self.folder) else self.spark.createDataFrame([], "value string")
        return lines.select(F.from_json("value", self.SCHEMA, {"mode": "FAILFAST"}).alias("e")).select("e.*")

    def _write(self, rows: DataFrame) -> None:
        rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(_next(self.spark, self.folder))

    def ingest(self, docs: DataFrame) -> None:
        """Adds documents ``(content_hash, text)``; one that is there already, or twice among the new, raises."""
        new = docs.select("content_hash", "text")
        twice = new.groupBy("content_hash").count().where("count > 1").select("content_hash")
        if new.join(self.documents(), "content_hash", "left_semi").select("content_hash").unionByName(twice).limit(1).count():
            raise ValueError("a document is in the journal already")
        self._write(new.select(F.lit("clf.ingest").alias("event_type"), "*"))

    def score(self, scores: DataFrame) -> None:
        """Adds scores ``(pos, content_hash, quality, safety)``; a greater ``pos`` is a later score."""
        self._write(scores.select(F.lit("clf.score").alias("event_type"), F.col("pos").cast("long").alias("pos"), "content_hash", F.col("quality").cast("float").alias("quality"), F.col("safety").cast("float").alias("safety")))

    def documents(self) -> DataFrame:
        return self._events().where("event_type = 'clf.ingest'").select("content_hash", "text")

    def replay(self) -> DataFrame:
        """``(content_hash, quality, safety)``: the last score of each text."""
        return classify.last_predictions(self._events().where("event_type = 'clf.score'"))


class LedgerStore:
    """Experiment records in Parquet: an id stands once, and a record supersedes only one that is there."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def records(self) -> DataFrame:
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/part=*")

    def append(self, new: DataFrame) -> None:
        ledger.append(self.records(), new)  # raises before anything is written
        new.write.parquet(_next(self.spark, self.folder))

    def size(self) -> DataFrame:
        """One row ``(n_records, empty)``; superseded records count."""
        return self.records().agg(F.count("*").alias("n_records")).withColumn("empty", F.col("n_records") == 0)


class SuiteStore:
    """Held-out suites: the generation in use, the ones before it, and items that wait to replace it.

    All times are milliseconds. Items are ``(suite, item_id, answer, weight_milli)``.
    """

    ITEMS = "suite string, item_id string, answer string, weight_milli long, text string"
    HISTORY = "suite string, suite_hash string, installed_ms long, cutoff_ms long, written_ms long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(f"{path}/part=*") if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def history(self) -> DataFrame:
        """Every generation that was ever installed."""
        return self._read("history", self.HISTORY)

    def current(self) -> DataFrame:
        """The generation of each suite that was installed last."""
        last = self.history().groupBy("suite").agg(F.max_by(F.struct("suite_hash", "installed_ms", "cutoff_ms", "written_ms"), "installed_ms").alias("g"))
        return last.select("suite", "g.*")

    def pending(self) -> DataFrame:
        """Items that were written after their suite's generation; those of the last writing count."""
        waiting = self._read("pending", f"{self.ITEMS}, written_ms long").join(self.current().select("suite", F.col("written_ms").alias("used")), "suite", "left")
        waiting = waiting.where("used is null or written_ms > used")
        newest = waiting.groupBy("suite").agg(F.max("written_ms").alias("written_ms"))
        return waiting.join(newest, ["suite", "written_ms"]).drop("used")

    def items(self) -> DataFrame:
        """The items in use."""
        return self._read("pending", f"{self.ITEMS}, written_ms long").join(self.current().select("suite", "written_ms"), ["suite", "written_ms"], "left_semi").drop("written_ms")

    def write(self, items: DataFrame, written_ms: int) -> None:
        """Adds waiting items; an empty id, or one that stands twice in its suite, raises."""
        if items.where("item_id is null or item_id = ''").limit(1).count() or items.groupBy("suite", "item_id").count().where("count > 1").limit(1).count():
            raise ValueError("ids of items must be there, and once")
        columns = [c.split()[0] for c in self.ITEMS.split(", ")]
        items.select(*columns, F.lit(written_ms).cast("long").alias("written_ms")).write.parquet(_next(self.spark, f"{self.folder}/pending"))

    def rotate(self, cutoff_ms: int, now_ms: int) -> DataFrame:
        """``(suite, ok)``: waiting suites that may be installed are, the others stay as they are.

        A rotation needs a cutoff that isn't ahead, items written after it, and 90 days since the suite's last one.
        """
        waiting = self.pending()
        state = waiting.groupBy("suite").agg(F.count("*").alias("n_pending"), F.min("written_ms").alias("oldest_pending"))
        state = state.join(self.current().select("suite", "installed_ms"), "suite", "left").withColumn("installed_at", F.coalesce("installed_ms", F.lit(-(1 << 60))))
        verdict = control.may_rotate(state, cutoff_ms, now_ms)
        rows = verdict.collect()  # one for each suite
        allowed = [r.suite for r in rows if r.ok]
        if allowed:
            fresh = waiting.where(F.col("suite").isin(allowed))
            made = control.suite_hash(fresh).join(fresh.groupBy("suite").agg(F.max("written_ms").alias("written_ms")), "suite")
            made.select("suite", "suite_hash", F.lit(now_ms).cast("long").alias("installed_ms"), F.lit(cutoff_ms).cast("long").alias("cutoff_ms"), "written_ms").write.parquet(_next(self.spark, f"{self.folder}/history"))
        return self.spark.createDataFrame([(r.suite, r.ok) for r in rows], "suite string, ok boolean")


class BlobStore:
    """Blobs by the SHA-256 of their content, in several places at once, with pins against the collection of garbage."""

    BLOBS, PINS = "digest string, content binary", "digest string, pinned boolean, pos long"

    def __init__(self, spark: SparkSession, folder: str, backends: list[str], min_replicas: int):
        self.spark, self.folder, self.backends, self.min_replicas = spark, folder, backends, min_replicas

    def put(self, blobs: DataFrame) -> DataFrame:
        """Writes ``(content)`` to every backend; ``(digest, replicas, stored)``. A backend that fails only costs its replica."""
        rows = blobs.select(F.sha2("content", 256).alias("digest"), "content").dropDuplicates(["digest"])
        done = []
        for name in self.backends:
            try:
                rows.write.parquet(_next(self.spark, f"{self.folder}/{name}"))
                done.append(name)
            except (PySparkException, Py4JJavaError):  # a backend that can't be written to
                continue
        replicas = rows.select("digest", F.lit(len(done)).cast("long").alias("replicas"))
        return replicas.withColumn("stored", F.col("replicas") >= self.min_replicas)

    def replicas(self) -> DataFrame:
        """``(backend, digest, content)``, each digest once in a backend, without what was collected."""
        out = None
        gone = self._gone()
        for name in self.backends:
            path = f"{self.folder}/{name}"
            if exists(self.spark, path):
                part = self.spark.read.schema(self.BLOBS).parquet(f"{path}/part=*").dropDuplicates(["digest"]).withColumn("backend", F.lit(name))
                out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], "backend string, digest string, content binary")
        return out.select("backend", "digest", "content").join(gone, "digest", "left_anti")

    def _gone(self) -> DataFrame:
        path = f"{self.folder}/collected"
        return self.spark.read.schema("digest string").parquet(f"{path}/part=*") if exists(self.spark, path) else self.spark.createDataFrame([], "digest string")

    def get(self) -> DataFrame:
        """``(digest, content)`` of what is sound in some backend."""
        sound = self.replicas().where(F.sha2("content", 256) == F.col("digest"))
        return sound.groupBy("digest").agg(F.first("content").alias("content"))

    def pin(self, digests: DataFrame, pinned: bool = True) -> None:
        path = f"{self.folder}/pins"
        at = int(_next(self.spark, path).rsplit("=", 1)[1])
        digests.select("digest", F.lit(pinned).alias("pinned"), F.lit(at).cast("long").alias("pos")).distinct().write.parquet(_next(self.spark, path))

    def pins(self) -> DataFrame:
        path = f"{self.folder}/pins"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], "digest string")
        last = self.spark.read.schema(self.PINS).parquet(f"{path}/part=*").groupBy("digest").agg(F.max_by("pinned", "pos").alias("pinned"))
        return last.where("pinned").select("digest")

    def collect_garbage(self) -> DataFrame:
        """One row ``(blobs, bytes)`` of what isn't pinned, which is then gone; its files are left to a later rewriting."""
        loose = self.replicas().join(self.pins(), "digest", "left_anti").select("digest", "backend", F.octet_length("content").cast("long").alias("size"))
        row = control.collect_garbage(loose, self.spark.createDataFrame([], "digest string")).first()
        if row.blobs:
            loose.select("digest").distinct().write.parquet(_next(self.spark, f"{self.folder}/collected"))
        return self.spark.createDataFrame([(row.blobs, row.bytes)], "blobs long, bytes long")


def shard_manifest(docs: DataFrame, hits: DataFrame, suites: DataFrame, columns: list[str]) -> DataFrame:
    """``(mix_bucket, shard_id, n_docs, n_chars, columns, status, against, sources, content_hash)`` of each data shard.

    ``docs`` is ``(id, text, mix_bucket, shard_id, source)``, ``hits`` ``(id)`` of contaminated documents, ``suites`` ``(suite)``
    of all that were scanned for. ``sources`` lists where the texts come from, which is bounded by the number of
    sources. The hash is of the number of texts and of sums over their hashes, so it doesn't depend on the
    order of rows and combines on the map side.
    """
    rows = docs.join(hits.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    part = lambda at: F.bit_xor(F.conv(F.substring(digest, at, 15), 16, 10).cast("long"))
    out = rows.groupBy("mix_bucket", "shard_id").agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0).cast("long")).alias("n_chars"), F.max("hit").alias("hit"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), part(1).alias("a"), part(16).alias("b"))
    scanned = suites.select("suite").distinct().agg(F.array_join(F.array_sort(F.collect_list("suite")), ",").alias("against"))
    out = out.crossJoin(F.broadcast(scanned))  # one row
    return out.select(
        "mix_bucket", "shard_id", "n_docs", "n_chars", F.lit(",".join(columns)).alias("columns"), F.when(F.col("hit") == 1, "flagged").otherwise("clean").alias("status"), "against", "sources",
        F.sha2(F.concat_ws("|", F.col("n_docs").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("content_hash"))


def write_shards(docs: DataFrame, folder: str, hits: DataFrame, suites: DataFrame) -> DataFrame:
    """Writes documents by ``mix_bucket`` and ``shard_id`` with their manifest beside them, which is returned as it was written."""
    docs.write.partitionBy("mix_bucket", "shard_id").parquet(f"{folder}/shards")
    written = docs.sparkSession.read.schema(docs.schema).parquet(f"{folder}/shards")
    manifest = shard_manifest(written, hits, suites, [c for c in docs.columns if c not in ("mix_bucket", "shard_id")])
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")
