"""Duplicates by document, by paragraph and by similarity, each with a keeper that doesn't depend on the order of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..session import stage
from .graph import components


@dataclass(frozen=True)
class NearConfig:
    """Shingle width, number of hashes, bands and rows in a band."""

    shingle: int = 5
    hashes: int = 128
    bands: int = 32
    rows: int = 4

    def __post_init__(self):
        if min(self.shingle, self.hashes, self.bands, self.rows) < 1 or self.bands * self.rows != self.hashes:
            raise ValueError(f"bands times rows must be the number of hashes, and none may be zero: {self}")


def _keeper() -> F.Column:
    return F.min(F.struct("content_hash", "id"))["id"]


def exact_documents(docs: DataFrame) -> DataFrame:
    """``(id, h, kept_id)`` of ``(id, text, content_hash)``; null texts are left out.

    The aggregate over hashes alone is combined on the map side; a hot group is one row when it is joined back.
    """
    hashed = docs.where("text is not null").select("id", "content_hash", text.exact_hash(F.col("text")).alias("h"))
    hashed = stage(hashed, "hashed")  # texts are read and hashed once
    return hashed.join(hashed.groupBy("h").agg(_keeper().alias("kept_id")), "h").select("id", "h", "kept_id")


def exact_paragraphs(docs: DataFrame) -> DataFrame:
    """``(id, kept)``: a document is dropped if it shares a paragraph with a kept one before it.

    The order is that of (content_hash, id). Documents that share no paragraph are kept at once and take
    no further part. Rounds keep every undecided document that is the
    first undecided one on all its paragraphs, then drop those sharing a paragraph with a kept one.
    """
    parts = F.transform(F.array_distinct(text.paragraphs(F.col("text"))), lambda p: F.struct(F.xxhash64(p).alias("a"), F.md5(p).alias("p")))
    rows = docs.where("text is not null").select("id", F.struct("content_hash", "id").alias("rank"), parts.alias("ps"))
    rows = stage(rows, "paragraphs")
    every = rows.select("id", "rank", F.explode("ps").alias("p")).select("id", "rank", "p.a", "p.p")
    shared = every.groupBy("a", "p").agg(F.count("*").alias("n")).where("n > 1").select("a", "p")
    left = stage(every.join(shared, ["a", "p"], "left_semi"), "undecided")
    kept = rows.select("id").join(left.select("id").distinct(), "id", "left_anti")
    while left.limit(1).count():
        first = left.groupBy("a", "p").agg(F.min("rank").alias("first"))
        judged = left.join(first, ["a", "p"])
        new = stage(judged.groupBy("id").agg(F.min((F.col("rank") == F.col("first")).cast("int")).alias("all_first")).where("all_first = 1").select("id"), "kept")
        taken = left.join(new, "id", "left_semi").select("a", "p").distinct()
        gone = left.join(taken, ["a", "p"], "left_semi").select("id").distinct()
        left = stage(left.join(gone, "id", "left_anti"), "undecided")
        kept = kept.unionByName(new)
    return rows.select("id").join(kept.withColumn("kept", F.lit(True)), "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


def signatures(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """``(id, signature)``: for each seed the least hash over the different shingles; documents without shingles have none.

    Shingles that texts of a batch share are hashed once; as Columns, 128 seeds are a plan that takes minutes.
    """
    import hashlib

    import numpy as np
    import pandas as pd

    parts = docs.where("text is not null").select("id", F.array_distinct(text.shingles(F.col("text"), config.shingle)).alias("s")).where(F.size("s") > 0)

    def least(batches):
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch, places = whole.iloc[at : at + 1000], {}
                index = np.array([places.setdefault(x, len(places)) for s in batch["s"] for x in s], dtype=np.int64)
                starts = np.cumsum([0, *batch["s"].str.len()])[:-1]
                coded, low = [x.encode() for x in places], []
                for k in range(config.hashes):
                    seed = k.to_bytes(8, "little")
                    hashes = np.frombuffer(b"".join([hashlib.sha256(seed + x).digest()[:8] for x in coded]), dtype="<u8")
                    low.append(np.minimum.reduceat(hashes[index], starts))
                yield pd.DataFrame({"id": batch["id"], "signature": pd.Series([[f"{x:016x}" for x in row] for row in np.array(low).T.tolist()], dtype=object, index=batch.index)})

    return parts.mapInPandas(least, f"id {docs.schema['id'].dataType.simpleString()}, signature array<string>")


def fast_signatures(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """As ``signatures`` with multiplied 64-bit hashes, for large corpora: shingles are hashed in the JVM, minima taken by NumPy."""
    import numpy as np
    import pandas as pd

    parts = docs.where("text is not null").select("id", F.array_distinct(text.shingles(F.col("text"), config.shingle)).alias("s")).where(F.size("s") > 0)
    odd, add = (hashing.SplitMix(seed).many(config.hashes) for seed in (1, 2))

    def least(batches):
        for batch in batches:
            out = []
            for hashes in batch["s"]:
                low = np.full(config.hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(hashes), 512):
                    mixed = np.asarray(hashes[at : at + 512]).astype(np.uint64)[:, None] * (odd | np.uint64(1)) + add
                    np.minimum(low, (mixed ^ (mixed >> np.uint64(31))).min(axis=0), out=low)
                out.append([f"{x:016x}" for x in low.tolist()])
            yield pd.DataFrame({"id": batch["id"], "signature": pd.Series(out, dtype=object)})

    hashed = parts.select("id", F.transform("s", lambda x: F.xxhash64(x)).alias("s"))
    return hashed.mapInPandas(least, f"id {docs.schema['id'].dataType.simpleString()}, signature array<string>")


def band_keys(signed: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """``(id, band, key)``: the hash of each band's rows, each as 8 little-endian bytes.

    The bytes are turned in Python: as Columns, 128 reversed hashes are a plan of thousands of expressions.
    """
    import hashlib

    import pandas as pd

    def hashed(batches):
        for batch in batches:
            keys = []
            for signature in batch["signature"]:
                rows = [bytes.fromhex(x)[::-1] for x in signature]
                digests = (hashlib.sha256(b"".join(rows[k * config.rows : (k + 1) * config.rows])).digest() for k in range(config.bands))
                keys.append([d[:8][::-1].hex() for d in digests])
            yield pd.DataFrame({"id": batch["id"], "keys": pd.Series(keys, dtype=object)})

    kind = signed.schema["id"].dataType.simpleString()
    out = signed.select("id", "signature").mapInPandas(hashed, f"id {kind}, keys array<string>")
    return out.select("id", F.posexplode("keys").alias("band", "key"))


#: Similarity from which texts are near copies, and texts of a bucket that meet in one step of the join.
SIMILARITY, BLOCK = 0.8, 2_000


def similar_pairs(docs: DataFrame, keys: DataFrame, width: int, similarity: float) -> DataFrame:
    """``(a, b)``: pairs that share a band and at least ``similarity`` of their shingles, and each text with the least of its equals.

    Every pair of a bucket is looked at, in blocks. Numbers of shingles, and 256 bits of which shingles set one each,
    bound what two texts can share; the shingles themselves meet only where that bound reaches the similarity.
    """
    hashes = F.array_distinct(F.transform(text.shingles(F.col("text"), width), lambda x: F.xxhash64(x)))
    sets = docs.where("text is not null").select("id", F.array_sort(hashes).alias("s")).where(F.size("s") > 0)
    bits = [F.expr(f"aggregate(filter(s, x -> (shiftright(x, 6) & 3) = {k}), 0L, (v, x) -> v | shiftleft(1L, int(x & 63)))").alias(f"w{k}") for k in range(4)]
    sets = stage(sets.select("id", "s", F.size("s").alias("n"), F.md5(F.concat_ws(",", F.col("s").cast("array<string>"))).alias("g"), *bits), "sets")
    hubs = sets.groupBy("g").agg(F.min("id").alias("hub"))
    equal = sets.join(hubs, "g").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    # Equal texts share all bands, so the least of them stands for all.
    own = sets.drop("s").join(hubs, "g").where("id = hub").drop("g", "hub")
    rows = stage(keys.join(own, "id"), "members")
    sizes = rows.groupBy("band", "key").agg(F.ceil(F.count("*") / BLOCK).alias("parts"), F.count("*").alias("m")).where("m > 1").drop("m")
    rows = rows.join(sizes, ["band", "key"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    words = [f"w{k}" for k in range(4)]
    left = rows.select("band", "key", F.col("id").alias("a"), F.col("n").alias("n1"), *(F.col(w).alias(f"a{w}") for w in words), F.col("mine").alias("i"), every.alias("j"))
    right = rows.select("band", "key", F.col("id").alias("b"), F.col("n").alias("n2"), *(F.col(w).alias(f"b{w}") for w in words), every.alias("i"), F.col("mine").alias("j"))
    only = lambda x, y: sum((F.bit_count(F.col(f"{x}{w}").bitwiseAND(F.bitwise_not(F.col(f"{y}{w}")))) for w in words), F.lit(0))
    most = F.least(F.col("n1") - only("a", "b"), F.col("n2") - only("b", "a"))
    may = most >= similarity * (F.col("n1") + F.col("n2") - most) - 1e-6
    pairs = left.join(right, ["band", "key", "i", "j"]).where((F.col("a") < F.col("b")) & may).select("a", "b").distinct()
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("s1")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("s2")), "b")
    return pairs.where(jaccard(F.col("s1"), F.col("s2")) >= similarity).select("a", "b").unionByName(equal)


def near_clusters(docs: DataFrame, config: NearConfig = NearConfig(), fast: bool = False, similarity: float | None = None) -> DataFrame:
    """``(id, cluster, kept_id)`` of documents that share a band with another one and, with a ``similarity``, that share of shingles.

    Without a similarity, which is the reference's rule, buckets are stars around their least id, so a bucket of
    any size gives one edge for each member.
    """
    signed = (fast_signatures if fast else signatures)(docs, config)
    keys = stage(band_keys(signed, config), "bands")
    if similarity is not None:
        edges = similar_pairs(docs, keys, config.shingle, similarity)
    else:
        stars = keys.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
        edges = keys.join(stars, ["band", "key"]).where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    labelled = components(edges).select(F.col("node").alias("id"), F.col("label").alias("cluster"))
    ranked = labelled.join(docs.select("id", "content_hash"), "id")
    return ranked.select("id", "cluster").join(ranked.groupBy("cluster").agg(_keeper().alias("kept_id")), "cluster").select("id", "cluster", "kept_id")


def dedup_corpus(docs: DataFrame, config: NearConfig = NearConfig(), fast: bool = False, similarity: float | None = None) -> DataFrame:
    """``(id, status)`` after the exact document, exact paragraph and near passes, each over what the last one kept."""
    docs = stage(docs.select("id", "text", "content_hash").where("text is not null"), "dedup")
    if not docs.limit(1).count():
        raise ValueError("an empty corpus can't be deduplicated")
    one = exact_documents(docs).where("id = kept_id").select("id")
    after_one = stage(docs.join(one, "id", "left_semi"), "exact")
    two = exact_paragraphs(after_one).where("kept").select("id")
    after_two = stage(after_one.join(two, "id", "left_semi"), "paragraph")
    near = near_clusters(after_two, config, fast, similarity).where("id <> kept_id").select("id", F.lit("dropped_near").alias("near"))
    rows = docs.select("id").join(after_two.select("id", F.lit(True).alias("left")), "id", "left").join(near, "id", "left")
    return rows.select("id", F.when(F.col("near").isNotNull(), F.col("near")).when(F.col("left"), "kept").otherwise("dropped_exact").alias("status"))


def report(statuses: DataFrame) -> DataFrame:
    """``(status, n)``."""
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def report_lists(statuses: DataFrame) -> DataFrame:
    """``(status, pos, id)``: each status's ids in their order, as rows with their places, so a list may have any length."""
    from .classify import ranked

    placed = ranked(statuses.select("status", "id", F.struct("status", "id").alias("mr_key")), "mr_key").drop("mr_key")
    first = placed.groupBy("status").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "status").select("status", (F.col("rank") - F.col("first")).alias("pos"), "id")


def select_kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return docs.join(kept.select("id").distinct(), "id", "left_semi")


def jaccard(a: F.Column, b: F.Column) -> F.Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))
