"""Contamination of documents by evaluation items. A scan against an empty index raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

WIDTH = 8
#: Query vectors in one broadcast; more are scanned in as many blocks.
BLOCK = 20_000


def _checked(items: DataFrame) -> DataFrame:
    if not items.where("text is not null").limit(1).count():
        raise ValueError("the index of evaluation items is empty")
    return items.where("text is not null")


def unique_items(items: DataFrame) -> DataFrame:
    """Keys ``(suite, item_id)`` that occur more than once; an index may hold each once."""
    return items.groupBy("suite", "item_id").agg(F.count("*").alias("n")).where("n > 1")


def ngram_hits(docs: DataFrame, items: DataFrame, n: int = WIDTH, minimum: bool = False) -> DataFrame:
    """Different ``(id, suite, item_id)`` that share n words in a row.

    Items of fewer words never match; with ``minimum`` they match by as many words as they have.
    """
    items = _checked(items)
    tokens = text.words(text.collapse(F.lower("text")))
    if minimum:
        grams = F.when(F.size(tokens) < n, F.filter(F.array(F.array_join(tokens, " ")), lambda g: g != "")).otherwise(text.windows(tokens, n))
    else:
        grams = text.windows(tokens, n)
    index = items.select("suite", "item_id", F.size(tokens).alias("words"), F.explode(F.array_distinct(grams)).alias("gram"))
    widths = [n]
    if minimum:
        widths += [r.words for r in index.where(F.col("words") < n).select("words").distinct().collect()]
    rows = docs.where("text is not null").select("id", tokens.alias("tokens"))
    parts = F.array_distinct(F.concat(*(text.windows(F.col("tokens"), w) for w in widths)))
    exploded = rows.select("id", F.explode(parts).alias("gram"))
    # No hint: the adaptive plan broadcasts the index if its measured bytes are below the threshold.
    return exploded.join(index.select("suite", "item_id", "gram"), "gram").select("id", "suite", "item_id").distinct()


def status(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``(id, status, n_items)``: flagged if any item was hit, else clean."""
    found = hits.groupBy("id").agg(F.count("*").alias("n_items"))
    return docs.select("id").join(found, "id", "left").select("id", F.when(F.col("n_items") > 0, "flagged").otherwise("clean").alias("status"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"))


def shard_report(docs: DataFrame, hits: DataFrame, items: DataFrame, shard: str) -> DataFrame:
    """``(shard, status, against)``; ``against`` lists the suites of the whole index, which are few."""
    suites = F.array_join(F.array_sort(F.collect_set("suite")), ",").alias("against")
    flagged = docs.select("id", shard).join(hits.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    out = flagged.groupBy(shard).agg(F.max("hit").alias("hit"))
    return out.crossJoin(F.broadcast(_checked(items).agg(suites))).select(shard, F.when(F.col("hit") == 1, "flagged").otherwise("clean").alias("status"), "against")


def word_match(docs: DataFrame, items: DataFrame, against: list[str] | None = None, n: int = WIDTH) -> DataFrame:
    """Ids of documents that share ``min(n, words)`` ASCII words in a row with an item, or are its very words."""
    items = _checked(items)
    if against is not None:
        items = items.where(F.col("suite").isin(against))
    tokens = text.regex_words(F.col("text"))
    index = items.select(tokens.alias("t")).where(F.size("t") > 0)
    short = index.where(F.size("t") < n).select(F.array_join("t", " ").alias("gram"), F.size("t").alias("w")).distinct()
    grams = index.where(F.size("t") >= n).select(F.explode(text.windows(F.col("t"), n)).alias("gram"), F.lit(n).alias("w")).distinct().unionByName(short)
    widths = sorted({n} | {r.w for r in short.select("w").distinct().collect()})
    rows = docs.where("text is not null").select("id", tokens.alias("t"))
    mine = rows.select("id", F.explode(F.array_distinct(F.concat(*(text.windows(F.col("t"), w) for w in widths)))).alias("gram"))
    return mine.join(grams.select("gram").distinct(), "gram", "left_semi").select("id").distinct()


def planted_missing(planted: DataFrame, hits: DataFrame) -> DataFrame:
    """Planted items that no document was caught with."""
    return planted.join(hits, ["suite", "item_id"], "left_anti")


def method_hash(items: DataFrame, header: str = "decontam/v1", n: int = WIDTH) -> DataFrame:
    """One row: SHA-256 over a header and the items in the order of (suite, item_id).

    The index is a test collection and bounded; its items are put in order in one place.
    """
    lines = F.array_sort(F.collect_list(F.struct("suite", "item_id", "text")))
    body = F.array_join(F.transform(lines, lambda x: F.concat(x["suite"], F.lit("\0"), x["item_id"], F.lit("\0"), x["text"], F.lit("\n"))), "")
    head = f"{header}\nngram_n={n}\nembed_model=\n"
    return _checked(items).agg(F.sha2(F.concat(F.lit(head), body), 256).alias("method_hash"))


def embedding_hits(vectors: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """``(vec_id, query_id, cosine)`` at or over the threshold, of every vector with every query.

    Queries are taken in blocks of about ``BLOCK``, whatever their number: a block is one array of unit vectors in
    single precision that is broadcast, and one pass of matrix products over the vectors. Pairs that may reach the
    threshold are worked out again in double precision. Null vectors and those without a length match nothing.
    """
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    kinds = vectors.schema["vec_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"vec_id {kinds[0]}, query_id {kinds[1]}, cosine double"
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).where("query is not null")
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    found = spark.createDataFrame([], schema)

    def unit(rows: pd.Series) -> np.ndarray:
        made = np.array(rows.tolist(), dtype=np.float64)
        size = np.sqrt((made * made).sum(axis=1, keepdims=True)) if len(made) else np.zeros((0, 1))
        return np.divide(made, size, out=np.full_like(made, np.nan), where=size > 0)

    for block in range(blocks):
        part = asked.where(F.col("block") == block).select("query_id", "query").toArrow().to_pandas()
        by_size = {n: (group["query_id"].to_numpy(), unit(group["query"])) for n, group in part.groupby(part["query"].str.len())} if len(part) else {}
        shared = spark.sparkContext.broadcast(by_size)

        def score(batches, shared=shared):
            for batch in batches:
                for n, group in batch.groupby(batch["embedding"].str.len()):
                    ids, theirs = shared.value.get(n, (None, None))
                    if ids is None:
                        continue
                    for at in range(0, len(group), 256):
                        rows = group.iloc[at : at + 256]
                        mine = unit(rows["embedding"])
                        i, j = np.nonzero(mine.astype(np.float32) @ theirs.T.astype(np.float32) >= np.float32(threshold - 1e-5))
                        value = np.einsum("ij,ij->i", mine[i], theirs[j])
                        keep = value >= threshold
                        yield pd.DataFrame({"vec_id": rows["vec_id"].to_numpy()[i[keep]], "query_id": ids[j[keep]], "cosine": value[keep]})

        rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
        found = found.unionByName(rows.mapInPandas(score, schema)) if block else rows.mapInPandas(score, schema)
    return found


def cosine(a: F.Column, b: F.Column) -> F.Column:
    """Cosine of two arrays of numbers in double precision; null if one has no length."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
