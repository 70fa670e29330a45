"""Mixing sources to target weights: which documents to take, and how often, by thresholds on a hash.

Every document has a hash of its id and text. A source whose target is k times its size and a rest takes each document k
times, and once more those whose hash lies below the source's threshold. The threshold comes from nested histograms: words
are summed by source and hash bucket, the bucket in which the rest of the budget runs out is cut into buckets of its own,
and so on until one hash value is left. Nothing is sorted and no document is shuffled: a round sums in each task first,
and gives at most 4,096 sums for each source, however many rows the source holds. The mix itself is a filter on the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, named_apart, table
from lodestone.storage import broadcast_if_small

#: Weights of the sources in order of code points, null last; repeated as long as there are sources.
WEIGHTS = (5, 2, 1)
#: Words of the mix, as a share of all words.
SHARE = 1.5
#: A document is taken at most so often, and a source's target is at most so many times its size.
MOST_REPEATS = 2
HASH_BITS, BUCKET_BITS = 60, 12
SEED = "mix"
RESULTS = ["size", "source_size", "target", "taken"]


def word_count(text: Column) -> Column:
    """Runs of characters that are no white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def document_hash(seed: str = SEED) -> Column:
    """60 bits of a hash of id and text, which no partitioning and no rerun changes."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(seed), *parts).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(measured: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) of each source.

    Sources share the mix by weight; those whose part would be above `most` times their size stop there and the others
    share what that leaves, until none is above. The words that one unit of weight gets only grow from round to round, so
    a round is one sum over the table of sources, and that number is all that reaches the driver.
    """
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = materialise(sizes.withColumn("weight", F.array(*map(F.lit, weights))[(place % len(weights)).cast("int")].cast("double")), "sources")
    all_words = share * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    limit = most * F.col("source_size").cast("double")
    stopped_before, left, weight = -1, all_words, 0.0
    capped: Column = F.lit(False)
    while True:
        row = sources.agg(F.count(F.when(capped, 1)).alias("n"), F.sum(F.when(capped, limit)).alias("c"), F.sum(F.when(~capped, F.col("weight"))).alias("w")).first()
        if row.n == stopped_before:
            break
        stopped_before, left, weight = row.n, all_words - (row.c or 0.0), row.w or 0.0
        if not weight:
            break
        capped = F.lit(left) * F.col("weight") / F.lit(weight) > limit
    part = F.lit(left) * F.col("weight") / F.lit(weight) if weight else limit
    return sources.select("source", "source_size", F.when(capped, limit).otherwise(part).alias("target"))


def thresholds(measured: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with `repeats`, `cut`, and of the documents whose hash is `cut`: `cut_rows`, `cut_size` and `cut_left`, the words left for them.

    Documents of a smaller hash are taken once more than `repeats`, those of a larger one not. Without a cut (null) the
    rest of the budget holds none (`all_more` false) or all (true) of the source's documents.
    """
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = wanted.withColumn("repeats", repeats.cast("long")).withColumn("cut_left", F.col("target") - F.col("repeats") * F.col("source_size"))
    state = state.withColumns({"prefix": F.lit(0).cast("long"), "cut_rows": F.lit(None).cast("long"), "cut_size": F.lit(None).cast("long"), "cut": F.lit(None).cast("long")})
    state = materialise(state.withColumn("open", F.col("cut_left") > 0), "thresholds")
    for shift in range(HASH_BITS - BUCKET_BITS, -1, -BUCKET_BITS):
        still = state.where("open").select(F.col("source").alias("s"), "prefix", F.col("cut_left").alias("left_before"))
        if still.isEmpty():
            break
        inside = measured.join(broadcast_if_small(still), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BUCKET_BITS) == F.col("prefix")))
        sums = inside.groupBy("s", "left_before", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("own"), F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        until = F.sum("own").over(Window.partitionBy("s").orderBy("bucket"))
        over = sums.withColumn("until", until).where("until > left_before").groupBy("s").agg(F.min_by(F.struct("bucket", "own", "n", "low", "high", (F.col("left_before") - F.col("until") + F.col("own")).alias("rest")), "bucket").alias("b"))
        joined = state.join(over, F.col("source").eqNullSafe(F.col("s")), "left")
        found = F.col("open") & F.col("b").isNotNull()
        changed = {"prefix": "b.bucket", "cut_left": "b.rest", "cut_rows": "b.n", "cut_size": "b.own", "cut": "b.low"}
        state = joined.withColumns({c: F.when(found, F.col(new)).otherwise(F.col(c)) for c, new in changed.items()}).withColumn("open", found & (F.col("b.low") < F.col("b.high"))).drop("s", "b")
        state = materialise(state, "thresholds")
    return state.select("source", "source_size", "target", "repeats", "cut", "cut_rows", "cut_size", "cut_left")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, seed: str = SEED, keep_text: bool = True) -> DataFrame:
    """docs with size (words), source_size, target (its source's, in words) and taken (words that the mix takes of it, repeats counted).

    Documents are taken whole: never, once or as often as `most`. The one at the threshold is taken if that brings the
    source nearer its target, so a source misses it by at most half of one document. Rows equal in id and text share a
    hash; where such a hash is the threshold, each row takes its even share of the words left, so repeated rows cannot
    overshoot, however many they are. A null text has no words, a null source is a source, null ids are like any other
    value. Input columns named as a result (whatever their case) are replaced, others stay. An empty table gives none.
    """
    keep = [c for c in named_apart(docs, RESULTS) if keep_text or c.lower() != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_"))
    measured = docs.select(row.alias("row"), "source", word_count(F.col("text")).alias("size"), document_hash(seed).alias("h"))
    lean = materialise(measured.drop("row") if keep_text else measured, "sizes")
    found = thresholds(lean, targets(lean, weights, share, most)).withColumnRenamed("source", "_source")
    rows = measured if keep_text else lean
    joined = rows.join(broadcast_if_small(found), F.col("source").eqNullSafe(F.col("_source")))
    several = F.floor(F.col("size") * F.col("cut_left") / F.col("cut_size")).cast("long")
    at_cut = F.when(F.col("cut_rows") > 1, several).when(2 * F.col("cut_left") > F.col("cut_size"), F.col("size")).otherwise(0)
    more = F.when(F.col("cut").isNull(), F.when(F.col("cut_left") > 0, F.col("size")).otherwise(0)).when(F.col("h") < F.col("cut"), F.col("size")).when(F.col("h") == F.col("cut"), at_cut).otherwise(0)
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "size", "source_size", "target", (F.col("repeats") * F.col("size") + more).cast("long").alias("taken"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, and its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken", "source")
