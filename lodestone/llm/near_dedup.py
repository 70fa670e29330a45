"""Near-duplicates by BagMinHash: weighted Jaccard similarity of five-word shingle multisets of at least 0.8.

1. Equal texts form classes; one pass over the whole texts makes a signature of BANDS * ROWS registers for each.
2. Classes whose signatures agree on a band share a bucket. Each is compared with the bucket's least class, not with
   all others; hits are verified by the exact multiset overlap, and connected components follow.
3. What the least classes can't decide gets an exact rest: in a bucket whose classes lie in several components, those
   outside its largest component are compared, in blocks, with all of its classes in other components. There every
   pair that shares an element of its prefixes (sets of similarity 0.8 must, as each prefix is the fifth of least
   hashes) is verified exactly, and only one link for each two components leaves a block; then they are final.

A pair of similarity 0.8 shares a bucket with probability 1 - (1 - 0.8^5)^24 = 0.9999. Nothing grows with the square of a
group but the rest, and there only for classes outside a bucket's largest component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bagminhash import multiset, numbered, signatures
from lodestone.llm.common import map_texts, materialise, text_chunks
from lodestone.llm.graph import components
from lodestone.llm.words import mix, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Classes, and members of their multisets, of one block of the rest.
BLOCK, BLOCK_MEMBERS = 256, 1 << 17


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text and band hashes (none for a text without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                text, element, count = multiset(words(texts), SHINGLE)
                point = signatures(text, element, count, len(texts), BANDS * ROWS)
                some = np.zeros(len(texts), bool)
                some[text] = True
                band = np.zeros((len(texts), BANDS), np.uint64)
                for r in range(ROWS):
                    band = mix(band + point[:, r::ROWS])
                band = mix(band + np.arange(BANDS, dtype=np.uint64))
                sizes = some * BANDS
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(band[some].ravel().view(np.int64), sizes)], names=["doc_id", "key", "bands"])

    shape = T.StructType([docs.schema["doc_id"], T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"), "text").mapInArrow(sign, shape)


def _member_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and members: the sorted multiset of each node's text, repeated shingles numbered apart."""
    wanted = classes.join(nodes, "node").select("node", "key", "doc_id")
    texts = docs.select(F.unhex(F.sha2("text", 256)).alias("k"), F.col("doc_id").alias("d"), "text")
    found = wanted.join(texts, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "text")

    def overlap_sets(texts: pa.Array, _: pa.RecordBatch) -> list:
        text, element = numbered(*multiset(words(texts), SHINGLE))
        element = element.view(np.int64)[np.lexsort((element.view(np.int64), text))]
        return [_lists(element, np.bincount(text, minlength=len(texts)))]

    return materialise(map_texts(found, overlap_sets, "members array<long>", keep_text=False).select("node", "members").dropDuplicates(["node"]), "members")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose multisets overlap enough."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    n, m = F.size("x"), F.size("y")
    fits = F.least(n, m) >= SIMILARITY * F.greatest(n, m)
    both = F.size(F.array_intersect("x", "y"))
    return joined.where(fits).where(both >= SIMILARITY * (n + m - both)).select("a", "b")


def _prefixes(members: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of which two sets of similarity SIMILARITY share one at least, sorted, with the set of each: of n those of the n - ceil(SIMILARITY * n) + 1 least hashes."""
    n = np.diff(bounds)
    k = np.minimum(n, n - np.ceil(SIMILARITY * n - 1e-9).astype(np.int64) + 1)
    of = np.repeat(np.arange(len(n)), k)
    elements = members[np.repeat(bounds[:-1] - np.cumsum(k) + k, k) + np.arange(k.sum())]
    order = np.argsort(elements, kind="stable")
    return elements[order], of[order]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks, one link (a, b) for each two components that a verified pair of theirs joins."""
    for batch in batches:
        for i in range(batch.num_rows):
            sides = []
            for side in "xy":
                root, members = (batch.column(f"{side}_{c}")[i].values for c in ("root", "members"))
                sides.append((root.to_numpy(), members.flatten().to_numpy(), np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy())])))
            (xr, xm, xb), (yr, ym, yb) = sides
            size, sizes = np.diff(yb), np.diff(xb)
            element, of = _prefixes(xm, xb)
            asked, by = _prefixes(ym, yb)
            first, last = np.searchsorted(element, asked), np.searchsorted(element, asked, "right")
            order = np.argsort(by, kind="stable")
            bounds = np.searchsorted(by[order], np.arange(len(yr) + 1))
            links = set()
            for k in range(len(yr)):
                own = ym[yb[k] : yb[k + 1]]
                met = np.zeros(len(xr), bool)
                for j in order[bounds[k] : bounds[k + 1]].tolist():
                    met[of[first[j] : last[j]]] = True
                near = np.flatnonzero(met & (xr != yr[k]) & (np.minimum(sizes, size[k]) >= SIMILARITY * np.maximum(sizes, size[k])))
                if len(near):
                    n = sizes[near]
                    at = np.repeat(xb[near] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    found = own[np.minimum(np.searchsorted(own, xm[at]), len(own) - 1)] == xm[at]
                    both = np.add.reduceat(found.astype(np.int64), np.cumsum(n) - n)
                    links.update((min(int(r), int(yr[k])), max(int(r), int(yr[k]))) for r in xr[near[both >= SIMILARITY * (n + size[k] - both)]])
            a, b = zip(*sorted(links), strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _block_count(*which) -> F.Column:
    """Blocks of about BLOCK rows and BLOCK_MEMBERS members, of the rows for which the condition holds."""
    rows, members = (F.sum(F.when(which[0], x)) if which else F.sum(x) for x in (F.lit(1), F.col("size")))
    return F.ceil(F.greatest(rows / BLOCK, members / BLOCK_MEMBERS)).cast("int")


def _rest(buckets: DataFrame, sets: DataFrame, label: DataFrame) -> DataFrame:
    """Links between components whose members share a bucket: those outside a bucket's largest component against all the bucket's.

    The rows of a bucket are dealt into blocks while they are ids only; the multisets join them by node and meet by
    bucket and block, so that no task gets a whole bucket's.
    """
    of = buckets.join(label, "node", "left").select("bucket", "node", F.coalesce("root", F.col("node")).alias("root"))
    counts = of.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("largest")).where("roots > 1 and n > 2")
    of = materialise(of.join(mixed.select("bucket", "largest"), "bucket").join(sets.select("node", F.size("members").alias("size")), "node"), "mixed")
    outside = F.col("root") != F.col("largest")
    sizes = of.groupBy("bucket").agg(_block_count().alias("x_blocks"), _block_count(outside).alias("y_blocks"))
    dealt = of.join(sizes, "bucket").select("bucket", "node", "root", "y_blocks", F.pmod(F.xxhash64("node"), "x_blocks").cast("int").alias("x_block"), F.when(outside, F.pmod(F.xxhash64("node"), "y_blocks").cast("int")).alias("y_block"))
    full = dealt.join(sets, "node")

    def arrays(side: str) -> list:
        return [F.col(f"r.{c}").alias(f"{side}_{c}") for c in ("root", "members")]

    held = F.collect_list(F.struct("root", "members")).alias("r")
    x = full.groupBy("bucket", "x_block", "y_blocks").agg(held).select("bucket", F.explode(F.sequence(F.lit(0), F.col("y_blocks") - 1)).alias("block"), *arrays("x"))
    y = full.where("y_block IS NOT NULL").groupBy("bucket", F.col("y_block").alias("block")).agg(held).select("bucket", "block", *arrays("y"))
    return x.join(y, ["bucket", "block"]).drop("bucket", "block").mapInArrow(_compare, "a long, b long").distinct()


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """key, doc_id (the least of the equal texts), root (one node for each group of near-duplicates), node: a row for each distinct text."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = _signed(docs)
    first = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    classes = materialise(first.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = classes.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    buckets = materialise(rows.join(shared, "bucket").select("bucket", "node", "least"), "buckets")
    stars = materialise(buckets.where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    nodes = stars.select(F.col("a").alias("node")).union(stars.select(F.col("b").alias("node"))).distinct()
    sets = _member_sets(nodes, classes, docs)
    label = components(_verified(stars, sets))
    rest = materialise(_rest(buckets.select("bucket", "node"), sets, label.select(F.col("a").alias("node"), F.col("b").alias("root"))), "rest")
    if rest.limit(1).count():
        label = components(label.union(rest))
    return classes.select("key", "doc_id", "node").join(label.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("key", "doc_id", "node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, class_id (least doc_id of the near-duplicates that it is linked with, over any number of links) and same_text_id (least doc_id of equal texts).

    Null and wordless texts are near no other text; a null text equals an empty one; repeated rows share a class; a
    class of null ids only has null ids; an empty table gives no rows.
    """
    classes = materialise(near_duplicate_classes(docs), "grouped")
    groups = classes.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = classes.join(groups, "root").select("key", "class_id", F.col("doc_id").alias("same_text_id"))
    return docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key")).join(named, "key").select("doc_id", "class_id", "same_text_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: the least doc_id (null last), of repeated rows one.

    Repeated rows become one before they are shuffled, and rows are dealt by text and id, so that many copies of a text
    share no task; the join needs no further shuffle of the texts.
    """
    classes = near_duplicate_classes(docs)
    chosen = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("c"))
    key, own = (_free(docs, n) for n in ("own_key", "own_id"))
    known = lambda column: F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))  # noqa: E731  an id that is not null
    chosen = chosen.select(F.col("c.key").alias(key), known("c.doc_id").alias(own))
    rows = docs.withColumns({key: F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), own: known("doc_id")})
    return rows.dropDuplicates([key, own]).join(chosen, [key, own], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def _free(docs: DataFrame, name: str) -> str:
    """The name, longer if docs has such a column."""
    while name in (c.lower() for c in docs.columns):
        name += "_"
    return name


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from lodestone.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
