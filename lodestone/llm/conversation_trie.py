"""The prefix trie of all conversations, as the Cartesian tree over the LCP array of the sorted conversations.

A turn becomes a digest of its role and text where it is read, so texts are never shuffled. A conversation is the string
of its turns' digests, and equal conversations are counted together, by runs of the sorted table, so a conversation that
a third of all others repeat is split like any other. The distinct strings are then dealt into sorted blocks. Between
neighbours stands the number of leading turns that they share (LCP). A trie node that branches is a longest run of
strings whose LCPs are not below some depth: the node of the Cartesian tree of the LCPs, whose ends are the nearest
smaller values on both sides; nodes of equal LCP between the same ends are one node with more children.

1. Each block finds the nearest smaller values inside it with a stack, and sums its runs. Runs that a block's end leaves
   open, and a block's sums up to each new least value from its beginning, are its summary, a few numbers for each.
2. The driver joins the summaries from block to block: for each block, what open runs gain behind it and before it.
   That is as large as the boundary strings' numbers of branching depths, times the blocks; rows never get there.
3. Each string's runs become rows of their own in a map: a run of depths is expanded to one node for each depth.

A row of the sorted table holds the digests of one conversation, 16 bytes and a length for each turn.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from lodestone.llm.common import materialise, table

DIGEST = 16
#: Turns of one sorted block.
BLOCK_TURNS = 500_000
#: Characters of a piece of a list of ids; the pieces of one list are hashed one after the other.
PIECE = 1 << 16
#: Node rows in an Arrow batch.
BATCH = 20_000
NO_MEMBERS = hashlib.sha256(b"").hexdigest()

_LONGS = pa.list_(pa.int64())
NODES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
_COUNTED = pa.schema([("key", pa.binary()), ("sizes", _LONGS), ("first", pa.int64()), ("cnt", pa.int64()), ("ids", pa.string())])
_RUNS = pa.schema([("block", pa.int32()), ("leading", pa.bool_()), ("lcp", pa.int32()), ("sizes", _LONGS), ("sha", pa.string()), ("high", pa.list_(pa.int32())), ("kids", _LONGS), ("sums", pa.list_(_LONGS)), ("open", pa.list_(pa.bool_())), ("up_conv", pa.int64()), ("up_open", pa.bool_()), ("up_leading", pa.bool_()), ("summary", pa.binary())])


def turn_digest() -> Column:
    """Hexadecimal MD5 of role and text, with the role's length in front, so that no two turns are joined to one string. Nulls are empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def sequences(conversations: DataFrame, *, with_group: Column | None = None) -> DataFrame:
    """(conv_id, turns): each conversation's turns as structs of turn number, digest and UTF-8 bytes of the text, in order.

    A null turn number comes first; turns of equal number stand in the order of their digests; repeated rows are turns of
    their own. Rows without conv_id belong to no conversation and take no part. with_group, an expression of conv_id, is
    kept as `group`, and rows are dealt by it, so that conversations of one group can be joined where they are.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", turn_digest().alias("d"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).alias("t"))
    keys = ["conv_id"]
    if with_group is not None:
        rows, keys = rows.withColumn("group", with_group).repartition("group"), ["group", "conv_id"]
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("turns"))


def lcp(a: bytes, b: bytes) -> int:
    """Leading turns that two strings of digests share."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[: DIGEST * middle] == b[: DIGEST * middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part in batched(rows, BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sizes, conv_id), sorted, to one row for each key and piece of its ids."""

    def pieces() -> Iterator[tuple]:
        key = sizes = first = None
        ids: list[str] = []
        length = 0
        for k, s, c in _rows(batches):
            if ids and (k != key or length >= PIECE):
                yield key, sizes, first, len(ids), ",".join(ids)
                ids, length = [], 0
            if not ids:
                key, sizes, first = k, s, c
            ids.append(str(c))
            length += len(ids[-1]) + 1
        if ids:
            yield key, sizes, first, len(ids), ",".join(ids)

    return _batches(pieces(), _COUNTED)


def _distinct(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted pieces to (key, sizes, least id, number of ids, SHA-256 of the list of ids)."""
    now: tuple | None = None
    n, digest = 0, None
    for key, sizes, first, cnt, ids in rows:
        if now is None or key != now[0]:
            if now is not None:
                yield *now, n, digest.hexdigest()
            now, n, digest = (key, sizes, first), cnt, hashlib.sha256(ids.encode())
        else:
            n += cnt
            digest.update(b"," + ids.encode())
    if now is not None:
        yield *now, n, digest.hexdigest()


@dataclass(slots=True)
class Run:
    """Depths low < d <= high of the string that opens them: the same strings pass through all of them.

    sums: number of conversations, their bytes, bytes of the strings' new turns, leaves, least conv_id, of the strings from
    its own on until the run closes. kids: later strings that leave at depth `high`.
    """

    string: list
    low: int
    high: int
    sums: list[int]
    kids: int = 0
    open: bool = False


def _add(to: list[int], more: list[int]) -> None:
    for i in range(4):
        to[i] += more[i]
    to[4] = min(to[4], more[4])


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted block: its strings with the runs that they open, nearest smaller values as far as the block shows them.

    The block's first string counts as if it shared nothing with the one before; step 3 cuts that off.
    """
    strings: list[list] = []
    stack: list[Run] = []
    last_key, last_length = b"", 0
    for key, sizes, conv, cnt, sha in _distinct(_rows(batches)):
        length, total = len(sizes), sum(sizes)
        shared = lcp(last_key, key) if strings else -1
        parent = None
        if strings:
            stack[-1].sums[3] += shared < last_length
            while stack[-1].low >= shared:
                done = stack.pop()
                _add(stack[-1].sums, done.sums)
            top = stack[-1]
            if top.high > shared:  # the deeper part closes, the rest stays open
                stack[-1] = Run(top.string, top.low, shared, list(top.sums))
                top.string[4].append(stack[-1])
                top.low = shared
            stack[-1].kids += 1
            parent = stack[-1]
        new = total - sum(sizes[: max(shared, 0)])
        string = [not strings, shared, sizes, sha, [], parent]
        run = Run(string, shared, length, [cnt, cnt * total, new, 0, conv])
        string[4].append(run)
        strings.append(string)
        stack.append(run)
        if len(strings) == 1:
            first_key, first_sizes = key, sizes
        last_key, last_length = key, length
    if not strings:
        return
    for below, above in zip(stack[-2::-1], stack[:0:-1], strict=True):
        _add(below.sums, above.sums)
    for run in stack:
        run.open = True
    for string in strings:
        string[4].sort(key=lambda run: run.high)
    summary = {
        "first_key": first_key, "last_key": last_key, "last_length": last_length, "first_sizes": first_sizes,
        "front": [(r.low, r.high, r.kids, r.sums, r.open) for r in strings[0][4]],
        "back": [(r.low, r.high, r.sums[4], r.string is strings[0]) for r in stack],
    }
    block = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        for leading, shared, sizes, sha, runs, parent in strings:
            up = (parent.sums[4], parent.open, parent.string[0]) if parent else (None, None, None)
            yield block, leading, shared, sizes, sha, [r.high for r in runs], [r.kids for r in runs], [r.sums for r in runs], [r.open for r in runs], *up, pickle.dumps(summary) if leading else None

    yield from _batches(rows(), _RUNS)


@dataclass
class Around:
    """What a block's strings need to know of the others: turns shared with the block before, whether its last string is a leaf, and what open runs gain.

    after, before: pieces (deepest depth, sums) and (deepest depth, least conv_id), in order of depth; kids: by depth.
    """

    shared: int
    last_is_leaf: bool
    after: list[tuple[int, list[int]]] = field(default_factory=list)
    kids: dict[int, int] = field(default_factory=dict)
    before: list[tuple[int, int]] = field(default_factory=list)


def _at(pieces: list[tuple], depth: int):
    """The value of the piece that holds depth; None beyond the deepest."""
    i = bisect_left(pieces, depth, key=lambda p: p[0])
    return pieces[i][1] if i < len(pieces) else None


def _joined(blocks: list[tuple[int, dict]]) -> dict[int, Around]:
    """Around each block, from the summaries in order: least values are passed on from block to block, in both directions."""
    shared = [-1] + [lcp(a["last_key"], b["first_key"]) for (_, a), (_, b) in zip(blocks, blocks[1:], strict=False)]
    out = []
    for k, (_, s) in enumerate(blocks):
        out.append(Around(shared[k], k + 1 == len(blocks) or shared[k + 1] < s["last_length"]))
    for k in range(len(blocks) - 2, -1, -1):
        here, there, limit, nxt = out[k], out[k + 1], shared[k + 1], blocks[k + 1][1]
        known = sum(nxt["first_sizes"][:limit])
        here.kids[limit] = 1
        for low, high, kids, sums, is_open in nxt["front"]:
            top = min(high, limit)
            if low >= top and not (low < 0 <= top):
                break
            if high <= limit:
                here.kids[high] = here.kids.get(high, 0) + kids
            base = list(sums)
            base[2] -= known
            base[3] += is_open and there.last_is_leaf
            if not is_open:
                here.after.append((top, base))
                continue
            before = low
            for deep, more in there.after:
                if deep <= before:
                    continue
                both = list(base)
                _add(both, more)
                before = min(deep, top)
                here.after.append((before, both))
                if before == top:
                    break
            if before < top:
                here.after.append((top, base))
            for depth, n in there.kids.items():
                if low < depth <= top:
                    here.kids[depth] = here.kids.get(depth, 0) + n
    for k in range(1, len(blocks)):
        here, limit = out[k], shared[k]
        for low, high, conv, leading in blocks[k - 1][1]["back"]:
            top, before = min(high, limit), low
            if leading:
                for deep, least in out[k - 1].before:
                    if before < deep and before < top:
                        here.before.append((min(deep, top), min(conv, least)))
                        before = min(deep, top)
            if before < top:
                here.before.append((top, conv))
    return {block: around for (block, _), around in zip(blocks, out, strict=True)}


def _expand(row: tuple, near: dict[int, Around]) -> Iterator[tuple]:
    """The nodes that a string adds to those before it."""
    block, leading, shared, sizes, sha, highs, kids, sums, opens, up_conv, up_open, up_leading, _ = row
    around = near[block]
    length = len(sizes)
    upto = [0]
    for n in sizes:
        upto.append(upto[-1] + n)

    def least(conv: int, depth: int, is_open: bool, is_leading: bool) -> int:
        if is_open and (more := _at(around.after, depth)):
            conv = min(conv, more[4])
        if is_leading and depth <= around.shared and (other := _at(around.before, depth)) is not None:
            conv = min(conv, other)
        return conv

    own_new = upto[length] - upto[max(shared, 0)]
    if leading:
        shared = around.shared
        if shared >= 0:
            at = bisect_left(highs, shared)
            up_conv, up_open, up_leading = sums[at][4], opens[at], True
    parent = least(up_conv, shared, up_open, up_leading) if shared >= 0 else None
    for depth in range(shared + 1, length + 1):
        at = bisect_left(highs, depth)
        n, all_bytes, new, leaves, conv = sums[at]
        children = (depth < length) + (kids[at] if depth == highs[at] else 0)
        if opens[at]:
            children += around.kids.get(depth, 0)
            leaves += around.last_is_leaf
            if more := _at(around.after, depth):
                n, all_bytes, new, leaves, conv = n + more[0], all_bytes + more[1], new + more[2], leaves + more[3], min(conv, more[4])
        above = upto[max(depth - 1, 0)]
        saved = (all_bytes - n * above) - (new - own_new) - (upto[length] - above)
        yield conv, depth, parent, n, children, leaves, saved, sha if depth == length else NO_MEMBERS
        parent = conv


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of all sequences (conv_id, turns: structs with digest `d` and bytes `n`), one row each.

    conv_id is a node's smallest member, depth its number of turns, parent_conv_id its parent's conv_id (null at the
    root), n_convs its members, n_children and n_leaves as named (a childless node is its own leaf), saved_tokens the sum
    over its subtree of (n_convs - 1) times the bytes of a node's last text, ends_sha256 the SHA-256 of the ids of those
    members that end there. A sequence without turns ends at the root. No sequences give no rows, not even a root.
    """
    spark = sequences.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["d"]), ""))
    plain = materialise(sequences.select(key.alias("key"), F.transform("turns", lambda t: t["n"]).alias("sizes"), "conv_id"), "sequences")
    turns = plain.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    n = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // BLOCK_TURNS)))
    counted = materialise(plain.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_counted, from_arrow_schema(_COUNTED)), "counted")
    runs = materialise(counted.repartitionByRange(n, "key").sortWithinPartitions("key", "first").mapInArrow(_block, from_arrow_schema(_RUNS)), "runs")
    blocks = [(r.block, pickle.loads(r.summary)) for r in runs.where("summary IS NOT NULL").select("block", "summary").orderBy("block").collect()]
    near = spark.sparkContext.broadcast(_joined(blocks))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((node for row in _rows(batches) for node in _expand(row, near.value)), NODES)

    return runs.withColumn("summary", F.lit(None).cast("binary")).mapInArrow(nodes, from_arrow_schema(NODES))


#: A conversation takes its first turns from the one whose id is the next lower multiple of this, at most so many less one.
GROUP, OPENINGS = 5, 9


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with the first crc32(conv_id) % 9 turns of conversation conv_id - conv_id % 5 in place of its own."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = sequences(conversations, with_group=F.col("conv_id") - F.col("conv_id") % GROUP)
    openings = own.where(F.col("conv_id") == F.col("group")).select("group", F.slice("turns", 1, OPENINGS - 1).alias("opening"))
    joined = own.join(openings, "group", "left").withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS).cast("int"))
    none = F.array().cast(own.schema["turns"].dataType)
    rebuilt = F.concat(F.slice(F.coalesce("opening", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return prefix_trie(joined.select("conv_id", rebuilt.alias("turns")))
