"""The prefix trie of conversations: which beginnings they share, and what sharing them saves.

Conversations become sequences of turn digests and are sorted by these over all partitions, so that equal beginnings stand
together and a beginning that very many share is spread over partitions like any other. A run of sorted conversations is a
shard: its trie is a sequence of balanced parentheses. findclose delimits subtrees, ranks of `()` count their leaves,
cumulative arrays give their members and savings, range minima their smallest members.

All but the nodes on the paths of a shard's first and last conversation are whole within it. Those two paths, the shard's
spine, may be shared with its neighbours. Spines are merged, FAN_IN neighbours at a time: what lies between the outermost
paths of a merged run is whole then, and the outermost paths are its spine, until one run is left. The members that end
at a spine's node are hashed as a stream of texts in order, one node's after the other, never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .balanced_parens import Minima, Parentheses
from .mixing import words_in
from .shared import parts, small_batches, valid, written

#: Nodes of a shard; the conversation that reaches this is its last.
SHARD_NODES = 1 << 18
#: Neighbours that are merged at a time.
FAN_IN = 64
#: Members whose ids are one piece of text.
PIECE = 4096
#: Hex digits of a turn's digest.
_CHARS = 32
_NOBODY = hashlib.sha256(b"").hexdigest()
_WHOLE, _SPINE, _ENDS = 0, 1, 2
#: Whole nodes (slot: their parent's in the shard's spine, or -1), nodes of spines (n_children, n_leaves and saved without what comes from the spine itself), and pieces of members' ids.
_ROWS = "kind int, shard long, slot int, digest string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, words long, first boolean, ends string"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_KINDS = [_TYPES[x.split()[1]] for x in _ROWS.split(", ")]
_MERGED = "shard long, slot int, digest string, parent string, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved long, words long, first boolean, whole boolean"
_MERGED_NAMES = [x.split()[0] for x in _MERGED.split(", ")]


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) to (conv_id, turns), one row for each conversation.

    turns: an array of (digest, words) in the order of `turn`, null first; turns of one number come in the order of their
    digests. Turns are equal if the 128-bit digests of role and text are. A null role or text is an empty one. Rows without
    conv_id belong to no conversation and are left out. A conversation is one row of about 40 bytes for each turn.
    """
    role, text = (F.coalesce(valid(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    number = F.col("turn").cast("long")
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(number.isNotNull().alias("known"), number.alias("turn"), digest.alias("digest"), words_in(text).alias("words")).alias("turn"))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def _columns(n: int, **known: object) -> pa.RecordBatch:
    """A batch of _ROWS; what isn't given is null."""
    made = []
    for name, kind in zip(_NAMES, _KINDS, strict=True):
        value = known.get(name)
        made.append(pa.nulls(n, kind) if value is None else pa.array(value if isinstance(value, (list, np.ndarray)) else [value] * n, kind))
    return pa.RecordBatch.from_arrays(made, names=_NAMES)


def _chain(key: str) -> list[str]:
    """Digests of a sequence's beginnings, the empty one first."""
    out = [""]
    for at in range(0, len(key), _CHARS):
        out.append(hashlib.md5((out[-1] + key[at : at + _CHARS]).encode()).hexdigest())
    return out


class _Shard:
    """Sorted conversations as a tree; nodes by preorder."""

    def __init__(self) -> None:
        self.depth, self.parent, self.words, self.ends, self.members = [0], [-1], [0], [0], []
        self.path, self.key, self.first, self.first_path = [0], "", None, [0]

    def add(self, conv_id: int, key: str, words: list[int]) -> None:
        shared, most = 0, min(len(self.key), len(key)) // _CHARS
        if self.key[: most * _CHARS] == key[: most * _CHARS]:
            shared = most
        else:
            while self.key[shared * _CHARS : (shared + 1) * _CHARS] == key[shared * _CHARS : (shared + 1) * _CHARS]:
                shared += 1
        del self.path[shared + 1 :]
        for d in range(shared, len(words)):
            self.parent.append(self.path[-1])
            self.path.append(len(self.depth))
            self.depth.append(d + 1)
            self.words.append(words[d])
            self.ends.append(0)
        self.ends[self.path[-1]] += 1
        self.members.append(conv_id)
        self.key = key
        if self.first is None:
            self.first, self.first_path = key, list(self.path)

    def batches(self, shard: int) -> Iterator[pa.RecordBatch]:
        depth, parent, words, ends, members = (np.array(x, np.int64) for x in (self.depth, self.parent, self.words, self.ends, self.members))
        n = len(depth)
        tree = Parentheses(depth)
        closes = tree.find_close()
        beyond = np.arange(n) + (closes - tree.opens + 1) // 2  # the node after each subtree
        before = np.concatenate([[0], np.cumsum(ends)])
        n_convs = before[beyond] - before[:-1]
        smallest = Minima(members, np.iinfo(np.int64).max).least(before[:-1], before[beyond])
        savings = np.concatenate([[0], np.cumsum((n_convs - 1) * words)])
        saved, leaves = savings[beyond] - savings[:-1], tree.leaves_within(closes)
        slot = np.full(n, -1)
        spine = np.array(sorted({*self.first_path, *self.path}))
        slot[spine] = np.arange(len(spine))
        whole = np.flatnonzero(slot < 0)
        above = parent[whole]
        children = np.bincount(parent[1:], minlength=n)
        for i in range(0, len(whole), 1 << 16):
            at, up = whole[i : i + (1 << 16)], above[i : i + (1 << 16)]
            hashes = [self._hash(before[k], before[k] + ends[k]) for k in at]
            yield _columns(len(at), kind=_WHOLE, shard=shard, slot=slot[up].astype(np.int32), conv_id=smallest[at], depth=depth[at], parent_conv_id=smallest[up], n_convs=n_convs[at], n_children=children[at], n_leaves=leaves[at], saved=saved[at], ends=hashes)
        # of spines' nodes what comes from whole children
        sums = [np.bincount(above, weights=None, minlength=n), np.zeros(n, np.int64), np.zeros(n, np.int64)]
        np.add.at(sums[1], above, leaves[whole])
        np.add.at(sums[2], above, saved[whole])
        digests = dict(zip(self.path, _chain(self.key), strict=True)) | dict(zip(self.first_path, _chain(self.first), strict=True))
        of_first = set(self.first_path)
        names = [digests[k] for k in spine.tolist()]
        yield _columns(len(spine), kind=_SPINE, shard=shard, slot=slot[spine].astype(np.int32), digest=names, conv_id=smallest[spine], depth=depth[spine], n_convs=n_convs[spine], n_children=sums[0][spine], n_leaves=sums[1][spine], saved=sums[2][spine], words=words[spine], first=[k in of_first for k in spine.tolist()])
        for k, name in zip(spine.tolist(), names, strict=True):
            for i in range(before[k], before[k] + ends[k], PIECE):
                yield _columns(1, kind=_ENDS, shard=shard, slot=int(i - before[k]) // PIECE, digest=name, ends=",".join(map(str, self.members[i : min(i + PIECE, before[k] + ends[k])])))

    def _hash(self, begin: int, end: int) -> str:
        return hashlib.sha256(",".join(map(str, self.members[begin:end])).encode()).hexdigest() if end > begin else _NOBODY


def _shards(batches: Iterator[pa.RecordBatch], shard_nodes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, shard = TaskContext.get().partitionId() << 32, _Shard()
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "key", "words")), strict=True):
            shard.add(*row)
            if len(shard.depth) >= shard_nodes:
                yield from shard.batches(number)
                number, shard = number + 1, _Shard()
    if shard.members:
        yield from shard.batches(number)


def _merged(rows: Iterable[dict], last: bool) -> Iterator[dict]:
    """Whole nodes, and the spine, of a run of neighbours from their spines' rows in order. last: there are no further neighbours."""
    stack: list[dict] = []
    kept: list[dict] = []  # the end of the first path

    def pop() -> Iterator[dict]:
        node = stack.pop()
        if node["first"] and not last:
            kept.append(node)
            return
        node |= {"n_leaves": node["n_leaves"] if node["n_children"] else 1, "saved": node["saved"] + (node["n_convs"] - 1) * node["words"], "parent": stack[-1]["digest"] if stack else None, "whole": True}
        if stack:
            stack[-1]["n_children"] += 1
            stack[-1]["n_leaves"] += node["n_leaves"]
            stack[-1]["saved"] += node["saved"]
        yield node

    begun = None
    for row in rows:
        begun = row["shard"] if begun is None else begun
        d = row["depth"]
        if d < len(stack) and stack[d]["digest"] == row["digest"]:
            node = stack[d]
            for c in ("n_convs", "n_children", "n_leaves", "saved"):
                node[c] += row[c]
            node["conv_id"] = min(node["conv_id"], row["conv_id"])
            continue
        while len(stack) > d:
            yield from pop()
        stack.append(row | {"first": row["first"] and row["shard"] == begun, "whole": False, "parent": None})
    if last:
        while stack:
            yield from pop()
        return
    first = [node for node in stack if node["first"]] + kept[::-1]
    for slot, node in enumerate([*first, *(node for node in stack if not node["first"])]):
        yield node | {"slot": slot}


def _merge(spines: DataFrame, last: bool) -> DataFrame:
    """spines (group, and rows of spines) to rows of _MERGED, whose shards are the groups."""
    schema = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in _MERGED.split(", ")])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
        for b in batches:
            yield from ((row.pop("group"), row) for row in b.to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        for group, rows in groupby(grouped(batches), key=lambda x: x[0]):
            held = []
            for node in _merged((row for _, row in rows), last):
                held.append({c: node.get(c) for c in _MERGED_NAMES} | {"shard": group})
                if len(held) == 4096:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
            yield pa.RecordBatch.from_pylist(held, schema)

    spark = spines.sparkSession
    return spines.repartition(parts(spark), "group").sortWithinPartitions("group", "shard", "slot").mapInArrow(run, _MERGED)


def _hashed(pieces: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of pieces of text in order; a task holds one piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], names=["digest", "ends_sha256"])
        for b in batches:
            for digest, text in zip(b.column("digest").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if state is not None and digest == name:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    yield done()
                name, state = digest, hashlib.sha256(text.encode())
        if state is not None:
            yield done()

    return pieces.select("digest", "shard", "slot", "ends").repartition(parts(pieces.sparkSession), "digest").sortWithinPartitions("digest", "shard", "slot").mapInArrow(run, "digest string, ends_sha256 string")


def prefix_trie(sequences: DataFrame, shard_nodes: int = SHARD_NODES, fan_in: int = FAN_IN) -> DataFrame:
    """sequences (conv_id, turns), conv_id without nulls or repeats, to the trie's nodes: (conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    A node is a beginning of `depth` turns, named by its smallest member; the root is that of none, and conversations without
    turns are its members. n_leaves counts the childless nodes of its subtree, itself included; saved_tokens sums
    (n_convs - 1) times the last turn's words over it; ends_sha256 is the digest of the ids, ascending and joined by commas,
    of the members that have no more turns. No conversations make no nodes. Other columns are not read.
    """
    spark = sequences.sparkSession
    small_batches(spark)
    keys = written(sequences.select("conv_id", F.array_join(F.transform("turns", lambda x: x["digest"]), "").alias("key"), F.transform("turns", lambda x: x["words"]).alias("words")), "sequences")
    dealt = keys.repartitionByRange(parts(spark), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    rows = written(dealt.mapInArrow(lambda batches: _shards(batches, shard_nodes), _ROWS), "trie-shards")
    # shards in order, numbered without gaps; the driver gets a count for each partition
    base, n = [], 0
    for part, count in sorted(rows.where(F.col("kind") == _SPINE).groupBy(F.shiftright("shard", 32).cast("int").alias("part")).agg(F.countDistinct("shard")).collect()):
        base.append((part, n))
        n += count
    starts = F.broadcast(spark.createDataFrame(base, "part int, start long"))
    spine = rows.where(F.col("kind") == _SPINE).withColumn("part", F.shiftright("shard", 32).cast("int")).join(starts, "part")
    left = spine.withColumn("shard", F.col("start") + F.col("shard").bitwiseAND((1 << 32) - 1)).select("shard", "slot", "digest", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "words", "first")
    done: list[DataFrame] = []
    while True:
        n = -(-n // fan_in)
        merged = written(_merge(left.withColumn("group", F.floor(F.col("shard") / fan_in)), n <= 1), "merged-spines")
        done.append(merged.where("whole"))
        if n <= 1:
            break
        left = merged.where("NOT whole").drop("parent", "whole")
    shared = done[0]
    for more in done[1:]:
        shared = shared.unionByName(more)
    shared = written(shared.select("digest", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved"), "shared-nodes")
    named = shared.select("digest", "conv_id")
    parents = named.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"]
    of_spines = shared.join(parents, "parent", "left").join(_hashed(rows.where(F.col("kind") == _ENDS)), "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOBODY)))
    within = rows.where(F.col("kind") == _WHOLE).withColumnRenamed("ends", "ends_sha256")
    # a whole node below a spine: its parent's name is that of the merged node; a key of the join has a shard's nodes at most
    slots = spine.select("shard", "slot", "digest").join(named, "digest").select("shard", "slot", F.col("conv_id").alias("above"))
    below = within.where("slot >= 0").join(slots, ["shard", "slot"]).withColumn("parent_conv_id", F.col("above"))
    return of_spines.select(*columns).unionByName(within.where("slot < 0").select(*columns)).unionByName(below.select(*columns))
