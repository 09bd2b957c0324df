"""Prefix trie of conversations: shared beginnings, and the tokens that sharing saves.

Turns are encoded by a dictionary: each distinct (role, text) gets a number. A conversation is the
sequence of its turns' numbers, in the order of turn (null first). Conversations of equal sequences are one class with its number of
members and smallest member, so copies carry no work. Classes are dealt to shards by ranges of their
sequences; a shard holds about TURNS turns. A task builds one shard's ternary search tree: a node holds a turn, the
next turns of the same beginning smaller and larger than it, and the turns that follow it. Sequences are inserted
medians first, so that siblings lie in balanced trees, and the tree is walked with a stack of its own.

A node of the trie may lie in several shards, which are neighbours then. Each shard knows how many turns its first sequence shares with the
last one of the shard before, and its last one with the first of the shard behind (two numbers for each shard). So it knows which of its nodes begin in it and which
end in it, and counts children, leaves and lengths of the former or latter alone; with that all sums of a
boundary node are added up over shards. Boundary nodes carry a digest of their sequence; other nodes are final.

saved_tokens of a node is the sum over its subtree of (n_convs - 1) * length, with the code points of the last text as
length by default. A node's ends are the members that have no further turn; their ids are hashed in ascending order from sorted
ranges, joined in pieces of PIECE ids, so that a task holds a piece of a list at a time.

Cases: null role or text is empty; turns of equal number go by the digest of role and text; repeated rows are turns
of their own; rows without a conv_id belong to no conversation and are left out; conversations without
turns are members of the root alone. An empty table gives an empty result; other columns are not read. A
conversation's turn numbers, 16 bytes a turn, must fit in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread_join, table

#: Turns of a shard, ids of a piece, and shards at most.
TURNS, PIECE, SHARDS = 200_000, 512, 20_000
NODES = "key binary, parent_key binary, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(conversations: DataFrame) -> DataFrame:
    """Per conversation: conv_id, turns (array of (id, n): a turn's number and its text's code points)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.length(text).cast("long").alias("n"))
    rows = cut(rows, "turns")
    numbers = cut(rows.groupBy("digest").agg(F.count("*").alias("size")).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    coded = spread_join(rows, numbers, ["digest"], "size", F.xxhash64("conv_id", "turn")).select("conv_id", F.struct("turn", "digest", "id", "n").alias("t"))
    whole = coded.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["n"].alias("n"))).alias("turns"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, conv_id) in order: pieces of a key's ids, joined."""
    key, first, held = None, 0, []
    out: list[tuple] = []
    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if k != key or len(held) == PIECE:
                if held:
                    out.append((key, first, ",".join(held)))
                key, first, held = k, c, []
            held.append(str(c))
        yield _rows(out)
        out = []
    yield _rows([*out, *([(key, first, ",".join(held))] if held else [])])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["key", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, ids) in order: the digest of a key's ids."""
    key, now = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, now.hexdigest()))
                key, now = k, hashlib.sha256(ids.encode())
            else:
                now.update(b"," + ids.encode())
        yield _digests(out)
    yield _digests([] if key is None else [(key, now.hexdigest())])


def _digests(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["key", "ends"])


def classes(rebuilt: DataFrame) -> DataFrame:
    """Per distinct sequence of conversations (conv_id, turns): ids, lengths, n, least (its smallest member), ends (the digest of its members)."""
    ids = F.transform("turns", lambda t: t["id"])
    key = F.unhex(F.sha2(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), 256))
    rows = cut(rebuilt.select("conv_id", "turns", key.alias("key")), "rebuilt")
    found = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    # a class's sequence comes from its smallest member: no row of a large class but one is moved with its turns
    held = found.join(rows.select(F.col("conv_id").alias("least"), "turns"), "least")
    members = rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = members.mapInArrow(_pieces, "key binary, first long, ids string").repartition("key").sortWithinPartitions("key", "first")
    ends = pieces.select("key", "ids").mapInArrow(_hashed, "key binary, ends string")
    return held.join(ends, "key").select(F.transform("turns", lambda t: t["id"]).alias("ids"), F.transform("turns", lambda t: t["n"]).alias("lengths"), "n", "least", "ends")


def shared(a: Column, b: Column) -> Column:
    """How many first members two arrays have in common; -1 if one is null."""
    differ = F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)) | (i == F.least(F.size(a), F.size(b))))
    return F.when(a.isNull() | b.isNull(), F.lit(-1)).otherwise(F.get(differ, F.lit(0)))


class Tree:
    """Ternary search tree of sequences; node 0 is the root, others hold a turn."""

    def __init__(self):
        self.turn, self.low, self.high, self.down = [-1], [0], [0], [0]  # 0: none
        self.least, self.count, self.length, self.ends = [None], [0], [0], [None]

    def _node(self, turn: int, length: int) -> int:
        for column, value in ((self.turn, turn), (self.low, 0), (self.high, 0), (self.down, 0), (self.least, None), (self.count, 0), (self.length, length), (self.ends, None)):
            column.append(value)
        return len(self.turn) - 1

    def _pass(self, node: int, n: int, least: int) -> None:
        self.count[node] += n
        if self.least[node] is None or least < self.least[node]:
            self.least[node] = least

    def insert(self, ids: list[int], lengths: list[int], n: int, least: int, ends: str) -> None:
        turn, low, high, down = self.turn, self.low, self.high, self.down
        at = 0
        self._pass(at, n, least)
        for t, length in zip(ids, lengths, strict=True):
            side, parent, now = down, at, down[at]
            while now and turn[now] != t:
                side, parent = (low, now) if t < turn[now] else (high, now)
                now = side[now]
            if not now:
                now = side[parent] = self._node(t, length)
            at = now
            self._pass(at, n, least)
        self.ends[at] = ends

    def children(self, node: int) -> list[int]:
        """In ascending order of turns."""
        out, stack, now = [], [], self.down[node]
        while stack or now:
            while now:
                stack.append(now)
                now = self.low[now]
            now = stack.pop()
            out.append(now)
            now = self.high[now]
        return out


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of a range before the middles of its halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            yield (a + b) // 2
            stack += [((a + b) // 2 + 1, b), (a, (a + b) // 2)]


def _key(ids: list[int], lengths: int) -> list[bytes]:
    """Digests of the first 0, 1, ... turns."""
    now, out = hashlib.sha256(), []
    for d in range(lengths + 1):
        if d:
            now.update(b"%d," % ids[d - 1])
        out.append(now.digest())
    return out


def shard_nodes(rows: list[tuple], before: int, behind: int) -> list[tuple]:
    """NODES of one shard, from its classes (ids, lengths, n, least, ends) in order.

    before: turns that the first sequence shares with the shard before (-1: there is none), behind: the last one's with the shard behind.
    Of nodes that lie in other shards too the numbers are this shard's parts.
    """
    tree = Tree()
    for i in medians(len(rows)):
        tree.insert(*rows[i])
    first, last = rows[0][0], rows[-1][0]
    first_keys, last_keys = _key(first, max(before, 0)), _key(last, max(behind, 0))
    # walk: children behind their parent, with depth and whether the path is still that of the first and last sequence
    order, parent, depth, on = [0], [-1], [0], [(before >= 0, behind >= 0)]
    kids: list[int] = []
    at = 0
    while at < len(order):
        found = tree.children(order[at])
        kids.append(len(found))
        d = depth[at] + 1
        f, g = on[at]
        for c in found:
            order.append(c)
            parent.append(at)
            depth.append(d)
            t = tree.turn[c]
            on.append((f and d <= before and first[d - 1] == t, g and d <= behind and last[d - 1] == t))
        at += 1
    n = len(order)
    leaves, saved, born = [0] * n, [0] * n, [0] * n
    out = []
    for k in range(n - 1, -1, -1):
        node, (f, g) = order[k], on[k]
        # a node that goes on in the shard behind has its children there as well; one known from before was counted there
        if not kids[k] and not g:
            leaves[k] += 1
        saved[k] += (tree.count[node] - (0 if f else 1)) * tree.length[node]
        if k:
            p = parent[k]
            leaves[p] += leaves[k]
            saved[p] += saved[k]
            born[p] += not f
    for k in range(n):
        node, (f, g), p = order[k], on[k], parent[k]
        key = first_keys[depth[k]] if f else last_keys[depth[k]] if g else None
        up_key = up = None
        if p >= 0:
            up_key = first_keys[depth[p]] if on[p][0] else last_keys[depth[p]] if on[p][1] else None
            up = None if up_key else tree.least[order[p]]
        out.append((key, up_key, up, tree.least[node], depth[k], tree.count[node], born[k], leaves[k], saved[k], tree.ends[node]))
    return out


_TYPES = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())


def _shard(rows: pa.Table) -> pa.Table:
    names = [c.split()[0] for c in NODES.split(", ")]
    columns = [rows.column(c).to_pylist() for c in ("ids", "lengths", "n", "least", "ends")]
    before, behind = rows.column("before")[0].as_py(), rows.column("behind")[0].as_py()
    out = shard_nodes(sorted(zip(*columns, strict=True)), before, behind)
    return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(_TYPES)], names=names)


def trie(rebuilt: DataFrame, turns: int = TURNS) -> DataFrame:
    """Nodes of conversations (conv_id, turns as sequences() gives them): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    held = cut(classes(rebuilt), "classes")
    total = held.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
    shards = max(1, min(SHARDS, -(-total // turns)))
    dealt = cut(held.repartitionByRange(shards, "ids").withColumn("shard", F.spark_partition_id()), "shards")
    # a row for each shard
    edges = dealt.groupBy("shard").agg(F.min("ids").alias("first"), F.max("ids").alias("last")).withColumn("g", F.lit(0))
    edges = _neighbours(edges)
    whole = dealt.join(F.broadcast(edges), "shard").groupBy("shard").applyInArrow(_shard, NODES)
    nodes = cut(whole, "nodes")
    merged = nodes.where("key is not null").groupBy("key").agg(
        F.first("parent_key").alias("parent_key"),
        F.first("parent_conv_id").alias("parent_conv_id"),
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.max("ends_sha256").alias("ends_sha256"),
    )
    merged = cut(merged, "merged")
    each = nodes.where("key is null").unionByName(merged)
    parents = merged.where("n_children > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"), "n_children")
    lower = spread_join(each.where("parent_key is not null"), parents.withColumnRenamed("n_children", "__size"), ["parent_key"], "__size", F.xxhash64("conv_id", "depth"))
    lower = lower.withColumn("parent_conv_id", F.col("up")).select(*nodes.columns)
    nobody = hashlib.sha256(b"").hexdigest()
    return each.where("parent_key is null").unionByName(lower).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))


def _neighbours(edges: DataFrame) -> DataFrame:
    """shard, before, behind: turns shared with the neighbouring shards, -1 without one. There are SHARDS rows at most."""
    line = Window.partitionBy("g").orderBy("shard")
    near = edges.withColumns({"prior": F.lag("last").over(line), "next": F.lead("first").over(line)})
    return near.select("shard", shared(F.col("prior"), F.col("first")).alias("before"), shared(F.col("last"), F.col("next")).alias("behind"))


def rebuilt(each: DataFrame) -> DataFrame:
    """Conversations whose first turns come from the first conversation of their hundred: crc32(conv_id) mod 6 of them."""
    many = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    heads = each.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    rows = each.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", many).join(heads, "base", "left")
    own = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(F.slice("turns", 1, 0))
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(head, own).alias("turns"))


def op11_trie(spark, sf_dir):
    each = cut(sequences(table(spark, sf_dir, "conversations")), "sequences")
    return trie(rebuilt(each))


#: All prefixes, grouped; sums over subtrees from each node to all its ancestors. DuckDB has no crc32: bit by bit.
SQL = r"""
with recursive t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as turn_key from conversations where conv_id is not null
), s as (select conv_id, list({'k': turn_key, 'n': length(text)} order by turn nulls first, turn_key) as ts from t group by conv_id),
b(conv_id, pos, crc) as (
  select conv_id, 0, 4294967295::bigint from s
  union all
  select conv_id, pos + 1, list_reduce([xor(crc, ascii(substr(conv_id::varchar, pos + 1, 1))::bigint), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)
  from b where pos < length(conv_id::varchar)
), h as (select conv_id, xor(crc, 4294967295) % 6 as h from b where pos = length(conv_id::varchar)),
r as (
  select s.conv_id, list_concat(coalesce(p.ts[1 : h.h], []), s.ts[h.h + 1 :]) as ts from s join h using (conv_id) left join s p on p.conv_id = s.conv_id - s.conv_id % 100
), k as (select conv_id, len(ts) as len, ts, unnest(range(0, len(ts) + 1)) as depth from r),
q as (
  select conv_id, len, depth, case when depth > 0 then ts[depth].n else 0 end as n,
    sha256(array_to_string(list_transform(ts[1 : depth], lambda x: x.k), ',')) as key, case when depth > 0 then sha256(array_to_string(list_transform(ts[1 : depth - 1], lambda x: x.k), ',')) end as up from k
), n as (
  select depth, key, up, any_value(n) as n, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len = depth), '')) as ends from q group by depth, key, up
), c as (select depth - 1 as depth, up as key, count(*) as n_children from n where depth > 0 group by all),
m as (select n.*, coalesce(n_children, 0) as n_children from n left join c using (depth, key)),
a as (
  select distinct m.depth, m.key, m.n_children = 0 as leaf, (m.n_convs - 1) * m.n as own, x.depth as adepth, x.key as akey
  from m join q w on w.conv_id = m.conv_id and w.depth = m.depth and w.key = m.key join q x on x.conv_id = w.conv_id and x.depth <= w.depth
), g as (select adepth as depth, akey as key, count(*) filter (leaf) as n_leaves, sum(own) as saved from a group by all)
select m.conv_id, m.depth::bigint as depth, p.conv_id as parent_conv_id, m.n_convs::bigint as n_convs, m.n_children::bigint as n_children, g.n_leaves::bigint as n_leaves, g.saved::bigint as saved_tokens, m.ends as ends_sha256
from m join g using (depth, key) left join m p on p.depth = m.depth - 1 and p.key = m.up
"""
