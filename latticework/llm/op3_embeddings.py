"""Embedding near-duplicates: sign hashing in tables, exact cosines, connected components.

Vectors are linked if their labels are equal and not null and their cosine in double precision is
at least `least`. Equal vectors of a label form a class first, with a number of its own, and only the class
goes on; its size counts in n_links. (Only vectors of the same doubles share a class, told by 128 bits of hash; they have
a cosine of 1 up to rounding.)

Each of TABLES tables hashes a vector to the signs of PLANES random hyperplanes. At a cosine of
0.98 two vectors agree on a sign with probability 1 - acos(0.98) / pi = 0.936, on a table's 20
signs with 0.268, and in one of 36 tables at least with all but 0.000013.

Vectors that share a bucket are compared in blocks of it, all against all, by one matrix product
in a task. A pair counts in the first table that it shares, so each pair counts once. A task
returns sums for each vector, not pairs: class members linked, and links that join the
block's components. Buckets of one vector drop out before vectors move. A bucket has about the square root of its
vectors in each block, BLOCK at least, and a block's vectors hold about BYTES at most; a task holds two blocks and a vector goes
to as many tasks as its bucket has blocks. Joins with hot buckets are dealt to parts. Cosines
within 1e-9 of the threshold are taken again by one formula, so the size of a bucket does not decide on a pair.

Cases: null vectors, zero vectors, vectors with null or non-finite components, and rows with a null
label link with nothing (n_links 0, a component of their own, kept). Vectors of other lengths than
each other have no cosine and are not linked. Rows that repeat a vec_id are separate vectors in
n_links and share a component by name. A null vec_id is never a component's name. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop, spread_join, table

TABLES, PLANES = 36, 20
#: Vectors of a block in a large bucket at least, bytes of a block; buckets of at most SMALL are compared pair by pair.
BLOCK, BYTES, SMALL = 256, 16 << 20, 16
LEAST = 0.98


def _planes(size: int) -> np.ndarray:
    return np.random.RandomState(1234 + size).standard_normal((size, TABLES * PLANES))


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = (1 << np.arange(PLANES)).astype(np.int64)
    planes = {}
    for batch in batches:
        keys = [None] * batch.num_rows
        vectors = batch.column("embedding")
        sizes = np.array([len(v) for v in vectors], dtype=np.int64)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            x = np.array([vectors[int(i)].values.to_numpy(zero_copy_only=False) for i in rows], dtype=np.float64)
            if size not in planes:
                planes[size] = _planes(int(size))
            # scaled by the largest component, so that no sum overflows and parallel vectors have the same signs
            top = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
            x = np.divide(x, top, out=np.zeros_like(x), where=top > 0)
            signs = (x @ planes[size] >= 0).reshape(len(rows), TABLES, PLANES)
            codes = signs @ weights + (np.arange(TABLES) << PLANES)
            for i, k in zip(rows, codes, strict=True):
                keys[i] = k
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(keys, pa.list_(pa.int64()))], names=["id", "label", "codes"])


class _Rows:
    """Rows of some whole buckets as arrays."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        column = lambda c: rows.column(c).chunk(0)
        self.ids, self.side, self.count, self.code, self.bi, self.bj = (column(c).to_numpy() for c in ("id", "side", "copies", "code", "bi", "bj"))
        label = pa.compute.dictionary_encode(column("label")).indices.to_numpy()
        self.codes = column("codes").flatten().to_numpy().reshape(rows.num_rows, -1)
        lists = column("embedding")
        self.sizes = lists.value_lengths().to_numpy().astype(np.int64)
        flat = lists.flatten().to_numpy().astype(np.float64)
        x = np.zeros((rows.num_rows, int(self.sizes.max())))
        x[np.arange(x.shape[1])[None, :] < self.sizes[:, None]] = flat
        top = np.abs(x).max(axis=1, keepdims=True)
        self.unit = x / top
        self.unit /= np.linalg.norm(self.unit, axis=1, keepdims=True)
        change = (self.code[1:] != self.code[:-1]) | (label[1:] != label[:-1]) | (self.bi[1:] != self.bi[:-1]) | (self.bj[1:] != self.bj[:-1])
        self.starts = np.concatenate([[0], np.flatnonzero(change) + 1, [rows.num_rows]])

    def cosine(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.unit[i], self.unit[j])

    def keep(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs that belong here: of one length, of both blocks, and in the first table that they share."""
        good = (self.sizes[i] == self.sizes[j]) & ((self.bi[i] == self.bj[i]) | (self.side[i] != self.side[j]))
        return good & (self.codes[i, (self.codes[i] == self.codes[j]).argmax(axis=1)] == self.code[i])


def _joined(out: list, r: _Rows, i: np.ndarray, j: np.ndarray, base: int, n: int) -> None:
    """Links of a large bucket as a count for each row and one edge to its component's root."""
    links = np.zeros(n, dtype=np.int64)
    np.add.at(links, i - base, r.count[j])
    np.add.at(links, j - base, r.count[i])
    root = list(range(n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for p, q in zip((i - base).tolist(), (j - base).tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            root[q] = p
    to = np.array([find(v) for v in range(n)])
    keep = np.flatnonzero(links > 0)
    out.append((r.ids[base + keep], links[keep], r.ids[base + to[keep]]))


def _links(rows: pa.Table, least: float) -> pa.RecordBatch | None:
    r = _Rows(rows)
    out: list[tuple] = []
    n = np.diff(r.starts)
    small = np.repeat(n <= SMALL, n)
    end = np.repeat(r.starts[1:], n)
    for d in range(1, int(n[n <= SMALL].max(initial=1))):
        i = np.flatnonzero(small & (np.arange(len(small)) + d < end))
        i = i[r.cosine(i, i + d) >= least]
        i = i[r.keep(i, i + d)]
        out += [(r.ids[i], r.count[i + d], r.ids[i + d]), (r.ids[i + d], r.count[i], r.ids[i])]
    for k in np.flatnonzero(n > SMALL):
        s, e = r.starts[k], r.starts[k + 1]
        cosine = r.unit[s:e] @ r.unit[s:e].T
        i, j = np.nonzero(np.triu(cosine >= least - 1e-9, 1))
        close = np.flatnonzero(cosine[i, j] < least + 1e-9)
        i, j = i + s, j + s
        sure = np.ones(len(i), dtype=bool)
        sure[close] = r.cosine(i[close], j[close]) >= least
        i, j = i[sure], j[sure]
        good = r.keep(i, j)
        if good.any():
            _joined(out, r, i[good], j[good], s, e - s)
    if not out:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out]), pa.int64()) for c in range(3)], names=["id", "links", "to"])


def _compare(least: float):
    """Batches of rows sorted by bucket and block; a bucket's rows may straddle batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            keys = rows.select(["label", "code", "bi", "bj"])
            last = keys.slice(rows.num_rows - 1).to_pylist()[0]
            same = pa.compute.and_(pa.compute.equal(keys["code"], last["code"]), pa.compute.equal(keys["label"], last["label"]))
            same = pa.compute.and_(same, pa.compute.and_(pa.compute.equal(keys["bi"], last["bi"]), pa.compute.equal(keys["bj"], last["bj"]))).to_numpy()
            begin = int(same.argmax())
            held = rows.slice(begin)
            if begin and (found := _links(rows.slice(0, begin), least)) is not None:
                yield found
        if held is not None and (found := _links(held, least)) is not None:
            yield found

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    number = lambda x: x.cast("double")
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    good = good & F.forall("embedding", lambda x: F.coalesce(~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")), F.lit(False)))
    good = good & F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").withColumn("good", F.coalesce(good, F.lit(False)))
    # -0.0 and 0.0 are the same component
    plain = F.transform("embedding", lambda x: number(x) + F.lit(0.0))
    keys = [F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit("second"), F.size("embedding"), plain).alias("h2")]
    rows = cut(rows.select("vec_id", "label", "embedding", "good", *keys), "vectors")
    key = ["label", "h1", "h2"]
    classes = rows.where("good").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    # numbers are unique, and fixed once the table is written
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), *key, "rep", "copies", "embedding"), "classes")
    hashed = cut(classes.select("id", "label", "embedding").mapInArrow(_hash, f"id long, label {dict(vectors.dtypes)['label']}, codes array<long>"), "hashed")
    members = hashed.select("id", "label", F.explode("codes").alias("code"))
    found_in = members.groupBy("label", "code").agg(F.count("*").alias("n")).where("n > 1")
    longest = classes.agg(F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()[0]
    blocks = F.greatest(F.ceil(F.col("n") / F.greatest(F.lit(BLOCK), F.sqrt("n"))), F.ceil(F.col("n") * 8 * longest / BYTES)).cast("int")
    buckets = cut(found_in.select("label", "code", "n", blocks.alias("blocks")), "buckets")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = spread_join(members, buckets, ["label", "code"], "n", F.xxhash64("id", F.lit("part"))).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "label", "code", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), F.col("block").alias("side"))
    full = hashed.select("id", "codes").join(classes.select("id", "copies", "embedding"), "id")
    # a task streams the buckets that it holds: one at a time in memory, none of more than two blocks
    together = dealt.join(full, "id").repartition("label", "code", "bi", "bj").sortWithinPartitions("label", "code", "bi", "bj")
    compared = cut(together.mapInArrow(_compare(least), "id long, links long, to long"), "compared")
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    found = components(compared.select(F.col("id").alias("a"), F.col("to").alias("b")))
    per_class = classes.select("id", *key, "rep", "copies").join(links, "id", "left").join(found, "id", "left")
    per_class = cut(per_class.select(*key, "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component")), "linked")
    names = per_class.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    per_class = cut(spread_join(per_class, names, ["component"], "n", F.col("h1")).select(*key, "copies", "links", "component_id"), "named")
    drop(hashed, buckets, compared)
    out = spread_join(rows.where("good"), per_class, key, "copies", F.coalesce("vec_id", F.lit(0)))
    out = out.select("vec_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    out = out.unionByName(rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embeddings(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
with v as (
  select vec_id, label, embedding::double[] as e, label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as good
  from embeddings
), n as (select vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as u from v where good),
p as (
  select a.vec_id as x, b.vec_id as y from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.u) = len(b.u)
  where list_dot_product(a.u, b.u) >= 0.98
),
d as (select vec_id as x, (select count(*) from p where p.x = vec_id) as n_links from v),
r(x, y) as (select vec_id, vec_id from v union select r.x, p.y from r join p on r.y = p.x)
select d.x as vec_id, d.n_links::bigint as n_links, min(r.y) as component_id, min(r.y) = d.x as kept
from d join r on r.x = d.x group by d.x, d.n_links
"""
SQL = SQL.replace("with v as", "with recursive v as", 1)
