"""MinHash near-duplicates: b-bit signatures after band candidates, links confirmed on full sets.

A text's words are its runs of non-space characters with A-Z lower-cased; its set holds its
distinct word shingles. Two texts are linked if 100 * |intersection| >= percent * |union|.

1. One pass gives each document its set's size, a 128-bit digest of the set, band keys of its
   minima and the low bits of the minima packed in bit planes.
2. Documents of equal sets form a class at once (similarity 1), with a number of its own, and only
   one of a class's texts goes on, so copies never meet as pairs.
3. In each band's bucket every member is compared with the bucket's first member by bit
   counts of the packed signatures; the best candidate of each class is confirmed on
   full sets. This joins almost every group in a star of as many pairs as classes.
4. Buckets that still hold several components are compared in blocks, all members against
   all, inside tasks: bit counts first, then full sets, and only links that join two
   components leave the task. So no link between components is lost and no pairs are dealt.
   A bucket has about the square root of its members in each block, BLOCK at least, and a
   block's sets hold about BYTES; so a task holds two such blocks, and a member goes to as many
   tasks as its bucket has blocks.

Classes carry the work; doc_ids only name what comes out, so null and repeated ids do no harm.
Joins with hot buckets and hot first members are dealt to parts.

Cases: null or empty texts and texts of white space have an empty set (n_shingles 0), are
linked with nothing, name their component themselves and are kept; fewer words than the shingle size make one
shingle. A component is named by its smallest doc_id that is not null, by null if it has none. keep_one keeps one row of each
component, of the smallest doc_id (of rows that repeat it with different texts, one). Other columns are not
read. doc_ids are cast to long. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop, spread_join, table
from .words import U, Words, mix, shingle_hashes, shingle_sets, slices

BANDS, ROWS, BITS = 24, 6, 8
HASHES = BANDS * ROWS
#: A candidate is confirmed on full sets if its estimate is at most this much below the threshold: over 4 standard errors.
SLACK = 0.16
#: Members of a block in the comparison of whole buckets at least, and bytes of its sets.
BLOCK, BYTES = 256, 16 << 20

_R = np.random.RandomState(7)
_MUL = (_R.randint(0, 1 << 31, HASHES).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _R.randint(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def minima(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima (rows x HASHES) over the runs of flat that begin at starts."""
    low = (flat ^ (flat >> U(32))).astype(np.uint32)
    out = np.empty((len(starts), HASHES), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(low * _MUL[k] + _ADD[k], starts)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(mins), BANDS), dtype=U)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            keys = keys * U(0xD6E8FEB86659FD93) + mins[:, r::ROWS].astype(U) + U(1)
        keys += np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15)
    return mix(keys).view(np.int64)


def pack(mins: np.ndarray) -> np.ndarray:
    """Low BITS bits of each minimum as bit planes, one row of bytes for each signature."""
    # the mixed value: minima themselves lean to small numbers
    low = mix(mins.astype(U), 5)
    planes = [np.packbits(((low >> U(b)) & U(1)).astype(np.uint8), axis=1) for b in range(BITS)]
    return np.concatenate(planes, axis=1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures, corrected for equal low bits by chance."""
    differ = (a ^ b).reshape(*np.broadcast_shapes(a.shape, b.shape)[:-1], BITS, -1)
    same = 1 - np.bitwise_count(np.bitwise_or.reduce(differ, axis=-2)).sum(axis=-1) / HASHES
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def _schema() -> str:
    return "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary"


def _sign(size: int, full: bool, id_at: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(text_at)):
                part = batch.slice(at, to - at)
                w = Words(part.column(text_at))
                sets = [np.unique(shingle_hashes(w.hash[w.first[i] : w.first[i + 1]], size)) for i in range(to - at)]
                n = np.array([len(s) for s in sets], dtype=np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, U)
                starts = np.concatenate([[0], np.cumsum(n)])[:-1][n > 0]
                h = np.zeros((2, to - at), dtype=U)
                if len(starts):
                    for i in (0, 1):
                        h[i, n > 0] = np.add.reduceat(mix(flat, 11 + i), starts)
                h1, h2 = (pa.array(x.view(np.int64)) for x in h)
                if not full:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n), h1, h2], names=[*(f"c{i}" for i in range(part.num_columns)), "n", "h1", "h2"])
                    continue
                bands, sig = [None] * (to - at), [None] * (to - at)
                if len(starts):
                    mins = minima(flat, starts)
                    for i, k, s in zip(np.flatnonzero(n), band_keys(mins), pack(mins), strict=True):
                        bands[i], sig[i] = k, s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_at).cast(pa.int64()), pa.array(n), h1, h2, pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands", "sig"],
                )

    return run


def _planes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            est = estimate(_planes(batch.column("sig_a")), _planes(batch.column("sig_b")))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est)], names=["a", "b", "est"])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Of two sorted sets without repeats."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            keep = [linked(a[i].values.to_numpy(), b[i].values.to_numpy(), percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _to_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column("text")):
                part = batch.slice(at, to - at)
                sets = shingle_sets(part.column("text"), size)
                h = np.array([[mix(s, 11).sum(dtype=U), mix(s, 12).sum(dtype=U)] for s in sets], dtype=U).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["h1", "h2", "n_shingles", "set"],
                )

    return run


def _blocks(percent: int):
    """All members of two blocks of a bucket, over components: links that join components."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        n = rows.num_rows
        ids, comp, side = (rows.column(c).to_numpy() for c in ("id", "component", "side"))
        band = np.array(rows.column("bands").to_pylist(), dtype=np.int64).reshape(n, BANDS)
        key = rows.column("bucket")[0].as_py() if n else 0
        planes = _planes(rows.column("sig").chunk(0)) if n else np.zeros((0, 1), np.uint8)
        sets = rows.column("set").chunk(0) if n else []
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        alone = not rows.column("across")[0].as_py() and rows.column("bi")[0].as_py() == rows.column("bj")[0].as_py()
        for i in range(n):
            other = (ids > ids[i]) if alone else (side != side[i]) & (ids > ids[i])
            js = np.flatnonzero(other & (comp != comp[i]))
            if not len(js):
                continue
            est = estimate(planes[js], planes[i][None, :])
            js = js[est >= percent / 100 - SLACK]
            if not len(js):
                continue
            # a pair belongs to the first band it shares
            js = js[band[i][(band[js] == band[i]).argmax(axis=1)] == key]
            for j in js:
                p, q = find(int(comp[i])), find(int(comp[j]))
                if p != q and linked(np.sort(sets[i].values.to_numpy()), np.sort(sets[int(j)].values.to_numpy()), percent):
                    root[max(p, q)] = min(p, q)
                    out.append((int(comp[i]), int(comp[j])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


KEY = ["h1", "h2", "n_shingles"]


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Per class of equal sets: KEY, rep (its smallest doc_id), component (the smallest of the component), first (if it holds that one).

    The second result holds doc_id and KEY of each document.
    """
    signed = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sign(size, True, 0, 1), _schema()), "signed")
    classes = signed.where("n_shingles > 0").groupBy(*KEY).agg(F.first(F.struct("bands", "sig")).alias("x"), F.min("doc_id").alias("rep"))
    # numbers are unique, and fixed once the table is written
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), *KEY, "rep", "x.bands", "x.sig"), "classes")
    members = classes.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = cut(members.groupBy("bucket").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1"), "buckets")
    inside = cut(spread_join(members, buckets, ["bucket"], "n", F.xxhash64("id")), "inside")
    pairs = cut(inside.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    signature = lambda x: classes.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"))
    heads = cut(pairs.groupBy("a").agg(F.count("*").alias("n")).join(signature("a"), "a"), "heads")
    stars = spread_join(pairs.join(signature("b"), "b"), heads, ["a"], "n", F.xxhash64("b")).select("a", "b", "sig_a", "sig_b")
    stars = stars.mapInArrow(_estimates, "a long, b long, est double").where(F.col("est") >= percent / 100 - SLACK)
    best = cut(stars.groupBy("b").agg(F.max(F.struct("est", -F.col("a"))).alias("x")).select((-F.col("x.col2")).alias("a"), "b"), "best")
    wanted = classes.join(inside.select("id").distinct(), "id", "left_semi").select("id", *KEY, "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), "text").join(wanted.select("rep").distinct(), F.col("d").eqNullSafe(F.col("rep")), "left_semi")
    sets = texts.select("text").mapInArrow(_to_sets(size), "h1 long, h2 long, n_shingles long, set array<long>")
    # an id that repeats may bring a class's text again, and texts of other classes
    sets = cut(sets.groupBy(*KEY).agg(F.first("set").alias("set")).join(wanted, KEY).select("id", "set"), "sets")
    with_b = best.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    centers = best.groupBy("a").agg(F.count("*").alias("n")).join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    confirmed = spread_join(with_b, cut(centers, "centers"), ["a"], "n", F.xxhash64("b")).select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long")
    found = cut(components(cut(confirmed, "confirmed")), "found")
    named = cut(inside.select("bucket", "id", "n_shingles").join(found, "id", "left").select("bucket", "id", "n_shingles", F.coalesce("component", "id").alias("component")), "named")
    drop(buckets, inside, pairs, heads, best)
    # a bucket's largest component needs no comparison inside, only with the bucket's other members
    counts = named.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s")).groupBy("bucket")
    open_ = counts.agg(F.max(F.struct("c", "component", "s")).alias("big"), F.sum("c").alias("n"), F.sum("s").alias("s"), F.count("*").alias("k")).where("k > 1")
    blocks = lambda n, s: F.greatest(F.ceil(n / F.greatest(F.lit(BLOCK), F.sqrt(F.col("n")))), F.ceil(8 * s / BYTES)).cast("int")
    big = F.col("big")
    open_ = cut(open_.select("bucket", "n", big["component"].alias("big"), blocks(big["c"], big["s"]).alias("nl"), blocks(F.col("n") - big["c"], F.col("s") - big["s"]).alias("no")), "open")
    large = F.col("component") == F.col("big")
    block = F.pmod(F.xxhash64("id"), F.when(large, F.col("nl")).otherwise(F.col("no"))).cast("int")
    across = large | (F.col("other") < F.col("nl"))
    mate = F.col("other") - F.col("nl")
    rest = (
        spread_join(named, open_, ["bucket"], "n", F.xxhash64("id", F.lit("part")))
        .select("bucket", "id", "component", "big", "nl", block.alias("block"), F.explode(F.sequence(F.lit(0), F.when(large, F.col("no")).otherwise(F.col("nl") + F.col("no")) - 1)).alias("other"))
        .select(
            "bucket",
            "id",
            "component",
            across.alias("across"),
            F.when(large, F.col("block")).when(across, F.col("other")).otherwise(F.least("block", mate)).alias("bi"),
            F.when(large, F.col("other")).when(across, F.col("block")).otherwise(F.greatest("block", mate)).alias("bj"),
            F.when(across, large.cast("int")).otherwise(F.col("block")).alias("side"),
        )
        .join(classes.select("id", "bands", "sig"), "id")
        .join(sets, "id")
    )
    more = cut(rest.groupBy("bucket", "across", "bi", "bj").applyInArrow(_blocks(percent), "a long, b long"), "more")
    joined = components(more)
    # links between components rename components
    renamed = found.join(joined.select(F.col("id").alias("component"), F.col("component").alias("further")), "component", "left").select("id", F.coalesce("further", "component").alias("component"))
    final = cut(renamed.unionByName(joined.join(found, "id", "left_anti")), "final")
    drop(named, open_, sets)
    classes = classes.select("id", *KEY, "rep").join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # of a component's classes the one with the smallest doc_id is the first
    names = classes.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "id")).alias("m"))
    out = classes.join(names, "component").select(*KEY, "rep", F.col("m.rep").alias("component"), (F.col("m.id") == F.col("id")).alias("first"))
    return cut(out, "result"), signed.select("doc_id", *KEY)


def membership(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    classes, each = near_duplicates(docs, size, percent)
    out = each.where("n_shingles > 0").join(classes, KEY).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    # empty documents have no class, so they do not meet in one task
    out = out.unionByName(each.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each near-duplicate group: of its smallest doc_id. Columns as in docs."""
    classes, _ = near_duplicates(docs, size, percent)
    nobody = F.lit(-(1 << 63))
    stay = classes.where("first").select("h1", "h2", F.col("n_shingles").alias("n"), F.coalesce("rep", nobody).alias("kept_id"))
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    at = names.index("doc_id"), names.index("text")
    keyed = plain.mapInArrow(_sign(size, False, *at), f"{kinds}, n long, h1 long, h2 long")
    mine = F.col(f"c{at[0]}")
    # the doc_id is part of the key: rows of a hot class spread over tasks, and all but one find no partner
    full = keyed.where("n > 0").withColumn("kept_id", F.coalesce(mine.cast("long"), nobody)).join(stay, ["kept_id", "h1", "h2", "n"], "left_semi")
    full = full.dropDuplicates(["kept_id", "h1", "h2", "n"])
    columns = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return full.select(*columns).unionByName(keyed.where("n = 0").select(*columns))


def op10_minhash(spark, sf_dir):
    return membership(table(spark, sf_dir, "documents"))


#: Shared shingles of all pairs, and components by recursion.
SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w
), n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as x, b.doc_id as y from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), r(x, y) as (select doc_id, doc_id from documents union select r.x, p.y from r join p on r.y = p.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.y) as component_id, min(r.y) = d.doc_id as kept
from documents d join r on r.x = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id, n.n
"""
