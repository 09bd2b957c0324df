"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating; each gets its
weight's share of all words, at most `most` times its own words, the excess reshared by weight.
With caps sorted by cap / weight the water level has a closed form, so no iteration is needed.

Quotas: a block is `unit` words, the same for all: `block`, or less where the sources hold under
FEWEST blocks on average, so one small source does not shrink the blocks of all. All blocks of the
mix are dealt to sources by the highest quotients target / (2 seats - 1); a source has seats for at most `most`
times its words, and what it cannot seat goes on to the next quotients. A source is dealt to shards by a
hash, and its seats go to them by the highest quotients of their words in the same way.
Of all quotients only those near the border are ranked: with n parties of sum T and S seats, quotients
over T / (2S - n) are at most S, those over T / (2S + n) at least S, so the first are seated without
ranking and 2n rows at most are ranked for the rest. This is exact for any sizes. Ties
go by source (null last) or shard, then seat.

Selection: a shard of n words is cut into m pieces of a block each (smaller ones where it has few),
and its seats' words are dealt to pieces: each is taken q div m times, and the q mod m first of a
seeded permutation i * step + start mod m once more; step is prime to m, drawn by the seed from the middle
third of m. A document's selection is its ranges of words that lie in taken pieces, each with its number of
repeats; taken is the number of those words, repeats counted. remade() gives documents the selected text:
pass t over the document holds the ranges taken t times or more, with the white space between their words;
passes are separated by a newline.

Ranks over sources and shards are made in ranges, so no task holds all of them; a task sorts one shard's documents.

Cases: null texts have size 0 and take 0; a null source is a source of its own, last. Repeated
rows are separate documents; a null doc_id is dealt by its text. With no words at all, targets and taken are 0.
Documents without words are returned. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, ordered, table

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
#: Words in a block, and about how many words a shard holds.
BLOCK, SHARD = 64, 100_000
#: What separates words, as in WORD.
SPACE = r"[\x20\x09-\x0D]"
RANGES = "array<struct<begin:long,end:long,times:long>>"
#: Blocks that a source holds on average at least, and pieces of a shard; words are the smallest block.
FEWEST = 256
#: Sources that are sent to all tasks at most; more are joined in parts.
SENT, PARTS = 10_000, 32


def sized(docs: DataFrame, seed: str = SEED, carry: bool = False) -> DataFrame:
    """doc_id, source, size and key, a seeded digest; with carry all columns of docs as a struct besides."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")))))
    key = F.md5(F.concat(F.lit(seed), name))
    return docs.select("doc_id", "source", size.alias("size"), key.alias("key"), *([F.struct(*docs.columns).alias("row")] if carry else []))


def targets(each: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: source, sid (its number from 1), source_size, weight, target."""
    sources = ordered(each.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").isNull(), F.col("source")], "sid")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")).cast("double")
    sources = sources.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    ratio = F.col("cap") / F.col("weight")
    line = cut(ordered(sources, [ratio, F.col("sid")], "at", cap_upto="cap", weight_upto="weight"), "sources")
    everything, whole = line.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level = (F.lit(everything or 0.0) - F.col("cap_upto") + F.col("cap")) / (F.lit(whole or 0.0) - F.col("weight_upto") + F.col("weight"))
    # the first source in this order that stays below its cap sets the level for itself and all after it
    first = line.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", "at")).first()[0]
    target = F.col("cap") if first is None else F.least("cap", F.lit(first) * F.col("weight"))
    return line.select("source", "sid", "source_size", "weight", target.alias("target"))


def _seat_of(wish: Column, level: Column, most: Column) -> Column:
    """Seats of a wish whose quotients are at least level, at most `most`."""
    return F.greatest(F.lit(0.0), F.least(most, F.floor((wish / level + 1) / 2))).cast("long")


#: Room for rounding in the bounds between which quotients are ranked, and a level that no quotient reaches.
_ROOM, _NEVER = 1e-9, 1e300


def _ranked(bounded: DataFrame, names: list[str]) -> DataFrame:
    """Adds `given` to rows with a wish, `base` seats, `upto` seats to try and `left`, the seats that their group g has to give beyond the bases."""
    tries = bounded.withColumn("seat", F.explode(F.when(F.col("upto") > F.col("base"), F.sequence(F.col("base") + 1, F.col("upto")))))
    tries = tries.select("g", *names, "left", "seat", (F.col("wish") / (2 * F.col("seat") - 1)).alias("quotient"))
    line = cut(ordered(tries, [F.col("g"), F.col("quotient").desc(), *map(F.col, names), F.col("seat")], "rank"), "quotients")
    before = line.groupBy("g").agg((F.min("rank") - 1).alias("before"))
    won = line.join(before, "g").where(F.col("rank") - F.col("before") <= F.col("left")).groupBy("g", *names).agg(F.count("*").alias("won"))
    return bounded.join(won, ["g", *names], "left").withColumn("given", F.col("base") + F.coalesce("won", F.lit(0)))


def _rounded(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def seats_of_sources(goal: DataFrame, seats: int, unit: int, most: int = MOST) -> DataFrame:
    """Of goal (sid, source_size, target): sid, given. A source seats at most `most` times its words."""
    rows = goal.where("target > 0").select("sid", F.col("target").alias("wish"), _rounded(F.col("source_size") * most / F.lit(float(unit))).alias("cap"))
    rows = cut(rows, "wishes")
    seats = min(seats, rows.agg(F.sum("cap")).first()[0] or 0)
    high = low = _NEVER
    while seats:
        # sources that are full at a level that seats too few are full in the end
        full = _seat_of(F.col("wish"), F.lit(low), F.col("cap")) >= F.col("cap")
        n, wish, held = rows.agg(F.count(F.when(~full, 1)), F.sum(F.when(~full, F.col("wish"))), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0))).first()
        left = seats - held
        if not n or not left:
            high = low
            break
        high = min(low, wish / (2 * left - n) * (1 + _ROOM)) if 2 * left > n else low
        low = wish / (2 * left + n) * (1 - _ROOM)
        if rows.agg(F.sum(_seat_of(F.col("wish"), F.lit(low), F.col("cap")))).first()[0] >= seats:
            break
    base, upto = (_seat_of(F.col("wish"), F.lit(x), F.col("cap")) for x in (high, low))
    bounded = rows.withColumn("base", base).withColumn("upto", upto).withColumn("g", F.lit(1))
    seated = bounded.agg(F.sum("base")).first()[0] or 0
    return _ranked(bounded.withColumn("left", F.lit(seats - seated)), ["sid"]).select("sid", "given")


def seats_of_shards(parts: DataFrame) -> DataFrame:
    """parts (sid, shard, n, seats) with `given`: the seats of a source go to its shards by their words.

    All shards are full at the same quotient, so the seats that a shard has no room for are those that none has.
    """
    sums = parts.groupBy("sid").agg(F.sum("n").cast("double").alias("total"), F.count("*").alias("shards"))
    rows, two = parts.join(sums, "sid").withColumn("wish", F.col("n").cast("double")), 2.0 * F.col("seats")
    high = F.when(two > F.col("shards"), F.col("total") / (two - F.col("shards")) * (1 + _ROOM)).otherwise(_NEVER)
    low = F.col("total") / (two + F.col("shards")) * (1 - _ROOM)
    base, upto = (_seat_of(F.col("wish"), x, F.lit(1e18)) for x in (high, low))
    bounded = cut(rows.select(F.col("sid").alias("g"), "shard", "n", "wish", "seats", base.alias("base"), upto.alias("upto")), "bounds")
    seated = bounded.groupBy("g").agg(F.sum("base").alias("seated"))
    return _ranked(bounded.join(seated, "g").withColumn("left", F.col("seats") - F.col("seated")), ["shard"]).select(F.col("g").alias("sid"), "shard", "n", "given")


def _number(digest: Column, at: int, size: int) -> Column:
    return F.conv(F.substring(digest, at, size), 16, 10).cast("long")


def _permuted(quota: DataFrame, seed: str) -> DataFrame:
    """Adds start and step, prime to m, of a shard's permutation. Of 64 numbers in a row one is prime to any m below 2^40 at least."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), "sid", F.lit(":"), "shard"))
    third = F.expr("m div 3")
    out = quota.withColumn("start", _number(digest, 1, 7)).withColumn("from", third + _number(digest, 8, 7) % F.greatest(F.lit(1), third))
    gcd = "aggregate(sequence(1, 64), named_struct('a', (from + j) % m, 'b', m), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)"
    return out.withColumn("step", F.expr(f"(from + filter(sequence(0L, 63L), j -> {gcd} = 1)[0]) % m")).drop("from")


def _with_goal(rows: DataFrame, goal: DataFrame, few: bool) -> DataFrame:
    """rows with their source's sid, shards, source_size and target."""
    g = goal.select(F.col("source").alias("__s"), "sid", "source_size", "target", "shards")
    same = F.col("source").eqNullSafe(F.col("__s"))
    if few:
        return rows.join(F.broadcast(g), same).drop("__s")
    # any source may hold a third of all rows
    g = g.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = rows.withColumn("__in", (_number(F.col("key"), 1, 8) % PARTS).cast("int"))
    return rows.join(g, same & (F.col("__in") == F.col("__part"))).drop("__s", "__in", "__part")


def selected(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: str = SEED, carry: bool = False) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, ranges; with carry the columns of docs as the struct row instead of the first two.

    ranges: the taken ranges of words in ascending order, array of (begin, end exclusive, times); words count from 0.
    """
    each = cut(sized(docs, seed), "sized")
    goal = cut(targets(each, weights, most).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long")), "targets")
    rows, sources, words, wanted = goal.agg(F.count("*"), F.count(F.when(F.col("source_size") > 0, 1)), F.sum("source_size"), F.sum("target")).first()
    unit = max(1, min(block, (words or 0) // (FEWEST * max(1, sources))))
    seats = int((wanted or 0.0) / unit + 0.5)

    def deal(x: DataFrame) -> DataFrame:
        return _with_goal(x, goal, rows <= SENT).withColumn("shard", _number(F.col("key"), 1, 8) % F.col("shards"))

    dealt = deal(each)
    shards = dealt.groupBy("sid", "shard").agg(F.sum("size").alias("n")).where("n > 0")
    quota = seats_of_shards(cut(shards.join(seats_of_sources(goal, seats, unit, most).withColumnRenamed("given", "seats"), "sid"), "shards"))
    quota = quota.withColumn("m", F.greatest(_rounded(F.col("n") / unit), F.least("n", F.lit(FEWEST))).cast("long"))
    quota = quota.withColumn("q", F.least(_rounded(F.col("given") * unit * F.col("m") / F.col("n")), F.col("m") * most))
    quota = cut(_permuted(quota, seed).select("sid", "shard", "n", "m", "q", "start", "step"), "quotas")
    line = Window.partitionBy("sid", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = (deal(sized(docs, seed, True)) if carry else dealt).withColumn("end", F.sum("size").over(line)).join(quota, ["sid", "shard"], "left")
    # piece i holds the words from i * n div m to (i + 1) * n div m
    first, last = F.expr("(end - size) * m div n"), F.expr("(end - 1) * m div n")
    ranges = F.expr(
        "filter(transform(sequence(greatest(0, first - 1), least(m - 1, last + 1)), i -> named_struct("
        "'begin', greatest(0L, i * n div m - (end - size)), 'end', least(end, (i + 1) * n div m) - (end - size), "
        "'times', q div m + if((i * step + start) % m < q % m, 1L, 0L))), x -> x.end > x.begin and x.times > 0)"
    )
    out = out.withColumn("first", first).withColumn("last", last)
    ranges = F.when((F.col("size") > 0) & F.col("m").isNotNull(), ranges).otherwise(F.array()).cast(RANGES)
    return out.select(*(["row"] if carry else ["doc_id", "source"]), "size", "source_size", "target", ranges.alias("ranges"))


def _taken(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["begin"]) * x["times"])


def _carried(columns: list[str]) -> list[Column]:
    """Columns of docs named as the result's own get a prefix."""
    own = ("size", "source_size", "target", "taken")
    return [F.col("row").getField(c).alias(f"doc_{c}" if c in own else c) for c in columns]


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: str = SEED, carry: bool = False) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken; with carry all columns of docs instead of the first two."""
    first = _carried(docs.columns) if carry else ["doc_id", "source"]
    return selected(docs, weights, most, block, shard, seed, carry).select(*first, "size", "source_size", "target", _taken(F.col("ranges")).alias("taken"))


def remade_text(text: Column, ranges: Column) -> Column:
    """The words of ranges in text, repeats included."""
    words = F.regexp_extract_all(text, F.lit(WORD + SPACE + "*"), F.lit(0))

    def passes(x: Column) -> Column:
        part = lambda y: F.array_join(F.slice(x["words"], (y["begin"] + 1).cast("int"), (y["end"] - y["begin"]).cast("int")), "")
        one = lambda t: F.array_join(F.transform(F.filter(x["ranges"], lambda y: y["times"] >= t), part), "")
        return F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform(x["ranges"], lambda y: y["times"]))), one), "\n")

    # one row's words and ranges are named once, so that they are not made anew for each range
    named = F.array(F.struct(words.alias("words"), ranges.alias("ranges")))
    return F.when(F.size(ranges) > 0, F.element_at(F.transform(named, passes), 1)).otherwise(F.lit(""))


def remade(docs: DataFrame, **options) -> DataFrame:
    """The documents of which words are taken, all columns of docs, with the selected words as text, n_chars renewed; besides size, source_size, target and taken."""
    out = selected(docs, carry=True, **options).where(F.size("ranges") > 0)
    out = out.withColumn("text", remade_text(F.col("row.text"), F.col("ranges")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    carried = [new.get(c, x) for c, x in zip(docs.columns, _carried(docs.columns), strict=True)]
    return out.select(*carried, "size", "source_size", "target", _taken(F.col("ranges")).alias("taken"))


def op8_mixing(spark, sf_dir):
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: From the definition: all quotients are ranked.
SQL = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(concat('{SEED}', coalesce(doc_id::varchar, 'text ' || md5(coalesce(text, ''))))) as key from documents
), s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, row_number() over (order by source is null, source) as sid from s0),
s2 as (select *, ([{", ".join(f"{w}.0" for w in WEIGHTS)}])[(sid - 1) % {len(WEIGHTS)} + 1]::double as weight, (source_size * {MOST})::double as cap from s1),
s3 as (
  select *, row_number() over (order by cap / weight, sid) as pos, (sum(source_size) over ()::double - coalesce(sum(cap) over o, 0)) / (sum(weight) over () - coalesce(sum(weight) over o, 0)) as level from s2
  window o as (order by cap / weight, sid rows between unbounded preceding and 1 preceding)
), s4 as (select *, (select level from s3 where level * weight <= cap order by pos limit 1) as water from s3),
goal as (
  select source, sid, source_size, case when water is null then cap else least(cap, water * weight) end as target,
    greatest(1, ceil(source_size / {SHARD}.0))::bigint as shards from s4
), u as (
  select greatest(1, least({BLOCK}, coalesce(sum(source_size), 0) // ({FEWEST} * greatest(1, count(*) filter (source_size > 0)))))::bigint as unit, coalesce(sum(target), 0) as wanted from goal
), p1 as (select sid, target, unit, floor(wanted / unit + 0.5)::bigint as seats, floor(source_size * {MOST} / unit::double + 0.5)::bigint as room from goal, u where target > 0),
p2 as (select *, unnest(range(1, least(room, seats) + 1)) as seat from p1),
p3 as (select *, row_number() over (order by target / (2 * seat - 1) desc, sid, seat) as rank from p2),
own as (select sid, unit, count(*) filter (rank <= seats) as seats from p3 group by sid, unit),
dealt as (select d.*, sid, source_size, target, ('0x' || substr(key, 1, 8))::bigint % shards as shard from d join goal on d.source is not distinct from goal.source),
h as (select sid, shard, sum(size)::bigint as n from dealt group by sid, shard having sum(size) > 0),
q1 as (select h.*, unit, seats, unnest(range(1, seats + 1)) as seat from h join own using (sid)),
q2 as (select *, row_number() over (partition by sid order by n::double / (2 * seat - 1) desc, shard, seat) as rank from q1),
q3 as (select sid, shard, n, unit, count(*) filter (rank <= seats) as given from q2 group by sid, shard, n, unit),
q4 as (select *, greatest(floor(n / unit::double + 0.5), least(n, {FEWEST}))::bigint as m, md5(concat('{SEED}', ':', sid, ':', shard)) as g from q3),
q5 as (
  select *, least(floor((given * unit * m) / n::double + 0.5), m * {MOST})::bigint as q, ('0x' || substr(g, 1, 7))::bigint as start,
    m // 3 + ('0x' || substr(g, 8, 7))::bigint % greatest(1, m // 3) as low from q4
), q as (select *, (low + list_filter(range(0, 64), lambda j: gcd((low + j) % m, m) = 1)[1]) % m as step from q5),
l as (
  select dealt.*, n, m, q.q, start, step, (sum(size) over (partition by dealt.sid, dealt.shard order by key, doc_id nulls first, size rows unbounded preceding))::bigint as e
  from dealt left join q on dealt.sid = q.sid and dealt.shard = q.shard
)
select doc_id, size, source_size, target, case when size > 0 and m is not null then list_sum(list_transform(range(greatest(0, (e - size) * m // n - 1), least(m - 1, (e - 1) * m // n + 1) + 1),
  lambda i: greatest(0, least(e, (i + 1) * n // m) - greatest(e - size, i * n // m)) * (q // m + case when (i * step + start) % m < q % m then 1 else 0 end)))::bigint else 0 end as taken
from l
"""
