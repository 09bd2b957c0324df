r"""Personal data: fixed patterns and bootstrapped contexts, with DataFrame functions alone.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches of fixed patterns with
checks. A kind's spans come from the pieces between matches and the matches themselves: their
lengths add up to positions, so one split and one extraction find them all. Patterns are written
with possessive repeats and look-behinds that match the same strings in linear time.

Bootstrapping finds identifiers without a fixed form. A context is a word with a label's delimiter
(`:`, `=`, `#`, quote or bracket); its instance is the valid base span of any kind that begins right
after it (spaced phones and cards included), else a token of at least six characters with a
digit. Seeds are instances that are base entities or secrets by form (at
least 16 hexadecimal digits, both letters and digits; or 20 or more capitals and digits).
No base pattern holds a letter before a label's sign, so what the pattern matches right after a
context is a base span: no earlier match can reach over the context's word.
On the graph of contexts and instances, over all documents, Spark repeats: a context's confidence
is the share of its distinct instances that are trusted; an instance's score is the noisy-or of its
contexts' confidences; instances over SURE are trusted from then on. Trust only grows, and rounds end
when one trusts nothing new. Contexts with a confidence
of at least CONFIDENT and SUPPORT distinct trusted instances are the learned patterns, and
every token they introduce is a span of kind `id`, unless it overlaps a base span.

Redaction masks the union of a text's spans at once, from their positions: of spans that overlap, the
first (then by kind as listed) names the mask, and what the others cover besides goes with it.

All contexts over the thresholds are used. Up to PATTERNS of them go to all tasks as a literal: a
context has at most 24 letters and 6 signs, so that is about 30,000 characters at most. More stay a
table, which is joined with the distinct contexts of each row (a number given to rows when they are
written tells them apart), and each row gets the learned ones among its own as an array.

Cases: null text is empty; positions are code points, end exclusive; rows are independent, so
repeated rows and null ids need no care; an empty table learns nothing and gives an empty result;
clashing column names cannot occur, as only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, spread_join, table

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# a run of digits with single separators, whole, of 16 to 19 digits: other runs fail the check in any case
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": (EMAIL, "@"), "ip": (IP, None), "card": (CARD, None), "phone": (PHONE, "+")}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TOKEN = r"(?=[A-Za-z_.%+@-]*+[0-9])[A-Za-z0-9._%+@-]{6,}+"
#: word, delimiter and token; the delimiter holds one of a label's signs
_LABEL = r"(?<!\p{L})(\p{L}{2,24}+)(\x20?[:=#\x22'(\[][:=#\x22'(\[\x20]{0,4}+)"
CONTEXT = _LABEL + "(" + _TOKEN + ")"
#: word, delimiter, what begins right after of each kind, token; empty where there is none
LABELLED = _LABEL + r"(?=[A-Za-z0-9._%+@-])" + "".join(f"(?=({p})?+)" for p, _ in KINDS.values()) + "(" + _TOKEN + ")?+"
CONFIDENT, SUPPORT, SURE = 0.9, 3, 0.9
#: Learned contexts that are sent as a literal at most.
PATTERNS = 1000
_CHUNK = 256
#: Parts that the rows with one context are dealt to where contexts are joined.
_SALTS = 32
#: Column of a row's own learned contexts, and of its number.
_KNOWN, _ROW = "__known", "__row"
_ARRAY = "array<struct<begin:int,end:int,hit:string>>"
_ORDER = [*KINDS, "id"]


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", F.translate(hit, " -", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _may(text: Column, needle: str | None) -> Column:
    return F.contains(text, F.lit(needle)) if needle else text.rlike("[0-9]")


def located(text: Column, pattern: str, needle: str | None) -> Column:
    """All matches with their positions: array of (begin, end, hit)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    both = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)).alias("piece"), hits.alias("hit"))
    return F.when(_may(text, needle) & (F.size(hits) > 0), _placed(both)).otherwise(F.array().cast(_ARRAY))


def _placed(both: Column) -> Column:
    """Positions from lengths, in chunks, so that appending stays cheap with many matches."""
    width = lambda x: F.length(x["piece"]) + F.length(x["hit"])
    chunk = lambda k: F.slice(both, k * _CHUNK + 1, F.lit(_CHUNK))
    chunks = F.sequence(F.lit(0), F.floor((F.size(both) - 1) / _CHUNK).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    offsets = F.aggregate(chunks, start, lambda acc, k: F.struct((acc["at"] + F.aggregate(chunk(k), F.lit(0), lambda s, x: s + width(x))).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def inner(offset, k):
        begin = F.struct(offset.alias("at"), F.array().cast(_ARRAY).alias("out"))
        return F.aggregate(
            chunk(k),
            begin,
            lambda acc, x: F.struct(
                (acc["at"] + width(x)).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + F.length(x["piece"])).alias("begin"), (acc["at"] + width(x)).alias("end"), x["hit"].alias("hit"))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    return F.flatten(F.transform(offsets, inner))


def _check(kind: str):
    return lambda x: valid(kind, x["hit"])


def based(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, and for each kind an array of its valid spans; those of the columns `more` that docs has stay."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(c for c in more if c in docs.columns))
    for kind, (pattern, needle) in KINDS.items():
        out = out.withColumn(kind, F.filter(located(F.col("text"), pattern, needle), _check(kind)))
    return out


def _key(word: Column, delimiter: Column) -> Column:
    return F.concat(F.lower(word), F.translate(delimiter, " ", ""))


def is_seed(instance: Column) -> Column:
    seed = (instance.rlike("^[0-9a-fA-F]{16,}+$") & instance.rlike("[a-fA-F]")) | instance.rlike("^(?=[A-Z]*+[0-9])[A-Z0-9]{20,}+$")
    for kind, (pattern, _) in KINDS.items():
        seed |= instance.rlike(f"^(?:{pattern})$") & valid(kind, instance)
    return seed


def contexts_of(text: Column) -> Column:
    """Array of (context, instance)."""
    names = ["w", "d", *KINDS, "t"]

    def pair(x: Column) -> Column:
        base = (F.when((x[k] != "") & valid(k, x[k]), x[k]) for k in KINDS)
        return F.struct(_key(x["w"], x["d"]).alias("context"), F.coalesce(*base, x["t"]).alias("instance"))

    found = F.transform(F.arrays_zip(*(F.regexp_extract_all(text, F.lit(LABELLED), F.lit(i)).alias(n) for i, n in enumerate(names, 1))), pair)
    return F.when(text.rlike("[0-9@]") & text.rlike("[:=#\"'(\\[]"), F.filter(found, lambda x: x["instance"] != ""))


def _scores(pairs: DataFrame) -> DataFrame:
    sure = F.sum((F.col("trust") >= SURE).cast("long"))
    return pairs.groupBy("context").agg(F.count("*").alias("n"), sure.alias("hits")).where(F.col("hits") >= SUPPORT).withColumn("confidence", F.col("hits") / F.col("n"))


def learn(docs: DataFrame) -> DataFrame:
    """The learned contexts: context, n, hits, confidence."""
    pairs = docs.select(F.explode(contexts_of(F.col("text"))).alias("x")).select("x.context", "x.instance").distinct()
    pairs = cut(pairs.withColumn("trust", is_seed(F.col("instance")).cast("double")), "pairs")
    trusted = lambda: pairs.where(F.col("trust") >= SURE).count()
    before = -1
    while (now := trusted()) != before:
        before = now
        found = cut(_scores(pairs), "contexts")
        doubt = F.sum(F.log(1 - F.least("confidence", F.lit(0.999))))
        scores = cut(spread_join(pairs.select("context", "instance"), found, ["context"], "n", F.xxhash64("instance")).groupBy("instance").agg((1 - F.exp(doubt)).alias("score")), "instances")
        new = cut(pairs.join(scores, "instance", "left").select("context", "instance", F.greatest("trust", F.coalesce("score", F.lit(0.0))).alias("trust")), "pairs")
        drop(pairs, found, scores)
        pairs = new
    return _scores(pairs).where(F.col("confidence") >= CONFIDENT)


def learned(docs: DataFrame) -> list[str] | DataFrame:
    """All learned contexts: a list of up to PATTERNS, else a table (context)."""
    found = cut(learn(docs).select("context"), "learned")
    rows = found.limit(PATTERNS + 1).collect()
    return found if len(rows) > PATTERNS else sorted(r[0] for r in rows)


def _with_known(docs: DataFrame, contexts: list[str] | DataFrame) -> tuple[DataFrame, Column | None]:
    """docs and the array of contexts to look for in a row: a literal, or a column that is added."""
    if not isinstance(contexts, DataFrame):
        return docs, F.array(*map(F.lit, contexts)) if contexts else None
    rows = cut(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    own = rows.select(_ROW, F.explode(F.array_distinct(F.transform(contexts_of(F.col("text")), lambda x: x["context"]))).alias("context"))
    dealt = contexts.select("context", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    met = own.withColumn("salt", (F.xxhash64(_ROW) % _SALTS + _SALTS) % _SALTS).join(dealt.withColumn("salt", F.col("salt").cast("long")), ["context", "salt"])
    known = met.groupBy(_ROW).agg(F.collect_list("context").alias(_KNOWN))
    return rows.join(known, _ROW, "left").withColumn(_KNOWN, F.coalesce(_KNOWN, F.array().cast("array<string>"))).drop(_ROW), F.col(_KNOWN)


def _identified(text: Column, known: Column | None) -> Column:
    """Spans of tokens after learned contexts."""
    if known is None:
        return F.array().cast(_ARRAY)
    token = lambda x: F.regexp_extract(x["hit"], CONTEXT, 3)
    key = lambda x: _key(F.regexp_extract(x["hit"], CONTEXT, 1), F.regexp_extract(x["hit"], CONTEXT, 2))
    fit = F.filter(located(text, CONTEXT, None), lambda x: F.array_contains(known, key(x)))
    return F.transform(fit, lambda x: F.struct((x["end"] - F.length(token(x))).cast("int").alias("begin"), x["end"].alias("end"), token(x).alias("hit")))


def spans(docs: DataFrame, contexts: list[str] | DataFrame, *more: str) -> DataFrame:
    """doc_id, text, the columns `more` of docs and arrays of spans: email, ip, card, phone and id."""
    docs, known = _with_known(docs.select("doc_id", "text", *more), contexts)
    out = based(docs, _KNOWN, *more).withColumn("id", _identified(F.col("text"), known)).drop(_KNOWN)
    base = F.concat(*KINDS)
    clear = F.filter("id", lambda x: ~F.exists(base, lambda b: (b["begin"] < x["end"]) & (b["end"] > x["begin"])))
    return out.withColumn("id", F.when(F.size("id") > 0, clear).otherwise(F.col("id")))


def _label(kind: str):
    return lambda x: F.concat(F.lit(kind + ":"), x["begin"], F.lit(":"), x["end"])


def _named(kinds) -> Column:
    return F.array_join(F.concat(*(F.transform(k, _label(k)) for k in kinds)), ",")


def _masked(text: Column, marks: Column) -> Column:
    """text with marks (begin, kind, end), sorted, replaced. Positions go by chunks of marks, so that a long text is cut up once for each chunk."""
    chunk = lambda k: F.slice(marks, k * _CHUNK + 1, F.lit(_CHUNK))
    far = lambda xs, at: F.aggregate(xs, at, lambda s, x: F.greatest(s, x["end"]))
    chunks = F.sequence(F.lit(0), F.floor((F.size(marks) - 1) / _CHUNK).cast("int"))
    # how far the marks before each chunk reach, and those of all
    start = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("out"))
    reach = F.aggregate(chunks, start, lambda acc, k: F.struct(far(chunk(k), acc["at"]).alias("at"), F.array_append(acc["out"], far(chunk(k), acc["at"])).alias("out")), lambda acc: acc["out"])

    def inner(k: Column) -> Column:
        first, last = F.element_at(reach, k + 1), F.element_at(reach, k + 2)
        piece = F.substring(text, first + 1, last - first)

        def step(acc: Column, x: Column) -> Column:
            new = x["begin"] >= acc["at"]
            shown = F.concat(F.substring(acc["piece"], acc["at"] - first + 1, x["begin"] - acc["at"]), F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in _ORDER)), x["kind"]))
            out = F.array_append(acc["out"], F.when(new, shown).otherwise(F.lit("")))
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["piece"].alias("piece"), out.alias("out"))

        begin = F.struct(first.alias("at"), piece.alias("piece"), F.array().cast("array<string>").alias("out"))
        return F.array_join(F.aggregate(chunk(k), begin, step, lambda acc: acc["out"]), "")

    body = F.array_join(F.transform(chunks, inner), "")
    return F.when(F.size(marks) > 0, F.concat(body, F.substring(text, F.element_at(reach, -1) + 1, F.length(text)))).otherwise(text)


def redact(docs: DataFrame, contexts: list[str] | DataFrame | None = None) -> DataFrame:
    """docs with personal data in text replaced by [EMAIL], [IP], [CARD], [PHONE], [ID] and n_chars renewed."""
    contexts = learned(docs) if contexts is None else contexts
    names = [f"__c{i}" for i in range(len(docs.columns))]
    whole = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")])).withColumn("doc_id", F.lit(None).cast("long"))
    found = spans(whole, contexts, *names)
    mark = lambda k: lambda x: F.struct(x["begin"], F.lit(_ORDER.index(k) + 1).alias("kind"), x["end"])
    found = found.withColumn("__marks", F.array_sort(F.concat(*(F.transform(k, mark(k)) for k in _ORDER))))
    found = found.withColumn("__new", _masked(F.col("text"), F.col("__marks")))
    out = []
    for name, c in zip(names, docs.schema, strict=True):
        new = F.col(name)
        if c.name == "text":
            new = F.when(new.isNull(), new).otherwise(F.col("__new"))
        elif c.name == "n_chars":
            new = F.when(F.col(names[docs.columns.index("text")]).isNull(), new).otherwise(F.length("__new").cast(c.dataType))
        out.append(new.alias(c.name))
    return found.select(*out)


def op4_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = spans(docs, learned(docs))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_named(KINDS), 256).alias("base_sha256"),
        _named([*KINDS, "id"]).alias("spans"),
    )
