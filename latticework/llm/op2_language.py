"""Language ID: a linear-chain conditional random field labels words, documents take the mean.

Words get features: the whole word (lexicon), affixes of one to three bytes, two- and three-byte
n-grams and a mark for words without a letter, hashed into one table of weights for each label.
Transitions between labels are learned with them. Training maximises the likelihood of labelled
chains; a share of the chains is code-switched, made of pieces of two documents of different
languages, so that transitions learn that languages last but change. Labelling runs forward-
backward over a document's whole chain of words and gives each word a distribution over labels. For speed
the chain is cut into pieces of CHAIN words, whose products of transitions and emissions carry the messages from piece
to piece in both directions; the result is that of the whole chain.
A document's prediction is the label with the largest mean over its words that have letters, the first by
name of equals; its score is that mean.

The fit uses a bounded sample: about SAMPLE labelled documents of at most LONGEST characters, equally many of each
language and EACH at least, drawn by a hash among those whose crc32(doc_id) mod 5 is not 0. The driver holds them (30 MB
at most for up to 75 languages) and the model, 1 MB for each language, which is sent to all tasks; more than MOST languages are refused.
Everything else covers all documents whole; a task needs memory for one slice of texts.

Cases: null text and text without a letter give `und` with score 0; a null doc_id counts as an
empty string in the split; if no document has a label, all are `und`; repeated rows get equal
results; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import U, Words, mix, slices

CHAIN, SAMPLE, EACH, LONGEST, MOST = 64, 600, 8, 50_000, 256
BITS, STEPS, RATE, DECAY, SWITCHED = 18, 40, 0.25, 1e-6, 0.25
NONE = "und"
#: Pieces of chains that are worked on at once: short texts take a piece each, so this bounds memory where bytes do not.
GRID = 2048
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def features(data: np.ndarray, begin: np.ndarray, end: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the number of the word that has them, in order of words."""
    n = end - begin
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    left = np.repeat(end, n) - at  # bytes from here to the word's end
    done = at - np.repeat(begin, n)
    wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(U)
    two = wide[at] | wide[at + 1] << U(8)
    three = two | wide[at + 2] << U(16)
    parts = [(mix(word, 31), np.arange(len(n)))]
    for k, (code, size) in enumerate(((two, 2), (three, 3))):
        fits = left >= size
        parts.append((mix(code[fits] | U((k + 1) << 32)), owner[fits]))
    for k, (code, size) in enumerate(((wide[at], 1), (two, 2), (three, 3))):
        first, last = (done == 0) & (left >= size), left == size
        parts.append((mix(code[first] | U((k + 4) << 32)), owner[first]))
        parts.append((mix(code[last] | U((k + 8) << 32)), owner[last]))
    bare = np.flatnonzero(np.bincount(owner, _LETTER[data[at]], len(n)) == 0)
    parts.append((np.full(len(bare), mix(np.array([U(1) << U(40)]))[0]), bare))
    number = np.concatenate([p[0] for p in parts]) >> U(64 - BITS)
    owner = np.concatenate([p[1] for p in parts])
    order = np.argsort(owner, kind="stable")
    return number[order].astype(np.int32), owner[order].astype(np.int32)


def emissions(weights: np.ndarray, number: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, w[number], n) for w in weights], axis=1)


def forward_backward(score: np.ndarray, live: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """score: chains x words x labels, live: chains x words (a chain's words come first).

    Posteriors of labels, expected transitions (summed) and the log partition of each chain.
    """
    n, t, k = score.shape
    top = score.max(axis=2, keepdims=True)
    local = np.exp(score - top)
    local[~live] = 1.0
    step = np.exp(move)
    ahead, back, scale = np.empty_like(local), np.empty_like(local), np.ones((n, t))
    for i in range(t):
        a = local[:, i] if i == 0 else np.where(live[:, i, None], (ahead[:, i - 1] @ step) * local[:, i], ahead[:, i - 1])
        scale[:, i] = a.sum(axis=1)
        ahead[:, i] = a / scale[:, i, None]
    back[:, -1] = 1.0
    for i in range(t - 1, 0, -1):
        back[:, i - 1] = np.where(live[:, i, None], (back[:, i] * local[:, i]) @ step.T / scale[:, i, None], back[:, i])
    post = ahead * back
    post /= post.sum(axis=2, keepdims=True)
    moves = np.zeros((k, k))
    for i in range(1, t):
        on = live[:, i]
        moves += (ahead[on, i - 1] / scale[on, i, None]).T @ (local[on, i] * back[on, i])
    return post, moves * step, (np.log(scale) + np.where(live, top[:, :, 0], 0)).sum(axis=1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each first-level entry scaled to a largest value of 1."""
    return x / x.max(axis=tuple(range(1, x.ndim)), keepdims=True)


def whole_chains(score: np.ndarray, live: np.ndarray, pieces: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Posteriors of labels for chains cut into pieces: score is pieces of all chains x words x labels, `pieces` how many each chain has."""
    n, t, k = score.shape
    step = np.exp(move)
    local = np.exp(score - score.max(axis=2, keepdims=True))
    local[~live] = 1.0
    at = np.cumsum(pieces) - pieces  # each chain's first piece
    first = np.zeros(n, dtype=bool)
    first[at] = True
    enter, leave = np.ones((n, k)), np.ones((n, k))
    many = np.repeat(pieces > 1, pieces)
    if many.any():
        # what a piece does to a message: a product of matrices (label before it x its last label)
        rows = np.flatnonzero(many)
        part, on = local[rows], live[rows]
        through = np.where(first[rows, None, None], np.eye(k), step) * part[:, 0, None, :]
        for i in range(1, t):
            through = np.where(on[:, i, None, None], _scaled((through.reshape(-1, k) @ step).reshape(-1, k, k) * part[:, i, None, :]), through)
        place = np.zeros(n, dtype=np.int64)
        place[rows] = np.arange(len(rows))
        # long chains first, so those with a piece of a number are a prefix
        order = np.argsort(-pieces, kind="stable")
        with_more = np.searchsorted(-pieces[order], -np.arange(1, pieces.max() + 1), "right")
        for p in range(pieces.max() - 1):
            here = at[order[: with_more[p + 1]]] + p
            enter[here + 1] = _scaled((enter[here, None, :] @ through[place[here]])[:, 0])
        for p in range(pieces.max() - 1, 0, -1):
            here = at[order[: with_more[p]]] + p
            leave[here - 1] = _scaled((through[place[here]] @ leave[here, :, None])[:, :, 0])
    ahead, back = np.empty_like(local), np.empty_like(local)
    ahead[:, 0] = _scaled(np.where(first[:, None], 1.0, enter @ step) * local[:, 0])
    for i in range(1, t):
        ahead[:, i] = np.where(live[:, i, None], _scaled((ahead[:, i - 1] @ step) * local[:, i]), ahead[:, i - 1])
    back[:, -1] = leave
    for i in range(t - 1, 0, -1):
        back[:, i - 1] = np.where(live[:, i, None], _scaled((back[:, i] * local[:, i]) @ step.T), back[:, i])
    post = ahead * back
    return post / post.sum(axis=2, keepdims=True)


class Model:
    """labels, weights (labels x features), move (labels x labels)."""

    def __init__(self, labels: list[str], weights: np.ndarray, move: np.ndarray):
        self.labels, self.weights, self.move = labels, weights, move

    def posteriors(self, words: Words) -> np.ndarray:
        """A distribution over labels for each word."""
        k, n = len(self.labels), len(words.hash)
        if not n:
            return np.zeros((0, k))
        _, one, which = np.unique(words.hash, return_index=True, return_inverse=True)
        number, owner = features(words.data, words.begin[one], words.end[one], words.hash[one])
        score = emissions(self.weights, number, owner, len(one))[which]
        sizes = np.diff(words.first)
        pieces = -(-sizes // CHAIN)
        total, out, at = np.concatenate([[0], np.cumsum(pieces)]), np.empty((n, k)), 0
        while at < len(sizes):  # documents of about GRID pieces at a time, a longer one alone
            to = max(at + 1, int(np.searchsorted(total, total[at] + GRID, "right")) - 1)
            begin, end = words.first[at], words.first[to]
            if end > begin:
                place = np.arange(end - begin) - np.repeat(words.first[at:to] - begin, sizes[at:to])
                piece = np.repeat(total[at:to] - total[at], sizes[at:to]) + place // CHAIN
                grid = np.zeros((int(total[to] - total[at]), CHAIN, k))
                live = np.zeros(grid.shape[:2], dtype=bool)
                grid[piece, place % CHAIN] = score[begin:end]
                live[piece, place % CHAIN] = True
                own = pieces[at:to]
                out[begin:end] = whole_chains(grid, live, own[own > 0], self.move)[piece, place % CHAIN]
            at = to
        return out


def fit(texts: list[str], langs: list[str], seed: int = 5) -> Model:
    """Gradient ascent with per-weight rates on chains of the given texts."""
    labels = sorted(set(langs))
    k = len(labels)
    words = Words(pa.array(texts, pa.large_string()))
    gold = np.array([labels.index(x) for x in langs], dtype=np.int64)[words.row_of_word()]
    n = len(words.hash)
    weights, move = np.zeros((k, 1 << BITS)), np.zeros((k, k))
    if n == 0 or k < 2:
        return Model(labels, weights, move)
    _, one, which = np.unique(words.hash, return_index=True, return_inverse=True)
    number, owner = features(words.data, words.begin[one], words.end[one], words.hash[one])
    # chains of consecutive words of a document; of some, a part gives way to words of another document
    row = words.row_of_word()
    place = np.arange(n) - words.first[row]
    starts = np.flatnonzero(place % CHAIN == 0)
    index = np.minimum(starts[:, None] + np.arange(CHAIN), n - 1)
    live = (starts[:, None] + np.arange(CHAIN) < n) & (row[index] == row[starts][:, None])
    r = np.random.RandomState(seed)
    for c in np.flatnonzero(r.rand(len(starts)) < SWITCHED):
        other, cut = r.randint(len(starts)), r.randint(1, CHAIN)
        index[c, cut:], live[c, cut:] = index[other, : CHAIN - cut], live[other, : CHAIN - cut] & live[c, cut - 1]
    known = gold[index]
    rate_w, rate_m = np.full_like(weights, 1e-6), np.full_like(move, 1e-6)
    true_moves = np.zeros((k, k))
    both = live[:, 1:] & live[:, :-1]
    np.add.at(true_moves, (known[:, :-1][both], known[:, 1:][both]), 1)
    total = live.sum()
    for _ in range(STEPS):
        score = emissions(weights, number, owner, len(one))[which]
        post, moves, _ = forward_backward(np.where(live[:, :, None], score[index], 0.0), live, move)
        miss = -post
        miss[np.arange(len(index))[:, None], np.arange(CHAIN), known] += 1
        flat = which[index[live]]
        for label in range(k):
            per_word = np.bincount(flat, miss[live][:, label], len(one))
            slope = np.bincount(number, per_word[owner], 1 << BITS) / total - DECAY * weights[label]
            rate_w[label] += slope**2
            weights[label] += RATE * slope / np.sqrt(rate_w[label])
        slope = (true_moves - moves) / total - DECAY * move
        rate_m += slope**2
        move += RATE * slope / np.sqrt(rate_m)
    return Model(labels, weights.astype(np.float32), move)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled documents outside the held-out fifth."""
    usable = docs.where(F.col("lang").isNotNull() & (F.length("text") <= LONGEST) & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().limit(MOST + 1).collect()}
    if len(counts) > MOST:
        raise ValueError(f"more than {MOST} languages: their model is too large to be sent to all tasks")
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, max(EACH, sample / len(counts)) / n))).otherwise(share)
    rows = sorted((r[0], r[1]) for r in usable.where(draw < share).select("lang", "text").collect())
    return fit([t for _, t in rows], [x for x, _ in rows])


def word_labels(model: Model, text: str) -> list[tuple[str, str, float]]:
    """Words of a text with their label and its probability."""
    words = Words(pa.array([text], pa.large_string()))
    raw = (text or "").encode()
    return [(raw[b:e].decode(), model.labels[int(p.argmax())], float(p.max())) for b, e, p in zip(words.begin, words.end, model.posteriors(words), strict=True)]


def _predict(held, text_at: int, letter_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for at, to in slices(batch.column(text_at)):
                part = batch.slice(at, to - at)
                words = Words(part.column(text_at))
                n, k = to - at, len(model.labels)
                mean = np.zeros((n, max(1, k)))
                if len(words.hash) and k:
                    letters = np.concatenate([[0], np.cumsum(_LETTER[words.data])])
                    use = (letters[words.end] > letters[words.begin]).astype(np.float64)
                    post = model.posteriors(words) * use[:, None]
                    sums = np.concatenate([np.zeros((1, k)), np.cumsum(post, axis=0)])
                    held_words = np.concatenate([[0], np.cumsum(use)])
                    mean = (sums[words.first[1:]] - sums[words.first[:-1]]) / np.maximum(1, held_words[words.first[1:]] - held_words[words.first[:-1]])[:, None]
                best = mean.argmax(axis=1)
                letter = part.column(letter_at).to_pylist()
                labels = [model.labels[b] if x and k else NONE for b, x in zip(best, letter, strict=True)]
                score = [min(1.0, max(0.0, float(m[b]))) if x and k else 0.0 for m, b, x in zip(mean, best, letter, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels, pa.string()), pa.array(score, pa.float64())], names=[*(f"c{i}" for i in range(part.num_columns)), "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with lang_pred and score after their own columns (in their order)."""
    model = learn(docs) if model is None else model
    names = docs.columns
    plain = docs.withColumn("", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).toDF(*(f"c{i}" for i in range(len(names) + 1)))
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(plain.schema))
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = plain.mapInArrow(_predict(held, names.index("text"), len(names)), f"{kinds}, lang_pred string, score double")
    return out.drop(f"c{len(names)}")


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those of no language or an unsure one."""
    out = predicted(docs).where((F.col("lang_pred") != NONE) & (F.col("score") >= least))
    return out.drop("lang_pred", "score").toDF(*docs.columns)


def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = predicted(docs.select("doc_id", "text"), learn(docs))
    return out.select(F.col("c0").alias("doc_id"), F.coalesce(held_out(F.col("c0")), F.lit(False)).alias("held_out"), "lang_pred", "score")
