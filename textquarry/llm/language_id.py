"""Language identification with a linear-chain conditional random field over words.

Words are the white-space separated tokens that have a letter, lower-cased and without what is neither a letter nor a mark
on one. Tokens longer than LONG characters, and those in scripts without spaces, are split at punctuation and into pieces of
PIECE letters, each a word, so that all of a text counts. A word's emission scores sum the weights of its features: character
n-grams of 2 to 4 between word boundary marks, which include its affixes, and the word itself (the lexicon). A matrix of
learned transitions joins neighbouring words. Forward-backward gives each word's probabilities; a text's are their means
over all its words, and its language is the likeliest.

Training takes a bounded sample: the LANGUAGES languages with the most different labelled documents, rarer ones are not
learned; for each the PER_LANGUAGE labelled documents of least hash, repeated rows once; and of each a window of WINDOW
words at a place the hash picks. Half of the training chains join windows of two languages, so that transitions
are learned from code-switched text. All words of a window carry their document's label. The weights are fitted by
gradient steps on the exact likelihood, with a fixed seed.

Forward-backward over a batch of texts runs in three exact passes over segments of SEGMENT words: products of the
transition matrices of each segment, then messages from segment to segment, then within all segments at once.

Defined cases: a null text, or one without letters, is ``und`` with score 0; so is every text if no document is labelled.
A null doc_id is in no fold: it is not held out and not trained on. Equal texts get equal predictions. Only ``doc_id``,
``text`` and, for training, ``lang`` are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, small_batches, unused

PER_LANGUAGE, LANGUAGES, WINDOW, STEPS = 600, 64, 48, 40
HELD, PRIOR = 50, 50
BUCKETS, SEGMENT, KEPT = 1 << 17, 64, 150_000
LONG, PIECE = 64, 8
NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
AROUND = ".,;:!?\"'()[]{}*-\u2013\u2014\u201c\u201d\u2018\u2019\u00ab\u00bb\u2026"
PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~\u00a1-\u00bf\u2000-\u206f\u3000-\u3003\u3008-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")
#: Letters of scripts that are written without spaces: Thai, Lao, Burmese, Khmer, kana and Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
UND = "und"


def words_of(text: str) -> list[str]:
    tokens = text.split()
    if UNSPACED.search(text) or max(map(len, tokens), default=0) > LONG:
        return [w for t in tokens for w in pieces(t)]
    return [w for t in tokens if (w := t if t.isalpha() else letters(t))]


def letters(token: str) -> str:
    """The letters of a token and the marks on them; empty if it has no letter."""
    if (inner := token.strip(AROUND)).isalpha():
        return inner
    left = NO_LETTER.sub("", token)
    return left if any(map(str.isalpha, left)) else ""


def pieces(token: str) -> list[str]:
    """The letters of a token: as one word, or of a long or unspaced one in pieces, none across punctuation."""
    if len(token) <= LONG and not UNSPACED.search(token):
        return [w] if (w := letters(token)) else []
    runs = (NO_LETTER.sub("", r) for r in PUNCTUATION.split(token))
    return [w for r in runs for k in range(0, len(r), PIECE) if (w := letters(r[k : k + PIECE]))]


def folded(word: str) -> str:
    return word.lower()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words, one after the other, and where each word's begin."""
    marked = ["\x02" + w + "\x03" for w in words]
    sizes = np.array([len(m) for m in marked])
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    found, of = [], []
    value = code * np.uint64(0x9E3779B97F4A7C15)
    for n in (2, 3, 4):
        value = value[:-1] * np.uint64(0x100000001B3) ^ code[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F)
        inside = owner[: len(value)] == owner[n - 1 :]
        found.append((value[inside] ^ (value[inside] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(47))
        of.append(owner[: len(value)][inside])
    found.append(np.array([zlib.crc32(m.encode("utf-8", "surrogatepass")) for m in marked], np.uint64) % np.uint64(BUCKETS))
    of.append(np.arange(len(words)))
    bucket, at = np.concatenate(found).astype(np.int64) % BUCKETS, np.concatenate(of)
    order = np.argsort(at, kind="stable")
    return bucket[order], np.searchsorted(at[order], np.arange(len(words)))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    moves: np.ndarray  # languages x languages, log
    known: np.ndarray  # BUCKETS, those of the training words
    limit: float = 0.0  # texts of a lower coverage are in no language

    def emissions(self, words: list[str]) -> np.ndarray:
        return self.read(words)[0]

    def read(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The emissions of words, and (words x 2) how many of their features are known and how many there are."""
        bucket, starts = features(words)
        counts = np.stack((np.add.reduceat(self.known[bucket].astype(np.int64), starts), np.diff(np.append(starts, len(bucket)))), 1)
        return np.add.reduceat(self.weights[bucket], starts).astype(np.float32), counts


def forward_backward(scores: np.ndarray, moves: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals (chains x steps x languages) and pair marginals summed (languages x languages), of short chains."""
    n, t, k = scores.shape
    e, a = np.exp(scores - scores.max(2, keepdims=True)), np.exp(moves - moves.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        step = (alpha[:, i - 1] @ a) * e[:, i]
        alpha[:, i] = np.where(valid[:, i, None], step / step.sum(1, keepdims=True), alpha[:, i - 1])
    pairs = np.zeros((k, k))
    for i in range(t - 1, 0, -1):
        right = e[:, i] * beta[:, i]
        both = alpha[:, i - 1, :, None] * a * right[:, None, :]
        pairs += (both / both.sum((1, 2), keepdims=True))[valid[:, i]].sum(0)
        step = right @ a.T
        beta[:, i - 1] = np.where(valid[:, i, None], step / step.sum(1, keepdims=True), beta[:, i])
    gamma = alpha * beta
    return gamma / gamma.sum(2, keepdims=True), pairs


def fit(windows: list[tuple[str, list[str]]], steps: int = STEPS, seed: int = 7) -> Model:
    """A model of (language, words) windows."""
    languages = sorted({lang for lang, _ in windows})
    k, label = len(languages), {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    chains: list[tuple[list[str], list[int]]] = [(w, [label[x]] * len(w)) for x, w in windows]
    other = rng.permutation(len(windows))
    for i, j in enumerate(other[: len(windows) // 2].tolist()):  # code-switched chains
        (one, a), (two, b) = chains[i], chains[j]
        cut, cut2 = len(a) // 2, len(b) // 2
        chains[i] = one[:cut] + two[cut2:], a[:cut] + b[cut2:]
    chains = [c for c in chains if c[0]]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(folded(w) for c, _ in chains for w in c))}
    bucket, starts = features(list(vocabulary))
    used, bucket = np.unique(bucket, return_inverse=True)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(bucket))))
    t = max(len(c) for c, _ in chains)
    word, gold, valid = np.zeros((len(chains), t), np.int64), np.zeros((len(chains), t), np.int64), np.zeros((len(chains), t), bool)
    for i, (c, y) in enumerate(chains):
        word[i, : len(c)], gold[i, : len(c)], valid[i, : len(c)] = [vocabulary[folded(w)] for w in c], y, True
    truth = np.eye(k)[gold]
    observed = np.zeros((k, k))
    np.add.at(observed, (gold[:, :-1][valid[:, 1:]], gold[:, 1:][valid[:, 1:]]), 1)
    params = [np.zeros((len(used), k)), np.zeros((k, k))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    size = float(valid.sum())
    for step in range(1, steps + 1):
        weights, moves = params
        scores = np.add.reduceat(weights[bucket], starts)[word]
        gamma, pairs = forward_backward(scores, moves, valid)
        error = ((gamma - truth) * valid[:, :, None]).reshape(-1, k)
        flat = word.ravel()
        by_word = np.stack([np.bincount(flat, error[:, c], len(vocabulary)) for c in range(k)], 1)
        by_bucket = np.stack([np.bincount(bucket, by_word[owner, c], len(used)) for c in range(k)], 1)
        slopes = [by_bucket / size + 1e-6 * weights, (pairs - observed) / size + 1e-4 * moves]
        for p, g, m, v in zip(params, slopes, first, second, strict=True):  # Adam
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    full = np.zeros((BUCKETS, k), np.float32)
    full[used] = params[0]
    known = np.zeros(BUCKETS, bool)
    known[used] = True
    return Model(languages, full, params[1], known)


def coverage(counts: np.ndarray) -> np.ndarray:
    """The share of known features (rows of known, all), with PRIOR known ones more: a few words don't tell."""
    return (counts[:, 0] + PRIOR) / (counts[:, 1] + PRIOR)


def rejection_limit(model: Model, held: list[list[str]], seed: int = 7) -> float:
    """Midway between the coverage that nearly all windows held out from training reach and that of the same windows with
    their letters drawn at random. 0, which rejects nothing, for under HELD windows or if these don't lie apart."""
    if len(held) < HELD:
        return 0.0
    letters = np.array(list("".join(folded(w) for ws in held for w in ws)))
    rng = np.random.default_rng(seed)
    noise = [["".join(rng.choice(letters, len(w))) for w in ws] for ws in held]
    of = lambda windows: coverage(np.array([model.read([folded(w) for w in ws])[1].sum(0) for ws in windows]))
    low, high = float(np.quantile(of(held), 0.001)), float(np.median(of(noise)))
    return (low + high) / 2 if high < low else 0.0


def mean_marginals(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Mean word probabilities of each text, for the emissions of all texts' words one after the other (sizes >= 1)."""
    k = scores.shape[1]
    a = np.exp(moves - moves.max())
    segments = -(-sizes // SEGMENT)
    ends = np.cumsum(segments)
    firsts = ends - segments
    rows = int(ends[-1])
    valid = np.zeros(rows * SEGMENT, bool)
    begin = np.repeat(firsts * SEGMENT - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(scores))
    valid[begin] = True
    e = np.ones((rows * SEGMENT, k))
    e[begin] = np.exp(scores - scores.max(1, keepdims=True))
    e, valid = e.reshape(rows, SEGMENT, k).transpose(1, 0, 2).copy(), valid.reshape(rows, SEGMENT).T.copy()
    product = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for t in range(SEGMENT):
        on = slice(None) if valid[t].all() else np.flatnonzero(valid[t])
        if isinstance(on, np.ndarray) and not len(on):
            break
        step = (product[on].reshape(-1, k) @ a).reshape(-1, k, k)
        if t == 0:
            step[firsts] = np.eye(k)  # a text's first word has none before it
        step *= e[t, on][:, None, :]
        product[on] = step / step.sum((1, 2), keepdims=True)
    enter, leave = np.full((rows, k), 1.0 / k), np.ones((rows, k))
    deep = np.argsort(-segments, kind="stable")
    for s in range(1, int(segments.max())):
        on = firsts[deep[: np.searchsorted(-segments[deep], -s, "left")]] + s
        step = np.einsum("nk,nkj->nj", enter[on - 1], product[on - 1])
        enter[on] = step / step.sum(1, keepdims=True)
    for s in range(int(segments.max()) - 1, 0, -1):
        on = firsts[deep[: np.searchsorted(-segments[deep], -s, "left")]] + s
        step = np.einsum("nkj,nj->nk", product[on], leave[on])
        leave[on - 1] = step / step.sum(1, keepdims=True)
    alpha, now = np.empty_like(e), enter
    for t in range(SEGMENT):
        step = now @ a
        if t == 0:
            step[firsts] = 1.0
        step *= e[t]
        alpha[t] = now = np.where(valid[t][:, None], step / step.sum(1, keepdims=True), now)
    total, now = np.zeros((rows, k)), leave
    for t in range(SEGMENT - 1, -1, -1):
        gamma = alpha[t] * now
        total += np.where(valid[t][:, None], gamma / gamma.sum(1, keepdims=True), 0)
        step = (e[t] * now) @ a.T
        now = np.where(valid[t][:, None], step / step.sum(1, keepdims=True), now)
    return np.add.reduceat(total, firsts) / sizes[:, None]


class Labeller:
    """Predicts texts with a model; keeps the emissions of words it has seen."""

    def __init__(self, model: Model):
        self.model, self.known, self.rows, self.used = model, {}, np.zeros((1024, len(model.languages)), np.float32), 0
        self.counts = np.zeros((1024, 2), np.int64)

    def _learn(self, tokens: list[str]) -> None:
        emissions, counts = self.model.read([folded(w) for w in tokens])
        while self.used + len(tokens) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.counts = np.concatenate((self.counts, np.zeros_like(self.counts)))
        self.rows[self.used : self.used + len(tokens)] = emissions
        self.counts[self.used : self.used + len(tokens)] = counts
        self.known.update(zip(tokens, range(self.used, self.used + len(tokens)), strict=True))
        self.used += len(tokens)

    def marginals(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The places of the texts that have letters, their mean word probabilities and their coverage."""
        lists = [words_of(t) if t else [] for t in texts]
        on = [i for i, ws in enumerate(lists) if ws]
        if not on or not self.model.languages:
            return [], np.zeros((0, len(self.model.languages))), np.zeros(0)
        if len(self.known) > KEPT:
            self.known, self.used = {}, 0
        known = self.known
        if missing := [w for w in {w for i in on for w in lists[i]} if w not in known]:
            self._learn(missing)
        at, sizes = np.fromiter((known[w] for i in on for w in lists[i]), np.int64), np.array([len(lists[i]) for i in on])
        covered = coverage(np.add.reduceat(self.counts[at], np.cumsum(sizes) - sizes))
        return on, mean_marginals(self.rows[at].astype(np.float64), sizes, self.model.moves), covered


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, held: bool = False) -> list[tuple[str, list[str]]]:
    """Training windows of docs (doc_id, text, lang), at most per_language of each of the LANGUAGES most frequent languages;
    with ``held``, such windows of the documents held out."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    labelled = docs.where(F.col("lang").isNotNull() & ((fold == 1) if held else (fold != 1))).select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    # different documents: rows that repeat neither crowd out others nor thin the sample
    frequent = F.broadcast(labelled.groupBy("lang").agg(F.approx_count_distinct(place, 0.02).alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES))
    # the least hashes of a language are under three times their share, so few more than are taken meet in a task
    few = F.col("place") <= F.lit(2.0**63) * 3 * per_language / F.col("n")
    hashed = labelled.withColumn("place", place).join(frequent, "lang").where(few).select("lang", "doc_id", "place").distinct()
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = hashed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language).select("doc_id", "place", "lang")
    rows = labelled.withColumn("place", place).join(F.broadcast(chosen), ["doc_id", "place", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = []
            for text, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_of(text or "")
                start = at % max(1, len(words) - WINDOW + 1)
                windows.append(words[start : start + WINDOW])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(windows, pa.list_(pa.string()))], ["lang", "place", "words"])

    small_batches(docs.sparkSession)
    windows = rows.select("text", "lang", "place").mapInArrow(lean(run), "lang string, place bigint, words array<string>")
    got = windows.dropDuplicates(["lang", "place"]).collect()  # per_language rows of a language at most
    got = [r for r in got if r["words"]]
    return [(r["lang"], list(r["words"])) for r in sorted(got, key=lambda r: (r["lang"], r["place"]))]


def train(docs: DataFrame) -> Model:
    windows = sample(docs)
    return fit(windows) if windows else Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(BUCKETS, bool))


def predictions(docs: DataFrame, model: Model) -> Column:
    """A struct column (lang_pred, score, in_language: the coverage reaches the model's limit) over docs' text column, for use in a projection of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows

    @F.pandas_udf("lang_pred string, score double, in_language boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        label = Labeller(shared.value)
        for texts in batches:
            langs, scores, inside = [UND] * len(texts), [0.0] * len(texts), [False] * len(texts)
            on, means, covered = label.marginals(texts.tolist())
            for i, row, share in zip(on, means, covered, strict=True):
                best = int(row.argmax())
                langs[i], scores[i], inside[i] = label.model.languages[best], min(1.0, float(row[best])), bool(share >= label.model.limit)
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "in_language": inside})

    small_batches(docs.sparkSession)
    return predicted(F.col("text").cast("string"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), predictions(docs, model).alias("p")).select("doc_id", "p.lang_pred", "p.score")


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is in one of the languages: those predicted ``und`` go, and those with so few of the
    languages' n-grams that they are below rejection_limit(). Without labelled documents only texts without letters go."""
    model, name = train(docs), unused(docs, "language_id")
    if not model.languages:
        return docs.where(F.col("text").cast("string").rlike("\\p{L}"))
    model.limit = rejection_limit(model, [words for _, words in sample(docs, held=True)])
    return docs.withColumn(name, predictions(docs, model)).where(F.col(name)["in_language"]).select(*docs.columns)


def language_query(docs: DataFrame) -> DataFrame:
    found = predict(docs, train(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
