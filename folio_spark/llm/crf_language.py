"""Language of words in code-switched text by a linear-chain conditional random field.

Words are runs of letters. A word's features are its anchored character n-grams (prefixes and
suffixes), its inner n-grams, and what a lexicon counted over all training documents says of the
whole word. Weights and the transitions between languages are learned together by the gradient of
the conditional likelihood; forward-backward gives each word a probability per language, and a
document the mean over its words.

Training sequences are windows of labelled documents stitched together, so that languages change
inside them and the transitions can be learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import own_names


ORDERS = (2, 3, 4)  # lengths of n-grams; word bounds count as one character
HASH_BITS = 16  # rows of the n-gram weight table
UNKNOWN = "und"
DOCS_PER_LANGUAGE = 600  # about so many labelled documents of each language are fitted on
WINDOW = 24  # words taken from a sampled document
LEXICON_WORDS = 20_000  # most frequent words that are mostly of one language
PURITY = 0.8
EPOCHS = 60
BLOCK = 1 << 18  # characters whose features are held at once
CHAIN = 1 << 20  # characters that go through forward-backward at once

_B = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # n-gram weights, (2^HASH_BITS, languages)
    of_lexicon: np.ndarray  # lexicon weights: (languages + 1, languages); the last row is for words outside it
    start: np.ndarray
    transition: np.ndarray
    words: np.ndarray  # sorted hashes of lexicon words
    word_language: np.ndarray


def letters() -> np.ndarray:
    """By code point: 1 for a letter, 2 for a combining mark (part of a word, but no letter)."""
    import unicodedata

    kind = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            kind[i] = 1
        elif c == "M":
            kind[i] = 2
    return kind


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _B, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of some texts, with the hashes of their n-grams and of themselves."""

    def __init__(self, texts: list[str], kind: np.ndarray):
        joined = "\n" + "\n".join(texts) + "\n\n\n\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = kind[np.minimum(points, 0x10FFFF)] > 0
        self.letter = inside
        self.points = np.where(inside, points, 0).astype(np.uint64)
        step = np.diff(inside.astype(np.int8))
        self.first, self.stop = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
        bounds = np.cumsum([1] + [len(t) + 1 for t in texts])
        self.of_text = np.searchsorted(self.first, bounds)  # word range of each text
        self.id_at = np.cumsum(np.concatenate([[0], (step == 1).astype(np.int64)])) - 1

    def __len__(self) -> int:
        return len(self.first)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word: sum of point * B^(place), moved to a common place."""
        if not len(self):
            return np.zeros(0, np.uint64)
        size = self.stop - self.first
        place = np.arange(len(self.points)) - self.first[np.maximum(self.id_at, 0)]
        power = _powers(int(size.max()) + 1)
        inside = self.letter
        terms = np.zeros(len(self.points), np.uint64)
        terms[inside] = self.points[inside] * power[place[inside]]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
        return _mix(sums[self.stop] - sums[self.first] + size.astype(np.uint64) * np.uint64(_B))

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of the weight table, word) of every n-gram; word bounds are zeros."""
        n = len(self.points) - order + 1
        on = [self.letter[j : n + j] for j in range(order)]
        valid = (on[0] | on[1]) & (on[order - 1] | on[order - 2])
        for j in range(1, order - 1):
            valid &= on[j]
        h = self.points[:n].copy()
        for j in range(1, order):
            h *= np.uint64(_B)
            h += self.points[j : n + j] + np.uint64(order)
        at = np.flatnonzero(valid)
        rows = (_mix(h[at]) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        return rows, np.where(self.letter[at], self.id_at[at], self.id_at[at + 1])


def lexicon_rows(words: Words, model_words: np.ndarray, word_language: np.ndarray, none: int) -> np.ndarray:
    if not len(model_words):
        return np.full(len(words), none)
    h = words.hashes().view(np.int64)
    at = np.minimum(np.searchsorted(model_words, h), len(model_words) - 1)
    return np.where(model_words[at] == h, word_language[at], none)


def emissions(words: Words, m: Model) -> np.ndarray:
    out = m.of_lexicon[lexicon_rows(words, m.words, m.word_language, len(m.languages))].copy()
    for order in ORDERS:
        rows, of_word = words.grams(order)
        sums = np.concatenate([np.zeros((1, len(m.languages))), np.cumsum(m.table[rows], axis=0)])
        edge = np.searchsorted(of_word, np.arange(len(words) + 1))
        out += sums[edge[1:]] - sums[edge[:-1]]
    return out


def posteriors(emit: np.ndarray, opens: np.ndarray, m: Model) -> np.ndarray:
    """P(language | whole text) of each word; ``opens`` marks the first words of texts.

    All texts form one chain: the step into a first word forgets what came before. The chain is
    cut into about sqrt(n) blocks that are walked side by side: first for each block's product of
    steps, which gives the vectors that enter it from both ends, then for the posteriors.
    """
    n, k = emit.shape
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    pad = blocks * width - n
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    e = np.concatenate([e, np.ones((pad, k))]).reshape(blocks, width, k)
    new = np.concatenate([opens, np.ones(pad, bool)]).reshape(blocks, width)
    move, begin = np.exp(m.transition - m.transition.max()), np.exp(m.start - m.start.max())
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(width):
        step = (product.reshape(-1, k) @ move).reshape(blocks, k, k)
        if new[:, t].any():
            step = np.where(new[:, t, None, None], product.sum(axis=2, keepdims=True) * begin, step)
        product = step * e[:, t, None, :]
        product /= product.max(axis=(1, 2), keepdims=True)
    enter, leave = np.ones((blocks, k)), np.ones((blocks, k))
    for b in range(1, blocks):
        v = enter[b - 1] @ product[b - 1]
        enter[b] = v / v.sum()
    for b in range(blocks - 2, -1, -1):
        v = product[b + 1] @ leave[b + 1]
        leave[b] = v / v.sum()
    alpha = np.empty((width, blocks, k))
    v = enter
    for t in range(width):
        v = np.where(new[:, t, None], begin, v @ move) * e[:, t]
        v /= v.sum(axis=1, keepdims=True)
        alpha[t] = v
    beta = leave
    for t in range(width - 1, -1, -1):
        alpha[t] *= beta
        v = e[:, t] * beta
        beta = np.where(new[:, t, None], 1.0, v @ move.T)
        beta /= beta.sum(axis=1, keepdims=True)
    post = alpha.transpose(1, 0, 2).reshape(-1, k)[:n]
    return post / post.sum(axis=1, keepdims=True)


def _in_pieces(texts: list[str], size: int):
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j]) <= size):
            chars += len(texts[j])
            j += 1
        yield texts[i:j]
        i = j


def predict(texts: list[str | None], m: Model, kind: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and mean word probability of each text; ``und`` and 0 without a letter."""
    names, scores = [], []
    for some in _in_pieces([(t or "").lower() for t in texts], CHAIN):
        emit, counts = [], []
        for piece in _in_pieces(some, BLOCK):
            words = Words(piece, kind)
            counts += np.diff(words.of_text).tolist()
            if len(m.languages):
                emit.append(emissions(words, m))
        edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        total = int(edges[-1])
        if not total or not m.languages:
            names += [UNKNOWN] * len(some)
            scores += [0.0] * len(some)
            continue
        opens = np.zeros(total, bool)
        opens[edges[:-1][np.diff(edges) > 0]] = True
        sums = np.concatenate([np.zeros((1, len(m.languages))), np.cumsum(posteriors(np.concatenate(emit), opens, m), axis=0)])
        for i, text in enumerate(some):
            a, b = edges[i], edges[i + 1]
            if a == b or not any(c.isalpha() for c in text):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            mean = (sums[b] - sums[a]) / (b - a)
            best = int(mean.argmax())
            names.append(m.languages[best])
            scores.append(float(min(1.0, max(0.0, mean[best]))))
    return names, scores


# ---- learning ----


def _labelled(docs: DataFrame, fold: int, of: int) -> DataFrame:
    learnt = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of != fold, F.lit(False))
    return docs.where(learnt & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def _count_words(languages: list[str]):
    number = {name: i for i, name in enumerate(languages)}

    def run(batches):
        kind = letters()
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in dict.fromkeys(langs):
                for piece in _in_pieces([t.lower() for t, x in zip(texts, langs) if x == name], BLOCK):
                    h, n = np.unique(Words(piece, kind).hashes().view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h), pa.array(np.full(len(h), number[name], np.int32)), pa.array(n.astype(np.int64))], ["word", "lang", "n"]
                    )

    return run


def lexicon(labelled: DataFrame, languages: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` most frequent words of which at least PURITY are of one language (by hash)."""
    counts = labelled.select("text", "lang").mapInArrow(_count_words(languages), "word long, lang int, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    by_word = counts.groupBy("word").agg(F.sum("n").alias("n"), F.max(F.struct("n", "lang")).alias("top"))
    kept = by_word.where(F.col("top.n") >= PURITY * F.col("n")).orderBy(F.desc("n"), "word").select("word", F.col("top.lang").alias("lang")).limit(size)
    rows = sorted((r.word, r.lang) for r in kept.collect())
    return np.array([w for w, _ in rows], np.int64), np.array([x for _, x in rows], np.int64)


def _windows(window: int):
    def run(batches):
        import zlib

        kind = letters()
        for batch in batches:
            ids, texts, langs = (c.to_pylist() for c in batch.columns)
            out, of = [], []
            for doc_id, text, lang in zip(ids, texts, langs):
                text = text.lower()
                words = Words([text], kind)
                if not len(words):
                    continue
                at = zlib.crc32(f"window{doc_id}".encode()) % max(1, len(words) - window + 1)
                spans = zip(words.first[at : at + window].tolist(), words.stop[at : at + window].tolist())
                out.append(" ".join([text[a - 1 : b - 1] for a, b in spans]))  # a line feed precedes the text
                of.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(of, pa.string())], ["text", "lang"])

    return run


def _gradient_steps(words: Words, label: np.ndarray, opens: np.ndarray, m: Model, epochs: int) -> None:
    """Full-batch Adam on the conditional log-likelihood, with a small ridge."""
    k = len(m.languages)
    lex = lexicon_rows(words, m.words, m.word_language, k)
    grams = [words.grams(order) for order in ORDERS]
    rows, of_word = np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams])
    truth = np.eye(k)[label]
    inner = np.flatnonzero(~opens)
    params = [m.table, m.of_lexicon, m.start, m.transition]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    n = len(label)
    real = np.zeros((k, k))
    np.add.at(real, (label[inner - 1], label[inner]), 1.0)
    for step in range(1, epochs + 1):
        emit = emissions(words, m)
        pair, post = _pair_posteriors(emit, opens, m)
        off = (truth - post) / n
        table = np.stack([np.bincount(rows, off[of_word, j], len(m.table)) for j in range(k)], axis=1)
        in_lex = np.stack([np.bincount(lex, off[:, j], k + 1) for j in range(k)], axis=1)
        grads = [table, in_lex, off[opens].sum(axis=0), (real - pair) / n]
        for p, g, (first, second) in zip(params, grads, state):
            g = g - 1e-6 * p
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            p += 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)


def _pair_posteriors(emit: np.ndarray, opens: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Expected transitions and word posteriors of equally long sequences."""
    k = emit.shape[1]
    length = int(np.diff(np.append(np.flatnonzero(opens), len(opens)))[0])
    e = np.exp(emit - emit.max(axis=1, keepdims=True)).reshape(-1, length, k)
    move, begin = np.exp(m.transition - m.transition.max()), np.exp(m.start - m.start.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for t in range(length):
        v = (begin if t == 0 else alpha[:, t - 1] @ move) * e[:, t]
        alpha[:, t] = v / v.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        v = (e[:, t + 1] * beta[:, t + 1]) @ move.T
        beta[:, t] = v / v.sum(axis=1, keepdims=True)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    pair = np.zeros((k, k))
    for t in range(1, length):
        joint = alpha[:, t - 1, :, None] * move * (e[:, t] * beta[:, t])[:, None, :]
        pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return pair, post.reshape(-1, k)


def fit(docs: DataFrame, fold: int = 0, of: int = 5, docs_per_language: int = DOCS_PER_LANGUAGE, lexicon_words: int = LEXICON_WORDS, epochs: int = EPOCHS) -> Model:
    """Learn from rows with text and lang whose crc32(doc_id as text) mod ``of`` is not ``fold``.

    The lexicon counts every word of all of them. Weights are fitted on a bounded sample: one
    window of WINDOW words from about ``docs_per_language`` documents of each language, drawn by
    a hash of doc_id. A table without such rows gives a model without languages.
    """
    labelled = _labelled(docs, fold, of)
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    k = len(languages)
    empty = np.zeros(0, np.int64)
    m = Model(languages, np.zeros((1 << HASH_BITS, k)), np.zeros((k + 1, k)), np.zeros(k), np.zeros((k, k)), empty, empty)
    if not k:
        return m
    m.words, m.word_language = lexicon(labelled, languages, lexicon_words)
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, F.lit(docs_per_language / sizes[name])).otherwise(share)
    drawn = labelled.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30) < share)
    sample = sorted(((r.lang, r.text) for r in drawn.mapInArrow(_windows(WINDOW), "text string, lang string").collect()))
    rng = np.random.default_rng(11)
    words, label = [], []
    for i in rng.permutation(len(sample)):
        lang, text = sample[i]
        some = text.split(" ")[: int(rng.integers(3, WINDOW + 1))]  # spans of varied length, so changes come anywhere
        words += some
        label += [languages.index(lang)] * len(some)
    length = min(48, len(words))
    if not length:
        return m
    words, label = words[: len(words) // length * length], label[: len(label) // length * length]
    held = Words([" ".join(words)], letters())
    opens = np.zeros(len(label), bool)
    opens[::length] = True
    _gradient_steps(held, np.array(label), opens, m, epochs)
    return m


def _predict_rows(shared, place: int, names: list[str]):
    def run(batches):
        kind, m = letters(), Model(**shared.value)
        for batch in batches:
            langs, scores = predict(batch.column(place).to_pylist(), m, kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *names])

    return run


def identify(docs: DataFrame, model: Model, name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language (column ``name``) and ``score`` of each whole text; map-only.

    A null text, and one without a letter, is ``und`` with score 0. Ties go to the first language
    in order of name. Columns of these two names are replaced; all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by the table's size, languages and lexicon
    rows = docs.drop(name, score)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_predict_rows(shared, rows.columns.index("text"), [name, score]), f"{fields}, `{name}` string, `{score}` double")


@own_names
def keep_identified(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """``docs`` without texts that have no letter or no language of score ``least`` or more; columns as they were."""
    marked = identify(docs, model, "_lang_pred", "_lang_score")
    return marked.where((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_score") >= least)).drop("_lang_pred", "_lang_score")


def op4_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; a row without doc_id is never learnt from and held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return identify(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
