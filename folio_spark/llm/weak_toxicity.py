"""Toxicity by weak supervision.

Voters are lexicons and patterns: words, prefixes and suffixes that labelled toxic documents hold
more often than clean ones, groups of them that stay silent (a vote for clean), and patterns of
style. A generative label model estimates from the votes how often each voter fires on either
class and how strongly voters depend on each other; its posterior labels train a linear
classifier, which scores whole texts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sift

WORD = re.compile(r"[^\W\d_]+")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
PREFIXES, SUFFIXES = (4, 5, 6), (4, 5)
SAMPLE = 8_000  # labelled documents of each class that the models are fitted on, about
TERMS = 2_000  # lexicon entries of each class in the classifier
VOTERS = 300  # of them, those that vote by themselves
SHARDS = 8  # groups of lexicon entries whose silence is a vote for clean
LEAST = 4  # labelled toxic documents that must hold an entry
PRECISION = 0.5  # share of toxic documents among an entry's, at the lower 95 % bound
STRONG = 0.5  # correlation from which voters count as dependent
FEW = 20.0  # documents by which correlations of voters are shrunk
THRESHOLD = 0.7
WORDS_KNOWN = 200_000  # words whose entries a task keeps at hand


def terms_of(word: str) -> list[str]:
    """The word and its affixes: ``=word``, ``pref-``, ``-suff``."""
    out = ["=" + word]
    out += [word[:n] + "-" for n in PREFIXES if len(word) > n]
    out += ["-" + word[-n:] for n in SUFFIXES if len(word) > n]
    return out


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def styles(text: str | None) -> list[bool]:
    """Pattern voters: shouting, many exclamation marks, mostly very short, no words at all."""
    text = text or ""
    upper = len(UPPER.findall(text))
    return [2 * upper > len(text) > 0, text.count("!") * 50 > len(text) > 0, 0 < len(text) < 40, not text.strip()]


def _count_terms(batches):
    for batch in batches:
        toxic, clean = Counter(), Counter()
        known: dict[str, list[str]] = {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = set()
            for word in words_of(text):
                if (terms := known.get(word)) is None:
                    terms = known[word] = terms_of(word)
                found.update(terms)
            (toxic if label else clean).update(found)
        names = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[t] for t in names], pa.int64()), pa.array([clean[t] for t in names], pa.int64())], ["term", "n1", "n0"]
        )


def mined(labelled: DataFrame, n1: int, n0: int, size: int = TERMS) -> tuple[list[str], list[str]]:
    """Entries that speak for toxic, and for clean, counted over all labelled documents.

    Toxic: the ``size`` of most toxic documents whose share of toxic is at least PRECISION by
    Wilson's lower bound. Clean: a tenth as many, by log odds times the root of support.
    """
    counts = labelled.select("text", "toxic").mapInArrow(_count_terms, "term string, n1 long, n0 long")
    counts = counts.groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    n, z2 = F.col("n1") + F.col("n0"), 1.96**2
    share = F.col("n1") / n
    low = (share + z2 / (2 * n) - 1.96 * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    scored = counts.withColumn("low", low).withColumn("strength", odds * F.sqrt(n))
    scored = scored.where(((F.col("n1") >= LEAST) & (F.col("low") >= PRECISION)) | (F.col("strength") < -1.0))
    for_toxic = scored.where(F.col("low") >= PRECISION).orderBy(F.desc(F.col("n1") * F.col("low")), "term").limit(size)
    for_clean = scored.where(F.col("low") < PRECISION).orderBy("strength", "term").limit(size // 10)
    sides = for_toxic.select("term", F.lit(1).alias("side")).union(for_clean.select("term", F.lit(0).alias("side"))).collect()
    return [r.term for r in sides if r.side], [r.term for r in sides if not r.side]


def entries(text: str | None, number: dict[str, int], known: dict[str, tuple[int, ...]]) -> set[int]:
    """Numbers of the lexicon entries the text holds."""
    found: set[int] = set()
    for word in words_of(text):
        if (ids := known.get(word)) is None:
            if len(known) >= WORDS_KNOWN:
                known.clear()
            ids = known[word] = tuple(number[t] for t in terms_of(word) if t in number)
        if ids:
            found.update(ids)
    return found


def _held_entries(terms: list[str]):
    number = {t: i for i, t in enumerate(terms)}

    def run(batches):
        known: dict = {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            columns = [pa.array([sorted(entries(t, number, known)) for t in texts], pa.list_(pa.int32())), pa.array([styles(t) for t in texts], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["terms", "styles", "toxic"])

    return run


def votes(held: np.ndarray, style: np.ndarray) -> np.ndarray:
    """Fired voters per document: entries of the toxic lexicon, silent shards of it, styles."""
    silent = [~held[:, s::SHARDS].any(axis=1) for s in range(min(SHARDS, held.shape[1]))]
    return np.concatenate([held[:, :VOTERS], *(s[:, None] for s in silent), style], axis=1).astype(np.float32)


def label_model(fired: np.ndarray, share: float, weight: np.ndarray, start: np.ndarray, n_toxic: int = 0, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic, P(fires | class), dependence weights) by expectation-maximisation.

    Classes are latent. ``share`` is the prior of toxic, ``weight`` the documents' weights,
    ``start`` a first posterior; the first ``n_toxic`` voters are taken to fire no less on toxic
    texts than on clean ones, which keeps the latent class the one that is meant. Within a class voters may depend on each other: a voter's evidence
    is divided by one plus its summed strong correlations with the others, so that entries for one and
    the same word count about once.
    """
    post = start.astype(np.float64)
    for _ in range(rounds):
        mass = np.stack([weight * (1 - post), weight * post])
        total = mass.sum(axis=1, keepdims=True)
        rate = (mass @ fired + 0.1) / (total + 1.0)
        rate[1, :n_toxic] = np.maximum(rate[1, :n_toxic], rate[0, :n_toxic])
        spread = np.zeros((fired.shape[1],) * 2)
        for c in range(2):
            centred = (fired - rate[c]) * np.sqrt(mass[c] / max(total[c, 0], 1e-9))[:, None]
            cov = (centred.T @ centred).astype(np.float64)
            sd = np.sqrt(np.diag(cov))
            # Firing together on a few documents is no sign of dependence.
            spread = np.maximum(spread, np.abs(cov) / (np.outer(sd, sd) + FEW / len(fired)))
        np.fill_diagonal(spread, 0.0)
        depend = 1.0 / (1.0 + np.where(spread > STRONG, spread, 0.0).sum(axis=1))
        yes, no = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
        logit = np.log(share / (1 - share)) + fired @ (depend * (yes - no)) + (depend * no).sum()
        post = 1.0 / (1.0 + np.exp(-np.clip(logit, -50, 50)))
    return post, rate, depend


def linear_model(rows: list[np.ndarray], size: int, target: np.ndarray, weight: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by Adam; the last weight is the bias."""
    at = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)]) if rows else np.zeros(0, np.int64)
    of = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    scale = weight / weight.sum()
    for step in range(1, steps + 1):
        logit = np.bincount(at, w[of], len(rows)) + w[-1]
        off = (1.0 / (1.0 + np.exp(-np.clip(logit, -50, 50))) - target) * scale
        grad = np.append(np.bincount(of, off[at], size) + ridge * w[:-1], off.sum())
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
    return w


def fit(docs: DataFrame, labels: DataFrame, fold: int = 1, of: int = 3, sample: int = SAMPLE, size: int = TERMS) -> tuple[list[str], np.ndarray]:
    """Lexicon entries and their weights (bias last), from rows whose crc32(doc_id) mod ``of`` is not ``fold``.

    The lexicon is mined from all labelled documents; the label model and the classifier are fitted
    on about ``sample`` documents of each class, drawn by a hash of doc_id. A doc_id with several
    labels is toxic if one of them is; without labels, or with one class only, every text scores the
    share of toxic labels (0 if there are none).
    """
    learnt = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of != fold, F.lit(False)) & F.col("toxic").isNotNull()
    known = labels.where(learnt).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def with_text(some: DataFrame) -> DataFrame:
        # One way at every size: labels grow with the documents, so they are merged and never broadcast.
        return sift(texts, "doc_id", some, "_id").join(some.hint("merge"), F.col("doc_id") == F.col("_id")).select("text", (F.col("toxic") > 0).alias("toxic"), "doc_id")

    labelled = with_text(known)
    sizes = {bool(r.toxic): r.n for r in known.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    share = n1 / (n1 + n0) if n1 + n0 else 0.0
    if not n1 or not n0:
        return [], np.array([np.log(max(share, 1e-9) / max(1 - share, 1e-9))])
    toxic, clean = mined(labelled, n1, n0, size)
    terms = toxic + clean
    draw = F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = with_text(known.where(draw < F.when(F.col("toxic") > 0, sample / n1).otherwise(sample / n0)))
    rows = drawn.select("text", "toxic").mapInArrow(_held_entries(terms), "terms array<int>, styles array<boolean>, toxic boolean").collect()
    rows = sorted(rows, key=lambda r: (r.terms, r.styles, r.toxic))
    if not rows:
        return [], np.array([np.log(share / (1 - share))])
    held = np.zeros((len(rows), len(terms)), bool)
    for i, r in enumerate(rows):
        held[i, r.terms] = True
    label = np.array([r.toxic for r in rows])
    weight = np.where(label, max(1.0, n1 / sample), max(1.0, n0 / sample))
    fired = votes(held[:, : len(toxic)], np.array([r.styles for r in rows]))
    post, _, _ = label_model(fired, share, weight, np.where(label, 0.99, 0.01), min(VOTERS, len(toxic)))
    return terms, linear_model([np.array(r.terms, np.int64) for r in rows], len(terms), post, weight)


def _scores(shared):
    def run(batches):
        terms, weights = shared.value
        number, known = {t: i for i, t in enumerate(terms)}, {}
        values, bias = weights[:-1], float(weights[-1])
        for batch in batches:
            logit = np.array([bias + sum([values[i] for i in entries(t, number, known)]) for t in batch.column(1).to_pylist()])
            score = 1.0 / (1.0 + np.exp(-np.clip(logit, -50, 50)))
            columns = [batch.column(0), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    return run


def score_texts(docs: DataFrame, terms: list[str], weights: np.ndarray) -> DataFrame:
    """(doc_id, score, predicted) per row; map-only. Null and empty texts hold no entry and get the bias."""
    shared = docs.sparkSession.sparkContext.broadcast((terms, weights))  # bounded by TERMS
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(shared), "doc_id long, score double, predicted int")


def op8_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; a row without doc_id is held out."""
    scored = score_texts(docs, *fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
