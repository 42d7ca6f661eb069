"""Subword lattice likelihood of whole texts.

The vocabulary of a public tokenizer is taken as it is; its unigram scores are re-estimated on
the training documents by expectation-maximisation over all segmentations. A text's probability
is the sum over every segmentation of its words, found by a forward recursion in logarithms.

Every word starts with the word mark, and pieces with the mark inside are left out, so no piece
spans two words: the sum over the segmentations of a text is the product of the sums of its
words, and each distinct word is summed once for the whole corpus. The lattice of a word holds one
more arc if the training documents have the word: the whole of it, at its discounted frequency.
With N training tokens, V word types, count c and discount d,

    P(word) = max(c - d, 0) / N + (d * V / N) * sum over segmentations of the product of piece scores

which sums to one over all words and the end of a text (P = documents / N).
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # the tokenizer's word mark
STOP = b""  # ends a word
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))  # A-Z only
PRIOR = 0.01  # added to every expected count, so that each piece keeps some probability
PLAIN = 60  # bytes of a word up to which products are tried before logarithms
ROUNDS = 4
COMMON_WORDS = 200_000  # words whose scores are sent to every task; the rest is joined
LN10 = math.log(10.0)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()  # splits at 0x20 and 0x09-0x0D


def vocabulary(path: str = VOCABULARY) -> dict[bytes, float]:
    """Piece (word mark as one zero byte) to starting probability, falling with the stored score.

    Single bytes are always pieces, so every word has a segmentation.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights = {bytes([b]): 1e-6 for b in range(256)}  # byte 0 is the mark
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or MARK in piece[1:] or "\0" in piece:
            continue
        raw = (b"\0" + piece[1:].encode()) if piece.startswith(MARK) else piece.encode()
        if raw.translate(LOWER) == raw:
            weights[raw] = 1.0 / (10.0 - model.get_score(i))  # scores of merges fall by one with the rank
    return normalised(weights, 1.0)


def normalised(weights: dict[bytes, float], words: float) -> dict[bytes, float]:
    """Marked pieces open a word and share one distribution; all others share one with STOP."""
    opening = sum(v for k, v in weights.items() if k[:1] == b"\0")
    inside = sum(v for k, v in weights.items() if k[:1] != b"\0") + words
    return {k: v / (opening if k[:1] == b"\0" else inside) for k, v in weights.items()} | {STOP: words / inside}


def trie(logs: dict[bytes, float]) -> list:
    """Nodes [children by byte, log probability or None, probability, number of the piece]."""
    root: list = [{}, None, 0.0, -1]
    for number, (piece, value) in enumerate(logs.items()):
        if piece == STOP:
            continue
        node = root
        for b in piece:
            node = node[0].setdefault(b, [{}, None, 0.0, -1])
        node[1:] = value, math.exp(value), number
    return root


def log_add(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x if y == -math.inf else x + math.log1p(math.exp(y - x))


def forward(word: bytes, root: list) -> tuple[list[float], list[tuple[int, int, list]]]:
    """Log of the summed weight of all segmentations of each prefix, and the lattice's arcs."""
    none, log1p, exp = -math.inf, math.log1p, math.exp
    alpha = [none] * (len(word) + 1)
    alpha[0] = 0.0
    arcs = []
    for i in range(len(word)):
        before, node, j = alpha[i], root, i
        while (node := node[0].get(word[j])) is not None:
            j += 1
            if (value := node[1]) is not None:
                arcs.append((i, j, node))
                x, y = before + value, alpha[j]
                if y == none:
                    alpha[j] = x
                elif x > y:
                    alpha[j] = x + log1p(exp(y - x))
                else:
                    alpha[j] = y + log1p(exp(x - y))
            if j == len(word):
                break
    return alpha, arcs


def expected(word: bytes, root: list, totals: list[float]) -> None:
    """Add the expected number of uses of each piece (by number) in the word.

    Plain products serve while they do not underflow, logarithms for the rest.
    """
    n = len(word)
    if n <= PLAIN:
        ahead, arcs = [1.0] + [0.0] * n, []
        for i in range(n):
            if not (before := ahead[i]):
                continue
            node, j = root, i
            while (node := node[0].get(word[j])) is not None:
                j += 1
                if value := node[2]:
                    arcs.append((i, j, value, node[3]))
                    ahead[j] += before * value
                if j == n:
                    break
        if (whole := ahead[n]) > 1e-250:
            back = [0.0] * n + [1.0]
            for i, j, value, number in reversed(arcs):
                if after := value * back[j]:
                    back[i] += after
                    totals[number] += ahead[i] * after / whole
            return
    alpha, arcs = forward(word, root)
    beta = [-math.inf] * (n + 1)
    beta[-1] = 0.0
    for i, j, node in reversed(arcs):  # arcs leave in order of their start, so beta[j] is final
        beta[i] = log_add(beta[i], node[1] + beta[j])
    for i, j, node in arcs:
        totals[node[3]] += math.exp(alpha[i] + node[1] + beta[j] - alpha[-1])


def _count_words(batches):
    for batch in batches:
        seen, learnt = Counter(), Counter()
        for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (seen if held else learnt).update(words_of(text))
        names = list(learnt.keys() | seen.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array([learnt[w] for w in names], pa.int64()), pa.array([learnt[w] + seen[w] for w in names], pa.int64())],
            ["word", "c", "uses"],
        )


def _with_held(docs: DataFrame, fold: int, of: int) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == fold, F.lit(True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), held.alias("held_out"))


def _expectation(shared):
    def run(batches):
        root, totals, pieces = trie(shared.value), [0.0] * len(shared.value), list(shared.value)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                expected(b"\0" + word, root, totals)
        used = [i for i, n in enumerate(totals) if n]
        columns = [pa.array([pieces[i] for i in used], pa.binary()), pa.array([totals[i] for i in used], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["piece", "n"])

    return run


def fit(types: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS) -> dict[bytes, float]:
    """Log probabilities of pieces, by EM over the distinct training words.

    The pieces spell words that are new or rare, so each type counts once. What returns to the
    driver is one number per piece of the vocabulary, whatever the corpus.
    """
    spark = types.sparkSession
    logs = {k: math.log(v) for k, v in vocabulary(path).items()}
    learnt = types.where("c > 0").select("word")
    n_words = learnt.count()
    for _ in range(rounds if n_words else 0):
        shared = spark.sparkContext.broadcast(logs)
        parts = learnt.mapInArrow(_expectation(shared), "piece binary, n double")
        counts = {bytes(r.piece): r.n for r in parts.groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        logs = {k: math.log(v) for k, v in normalised({k: counts.get(k, 0.0) + PRIOR for k in logs if k != STOP}, n_words).items()}
        shared.unpersist()
    return logs


def discount(types: DataFrame) -> float:
    """Absolute discount n1 / (n1 + 2 n2) from the words seen once and twice."""
    n = types.agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    return n.once / (n.once + 2 * n.twice) if n.once and n.twice else 0.5


def _word_scores(shared, n_train: int, back_off: float, taken: float):
    def run(batches):
        root, stop, spelled = trie(shared.value), shared.value[STOP], math.log(back_off)
        for batch in batches:
            scores = []
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                log_p = forward(b"\0" + word, root)[0][-1] + stop + spelled
                scores.append((log_add(log_p, math.log((c - taken) / n_train)) if c else log_p) / LN10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "log_p"])

    return run


def _text_scores(shared, n_types: int, n_train: int, n_docs: int, end: float):
    below = math.log10(n_train + n_types + 1) if n_train + n_types else 0.0

    def run(batches):
        from pyspark import TaskContext

        common = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = [[], [], [], [], [], []]
            for text in batch.column(1).to_pylist():
                found = Counter(words_of(text))
                tokens, known, base, score, rest = 1, int(n_docs > 0), math.log10(n_docs + 1) - below, end, []
                for word, n in found.items():
                    tokens += n
                    if (held := common.get(word)) is None:
                        rest.append({"word": word, "n": n})
                    else:
                        known += n if held[0] else 0
                        base += n * (math.log10(held[0] + 1) - below)
                        score += n * held[1]
                for column, value in zip(out, (row, tokens, known, base, score, rest)):
                    column.append(value)
                row += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(out, kinds))],
                ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "log_p", "rest"],
            )

    return run


def score_texts(docs: DataFrame, fold: int = 2, of: int = 7, path: str = VOCABULARY, rounds: int = ROUNDS, common_words: int = COMMON_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id as text) mod ``of`` is not ``fold``; a row without doc_id
    is never learnt from and counts as held out. ``base_score`` is the add-one unigram model of whole
    words, ``score`` the lattice model; both are log10 probabilities of the whole text and its
    end. A null text is an empty one: its end alone. Repeated rows count, and are scored, each.

    ``common_words`` bounds the table sent to the tasks (the most used words); words outside it
    are joined on the word itself. It moves work and does not change a result.
    """
    spark = docs.sparkSession
    held = _with_held(docs, fold, of)
    counted = held.select("text", "held_out").mapInArrow(_count_words, "word binary, c long, uses long")
    types = cut(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("uses").alias("uses")), "words")
    n_docs = held.where(~F.col("held_out")).count()
    words = types.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_train, n_types = words.n + n_docs, words.v + int(n_docs > 0)
    taken = discount(types)
    # Without training words every word is spelled; each text then ends after a word with probability 1/2.
    back_off, end = (taken * words.v / n_train, math.log10(n_docs / n_train)) if words.v else (0.5, math.log10(0.5))
    shared = spark.sparkContext.broadcast(fit(types, path, rounds))
    scored = cut(types.mapInArrow(_word_scores(shared, n_train, back_off, taken), "word binary, c long, uses long, log_p double"), "word-scores")
    top = scored.orderBy(F.desc("uses"), "word").select("word", "c", "log_p").limit(common_words)
    common = spark.sparkContext.broadcast({bytes(r.word): (r.c, r.log_p) for r in top.toLocalIterator()})
    schema = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, log_p double, rest array<struct<word:binary,n:long>>"
    partly = cut(held.mapInArrow(_text_scores(common, n_types, n_train, n_docs, end), schema), "text-scores")
    rest = partly.select("row", F.explode("rest").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    met = rest.join(scored.select("word", "c", F.col("log_p").alias("p")), "word")
    below = F.log10(F.lit(float(n_train + n_types + 1)))
    sums = met.groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_known"),
        F.sum(F.col("n") * (F.log10(F.col("c") + 1.0) - below)).alias("_base"),
        F.sum(F.col("n") * F.col("p")).alias("_log_p"),
    )
    both = partly.drop("rest").join(sums, partly["row"] == sums["_row"], "left")

    def plus(a: str, b: str, name: str):
        return (F.col(a) + F.coalesce(b, F.lit(0))).alias(name)

    return both.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "_known", "n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        plus("base", "_base", "base_score"), plus("log_p", "_log_p", "score"),
    )
