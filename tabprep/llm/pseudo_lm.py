"""Document scores by masked pseudo-likelihood.

A small network predicts the class of each token from the classes on both sides of it: every place of the window has its
own table of weights from the class there to the hidden units, a rectified layer follows, and a softmax over the classes
gives the class's conditional probability. A word's probability is that of its class times the word's share of all
tokens of the class. A document's score is the sum of the logarithms over all its tokens.

The vocabulary is every word of every document. Its counts are a table that grows with the corpus: the most frequent
words are classes of one word each, the others fall into classes by their hash, where counts tell them apart. Counts of
frequent words are sent to every task, those of all others are joined by word, so no task holds the vocabulary.

Training goes over all documents as well: in each round every task takes gradient steps over its own documents, starting
from the same weights, and the tasks' weights are averaged by their numbers of tokens. The size of the network does not
depend on the corpus; the averages are made in groups, then over the groups.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.arrow import id_and_text, in_blocks, rows_batch, text_bytes
from tabprep.llm.hashing import mix, word_hashes
from tabprep.sources.storage import stored

#: Frequent words that are classes of their own, classes of all other words, tokens on each side, hidden units.
WORDS, CLASSES, SIDE, HIDDEN = 191, 64, 2, 32
VOCABULARY = WORDS + CLASSES + 1  # the last: beyond the document's ends
OUTSIDE = VOCABULARY - 1
#: Sums of exponentials above this lose no digits to numbers that are too small for single precision.
LEAST_TOTAL = 1e-25
#: Tokens that are scored together; their logits stay in a processor's cache.
SCORED = 512
#: Words whose counts are sent to every task (16 bytes each). A memory setting, without effect on scores.
SENT_WORDS = 200_000


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])
    for batch in in_blocks(batches, 0):
        words, n = np.unique(word_hashes(*text_bytes(batch.column(0)))[0], return_counts=True)
        yield rows_batch(schema, words.view(np.int64), n)


def word_table(texts: DataFrame) -> DataFrame:
    """(word, n): hash and number of every different word of every text, stored."""
    return stored(texts.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and numbers of so many most frequent words, the most frequent first, ties by hash."""
    rows = counts.orderBy(F.desc("n"), "word").limit(most).toArrow()
    return rows["word"].to_numpy().astype(np.int64).view(np.uint64), rows["n"].to_numpy().astype(np.int64)


def class_of(hashes: np.ndarray) -> np.ndarray:
    """Class, from 0, of words that are no class of their own."""
    return (mix(hashes) % np.uint64(CLASSES)).astype(np.int64)


def class_totals(counts: DataFrame, words: np.ndarray) -> np.ndarray:
    """Tokens of each class of several words."""
    schema = pa.schema([("class", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            rest = ~np.isin(hashes, words)
            np.add.at(total, class_of(hashes[rest]), batch.column(1).to_numpy()[rest])
        yield rows_batch(schema, range(CLASSES), total)

    totals = np.zeros(CLASSES, np.int64)
    for r in counts.mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        totals[r["class"]] = r.n
    return totals


def token_ids(raw: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens and the texts' numbers of tokens: a frequent word's place in the list, or else a class of its hash."""
    hashes, counts = word_hashes(raw, offsets)
    return class_ids(hashes, words), counts


def class_ids(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
    known = words[at] == hashes if len(words) else np.zeros(len(hashes), bool)
    return np.where(known, at, WORDS + class_of(hashes)).astype(np.int64)


def windows(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each token the tokens around it, those beyond its text's ends being OUTSIDE."""
    # Texts stand SIDE places apart, with OUTSIDE between them.
    place = np.arange(len(ids)) + SIDE * np.repeat(np.arange(1, len(counts) + 1), counts)
    spaced = np.full(len(ids) + SIDE * (len(counts) + 1), OUTSIDE, np.int64)
    spaced[place] = ids
    return np.stack([spaced[place + step] for step in (*range(-SIDE, 0), *range(1, SIDE + 1))], 1)


class Network:
    """Weights: tables (window places, vocabulary, hidden), bias, output (hidden, vocabulary) and its bias."""

    def __init__(self, parts: list[np.ndarray] | None = None, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.parts = parts or [rng.normal(0, 0.3, (2 * SIDE, VOCABULARY, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
                               rng.normal(0, 0.1, (HIDDEN, VOCABULARY)).astype(np.float32), np.zeros(VOCABULARY, np.float32)]
        self._logits = np.empty((0, VOCABULARY), np.float32)

    @classmethod
    def read(cls, raw: bytes) -> Network:
        flat, shapes, parts, at = np.frombuffer(raw, np.float32), [p.shape for p in cls().parts], [], 0
        for shape in shapes:
            size = int(np.prod(shape))
            parts.append(flat[at:at + size].reshape(shape).copy())
            at += size
        return cls(parts)

    def write(self) -> bytes:
        return np.concatenate([p.reshape(-1) for p in self.parts]).astype(np.float32).tobytes()

    def _forward(self, around: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hidden units, each row's own logit, the exponentials of all logits and their sums.

        The exponentials are in a buffer that the next call uses again. Logits are shifted by the largest of their row only
        if exponentials leave the range of their type without.
        """
        tables, bias, out, out_bias = self.parts
        units = tables[0].take(around[:, 0], 0)
        units += bias
        for k in range(1, 2 * SIDE):
            units += tables[k].take(around[:, k], 0)
        hidden = np.ones((len(around), HIDDEN + 1), out.dtype)  # the last column meets the bias
        np.maximum(units, 0, out=hidden[:, :HIDDEN])
        if len(self._logits) < len(around) or self._logits.dtype != out.dtype:
            self._logits = np.empty((len(around), VOCABULARY), out.dtype)
        for shifted in (False, True):
            logits = np.matmul(hidden, np.concatenate([out, out_bias[None]]), out=self._logits[:len(around)])
            if shifted:
                logits -= logits.max(1, keepdims=True)
            own = logits[np.arange(len(ids)), ids]
            with np.errstate(over="ignore", under="ignore"):
                np.exp(logits, out=logits)
                total = logits @ np.ones(VOCABULARY, logits.dtype)
            if total.min(initial=1) > LEAST_TOTAL and np.isfinite(total).all():
                break
        return hidden[:, :HIDDEN], own, logits, total

    def log_probabilities(self, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
        _, own, _, total = self._forward(around, ids)
        return own - np.log(total)

    def step(self, around: np.ndarray, ids: np.ndarray, rate: float) -> None:
        """One gradient step on the mean negative log-likelihood of the batch."""
        tables, bias, out, out_bias = self.parts
        hidden, _, p, total = self._forward(around, ids)
        n = len(ids)
        # The gradient's rows are (p - total at the word) times rate / n / total; that factor goes to the narrow matrices.
        p[np.arange(n), ids] -= total
        factor = (rate / n / total).astype(p.dtype)
        back = p @ out.T
        back *= hidden > 0
        back *= factor[:, None]
        out -= (hidden * factor[:, None]).T @ p
        out_bias -= factor @ p
        bias -= back.sum(0)
        # All tables are one: a row for each window place and token; sums over the rows that are met, two numbers at a time.
        rows = (around + VOCABULARY * np.arange(2 * SIDE)).T.reshape(-1).astype(np.uint16)
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        pairs = back.view(np.result_type(back.dtype, np.complex64)).take(order % n, 0)
        tables.reshape(-1, HIDDEN)[rows[first]] -= np.add.reduceat(pairs, first, axis=0).view(back.dtype)


def _train(words: np.ndarray, start: bytes, rate: float, batch_tokens: int):
    schema = pa.schema([("task", pa.int32()), ("tokens", pa.int64()), ("weights", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, seen = Network.read(start), 0
        for batch in in_blocks(batches, 0):
            ids, counts = token_ids(*text_bytes(batch.column(0)), words)
            around = windows(ids, counts)
            for at in range(0, len(ids), batch_tokens):
                network.step(around[at:at + batch_tokens], ids[at:at + batch_tokens], rate)
            seen += len(ids)
        if seen:
            yield rows_batch(schema, [TaskContext.get().partitionId()], [seen], [network.write()])
    return run


def _averaged(frame: pd.DataFrame) -> pd.DataFrame:
    n = frame["tokens"].to_numpy()
    mean = sum(np.frombuffer(w, np.float32) * np.float32(k / n.sum()) for w, k in zip(frame["weights"], n, strict=True))
    return pd.DataFrame({"task": [frame["task"].iloc[0] // GROUP], "tokens": [n.sum()], "weights": [mean.astype(np.float32).tobytes()]})


#: Weights that one task averages.
GROUP = 16


def train(texts: DataFrame, words: np.ndarray, rounds: int = 1, rate: float = 0.5, batch_tokens: int = 512) -> bytes:
    """Weights after so many rounds over all texts."""
    weights = Network().write()
    for k in range(rounds):
        kinds = "task int, tokens long, weights binary"
        level = stored(texts.select("text").mapInArrow(_train(words, weights, rate / (1 + k), batch_tokens), kinds), "weights")
        while (n := level.count()) > 1:
            level = stored(level.groupBy((F.col("task") / GROUP).cast("int").alias("g")).applyInPandas(_averaged, kinds), "weights")
            if n <= GROUP and level.count() > 1:
                level = level.withColumn("task", F.lit(0))
        if row := level.first():
            weights = row.weights
    return weights


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 1) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over all tokens, natural logarithm), mean (per token; null without tokens).

    Words are split at ASCII white space, A-Z in lower case. Null, empty and wordless texts have no tokens and the sum 0.
    Null and repeated ids keep their rows; an empty table stays empty; other columns are not read.
    """
    texts = id_and_text(docs, key, text)
    counts = word_table(texts)
    sent, n_sent = frequent_words(counts, SENT_WORDS)
    words = np.sort(sent[:WORDS] if len(sent) >= WORDS else frequent_words(counts, WORDS)[0])
    with np.errstate(divide="ignore"):
        log_totals = np.log(class_totals(counts, words))
    order = np.argsort(sent)
    sent, log_sent = sent[order], np.log(n_sent[order])
    weights = train(texts, words, rounds)
    all_sent = counts.count() <= len(sent)
    # A row's number lasts only as the table is stored below; ``rest`` are its tokens whose counts are not sent.
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_likelihood", pa.float64()),
                        ("rest", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, row = Network.read(weights), TaskContext.get().partitionId() << 33
        for batch in in_blocks(batches, 1):
            hashes, counts = word_hashes(*text_bytes(batch.column(1)))
            ids = class_ids(hashes, words)
            around, each = windows(ids, counts), np.zeros(len(ids) + 1)
            for at in range(0, len(ids), SCORED):
                each[at:at + SCORED][:len(ids) - at] = network.log_probabilities(around[at:at + SCORED], ids[at:at + SCORED])
            shared = np.flatnonzero(ids >= WORDS)
            found = np.minimum(np.searchsorted(sent, hashes[shared]), max(len(sent) - 1, 0))
            known = sent[found] == hashes[shared] if len(sent) else np.zeros(len(shared), bool)
            each[shared] -= log_totals[ids[shared] - WORDS]
            each[shared[known]] += log_sent[found[known]]
            sums = np.concatenate([[0.0], np.cumsum(each[:-1])])
            ends = np.cumsum(counts)
            rest = shared[~known]
            lists = pa.ListArray.from_arrays(np.searchsorted(rest, np.append(0, ends)).astype(np.int32), hashes[rest].view(np.int64))
            yield rows_batch(schema, np.arange(row, row + len(counts)), batch.column(0), counts, sums[ends] - sums[ends - counts], lists)
            row += len(counts)

    scored = texts.mapInArrow(run, "row long, doc_id long, n_tokens long, log_likelihood double, rest array<long>")
    if not all_sent:
        scored = stored(scored, "scored")
        more = (scored.select("row", F.explode("rest").alias("word")).join(counts, "word").groupBy("row")
                .agg(F.sum(F.log(F.col("n").cast("double"))).alias("more")))
        scored = scored.drop("rest").join(more, "row", "left").withColumn(
            "log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    return scored.select("doc_id", "n_tokens", "log_likelihood",
                         F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean"))


def vocabulary_settings() -> str:
    """The settings as JSON, to be kept beside stored weights."""
    return json.dumps({"words": WORDS, "classes": CLASSES, "side": SIDE, "hidden": HIDDEN})
