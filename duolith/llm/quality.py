"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

A text is read as a stream of tokens: each word's lower-case stem, a mark for
words in capitals, the punctuation after it, and one mark wherever a word repeats
the one before. Unigrams and bigrams of the stream are hashed into 2**BITS
places; a feature's value is the square root of its share, so long and short
texts have vectors of length one. A score is the logistic of a sparse dot product.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolith.llm.common import Rows, crc_of_id, map_batches, map_texts

BITS = 20
#: Labelled rows that training sees at most, of each label.
MOST_ROWS = 3000
REMEMBERED = 50_000
THRESHOLD = 0.3
EDGES = re.compile(r"(\W*)(.*?)(\W*)", re.DOTALL)
SAME, CAPITALS = zlib.crc32(b"\0same"), zlib.crc32(b"\0capitals")
MIX = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Sparse vectors of texts; words are remembered up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def tokens(self, word: str) -> tuple[int, ...]:
        known = self.known.get(word)
        if known is None:
            before, stem, after = EDGES.fullmatch(word).groups()
            parts = [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in (before, stem.lower(), after) if x]
            known = tuple(parts + [CAPITALS] * (len(stem) > 1 and stem.isupper()))
            if len(self.known) < REMEMBERED:
                self.known[word] = known
        return known

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        stream: list[int] = []
        last, known, tokens = "", self.known.get, self.tokens
        for word in text.split():
            if word == last:
                stream.append(SAME)
            else:
                stream += known(word) or tokens(word)
                last = word
        ids = np.array(stream, dtype=np.uint64)
        pairs = ids[:-1] * MIX + ids[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        places = (np.concatenate([ids * MIX, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)
        found, counts = np.unique(places, return_counts=True)
        return found, np.sqrt(counts / max(1, len(places)))


class Ftrl:
    """Follow-the-regularised-leader for logistic loss; the last place is the bias."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-float(w @ x))) - y) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def train(texts: list[str], labels: list[int], *, passes: int = 4, seed: int = 7) -> np.ndarray:
    """Weights, with the bias last; zeros where there is nothing to learn from."""
    features, model, bias, rows = Features(), Ftrl(), 1 << BITS, Rows()
    for text in texts:
        at, x = features(text)
        rows.add(np.append(at, bias), np.append(x, 1.0))
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i], labels[i])
    return model.weights(slice(None)).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """h, text, quality of at most MOST_ROWS rows of each label outside the held-out fold, chosen by a hash of the id.

    Of rows with one id the least text counts.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(crc_of_id(F.col("doc_id")) % 5 != 0).select("doc_id", "quality")
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("_other")).where("quality = _other")
    picked = None
    for y in (0, 1):
        some = known.where(F.col("quality") == y).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_ROWS)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # at most 2 * MOST_ROWS ids
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return rows.select(F.xxhash64("doc_id").alias("h"), "text", "quality")


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Trains in one task, which gets the bounded sample only; the driver gets the weights."""

    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([train([t for _, t, _ in rows], [y for *_, y in rows]).tobytes()], pa.binary())], names=["weights"])

    told = map_batches(labelled_sample(docs, labels).repartition(1), run, "weights binary").collect()
    return np.frombuffer(told[0][0], np.float32) if told else train([], [])


#: One memory of words for each worker process.
FEATURES = Features()


def goodness(weights: np.ndarray, text: str) -> float:
    at, x = FEATURES(text)
    return 1 / (1 + float(np.exp(-(float(weights[at] @ x) + float(weights[-1])))))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; see the module for what a score reads."""
    told = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 weights

    def make(texts: list[str]) -> dict[str, list]:
        return {"score": [goodness(told.value, t) for t in texts]}

    scored = map_texts(docs, make, "score double")
    return scored.select(
        "doc_id", (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def classify(docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None) -> DataFrame:
    """Learns from `labels` (doc_id, quality) and scores every row of docs.

    Returns doc_id, held_out, score, predicted (1: good). Training texts come from
    train_on (docs, if not given). Null and empty texts get the score of the bias;
    without labels every score is 0.5; ids with contradicting labels teach nothing;
    repeated rows stay; a score equal to the threshold is good; an empty table gives
    an empty table; other columns are not read.
    """
    return score(docs, fit(train_on if train_on is not None else docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame, train_on: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject.

    Null and empty texts get the score of the bias, like in classify; repeated rows
    stay or go together; a score equal to the threshold stays; an empty table gives
    an empty table.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(train_on, labels))

    def run(batches):
        w = weights.value
        for batch in batches:
            keep = [goodness(w, t or "") >= THRESHOLD for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, docs.schema)
