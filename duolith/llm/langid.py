"""Language identification: averaged hashed subword embeddings with a linear softmax.

A word's subwords are its byte n-grams, with a mark on either side of the word,
hashed into BUCKETS embeddings. A text is the mean embedding of all subwords of all its
words; a linear softmax turns it into languages. Both layers are trained by
stochastic gradient descent in numpy, on whole texts and on their lines, so that
short texts are known too. Probabilities are tempered on rows kept from training,
which also give the score below which a prediction isn't accepted.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duolith.llm.common import Rows, crc_of_id, map_batches, map_texts

BITS, WIDTH, GRAMS = 16, 16, (2, 3, 4, 5)
BUCKETS = 1 << BITS
#: Bounds of the training sample: rows of a language, rows in all (shared out where there are many languages), and lines of a text.
MOST_ROWS, MOST_IN_ALL, MOST_LINES = 700, 140_000, 12
#: Share of rightly predicted calibration rows that may be rejected, and the highest score that may be.
REJECTED, SURE = 0.001, 0.5
UNKNOWN = "und"
OTHER = re.compile(r"[\W\d_]+")
#: Word characters that are neither letters nor digits, such as ½, ² and Ⅷ.
NUMBERS = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
#: The embeddings' rate, times that of the output layer: their gradient is spread over all subwords of a text.
EMBEDDING_RATE = 30.0


def marked(text: str) -> str:
    """The letters of a text, lower case, with a space for each run of others; empty if there are none."""
    low = text.lower()
    if not low.isascii() and not NUMBERS.isdisjoint(low):
        low = "".join(" " if c in NUMBERS else c for c in low)
    return OTHER.sub(" ", low).strip()


def subwords(text: str) -> np.ndarray:
    """Buckets of all subwords of a text's words, in no order of meaning; empty if it has no letter."""
    letters = marked(text)
    if not letters:
        return np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(f" {letters} ".encode("utf-8", "replace"), dtype=np.uint8)
    gaps = np.cumsum(raw == 32, dtype=np.int32)
    rolled, out = raw.astype(np.uint64), []
    for n in range(2, max(GRAMS) + 1):
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + raw[n - 1 :]
        if len(rolled) == 0:
            break
        if n in GRAMS:
            # no gap strictly between its ends
            inside = rolled if n == 2 else rolled[gaps[n - 2 : len(raw) - 1] == gaps[: len(raw) - n + 1]]
            out.append((inside * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Subwords of a text and their shares."""
    ids = subwords(text)
    if not len(ids):
        return None
    found, counts = np.unique(ids, return_counts=True)
    return found, counts / len(ids)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # of each subword bucket, BUCKETS x languages
    bias: np.ndarray
    heat: float  # logits are divided by it
    least: float  # scores below it aren't accepted


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[str], langs: list[str], *, passes: int = 3, rate: float = 0.5, seed: int = 11) -> Model:
    """Every eighth text is kept for calibration."""
    names = sorted(set(langs))
    where = {n: i for i, n in enumerate(names)}
    dice = np.random.default_rng(seed)
    embed, out, bias = dice.uniform(-0.5, 0.5, (BUCKETS, WIDTH)) / WIDTH, np.zeros((WIDTH, max(1, len(names)))), np.zeros(max(1, len(names)))
    rows, kept, truths = Rows(), Rows(), ([], [])
    for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        lines = [x for x in text.split("\n") if x.strip()]
        if len(lines) > MOST_LINES:
            lines = [lines[k] for k in dice.choice(len(lines), MOST_LINES, replace=False)]
        for part in [text, *lines] if len(lines) > 1 else [text]:
            if c := counted(part):
                (kept if i % 8 == 7 else rows).add(*c)
                truths[i % 8 == 7].append(where[lang])
    steps, done = max(1, passes * len(rows)), 0
    for _ in range(passes):
        for k in dice.permutation(len(rows)):
            (at, share), y = rows[k], truths[0][k]
            speed = rate * (1 - done / steps)
            mean = share @ embed[at]
            error = softmax(mean @ out + bias)
            error[y] -= 1
            back = out @ error
            out -= speed * np.outer(mean, error)
            bias -= 0.01 * speed * error
            embed[at] -= speed * EMBEDDING_RATE * share[:, None] * back
            done += 1
    logits = embed @ out
    raw = np.array([share @ logits[at] + bias for at, share in map(kept.__getitem__, range(len(kept)))])
    truth = np.array(truths[1], dtype=int)
    heat, least = 1.0, 0.0
    if len(kept):
        loss = lambda h: -np.log(np.maximum(softmax(raw / h)[np.arange(len(kept)), truth], 1e-9)).mean()
        heat = float(min(np.geomspace(0.1, 10, 81), key=loss))
        p = softmax(raw / heat)
        right = p.max(1)[p.argmax(1) == truth]
        least = float(min(SURE, np.quantile(right, REJECTED))) if len(right) else 0.0
    return Model(names, logits.astype(np.float32), bias.astype(np.float32), heat, least)


def predict(m: Model, text: str) -> tuple[str, float]:
    """The likeliest language and its probability; `und` and 0 without a letter or without a model."""
    ids = subwords(text)
    if not len(ids) or not m.languages:
        return UNKNOWN, 0.0
    p = softmax((m.logits[ids].sum(0, dtype=np.float64) / len(ids) + m.bias) / m.heat)
    best = int(p.argmax())
    return m.languages[best], float(p[best])


def training_sample(docs: DataFrame) -> DataFrame:
    """h, text, lang of a bounded sample of each language outside the held-out fold, by a hash of the id.

    A language has MOST_ROWS rows at most, or its share of MOST_IN_ALL where there
    are many languages. Of rows with the same id and language the least text counts.
    Rows are ranked within 64 parts of a language first, then within 8, so that no task
    ranks more than 8 * MOST_ROWS ids but for the first round's even parts.
    """
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where(crc_of_id(F.col("doc_id")) % 4 != 2)
    many = rows.agg(F.count_distinct("lang")).first()[0]
    most = max(1, min(MOST_ROWS, MOST_IN_ALL // max(1, many)))
    h = F.xxhash64("doc_id")
    picked = rows.select("doc_id", "lang", h.alias("h")).distinct()
    for parts in (64, 8, 1):
        w = Window.partitionBy("lang", F.pmod("h", F.lit(parts))).orderBy("h", "doc_id")
        picked = picked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    picked = F.broadcast(picked.select("doc_id", "lang", "h"))  # at most MOST_IN_ALL ids
    found = rows.select("doc_id", "lang", "text").join(picked, ["doc_id", "lang"])
    return found.groupBy("doc_id", "lang", "h").agg(F.min("text").alias("text")).select("h", "text", "lang")


def fit(docs: DataFrame) -> Model:
    """Trains in one task, which gets the bounded sample only; the driver gets the model."""

    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        m = train([t for _, t, _ in rows], [x for *_, x in rows])
        made = [[m.languages], [m.logits.tobytes()], [m.bias.tobytes()], [m.heat], [m.least]]
        kinds = [pa.list_(pa.string()), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds, strict=True)], names=["languages", "logits", "bias", "heat", "least"])

    told = map_batches(training_sample(docs).repartition(1), run, "languages array<string>, logits binary, bias binary, heat double, least double").collect()
    if not told or not told[0]["languages"]:
        return train([], [])
    r = told[0]
    logits, bias = (np.frombuffer(r[c], np.float32) for c in ("logits", "bias"))
    return Model(list(r["languages"]), logits.reshape(BUCKETS, -1), bias, r["heat"], r["least"])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Predicts the language of every whole text.

    Returns doc_id, held_out, lang_pred, score, accepted for each row. Texts that
    are null or have no letter are `und` with score 0 and not accepted, as is
    everything where there is nothing to learn from; repeated rows stay; an empty
    table gives an empty table; languages of equal probability go by name; lang is
    read in training only, other columns never.
    """
    told = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    least = told.value.least

    def make(texts: list[str]) -> dict[str, list]:
        pairs = [predict(told.value, t) for t in texts]
        return {"lang_pred": [p[0] for p in pairs], "score": [p[1] for p in pairs]}

    named = map_texts(docs, make, "lang_pred string, score double")
    return named.select(
        "doc_id", (crc_of_id(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score", ((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).alias("accepted")
    )


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose language is predicted and accepted.

    Null texts and texts without a letter go; repeated rows stay together or go
    together; an empty table gives an empty table.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = told.value
        for batch in batches:
            pairs = [predict(m, t or "") for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and p >= m.least for lang, p in pairs], pa.bool_()))

    return map_batches(docs, run, docs.schema)
