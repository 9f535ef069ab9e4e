"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic
function of its words and their beginnings (which stand for stems in languages
that inflect or compound); the document's is their noisy-or, with a leak for labels
that no sentence explains: ``1 - (1 - leak) * prod(1 - p)``.  Weights and leak
are fitted to document labels; the sentences' probabilities then show where the
offending passage is.  When documents are scored, sentences with less than
``NOTHING`` count as none, so that a book isn't toxic for its length.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sample: at most so many labelled documents, of at most so many characters each.
SAMPLE, SAMPLE_CHARS = 6000, 20_000
#: Words and beginnings with a weight: those in at least LEAST documents of the sample, the KEPT most frequent.
LEAST, KEPT = 3, 60_000
#: Lengths of the beginnings of words.
STEMS = (4, 5, 6, 7)
#: Words whose weight a task keeps.
WORDS_KEPT = 150_000
#: log-odds of a sentence without weighted words, and those below which a sentence adds nothing to a score (a probability of 0.02).
BASE, NOTHING = -9.0, -3.9
STEPS, RATE, SHRINK = 120, 0.2, 0.05
SENTENCE = regex.compile(r"[^.!?\n]*[.!?\n]?")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}']+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences that hold a word: up to and with . ! ? or a line's end."""
    return [m.span() for m in SENTENCE.finditer(text) if WORD.search(m[0])]


def bags(text: str | None) -> list[set[str]]:
    """The distinct lower-case words of each sentence with a word."""
    if not text:
        return []
    found = (set(WORD.findall(s)) for s in regex.split(r"[.!?\n]+", text.lower()))
    return [b for b in found if b]


def features(word: str) -> list[str]:
    """The word itself, and its beginnings with a mark for what is left out."""
    return [word, *[word[:n] + "-" for n in STEMS if len(word) > n]]


class Model:
    """``weights`` of words and beginnings; those of whole words are summed up when first met."""

    def __init__(self, weights: dict[str, float], leak: float, base: float = BASE):
        self.weights, self.leak, self.base = weights, leak, base
        self._words: dict[str, float] = {}

    def _sum(self, bag: set[str]) -> float:
        known, total = self._words, 0.0
        for word in bag:
            w = known.get(word)
            if w is None:
                if len(known) >= WORDS_KEPT:
                    known.clear()
                get = self.weights.get
                w = known[word] = sum(get(f, 0.0) for f in features(word))
            total += w
        return total

    def score(self, text: str | None) -> float:
        """Probability of the label; a text without words, or without any sentence over NOTHING, has the leak, however long it is."""
        hidden = 0.0
        for bag in bags(text):
            z = self.base + self._sum(bag)
            if z >= NOTHING:
                hidden += math.log1p(math.exp(z)) if z < 500 else z
        return 1.0 - (1.0 - self.leak) * math.exp(-hidden)

    def locate(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences with at least that probability."""
        out = []
        for a, b in sentences(text or ""):
            z = self.base + self._sum(set(WORD.findall(text[a:b].lower())))
            p = 1.0 / (1.0 + math.exp(-min(max(z, -500.0), 500.0)))
            if p >= least:
                out.append((a, b, p))
        return out


def learn(rows: Iterable[tuple[str | None, int]], steps: int = STEPS, rate: float = RATE, shrink: float = SHRINK, least: int = LEAST) -> Model:
    """Fit weights to (text, label) by full-batch gradient steps, two thirds of them with soft thresholding; the same on each run.

    Without rows the leak is 0, and with labels of one kind alone it is that label: no weight tells anything then."""
    texts = [(t, int(y)) for t, y in rows]
    y = np.array([label for _, label in texts], float)
    if not len(y) or y.min() == y.max():
        return Model({}, float(y.mean()) if len(y) else 0.0)
    frequency: Counter = Counter()
    for text, _ in texts:
        frequency.update({f for w in set().union(*bags(text)) for f in features(w)})
    kept = sorted((w for w, n in frequency.items() if n >= least), key=lambda w: (-frequency[w], w))[:KEPT]
    number = {w: i for i, w in enumerate(kept)}
    word, sentence, doc = array("i"), array("i"), array("i")
    del frequency
    for d, (text, _) in enumerate(texts):
        for bag in bags(text):
            mine = sorted(number[f] for w in bag for f in features(w) if f in number)
            word.extend(mine)
            sentence.extend([len(doc)] * len(mine))
            doc.append(d)
    word, sentence, doc = (np.frombuffer(x, np.int32) if len(x) else np.empty(0, np.int32) for x in (word, sentence, doc))
    w, n = np.zeros(len(kept)), len(y)
    leak = 0.02
    m, v, held = np.zeros(len(kept)), np.zeros(len(kept)), np.ones(len(kept), bool)
    for step in range(1, steps + 1):
        z = BASE + np.bincount(sentence, w[word], len(doc))
        hidden = np.bincount(doc, np.logaddexp(0.0, z), n)
        clean = (1.0 - leak) * np.exp(-hidden)
        # d loss / d hidden: 1 for label 0, -clean / (1 - clean) for label 1
        slope = np.where(y == 1, -clean / np.maximum(1.0 - clean, 1e-9), 1.0)
        g = np.bincount(word, (slope[doc] / (1.0 + np.exp(-z)))[sentence], len(kept)) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        pace = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
        if 3 * step < 2 * steps:
            w = w - pace * m / (1 - 0.9**step)
            w = np.sign(w) * np.maximum(np.abs(w) - pace * shrink / n, 0.0)
            held = w != 0
        else:  # what is left is fitted without shrinking
            w = np.where(held, w - pace * m / (1 - 0.9**step), 0.0)
        # leak: labels 1 that no sentence explains, by expectation
        share = leak / np.maximum(1.0 - clean, 1e-9)
        leak = float(np.clip((share * y).sum() / n, 1e-4, 0.4))
    return Model({k: float(x) for k, x in zip(kept, w, strict=True) if abs(x) > 1e-3}, leak)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts outside the held-out part, chosen by a hash of the id: bounded, and the same on each run.

    Null ids and null labels don't count; of an id with several labels the greatest does; no label gives an empty list."""
    ids = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows).select(F.col("doc_id").alias("_id"), "toxic")
    found = docs.select(F.col("doc_id").alias("_id"), "text").filter(F.length("text") <= chars).join(F.broadcast(ids), "_id").dropDuplicates(["_id"])
    return [(r.text, r.toxic) for r in sorted(found.collect(), key=lambda r: r._id)]


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, worst) of every row, the whole text each: the label's probability and the sentence
    (start, end, probability) that is most likely to offend, null if none reaches 0.5.

    Null and empty texts have the leak as score.  Repeated rows are scored each."""
    packed = docs.sparkSession.sparkContext.broadcast((model.weights, model.leak, model.base))  # bounded by KEPT

    def run(parts):
        import pyarrow as pa

        m = Model(*packed.value)
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])
        for batch in parts:
            scores, worst = [], []
            for text in batch.column(1):
                text = text.as_py()
                scores.append(m.score(text))
                found = m.locate(text) if scores[-1] >= 0.5 else []
                top = max(found, key=lambda x: (x[2], -x[0]), default=None)
                worst.append(None if top is None else {"start": top[0], "end": top[1], "probability": top[2]})
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(worst, kind)], names=["doc_id", "score", "worst"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, worst struct<start: long, end: long, probability: double>")


def clean_documents(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``least``, with all their columns."""
    packed = docs.sparkSession.sparkContext.broadcast((model.weights, model.leak, model.base))
    names = docs.columns

    def run(parts):
        import pyarrow as pa

        m, at = Model(*packed.value), names.index("text")
        for batch in parts:
            texts = batch.column(at).cast(pa.string())
            yield batch.filter(pa.array([m.score(t.as_py()) < least for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
