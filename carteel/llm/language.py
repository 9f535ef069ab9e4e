"""Language identification by unigrams over pieces, summed over all segmentations.

Each language has probabilities for the pieces of a fixed public vocabulary.  A
word's probability is the sum over all ways to cut it into pieces, found by a
forward algorithm; a text's is the product over its words.  The probabilities
come from expectation maximisation with the forward-backward algorithm on a
bounded sample of labelled documents, a task for each language; every document is
scored, whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import batches, texts_of

#: The sample: at most so many documents of a language, and of a longer text a part of so many characters, from a place that a hash of the id chooses.
SAMPLE, SAMPLE_CHARS = 400, 20_000
#: Pieces longer than this many characters (with the word mark) are left out.
LONGEST = 12
#: Rounds of expectation maximisation, and the count that every piece has besides.
ROUNDS, PRIOR = 3, 0.05
#: Words of more letters (and the mark) are learned in logarithms.
LONG_WORD = 40
#: Probability of a character that no piece covers.
UNKNOWN = 1e-7
MARK = "▁"
#: Between words: anything but letters and their marks.
BETWEEN = r"[^\p{L}\p{M}]+"
#: Word scores that a process keeps.
KEPT = 300_000


def pieces(model: str = "piece_bpe_32k.model", longest: int = LONGEST) -> list[str]:
    """The vocabulary: letter pieces of a public model, in lower case, in its order."""
    import sentencepiece

    from .tokens import tokenizer_file

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(model))
    found = dict.fromkeys(sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()))
    return [p for p in found if len(p) <= longest and regex.fullmatch(MARK + r"?[\p{L}\p{M}]+|" + MARK, p)]


def split_words(texts: pa.Array) -> pa.ListArray:
    """Runs of letters and marks of each text, in lower case; empty ones at the ends stay."""
    return pc.split_pattern_regex(pc.utf8_lower(texts), BETWEEN)


def words(text: str | None) -> list[str]:
    """The words of one text."""
    found = split_words(pa.array([text or ""], pa.string())).flatten().to_pylist()
    return [w for w in found if regex.search(r"\p{L}", w)]


class Model:
    """``probs``: a row for each of ``pieces``, a column for each of ``languages``."""

    def __init__(self, languages: list[str], pieces: list[str], probs: np.ndarray, longest: int = LONGEST):
        self.languages, self.pieces, self.probs, self.longest = languages, pieces, probs, longest

    @property
    def table(self) -> dict[str, tuple[float, ...]]:
        """For each piece, its probability in each language."""
        return dict(zip(self.pieces, map(tuple, self.probs.tolist()), strict=True))

    def log_probability(self, word: str) -> list[float]:
        """log of the sum over all segmentations, for each language: the plain form of what ``Scorer`` does for many words."""
        text, table, n = MARK + word, self.table, len(self.languages)
        out = []
        for k in range(n):
            at = [0.0]
            for i in range(1, len(text) + 1):
                ways = []
                for j in range(max(0, i - self.longest), i):
                    p = table[text[j:i]][k] if text[j:i] in table else UNKNOWN if i - j == 1 else 0.0
                    if p:
                        ways.append(at[j] + math.log(p))
                most = max(ways)
                at.append(most + math.log(sum(math.exp(w - most) for w in ways)))
            out.append(at[-1])
        return out


def learn_one(texts: Iterable[str], vocabulary: list[str], longest: int = LONGEST, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language, in order of the vocabulary.  Reruns on equal texts agree."""
    seen: Counter = Counter()
    for text in texts:
        seen.update(words(text))
    number = {p: i for i, p in enumerate(vocabulary)}
    spans = [(len(w) + 1, k, _spans(MARK + w, number, longest)) for w, k in sorted(seen.items())]
    prob = np.full(len(vocabulary), 1.0 / max(1, len(vocabulary)))
    for _ in range(rounds):
        got, known = [PRIOR] * len(vocabulary), prob.tolist()
        for n, k, found in spans:
            (_expect if n <= LONG_WORD else _expect_long)(n, found, known, k, got)
        prob = np.array(got) / sum(got)
    return prob


def learn(rows: Iterable[tuple[str, str]], vocabulary: list[str], longest: int = LONGEST, rounds: int = ROUNDS) -> Model:
    """A model from (language, text) rows; without rows it has no language, and every text is ``und`` for it."""
    texts: dict[str, list[str]] = {}
    for lang, text in rows:
        texts.setdefault(lang, []).append(text)
    found = {lang: learn_one(mine, vocabulary, longest, rounds) for lang, mine in sorted(texts.items())}
    return Model(list(found), vocabulary, np.column_stack(list(found.values())) if found else np.empty((len(vocabulary), 0)), longest)


def _spans(text: str, number: dict[str, int], longest: int) -> list[tuple[int, int, int]]:
    """(start, end, piece) in order of end; an uncovered character is a span with piece -1."""
    out = []
    for i in range(1, len(text) + 1):
        for j in range(max(0, i - longest), i):
            if (piece := number.get(text[j:i])) is not None:
                out.append((j, i, piece))
            elif i - j == 1:
                out.append((j, i, -1))
    return out


def _expect(n: int, spans: list[tuple[int, int, int]], prob: list[float], weight: int, got: list[float]) -> None:
    """Adds the expected counts of the pieces of a word that comes ``weight`` times."""
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    ahead[0] = behind[n] = 1.0
    ps = [prob[p] if p >= 0 else UNKNOWN for _, _, p in spans]
    for (j, i, _), p in zip(spans, ps, strict=True):
        ahead[i] += ahead[j] * p
    for (j, i, _), p in zip(reversed(spans), reversed(ps), strict=True):
        behind[j] += behind[i] * p
    share = weight / ahead[n]
    for (j, i, piece), p in zip(spans, ps, strict=True):
        if piece >= 0:
            got[piece] += ahead[j] * p * behind[i] * share


def _expect_long(n: int, spans: list[tuple[int, int, int]], prob: list[float], weight: int, got: list[float]) -> None:
    """As ``_expect`` in logarithms, for words (or clauses of scripts without spaces) whose probability is too small for a float."""
    none = -math.inf
    ahead, behind = [none] * (n + 1), [none] * (n + 1)
    ahead[0] = behind[n] = 0.0

    def plus(a: float, b: float) -> float:
        high, low = (a, b) if a > b else (b, a)
        return high + math.log1p(math.exp(low - high)) if low > none else high

    ps = [math.log(prob[p] if p >= 0 else UNKNOWN) for _, _, p in spans]
    for (j, i, _), p in zip(spans, ps, strict=True):
        ahead[i] = plus(ahead[i], ahead[j] + p)
    for (j, i, _), p in zip(reversed(spans), reversed(ps), strict=True):
        behind[j] = plus(behind[j], behind[i] + p)
    for (j, i, piece), p in zip(spans, ps, strict=True):
        if piece >= 0:
            got[piece] += weight * math.exp(ahead[j] + p + behind[i] - ahead[n])


def sample(docs: DataFrame, per_language: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(lang, text): at most ``per_language`` labelled texts of every language, those with the least hash of id and text, of at
    most ``chars`` characters each; the same on each run.

    A share of the hash's range that holds a few times as many rows is cut off for each language before anything is
    shuffled, so the task that picks them gets about as many at every size of the table."""
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(7), F.col("doc_id"), F.col("text")).alias("_order"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("_order", 0.05).alias("_n"))  # repeated rows count once
    # four times as many as wanted and some more: fewer than wanted come from it with a probability below 1e-9
    reach = F.least(F.lit(1.0), F.lit(4.0 * per_language + 100) / F.col("_n"))
    low = F.lit(float(-(2**63))) + reach * F.lit(2.0**64)
    counts = counts.select("lang", F.when(reach >= 1, F.lit(math.inf)).otherwise(low).alias("_high"))  # far smaller than the model
    near = rows.join(F.broadcast(counts), "lang").filter(F.col("_order").cast("double") <= F.col("_high")).drop("_high")
    begin = F.when(F.length("text") > chars, F.pmod(F.col("_order"), F.length("text") - chars + 1)).otherwise(0).cast("int") + 1
    cut = near.select("lang", "_order", F.substr("text", begin, F.lit(chars)).alias("text")).dropDuplicates(["lang", "_order"])
    top = Window.partitionBy("lang").orderBy("_order", "text")
    return cut.withColumn("_k", F.row_number().over(top)).filter(F.col("_k") <= per_language).select("lang", "text")


def learn_languages(docs: DataFrame, vocabulary: list[str] | None = None, per_language: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """A model of every language that labels a row of ``docs`` (text, lang), each learned in a task of its own; a number for each
    piece and language comes to the driver."""
    vocabulary = pieces() if vocabulary is None else vocabulary

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("text")
        prob = learn_one(table["text"].to_pylist(), vocabulary)
        return pa.table({"lang": table["lang"].slice(0, 1), "prob": pa.array([prob.tolist()], pa.list_(pa.float64()))})

    found = sample(docs, per_language, chars).groupBy("lang").applyInArrow(run, "lang string, prob array<double>").collect()
    found = sorted((r.lang, r.prob) for r in found)
    return Model([lang for lang, _ in found], vocabulary, np.array([p for _, p in found]).T if found else np.empty((len(vocabulary), 0)))


class Scorer:
    """Scores texts; keeps the scores of the words it has met.

    Words of one length run through the forward algorithm together: a substring
    is looked up by a polynomial hash among those of the pieces."""

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, model: Model):
        self.model, self._row = model, {}
        n = len(model.languages)
        self._scores = np.empty((KEPT, n))
        hashes = np.array([self._hash(p) for p in model.pieces], np.uint64)
        order = np.argsort(hashes)
        self._hashes = hashes[order]
        # a row for each piece, one for characters without piece, one for other substrings
        self._probs = np.vstack([model.probs[order], np.full((1, n), UNKNOWN), np.zeros((1, n))])

    def _hash(self, piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(self._BASE) + ord(c) + 1) & (2**64 - 1)
        return np.uint64(h)

    def _same_length(self, found: list[str]) -> np.ndarray:
        chars = np.array([list(map(ord, MARK + w)) for w in found], np.uint64) + np.uint64(1)
        count, size = chars.shape
        known, probs, longest = self._hashes, self._probs, self.model.longest
        unknown, none = len(known), len(known) + 1
        ahead = np.zeros((count, size + 1, probs.shape[1]))
        ahead[:, 0] = 1.0
        logs = np.zeros((count, probs.shape[1]))
        powers = [np.uint64(pow(int(self._BASE), k, 2**64)) for k in range(longest)]
        for i in range(1, size + 1):
            most = min(i, longest)
            h = np.zeros(count, np.uint64)
            total = np.zeros((count, probs.shape[1]))
            for k in range(1, most + 1):
                h = h + chars[:, i - k] * powers[k - 1]  # one more character in front
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                row = np.where(known[at] == h, at, unknown if k == 1 else none) if len(known) else np.full(count, unknown if k == 1 else none)
                total += ahead[:, i - k] * probs[row]
            ahead[:, i] = total
            if i % 8 == 0 and i < size:  # keep the numbers in range
                logs += np.log(total)
                ahead[:, max(0, i - longest) : i + 1] /= total[:, None, :]
        return logs + np.log(ahead[:, size])

    def _learn(self, fresh: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in fresh:
            by_length.setdefault(len(w), []).append(w)
        for size, group in sorted(by_length.items()):
            step = max(1, (1 << 19) // (size + 2))
            for a in range(0, len(group), step):
                part = group[a : a + step]
                first = len(self._row)
                self._scores[first : first + len(part)] = self._same_length(part)
                self._row.update(zip(part, range(first, first + len(part)), strict=True))

    def scores(self, found: list[str]) -> np.ndarray:
        """A row for each word of ``found``; zeros for what has no letter."""
        row, out = self._row, np.zeros((len(found), len(self.model.languages)))
        for a in range(0, len(found), KEPT // 2):
            part = found[a : a + KEPT // 2]
            distinct = dict.fromkeys(part)
            fresh = [w for w in distinct if w not in row and w and regex.search(r"\p{L}", w)]
            if len(row) + len(fresh) > KEPT:
                row.clear()
                fresh = [w for w in distinct if w and regex.search(r"\p{L}", w)]
            self._learn(fresh)
            at = np.array([row.get(w, -1) for w in part], np.int64)
            out[a : a + len(part)] = np.where(at[:, None] >= 0, self._scores[at], 0.0)
        return out

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities, whether there is a word) of each text."""
        split = split_words(texts)
        ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        rows = self.scores(coded.dictionary.to_pylist())
        number = coded.indices.to_numpy()
        total = np.zeros((len(texts), rows.shape[1]))
        for d in range(len(texts)):
            total[d] = rows[number[ends[d] : ends[d + 1]]].sum(axis=0)
        return total, total.any(axis=1)

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Languages and posteriors with equal priors; 'und' and 0 for texts without a letter."""
        if not self.model.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        total, there = self.sums(texts)
        best = total.argmax(axis=1)
        gap = np.maximum(total - total[np.arange(len(total)), best][:, None], -700)
        score = np.where(there, 1.0 / np.exp(gap).sum(axis=1), 0.0)
        return [self.model.languages[b] if t else "und" for b, t in zip(best.tolist(), there.tolist(), strict=True)], score.tolist()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; the whole text counts.

    Null texts and texts without a letter are ``und`` with score 0, as is all
    text for a model without languages.  Repeated rows are scored each."""
    packed = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.probs, model.longest))  # 8 bytes for each piece and language

    def run(parts):
        scorer = Scorer(Model(*packed.value))
        for batch in parts:
            texts = texts_of(batch.column(1))
            for a, b in batches(texts):
                lang, score = scorer.predict(texts.slice(a, b - a))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents that aren't held out, then predict for every document.

    A null doc_id isn't held out.  Without any label all texts are ``und``."""
    model = learn_languages(docs.filter(~held_out()))
    return identify(docs, model).withColumn("held_out", held_out())
