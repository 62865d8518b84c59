"""Language identification by interpolated Kneser-Ney character models.

Letters are lower-cased and read word by word, with three spaces before a word and one
after it. Each language has a model of character 4-grams; the models of all languages
share one sorted array of n-gram hashes per order with a row of log-probabilities, so
that one binary search serves all of them. Documents go to the language of the lowest
cross-entropy per character.

The models are fitted on a bounded sample of labelled documents (``sample`` per
language, the first by digest). Prediction covers all documents and whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonolith.llm.words import mix

LETTERS = re.compile(r"[^\W\d_]+")
ORDER = 4
PAD = " " * (ORDER - 1)
UNDETERMINED = "und"


@dataclass(frozen=True)
class LangIdOptions:
    """``sample``: training documents per language. A fifth of them calibrates: the softness
    of the score, and the greatest cross-entropy that is not rejected, ``slack`` above the
    worst one seen in the language, and more for few characters (``short`` / sqrt(n)).
    A language is ranked in ``parts`` parts first."""

    sample: int = 1000
    slack: float = 0.25
    short: float = 5.0
    cache: int = 250_000
    parts: int = 64


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray]  # by order from 1: sorted n-gram hashes
    logp: list[np.ndarray]  # by order: a row per n-gram, a column per language
    contexts: list[np.ndarray]  # by order: sorted hashes of contexts
    backoff: list[np.ndarray]
    unseen: np.ndarray  # log-probability of an unknown character
    softness: float = 1.0
    limit: np.ndarray | None = None  # greatest cross-entropy accepted, by language

    def positions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the padded words, and where the scored characters are."""
        text = "".join(f"{PAD}{w} " for w in words)
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        ends = np.cumsum(lengths + len(PAD))
        at = np.repeat(ends - np.cumsum(lengths), lengths) + np.arange(lengths.sum())
        return cp, at

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probabilities per word and language, and numbers of scored characters."""
        cp, at = self.positions(words)
        out = np.zeros((len(at), len(self.langs)), dtype=np.float32)
        todo = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            h = gram_hash(cp, at[todo], n)
            i, hit = _find(self.keys[n - 1], h)
            out[todo[hit]] += self.logp[n - 1][i[hit]]
            todo = todo[~hit]
            if n > 1 and len(todo):
                i, hit = _find(self.contexts[n - 1], gram_hash(cp, at[todo] - 1, n - 1))
                out[todo[hit]] += self.backoff[n - 1][i[hit]]
        out[todo] += self.unseen
        n_chars = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        return np.add.reduceat(out, np.cumsum(n_chars) - n_chars, axis=0), n_chars


def gram_hash(cp: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(end), n, dtype=np.uint64)
    for j in range(n - 1, -1, -1):
        h = h * np.uint64(0x100000001B3) + cp[end - j]
    return mix(h)


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.searchsorted(keys, h)
    i[i == len(keys)] = 0
    return i, (keys[i] == h) if len(keys) else np.zeros(len(h), dtype=bool)


def _kneser_ney(counts: dict[str, int], vocabulary: int) -> tuple[list[dict[str, float]], list[dict[str, float]]]:
    """Interpolated probabilities of the n-grams of one language, and backoff weights of contexts, by order."""
    levels: list[dict[str, int]] = [{} for _ in range(ORDER)]
    levels[ORDER - 1] = counts
    for n in range(ORDER - 1, 0, -1):  # below the top, in how many different contexts an n-gram appears
        levels[n - 1] = dict(Counter(g[1:] for g in levels[n]))
    probs: list[dict[str, float]] = []
    weights: list[dict[str, float]] = []
    for n, level in enumerate(levels, 1):
        ones, twos = (sum(1 for c in level.values() if c == k) for k in (1, 2))
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        total: Counter = Counter()
        kinds: Counter = Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        weight = {h: discount * kinds[h] / total[h] for h in total}
        lower = probs[-1] if probs else None
        probs.append({g: max(c - discount, 0) / total[g[:-1]] + weight[g[:-1]] * (lower[g[1:]] if lower is not None else 1 / vocabulary) for g, c in level.items()})
        weights.append(weight)
    return probs, weights


def build(grams: pd.DataFrame) -> Model:
    """From the 4-gram counts of each language (columns lang, gram, n)."""
    langs = sorted(grams["lang"].unique())
    vocabulary = len({g[-1] for g in grams["gram"]}) + 1
    fitted = []
    for lang in langs:
        own = grams[grams["lang"] == lang]
        fitted.append(_kneser_ney(dict(zip(own["gram"], own["n"].astype(int), strict=True)), vocabulary))
    unseen = np.array([math.log(w[0].get("", 1.0) / vocabulary) for _, w in fitted], dtype=np.float32)

    def back(l: int, g: str) -> float:
        """Log-probability in language l of an n-gram that may be unseen there."""
        probs, weights = fitted[l]
        out = 0.0
        while g:
            if g in probs[len(g) - 1]:
                return out + math.log(probs[len(g) - 1][g])
            out += math.log(weights[len(g) - 1].get(g[:-1], 1.0))
            g = g[1:]
        return math.log(1 / vocabulary) + out

    keys, logp, contexts, backoff = [], [], [], []
    for n in range(1, ORDER + 1):
        seen = sorted({g for probs, _ in fitted for g in probs[n - 1]})
        h = _hash_strings(seen, n)
        order = np.argsort(h)
        keys.append(h[order])
        logp.append(np.array([[back(l, g) for l in range(len(langs))] for g in seen], dtype=np.float32).reshape(len(seen), len(langs))[order])
        held = sorted({c for _, weights in fitted for c in weights[n - 1]})
        h = _hash_strings(held, n - 1)
        order = np.argsort(h)
        contexts.append(h[order])
        backoff.append(np.array([[math.log(weights[n - 1].get(c, 1.0)) for _, weights in fitted] for c in held], dtype=np.float32).reshape(len(held), len(langs))[order])
    return Model(langs, keys, logp, contexts, backoff, unseen)


def _hash_strings(grams: list[str], n: int) -> np.ndarray:
    cp = np.array([ord(c) for g in grams for c in g], dtype=np.uint64)
    return gram_hash(cp, np.arange(len(grams)) * n + n - 1, n)


class Scorer:
    """Scores of texts through a cache of words, of one task."""

    def __init__(self, model: Model, cache: int):
        self.model, self.limit = model, cache
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.score = np.zeros((1 << 14, len(self.model.langs)), dtype=np.float32)
        self.chars = np.zeros(1 << 14, dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 1 << 15):
            part = words[i : i + (1 << 15)]
            n = len(self.known)
            while n + len(part) > len(self.chars):
                self.score, self.chars = np.concatenate([self.score, np.zeros_like(self.score)]), np.concatenate([self.chars, np.zeros_like(self.chars)])
            score, chars = self.model.words(part)
            letters = np.array([w.isalpha() or any(c.isalpha() for c in w) for w in part])
            self.score[n : n + len(part)] = score * letters[:, None]
            self.chars[n : n + len(part)] = chars * letters
            self.known.update(zip(part, range(n, n + len(part)), strict=True))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probabilities per text and language, and scored characters (0: no letter)."""
        words = [LETTERS.findall(t.lower()) for t in texts]
        flat = [w for ws in words for w in ws]
        at = list(map(self.known.get, flat))
        if None in at:
            new = list(dict.fromkeys(w for w, i in zip(flat, at, strict=True) if i is None))
            if len(self.known) + len(new) > self.limit:
                self.clear()
                new = list(dict.fromkeys(flat))
            self._learn(new)
            at = list(map(self.known.get, flat))
        index = np.array(at, dtype=np.int64)
        ends = np.cumsum([len(ws) for ws in words])
        total = np.concatenate([np.zeros((1, len(self.model.langs))), np.cumsum(self.score[index], axis=0, dtype=np.float64)])
        chars = np.concatenate([[0], np.cumsum(self.chars[index])])
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return total[ends] - total[begins], chars[ends] - chars[begins]


def decide(score: np.ndarray, chars: np.ndarray, model: Model, short: float = LangIdOptions.short) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language (-1: undetermined), confidence, and rejection of each text."""
    per_char = score / np.maximum(chars, 1)[:, None]
    best = per_char.argmax(axis=1)
    soft = model.softness * (score - score.max(axis=1, keepdims=True))
    confidence = 1 / np.exp(soft).sum(axis=1)
    limit = model.limit[best] if model.limit is not None else np.full(len(best), np.inf)
    rejected = (chars == 0) | (-per_char[np.arange(len(best)), best] > limit * (1 + short / np.sqrt(np.maximum(chars, 1))))
    best[chars == 0] = -1
    confidence[chars == 0] = 0
    return best, confidence, rejected


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grams: Counter = Counter()
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            for word, n in Counter(LETTERS.findall((text or "").lower())).items():
                padded = f"{PAD}{word} "
                for i in range(len(word) + 1):
                    grams[lang, padded[i : i + ORDER]] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in grams], pa.string()), pa.array([k[1] for k in grams], pa.string()), pa.array(list(grams.values()), pa.int64())], names=["lang", "gram", "n"])


def fit(docs: DataFrame, options: LangIdOptions | None = None) -> Model | None:
    """Fit on the labelled documents outside the held-out fold; None if there are none.

    What reaches the driver is bounded by ``sample`` documents per language: their n-gram
    counts, and the calibration texts. Rows of the same id and text are one document, so the
    fit is the same however often they repeat and wherever they lie."""
    o = options or LangIdOptions()
    keys = ["lang", "doc_id", "th"]
    labelled = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("th"))
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("th")]
    rank = lambda *by: F.row_number().over(W.partitionBy("lang", *by).orderBy(*order))
    # repeated rows are one; ranked by parts of a language first, so that no task reads a whole one
    chosen = labelled.select(*keys).distinct().withColumn("part", F.pmod(F.xxhash64("th", "doc_id"), F.lit(o.parts)))
    chosen = chosen.withColumn("rank", rank("part")).where(F.col("rank") <= o.sample).withColumn("rank", rank()).where(F.col("rank") <= o.sample)
    chosen = chosen.select(*keys, (F.col("rank") % 5 == 0).alias("calibrates"))
    sample = labelled.join(F.broadcast(chosen), keys).dropDuplicates(keys)  # at most sample rows a language
    grams = sample.where(~F.col("calibrates")).mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(grams):
        return None
    model = build(grams)
    held = sample.where("calibrates").select("lang", "text").toPandas()
    held = held[held["lang"].isin(model.langs)]
    score, chars = Scorer(model, o.cache).texts(held["text"].tolist())
    truth = np.array([model.langs.index(l) for l in held["lang"]], dtype=np.int64)
    use = chars > 0
    if use.any():
        score, chars, truth = score[use], chars[use], truth[use]
        rest = score - score.max(axis=1, keepdims=True)
        grid = 2.0 ** -np.arange(0, 12)
        loss = [(np.log(np.exp(t * rest).sum(axis=1)) - t * rest[np.arange(len(truth)), truth]).sum() for t in grid]
        model.softness = float(grid[int(np.argmin(loss))])
        entropy = -score[np.arange(len(truth)), truth] / chars
        model.limit = np.array([(1 + o.slack) * entropy[truth == l].max() if (truth == l).any() else np.inf for l in range(len(model.langs))])
    return model


def _batches(texts: list[str | None], chars: int = 1 << 20) -> Iterator[list[str]]:
    part: list[str] = []
    n = 0
    for t in texts:
        part.append(t or "")
        n += len(part[-1])
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def predict(docs: DataFrame, model: Model | None, options: LangIdOptions | None = None) -> DataFrame:
    """Language of every row of ``docs`` (doc_id, text; others are ignored).

    Returns doc_id, th (xxhash64 of the text), lang_pred, score (calibrated confidence, 0 to
    1) and rejected (no letter, or a cross-entropy beyond what the language's labelled texts
    reach). Null texts and texts without a letter are ``und``
    with score 0, as is everything when nothing was labelled. Ties go to the first language
    by code point. Equal texts get equal rows. An empty table gives no rows.
    """
    o = options or LangIdOptions()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, o.cache) if model is not None else None
        for b in batches:
            langs, conf, gone = [], [], []
            for texts in _batches(b.column("text").to_pylist()):
                if scorer is None:
                    langs += [UNDETERMINED] * len(texts)
                    conf += [0.0] * len(texts)
                    gone += [True] * len(texts)
                    continue
                best, confidence, rejected = decide(*scorer.texts(texts), model, o.short)
                langs += [model.langs[i] if i >= 0 else UNDETERMINED for i in best]
                conf += confidence.tolist()
                gone += rejected.tolist()
            cols = [b.column("doc_id"), b.column("th"), pa.array(langs, pa.string()), pa.array(conf, pa.float64()), pa.array(gone, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, lang_pred string, score double, rejected boolean")
