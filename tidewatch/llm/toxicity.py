"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window of text is compressed with both; text of a
kind is shorter under the dictionary of its kind. The pair of lengths is turned into a calibrated log-odds, and a document
is scored by what its windows hold.

A window is one word, spelt as its overlapping 4-grams (`^idi idio diot iot$`). Plain words are too short for zstandard:
below about ten bytes of saving it stores a block raw, so that the lengths say nothing. Spelt this way, a shared stem is a match
of twenty bytes and more, and a difference of one letter costs several.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fold, fresh

WORD = re.compile(r"[^\W\d_]+")
SPELL, LONGEST, STEM, LEVEL = 4, 64, 5, 3


def _words(text: str | None) -> list[str]:
    """Letter runs in lower case; runs over LONGEST letters are cut into pieces, none is left out."""
    found = WORD.findall(text.lower()) if text else []
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def _spelt(word: str) -> bytes:
    word = f"^{word}$"
    return "".join([word[i : i + SPELL] for i in range(max(1, len(word) - SPELL + 1))]).encode()


def _stems(words) -> set[str]:
    return {f"^{w}$"[i : i + STEM] for w in words for i in range(max(1, len(w) + 3 - STEM))}


def _dictionary(words: list[str], size: int) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    samples = [b"".join(map(_spelt, words[i : i + 4])) for i in range(0, len(words), 4)]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Lengths:
    """Compressed lengths of words under both dictionaries. Remembers words, up to a bound, then starts anew."""

    def __init__(self, toxic: bytes, ordinary: bytes, remember: int = 300_000):
        def compressor(content: bytes):
            options = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), **options)

        self.toxic, self.ordinary, self.known, self.remember = compressor(toxic), compressor(ordinary), {}, remember

    def __call__(self, word: str) -> tuple[int, int, int]:
        key = self.known.get(word)
        if key is None:
            if len(self.known) >= self.remember:
                self.known.clear()
            spelt = _spelt(word)
            key = (min(len(spelt), 60), len(self.ordinary.compress(spelt)), len(self.toxic.compress(spelt)))
            self.known[word] = key
        return key


def _features(words: list[str], lengths: Lengths, odds: dict) -> list[float]:
    """What the log-odds of a document's windows come to: the largest, the largest three, and how many pass each threshold."""
    found = sorted((odds.get(lengths(w), 0.0) for w in set(words)), reverse=True) or [0.0]
    high = [v for v in found if v > 1.0]
    passed = [math.log1p(sum(v > least for v in high)) for least in (1, 3, 5, 7)]
    return [found[0] / 4, sum(found[:3]) / 10, math.log1p(sum(v for v in high if v > 2)), *passed, math.log1p(len(found))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str, int]], toxic_bytes: int = 4096, ordinary_bytes: int = 8192) -> dict:
    """The model from (text, label) rows: dictionaries, log-odds of window lengths, weights of the document score.

    Two of three rows train dictionaries and odds, the third calibrates the score. Labels are of whole documents, and most of a toxic
    document is ordinary; its toxic words are those with stems far commoner in toxic than in ordinary documents.
    Without rows of both labels the score is the share of toxic rows (0 without rows).
    """
    share = sum(y for _, y in rows) / len(rows) if rows else 0.0
    learn = [(_words(t), y) for i, (t, y) in enumerate(rows) if i % 3 != 2]
    check = [(_words(t), y) for i, (t, y) in enumerate(rows) if i % 3 == 2] or learn
    toxic, ordinary = [w for w, y in learn if y], [w for w, y in learn if not y]
    in_toxic, in_ordinary = Counter(), Counter()
    for words in toxic:
        in_toxic.update(_stems(set(words)))
    for words in ordinary:
        in_ordinary.update(_stems(set(words)))
    least = max(3, len(toxic) // 150)
    base = math.log((len(toxic) + 1) / (len(ordinary) + 1))
    common = max(least, len(toxic) // 50)
    telling = {
        s for s, n in in_toxic.items()
        if n >= least and math.log((n + 0.5) / (in_ordinary[s] + 0.5)) - base > (1.5 if n >= common else 2.5)
    }
    marked = [w for words in toxic for w in words if not telling.isdisjoint(_stems((w,)))]
    if not marked or not ordinary:
        return {"share": share}
    random = np.random.default_rng(7)
    usual = [w for words in ordinary for w in words]
    usual = [usual[i] for i in random.permutation(len(usual))[:200_000]]
    model = {
        "toxic": _dictionary([marked[i] for i in random.permutation(len(marked))], toxic_bytes),
        "ordinary": _dictionary(usual, ordinary_bytes),
    }
    lengths = Lengths(model["toxic"], model["ordinary"])
    yes = Counter(lengths(w) for w in marked)
    no = Counter(lengths(w) for words in ordinary for w in words)
    n_yes, n_no = sum(yes.values()) + 1, sum(no.values()) + 1
    model["odds"] = {k: math.log((yes[k] + 0.05) / n_yes / ((no[k] + 0.5) / n_no)) for k in yes.keys() | no.keys()}
    x = np.array([_features(w, lengths, model["odds"]) for w, _ in check])
    model["weights"] = _logistic(x, np.array([float(y) for _, y in check]))
    return model


def scorer(model: dict):
    """Column function text -> score between 0 and 1."""

    def scores(parts):
        weights = model.get("weights")
        lengths = None if weights is None else Lengths(model["toxic"], model["ordinary"])
        for texts in parts:
            if weights is None:
                yield pd.Series([float(model["share"])] * len(texts), dtype="float64")
                continue
            x = np.array([_features(_words(t), lengths, model["odds"]) for t in texts]).reshape(-1, len(weights) - 1)
            z = np.clip(x @ weights[:-1] + weights[-1], -30, 30)
            yield pd.Series(1 / (1 + np.exp(-z)), dtype="float64")

    scores.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scores, "double")


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = 3000, longest: int = 20_000) -> DataFrame:
    """(text, toxic, place, doc_id): the bounded sample a model is fitted on, at most `per_label` labelled documents of either label, by hash
    order of doc_id, of those with 1 to `longest` characters and crc32(doc_id) mod 5 other than 0.

    The bound holds for this sample alone; scoring covers all documents and whole texts. A document labelled both ways counts once for either.
    """
    marks = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & (fold("doc_id", 5) != 0)).distinct()
    order = F.xxhash64("doc_id")
    fit_for = docs.select("doc_id", "text").where(F.length("text").between(1, longest))
    # Drawn from labels first: some have no document of fitting length, hence the margin.
    drawn = [marks.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(per_label * 5 // 4) for y in (0, 1)]
    chosen = fit_for.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    chosen = chosen.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("place", order)
    parts = [chosen.where(F.col("toxic") == y).orderBy("place", "doc_id").limit(per_label) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).select("text", "toxic", "place", "doc_id")


def trained(docs: DataFrame, labels: DataFrame, per_label: int = 3000) -> dict:
    """The model, fitted in one task on the bounded sample; only the model itself, a few 10 kB, comes to the driver."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"text": [], "toxic": [], "place": [], "doc_id": []}), *parts])
        rows = rows.sort_values(["toxic", "place", "doc_id"], kind="stable")
        model = fit(list(zip(rows["text"].tolist(), rows["toxic"].astype(int).tolist())))
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    found = training_rows(docs, labels, per_label).repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])


def score(docs: DataFrame, model: dict, text: str = "text") -> Column:
    """Score of each whole text. NULL and empty texts have no windows and get the score of that."""
    return scorer(model)(docs[text])


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 3000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`, repeated rows included.

    held_out: crc32 of doc_id as text mod 5 is 0 (false for a NULL id); such rows never train. Empty tables give no rows; without labels
    all scores are 0. Other columns of `docs` are not read.
    """
    model = trained(docs, labels, per_label)
    rows = docs.select("doc_id", "text")
    scored = rows.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), score(rows, model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, per_label: int = 3000, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` scored below `threshold`, with their columns unchanged."""
    model = trained(docs, labels, per_label)
    name = fresh("score", docs.columns)
    return docs.withColumn(name, score(docs, model)).where(F.col(name) < threshold).drop(name)
