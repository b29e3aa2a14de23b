"""Language identification with interpolated Kneser-Ney character models.

Per language, n-grams of characters up to `ORDER` are counted over a sample of labelled texts (words in lower case between single
spaces); lower orders count in how many different contexts an n-gram was seen. Models are kept as sorted arrays of 64-bit n-gram hashes, one
array per order shared by all languages, with a column of log-probabilities (and of back-off weights for contexts) per language, and are
looked up by binary search for all characters of a batch at once. A text goes to the language of the lowest cross-entropy per
character; `accepted` tells whether that entropy is one that texts of the language have (a calibrated quantile).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import fold

ORDER, DISCOUNT, UNKNOWN = 4, 0.75, "und"
ALPHABET = 10_000  # the lowest order backs off to an equal share for this many characters
LETTERS = re.compile(r"[^\W\d_]+")
MULTIPLY = 0x9E3779B97F4A7C15
POWERS = [np.uint64(pow(MULTIPLY, 2 * n + 1, 1 << 64)) for n in range(ORDER)]
RESULT = "lang_pred string, score double, cross_entropy double, accepted boolean"


def characters(text: str | None) -> np.ndarray:
    """Code points of the letter runs of a text, in lower case, with a space before, between and after; empty without letters."""
    words = LETTERS.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = f" {' '.join(words)} "
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _hashes(chars: np.ndarray) -> list[np.ndarray]:
    """Per order 1 to ORDER the hash of the n-gram that ends at each position (positions before a full one: shorter n-grams)."""
    value = (chars + np.uint64(1)) * POWERS[0]
    value ^= value >> np.uint64(29)
    out, reach = [value], value
    for n in range(1, ORDER):
        back = np.zeros_like(value)
        back[n:] = value[:-n]
        back *= POWERS[n]
        reach = reach + (back ^ (back >> np.uint64(31)))
        out.append(reach)
    return out


class Model:
    """Interpolated Kneser-Ney of several languages. `texts` are (language, text) rows."""

    def __init__(self, rows: list[tuple[str, str]], quantile: float = 0.995):
        whole: dict[str, list[np.ndarray]] = {}
        for lang, text in rows:
            if len(chars := characters(text)):
                whole.setdefault(lang, []).append(chars)
        self.languages = sorted(whole)
        self.grams, self.logs, self.contexts, self.weights = [], [], [], []
        if not self.languages:
            return
        fitted = {lang: [c for i, c in enumerate(cs) if i % 5] or cs for lang, cs in whole.items()}
        stores = [self._counts(fitted[lang]) for lang in self.languages]
        probabilities: list[dict] = []
        for n in range(ORDER):
            grams = np.unique(np.concatenate([s[n]["gram"] for s in stores]))
            table = np.zeros((len(grams), len(self.languages)))
            contexts = np.unique(np.concatenate([s[n]["context"] for s in stores]))
            weight = np.zeros((len(contexts), len(self.languages)))  # log of 1: an unseen context backs off for free
            for k, s in enumerate(stores):
                level = s[n]
                own, first = np.unique(level["gram"], return_index=True)
                context, group = np.unique(level["context"][first], return_inverse=True)
                count = level["count"][first].astype(float)
                total, kinds = np.bincount(group, count), np.bincount(group)
                spare = DISCOUNT * kinds / total
                weight[np.searchsorted(contexts, context), k] = np.log(spare)
                higher = np.maximum(count - DISCOUNT, 0) / total[group]
                at = np.searchsorted(grams, own)
                table[at, k] = higher
            # The lower order fills in: gram -> its own shorter gram (without the first character).
            shorter, parent = self._parents(stores, n, grams)
            lower = probabilities[-1]["p"][shorter] if n else np.full((len(grams), len(self.languages)), 1 / ALPHABET)
            place = np.searchsorted(contexts, parent)
            table = table + np.exp(weight[place]) * lower
            probabilities.append({"p": table})
            self.grams.append(grams)
            self.logs.append(np.log(np.maximum(table, 1e-12)).astype(np.float32))
            self.contexts.append(contexts)
            self.weights.append(weight.astype(np.float32))
        # Order 1 has one context; what is in no table backs off to a fixed share.
        self.unseen = (np.log(1 / ALPHABET) + self.weights[0].max(axis=0)).astype(np.float32)
        self.limits = []
        for k, lang in enumerate(self.languages):
            held = [c for i, c in enumerate(whole[lang]) if not i % 5 and len(c) >= 40] or [c for c in whole[lang] if len(c)]
            own = [self.entropies(c)[k] for c in held]
            self.limits.append(float(np.quantile(own, quantile)) * 1.05 if own else np.inf)

    @staticmethod
    def _counts(texts: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
        """Per order: distinct n-grams with their hash, the hash of their context and of their shorter gram, and their Kneser-Ney count."""
        chars = np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint64)
        start = np.concatenate([np.arange(len(t)) for t in texts]) if texts else np.zeros(0, dtype=np.int64)
        full = _hashes(chars)
        levels = []
        for n in range(ORDER):
            ok = start >= n
            gram = full[n][ok]
            context = np.r_[np.uint64(0), full[n - 1][:-1]][ok] if n else np.zeros(len(gram), dtype=np.uint64)
            shorter = full[n - 1][ok] if n else np.zeros(len(gram), dtype=np.uint64)
            if n == ORDER - 1:
                own, first, count = np.unique(gram, return_index=True, return_counts=True)
            else:  # in how many different contexts to the left
                longer = full[n + 1][start >= n + 1]
                _, one = np.unique(longer, return_index=True)
                left, seen = np.unique(full[n][start >= n + 1][one], return_counts=True)
                own, first = np.unique(gram, return_index=True)
                count = np.ones(len(own), dtype=np.int64)
                at = np.searchsorted(own, left)
                count[at] = np.maximum(seen, 1)
            levels.append({"gram": own, "context": context[first], "shorter": shorter[first], "count": count})
        return levels

    def _parents(self, stores: list, n: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shorter, context = np.zeros(len(grams), dtype=np.int64), np.zeros(len(grams), dtype=np.uint64)
        for s in stores:
            at = np.searchsorted(grams, s[n]["gram"])
            context[at] = s[n]["context"]
            if n:
                shorter[at] = np.searchsorted(self.grams[n - 1], s[n]["shorter"])
        return shorter, context

    def entropies(self, chars: np.ndarray) -> np.ndarray:
        """Cross-entropy per character under each language, in nats."""
        total = np.zeros(len(self.languages))
        size = 1 << 18
        for at in range(0, len(chars), size):  # whole texts, a bounded stretch at a time
            lead = min(at, ORDER)
            total += self._log(chars[at - lead : at + size], lead)
        return -total / max(1, len(chars))

    def _log(self, chars: np.ndarray, skip: int) -> np.ndarray:
        full = _hashes(chars)
        result = np.zeros(len(self.languages))
        todo = np.arange(skip, len(chars))
        for n in range(ORDER - 1, -1, -1):
            short = todo < n  # the start of a text has no longer context
            now = todo[~short] if short.any() else todo
            at = np.minimum(np.searchsorted(self.grams[n], full[n][now]), len(self.grams[n]) - 1)
            hit = self.grams[n][at] == full[n][now]
            result += self.logs[n][at[hit]].sum(axis=0, dtype=np.float64)
            missed = now[~hit]
            if n and len(missed):
                context = full[n - 1][missed - 1]
                at = np.minimum(np.searchsorted(self.contexts[n], context), len(self.contexts[n]) - 1)
                known = self.contexts[n][at] == context
                result += self.weights[n][at[known]].sum(axis=0, dtype=np.float64)
            elif len(missed):
                result += len(missed) * self.unseen.astype(np.float64)
            todo = np.concatenate([todo[short], missed]) if short.any() else missed
        return result

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        chars = characters(text)
        if not len(chars) or not self.languages:
            return UNKNOWN, 0.0, None, False
        entropy = self.entropies(chars)
        best = int(entropy.argmin())
        # Evidence grows with length, but neighbouring n-grams overlap: at most 50 characters count in full.
        odds = np.exp(-(entropy - entropy[best]) * min(len(chars), 50))
        return self.languages[best], float(1 / odds.sum()), float(entropy[best]), bool(entropy[best] <= self.limits[best])


def predictions(model: Model, text: Column) -> Column:
    def each(parts):
        for texts in parts:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "cross_entropy", "accepted"])

    each.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(each, RESULT)(text)


def training_rows(docs: DataFrame, per_language: int = 1500, longest: int = 20_000, languages: int = 200) -> list[tuple[str, str]]:
    """The bounded sample models are fitted on: at most `per_language` texts of 1 to `longest` characters of each of at most `languages`
    languages (the ones with most texts), by hash order of doc_id, of documents with crc32(doc_id) mod 3 other than 1 and a language.

    Two passes whatever the number of languages: one counts, one draws.
    """
    learn = docs.select("doc_id", "text", "lang").where((fold("doc_id", 3) != 1) & F.col("lang").isNotNull() & F.length("text").between(1, longest))
    counts = learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counts:
        return []
    # About the sample's size by hash first, so that sorting stays small; the order makes it exact.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    bound = {lang: int(min(1.0, 2.0 * per_language / n + 200 / n) * (1 << 20)) for lang, n in counts}
    least = F.create_map(*[F.lit(x) for pair in bound.items() for x in pair])[F.col("lang")]
    order = Window.partitionBy("lang").orderBy(place, "doc_id", "text")
    drawn = learn.where(place < least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    rows = [(r["lang"], r["text"]) for r in drawn.orderBy("lang", "rank").select("lang", "text").collect()]
    most = {lang: -k for k, (lang, _) in enumerate(counts)}
    return sorted(rows, key=lambda r: -most[r[0]])


def language_id(docs: DataFrame, per_language: int = 1500) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, accepted) for every row of `docs`, repeated rows included.

    held_out: crc32 of doc_id as text mod 3 is 1 (false for a NULL id). NULL texts and texts without a letter are `und` with score 0;
    so is everything if there is nothing to learn from. Ties go to the language that is first by name. An empty table gives no
    rows. Prediction reads the text alone.
    """
    model = Model(training_rows(docs, per_language))
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return rows.select("doc_id", "held_out", predictions(model, rows["text"]).alias("p")).select("doc_id", "held_out", "p.*")
