"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

The n-grams of the benchmark are counted in the whole corpus. An item's seeds are its n * e + s rarest n-grams, e being the edits a copy may
have and s the seeds asked for: e edits break at most n * e n-grams, so that a copy with no more edits keeps at least s seeds, whichever
they are. (N-grams that occur nowhere are the rarest: no copy holds them, so they are among the broken ones.) Of an item too short for that, all
n-grams are seeds and one is enough. Seeds that lie near one diagonal give a region of the document; the item is aligned with it word by word (match 2,
mismatch and gap -1), and the score is the share of what a whole verbatim copy would get.

Documents never move: the benchmark goes to them, in blocks of at most `block_words` words, however large it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fresh

WORD = re.compile(r"\w+")
N, MATCH, OTHER = 3, 2, -1
FOUND = "array<struct<item_id: long, score: double, first_word: int, last_word: int, seeds: int>>"


def _words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _codes(ids: np.ndarray, base: int) -> np.ndarray:
    """One number per n-gram of word ids; -1 where a word is unknown."""
    if len(ids) < N:
        return np.zeros(0, dtype=np.int64)
    parts = [ids[i : len(ids) - N + 1 + i] for i in range(N)]
    code = parts[0]
    for p in parts[1:]:
        code = code * base + p
    return np.where(np.minimum.reduce(parts) < 0, -1, code)


class Items:
    """A block of benchmark items as word ids, with the codes of all their n-grams."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        split = [_words(t) for _, t in rows]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for s in split for w in s}))}
        self.base = len(self.vocabulary) + 1
        self.words = [np.array([self.vocabulary[w] for w in s], dtype=np.int64) for s in split]
        self.codes = np.unique(np.concatenate([_codes(w, self.base) for w in self.words] or [np.zeros(0, dtype=np.int64)]))

    def of(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in _words(text)], dtype=np.int64)

    def places(self, ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a document's n-grams among `codes` (ascending), and which they are."""
        own = _codes(ids, self.base)
        at = np.flatnonzero(own >= 0)
        k = np.searchsorted(codes, own[at])
        same = k < len(codes)
        same[same] = codes[k[same]] == own[at][same]
        return at[same], k[same]


def _count(items: Items):
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(items.codes), dtype=np.int64)
        for part in parts:
            for text in part["text"]:
                _, k = items.places(items.of(text), items.codes)
                np.add.at(total, k, 1)
        yield pd.DataFrame({"code": items.codes[total > 0], "n": total[total > 0]})

    return count


class Seeds:
    """The rarest n-grams of each item: (item, position) by code; `least` has how many of them an item must show."""

    def __init__(self, items: Items, counts: dict[int, int], edits: float, least_seeds: int):
        rows = []
        self.least = np.ones(len(items.words), dtype=np.int64)
        for k, words in enumerate(items.words):
            codes = _codes(words, items.base)
            n = np.array([counts.get(int(c), 0) for c in codes])
            broken = N * int(np.ceil(edits * len(words)))
            self.least[k] = max(1, min(least_seeds, len(codes) - broken))
            wanted = broken + least_seeds
            rows += [(int(codes[i]), k, int(i)) for i in np.argsort(n, kind="stable")[:wanted]]
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 3)
        self.codes, self.starts = np.unique(table[:, 0], return_index=True)
        self.ends = np.append(self.starts[1:], len(table))
        self.item, self.position = table[:, 1], table[:, 2]

    def expand(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, diagonal) of every seed found at document positions `at`."""
        n = self.ends[k] - self.starts[k]
        rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[k], n)
        return self.item[rows], np.repeat(at, n) - self.position[rows]


def align(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of one item with many regions of equal width: best scores and where they end. Negative ids match nothing."""
    wide = np.arange(regions.shape[1] + 1) * -OTHER
    above = np.zeros((len(regions), regions.shape[1] + 1), dtype=np.int32)
    best, end = np.zeros(len(regions), dtype=np.int32), np.zeros(len(regions), dtype=np.int64)
    for word in item:
        row = np.zeros_like(above)
        row[:, 1:] = above[:, :-1] + np.where(regions == word, MATCH, OTHER)
        np.maximum(row, above + OTHER, out=row)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + wide, axis=1) - wide  # gaps along the region
        top = row.argmax(axis=1)
        value = row[np.arange(len(row)), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
        above = row.astype(np.int32)
    return best, end


def _regions(seeds: Seeds, items: Items, ids: np.ndarray, edits: float) -> list[tuple[int, int, int, int]]:
    """(item, start, end, seeds) of the stretches of a document with enough seeds of an item near one diagonal."""
    item, diagonal = seeds.expand(*items.places(ids, seeds.codes))
    if not len(item):
        return []
    order = np.lexsort((diagonal, item))
    item, diagonal = item[order], diagonal[order]
    lengths = np.array([len(w) for w in items.words])[item]
    slack = np.ceil(edits * lengths).astype(np.int64) + N
    new = np.r_[True, (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(item))
    found = []
    for s, e in zip(starts, ends):
        if e - s < seeds.least[item[s]]:
            continue
        long, room = int(lengths[s]), int(slack[s])
        first, last = int(max(0, diagonal[s] - room)), int(min(len(ids), diagonal[e - 1] + long + room))
        step = 4 * (long + room)  # a long stretch is cut into overlapping ones; each alignment fits into one of them
        cuts = range(first, max(first + 1, last - 2 * (long + room)), step - 2 * (long + room))
        found += [(int(item[s]), c, min(last, c + step), int(e - s)) for c in cuts]
    return found


def _search(items: Items, seeds: Seeds, edits: float, least_score: float, least_words: int):
    def texts_of(texts: pd.Series) -> list[list[dict]]:
        pending: dict[tuple[int, int], list] = {}
        documents = []
        for k, text in enumerate(texts):
            ids = items.of(text)
            regions = _regions(seeds, items, ids, edits)
            documents.append(ids if regions else None)
            for item, start, end, n in regions:
                pending.setdefault((item, -(-(end - start) // 32)), []).append((k, start, end, n))
        best: dict[tuple[int, int], tuple] = {}
        for (item, width), places in pending.items():
            words = items.words[item]
            least = least_score if len(words) >= least_words else 1.0
            for at in range(0, len(places), 512):
                some = places[at : at + 512]
                region = np.full((len(some), width * 32), -2, dtype=np.int64)
                for r, (k, start, end, _) in enumerate(some):
                    region[r, : end - start] = documents[k][start:end]
                top, last = align(words, region)
                share = top / (MATCH * len(words))
                for r in np.flatnonzero(share >= least):
                    k, start, _, n = some[r]
                    back = region[r : r + 1, : last[r]][:, ::-1]
                    begin = int(last[r] - align(words[::-1], back)[1][0])
                    row = (float(share[r]), -(start + begin), start + int(last[r]) - 1, n)
                    best[k, item] = max(best.get((k, item), (0.0,)), row)
        out: list[list[dict]] = [[] for _ in documents]
        for (k, item), (share, first, last, n) in sorted(best.items()):
            out[k].append({"item_id": items.ids[item], "score": share, "first_word": -first, "last_word": last, "seeds": n})
        return out

    def search(parts):
        for texts in parts:
            yield pd.Series([x for at in range(0, len(texts), 1000) for x in texts_of(texts.iloc[at : at + 1000])], dtype=object)

    search.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(search, FOUND)


def searches(
    docs: DataFrame, benchmark: DataFrame, edits: float = 0.25, least_score: float = 0.5, least_seeds: int = 2,
    least_words: int = 8, block_words: int = 1_000_000,
) -> list[Column]:
    """One column per block of benchmark items: the items found in `docs.text`, as an array of FOUND.

    Of an item of fewer than `least_words` words only a whole verbatim copy tells a leak; one of fewer words than an n-gram has is in many
    texts by chance and is not looked for. Items without id are not either.
    """
    size = F.size(F.split(F.col("text"), r"\s+"))
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    total = rows.agg(F.sum(size)).first()[0] or 0
    blocks = -(-total // block_words)
    found = []
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct().orderBy("item_id", "text").collect()
        items = Items([(r[0], r[1]) for r in own if len(_words(r[1])) >= N])
        if not items.ids:
            continue
        counts = docs.select("text").mapInPandas(_count(items), "code long, n long").groupBy("code").agg(F.sum("n"))
        seeds = Seeds(items, dict(tuple(r) for r in counts.collect()), edits, least_seeds)
        found.append(_search(items, seeds, edits, least_score, least_words)(docs["text"]))
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word, seeds): each benchmark item each row of `docs` holds, at its best place.

    Words are counted from 0. NULL and empty texts hold nothing; an empty benchmark or corpus gives no rows; repeated rows of
    `docs` give repeated rows. Items sharing an id are looked for one by one. Other columns are not read.
    """
    rows = docs.select("doc_id", "text")
    parts = [
        rows.select("doc_id", F.explode(column).alias("f")).select("doc_id", "f.*")
        for column in searches(rows, benchmark, **options)
    ]
    empty = docs.sparkSession.createDataFrame([], "doc_id long, " + FOUND.removeprefix("array<struct<").removesuffix(">>").replace(":", ""))
    result = parts[0] if parts else empty
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` in which no benchmark item is found, columns unchanged."""
    kept = docs
    for column in searches(docs, benchmark, **options):
        name = fresh("leaks", docs.columns)
        kept = kept.withColumn(name, column).where(F.size(name) == 0).drop(name)
    return kept
