"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic), after values without a target of their own have been put together as
`*`; the table of cells is therefore bounded by the targets, not by the data. Raking scales the cells' token weights until
their sums along each dimension meet its target shares, with no cell above the tokens it has. A document is kept with the probability by
which its cell was scaled, so the expected tokens of the sample meet every margin, and by a hash of doc_id instead of a draw, so that
a rerun keeps the same rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fresh

OTHER = "*"


def n_tokens(text: Column) -> Column:
    """Number of words between white space; 0 for NULL and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def word_length_topic(text: Column, tokens: Column) -> Column:
    """Stand-in where a table has no topic: short, middle or long words on average."""
    mean = F.length(text) / F.when(tokens > 0, tokens)
    return F.when(mean < 6.0, "short").when(mean < 8.0, "middle").when(mean >= 8.0, "long")


def bucket(value: Column, targets: dict[str, float]) -> Column:
    """The value if it has a target, else OTHER (NULL too)."""
    return F.when(value.isin([k for k in targets if k != OTHER]), value).otherwise(F.lit(OTHER))


def _margin(cells: np.ndarray, axis: int) -> np.ndarray:
    return cells.sum(axis=tuple(a for a in range(cells.ndim) if a != axis))


def shares_of(cells: np.ndarray, shares: list[np.ndarray]) -> list[np.ndarray]:
    """Target shares of each dimension that sum to 1; those of values without tokens go to the others in proportion."""
    out = []
    for axis, share in enumerate(shares):
        there = _margin(cells, axis) > 0
        share = np.where(there, share, 0.0)
        if share.sum() <= 0:
            share = there.astype(float)
        out.append(share / max(share.sum(), 1e-300))
    return out


def rake(cells: np.ndarray, wanted: list[np.ndarray], rounds: int = 500, within: float = 1e-10) -> np.ndarray:
    """Weights of the cells whose margins are the wanted sums; cells without tokens stay zero.

    Where no weights meet all margins at once, the result is where the last of `rounds` rounds ends: the last dimension is met, the others as
    nearly as raking comes.
    """
    weights = cells.astype(float)
    for _ in range(rounds):
        worst = 0.0
        for axis, want in enumerate(wanted):
            has = _margin(weights, axis)
            factor = np.divide(want, has, out=np.zeros_like(has), where=has > 0)
            worst = max(worst, float(np.abs(factor[(has > 0) & (want > 0)] - 1).max(initial=0.0)))
            weights = weights * factor.reshape([-1 if a == axis else 1 for a in range(weights.ndim)])
        if worst < within:
            break
    return weights


def _missed(weights: np.ndarray, wanted: list[np.ndarray]) -> float:
    """The largest difference of a margin from its target, as a share of all."""
    total = max(float(wanted[0].sum()), 1e-300)
    return max(float(np.abs(_margin(weights, axis) - want).max(initial=0.0)) for axis, want in enumerate(wanted)) / total


def rake_within(cells: np.ndarray, shares: list[np.ndarray], kept: float) -> np.ndarray | None:
    """Weights with `kept` tokens in all, margins in the given shares and no cell above its own tokens; None if there are none.

    A cell that raking puts above its tokens is taken whole, and the others are raked again to what is left of the margins.
    """
    whole = np.zeros(cells.shape, bool)
    wanted = [share * kept for share in shares]
    for _ in range(cells.size + 1):
        fixed = np.where(whole, cells, 0.0)
        rest = [want - _margin(fixed, axis) for axis, want in enumerate(wanted)]
        if min(float(r.min(initial=0.0)) for r in rest) < -1e-9 * kept:
            return None
        weights = fixed + rake(np.where(whole, 0.0, cells), [np.maximum(r, 0.0) for r in rest])
        above = (weights > cells * (1 + 1e-9)) & ~whole
        if not above.any():
            return np.minimum(weights, cells) if _missed(weights, wanted) < 1e-6 else None
        whole |= above
    return None


def rates(cells: np.ndarray, shares: list[np.ndarray], keep: float) -> tuple[np.ndarray, np.ndarray]:
    """(weight of a token, probability of keeping a document) of each cell.

    Expected kept tokens meet all margins, and no probability is above 1. They are `keep` of all tokens, or the largest part below
    that at which this is possible. If raking meets the margins at no size (targets that contradict one another), probabilities are in
    proportion to what raking ends with, cut nowhere.
    """
    total = float(cells.sum())
    if total <= 0:
        return np.zeros(cells.shape), np.zeros(cells.shape)
    shares = shares_of(cells, shares)
    weights = rake_within(cells, shares, keep * total)
    if weights is None:
        low, high = 0.0, keep * total
        for _ in range(40):
            middle = (low + high) / 2
            found = rake_within(cells, shares, middle)
            if found is None:
                high = middle
            else:
                low, weights = middle, found
    if weights is None:
        raked = rake(cells, [share * total for share in shares])
        factor = np.divide(raked, cells, out=np.zeros_like(raked), where=cells > 0)
        weights = cells * factor * min(keep, 1 / factor.max())
    probability = np.divide(weights, cells, out=np.zeros_like(weights), where=cells > 0)
    return probability * (total / weights.sum()), probability


def mix(
    docs: DataFrame, targets: dict[str, dict[str, float]], tokens: str, dimensions: dict[str, str], keep: float,
    columns: list[str], seed: int = 11,
) -> DataFrame:
    """`columns` of every row of `docs` with n_tokens, weight, probability and selected.

    `dimensions` names the column of each target; `tokens` the column of token counts. weight: the raked weight of a token of the row's cell
    (its mean over all tokens is 1). selected: a hash of doc_id below probability. Rows of a cell without tokens (empty texts) have weight 0 and are
    not selected. NULL dimensions count as `*`, NULL doc_id hashes like one value, repeated rows share one
    fate. An empty table gives no rows.
    """
    names = list(targets)
    keys = {n: [k for k in sorted(targets[n]) if k != OTHER] + [OTHER] for n in names}
    if math.prod(len(k) for k in keys.values()) > 1_000_000:
        raise ValueError("targets span more than a million cells")
    cell = [bucket(docs[dimensions[n]].cast("string"), targets[n]) for n in names]
    sums = docs.groupBy(*[c.alias(n) for c, n in zip(cell, names)]).agg(F.sum(tokens).alias("tokens")).collect()
    cells = np.zeros([len(keys[n]) for n in names])
    for row in sums:
        cells[tuple(keys[n].index(row[n]) for n in names)] = row["tokens"] or 0
    shares = [np.array([float(targets[n].get(k, 0.0)) for k in keys[n]]) for n in names]
    factor, probability = rates(cells, shares, keep)
    # The bounded table of cells becomes a literal: no join, no shuffle of documents.
    place = F.lit(0)
    for n, c in zip(names, cell):
        index = F.create_map(*[x for i, k in enumerate(keys[n]) for x in (F.lit(k), F.lit(i))])
        place = place * len(keys[n]) + index[c]
    at = lambda values: F.array(*[F.lit(float(v)) for v in values.ravel()])[place]
    draw = F.pmod(F.xxhash64(F.lit(seed), docs["doc_id"]), F.lit(1 << 30)) / float(1 << 30)
    return docs.select(
        *columns, docs[tokens].alias("n_tokens"), at(factor).alias("weight"), at(probability).alias("probability"),
        (draw < at(probability)).alias("selected"),
    )


#: Production targets over `documents`: the hot source is held to a tenth, languages are evened out, long words favoured.
TARGETS = {
    "source": {"src0": 0.1, OTHER: 0.9},
    "lang": {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.12, OTHER: 0.02},
    "topic": {"short": 0.4, "middle": 0.4, "long": 0.18, OTHER: 0.02},
}
KEEP = 0.8


def prepared(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """`docs` with its token counts and topics, under names not in use."""
    tokens, topic = fresh("n_tokens", docs.columns), fresh("topic", docs.columns)
    counted = docs.withColumn(tokens, n_tokens(docs["text"]))
    return counted.withColumn(topic, word_length_topic(F.col("text"), F.col(tokens))), tokens, topic


def mixed_documents(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, keep: float = KEEP) -> DataFrame:
    """(doc_id, n_tokens, weight, probability, selected) of every document."""
    rows, tokens, topic = prepared(docs.select("doc_id", "text", "source", "lang"))
    return mix(rows, targets, tokens, {"source": "source", "lang": "lang", "topic": topic}, keep, ["doc_id"])


def sample_documents(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, keep: float = KEEP) -> DataFrame:
    """The columns of the selected documents, with n_tokens, weight and probability under names not in use."""
    rows, tokens, topic = prepared(docs)
    taken = [*docs.columns, tokens, topic]
    given = {n: fresh(n, docs.columns) for n in ("n_tokens", "weight", "probability", "selected")}
    plain = {c: f"c{i}" for i, c in enumerate(taken)}
    bare = rows.toDF(*[plain[c] for c in taken]).withColumn("doc_id", F.col(plain["doc_id"]))
    dims = {"source": plain["source"], "lang": plain["lang"], "topic": plain[topic]}
    out = mix(bare, targets, plain[tokens], dims, keep, [plain[c] for c in docs.columns]).where("selected").drop("selected")
    return out.toDF(*docs.columns, given["n_tokens"], given["weight"], given["probability"])
