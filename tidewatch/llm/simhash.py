"""Near-duplicates by SimHash, found with BK-trees.

Equal fingerprints are merged first, so copies cost one row. Fingerprints within `radius` bits agree on at least one of radius + 1
blocks of bits; each (block, value) is a shard, and a fingerprint belongs to as many shards as there are blocks. A shard's
fingerprints form a BK-tree (children keyed by their Hamming distance to the parent) that is searched along edges within the
radius only. A shard of more than `shard_rows` fingerprints is cut into pieces, and every pair of pieces becomes one cell, so
that all pairs still meet while a task holds at most two pieces. A cell sends on one link per fingerprint (to the smallest
fingerprint it reaches inside the cell) and not all pairs; components join the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import components, settled

SEED, BITS, SLICE = 42, 64, 1 << 18


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text; 0 without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(parts))
    first, last = starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(first), SLICE):
        pieces = zip(first[at : at + SLICE], last[at : at + SLICE])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pieces], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(first), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, words: int = 3) -> Column:
    def each(parts):
        for texts in parts:
            yield pd.Series([fingerprint_of(t, words) for t in texts], dtype="int64")

    each.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(each, "long")(text)


class Forest:
    """BK-trees of many groups at once. `group` is ascending, the values of a group differ, the first of each is its root."""

    def __init__(self, group: np.ndarray, values: np.ndarray):
        self.values = values
        roots = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        self.root = roots[np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1]
        open_, at = np.setdiff1d(np.arange(len(values)), roots), self.root.copy()
        keys, nodes = [], []
        while len(open_):  # one level of all trees at a time
            edge = at[open_] * (BITS + 1) + np.bitwise_count(values[open_] ^ values[at[open_]])
            key, first, which = np.unique(edge, return_index=True, return_inverse=True)
            child = open_[first]
            keys.append(key)
            nodes.append(child)
            at[open_] = child[which]
            open_ = np.delete(open_, first)
        keys, nodes = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (keys, nodes))
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, level by level; each query looks through the tree of its own group."""
        query, node = queries, self.root[queries]
        while len(query):
            distance = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
            hit = (distance <= radius) & (query != node)
            yield query[hit], node[hit]
            base = node * (BITS + 1)
            low = np.searchsorted(self.keys, base + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.keys, base + np.minimum(distance + radius, BITS), side="right")
            n = high - low
            total = int(n.sum())
            where = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            query, node = np.repeat(query, n), self.nodes[where]


def _roots_within(group: np.ndarray, values: np.ndarray, radius: int, frontier: int = 1 << 21) -> np.ndarray:
    """For every value the smallest position it is connected to inside its group."""
    forest, label = Forest(group, values), np.arange(len(values))
    sizes = np.bincount(np.searchsorted(np.unique(group), group))[np.searchsorted(np.unique(group), group)]
    cuts = np.unique(np.cumsum(sizes) // frontier, return_index=True)[1].tolist() + [len(values)]
    for start, end in zip(cuts[:-1], cuts[1:]):
        for a, b in forest.search(np.arange(start, end), radius):
            while len(a):
                a, b = label[a], label[b]
                differ = a != b
                a, b = a[differ], b[differ]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label != label[label]).any():
                    label = label[label]
    return label


def _link_cells(radius: int):
    def link(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(rows: pd.DataFrame) -> pd.DataFrame:
            group = rows.groupby(["shard", "cell"], sort=False).ngroup().to_numpy()
            values = rows["fp"].to_numpy().view(np.uint64)
            label = _roots_within(group, values, radius)
            linked = label != np.arange(len(values))
            fp = rows["fp"].to_numpy()
            return pd.DataFrame({"a": fp[linked], "b": fp[label[linked]]})

        held = None
        for part in parts:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            if len(held) < 50_000:
                continue
            last = (held["shard"] == held["shard"].iat[-1]) & (held["cell"] == held["cell"].iat[-1])
            if not last.all():
                yield done(held[~last].reset_index(drop=True))
                held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield done(held)

    return link


def links_within(prints: DataFrame, radius: int = 3, shard_rows: int = 2048) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (distinct column `fp`) that chains of steps of `radius` bits connect."""
    blocks = radius + 1
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    shards = F.array(*[
        F.shiftrightunsigned(F.shiftleft("fp", BITS - high), BITS - high + low) * blocks + i
        for i, (low, high) in enumerate(zip(edges[:-1], edges[1:]))
    ])
    keyed = prints.select("fp", F.explode(shards).alias("shard"))
    sizes = keyed.groupBy("shard").count().where("count > 1")
    pieces = sizes.select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("pieces"))
    mine = F.pmod(F.xxhash64("fp"), F.col("pieces").cast("long"))
    met = keyed.join(pieces, "shard").select("fp", "shard", mine.alias("p"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("q"))
    cell = F.least("p", "q") * F.lit(1 << 31) + F.greatest("p", "q")
    cells = met.select("shard", cell.alias("cell"), "fp").repartition("shard", "cell").sortWithinPartitions("shard", "cell")
    return cells.mapInPandas(_link_cells(radius), "a long, b long")


def simhash(docs: DataFrame, words: int = 3, radius: int = 3, shard_rows: int = 2048) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`, repeated rows included.

    NULL and empty texts have fingerprint 0 and are linked like any other. component_id is the smallest doc_id reachable, NULL only
    if no row there has one. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    rows = settled(docs.select("doc_id", fingerprints(docs["text"], words).alias("fp")), "fingerprints")
    prints = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    groups = components(links_within(prints.select("fp"), radius, shard_rows))
    members = prints.join(groups, prints["fp"] == groups["node"]).select("fp", "least", "component")
    smallest = members.groupBy("component").agg(F.min("least").alias("smallest"))
    grouped = members.join(smallest, "component").select("fp", "smallest")
    named = prints.join(grouped, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_each(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its group, columns unchanged.

    Of rows equal in doc_id and text one stays. Rows without doc_id cannot be named as copies and stay.
    """
    groups = simhash(docs.where(docs["doc_id"].isNotNull()), words, radius)
    keep = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).unionByName(docs.where(docs["doc_id"].isNull()))
