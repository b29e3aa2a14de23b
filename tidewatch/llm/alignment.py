"""Alignment of two tokenizers over the same texts by pointer jumping.

The tokens of both tokenizers cover the same bytes. Every token points to the token of the other side that overlaps it and reaches
farthest to the right, or to itself where none reaches beyond it; successors are doubled (`successor[successor]`) for all tokens of a batch at
once until nothing moves. Each token then points to the token its group ends with, where both tokenizers end together.

How often two ids end together in the whole corpus is summed in Spark. The most frequent pairs, at most `HEAD` of them, go to every task; links of
rarer pairs meet their counts in an equality join, in which no pair is frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.bpe import chunks, gathered, lists, model_of, read_bytes
from tidewatch.llm.common import fresh, settled

HEAD = 1 << 18
RESULT = "n_a int, n_b int, groups string, link_a array<int>, link_b array<int>"


class Pieces:
    """A sentencepiece model from its bytes, with the bytes each id stands for."""

    def __init__(self, data: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        ids = range(self.model.vocab_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens in a row."""
        return gathered(self.flat, self.begins[ids], self.lengths[ids])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_pieces: dict[bytes, Pieces] = {}


def pieces_of(data: bytes) -> Pieces:
    """The model of a file, built once in a process."""
    if data not in _pieces:
        _pieces.clear()
        _pieces[data] = Pieces(data)
    return _pieces[data]


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending end offsets of tokens over the same bytes -> for every token of either side the token of b its group ends with."""
    n = len(ends_a)
    starts_a, starts_b = np.concatenate([[0], ends_a[:-1]]), np.concatenate([[0], ends_b[:-1]])
    # The last token of the other side that starts before this one ends; starts are counted by byte, which is cheaper than a search for each end.
    size = int(max(ends_a[-1], ends_b[-1])) + 2
    to_b = np.bincount(starts_b + 1, minlength=size).cumsum()[ends_a] - 1
    to_a = np.bincount(starts_a + 1, minlength=size).cumsum()[ends_b] - 1
    own = np.arange(n, n + len(ends_b))
    successor = np.concatenate([n + to_b, np.where(ends_a[to_a] > ends_b, to_a, own)])
    while True:
        doubled = successor[successor]
        if np.array_equal(doubled, successor):
            return successor[:n] - n, successor[n:] - n
        successor = doubled


def alignment_of(text: str, a: np.ndarray, b: np.ndarray, bpe, pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(last of a, last of b, marked): positions of the tokens that end each group, and all ids in the order of the groups, those of a
    group's side a first, as id * 4 + what follows (0 `,`, 1 `|`, 2 `;`, 3 nothing). None where a tokenizer changed the text."""
    whole = b" " + text.encode()
    if not text or bpe.joined(a).tobytes() != whole or pieces.joined(b).tobytes() != whole:
        return None
    of_a, of_b = terminals(np.cumsum(bpe.lengths[a]), np.cumsum(pieces.lengths[b]))
    last_a = np.append(np.flatnonzero(of_a[1:] != of_a[:-1]), len(a) - 1)
    last_b = np.append(np.flatnonzero(of_b[1:] != of_b[:-1]), len(b) - 1)
    # Ahead of a token stand the tokens of its own side before it, and those of the other side in earlier groups (b: in its own one too).
    ahead_a = np.repeat(np.append(0, last_b[:-1] + 1), np.diff(last_a, prepend=-1))
    ahead_b = np.repeat(last_a + 1, np.diff(last_b, prepend=-1))
    marked = np.empty(len(a) + len(b), np.int64)
    marks = np.zeros(len(a), np.int64)
    marks[last_a] = 1
    marked[np.arange(len(a)) + ahead_a] = a * 4 + marks
    marks = np.zeros(len(b), np.int64)
    marks[last_b] = 2
    marked[np.arange(len(b)) + ahead_b] = b * 4 + marks
    marked[-1] += 1
    return last_a, last_b, marked


_written: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def written_ids(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begins, lengths) of all ids below `size` as written in groups, at id * 4 + what follows; built once in a process."""
    if size not in _written:
        names = [f"{i}{mark}" for i in range(size) for mark in (",", "|", ";", "")]
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        _written[size] = (np.frombuffer("".join(names).encode(), np.uint8), np.cumsum(lengths) - lengths, lengths)
    return _written[size]


def alignment_rows(vocabulary: bytes, model: bytes, digest: bool):
    """Function from arrays of texts to arrays of RESULT."""

    def rows(parts):
        bpe, pieces = model_of(vocabulary), pieces_of(model)
        flat, begins, lengths = written_ids(max(len(bpe.bytes_of), len(pieces.bytes_of)))
        none = np.zeros(0, np.int32)
        for texts in parts:
            for some in chunks(texts):
                counts, groups, link_a, link_b = [], [], [], []
                for text, a, b in zip(some, bpe.encode([" " + t for t in some], specials=False), pieces.encode(some)):
                    a, b = a.astype(np.int64), np.array(b, np.int64)
                    found = alignment_of(text, a, b, bpe, pieces)
                    if found is None:
                        counts.append((0, 0))
                        groups.append("")
                        link_a.append(none)
                        link_b.append(none)
                        continue
                    last_a, last_b, marked = found
                    counts.append((len(a), len(b)))
                    written = gathered(flat, begins[marked], lengths[marked]).tobytes()
                    groups.append(hashlib.sha256(written).hexdigest() if digest else written.decode())
                    link_a.append(a[last_a].astype(np.int32))
                    link_b.append(b[last_b].astype(np.int32))
                n = np.array(counts, np.int32).reshape(-1, 2)
                columns = [pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(groups, pa.string()), lists(link_a), lists(link_b)]
                yield pa.StructArray.from_arrays(columns, ["n_a", "n_b", "groups", "link_a", "link_b"])

    rows.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return rows


def alignments(docs: DataFrame, vocabulary: str, model: str, text: str = "text", digest: bool = False) -> DataFrame:
    """`docs` with the alignment of a byte-level BPE (a: file `vocabulary`) and a sentencepiece model (b: file `model`) over each text.

    n_a, n_b: numbers of tokens; groups: ids by group as `a1,a2|b1;a3|b2,b3`, or with `digest` the SHA-256 of that; link_a, link_b: the ids that end together, in order, one pair per
    group. Strings of special tokens are plain text. NULL and empty texts, and texts that either tokenizer does not keep byte by
    byte, have no tokens, groups or links. Repeated rows each have their result; an empty table gives no rows. A column of `docs` with the name of a
    new one stays, and the new one gets underscores in front.
    """
    rows = alignment_rows(read_bytes(vocabulary), read_bytes(model), digest)
    name = fresh("aligned", docs.columns)
    found = docs.withColumn(name, F.arrow_udf(rows, RESULT)(docs[text]))
    new = [F.col(f"{name}.{c}").alias(fresh(c, docs.columns)) for c in ("n_a", "n_b", "groups", "link_a", "link_b")]
    return found.select(*docs.columns, *new)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n, best) of rows (a, b): how often each pair comes, and whether no other a comes with that b more often."""
    counts = settled(links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def head_of(pairs: DataFrame, head: int) -> int:
    """The least count such that at most `head` pairs reach it, in steps of an eighth of a power of two."""
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(pairs.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).collect(), reverse=True)
    least, total = None, 0
    for row in sizes:
        total += row["pairs"]
        if total > head:
            break
        least = row["least"]
    return least if least is not None else 1 << 62


def link_sums(aligned: DataFrame, pairs: DataFrame, key: str, head: int = HEAD) -> DataFrame:
    """(key, n_best, count_sum) for every row of `aligned` (key, link_a, link_b) that has links: over its links, how many are best, and the sum of n."""
    least = head_of(pairs, head)
    known = pairs.where(F.col("n") >= least)
    links = aligned.select(key, F.explode(F.arrays_zip("link_a", "link_b")).alias("l")).select(key, F.col("l.link_a").alias("a"), F.col("l.link_b").alias("b"))
    met = links.join(F.broadcast(known), ["a", "b"], "left")
    rare = F.col("n").isNull()
    part = met.groupBy(key, F.when(rare, F.col("a")).alias("a"), F.when(rare, F.col("b")).alias("b")).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("count_sum"), F.sum("best").alias("n_best"))
    part = settled(part, "link-sums")
    done = part.where("a is null").select(key, "n_best", "count_sum")
    rest = part.where("a is not null").select(key, "a", "b", "k").join(pairs.where(F.col("n") < least), ["a", "b"])
    rest = rest.select(key, (F.col("k") * F.col("best")).alias("n_best"), (F.col("k") * F.col("n")).alias("count_sum"))
    return done.unionByName(rest).groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned_documents(docs: DataFrame, vocabulary: str, model: str, head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of `docs`; see `alignments`.

    n_best: links whose pair of ids ends together at least as often in the whole table as any other pair with its id of b; count_sum: how
    often the pairs of all links do, summed. groups_sha256 is the digest of groups, empty without tokens. NULL ids stay NULL.
    """
    rows = alignments(docs.select("doc_id", "text"), vocabulary, model, digest=True)
    aligned = settled(rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"),
        F.size("link_a").cast("long").alias("n_links"), F.col("groups").alias("groups_sha256"), "link_a", "link_b",
    ), "alignments")
    both = aligned.select(F.explode(F.arrays_zip("link_a", "link_b")).alias("l")).select(F.col("l.link_a").alias("a"), F.col("l.link_b").alias("b"))
    pairs = settled(pair_counts(both), "pairs")
    sums = link_sums(aligned.select("row", "link_a", "link_b"), pairs, "row", head)
    result = aligned.drop("link_a", "link_b").join(sums, "row", "left")
    return result.select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256",
    )
