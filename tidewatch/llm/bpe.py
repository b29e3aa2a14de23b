"""Byte-level BPE by speculation and verification.

Merging a word pair by pair is the slow way to its tokens. Here a greedy longest match proposes the tokens of all words of a batch at once.
A proposal is the merged result exactly when each of its tokens is what its own bytes merge to and no two neighbours would have
merged across their border; the neighbours are tested for all distinct pairs of the batch in one vectorised walk. Only words
that fail are merged pair by pair.

The vocabulary file is read once by the driver (its size is that of the vocabulary) and travels to the tasks as bytes.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from tidewatch.llm.common import fresh

CHUNK_BYTES, REMEMBER, REMEMBER_CHARS, SIDE_BY_SIDE = 1 << 19, 400_000, 48, 64
NEVER = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Splitter:
    """Words of a text as the tokenizers library cuts them.

    Libraries know different versions of Unicode, so the class of a code point is asked of that library when it is first met; those
    on which `regex` disagrees become exceptions in the pattern. Texts within Latin-1, whose classes fit into a table, are cut by
    the faster `re`.
    """

    def __init__(self):
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.own = {kind: regex.compile(kind) for kind in (r"\p{L}", r"\p{N}", r"\s")}
        self.known: set[str] = set()
        self.members: dict[str, set[str]] = {kind: set() for kind in self.own}
        self.strangers: dict[str, set[str]] = {kind: set() for kind in self.own}
        table = {kind: "" for kind in self.own}
        for char in map(chr, range(256)):
            if kind := self._class(char):
                table[kind] += re.escape(char)
        self.latin = re.compile(self._pattern(*table.values())).findall
        self._compile()

    @staticmethod
    def _pattern(letter: str, number: str, space: str) -> str:
        return (
            f" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{letter}{number}{space}]+|[{space}]+(?![^{space}])|[{space}]+"
        )

    def _compile(self) -> None:
        def of(kind: str) -> str:
            listed = lambda chars: "".join(f"\\U{ord(c):08x}" for c in sorted(chars))
            plus = f"||[{listed(self.members[kind])}]" if self.members[kind] else ""
            minus = f"--[{listed(self.strangers[kind])}]" if self.strangers[kind] else ""
            return f"[[{kind}{plus}]{minus}]"

        self.find = regex.compile(self._pattern(*map(of, self.own)), regex.V1).findall

    def _class(self, char: str) -> str | None:
        """Which class the library puts a code point in: it stays together with a neighbour of its class only."""
        for lead, kind in (("a", r"\p{L}"), ("1", r"\p{N}"), ("!", None)):
            if len(self.library.pre_tokenize_str(lead + char)) == 1:
                return kind
        return r"\s"

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return self.latin(text)
        except UnicodeEncodeError:
            pass
        new = set(text) - self.known
        differ = False
        for char in new:
            kind = self._class(char)
            for name, pattern in self.own.items():
                if (pattern.match(char) is not None) != (kind == name):
                    (self.members if kind == name else self.strangers)[name].add(char)
                    differ = True
        self.known |= new
        if differ:
            self._compile()
        return self.find(text)


class ByteBpe:
    """A byte-level BPE from the bytes of a vocabulary file of the tokenizers library, as sorted arrays."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or model["type"] != "BPE":
            raise ValueError("not a plain byte-level BPE")
        vocab, byte = model["vocab"], byte_letters()
        added = spec["added_tokens"]
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with flags are not supported")
        size = max([*vocab.values(), *(t["id"] for t in added)]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, at in vocab.items():
            self.bytes_of[at] = bytes(byte[c] for c in token)
        for token in added:
            self.bytes_of[token["id"]] = token["content"].encode()
        self.specials = {t["content"]: t["id"] for t in added}
        by_length = sorted(self.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.single = np.zeros(256, np.int64)
        for token, at in vocab.items():
            if len(token) == 1:
                self.single[byte[token]] = at
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if self.rank[z] >= 0 or rank <= max(self.rank[x], self.rank[y]):
                raise ValueError("merges are not in the order of a trained BPE")
            self.merges[x, y] = rank, z
            self.left[z], self.right[z], self.rank[z] = x, y, rank
        keys = np.array([x << 32 | y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.arange(len(keys), dtype=np.int64)[order]
        self.pair_merged = np.array([z for _, z in self.merges.values()], np.int64)[order]
        self._trie(vocab.values())
        self._whole()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.splitter = Splitter()
        self.memory: dict[str, bytes] = {}

    def _trie(self, ids: Iterable[int]) -> None:
        """Edges (node, byte) -> node as sorted keys, and the token that ends at each node."""
        edges: dict[int, int] = {}
        ends = [-1]
        for at in ids:
            node = 0
            for b in self.bytes_of[at]:
                key = node << 8 | b
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(ends)
                    ends.append(-1)
            ends[node] = at
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.edge_keys, self.edge_nodes = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.node_token = np.array(ends, np.int64)
        # The first two bytes are looked up in tables: node of a byte, and of two bytes (0: there is none).
        self.root, self.second = np.zeros(256, np.int64), np.zeros(1 << 16, np.int64)
        first = self.edge_keys < 256
        self.root[self.edge_keys[first]] = self.edge_nodes[first]
        byte_of = np.full(len(ends), -1, np.int64)
        byte_of[self.edge_nodes[first]] = self.edge_keys[first]
        above = byte_of[self.edge_keys >> 8]
        self.second[above[above >= 0] << 8 | self.edge_keys[above >= 0] & 255] = self.edge_nodes[above >= 0]

    def _whole(self) -> None:
        """Which tokens are what their own bytes merge to: both halves are, and nothing merges across them before they do."""
        merged = np.flatnonzero(self.rank >= 0)
        fine = self.apart(self.left[merged], self.right[merged], self.rank[merged])
        self.whole = np.ones(len(self.rank), bool)
        for at, ok in zip(merged[np.argsort(self.rank[merged])], fine[np.argsort(self.rank[merged])]):
            self.whole[at] = ok and self.whole[self.left[at]] and self.whole[self.right[at]]

    def apart(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether neighbours x, y never merge across their border (before rank `until`).

        Merging is played backwards: of both tokens the one made last is undone, which uncovers its half at the border. Whatever
        stands at the border at a time must not merge before that time.
        """
        x, y = x.copy(), y.copy()
        until = np.full(len(x), NEVER) if until is None else until.copy()
        result = np.ones(len(x), bool)
        todo = np.arange(len(x))
        while len(todo):
            u, v = x[todo], y[todo]
            key = u << 32 | v
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            clash = (self.pair_keys[at] == key) & (self.pair_ranks[at] < until[todo])
            result[todo[clash]] = False
            left_last = self.rank[u] > self.rank[v]
            last = np.maximum(self.rank[u], self.rank[v])
            # Equal pairs merge from the left: the left token's own merge goes before one across the border, that of the right one after.
            until[todo] = np.where(left_last, last, last + 1)
            x[todo] = np.where(left_last, self.right[u], u)
            y[todo] = np.where(left_last, v, self.left[v])
            todo = todo[~clash & (last >= 0)]
        return result

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match: the tokens of all words in a row, and how many each word has."""
        sizes = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        limit = np.repeat(np.cumsum(sizes), sizes)
        best = self.node_token[self.root[text]]
        todo = np.flatnonzero(np.arange(1, len(text) + 1) < limit)
        node = np.zeros(len(text), np.int64)
        node[todo] = self.second[text[todo] << 8 | text[todo + 1]]
        todo = todo[node[todo] > 0]
        token = self.node_token[node[todo]]
        best[todo[token >= 0]] = token[token >= 0]
        depth = 2
        while True:
            todo = todo[todo + depth < limit[todo]]
            if not len(todo):
                break
            key = node[todo] << 8 | text[todo + depth]
            at = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            hit = self.edge_keys[at] == key
            todo, onward = todo[hit], self.edge_nodes[at[hit]]
            node[todo] = onward
            token = self.node_token[onward]
            ends = token >= 0
            best[todo[ends]] = token[ends]
            depth += 1
        step = self.lengths[best].tolist()
        starts, at = [], 0
        while at < len(step):  # a longest match never reaches beyond its word
            starts.append(at)
            at += step[at]
        starts = np.array(starts, np.int64)
        return best[starts], np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))

    def merge(self, word: bytes) -> list[int]:
        """The exact tokens of a word: always the pair of lowest rank, from the left."""
        tokens = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        heap = [(*found, i, tokens[i], tokens[i + 1]) for i in range(len(tokens) - 1) if (found := self.merges.get((tokens[i], tokens[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, merged, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= len(tokens) or tokens[j] != b:
                continue
            tokens[i], tokens[j] = merged, -1
            after[i] = after[j]
            if after[i] < len(tokens):
                before[after[i]] = i
                if found := self.merges.get((merged, tokens[after[i]])):
                    heapq.heappush(heap, (*found, i, merged, tokens[after[i]]))
            if before[i] >= 0 and (found := self.merges.get((tokens[before[i]], merged))):
                heapq.heappush(heap, (*found, before[i], tokens[before[i]], merged))
        return [t for t in tokens if t >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NEVER for pairs that do not merge) and what it merges to."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER), self.pair_merged[at]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """`merge` for many short words side by side, as int32 in bytes: a round merges in each word all pairs of its lowest rank."""
        sizes = np.array([len(w) for w in words], np.int64)
        tokens = self.single[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        found = [b""] * len(words)
        rank, merged = self._ranks(tokens, np.r_[tokens[1:], 0])
        rank[np.cumsum(sizes) - 1] = NEVER
        while len(tokens):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[starts, len(tokens)])
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NEVER
            if done.any():
                flat = tokens.astype(np.int32).tobytes()
                for w, at, n in zip(word[starts[done]].tolist(), (starts[done] * 4).tolist(), (counts[done] * 4).tolist()):
                    found[w] = flat[at : at + n]
                stay = np.repeat(~done, counts)
                tokens, word, rank, merged = tokens[stay], word[stay], rank[stay], merged[stay]
                counts, lowest = counts[~done], lowest[~done]
                if not len(tokens):
                    break
            hit = rank == np.repeat(lowest, counts)
            if (hit[1:] & hit[:-1]).any():  # of `a a a` the left pair merges
                at = np.flatnonzero(hit)
                run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], np.arange(len(at)), 0))
                hit[at[(np.arange(len(at)) - run) % 2 == 1]] = False
            tokens = np.where(hit, merged, tokens)
            stay = np.r_[True, ~hit[:-1]]
            tokens, word, rank, merged, hit = tokens[stay], word[stay], rank[stay], merged[stay], hit[stay]
            # Pairs to the left and to the right of a merged one are new.
            new = np.flatnonzero(hit | np.r_[hit[1:], False])
            after = np.minimum(new + 1, len(tokens) - 1)
            rank[new], merged[new] = self._ranks(tokens[new], tokens[after])
            rank[new[(after == new) | (word[after] != word[new])]] = NEVER
        return found

    def encode_words(self, words: list[bytes]) -> tuple[list[bytes], int]:
        """The tokens of each word (none empty) as int32 in bytes, and how many words had to be merged pair by pair."""
        if not words:
            return [], 0
        tokens, counts = self.propose(words)
        ends = np.cumsum(counts)
        word = np.repeat(np.arange(len(words)), counts)
        failed = np.zeros(len(words), bool)
        failed[word[~self.whole[tokens]]] = True
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, group = np.unique(tokens[inside] << 32 | tokens[inside + 1], return_inverse=True)
        failed[word[inside[~self.apart(pairs >> 32, pairs & 0xFFFFFFFF)[group]]]] = True
        flat, ends = tokens.astype(np.int32).tobytes(), (ends * 4).tolist()
        found = [flat[a:b] for a, b in zip([0, *ends], ends)]
        redo = np.flatnonzero(failed).tolist()
        # Rounds over all words would cost a long one the square of its length.
        short = [i for i in redo if len(words[i]) <= SIDE_BY_SIDE]
        for i, ids in zip(short, self.merge_all([words[i] for i in short]) if short else ()):
            found[i] = ids
        for i in redo:
            if len(words[i]) > SIDE_BY_SIDE:
                found[i] = np.array(self.merge(words[i]), np.int32).tobytes()
        return found, len(redo)

    def encode(self, texts: list[str], specials: bool = True) -> Iterator[np.ndarray]:
        """Token ids (int32) of each text. Strings of special tokens are their ids with `specials`, plain text without."""
        if len(self.memory) > REMEMBER:
            self.memory.clear()
        cut: list[list[str]] = []
        special_words: dict[str, bytes] = {}
        for text in texts:
            if specials and self.special and self.special.search(text):
                words = []
                for i, part in enumerate(self.special.split(text)):
                    if i % 2:  # a word that no text can have: a NUL byte ahead of a letter is cut off
                        special_words[f"\0a{part}"] = np.array([self.specials[part]], np.int32).tobytes()
                        words.append(f"\0a{part}")
                    else:
                        words += self.splitter.words(part)
                cut.append(words)
            else:
                cut.append(self.splitter.words(text))
        memory = self.memory
        new = [w for w in set().union(*cut) if w not in memory and w not in special_words]
        found = dict(zip(new, self.encode_words([w.encode() for w in new])[0]))
        memory.update(found)
        of = memory | special_words if special_words else memory
        for words in cut:
            yield np.frombuffer(b"".join(map(of.__getitem__, words)), np.int32)
        for word in new:
            if len(word) > REMEMBER_CHARS:
                del memory[word]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens in a row."""
        return gathered(self.flat, self.begins[ids], self.lengths[ids])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of token ids; bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        return b"".join(self.joined(ids[at : at + (1 << 18)]).tobytes() for at in range(0, len(ids), 1 << 18)).decode("utf-8", "replace")


def gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of `flat` that start at `begins`, in a row."""
    shift = begins - (np.cumsum(sizes) - sizes)
    return flat[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[list[str]]:
    """The texts of an array in order, NULL as empty, in lists of about `size` bytes; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // size
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(texts)]
    for low, high in zip(cuts, cuts[1:]):
        yield [t or "" for t in texts[low:high].to_pylist()]


def lists(parts: list[np.ndarray]) -> pa.Array:
    """One list<int32> array of int32 arrays."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


_models: dict[bytes, ByteBpe] = {}


def model_of(data: bytes) -> ByteBpe:
    """The model of a vocabulary file, built once in a process."""
    if data not in _models:
        _models.clear()
        _models[data] = ByteBpe(data)
    return _models[data]


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encoded(text: Column, vocabulary: bytes, specials: bool = True) -> Column:
    """Column (ids, decoded): token ids of each whole text and the text that decoding them gives. NULL counts as empty."""

    def each(parts):
        bpe = model_of(vocabulary)
        for texts in parts:
            for some in chunks(texts):
                ids = list(bpe.encode(some, specials))
                yield pa.StructArray.from_arrays([lists(ids), pa.array(map(bpe.decode, ids), pa.string())], ["ids", "decoded"])

    each.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(each, "ids array<int>, decoded string")(text)


def tokens(docs: DataFrame, path: str, text: str = "text", specials: bool = True) -> DataFrame:
    """`docs` with `ids array<int>` and `decoded string` of the vocabulary file at `path` behind its columns.

    Every row keeps its place, repeated rows and rows with NULL ids too. NULL and empty texts have no ids and decode to an empty text.
    A column of `docs` that is called ids or decoded stays; the new one gets underscores in front. An empty table gives no rows.
    """
    found = fresh("encoded", docs.columns)
    ids, decoded = fresh("ids", docs.columns), fresh("decoded", docs.columns)
    rows = docs.withColumn(found, encoded(docs[text], read_bytes(path), specials))
    return rows.select(*docs.columns, F.col(f"{found}.ids").alias(ids), F.col(f"{found}.decoded").alias(decoded))
