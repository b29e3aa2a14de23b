"""Tokenizers and spelling: against the public libraries and brute force, and on awkward input."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import awkward
from tidewatch.llm import alignment, bpe, common, queries, spelling

FOLDER = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(rng):
    kinds = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0x80, 0x3000), lambda: rng.randrange(0x10000, 0x20000),
             lambda: rng.choice([0x558, 0x88F, 32, 32, 0xA0, 0x85, 0x3000, 10, 13, 0x2581])]
    out = ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(60))) for _ in range(600)]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for letters in ("aab eThe", " \n\t-=_*aA", "ab") for _ in range(400)]
    return [*out, "", "a" * 30_000, "<|endoftext|>a <|endoftext|><|endoftext|", " " * 1000 + "x", "é" * 999, "'s'S'll I'm", "\0a<|endoftext|>", "x" * 100_000]


@pytest.fixture(scope="module")
def model():
    return bpe.ByteBpe(bpe.read_bytes(A))


@pytest.mark.parametrize("specials", [True, False])
def test_bpe_equals_the_library(model, specials):
    texts = odd_texts(random.Random(1))
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = not specials
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        got = [ids.tolist() for part in bpe.chunks(pa.array(texts)) for ids in model.encode(part, specials)]
        assert got == want
    assert [model.decode(ids) for ids in got] == [library.decode(ids, skip_special_tokens=False) for ids in want]


def test_decode_equals_the_library_on_any_ids(model):
    rng, library = random.Random(2), Tokenizer.from_file(A)
    for _ in range(500):
        ids = [rng.randrange(50_257) for _ in range(rng.randrange(30))]
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_only_failing_words_are_merged(model):
    words = [w.encode() for w in (" the", " house", " xqzjk", " zzzzzzz", " hello", " unbelievableness", "s" * 90)]
    found, merged = model.encode_words(words)
    assert [np.frombuffer(f, np.int32).tolist() for f in found] == [model.merge(w) for w in words]
    assert 0 < merged < len(words)
    rng = random.Random(3)
    short = ["".join(rng.choice("aabeht \u00e9") for _ in range(rng.randrange(1, 12))).encode() for _ in range(2000)]
    assert [np.frombuffer(f, np.int32).tolist() for f in model.merge_all(short)] == [model.merge(w) for w in short]


def test_neighbours_that_would_merge_are_no_encoding(model):
    """`apart` says of every pair of whole tokens whether they are the encoding of their bytes."""
    rng = random.Random(4)
    pairs = [(rng.randrange(256, 50_256), rng.randrange(256, 3000)) for _ in range(3000)]
    x, y = (np.array(v) for v in zip(*pairs))
    want = [model.merge(model.bytes_of[a] + model.bytes_of[b]) == [a, b] for a, b in pairs]
    assert model.apart(x, y).tolist() == want and 0 < sum(want) < len(want)


def test_bpe_query_by_the_library(spark):
    library, sha = Tokenizer.from_file(A), lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = {r["doc_id"]: r["text"] or "" for r in common.table(spark, FOLDER, "documents").collect()}
    found = queries.QUERIES["op12_bpe"](spark, FOLDER).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert tuple(r)[1:] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def brute_alignment(texts):
    """Per text (ids of a, ids of b, groups, links), from the libraries and offsets alone."""
    library, pieces, byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), bpe.byte_letters()
    library.encode_special_tokens = True
    out = []
    for text in texts:
        out.append(([], [], [], []))
        if not text:
            continue
        whole = (" " + text).encode()
        a, b = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        sides = [[bytes(byte[c] for c in library.id_to_token(i)) for i in a],
                 [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("\u2581", " ").encode() for i in b]]
        if any(b"".join(side) != whole for side in sides):
            continue
        ends = []
        for side in sides:
            at, places = 0, {}
            for k, token in enumerate(side):
                at += len(token)
                places[at] = k
            ends.append(places)
        groups, links, i, j = [], [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            p, q = ends[0][end] + 1, ends[1][end] + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        out[-1] = (a, b, groups, links)
    return out


def test_pointer_jumping_groups():
    rng = np.random.default_rng(5)
    for _ in range(300):
        total = int(rng.integers(1, 40))
        a, b = (np.unique(np.append(rng.integers(1, total + 1, int(rng.integers(0, total + 1))), total)) for _ in range(2))
        of_a, of_b = alignment.terminals(a, b)
        common_ends = np.intersect1d(a, b)
        assert (b[of_a] == common_ends[np.searchsorted(common_ends, a)]).all() and (b[of_b] == common_ends[np.searchsorted(common_ends, b)]).all()


@pytest.mark.parametrize("head", [1 << 18, 20, 0])
def test_alignment_by_brute_force(spark, head):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, FOLDER, "documents").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(odd_texts(random.Random(6))[::5])] + [(1, None), (None, "no id"), (2, "\u2581 kept by one only"), rows[0]]
    want = brute_alignment([t for _, t in rows])
    counts = Counter(link for w in want for link in w[3])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = sorted((
        -1 if d is None else d, len(a), len(b), len(g), len(l), sum(counts[x] == most[x[1]] for x in l), sum(counts[x] for x in l), sha(";".join(g)) if a else "",
    ) for (d, _), (a, b, g, l) in zip(rows, want))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = alignment.aligned_documents(frame, A, B, head=head).collect()
    assert sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in got) == expected


def brute_spelling(rows, slip=199):
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            word = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % slip == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    shared, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shared[i, w[:i] + w[i + 1 :]].add(w)
            if (less := w[:i] + w[i + 1 :]) in words and less != w:
                near[w].add(less)
                near[less].add(w)
    for group in shared.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best
    result = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        result[w] = (w, n, len(near[w]), form.get(w), words.get(form.get(w)), root)
    return result


def test_spelling_by_brute_force(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    got = {r["word"]: tuple(r) for r in spelling.variants(docs).collect()}
    assert got == brute_spelling([tuple(r) for r in docs.collect()])


def test_spelling_of_dense_groups_accents_ties_and_chains(spark):
    rng = random.Random(7)
    times = {"abcdef": 5000, "abcdeg": 900, "abcdgg": 150, "abcggg": 25, "abgggg": 5, "abcdefx": 900, "Abcdef": 7, "été\u00c0ßÿx": 40, "été\u00e0ßÿx": 5,
             "aaaaaa": 30, "aaaaaaa": 5, "abcabc": 6, "acbabc": 30, "short": 99, "x" * 3000: 5, "x" * 3001: 25}
    for _ in range(150):
        word = list("common")
        for _ in range(rng.randrange(3)):
            word[rng.randrange(6)] = rng.choice("comnxyz")
        times["".join(word)] = rng.randrange(5, 40)
    words = [w for w, n in times.items() for _ in range(n)]
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)] + [(None, "commom commom"), (41, None), (42, "")]
    frame = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").withColumn("word", F.lit("taken")).withColumn("n", F.lit(0))
    for slip in (199, 7):
        got = {r["word"]: tuple(r) for r in spelling.variants(frame, slip=slip).collect()}
        assert got == brute_spelling([*rows, rows[0]], slip)
    assert spelling.variants(frame.limit(0)).count() == 0


def test_signatures_miss_no_near_pair(spark):
    """All pairs of strings over a small alphabet, with few parts."""
    words = ["".join(w) for w in {tuple(random.Random(i).choice("abc") for _ in range(5 + i % 3)) for i in range(700)}]
    near = spelling.near_words(spark.createDataFrame([(w, 9) for w in words], "word string, n long"), parts=4, parts1=2)

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    got = [frozenset((r["a"], r["b"])) for r in near.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b)}


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark).withColumn("ids", F.lit("taken")).withColumn("Decoded", F.lit("taken")).withColumn("link_a", F.lit("taken")).withColumn("row", F.lit(1))
    for rows in (docs, docs.limit(0)):
        n = rows.count()
        coded = bpe.tokens(rows, A)
        assert coded.columns == [*rows.columns, "_ids", "_decoded"] and coded.count() == n
        assert coded.where("coalesce(text, '') <> _decoded").count() == 0
        both = alignment.alignments(rows, A, B)
        assert both.columns[-5:] == ["n_a", "n_b", "groups", "_link_a", "link_b"] and both.count() == n
        assert alignment.aligned_documents(rows, A, B).count() == n
        assert spelling.variants(rows).count() == 0
