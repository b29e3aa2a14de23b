"""The operators of the subpackage against brute force, round trips and held-out accuracy, and on awkward input."""

import gzip
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tidewatch.llm import common, decontaminate, htmltext, languages, lines, mixing, passages, simhash, topk, toxicity, warc

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sample_words(rng, n, alphabet="abcdefghij"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 8))) for _ in range(n)]


def components_of(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def awkward(spark):
    """NULLs in every column, empty and long texts, ties, repeated rows and columns whose names operators use themselves."""
    rows = [
        (None, "no id at all", None, None, None), (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "\n \n", "de", None, 3),
        (4, "x" * 200_000, "en", "a", 200_000), (5, "same words in both rows here", "en", "b", 28), (5, "same words in both rows here", "en", "b", 28),
        (6, "same words in both rows here", "fr", "b", 28), (7, "ö ü 漢字 🙂 ퟿", "de", "c", 9), (8, "1234 5678", "es", "c", 9),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("score", "fp", "doc", "repeats", "weight", "n_tokens", "topic", "leaks", "component_id", "h1", "item_id"):
        frame = frame.withColumn(name, F.lit("taken"))
    return frame


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# --- components ---


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)] + [(999, 999)]
    found = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == components_of({n for e in edges for n in e}, edges)


# --- 1: WARC ---


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(12))) for _ in range(k)]
        merged = [(runs[r][i], r) for r, i in warc.LoserTree(runs)]
        assert merged == sorted((v, r) for r, run in enumerate(runs) for v in run)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 60
    rows = [(1, "http://www.A.b/X?q#f", big), (9, "http://a.b/x?q", big), (2, None, None), (3, "http://a.b/\r\nx", "small"), (4, "u", "small"), (None, "u", big), (9, "http://a.b/x?q", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("position", F.lit(0))
    found = warc.capture_index(pages, path=f"{tmp_path}/a").orderBy("position").collect()
    assert [r["position"] for r in found] == list(range(1, 8))
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found)
    n = len(big.encode())
    assert got == sorted([(0, "revisit", 9, n), (1, "revisit", 9, n), (2, "response", None, 0), (3, "response", None, 5), (4, "response", None, 5), (9, "response", None, n), (9, "response", None, n)])
    payloads = warc.read_archives(spark, f"{tmp_path}/a", with_payload=True).where("record_type = 'response'")
    assert {(r["page_id"], r["payload"]) for r in payloads.collect()} == {(2, ""), (3, "small"), (4, "small"), (9, big)}
    assert warc.capture_index(pages.limit(0)).count() == 0


def test_cut_archives_are_refused():
    whole = gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")
    with pytest.raises(EOFError):
        list(warc.records_in(whole))


# --- 2: top-k ---


@pytest.mark.parametrize("shape", ["random", "ties", "few"])
def test_top_k(spark, shape):
    rng = np.random.default_rng(3)
    n = 8 if shape == "few" else 240
    vectors = rng.integers(-1, 2, (n, 6)) / 64 if shape == "ties" else rng.normal(0, 0.4, (n, 6))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [float("nan")] * 6), (1002, [None] * 6), (None, [0.1] * 6), rows[0]]
    table = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = topk.top_k(table.where("vec_id % 5 = 0"), table, k=7, block_rows=50, query_rows=16).collect()
    whole = np.floor(vectors * 64).astype(int)
    want = set()
    for q in range(0, n, 5):
        score = whole @ whole[q]
        order = sorted((-score[i], i) for i in range(n) if i != q)[:7]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(order)}
    assert {tuple(r) for r in found} == want
    assert topk.top_k(table.limit(0), table).count() == 0


def clustered(rng, n=4000, dims=16, groups=20):
    centres = rng.normal(0, 400, (groups, dims))
    return (centres[rng.integers(0, groups, n)] + rng.normal(0, 8, (n, dims))).astype(int)


def test_the_threshold_leaves_most_rows_unscored_where_there_are_few_dimensions(spark):
    rng = np.random.default_rng(8)
    vectors = clustered(rng, dims=3)
    lists = topk.Lists(np.arange(4000), vectors)
    asked = range(0, 4000, 100)
    for q in asked:
        ids, score = lists.best(q, vectors[q], 10)
        whole = vectors @ vectors[q]
        want = [i for i in np.lexsort((np.arange(4000), -whole)) if i != q][:10]
        assert ids.tolist() == want and score.tolist() == whole[want].tolist()
    assert lists.scored < 0.5 * 4000 * len(asked)
    before = lists.scored
    for q in asked:  # with the k-th best known from elsewhere even less is read, and a floor above all reads nothing
        floor = int(np.sort(vectors @ vectors[q])[-11])
        lists.best(q, vectors[q], 10, floor)
    assert lists.scored - before <= before
    before = lists.scored
    assert not len(lists.best(0, vectors[0], 10, 1 << 60)[0]) and lists.scored == before


def test_blocks_out_of_reach_are_not_sent(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vectors = clustered(rng, 3000)
    rows = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, v array<long>")
    pairs = {}

    def spy(frame, purpose):
        out = common.settled(frame, purpose)
        pairs[purpose] = out.count()
        return out

    monkeypatch.setattr(topk, "settled", spy)
    found = topk.top_k(rows.where("vec_id % 50 = 0"), rows, k=5, block_rows=100, query_rows=2).collect()
    whole = vectors @ vectors.T
    want = {(q, r + 1, int(i)) for q in range(0, 3000, 50) for r, i in enumerate([i for i in np.lexsort((np.arange(3000), -whole[q])) if i != q][:5])}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found} == want
    assert pairs["block-pairs"] < 0.5 * pairs["vector-blocks"] * pairs["query-blocks"]


# --- 3: mixing ---


def test_raking_meets_the_margins(spark):
    rng = np.random.default_rng(4)
    cells = rng.uniform(1, 50, (3, 4, 2))
    cells[0, 1, 0] = 0
    shares = [np.array([0.2, 0.5, 0.3]), np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.6, 0.4])]
    weights = mixing.rake(cells, [share * cells.sum() for share in shares])
    for axis, share in enumerate(shares):
        assert np.allclose(weights.sum(axis=tuple(a for a in range(3) if a != axis)) / weights.sum(), share, atol=1e-6)
    assert weights[0, 1, 0] == 0 and mixing.rake(np.zeros((2, 2)), [np.ones(2), np.ones(2)]).sum() == 0
    for keep in (0.1, 0.9):  # with probabilities up to 1, the sample meets them too
        weight, probability = mixing.rates(cells, shares, keep)
        kept = cells * probability
        assert probability.max() <= 1 and 0 < kept.sum() <= keep * cells.sum() * (1 + 1e-9)
        assert np.allclose(weight, probability * cells.sum() / kept.sum())
        for axis, share in enumerate(shares):
            assert np.allclose(kept.sum(axis=tuple(a for a in range(3) if a != axis)) / kept.sum(), share, atol=1e-5)


def test_as_much_is_kept_as_the_targets_allow():
    cells, shares = np.array([[10.0, 0.0], [0.0, 90.0]]), [np.array([0.5, 0.5]), np.array([0.5, 0.5])]
    _, probability = mixing.rates(cells, shares, 0.8)
    assert probability[0, 0] == pytest.approx(1, abs=1e-4) and probability[1, 1] == pytest.approx(1 / 9, abs=1e-4)
    contradicting = [np.array([0.5, 0.5]), np.array([0.1, 0.9])]
    assert 0 < mixing.rates(cells, contradicting, 0.8)[1].max() <= 1
    assert mixing.rates(np.zeros((2, 2)), shares, 0.8)[1].sum() == 0


def test_the_sample_meets_the_targets(spark):
    rows = common.table(spark, "/root/testdata/sf0.1", "documents")
    targets = {"source": {"src0": 0.1, mixing.OTHER: 0.9}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}
    counted = rows.select("doc_id", "source", "lang", mixing.n_tokens(F.col("text")).alias("n"))
    taken = mixing.mix(counted, targets, "n", {"source": "source", "lang": "lang"}, 0.8, ["doc_id", "source", "lang"]).where("selected").toPandas()
    share = lambda c: (taken.groupby(c)["n_tokens"].sum() / taken["n_tokens"].sum()).to_dict()
    assert share("source")["src0"] == pytest.approx(0.1, abs=0.01)
    assert all(share("lang")[k] == pytest.approx(v, abs=0.02) for k, v in targets["lang"].items())


def test_mixing_by_brute_force(spark):
    docs = common.table(spark, FOLDER, "documents")
    found = {r["doc_id"]: r for r in mixing.mixed_documents(docs).collect()}
    rows = docs.collect()
    tokens = {r["doc_id"]: len(r["text"].split()) for r in rows}
    assert all(found[d]["n_tokens"] == n for d, n in tokens.items())

    def cell(r):
        mean = len(r["text"]) / max(1, tokens[r["doc_id"]])
        topic = "short" if mean < 6 else "middle" if mean < 8 else "long"
        return tuple(v if v in mixing.TARGETS[k] else "*" for k, v in (("source", r["source"]), ("lang", r["lang"]), ("topic", topic)))

    sums = defaultdict(float)
    for r in rows:
        sums[cell(r)] += tokens[r["doc_id"]]
    # Expected kept tokens meet every margin, nothing is cut, and documents of a cell share one probability.
    kept, chance = defaultdict(float), {}
    for r in rows:
        f = found[r["doc_id"]]
        assert chance.setdefault(cell(r), f["probability"]) == f["probability"] <= 1
        for axis, value in enumerate(cell(r)):
            kept[axis, value] += tokens[r["doc_id"]] * f["probability"]
    total = sum(w for (axis, _), w in kept.items() if not axis)
    for axis, name in enumerate(("source", "lang", "topic")):
        there = {c[axis] for c in sums if sums[c]}
        scale = sum(mixing.TARGETS[name][k] for k in there)
        for k in there:
            assert kept[axis, k] / total == pytest.approx(mixing.TARGETS[name][k] / scale, abs=1e-5)
    assert 0 < total <= mixing.KEEP * sum(tokens.values()) * (1 + 1e-9)


# --- 4: languages ---


def test_kneser_ney_sums_to_one():
    rng = random.Random(5)
    model = languages.Model([("a", " ".join(sample_words(rng, 40, "abc"))) for _ in range(20)] + [("b", " ".join(sample_words(rng, 40, "xyz"))) for _ in range(20)])
    history = languages.characters("abca")[:-1]
    chars = [np.uint64(ord(c)) for c in "abcxyz "]
    total = sum(np.exp(model._log(np.r_[history, c], len(history))) for c in chars)
    # All characters never seen share what is left equally.
    unseen = np.exp(model._log(np.r_[history, np.uint64(ord("!"))], len(history)))
    assert np.allclose(total + (languages.ALPHABET - len(chars)) * unseen, 1, atol=0.001)


def test_languages_are_told_apart_on_held_out_documents(spark):
    docs = common.table(spark, FOLDER, "documents")
    found = {r["doc_id"]: r for r in languages.language_id(docs).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 30 and all(found[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) >= 0.97


def test_texts_of_no_known_language_are_not_accepted(spark):
    model = languages.Model([(r["lang"], r["text"]) for r in common.table(spark, FOLDER, "documents").collect()])
    assert model.predict("zxq wvk jjq xzw qqk vvx kzz wqx jxk zvq kwz xqj " * 5)[3] is False


# --- 5: lines ---


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        following = [i]
        for j, d in enumerate(b, 1):
            following.append(min(row[j] + 1, following[-1] + 1, row[j - 1] + (c != d)))
        row = following
    return row[-1]


def changed(rng, word, n):
    word = list(word)
    for _ in range(n):
        i = rng.randrange(len(word) + 1)
        kind = rng.choice("sid")
        if kind == "i" or i == len(word):
            word.insert(i, rng.choice("abc"))
        elif kind == "s":
            word[i] = rng.choice("abc")
        else:
            del word[i]
    return "".join(word)


def test_edit_distance(spark):
    rng, rows = random.Random(6), []
    for _ in range(400):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(25)))
        b = changed(rng, a, rng.randrange(5))
        rows.append((a, b) if len(a) >= len(b) else (b, a))
    frame = spark.createDataFrame(rows, "p string, t string")
    for most in (1, 2, 3):
        for r in frame.select("p", "t", lines.edit_distance(F.col("p"), F.col("t"), most).alias("d")).collect():
            assert min(r["d"], most + 1) == min(edits(r["p"], r["t"]), most + 1), r


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(25, 60))).strip() for _ in range(40)]
    docs = [(d, "\n".join(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4])) for _ in range(5))) for d in range(60)]
    found = {(r["doc_id"], n) for r in lines.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect() for n in r["repeats"]}
    every = [(d, n, x.strip(" ").lower()) for d, t in docs for n, x in enumerate(t.split("\n")) if len(x.strip(" ")) >= 20]
    texts = sorted({x for _, _, x in every})
    near = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2]
    group, first = components_of(texts, near), {}
    for d, n, x in sorted(every):
        first.setdefault(group[x], (d, n))
    assert found == {(d, n) for d, n, x in every if first[group[x]] != (d, n)} and found


def test_line_dedup_takes_lines_out_and_keeps_documents(spark):
    line = "a line that is long enough to count"
    docs = spark.createDataFrame([(1, f"{line}\nshort\n{line}"), (2, f"own text of this document\n{line.upper()}"), (3, None)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in lines.drop_repeats(docs.withColumn("n_chars", F.lit(0).cast("long"))).collect()}
    assert out == {1: f"{line}\nshort", 2: "own text of this document", 3: None}


# --- 6: HTML ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="cookie-notice">We use cookies, and so on.</div>
<div id="main"><div class="post"><h2>Title &amp; more</h2><p>First   paragraph, with <b>bold</b>&nbsp;text; and a <a href=x>link</a>.
<p>Second &#8212; paragraph. It goes on, and on.<ul><li>An item, one.</li><li>Another item.</li></ul><h3>Part</h3><p>Short.</p>
<form><p>Your name, please: <input></p></form></div>
<section class="comments"><h3>Comments</h3><p>I do not agree, not at all, with any of this. Really.</p></section></div>
<aside><p>Other stories, which are long enough, to look like text.</p></aside><footer>&copy; 2024, all rights.</footer></body>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == (
        "Title & more\nFirst paragraph, with bold text; and a link.\nSecond — paragraph. It goes on, and on.\nAn item, one.\nAnother item.\nPart\nShort."
    )
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<script>x") == ""
    assert htmltext.main_text("plain words only") == "plain words only"
    assert htmltext.main_text("<p>one<p>two</div></b>") == "one\ntwo"
    assert len(htmltext.main_text("<div>" * 5000 + "<p>deep text, still here.</p>")) > 0


def test_extract_holds_the_article_of_every_page(spark):
    import html
    import re

    rows = htmltext.extract(common.table(spark, FOLDER, "pages")).collect()
    pages = {r["page_id"]: r["html"] for r in common.table(spark, FOLDER, "pages").collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", pages[r["page_id"]], re.DOTALL)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", body)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


# --- 7: SimHash ---


def slow_fingerprint(text):
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("shard_rows", [2048, 3])
def test_simhash_by_brute_force(spark, shard_rows):
    docs = common.table(spark, FOLDER, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {9001: None, 9002: "", 9003: "Two WORDS", 9004: "two words"}
    more = spark.createDataFrame([(d, t) for d, t in texts.items() if d > 9000], "doc_id long, text string")
    prints = {d: slow_fingerprint(t) for d, t in texts.items()}
    ids = sorted(texts)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 3]
    group = components_of(ids, edges)
    found = simhash.simhash(docs.unionByName(more), shard_rows=shard_rows).collect()
    assert {tuple(r) for r in found} == {(d, f"{prints[d]:016x}", group[d]) for d in ids}


def test_forest_finds_all_in_a_dense_group():
    rng = np.random.default_rng(8)
    center = int(rng.integers(2**63))
    values = np.unique(np.array([center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))], dtype=np.uint64))
    group = np.zeros(len(values), dtype=np.int64)
    hits = {(int(a), int(b)) for x, y in simhash.Forest(group, values).search(np.arange(len(values)), 3) for a, b in zip(x, y)}
    assert hits == {(i, j) for i in range(len(values)) for j in range(len(values)) if i != j and int(values[i] ^ values[j]).bit_count() <= 3}


# --- 8: passages ---


def test_compact_windows_by_brute_force():
    rng = np.random.default_rng(9)
    for n in (0, 3, 10, 57):
        values = rng.integers(0, 30, n).astype(np.uint64)
        want = set()
        for left in range(n):
            for right in range(left + 4, n):
                c = left + int(values[left : right + 1].argmin())
                want.add(c)
        l, c, r = passages.compact_windows(values, 5)
        assert set(c.tolist()) == want
        for a, m, b in zip(l, c, r):
            assert values[a : b + 1].min() == values[m] and (a == 0 or values[a - 1] <= values[m]) and (b == n - 1 or values[b + 1] < values[m])


def test_passages_shared_by_documents(spark):
    rng = random.Random(10)
    shared = [sample_words(rng, 70) for _ in range(8)]
    docs, holders = [], defaultdict(set)
    for d in range(60):
        words = sample_words(rng, 150)
        if d % 3:
            k = rng.randrange(8)
            part = list(shared[k])
            if d % 2:
                part[35] = "edited"
            at = rng.randrange(150)
            words[at:at] = part
            holders[k].add(d)
        docs.append((d, " ".join(words)))
    found = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    group = components_of(range(60), [(r["doc_id"], r["rep_doc_id"]) for r in found])
    for members in holders.values():
        assert len({group[d] for d in members}) == 1
    assert {r["doc_id"] for r in found} | {r["rep_doc_id"] for r in found} == set().union(*(m for m in holders.values() if len(m) > 1))
    texts = dict(docs)
    for r in found:
        a = texts[r["doc_id"]].split()[r["first_word"] : r["last_word"] + 1]
        b = texts[r["rep_doc_id"]].split()[r["rep_first_word"] : r["rep_last_word"] + 1]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert len(a) >= 50 and len(x & y) / len(x | y) >= 0.8


def alike(a, b):
    """Whether any two stretches of at least 46 shingles have a Jaccard similarity of at least 0.8, by trying all of them."""
    bits = {}
    sides = []
    for words in (a, b):
        shingles = [1 << bits.setdefault(tuple(words[i : i + 5]), len(bits)) for i in range(len(words) - 4)]
        stretches = []
        for i in range(len(shingles)):
            held = 0
            for j in range(i, len(shingles)):
                held |= shingles[j]
                if j - i + 1 >= 46:
                    stretches.append(held)
        sides.append(stretches)
    return any((x & y).bit_count() * 5 >= (x | y).bit_count() * 4 for x in sides[0] for y in sides[1])


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(3)] = sample_words(rng, rng.randrange(3))
    return words


def test_stretches_alike_by_brute_force():
    rng = random.Random(12)
    outcomes = Counter()
    for _ in range(150):
        base = sample_words(rng, rng.randrange(50, 66))
        x, y = (sample_words(rng, 3) + edited(rng, base, rng.randrange(3)) + sample_words(rng, 3) for _ in range(2))
        s, t = (passages.shingles(" ".join(w)) for w in (x, y))
        here = {v: i for i, v in enumerate(t.tolist())}
        places = [(0, i, i, i, here[v], here[v], here[v]) for i, v in enumerate(s.tolist()) if v in here]
        want, found = alike(x, y), passages.verified(s, t, np.array(places)) if places else []
        assert found or not want
        for first, last, rep_first, rep_last, similarity in found:
            here, there = set(s[first : last + 1].tolist()), set(t[rep_first : rep_last + 1].tolist())
            assert last - first >= 45 and len(here & there) / len(here | there) == similarity >= 0.8
        outcomes[want] += 1
    assert min(outcomes[True], outcomes[False]) > 20


def test_bands_by_brute_force():
    rng = np.random.default_rng(14)
    for kinds in (3, 12, 60, 10_000):
        x, y = (rng.integers(0, kinds, 90).astype(np.uint64) for _ in range(2))
        x[30:60] = y[25:55]
        there = passages.Places(y)
        ranks = np.searchsorted(there.sorted, x)
        at = np.flatnonzero(np.isin(x, y))
        for diagonal in (-40, 0, 5, 7, 60):
            low, high = diagonal - passages.SLACK, diagonal + passages.SLACK
            shared = [(i, i - j) for i in range(90) for j in range(90) if x[i] == y[j]]
            inside = [p for p in shared if low <= p[1] <= high]
            points = passages._shared(at, ranks[at], there, low, high)
            assert sorted(zip(*(c.tolist() for c in points))) == sorted(inside)
            assert passages._shared(at, ranks[at], there, low, high, len(inside) - 1) is None
            band = passages.Band(*passages._shared(at, ranks[at], there, -90, 90), diagonal)
            match = np.isin(np.arange(90), [i for i, _ in inside])
            for position in np.flatnonzero(match).tolist():
                for cost in (2, 4, 8, 50):
                    gain = np.where(match, 1, -cost)
                    want = position - int(np.cumsum(gain[position::-1]).argmax()), position + int(np.cumsum(gain[position:]).argmax())
                    assert band.widest(position, cost) == want
            equal = {i for i, d in inside if d == diagonal}
            for position in equal:
                begin, end = position, position + 1
                while begin - 1 in equal:
                    begin -= 1
                while end in equal:
                    end += 1
                assert band.run(position) == (begin, end)


def test_passages_of_long_texts_are_judged_by_what_is_shared():
    import time

    rng = random.Random(15)
    lines = [sample_words(rng, 30) for _ in range(250)]
    texts = []
    for _ in range(2):
        words = []
        for line in lines:
            words += line + sample_words(rng, 100 + rng.randrange(60))
        texts.append(passages.shingles(" ".join(words)))
    x, y = texts
    here = {v: i for i, v in enumerate(y.tolist())}
    places = np.array([(v, i, i, i, here[u], here[u], here[u]) for i, (v, u) in enumerate(zip(x.view(np.int64).tolist(), x.tolist())) if u in here])
    start = time.process_time()
    assert passages.verified(x, y, places) == [] and len(places) > 6000
    took = time.process_time() - start
    n = min(len(x), len(y))
    start = time.process_time()
    for _ in range(25 * len(lines)):  # the whole texts along 25 diagonals for every line
        np.flatnonzero(x[:n] == y[:n])
    assert took < 15 * (time.process_time() - start)


def test_windows_and_runs_of_many_texts_are_those_of_each():
    rng = random.Random(16)
    texts = [" ".join(sample_words(rng, rng.randrange(120))) for _ in range(40)]
    texts += ["", " \n", "x " * 90, "a b c " * 40, "x " * 45 + " ".join(sample_words(rng, 60)) + " x" * 50, "\u00c4 \u4e2d " * 60]
    rows = pd.DataFrame({"doc_id": range(len(texts)), "version": 7, "text": texts})
    together = pd.concat(passages._windows(iter([rows])))
    alone = pd.concat(w for k in range(len(texts)) for w in passages._windows(iter([rows[k : k + 1]])))
    assert together.to_numpy().tolist() == alone.to_numpy().tolist() and len(together) > 100
    asked = [(d, g[["l", "c", "r"]].assign(open=g["c"] % 2 == 0).to_dict("records")) for d, g in together.groupby("doc")]
    given = pd.DataFrame([({"doc": d, "version": 7}, texts[d], 3, w) for d, w in asked], columns=["doc", "text", "same", "windows"])
    found = {tuple(r) for r in pd.concat(passages._runs(iter([given]))).itertuples(index=False)}
    want = set()
    for d, windows in asked:
        s = passages.shingles(texts[d])
        of = {k: w for w in windows for k in range(max(w["l"], w["c"] - passages.GRAMS + 1), min(w["c"], w["r"] - passages.GRAMS + 1) + 1)}
        places = defaultdict(list)
        for k in sorted(of):
            size = passages.RUN if len(set(s[k : k + passages.RUN].tolist())) >= passages.VARIED else passages.LONG
            if k + size <= len(s):
                places[int(passages._joined(s[k : k + size], size).view(np.int64)[0])].append(k)
        for run, at in places.items():
            for chain in np.split(np.array(at), np.flatnonzero(np.diff(at) >= passages.RUN) + 1):
                for w in (of[int(chain[0])], of[int(chain[-1])]):
                    want.add((run, 3, d, 7, w["l"], w["c"], w["r"], any(of[k]["open"] for k in chain.tolist())))
    assert found == want


def test_stretches_remembered_are_those_judged(monkeypatch):
    class Forgets(dict):
        def __contains__(self, name):
            return False

    rng = random.Random(18)
    made, memo, judged = passages.chained, {}, []
    monkeypatch.setattr(passages, "chained", lambda *given: judged.append(1) or made(*given))
    calls, outcomes = Counter(), Counter()
    for k in range(16):
        base = sample_words(rng, rng.choice((30, 43, 60)))
        texts = [sample_words(rng, rng.randrange(4)) + (edited(rng, base, rng.randrange(3)) * 30)[: 180 + 40 * k] for _ in range(2)]
        x, y = (passages.shingles(" ".join(t)) for t in texts)
        places = [(0, i, i, i, j, j, j) for i in range(0, len(x), 9) for j in range(len(y)) if x[i] == y[j]]
        if not places:
            continue
        both = []
        for how, known in (("remembered", memo), ("judged", Forgets())):
            judged.clear()
            both.append(passages.verified(x, y, np.array(places), known))
            calls[how] += len(judged)
        assert both[0] == both[1]
        outcomes[bool(both[0])] += 1
    assert min(outcomes[True], outcomes[False]) > 3 and calls["remembered"] < calls["judged"] / 2


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for k in range(files.size()) if "shuffle_" in (f := files.apply(k).getName()) and f.endswith(".data")}


def test_passages_keep_no_shuffled_rows(spark):
    import time

    rng = random.Random(17)
    shared = sample_words(rng, 60)
    docs = [(d, " ".join(sample_words(rng, 40) + (shared if d % 2 else []))) for d in range(20)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    before, setting = shuffle_files(spark), spark.conf.get(common.CLEANUP)
    found = passages.repeated_passages(rows)
    for _ in range(50):  # executors are told to remove them
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(common.CLEANUP) == setting
    assert {r["doc_id"] for r in found.collect()} == set(range(3, 20, 2))


def test_a_text_goes_to_a_cell_of_pairs_once(spark):
    name = lambda d: (d, 7)
    each = [(name(a), name(b), [a, b]) for a in range(150) for b in range(a)] + [(name(d), name(1000), [0, d]) for d in range(2000, 2600)]
    place = "struct<doc: bigint, version: int>"
    pairs = spark.createDataFrame(each, f"doc {place}, rep {place}, places array<bigint>")
    rows = passages._cells(pairs).collect()
    assert sorted((tuple(r["doc"]), tuple(r["rep"]), r["places"]) for r in rows) == sorted(each)
    cells = defaultdict(lambda: (set(), set()))
    for r in rows:
        for side, k in zip(cells[r["cell"]], ("doc", "rep")):
            side.add(r[k])
    assert sum(len(a | b) for a, b in cells.values()) < len(each) / 4
    assert max(len(side) for both in cells.values() for side in both) <= 2 * passages.BLOCK


def test_no_link_of_passages_is_left_out(spark):
    rng = random.Random(13)
    docs = []
    for _ in range(24):
        base = sample_words(rng, rng.randrange(50, 60))
        if rng.random() < 0.7:  # a smaller document that shares all places of the passage but no passage
            cuts = [base[:25], base[25:], base[12:38]]
            docs.append([w for c in cuts for w in c + sample_words(rng, 8)])
        for _ in range(rng.randrange(2, 5)):
            docs.append(sample_words(rng, 4) + edited(rng, base, rng.randrange(3)) + sample_words(rng, 4))
    rows = [(d, " ".join(w)) for d, w in enumerate(docs)]
    rows += [(len(docs) + i, t) for i, (_, t) in enumerate(rows[:20])]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    words = [t.split() for _, t in rows]
    group = components_of(range(len(rows)), [(r["doc_id"], r["rep_doc_id"]) for r in found])
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(set(words[a]) & set(words[b])) > 20 and alike(words[a], words[b])]
    assert len(links) > 20 and [x for x in links if group[x[0]] != group[x[1]]] == []
    for r in found:
        a = words[r["doc_id"]][r["first_word"] : r["last_word"] + 1]
        b = words[r["rep_doc_id"]][r["rep_first_word"] : r["rep_last_word"] + 1]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert r["rep_doc_id"] < r["doc_id"] and len(a) >= 50 and len(x & y) / len(x | y) == r["similarity"] >= 0.8


# --- 9: decontamination ---


def test_align_is_smith_waterman():
    rng = np.random.default_rng(11)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 12))
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i, j] = max(0, table[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
        best, end = decontaminate.align(a, b[None, :])
        assert best[0] == table.max() and table[:, end[0]].max() == best[0]


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_copies_with_few_edits_are_found(spark, block_words):
    rng = random.Random(12)
    items = [(k, " ".join(sample_words(rng, rng.randrange(12, 40)))) for k in range(6)]
    docs, want = [], set()
    for d in range(40):
        words = sample_words(rng, 80)
        if d % 2:
            k = rng.randrange(6)
            copy = items[k][1].split()
            for _ in range(len(copy) // 5):
                i = rng.randrange(len(copy))
                copy[i : i + 1] = rng.choice([[], ["changed"], [copy[i], "added"]])
            at = rng.randrange(80)
            words[at:at] = copy
            want.add((d, k))
        docs.append((d, " ".join(words).upper() if d % 4 == 1 else " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([*items, (None, "x"), (77, None), (78, "too short")], "item_id long, text string")
    found = decontaminate.leaks(frame, tests, block_words=block_words).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(frame, tests).collect()) == [d for d in range(40) if not d % 2]
    assert decontaminate.leaks(frame, tests.limit(0)).count() == 0


@pytest.mark.parametrize("edits", [0, 3, 6, 10])
def test_every_copy_within_the_bound_is_found(spark, edits):
    """Replaced words up to a quarter of an item, wherever they are; n-grams of the broken places occur nowhere."""
    rng = random.Random(edits)
    item = sample_words(rng, 40)
    docs = []
    for d in range(60):
        copy = list(item)
        for at in rng.sample(range(40), edits):
            copy[at] = f"zz{rng.randrange(10**6)}"
        docs.append((d, " ".join([*sample_words(rng, 30), *copy, *sample_words(rng, 30)])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.leaks(frame, tests).collect()} == set(range(60))


def test_short_items_are_found_whole(spark):
    rows = [(1, "x One two three, four five six seven! y"), (2, "one two three four five six"), (3, "one two three four and five six seven"), (4, "a b c"), (5, "a b d c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("taken")).withColumn("score", F.lit("taken"))
    tests = spark.createDataFrame([(7, "one two three four five six seven"), (8, "a b c"), (9, "y")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, tests).collect()} == {(1, 7), (4, 8)}


# --- 10: toxicity ---


def test_toxicity_on_held_out_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    marks = common.table(spark, "/root/testdata/sf0.01", "labels")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    held = [(r["toxic"], found[r["doc_id"]]) for r in marks.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(f["held_out"] for _, f in held)
    assert np.mean([f["predicted"] == y for y, f in held]) >= 0.9
    assert sum(f["predicted"] for y, f in held if y) > sum(y for y, _ in held) / 2


def test_toxicity_without_labels(spark):
    found = toxicity.toxicity(awkward(spark), labels(spark)).collect()
    assert len(found) == 10 and {r["score"] for r in found} == {0.0}


def test_the_compressed_lengths_do_the_work(spark):
    """With dictionaries that do not tell toxic from ordinary text the same model finds little."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    marks = common.table(spark, "/root/testdata/sf0.01", "labels")
    rows = [(r["text"], r["toxic"]) for r in toxicity.training_rows(docs, marks).orderBy("toxic", "place", "doc_id").collect()]
    held = marks.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").join(docs.select("doc_id", "text"), "doc_id").collect()

    def found(model):
        lengths = toxicity.Lengths(model["toxic"], model["ordinary"])
        x = np.array([toxicity._features(toxicity._words(r["text"]), lengths, model["odds"]) for r in held])
        hit = x @ model["weights"][:-1] + model["weights"][-1] >= 0
        return sum(h for h, r in zip(hit, held) if r["toxic"]) / max(1, sum(r["toxic"] for r in held))

    model = toxicity.fit(rows)
    assert found(model) >= 0.5 + found(model | {"toxic": model["ordinary"]})


# --- awkward input and the pipeline ---


def test_operators_take_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, "some words that nobody has in a text of this table")], "item_id long, text string")
    marks = labels(spark, [(2, 1, 0), (5, 1, 1), (6, None, None), (None, 1, 1)])
    for rows in (docs, docs.limit(0)):
        n = rows.count()
        assert toxicity.toxicity(rows, marks).count() == n
        assert languages.language_id(rows).count() == n
        assert simhash.simhash(rows).count() == n
        assert lines.line_dedup(rows).count() == n
        assert mixing.mixed_documents(rows).count() == n
        assert decontaminate.leaks(rows, bench).count() == 0
        assert passages.repeated_passages(rows).count() == 0
    got = {r["doc_id"]: r["lang_pred"] for r in languages.language_id(docs).collect()}
    assert got[1] == got[2] == got[3] == got[8] == "und" and got[7] != "und"


def test_one_id_may_have_several_texts(spark):
    shared = " ".join(f"w{i}" for i in range(80))
    rows = [(1, f"a b c d e {shared}"), (1, f"q r s t u v {shared}"), (2, f"z {shared} y"), (2, f"z {shared} y"), (3, None), (None, shared)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["rep_doc_id"], r["last_word"] - r["first_word"]) for r in found) == [(1, 1, 79), (2, 1, 79)]


def test_pages_of_any_markup_are_read_in_linear_time():
    import time

    for bad in ("<a " * 150_000, "<a x=\"" * 80_000, "<a \"<b '>" * 60_000, "<div>" * 100_000 + "x", "<" * 400_000, "<!" * 100_000, "<div>x" * 20_000):
        start = time.time()
        htmltext.main_text(bad)
        assert time.time() - start < 5
    deep = "<div>" * 900 + "<nav>menu</nav><p>The text, of the page.</p>" + "</div>" * 900
    assert htmltext.main_text(deep) == "The text, of the page."


def test_article_text_is_kept_under_any_class_name():
    page = ("<body><div class='nav-links'><a href=x>One</a></div><article><p class='alert-fatigue-study'>Alarms, and who hears them.</p><figure class='share-price'>"
            "<figcaption>The price, in 2024.</figcaption></figure><div class='ad-box'>Buy now, today!</div><p>A last line, of text.</p></article></body>")
    assert htmltext.main_text(page) == "Alarms, and who hears them.\nThe price, in 2024.\nA last line, of text."


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    marks, bench = labels(spark, [(2, 1, 0), (5, 1, 1)]), spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = awkward(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns if k < 4 else set(docs.columns) < set(out.columns)
        docs = out
    assert docs.count() <= 10


def test_pipeline_keeps_what_its_stages_should(spark):
    docs, marks, bench = (common.table(spark, FOLDER, n) for n in ("documents", "labels", "benchmark"))
    stages = {}
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = common.settled(stage(spark, rows, FOLDER), f"test-{name}")
        stages[name] = {r["doc_id"]: r for r in rows.collect()}
    ids = lambda found: set(found)
    whole = {r["doc_id"] for r in docs.collect()}
    # toxicity: what the operator predicts goes, and nothing else
    assert whole - ids(stages["toxicity"]) == {r["doc_id"] for r in toxicity.toxicity(docs, marks).where("predicted = 1").collect()}
    # line dedup: all documents stay, no line comes twice
    assert ids(stages["line_dedup"]) == ids(stages["toxicity"])
    kept = spark.createDataFrame([r for r in stages["line_dedup"].values()], docs.schema)
    assert lines.line_dedup(kept).where("n_repeats > 0").count() == 0
    # near dedup: the one of each component that stays is its smallest
    classes = {r["doc_id"]: r["component_id"] for r in simhash.simhash(kept, words=3, radius=3).collect()}
    assert ids(stages["simhash_near_dedup"]) == set(classes.values())
    # decontamination: what holds an item goes, and nothing else
    held = kept.where(F.col("doc_id").isin(*ids(stages["simhash_near_dedup"])))
    assert ids(stages["simhash_near_dedup"]) - ids(stages["decontamination"]) == {r["doc_id"] for r in decontaminate.leaks(held, bench).collect()}
    # mixing: the operator's selection
    clean = held.where(F.col("doc_id").isin(*ids(stages["decontamination"])))
    assert ids(stages["mixing"]) == {r["doc_id"] for r in mixing.mixed_documents(clean).where("selected").collect()}
    assert stages["mixing"] and {r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()} == ids(stages["mixing"])


def test_all_queries_and_the_pipeline_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
