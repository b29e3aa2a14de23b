"""Spelling variants: words one edit apart, found with PartEnum signatures of their letters.

A word's multiset of letters is a binary vector: one place for each letter and how often it has come up. Replacing a code point
changes two places, inserting or deleting one changes one, so words one edit apart have vectors of Hamming distance at most two. The
letters are dealt to `parts` parts; a distance of two touches at most two parts, so all others agree, and a word signs every choice of
`parts` - 2 parts with a hash of its letters there. Words of one length need this; between neighbouring lengths the distance is one and choices of
`parts1` - 1 parts do. Words that share a signature, and the length it is for, meet in an equality join and are verified by their edit distance.

Signatures are exact: no two near words are missed. Letters are dealt so that parts carry about equal numbers of letters.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import settled

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
SLIP, LEAST_CHARS, LEAST_TIMES, TIMES, PARTS, PARTS1 = 199, 6, 5, 5, 8, 4


def word_counts(docs: DataFrame, slip: int = SLIP, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n): runs of letters in lower case, with a slip of the pen in about one in `slip` of them, that are frequent and long enough.

    Where `slip` divides the crc32 of `<doc_id>:<run>`, the run loses the code point at that hash modulo its length. A NULL doc_id is
    an empty string there.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    runs = runs.select("run", h.alias("h"), F.length("run").alias("len"))
    at = (F.col("h") % F.col("len")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("len")))
    words = runs.select(F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_times)


def letter_weights(words: DataFrame) -> dict[str, int]:
    """How often the words hold each letter."""
    row = words.agg(*[F.sum(F.length("word") - F.length(F.translate("word", c, ""))).alias(f"n{i}") for i, c in enumerate(LETTERS)]).first()
    return {c: row[i] or 0 for i, c in enumerate(LETTERS)}


def deal_letters(weights: dict[str, int], parts: int) -> list[str]:
    """The letters in `parts` groups of about equal weight."""
    groups, load = [""] * parts, [0] * parts
    for weight, letter in sorted(((n, c) for c, n in weights.items()), key=lambda p: (-p[0], p[1])):
        lightest = min(range(parts), key=lambda g: (load[g], len(groups[g]), g))
        groups[lightest] += letter
        load[lightest] += weight
    return groups


def _signatures(groups: list[str], distance: int, tag: Column) -> Column:
    """One hash per choice of all but `distance` groups, of the letters a word has there; `tag` goes into all of them."""
    # The hash of a multiset is the sum of its letters' hashes; `_of<k>` holds that of the k-th group.
    held = [F.col(f"_of{len(groups)}_{g}") for g in range(len(groups))]
    chosen = combinations(range(len(groups)), len(groups) - distance)
    return F.array(*[F.xxhash64(F.lit(distance * 1000 + k), tag, *[held[g] for g in choice]) for k, choice in enumerate(chosen)])


def _part_hashes(word: Column, groups: list[str]) -> dict[str, Column]:
    out = {}
    for g, letters in enumerate(groups):
        rest = "".join(c for c in LETTERS if c not in letters)
        inside = F.array_sort(F.split(F.translate(word, rest, ""), ""))
        out[f"_of{len(groups)}_{g}"] = F.xxhash64(F.array_join(inside, ""))
    return out


def near_words(words: DataFrame, parts: int = PARTS, parts1: int = PARTS1) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of words exactly one edit apart, each once, with a < b where they are equally long and a the shorter one else."""
    weights = letter_weights(words)
    two, one = deal_letters(weights, parts), deal_letters(weights, parts1)
    length = F.length("word")
    rows = words.withColumns(_part_hashes(F.col("word"), two) | _part_hashes(F.col("word"), one))
    # side 0: may be the first of a pair, 1: the second, 2: either.
    same = F.transform(_signatures(two, 2, length), lambda s: F.struct(s.alias("sign"), F.lit(2).alias("side")))
    short = F.transform(_signatures(one, 1, length + 1), lambda s: F.struct(s.alias("sign"), F.lit(0).alias("side")))
    long = F.transform(_signatures(one, 1, length), lambda s: F.struct(s.alias("sign"), F.lit(1).alias("side")))
    signed = rows.select("word", "n", F.explode(F.concat(same, short, long)).alias("s")).select("word", "n", "s.sign", "s.side")
    a = signed.where("side <> 1").select("sign", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("side").alias("side_a"))
    b = signed.where("side <> 0").select("sign", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("side").alias("side_b"))
    met = a.join(b, "sign").where(
        ((F.col("side_a") == 2) & (F.col("side_b") == 2) & (F.col("a") < F.col("b"))) | ((F.col("side_a") == 0) & (F.col("side_b") == 1))
    )
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b").distinct()


def variants(docs: DataFrame, times: int = TIMES, slip: int = SLIP, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of `docs` that is long and frequent enough.

    n_near counts the words exactly one edit away. form is the most frequent of them (ties: the smallest in code-point order), if it
    is at least `times` as frequent as the word; root is where following forms from the word ends. NULL and empty texts have no
    words, repeated rows count as often as they stand there, and an empty table or one without such words gives no rows. Only doc_id and text
    are read.
    """
    words = settled(word_counts(docs.select("doc_id", "text"), slip, least_chars, least_times), "words")
    pairs = settled(near_words(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    # The least of (-n, word) is the most frequent near word, the smallest by code points among equals.
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")
    frequent = -F.col("best.m") >= F.lit(times) * F.col("n")
    rows = settled(rows.select(
        "word", "n", "n_near", F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.m")).alias("form_n")
    ), "forms")
    # Pointers are doubled until all stand at an end; a form is `times` as frequent as its word, so chains are short and have no cycles.
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settled(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    result = rows.join(links, "word", "left")
    return result.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
