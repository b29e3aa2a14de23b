"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines (trimmed, in lower case) of at least `min_chars` characters are equal by hash, or near when at most `edits` edits apart. Of two
near lines the shorter one, cut into edits + 1 segments, has a segment that the longer one holds in full, close to the same place. So each
line is indexed under its own segments and probes, for every length it may meet, the few substrings a segment can have been shifted to.
What meets under one key is verified by a banded bit-parallel edit distance. Equal and near lines form classes (connected
components); the first line of a class in order of (doc_id, line number) stays, the others are repeats.

Texts are not moved to find candidates: an index row is two numbers. A line that makes up more than a thousandth of all lines (there are fewer
than a thousand such) enters the index from its first place only. A large group of near lines is not paired off: each first meets one
line per key, and only lines whose classes are still different after that are compared with one another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import components, fresh, settled

EDITS, MIN_CHARS, HOT_SHARE = 2, 20, 1000
LETTERS = "etaonisrhdlu"


def edit_distance(longer: Column, shorter: Column, edits: int = EDITS) -> Column:
    """Edit distance of two strings if it is at most `edits`, else some number above. `longer` is not the shorter string.

    Bits of a word stand for the 2 * edits + 1 cells of a column that lie in the band around the diagonal; one step takes
    all of them to the next column (vertical differences plus and minus, shifted along the diagonal). Only the diagonal on which the
    last cell lies is summed up: it grows by one wherever its cell does not continue for free.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    above = (1 << edits) - 1
    long = lambda v: F.lit(v).cast("long")

    def of(pair: Column) -> Column:
        p, t, off = pair.p, pair.t, pair.off

        def diagonal(word: Column) -> Column:
            """The bit of the diagonal the last cell lies on."""
            return F.call_function("shiftright", word, off + edits).bitwiseAND(long(1))

        def step(s: Column, j: Column) -> Column:
            bits = [F.when(F.get(p, j + (b - edits)) == F.get(t, j), long(1 << b)).otherwise(long(0)) for b in range(width)]
            # Arrays of one element name what is used twice; an inlined expression would be evaluated again at every use.
            first = F.transform(F.array(reduce(lambda x, y: x + y, bits)), lambda e: F.struct(
                (((e.bitwiseAND(s.vp) + s.vp).bitwiseXOR(s.vp)).bitwiseOR(e).bitwiseOR(s.vn)).bitwiseAND(long(mask)).alias("d0")
            ))
            second = F.transform(first, lambda w: F.struct(
                w.d0.alias("d0"), F.shiftright(w.d0, 1).alias("x"), w.d0.bitwiseAND(s.vp).alias("hn"),
                s.vn.bitwiseOR(F.bitwise_not(w.d0.bitwiseOR(s.vp)).bitwiseAND(long(mask))).alias("hp"),
            ))
            third = F.transform(second, lambda w: F.struct(
                w.hn.bitwiseOR(F.bitwise_not(w.x.bitwiseOR(w.hp)).bitwiseAND(long(mask))).alias("vp"),
                w.x.bitwiseAND(w.hp).alias("vn"), (s.d + 1 - diagonal(w.d0)).alias("d"),
            ))
            return F.when(s.d > edits, s).otherwise(F.get(third, F.lit(0)))

        start = F.struct(long(mask ^ above).alias("vp"), long(above).alias("vn"), off.cast("long").alias("d"))
        columns = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(columns, start, step, lambda s: s.d)

    def chars(text: Column) -> Column:
        return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))

    off = F.length(longer) - F.length(shorter)
    # Split once per pair: the arrays are bound to a name.
    pair = F.array(F.struct(chars(longer).alias("p"), chars(shorter).alias("t"), off.alias("off")))
    return F.when(off > edits, long(edits + 1)).otherwise(F.get(F.transform(pair, of), F.lit(0)))


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, doc, line_no, line, h1, h2): the lines long enough to count. doc is a hash of id and text."""
    doc = F.xxhash64("doc_id", "text").alias("doc")
    rows = docs.select("doc_id", doc, F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    rows = rows.select("doc_id", "doc", "line_no", F.lower(F.trim("raw")).alias("line")).where(F.length("line") >= min_chars)
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(1))})


def _keys(line: Column, length: Column, edits: int) -> Column:
    """Keys of a line: its edits + 1 own segments first, then all other probes; NULL where one would reach beyond the line."""
    own, probes = [], []
    for less in range(edits + 1):
        short = length - less
        for i in range(edits + 1):
            begin = F.floor(short * i / (edits + 1)).cast("int")
            size = F.floor(short * (i + 1) / (edits + 1)).cast("int") - begin
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                at = begin + shift
                key = F.xxhash64(short * (edits + 1) + i, F.substring(line, at + 1, size))
                if less == 0 and shift == 0:
                    own.append(key)
                else:
                    probes.append(F.when((at >= 0) & (at + size <= length), key))
    return F.array(*own, *probes)


def _lines_with(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, h1, h2, line) of the lines whose h is among the distinct ones of `wanted`.

    A bitmap of 2^27 places of the wanted hashes (16 MB at most, whatever their number) goes to the lines first, so that hardly any
    line that is not wanted is shuffled; the join behind it is exact.
    """
    place = lambda h: F.pmod(h, F.lit(1 << 27))
    bitmap = wanted.select(place(F.col("h")).alias("p")).groupBy(F.shiftright("p", 15).alias("part")).agg(
        F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("bits"))
    half = lines.select(F.shiftright("h1", 1).alias("h"), "h1", "h2", "line").withColumn("p", place(F.col("h")))
    met = half.withColumn("part", F.shiftright("p", 15)).join(F.broadcast(bitmap), "part")
    bit = F.col("p").bitwiseAND(32767).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, bit.bitwiseAND(7)).bitwiseAND(1) == 1
    # Not a semi join: that would be pushed below the bitmap, and all lines would be shuffled after all.
    return met.where(hit).select("h", "h1", "h2", "line").join(wanted, "h")


def near_lines(docs: DataFrame, firsts: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Verified pairs (a1, a2, b1, b2) of hashes of different lines at most `edits` edits apart: not all, but enough that the classes
    (connected components) are those of all pairs."""
    lines = lines_of(docs, min_chars)
    total = firsts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(firsts.where(F.col("n") > total / HOT_SHARE + 1).select("h1", "h2", F.col("first").alias("only")))
    place = F.struct("doc_id", "doc", "line_no")
    once = lines.join(hot, ["h1", "h2"], "left").where(F.col("only").isNull() | (F.col("only") == place))
    # An array of its own, and the outer form: the plain one is computed without sharing `length` between the keys, at twice the time.
    keyed = once.withColumn("len", F.length("line")).select("h1", _keys(F.col("line"), F.col("len"), edits).alias("keys"))
    rows = keyed.select("h1", F.posexplode_outer("keys").alias("place", "key")).where("key is not null")
    packed = F.shiftleft(F.shiftright("h1", 1), 1).bitwiseOR(F.when(F.col("place") <= edits, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    index = rows.select("key", packed.alias("packed")).selectExpr(
        "key", "packed",
        "min(packed >> 1) over (partition by key) as low", "max(packed >> 1) over (partition by key) as high",
        "max(packed & 1) over (partition by key) as indexed",
    ).where("low < high and indexed = 1")
    met = settled(index.selectExpr("key", "packed >> 1 as h", "packed & 1 as i").distinct(), "shared-segments")
    # Only lines that met another one are fetched, and all that is compared for every candidate are letter counts.
    texts = settled(_lines_with(lines, met.select("h").distinct()).dropDuplicates(["h", "h1", "h2"]), "line-texts")
    counts = texts.groupBy("h").agg(
        F.first(F.array(*[F.length("line") - F.length(F.translate("line", c, "")) for c in LETTERS])).alias("n"),
        F.first(F.length("line")).alias("len"), (F.count(F.lit(1)) == 1).alias("sure"),
    )
    known = met.join(counts, "h")

    def alike(n: Column, m: Column) -> Column:
        """An edit changes two letter counts by one each."""
        return reduce(lambda v, w: v + w, [F.abs(n[k] - m[k]) for k in range(len(LETTERS))]) <= 2 * edits

    # First every line meets one line of each key only; all lines indexed under one key are equally long.
    pivots = known.where("i = 1").groupBy("key").agg(F.min(F.struct("h", "n", "sure")).alias("x"))
    star = known.join(pivots, "key").where((F.col("h") != F.col("x.h")) & alike(F.col("n"), F.col("x.n")))
    star = star.select(F.least("h", "x.h").alias("a"), F.greatest("h", "x.h").alias("b"), (F.col("sure") & F.col("x.sure")).alias("sure"))
    near = settled(_verified(star.distinct(), texts, edits), "near-pivots")
    # Then lines that are not in one class yet; a key with a single class has nothing left to find. Lines that share h have no class here.
    classes = components(near.where("sure")).select(F.col("node").alias("h"), "component")
    known = known.join(classes, "h", "left").withColumn("class", F.coalesce("component", "h")).drop("component", "sure")
    known = settled(known, "line-classes")
    open_ = known.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
    known = known.join(open_, "key")
    x, y = known.where("i = 1").alias("x"), known.alias("y")
    # Of equally long lines both are indexed.
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.class") != F.col("y.class")) & (F.col("y.len") - F.col("x.len") <= edits) & (
        (F.col("x.len") < F.col("y.len")) | ((F.col("x.len") == F.col("y.len")) & (
            (F.col("x.h") < F.col("y.h")) | ((F.col("y.i") == 0) & (F.col("x.h") != F.col("y.h")))))
    ) & alike(F.col("x.n"), F.col("y.n"))
    pairs = x.join(y, apart).select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b"), F.lit(True).alias("sure")).distinct()
    return near.unionByName(_verified(settled(pairs, "line-pairs"), texts, edits)).select("a1", "a2", "b1", "b2")


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) of `h` whose lines are at most `edits` edits apart, with the hashes of both lines."""
    left = texts.select(F.col("h").alias("a"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("la"))
    right = texts.select(F.col("h").alias("b"), F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("lb"))
    both = pairs.join(left, "a").join(right, "b")
    swap = F.length("la") < F.length("lb")
    longer, shorter = F.when(swap, F.col("lb")).otherwise(F.col("la")), F.when(swap, F.col("la")).otherwise(F.col("lb"))
    both = both.select("a", "b", "sure", "a1", "a2", "b1", "b2", longer.alias("p"), shorter.alias("t"))
    return both.where(edit_distance(F.col("p"), F.col("t"), edits) <= edits).drop("p", "t")


def repeats(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, doc, line_no) of every line that repeats an earlier one, equal or near; see `line_dedup`."""
    lines = settled(lines_of(docs, min_chars).select("doc_id", "doc", "line_no", "h1", "h2"), "line-places")
    place = F.struct("doc_id", "doc", "line_no")
    firsts = settled(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "lines")
    pairs = settled(near_lines(docs, firsts, edits, min_chars), "near-lines")
    name = lambda s: F.struct(F.col(s + "1").alias("h1"), F.col(s + "2").alias("h2"))
    classes = components(pairs.select(name("a").alias("a"), name("b").alias("b")))
    members = classes.select("node.h1", "node.h2", "component").join(firsts, ["h1", "h2"])
    leads = members.groupBy("component").agg(F.min("first").alias("lead"))
    near = members.join(leads, "component").select("h1", "h2", "lead")
    equal = firsts.where("n > 1").join(near.select("h1", "h2"), ["h1", "h2"], "left_anti").select("h1", "h2", F.col("first").alias("lead"))
    return lines.join(near.unionByName(equal), ["h1", "h2"]).where(F.col("lead") != place).select("doc_id", "doc", "line_no")


def line_dedup(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_repeats, repeats) for every row of `docs`; repeats holds ascending line numbers from 0.

    Rows equal in doc_id and text are one document and share their result. NULL texts have no lines; empty texts have one, too
    short to count. NULL ids come first in order. A document without repeats has an empty array, an empty table
    no rows. Other columns are not read.
    """
    rows = docs.select("doc_id", "text")
    found = repeats(rows, edits, min_chars).groupBy("doc_id", "doc").agg(F.sort_array(F.collect_set("line_no")).alias("repeats"))
    size = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    base = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), F.when(F.col("text").isNull(), 0).otherwise(size).alias("n_lines"))
    joined = base.alias("d").join(found.alias("f"), F.expr("d.doc = f.doc and d.doc_id <=> f.doc_id"), "left")
    none = F.array().cast("array<int>")
    return joined.select(
        "d.doc_id", "n_lines", F.coalesce(F.size("repeats"), F.lit(0)).alias("n_repeats"), F.coalesce("repeats", none).alias("repeats")
    ).withColumn("n_repeats", F.greatest("n_repeats", F.lit(0)))


def drop_repeats(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` with repeated lines taken out of text (and n_chars, if there, counted anew); every row stays."""
    found = repeats(docs.select("doc_id", "text"), edits, min_chars)
    found = found.groupBy("doc_id", "doc").agg(F.collect_set("line_no").alias("repeats"))
    doc = fresh("doc", docs.columns)
    gone = fresh("repeats", docs.columns)
    found = found.select(F.col("doc_id").alias("_id"), F.col("doc").alias("_doc"), F.col("repeats").alias(gone))
    keyed = docs.withColumn(doc, F.xxhash64("doc_id", "text"))
    joined = keyed.join(found, (keyed[doc] == found["_doc"]) & keyed["doc_id"].eqNullSafe(found["_id"]), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    out = joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
