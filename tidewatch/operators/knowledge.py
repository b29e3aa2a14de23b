"""Knowledge documents and their match with statements."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions.structure import statement_parts
from tidewatch.functions.text import contains_text, mask_sql, unnest

_GRAM = 3


def search_terms(sql: Column, tables: Column) -> Column:
    """Lower-case tables and keywords of a statement, each once, sorted."""
    upper = F.upper(sql)
    words = F.array_compact(F.array(*[F.when(F.contains(upper, F.lit(k)), F.lit(k)) for k in K.SQL_KEYWORDS]))
    found = F.array_sort(F.array_distinct(F.transform(F.concat(tables, words), F.lower)))
    return F.coalesce(found, F.array().cast("array<string>"))


def _grams(text: Column, least: int) -> Column:
    """All distinct substrings of `least` to three characters."""
    def of(n):
        spots = F.sequence(F.lit(1), F.length(text) - (n - 1))
        return F.when(F.length(text) >= n, F.transform(spots, lambda i: F.substring(text, i, F.lit(n))))

    return F.array_distinct(F.flatten(F.array_compact(F.array(*[of(n) for n in range(least, _GRAM + 1)]))))


def match_terms(terms: DataFrame, documents: DataFrame) -> DataFrame:
    """(term, id) where the tags of an enabled document contain the term.

    "Contains" is no equality, and comparing every term with every tag would be a cross join. A tag that contains a term also contains all its
    substrings of three characters (or the term itself, if it is shorter). So tags are indexed under their substrings, and a term looks under the
    one that the fewest tags have; what meets there is compared. A term with a substring that no tag has finds nothing. A common
    beginning of terms or tags is thus no hot key.
    """
    tagged = documents.filter(F.col("enabled")).select("id", F.lower("tags").alias("_tags"))
    # counting keeps the optimizer from merging the grouping with the one of the index
    tags = tagged.groupBy("_tags").agg(F.count(F.lit(1)).alias("_documents")).filter(F.col("_tags").isNotNull())
    index = unnest(tags.select("_tags", _grams(F.col("_tags"), 1).alias("_all")), "_all", "_gram", "_tags")
    sizes = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.length("term") < _GRAM, F.array("term")).otherwise(_grams(F.col("term"), _GRAM))
    wanted = unnest(terms.select("term", own.alias("_own")), "_own", "_gram", "term")
    rarest = (
        wanted.join(sizes, "_gram", "left").groupBy("term")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_least"))
        .filter(F.col("_least.n") > 0).select("term", F.col("_least.gram").alias("_gram"))
    )
    hits = rarest.join(index, "_gram").filter(F.contains("_tags", "term")).select("term", "_tags")
    return hits.join(tagged, "_tags").drop("_tags")


def _priority() -> Column:
    ranks = F.create_map(*[F.lit(x) for x in chain.from_iterable(K.CATEGORY_PRIORITY.items())])
    return F.coalesce(ranks[F.col("category")], F.lit(K.OTHER_PRIORITY))


def knowledge_rows(term_sets: DataFrame, documents: DataFrame) -> DataFrame:
    """(term_set, id, priority): the documents of each term set as rows, each once; for answers too large for one text."""
    terms = unnest(term_sets, "term_set", "term", "term_set")
    hits = match_terms(terms.select("term").distinct(), documents)
    pairs = terms.join(hits, "term").select("term_set", "id").distinct()
    return pairs.join(documents.select("id", _priority().alias("priority")), "id").select("term_set", "id", "priority")


def knowledge_texts(term_sets: DataFrame, documents: DataFrame, *, most: int | None = None) -> DataFrame:
    """(term_set, knowledge, documents_found) for distinct term sets.

    Documents are counted and, with `most`, ranked by priority and id as rows before any text is fetched; documents_found always counts all.
    """
    rows = knowledge_rows(term_sets, documents)
    found = rows.groupBy("term_set").agg(F.count(F.lit(1)).alias("documents_found"))
    if most is not None:
        first = Window.partitionBy("term_set").orderBy("priority", "id")
        rows = rows.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= most)
    texts = rows.join(documents.select("id", "category", "title", "content"), "id").select(
        "term_set", F.struct("priority", "id", "category", "title", "content").alias("doc"))
    blocks = F.transform(F.array_sort(F.collect_list("doc")), lambda d, i: F.concat(
        F.lit("**规则"), (i + 1).cast("string"), F.lit("** ["), d["category"], F.lit("]: "), d["title"],
        F.lit("\n> "), d["content"], F.lit("\n\n"),
    ))
    joined = texts.groupBy("term_set").agg(F.concat(F.lit(K.KNOWLEDGE_HEADER), F.array_join(blocks, "")).alias("knowledge"))
    return found.join(joined, "term_set")


def statement_terms(statements: DataFrame) -> DataFrame:
    """(sql_text, term_set) of the distinct texts, each analysed once."""
    # counting keeps the optimizer from merging the two groupings, so terms are searched once per distinct text
    texts = statements.groupBy("sql_text").agg(F.count(F.lit(1)).alias("_copies")).withColumn("_parts", statement_parts("sql_text"))
    return texts.select("sql_text", search_terms(F.col("sql_text"), F.col("_parts.refs.table")).alias("term_set"))


def join_knowledge(statements: DataFrame, documents: DataFrame, *, most: int | None = None) -> DataFrame:
    """Add the text of all matching documents (or the first `most`), by category priority, then id; empty without a match.

    Statements with the same tables and keywords share their text, so documents meet distinct term sets only.
    """
    keyed = statement_terms(statements)
    texts = knowledge_texts(keyed.groupBy("term_set").agg(F.count(F.lit(1)).alias("_texts")), documents, most=most)
    return (
        statements.join(keyed, "sql_text", "left").join(texts, "term_set", "left")
        .withColumn("knowledge", F.coalesce("knowledge", F.lit("")))
        .withColumn("documents_found", F.coalesce("documents_found", F.lit(0)))
        .drop("term_set")
    )


def build_manual_context(statements: DataFrame, documents: DataFrame) -> DataFrame:
    """Add the diagnosis context of statements entered by hand, with sensitive values masked.

    The context depends on the text alone, so each distinct text is searched, masked and put together once.
    """
    texts = statements.groupBy("sql_text").agg(F.count(F.lit(1)).alias("_copies")).select("sql_text")
    contexts = join_knowledge(texts, documents).select("sql_text", F.concat(
        F.when(F.col("knowledge") != "", F.concat("knowledge", F.lit("\n\n"))).otherwise(""),
        F.lit(K.STATEMENT_HEADER), mask_sql(F.col("sql_text")), F.lit("\n\n" + K.MANUAL_INSTRUCTION),
    ).alias("context"))
    return statements.join(contexts, "sql_text", "left")


def list_documents(documents: DataFrame, *, category=None, tag=None) -> DataFrame:
    """Enabled documents of a category, or with a tag that contains `tag`, or all."""
    found = documents.filter(F.col("enabled"))
    if category is not None:
        found = found.filter(F.col("category") == category)
    elif tag is not None:
        found = found.filter(contains_text(F.col("tags"), tag))
    return found.orderBy("category", "id")


def upsert_documents(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """The next snapshot. `changes` has the document columns, one row per id, and `action`: insert, update or delete.

    Left-out values get the defaults; an update of an unknown id and a delete change nothing else.
    """
    new = changes.select(
        "id", "action", F.col("title").alias("_title"), F.col("content").alias("_content"),
        F.coalesce("category", F.lit(K.DEFAULT_CATEGORY)).alias("_category"),
        F.coalesce("tags", F.lit("")).alias("_tags"), F.coalesce("enabled", F.lit(True)).alias("_enabled"),
    )
    old = documents.withColumn("_known", F.lit(True))
    both = old.join(new, "id", "full").filter(
        (F.col("action").isNull()) | ((F.col("action") == "update") & F.col("_known"))
        | ((F.col("action") == "insert") & F.col("_known").isNull())
    )
    kept = F.col("action").isNull()
    return both.select("id", *[
        F.when(kept, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
        for c in ("title", "content", "category", "tags", "enabled")
    ])
