"""From retrieved chunks to an answer: bounded snippets, prompts, the extractive answer, the grounding guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citation, collapse, has_citation, let, overlap, sentences, terms, tokens

# The answer that says nothing, and the fields of a citation.
NOT_FOUND = "NOT_FOUND"
BASE_FIELDS = ["source_path", "year_month", "chunk_id"]
METADATA_FIELDS = ["source_path", "year_month", "heading", "chunk_id"]
MAX_CONTEXT_CHARS = 10_000
TERM_CHARS, MAX_SENTENCES, SNIPPET_WORDS = 2, 2, 80
EMPTY_CONTEXT = "(nothing was found)"
SYSTEM_PROMPT = (
    "You are given numbered excerpts, headed [S1], [S2] and so on, and a question.\n"
    "1. Each statement of your reply ends with the label of the excerpt that it rests on, like [S2].\n"
    "2. Figures are copied digit by digit. A figure that you work out comes with its arithmetic.\n"
    "3. Two or three sentences are enough.\n"
    "4. Where the excerpts don't settle the question, the whole reply is " + NOT_FOUND + "."
)


def snippets(hits: DataFrame, budget: int = MAX_CONTEXT_CHARS, fields: list[str] = BASE_FIELDS, question_col: str = "question_id") -> DataFrame:
    """question, rank, label, text, citation: retrieved texts in order of rank, clipped to a budget of characters.

    hits: question, rank, text and the fields. Labels count blank texts too; blank ones and those past the budget are
    left out. The running sum is over a question's hits, k at most.
    """
    clean = collapse(F.coalesce("text", F.lit("")))
    before = Window.partitionBy(question_col).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = hits.withColumn("_clean", clean).withColumn("_used", F.coalesce(F.sum(F.length("_clean")).over(before), F.lit(0)))
    left = F.lit(max(0, budget)) - F.col("_used")
    have = set(hits.columns)
    get = lambda f: F.col(f) if f in have else F.lit(None).cast("string")
    return used.filter((F.col("_clean") != "") & (left > 0)).select(
        question_col, "rank", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("label"), F.substring("_clean", F.lit(1), left.cast("int")).alias("text"), citation(fields, get).alias("citation")
    )


def context_blocks(snips: DataFrame, question_col: str = "question_id") -> DataFrame:
    """question, context: its snippets in order, each under its label and citation, blank lines between."""
    line = F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col("citation"), F.lit("\n"), F.col("text"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return snips.groupBy(question_col).agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n\n").alias("context"))


def messages(question: Column, context: Column) -> Column:
    """array of struct(role, content): the system's and the user's message."""
    user = F.concat(F.lit("# Excerpts\n\n"), F.coalesce(context, F.lit(EMPTY_CONTEXT)), F.lit("\n\n# Question\n\n"), question)
    make = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(make("system", F.lit(SYSTEM_PROMPT)), make("user", user))


def extractive(hits: Column, question: Column, most: int = MAX_SENTENCES) -> Column:
    """The sentences that share most words with the question, cited; NOT_FOUND without hits.

    hits: array of struct(rank, text) in order of rank. Sentences sort by shared words, then source, then length,
    then place.
    """

    def ranked(wanted: Column) -> Column:
        def of(hit: Column) -> Column:
            place = lambda s, i: F.struct((-overlap(wanted, terms(s))).alias("o"), hit["rank"].alias("r"), F.length(s).alias("l"), i.alias("i"), s.alias("s"))
            return F.transform(sentences(F.coalesce(hit["text"], F.lit(""))), place)

        return F.slice(F.array_sort(F.flatten(F.transform(hits, of))), 1, most)

    cite = lambda best: F.when(F.size(best) > 0, F.array_join(F.transform(best, lambda x: F.concat(x["s"], F.lit(" [S"), x["r"].cast("string"), F.lit("]"))), " "))
    cited = let(let(terms(question, TERM_CHARS), ranked), cite)
    first = F.array_join(F.slice(tokens(F.coalesce(F.get(hits, F.lit(0))["text"], F.lit(""))), 1, SNIPPET_WORDS), " ")
    fallback = F.when(first != "", F.concat(first, F.lit(" [S1]"))).otherwise(NOT_FOUND)
    return F.when(F.coalesce(F.size(hits), F.lit(0)) < 1, NOT_FOUND).otherwise(F.coalesce(cited, fallback))


def guard(answer: Column, fallback: Column, require_citations: bool = True, use_fallback: bool = True) -> Column:
    """Empty answers and NOT_FOUND in any case become NOT_FOUND; so do answers without a citation, or the fallback."""
    clean = collapse(F.coalesce(answer, F.lit("")))
    bad = (clean == "") | F.upper(clean).startswith(NOT_FOUND)
    uncited = ~has_citation(clean) if require_citations else F.lit(False)
    return F.when(bad, NOT_FOUND).when(uncited, fallback if use_fallback else F.lit(NOT_FOUND)).otherwise(clean)


def collect_hits(hits: DataFrame, columns: list[str], question_col: str = "question_id") -> DataFrame:
    """question, hits: array of struct(rank, columns) in order of rank; k at most for a question."""
    return hits.groupBy(question_col).agg(F.sort_array(F.collect_list(F.struct("rank", *columns))).alias("hits"))
