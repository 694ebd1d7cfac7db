"""Full-text search over documents `(repo_id, path, content)`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.paths import col
from repoquarry.functions.rows import unfold
from repoquarry.operators.skew import first_rows, spread_join


def terms_of(text: Column | str) -> Column:
    """Array of the lower-cased words of a text."""
    words = F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+", -1)
    return F.array_remove(words, "")


def _equals(term: str):
    return lambda word: word == term


def term_counts(text: Column | str) -> Column:
    """Array of (term, tf) of a text: its words sorted, then the lengths of the runs of equal ones."""
    words = F.sort_array(terms_of(text))

    def runs(sorted_words: Column) -> Column:
        size = F.size(sorted_words)
        starts = F.filter(
            F.sequence(F.lit(1), size), lambda i: (i == 1) | (F.element_at(sorted_words, i) != F.element_at(sorted_words, F.greatest(i - 1, F.lit(1))))
        )

        def run(bounds: Column, k: Column) -> Column:
            end = F.coalesce(F.try_element_at(bounds, k + 2), size + 1)
            return (end - F.element_at(bounds, k + 1)).cast("bigint")

        # A one-element array binds the starts, so they are found once.
        return F.transform(
            F.array(starts),
            lambda bounds: F.transform(
                bounds, lambda start, k: F.struct(F.element_at(sorted_words, start).alias("term"), run(bounds, k).alias("tf"))
            ),
        )[0]

    none = F.array().cast("array<struct<term: string, tf: bigint>>")
    return F.transform(F.array(words), lambda w: F.when(F.size(w) == 0, none).otherwise(runs(w)))[0]


def term_index(docs: DataFrame) -> DataFrame:
    """Inverted index `(repo_id, term, path, tf)`.

    A document is one row, so its terms are counted inside the row: no word is ever shuffled. Write the result
    range-partitioned by (repo_id, term) to serve searches.
    """
    counted = unfold(docs, ["repo_id", "path"], term_counts("content"), "found")
    return counted.select("repo_id", "found.term", "path", "found.tf")


def search_docs(docs: DataFrame, terms: list[str], k: int = 10, index: DataFrame | None = None) -> DataFrame:
    """`(repo_id, rank, path, score)`: top k documents per repository by summed tf * ln(1 + documents / df).

    Without a stored index only the wanted terms are kept while the texts are split.
    """
    wanted = sorted({t.lower() for t in terms})
    if index is None:
        # Counted inside the row of the document; only (term, tf) of the wanted terms leaves it.
        def count(words: Column) -> Column:
            found = [F.struct(F.lit(t).alias("term"), F.size(F.filter(words, _equals(t))).cast("bigint").alias("tf")) for t in wanted]
            return F.filter(F.array(*found), lambda f: f["tf"] > 0)

        kept = F.filter(terms_of("content"), lambda w: w.isin(wanted))
        hits = F.transform(F.array(kept), count)[0]
        postings = unfold(docs, ["repo_id", "path"], hits, "hit").select("repo_id", "path", "hit.*")
    else:
        postings = index.filter(F.col("term").isin(wanted))
    sizes = docs.groupBy("repo_id").agg(F.count("*").alias("documents"))
    # One row per wanted term and repository, however many postings a term has.
    weights = postings.groupBy("repo_id", "term").agg(F.count("*").alias("df")).join(sizes, "repo_id")
    weights = weights.select("repo_id", "term", F.log1p(F.col("documents") / F.col("df")).alias("idf"))
    scored = spread_join(postings, weights, ["repo_id", "term"], "path").groupBy("repo_id", "path")
    scores = scored.agg(F.round(F.sum(F.col("tf") * F.col("idf")), 6).alias("score"))
    return first_rows(scores, ["repo_id"], [F.desc("score"), F.asc("path")], k)
