"""The registered queries of this folder. Each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_packing, decontaminate, jaccard_join, materialize, packing, quality_crf, quality_rules, ranked_search, spelling, suffix_dedup, token_counts, tokens, toxicity, url_filter
from .common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

END_OF_TEXT = 49407
ORDER_KEY = 20240229
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_url_filter(spark, sf):
    """Verdict of every page's url."""
    return url_filter.filter_urls(table(spark, sf, "pages").select("page_id", "url"), URL_RULES)


@query
def op8_best_two_fit(spark, sf):
    """Place of every piece of every document in sequences of 2048 tokens."""
    return packing.packed_documents(documents(spark, sf), tokens.default_path())


@query
def op10_quality_rules(spark, sf):
    """Base counts and verdict of every document, by limits from the tails of the sketches of its language and source."""
    return quality_rules.adaptive_rules(documents(spark, sf))


@query
def op10_quality_rules_slack(spark, sf):
    """Base counts and verdict of every document, by limits that lie a fixed slack from the median at least."""
    return quality_rules.quality_rules(documents(spark, sf))


@query
def op10_quality_rules_tails(spark, sf):
    """The same as `op10_quality_rules`, under its earlier name."""
    return op10_quality_rules(spark, sf)


@query
def op3_suffix_dedup(spark, sf):
    """What is left of every document without byte strings of 50 that an earlier one holds."""
    return suffix_dedup.dedup(documents(spark, sf))


@query
def op2_ngram_jaccard(spark, sf):
    """Component of every document under links of 4-word shingle sets at Jaccard 0.85."""
    return jaccard_join.join_documents(documents(spark, sf))


@query
def op1_quality_crf(spark, sf):
    """Quality score of every document, learnt from three quarters of the labels."""
    docs = documents(spark, sf)
    return quality_crf.classify(docs, quality_crf.fit(docs, table(spark, sf, "labels")))


@query
def op5_toxicity_grammar(spark, sf):
    """Toxicity score of every document, learnt from four fifths of the labels."""
    docs = documents(spark, sf)
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf, "labels")))


@query
def op4_string_tiling(spark, sf):
    """Documents that hold a benchmark item, in whatever order, with the items."""
    found = decontaminate.contaminated_pairs(documents(spark, sf), table(spark, sf, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))


@query
def op7_token_counts(spark, sf):
    """Tokens of every document, counted from flat streams."""
    return token_counts.document_counts(documents(spark, sf), tokens.default_path(), END_OF_TEXT)


@query
def op9_training_order(spark, sf):
    """Every sequence of 2048 tokens at its place in training order."""
    return materialize.ordered_documents(documents(spark, sf), tokens.default_path(), ORDER_KEY, end=END_OF_TEXT)


@query
def op12_binary_packing(spark, sf):
    """Every piece of every document in sequences of a power of two of tokens, 2048 at most."""
    return binary_packing.binary_sequences(documents(spark, sf), tokens.default_path("byte_bpe_50k.json"))


@query
def op13_spelling_variants(spark, sf):
    """Every word with its more frequent neighbour, and the root that such neighbours lead to."""
    return spelling.group_variants(documents(spark, sf))


@query
def op11_ranked_search(spark, sf):
    """The 20 documents that rank highest for every benchmark item."""
    return ranked_search.search(documents(spark, sf), table(spark, sf, "benchmark"))
