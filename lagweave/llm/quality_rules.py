"""Quality rules with thresholds learnt per language and source from mergeable quantile sketches; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Metric -> (numerator, denominator, highest grid step). A value is the ratio in steps of 1/1000.
METRICS = {
    "word_length": ("word_chars", "n_words", 100_000),
    "symbols": ("1000 * n_symbols", "word_chars", 1_000_000),
    "dup_lines": ("1000 * n_dup_lines", "n_lines", 1_000_000),
    "repeats": ("1000 * n_repeat_words", "n_words", 1_000_000),
}


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _repeats(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more. hashes[i] is the window of words i .. i + 7.

    A window repeats if it equals a neighbour in sorted order; words covered are counted by the gaps between such windows' starts.
    """
    def covered(pairs):
        same = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
        again = F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1))
        starts = F.sort_array(F.transform(again, lambda x: x["p"]))
        return _let(starts, lambda s: F.aggregate(
            F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    paired = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    found = _let(F.sort_array(paired), covered)
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found).otherwise(F.lit(0)).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each whole text (null: all zero)."""
    text = docs.select("doc_id", "lang", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    hashes = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])))
    one = F.array(F.struct(words.alias("w"), lines.alias("l")))
    parts = F.transform(one, lambda x: F.struct(
        F.size(x["w"]).cast("long").alias("n_words"), F.size(x["l"]).cast("long").alias("n_lines"),
        (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines")))[0]
    return text.select(
        "doc_id", "lang", "source", parts.alias("p"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(hashes, _repeats).alias("n_repeat_words"),
    ).select("doc_id", "lang", "source", "p.n_words", "word_chars", "n_symbols", "p.n_lines", "p.n_dup_lines", "n_repeat_words")


def grid(metric: str) -> Column:
    """The metric as a whole step of its fixed grid, by integer division; 0 where it has no denominator."""
    num, den, top = METRICS[metric]
    if metric == "word_length":
        num = f"1000 * {num}"
    return F.expr(f"least(coalesce(({num}) div nullif({den}, 0), 0), {top})")


def sketch(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Counts of (group, metric, grid step): a quantile sketch whose merge is the sum of counts, the same in any order.

    Its size is bounded by the grid for each group. A quantile read from it is off by less than one step.
    """
    stacked = counts.select(*groups, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), grid(m).alias("step")) for m in METRICS])))
    return stacked.groupBy(*groups, "metric", "step").agg(F.count("*").alias("n"))


def merged(finer: DataFrame, groups: list[str]) -> DataFrame:
    return finer.groupBy(*groups, "metric", "step").agg(F.sum("n").alias("n"))


def quantiles(sk: DataFrame, groups: list[str], shares: dict[str, float]) -> DataFrame:
    """For each group and metric the lowest step at or below which at least this share of the rows lies, and the row count."""
    by = Window.partitionBy(*groups, "metric")
    upto = sk.withColumn("_upto", F.sum("n").over(by.orderBy("step"))).withColumn("_all", F.sum("n").over(by))
    return upto.groupBy(*groups, "metric").agg(
        F.max("_all").alias("n"), *[F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * q), F.col("step"))).alias(name) for name, q in shares.items()])


def thresholds(counts: DataFrame, least_rows: int, reach: int, slack: dict[str, int]) -> DataFrame:
    """One row per (lang, source): `low_word_length` and `high_<metric>`, inclusive limits in grid steps.

    A limit is the median plus (or minus) `reach` times the distance to the 75th (25th) percentile, at least the metric's slack.
    The slacks are wide: as long as a group's quartiles lie close together, they are what decides, as fixed cutoffs (see `tail_thresholds`).
    A (lang, source) with fewer than `least_rows` rows takes the limits of its language, and that of all rows if this is small
    too: the coarser sketches are merges of the finer ones.
    """
    fine = saved(sketch(counts, ["lang", "source"]), "sketch")
    shares = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    levels = [quantiles(fine, ["lang", "source"], shares), quantiles(merged(fine, ["lang"]), ["lang"], shares),
              quantiles(merged(fine, []), [], shares)]

    def limits(q: DataFrame, groups: list[str], tag: str) -> DataFrame:
        gap = F.create_map(*[x for m, s in slack.items() for x in (F.lit(m), F.lit(s))])[F.col("metric")]
        high = F.col("q50") + F.greatest(reach * (F.col("q75") - F.col("q50")), gap)
        low = F.col("q50") - F.greatest(reach * (F.col("q50") - F.col("q25")), gap)
        made = [F.max(F.when(F.col("metric") == m, high)).alias(f"high_{m}") for m in METRICS]
        made.append(F.max(F.when(F.col("metric") == "word_length", low)).alias("low_word_length"))
        return q.groupBy(*groups).agg(F.struct(F.max("n").alias("n"), *made).alias(tag))

    by_source, by_lang, whole = [limits(q, g, t) for q, g, t in zip(levels, (["lang", "source"], ["lang"], []), ("a", "b", "c"), strict=True)]
    lang = by_lang.withColumnRenamed("lang", "_lang")
    joined = by_source.join(lang, by_source["lang"].eqNullSafe(lang["_lang"]), "left").withColumn("_one", F.lit(1))
    joined = joined.join(whole.withColumn("_one", F.lit(1)), "_one", "left")
    pick = F.when(F.col("a.n") >= least_rows, F.col("a")).when(F.col("b.n") >= least_rows, F.col("b")).otherwise(F.col("c"))
    return joined.select("lang", "source", pick.alias("t")).select("lang", "source", "t.*").drop("n")


#: Smallest distance of a limit from the median, in grid steps: 2.5 characters a word; 5, 50 and 30 in a hundred.
SLACK = {"word_length": 2500, "symbols": 50, "dup_lines": 500, "repeats": 300}


def quality_rules(docs: DataFrame, least_rows: int = 200, reach: int = 6, slack: dict[str, int] = SLACK) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row of `docs` (doc_id, text, lang, source; further columns are left out).

    base_failed: fewer than 20 words, or over 30 in a hundred of them in repeated 8-word windows. kept: not base_failed, and
    each metric of METRICS within the limits of the row's (lang, source); see `thresholds`. Null lang or source is a group like any other. Null and
    empty texts have counts of 0 and fail. Rows equal in all columns are judged alike, each for itself; an empty table gives an empty result.
    The counts are worked out once and saved; a join attaches the limits, which AQE splits where one source is large.
    """
    counts = saved(base_counts(docs), "counts")
    return _judged(counts, thresholds(counts, least_rows, reach, slack))


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _judged(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows of `counts` with base_failed and kept; a (lang, source) without limits has none to keep to."""
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    both = counts.join(limits, counts["lang"].eqNullSafe(F.col("_lang")) & counts["source"].eqNullSafe(F.col("_source")), "left")
    inside = grid("word_length") >= F.col("low_word_length")
    for m in METRICS:
        inside = inside & (grid(m) <= F.col(f"high_{m}"))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _base_failed().alias("base_failed"),
                       (~_base_failed() & F.coalesce(inside, F.lit(True))).alias("kept"))


#: Share of a group's rows beyond each of its limits, and the smallest distance of a limit from the median, in grid steps.
TAIL, FLOOR = 0.01, 5
#: Sources that a language, or the table, needs for their middle distance to count.
VOTES = 3


def tail_thresholds(counts: DataFrame, least_rows: int, tail: float = TAIL, floor: int = FLOOR) -> DataFrame:
    """One row per (lang, source) of rows that pass the base rules: `low_word_length` and `high_<metric>`, inclusive limits in grid steps.

    A limit is the group's median plus (or minus) a distance, at least `floor`. The group's own distance is that of its 1 - `tail` (`tail`)
    quantile from its median; a group of fewer than `least_rows` rows takes both from the sketch of its language, and of all rows if this is
    small too. What counts is the middle one of this distance, the middle distance of the language's sources and that of all
    sources, where each source of `least_rows` rows has one vote, however many rows it has: a dirty source, even one that holds most
    rows, doesn't widen its own limits beyond what others have. Where fewer than VOTES sources vote, the next level's stands in.
    """
    fine = saved(sketch(counts.where(~_base_failed()), ["lang", "source"]), "sketch")
    shares = {"low": tail, "mid": 0.5, "high": 1 - tail}

    def level(sk: DataFrame, groups: list[str], tag: str) -> DataFrame:
        q = quantiles(sk, groups, shares)
        return q.select(*groups, "metric", F.struct("n", "mid", (F.col("high") - F.col("mid")).alias("up"), (F.col("mid") - F.col("low")).alias("down")).alias(tag))

    def votes(groups: list[str], tag: str) -> DataFrame:
        middle = [F.expr(f"percentile_disc(0.5) within group (order by a.{d})").cast("long").alias(d) for d in ("up", "down")]
        made = own.where(F.col("a.n") >= least_rows).groupBy(*groups, "metric").agg(F.count("*").alias("n"), *middle)
        return made.where(F.col("n") >= VOTES).select(*groups, "metric", F.struct("up", "down").alias(tag))

    own = level(fine, ["lang", "source"], "a")
    joined = own
    for part in (level(merged(fine, ["lang"]), ["lang"], "b"), level(merged(fine, []), [], "c"), votes(["lang"], "vb"), votes([], "vc")):
        part = part.withColumnRenamed("metric", "_metric")
        on = F.col("metric") == F.col("_metric")
        if "lang" in part.columns:
            part = part.withColumnRenamed("lang", "_lang")
            on = on & F.col("lang").eqNullSafe(F.col("_lang"))
        joined = joined.join(part, on, "left").drop("_metric", "_lang")

    pick = F.when(F.col("a.n") >= least_rows, F.col("a")).when(F.col("b.n") >= least_rows, F.col("b")).otherwise(F.col("c"))
    told = joined.select("lang", "source", "metric", pick.alias("p"), "vb", "vc")

    def distance(d: str) -> Column:
        mine, table = F.col(f"p.{d}"), F.coalesce(F.col(f"vc.{d}"), F.col(f"p.{d}"))
        three = F.sort_array(F.array(mine, F.coalesce(F.col(f"vb.{d}"), table), table))
        return F.greatest(three[1], F.lit(floor))

    made = [F.max(F.when(F.col("metric") == m, F.col("p.mid") + distance("up"))).alias(f"high_{m}") for m in METRICS]
    made.append(F.max(F.when(F.col("metric") == "word_length", F.col("p.mid") - distance("down"))).alias("low_word_length"))
    return told.groupBy("lang", "source").agg(*made)


def adaptive_rules(docs: DataFrame, least_rows: int = 200, tail: float = TAIL, floor: int = FLOOR) -> DataFrame:
    """As `quality_rules`, but the limits are the tails that the groups' sketches show, with no cutoff put in by hand; see `tail_thresholds`."""
    counts = saved(base_counts(docs), "counts")
    return _judged(counts, tail_thresholds(counts, least_rows, tail, floor))
