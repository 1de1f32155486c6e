"""Quality rules: base statistics of texts and robust multivariate outliers.

Texts that pass the base rules are judged by a vector of transformed statistics. For each
language and source a minimum-covariance-determinant estimate is made by concentration steps:
from medians and quartile ranges on, the three quarters of the rows with the least distances
give the next mean and covariance. Rows far from the estimate by Mahalanobis distance are
rejected. Everything is built-in expressions; sums run over whole numbers, so results do not
depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

BLANK = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

# Statistic vector: name, expression over the base statistics, least standard deviation. The last is what
# ordinary texts of one source may differ by: twice the length, a tenth in word length, a line or a few words said twice.
VECTOR = [
    ("x_words", "ln(1 + n_words)", 0.7),
    ("x_length", "ln(word_chars / n_words)", 0.1),
    ("x_symbols", "ln(1 + 100 * n_symbols / word_chars)", 0.4),
    ("x_lines", "ln(1 + n_dup_lines)", 0.8),
    ("x_repeats", "ln(1 + 100 * n_repeat_words / n_words)", 1.0),
]
UNIT = 256  # vectors are rounded to 1/256
SUBSET = 0.75
STEPS = 4
MIN_ROWS = 50
# Median of the chi-square distribution with 5 degrees of freedom.
CHI_MEDIAN = 4.351
# Squared distance from which a text is rejected. Statistics of texts have heavier tails than normal ones,
# for which 40.9 would leave one in ten million out.
CUTOFF = 60.0


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column, span: int = 5) -> Column:
    """Words inside windows of ``span`` words that occur twice or more in the list."""

    def of_hashes(h: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(h) - span), lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(span)]).alias("h"), i.alias("i"))
        )
        return bound(F.sort_array(windows), of_windows)

    def of_windows(w: Column) -> Column:
        again = F.filter(w, lambda x, k: (x["h"] == F.get(w, k - 1)["h"]) | (x["h"] == F.get(w, k + 1)["h"]))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        first = F.struct(F.lit(-span).alias("last"), F.lit(0).cast("long").alias("covered"))
        return F.aggregate(
            starts, first,
            lambda a, s: F.struct(s.alias("last"), (a["covered"] + F.least(F.lit(span), s - a["last"]).cast("long")).alias("covered")),
            lambda a: a["covered"],
        )

    return F.when(F.size(words) >= span, bound(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).otherwise(F.lit(0).cast("long"))


def base_statistics(docs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; a null text has none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(*id_cols, text.alias("_text"))

    def without_any(column: str, characters: str) -> Column:
        return F.translate(F.col(column), characters, "")

    filled = lambda lines: F.filter(lines, lambda x: F.translate(x, BLANK, "") != "")
    measured = plain.select(
        *id_cols,
        bound(
            F.filter(F.split("_text", BLANK_RUN), lambda w: w != ""),
            lambda words: F.struct(F.size(words).cast("long").alias("n"), _repeat_words(words).alias("repeats")),
        ).alias("_words"),
        F.char_length(without_any("_text", BLANK)).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(without_any("_text", SYMBOLS))).cast("long").alias("n_symbols"),
        bound(filled(F.split("_text", "\n")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    named = measured.select(
        *id_cols, F.col("_words.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_words.repeats").alias("n_repeat_words")
    )
    return named.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def _names(prefix: str) -> list[str]:
    return [f"{prefix}{i}{j}" for i in range(len(VECTOR)) for j in range(i + 1)]


def _factors(moments: DataFrame) -> DataFrame:
    """Mean and inverse Cholesky factor of each group from its count, sums and sums of products."""
    d = range(len(VECTOR))
    out = moments.withColumns({f"m{i}": F.col(f"s{i}").cast("double") / F.col("n") for i in d})
    # A floor keeps statistics that hardly vary in a group from making the covariance singular.
    out = out.withColumns(
        {
            f"c{i}{j}": F.col(f"p{i}{j}").cast("double") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + (F.lit((VECTOR[i][2] * UNIT) ** 2) if i == j else 0)
            for i in d for j in range(i + 1)
        }
    )
    for i in d:
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for i in d:
        for j in range(i + 1):
            head = F.lit(1.0) if i == j else -sum((F.col(f"l{i}{k}") * F.col(f"v{k}{j}") for k in range(j, i)), F.lit(0.0))
            out = out.withColumn(f"v{i}{j}", head / F.col(f"l{i}{i}"))
    return out.select("g_lang", "g_source", *[f"m{i}" for i in d], *_names("v"))


def _distance() -> Column:
    """Squared Mahalanobis distance of the row's vector z0.. from the group's estimate."""
    total = F.lit(0.0)
    for i in range(len(VECTOR)):
        part = sum((F.col(f"v{i}{j}") * (F.col(f"z{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + part * part
    return total


def _concentrated(placed: DataFrame, distance: Column) -> DataFrame:
    """Moments of the ``SUBSET`` of each group's rows with the least distances.

    Rows are summed by steps of the distance, combined before the shuffle; the steps that make up
    the subset are then added. A step holds a 64th of a doubling, so ties are taken together.
    """
    d = range(len(VECTOR))
    level = F.floor(F.log2(distance + 2.0**-20) * 64).cast("long")
    exact = lambda x: F.sum(x.cast("decimal(30,0)"))
    steps = placed.groupBy("g_lang", "g_source", level.alias("level")).agg(
        F.count("*").alias("n"), *[exact(F.col(f"z{i}")).alias(f"s{i}") for i in d], *[exact(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"p{i}{j}") for i in d for j in range(i + 1)]
    )
    group = Window.partitionBy("g_lang", "g_source")
    before = group.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    ranked = steps.withColumns({"_all": F.sum("n").over(group), "_before": F.coalesce(F.sum("n").over(before), F.lit(0))})
    near = ranked.filter(F.col("_before") < F.col("_all") * SUBSET)
    sums = [F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in d], *_names("p")]]
    return near.groupBy("g_lang", "g_source").agg(*sums)


def outliers(rows: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Add ``distance`` (squared, scaled; null for rows without words) to stored rows of base statistics.

    Null languages and sources count as empty strings. A row is judged by the estimate of its source in its
    language; with fewer than MIN_ROWS passing rows there, by that of all passing rows of the language, large
    sources included; with too few of those, by that of all passing rows of all languages, however few they are.
    """
    d = range(len(VECTOR))
    named = rows.withColumns({"g_lang": F.coalesce(F.col(lang_col), F.lit("")), "_source": F.coalesce(F.col(source_col), F.lit(""))})
    passing = named.filter("NOT base_failed")
    counts = stored(passing.groupBy("g_lang", "_source").agg(F.count("*").alias("_n")), "sources")
    large = counts.filter(F.col("_n") >= MIN_ROWS).select("g_lang", "_source", F.lit(True).alias("_large"))
    per_lang = counts.groupBy("g_lang").agg(F.sum("_n").alias("_n"))
    wide = per_lang.filter(F.col("_n") >= MIN_ROWS).select("g_lang", F.lit(True).alias("_wide"))
    # Only languages with passing rows in small sources need an estimate over all their rows.
    mixed = counts.filter(F.col("_n") < MIN_ROWS).select("g_lang").distinct().join(wide, "g_lang")
    all_too = not per_lang.filter(F.col("_n") < MIN_ROWS).isEmpty()
    vectors = {f"z{i}": F.expr(f"CASE WHEN n_words > 0 AND word_chars > 0 THEN CAST(round(({e}) * {UNIT}) AS LONG) END") for i, (_, e, _) in enumerate(VECTOR)}
    placed = named.join(large, ["g_lang", "_source"], "left").join(wide, "g_lang", "left").join(mixed.select("g_lang", F.lit(True).alias("_mixed")), "g_lang", "left")
    own_group = F.concat(F.lit("="), "_source")
    placed = placed.withColumns({
        # One estimate has "=" and the source, "" all rows of the language, and "*" all rows of all languages.
        "_home": F.col("g_lang"), "_mixed": F.coalesce("_mixed", F.lit(False)),
        "g_lang": F.when(F.col("_large") | F.col("_wide"), F.col("g_lang")).otherwise(F.lit("")),
        "g_source": F.when(F.col("_large"), own_group).when(F.col("_wide"), F.lit("")).otherwise(F.lit("*")),
        **vectors,
    })
    placed = stored(placed.drop("_source", "_large", "_wide"), "vectors")
    # Passing rows enter their own estimate and every wider one that is needed.
    entered = [F.when(F.col("g_source").startswith("="), F.struct("g_lang", "g_source")), F.when(F.col("_mixed"), F.struct(F.col("_home").alias("g_lang"), F.lit("").alias("g_source")))]
    if all_too:
        entered.append(F.struct(F.lit("").alias("g_lang"), F.lit("*").alias("g_source")))
    own = placed.filter("NOT base_failed").select(*[f"z{i}" for i in d], F.explode(F.array_compact(F.array(*entered))).alias("_in"))
    own = own.select("_in.g_lang", "_in.g_source", *[f"z{i}" for i in d])
    enough = F.count("*").alias("rows")
    quartiles = own.groupBy("g_lang", "g_source").agg(enough, *[F.percentile(f"z{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in d])
    quartiles = stored(quartiles, "quartiles")
    spread = lambda i: F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(VECTOR[i][2] * UNIT))
    first = sum((((F.col(f"z{i}") - F.col(f"q{i}")[1]) / spread(i)) ** 2 for i in d), F.lit(0.0))
    key = ["g_lang", "g_source"]
    factors = stored(_factors(_concentrated(own.join(quartiles, key), first)), "estimate")
    for _ in range(STEPS):
        factors = stored(_factors(_concentrated(own.join(factors, key), _distance())), "estimate")
    # The subset's covariance is too small; the median distance tells by how much. Rounded distances keep the map of values small.
    medians = own.join(factors, key).groupBy(*key).agg(F.percentile(F.floor(F.log2(_distance() + 2.0**-20) * 64), F.lit(0.5)).alias("_level"))
    scaled = stored(factors.join(medians, key).withColumn("scale", F.greatest(F.pow(F.lit(2.0), F.col("_level") / 64) / CHI_MEDIAN, F.lit(0.25))), "estimate")
    measured = placed.join(scaled, key, "left").withColumn("distance", _distance() / F.col("scale"))
    return measured.select(*[c for c in rows.columns], "distance")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, base statistics, base_failed, kept, distance) of every row; other columns are ignored, repeated rows stay repeated.

    Statistics are made in one pass over the texts and stored; the estimates read only those.
    """
    light = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_from"), F.col(text_col).alias("_body"))
    rows = stored(base_statistics(light, ["_id", "_lang", "_from"], "_body"), "statistics")
    far = F.coalesce(F.col("distance") > CUTOFF, F.lit(False))
    return outliers(rows, "_lang", "_from").select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "distance",
    )
