"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Each text gives a vector of transformed statistics. In each group three starts (quartiles; directions from the medians;
the half that is nearest to the medians) take two concentration steps each: a step keeps the three quarters of the rows
that are nearest in Mahalanobis distance and estimates again from these, which lowers the determinant. The start with the
least determinant goes on until a step lowers it no further. The estimate is scaled to chi-square's 0.75 quantile, and
once more made from all rows within its 0.975 quantile; rows beyond the 0.9999 quantile are rejected.

The estimate is a regularised one: a floor is added to each variance, since nearly all clean texts have no symbols and no
repeated lines at all, so that without it the determinant would be 0 and any symbol an outlier. Only sums of each group
are gathered, never its rows, and they are summed before they are shuffled, so a hot group is no task of its own. The
scale never falls below 1, and floors widen each variance: fewer clean rows than the quantile says are rejected.

Defined cases: a null text has no words; texts that fail the base rules are rejected and take no part in the estimates;
null languages and sources count as empty strings; a group of fewer than `MIN_GROUP` rows supports no estimate of its
own and is measured against its language's, or against none if that has too few rows as well; repeated rows are judged
alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glossaria.llm.common import cut, few, row_id, space_words, text_or_empty

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

#: Dimensions of the vector, and the standard deviation that is added in each.
FLOORS = {"log_words": 1.0, "word_length": 0.25, "symbols": 0.05, "repeats": 0.1, "lines": 0.5}
CORE = 0.75  # of a group's rows are in the estimate
# Quantiles of chi-square with five degrees of freedom.
CHI2_CORE, CHI2_975, CHI2_9999 = 6.6257, 12.8325, 25.7448
FALL = 1e-3  # of a log determinant; less is no fall
MIN_GROUP = 50
CUTOFF = CHI2_9999  # squared distance
FEW_GROUPS = 20_000  # estimates that are sent to all tasks: some 400 bytes each
GROUP = ["g_pooled", "g_lang", "g_source"]
TEXT_GROUP = ["g_lang", "g_source"]
DIMS = list(FLOORS)
NUMBERS = range(len(DIMS))
PAIRS = [(i, j) for i in NUMBERS for j in range(i + 1)]


def window_hashes(words: Column) -> Column:
    """A hash of each window of three words."""
    first = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(first, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text_or_empty(text_col)
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    source = F.coalesce(F.col("source"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(row_id(docs).alias("rid"), F.col(id_col).alias("doc_id"), lang.alias("g_lang"), source.alias("g_source"), text.alias("text"))
    rows = rows.withColumn("words", space_words(F.col("text"))).withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    )
    rows = rows.select(
        "rid", "doc_id", *TEXT_GROUP, F.size("words").cast("long").alias("n_words"), F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), window_hashes(F.col("words")).alias("windows"),
    )
    rows = rows.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("sorted", F.when(F.col("repeats"), placed))
    # Places of windows that equal a neighbour in sorted order; each covers three words less what is covered already.
    as_next = lambda x, k: F.coalesce(x["h"] == F.get("sorted", k + 1)["h"], F.lit(False))
    as_last = lambda x, k: F.coalesce(x["h"] == F.when(k > 0, F.get("sorted", k - 1)["h"]), F.lit(False))
    hit = F.filter("sorted", lambda x, k: as_next(x, k) | as_last(x, k))
    rows = rows.withColumn("places", F.sort_array(F.transform(hit, lambda x: x["i"])))
    covered = F.aggregate(
        "places", F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct((p + 2).alias("end"), (a["n"] + p + 2 - F.greatest(a["end"], p - 1)).cast("long").alias("n")), lambda a: a["n"],
    )
    rows = rows.withColumn("n_repeat_words", F.when(F.col("repeats"), covered).otherwise(F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return rows.select("rid", "doc_id", *TEXT_GROUP, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def vector() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "log_words": F.log1p("n_words"), "word_length": F.col("word_chars") / words, "symbols": F.sqrt(F.col("n_symbols") / chars),
        "repeats": F.sqrt(F.col("n_repeat_words") / words), "lines": F.log1p("n_dup_lines"),
    }


def with_group(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Rows with their group's estimates: sent to all tasks where they are counted to be few."""
    return rows.join(few(estimate, FEW_GROUPS), GROUP)


def _sum(parts: list[str]) -> str:
    return "(" + " + ".join(parts or ["0D"]) + ")"


#: Squared Mahalanobis distance by the inverse Cholesky factor of a group's estimate.
DISTANCE = _sum([f"pow({_sum([f'w_{i}_{j} * ({DIMS[j]} - m_{j})' for j in range(i + 1)])}, 2)" for i in NUMBERS])


def with_factor(moments: DataFrame) -> DataFrame:
    """w_i_j, the inverse of the Cholesky factor of the covariances c_i_j, and their log determinant, in place of these."""
    kept, out = [c for c in moments.columns if not c.startswith("c_")], moments
    for j in NUMBERS:  # column by column of the factor
        rest = {k: f"(c_{k}_{j} - {_sum([f'l_{k}_{m} * l_{j}_{m}' for m in range(j)])})" for k in NUMBERS[j:]}
        corner = f"sqrt(greatest({rest[j]}, 1e-12D))"
        out = out.selectExpr("*", *(f"{corner if k == j else f'{rest[k]} / {corner}'} AS l_{k}_{j}" for k in rest))
    for i in NUMBERS:  # row by row of its inverse
        rest = {j: "1D" if i == j else "-" + _sum([f"l_{i}_{m} * w_{m}_{j}" for m in range(j, i)]) for j in range(i + 1)}
        out = out.selectExpr("*", *(f"{rest[j]} / l_{i}_{i} AS w_{i}_{j}" for j in rest))
    return out.selectExpr(*kept, *(f"w_{i}_{j}" for i, j in PAIRS), f"{_sum([f'2 * ln(l_{i}_{i})' for i in NUMBERS])} AS log_det")


def moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means and regularised covariances of rows that have their group's center m_i; sums are taken around that."""
    off = [f"({d} - m_{i})" for i, d in enumerate(DIMS)]
    means = [f"avg({off[i]})" for i in NUMBERS]
    sums = rows.groupBy(*by).agg(*map(F.expr, [
        "count(*) AS n", *(f"first(m_{i}) + {means[i]} AS m_{i}" for i in NUMBERS),
        *(f"avg({off[i]} * {off[j]}) - {means[i]} * {means[j]} + {list(FLOORS.values())[i] ** 2 if i == j else 0.0}D AS c_{i}_{j}" for i, j in PAIRS),
    ]))
    return with_factor(sums)


def starts(rows: DataFrame) -> DataFrame:
    """Three estimates of each group."""
    quartiles = rows.groupBy(*GROUP).agg(*(F.expr(f"percentile_approx({d}, array(0.25, 0.5, 0.75), 1000) AS q_{i}") for i, d in enumerate(DIMS)))
    spread = [f"greatest((q_{i}[2] - q_{i}[0]) / 1.349D, {f}D) AS t_{i}" for i, f in enumerate(FLOORS.values())]
    middle = cut(quartiles.selectExpr(*GROUP, *(f"q_{i}[1] AS m_{i}" for i in NUMBERS), *spread))
    centers = [f"m_{i}" for i in NUMBERS]
    plain = with_factor(middle.selectExpr(*GROUP, *centers, *(f"{f't_{i} * t_{j}' if i == j else '0D'} AS c_{i}_{j}" for i, j in PAIRS)))

    placed = with_group(rows, middle).selectExpr("*", *(f"({d} - m_{i}) / t_{i} AS z_{i}" for i, d in enumerate(DIMS)))
    placed = placed.selectExpr("*", f"sqrt({_sum([f'z_{i} * z_{i}' for i in NUMBERS])}) AS norm")
    sign = [f"z_{i} / greatest(norm, 1e-9D)" for i in NUMBERS]
    signs = placed.groupBy(*GROUP).agg(F.percentile_approx("norm", 0.5, 1000).alias("half"), *(F.expr(f"covar_pop({sign[i]}, {sign[j]}) AS s_{i}_{j}") for i, j in PAIRS))
    signs = cut(signs.join(middle, GROUP))
    directions = with_factor(signs.selectExpr(*GROUP, *centers, *(f"t_{i} * t_{j} * ({len(DIMS)} * s_{i}_{j} + {0.05 if i == j else 0.0}D) AS c_{i}_{j}" for i, j in PAIRS)))
    near = placed.join(few(signs.select(*GROUP, "half"), FEW_GROUPS), GROUP).where("norm <= half")
    found = [plain, directions, moments(near, GROUP).drop("n")]
    return cut(found[0].withColumn("start", F.lit(0)).unionByName(found[1].withColumn("start", F.lit(1))).unionByName(found[2].withColumn("start", F.lit(2))))


def concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One step: moments of each group's nearest three quarters, for each of its estimates."""
    by = [*GROUP, "start"]
    far = with_group(rows, estimate).withColumn("d2", F.expr(DISTANCE))
    edge = cut(far.groupBy(*by).agg(F.percentile_approx("d2", CORE, 1000).alias("edge")))
    return cut(moments(far.join(few(edge, FEW_GROUPS), by).where(F.col("d2") <= F.col("edge")), by))


def scaled(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds the group's number of rows, and `scale`: what makes the core's edge fit chi-square's."""
    edge = with_group(rows, estimate).groupBy(*GROUP).agg(F.percentile_approx(F.expr(DISTANCE), CORE, 1000).alias("edge"), F.count("*").alias("rows"))
    return cut(estimate.join(edge, GROUP).select(*estimate.columns, "rows", F.greatest(F.col("edge") / CHI2_CORE, F.lit(1.0)).alias("scale")))


def estimates(rows: DataFrame) -> DataFrame:
    """The estimate of each group: m_i, w_i_j, scale, rows."""
    tried = concentrate(rows, concentrate(rows, starts(rows)))
    least = F.struct("log_det", "start")
    best = tried.groupBy(*GROUP).agg(F.min(least).alias("least")).select(*GROUP, "least.start")
    found = active = cut(tried.join(best, [*GROUP, "start"]))
    while True:  # a group goes on while a step lowers its determinant, which floors bound from below
        before = active.select(*GROUP, F.col("log_det").alias("before"))
        active = cut(concentrate(rows, active).join(before, GROUP).where(F.col("log_det") < F.col("before") - FALL).drop("before"))
        if active.isEmpty():
            break
        found = cut(found.join(active.select(*GROUP), GROUP, "left_anti").unionByName(active))
    found = scaled(rows, found.drop("start", "n"))
    good = with_group(rows, found).where(F.expr(DISTANCE) <= CHI2_975 * F.col("scale"))
    return scaled(rows, cut(moments(good, GROUP).drop("n")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The statistics, d2 (squared distance; null if base_failed or without an estimate) and kept."""
    stats = cut(statistics(docs, id_col, text_col))
    both = F.explode(F.array(F.struct(F.lit(False).alias("g_pooled"), "g_lang", "g_source"), F.struct(F.lit(True).alias("g_pooled"), "g_lang", F.lit("").alias("g_source"))))
    rows = stats.where(~F.col("base_failed")).select(both.alias("g"), *(c.alias(n) for n, c in vector().items())).select("g.*", *DIMS)
    found = estimates(rows).where(F.col("rows") >= MIN_GROUP)
    shape = [c for c in found.columns if c[:2] in ("m_", "w_") or c == "scale"]
    own = found.where(~F.col("g_pooled")).select("g_lang", "g_source", *(F.col(c).alias(f"own_{c}") for c in shape))
    pooled = found.where("g_pooled").select("g_lang", *(F.col(c).alias(f"pool_{c}") for c in shape))
    measured = stats.withColumns(vector()).join(few(own, FEW_GROUPS), ["g_lang", "g_source"], "left").join(few(pooled, FEW_GROUPS), "g_lang", "left")
    measured = measured.withColumns({c: F.coalesce(f"own_{c}", f"pool_{c}") for c in shape})
    measured = measured.withColumn("d2", F.when(~F.col("base_failed"), F.expr(DISTANCE) / F.col("scale")))
    return measured.select(*stats.columns, "d2", (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)).alias("kept"))
