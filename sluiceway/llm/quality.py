r"""Quality rules: fixed limits, then robust multivariate outliers.

Base statistics of a text are its words, their characters, symbols, repeated lines and words in five-word
windows that occur more than once. Texts under MIN_WORDS words or with over MAX_REPEATED of their words in
repeated windows fail at once. For the others the statistics are transformed (logarithms and square roots of
rates) and compared within their language and source with a minimum-covariance-determinant estimate: the mean and
covariance of the SHARE of rows whose covariance has the least determinant, as far as concentration steps find
them. They set out from three robust starts (medians with median deviations alone, with correlations of
hyperbolic tangents, and with covariances of spatial signs); each step takes the SHARE of rows of least distance,
until no step lowers the determinant any more, and of all starts the least determinant counts. Every covariance
has the squares of FLOORS added to its variances (a regularised estimate), so that a statistic that hardly
varies in a group does not reject small deviations. Squared distances are divided by the ratio of their median
to that of chi-squared where this is above one, as the estimate of a part of the rows is too narrow; they are
never raised. Rows beyond LIMIT are rejected.

A group under MIN_GROUP rows (ten for each statistic) is compared with all rows of its language, large groups
included, and where these are too few with all rows of the table, however few they are. Only rows without a
language are not compared with those of languages: fewer than MIN_GROUP of them are kept, with a null distance.

Everything is column expressions and grouped aggregates: what a step shuffles is partial sums by group and a
quantile sketch, whatever the size of a group. Null and empty texts have no words; very long texts are counted
whole; null languages and sources are groups of their own; ties get equal distances and equal verdicts; repeated
rows count as often as they are there; an empty table gives no rows; `base_stats` keeps the columns named, and
`outliers` all columns it gets, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, packed, table, unpacked, words_of

MIN_WORDS, MAX_REPEATED, WINDOW = 10, 0.2, 5
MIN_GROUP, SHARE = 50, 0.75

#: A step that lowers the logarithm of the determinant by less ends a start.
SETTLED = 1e-5

#: Of chi-squared with five degrees of freedom: the median, and the 0.9999 quantile, the largest squared distance kept:
#: of rows that follow the estimate's normal law one in 10,000 goes.
MEDIAN, LIMIT = 4.3515, 25.7448

#: Least standard deviations of the transformed statistics below.
FLOORS = (0.5, 0.15, 0.06, 0.12, 0.12)
NAMES = ("x0", "x1", "x2", "x3", "x4")

#: Group estimates up to so many rows are broadcast; more are joined by shuffle, each of a group's rows to one of SALTS copies.
BROADCAST_GROUPS, SALTS = 20_000, 32


def base_stats(docs: DataFrame, *, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], t.alias("t"), words_of(t).alias("ws"))
    n = F.size("ws")
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = F.col("ws")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        *keep, n.cast("long").alias("n_words"),
        (F.char_length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        windows.alias("hs"),
    )
    # Where windows repeat: sorted with their places, equal neighbours are repeats; the words they cover, in order of place.
    placed = F.sort_array(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, x, i, k: F.coalesce(F.get(a, i + k)["h"] == x["h"], F.lit(False))
    repeats = F.transform(F.array(placed), lambda a: F.sort_array(F.transform(F.filter(a, lambda x, i: same(a, x, i, -1) | same(a, x, i, 1)), lambda x: x["i"])))[0]
    covered = F.transform(F.array(repeats), lambda a: F.aggregate(F.transform(a, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(a, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x))[0]
    repeated = F.when(F.size(F.array_distinct("hs")) == F.size("hs"), 0).otherwise(covered).cast("long")
    rows = rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words")))


def _transformed() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(n),
        F.log1p(F.col("word_chars") / n),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _joined(rows: DataFrame, groups: DataFrame, bounded: bool, how: str = "inner") -> DataFrame:
    """The rows with the columns of their group g. A large table of groups is joined by shuffle, large groups salted."""
    right = groups.withColumnRenamed("g", "g_")
    if bounded:
        return rows.join(F.broadcast(right), F.col("g") == F.col("g_"), how).drop("g_")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*NAMES), F.lit(SALTS)))
    right = right.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(right, (F.col("g") == F.col("g_")) & (F.col("salt") == F.col("salt_")), how).drop("g_", "salt", "salt_")


def _with_distance(rows: DataFrame, *, keep_means: bool = False) -> DataFrame:
    """The rows with d, the squared distance by the mean m_i and the lower triangle l_i_j of the covariance's factor; y0.. are worked out one after the other."""
    keep = [c for c in rows.columns if not c.startswith(("l_",) if keep_means else ("m_", "l_"))]
    for i in range(P):
        known = sum((F.col(f"l_{i}_{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"y{i}", (F.col(NAMES[i]) - F.col(f"m_{i}") - known) / F.col(f"l_{i}_{i}"))
    return rows.select(*keep, functools.reduce(Column.__add__, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(P)]).alias("d"))


def _factored(estimate: DataFrame, *keep: str) -> DataFrame:
    """keep, m_i, l_i_j and logdet of covariances c_i_j, variances raised by the squares of their floors."""
    for i, j in PAIRS:
        known = sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
        c = F.coalesce(F.col(f"c_{i}_{j}"), F.lit(0.0)) - known
        estimate = estimate.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(c + F.lit(FLOORS[i] ** 2), F.lit(1e-12))) if i == j else c / F.col(f"l_{j}_{j}"))
    logdet = functools.reduce(Column.__add__, [2 * F.log(F.col(f"l_{i}_{i}")) for i in range(P)])
    return estimate.select(*keep, *[f"m_{i}" for i in range(P)], *[f"l_{i}_{j}" for i, j in PAIRS], logdet.alias("logdet"))


def _middle(c: Column | str) -> Column:
    return F.percentile_approx(c, 0.5, 1000)


def _starts(good: DataFrame, bounded: bool) -> DataFrame:
    """g, start, m_i, l_i_j: three robust estimates of each group."""
    places = cut(good.groupBy("g").agg(*[_middle(x).alias(f"m_{i}") for i, x in enumerate(NAMES)]))
    spread = _joined(good, places, bounded).groupBy("g").agg(*[_middle(F.abs(F.col(x) - F.col(f"m_{i}"))).alias(f"s_{i}") for i, x in enumerate(NAMES)])
    spread = spread.select("g", *[F.sqrt((1.4826 * F.col(f"s_{i}")) ** 2 + FLOORS[i] ** 2).alias(f"s_{i}") for i in range(P)])
    both = cut(places.join(spread.withColumnRenamed("g", "g_"), F.col("g") == F.col("g_")).drop("g_"))
    z = _joined(good, both, bounded)
    z = z.select("g", *[((F.col(x) - F.col(f"m_{i}")) / F.col(f"s_{i}")).alias(f"z{i}") for i, x in enumerate(NAMES)])
    z = z.withColumn("size", F.greatest(F.sqrt(functools.reduce(Column.__add__, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)])), F.lit(1e-9)))
    sign, bent = (lambda i: F.col(f"z{i}") / F.col("size")), (lambda i: F.tanh(F.col(f"z{i}")))
    shapes = z.groupBy("g").agg(*[F.avg(sign(i) * sign(j)).alias(f"u_{i}_{j}") for i, j in PAIRS], *[F.covar_pop(bent(i), bent(j)).alias(f"t_{i}_{j}") for i, j in PAIRS])
    wide = both.join(shapes.withColumnRenamed("g", "g_"), F.col("g") == F.col("g_")).drop("g_")
    scale = lambda i, j: F.col(f"s_{i}") * F.col(f"s_{j}")
    least = F.lit(1e-6)
    kinds = [
        lambda i, j: scale(i, j) if i == j else F.lit(0.0),
        lambda i, j: scale(i, j) * F.col(f"t_{i}_{j}") / F.sqrt(F.greatest(F.col(f"t_{i}_{i}"), least) * F.greatest(F.col(f"t_{j}_{j}"), least)),
        lambda i, j: scale(i, j) * P * F.col(f"u_{i}_{j}"),
    ]
    made = [wide.select("g", F.lit(k).alias("start"), *[f"m_{i}" for i in range(P)], *[kind(i, j).alias(f"c_{i}_{j}") for i, j in PAIRS]) for k, kind in enumerate(kinds)]
    return _factored(functools.reduce(DataFrame.unionAll, made), "g", "start")


def estimates(good: DataFrame, *, bounded: bool = True) -> DataFrame:
    """g, m_i, l_i_j, logdet: of each group g of rows x0.. the estimate of the least determinant."""
    now, seen = cut(_starts(good, bounded).drop("logdet").withColumn("before", F.lit(float("inf")))), []
    while True:
        last = now.select("g", "start", "before", *[f"m_{i}" for i in range(P)], *[f"l_{i}_{j}" for i, j in PAIRS])
        near = _with_distance(_joined(good, last, bounded)).select("g", "start", "before", *NAMES, "d")
        limits = cut(near.groupBy("g", "start").agg(F.percentile_approx("d", SHARE, 1000).alias("limit")))
        both = last.join(limits.select(F.col("g").alias("h"), F.col("start").alias("begun"), "limit"), (F.col("g") == F.col("h")) & (F.col("start") == F.col("begun"))).drop("h", "begun")
        near = _with_distance(_joined(good, both, bounded), keep_means=True).where("d <= limit")
        # Sums of distances from the former mean, so that small variances keep their digits.
        off = lambda i: F.col(NAMES[i]) - F.col(f"m_{i}")
        near = near.select("g", "start", "before", *[f"m_{i}" for i in range(P)], *[off(i).alias(f"z{i}") for i in range(P)])
        sums = near.groupBy("g", "start", "before", *[f"m_{i}" for i in range(P)]).agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(f"z{i}").alias(f"z{i}") for i in range(P)], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"c_{i}_{j}") for i, j in PAIRS]
        )
        mean = lambda i: F.col(f"z{i}") / F.col("n")
        sums = sums.select("g", "start", "before", *[(F.col(f"m_{i}") + mean(i)).alias(f"m_{i}") for i in range(P)], *[(F.col(f"c_{i}_{j}") / F.col("n") - mean(i) * mean(j)).alias(f"c_{i}_{j}") for i, j in PAIRS])
        made = cut(_factored(sums, "g", "start", "before"))
        seen.append(made)
        now = made.where(F.col("logdet") < F.col("before") - SETTLED).withColumn("before", F.col("logdet"))
        if now.isEmpty():
            break
    every = functools.reduce(DataFrame.unionAll, seen).drop("before")
    held = [c for c in every.columns if c not in ("g", "start")]
    best = every.groupBy("g").agg(F.min_by(F.struct(*held), F.struct("logdet", "start")).alias("e"))
    return cut(best.select("g", *[F.col(f"e.{c}").alias(c) for c in held]))


def outliers(stats: DataFrame, *, lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """The rows with distance (of rows that base_failed: null) and kept. The rows, and the statistics to compare, are kept in the checkpoint folder, as each step reads them."""
    stats = cut(stats)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("~"))
    held = packed(stats, ok=F.col("base_failed") == F.lit(False), g2=F.concat_ws("\u0000", name(lang), name(source)), g1=name(lang), **dict(zip(NAMES, _transformed(), strict=True)))
    # g names the population that a group is compared with, gs those that its rows are part of: a row counts in three at most.
    sizes = held.where("ok").groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.groupBy("g1").agg(F.sum("n").alias("pool"), F.min("n").alias("least")).withColumnRenamed("g1", "p1")
    own, wide = F.concat(F.lit("2"), "g2"), F.concat(F.lit("1"), "g1")
    names = sizes.join(totals, F.col("g1") == F.col("p1")).select(
        F.col("g2").alias("k2"),
        F.when(F.col("n") >= min_group, own).when(F.col("pool") >= min_group, wide).when(F.col("g1") != "~", "0").alias("g"),
        F.when(F.col("n") >= min_group, own).alias("o"), F.when((F.col("least") < min_group) & (F.col("pool") >= min_group), wide).alias("w"),
    )
    names = cut(names)
    all_rows = F.lit("0" if names.where("g = '0'").limit(1).count() else None).cast("string")
    names = names.select("k2", "g", F.array_compact(F.array("o", "w", all_rows)).alias("gs"))
    bounded = names.count() <= BROADCAST_GROUPS
    rows = _joined(held.withColumn("g", F.col("g2")), names.select(F.col("k2").alias("g"), F.col("g").alias("population"), "gs"), bounded, "left").drop("g", "g1", "g2").withColumnRenamed("population", "g")
    good = cut(rows.where("ok").select(F.explode("gs").alias("g"), *NAMES))
    best = estimates(good, bounded=bounded).drop("logdet")
    scale = cut(_with_distance(_joined(good, best, bounded)).groupBy("g").agg(_middle("d").alias("median")))
    best = best.join(scale.withColumnRenamed("g", "g_"), F.col("g") == F.col("g_")).drop("g_")
    out = _with_distance(_joined(rows, best, bounded, "left"))
    out = out.withColumn("far", F.when(F.col("ok"), F.col("d") * MEDIAN / F.greatest(F.col("median"), F.lit(MEDIAN))))
    return unpacked(out, stats.columns, distance=F.col("far"), kept=F.col("ok") & (F.coalesce("far", F.lit(0.0)) <= LIMIT))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = base_stats(table(spark, sf_dir, "documents"), keep=["doc_id", "lang", "source"])
    return outliers(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


QUERIES = {"op6_quality": op6_quality}
