r"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

Method. Each document gets five statistics of its whole text; they are transformed to be near normal (logarithms
and square roots of rates) and each group of language and source gets a minimum-covariance-determinant (MCD)
estimate of their centre and scatter. It starts from three deterministic scatters of robustly standardised values
(medians and interquartile ranges; their squashed and sign values) and concentrates: the rows with the least
Mahalanobis distances that make up three quarters of the group give the next centre and scatter, five times; the
start with the least determinant wins. Rows are then reweighted once at the 97.5 % point, the scatter is made consistent
for a normal distribution, and rows are rejected beyond `cutoff`, a squared distance that fewer than one in 10 million normal
rows exceed (statistics of real text have longer tails than a normal distribution; a lower cutoff would reject clean documents).

A concentration step is one aggregation over all rows: distances fall in logarithmic bins per group, the moments of
each bin are summed, and the lowest bins that hold three quarters of the rows are merged. So the steps see every row,
nothing is sampled or collected, a hot group pre-aggregates on the map side, and the step's result is a few rows per
group. Each statistic is measured in units of a tolerance, and the unit matrix is added to the scatter: a statistic that is
constant in a group (symbols, repeated lines and words in prose) stays regular, and deviations of a few tolerances are never outlying.
The estimates, a row per group, are broadcast after a check of their number, so rows stay where they are.

Native: only DataFrame functions. The statistics (a few numbers per row) are a table in the shared folder; the
text is read once. Words `[^\x20\x09-\x0D]+` repeated in 3-word windows are found per row by sorting window hashes.

Cases. Null or wordless text: no words, base_failed. Groups of fewer than `least` rows (ten for each statistic) are judged by
the estimate of all rows of their language, then of all rows; if even those are fewer, only the base rule decides. Null
language or source is a value like others. Repeated rows count each. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CUTOFF = 43.0
SHARE = 0.75
STEPS = 5
_CHI2_975 = 12.83
_CONSISTENT = 0.975 / 0.9238  # by how much cutting a five-dimensional normal distribution there shrinks its scatter
_MOST_BROADCAST = 50_000  # estimates, about 300 bytes each
#: Of log words, log mean word length, and the square roots of symbols, repeated lines and repeated words per word.
TOLERANCES = (1.0, 0.05, 0.05, 0.04, 0.1)
_P = len(TOLERANCES)
LEAST = 10 * _P
_X = [f"x_{i}" for i in range(_P)]
_BINS = 12  # per doubling of the squared distance
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column, n: Column) -> Column:
    """Words in 3-word windows that occur twice or more; most texts end at the comparison of two counts."""
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    return F.when(n < 4, F.lit(0)).otherwise(_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h))))


def _covered(hashes: Column) -> Column:
    """Sort (hash, place), keep places with an equal neighbour, and sum the words that each place newly covers."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = _let(placed, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
    places = F.array_sort(F.transform(again, lambda x: x["i"]))
    new = _let(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))
    return F.aggregate(new, F.lit(0), lambda a, x: a + x)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    split = docs.select(
        *own,
        F.filter(F.split(t, _SPACE), lambda w: w != "").alias("__words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("__words")
    return split.select(
        *own,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("__words"), n).cast("long").alias("n_repeat_words"),
    )


def features() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    transformed = [F.log(words), F.log((F.col("word_chars") + 1) / words), F.sqrt(F.col("n_symbols") / words), F.sqrt(F.col("n_dup_lines") / words), F.sqrt(F.col("n_repeat_words") / words)]
    return [(f / F.lit(t)).alias(x) for f, t, x in zip(transformed, TOLERANCES, _X, strict=True)]


def _few(table: DataFrame) -> DataFrame:
    """A table of groups for a join: broadcast if its rows are few."""
    return F.broadcast(table) if table.count() <= _MOST_BROADCAST else table


def _grouped(rows: DataFrame, least: int) -> DataFrame:
    """rows with grp, whose estimate judges a row (its language and source, its language, or all), and of, the estimates that it is part of."""
    pair = F.to_json(F.struct(F.coalesce("lang", F.lit("\0")).alias("l"), F.coalesce("source", F.lit("\0")).alias("s")))
    lang = F.to_json(F.struct(F.coalesce("lang", F.lit("\0")).alias("l")))
    counted = cut(rows.where("fit").groupBy("lang", "source").agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    by_lang = Window.partitionBy("lang")
    level = F.when(F.col("n") >= least, 0).when(F.sum("n").over(by_lang) >= least, 1).when(F.lit(total >= least), 2)
    leveled = cut(counted.withColumn("level", level))
    for_all = not leveled.where("level = 2").isEmpty()
    needed = F.max(F.col("level") == 1).over(by_lang)
    of = F.array_compact(F.array(F.when(F.col("level") == 0, pair), F.when(needed, lang), F.when(F.lit(for_all), "*")))
    grp = F.when(F.col("level") == 0, pair).when(F.col("level") == 1, lang).when(F.col("level") == 2, "*")
    groups = cut(leveled.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), grp.alias("grp"), of.alias("of")))
    return rows.join(_few(groups), F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s")), "left").drop("__l", "__s")


def _estimate(moments: DataFrame, keys: list[str], ridge: float, grow: float = 1.0) -> DataFrame:
    """Means, Cholesky factor and log-determinant of the scatter, grow times that of the summed moments n, s_i, q_i_j."""
    n = F.col("n")
    means = moments.select(*keys, "n", *[(F.col(f"s_{i}") / n).alias(f"m_{i}") for i in range(_P)], *[(F.col(f"q_{i}_{j}") / n).alias(f"q_{i}_{j}") for i, j in _PAIRS])
    out = means.select(*keys, "n", *[f"m_{i}" for i in range(_P)], *[(grow * (F.col(f"q_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) + F.lit(ridge if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS])
    for i in range(_P):  # a column of the factor per step, so that expressions stay small
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    logdet = sum((F.log(f"l_{i}_{i}") for i in range(_P)), F.lit(0.0))
    return out.select(*keys, logdet.alias("logdet"), *[f"m_{i}" for i in range(_P)], *[f"l_{i}_{j}" for i, j in _PAIRS])


def _with_distance(rows: DataFrame) -> DataFrame:
    """d2 by forward substitution, a column per step."""
    for i in range(_P):
        rest = F.col(f"x_{i}") - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        rows = rows.withColumn(f"z_{i}", rest / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(_P)), F.lit(0.0)))


def _moments(x: list[Column]) -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s_{i}") for i in range(_P)], *[F.sum(x[i] * x[j]).alias(f"q_{i}_{j}") for i, j in _PAIRS]]


def _concentrate(rows: DataFrame, estimates: DataFrame, keys: list[str], share: float, ridge: float) -> DataFrame:
    """One concentration step for each group and start."""
    x = [F.col(c) for c in _X]
    far = _with_distance(rows.join(_few(estimates), "grp"))
    band = F.floor(F.log2(F.col("d2") + 1e-6) * _BINS).cast("int").alias("band")
    bands = far.select(*keys, band, *x).groupBy(*keys, "band").agg(*_moments(x))
    up_to = Window.partitionBy(*keys).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    placed = bands.withColumn("below", F.coalesce(F.sum("n").over(up_to), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    near = placed.where(F.col("below") < share * F.col("all"))
    sums = near.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"s_{i}").alias(f"s_{i}") for i in range(_P)], *[F.sum(f"q_{i}_{j}").alias(f"q_{i}_{j}") for i, j in _PAIRS])
    return _estimate(sums, keys, ridge)


def mcd(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """(grp, m_*, l_*): the reweighted MCD centre and Cholesky factor of x_0.. in each grp."""
    ridge = 1.0
    centre = rows.groupBy("grp").agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"p_{c}") for c in _X])
    scale = lambda c: F.greatest((F.col(f"p_{c}")[2] - F.col(f"p_{c}")[0]) / 1.349, F.lit(1.0))
    robust = centre.select("grp", *[F.col(f"p_{c}")[1].alias(f"mid_{c}") for c in _X], *[scale(c).alias(f"dev_{c}") for c in _X])
    z = [(F.col(c) - F.col(f"mid_{c}")) / F.col(f"dev_{c}") for c in _X]
    norm = F.sqrt(sum((v * v for v in z), F.lit(1e-12)))
    squash = F.struct(F.lit("squash").alias("start"), *[F.tanh(v).alias(f"y_{i}") for i, v in enumerate(z)])
    sign = F.struct(F.lit("sign").alias("start"), *[(v / norm).alias(f"y_{i}") for i, v in enumerate(z)])
    known = [*[f"mid_{c}" for c in _X], *[f"dev_{c}" for c in _X]]
    robust = cut(robust)
    turned = rows.join(_few(robust), "grp").select("grp", *known, F.explode(F.array(squash, sign)).alias("v")).select("grp", *known, "v.*")
    y = [F.col(f"y_{i}") for i in range(_P)]
    shape = turned.groupBy("grp", "start", *known).agg(*_moments(y))
    # A start's scatter: the correlation of squashed or sign values, rescaled by the robust deviations.
    n = F.col("n")
    cov = {(i, j): F.col(f"q_{i}_{j}") / n - F.col(f"s_{i}") * F.col(f"s_{j}") / n / n for i, j in _PAIRS}
    dev = [F.col(f"dev_{c}") for c in _X]
    corr = {(i, j): cov[i, j] / F.sqrt(F.greatest(cov[i, i] * cov[j, j], F.lit(1e-18))) for i, j in _PAIRS}
    keep = ["grp", "start", *[F.col(f"mid_{c}").alias(f"m_{i}") for i, c in enumerate(_X)]]
    starts = shape.select(*keep, *[((dev[i] * dev[j] * corr[i, j]) if i != j else dev[i] * dev[i] + ridge).alias(f"c_{i}_{j}") for i, j in _PAIRS])
    plain = robust.select("grp", F.lit("plain").alias("start"), *[F.col(f"mid_{c}").alias(f"m_{i}") for i, c in enumerate(_X)], *[(F.col(f"dev_{_X[i]}") * F.col(f"dev_{_X[i]}") if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS])
    begun = starts.unionByName(plain)
    as_sums = begun.select("grp", "start", F.lit(1).alias("n"), *[F.col(f"m_{i}").alias(f"s_{i}") for i in range(_P)], *[(F.col(f"c_{i}_{j}") + F.col(f"m_{i}") * F.col(f"m_{j}")).alias(f"q_{i}_{j}") for i, j in _PAIRS])
    estimates = cut(_estimate(as_sums, ["grp", "start"], ridge))
    for _ in range(steps):
        estimates = cut(_concentrate(rows, estimates, ["grp", "start"], share, ridge))
    best = cut(estimates.groupBy("grp").agg(F.min_by(F.struct(*[c for c in estimates.columns if c not in ("grp", "start")]), F.struct("logdet", "start")).alias("e")).select("grp", "e.*"))
    # Consistency: the median distance of a normal sample; then one reweighting.
    x = [F.col(c) for c in _X]
    far = cut(_with_distance(rows.join(_few(best), "grp")).select("grp", *x, "d2"))
    factor = cut(far.groupBy("grp").agg((F.percentile_approx("d2", 0.5, 1000) / 4.3515).alias("factor")))
    near = far.join(_few(factor), "grp").where(F.col("d2") <= _CHI2_975 * F.greatest(F.col("factor"), F.lit(1e-9)))
    return cut(_estimate(near.groupBy("grp").agg(*_moments(x)), ["grp"], ridge, _CONSISTENT))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance), a row per row of docs."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = cut(with_statistics(base).drop("text").withColumn("base_failed", failed).select("*", (F.col("n_words") > 0).alias("fit"), *features()))
    rows = cut(_grouped(measured, least))
    estimates = mcd(rows.where("fit").select(F.explode("of").alias("grp"), *_X))
    judged = _with_distance(rows.join(_few(estimates), "grp", "left"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).alias("kept"),
        F.sqrt("d2").alias("distance"),
    )


def op1_quality(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return quality(read_table(spark, sf_dir, "documents"))
