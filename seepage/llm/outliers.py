"""Quality rules and robust multivariate outliers, with DataFrame functions only.

Every text gives a vector of transformed statistics.  For each language and
source the minimum-covariance-determinant estimate of location and scatter is
found by concentration: the share ``CORE`` of rows with the smallest distances
gives the next mean and covariance, and so on.  There are three starts: the
diagonal of the absolute deviations, and the correlations of the hyperbolic
tangents and of the spatial signs of the centred rows.  After ``EARLY`` rounds
the start with the least determinant goes on until its determinant falls no
more.  A text is rejected if its squared Mahalanobis distance from that core,
scaled so that the median distance is that of a normal vector of as many
statistics as vary in the group, lies beyond ``CUTOFF``.

Each round sums moments per group before they are shuffled; a group is only a
row of numbers, which is sent to all tasks while all of them are small, so one
with most of the texts costs no task more.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.functions.text import let
from seepage.llm.tables import stored
from seepage.operators.joins import salted_join

#: Share of rows in the core, rounds of all starts, and the fall of a determinant's logarithm that ends the rounds.
CORE, EARLY, STILL = 0.75, 2, 1e-3
#: Rounds after which a search ends that rounding keeps from standing still; on ``sf0.1`` it took 8.
MOST_ROUNDS = 50
#: Groups with fewer texts are judged together with the other small ones of their language, then by all texts of the
#: language, then by all texts.
LEAST_GROUP = 100
#: Rows for each statistic up to which a group is its own core: part of so few rows says little of their scatter.
ROWS_EACH = 5
#: Bytes of the table of groups up to which it is sent to all tasks.
SENT = 32 << 20
#: Squared distance beyond which a text is rejected: the 0.999 quantile of the chi-squared distribution with five degrees of freedom.
CUTOFF = 20.515006
#: Least degrees of freedom and least factor that distances are divided by; texts that are all alike have neither.
LEAST_FREEDOM = LEAST_SCALE = 0.5
#: Names of the transformed statistics, and the deviation that each may always have, added to the scatter, which stays
#: regular where the core's texts are alike in a statistic.
FEATURES = {"z_words": 0.05, "z_length": 0.01, "z_symbols": 0.1, "z_lines": 0.05, "z_repeats": 0.05}

NAMES = list(FEATURES)
PAIRS = list(combinations_with_replacement(range(len(NAMES)), 2))


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Windows are compared by 64-bit hash.  They are sorted with their places, so
    that equal ones are neighbours; the places of repeated ones are joined up.
    """
    windows = F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i"))))

    def covered(order: Column) -> Column:
        def twice(w: Column, at: Column) -> Column:
            before = F.when(at > 0, F.get(order, at - 1)["h"])
            return F.coalesce(w["h"] == before, F.lit(False)) | F.coalesce(w["h"] == F.get(order, at + 1)["h"], F.lit(False))

        places = F.transform(F.filter(order, twice), lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2))
        return F.size(F.array_distinct(F.flatten(places)))

    return F.coalesce(let(F.array_sort(windows), covered), F.lit(0)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) per row.

    Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none.
    """
    text = F.coalesce("text", F.lit(""))
    blanks = " \t\n\x0b\x0c\r"
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, blanks, "") != "")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    rows = docs.select("doc_id", "lang", "source", text.alias("_t"), words.alias("_w"), lines.alias("_l"))
    return rows.select(
        "doc_id", "lang", "source", F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", blanks, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"), _repeated(F.col("_w")).alias("n_repeat_words"))


def vector(stats: DataFrame) -> DataFrame:
    """``stats`` with the transformed statistics: logarithms of counts, arc sines of shares."""
    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.asin(F.sqrt(F.col(part) / F.col(whole)))).otherwise(0.0)

    return stats.withColumns({
        "z_words": F.log1p("n_words"), "z_length": F.when(F.col("n_words") > 0, F.log(F.col("word_chars") / F.col("n_words"))).otherwise(0.0),
        "z_symbols": F.when(F.col("word_chars") > 0, F.log1p(1000.0 * F.col("n_symbols") / F.col("word_chars"))).otherwise(0.0),
        "z_lines": share("n_dup_lines", "n_lines"), "z_repeats": share("n_repeat_words", "n_words")})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _named(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), p), F.lit("?")) for p in parts])


def _sent(groups: DataFrame, on: str) -> bool:
    """Whether three rows of each group, of 64 numbers each, are few enough to be sent to all tasks; ``groups`` is a written table."""
    return (groups.agg(F.sum(3 * (F.octet_length(on) + F.lit(16 * 64)))).first()[0] or 0) <= SENT


def _meet(rows: DataFrame, groups: DataFrame, on: str, sent: bool) -> DataFrame:
    """Rows with the one or few rows of their group."""
    return rows.join(F.broadcast(groups), on) if sent else salted_join(rows, groups, on)


def grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with ``grp``, the group that judges a row, and ``feeds``, the groups whose estimate it is part of.

    A group is a language and source, the pool of small groups of a language,
    a whole language (for a pool that is small itself) or all rows (for such a
    pool of a small language).
    """
    sizes = stored(rows.groupBy("lang", "source").agg(F.count("*").alias("n")), "sizes")
    fine = F.col("n") >= LEAST_GROUP
    langs = sizes.groupBy("lang").agg(F.sum("n").alias("total"), F.sum(F.when(~fine, F.col("n")).otherwise(0)).alias("pool"))
    langs = langs.withColumn("lone", (F.col("pool") > 0) & (F.col("pool") < LEAST_GROUP)).withColumn("large", F.col("total") >= LEAST_GROUP)
    all_rows = langs.agg(F.max(F.col("lone") & ~F.col("large"))).first()[0] or False
    lang, everything = F.col("s.lang"), F.lit("")
    pool = F.when(~F.col("lone"), _named(lang)).when(F.col("large"), F.concat(_named(lang), F.lit("\x1f*"))).otherwise(everything)
    judge = F.when(fine, _named(lang, F.col("s.source"))).otherwise(pool)
    feeds = F.array(judge, F.when(F.col("lone") & F.col("large"), pool), everything if all_rows else judge)
    groups = sizes.alias("s").join(langs.alias("l"), F.expr("s.lang <=> l.lang")).select(
        _named(lang, F.col("s.source")).alias("_own"), judge.alias("grp"), F.array_distinct(F.array_compact(feeds)).alias("feeds"))
    groups = stored(groups, "groups")
    return _meet(rows.withColumn("_own", _named(F.col("lang"), F.col("source"))), groups, "_own", _sent(groups, "_own")).drop("_own")


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and covariance of each group (m0.., c0_0..), with the allowed deviations added."""
    # moments around the group's own median, which keeps the differences exact
    shifted = [F.col(name) - F.col(f"s{i}") for i, name in enumerate(NAMES)]
    sums = rows.groupBy("grp", "start", *[f"s{i}" for i in range(len(NAMES))]).agg(
        F.count("*").alias("n"), *[F.avg(x).alias(f"a{i}") for i, x in enumerate(shifted)],
        *[F.avg(shifted[i] * shifted[j]).alias(f"q{i}_{j}") for i, j in PAIRS])
    allowed = list(FEATURES.values())
    covariance = [(F.col(f"q{i}_{j}") - F.col(f"a{i}") * F.col(f"a{j}") + F.lit(allowed[i] ** 2 if i == j else 0.0)).alias(f"c{i}_{j}") for i, j in PAIRS]
    return sums.select("grp", "start", *[f"s{i}" for i in range(len(NAMES))], *[(F.col(f"s{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in range(len(NAMES))], *covariance)


def _whitened(groups: DataFrame) -> DataFrame:
    """Groups with the inverse of the covariance's Cholesky factor (w0_0..), row by row, and ``size``, the logarithm of its determinant."""
    def at(kind: str, i: int, j: int) -> Column:
        return F.col(f"{kind}{i}_{j}")

    def left(i: int, j: int) -> Column:
        return sum((-at("l", i, k) * at("l", j, k) for k in range(j)), at("c", j, i))

    for j in range(len(NAMES)):
        groups = groups.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(left(j, j), F.lit(1e-12))))
        groups = groups.withColumns({f"l{i}_{j}": left(i, j) / at("l", j, j) for i in range(j + 1, len(NAMES))})
    groups = groups.withColumns({f"w{i}_{i}": 1 / at("l", i, i) for i in range(len(NAMES))})
    for apart in range(1, len(NAMES)):
        places = [(j + apart, j) for j in range(len(NAMES) - apart)]
        groups = groups.withColumns({
            f"w{i}_{j}": -sum((at("l", i, k) * at("w", k, j) for k in range(j, i)), F.lit(0.0)) / at("l", i, i) for i, j in places})
    kept = [f"w{i}_{j}" for i in range(len(NAMES)) for j in range(i + 1)]
    size = sum((-2 * F.log(f"w{i}_{i}") for i in range(len(NAMES))), F.lit(0.0))
    return groups.select("grp", "start", *[f"s{i}" for i in range(len(NAMES))], *[f"m{i}" for i in range(len(NAMES))], *kept, size.alias("size"))


def _distance() -> Column:
    """Squared length of the whitened difference from the group's mean."""
    total = F.lit(0.0)
    for i in range(len(NAMES)):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"w{i}_{j}") * (F.col(NAMES[j]) - F.col(f"m{j}"))
        total = total + y * y
    return total


def _starts(rows: DataFrame) -> tuple[DataFrame, bool]:
    """Three first estimates of each group, around its medians, and whether tables of groups are sent."""
    places = range(len(NAMES))
    medians = stored(rows.groupBy("grp").agg(*[F.percentile_approx(name, 0.5).alias(f"s{i}") for i, name in enumerate(NAMES)]), "medians")
    sent = _sent(medians, "grp")
    spread = _meet(rows, medians, "grp", sent).groupBy("grp", *[f"s{i}" for i in places]).agg(
        *[F.percentile_approx(F.abs(F.col(name) - F.col(f"s{i}")), 0.5).alias(f"d{i}") for i, name in enumerate(NAMES)])
    # 1.4826 turns a median absolute deviation into a standard deviation
    scales = [F.sqrt(F.pow(F.col(f"d{i}") * 1.4826, F.lit(2)) + F.lit(allowed**2)).alias(f"v{i}") for i, allowed in enumerate(FEATURES.values())]
    spread = stored(spread.select("grp", *[f"s{i}" for i in places], *scales), "spreads")
    centred = _meet(rows, spread, "grp", sent).withColumns({f"z{i}": (F.col(name) - F.col(f"s{i}")) / F.col(f"v{i}") for i, name in enumerate(NAMES)})
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in places), F.lit(0.0)))
    shapes = {"t": [F.tanh(f"z{i}") for i in places], "g": [F.when(length > 0, F.col(f"z{i}") / length).otherwise(0.0) for i in places]}
    products = centred.groupBy("grp", *[f"{x}{i}" for x in "sv" for i in places]).agg(
        *[F.avg(u[i] * u[j]).alias(f"{x}{i}_{j}") for x, u in shapes.items() for i, j in PAIRS])

    def covariance(shape: str | None, i: int, j: int) -> Column:
        scale = F.col(f"v{i}") * F.col(f"v{j}")
        if i == j or shape is None:
            return scale if i == j else F.lit(0.0)
        own = F.sqrt(F.col(f"{shape}{i}_{i}") * F.col(f"{shape}{j}_{j}"))
        # a little less than the correlation keeps the matrix regular
        return F.when(own > 0, 0.99 * F.col(f"{shape}{i}_{j}") / own * scale).otherwise(0.0)

    products = stored(products, "products")
    first = [products.select(
        "grp", F.lit(k).alias("start"), *[f"s{i}" for i in places], *[F.col(f"s{i}").alias(f"m{i}") for i in places],
        *[covariance(shape, i, j).alias(f"c{i}_{j}") for i, j in PAIRS]) for k, shape in enumerate((None, *shapes))]
    return stored(_whitened(first[0].unionByName(first[1]).unionByName(first[2])), "estimates"), sent


def _concentrated(rows: DataFrame, groups: DataFrame, sent: bool) -> DataFrame:
    """Estimates from the rows that lie nearest to the last ones."""
    few = F.count("*") <= ROWS_EACH * len(NAMES)
    edge = _meet(rows, groups, "grp", sent).withColumn("_d", _distance()).groupBy("grp", "start").agg(
        F.when(few, F.max("_d")).otherwise(F.percentile_approx("_d", CORE, 10000)).alias("_edge"))
    bounded = groups.join(edge, ["grp", "start"])
    return stored(_whitened(_moments(_meet(rows, bounded, "grp", sent).filter(_distance() <= F.col("_edge")))), "estimates")


def estimates(rows: DataFrame) -> tuple[DataFrame, bool]:
    """Per group the mean, the whitening factor and the median distance ``middle``, for rows with ``grp``; whether they are sent.

    A round takes the core of the last one, which does not raise the
    determinant (but for ties and approximate quantiles at the core's edge).
    """
    groups, sent = _starts(rows)
    for _ in range(EARLY):
        groups = _concentrated(rows, groups, sent)
    best = groups.groupBy("grp").agg(F.min(F.struct("size", "start")).alias("_best")).select("grp", "_best.start")
    groups = stored(groups.join(best, ["grp", "start"]), "estimates")
    for _ in range(EARLY, MOST_ROUNDS):
        last, groups = groups, _concentrated(rows, groups, sent)
        if groups.join(last.select("grp", F.col("size").alias("_last")), "grp").filter(F.col("size") < F.col("_last") - STILL).isEmpty():
            break
    middle = _meet(rows, groups, "grp", sent).groupBy("grp").agg(F.percentile_approx(_distance(), 0.5, 10000).alias("middle"))
    return stored(groups.join(middle, "grp"), "estimates"), sent


def _scale() -> Column:
    """Median distance over that of a normal vector of the statistics that vary; those at the allowed deviation only do not."""
    freedom = F.lit(float(len(NAMES)))
    for i, allowed in enumerate(FEATURES.values()):
        for j in range(i, len(NAMES)):
            freedom = freedom - allowed**2 * F.pow(F.col(f"w{j}_{i}"), F.lit(2))
    freedom = F.greatest(freedom, F.lit(LEAST_FREEDOM))
    # Wilson and Hilferty's median of the chi-squared distribution
    return F.greatest(F.col("middle") / (freedom * F.pow(1 - 2 / (9 * freedom), F.lit(3))), F.lit(LEAST_SCALE))


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Statistics, ``base_failed``, ``distance`` and ``kept`` per row of ``docs`` (doc_id, text, lang, source).

    Rows that fail the base rules take no part in the estimates.  Null
    languages and sources are groups of their own; every other text is judged,
    by the texts that ``grouped`` names.  A group whose texts are all alike
    keeps what lies within about three times the allowed deviations; up to
    about ten texts in all are too few for any to be far away.
    """
    stats = stored(statistics(docs).withColumn("base_failed", base_failed()), "statistics")
    rows = stored(grouped(vector(stats.filter("not base_failed"))), "vectors")
    feeding = stored(rows.select(F.explode("feeds").alias("grp"), *NAMES), "members")
    groups, sent = estimates(feeding)
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = _meet(rows, groups, "grp", sent).select(*out, (_distance() / _scale()).alias("distance")).withColumn("kept", F.col("distance") <= cutoff)
    bad = stats.filter("base_failed").select(*out, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return good.unionByName(bad)
