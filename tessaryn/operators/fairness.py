"""Approval rates, disparate impact and tests between groups (A16 to A21, ST1 to ST8), and chart data (V1 to V6).

Statistics are aggregated on the cluster; only the final handful of numbers of a test comes to the
driver, where p-values are worked out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaryn.functions import tails
from tessaryn.functions.fields import AGE_BANDS, band_rank
from tessaryn.runtime import written

FOUR_FIFTHS, PRIME = 0.8, "25-34"
FEATURES = ["clean_annual_income", "clean_credit_history_months", "clean_debt_to_income", "clean_savings_balance"]


def with_outcome(df: DataFrame, null_outcome: str = "reject") -> DataFrame:
    """``approved`` as 1 or 0; a missing outcome counts as rejected, or drops the row with ``exclude``."""
    yes = F.coalesce(F.col("clean_loan_approved"), F.lit(False)).cast("int")
    return (df.where(F.col("clean_loan_approved").isNotNull()) if null_outcome == "exclude" else df).withColumn("approved", yes)


def gender_subset(df: DataFrame) -> DataFrame:
    return df.where(F.col("clean_gender").isin("Male", "Female") & F.col("approved").isNotNull())


def age_subset(df: DataFrame) -> DataFrame:
    return df.where(F.col("age_band").isNotNull() & F.col("approved").isNotNull())


def approval_table(df: DataFrame, *keys: str) -> DataFrame:
    """``n``, ``approved_n`` and ``approval_rate`` of each observed group."""
    g = df.groupBy(*keys).agg(F.count("approved").alias("n"), F.sum("approved").alias("approved_n"))
    return g.withColumn("approval_rate", F.col("approved_n") / F.nullif("n", F.lit(0)))


def interaction_table(df: DataFrame) -> DataFrame:
    return approval_table(age_subset(gender_subset(df)), "age_band", "clean_gender").orderBy(band_rank(F.col("age_band")), "clean_gender")


def disparate_impact(df: DataFrame, group: str, privileged: str, unprivileged: str) -> DataFrame:
    """One row: both groups' sizes and rates, ratio (null if the privileged rate is 0 or unknown), difference, four-fifths flag."""
    side = lambda v, f: f(F.when(F.col(group) == v, F.col("approved")))
    one = df.agg(side(privileged, F.count).alias("privileged_n"), side(unprivileged, F.count).alias("unprivileged_n"), side(privileged, F.avg).alias("privileged_rate"), side(unprivileged, F.avg).alias("unprivileged_rate"))
    return _impact(one.withColumns({"privileged_group": F.lit(privileged), "unprivileged_group": F.lit(unprivileged)}))


def _impact(df: DataFrame) -> DataFrame:
    p, u = F.col("privileged_rate"), F.col("unprivileged_rate")
    ratio = F.when(p > 0, u / p)
    return df.select("privileged_group", "unprivileged_group", "privileged_n", "unprivileged_n", "privileged_rate", "unprivileged_rate", ratio.alias("disparate_impact"), (u - p).alias("demographic_parity_difference"), F.coalesce(ratio < FOUR_FIFTHS, F.lit(False)).alias("four_fifths_flag"))


def age_impact_table(df: DataFrame, reference: str = PRIME) -> DataFrame:
    """Disparate impact of each present band against the reference band, in age order."""
    t = approval_table(age_subset(df), "age_band")
    ref = t.where(F.col("age_band") == reference).agg(F.first("n").alias("privileged_n"), F.first("approval_rate").alias("privileged_rate"))
    both = t.where(F.col("age_band") != reference).crossJoin(ref)  # at most five rows and one
    both = both.select(F.lit(reference).alias("privileged_group"), F.col("age_band").alias("unprivileged_group"), F.coalesce("privileged_n", F.lit(0)).alias("privileged_n"), F.col("n").alias("unprivileged_n"), "privileged_rate", F.col("approval_rate").alias("unprivileged_rate"))
    return _impact(both).orderBy(band_rank(F.col("unprivileged_group")))


def chi2_statistic(df: DataFrame, group: str, outcome: str = "approved") -> DataFrame:
    """One row ``chi2``, ``dof`` of independence over the contingency table, with Yates' correction for one degree."""
    cells = df.where(F.col(group).isNotNull() & F.col(outcome).isNotNull()).groupBy(F.col(group).alias("g"), F.col(outcome).alias("o")).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy("g").agg(F.sum("n").alias("r")), cells.groupBy("o").agg(F.sum("n").alias("c"))
    grid = rows.crossJoin(cols).join(cells, ["g", "o"], "left")  # groups times outcomes: the table itself
    t = F.sum("c").over(W.partitionBy("g"))
    grid = grid.withColumn("e", F.col("r") * F.col("c") / t).withColumn("d", F.abs(F.coalesce("n", F.lit(0)) - F.col("e")))
    dof = (F.count_distinct("g") - 1) * (F.count_distinct("o") - 1)
    plain, yates = F.sum(F.col("d") * F.col("d") / F.col("e")), F.sum(F.pow(F.col("d") - F.least(F.lit(0.5), F.col("d")), 2) / F.col("e"))
    return grid.agg(F.when(dof == 1, yates).otherwise(plain).alias("chi2"), dof.cast("bigint").alias("dof"))


def chi2_test(df: DataFrame, group: str, outcome: str = "approved") -> DataFrame:
    """``chi2`` (4 places), ``p_value`` (6), ``dof``, ``significant_at_05``; one row."""
    x, dof = chi2_statistic(df, group, outcome).first()
    p = tails.chi2_tail(x, dof) if x is not None and dof else None
    return df.sparkSession.createDataFrame([(None if x is None else round(x, 4), None if p is None else round(p, 6), dof, bool(p is not None and p < 0.05))], "chi2 double, p_value double, dof bigint, significant_at_05 boolean")


def value_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by``, ``value``, ``t`` (how often), ``rank``: average ranks from distinct values' counts.

    Running sums are taken in 256 ranges of the values and over the ranges, so no window holds all values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("t"))
    at = [i / 256 for i in range(1, 256)]
    cut = counts.groupBy(*by).agg(F.percentile_approx("v", at, 1000).alias("_cuts"))
    counts = counts.join(cut, by) if by else counts.join(F.broadcast(cut))  # one row
    counts = counts.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("v")))).drop("_cuts")
    sums = counts.groupBy(*by, "_b").agg(F.sum("t").alias("_s"))
    sums = sums.select(*by, "_b", (F.sum("_s").over(W.partitionBy(*by).orderBy("_b")) - F.col("_s")).alias("_before"))
    inside = F.sum("t").over(W.partitionBy(*by, "_b").orderBy("v")) - F.col("t")
    return counts.withColumn("_in", inside).join(sums, [*by, "_b"]).select(*by, "v", "t", (F.col("_before") + F.col("_in") + (F.col("t") + 1) / 2).alias("rank"))


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """``by`` and one interpolated quantile for each entry of ``at``, exact, from ranks of distinct values: no task holds a group's values."""
    ranks = value_ranks(df, by, value)
    first, last = F.col("rank") - (F.col("t") - 1) / 2, F.col("rank") + (F.col("t") - 1) / 2
    size = ranks.groupBy(*by).agg(F.sum("t").alias("_n"))
    r = ranks.join(size, by) if by else ranks.join(F.broadcast(size))  # one row
    out = []
    for name, p in at.items():
        place = (F.col("_n") - 1) * p + 1
        low, high = F.floor(place), F.ceil(place)
        pick = lambda k: F.max(F.when((first <= k) & (last >= k), F.col("v")))
        out += [pick(low).alias(f"_l{name}"), pick(high).alias(f"_h{name}"), F.max(place - low).alias(f"_w{name}")]
    g = r.groupBy(*by).agg(*out)
    return g.select(*by, *[(F.col(f"_l{n}") * (1 - F.col(f"_w{n}")) + F.col(f"_h{n}") * F.col(f"_w{n}")).alias(n) for n in at])


def mann_whitney_statistics(df: DataFrame, features: list[str], group: str = "clean_gender", first: str = "Male", second: str = "Female") -> DataFrame:
    """``feature``, ``n1``, ``n2``, ``u_stat`` (of the first group), ``ties``: all features in one ranked pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    long = df.where(F.col(group).isin(first, second)).select((F.col(group) == first).alias("_one"), pairs.alias("x")).select("_one", "x.*").where("value IS NOT NULL")
    ranks = value_ranks(long, ["feature"], "value")
    own = long.where("_one").groupBy("feature", F.col("value").alias("v")).agg(F.count("*").alias("_k"))
    both = ranks.join(own, ["feature", "v"], "left").fillna(0, ["_k"])
    g = both.groupBy("feature").agg(F.sum("_k").alias("n1"), (F.sum("t") - F.sum("_k")).alias("n2"), F.sum(F.col("_k") * F.col("rank")).alias("_r"), F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    return g.select("feature", "n1", "n2", (F.col("_r") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u_stat"), "ties")


def proxy_table(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Mann-Whitney tests and exact medians of financial features between men and women (ST5)."""
    g = gender_subset(df)
    stat = {r.feature: r for r in mann_whitney_statistics(g, features).collect()}  # one row per feature
    long = g.select("clean_gender", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select("clean_gender", "x.*")
    mid = {f"{r.clean_gender}_{r.feature}": r.median for r in quantiles(long, ["clean_gender", "feature"], "value", {"median": 0.5}).collect()}  # two rows per feature
    rows = []
    for f in features:
        r, p = stat.get(f), None
        if r and r.n1 >= 2 and r.n2 >= 2:
            p = tails.mann_whitney_p(r.u_stat, r.n1, r.n2, r.ties)
        m, w = mid.get(f"Male_{f}"), mid.get(f"Female_{f}")
        rows.append((f, None if m is None else round(float(m), 4), None if w is None else round(float(w), 4), None if p is None else round(r.u_stat, 1), None if p is None else round(p, 6), bool(p is not None and p < 0.05)))
    return df.sparkSession.createDataFrame(rows, "feature string, male_median double, female_median double, u_stat double, p_value double, significant_at_05 boolean")


def credit_age_statistic(df: DataFrame) -> DataFrame:
    """One row ``n``, ``rho``: Spearman correlation of age band and credit history from average ranks."""
    d = age_subset(df).select(band_rank(F.col("age_band")).alias("x"), F.col("clean_credit_history_months").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    both = F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col("x").cast("double").alias("value")), F.struct(F.lit("y").alias("side"), F.col("y").alias("value"))))
    r = value_ranks(d.select(both.alias("s")).select("s.*"), ["side"], "value")
    cells = d.groupBy("x", "y").agg(F.count("*").alias("k"))
    for side in ("x", "y"):
        cells = cells.join(r.where(F.col("side") == side).select(F.col("v").alias(side), F.col("rank").alias(f"r{side}")), side)
    k, x, y = F.col("k"), F.col("rx"), F.col("ry")
    n = F.sum(k)
    cov = F.sum(k * x * y) - F.sum(k * x) * F.sum(k * y) / n
    var = lambda v: F.sum(k * v * v) - F.sum(k * v) * F.sum(k * v) / n
    return cells.agg(n.alias("n"), (cov / F.nullif(F.sqrt(var(x) * var(y)), F.lit(0.0))).alias("rho"))


def credit_age_correlation(df: DataFrame) -> DataFrame:
    n, rho = credit_age_statistic(df).first()
    p = None
    if rho is not None and n > 2:
        p = 0.0 if abs(rho) >= 1 else tails.t_two_sided(rho * ((n - 2) / (1 - rho * rho)) ** 0.5, n - 2)
    return df.sparkSession.createDataFrame([(None if rho is None else round(rho, 4), None if p is None else round(p, 6), bool(p is not None and p < 0.05))], "spearman_rho double, p_value double, significant_at_05 boolean")


def interest_rates(df: DataFrame) -> DataFrame:
    """Number, exact median and mean of approved applicants' rates by gender (ST7 without its test)."""
    d = gender_subset(df).where("approved = 1")
    side = lambda s: F.when(F.col("clean_gender") == s, F.col("clean_interest_rate"))
    plain = d.agg(*[a for s in ("Male", "Female") for a in (F.count(side(s)).alias(f"{s.lower()}_n"), F.avg(side(s)).alias(f"{s.lower()}_mean_rate"))])
    mid = quantiles(d, ["clean_gender"], "clean_interest_rate", {"_m": 0.5}).agg(*[F.max(F.when(F.col("clean_gender") == s, F.col("_m"))).alias(f"{s.lower()}_median_rate") for s in ("Male", "Female")])
    return plain.join(F.broadcast(mid)).select("male_n", "male_median_rate", "male_mean_rate", "female_n", "female_median_rate", "female_mean_rate")  # one row each


def interest_rate_test(df: DataFrame) -> DataFrame:
    one = interest_rates(df)
    r = mann_whitney_statistics(gender_subset(df).where("approved = 1"), ["clean_interest_rate"]).first()
    p = tails.mann_whitney_p(r.u_stat, r.n1, r.n2, r.ties) if r and r.n1 >= 2 and r.n2 >= 2 else None
    return one.withColumns({"u_stat": F.lit(None if p is None else round(r.u_stat, 1)).cast("double"), "p_value": F.lit(None if p is None else round(p, 6)).cast("double"), "significant_at_05": F.lit(bool(p is not None and p < 0.05))})


def rejection_reasons(df: DataFrame) -> DataFrame:
    """Rejected applicants by reason and gender, with totals, most first (A18); null reasons left out."""
    d = gender_subset(df).where("approved = 0 AND clean_rejection_reason IS NOT NULL")
    g = d.groupBy("clean_rejection_reason").agg(*[F.count_if(F.col("clean_gender") == s).alias(s) for s in ("Female", "Male")])
    return g.withColumn("total", F.col("Female") + F.col("Male")).orderBy(F.desc("total"), "clean_rejection_reason")


def spending_by_gender(analysis: DataFrame, spending: DataFrame, places: int = 2) -> DataFrame:
    """Mean amount of each category by gender, joined on application id (A19): 0 where a group has no item, null where it has no amount."""
    ids = gender_subset(analysis).select("application_id", "clean_gender")
    d = spending.join(ids, "application_id").where("category_clean IS NOT NULL")
    at = lambda s: F.col("clean_gender") == s
    money = F.col("amount_clean").cast("decimal(18,2)")
    mean = lambda s: F.when(F.count_if(at(s)) == 0, 0.0).otherwise(F.round(F.sum(F.when(at(s), money)).cast("double") / F.nullif(F.count(F.when(at(s), money)), F.lit(0)), places))
    return d.groupBy("category_clean").agg(mean("Female").alias("Female"), mean("Male").alias("Male"))


def spending_gaps(table: DataFrame, n: int = 8) -> DataFrame:
    return table.withColumn("gap", F.abs(F.round(F.col("Female") - F.col("Male"), 2))).orderBy(F.desc_nulls_last("gap"), "category_clean").limit(n)


def fairness_summary(df: DataFrame) -> DataFrame:
    """Labelled and formatted results of all tests (ST8). The columns that they need are written once."""
    spark, df = df.sparkSession, written(df.select("clean_gender", "age_band", "approved", "clean_interest_rate"), "outcomes")
    di = disparate_impact(gender_subset(df), "clean_gender", "Male", "Female").first()
    by_gender, by_age, rate = chi2_test(gender_subset(df), "clean_gender").first(), chi2_test(age_subset(df), "age_band").first(), interest_rate_test(df).first()
    text = lambda x, f="{:.4f}": "nan" if x is None else f.format(x)
    rows = [
        ("Gender — Disparate Impact Ratio", text(di.disparate_impact), di.four_fifths_flag, by_gender.p_value, by_gender.significant_at_05, f"Female rate {text(di.unprivileged_rate, '{:.1%}')} vs Male {text(di.privileged_rate, '{:.1%}')}"),
        ("Gender — Demographic Parity Difference", text(di.demographic_parity_difference, "{:+.4f}"), None, by_gender.p_value, by_gender.significant_at_05, "Negative = Female approval rate below Male"),
    ]
    for r in age_impact_table(df).collect():  # at most five rows
        rows.append((f"Age — DI ratio ({r.unprivileged_group} vs {PRIME})", text(r.disparate_impact), r.four_fifths_flag, by_age.p_value, by_age.significant_at_05, f"n={r.unprivileged_n}"))
    if rate.male_n or rate.female_n:
        rows.append(("Interest Rate — Gender gap (approved only)", f"Male={text(rate.male_median_rate)} Female={text(rate.female_median_rate)}", None, rate.p_value, rate.significant_at_05, f"n Male={rate.male_n}, n Female={rate.female_n}"))
    return spark.createDataFrame(rows, "analysis string, metric_value string, four_fifths_flag boolean, p_value double, significant_at_05 boolean, note string")


def heatmap_data(df: DataFrame) -> DataFrame:
    """Rate and number of all bands by gender, observed or not (V3)."""
    bands = F.explode(F.array(*[F.lit(b) for b in AGE_BANDS]))
    at = lambda s, c: F.max(F.when(F.col("clean_gender") == s, F.col(c)))
    wide = interaction_table(df).groupBy("age_band").agg(*[at(s, c).alias(f"{s.lower()}_{n}") for s in ("Female", "Male") for c, n in (("approval_rate", "rate"), ("n", "n"))])
    return df.sparkSession.range(1).select(bands.alias("age_band")).join(wide, "age_band", "left").orderBy(band_rank(F.col("age_band")))


def box_data(df: DataFrame, features: list[str]) -> DataFrame:
    """``feature``, ``clean_gender``, ``n``, ``q1``, ``median``, ``q3``, ``low``, ``high`` (V5)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    long = gender_subset(df).select("clean_gender", pairs.alias("x")).select("clean_gender", "x.*").where("value IS NOT NULL")
    by = ["feature", "clean_gender"]
    ends = long.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return ends.join(quantiles(long, by, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}), by).select(*by, "n", "q1", "median", "q3", "low", "high")


def histogram(df: DataFrame, group: str, value: str, bins: int = 15) -> DataFrame:
    """``group``, ``bin`` (1-based), ``n``, ``low``, ``high``: equal bins over each group's own range, the last one closed (V6)."""
    d = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v"))
    ends = d.groupBy(group).agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(width == 0, 1).otherwise(F.least(F.floor((F.col("_v") - F.col("low")) / width) + 1, F.lit(bins)))
    return d.join(ends, group).groupBy(group, at.cast("int").alias("bin"), "low", "high").agg(F.count("*").alias("n")).select(group, "bin", "n", "low", "high")


def rate_marks(df: DataFrame) -> DataFrame:
    """Approval by band with the reference rate and its four-fifths line (V2)."""
    t = approval_table(age_subset(df), "age_band")
    ref = t.where(F.col("age_band") == PRIME).agg(F.first("approval_rate").alias("reference_rate"))
    return t.crossJoin(ref).withColumn("four_fifths_line", F.col("reference_rate") * FOUR_FIFTHS).orderBy(band_rank(F.col("age_band")))  # one reference row


def interest_histogram(df: DataFrame) -> DataFrame:
    """The histogram of approved applicants' rates with each group's median, which is drawn as a line (V6)."""
    d = gender_subset(df).where("approved = 1 AND clean_interest_rate IS NOT NULL")
    return histogram(d, "clean_gender", "clean_interest_rate").join(quantiles(d, ["clean_gender"], "clean_interest_rate", {"group_median": 0.5}), "clean_gender")


def labelled(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)
