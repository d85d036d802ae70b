"""Column-level profile of loads (problem 1): exact aggregates and a classifier two-sample test.

Every value becomes a cell: null, or the quantile range of the column that it lies in together with
its form (negative, zero, round, number of decimals). Exact counts of cells by load and fold are
all that is shuffled. For every load a logistic regression learns on four fifths of a column's cells
to tell the load from the others; how well it does on the rest, cross-fitted, is how far the
column's profile departs, in missing share, range, form or distribution alike. A second model sees
all columns of all rows, as sums of products of their features by load and half, and is refitted
without each column: what it loses is what that column alone tells.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaryn.runtime import written

BINS, FOLDS = 16, 5
FORMS = ["negative", "zero", "thousands", "hundreds", "dozens", "tens", "whole", "one_decimal", "two_decimals", "more_decimals"]
CELLS = 1 + (BINS + 2) * len(FORMS)
#: Rows whose features are held at once.
CHUNK = 50_000
#: A column is suspect if the classifier's AUC is at least this and above the middle of all loads by ``DOUBT`` spreads, and out of
#: line if it is so by ``SPREADS`` of them. In small loads chance alone spreads the AUC widely; there a suspect column is out of line
#: if its missing share, or that of a form of values, is off the middle by this much and so many standard errors.
MIN_AUC, DOUBT, SPREADS, MIN_MISSING, MIN_FORM, ERRORS = 0.6, 1.0, 4.5, 0.15, 0.25, 5.0
#: Or if this share of its values lies beyond the middle load's range by more than half of that range.
MIN_OUTSIDE, MARGIN = 0.05, 0.5


def form_of(v: Column) -> Column:
    """Index into ``FORMS``."""
    tests = [v < 0, v == 0, v % 1000 == 0, v % 100 == 0, v % 12 == 0, v % 10 == 0, v == F.rint(v), F.abs(v - F.round(v, 1)) < 1e-9, F.abs(v - F.round(v, 2)) < 1e-9]
    out = F.lit(len(FORMS) - 1)
    for i, t in reversed(list(enumerate(tests))):
        out = F.when(t, i).otherwise(out)
    return out


def cell_of(v: Column, edges: list[float]) -> Column:
    """0 for null (and NaN), else range times form. Ranges are those between the column's quantiles and the two outside."""
    at = F.lit(0)
    for e in edges:
        at = at + (v > F.lit(float(e))).cast("int")
    return F.when(v.isNull() | F.isnan(v), 0).otherwise(1 + at * len(FORMS) + form_of(v))


def _edges(df: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Distinct quantiles of each column: one row of at most ``BINS`` + 1 numbers per column comes back."""
    at = [0.001, *(i / BINS for i in range(1, BINS)), 0.999]
    got = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), at, 2000).alias(c) for c in columns]).first()
    return {c: sorted(set(got[c] or [])) for c in columns}


def _features(cells: np.ndarray) -> np.ndarray:
    """Null, place in the order of ranges and its square, each range, each form."""
    x = np.zeros((len(cells), 3 + BINS + 2 + len(FORMS)))
    x[:, 0] = cells == 0
    at, form = np.divmod(np.maximum(cells - 1, 0), len(FORMS))
    z = np.where(cells == 0, 0, 2 * at / (BINS + 1) - 1)
    x[:, 1], x[:, 2] = 1.5 * z, np.where(cells == 0, 0, 1.5 * (z * z - 0.35))
    full = np.flatnonzero(cells > 0)
    x[full, 3 + at[full]] = 1
    x[full, 3 + BINS + 2 + form[full]] = 1
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 2.0, steps: int = 6) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -20, 20)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        b = b + np.linalg.solve(h, x.T @ (w * (y - p)) - penalty * b)
    return b


def auc(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float:
    """Chance that a positive weight scores above a negative one, ties half."""
    if pos.sum() <= 0 or neg.sum() <= 0:
        return 0.5
    order = np.argsort(score, kind="stable")
    s, p, n = score[order], pos[order], neg[order]
    start = np.flatnonzero(np.r_[True, np.diff(s) > 1e-12])
    p, n = np.add.reduceat(p, start), np.add.reduceat(n, start)
    below = np.cumsum(n) - n
    return float((p * (below + n / 2)).sum() / (p.sum() * n.sum()))


def column_auc(own: np.ndarray, others: np.ndarray) -> float:
    """Cross-fitted AUC of a logistic regression on the cells of one column.

    ``own`` and ``others`` are fold by cell: counts of the load, and mean shares of the loads. Both sides weigh the same.
    """
    live = np.flatnonzero(own.sum(0) + others.sum(0))
    own, others = own[:, live], others[:, live] / max(others.sum(), 1e-12) * own.sum()
    x = _features(live)
    pos, neg, score_p, score_n = [], [], [], []
    for f in range(FOLDS):
        if own[f].sum() == 0:
            continue
        a, b = own.sum(0) - own[f], others.sum(0) - others[f]
        if a.sum() == 0:
            continue
        beta = fit_logistic(np.vstack([x, x]), np.r_[np.ones(len(x)), np.zeros(len(x))], np.r_[a, b])
        s = x @ beta[:-1]
        score_p.append(s), pos.append(own[f]), neg.append(others[f]), score_n.append(s)
    if not pos:
        return 0.5
    s = np.concatenate(score_p)
    return auc(s, np.concatenate(pos), np.concatenate(neg))


def _moment_auc(own: np.ndarray, others: np.ndarray, keep: np.ndarray, ridge: float = 2.0) -> float:
    """Cross-fitted AUC of a linear model of all columns, from nothing but sums over all rows.

    ``own`` and ``others`` are half by feature by feature: sums of products of the features ``keep``, the last of which is
    1. The model is the first Newton step of the logistic regression, both sides weighing the same; the AUC is
    that of normal scores with the mean and spread that its scores have in the other half.
    """
    own, others = own[:, keep][:, :, keep], others[:, keep][:, :, keep]
    size_own, size_others = own[:, -1, -1], others[:, -1, -1]
    if min(size_own.min(), size_others.min()) <= 0:
        return 0.5
    penalty = np.diag(np.r_[np.full(own.shape[1] - 1, ridge), 1e-6])
    own, others, total = own / size_own[:, None, None], others / size_others[:, None, None], 0.0
    for test in (0, 1):
        a, b = own[1 - test], others[1 - test]
        weight = (size_own[1 - test] + size_others[1 - test]) / 2
        beta = np.linalg.solve(weight * (a + b) / 4 + penalty, weight * (a[-1] - b[-1]) / 2)[:-1]
        (m, v), (n, w) = ((x[-1, :-1] @ beta, max(beta @ (x[:-1, :-1] - np.outer(x[-1, :-1], x[-1, :-1])) @ beta, 0)) for x in (own[test], others[test]))
        total += size_own[test] * (1 + erf((m - n) / sqrt(2 * (v + w) + 1e-12))) / 2
    return float(total / size_own.sum())


def _coarse(cells: np.ndarray) -> np.ndarray:
    x = _features(cells)
    ranges = x[:, 3 : 3 + BINS + 2]
    return np.column_stack([x[:, :3], ranges.reshape(len(x), -1, 3).sum(2), x[:, 3 + BINS + 2 :]])


def _moments(cells: pd.DataFrame, picks: list[str]) -> np.ndarray:
    """Half by feature by feature: sums of products of the features of all columns and 1, rows counted ``n`` times."""
    out = 0.0
    for at in range(0, max(len(cells), 1), CHUNK):
        part = cells.iloc[at : at + CHUNK]
        x, n = np.column_stack([*(_coarse(part[c].to_numpy()) for c in picks), np.ones(len(part))]), part["n"].to_numpy()
        out = out + np.stack([(x * (n * (part["half"].to_numpy() == h))[:, None]).T @ x for h in (0, 1)])
    return out


def _error(share: Column, n: Column) -> Column:
    """Standard error of a share among ``n``, not quite 0 for shares of 0 and 1."""
    return F.sqrt((share + 1 / n) * (1 - share + 1 / n) / n)


def profile(df: DataFrame, table_name: str, load_col: str, columns: list[str], row_hash: Column) -> DataFrame:
    """One row per load and column: exact aggregates, departure by the classifier, and whether it is out of line.

    Columns: ``table_name``, ``load_id``, ``column_name``, ``n_rows``, ``missing``, ``n_distinct``, ``low``,
    ``high``, ``mean``, ``middle_missing``, ``auc``, ``joint_auc``, ``ablation`` (what the model of all columns
    loses without this one; null where it is the only one), ``form_shift`` (largest significant change of a form's share, else null), ``outside``
    (share far out of the middle load's range), ``found``.
    Rows without a load id are left out; a load of nulls only has null aggregates; tied values share
    their cell; an empty table gives no rows. ``row_hash`` spreads rows over folds; equal rows share one.
    """
    d = df.where(F.col(load_col).isNotNull()).select(
        F.col(load_col).cast("string").alias("load_id"), F.pmod(row_hash, F.lit(FOLDS)).cast("int").alias("fold"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"v{i}") for i, c in enumerate(columns)]
    )
    edges = _edges(d, [f"v{i}" for i in range(len(columns))])
    cells = d.withColumns({f"c{i}": cell_of(F.col(f"v{i}"), edges[f"v{i}"]) for i in range(len(columns))})
    long = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(f"v{i}").alias("v"), F.col(f"c{i}").alias("cell")) for i in range(len(columns))]))
    values = cells.select("load_id", "fold", long.alias("x")).groupBy("load_id", "x.col", "fold", "x.cell", "x.v").agg(F.count("*").alias("n"))
    values = written(values, "value_counts")
    v, n = F.col("v"), F.col("n")
    base = values.groupBy("load_id", "col").agg(
        F.sum("n").alias("n_rows"), (F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)) / F.sum("n")).alias("missing"), F.count_distinct("v").alias("n_distinct"), F.min("v").alias("low"), F.max("v").alias("high"), (F.sum(v * n) / F.sum(F.when(v.isNotNull(), n))).alias("mean")
    )
    counts = values.groupBy("load_id", "col", "fold", "cell").agg(F.sum("n").alias("n"))
    sizes = base.where("col = 0").select("load_id", F.col("n_rows").alias("_size"))
    share = counts.join(sizes, "load_id").groupBy("col", "fold", "cell").agg(F.sum(F.col("n") / F.col("_size")).alias("share")).toPandas()  # columns * folds * CELLS numbers at most
    others = np.zeros((len(columns), FOLDS, CELLS))
    others[share["col"], share["fold"], share["cell"]] = share["share"]

    form = F.when(F.col("cell") > 0, (F.col("cell") - 1) % len(FORMS))
    forms = counts.groupBy("load_id", "col", form.alias("form")).agg(F.sum("n").alias("n")).where("form IS NOT NULL")
    grid = base.select("load_id", "col", "n_rows").withColumn("form", F.explode(F.sequence(F.lit(0), F.lit(len(FORMS) - 1))))
    forms = grid.join(forms, ["load_id", "col", "form"], "left").withColumn("_p", F.coalesce("n", F.lit(0)) / F.col("n_rows"))
    usual = forms.groupBy("col", "form").agg(F.median("_p").alias("_m"))
    forms = forms.join(usual, ["col", "form"]).withColumn("_off", F.abs(F.col("_p") - F.col("_m")))
    strange = forms.groupBy("load_id", "col").agg(F.max(F.when(F.col("_off") >= ERRORS * _error(F.col("_m"), F.col("n_rows")), F.col("_off"))).alias("form_shift"))

    fence = base.groupBy("col").agg(F.median("low").alias("_low"), F.median("high").alias("_high")).withColumn("_m", MARGIN * (F.col("_high") - F.col("_low")))
    beyond = (v < F.col("_low") - F.col("_m")) | (v > F.col("_high") + F.col("_m"))
    outside = values.join(fence, "col").groupBy("load_id", "col").agg((F.sum(F.when(beyond, n).otherwise(0)) / F.sum("n")).alias("outside"))

    picks = [f"c{i}" for i in range(len(columns))]
    joint = cells.groupBy("load_id", (F.col("fold") % 2).alias("half"), *picks).agg(F.count("*").alias("n"))
    joint = written(joint if len(columns) > 1 else joint.limit(0), "joint_cells")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum(_moments(pdf, picks) for pdf in batches)
        if np.ndim(total):
            yield pd.DataFrame({"at": np.arange(total.size), "value": total.ravel()})

    sums = joint.drop("load_id").mapInPandas(summed, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()  # two halves of features * features numbers
    everyone = sums.sort_values("at")["value"].to_numpy()

    def judge(own: pd.DataFrame, sample: pd.DataFrame) -> pd.DataFrame:
        load = own["load_id"].iloc[0] if len(own) else sample["load_id"].iloc[0]
        count = np.zeros((len(columns), FOLDS, CELLS))
        count[own["col"], own["fold"], own["cell"]] = own["n"]
        size = count[0].sum()
        alone = [column_auc(count[i], np.maximum(others[i] - count[i] / max(size, 1), 0)) for i in range(len(columns))]
        joint, lost = None, [None] * len(columns)
        if len(sample):
            mine = _moments(sample, picks)
            rest, wide = everyone.reshape(mine.shape) - mine, (mine.shape[1] - 1) // len(columns)
            of = np.r_[np.repeat(np.arange(len(columns)), wide), -1]  # the column of each feature
            joint_of = lambda without: _moment_auc(mine, rest, np.flatnonzero(of != without))
            joint = joint_of(len(columns))
            lost = [joint - joint_of(i) for i in range(len(columns))]
        return pd.DataFrame({"load_id": load, "col": range(len(columns)), "auc": alone, "joint_auc": joint, "ablation": lost}).astype({"joint_auc": float, "ablation": float})

    tested = counts.groupBy("load_id").cogroup(joint.groupBy("load_id")).applyInPandas(judge, "load_id string, col int, auc double, joint_auc double, ablation double")
    out = written(base.join(tested, ["load_id", "col"]).join(strange, ["load_id", "col"]).join(outside, ["load_id", "col"]), "profiles")
    middle = out.groupBy("col").agg(F.median("auc").alias("_a"), F.median("missing").alias("middle_missing"))
    out = out.join(middle, "col").withColumn("_dev", F.abs(F.col("auc") - F.col("_a")))
    spread = out.groupBy("col").agg((F.median("_dev") * 1.4826).alias("_s"))
    off = F.abs(F.col("missing") - F.col("middle_missing"))
    apart = lambda spreads: (F.col("auc") >= MIN_AUC) & (F.col("auc") >= F.col("_a") + spreads * F.col("_s"))
    by_missing = (off >= MIN_MISSING) & (off >= ERRORS * _error(F.col("middle_missing"), F.col("n_rows")))
    exact = by_missing | (F.coalesce("form_shift", F.lit(0.0)) >= MIN_FORM) | ((F.col("outside") >= MIN_OUTSIDE) & (F.col("outside") * F.col("n_rows") >= 2))
    found = apart(SPREADS) | (apart(DOUBT) & exact)
    names = F.array(*[F.lit(c) for c in columns])
    return out.join(spread, "col").select(
        F.lit(table_name).alias("table_name"), "load_id", names[F.col("col")].alias("column_name"), "n_rows", "missing", "n_distinct", "low", "high", "mean", "middle_missing", "auc", "joint_auc", "ablation", "form_shift", "outside", found.alias("found")
    )
