"""Model evaluation on long-form scores.

Scores are one row per (row key, model, split) with ``label``,
``probability`` and ``prediction``. Everything here is an aggregate over that
table; no step gathers a whole group of rows in one task:

* AUC and ROC need, for every distinct score, the positives and negatives
  ranked above it. Rows are first reduced to distinct scores; running totals
  over ordered ranges of (group, score) then give the ranks, so that neither a
  large group nor a crowded score gathers in one task.
* The threshold search maps each row to the last grid threshold at or below
  its score, so the grid is applied to a <= 91-row table per group instead of
  to every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order_stats import join_null_safe
from .prefix import with_prefix_totals

GROUP = ("model", "split")

# The reference's threshold grid, 0.10 to 0.99 by 0.01, filled
# the way numpy's arange fills it (start + i * ((start + step) - start)).
GRID_START, GRID_STEP, GRID_SIZE = 0.1, 0.01, 90


def _g(by) -> list[str]:
    return list(by)


# M5 -------------------------------------------------------------------------
def ensemble(scores: DataFrame, models: Sequence[str], name: str = "ensemble",
             key: Sequence[str] = ("entity", "event_id"), threshold: float = 0.5) -> DataFrame:
    """Soft vote: mean probability of ``models`` per row; positive at ``threshold``."""
    k = [*key, "split", "label"]
    ens = (scores.where(F.col("model").isin(list(models)))
           .groupBy(*k).agg(F.avg("probability").alias("probability"))
           .withColumn("model", F.lit(name))
           .withColumn("prediction", (F.col("probability") >= threshold).cast("int")))
    return ens.select(*key, "label", "model", "split", "probability", "prediction")


# M7 / M8 / M17 ----------------------------------------------------------------
def _counts(scores: DataFrame, by) -> DataFrame:
    y, p = F.col("label"), F.col("prediction")
    return scores.groupBy(*_g(by)).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))


def _div0(a, b):
    """a / b, 0 when b is 0 (the reference's ``zero_division=0``)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def score_ranks(scores: DataFrame, by=GROUP) -> DataFrame:
    """Per (group, distinct probability): n_pos, n_neg and the positives/negatives scored higher.

    Rows are reduced to distinct scores once; running totals over ordered ranges (written to the shared
    checkpoint folder) give what ranks above, so AUC and ROC of one table can share the result.
    """
    by = _g(by)
    d = scores.groupBy(*by, "probability").agg(
        F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") != 1).alias("n_neg"))
    below = with_prefix_totals(d, [*[F.col(c) for c in by], F.col("probability")],
                               {"_pos_below": F.col("n_pos"), "_neg_below": F.col("n_neg")})
    ends = below.groupBy(*by).agg(F.max(F.col("_pos_below") + F.col("n_pos")).alias("_pos_end"),
                                  F.max(F.col("_neg_below") + F.col("n_neg")).alias("_neg_end"))
    return join_null_safe(below, ends, by, "inner").select(
        *by, "probability", "n_pos", "n_neg",
        (F.col("_pos_end") - F.col("_pos_below") - F.col("n_pos")).alias("pos_above"),
        (F.col("_neg_end") - F.col("_neg_below") - F.col("n_neg")).alias("neg_above"))


def auc(scores: DataFrame, by=GROUP, ranks: DataFrame | None = None) -> DataFrame:
    """ROC AUC per group (mid-rank rule for ties); 0 when a group has one class."""
    r = ranks if ranks is not None else score_ranks(scores, by)
    g = r.groupBy(*_g(by)).agg(
        F.sum(F.col("n_neg") * (F.col("pos_above") + F.col("n_pos") * F.lit(0.5))).alias("_w"),
        F.sum("n_pos").alias("_p"), F.sum("n_neg").alias("_n"))
    a = F.when((F.col("_p") == 0) | (F.col("_n") == 0), F.lit(0.0)).otherwise(
        F.col("_w") / (F.col("_p").cast("double") * F.col("_n")))
    return g.select(*_g(by), a.alias("auc"))


def metrics(scores: DataFrame, by=GROUP) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 on zero division) and AUC per group."""
    c = _counts(scores, by)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec = _div0(tp, tp + fp)
    rec = _div0(tp, tp + fn)
    out = c.select(*_g(by), ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
                   prec.alias("precision"), rec.alias("recall"),
                   _div0(2 * tp, 2 * tp + fp + fn).alias("f1"))
    return out.join(auc(scores, by), _g(by))


def confusion(scores: DataFrame, by=GROUP) -> DataFrame:
    """2 x 2 counts (label, prediction) per group, zero cells included."""
    c = scores.groupBy(*_g(by), "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("prediction"))
                      for a in (0, 1) for b in (0, 1)])
    grid = scores.select(*_g(by)).distinct().select(*_g(by), F.inline(cells))
    return grid.join(c, [*_g(by), "label", "prediction"], "left").fillna(0, ["n"])


def class_report(scores: DataFrame, by=GROUP) -> DataFrame:
    """Per class 0/1 and 'macro avg' / 'weighted avg': precision, recall, F1, support."""
    c = _counts(scores, by)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    per = []
    for cls, (t, fpos, fneg) in {"1": (tp, fp, fn), "0": (tn, fn, fp)}.items():
        p, r = _div0(t, t + fpos), _div0(t, t + fneg)
        per.append(c.select(*_g(by), F.lit(cls).alias("class"), p.alias("precision"), r.alias("recall"),
                            _div0(2 * t, 2 * t + fpos + fneg).alias("f1"), (t + fneg).alias("support")))
    rows = per[0].unionByName(per[1])
    n = F.sum("support")
    macro = rows.groupBy(*_g(by)).agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                                      F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                                      n.alias("support"))
    wavg = rows.groupBy(*_g(by)).agg(
        F.lit("weighted avg").alias("class"),
        *[_div0(F.sum(F.col(m) * F.col("support")), n).alias(m) for m in ("precision", "recall", "f1")],
        n.alias("support"))
    return rows.unionByName(macro).unionByName(wavg)


# M9 -------------------------------------------------------------------------
def roc_curve(scores: DataFrame, by=GROUP, ranks: DataFrame | None = None) -> DataFrame:
    """(threshold, fpr, tpr) per group at every distinct score, plus the (inf, 0, 0) start."""
    r = ranks if ranks is not None else score_ranks(scores, by)
    tot = r.groupBy(*_g(by)).agg(F.sum("n_pos").alias("_p"), F.sum("n_neg").alias("_n"))
    r = r.join(tot, _g(by))
    pts = r.select(*_g(by), F.col("probability").alias("threshold"),
                   _div0(F.col("neg_above") + F.col("n_neg"), F.col("_n")).alias("fpr"),
                   _div0(F.col("pos_above") + F.col("n_pos"), F.col("_p")).alias("tpr"))
    start = tot.select(*_g(by), F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                       F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


# M10 ------------------------------------------------------------------------
def grid_threshold(i):
    delta = (F.lit(GRID_START) + F.lit(GRID_STEP)) - F.lit(GRID_START)
    return F.lit(GRID_START) + i.cast("double") * delta


def best_threshold(scores: DataFrame, split: str | None = "validation", by=("model",)) -> DataFrame:
    """Accuracy-maximising grid threshold per group; the smallest threshold wins ties."""
    s = scores if split is None else scores.where(F.col("split") == split)
    p = F.col("probability")
    # last grid index whose threshold is <= p (-1 when below the grid)
    g0 = F.floor((p - F.lit(GRID_START)) / (F.lit(GRID_START + GRID_STEP) - F.lit(GRID_START))).cast("int")
    g0 = F.least(F.lit(GRID_SIZE - 1), F.greatest(F.lit(-1), g0))
    g1 = F.when((g0 >= 0) & (grid_threshold(g0) > p), g0 - 1).otherwise(g0)
    m = F.when((g1 < GRID_SIZE - 1) & (grid_threshold(g1 + 1) <= p), g1 + 1).otherwise(g1)
    cells = (s.withColumn("_m", m).groupBy(*_g(by), "_m")
             .agg(F.count_if(F.col("label") == 1).alias("_pos"), F.count_if(F.col("label") != 1).alias("_neg")))
    grid = cells.select(*_g(by)).distinct().select(*_g(by), F.explode(F.sequence(F.lit(-1), F.lit(GRID_SIZE - 1))).alias("_m"))
    t = grid.join(cells, [*_g(by), "_m"], "left").fillna(0, ["_pos", "_neg"])
    w = Window.partitionBy(*_g(by)).orderBy("_m")
    # a row is predicted positive at grid index i when its cell index _m >= i
    tp = F.sum("_pos").over(w.rowsBetween(0, Window.unboundedFollowing))
    tn = F.coalesce(F.sum("_neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum(F.col("_pos") + F.col("_neg")).over(Window.partitionBy(*_g(by)))
    acc = t.select(*_g(by), "_m", ((tp + tn) / n).alias("accuracy")).where(F.col("_m") >= 0)
    best = Window.partitionBy(*_g(by)).orderBy(F.desc("accuracy"), F.asc("_m"))
    return (acc.withColumn("_r", F.row_number().over(best)).where("_r = 1")
            .select(*_g(by), grid_threshold(F.col("_m")).alias("threshold"), "accuracy"))


# M14 ------------------------------------------------------------------------
def regression_metrics(df: DataFrame, y: str, yhat: str, by=()) -> DataFrame:
    """MAE, MSE, RMSE and R^2 (1 - SSE / SST)."""
    e = F.col(y) - F.col(yhat)
    g = df.groupBy(*_g(by)) if by else df.groupBy()
    out = g.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                F.var_pop(F.col(y)).alias("_vy"))
    return out.select(*_g(by), "mae", "mse", F.sqrt("mse").alias("rmse"),
                      F.when(F.col("_vy") == 0, F.lit(None)).otherwise(F.lit(1.0) - F.col("mse") / F.col("_vy")).alias("r2"))


# M16 ------------------------------------------------------------------------
METRIC_NAMES = ["accuracy", "precision", "recall", "f1", "auc"]


def metrics_long(m: DataFrame, by=GROUP) -> DataFrame:
    return m.unpivot(_g(by), METRIC_NAMES, "metric", "value")


# M18 ------------------------------------------------------------------------
def with_class_weights(df: DataFrame, mode: str = "balanced", positive_weight: float = 3.0,
                       label: str = "label", out: str = "weight") -> DataFrame:
    """Fixed (``positive_weight`` on class 1) or balanced n / (2 * n_class) weights."""
    if mode == "fixed":
        return df.withColumn(out, F.when(F.col(label) == 1, F.lit(positive_weight)).otherwise(F.lit(1.0)))
    cnt = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))  # one row per class
    all_rows = cnt.agg((F.sum("_nc") / F.count(label)).alias("s")).scalar()
    cnt = cnt.select(label, (all_rows / F.col("_nc")).alias(out))
    return df.join(F.broadcast(cnt), label, "left")


# J6 -------------------------------------------------------------------------
def attach_scores(df: DataFrame, scores: DataFrame, models: Sequence[str],
                  key: Sequence[str] = ("entity", "event_id"), row_id: str = "row_id") -> DataFrame:
    """One ``<model>_probability`` and ``<model>_prediction`` column per model, joined on the row.

    Where both tables have ``row_id``, which names a row for good, that is the key. Otherwise rows of one ``key`` are numbered on both
    sides, the n-th row of a key getting the n-th score of each model: no row and no score is lost when keys repeat.
    Keys that are null match each other.
    """
    scores = scores.where(F.col("model").isin(list(models)))
    if row_id in df.columns and row_id in scores.columns:
        on, own = [row_id], df
    else:
        nth = "_nth"
        on = [*key, nth]
        of_df = Window.partitionBy(*key).orderBy(*[c for c, t in df.dtypes if c not in key and not t.startswith("map")] or [F.lit(0)])
        of_scores = Window.partitionBy(*key, "model").orderBy("probability", "prediction")
        own, scores = df.withColumn(nth, F.row_number().over(of_df)), scores.withColumn(nth, F.row_number().over(of_scores))
    of_model = lambda c, m: F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{m}_{c}")
    wide = scores.groupBy(*on).agg(*[of_model(c, m) for m in models for c in ("probability", "prediction")])
    return join_null_safe(own, wide, on).drop("_nth")
