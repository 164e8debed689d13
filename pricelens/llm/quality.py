"""Quality classifier: support vectors on naive Bayes features.

Indicators of byte n-grams, words and repeated words are scaled by the classes' log-count ratios; a linear
hinge-loss model is fitted to them by dual coordinate descent on a bounded sample of labelled rows
(``PER_CLASS`` of each class), in one task. Margins become probabilities by a sigmoid fitted to margins of
rows that the model hasn't seen, weighted by the classes' counts among all labelled rows. Scoring is one map over
whole texts.

Defined cases: null and empty texts have no features and get the score of the bias alone; a null label counts
as none, several labels of one document as its least; repeated rows score alike; without labels every score is
0.5, with one class its share; an empty table gives an empty result. Extra columns are kept, and those named like an output replaced.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import encode, fold
from pricelens.llm.linear import Svm, class_sample, features, fit_sigmoid, fit_svm, log_count_ratio, sampled_texts, sigmoid

FOLDS, TEST_FOLD = 4, 2
PER_CLASS = 3000   # labelled rows of each class that are learned from, at most
THRESHOLD = 0.7


def _fit(f: pd.DataFrame) -> tuple[Svm | None, float, float]:
    """Model and sigmoid from (label, count, text); without two classes only the sigmoid's constant."""
    positive = f["label"].to_numpy(int) == 1
    if positive.all() or not positive.any():
        return None, 0.0, 500.0 if positive.all() else -500.0
    rows = list(features(encode(f["text"])))
    fold_of = np.arange(len(rows)) % 2
    margins = np.zeros(len(rows))
    for k in (0, 1):
        own = np.flatnonzero(fold_of != k)
        if positive[own].all() or not positive[own].any():
            own = np.arange(len(rows))
        part = [rows[i] for i in own]
        model = fit_svm(part, positive[own], log_count_ratio(part, positive[own]))
        for i in np.flatnonzero(fold_of == k):
            margins[i] = model.margin(rows[i])
    per = f["count"].to_numpy(float) / np.where(positive, positive.sum(), (~positive).sum())
    a, b = fit_sigmoid(margins, positive.astype(float), per / per.mean())
    return fit_svm(rows, positive, log_count_ratio(rows, positive)), a, b


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        label_id: str = "doc_id", per_class: int = PER_CLASS) -> tuple[Svm | None, float, float]:
    """Model from the labelled documents outside the test fold."""
    ids = (labels.filter((fold(F.col(label_id), FOLDS) != TEST_FOLD) & F.col(label).isin(0, 1))
           .groupBy(F.col(label_id).alias("id")).agg(F.min(label).cast("int").alias("label")))
    rows = sampled_texts(docs, doc_id, text, class_sample(ids, per_class))
    fitted = (rows.withColumn("one", F.lit(1)).groupBy("one")  # a bounded sample
              .applyInPandas(lambda f: pd.DataFrame({"model": [pickle.dumps(_fit(f.sort_values(["label", "text"]).reset_index(drop=True)))]}), "model binary")
              .first())
    return pickle.loads(fitted[0]) if fitted else (None, 0.0, 0.0)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          label_id: str = "doc_id", per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    model, a, b = fit(docs, labels, doc_id, text, label, label_id, per_class)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(sigmoid(np.full(len(texts), b)))
        return pd.Series([float(sigmoid(a * model.margin(x) + b)) for x in features(encode(texts))], dtype=float)

    out = docs.withColumns({"held_out": fold(F.col(doc_id), FOLDS) == TEST_FOLD, "score": run(F.col(text))})
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
