"""Language identification by hierarchical discrimination.

The language family is predicted first, by a linear support vector machine for each family against the rest; then machines for each
pair of languages of that family separate them. A language that is in no named family is one of its own, so the model grows with
the number of languages (and the square of the largest family), not with all pairs of them. Both use indicators of byte n-grams of the
lower-cased text and are fitted on a bounded sample (``PER_LANGUAGE`` documents of each language) in one task, which is sent the
numbers of a text's distinct features, a bounded list however long the text is. Margins become probabilities by sigmoids fitted on rows that
the machine of the other half has not seen. Prediction is one map over whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with a null lang or a
null doc_id in the held-out sense a document isn't learned from or held out; repeated rows get equal results; without
documents to learn from every language is ``und``; an empty table gives an empty result. Extra columns are kept, and those
named like an output are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import encode, fold, unused
from pricelens.llm.linear import DIMS, class_sample, features, fit_sigmoid, fit_svm, sampled_texts, sigmoid

FOLDS, TEST_FOLD = 4, 2
PER_LANGUAGE = 1500  # documents of each language that are learned from, at most
NONE = "und"
#: families of languages; one not named here is a family of its own
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


class Machine:
    """A support vector machine for one class against another, with the probability of the first."""

    def __init__(self, rows: list[np.ndarray], positive: np.ndarray):
        half = np.zeros(len(rows), bool)  # every other row of each class
        for kind in (True, False):
            half[np.flatnonzero(positive == kind)[::2]] = True
        self.svm = fit_svm(rows, positive, np.ones(DIMS))
        margins = np.zeros(len(rows))
        for part in (half, ~half):
            both = len(set(positive[~part].tolist())) == 2
            svm = fit_svm([r for r, p in zip(rows, part) if not p], positive[~part], np.ones(DIMS)) if both else self.svm
            margins[part] = [svm.margin(r) for r, p in zip(rows, part) if p]
        weight = np.where(positive, 1 / positive.sum(), 1 / (~positive).sum()) * len(rows)
        self.scale, self.shift = fit_sigmoid(margins, positive.astype(float), weight)

    def chance(self, ids: np.ndarray) -> float:
        return float(sigmoid(self.scale * self.svm.margin(ids) + self.shift))


class Rest:
    """One machine per class against all others; the likeliest class wins."""

    def __init__(self, rows: list[np.ndarray], labels: list[str]):
        self.classes, own = sorted(set(labels)), np.array(labels, dtype=object)
        # of two classes the second one's machine is the first one's
        wanted = self.classes[:1] if len(self.classes) == 2 else self.classes if len(self.classes) > 2 else []
        self.machines = {c: Machine(rows, own == c) for c in wanted}

    def predict(self, ids: np.ndarray) -> tuple[str, float]:
        """Class, and its probability among all."""
        p = {c: m.chance(ids) for c, m in self.machines.items()}
        if len(self.classes) <= 2:
            first = p.get(self.classes[0], 1.0)
            return (self.classes[0], first) if first >= 0.5 else (self.classes[1], 1 - first)
        best = max(self.classes, key=lambda c: (p[c], c))
        return best, p[best] / max(sum(p.values()), 1e-300)


class Pairwise:
    """One machine per pair of classes; the class with most wins, then the largest probabilities."""

    def __init__(self, rows: list[np.ndarray], labels: list[str]):
        self.classes, own = sorted(set(labels)), np.array(labels, dtype=object)
        self.machines: dict[tuple[str, str], Machine] = {}
        for a, b in combinations(self.classes, 2):
            at = np.flatnonzero((own == a) | (own == b))
            self.machines[a, b] = Machine([rows[i] for i in at], own[at] == a)

    def predict(self, ids: np.ndarray) -> tuple[str, float]:
        """Class, and the least probability with which it won against another."""
        wins = {c: [0, 0.0] for c in self.classes}
        chance = {}
        for (a, b), machine in self.machines.items():
            p = machine.chance(ids)
            won, p = (a, p) if p >= 0.5 else (b, 1 - p)
            chance[a, b] = (won, p)
            wins[won][0] += 1
            wins[won][1] += p
        best = max(self.classes, key=lambda c: (*wins[c], c))
        against = [p if won == best else 1 - p for pair, (won, p) in chance.items() if best in pair]
        return best, min(against, default=1.0)


class Model:
    """Families against the rest, then pairs of languages within each; ``rows`` are texts' features."""

    def __init__(self, rows: list[np.ndarray], labels: list[str]):
        families = [family_of(x) for x in labels]
        self.family = Rest(rows, families)
        self.within = {f: Pairwise([r for r, x in zip(rows, families) if x == f], [x for x in labels if family_of(x) == f])
                       for f in self.family.classes}

    def predict(self, ids: np.ndarray) -> tuple[str, float]:
        family, p = self.family.predict(ids)
        lang, q = self.within[family].predict(ids)
        return lang, p * q


def prepared(texts) -> list[bytes]:
    return encode(t.lower() if isinstance(t, str) else t for t in texts)


def has_letter(text) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        f = f[[has_letter(t) for t in f["text"]]]
        yield pd.DataFrame({"label": f["label"], "ids": [x.tobytes() for x in features(prepared(f["text"]), words=False)]})


def _fit(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values(["label", "ids"])
    rows = [np.frombuffer(x, np.int32) for x in f["ids"]]
    return pd.DataFrame({"model": [pickle.dumps(Model(rows, list(f["label"])))]})


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model | None:
    ids = (docs.filter((fold(F.col(doc_id), FOLDS) != TEST_FOLD) & F.col(lang).isNotNull())
           .select(F.col(doc_id).alias("id"), F.col(lang).alias("label")))
    rows = sampled_texts(docs, doc_id, text, class_sample(ids, per_language)).select("label", "text").mapInPandas(_features, "label string, ids binary")
    fitted = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_fit, "model binary").first()  # a bounded sample
    return pickle.loads(fitted[0]) if fitted else None


def predict(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
            per_language: int = PER_LANGUAGE) -> DataFrame:
    """``docs`` with held_out, lang_pred and score."""
    model = fit(docs, doc_id, text, lang, per_language)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [model.predict(x) if model and has_letter(t) else (NONE, 0.0)
                 for t, x in zip(texts, features(prepared(texts), words=False), strict=True)]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    found = unused(docs.columns, "_found")
    out = docs.withColumn(found, run(F.col(text)))
    return (out.withColumns({"held_out": fold(F.col(doc_id), FOLDS) == TEST_FOLD, "lang_pred": F.col(f"{found}.lang_pred"),
                             "score": F.col(f"{found}.score")}).drop(found))
