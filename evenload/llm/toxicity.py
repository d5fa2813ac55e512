"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

Grades 0..K are ordered. One weight vector is shared by all thresholds:
P(grade <= k) = sigmoid(threshold_k - w x), where x marks which of the chosen
words a text holds. Words are full 64-bit hashes (no buckets to collide in);
chosen are all those whose association with a grade above 0 passes the universal
threshold sqrt(2 ln m) over m words, by the signed root of the likelihood ratio of the
two-by-two table, which a word in few documents does not pass by chance. A text's score is its expected severity,
the sum of P(grade >= k). It is toxic if P(grade >= 1) reaches the model's cut:
the middle of the gap that parts the fitted sample with the best F1.

The fit sees at most ``max_rows`` labelled documents, those with the smallest
hashes of their ids: the only bounded step. Their features are sparse. Scoring reads whole texts.

Defined cases: a null or empty text has no features; a very long text is one row, read whole; without labelled
documents of two grades nothing is toxic and the severity is 0; labels with a
null grade are ignored; repeated labels each count; repeated documents are
scored row by row; ties at the cut are toxic; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenload.llm.words import batches, hash_words
from evenload.scratch import materialize


@dataclass(frozen=True)
class OrdinalModel:
    """words: sorted hashes; weights: one each; thresholds: ascending, one per grade above 0; cut: P(grade >= 1) of toxic texts."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 2.0

    def at_least(self, eta: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -500, 500)))

    def linear(self, texts: list[str | None]) -> np.ndarray:
        """w x for each text."""
        out = np.zeros(len(texts))
        if not len(self.words):
            return out
        likely = np.zeros(1 << 16, bool)
        likely[(self.words >> np.uint64(48)).astype(np.int64)] = True
        for a, b in batches(texts):
            hashes, offsets = hash_words(texts[a:b], bare=True)
            at = np.flatnonzero(likely[(hashes >> np.uint64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.words, hashes[at]), len(self.words) - 1)
            hit = self.words[place] == hashes[at]
            doc = np.searchsorted(offsets, at[hit], side="right") - 1
            pairs = np.unique(doc * len(self.words) + place[hit])
            np.add.at(out, a + pairs // len(self.words), self.weights[pairs % len(self.words)])
        return out


class Marks(NamedTuple):
    """A sparse matrix of ones: the row and the column of each."""

    row: np.ndarray
    column: np.ndarray
    n: int
    d: int

    @classmethod
    def of(cls, dense: np.ndarray) -> Marks:
        return cls(*np.nonzero(dense), *dense.shape)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.n)

    def summed(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=v[self.row], minlength=self.d)


def minimise(f, x: np.ndarray, steps: int = 200, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """Limited-memory BFGS with backtracking; f gives a value and its gradient."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, alphas = -grad, []
        for s, y in reversed(past):
            alphas.append(s @ direction / (s @ y))
            direction = direction - alphas[-1] * y
        if past:
            s, y = past[-1]
            direction = direction * (s @ y / (y @ y))
        for (s, y), alpha in zip(past, reversed(alphas), strict=True):
            direction = direction + s * (alpha - y @ direction / (s @ y))
        slope, step = grad @ direction, 1.0
        while True:
            new_value, new_grad = f(x + step * direction)
            if new_value <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = step * direction, new_grad - grad
        done = abs(value - new_value) <= tolerance * max(1.0, abs(value))
        x, value, grad = x + s, new_value, new_grad
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y)]
        if done:
            break
    return x


def fit_ordinal(features: Marks, grades: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by penalised likelihood; every grade up to the largest has a threshold."""
    n, d = features.n, features.d
    top = int(grades.max())
    onehot = np.eye(top + 1)[grades]

    def unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(p[d + 1 :], -20, 20)))])

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, cuts = unpack(p)
        eta = features.times(w)
        below = 1 / (1 + np.exp(np.clip(eta[:, None] - cuts[None, :], -500, 500)))
        density = below * (1 - below)
        edge = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), density, np.zeros((n, 1))], axis=1)
        chance = np.maximum((np.diff(edge, axis=1) * onehot).sum(1), 1e-12)
        d_eta = (np.diff(slope, axis=1) * onehot).sum(1) / chance
        upper, lower = onehot[:, :-1] * density, onehot[:, 1:] * density
        d_cuts = -((upper - lower) / chance[:, None]).sum(0)
        gaps = np.exp(np.clip(p[d + 1 :], -20, 20))
        tail = np.cumsum(d_cuts[::-1])[::-1]
        small = 1e-3
        grad = np.concatenate([features.summed(d_eta) + ridge * w, [tail[0]], tail[1:] * gaps + small * p[d + 1 :]])
        return -np.log(chance).sum() + ridge / 2 * w @ w + small / 2 * p[d + 1 :] @ p[d + 1 :], grad

    share = np.clip((grades == 0).mean(), 1e-3, 1 - 1e-3)
    start = np.concatenate([np.zeros(d), [np.log(share / (1 - share))], np.zeros(top - 1)])
    return unpack(minimise(loss, start))


def best_cut(eta: np.ndarray, toxic: np.ndarray) -> float:
    """The linear score that parts toxic texts with the best F1, in the middle of its gap.

    It is above 0, the score of a text that holds none of the words; infinite if no score is.
    """
    order = np.argsort(-eta, kind="stable")
    score, hits = eta[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(eta) + 1) + max(1, toxic.sum()))
    f1[:-1][score[:-1] == score[1:]] = -1  # equal scores cannot be parted
    f1[score <= 1e-9] = -1
    at = int(np.argmax(f1))
    if f1[at] < 0:
        return np.inf
    return float((score[at] + max(0.0, score[min(at + 1, len(score) - 1)])) / 2)


def distinct_words(text: Column) -> Column:
    """The distinct word hashes of a text, as signed 64-bit integers."""

    @F.arrow_udf("array<bigint>")
    def listed(column: pa.Array) -> pa.Array:
        texts, out = column.to_pylist(), []
        for a, b in batches(texts):
            hashes, offsets = hash_words(texts[a:b], bare=True)
            out += [np.unique(hashes[offsets[i] : offsets[i + 1]]).view(np.int64) for i in range(b - a)]
        return pa.array(out, pa.list_(pa.int64()))

    return listed(text)


def among(words: Column, chosen: np.ndarray) -> Column:
    """The places in chosen (sorted, signed) of those words that are there."""

    @F.arrow_udf("array<int>")
    def found(column: pa.Array) -> pa.Array:
        out = []
        for row in column:
            own = np.array(row.values, np.int64)
            at = np.minimum(np.searchsorted(chosen, own), len(chosen) - 1)
            out.append(at[chosen[at] == own].astype(np.int32))
        return pa.array(out, pa.list_(pa.int32()))

    return found(words)


def fit(
    docs: DataFrame, labels: DataFrame, grade: Column, max_rows: int = 12_000, ridge: float = 0.05,
    id_col: str = "doc_id", text_col: str = "text",
) -> OrdinalModel:
    """The model from at most max_rows labelled documents; grade is a Column over labels (0, 1, ..., or null).

    Words are counted where they lie; the driver gets the chosen ones and their places.
    """
    chosen = (
        labels.select(F.col(id_col).alias("_id"), grade.cast("int").alias("grade"))
        .where("_id is not null and grade is not null")
        .orderBy(F.xxhash64("_id"), "_id", "grade")
        .limit(max_rows)
    )
    sample = materialize(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .join(F.broadcast(chosen), "_id")  # at most max_rows rows
        .select("_id", "grade", distinct_words(F.col("_text")).alias("words")),
        "toxicity",
    )
    if sample.count() > max_rows:  # ids that repeat among documents
        sample = materialize(sample.orderBy(F.xxhash64("_id"), "_id", "grade", F.xxhash64("words")).limit(max_rows), "toxicity")
    grades = {r.grade: r.n for r in sample.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(grades) < 2:
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    n, toxic = sum(grades.values()), sum(c for g, c in grades.items() if g > 0)
    counted = materialize(
        sample.select((F.col("grade") > 0).cast("int").alias("toxic"), F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count("*").cast("double").alias("held"), F.sum("toxic").cast("double").alias("both"))
        .where(F.col("held") < n),
        "words",
    )
    bar = float(np.sqrt(2 * np.log(max(2, counted.count()))))
    # Twice the log-likelihood ratio: observed x ln(observed / expected) over the four cells.
    cells = [
        ("both", f"held * {toxic / n!r}D"), ("held - both", f"held * {1 - toxic / n!r}D"),
        (f"{toxic}D - both", f"({n}D - held) * {toxic / n!r}D"), (f"{n - toxic}D - held + both", f"({n}D - held) * {1 - toxic / n!r}D"),
    ]
    ratio = " + ".join(f"if({o} > 0, ({o}) * ln(({o}) / ({e})), 0D)" for o, e in cells)
    best = counted.where(F.expr(f"2 * ({ratio}) > {bar * bar!r}D")).select("word").collect()
    names = np.sort(np.array([r.word for r in best], np.int64))
    found = among(F.col("words"), names) if len(names) else F.array().cast("array<int>")
    rows = sample.select("grade", found.alias("at")).collect()
    y = np.array([r.grade for r in rows], np.int64)
    column = np.concatenate([np.zeros(0, np.int64), *(np.array(r["at"], np.int64) for r in rows)])
    x = Marks(np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows]), column, len(rows), len(names))
    weights, thresholds = fit_ordinal(x, y, ridge)
    order = np.argsort(names.view(np.uint64))
    cut = best_cut(x.times(weights), y > 0)
    least = 2.0 if np.isinf(cut) else float(1 / (1 + np.exp(thresholds[0] - cut)))
    return OrdinalModel(names.view(np.uint64)[order], weights[order], thresholds, least)


def score(model: OrdinalModel, text: Column) -> Column:
    """struct(p_toxic, severity) of a text."""

    @F.arrow_udf("struct<p_toxic: double, severity: double>")
    def scored(column: pa.Array) -> pa.Array:
        p = model.at_least(model.linear(column.to_pylist()))
        first = p[:, 0] if p.shape[1] else np.zeros(len(p))
        return pa.StructArray.from_arrays([pa.array(first), pa.array(p.sum(1))], ["p_toxic", "severity"])

    return scored(text)


#: 0: not toxic; 1: toxic; 2: toxic and of low quality.
SEVERITY = "case when toxic = 0 then 0 when toxic = 1 and quality = 0 then 2 when toxic = 1 then 1 end"


def graded(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with p_toxic, severity and toxic (p_toxic at or above the model's cut) added, which replace equal names."""
    model = fit(docs, labels, F.expr(SEVERITY), id_col=id_col, text_col=text_col, **options)
    scored = docs.select(F.struct(*docs.columns).alias("_row"), score(model, F.col(text_col)).alias("_score"))
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("p_toxic", "severity", "toxic")]
    return scored.select(*kept, "_score.p_toxic", "_score.severity", (F.col("_score.p_toxic") >= model.cut).alias("toxic"))


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the toxic ones, in the same columns."""
    model = fit(docs, labels, F.expr(SEVERITY), id_col=id_col, text_col=text_col)
    return docs.where(score(model, F.col(text_col))["p_toxic"] < model.cut)
