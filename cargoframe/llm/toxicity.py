"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of lower-cased code points, counted once per document. Every
feature value is its log-count ratio between toxic and clean training documents; logistic
regression is fitted on those values. The fit uses at most ``MAX_TOXIC`` toxic and
``MAX_CLEAN`` clean labelled rows, picked by a hash of the id; scores cover every document.

Null and empty texts have no feature and get the score of the intercept. Without a toxic or
without a clean training row the score is the share of toxic labels (0.0 without labels).
Null labels, and labels of null ids, are left out. Repeated rows are scored alike. Columns other than
doc_id and text never reach a score.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cargoframe.sources.scratch import ship

ORDERS = (3, 4, 5)
BITS = 20
#: Bounds of the fit: labelled rows of each class, features of the model.
MAX_TOXIC, MAX_CLEAN, FEATURES = 3000, 6000, 2048
ROUNDS, RIDGE = 150, 2e-3
#: Characters handled at once; longer batches and texts are taken in pieces.
PIECE = 1 << 20


def _features(text: str, keep: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct features of a text; with ``keep`` only those marked there."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for low in range(0, len(points), PIECE):
        part = points[low:low + PIECE + max(ORDERS) - 1].astype(np.uint64) + np.uint64(1)
        rolling = np.zeros(len(part), np.uint64)
        for k in range(1, max(ORDERS) + 1):
            if len(part) < k:
                break
            rolling = rolling[:len(part) - k + 1] * np.uint64(0x9FB21C651E98DF25) + part[k - 1:]
            if k in ORDERS:
                mixed = (rolling ^ (rolling >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                at = (mixed >> np.uint64(64 - BITS)).astype(np.int32)
                found.append(at if keep is None else at[keep[at]])
        if len(found) > 3 * len(ORDERS):
            found = [np.unique(np.concatenate(found))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def _fit(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Chosen features, their weights times ratios, and the intercept."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for text, label in zip(texts, toxic):
        counts[int(label), _features(text)] += 1
    clean, bad = int((~toxic).sum()), int(toxic.sum())
    ratio = np.log((counts[1] + 1) / (bad + 2)) - np.log((counts[0] + 1) / (clean + 2))
    often = counts.sum(0)
    # weight of evidence: a ratio counts as much as the documents behind it
    evidence = np.where(often >= 3, np.abs(ratio) * np.sqrt(often), 0)
    chosen = np.sort(np.argpartition(-evidence, FEATURES)[:FEATURES].astype(np.int32))
    chosen = chosen[evidence[chosen] > 0]
    number = np.full(1 << BITS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    rows = [number[f] for f in (_features(t, number >= 0) for t in texts)]
    size = np.array([len(r) for r in rows])
    column = np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(rows)), size)
    scale = ratio[chosen]
    weight = np.where(toxic, 0.5 / bad, 0.5 / clean)
    w, b = np.zeros(len(chosen)), 0.0
    m, v, value = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), scale[column]
    for step in range(1, ROUNDS + 1):
        z = np.bincount(row, weights=w[column] * value, minlength=len(rows)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic)
        grad = np.append(np.bincount(column, weights=error[row] * value, minlength=len(chosen)) + RIDGE * w,
                         error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.02 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return chosen, (w * scale).astype(np.float64), float(b)


def train(docs: DataFrame, labels: DataFrame, hold_out: bool = True) -> dict:
    """Model from the labelled documents; with ``hold_out`` only from those whose crc32 of the
    id as text is no multiple of 5. The model is a few arrays of bounded size."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("label_id IS NOT NULL AND toxic IS NOT NULL")
    if hold_out:
        known = known.filter(F.crc32(F.col("label_id").cast("string")) % 5 != 0)
    known = known.groupBy("label_id").agg((F.max("toxic") > 0).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not clean:
        return {"share": bad / (bad + clean) if bad + clean else 0.0}
    place = F.pmod(F.xxhash64("label_id", F.lit(8)), F.lit(1_000_000_007)) / F.lit(1_000_000_007)
    share = F.when(F.col("toxic"), F.lit(MAX_TOXIC / bad)).otherwise(F.lit(MAX_CLEAN / clean))
    picked = known.filter(place < share)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(
        picked, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic").dropDuplicates(["doc_id"])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        if frame["toxic"].nunique() < 2:
            return pd.DataFrame({"chosen": [b""], "weights": [b""], "bias": [0.0], "share": [float(frame["toxic"].mean())]})
        chosen, weights, bias = _fit([t or "" for t in frame["text"]], frame["toxic"].to_numpy(bool))
        return pd.DataFrame({"chosen": [chosen.tobytes()], "weights": [weights.tobytes()], "bias": [bias], "share": [None]})

    model = texts.groupBy(F.lit(0).alias("all")).applyInPandas(
        fit, "chosen binary, weights binary, bias double, share double").first()
    if model is None:
        return {"share": bad / (bad + clean)}
    return model.asDict()


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of the documents and ``score``, the likelihood of the toxic label."""
    if model.get("share") is not None:
        return docs.withColumn("score", F.lit(float(model["share"])))
    ship(docs.sparkSession)
    chosen = np.frombuffer(model["chosen"], np.int32)
    weights, bias = np.frombuffer(model["weights"], np.float64), model["bias"]

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.zeros(1 << BITS)
        table[chosen] = weights
        keep = np.zeros(1 << BITS, bool)
        keep[chosen] = True
        for texts in batches:
            z = np.array([table[_features(t, keep)].sum() if t else 0.0 for t in texts]) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    rated = F.pandas_udf(rate, "double")
    return docs.withColumn("score", rated(F.col("text").cast("string")))
