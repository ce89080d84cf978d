"""Operator 2: toxicity by non-negative positive-unlabelled learning.

Numpy classifiers are trained from confirmed toxic texts (positives) and
unlabelled texts, which hold an unknown part of toxic ones.  With class prior
p and logistic loss l, the risk is

    p * E_pos[l(+)] + max(0, E_unl[l(-)] - p * E_pos[l(-)])

The second term estimates the risk on clean texts; it cannot be negative, so
when it falls below zero the step goes back on it instead of fitting it
further (Kiryo et al. 2017).  The weights are kept sparse by an L1 term.

Features are hashed: the words of a text and their first 3 to 6 bytes, each
counted once.  Nothing else of a row enters a score.  Training uses a bounded
sample: at most ``MAX_POSITIVES`` positives and ``MAX_UNLABELLED`` unlabelled
texts for each of ``CLASSIFIERS`` classifiers, chosen by a hash of the id.
Each classifier is trained in a task of its own; the score is the logistic
function of their mean.  Only the sparse weights reach the driver.

Defined cases: a null text counts as empty; an empty text gets the score of
the intercept; a null id is read as empty text by the held-out rule and is
never sampled; of contradicting labels for an id the toxic one counts; without
positives or unlabelled texts every score is 0; repeated rows are scored
alike; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import slices, text_key, utf8_list
from feedloom.llm.hashing import joined, runs, span_hashes

MAX_POSITIVES = 3000
MAX_UNLABELLED = 6000
CLASSIFIERS = 3
SLOTS = 1 << 20
PREFIXES = (3, 4, 5, 6)
#: Texts of a training sample in which a feature occurs at least.
MIN_TEXTS = 3
#: Entries (text, feature) summed at once: bounds the memory of a step.
ENTRIES = 1 << 20
STEPS = 120
RATE = 0.08
#: The L1 term of a feature in units of its chance level: the standard error of
#: prior * (its frequency among the positives).  First to select, then to fit.
SELECT, FIT = 3.0, 0.5
DEFAULT_PRIOR = 0.05
#: Scores from here on are predicted toxic.
CUT = 0.5
SLICE_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row of each feature, slot): words and prefixes, repeats included."""
    data, begins = joined(texts)
    data = _LOWER[data]
    starts, ends = runs(_LETTER[data])
    rows = np.searchsorted(begins, starts, side="right") - 1
    all_rows, all_slots = [], []
    for n in (*PREFIXES, None):
        if n is None:
            r, h = rows, span_hashes(data, starts, ends)
        else:
            long = np.flatnonzero(ends - starts > n)
            r, s = rows[long], starts[long]
            h = np.zeros(len(s), dtype=np.uint64)
            for j in range(n):
                h = (h + data[s + j]) * np.uint64(0x100000001B3 + 2 * n)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9E3779B97F4A7C15)
        all_rows.append(r)
        all_slots.append((h >> np.uint64(44)).astype(np.int64))
    return np.concatenate(all_rows), np.concatenate(all_slots)


def unique_features(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct slots of each text."""
    rows, slots = features(texts)
    both = np.unique(rows * SLOTS + slots)
    return np.split((both % SLOTS).astype(np.int32), np.searchsorted(both // SLOTS, np.arange(1, len(texts))))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never used: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def minimise(row: np.ndarray, column: np.ndarray, n_rows: int, n_pos: int, w: np.ndarray, b: float, prior: float,
             l1: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk from weights w and intercept b.  Entry i
    says that text row[i] has feature column[i]; the first n_pos texts are the
    positives."""
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    is_pos = np.arange(n_rows) < n_pos
    weight_pos, weight_unl = prior / n_pos, 1.0 / (n_rows - n_pos)
    parts = [(row[i:i + ENTRIES], column[i:i + ENTRIES]) for i in range(0, len(row), ENTRIES)]
    for step in range(1, steps + 1):
        score = np.full(n_rows, b)
        for r, c in parts:
            score += np.bincount(r, weights=w[c], minlength=n_rows)
        p = 0.5 * (1 + np.tanh(0.5 * score))
        as_clean = np.logaddexp(0, score)                       # l(-)
        clean = weight_unl * as_clean[~is_pos].sum() - weight_pos * as_clean[is_pos].sum()
        toward = np.where(is_pos, -weight_pos * p, weight_unl * p)          # gradient of the clean risk
        g = np.where(is_pos, weight_pos * (p - 1), 0.0) + toward if clean >= 0 else -toward
        grad = np.append(np.zeros(len(w)), g.sum())
        for r, c in parts:
            grad[:-1] += np.bincount(c, weights=g[r], minlength=len(w))
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        scale = rate / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        move = scale * m / (1 - 0.9 ** step)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * scale[:-1], 0)     # proximal step of the L1 term
    return w, b


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float,
          steps: int = STEPS, rate: float = RATE, select: float = SELECT, fit_: float = FIT) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse weights (slots, values) and intercept from feature sets: a
    strong L1 term selects features, then those are fitted with a weak one."""
    rows, n_pos = positive + unlabelled, len(positive)
    # a few texts at once: the whole sample is held as int32 columns and nothing wider
    times, held, first = np.zeros(SLOTS, dtype=np.int64), 0, 0
    for i, r in enumerate(rows, 1):
        held += len(r)
        if held >= ENTRIES or i == len(rows):
            times += np.bincount(np.concatenate(rows[first:i]), minlength=SLOTS)
            held, first = 0, i
    used = np.flatnonzero(times >= MIN_TEXTS)
    place = np.full(SLOTS, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    columns = [(c := place[r])[c >= 0] for r in rows]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in columns])
    column, times = np.concatenate(columns), times[used]
    del columns
    share = times / len(rows)
    chance = prior * np.sqrt(share * (1 - share) / n_pos)
    b = float(np.log(prior / (1 - prior)))
    w, b = minimise(row, column, len(rows), n_pos, np.zeros(len(used)), b, prior, select * chance, steps, rate)
    chosen = np.flatnonzero(w)
    place = np.full(len(used), -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    inside = place[column] >= 0
    w, b = minimise(row[inside], place[column[inside]], len(rows), n_pos, w[chosen], b, prior, fit_ * chance[chosen],
                    2 * steps, rate)
    return used[chosen].astype(np.int64), w, b


@dataclass
class Model:
    """Mean of the classifiers: weight of every slot, and the intercept."""
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        rows, slots = features(texts)
        hit = np.flatnonzero(self.weights[slots])
        both = np.unique(rows[hit] * SLOTS + slots[hit])
        total = np.bincount(both // SLOTS, weights=self.weights[both % SLOTS], minlength=len(texts)) + self.intercept
        return 0.5 * (1 + np.tanh(0.5 * total))


def sample_texts(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fold, text) of the texts to train on: of ``positives`` (id) fold -1, of
    all texts the number of a classifier; none held out.  A row for each (id,
    text), so an id with many rows counts as its texts do and a repeated row
    once, and the sizes are bounded by the parameters above."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text).alias("key"), text.alias("text"))
    rows = rows.where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    pairs = rows.select("id", "key").distinct()
    order = F.xxhash64("id", "key", F.lit(5))
    pos = (pairs.join(positives, "id", "left_semi").orderBy(order, "id", "key").limit(MAX_POSITIVES)
           .withColumn("fold", F.lit(-1)))
    unl = (pairs.orderBy(order, "id", "key").limit(MAX_UNLABELLED * CLASSIFIERS)
           .withColumn("fold", F.pmod(F.xxhash64("id", "key", F.lit(6)), F.lit(CLASSIFIERS)).cast("int")))
    sample = F.broadcast(pos.unionByName(unl))
    return rows.join(sample, ["id", "key"]).dropDuplicates(["id", "key", "fold"]).select("fold", "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """Train on the rows that are not held out."""
    spark = docs.sparkSession
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
             .where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
             .groupBy("id").agg(F.max("y").alias("y")))
    prior = known.agg(F.avg("y")).first()[0]
    prior = min(max(DEFAULT_PRIOR if prior is None else prior, 0.001), 0.9)
    texts = sample_texts(docs, known.where("y = 1").select("id"), id_col, text_col)

    def featurise(batches):
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                sets = unique_features(utf8_list(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=["fold", "slots"])

    rows = texts.select("fold", "text").mapInArrow(featurise, "fold int, slots binary")
    folds = F.when(F.col("fold") < 0, F.array(*(F.lit(i) for i in range(CLASSIFIERS)))).otherwise(F.array("fold"))
    rows = rows.select("slots", (F.col("fold") < 0).alias("positive"), F.explode(folds).alias("classifier"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, dtype=np.int32) for s in pdf["slots"]]
        pos = [s for s, p in zip(sets, pdf["positive"]) if p]
        unl = [s for s, p in zip(sets, pdf["positive"]) if not p]
        if not pos or not unl:
            return pd.DataFrame({"slots": [b""], "weights": [b""], "intercept": [float("-inf")]})
        slots, weights, intercept = train(pos, unl, prior)
        return pd.DataFrame({"slots": [slots.tobytes()], "weights": [weights.tobytes()], "intercept": [intercept]})

    trained = rows.groupBy("classifier").applyInPandas(one, "slots binary, weights binary, intercept double").collect()
    weights, intercept = np.zeros(SLOTS), 0.0
    for r in trained:
        weights[np.frombuffer(r.slots, dtype=np.int64)] += np.frombuffer(r.weights) / len(trained)
        intercept += r.intercept / len(trained)
    return Model(weights, intercept if trained else float("-inf"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text_col).cast("string").alias("t"), F.col(id_col).cast("long").alias("doc_id"),
                       held_out(F.col(id_col)).alias("held_out"))

    def run(batches):
        for whole in batches:
            for b in slices(whole, 0, SLICE_BYTES):
                s = shared.value.scores(utf8_list(b.column(0)))
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                                                 names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the cut, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for b in slices(whole, at, SLICE_BYTES):
                yield b.filter(pa.array(shared.value.scores(utf8_list(b.column(at))) < CUT))

    return docs.mapInArrow(run, docs.schema)
