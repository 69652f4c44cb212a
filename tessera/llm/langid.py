"""Language identification in two steps: the family first, then one-versus-one linear SVMs among its languages.

Features are hashed byte n-grams of the letters of the whole text, square roots of their shares, at length one. The
SVMs are fitted on a sample of labelled documents: about ``per_language`` of each language, but ``sample`` in all, picked
by a hash of doc_id, at most twice that whatever the table's size or the number of languages; so at most 200 MB of vectors
reach the driver. Families are fixed below; a language that
isn't listed is a family of its own. The same one-versus-one machines choose the family.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when there is nothing to
learn from. Rows without lang or doc_id are never learned from; a null doc_id isn't held out. Repeated rows get a row
each. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages of each family that may be hard to tell apart.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
DIMENSIONS = 4096
_SEEDS = {1: 0x9E3779B1, 2: 0x85EBCA6B, 3: 0xC2B2AE35, 4: 0x27D4EB2F}
_NOT_LETTERS = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def features(text: str | None) -> np.ndarray | None:
    """A text's vector; None if it has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    data = np.frombuffer(b" " + _NOT_LETTERS.sub(b" ", text.lower().encode()) + b" ", np.uint8)
    counts = np.zeros(DIMENSIONS)
    for at in range(0, len(data), 1 << 20):
        block = data[at : at + (1 << 20) + 3].astype(np.uint32)
        code = np.zeros(len(block), np.uint32)
        for n, seed in _SEEDS.items():
            if len(block) < n:
                break
            code = (code[: len(block) - n + 1] << np.uint32(8)) | block[n - 1 :]
            kept = code[: 1 << 20] if at + (1 << 20) < len(data) else code
            counts += np.bincount((kept * np.uint32(seed)) >> np.uint32(20), minlength=DIMENSIONS)
    out = np.sqrt(counts)
    return (out / np.sqrt((out * out).sum())).astype(np.float32)


def linear_svm(x: np.ndarray, positive: np.ndarray, cost: float = 1.0, sweeps: int = 30) -> np.ndarray:
    """Weights, bias last, of an L2-regularised machine with squared hinge loss, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    y = np.where(positive, 1.0, -1.0)
    diagonal = (x * x).sum(axis=1) + 0.5 / cost
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(sweeps):
        moved = 0.0
        for i in order.permutation(len(x)):
            gradient = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - gradient / diagonal[i])
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class OneVersusOne:
    """A linear SVM for each pair of classes; the class with most wins, ties by the sum of margins."""

    def __init__(self, classes: list[str], x: np.ndarray, of: np.ndarray):
        self.classes = classes
        self.pairs = list(combinations(range(len(classes)), 2))
        machines = []
        for a, b in self.pairs:
            rows = (of == a) | (of == b)
            machines.append(linear_svm(x[rows], of[rows] == a))
        self.weights = np.array(machines, np.float32).reshape(len(self.pairs), -1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and confidence (0 to 1) of each row: the logistic of its least margin against another class."""
        n, k = len(x), len(self.classes)
        if k == 1:
            return np.zeros(n, int), np.ones(n)
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        table = np.zeros((n, k, k))
        for p, (a, b) in enumerate(self.pairs):
            table[:, a, b], table[:, b, a] = margins[:, p], -margins[:, p]
        best = ((table > 0).sum(axis=2) + np.clip(table, -1, 1).sum(axis=2) / (2 * k)).argmax(axis=1)
        own = table[np.arange(n), best]
        own[np.arange(n), best] = np.inf
        return best, 1 / (1 + np.exp(-2 * own.min(axis=1)))


class Model:
    """Families, and languages within each."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        family = [FAMILY_OF.get(c, c) for c in langs]
        names = sorted(set(family))
        self.top = OneVersusOne(names, x, np.array([names.index(f) for f in family]))
        self.within = []
        for name in names:
            rows = np.array([f == name for f in family])
            own = [c for c, r in zip(langs, rows) if r]
            codes = sorted(set(own))
            self.within.append(OneVersusOne(codes, x[rows], np.array([codes.index(c) for c in own])))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = self.top.predict(x)
        langs: list[str] = [""] * len(x)
        for f, machine in enumerate(self.within):
            rows = np.flatnonzero(family == f)
            if len(rows):
                best, also = machine.predict(x[rows])
                sure[rows] *= also
                for r, b in zip(rows.tolist(), best.tolist()):
                    langs[r] = machine.classes[b]
        return langs, np.clip(sure, 0, 1)


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, per_language: int = 300, sample: int = 6000) -> Model | None:
    """Learns from ``docs(doc_id, text, lang)``; the sample's vectors reach the driver, at most twice ``sample``."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    per_language = max(2, min(per_language, sample // len(counts)))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30))
    share = F.lit(0)
    for code, n in counts.items():
        share = F.when(F.col("lang") == code, F.lit(min(1 << 30, int((1 << 30) * per_language / n) + 1))).otherwise(share)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, v.tobytes()) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)) if (v := features(text.as_py())) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.binary())], names=["lang", "vector"])

    rows = usable.where(draw < share).select("lang", "text").mapInArrow(vectors, "lang string, vector binary").limit(2 * per_language * len(counts)).collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["vector"])))
    if not rows:
        return None
    return Model(np.array([np.frombuffer(r["vector"], np.float32) for r in rows]), [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of ``docs(doc_id, text)``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                vectors = [features(x.as_py()) if model else None for x in batch.column(2)]
                rows = [k for k, v in enumerate(vectors) if v is not None]
                langs, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
                if rows:
                    found, sure = model.predict(np.array([vectors[k] for k in rows]))
                    scores[rows] = sure
                    for k, code in zip(rows, found):
                        langs[k] = code
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = 300) -> DataFrame:
    """Learns from the documents that aren't held out, and predicts all."""
    return predict(docs, fit(docs.where(~held_out(F.col("doc_id"))), per_language))
