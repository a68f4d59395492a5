"""A quality classifier on random-indexing word vectors.

Each word has a sparse random index vector; its context vector is the sum of the index vectors of
the words around it over the training sample. A document is pooled into the means of the context
vectors of its words and of their shapes (case and punctuation), and of its repetitions. A
two-layer numpy network scores the pool; a temperature fitted on rows that the network has not
seen calibrates the probability. The sample has at most ``SAMPLE`` labelled rows, the same ones however the tables are partitioned;
every text is learned from and scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.llm.common import exact_id, unit_hash
from treelake.llm.tokens import MEMO, groups

#: Buckets of words and of shapes, size of the vectors, words on each side, hidden units.
WORDS, SHAPES, DIM, WINDOW, HIDDEN = 8192, 1024, 32, 2, 24
#: Most labelled rows that are learned from.
SAMPLE = 3000
_REPEAT = WORDS + SHAPES
_ROWS = _REPEAT + 2
_LETTERS = re.compile(r"[^\W\d_]+")
_MEMO: dict[str, tuple[int, int]] = {}


def _features(word: str) -> tuple[int, int]:
    """The word's bucket and its shape's."""
    plain = "".join(_LETTERS.findall(word)).lower()
    case = "l" if word.islower() else "u" if word.isupper() and len(plain) > 1 else "t" if word.istitle() else "m"
    rest = re.sub(r"\d+", "9", _LETTERS.sub("a", word))
    shape = (case if plain else "") + re.sub(r"(.)\1{2,}", r"\1\1\1", rest)[:12]
    return zlib.crc32(plain.encode("utf-8", "surrogatepass")) % WORDS, WORDS + zlib.crc32(shape.encode("utf-8", "surrogatepass")) % SHAPES


def token_rows(text: str) -> np.ndarray:
    """Per word: its row, its shape's row, and whether it repeats the word before (a row of its own)."""
    words = text.split()
    if len(_MEMO) > MEMO:
        _MEMO.clear()
    for w in {w for w in words if w not in _MEMO}:
        _MEMO[w] = _features(w)
    out = np.empty((len(words), 3), np.int32)
    out[:, :2] = np.array([_MEMO[w] for w in words], np.int32).reshape(-1, 2)
    same = np.zeros(len(words), bool)
    same[1:] = (out[1:, 0] == out[:-1, 0]) & (out[1:, 1] == out[:-1, 1])
    out[:, 2] = _REPEAT + same
    return out


def index_vectors(seed: int = 7) -> np.ndarray:
    """Ternary random vectors with four entries each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((_ROWS, DIM), np.float32)
    for k in range(4):
        out[np.arange(_ROWS), rng.integers(0, DIM, _ROWS)] += rng.choice([-1, 1], _ROWS)
    return out


def context_vectors(docs: list[np.ndarray]) -> np.ndarray:
    """Sums of the neighbours' index vectors, scaled to length 1; unseen rows stay zero."""
    index = index_vectors()
    out = np.zeros((_ROWS, DIM), np.float32)
    for d in docs:
        for lag in range(1, WINDOW + 1):
            if len(d) <= lag:
                continue
            for own, other in ((d[lag:], d[:-lag]), (d[:-lag], d[lag:])):
                around = index[other[:, 0]] + index[other[:, 1]] + index[other[:, 2]]
                for column in range(3):
                    order = np.argsort(own[:, column], kind="stable")
                    rows = own[order, column]
                    first = np.flatnonzero(np.diff(rows, prepend=-1))
                    out[rows[first]] += np.add.reduceat(around[order], first, axis=0)
    out += 0.5 * index * (np.abs(out).sum(1, keepdims=True) > 0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def pooled(d: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Means over the words of word, shape and repetition vectors, their lengths, and log size."""
    means = np.zeros((3, DIM), np.float32)
    for at in range(0, len(d), 1 << 16):
        means += vectors[d[at : at + (1 << 16)]].sum(0)
    means /= max(1, len(d))
    spread = len(np.unique(d[:, 0])) / max(1, len(d)) ** 0.8
    return np.concatenate([means.ravel(), np.linalg.norm(means, axis=1), [spread, np.log1p(len(d)) / 5]]).astype(np.float32)


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.maximum(0, ((x - self.mean) * self.scale) @ w + b) @ v + c

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.stack([pooled(token_rows(t), self.vectors) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, seed: int = 11) -> tuple:
    """Weights of the two layers, by Adam on the cross entropy over shuffled batches."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, s, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(max(20, rounds * 256 // max(256, len(x)))):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            h = np.maximum(0, x[rows] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(e, p[2]) * (h > 0)
            t += 1
            for k, g in enumerate((x[rows].T @ back + 1e-3 * p[0], back.sum(0), h.T @ e + 1e-3 * p[2], e.sum(keepdims=True))):
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.001 * (g * g - s[k])
                p[k] -= 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model:
    """Learns from labels (0 or 1) of rows whose crc32(id as text) mod 3 is not 1."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where(
        F.col("__y").isin(0, 1) & (F.crc32(F.col("__id").cast("string")) % 3 != 1))
    known = known.orderBy(unit_hash(F.col("__id")), "__id", "__y").limit(SAMPLE)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["__id"], "y": b["__y"], "rows": [token_rows(t).ravel() for t in b["text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    got = (texts.join(F.broadcast(known), "__id").select("__id", "__y", "text")
           .mapInPandas(run, f"id {kind}, y int, rows array<int>").toPandas())
    got = got.sort_values(["id", "y"], kind="stable").iloc[:SAMPLE]
    rows = [np.asarray(r, np.int32).reshape(-1, 3) for r in got["rows"]]
    if not rows:
        size = 3 * DIM + 5
        none = (np.zeros((size, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
        return Model(np.zeros((_ROWS, DIM), np.float32), np.zeros(size), np.ones(size), none, 1.0)
    vectors = context_vectors(rows)
    x, y = np.stack([pooled(d, vectors) for d in rows]).astype(float), got["y"].to_numpy(float)
    mean, scale = x.mean(0), 1 / (x.std(0) + 1e-3)
    z = (x - mean) * scale
    aside = np.random.default_rng(3).random(len(z)) < 0.2
    layers = train(z[~aside], y[~aside]) if (~aside).any() else train(z, y)
    model = Model(vectors, mean, scale, layers, 1.0)
    if aside.any():
        own, side = model.logits(x[aside]), np.where(y[aside] > 0, 1, -1)
        grid = np.geomspace(0.25, 8, 40)
        model.temperature = float(grid[np.argmin([np.logaddexp(0, -side * own / t).mean() for t in grid])])
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted; with ``keep`` the columns of
    ``docs`` followed by ``__score`` instead.

    Null text counts as empty and is scored like any text. Labels other than 0 and 1, and labels
    without a document, teach nothing; without any label every score is 0.5. Null ids are scored,
    never learned from, and not held out. Repeated rows give repeated rows.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = [model.score(g) for g in groups(b["text"])]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": score,
                                "predicted": (score >= 0.5).astype(int)})

    if keep:
        if "__score" in docs.columns:
            raise ValueError("the table has a column __score already")
        # Only the text goes to Python; the other columns stay as they are.
        @F.pandas_udf("double")
        def score_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                scores = [model.score(g) for g in groups(b)]
                yield pd.Series(np.concatenate(scores) if scores else np.zeros(0))

        return docs.withColumn("__score", score_of(F.col(text_col)))
    rows = docs.select(exact_id(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
