"""A toxicity classifier: boosted trees over dense features, with isotonic calibration.

A lexicon of words and of stems (first letters of words) is read off a bounded sample of labelled rows, each entry with its log odds. The
features of a text are densities of the lexicon's tiers, how near its hits stand to the second person, capitals,
punctuation, obfuscation and stretched letters. A row of the sample gets its features from a lexicon that other folds gave, since
its own words would tell its label; the scores that calibration fits are of trees that have not seen the row either. Every text is
scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.llm.common import cut, exact_id, forget, unit_hash
from treelake.llm.privacy import _scores as scores_of
from treelake.llm.privacy import boost
from treelake.llm.tokens import MEMO, groups

#: Most labelled rows of either class that are learned from, folds, entries of the lexicon, rows an entry must stand in.
TOXIC, CLEAN, FOLDS, ENTRIES, SEEN = 2000, 4000, 4, 6000, 3
#: Lengths of stems, words on each side of a second person, bins of a feature.
STEMS, NEAR, BINS = range(3, 9), 4, 48
#: Least log odds of the tiers.
STRONG, MIDDLE, WEAK = 3.5, 2.0, 1.0

# Words of address and common insults in four languages.
SECOND = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deinen euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes".split())
INSULTS = frozenset((
    "idiot idiots moron morons stupid dumb loser losers trash scum clown pathetic worthless disgusting jerk imbecile fool coward "
    "dummkopf trottel abschaum widerlich erbärmlich wertlos imbécile crétin ordure minable dégoûtant idiota imbécil estúpido basura patético asqueroso").split())
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_MIXED = re.compile(r"[^\W\d_][\d@$!*#.+_-]+[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_PUNCT_RUN = re.compile(r"[^\w\s]{2,}")
#: Columns of a word's own values.
_COLUMNS = 17


def core(word: str) -> str:
    """The word in lower case without what surrounds it."""
    return _EDGES.sub("", word).lower()


def revealed(word: str) -> str:
    """A disguised word as it is meant: look-alikes as letters, what stands between them and repeats of letters left out."""
    return _STRETCHED.sub(r"\1", "".join(_LETTERS.findall(_EDGES.sub("", word).lower().translate(_LEET))))


def terms(words: set[str]) -> set[str]:
    """What the lexicon counts of a text: its words, closed by a blank, and their stems."""
    out: set[str] = set()
    for c in {core(w) for w in words}:
        if c.isalpha():
            out.add(c + " ")
            out.update(c[:k] for k in STEMS if k <= len(c))
    return out


def odds(pos: np.ndarray, neg: np.ndarray, all_pos: float, all_neg: float) -> np.ndarray:
    return np.log((pos + 0.5) / (all_pos + 1)) - np.log((neg + 0.5) / (all_neg + 1))


class Lexicon:
    """Log odds by term. ``values`` of a text are the features, from one memo of words."""

    def __init__(self, entries: dict[str, float]):
        self.entries = entries
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, _COLUMNS))

    def _odds(self, c: str) -> tuple[float, float]:
        get = self.entries.get
        return get(c + " ", 0.0), max((get(c[:k], 0.0) for k in STEMS if k <= len(c)), default=0.0)

    def _word(self, word: str) -> list[float]:
        c = core(word)
        whole, stem = self._odds(c) if c.isalpha() else (0.0, 0.0)
        meant = ""
        if c and (not c.isalpha() or _STRETCHED.search(c)):
            meant = revealed(word)
        whole2, stem2 = self._odds(meant) if meant else (0.0, 0.0)
        known = c in INSULTS
        hidden = bool(meant) and max(whole2, stem2) >= MIDDLE and max(whole, stem) < MIDDLE or meant in INSULTS and not known
        best = max(whole, stem)
        letters = sum(map(len, _LETTERS.findall(word)))
        upper = sum(ch.isupper() for ch in word)
        hit = best >= MIDDLE or known or hidden
        return [whole >= STRONG, MIDDLE <= whole < STRONG, stem >= STRONG, MIDDLE <= stem < STRONG, WEAK <= stem < MIDDLE, best, known, hidden, c in SECOND,
                hit, hit and upper > 0 and word.upper() == word, letters, upper, letters > 1 and upper == letters, word.count("!"), bool(_PUNCT_RUN.search(word)),
                bool(_MIXED.search(word)) + bool(_STRETCHED.search(word))]

    def _rows(self, words: list[str]) -> np.ndarray:
        if len(self.at) > MEMO:
            self.at, self.table = {}, self.table[:0]
        new = {w for w in words if w not in self.at}
        if new:
            start = len(self.at)
            self.at.update((w, start + i) for i, w in enumerate(new))
            rows = np.array([self._word(w) for w in new], float)
            if start + len(new) > len(self.table):
                self.table = np.vstack([self.table[:start], rows, np.zeros((len(rows) + start, _COLUMNS))])
            else:
                self.table[start : start + len(new)] = rows
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def values(self, text: str) -> np.ndarray:
        """The dense features of a text."""
        words = text.split()
        n = max(1, len(words))
        ids = self._rows(words)
        hits = np.flatnonzero(self.table[ids, 9]) if len(ids) else ids
        second = np.flatnonzero(self.table[ids, 8]) if len(ids) else ids
        total, most = np.zeros(_COLUMNS), 0.0
        for at in range(0, len(ids), 1 << 16):
            rows = self.table[ids[at : at + (1 << 16)]]
            total += rows.sum(0)
            most = max(most, rows[:, 5].max())
        near = 0.0
        if len(hits) and len(second):
            to = np.searchsorted(second, hits)
            apart = np.minimum(np.abs(hits - second[np.minimum(to, len(second) - 1)]), np.abs(hits - second[np.maximum(to - 1, 0)]))
            near = float((apart <= NEAR).mean())
        kinds = len({words[i] for i in hits})
        return np.array([*(total[[0, 1, 2, 3, 4, 5, 6, 7, 8, 9]] / n), most, near, np.log1p(total[9]), np.log1p(total[0] + total[2]), np.log1p(kinds),
                         total[10] / max(1.0, total[9]), total[12] / max(1.0, total[11]), total[13] / n, total[14] / n, text.count("?") / n, total[15] / n,
                         total[16] / n, np.log1p(len(words))])


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step-wise fit of ``y`` on ``score``, by pooling neighbours that violate the order."""
    blocks: list[list[float]] = []
    for s in np.unique(score):
        own = score == s
        blocks.append([s * w[own].sum(), (w * y)[own].sum(), w[own].sum()])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


@dataclass
class Model:
    entries: dict[str, float]
    edges: list[np.ndarray]
    start: float
    trees: list
    knots: tuple[np.ndarray, np.ndarray]
    key: str = field(default_factory=lambda: uuid4().hex)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)])

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.edges:
            return np.zeros(len(texts))
        if self.key not in _LEXICONS:
            _LEXICONS.clear()
            _LEXICONS[self.key] = Lexicon(self.entries)
        x = np.stack([_LEXICONS[self.key].values(t) for t in texts])
        return np.interp(scores_of(self.start, self.trees, self.binned(x)), *self.knots)


#: The lexicon in use, kept from batch to batch of a worker.
_LEXICONS: dict[str, Lexicon] = {}


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[int, float]]:
    """At most ``TOXIC`` and ``CLEAN`` labelled rows (id, y, fold, text) whose crc32(id as text) mod 5 is not 0, the same ones however the
    tables are partitioned, and what a row of either class stands for."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & (F.crc32(F.col("id").cast("string")) % 5 != 0))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = (unit_hash(F.col("id")), F.col("id"))
    some = known.where("y = 1").orderBy(*order).limit(TOXIC).unionByName(known.where("y = 0").orderBy(*order).limit(CLEAN))
    fold = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("fold")), F.lit(FOLDS)).cast("int")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(some), "id").select(exact_id("id").alias("id"), "y", fold.alias("fold"), "text")
    return rows, {y: counts[y] / min(counts[y], (CLEAN, TOXIC)[y]) for y in counts}


def lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Log odds by term from the sample's rows outside of each fold, and from all (last)."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for y, fold, text in zip(b["y"], b["fold"], b["text"]):
                seen.update((t, 2 * fold + y) for t in terms(set(text.split())))
            yield pd.DataFrame([(t, c, n) for (t, c), n in seen.items()], columns=["term", "cell", "n"])

    cells = rows.mapInPandas(count, "term string, cell int, n long")
    each = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)]
    sizes = {(r["y"], r["fold"]): r["n"] for r in rows.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    all_pos, all_neg = (sum(n for (y, _), n in sizes.items() if y == k) for k in (1, 0))
    pos, neg = (sum((F.col(f"c{2 * f + k}") for f in range(FOLDS)), F.lit(0)) for k in (1, 0))
    weight = F.log((pos + 0.5) / (all_pos + 1)) - F.log((neg + 0.5) / (all_neg + 1))
    kept = (cells.groupBy("term").agg(*each).where(pos >= SEEN).withColumn("w", weight).where(F.col("w") >= WEAK)
            .orderBy((pos * F.col("w")).desc(), "term").limit(ENTRIES).toPandas())
    c = kept[[f"c{i}" for i in range(2 * FOLDS)]].to_numpy(float).reshape(-1, FOLDS, 2)
    out = []
    for f in (*range(FOLDS), None):
        rest = [g for g in range(FOLDS) if g != f]
        p, n = c[:, rest, 1].sum(1), c[:, rest, 0].sum(1)
        w = odds(p, n, sum(sizes.get((1, g), 0) for g in rest), sum(sizes.get((0, g), 0) for g in rest))
        good = (p >= SEEN) & (w >= WEAK)
        out.append(dict(zip(kept["term"][good], w[good])))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    found, stands_for = sample(docs, labels, id_col, text_col, label_col)
    rows = cut(found)
    books = lexicons(rows)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [Lexicon(b) for b in books[:FOLDS]]
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "fold": b["fold"], "x": [own[f].values(t) for f, t in zip(b["fold"], b["text"])]})

    got = rows.mapInPandas(features, "id string, y int, fold int, x array<double>").toPandas().sort_values(["id", "y"], kind="stable")
    forget(rows)
    if not len(got):
        return Model({}, [], 0.0, [], (np.zeros(1), np.zeros(1)))
    x, y, fold = np.stack(got["x"].to_numpy()), got["y"].to_numpy(float), got["fold"].to_numpy()
    w = np.array([stands_for[int(k)] for k in y])
    w *= len(w) / w.sum()
    model = Model(books[FOLDS], [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])], 0.0, [], (np.zeros(1), np.zeros(1)))
    z = model.binned(x)
    unseen = np.zeros(len(y))
    for f in np.unique(fold):
        rest = fold != f
        unseen[~rest] = scores_of(*boost(z[rest], y[rest], w[rest]), z[~rest]) if rest.any() else 0.0
    model.knots = isotonic(unseen, y, w)
    model.start, model.trees = boost(z, y, w)
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from a score of 0.5).

    Null text counts as empty and is scored like any text. Labels other than 0 and 1, and labels without a document, teach
    nothing; without any label every score is 0. Null ids are scored, never learned from, and not held out. Repeated
    rows give repeated rows; other columns are ignored."""
    model = fit(docs, labels, id_col, text_col, label_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [model.score(g) for g in groups(b["text"])]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": score, "predicted": (score >= 0.5).astype(int)})

    rows = docs.select(exact_id(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
