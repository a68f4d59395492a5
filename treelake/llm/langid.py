"""Language identification in two levels: the family, then one-versus-one linear SVMs inside it.

Features are the relative frequencies of hashed letter trigrams. The machines are fitted by numpy
on a sample of labelled rows of at most ``PER_LANG`` rows a language and ``SAMPLE`` in all; every
text is then scored whole, in tasks, as the mean weight of its trigrams.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.llm.common import exact_id, unit_hash
from treelake.llm.tokens import groups

#: Hashed features, and the bounds of the training sample.
DIM, SAMPLE, PER_LANG = 1 << 12, 1400, 350
#: A family for the commoner codes; any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"), "turkic": ("tr", "az", "kk", "uz"), "indic": ("hi", "mr", "ne", "bn"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}


def _letters() -> np.ndarray:
    """Lower-case letter of each character of the basic plane; a space for what is no letter."""
    out = np.full(1 << 16, 32, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_TABLE: list[np.ndarray] = []


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of each trigram, text of each trigram, letters in each text)."""
    if not _TABLE:
        _TABLE.append(_letters())
    raw = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    of = np.full(len(raw), len(texts), np.int32)
    of[1 : 1 + int((lengths + 1).sum())] = np.repeat(np.arange(len(texts), dtype=np.int32), lengths + 1)
    flat = raw < 1 << 16
    c = _TABLE[0][np.where(flat, raw, 32)]
    if not flat.all():
        far = raw[~flat]
        c[~flat] = np.where([chr(x).isalpha() for x in far.tolist()], far, 32)
    at = np.flatnonzero(c != 32)
    h = c[at - 1] * np.uint32(0x9E3779B1) + c[at] * np.uint32(0x85EBCA77) + c[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    own = of[at]
    return (h >> np.uint32(20)).astype(np.int64) & (DIM - 1), own, np.bincount(own, minlength=len(texts))[: len(texts)]


def frequencies(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), DIM), np.float32)
    h, own, n = trigrams(texts)
    np.add.at(out.reshape(-1), own * np.int64(DIM) + h, 1)
    return out / np.maximum(n, 1)[:, None]


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, by accelerated gradient steps; y is -1 or 1, and the
    two sides weigh the same."""
    z = np.empty((len(x), x.shape[1] + 1), x.dtype)
    z[:, :-1], z[:, -1] = x, 1
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w = v = np.zeros(z.shape[1], x.dtype)
    top = float((np.einsum("ij,ij->i", z, z) * weight).sum())
    rate = 1 / (1 + 2 * c * top)
    for k in range(rounds):
        miss = np.maximum(0, 1 - y * (z @ v))
        new = v - rate * (v - 2 * c * (z.T @ (weight * y * miss)))
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Machines in one matrix: ``weights[feature, machine]``; each tells ``left`` from ``right``."""

    weights: np.ndarray
    bias: np.ndarray
    families: dict[str, list[str]]
    between: list[tuple[str, str]]
    within: dict[str, list[tuple[str, str]]]
    slope: float = 3.0

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        h, own, n = trigrams(texts)
        margins = np.zeros((len(texts), len(self.bias)))
        for at in range(0, len(h), 1 << 19):
            some, part = h[at : at + (1 << 19)], own[at : at + (1 << 19)]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            margins[part[first]] += np.add.reduceat(self.weights[some], first, axis=0)
        margins = margins / np.maximum(n, 1)[:, None] + self.bias
        names, chance = _one_versus_one(margins, sorted(self.families), self.between, 0, self.slope)
        out, score, column = list(names), chance.copy(), len(self.between)
        for family, langs in sorted(self.families.items()):
            rows = np.flatnonzero(names == family)
            if len(rows):
                won, p = _one_versus_one(margins[rows], langs, self.within[family], column, self.slope)
                for r, lang in zip(rows.tolist(), won.tolist()):
                    out[r] = lang
                score[rows] = score[rows] * p
            column += len(self.within[family])
        # A model without a language knows nothing of any text.
        learned = (n > 0) & bool(self.weights.size or len(self.families) > 1 or list(self.families.values()) != [["und"]])
        return [o if k else "und" for o, k in zip(out, n.tolist())], np.where(learned, score, 0.0)


def _one_versus_one(margins: np.ndarray, names: list[str], pairs: list[tuple[str, str]],
                    column: int, slope: float) -> tuple[np.ndarray, np.ndarray]:
    """The name with the most duels won, then the larger sum of margins; and the chance that it wins
    its closest duel."""
    index = {x: i for i, x in enumerate(names)}
    votes, sums = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
    closest = np.full((len(margins), len(names)), 20.0)
    for k, (a, b) in enumerate(pairs):
        m = margins[:, column + k]
        for name, side in ((a, m), (b, -m)):
            i = index[name]
            votes[:, i] += side > 0
            sums[:, i] += side
            closest[:, i] = np.minimum(closest[:, i], side)
    best = np.argmax(votes + 0.5 * np.tanh(sums / (1 + np.abs(sums).max(initial=1.0))), axis=1)
    return np.array(names, object)[best], 1 / (1 + np.exp(-np.clip(slope * closest[np.arange(len(best)), best], -30, 30)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> pd.DataFrame:
    """At most ``PER_LANG`` learnable rows of each language: (lang, counts of the features)."""
    rows = docs.where(F.crc32(F.col(id_col).cast("string")) % 5 != 0).where(F.col(lang_col).isNotNull())
    rows = rows.where(F.length(text_col) > 0)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return pd.DataFrame({"lang": [], "x": []})
    cap = max(1, min(PER_LANG, SAMPLE // len(sizes)))
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, 1.2 * cap / n))])
    some = rows.where(unit_hash(F.col(id_col)) < F.element_at(share, F.col(lang_col)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for g in groups(b["text"], 200_000):
                yield pd.DataFrame({"lang": b["lang"].to_numpy()[at : at + len(g)], "x": list(frequencies(g))})
                at += len(g)

    # The same rows however the table is partitioned.
    got = (some.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).orderBy(unit_hash(F.col("id")), "id", "text").limit(2 * cap * len(sizes))
           .select("lang", "text").mapInPandas(run, "lang string, x array<float>").toPandas())
    return got.groupby("lang", sort=True).head(cap)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows whose crc32(id as text) mod 5 is not 0 and whose language is known."""
    got = sample(docs, id_col, text_col, lang_col)
    langs = sorted(set(got["lang"]))
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(_FAMILY.get(lang, lang), []).append(lang)
    between = list(combinations(sorted(families), 2))
    within = {f: list(combinations(own, 2)) for f, own in sorted(families.items())}
    if not langs:
        return Model(np.zeros((DIM, 0)), np.zeros(0), {"und": ["und"]}, [], {"und": []})
    x = np.empty((len(got), DIM), np.float32)
    for k, row in enumerate(got["x"]):
        x[k] = row
    got = got.drop(columns="x")
    scale = 1 / (x.std(0) + 1e-4)
    scale = (scale / np.sqrt(DIM)).astype(np.float32)
    lang = got["lang"].to_numpy()
    family = np.array([_FAMILY.get(v, v) for v in lang], object)
    machines = [(family, a, b) for a, b in between]
    machines += [(lang, a, b) for f in sorted(families) for a, b in within[f]]
    weights, bias = np.zeros((DIM, len(machines)), np.float32), np.zeros(len(machines))
    margins = [np.array([1.0])]
    for k, (names, a, b) in enumerate(machines):
        rows = (names == a) | (names == b)
        w, bias[k] = svm(x[rows] * scale, np.where(names[rows] == a, 1, -1).astype(np.float32))
        weights[:, k] = w * scale
        margins.append(np.where(names[rows] == a, 1, -1) * (x[rows] @ weights[:, k] + bias[k]))
    # Chances: nine of ten training rows win their duels with 95 % at least.
    slope = float(np.log(19) / max(0.02, np.quantile(np.concatenate(margins), 0.1)))
    return Model(weights, bias, families, between, within, slope)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score.

    A null text, or one without a letter, is ``und`` with score 0; so is every row if no row can be
    learned from. Rows with a null id are predicted, never learned from, and not held out. Repeated
    rows give repeated rows; extra columns are ignored.
    """
    model = fit(docs, id_col, text_col, lang_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for g in groups(b["text"]):
                names, score = model.predict(g)
                own = b.iloc[at : at + len(g)]
                yield pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), "held_out": own["held_out"].to_numpy(),
                                    "lang_pred": names, "score": score})
                at += len(g)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(exact_id(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
