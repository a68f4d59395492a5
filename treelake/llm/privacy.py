"""Personal data by candidate boosting, in DataFrame functions only.

Strict patterns give the base spans, which always stay. Generators of high recall propose further
and overlapping spans (numbers in any grouping, local phone numbers, disguised addresses, keys). Each
candidate has features of its format and of what stands before it. Its label is evidence that no feature shows: a number is
a card if its check digit holds, four numbers are an address if each is in range, a telephone or e-mail
candidate is right if a base span of that kind covers it or a word such as "call" introduces it, a key if one such as "token" does. Boosted
trees are fitted on the counts of feature combinations over the whole corpus, a table whose size the features' ranges
bound. The trees become SQL conditions; a threshold for each kind is calibrated on documents held out from the fit, and
candidates above it that meet no base span are added.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans.
ALL_KINDS = (*KINDS, "secret")
#: Precision that a threshold must reach on held-out documents, one in FOLDS; trees, depth, learning rate.
PRECISION, FOLDS, TREES, DEPTH, RATE = 0.9, 5, 20, 3, 0.3
#: What the weights of all candidates add up to, whatever their number, beside a leaf's regularisation of 1.
WEIGHT = 1000.0
#: How often the evidence of a kind holds by chance alone: one in ten numbers has a right check digit.
CHANCE = (0.0, 0.0, 0.1, 0.0, 0.0)

# A match either begins where no earlier character could have begun it or right after the last match;
# with possessive repeats this finds what the plain patterns find, in time linear in the text.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_NUMBER = r"[+(]?[0-9](?:[\x20()./-]{0,3}[0-9])++"
_LOCAL = r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
_AT = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++"
       r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++")
_KEY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}"
_KEY_WORD = (r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?|authorization|bearer)"
             r"[\"']?\s*(?:[:=]|is)?\s*[\"']?$")
_WORDS = {"phone": r"(?i)(?:phone|tel|fax|call|mobile|cell)[a-z]*[.:#]?\s*$", "card": r"(?i)(?:card|visa|credit|account)[a-z]*[.:#]?\s*$",
          "email": r"(?i)(?:e-?mail|contact|write to)[.:]?\s*$", "ip": r"(?i)(?:\bip|host|server|address)[.:]?\s*$"}
_BLOCK, _TEXT_BLOCK = 256, 4096
#: Characters before a candidate that its features look at.
_BEFORE = 20


def _running(df: DataFrame, out: str, values: Column, add) -> DataFrame:
    """Adds ``out``: the running results of ``add`` from 0 before each element of ``values``, and the last one. Long arrays
    are taken in blocks, so that they aren't copied for each element, and what a loop looks into is a column
    that is named more than once: an expression with a single use would move into the loop and run for each element."""
    v, bases = f"{out}_values", f"{out}_bases"
    run = lambda a, start: F.aggregate(
        a, F.array(start), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))
    zero = F.lit(0).cast("int")
    starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(v, values)
    df = df.withColumn(bases, run(F.transform(starts, lambda b: F.aggregate(F.slice(v, b, _BLOCK), zero, lambda acc, x: add(acc, x))), zero))
    inside = lambda b, k: F.slice(run(F.slice(v, b, _BLOCK), F.when(k < F.size(bases), F.get(bases, k))), F.lit(1),
                                  F.size(F.slice(v, b, _BLOCK)))
    return df.withColumn(out, F.concat(F.flatten(F.transform(starts, inside)), F.slice(bases, -1, 1))).drop(v, bases)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _merged(df: DataFrame, spans: str, out: str) -> DataFrame:
    """Adds ``out``: spans (start, end, kind), sorted by start, with those that overlap merged under the first one's kind."""
    df = _running(df, "reach", F.transform(spans, lambda s: s["end"]), F.greatest)
    heads = F.filter(F.transform(spans, lambda s, i: F.when(s["start"] >= F.get("reach", i), i)), lambda i: i.isNotNull())
    df = df.withColumn("heads", heads)
    return df.withColumn(out, F.transform("heads", lambda i, k: F.struct(
        F.get(spans, i)["start"].alias("start"),
        F.get("reach", F.coalesce(F.get("heads", k + 1), F.size("reach") - 1)).alias("end"), F.get(spans, i)["kind"].alias("kind")))).drop("reach", "heads")


def _find(name: str, pattern: str, when: Column):
    """Two selects that add ``name``: array of (start, end, m, b) of the matches, code points, and what stands before each."""
    none = F.array().cast("array<string>")

    def matches(df: DataFrame) -> DataFrame:
        return df.withColumns({f"{name}_m": F.when(when, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)}).withColumns(
            {f"{name}_p": F.when(F.size(f"{name}_m") > 0, F.slice(F.split("text", pattern, -1), F.lit(1), F.size(f"{name}_m"))).otherwise(none)})

    def spans(df: DataFrame) -> DataFrame:
        # The k-th match begins after k + 1 pieces and k matches.
        steps = F.zip_with(f"{name}_p", f"{name}_m", lambda p, m: (F.char_length(p) + F.char_length(m)).cast("int"))
        df = _running(df, f"{name}_r", steps, _plus)
        found = F.transform(F.arrays_zip(F.slice(f"{name}_r", F.lit(1), F.size(f"{name}_m")).alias("r"), F.col(f"{name}_p").alias("p"), F.col(f"{name}_m").alias("m")),
                            lambda z, i: F.struct(
                                (z["r"] + F.char_length(z["p"])).alias("start"), (z["r"] + F.char_length(z["p"]) + F.char_length(z["m"])).alias("end"),
                                z["m"].alias("m"), F.right(F.concat(F.coalesce(F.get(f"{name}_m", i - 1), F.lit("")), z["p"]), F.lit(_BEFORE)).alias("b")))
        return df.withColumn(name, found).drop(f"{name}_m", f"{name}_p", f"{name}_r")

    return lambda df: spans(matches(df))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    doubled = lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
    each = F.transform(F.regexp_extract_all(F.reverse(_digits(m)), F.lit("[0-9]"), F.lit(0)), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _count(m: Column) -> Column:
    return F.char_length(_digits(m))


def _valid_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return _valid_ip(m)
    if kind == "card":
        return F.when(_count(m).between(13, 19), _luhn(m)).otherwise(False)
    if kind == "phone":
        return _count(m).between(9, 15)
    return F.lit(True)


def _keep_valid(kind: str):
    return lambda s: _valid(kind, s["m"])


def _labelled(number: int, name: str, *fields: str):
    """A function that turns a span into a struct of the constant ``name`` and the fields."""
    return lambda s: F.struct(F.lit(number).alias(name), *[s[f].alias(f) for f in fields])


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ...) with arrays email, ip, card, phone of (start, end, m)."""
    docs = docs.withColumn("has_digit", F.col("text").rlike("[0-9]"))
    tests = {"email": F.instr("text", "@") > 0, "ip": F.col("has_digit"), "card": F.col("has_digit"),
             "phone": F.col("has_digit") & (F.instr("text", "+") > 0)}
    for kind, pattern in zip(KINDS, (_EMAIL, _IP, _CARD, _PHONE), strict=True):
        docs = _find(kind, pattern, tests[kind])(docs)
    return docs.withColumns({k: F.filter(k, _keep_valid(k)) for k in KINDS})


def _index(df: DataFrame, name: str, spans: Column) -> DataFrame:
    """Adds what :func:`_meets` needs of ``spans``: their starts in order, and how far those before each one reach."""
    df = df.withColumn(f"{name}_sorted", F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    df = _running(df, f"{name}_reach", F.transform(f"{name}_sorted", lambda s: s["end"]), F.greatest)
    return df.withColumn(f"{name}_starts", F.transform(f"{name}_sorted", lambda s: s["start"])).drop(f"{name}_sorted")


def _meets(name: str, s: Column) -> Column:
    """Whether a span meets one of the indexed spans: of those that begin before its end, found by halving, one
    reaches beyond its start."""
    n = F.size(f"{name}_reach") - 1
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1.0)).cast("int"))
    half = lambda lo, hi: F.floor((lo + hi) / 2).cast("int")
    range_ = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    # (The starts are named twice, as in _running.)
    before = F.aggregate(steps, range_(F.lit(0), n), lambda r, _: F.when(r["lo"] >= r["hi"], r).when(
        (F.size(f"{name}_starts") > 0) & (F.get(f"{name}_starts", half(r["lo"], r["hi"])) < s["end"]), range_(half(r["lo"], r["hi"]) + 1, r["hi"])).otherwise(
        range_(r["lo"], half(r["lo"], r["hi"]))))["lo"]
    return (n > 0) & (F.get(f"{name}_reach", before) > s["start"])


def _candidates(docs: DataFrame) -> DataFrame:
    """Adds ``found``: candidates (kind, start, end, f array of features, meets a base span, right) of all generators."""
    for name, pattern, when in (("number", _NUMBER, F.col("has_digit")), ("local", _LOCAL, F.col("has_digit")),
                                ("at", _AT, F.col("text").rlike(r"@|\(at\)|\[at\]")), ("key", _KEY, F.col("has_digit"))):
        docs = _find(name, pattern, when)(docs)
    for name, spans in (("any", F.concat(*KINDS)), ("phones", F.col("phone")), ("emails", F.col("email"))):
        docs = _index(docs, name, spans)
    number = F.filter("number", lambda s: _count(s["m"]) >= 7)
    key = F.filter("key", lambda s: (_count(s["m"]) >= 2) & s["m"].rlike("[A-Za-z]"))
    gens = F.concat(*[F.transform(a, _labelled(g, "gen", "start", "end", "m", "b"))
                      for g, a in enumerate((number, F.col("local"), F.col("at"), key))])
    docs = docs.withColumn("gens", gens)

    def feature(s: Column) -> Column:
        m, n = s["m"], _count(s["m"])
        least = lambda x, most: F.least(x, F.lit(most)).cast("int")
        before = s["b"]
        last = F.right(before, F.lit(1))
        dots = F.char_length(m) - F.char_length(F.replace(m, F.lit("."), F.lit("")))
        four = m.rlike(r"^[0-9]{1,4}(?:\.[0-9]{1,4}){3}$")
        kind = F.when(s["gen"] == 2, 0).when(s["gen"] == 3, 4).when(four, 1).when(n >= 13, 2).otherwise(3)
        word = reduce(lambda acc, k: acc.when(before.rlike(_WORDS[KINDS[k]]), k + 1), range(4), F.when(F.lit(False), 0)).otherwise(0)
        f = F.array(
            s["gen"], least(n, 20), least((F.char_length(m) - n) / 4, 10), least(F.char_length(m) / 4, 15), m.contains("(").cast("int"),
            least(F.char_length(F.regexp_replace(m, "[A-Za-z0-9]", "")), 5), least(dots, 4),
            m.rlike(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$").cast("int"), m.rlike(r"^[0-9]{4}(?:[ -][0-9]{4}){3}$").cast("int"),
            m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int"), last.rlike("[\"']").cast("int"), m.rlike("[a-z].*[A-Z]|[A-Z].*[a-z]").cast("int"),
            m.rlike(r"\((?:at|dot)\)|\[(?:at|dot)\]").cast("int"), last.rlike("[A-Za-z0-9]").cast("int"))
        luhn = F.when(n.between(13, 19), _luhn(m)).otherwise(False)
        right = (F.when(kind == 0, _meets("emails", s) | (word == 1)).when(kind == 1, _valid_ip(m)).when(kind == 2, luhn)
                 .when(kind == 4, before.rlike(_KEY_WORD)).otherwise(_meets("phones", s) | (word == 4)))
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), f.alias("f"), _meets("any", s).alias("meets"),
                        right.alias("right"))

    return docs.withColumn("found", F.transform("gens", feature))


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, list]:
    """Trees for the log odds of ``y`` (shares) with weights ``w``: nested (feature, cut, left, right)."""
    prior = float(np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-3, 1 - 1e-3))
    start = float(np.log(prior / (1 - prior)))
    score, trees = np.full(len(y), start), []

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
        g, h = grad[rows].sum(), hess[rows].sum()
        best, split = 1e-6, None
        for j in range(x.shape[1] if depth else 0):
            values = x[rows, j]
            left_g, left_h = np.cumsum(np.bincount(values, grad[rows])), np.cumsum(np.bincount(values, hess[rows]))
            gain = (left_g**2 / (left_h + 1.0) + (g - left_g) ** 2 / (h - left_h + 1.0) - g**2 / (h + 1.0))[:-1]
            if len(gain) and gain.max() > best:
                best, split = float(gain.max()), (j, int(gain.argmax()))
        if split is None:
            return float(RATE * g / (h + 1.0))
        j, cut = split
        inside = x[rows, j] <= cut
        return (j, cut, grow(rows[inside], grad, hess, depth - 1), grow(rows[~inside], grad, hess, depth - 1))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(y)), w * (y - p), w * p * (1 - p), DEPTH))
        score = score + _scores(0.0, trees[-1:], x)
    return start, trees


def _scores(start: float, trees: list, x: np.ndarray) -> np.ndarray:
    def value(tree, rows: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(tree, tuple):
            out[rows] += tree
            return
        inside = x[rows, tree[0]] <= tree[1]
        value(tree[2], rows[inside], out)
        value(tree[3], rows[~inside], out)

    out = np.full(len(x), start)
    for t in trees:
        value(t, np.arange(len(x)), out)
    return out


def _as_sql(start: float, trees: list, f: Column) -> Column:
    def node(t) -> Column:
        return F.lit(float(t)) if not isinstance(t, tuple) else F.when(f[t[0]] <= t[1], node(t[2])).otherwise(node(t[3]))
    return reduce(lambda a, t: a + node(t), trees, F.lit(start))


def fit(docs: DataFrame, text_col: str = "text"):
    """(score of a feature array as a Column function, thresholds by kind), from all of ``docs``."""
    # An outer explode: a plain one adds a filter on its input that would repeat the whole search.
    rows = _candidates(base_spans(docs.select(text_of(text_col).alias("text")))).select(
        (F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0).alias("held"), F.explode_outer("found").alias("c"))
    table = rows.where("c is not null").groupBy("held", "c.kind", "c.f").agg(F.count("*").alias("n"), F.count_if("c.right").alias("k")).collect()
    return model_of([(r["held"], r["kind"], r["f"], r["n"], r["k"]) for r in table])


def model_of(table: list[tuple]):
    """The model from counts: (held out, kind, features, candidates, right ones)."""
    if not table:
        return (lambda f: F.lit(0.0)), [float("inf")] * len(ALL_KINDS)
    held, kinds = np.array([r[0] for r in table]), np.array([r[1] for r in table])
    x = np.array([r[2] for r in table])
    n, k = np.array([r[3] for r in table], float), np.array([r[4] for r in table], float)
    order = np.flatnonzero(~held)
    order = order[np.lexsort(np.column_stack((x, kinds))[order].T)]
    start, trees = boost(x[order], (k / n)[order], (n / max(n[order].sum(), 1) * WEIGHT)[order]) if len(order) else (0.0, [])
    scores = _scores(start, trees, x)
    limits = []
    for kind in range(len(ALL_KINDS)):
        own = np.flatnonzero((kinds == kind) & held)
        own = own[np.argsort(-scores[own], kind="stable")]
        right, all_ = np.cumsum(k[own]), np.cumsum(n[own])
        last = np.append(np.diff(scores[own]) != 0, True) if len(own) else np.zeros(0, bool)
        good = np.flatnonzero((right - CHANCE[kind] * all_ >= PRECISION * (1 - CHANCE[kind]) * all_) & last)
        limits.append(float(scores[own[good[-1]]]) - 1e-9 if len(good) else float("inf"))
    return (lambda f: _as_sql(start, trees, f)), limits


def find(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """``docs`` (of its columns and ``text``) with ``base`` and ``spans``: arrays of (kind, start, end), by kind and then start."""
    score, limits = model
    rows = _candidates(base_spans(docs.withColumn("text", text_of(text_col))))
    base = F.concat(*[F.transform(k, _labelled(i, "kind", "start", "end")) for i, k in enumerate(KINDS)])
    limit = lambda kind: reduce(lambda acc, i: acc.when(kind == i, F.lit(limits[i])), range(len(limits)), F.when(F.lit(False), F.lit(0.0)))
    more = F.filter("found", lambda c: ~c["meets"] & (score(c["f"]) > limit(c["kind"])))
    ordered = F.array_sort(F.transform(more, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    rows = _merged(rows.withColumn("base", base).withColumn("more", ordered), "more", "picked")
    picked = F.transform("picked", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.withColumn("spans", F.array_sort(F.concat("base", picked)))


def _written(spans: Column) -> Column:
    name = F.array(*map(F.lit, ALL_KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (base and added ones).

    Added spans that overlap are one span under the kind of the one that begins first.

    Null text counts as empty and has no span; repeated rows give repeated rows; the model is fitted
    on all rows of ``docs``; an empty table gives an empty result; extra columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = find(own, fit(own))
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                       F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
                       F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in its text replaced by its kind in brackets; spans that overlap count
    as one. Columns and rows stay as they are; null text stays null."""
    fields = docs.columns
    packed = docs.select(F.col(text_col).alias("text"), F.struct(*fields).alias("row"))
    rows = find(packed, fit(docs, text_col))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = _merged(rows.withColumn("ordered", ordered), "ordered", "merged")
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.char_length("text") / _TEXT_BLOCK)), lambda b: F.substring(
        F.col("text"), (b * _TEXT_BLOCK + 1).cast("int"), F.lit(_TEXT_BLOCK)))
    rows = rows.withColumn("blocks", F.when(F.size("merged") > 0, blocks))

    def piece(a: Column, b: Column) -> Column:
        """The text from a to b, from blocks of it, as finding a place in a long text takes a scan of it."""
        first, last = (F.floor(x / _TEXT_BLOCK).cast("int") for x in (a, b))
        begin = F.substring(F.get("blocks", first), a % _TEXT_BLOCK + 1, F.when(first == last, b - a).otherwise(_TEXT_BLOCK))
        more = F.concat(F.array_join(F.slice("blocks", first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                        F.substring(F.get("blocks", last), F.lit(1), b % _TEXT_BLOCK))
        return F.when(first == last, begin).otherwise(F.concat(begin, more))

    after = lambda i: F.coalesce(F.get("merged", i - 1)["end"], F.lit(0))
    parts = F.transform("merged", lambda s, i: F.concat(piece(after(i), s["start"]), F.element_at(name, s["kind"] + 1)))
    tail = piece(F.element_at("merged", -1)["end"], F.char_length("text"))
    text = F.when(F.size("merged") > 0, F.concat(F.concat_ws("", parts), tail)).otherwise(F.col("row")[text_col])
    return rows.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in fields])
