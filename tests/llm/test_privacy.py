import hashlib
import random
import re
import time

from treelake.llm import privacy

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    d = [int(c) for c in digits(s)][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def base(text):
    keep = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
            "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(m), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in zip(keep, (EMAIL, IP, CARD, PHONE)) for m in p.finditer(text or "") if keep[k](m.group())]


TEXTS = ["a@b.c_d@e.f g@h.i.j@k.l", "1.2.3.4.5.6.7.8 999.1.1.1 1.1.1.1", "+1 (705) 555-1902 call +49 30 123456-7 +", "4387513035237269 4387-5130-3523-7269-1",
         "x" * 3000 + "@y.z", "9" * 4000, "é@é.com é+1 234 567 8901 ü 1.2.3.4", "a@b a@b.c@d.e.f", "", None, "😀 a@b.cc 😀 10.0.0.1 😀", "99999999999999999999.1.1.1",
         "0000 0000 0000 0000", " ".join(f"1.1.{i % 256}.{i % 250}" for i in range(600)), "no data at all, version 3.0"]


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(9)
    texts = TEXTS + ["".join(rng.choice("0123456789 .-+()@aé\n") for _ in range(150)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, email int")
    got = {r.doc_id: r for r in privacy.personal_data(docs).collect()}
    for i, t in enumerate(texts):
        expected, r = base(t), got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest(), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in expected) for k in ("email", "ip", "card", "phone")]
        assert set(expected) <= set(filter(None, r.spans.split(",")))


def test_added_spans_and_redaction(spark):
    texts = [f"reach me at +1 ({a}) 555-1{a} today" for a in range(200, 260)] + ["phone: (705) 555-1902 or mail joe (at) ex.com", "clean text of 2024", None]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, spans string, base string")
    out = privacy.redact(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text == "reach me at [PHONE] today" and rows[0].spans == "a"
    assert "[PHONE]" in rows[60].text and "555" not in rows[60].text
    assert rows[61].text == "clean text of 2024" and rows[62].text is None


def test_added_spans_have_precision_and_recall(spark):
    """Keys are learned from those that a word introduces and found without one; words and numbers of other formats stay."""
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows, truth = [], {}
    for i in range(400):
        words = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 24))) for _ in range(12))
        lead = f"{words} item {rng.randrange(10**4)} of 1999-2003, "
        if i % 4 < 2:
            k = key()
            given = 'token = "' if i % 4 == 0 else 'see "'
            truth[i] = f"secret:{len(lead) + len(given)}:{len(lead) + len(given) + 40}"
            rows.append((i, f'{lead}{given}{k}" and more'))
        else:
            rows.append((i, f"{lead}build-{rng.randrange(10**4)}-release-of-{words.split()[0]} and more"))
    # Of the keys, one in eighteen is introduced by no word.
    rows = [r for r in rows if r[0] % 4 != 1 or r[0] % 72 == 1]
    got = {r.doc_id: [s for s in r.spans.split(",") if s] for r in privacy.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(truth.get(i) in s for i, s in got.items() if i in truth)
    assert hits >= 0.95 * sum(i in truth for i in got)
    added = [(i, x) for i, s in got.items() for x in s]
    assert sum(truth.get(i) == x for i, x in added) >= 0.95 * len(added)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in privacy.personal_data(docs).collect():
        expected = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert r.n_spans == len(list(filter(None, r.spans.split(",")))) >= len(expected)


def test_added_spans_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    added = found = 0
    for r in privacy.personal_data(docs).collect():
        keys = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', texts[r.doc_id])}
        more = set(filter(None, r.spans.split(","))) - set(base(texts[r.doc_id]))
        added += len(more)
        found += len(keys)
        assert more == keys
    assert added == found > 0


def test_ten_thousand_numbers_in_one_text(spark):
    text = " ".join(f"call 555-{i % 1000:03}-{i % 10000:04} at 10.0.{i % 256}.{i % 250}" for i in range(10_000))
    docs = spark.createDataFrame([(1, text), (2, text * 2)], "doc_id long, text string")
    start = time.time()
    model = privacy.fit(docs.limit(0))
    rows = {r.doc_id: r for r in privacy.find(docs, model).selectExpr("doc_id", "size(spans) as n").collect()}
    assert [rows[1].n, rows[2].n] == [len(base(text)), len(base(text * 2))]
    assert time.time() - start < 60
    out = {r.doc_id: r.text for r in privacy.redact(docs).collect()}
    assert out[1].count("[IP]") == 10_000 and "10.0." not in out[2]


def test_empty_table(spark):
    assert privacy.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
