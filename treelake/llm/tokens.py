"""Tokenisation of whole texts, and token files in a word-aligned code.

``WordEncoder`` gives the tokenizers library's ids. It asks the library for each distinct word
once per worker and keeps the answers in a bounded memo, which is right because that tokenizer
never carries anything across white space. ``ByteEncoder`` is a byte-level BPE of its own.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treelake.llm.common import exact_id

#: Entries a memo may hold before it starts afresh, and characters taken at once.
MEMO, AT_ONCE = 400_000, 1_000_000

_LATIN = "".join(c for c in map(chr, range(0x00C0, 0x0250)) if c.isalpha() and c != "İ")
_UNUSUAL = re.compile(f"[^ \\n\\t\\r!-~{_LATIN}]")
_PUNCTUATION_RUN = re.compile(r"[!-/:-@\[-`{-~]{2}")


def groups(texts: Iterable[str | None], size: int = AT_ONCE) -> Iterator[list[str]]:
    """Consecutive texts of about ``size`` characters in all; null counts as empty."""
    own, n = [], 0
    for t in texts:
        own.append(t or "")
        n += len(own[-1])
        if n >= size:
            yield own
            own, n = [], 0
    if own:
        yield own


class WordEncoder:
    """Ids, as little-endian unsigned 32-bit bytes, by the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        added = json.loads(self.lib.to_str())["added_tokens"]
        self.mark = added[0]["content"]
        self.mark_id = added[0]["id"]
        self.added = [a["content"] for a in added]
        self.model = self.lib.model
        self.shown = {b: c for b, c in enumerate(_byte_alphabet())}
        self.raw: dict[str, bytes] = {}
        self.lower: dict[str, bytes] = {}

    def _words(self, text: str) -> tuple[bool, list[str]]:
        """Whether the words are lower-cased, and the words. Plain Latin texts are lower-cased and
        have stops and commas set apart, which leaves the same pieces and far fewer distinct words."""
        flat = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        usual = flat.isprintable() if flat.isascii() else not _UNUSUAL.search(text)
        if usual and not _PUNCTUATION_RUN.search(text):
            return True, (flat.lower() + " ").replace(". ", " . ").replace(", ", " , ").split(" ")
        return False, flat.split(" ")

    def _learn_letters(self, memo: dict[str, bytes], words: list[str]) -> None:
        """Lower-cased words of letters are one piece each, which the library's model takes directly."""
        tokenize, ids, ends = self.model.tokenize, [], []
        for w in words:
            shown = w if w.isascii() else w.encode().decode("latin-1").translate(self.shown)
            ids += [t.id for t in tokenize(shown)]
            ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        for w, a, b in zip(words, [0, *ends], ends):
            memo[w] = raw[a:b]

    def _learn(self, memo: dict[str, bytes], words: set[str]) -> None:
        alone = [w for w in words if any(a in w for a in self.added)]
        for w in alone:
            memo[w] = np.array(self.lib.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        rest = list(words.difference(alone))
        for at in range(0, len(rest), 5000):
            some = rest[at : at + 5000]
            ids = np.array(self.lib.encode(self.mark.join(some), add_special_tokens=False).ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
            raw, begin = ids.tobytes(), 0
            for w, end in zip(some, ends, strict=True):
                memo[w] = raw[4 * begin : 4 * end]
                begin = end + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._words(t) for t in texts]
        for plain, memo in ((True, self.lower), (False, self.raw)):
            if len(memo) > MEMO:
                memo.clear()
            if new := {w for p, ws in split if p is plain for w in ws if w not in memo}:
                letters = [w for w in new if plain and w.isalpha()]
                self._learn_letters(memo, letters)
                self._learn(memo, new.difference(letters))
        return [b"".join(map((self.lower if p else self.raw).__getitem__, ws)) for p, ws in split]


class ByteEncoder:
    """Byte-level BPE: ranks beside part boundaries in one contiguous array for each short word."""

    #: Words above so many bytes use a queue instead of repeated scans.
    SHORT = 128
    _PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
               r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = {c: b for b, c in enumerate(_byte_alphabet())}
        as_bytes = lambda s: bytes(shown[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]))
        for s, i in vocab.items():
            self.bytes_of[i] = as_bytes(s)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.single = [vocab[c] for c in _byte_alphabet()]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.pieces = regex.compile(self._PIECES)
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.piece_memo: dict[str, bytes] = {}
        self.first_memo: dict[str, bytes] = {}
        self.later_memo: dict[str, bytes] = {}

    def word(self, word: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.single[b] for b in word]
        if len(ids) > self.SHORT:
            return self._long(ids)
        merge, none = self.merge.get, (1 << 60, 0)
        ranks = [merge(p, none)[0] for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none[0]:
            i = ranks.index(least)
            ids[i] = merge((ids[i], ids[i + 1]))[1]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merge((ids[i - 1], ids[i]), none)[0]
            if i < len(ranks):
                ranks[i] = merge((ids[i], ids[i + 1]), none)[0]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same merges, least rank and then leftmost first, in n log n."""
        n, merge = len(ids), self.merge.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = merge((a, b))[1], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := merge((ids[x], ids[y]))):
                    heapq.heappush(queue, (m[0], x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def _section(self, text: str) -> bytes:
        out, memo = [], self.piece_memo
        for p in self.pieces.findall(text):
            if (known := memo.get(p)) is None:
                if len(memo) > MEMO:
                    memo.clear()
                known = np.array(self.word(p.encode("utf-8", "surrogatepass")), "<u4").tobytes()
                if len(p) <= self.SHORT:
                    memo[p] = known
            out.append(known)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text. A single space between two other characters always begins a piece, so
        texts whose spaces are all of that kind are looked up space by space."""
        if self.at_special and self.at_special.search(text):
            parts = self.at_special.split(text)
            return b"".join(np.uint32(self.special[p]).astype("<u4").tobytes() if p in self.special
                            else self._section(p) for p in parts)
        words = text.split(" ")
        if "" in words or any(w[0].isspace() or w[-1].isspace() for w in words):
            return self._section(text)
        first, later = self.first_memo, self.later_memo
        for memo in (first, later):
            if len(memo) > MEMO:
                memo.clear()
        head = words[0]
        if head not in first:
            first[head] = self._section(head)
        rest = words[1:]
        for w in {w for w in rest if w not in later}:
            later[w] = self._section(" " + w)
        return first[head] + b"".join(map(later.__getitem__, rest))

    def decode(self, ids: list[int]) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=4)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


# --- byte BPE round trip ------------------------------------------------------------------------

def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   keep_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids
    and the decoded text themselves with ``keep_ids``. Null text counts as empty (no id); repeated
    rows give repeated rows; an empty table an empty result; other columns are ignored."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = byte_encoder(path)
        shown = [str(i) for i in range(len(enc.bytes_of))]
        for b in batches:
            rows = []
            for t in b["text"]:
                ids = np.frombuffer(enc.encode(t or ""), "<u4").tolist()
                decoded = enc.decode(ids)
                row = [len(ids), hashlib.sha256(",".join([shown[i] for i in ids]).encode()).hexdigest(),
                       hashlib.sha256(decoded.encode()).hexdigest()]
                rows.append([*row, ids, decoded] if keep_ids else row)
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256",
                                              *(["ids", "decoded"] if keep_ids else [])])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", ids array<int>, decoded string" if keep_ids else ""
    rows = docs.select(exact_id(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, f"doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


# --- Simple-8b ----------------------------------------------------------------------------------

#: Bits and count of selectors 1 to 14; selector 0 says that the next word is one raw value.
_BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_COUNTS = tuple(60 // b for b in _BITS)
BLOCK = 4096


def simple8b_encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block of ``BLOCK`` values). Each word takes the selector that
    packs the most of the next values; a block's last word is filled with zeros."""
    v = np.asarray(values, np.uint64)
    n_blocks = -(-len(v) // BLOCK)
    if not n_blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pad = np.zeros(n_blocks * BLOCK, np.uint64)
    pad[: len(v)] = v
    grid = pad.reshape(n_blocks, BLOCK)
    # Bits of each value, and their maxima over windows of 2, 4, ... values; a selector's window is covered by two
    # of those. (Just below 2**60 a value may seem one bit wider, and is escaped.)
    widths = {1: np.zeros((n_blocks, BLOCK + 64), np.uint8)}
    widths[1][:, :BLOCK] = np.frexp(grid.astype(np.float64))[1]
    for p in (2, 4, 8, 16, 32):
        half = widths[p // 2]
        widths[p] = half.copy()
        np.maximum(half[:, : -p // 2], half[:, p // 2 :], out=widths[p][:, : -p // 2])
    best = np.zeros((n_blocks, BLOCK), np.uint8)
    for s in range(len(_BITS), 0, -1):
        count = _COUNTS[s - 1]
        p = 1 << (count.bit_length() - 1)
        most = np.maximum(widths[p][:, :BLOCK], widths[p][:, count - p : count - p + BLOCK])
        best[most <= _BITS[s - 1]] = s
    step = np.array([1, *_COUNTS])[best]
    taken = np.zeros((n_blocks, BLOCK), bool)
    pos, rows = np.zeros(n_blocks, np.int64), np.arange(n_blocks)
    sizes = np.minimum(BLOCK, len(v) - rows * BLOCK)
    while len(rows):
        taken[rows, pos] = True
        pos = pos + step[rows, pos]
        live = pos < sizes[rows]
        rows, pos = rows[live], pos[live]
    starts = np.flatnonzero(taken.ravel())
    selector = best.ravel()[starts]
    raw = selector == 0
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(raw)[:-1]))
    words = np.zeros(len(starts) + int(raw.sum()), np.uint64)
    words[place[raw] + 1] = pad[starts[raw]]
    flat = np.concatenate((pad, np.zeros(60, np.uint64)))
    ends = (starts // BLOCK + 1) * BLOCK
    for s in np.unique(selector[~raw]):
        own = selector == s
        bits, count = _BITS[s - 1], _COUNTS[s - 1]
        at, end = starts[own], ends[own]
        word = np.full(len(at), np.uint64(int(s) << 60))
        tail = at + count > end
        for k in range(count):
            value = flat[at + k]
            value[tail & (at + k >= end)] = 0
            word |= value << np.uint64(k * bits)
        words[place[own]] = word
    block_of = starts // BLOCK
    first = np.searchsorted(block_of, np.arange(n_blocks))
    return words, place[first]


def simple8b_decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of :func:`simple8b_encode`, all words of a selector at once."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    payload = np.zeros(len(words), bool)
    zeros = np.flatnonzero(selector == 0)
    if len(zeros):
        known = -1
        for z in zeros.tolist():
            if z != known:
                payload[known := z + 1] = True
    # A raw value can look like any selector; whatever follows an escape is skipped, in order.
    heads = np.flatnonzero(~payload)
    sel = selector[heads]
    count = np.array([1, *_COUNTS, 0])[sel]
    block = np.searchsorted(offsets, heads, side="right") - 1
    before = np.concatenate(([0], np.cumsum(count)))
    first = np.searchsorted(heads, offsets)
    start = before[:-1] - before[first][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    own = sel == 0
    out[start[own]] = words[heads[own] + 1]
    for s in np.unique(sel[~own]):
        own = sel == s
        bits, mask = np.uint64(_BITS[s - 1]), np.uint64((1 << _BITS[s - 1]) - 1)
        w = words[heads[own]]
        at, last, count_ = start[own], end[own], _COUNTS[s - 1]
        full = at + count_ <= last
        for k in range(count_):
            out[at[full] + k] = (w[full] >> (np.uint64(k) * bits)) & mask
        for to, until, word in zip(at[~full].tolist(), last[~full].tolist(), w[~full]):
            for k in range(until - to):
                out[to + k] = (word >> (np.uint64(k) * bits)) & mask
    return out


# --- token files --------------------------------------------------------------------------------

FILE_SCHEMA = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.StringType())), T.StructField("lengths", T.ArrayType(T.IntegerType())),
    T.StructField("offsets", T.BinaryType()), T.StructField("words", T.BinaryType())])
#: Ids a file row gathers before it is closed; a document is never split between rows.
ROW_IDS = 1 << 20


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise ``docs`` and write their ids to ``out`` in ascending doc_id order.

    The files are Parquet, committed by Spark: part p holds the p-th range of ids; a row holds whole
    documents as Simple-8b words with the word offset of each block, and ``first``, the ids of
    its part before it. Null text counts as empty; rows that repeat an id are neighbours in the
    order of a hash of their text; null ids come first. Ids are integers; text that is none fails the job.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = word_encoder(path), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.uint32(end_id).astype("<u4").tobytes()
        doc_ids, lengths, ids, n, first = [], [], [], 0, 0

        def row() -> pd.DataFrame:
            words, offsets = simple8b_encode(np.frombuffer(b"".join(ids), "<u4"))
            return pd.DataFrame({"part": [part], "first": [first], "doc_ids": [doc_ids], "lengths": [lengths],
                                 "offsets": [offsets.astype("<i8").tobytes()], "words": [words.astype("<u8").tobytes()]})

        for b in batches:
            keys = b["doc_id"].tolist()
            at = 0
            for some in groups(b["text"]):
                for key, raw in zip(keys[at : at + len(some)], enc.encode(some), strict=True):
                    doc_ids.append(key)
                    ids.append(raw + end)
                    lengths.append(len(ids[-1]) // 4)
                    n += lengths[-1]
                    if n >= ROW_IDS:
                        yield row()
                        first += n
                        doc_ids, lengths, ids, n = [], [], [], 0
                at += len(some)
        if doc_ids:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
    rows = rows.sortWithinPartitions("doc_id", "tie").select(exact_id("doc_id").alias("doc_id"), "text")
    rows.mapInPandas(run, FILE_SCHEMA).write.option("compression", "zstd").parquet(out)


def read_token_files(spark: SparkSession, out: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, and its ids with
    ``keep_ids``. A first look at the parts' sizes (one number for each part) gives the starts."""
    files = spark.read.schema(FILE_SCHEMA).parquet(out)
    sizes = files.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    base, total = {}, 0
    for r in sizes.orderBy("part").collect():
        base[r["part"]] = total
        total += r["n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                lengths = np.asarray(r.lengths, np.int64)
                ends = np.cumsum(lengths)
                ids = simple8b_decode(np.frombuffer(r.words, "<u8"), np.frombuffer(r.offsets, "<i8"),
                                      int(ends[-1])).astype("<u4")
                own = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
                got = pd.DataFrame({"doc_id": list(r.doc_ids), "start": base[r.part] + r.first + ends - lengths,
                                    "n_tokens": lengths, "ids_crc32": [zlib.crc32(x.tobytes()) for x in own]})
                yield got.assign(ids=own) if keep_ids else got

    out = files.mapInPandas(run, "doc_id string, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else ""))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
