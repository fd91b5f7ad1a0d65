"""Byte-pair encoding and decoding with the files of public tokenizers.

A pre-token's symbols stand in a row; the leaves of a segment tree hold the
ranks of neighbouring pairs, each inner node the lesser of its two. The root
is the leftmost pair of lowest rank. A merge changes three leaves and their
paths to the root, and merging ends when the root holds no rank. The trees of
many pre-tokens of like size are worked on together, one merge of each at a
time, as columns of numbers.

Each task keeps what it has encoded, up to a number of distinct pre-tokens;
beyond it the store starts anew, so memory is bounded and results are not
touched by it.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cargolens.llm.common import blocks, narrow_batches, text_blocks

NONE = np.int64(1) << 60
#: Distinct pre-tokens a task remembers, and bytes of text that are looked up together.
REMEMBERED, TOGETHER = 100_000, 1 << 20
#: The split patterns of the two public files.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Capitals of Unicode 16, which Python does not lower yet.
LATE_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 32 for c in range(0x10D50, 0x10D66)}
LATE = re.compile("[" + "".join(map(chr, LATE_LOWER)) + "]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it has a shape, else the next free from U+0100 on."""
    shaped = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shaped else chr(next(rest)) for b in range(256)]


class Merges:
    """Encodes pre-tokens, given as bytes, to the ids of a vocabulary with ranked merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.joined = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE for pairs that don't merge or lack a right symbol (-1)."""
        key = left << 32 | (right & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((right >= 0) & (self.pairs[at] == key), self.ranks[at], NONE)

    def encode(self, tokens: list[bytes]) -> list[np.ndarray]:
        """Ids of each pre-token, none for an empty one."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(tokens)
        by_size: dict[int, list[int]] = {}
        for i, t in enumerate(tokens):
            if t:
                by_size.setdefault((len(t) - 1).bit_length(), []).append(i)
        for bits, members in by_size.items():
            wide = max(1, (1 << 21) >> bits)
            for k in range(0, len(members), wide):
                part = members[k : k + wide]
                for i, ids in zip(part, self._together([tokens[i] for i in part], 1 << bits)):
                    out[i] = ids
        return out

    def _together(self, tokens: list[bytes], size: int) -> list[np.ndarray]:
        """size: a power of two, not below the number of symbols of any token."""
        n, lengths = len(tokens), np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        raw = np.frombuffer(b"".join(t.ljust(size, b"\0") for t in tokens), dtype=np.uint8).reshape(n, size)
        place = np.arange(size)
        symbols = np.full((n, size + 1), -1, dtype=np.int64)  # the column behind the last stands for no symbol
        symbols[:, :size] = np.where(place < lengths[:, None], self.inner[raw], -1)
        row = np.arange(n)
        symbols[row, lengths - 1] = self.last[raw[row, lengths - 1]]
        after = np.where(place + 1 < lengths[:, None], place + 1, size)
        before = np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * size), NONE, dtype=np.int64)
        tree[:, size:] = self._leaf(symbols[:, :size], symbols[:, 1:], np.broadcast_to(place, (n, size)), size)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        while len(row := row[tree[row, 1] < NONE]):
            best = tree[row, 1]
            left, rank = best % size, best // size
            right = after[row, left]
            follower = after[row, right]
            symbols[row, left] = self.joined[rank]
            symbols[row, right] = -1
            after[row, left] = follower
            has = follower < size
            before[row[has], follower[has]] = left[has]
            self._put(tree, row, right, np.full(len(row), NONE), size)
            self._put(tree, row, left, self._leaf(symbols[row, left], symbols[row, follower], left, size), size)
            former = before[row, left]
            has = former >= 0
            own, former = row[has], former[has]
            self._put(tree, own, former, self._leaf(symbols[own, former], symbols[own, left[has]], former, size), size)
        kept = symbols[:, :size] >= 0
        flat, ends = symbols[:, :size][kept].astype(np.uint32), np.cumsum(kept.sum(axis=1))
        return np.split(flat, ends[:-1])

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """Rank and place as one number, so that the lesser is the lower rank and among equals the left one."""
        rank = np.where(left >= 0, self.rank(left, right), NONE)
        return np.where(rank < NONE, rank * size + place, NONE)

    @staticmethod
    def _put(tree: np.ndarray, row: np.ndarray, place: np.ndarray, value: np.ndarray, size: int) -> None:
        node = place + size
        tree[row, node] = value
        for _ in range(size.bit_length() - 1):
            node = node // 2
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])


class Tokenizer:
    """A public tokenizer file of kind word or byte: splitting, encoding, decoding, all by pre-token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        self.merges = Merges(model["vocab"], [tuple(m) for m in model["merges"]], suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.words = bool(suffix)
        self.find = regex.compile(WORD_PATTERN if self.words else BYTE_PATTERN).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.known: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        for text, i in self.special.items():
            # a special token is kept under a key that no pre-token can equal
            self.known["\0" + text] = np.uint32(i).tobytes()

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order; special tokens as themselves behind a NUL."""
        if "<|" not in text:
            return self.find(self._plain(text))
        out: list[str] = []
        for i, part in enumerate(self.parts(text)):
            out += ["\0" + part] if i % 2 else self.find(self._plain(part))
        return out

    def _plain(self, text: str) -> str:
        if not self.words:
            return text
        # lower-cased character by character: a final capital sigma is no special case
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return text if text.isascii() else LATE.sub(lambda m: chr(LATE_LOWER[ord(m[0])]), text)

    def learn(self, tokens: Iterable[str]) -> None:
        """Encodes those pre-tokens that aren't known yet."""
        new = [t for t in set(tokens) if t not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = [t for t in set(tokens) if t not in self.known]
        for t, ids in zip(new, self.merges.encode([t.encode("utf-8", "surrogatepass") for t in new])):
            self.known[t] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        split = [self.split(t) for t in texts]
        self.learn(t for s in split for t in s)
        return [np.frombuffer(b"".join([self.known[t] for t in s]), dtype="<u4") for s in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' own texts with blanks between them, as the file names no decoder."""
        return " ".join([self.names[i] for i in ids])


_OPEN: dict[str, Tokenizer] = {}


def opened(path: str) -> Tokenizer:
    """One tokenizer a file and task process."""
    if path not in _OPEN:
        _OPEN[path] = Tokenizer(path)
    return _OPEN[path]


DIGEST = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


def digests(path: str):
    """A column function: number of tokens, SHA-256 of the ids and of the decoded text of each whole text."""

    @F.pandas_udf(DIGEST)
    def digest(texts: pd.Series) -> pd.DataFrame:
        own, rows = opened(path), []
        whole = ["" if t is None else t for t in texts]
        for start, part in blocks([t.encode("utf-8", "surrogatepass") for t in whole], TOGETHER):
            split = [own.split(t) for t in whole[start : start + len(part)]]
            own.learn(set().union(*split))
            known = own.known
            for s in split:
                ids = b"".join([known[t] for t in s])
                text = own.decode(np.frombuffer(ids, dtype="<u4").tolist())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=DIGEST.names, index=texts.index)

    return digest


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row: round_trip() with the ids themselves."""
    narrow_batches(docs.sparkSession)

    def rows(batches):
        own = opened(path)
        for batch in batches:
            for start, part in text_blocks(batch, TOGETHER):
                split = [own.split(t.decode("utf-8", "surrogatepass")) for t in part]
                own.learn(set().union(*split))
                ids = [b"".join([own.known[t] for t in s]) for s in split]
                shown = (own.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in ids)
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(start, len(part)),
                        "n_tokens": pa.array(sizes),
                        "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in shown]),
                        "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat),
                    }
                )
        own.forget()  # the process lives on and serves other stages

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row: the ids of the whole text as an array."""
    return tokenized(docs, path).select("doc_id", "ids")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from rows of (doc_id, ids); null ids give an empty text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        own = opened(path)
        return pd.Series([own.decode([] if x is None else x.tolist()) for x in ids], index=ids.index, dtype=object)

    return rows.select("doc_id", text("ids").alias("text"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row.

    Null and empty texts have no tokens and the digests of nothing; repeated
    rows equal results; a null doc_id is kept. An empty table gives an empty
    result; columns but doc_id and text are not looked at.
    """
    narrow_batches(docs.sparkSession)
    digest = digests(path)
    return docs.select("doc_id", digest("text").alias("r")).select("doc_id", "r.*")
