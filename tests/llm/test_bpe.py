import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from llm_rows import ordered
from tokenizers import Tokenizer

from cargolens.llm import bpe, token_counts

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
POOL = "aAbB éÉñßΣσİıǅ'sStT<|>endoftxstar \n\t  　漢字1²½Ⅷ٣😀̧́‍!?.,-_\x1c\x1f͸ꟋᲉ"


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def samples():
    rng = random.Random(3)
    fixed = ["", " ", "a", "<|endoftext|>hi <|startoftext|>", "<|ENDOFTEXT|>", "ΑΣ ΟΔΟΣ", "don't  do\n\n\nthat \t x", "x" * 3000, "ab" * 1500 + "!?" * 300]
    return fixed + ["".join(rng.choice(POOL) for _ in range(rng.randint(1, 60))) for _ in range(400)]


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_ids_are_the_library_s(name):
    own, want = bpe.Tokenizer(public_tokenizers.path(name)), library(name).encode_batch(samples(), add_special_tokens=False)
    for text, ids, e in zip(samples(), own.encode(samples()), want):
        assert ids.tolist() == e.ids, text


def test_decoded_text_is_the_library_s():
    own, lib = bpe.Tokenizer(public_tokenizers.path(WORD)), library(WORD)
    for ids in own.encode(samples()):
        assert own.decode(ids.tolist()) == lib.decode(ids.tolist(), skip_special_tokens=False)


def test_merges_equal_plain_merging():
    vocab = {c: i for i, c in enumerate(bpe.byte_letters())}
    merges = []
    for a, b in [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "a"), ("aa", "aa"), ("c", "ab")]:
        vocab[a + b] = len(vocab)
        merges.append((a, b))
    own, rank = bpe.Merges(vocab, merges), {m: i for i, m in enumerate(merges)}
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for word, ids in zip(words, own.encode([w.encode() for w in words])):
        parts = list(word)
        while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert ids.tolist() == [vocab[p] for p in parts]


def test_store_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    own, texts = bpe.Tokenizer(public_tokenizers.path(WORD)), [f"word{i} <|endoftext|> other{i}" for i in range(60)]
    want = library(WORD).encode_batch(texts, add_special_tokens=False)
    for text, e in zip(texts, want):
        assert own.encode([text])[0].tolist() == e.ids


def test_round_trip_of_odd_rows(clashing, empty):
    rows, lib = clashing.select("doc_id", "text").collect(), library(WORD)
    want = []
    for r, e in zip(rows, lib.encode_batch([r.text or "" for r in rows], add_special_tokens=False)):
        shown = lib.decode(e.ids, skip_special_tokens=False)
        want.append((r.doc_id, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    path = public_tokenizers.path(WORD)
    assert ordered(bpe.round_trip(clashing, path).collect()) == ordered(want)
    assert bpe.round_trip(empty, path).count() == 0
    back = bpe.decoded(bpe.encoded(clashing, path), path)
    assert ordered(back.collect()) == ordered((r.doc_id, lib.decode(e.ids, skip_special_tokens=False)) for r, e in zip(rows, lib.encode_batch([r.text or "" for r in rows], add_special_tokens=False)))


@pytest.mark.parametrize("common", [0, 5, 1 << 18])
def test_token_counts_of_odd_rows(clashing, empty, monkeypatch, common):
    monkeypatch.setattr(token_counts, "COMMON", common)
    rows = clashing.select("doc_id", "text").collect()
    sizes = library(BYTE).encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    want = [(r.doc_id, len((r.text or "").encode()), len(e.ids), len(e.ids) > 100) for r, e in zip(rows, sizes)]
    path = public_tokenizers.path(BYTE)
    got = token_counts.over_limit(clashing, path, 100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert ordered(got.collect()) == ordered(want)
    assert token_counts.over_limit(empty, path, 100).count() == 0
