"""Token counts and the BPE codec against the public libraries."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from kinsum.llm import bpe_codec as bc
from kinsum.llm import token_counts as tc

PIECE, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
HARD = ["  ", "a  b", "a\nb\t c ", "<|endoftext|>x<|startoftext|> y <|endoftext|", "ΑΣ ΑΣΑ İstanbul ǅ", "é ﬁ Å", "日本語 テキスト 123 ४५", "🙂🙃 don't we'll 'S 'RE", "a" * 5000, "ab" * 300, "▁▁x ▁", "<s> </s> <unk> <0x0A>", "ſ K ß ẞ", "x" * 100 + " " * 100 + "y"]


@pytest.fixture(scope="module")
def cases(odd, real):
    rnd = random.Random(1)
    mixed = ["".join(rnd.choice("aabcdeinrst <>|▁éñß 1!'\n") for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    return list(enumerate([*odd, *HARD, *mixed, *[t for _, t in real]]))


def test_token_counts(make, cases):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = {i: (len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t in cases}
    rows = tc.token_counts(make(cases), PIECE, limit=100).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == want
    assert tc.token_counts(make([]), PIECE).collect() == []


def test_bpe_codec(make, cases):
    lib = tokenizers.Tokenizer.from_file(WORD)
    want = {}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in cases:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    rows = bc.bpe_codec(make(cases), WORD).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want
    assert bc.bpe_codec(make([]), WORD).collect() == []


def test_encoded_round_trip(make):
    lib = tokenizers.Tokenizer.from_file(WORD)
    (r,) = bc.encoded(make(["Hello <|endoftext|> wörld 12"]), WORD).collect()
    assert r.ids == lib.encode("Hello <|endoftext|> wörld 12", add_special_tokens=False).ids
    assert r.decoded.replace("</w>", "").split() [0] == "hello"


def test_small_automaton_is_sequential_merging():
    """Every string over a small alphabet: the automaton's path equals applying the
    merges in order, leftmost first."""
    merges = [("a", "a"), ("a", "b"), ("aa", "a"), ("b", "aa"), ("ab", "b"), ("baa", "ab")]
    vocab = {t: i for i, t in enumerate(["a", "b", *(u + v for u, v in merges)])}
    auto = bc.Automaton(vocab, merges)
    for n in range(1, 10):
        for k in range(2**n):
            s = [("a", "b")[k >> j & 1] for j in range(n)]
            want = list(s)
            for u, v in merges:
                i = 0
                while i < len(want) - 1:
                    if want[i] == u and want[i + 1] == v:
                        want[i : i + 2] = [u + v]
                    i += 1
            assert [auto.labels[t] for t in auto.path(s)] == want, s
