"""Token counts next to the library on whole texts."""

from __future__ import annotations

import os
from functools import cache

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.helpers import docs, odd_texts

from garoa.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    *odd_texts(),
    "a  b   c\n\n d \t e",
    " lead and trail ",
    "x<|endoftext|> y <|endoftext|>z",
    "it's 12 o'clock, isn't it?     yes \x1c no",
    "日本 語 " * 50,
]


@cache
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def plain(text):
    return len(library().encode(text or "", add_special_tokens=False).ids)


def test_counts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, TEXTS[3])]
    out = tokens.token_counts(docs(spark, rows, "n_tokens n_bytes over_limit"), PATH, limit=100).collect()
    want = sorted((i or -1, len((t or "").encode()), plain(t), plain(t) > 100) for i, t in rows)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == want
    assert tokens.token_counts(docs(spark, []), PATH).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1'., \n\t 　é<|>!", max_size=30))
def test_pieces_give_the_tokens_of_the_whole(text):
    assert "".join(tokens.PIECE.findall(text)) == text
    assert tokens.count_tokens(PATH, [text]) == [plain(text)]


def test_memory_starts_afresh(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 2)
    assert tokens.count_tokens(PATH, ["a b c d", "e f"]) == [plain("a b c d"), plain("e f")]
    assert tokens.count_tokens(PATH, ["g h a"]) == [plain("g h a")]
    assert set(tokens._remembered(PATH)) == {"g", " h", " a"}


def test_memory_is_bounded_in_bytes(monkeypatch):
    tokens._remembered.cache_clear()
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 20_000)
    for i in range(100):
        texts = [chr(0x4E00 + i) * 5_000, " ".join(f"{i}x{j}" for j in range(50))]
        assert tokens.count_tokens(PATH, texts)[1] == plain(texts[1])
    memory = tokens._remembered(PATH)
    assert max(map(len, memory)) <= tokens.REMEMBERED_CHARS
    assert memory.held <= 20_000 + 50 * 170 and len(memory) < 250
