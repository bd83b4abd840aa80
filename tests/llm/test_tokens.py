"""The tokenizing step of op3, op5 and op8: each different word goes to the library once, and odd texts get the libraries' own ids."""

import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from sparkfind.llm import bpe, tokens

ODD = ["a", "The", "É", "é", "ß", "ª", "µ", "×", "'s", "'", "22", "²", "½", "...", ",", "!", '"', "\\", "]", "^", "[", "\n", "\n\n", " ", "  ", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "\u200b", "\x00", "e\u0301", "H\u0331", "中", "İ", "K", "ſ", "Σ", "<|endoftext|>", "\U0001f600", "\xad", " the", " word.", " a.\nB", " x,\ny.\nz", "\n x", "?\n!"]


def fresh(name):
    lower = name.startswith("word")
    tokens._made.clear()
    return (tokens.word_bpe if lower else tokens.byte_bpe)(P.path(name)), tokens._tokenizer(P.path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_go_to_the_library_once(name):
    encode, library = fresh(name)
    r = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("qua", "fné", "ulm") for b in ("ter", "oß") for c in ("ing", "ed", "")]
    texts = [" ".join(r.choice(words) + r.choice(["", "", ",", ".", '!"', ".\nulmter", "\nquaoß,\nfnéter"]) for _ in range(200)) for _ in range(50)]
    asked, inner = [], encode.encode
    encode.encode = lambda ps: asked.extend(ps) or inner(ps)
    got = list(encode(pa.array(texts)))
    assert got == [tokens.packed(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    # the words after a blank, some without one before, and the marks and line feeds by themselves
    assert len(asked) == len(set(asked)) <= 2 * len(words) + 6
    assert list(encode(pa.array(texts))) == got and len(asked) == len(set(asked))


@pytest.mark.parametrize("part", [1, 1000, 4 << 20])
def test_odd_texts_have_the_libraries_ids(monkeypatch, part):
    monkeypatch.setattr(tokens, "PART_BYTES", part)
    r = random.Random(part)
    texts = ["", None, " ", "\n", "\0", "\0\0 a", " \0a", "a \0b", *("".join(r.choice(ODD) for _ in range(r.randint(1, 25))) for _ in range(2000))]
    column = pa.array([None, *texts], pa.string()).slice(1)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encode, library = fresh(name)
        encode.limit = 1 << 14  # the halves change places many times
        assert list(encode(column)) == [tokens.packed(x.ids) for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert list(encode(column.slice(0, 0))) == []
    path = P.path("byte_bpe_50k.tiktoken")
    made = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    assert list(bpe.byte_bpe_of(path, P.PATTERN).encode(column)) == [tokens.packed(made.encode_ordinary(t or "")) for t in texts]


def test_word_forms_are_one_word_of_op5():
    """Case and marks make no new word where the vocabulary is lower case."""
    encode, library = fresh("word_bpe_49k.json")
    texts = [" ".join(f + m for f in ("quater", "Quater", "QUATER", "fnéoß", "Fnéoß") for m in ("", ",", ".", "...")), '"Quater" (fnéoß)']
    got = list(encode(pa.array(texts)))
    assert got == [tokens.packed(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert set(encode.known) == {"quater", "fnéoß", ",", ".", "...", '"Quater"', "(fnéoß)"}
