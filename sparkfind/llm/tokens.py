"""Cached tokenization with the public vocabularies: whole texts to little-endian unsigned 32-bit ids.

A text is cut where no token of the vocabulary can cross. Arrow cuts the texts, finds the different pieces of some
megabytes and lays their ids in a row; Python looks up each different piece once, in a bounded cache, and only unknown
pieces go to the library. The cut is exact, not an approximation.
"""

from __future__ import annotations

import functools
import os
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Estimated bytes in each of the two halves of a worker's cache.
CACHE_BYTES = 100 << 20
#: Bytes of text that are cut at a time (one text at least), and different pieces that are looked up at a time.
PART_BYTES, PART_PIECES = 4 << 20, 4096
_made: dict = {}
#: ASCII marks that stand in no word (fixed: string.punctuation without the apostrophe).
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Stands before a piece that has no blank before it.
LOOSE = "\0"
#: A blank beside other white space or a control character, or a text that holds the mark of loose pieces.
_CROWDED = r"\x00|[\x00-\x20\x7f-\x{a0}\pZ] | [\x00-\x20\x7f-\x{a0}\pZ]"
_LETTERS, _MARKS = r"[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+", "[" + "".join("\\" + m for m in MARKS) + "]+"


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # as the vocabularies' own notes have it: their strings in a text are ordinary text
    return made


def packed(ids: Iterable[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Cached:
    """Ids of texts, through a bounded cache of pieces. cut: texts -> the list of each one's pieces; atoms: pieces -> the list of each
    one's parts, where pieces have parts; encode: a list of such pieces or parts -> the packed ids of each."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], cut: Callable[[pa.Array], pa.ListArray], atoms: Callable[[pa.Array], pa.ListArray] | None = None, limit: int = CACHE_BYTES):
        self.encode, self.cut, self.atoms, self.limit, self.known, self.old, self.size = encode, cut, atoms, limit, {}, {}, 0

    def rest(self) -> None:
        """Frees the older half: at a task's end, as the worker may go on with other work."""
        self.old = {}

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, in the order given; null is empty."""
        texts = texts.fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        parts = [*np.flatnonzero(np.diff(ends // PART_BYTES, prepend=-1)).tolist(), len(texts)]
        of_pieces = self._found if self.atoms is None else lambda pieces: _joined(self.atoms(pieces), self._found)
        for a, b in zip(parts, parts[1:]):
            yield from _joined(self.cut(texts.slice(a, b - a)), of_pieces).to_numpy(zero_copy_only=False)

    def _found(self, pieces: pa.Array) -> pa.Array:
        """The ids of pieces that differ from each other."""
        out: list = []
        for i in range(0, len(pieces), PART_PIECES):
            if self.size > self.limit:  # what is used again comes back from the older half
                self.known, self.old, self.size = {}, self.known, 0
            some = pieces.slice(i, PART_PIECES).to_numpy(zero_copy_only=False).tolist()
            found = list(map(self.known.get, some))
            lost = [k for k, ids in enumerate(found) if ids is None]
            fresh = [some[k] for k in lost]
            back = list(map(self.old.get, fresh))
            made = iter(self.encode([p for p, ids in zip(fresh, back) if ids is None]))
            back = [next(made) if ids is None else ids for ids in back]
            self.size += sum(map(len, fresh)) * 6 + 180 * len(fresh)
            self.known.update(zip(fresh, back))
            for k, ids in zip(lost, back):
                found[k] = ids
            out += found
        return pa.array(out, pa.large_binary())


def _joined(lists: pa.ListArray, ids_of: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """The ids of each list: its items' ids one after the other; ids_of gets each different item once."""
    coded = lists.flatten().dictionary_encode()
    ids = ids_of(coded.dictionary).take(coded.indices)
    ends = np.frombuffer(ids.buffers()[1], np.int64)[lists.offsets.to_numpy()]
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), ids.buffers()[2]])


def _in_order(which: np.ndarray, those: pa.Array, others: pa.Array) -> pa.Array:
    """One array of ``those`` where ``which`` holds and ``others`` elsewhere."""
    return pa.concat_arrays([those, others]).take(pa.array(np.argsort(np.argsort(~which, kind="stable"))))


def space_pieces(text: str) -> list[str]:
    """Pieces between which a byte-level BPE with the usual pattern never merges: a single blank
    between two other characters that are not white space starts a new piece. Text with longer
    or other white space around blanks stays joined there."""
    parts = text.split(" ")
    out, held = [], parts[0]
    for part in parts[1:]:
        if held and part and not held[-1].isspace() and not part[0].isspace():
            out.append(held)
            held = " " + part
        else:
            held += " " + part
    if held:
        out.append(held)
    return out


def blank_cut(texts: pa.Array) -> pa.ListArray:
    """``space_pieces`` of each text: a piece is given without the blank before it, and with ``LOOSE`` where there is none."""
    crowded = pc.match_substring_regex(texts, _CROWDED).to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(pc.binary_join_element_wise(LOOSE, texts.filter(~crowded), ""), " ")
    if not crowded.any():
        return plain
    odd = [[p[1:] if p[0] == " " and p[1:2] != LOOSE else LOOSE + p for p in space_pieces(t)] for t in texts.filter(crowded).to_pylist()]
    return _in_order(crowded, pa.array(odd, plain.type), plain)


def literal(piece: str) -> str:
    """The text of a piece of ``blank_cut``."""
    return piece[1:] if piece[:1] == LOOSE else " " + piece


def word_atoms(pieces: pa.Array, lower: bool) -> pa.ListArray:
    """Parts of pieces that the usual pattern never joins: a word of Latin-1 letters and a run of ``MARKS`` after it;
    where white space is kept, such words and marks on both sides of single line feeds, and the line feeds. ASCII letters
    of these are lower-cased where the vocabulary does so. All other pieces stay whole."""
    word = f"{_LETTERS}(?:{_MARKS})?"
    of_words = pc.match_substring_regex(pieces, f"^{word}$" if lower else f"^\\x00?{word}(?:\\n{word})*$").to_numpy(zero_copy_only=False)
    whole = pieces.filter(~of_words)
    pieces, mark = pieces.filter(of_words), "" if lower else LOOSE
    if lower:
        pieces = pc.ascii_lower(pieces)
    cut = pc.replace_substring_regex(pieces, f"({_MARKS}|\\n)", f" {mark}\\1")
    cut = pc.split_pattern(cut if lower else pc.replace_substring(cut, "\n", f"\n {mark}"), " ")
    single = pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1, dtype=np.int32)), whole)
    return _in_order(of_words, cut, single.cast(cut.type))


def plain_words(made, lower: bool) -> Callable[[list[str]], list[bytes]]:
    """An encoder of ``word_atoms`` that hands words straight to the library's BPE model.

    A word of Latin-1 letters, with or without a blank before, is one pre-token: normalising it is lower-casing at most,
    and its bytes map to the model's characters. All else takes the library's whole path."""
    from .bpe import byte_map

    chars = byte_map()
    letters = {chr(c): "".join(chars[b] for b in chr(c).encode()) for c in range(256)}
    tokenize, ids_of, blank = made.model.tokenize, attrgetter("id"), chars[0x20]

    def mapped(p: str) -> str | None:
        """The word in the model's characters; None for what is no plain word."""
        before, body = ("", p.lower()) if lower else ("", p[1:]) if p[:1] == LOOSE else (blank, p)
        if not body.isalpha():
            return None
        if body.isascii():
            return before + body
        return before + "".join(map(letters.__getitem__, body)) if max(body) <= "\xff" else None

    def encode(ps: list[str]) -> list[bytes]:
        words = list(map(mapped, ps))
        rest = [p if lower else literal(p) for p, w in zip(ps, words) if w is None]
        others = iter(made.encode_batch_fast(rest, add_special_tokens=False))
        return [packed(next(others).ids) if w is None else packed(map(ids_of, tokenize(w))) for w in words]

    return encode


def byte_bpe(path: str) -> Cached:
    """The byte-level BPE of a tokenizers file."""
    if ("byte", path) not in _made:
        made = _tokenizer(path)
        _made["byte", path] = Cached(plain_words(made, lower=False), blank_cut, functools.partial(word_atoms, lower=False))
    return _made["byte", path]


def word_bpe(path: str) -> Cached:
    """The word BPE of a tokenizers file whose normaliser drops white space."""
    if ("word", path) not in _made:
        made = _tokenizer(path)
        _made["word", path] = Cached(plain_words(made, lower=True), pc.ascii_split_whitespace, functools.partial(word_atoms, lower=True))
    return _made["word", path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
