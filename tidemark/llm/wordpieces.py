"""Word-level encoding with a bounded memory of words, for the vocabulary that drops white space.

Its normaliser and splitter never look across white space, so a text's ids are those of its words in turn.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import accumulate, chain, compress, repeat
from operator import eq, is_

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
VOCABULARY = "word_bpe_49k.json"
KEPT_WORDS = 200_000  # of each of two generations
KEPT_PACKED = 400_000  # likewise, where a word's part is some packed ids
KEPT_PIECES = 300_000  # likewise


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


# fixed values: printable stand-ins of bytes, as the byte-level splitter writes them
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in set(_SHOWN)]
BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(_REST)}
CHAR_OF = {b: c for c, b in BYTE_OF.items()}

LATIN_END = 0x250  # letters and digits below are the same in all Unicode versions in use
_LETTERS = "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == "L")
_DIGITS = "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == "N")
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\t-\\r \\x85\\xa0{_LETTERS}{_DIGITS}]+")
_LATIN_WORDS = re.compile("\n|" + _LATIN.pattern)  # of words that a line feed parts
_BEYOND = re.compile(f"[^\0-{chr(LATIN_END - 1)}]")
_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+|\n")


def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def marks_of(special: dict[str, int]) -> tuple[bytes, ...]:
    """The beginnings of special tokens: a word without any of them has no special token."""
    return tuple({x[:2].encode() for x in special})


def pieces_of(path: str) -> Callable[[list[bytes]], list[list[bytes | int]]]:
    """A function from words to their pieces, as bytes, by the vocabulary's own normaliser and splitter.

    Special tokens come as their ids. Words of plain Latin letters are split here by the same pattern, all at once.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    special = special_tokens(path)
    split_special = re.compile("(" + "|".join(re.escape(x) for x in special) + ")") if special else None
    marks = marks_of(special)

    def other(word: bytes) -> list[bytes | int]:
        text = word.decode()
        low = text.lower()
        if max(low) < chr(LATIN_END) > max(text) and unicodedata.is_normalized("NFC", text) and not any(m in word for m in marks):
            return [p.encode() for p in _LATIN.findall(low)]
        out: list[bytes | int] = []
        for part in split_special.split(text) if split_special else [text]:
            if part in special:
                out.append(special[part])
            elif part:
                out += [bytes(map(BYTE_OF.__getitem__, p)) for p, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part))]
        return out

    def split(words: list[bytes]) -> list[list[bytes | int]]:
        whole = b"\n".join(words)
        plain = [w.isascii() for w in words]
        if any(m in whole for m in marks):
            plain = [p and not any(m in w for m in marks) for w, p in zip(words, plain, strict=True)]
        groups: list[list[bytes | int]] = [[]]
        for p in _ASCII.findall(b"\n".join(compress(words, plain)).lower()):
            if p == b"\n":
                groups.append([])
            else:
                groups[-1].append(p)
        next_plain = iter(groups)
        return [next(next_plain) if p else other(w) for w, p in zip(words, plain, strict=True)]

    return split


class WordTable:
    """What each word of a text contributes to an output that is its words' parts joined.

    `make` turns the ids of a word into its part; a word without ids has the part `make([])`, which must be false.
    Words are kept in two generations of about KEPT_WORDS.
    """

    def __init__(self, split: Callable[[list[bytes]], list[list[bytes | int]]], encode: Callable[[list[bytes]], list[list[int]]], make: Callable[[list[int]], object]):
        self.split, self.encode, self.make = split, encode, make
        self.most = KEPT_WORDS
        self.now: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}

    def learn(self, words: set[bytes]) -> None:
        """Take in words that this generation doesn't have."""
        if len(self.now) + len(words) > self.most:
            self.old, self.now = self.now, {}
        unknown = []
        for w in words:
            got = self.old.get(w)
            if got is None:
                unknown.append(w)
            else:
                self.now[w] = got
        self.now.update(self.made(unknown))

    def made(self, words: list[bytes]) -> Iterator[tuple[bytes, object]]:
        """(word, part) of every word."""
        split = self.split(words)
        pieces = [p for p in set(chain.from_iterable(split)) if type(p) is bytes]
        ids_of = dict(zip(pieces, self.encode(pieces), strict=True))
        for w, s in zip(words, split, strict=True):
            if len(s) == 1 and type(s[0]) is bytes:
                ids = ids_of[s[0]]
            else:
                ids = [i for p in s for i in (ids_of[p] if type(p) is bytes else (p,))]
            yield w, self.make(ids)

    def parts(self, words: list[bytes]) -> list:
        parts = list(map(self.now.get, words))
        missing = list(compress(range(len(parts)), map(is_, parts, repeat(None))))
        if missing:
            lacking = list(map(words.__getitem__, missing))
            self.learn({*lacking})
            for i, p in zip(missing, map(self.now.__getitem__, lacking), strict=True):
                parts[i] = p
        return parts

    def of(self, texts: list[bytes]) -> list[list]:
        """The parts of the words of every text."""
        with no_collector():
            split = [t.split() for t in texts]
            parts = self.parts(list(chain.from_iterable(split)))
            ends = list(accumulate(map(len, split)))
            return [list(filter(None, parts[a:b])) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@contextmanager
def no_collector() -> Iterator[None]:
    """Without passes of the cycle collector: the tables of words hold no cycles, and each pass would walk them all."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def library_encoder(path: str) -> Callable[[list[bytes]], list[list[int]]]:
    """The tokenizers library's own model, piece by piece."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path).model
    shown = re.compile(rb"[!-~]*")

    def ids(piece: bytes) -> list[int]:
        text = piece.decode() if shown.fullmatch(piece) else "".join(map(CHAR_OF.__getitem__, piece))
        return [t.id for t in model.tokenize(text)]

    return lambda pieces: list(map(ids, pieces))


class PackedTable(WordTable):
    """A WordTable of the tokenizers library's ids, packed as bytes: "H" (two an id) or "I" (four).

    Words of Latin letters are split, and their ids packed, all at once; pieces are kept in two generations as words are, as
    many new words have known pieces. Other words, and those that may hold a special token, go the way of any table.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        super().__init__(pieces_of(path), library_encoder(path), lambda ids: array(kind, ids).tobytes())
        self.most = KEPT_PACKED
        self.kind = np.dtype(kind)
        self.model = Tokenizer.from_file(path).model
        self.marks = marks_of(special_tokens(path))
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def plain(self, word: bytes) -> bool:
        text = word.decode()
        return not (_BEYOND.search(text) or _BEYOND.search(text.lower()) or any(m in word for m in self.marks))

    def learn_pieces(self, pieces: set[str]) -> None:
        """Take in pieces that this generation doesn't have."""
        if len(self.pieces) + len(pieces) > KEPT_PIECES:
            self.old_pieces, self.pieces = self.pieces, {}
        self.pieces["\n"] = b""
        unknown = []
        for p in pieces - {"\n"}:
            got = self.old_pieces.get(p)
            if got is None:
                unknown.append(p)
            else:
                self.pieces[p] = got
        shown = [p if p.isascii() and p.isprintable() else "".join(map(CHAR_OF.__getitem__, p.encode())) for p in unknown]
        tokens = list(map(self.model.tokenize, shown))
        data = np.array([t.id for ts in tokens for t in ts], self.kind).tobytes()
        ends = list(accumulate(len(ts) * self.kind.itemsize for ts in tokens))
        self.pieces.update(zip(unknown, [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=False)], strict=True))

    def made(self, words: list[bytes]) -> Iterator[tuple[bytes, object]]:
        if not words:
            return
        whole = b"\n".join(words)
        text = whole.decode()
        low = text.lower()
        if _BEYOND.search(text) or _BEYOND.search(low) or any(m in whole for m in self.marks):
            plain = list(map(self.plain, words))
            yield from super().made([w for w, p in zip(words, plain, strict=True) if not p])
            words = list(compress(words, plain))
            if not words:
                return
            low = b"\n".join(words).decode().lower()
        found = _LATIN_WORDS.findall(low)
        found.append("\n")
        new = {p for p in {*found} if p not in self.pieces}
        if new:
            self.learn_pieces({*found} if len(self.pieces) + len(new) > KEPT_PIECES else new)
        parts = list(map(self.pieces.__getitem__, found))
        data = b"".join(parts)
        sizes, last = accumulate(map(len, parts)), map(eq, found, repeat("\n"))
        ends = list(compress(sizes, last))
        yield from zip(words, [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True)

    def joined(self, texts: list[bytes]) -> list[bytes]:
        """The ids of every text, packed."""
        with no_collector():
            split = [t.split() for t in texts]
            parts = self.parts(list(chain.from_iterable(split)))
            ends = list(accumulate(map(len, split)))
            return [b"".join(parts[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=False)]
