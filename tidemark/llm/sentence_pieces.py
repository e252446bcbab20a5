"""SentencePiece encoding and decoding of merge-type models, by backtracking.

The model merges, again and again, the adjacent symbols whose joined text is the piece of the highest score (the
leftmost of equals), from single characters on. A sequence of pieces is the result if and only if each piece is its own
result, and each two adjacent ones are the result of their joined text. So a text is encoded from left to right:

1. An Aho-Corasick automaton of the reversed pieces, run once over the reversed text, gives the longest piece that
   starts at every position.
2. The longest piece is taken if it is compatible with the piece before it: merging their joined text again gives just
   the two, as replaying the recorded steps of both tells. If not, its longest proper prefix that is a piece is tried, and so on; a bitfield holds the positions from
   which nothing led on, so that none is tried twice. Where no piece is left, the last one taken is put back.

No piece has a space after another character, or a common sign or digit next to any other, so a text is a sequence of parts that no
merge reaches across; the results of parts and words are kept, in bounded number. Characters without a piece become the pieces of their UTF-8 bytes.
Decoding joins the bytes of the pieces.
"""

from __future__ import annotations

import codecs
import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import held, smaller_batches
from tidemark.llm.textops import slices, text_bytes
from tidemark.llm.wordpieces import KEPT_WORDS, no_collector

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
KEPT_PAIRS = 500_000
LONGEST_KEPT = 64  # characters of a word whose result is kept
_WORDS = re.compile(" +[^ ]*")
_SIGNS = "\\x00-@\\[-`{-\\xa9\\xab-\\xb4\\xb6-\\xb9\\xbb-\\xbf\\u2000-\\u206f"  # signs and digits of ASCII, Latin-1 and general punctuation
_PARTS = re.compile(f"{SPACE}*[^{SPACE}{_SIGNS}]+|{SPACE}*[{_SIGNS}]+|{SPACE}+")


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _byte_by_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("tidemark-bytes", _byte_by_byte)


class Kept:
    """What is known of up to twice `most` texts: when a generation is full, only those met since the last turn stay."""

    def __init__(self, make: Callable[[str], bytes], most: int = KEPT_WORDS):
        self.make, self.most = make, most
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, text: str) -> bytes:
        known = self.now.get(text)
        if known is None:
            known = self.old.get(text)
            if known is None:
                known = self.make(text)
            if len(text) <= LONGEST_KEPT:
                if len(self.now) >= self.most:
                    self.old, self.now = self.now, {}
                self.now[text] = known
        return known


class Pieces:
    """A model's pieces: encode() and decode() as the library does them, with begin and end ids.

    Pieces that are their own result have a number, and so get, when first met, characters without a piece. By number:
    text, length, packed ids, the longest proper prefix that is a piece (-1: none) and the steps that merge its
    characters: (score, last symbol, first symbol) after each.
    """

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = proto.ModelProto.SentencePiece
        rules, trainer = model.normalizer_spec, model.trainer_spec
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        if trainer.model_type != proto.TrainerSpec.BPE or not plain or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or {p.type for p in model.pieces} - {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE}:
            raise ValueError(f"{path}: only merge-type models with byte fallback, a space put first and no other normalisation are encoded")
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        bodies = [p.piece.lstrip(SPACE) for _, p in normal]
        if any(SPACE in x for x in bodies):
            raise ValueError(f"{path}: a piece has a space after another character")
        #: parts of a word that no piece reaches across
        self.parts = _PARTS if all(len(_PARTS.findall(x)) <= 1 for x in bodies) else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.ends = [trainer.bos_id.to_bytes(4, "little"), trainer.eos_id.to_bytes(4, "little")]
        self.id_of, self.score = {p.piece: i for i, p in normal}, {p.piece: p.score for _, p in normal}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        of_byte = {i: bytes([b]) for b, i in self.byte_ids.items()}
        shown = lambda i, p: of_byte.get(i, p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else trainer.unk_surface.encode() if p.type == kinds.UNKNOWN else b"")
        self.text_of = [shown(i, p) for i, p in enumerate(model.pieces)]
        self.opens = {i for i, p in normal if p.piece.startswith(SPACE)}

        self.number: dict[str, int] = {}
        self.text, self.length, self.packed, self.prefix, self.steps, self.fits, self.n_fits = [], [], [], [], [], [], 0
        self.reversed = ahocorasick.Automaton()
        for x in self.id_of:
            symbols, steps = self.merged(x)
            if len(symbols) == 1:
                self.reversed.add_word(x[::-1], self.add(x, steps))
        self.reversed.make_automaton()
        for i, x in enumerate(list(self.text)):
            if len(x) > 1:
                self.prefix[i] = next((self.number[x[:k]] for k in range(len(x) - 1, 0, -1) if x[:k] in self.number), -1)
                if self.prefix[i] < 0:
                    self.prefix[i] = self.add(x[0], [])
        self.known_parts = Kept(lambda x: b"".join([self.packed[i] for i in self.split(x)]))
        self.known_words = Kept(lambda w: b"".join(map(self.known_parts.of, self.parts.findall(SPACE + w.replace(" ", SPACE)))))

    def add(self, text: str, steps: list) -> int:
        i = self.number.get(text)
        if i is None:
            i = self.number[text] = len(self.text)
            ids = [self.id_of[text]] if text in self.id_of else [self.byte_ids[b] for b in text.encode()]
            self.text.append(text)
            self.length.append(len(text))
            self.packed.append(np.array(ids, "<u4").tobytes())
            self.prefix.append(-1)
            self.steps.append([*steps, (-math.inf, "", "")])
            self.fits.append({})  # whether another one is compatible after it
        return i

    def merged(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The result of a short text by merging, and the score, the last and the first symbol after each step."""
        symbols, score, steps = list(text), self.score, []
        while True:
            found = [(s, -i) for i in range(len(symbols) - 1) if (s := score.get(symbols[i] + symbols[i + 1])) is not None]
            if not found:
                return symbols, steps
            best, i = max(found)
            symbols[-i : 2 - i] = [symbols[-i] + symbols[1 - i]]
            steps.append((best, symbols[-1], symbols[0]))

    def compatible(self, a: int, b: int) -> bool:
        """Merging the joined text of two pieces again never joins the symbols at their border.

        Until that happens each piece goes through its own steps. The best score comes first, the leftmost of equals:
        a step of a goes before the border, the border before a step of b.
        """
        left, right, score = iter(self.steps[a]), iter(self.steps[b]), self.score
        last, first = self.text[a][-1], self.text[b][0]
        (s_a, next_last, _), (s_b, _, next_first) = next(left), next(right)
        ok = None
        while ok is None:
            border = score.get(last + first)
            if border is not None and border > s_a and border >= s_b:
                ok = False
            elif s_a == s_b == -math.inf:
                ok = True
            elif s_a >= s_b:
                last = next_last
                s_a, next_last, _ = next(left)
            else:
                first = next_first
                s_b, _, next_first = next(right)
        self.n_fits += 1
        if self.n_fits > KEPT_PAIRS:
            self.n_fits = 1
            for known in self.fits:
                known.clear()
        self.fits[a][b] = ok
        return ok

    def split(self, text: str) -> list[int]:
        """The numbers of the pieces of a text in which spaces are written as the model writes them."""
        n, fits, length, prefix = len(text), self.fits, self.length, self.prefix
        longest = dict(list(self.reversed.iter(text[::-1]))[::-1])  # by the end in the reversed text, where the longest comes first
        open_ = bytearray(b"\x01") * (n + 1)
        taken: list[int] = []
        at, before, new = 0, -1, True
        while at < n:
            if new:
                piece = longest.get(n - 1 - at, -1)
                if piece < 0:
                    piece = self.add(text[at], [])
            while piece >= 0:
                if open_[at + length[piece]]:
                    if before < 0:
                        break
                    ok = fits[before].get(piece)
                    if ok or ok is None and self.compatible(before, piece):
                        break
                piece = prefix[piece]
            new = piece >= 0
            if new:
                taken.append(piece)
                at += length[piece]
                before = piece
            else:
                open_[at] = 0
                piece = taken.pop()
                at -= length[piece]
                before = taken[-1] if taken else -1
        return taken

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers, with the begin and the end id."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        words = [] if not text else text.split(" ") if "  " not in text and text[0] != " " else [w[1:] for w in _WORDS.findall(" " + text)]
        known = list(map(self.known_words.now.get, words))
        for i in [i for i, x in enumerate(known) if x is None] if None in known else ():
            known[i] = self.known_words.of(words[i])
        return b"".join((self.ends[0], *known, self.ends[1]))

    def decode(self, packed: bytes) -> str:
        """The text of ids; of the first piece a space is left out, as encode() put one there."""
        ids = np.frombuffer(packed, "<u4").tolist()
        out = b"".join(map(self.text_of.__getitem__, ids))
        first = next((i for i in ids if self.text_of[i]), None)
        return (out[1:] if first in self.opens else out).decode(errors="tidemark-bytes")


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids, decoded) of every row of docs, in any order.

    ids: the text's token ids with begin and end ids, as little-endian unsigned 32-bit integers, which `id_array`
    turns to an array. decoded: the text of the ids. A null text is encoded as an empty one: its begin and end ids.
    Texts of any length are encoded whole. Rows that repeat, or share an id, are returned as often as they occur; a null
    id stays null. Other columns are not read. An empty table gives an empty one. `path` is a merge-type model with
    byte fallback that puts a space first and changes nothing else; any other raises ValueError.
    """
    smaller_batches(docs.sparkSession)
    model = model_path(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held(("sentence pieces", model), lambda: Pieces(model))
        for batch in batches:
            _, at = text_bytes(batch.column(1))
            for a, b in slices(at):
                part = batch.slice(a, b - a)
                with no_collector():
                    packed = [pieces.encode(t or "") for t in part.column(1).to_pylist()]
                    decoded = [pieces.decode(p) for p in packed]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary, decoded string")


def decode_pieces(rows: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, decoded) of rows of packed ids; null ids give a null text."""
    model = model_path(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held(("sentence pieces", model), lambda: Pieces(model))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if p is None else pieces.decode(p) for p in batch.column(1).to_pylist()], pa.string())], names=["id", "decoded"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"id {rows.schema[id_col].dataType.simpleString()}, decoded string")


def id_array(packed: str = "ids"):
    """Packed ids as an array of int."""
    of = lambda i: F.conv(F.concat(*[F.hex(F.substring(packed, i * 4 + b, 1)) for b in (4, 3, 2, 1)]), 16, 10).cast("int")
    return F.transform(F.when(F.octet_length(packed) > 0, F.sequence(F.lit(0), (F.octet_length(packed) / 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>")), of)


def op12_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_pieces(docs)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
