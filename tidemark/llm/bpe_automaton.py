"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens; it accepts exactly the token sequences that the merge list produces. It is
compiled by one gadget for each merge (u, v) -> w, in the order of the list. Before any merge there is one
state, with an arc back for each base symbol. The gadget

* gives the target of the u-arcs a state of its own and takes the v-arc from it: u then v never stays;
* adds a w-arc beside every u-arc whose target had a v-arc, to a copy of the target of that v-arc.

Every state is "the last token was t". A copied state shares all arcs of its original up to the time of the
copy, so states are stored as (original, time) and the arcs taken since; arcs beside u-arcs are stored as
(u, time). All of this is compiled to flat arrays, and a transition that has been resolved is kept in a table.

A string has exactly one accepted path, and every start of a path is one too. So a word is encoded in one run
forward: a label table of one transition a byte names the labels that end at a place, longest first, and the
one with an arc from the state at its own start is the state here. Nothing is ever taken back. Many
words run side by side. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.runtime import held, smaller_batches
from tidemark.llm.textops import text_bytes
from tidemark.llm.wordpieces import BYTE_OF, WordTable, pieces_of, vocabulary_path

LAST = 1 << 30
END = 256  # the symbol after the last byte of a word
TABLE_MOST = 1 << 22
SIDE_BY_SIDE, LONG = 8192, 64


class IntTable:
    """Values of 64-bit keys in flat arrays, with open addressing; -1 for a key that is not there."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._first(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not there. A full table of TABLE_MOST places starts anew."""
        while 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys >= 0
            k, v = self.keys[old], self.values[old]
            fresh = len(self.keys) >= TABLE_MOST and self.n > 0
            self.__init__(self.bits if fresh else self.bits + 2)
            if not fresh:
                self.put(k, v)
        at = self._first(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        at = self._first(keys)
        left = np.flatnonzero(self.keys[at] != keys)
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            left = left[self.keys[at[left]] != keys[left]]
        self.values[at] = values
        self.n += len(keys)


class TokenAutomaton:
    """The compiled automaton of a vocabulary (token -> id) and its merges; tokens are spelt in bytes."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>"):
        size = max(vocab.values()) + 1
        self.up = np.full(size, -1, np.int32)  # state -> its original
        self.up_time = np.full(size, LAST, np.int32)
        self.beside = np.full(size, -1, np.int32)  # arc w -> arc u
        self.beside_time = np.full(size, LAST, np.int32)  # just before which the u-arc counts
        self._compile([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        spelt = []
        for token, i in vocab.items():
            final = token.endswith(end) and len(token) > len(end)
            chars = token[: -len(end)] if final else token
            if (self.beside[i] >= 0 or len(chars) == 1) and all(c in BYTE_OF for c in chars):
                spelt.append((tuple(BYTE_OF[c] for c in chars) + (END,) * final, i))
        self._label_table(spelt, size)
        self.arcs = IntTable()

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        taken: dict[int, dict[int, int]] = {}  # state -> arc -> time at which it went
        copy: dict[int, tuple[int, int]] = {}
        beside: dict[int, tuple[int, int]] = {}

        def has(state: int, arc: int, time: int) -> bool:
            """Whether the state has the arc just before `time`."""
            while True:
                p, t = state, time
                while True:
                    if taken.get(p, {}).get(arc, LAST) < t:
                        return False
                    if p not in copy:
                        break
                    p, since = copy[p]
                    t = min(t, since)
                if arc not in beside:
                    return True
                arc, time = beside[arc]

        for time, (u, v, w) in enumerate(merges):
            alive = has(u, v, time)
            taken.setdefault(u, {}).setdefault(v, time)
            if alive and w not in beside:
                beside[w] = (u, time + (u == v))
                copy[w] = (v, time)
        for w, (u, time) in beside.items():
            self.beside[w], self.beside_time[w] = u, time
            self.up[w], self.up_time[w] = copy[w]
        gone = [(s << 20 | a, t) for s, arcs in taken.items() for a, t in arcs.items()]
        self.taken = IntTable()
        if gone:
            self.taken.put(np.array([k for k, _ in gone], np.int64), np.array([t for _, t in gone], np.int32))

    def _label_table(self, spelt: list[tuple[tuple[int, ...], int]], size: int) -> None:
        """One transition a symbol; of every node, the longest label that ends there, and of it the next shorter."""
        child: list[dict[int, int]] = [{}]
        depth, parent, symbol = [0], [0], [0]
        node_of = {}
        for label, token in spelt:
            at = 0
            for s in label:
                if s not in child[at]:
                    child[at][s] = len(child)
                    depth.append(depth[at] + 1)
                    parent.append(at)
                    symbol.append(s)
                    child.append({})
                at = child[at][s]
            node_of[at] = token
        d, up, sym = np.array(depth), np.array(parent), np.array(symbol)
        own = np.full(len(child), -1, np.int32)
        own[list(node_of)] = list(node_of.values())
        self.go = np.zeros((len(child), 257), np.int32)
        self.ends = np.full(len(child), -1, np.int32)
        self.shorter, self.length = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        back = np.zeros(len(child), np.int64)
        below = np.flatnonzero(d == 1)
        self.go[0, sym[below]] = below
        self.ends[below] = own[below]
        for level in range(1, d.max() + 1):
            here = np.flatnonzero(d == level)
            if level > 1:
                back[here] = self.go[back[up[here]], sym[here]]
                self.ends[here] = np.where(own[here] >= 0, own[here], self.ends[back[here]])
            self.go[here] = self.go[back[here]]
            below = np.flatnonzero(d == level + 1)
            # a node's own children stand over those of the node it falls back to; that node is less deep
            self.go[up[below], sym[below]] = below
        at = np.flatnonzero(own >= 0)
        self.shorter[own[at]] = np.where(back[at] > 0, self.ends[back[at]], -1)
        self.length[own[at]] = d[at] - (sym[at] == END)

    def has_arcs(self, state: np.ndarray, arc: np.ndarray) -> np.ndarray:
        """Whether each state has the arc; the first state, -1, has them all."""
        ok = state < 0
        on = np.flatnonzero(~ok)
        key = state[on].astype(np.int64) << 20 | arc[on]
        got = self.arcs.get(key)
        new = np.unique(key[got < 0])
        if len(new):
            value = self._resolve((new >> 20).astype(np.int32), (new & 0xFFFFF).astype(np.int32))
            self.arcs.put(new, value.astype(np.int32))
            miss = np.flatnonzero(got < 0)
            got[miss] = value[np.searchsorted(new, key[miss])]
        ok[on] = got == 1
        return ok

    def _resolve(self, state: np.ndarray, arc: np.ndarray) -> np.ndarray:
        """Arcs after the last gadget, from the gadgets: down the arcs beside which an arc stands, and up the copies."""
        ok = np.zeros(len(state), bool)
        live, a, time = np.arange(len(state)), arc, np.full(len(state), LAST, np.int32)
        while len(live):
            p, t, dead, on = state[live], time.copy(), np.zeros(len(live), bool), np.arange(len(live))
            while len(on):
                gone = self.taken.get(p[on].astype(np.int64) << 20 | a[on])
                went = (gone >= 0) & (gone < t[on])
                dead[on[went]] = True
                t[on] = np.minimum(t[on], self.up_time[p[on]])
                p[on] = self.up[p[on]]
                on = on[~went & (p[on] >= 0)]
            live, a = live[~dead], a[~dead]
            u = self.beside[a]
            ok[live[u < 0]] = True
            live, time, a = live[u >= 0], self.beside_time[a[u >= 0]], u[u >= 0]
        return ok

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of every word, with its end."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted((i for i in range(len(words)) if 0 < len(words[i]) <= LONG), key=lambda i: -len(words[i]))
        for a in range(0, len(order), SIDE_BY_SIDE):
            part = order[a : a + SIDE_BY_SIDE]
            for i, ids in zip(part, self._run([words[i] for i in part]), strict=True):
                out[i] = ids
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._run_long(w)
        return out

    def _run(self, words: list[bytes]) -> list[list[int]]:
        """Words in order of length, longest first, one place of all of them at a time."""
        n, width = np.array([len(w) for w in words]), len(words[0])
        data = np.ascontiguousarray(np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width).T)
        state = np.full((width + 1, len(words)), -1, np.int32)
        node = np.zeros(len(words), np.int32)
        on = np.searchsorted(-n, -np.arange(width + 2), "right")  # words of so many bytes at least
        for k in range(1, width + 1):
            a, longer = on[k], on[k + 1]
            node[:a] = self.go[node[:a], data[k - 1, :a]]
            at = node[:a].copy()
            at[longer:] = self.go[at[longer:], END]
            row, arc = np.arange(a), self.ends[at]
            while len(row):
                ok = self.has_arcs(state[k - self.length[arc], row], arc)
                state[k, row[ok]] = arc[ok]
                row, arc = row[~ok], self.shorter[arc[~ok]]
        at, steps, row = n.copy(), [], np.arange(len(words))
        while at.any():
            token = np.where(at > 0, state[at, row], -1)
            steps.append(token)
            at -= np.where(token >= 0, self.length[token], 0)
        path = np.stack(steps[::-1], 1)
        there = path >= 0
        flat, ends = path[there].tolist(), np.cumsum(there.sum(1)).tolist()
        return [flat[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]

    def _run_long(self, word: bytes) -> list[int]:
        """One word, in memory of its length; as _run, place by place."""
        go, ends, shorter, length = self.go, self.ends, self.shorter, self.length
        state, node, known = [-1], 0, {}
        for k, symbol in enumerate(word, 1):
            node = go[node, symbol]
            arc = int(ends[go[node, END]] if k == len(word) else ends[node])
            while True:
                before = state[k - int(length[arc])]
                ok = known.get((before, arc))
                if ok is None:
                    ok = known[before, arc] = bool(self.has_arcs(np.array([before], np.int32), np.array([arc], np.int32))[0])
                if ok:
                    break
                arc = int(shorter[arc])
            state.append(arc)
        k, out = len(word), []
        while k:
            out.append(state[k])
            k -= int(length[state[k]])
        return out[::-1]


def load(path: str) -> tuple[TokenAutomaton, list[bytes]]:
    """The automaton of a vocabulary file, and the label of every id."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model = data["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    labels = {i: t for t, i in model["vocab"].items()} | {x["id"]: x["content"] for x in data["added_tokens"]}
    return TokenAutomaton(model["vocab"], merges, model["end_of_word_suffix"]), [labels.get(i, "").encode() for i in range(max(labels) + 1)]


def _table(path: str, digests: bool) -> WordTable:
    automaton, labels = load(path)
    numbers = [str(i).encode() for i in range(len(labels))]
    if digests:
        make = lambda ids: (b" ".join([numbers[i] for i in ids]), b" ".join([labels[i] for i in ids])) if ids else ()
    else:
        make = lambda ids: array("i", ids).tobytes()
    return WordTable(pieces_of(path), automaton.encode, make)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row. An empty text, or null, has no ids; ids of rows may repeat or be null.

    Texts of any length are encoded whole. Other columns are not read, whatever their names.
    """
    path = vocabulary_path(path)
    smaller_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held((path, "automaton ids"), lambda: _table(path, False))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                b = batch.slice(a, 500)
                raw, at = text_bytes(b.column(1))
                data = raw.tobytes()
                found = [b"".join(parts) for parts in table.of([data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)])]
                ends = np.cumsum([0, *(len(x) // 4 for x in found)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>")


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decoded: bool = False, ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, decoded][, ids]) of every row, encoded and decoded by the automaton.

    An empty text, or null, has no tokens, and digests of nothing; ids of rows may repeat or be null. Texts of any
    length are encoded whole. Other columns are not read, whatever their names.
    """
    path = vocabulary_path(path)
    smaller_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held((path, "automaton"), lambda: _table(path, True))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                b = batch.slice(a, 500)
                raw, at = text_bytes(b.column(1))
                data = raw.tobytes()
                numbers, texts = [], []
                for parts in table.of([data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]):
                    for each, column in zip((numbers, texts), zip(*parts, strict=True) if parts else ((), ()), strict=True):
                        each.append(b" ".join(column))
                n = [x.count(b" ") + 1 if x else 0 for x in numbers]
                out = [b.column(0), pa.array(n, pa.int64())] + [pa.array([hashlib.sha256(x).hexdigest() for x in each], pa.string()) for each in (numbers, texts)]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if decoded:
                    out.append(pa.array(texts, pa.binary()).cast(pa.string()))
                    names.append("decoded")
                if ids:
                    flat = np.fromstring(b" ".join([x for x in numbers if x]).decode(), np.int32, sep=" ")
                    out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * decoded + ", ids array<int>" * ids)


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_digests(docs).withColumnRenamed("id", "doc_id")
