"""Encoding by backtracking against the sentencepiece library: hard and random texts, odd rows, a whole table."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import sentence_pieces as S

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pieces():
    return S.Pieces(S.model_path())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=S.model_path())


def same(pieces, library, text):
    want = library.encode(text, add_bos=True, add_eos=True)
    packed = pieces.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == want, text
    assert pieces.decode(packed) == library.decode(want), text


HARD = ["", " ", "  ", " a", "a ", "a  b", "\n", "\t x\r\n", "▁", "▁a▁ b", "<s>", "</s><unk><0x0A>", "\0", "x\0y", " " * 100 + "a", "a" + " " * 50, "é" * 40, "梦想" * 30, "😀👍🏽 z̡̢", "a" * 77, "abab" * 20, "1234567890", "http://www.example.com/?q=1&b=2", "….”«†»,"]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(pieces, library, text):
    same(pieces, library, text)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(pieces, library, seed):
    rng = random.Random(seed)
    any_char = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x10000, 0x1F900)]))
    for _ in range(300):
        same(pieces, library, "".join(rng.choice("ab ▁é\n梦😀the") for _ in range(rng.randrange(60))))
        same(pieces, library, "".join(rng.choice(["the", "ing", " ", "  ", "er", "▁", ".", "...", "--", "/**", "    "]) for _ in range(rng.randrange(40))))
        same(pieces, library, "".join(any_char() for _ in range(rng.randrange(60))))
        same(pieces, library, "".join(library.id_to_piece(rng.randrange(3, 32000)) for _ in range(rng.randrange(20))))


def test_compatibility_is_merging_again(pieces):
    rng = random.Random(3)
    for _ in range(4000):
        a, b = rng.randrange(len(pieces.text)), rng.randrange(len(pieces.text))
        assert pieces.compatible(a, b) == (pieces.merged(pieces.text[a] + pieces.text[b])[0] == [pieces.text[a], pieces.text[b]])


def test_any_ids_are_decoded_as_the_library_does(pieces, library):
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.randrange(0, 32000) if rng.random() < 0.6 else rng.randrange(0, 259) for _ in range(rng.randrange(12))]
        assert pieces.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_bounded_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(S, "KEPT_PAIRS", 50)
    small = S.Pieces(S.model_path())
    small.known_parts.most = small.known_words.most = 20
    rng = random.Random(5)
    for _ in range(200):
        same(small, library, " ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 9))) for _ in range(30)))


def test_odd_rows(spark, library):
    long = "word and space  " * 40_000
    rows = [(1, None, 7), (2, "", 7), (None, "a b", 7), (3, "a b", 7), (3, "a b", 7), (4, long, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r.id or 0, r.n_tokens, bytes(r.ids), r.decoded) for r in S.encode_pieces(df).collect())
    packed = lambda t: np.array(library.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes()
    assert got == sorted((i or 0, len(packed(t)) // 4, packed(t), t or "") for i, t, _ in rows)
    assert S.encode_pieces(df.limit(0)).count() == 0
    arrays = S.encode_pieces(df.where("doc_id = 3")).select(S.id_array().alias("a")).collect()
    assert [r.a for r in arrays] == [library.encode("a b", add_bos=True, add_eos=True)] * 2
    back = S.decode_pieces(spark.createDataFrame([(1, packed("x  y")), (2, None)], "id long, ids binary")).collect()
    assert [tuple(r) for r in back] == [(1, "x  y"), (2, None)]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(S.model_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.add_dummy_prefix = False
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        S.Pieces(str(tmp_path / "m.model"))


def test_whole_table(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {i: library.encode(t, add_bos=True, add_eos=True) for i, t in docs.items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {i: (len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x).encode())) for i, x in ids.items()}
    assert {r.doc_id: tuple(r)[1:] for r in S.op12_query(spark, SF).collect()} == want
