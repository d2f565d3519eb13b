import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tessera.llm.sentencepiece_codec import BYTE, CONTROL, NORMAL, UNKNOWN, Codec, _cut, build, codec, decode, encode, encode_digest, read_model
from tessera.llm.pieces import tokenizer_path

from .conftest import ODD

PATH = tokenizer_path("piece_bpe_32k.model")
PARTS = ["a", "B", "word", "hello", "  ", " ", "\n", "\t", "▁", "é", "日本", "😀", "<s>", "<0x41>", "'s", "9", ".", "zz", "qu", "aaa", "....", "\x00", "　"]


def message(number, kind, value):
    key = bytes([*varint(number << 3 | kind)])
    return key + (varint(len(value)) + value if kind == 2 else value)


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def unigram(extra_spaces: bool) -> bytes:
    pieces = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), ("</s>", 0.0, CONTROL)] + [(f"<0x{i:02X}>", 0.0, BYTE) for i in range(256)]
    pieces += [(p, -2.0 - i / 7, NORMAL) for i, p in enumerate(["▁", "▁a", "a", "ab", "▁hell", "hello", "o", "h", "e", "l", "▁wor", "ld", "w", "or", "s", "é", "d", "b", "r", "▁▁"])]
    raw = b"".join(message(1, 2, message(1, 2, p.encode()) + message(2, 5, struct.pack("<f", s)) + message(3, 0, varint(k))) for p, s, k in pieces)
    return raw + message(2, 2, message(3, 0, varint(1)) + message(35, 0, varint(1))) + message(3, 2, message(1, 2, b"identity") + message(3, 0, varint(1)) + message(4, 0, varint(int(extra_spaces))) + message(5, 0, varint(1)))


def texts(n=1500):
    rng = random.Random(1)
    return ["", " ", "x"] + ["".join(rng.choices(PARTS, k=rng.randrange(25))) for _ in range(n)]


def test_parts_equal_whole_texts_and_the_library():
    own = codec(PATH)
    whole, rows = build(own.spec), texts()
    ids, at, same = own.encode(pa.array(rows))
    back = _cut(*own.decode(ids, at))
    assert same.all()
    for i, t in enumerate(rows):
        mine = ids[at[i] : at[i + 1]].tolist()
        assert mine == own.peer.encode(t) == whole.encode(t, add_special_tokens=False).ids, repr(t)
        assert back[i].decode("utf-8", "replace") == own.peer.decode(mine) == whole.decode(mine, skip_special_tokens=False)


@pytest.mark.parametrize("extra_spaces", [False, True])
def test_unigram_models(tmp_path, extra_spaces):
    path = tmp_path / "u.model"
    path.write_bytes(unigram(extra_spaces))
    own = Codec(str(path))
    assert own.spec.kind == 1 and own.spec.by_parts != extra_spaces
    rows = ["hello world", " a  b", "hellohello ab", "", "żółw", "worlds é  ", "<s>a</s>"]
    ids, at, same = own.encode(pa.array(rows))
    peer = sentencepiece.SentencePieceProcessor(model_file=str(path))
    for i, t in enumerate(rows):
        assert ids[at[i] : at[i + 1]].tolist() == peer.encode(t), t
    assert same.all()
    assert [x.decode() for x in _cut(*own.decode(ids, at))] == [peer.decode(peer.encode(t)) for t in rows]


def test_differences_are_told(monkeypatch):
    own = Codec(PATH)
    real = own.peer

    class Other:
        def encode(self, x, num_threads=1):
            found = real.encode(x, num_threads=1) if isinstance(x, list) else real.encode(x)
            return [y[:-1] if "odd" in t else y for t, y in zip(x, found)] if isinstance(x, list) else found

    own.peer = Other()
    ids, at, same = own.encode(pa.array(["even", "an odd one", "", "all even"]))
    assert same.tolist() == [True, False, True, True]
    assert ids[at[1] : at[2]].tolist() == real.encode("an odd one")


def test_spark_round_trip(docs):
    import zlib

    frame = docs(ODD, ids=[None, *range(1, len(ODD))], extra=("ids", "parity"))
    peer = codec(PATH).peer
    coded = encode(frame)
    rows = {r.doc_id: r for r in coded.collect()}
    assert len(rows) == len(ODD) and all(r.parity for r in rows.values())
    for i, t in enumerate(ODD):
        assert np.frombuffer(rows[i or None].ids, "<u4").tolist() == peer.encode(t or "")
        assert rows[i or None].round_trip
    assert {r.doc_id: r.text for r in decode(coded).collect()} == {i or None: t or "" for i, t in enumerate(ODD)}
    digest = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in encode_digest(frame).collect()}
    assert digest == {i: (len(r.ids) // 4, zlib.crc32(bytes(r.ids))) for i, r in rows.items()}
    assert encode_digest(docs([])).count() == 0


def test_wire_reader_matches_the_library():
    with open(PATH, "rb") as file:
        spec = read_model(file.read())
    peer = codec(PATH).peer
    assert len(spec.pieces) == peer.get_piece_size()
    assert all(p == peer.id_to_piece(i) and abs(s - peer.get_score(i)) < 1e-6 for i, (p, s, _) in enumerate(spec.pieces))


def test_unknown_pieces_decode_as_in_the_library(tmp_path):
    path = tmp_path / "u.model"
    path.write_bytes(unigram(False))
    own = Codec(str(path))
    peer = sentencepiece.SentencePieceProcessor(model_file=str(path))
    a = peer.piece_to_id("ab")
    for ids in ([0], [0, a], [a, 0, a], [1, 0], [0, 0]):
        assert _cut(*own.decode(np.array(ids), np.array([0, len(ids)])))[0].decode() == peer.decode(ids)
