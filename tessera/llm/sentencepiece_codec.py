"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read by its wire format.  From it come the normaliser (compiled map, extra spaces, the metaspace marker
and its prefix), the model (unigram with its scores, or BPE with merges in the order of their pieces' scores; both with byte
fallback) and the decoder.  Batches go to the library's threads.

No piece spans two neighbouring characters that no piece holds side by side, so a text's ids are those of the parts between
such neighbours; a worker keeps the ids of parts it has met.  Every new part is also encoded by the sentencepiece library: a
text has parity when all its parts have.  Models that change texts before (compiled maps, extra spaces) or hold pieces of
users or of line ends are encoded and compared text by text.

Defined cases: null text is empty and has no ids; lone marker characters decode to spaces, as the sentencepiece library does;
ids may be null or repeat, each row is a text of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held, ragged, slices, view
from tessera.llm.pieces import PieceEncoder, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Kinds of pieces and of models, and numbers of fields in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_APART = np.uint32(0xFFFFFFFF)  # stands among the ids of a part on which the libraries differ


def fields(raw: bytes):
    """(number, value) of a protobuf message: ints for varints, bytes for the rest."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            size = varint() if size is None else size
            value = raw[at : at + size]
            at += size
        yield key >> 3, value


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    extra_spaces_go: bool = True
    escape: bool = True
    unk_surface: str = " \u2047 "  # what an unknown piece decodes to

    @property
    def by_parts(self) -> bool:
        """Whether ids of a text are those of its parts."""
        return not self.charsmap and self.dummy_prefix and self.escape and not self.extra_spaces_go and not any(k == USER or (k == NORMAL and "\n" in p) for p, _, k in self.pieces)

    @property
    def apart(self) -> np.ndarray:
        """Whether no piece holds two bytes of ASCII side by side; the marker is a space."""
        table = np.zeros((256, 256), bool)
        table[:128, :128] = True
        for p, _, k in self.pieces:
            raw = np.frombuffer(p.replace(MARK, " ").encode(), np.uint8)
            if k == NORMAL and len(raw) > 1:
                table[raw[:-1], raw[1:]] = False
        return table


def read_model(raw: bytes) -> Spec:
    spec = Spec()
    for number, value in fields(raw):
        if number == 1:
            own = dict(fields(value))
            spec.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            own = dict(fields(value))
            spec.kind, spec.byte_fallback, spec.unk_id = own.get(3, UNIGRAM), bool(own.get(35, 0)), own.get(40, 0)
            spec.unk_surface = own[44].decode() if 44 in own else spec.unk_surface
        elif number == 3:
            own = dict(fields(value))
            spec.charsmap = own.get(2, b"")
            spec.dummy_prefix, spec.extra_spaces_go, spec.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
    return spec


def build(spec: Spec, prefix: bool | None = None):
    """A tokenizer of the tokenizers library; prefix overrides whether a marker is put before the text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    prefix = spec.dummy_prefix if prefix is None else prefix
    hidden = lambda p, k: f"\0{p}" if k in (CONTROL, UNUSED, UNKNOWN) else p  # noqa: E731  never found in a text
    if spec.kind == UNIGRAM:
        model = models.Unigram([(hidden(p, k), s) for p, s, k in spec.pieces], spec.unk_id, spec.byte_fallback)
    elif spec.kind == BPE:
        ids = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        whole = {p for p, _, k in spec.pieces if k in (NORMAL, USER)}
        ranked = sorted(((-s, i, p) for i, (p, s, k) in enumerate(spec.pieces) if k in (NORMAL, USER) and len(p) > 1))
        merges = [(p[:j], p[j:]) for _, _, p in ranked for j in range(1, len(p)) if p[:j] in whole and p[j:] in whole]
        model = models.BPE(ids, merges, unk_token=spec.pieces[spec.unk_id][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"models of kind {spec.kind} are neither unigram nor BPE")
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.extra_spaces_go:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    mark = MARK if spec.escape else " "
    steps += ([normalizers.Prepend(mark)] if prefix else []) + ([normalizers.Replace(" ", MARK)] if spec.escape else [])
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if prefix else [])])
    if users := [p for p, _, k in spec.pieces if k == USER]:
        tokenizer.add_tokens([AddedToken(p, normalized=True) for p in users])
    return tokenizer


class Codec:
    """Encoder and decoder of a model file in a worker."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as file:
            raw = file.read()
        self.spec = read_model(raw)
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.parts = PieceEncoder(self._encode_parts, apart=self.spec.apart) if self.spec.by_parts else None
        self.tokenizer = build(self.spec, False if self.parts else None)
        texts = [b"" if k == CONTROL else self.spec.unk_surface.encode() if k == UNKNOWN else bytes([int(p[3:-1], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in self.spec.pieces]
        self.size = np.array([len(t) for t in texts])
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.known = np.repeat(np.array([k != UNKNOWN for *_, k in self.spec.pieces]), self.size)  # the space of an unknown piece stays

    def _encode_parts(self, parts: list[str]) -> list[list[int]]:
        mine = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        lead = len(self.peer.encode("\n"))  # no piece holds a line end, so what follows one stands for itself
        theirs = [x[lead:] for x in self.peer.encode(["\n" + p for p in parts], num_threads=1)]
        return [x if x == y else [*x, int(_APART)] for x, y in zip(mine, theirs, strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts without nulls, offsets of texts in them, and whether each text has parity."""
        if self.parts:
            texts = pc.replace_substring(texts, MARK, " ")  # the same to the model
            spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
            ids, at = self.parts(spaced)
            apart = ids == _APART
            if not apart.any():
                return ids, at, np.ones(len(texts), bool)
            before = np.concatenate([[0], np.cumsum(apart)])[at]
            return ids[~apart], at - before, np.diff(before) == 0
        rows = texts.to_pylist()
        mine = [e.ids for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]
        same = np.array([x == y for x, y in zip(mine, self.peer.encode(rows, num_threads=1), strict=True)], bool)
        return np.array([i for x in mine for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in mine])]).astype(np.int64), same

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of texts from their ids, and offsets; the space of the prefix is taken off."""
        size = self.size[ids]
        at_bytes = ragged(self.first[ids], size)
        out = self.bytes[at_bytes]
        ends = np.concatenate([[0], np.cumsum(size)])[at]
        if self.spec.dummy_prefix:
            lead = ends[:-1][ends[1:] > ends[:-1]]
            lead = lead[(out[lead] == 32) & self.known[at_bytes[lead]]]
            keep = np.ones(len(out), bool)
            keep[lead] = False
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
            out = out[keep]
        return out, ends



def codec(path: str, threads: int = 2) -> Codec:
    """This worker process's codec; the library's threads are set before its first use."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    return held(("sentencepiece", path), lambda: Codec(path))


def _run(path: str, threads: int):
    def run(batches):
        own = codec(path, threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column("text")
            ids, at, same = own.encode(texts)
            out, ends = own.decode(ids, at)
            data, offsets = view(texts)
            trip = [a == b for a, b in zip(_cut(out, ends), _cut(data, offsets), strict=True)]
            raw = ids.astype("<u4").tobytes()
            pairs = zip((4 * at[:-1]).tolist(), (4 * at[1:]).tolist(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([raw[a:b] for a, b in pairs], pa.binary()), pa.array(trip, pa.bool_()), pa.array(same)],
                names=["doc_id", "ids", "round_trip", "parity"],
            )
            pa.default_memory_pool().release_unused()

    return run


def _cut(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", threads: int = 2) -> DataFrame:
    """(doc_id, ids, round_trip, parity): ids as little-endian unsigned 32-bit integers, whether they decode to the text, and
    whether the sentencepiece library has the same ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_run(model or tokenizer_path(MODEL), threads), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, round_trip boolean, parity boolean")


def _back(path: str, threads: int):
    def run(batches):
        own = codec(path, threads)
        for batch in slices(batches, "ids", 2 << 20):
            raw, at = view(batch.column("ids"))
            out, ends = own.decode(np.frombuffer(raw.tobytes(), "<u4"), at // 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.decode("utf-8", "replace") for x in _cut(out, ends)], pa.string())], names=["doc_id", "text"])

    return run


def decode(rows: DataFrame, model: str | None = None, threads: int = 2) -> DataFrame:
    """(doc_id, text) of rows(doc_id, ids)."""
    return rows.select("doc_id", "ids").mapInArrow(_back(model or tokenizer_path(MODEL), threads), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def _digest(batches):
    for batch in batches:
        ids = batch.column("ids").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), batch.column("round_trip"), batch.column("parity")], names=["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity"])


def encode_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip, parity), a row for each row of docs."""
    rows = encode(docs)
    return rows.mapInArrow(_digest, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean")
