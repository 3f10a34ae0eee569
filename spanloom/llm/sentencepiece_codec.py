"""SentencePiece encoding with source offsets, and decoding.

A text is normalised by repeatedly taking the longest prefix that the model's compiled character map knows (a double-array
trie over UTF-8 bytes) and noting for every normalised byte where it came from. Pieces partition the normalised text, so
each piece projects to a span of original bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from .common import text_rows

MARK = "▁"
MARK_BYTES = MARK.encode()
PART = 200_000  # characters encoded in one call of the library


class CharacterMap:
    """The compiled character map: a 32-bit size, a double-array trie of that size, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """The replacement of the longest known prefix of data[at:] and its length; an unknown character stands for itself."""
        best, length = -1, 0
        if self.units:
            unit = self.units[0]
            node = (unit >> 10) << ((unit & 0x200) >> 6)
            for i in range(at, len(data)):
                node ^= data[i]
                if node >= len(self.units) or (unit := self.units[node]) & 0x800000FF != data[i]:
                    break
                node ^= (unit >> 10) << ((unit & 0x200) >> 6)
                if unit & 0x100:
                    best, length = self.units[node] & 0x7FFFFFFF, i + 1 - at
        if length:
            return self.texts[best : self.texts.index(b"\0", best)], length
        lead = data[at]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + width], width


class Codec:
    """Encoder and decoder of one model.

    The library segments and names the pieces; where they come from is worked out here: the character map's longest prefixes
    give the normalised bytes and their alignment with the source, and the pieces, which partition the normalised bytes,
    are projected through it.
    """

    def __init__(self, model: bytes):
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.map, self.squeeze, self.dummy = CharacterMap(spec.precompiled_charsmap), spec.remove_extra_whitespaces, spec.add_dummy_prefix
        byte = {i for i, p in enumerate(proto.pieces) if p.type == p.BYTE}
        self.width = np.array([1 if i in byte else len(p.piece.encode()) for i, p in enumerate(proto.pieces)])
        self.decimal = [str(i) for i in range(len(proto.pieces))]
        self.end = self.lib.eos_id()

    def normalised(self, text: str) -> tuple[bytes, list[int]]:
        """The normalised bytes, and for each of them the source byte it starts at."""
        data, at, out, source = text.encode("utf-8", "replace"), 0, bytearray(), []
        spaces = self.squeeze
        if self.dummy and data.strip(b" " if self.squeeze else b""):
            out += MARK_BYTES
            source += [0] * 3
        while at < len(data):
            new, taken = self.map.longest(data, at)
            for char in new.decode("utf-8", "replace"):
                space = char == " "
                if not (space and spaces):
                    more = MARK_BYTES if space else char.encode()
                    out += more
                    source += [at] * len(more) if len(more) != taken or space else range(at, at + taken)
                spaces = space and self.squeeze
            at += taken
        while self.squeeze and out.endswith(MARK_BYTES):
            del out[-3:], source[-3:]
        return bytes(out), source

    def alignment(self, texts: list[str], parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of texts laid end to end: the source byte of every normalised byte, counted in its own text, and each text's normalised size.

        With an empty character map every character is its own longest prefix: only spaces widen, to the mark.
        """
        if self.map.units or self.squeeze:
            sources = [self.normalised(t)[1] for t in texts]
            sizes = np.fromiter(map(len, sources), np.int64, len(texts))
            return np.fromiter(chain.from_iterable(sources), np.int64, sizes.sum()), sizes
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begin, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(parts), np.uint8)
        width = np.where(data == 0x20, len(MARK_BYTES), 1)
        if self.dummy:
            width[begin[sizes > 0]] += len(MARK_BYTES)  # the mark before a text lies at its first byte
        before = np.concatenate(([0], np.cumsum(width)))
        return np.repeat(np.arange(len(data)) - np.repeat(begin, sizes), width), before[begin + sizes] - before[begin]

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray]]:
        """For each text, its ids with the end id, and the source byte where each piece but the end id stops."""
        lo = held = 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= PART or i == len(texts) - 1:
                yield from self.encode_part([t or "" for t in texts[lo : i + 1]])
                lo, held = i + 1, 0

    def encode_part(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        parts, ids = [t.encode("utf-8", "replace") for t in texts], self.lib.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        width = self.width[np.fromiter(chain.from_iterable(ids), np.int64, counts.sum())]
        source, norm = self.alignment(texts, parts)
        last = np.cumsum(counts)
        before = np.concatenate(([0], np.cumsum(width)))
        for i in np.flatnonzero(before[last] - before[last - counts] != norm).tolist():  # an unknown piece: ask the library how long it is
            width[last[i] - counts[i] : last[i]] = [len(p.piece.encode()) for p in self.lib.encode(texts[i], out_type="immutable_proto").pieces]
        stops = np.concatenate((source, [0]))[np.minimum(np.cumsum(width), len(source))]
        some = counts > 0
        stops[last[some] - 1] = np.fromiter(map(len, parts), np.int64, len(parts))[some]
        for own, a, b in zip(ids, (last - counts).tolist(), last.tolist(), strict=True):
            own.append(self.end)
            yield own, stops[a:b]

    def encode(self, text: str | None) -> tuple[list[int], str, np.ndarray]:
        """ids with the end id, the same joined by spaces, and the stops of encode_all()."""
        ((ids, stops),) = self.encode_all([text])
        return ids, self.joined(ids), stops

    def joined(self, ids: list[int]) -> str:
        return " ".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids array<int> (the end id last), starts and stops array<int> (source bytes of each
    piece but the end id). Null and empty texts have the end id only; repeated rows stay; other columns are ignored.
    The model (under a megabyte) is read on the driver and sent with the function."""
    model = read_model(model_path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(model)
        for f in frames:
            for part in range(0, len(f), 500):
                p = f.iloc[part : part + 500]
                rows = list(codec.encode_all(p["text"].tolist()))
                stops = [r[1].astype("int32") for r in rows]
                yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64").array, "ids": [np.array(r[0], "int32") for r in rows], "starts": [np.concatenate(([0], s[:-1])).astype("int32") if len(s) else s for s in stops], "stops": stops})

    return text_rows(df, id_col, text_col).mapInPandas(run, "doc_id long, ids array<int>, starts array<int>, stops array<int>")


def decode_documents(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids -> doc_id, text; null ids give an empty text."""
    model = read_model(model_path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(model)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "text": [codec.decode([int(i) for i in x]) if x is not None else "" for x in f["ids"]]})

    return df.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass and keep digests: doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes (where the
    last piece stops: all source bytes), spans_sha256 (of the stops as little-endian 64-bit integers)."""
    model = read_model(model_path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(model)
        for f in frames:
            rows = []
            for ids, stops in codec.encode_all(f["text"].tolist()):
                rows.append((len(ids), sha(codec.joined(ids).encode()), sha(codec.decode(ids).encode()), int(stops[-1]) if len(stops) else 0, sha(stops.tobytes())))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", "spans_sha256"])
            out.insert(0, "doc_id", f["doc_id"].astype("Int64").array)
            yield out

    return text_rows(df, id_col, text_col).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long, spans_sha256 string")
