"""Embedding near-dedup, tokenizer codec and quality classifier against brute force, the library and held-out labels."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import sentencepiece_model_pb2

from spanloom.llm import near_embeddings, quality, sentencepiece_codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    rows = [[float(x) for x in v] for v in base] + [[float(x) for x in base[i % 7] + rng.normal(scale=0.06, size=16)] for i in range(150)] + [[float(x) for x in base[9]]] * 30
    table = [(i, v, 1) for i, v in enumerate(rows)] + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None] * 8, 1), (1004, [], 1), (1005, [1.0, 2.0], 1), (1006, [float("inf")] * 16, 1)]
    got = {r.vec_id: r for r in near_embeddings.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<float>, shard int")).collect()}
    x = near_embeddings.unit(np.array(rows, np.float32))
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(comp, np.where(linked, comp[None, :], len(x)).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    assert len(got) == len(table)
    true = linked.sum(axis=1)
    ours = np.array([got[i].n_links for i in range(len(x))])
    assert (ours <= true).all() and ours.sum() >= 0.98 * true.sum()
    assert np.mean([got[i].component_id == comp[i] for i in range(len(x))]) > 0.97
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1000, 1007))
    assert near_embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    close = [(1, [1.0, 1e-12]), (2, [1.0, 2e-12]), (3, [1e300, 1e300]), (4, [1e-300, 1e-300])]  # told apart as doubles only
    assert [tuple(r)[:3] for r in near_embeddings.near_vectors(spark.createDataFrame(close, "vec_id long, embedding array<double>")).orderBy("vec_id").collect()] == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3)]


def test_rows_without_an_id_link_with_nothing(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (6, [1.0, 0.01]), (None, [0.0, 1.0]), (None, None)]
    got = sorted(map(str, near_embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    want = [(None, 0, None, True)] * 3 + [(1, 1, 1, True), (6, 1, 1, False)]
    assert got == sorted(f"Row(vec_id={a}, n_links={b}, component_id={c}, kept={d})" for a, b, c, d in want)


def test_blocks_of_one_shard_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.eye(8)[i % 2] + rng.normal(scale=0.01, size=8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = {tuple(r) for r in near_embeddings.near_vectors(df).collect()}
    monkeypatch.setattr(near_embeddings, "BLOCK_ROWS", 20)
    assert {tuple(r) for r in near_embeddings.near_vectors(df).collect()} == whole
    assert all(r[1] == 29 for r in whole)


def test_dense_group_over_many_shards_keeps_its_links(spark, monkeypatch):
    monkeypatch.setattr(near_embeddings, "SHARD_ROWS", 40)
    rng = np.random.default_rng(6)
    rows = np.concatenate((np.eye(16)[0] + rng.normal(scale=0.04, size=(800, 16)), rng.normal(size=(400, 16)))).astype(np.float32)
    short = [(5000 + i, [1.0, 0.01 * i, 0.0]) for i in range(5)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + short, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in near_embeddings.near_vectors(df).collect()}
    x = near_embeddings.unit(rows)
    true = (x @ x.T >= 0.95).sum(axis=1) - 1
    ours = np.array([got[i].n_links for i in range(len(x))])
    assert (ours <= true).all() and np.mean(ours[true > 0] / true[true > 0]) >= 0.98 and ours.sum() >= 0.98 * true.sum()
    assert [(got[i].n_links, got[i].component_id) for i, _ in short] == [(4, 5000)] * 5


def brute_links(x, floor=0.95):
    linked = x @ x.T >= floor
    np.fill_diagonal(linked, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(linked, comp[None, :], len(x)).min(axis=1))
        if (new == comp).all():
            return linked.sum(axis=1), comp
        comp = new


@pytest.mark.parametrize("flat", [4096, 4])
def test_many_shards_on_one_level_and_on_two(spark, monkeypatch, flat):
    monkeypatch.setattr(near_embeddings, "SHARD_ROWS", 60)
    monkeypatch.setattr(near_embeddings, "FLAT", flat)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 24))
    rows = np.concatenate((base, *(base[rng.integers(0, 300, 300)] + rng.normal(scale=s, size=(300, 24)) for s in (0.05, 0.1, 0.2, 0.25)))).astype(np.float32)
    extreme = [(9000, [1e30] + [0.0] * 23), (9001, [2e30] + [0.0] * 23), (9002, [1e-40] + [0.0] * 23), (9003, [1.0, 2.0, 3.0]), (9004, [1.0, 2.0, 3.001])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + extreme, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in near_embeddings.near_vectors(df).collect()}
    true, comp = brute_links(near_embeddings.unit(rows))
    ours = np.array([got[i].n_links for i in range(len(rows))])
    assert (ours <= true).all() and ours.sum() >= 0.98 * true.sum() and true.sum() > 1000
    assert np.mean([got[i].component_id == comp[i] for i in range(len(rows))]) > 0.97
    assert [(got[i].n_links, got[i].component_id) for i in range(9000, 9005)] == [(2, 9000)] * 3 + [(1, 9003)] * 2


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.read_model(MODEL))


def test_encoding_is_the_librarys(codec):
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "▁", "\n", "é", "😀", "<s>", "</s>", "<0x0A>", "the", "\t", "\0", "ing", ".", "　", "漢", "word "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids, joined, stops = codec.encode(text)
        assert ids == codec.lib.encode(text, add_eos=True) and joined == " ".join(map(str, ids))
        assert (stops[-1] if len(stops) else 0) == len(text.encode()) and (np.diff(stops) >= 0).all()


def test_spans_name_the_source_of_pieces(codec):
    text = "Hello  wörld▁x 😀"
    ids, _, stops = codec.encode(text)
    data, starts = text.encode(), [0, *stops[:-1]]
    for i, a, b in zip(ids, starts, stops, strict=False):
        piece = codec.lib.id_to_piece(i)
        if not piece.startswith("<0x"):
            assert data[a:b].decode().replace("▁", " ").strip() == piece.replace("▁", " ").strip()


def build_map(rules: dict[bytes, bytes]) -> bytes:
    """A double-array trie over NUL-ended keys, for the test of the longest prefix."""
    texts, value = b"", {}
    for k, v in rules.items():
        value[k] = len(texts)
        texts += v + b"\0"
    units, used = {0: 0}, {0}

    def place(prefix: bytes, node: int) -> None:
        nexts = sorted({k[len(prefix)] for k in rules if k.startswith(prefix) and len(k) > len(prefix)})
        labels = [0, *nexts] if prefix in rules else nexts
        offset = next(o for o in range(1, 1 << 16) if all((node ^ o ^ c) not in used for c in labels))
        base = node ^ offset
        units[node] |= offset << 10 | (0x100 if prefix in rules else 0)
        used.update(base ^ c for c in labels)
        if prefix in rules:
            units[base] = value[prefix] | 0x80000000
        for c in nexts:
            units[base ^ c] = c
        for c in nexts:
            place(prefix + bytes([c]), base ^ c)

    place(b"", 0)
    size = (max(used) + 512) // 256 * 256
    return struct.pack("<I", size * 4) + struct.pack(f"<{size}I", *(units.get(i, 0xFF) for i in range(size))) + texts


def test_longest_prefix_of_the_character_map():
    m = sentencepiece_codec.CharacterMap(build_map({b"a": b"1", b"ab": b"22", b"abcd": b"", "é".encode(): b"e"}))
    assert m.longest(b"abcx", 0) == (b"22", 2) and m.longest(b"abcd", 0) == (b"", 4) and m.longest(b"xa", 1) == (b"1", 1)
    assert m.longest("éz".encode(), 0) == (b"e", 2) and m.longest("zé漢".encode(), 3) == ("漢".encode(), 3)


@pytest.mark.parametrize("squeeze", [False, True])
def test_a_model_with_a_character_map(squeeze):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(sentencepiece_codec.read_model(MODEL))
    proto.normalizer_spec.precompiled_charsmap = build_map({b"A": b"a", "é".encode(): b"e", "ﬁ".encode(): b"fi", "　".encode(): b" ", b"\t": b" ", b"xyz": b"y", b"xy": b"q", b"\x01": b""})
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    codec = sentencepiece_codec.Codec(proto.SerializeToString())
    rng = random.Random(3)
    parts = ["A", "b", " ", "  ", "é", "ﬁ", "　", "\t", "xyz", "xy", "x", "\x01", "漢", "the", "😀", "▁"]
    texts = ["", "ﬁA xyz", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(800))]
    for text, (ids, stops) in zip(texts, codec.encode_all(texts), strict=True):
        norm, source = codec.normalised(text)
        assert ids == codec.lib.encode(text, add_eos=True) and norm.decode() == codec.lib.normalize(text).replace(" ", "▁")
        assert len(norm) == len(source) == sum(codec.width[ids[:-1]])
        assert [*source, 0][: len(norm)] == sorted(source) and (np.diff(stops) >= 0).all() and (not len(stops) or stops[-1] == len(text.encode()))
    ids, _, stops = codec.encode("ﬁA xyz")
    at = dict(zip(np.cumsum(codec.width[ids[:-1]]).tolist(), stops.tolist(), strict=True))
    assert [at[n] for n in (5, 6) if n in at] == [[3, 4][n - 5] for n in (5, 6) if n in at] and stops[-1] == 8


def test_round_trip_digests(spark, codec):
    docs = [(1, "plain text\nwith lines"), (2, None), (3, ""), (3, ""), (4, "x" * 20000 + " end"), (None, " lead and trail ")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, ids int")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in docs:
        ids = codec.lib.encode(t or "", add_eos=True)
        want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(codec.lib.decode(ids)), len((t or "").encode())))
    got = sentencepiece_codec.round_trip(df, MODEL).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.span_bytes) for r in got) == sorted(want)
    encoded = sentencepiece_codec.encode_documents(df, MODEL)
    assert sorted(r.text for r in sentencepiece_codec.decode_documents(encoded, MODEL).collect()) == sorted(t or "" for _, t in docs)
    assert sentencepiece_codec.round_trip(df.limit(0), MODEL).count() == 0


def test_quality_on_held_out_rows(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        docs.append((i, " ".join(w) if good else " ".join(x + "%%%" for x in w)))
        labels.append((i, int(good), 0))
    docs += [(10_000, None), (10_001, ""), (None, "some text"), (5, docs[5][1])]
    labels += [(3, None, 0), (None, 1, 0), (77_777, 0, 0)]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_scores(df, marks).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert held and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    assert all(r.score == 0.5 for r in quality.quality_scores(df, marks.limit(0)).collect())
    assert quality.quality_scores(df.limit(0), marks).count() == 0


def brute_vectors(texts):
    """Sums of the index vectors of the two words before and after each word, by plain loops over buckets."""
    places, signs = quality.index_vectors()
    out = np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        ids = [zlib.crc32(w.encode()) % quality.BUCKETS for w in quality.TOKEN.findall(t or "")]
        for i, a in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i:
                    for k in range(quality.NONZERO):
                        out[a, places[ids[j], k]] += signs[ids[j], k]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def test_word_vectors_match_plain_loops(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("alpha beta, gamma. delta eps é 12".split()) for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, "", "w " * 50_000]
    docs = spark.createDataFrame([(i, t, "b", [1.0]) for i, t in enumerate(texts)], "doc_id long, text string, bucket string, x array<double>")
    got = quality.word_vectors(quality.text_rows(docs))
    assert np.allclose(got, brute_vectors(texts), atol=1e-5)
    marks = spark.createDataFrame([(i, i % 2, "t") for i in range(40)], "doc_id long, quality int, text string")
    scores = quality.quality_scores(docs, marks).collect()
    assert sorted(r.doc_id for r in scores) == list(range(len(texts))) and all(0 <= r.score <= 1 for r in scores)
