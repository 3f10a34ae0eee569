"""Exact substring dedup against a table of all strings."""

import hashlib
import random

import numpy as np
import pytest

from spanloom.llm import suffix_dedup


def brute(docs, least=100):
    first, out = {}, {}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        data = (t or "").encode()
        for s in range(len(data) - least + 1):
            first.setdefault(data[s : s + least], (i, s))
    for i, t in docs:
        data, gone = (t or "").encode(), np.zeros(len((t or "").encode()), bool)
        for s in range(len(data) - least + 1):
            if first[data[s : s + least]] != (i, s):
                gone[s : s + least] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out[i, t] = (len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioué") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, docs = [text(60) for _ in range(4)], [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 900), (6, "ab" * 300), (None, text(40))]
    for i in range(40):
        parts = [text(rng.randint(1, 60))]
        for s in shared:
            if rng.random() < 0.5:
                a = rng.randrange(len(s) // 2)
                parts += [s[a : a + rng.randint(60, 260)], text(rng.randint(0, 20))]
        docs.append((10 + i, "".join(parts)))
    return docs + [(70, docs[12][1]), (71, docs[12][1] + "!"), (70, docs[12][1]), (72, docs[20][1][5:])]


@pytest.mark.parametrize("more", [{}, {"hot": 3}, {"task_bytes": 3000}])
def test_bytes_match_brute_force(spark, monkeypatch, more):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, h int")
    monkeypatch.setattr(suffix_dedup.repeat_starts, "__defaults__", tuple({"hot": 20_000, "task_bytes": 2_000_000, **more}.values()))
    want = brute(docs)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.repeated_bytes(df)).collect())
    assert got == sorted((str(i), *want[i, t]) for i, t in docs)


def test_empty_table(spark):
    assert suffix_dedup.digest(suffix_dedup.repeated_bytes(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_equal_strings_of_contexts():
    group, owner, offset = suffix_dedup.equal_strings([b"abcabcabc", b"xbcabcax", b"q"], 4)
    found = {}
    for g, o, a in zip(group.tolist(), owner.tolist(), offset.tolist(), strict=True):
        found.setdefault(g, set()).add((o, a))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, brute_groups()))


def brute_groups():
    texts, found = [b"abcabcabc", b"xbcabcax", b"q"], {}
    for o, t in enumerate(texts):
        for a in range(len(t) - 3):
            found.setdefault(t[a : a + 4], set()).add((o, a))
    return [g for g in found.values() if len(g) > 1]
