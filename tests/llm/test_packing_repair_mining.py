"""Packing, conversation repair and hard negatives against the library and brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import conversation_repair, hard_negatives, packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n, seed):
    rng = random.Random(seed)
    letters = list("abcJHWIs'..,,  \n\t<|>!?09é×ßÉñΣς中。") + ["̌", "̇", " ", " ", "\x1c", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'ll", "İ", "ﬁ", "\x00", "각"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 15))) for _ in range(n)]


def test_ids_by_word_equal_the_library():
    words = packing.WordIds(open(WORDS, encoding="utf-8").read())
    texts = [*odd_texts(5000, 1), "Word, " * 50_000, "x" * 20_000, "Fünf größere Wörter, naïve. école", ""]
    for text, ids in zip(texts, words.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == words.lib.encode(text, add_special_tokens=False).ids


def test_windows_hold_every_id_once_and_are_full(spark):
    lib, rng = Tokenizer.from_file(WORDS), random.Random(2)
    texts = [None, "", "", "same text", "same text", "long " * 9000, *odd_texts(60, 3), *[" ".join(rng.choices(["red", "stone", "walks"], k=rng.randint(1, 900))) for _ in range(150)]]
    rows = [(i if i % 50 else None, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long, context string").repartition(3)
    got = packing.pack_documents(df, WORDS, step_tokens=4096).collect()
    docs = Counter()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
    for i, t, *_ in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        docs[i, ids.tobytes()] += 1
    for (i, ids), times in docs.items():
        mine = [r for r in pieces[i, len(ids) // 4] if bytes(r.ids) == ids[4 * r.start : 4 * (r.start + r.length)]]
        assert sum(r.length for r in mine) >= times * (len(ids) // 4)
    assert sum(r.length for r in got) == sum(times * (len(ids) // 4) for (_, ids), times in docs.items())
    windows = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length > 0
        windows[r.sequence_id].append(r)
    steps = defaultdict(Counter)
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        ends = list(itertools.accumulate(r.length for r in w))
        assert [r.offset for r in w] == [0, *ends[:-1]] and ends[-1] == w[0].context and w[0].context & (w[0].context - 1) == 0 and w[0].context <= 2048
        assert len({(r.context, r.step) for r in w}) == 1
        steps[w[0].context][w[0].step] += 1
    for context, sizes in steps.items():
        assert max(sizes.values()) <= max(1, 4096 // context)
    assert packing.pack_documents(df.limit(0), WORDS).count() == 0


def test_long_parts_are_filled_from_shorter_tiers():
    p = packing.Packer((256, 512, 1024, 2048), 0, 8192)
    for doc, n in enumerate([5000, 1500, 900, 300, 200, 248, 100, 52]):
        p.add(doc, n)
    p.pack(True)
    by_context = defaultdict(list)
    for _, context, _, pieces in p.flush():
        by_context[context].append(pieces)
    assert sorted(by_context[2048])[0] == [(0, 0, 2048)] and [(1, 0, 1500), (3, 0, 300), (5, 0, 248)] in by_context[2048]  # best fits first
    assert sum(n for w in by_context.values() for pieces in w for *_, n in pieces) == 8300


def plain_repair(rows):
    """Every way to keep, give a role, delete and insert up to two rows at each place, by cost, then by audit."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    inserted = [(5 * n, "I" * n, new, [(NAMES[c], "") for c in new]) for n in range(3) for new in map("".join, itertools.product("ua", repeat=n))]
    best = None
    choices = []
    for (role, text), fault in zip(rows, faults, strict=True):
        cut = 5 if fault == "truncated" else 0
        stay = [] if fault in ("blank", "duplicate") else [(cut, "K", role[:1] or "-", [(role, text)]), *[(cut + 1, "R", c, [(NAMES[c], text)]) for c in "ua"]]
        choices += [inserted, [(2, "D", "", []), *stay]]
    for way in itertools.product(*choices, inserted):
        if re.fullmatch("(s?(ua)+)?", "".join(w[2] for w in way)):
            found = (sum(w[0] for w in way), "".join(w[1] for w in way), [x for w in way for x in w[3]])
            best = found if best is None or found[:2] < best[:2] else best
    return faults, best


NAMES = {"u": "user", "a": "assistant"}


def test_repair_is_the_cheapest_of_all_edits(spark):
    rng = random.Random(4)
    texts = ["Done.", "Well!", "cut", " \n", "Done.", "eh?"]
    convs = {c: [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(texts)) for _ in range(rng.randint(1, 3))] for c in range(60)}
    convs[1000], convs[1001], convs[1002] = [("system", "Be kind."), ("assistant", "Yes.")], [(" ", " ")], [("assistant", "A."), ("assistant", "B."), ("user", "C.")]
    rows = [(c, t, role, text, "clash", 7) for c, conv in convs.items() for t, (role, text) in enumerate(conv)]
    rows += [(None, None, None, None, "clash", 7), (None, 3, "user", "Q?", "clash", 7), (None, 3, "user", "Q?", "clash", 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, sig string, place int").repartition(5)
    report, out = conversation_repair.repair(df)
    report = {r.conv_id: r for r in report.collect()}
    texts = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: r.place):
        texts[r.conv_id].append((r.role, r.text))
    convs[None] = [(" ", " "), ("user", "Q?"), ("user", "Q?")]
    assert report.keys() == convs.keys()
    for c, conv in convs.items():
        faults, (cost, audit, repaired) = plain_repair(conv)
        r = report[c]
        assert (r.cost, r.audit) == (cost, audit) and texts[c] == repaired and r.n_rows == len(conv)
        assert [r.blank, r.duplicate, r.truncated] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        assert r.illegal == sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(conv))
    assert report[None].gaps == 0 and report[1000].gaps == 0
    empty = conversation_repair.repair(df.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_one_long_conversation_and_very_long_texts(spark):
    n = 6001
    rows = [(7, 2 * i, "user" if i % 2 == 0 else "assistant", f"Line {i}.") for i in range(n)] + [(8, 0, "user", "y" * 300_000 + "."), (8, 1, "assistant", "z" * 300_000)]
    report, out = conversation_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7))
    got = {r.conv_id: r for r in report.collect()}
    assert got[7].audit == "K" * (n - 1) + "D" and got[7].cost == 2 and got[7].gaps == n - 1
    assert (got[8].cost, got[8].audit) == (4, "DD")
    digest = {r.conv_id: r.repaired_sha256 for r in conversation_repair.text_hashes(out).collect()}
    assert digest[7] == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows[: n - 1]).encode()).hexdigest() and 8 not in digest


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "Why? So.") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = Counter()
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault:
            want[c, t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text] += 2 if fault == 3 else 1
    assert Counter(map(tuple, conversation_repair.damaged(df).collect())) == want
    lost = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = conversation_repair.repaired_digest(spark.createDataFrame([(lost, 0, "user", "Hi.")], df.schema)).first()
    assert row.cost == row.n_rows == 0 and row.audit == "" and row.repaired_sha256 == hashlib.sha256(b"").hexdigest()


def plain_negatives(rows, n_pos, n_neg):
    ints = {}
    for r, (vec_id, label, v) in enumerate(rows):
        if vec_id is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints[r] = [int(np.floor(256 * x)) for x in v]
            if sum((abs(x) + 1) ** 2 for x in ints[r]) >= 2**55:
                del ints[r]
    out = Counter()
    for a in ints:
        if rows[a][0] % 100 == 0:
            scored = [(-sum(x * y for x, y in zip(ints[a], ints[b], strict=True)), rows[b][0], b) for b in ints if b != a and len(ints[a]) == len(ints[b])]
            for p, positive, _ in sorted(x for x in scored if rows[x[2]][1] == rows[a][1])[:n_pos]:
                fits = sorted(x for x in scored if rows[x[2]][1] != rows[a][1] and -30 * p <= -100 * x[0] <= -90 * p)
                for rank, (s, negative, _) in enumerate(fits[:n_neg], 1):
                    out[rows[a][0], positive, rank, negative, -p, -s] += 1
    return out


def test_negatives_equal_all_integer_products(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(700, 24)) * (0.9 ** np.arange(24))
    rows = [(i * 10, i % 4, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(base)]
    rows += [(i * 10 + 1, 9, rows[i % 40][2]) for i in range(100)]  # ties
    rows += [(100, 1, rows[3][2]), (100, 1, rows[3][2]), (-200, 2, rows[5][2])]  # repeated rows
    rows += [(None, 1, rows[0][2]), (300, None, rows[0][2]), (400, 1, None), (500, 1, [None] * 24), (600, 1, [float("nan")] * 24), (700, 1, [float("inf")] * 24), (800, 1, [1e300] * 24)]
    rows += [(900, 1, [1.0, 0.5]), (901, 1, [0.9, 0.5]), (902, 2, [0.5, 0.5]), (1000, 1, []), (1001, 1, []), (1002, 2, []), (1100, 3, [2e5] * 3), (1101, 3, [2e5, 2e5, 1.0]), (1102, 4, [2e5, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, rid string, dim int").repartition(3)
    want = plain_negatives(rows, 5, 10)
    assert len(want) > 2000
    for cell in (None, 20_000):
        assert Counter(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, cell=cell).collect())) == want
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_keep_every_pair_in_the_window_and_drop_most():
    rng = np.random.default_rng(7)
    ints = np.floor(256 * rng.normal(size=(800, 64)) * 0.8 ** np.arange(64)).astype(np.int64)
    rotation = np.linalg.eigh((ints.T @ ints).astype(float))[1][:, ::-1]
    stages = hard_negatives.stages_of(64)
    q, x = (hard_negatives.Turned(t, rotation, stages) for t in (ints[:50], ints))
    true = ints[:50] @ ints.T
    low, high = np.quantile(true, 0.97, axis=1), np.quantile(true, 0.99, axis=1)
    i, j = hard_negatives.survivors(q, x, np.ones(true.shape, bool), low, high, stages, hard_negatives.rounding(64, rotation))
    inside = {*zip(*np.nonzero((true >= low[:, None]) & (true <= high[:, None])), strict=True)}
    assert inside <= {*zip(i, j, strict=True)} and len(i) <= 1.01 * len(inside) + 5
    assert (hard_negatives.exact(ints[:50], ints, i, j) == true[i, j]).all()

