"""Paragraph dedup against brute-force Jaccard and components."""

import hashlib
import random

from spanloom.llm import substring_dedup


def shingles(line):
    w = line.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(docs, least):
    places = [(i, p, line) for i, t in docs for p, line in enumerate((t or "").split("\n")) if len(line.split()) >= least]
    root = list(range(len(places)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(p[2]) for p in places]
    for a in range(len(places)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    first = {}
    for k, (i, p, _) in enumerate(places):
        first[find(k)] = min(first.get(find(k), (i, p)), (i, p))
    return {(i, p) for k, (i, p, _) in enumerate(places) if first[find(k)] != (i, p)}


def check(spark, docs, **more):
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, dkey string")
    found = substring_dedup.repeated_paragraphs(df, **more)
    got = {(r.doc_id, p) for r in found.collect() for p in r.gone}
    return got, found


def test_removals_match_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(60)] for _ in range(4)]
    docs = [(1, None), (2, ""), (3, "short line\nshort line")]
    for i in range(40):
        lines = []
        for b in base:
            w = list(b)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(60)] = word()
            if rng.random() < 0.7:
                lines.append(" ".join(w).title())
        lines.append(" ".join(word() for _ in range(30)))
        docs.append((10 + i, "\n".join(lines)))
    got, found = check(spark, docs, window=10_000)
    want = brute(docs, 20)
    assert len(got ^ want) <= 0.01 * len(want) and len(want) > 50
    for r in substring_dedup.digest(found).collect():
        t = dict(docs)[r.doc_id] or ""
        kept = "\n".join(x for p, x in enumerate(t.split("\n")) if (r.doc_id, p) not in got) if any(g[0] == r.doc_id for g in got) else t
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_blocks_find_the_same(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(30):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(60)] = f"x{rng.random()}"
        docs.append((i, " ".join(w)))
    whole, _ = check(spark, docs)
    defaults = substring_dedup.paragraph_links.__defaults__
    monkeypatch.setattr(substring_dedup.paragraph_links, "__defaults__", (5,))
    blocks, _ = check(spark, docs)
    monkeypatch.setattr(substring_dedup.paragraph_links, "__defaults__", defaults)
    assert whole == blocks == brute(docs, 20)


def test_passages_inside_different_lines(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    passages, docs = [text(51 + 3 * i) for i in range(20)], []
    for i in range(20):
        docs.append((10 + i, " ".join(text(70) + passages[i] + text(40))))
        docs.append((100 + i, "\n".join(" ".join(w) for w in (text(30), text(15) + passages[i][:20], passages[i][20:35], passages[i][35:] + text(25)))))
    docs += [(200 + i, " ".join(text(200))) for i in range(20)]
    got, found = check(spark, docs)
    assert not got
    rows = {r.doc_id: r for r in substring_dedup.digest(found).collect()}
    assert all(rows[i].n_removed == 0 for i in rows if not 100 <= i < 200)
    hit = [i for i in range(20) if rows[100 + i].n_removed > 0]
    assert len(hit) >= 19 and all(rows[100 + i].kept_in == [10 + i] for i in hit)
    own = dict(docs)
    for r in substring_dedup.without_repeats(found).collect():
        starts = {tuple(own[r.doc_id].split()[a : a + 25]) for a in r.windows}
        earlier = {tuple(t.split()[a : a + 25]) for i, t in docs if i < r.doc_id for a in range(len(t.split()))}
        assert starts <= earlier and len(r.kept.split()) <= len(own[r.doc_id].split()) - 25 * bool(r.windows)


def test_what_remains():
    cut = lambda t, g, w, n: substring_dedup.remainder(t, g, w, n)
    assert cut(b" a b\n c  d e\n\nf", [], [1], 3) == b" a \ne\n\nf"
    assert cut(b"a b\nc d\ne", [0], [3], 2) == b"c "
    assert cut(b"a\tb\n", [], [], 2) == b"a\tb\n" and cut(b"a b\nc", [], [0, 1], 2) == b""


def test_very_long_line(spark):
    line = " ".join(f"w{i}" for i in range(60_000))
    got, found = check(spark, [(1, line), (2, "x " * 30 + line), (3, "y " * 50_000)])
    rows = {r.doc_id: r for r in substring_dedup.digest(found).collect()}
    assert (2, 0) in got and rows[1].n_removed == 0 and rows[3].n_removed == 0


def test_repeated_rows_nulls_and_empty(spark):
    line = " ".join(f"w{i}" for i in range(25))
    got, found = check(spark, [(1, line), (1, line), (2, line + "\n" + line), (None, "x")])
    assert got == {(2, 0), (2, 1)} and found.count() == 4
    assert check(spark, [])[1].count() == 0
