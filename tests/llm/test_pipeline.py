"""The pipeline's stages against brute force on a small corpus, and the near-copy groups against all pairs."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import simhash


def jaccard_groups(docs, similarity=0.8):
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in docs if t}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs, number = [], 0
    for _ in range(30):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = word()
            docs.append((number, " ".join(w)))
            number += 1
    return docs


def test_near_copies_match_all_pairs(spark):
    docs = texts() + [(900, None), (901, ""), (902, ""), (3, texts()[3][1])]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, keep int")
    got = dict(simhash.near_copies(df).collect())
    want = {i: r for i, r in jaccard_groups(docs).items()}
    grouped = {i for i, r in want.items() if list(want.values()).count(r) > 1}
    assert set(got) <= grouped and len(got) >= 0.97 * len(grouped)
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(got)
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_near_copies_at_the_required_similarity_are_found(spark):
    rng, docs = random.Random(12), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for i in range(600):
        w = [word() for _ in range(300)]
        docs.append((2 * i, " ".join(w)))
        for k in range(20, 300, 50):  # six words, five shingles each: Jaccard 266 / 326
            w[k] = word()
        docs.append((2 * i + 1, " ".join(w)))
    got = dict(simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert all(keep == i // 2 * 2 for i, keep in got.items()) and len(got) >= 2 * 0.99 * 600


@pytest.mark.parametrize("bucket", [400_000, 60])
def test_near_copies_in_a_template_and_in_large_balls(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "SMALL", 2)
    monkeypatch.setattr(simhash, "LEAF", 40)
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template, docs = [word() for _ in range(400)], []
    for i in range(120):  # all alike in 0.6 or so, every two of them in 0.9
        w = list(template)
        for k in range(60):
            w[k] = word()
        docs.append((2 * i, " ".join(w)))
        for k in range(0, 20, 10):
            w[k] = word()
        docs.append((2 * i + 1, " ".join(w)))
    base = [word() for _ in range(300)]
    for i in range(100):  # one group
        w = list(base)
        w[rng.randrange(300)] = word()
        docs.append((1000 + i, " ".join(w)))
    got = dict(simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    want = jaccard_groups(docs)
    assert len(got) >= 0.98 * len(docs) and all(got[i] == want[i] for i in got)


@pytest.mark.parametrize("most", [400_000, 30, 5])
def test_split_buckets_bring_the_same_pairs_together(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BUCKET", most)
    rng = random.Random(15)
    fps = [rng.getrandbits(26) for _ in range(40)] + [123_456_789 >> 1] * 50
    fps += [f ^ (1 << rng.randrange(26)) ^ (1 << rng.randrange(26)) for f in fps]
    cut = spark.createDataFrame([(i, f, 0) for i, f in enumerate(fps)], "lead long, fp long, table int")
    groups = simhash.dealt(cut, 26, 4, False)
    sizes = groups.groupBy("table", "bucket", "bits", "x", "y").count()
    got = set()
    for r in groups.groupBy("bucket", "bits", "x", "y").agg(F.collect_list(F.struct("lead", "fp")).alias("m")).collect():
        low = 26 - r.bits
        for x in r.m:  # as one-bit variants below the prefix
            for y in r.m:
                mine = {v for v in [x.fp, *(x.fp ^ 1 << i for i in range(26))] if v >> low == r.bucket}
                if mine & {v for v in [y.fp, *(y.fp ^ 1 << i for i in range(26))] if v >> low == r.bucket}:
                    got.add((x.lead, y.lead))
    assert got == {(i, j) for i, f in enumerate(fps) for j, g in enumerate(fps) if (f ^ g).bit_count() <= 2}
    assert most > 30 or sizes.agg(F.max("count")).first()[0] <= 3 * most  # parts are dealt by hash


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(None, "some words without an id", "en", "a", None, "x"), (1, None, None, None, None, "x"), (1, None, None, None, None, "x"), (2, "", "", "", 0, "x"), (3, "w " * 40_000, "en", "a", 80_000, "x")]
    for docs in (rows, []):
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, keep string")
        folder = tmp_path / str(len(docs))
        spark.createDataFrame([(3, 1, 0), (9, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "a b c")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, str(folder))
            assert name == "encoding" or out.schema.names == df.schema.names
            assert sorted(map(str, out.select("doc_id").collect())) == sorted(map(str, df.select("doc_id").collect())), name


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    docs = texts(5)
    junk = [(500 + i, " ".join(f"{w}%%%" for w in t.split())) for i, t in docs]
    passage = "one two three four five six seven eight nine ten eleven twelve"
    leaks = [(800, docs[0][1][::-1] + " " + passage)]
    secret = [(801, docs[1][1][::-1] + ' token = "abcdef0123456789abcdef0123456789"')]
    rows = [(i, t, "en", f"s{rng.randrange(3)}", len(t)) for i, t in docs + junk + leaks + secret]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 500), 0) for i, *_ in rows if i < 800], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.schema.names == kept.schema.names, name
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        kept = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        seen.append({r.doc_id: r for r in kept.collect()})
    quality, near, clean, masked = seen
    assert len([i for i in quality if 500 <= i < 800]) <= 2 and len([i for i in quality if i < 500]) >= 0.97 * len(docs)
    groups = jaccard_groups([(i, r.text) for i, r in quality.items()])
    assert len(set(near) ^ {i for i, r in groups.items() if i == r}) <= 2
    assert set(near) - set(clean) == {800} & set(near)
    assert set(masked) == set(clean)
    assert all(r.n_chars == len(r.text) and (r.text == clean[i].text or i == 801) for i, r in masked.items())
    assert 801 not in masked or masked[801].text.endswith('[SECRET]"')
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(final) == set(masked)
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, lib.encode(masked[i].text, add_eos=True))).encode()).hexdigest() for i, r in final.items())
