"""SimHash, line dedup, and the pipeline's use of them, against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tintype.llm import line_dedup, queries, simhash
from tintype.operators.components import connected_components


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, near):
    """Least index reachable of each value."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprints_and_components(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "One", "one two", "ÀB c D", "a b c\td\x0be f"]
    for _ in range(25):
        words = [rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randrange(150, 400))]
        texts.append(" ".join(words))
        for _ in range(3):
            changed = list(words)
            for _ in range(rng.randrange(3)):
                changed[rng.randrange(len(words))] = "zz"
            texts.append(" ".join(changed))
    rows = [(i, t, 5, "y") for i, t in enumerate(texts)] + [(2, " \n", 5, "y"), (None, texts[-1], 5, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string")
    got = simhash.near_duplicates(df).collect()
    want = [plain_fingerprint(t) for t in texts]
    component = classes(want, lambda a, b: (a ^ b).bit_count() <= 3)
    assert len(got) == len(rows)
    for r in got:
        i = len(texts) - 1 if r.doc_id is None else r.doc_id
        assert r.fingerprint == f"{want[i]:016x}" and r.component_id == component[i]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(component))
    assert simhash.keep_one(df.limit(0)).count() == 0
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_unrelated_texts_under_one_id_stay(spark):
    one, two = (" ".join(w + str(i) for i in range(60)) for w in "ab")
    rows = [(1, one, "x"), (1, two, "x"), (1, one, "x"), (2, one, "y"), (None, two, "y"), (None, "of its own " * 9, "y"), (3, two, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    want = {(1, one), (1, two), (None, "of its own " * 9)}
    kept = simhash.keep_one(df).collect()
    assert len(kept) == 3 and {(r.doc_id, r.text) for r in kept} == want
    assert len({r.component_id for r in simhash.near_duplicates(df.where("doc_id = 1")).collect()}) == 1 and simhash.near_duplicates(df).count() == 7


def test_bit_sliced_distances_and_pieces(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = [*base]
    for b in [*base, *[base[0]] * 400]:
        x = int(b)
        for k in rng.integers(0, 64, rng.integers(0, 5)):
            x ^= 1 << int(k)
        fps.append(np.uint64(x))
    fps = np.unique(np.array(fps, dtype=np.uint64))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    assert (simhash.links_between(fps, fps, list(range(64))) == near).all()
    for radius in (1, 2, 5):
        d = simhash.within(simhash.planes_of(fps ^ fps[0]), (-(-len(fps) // 64),), radius)
        lanes = np.unpackbits(d.view(np.uint8), bitorder="little")[: len(fps)].astype(bool)
        assert (lanes == (np.bitwise_count(fps ^ fps[0]) <= radius)).all()
    monkeypatch.setattr(simhash, "PIECE", 20)  # so that the large bucket is cut
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.component for r in connected_components(simhash.fingerprint_links(df)).collect()}
    component = classes([int(x) for x in fps], lambda a, b: (a ^ b).bit_count() <= 3)
    names = {}
    for x, c in zip(fps.view(np.int64).tolist(), component, strict=True):
        assert names.setdefault(c, got.get(x, x)) == got.get(x, x)
    assert len(set(names.values())) == len(names)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_near_is_edit_distance_of_one():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ([rng.choice("ab") for _ in range(rng.randrange(6))] for _ in range(2))
        assert line_dedup.near(a, b) == (edits(a, b) <= 1)
        keys = line_dedup.variant_keys(a).tolist() if a else []
        variants = [a, *(a[:i] + a[i + 1 :] for i in range(len(a)))] if a else []
        assert all((keys[i] == keys[j]) == (variants[i] == variants[j]) for i in range(len(keys)) for j in range(i))


def test_removed_lines_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["aa", "bb", "cc", "dd"]
    line = lambda: "  ".join(rng.choice(words) for _ in range(rng.randint(3, 8)))
    rows = [(i if i % 7 else None, "\n".join(line() for _ in range(rng.randint(0, 3))) if i % 11 else None) for i in range(150)]
    rows += rows[:6] + [(3, "AA BB cc dd ee\nzz"), (9, "é " * 400 + "\n" + "é " * 399 + "x")]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, lk int, line string")
    hashes = {r.text or "": r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    lines = sorted({((0 if i is None else 1, i or 0), hashes[t or ""], p, tuple(x.lower().split())) for i, t in rows for p, x in enumerate((t or "").split("\n")) if len(x.split()) >= 5})
    want = {(i[1] if i[0] else None, h, p) for k, (i, h, p, w) in enumerate(lines) if any(edits(w, v) <= 1 for _, _, _, v in lines[:k])}
    assert {tuple(r) for r in line_dedup.removed_lines(df).collect()} == want
    clash = df.withColumn("removed_lines", F.lit("own"))
    kept = line_dedup.dedup_lines(clash, count_as=None)
    assert kept.columns == clash.columns and {r.removed_lines for r in kept.collect()} == {"own"}
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(clash)
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "removed_lines"] and out.count() == len(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_earliest_line_stays_and_emptied_documents_go(spark):
    a = "The quick brown fox jumps over the dog"
    df = spark.createDataFrame([(1, f"{a}\nshort"), (2, a.lower().replace("quick", "slow")), (3, f"{a}\nA line of its own, quite another one"), (4, "short"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, drop_emptied=True).collect()}
    assert got == {1: f"{a}\nshort", 3: "A line of its own, quite another one", 4: "short", 5: None}


def test_short_lines_go_if_they_repeat(spark, tmp_path):
    df = spark.createDataFrame([(1, "Read more\n其他文字\none two three four"), (2, "read  MORE\n\n\none two three five"), (3, "其他文字"), (4, "read"), (5, None)], "doc_id long, text string")
    want = {(2, 0), (3, 0)}
    assert {(r.doc_id, r.pos) for r in line_dedup.removed_lines(df, least_words=1).collect()} == want
    df.withColumn("n_chars", F.length("text")).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.removed_lines for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
    assert sorted(r.doc_id for r in corpus_pipeline.lines(spark, df, "").collect()) == [1, 2, 4, 5]
