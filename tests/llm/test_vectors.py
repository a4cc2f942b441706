"""Vector codes, the pivot index and the filter audit against plain versions."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import oracle
from tintype.llm import filter_audit, pivot_index, queries, vector_codes


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_filter_audit", "op13_pivot_index"])
def test_query_equals_sql(spark, sf_dir, name):
    oracle.same(queries.queries()[name](spark, sf_dir), oracle.connect(sf_dir), queries.oracle_sql()[name])


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """{row number: (code, error, label_error)} of (id, vector, label) rows, and the codebooks' hash."""
    good = [i for i, (_, v, _) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    good.sort(key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    good = [i for i in good if len(rows[i][1]) == len(rows[good[0]][1])]
    w = len(rows[good[0]][1]) // parts if good else 1
    cut = {i: [[vector_codes.whole(x) for x in rows[i][1][p * w : p * w + w]] for p in range(parts)] for i in good}
    books = [[cut[i][p] for i in good[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        own = {i: [nearest(p, v)[1] for p, v in enumerate(cut[i])] for i in good}
        for p in range(parts):
            for e in range(len(books[p])):
                if mine := [cut[i][p] for i in good if own[i][p] == e]:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out, by_label = {}, {}
    for i in good:
        best = [nearest(p, v) for p, v in enumerate(cut[i])]
        out[i] = "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)
        by_label[rows[i][2]] = by_label.get(rows[i][2], 0) + out[i][1]
    cap = lambda x: min(x, 2**63 - 1)
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return {i: (c, cap(e), cap(by_label[rows[i][2]])) for i, (c, e) in out.items()}, digest


def codes_of(spark, rows, kind="double"):
    df = spark.createDataFrame([(i, v, lab, "c", 1.5) for i, v, lab in rows], f"vec_id long, embedding array<{kind}>, label int, code string, lower double").repartition(3)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df).collect()), key=str)


def held_against_plain(spark, rows):
    want, digest = plain_codes(rows)
    assert codes_of(spark, rows) == sorted(((rows[i][0], *x, digest) for i, x in want.items()), key=str)


def test_codes_equal_plain_integers(spark):
    rng = random.Random(3)
    middles = [[rng.gauss(0, 0.4) for _ in range(32)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(middles)], rng.choice([None, 1, 2])) for i in range(400)]
    rows += [rows[5], rows[5], (7, rows[9][1], 1), (None, rows[3][1], None), (None, None, 3), (500, [], 1), (501, [None] * 32, 1), (502, [math.nan] * 32, 1), (503, [math.inf] + [0.0] * 31, 1), (504, [0.5] * 16, 1), (505, [0.5] * 31, 1)]
    held_against_plain(spark, rows)


def test_codes_of_few_ties_and_huge_components(spark):
    held_against_plain(spark, [(i, [float(i % 3)] * 16, None) for i in range(9)])
    rng = random.Random(4)
    for huge in ([1e6, -3e4], [1e12, 1e30, -1e300], [5000.0] * 70):  # in some rows, also as entries; in all entries of a part
        rows = [(i, [rng.uniform(-2, 2) for _ in range(16)], i % 4) for i in range(150)]
        for i, x in zip((5, 100, 120) if len(huge) < 9 else range(70), huge, strict=False):
            rows[i][1][i % 16 if len(huge) < 9 else 3] = x
        held_against_plain(spark, rows)
    assert codes_of(spark, []) == [] and codes_of(spark, [(1, None, 1), (2, [1.0], 2)]) == []
    assert codes_of(spark, [(1, [0.25] * 16, 1)], "float")[0][:4] == (1, "00" * 16, 0, 0)


def test_bounds_spare_scans_and_hold():
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(0, 40, (600, 4)) + 300 * rng.integers(-3, 4, (600, 1)))
    old = v[:64].astype(int).astype(object)[None]
    books = vector_codes.Codebooks([old])
    none = np.full(600, -1), np.zeros((600, 4)), np.zeros((600, 4), dtype=int)
    entry, _, lower, stamp = books.assign(0, v, *none)
    for _ in range(2):
        new = books.history[-1].copy()
        for e in range(64):
            if (entry == e).any():
                new[0, e] = [int(x) for x in v[entry == e].sum(axis=0) // (entry == e).sum()]
        books = vector_codes.Codebooks([*books.history, new])
        every = vector_codes._distances(v, new[0].astype(float))
        drift = books.moved[stamp, 0, np.arange(4)[None, :]]
        spared = lower - drift > np.sqrt(every[np.arange(600), entry])[:, None] + 1e-6 * (1 + lower + drift)
        assert spared.any()
        entry, d, lower, stamp = books.assign(0, v, entry, lower, stamp)
        assert (entry == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
        every[np.arange(600), entry] = np.inf
        for g, own in enumerate(books.groups):  # no bound is over the distance to the nearest of the others
            assert (lower[:, g] - books.moved[stamp[:, g], 0, g] <= np.sqrt(every[:, own].min(axis=1)) + 1e-9).all()
    length = lambda x, y: math.sqrt(((y - x) ** 2).sum())
    net, summed = length(books.history[0], books.history[2]), length(*books.history[:2]) + length(*books.history[1:])
    assert net < summed


def plain_links(rows):
    """Per row (n_links, component_id) by all pairs."""
    ok = [bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.linalg.norm(v) if good else None for (_, v), good in zip(rows, ok, strict=True)]
    near = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((len(near[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return out


def clusters(rng, sizes, noise, dim=24):
    out = []
    for n in sizes:
        middle = rng.normal(size=dim)
        middle /= np.linalg.norm(middle)
        out += [(middle + rng.normal(size=dim) * noise / np.sqrt(dim)) * rng.uniform(0.1, 9) for _ in range(n)]
    return [[float(x) for x in v] for v in out]


@pytest.mark.parametrize(("noise", "piece"), [(0.1, 1024), (0.1, 16), (0.22, 16), (0.22, 1024)])
def test_links_and_components_equal_all_pairs(spark, noise, piece):
    """Groups inside a ball and groups whose pairs are about the limit, in one piece and in many."""
    rng = np.random.default_rng(6)
    vectors = clusters(rng, [150, 40, 20, 5, 2, 2, *[1] * 300], noise)
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    rows += [rows[3], (9000, rows[3][1]), (None, rows[8][1]), (9001, rows[8][1]), (None, [-x for x in rows[200][1]])]
    rows += [(9002, None), (9003, []), (9004, [0.0] * 24), (9005, [None, *[1.0] * 23]), (9006, [math.nan] * 24), (9007, rows[0][1][:12]), (9008, rows[0][1][:12]), (None, None)]
    df = spark.createDataFrame([(i, v, "n", 3, 4.0) for i, v in rows], "vec_id long, embedding array<double>, node string, ball int, n double")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivot_index.near_vectors(df, piece=piece).collect()), key=str)
    want = sorted(((i, n, c, c is not None and i == c) for (i, _), (n, c) in zip(rows, plain_links(rows), strict=True)), key=str)
    assert len(got) == len(want)
    found, there = sum(x[1] for x in got), sum(x[1] for x in want)
    assert found <= there and found >= 0.995 * there
    if noise < 0.2:
        assert got == want


def test_index_recall_at_the_limit(spark):
    """Pairs of cosine 0.951, the hardest to find, among 4000 vectors: recall over 0.99, none below the limit."""
    rng = np.random.default_rng(7)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u = rng.normal(size=a.shape)
    u -= (u * a).sum(axis=1, keepdims=True) * a
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    rows = np.concatenate([a, 0.951 * a + math.sqrt(1 - 0.951**2) * u])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in pivot_index.near_vectors(df).collect()}
    assert len(got) == 4000
    hit = [i for i in range(2000) if got[2000 + i].component_id == i]
    assert len(hit) >= 0.99 * 2000 and all(got[i].n_links == 1 for i in hit)
    assert sum(r.n_links for r in got.values()) == 2 * len(hit)


def test_a_ball_is_never_compared_with_itself(spark):
    """Of a group of near copies in one ball no two meet; postings grow with the group, not with its square."""
    rng = np.random.default_rng(8)
    vectors = clusters(rng, [600, *[1] * 60], 0.05)
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(vectors)], "node long, copies long, vector array<double>")
    points = pivot_index.described(df, pivot_index.choose_pivots(pivot_index.units(np.array(vectors)), 50))
    met = pivot_index._meetings(points, 32)
    of_ball = met.where(F.col("node") < 600).groupBy("g").agg(F.min("second").alias("a"), F.max("second").alias("b"), F.min("ball").alias("least"), F.count_distinct("ball").alias("balls"), F.count("*").alias("n"))
    assert points.where("node < 600").select("ball").distinct().count() == 1
    assert of_ball.where("a <> b").count() == 0 and met.count() < 40 * 660


def plain_audit(docs, labels):
    """The rows of the audit by playing every order on every document."""
    def words(t):
        return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]

    out = {}
    for part in {s or "" for _, _, s in docs}:
        own = [(i, t or "") for i, t, s in docs if (s or "") == part]
        fails = []
        for i, t in own:
            w = words(t)
            f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
            f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
            fails.append({k for k, v in f.items() if v})
        removed_in_all = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(range(len(own)))
            for step, k in enumerate(order, 1):
                gone = [n for n in left if k in fails[n]]
                before = set(range(len(own))) - set(left)
                left = [n for n in left if k not in fails[n]]
                lost = lambda kind: sum(any(j == own[n][0] and lab[kind] == 1 for j, *lab in labels) for n in gone)  # noqa: B023, E731
                out[part, order, step] = [len(left), len(gone), sum(k in fails[n] for n in before), sum(f == {k} for f in fails), lost(0), lost(1)]
                removed_in_all[k] += len(gone)
        for order in map("".join, permutations("ABCDE")):
            for step, k in enumerate(order, 1):
                out[part, order, step].append(removed_in_all[k])
    return out


def test_audit_equals_playing_every_order(spark):
    rng = random.Random(9)
    long = lambda n, kinds: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
    texts = [None, "", " \n", "A", "#", long(250, 10), long(250, 4000), "X" + long(300, 5000), long(220, 50) + " & B" * 30, "é" * 50 + " ÀÉ", "z" * 200_000 + " " + long(5000, 900_000)]
    docs = [(i, rng.choice(texts), rng.choice([None, "", "a", "b"])) for i in range(120)]
    docs += [docs[3], docs[3], (5, texts[6], "b"), (None, texts[6], "a"), (None, texts[6], None), (-1, texts[7], "c"), (500, long(230, 5000), "only")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame([(i, t, s, "m", "h", 1) for i, t, s in docs], "doc_id long, text string, source string, mask string, h string, quality int").repartition(3)
    lab = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.filter_audit(df, lab).collect()
    want = plain_audit(docs, labels)
    assert len(got) == len(want)
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step], r
    assert filter_audit.filter_audit(df.limit(0), lab).count() == 0


def test_prepass_clears_unique_texts_only(spark):
    hashes = spark.createDataFrame([(i % 5000 * 7919,) for i in range(5300)], "h long")
    kept = {r.h for r in filter_audit.possible_repeats(hashes, 5300).collect()}
    assert {i * 7919 for i in range(300)} <= kept and len(kept) < 300 + 0.02 * 4700
