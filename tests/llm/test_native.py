"""Quality rules and order MinHash against plain Python."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tintype.llm import line_quality, order_minhash

SCHEMA = "doc_id long, text string, source string, th string, pos int, removed_words int"


def docs_of(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], SCHEMA)


def counts(t):
    words = [x for x in re.split("[ \t-\r]+", t) if x]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search("[^ \t-\r]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated)


def test_counts_equal_brute_force(spark):
    rng = random.Random(0)
    texts = [None, "", " \n ", "a", "é ß 🙂\tx\x0b\x0cy\r\n", "a " * 5000, "x#*$%&|<> #\n" * 3]
    for _ in range(60):
        vocabulary = rng.choice([2, 3, 30])
        texts.append("".join(rng.choice("abcdefghij"[: max(2, vocabulary // 3)]) + rng.choice([" ", " ", "\n", "\t "]) for _ in range(rng.randrange(80))))
    df = docs_of(spark, [(i if i % 5 else None, t, "s") for i, t in enumerate(texts)] + [(1, "", "s")])
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in line_quality.quality_rules(df)[0].collect())
    assert got == Counter((i if i % 5 else None, *counts(t or "")) for i, t in enumerate([*texts])) + Counter([(1, 0, 0, 0, 0, 0)])


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    body = " ".join("word" + chr(97 + k) for k in range(25))
    own = lambda i: body.replace("wordc", "".join(chr(97 + int(c)) for c in str(i)))
    rows = [(i, f"Shared  BOILER {i} line here\n{own(i)}", "a") for i in range(30)]  # one line in normal form
    rows += [(100 + i, f"shared boiler 9 line here\n{own(100 + i)}", "b") for i in range(3)]  # rare with that host
    rows += [(200 + i, "\n".join(["shared boiler 1 line here"] * 12 + ["a b c"]), "a") for i in range(2)]
    rows += [(300 + i, f"the very same text of a copy {body}", "a") for i in range(40)]  # one text, however often
    limits = {"min_docs": 10, "max_share": 0.01, "max_repeat": 100, "copies_once": True, "fold_digits": True}
    verdicts, removed = line_quality.quality_rules(docs_of(spark, rows), **limits)
    kept = {r.doc_id: (r.kept, r.removed_words) for r in verdicts.collect()}
    assert all(kept[i] == (True, 5) for i in range(30)) and all(kept[100 + i] == (True, 0) for i in range(3))
    assert all(kept[200 + i] == (False, 60) for i in range(2)) and all(kept[300 + i] == (True, 0) for i in range(40))
    assert {(r.doc_id, r.pos) for r in removed.where("doc_id < 100").collect()} == {(i, 0) for i in range(30)}
    out = line_quality.apply_quality_rules(docs_of(spark, rows), **limits)
    assert out.columns == docs_of(spark, rows).columns and {r.text for r in out.where("doc_id = 7").collect()} == {own(7)} and out.count() == 73


def test_lines_are_counted_by_documents_of_a_host(spark):
    rng = random.Random(7)
    filler = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(30))
    rows = [(i, f"{filler()}\nline {min(i, 19) % 20 // 2}\nline 1", "ab"[i % 2] if i % 7 else None) for i in range(200)]
    rows += [(500 + i, "a text of which there are copies " * 3 + "\nand more of the same", "a") for i in range(12)] + [(0, rows[0][1], None)] * 30
    limits = {"min_docs": 10, "max_share": 0.3, "max_docs": 60, "max_repeat": 100}
    held, hosts = {}, {}
    for i, t, s in set(rows):
        hosts.setdefault(s, set()).add(i)
        for x in t.split("\n"):
            held.setdefault((s, " ".join(x.lower().split())), set()).add(i)
    often = {k for k, v in held.items() if len(v) > 10 and (len(v) > 0.3 * len(hosts[k[0]]) or len(v) > 60)}
    want = {(i, p) for i, t, s in rows for p, x in enumerate(t.split("\n")) if (s, " ".join(x.lower().split())) in often}
    verdicts, removed = line_quality.quality_rules(docs_of(spark, rows), **limits)
    assert {(r.doc_id, r.pos) for r in removed.collect()} == want
    lost = {i: sum(len(x.split()) for p, x in enumerate(t.split("\n")) if (i, p) in want) for i, t, _ in rows}
    got = verdicts.collect()
    assert len(got) == len(rows) and all(r.removed_words == lost[r.doc_id] and r.kept == (not r.base_failed and r.n_words - lost[r.doc_id] >= 0.3 * r.n_words) for r in got)


def test_near_copies_do_not_make_each_others_lines_frequent(spark):
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(9))
    first = [line() for _ in range(12)]
    rows = [(i, "\n".join(line() if k == i % 12 else x for k, x in enumerate(first)), "s") for i in range(60)]
    rows += [(100 + i, "\n".join([line(), "the usual foot of a page", line(), line()]), "s") for i in range(40)]
    removed = {(r.doc_id, r.pos) for r in line_quality.quality_rules(docs_of(spark, rows), copies_once=True)[1].collect()}
    assert removed == {(100 + i, 1) for i in range(40)}
    assert not line_quality.quality_rules(docs_of(spark, rows))[0].where("kept and doc_id < 100").count()  # counted by documents they do


def test_copies_do_not_raise_the_limit(spark):
    """A page's foot in 30 of 900 documents of a source is frequent at 2 %, also if the source holds 3000 copies of another text."""
    rng = random.Random(10)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(9))
    rows = [(i, "\n".join([line(), *(["the usual foot of a page"] if i < 30 else []), line(), line()]), "s") for i in range(900)]
    copy = [line() for _ in range(20)]
    rows += [(1000 + i, "\n".join([f"{i} own line of this copy", *copy]), "s") for i in range(3000)]
    removed = {(r.doc_id, r.pos) for r in line_quality.quality_rules(docs_of(spark, rows), copies_once=True, max_share=0.02)[1].collect()}
    assert removed == {(i, 1) for i in range(30)}


def test_empty_table(spark):
    df = docs_of(spark, []).withColumn("n_chars", F.lit(1).cast("long"))
    assert line_quality.apply_quality_rules(df).count() == 0 and line_quality.quality_rules(df)[0].count() == 0
    assert order_minhash.compare_neighbours(df).count() == 0


def numbered_kmers(text):
    """The 3-word k-mers of a text with their number among equal ones and their place."""
    words = [x for x in re.split("[ \t-\r]+", text or "") if x]
    kmers = [tuple(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([tuple(words)] if words else [])
    seen = Counter()
    out = []
    for i, k in enumerate(kmers):
        out.append((k, seen[k], i))
        seen[k] += 1
    return out


def plain_sketches(spark, texts):
    """Of each text the 64 tuples: those two numbered k-mers that are least under the hash less the entry's share of the circle, in text order."""
    every = {(" ".join(k), o) for x in texts for k, o, _ in numbered_kmers(x)}
    rows = spark.createDataFrame(sorted(every), "t string, o int")
    hash_of = order_minhash.let(order_minhash.words_of(F.col("t")), lambda w: order_minhash._kmers(F.transform(w, lambda x: F.xxhash64(x))))[0]
    rows = rows.withColumn("h", hash_of)
    number = {(r.t, r.o): (r.x % (1 << 64)) >> 30 for r in rows.withColumn("x", F.when(F.col("o") == 0, F.col("h")).otherwise(F.xxhash64("h", "o"))).collect()}
    out = []
    for t in texts:
        ranks = [(number[" ".join(k), o], place) for k, o, place in numbered_kmers(t)]
        out.append([tuple(r for r, _ in sorted(sorted(ranks, key=lambda x: ((x[0] - (b << 28)) % (1 << 34), x[1]))[:2], key=lambda x: x[1])) for b in range(64)] if ranks else [])
    return out


def plain_likeness(a, b):
    return sum(x == y for x, y in zip(a, b, strict=False)) / 64 if a or b else 1.0


def test_sketch_follows_numbered_kmers_and_their_order(spark):
    rng = random.Random(4)
    texts = ["", "a", "a b", "a b c", "a b c d", " ".join("ab"[i % 2] for i in range(60)), "x " * 300]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 200))) for _ in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", order_minhash.order_minhash(F.col("text")).alias("s"))
    pairs = rows.alias("a").crossJoin(rows.alias("b")).select("a.i", F.col("b.i").alias("j"), order_minhash.likeness(F.col("a.s"), F.col("b.s")).alias("l"))
    plain = plain_sketches(spark, texts)
    assert all(len(r.s) == (64 if texts[r.i] else 0) for r in rows.collect())
    assert all(r.l == plain_likeness(plain[r.i], plain[r.j]) for r in pairs.collect())


def test_likeness_of_reordered_blocks_is_low_at_any_length(spark):
    def text(n):
        words = [f"w{n}x{i}" for i in range(n)]
        return " ".join(words), " ".join(w for i in range(n - 5, -1, -5) for w in words[i : i + 5])

    rows = spark.createDataFrame([(n, *text(n)) for n in (20, 40, 80, 160, 640, 2560)], "n int, a string, b string")
    got = {r.n: r.l for r in rows.select("n", order_minhash.likeness(order_minhash.order_minhash(F.col("a")), order_minhash.order_minhash(F.col("b"))).alias("l")).collect()}
    assert max(got.values()) < 0.25


def test_neighbours_and_edited_texts(spark):
    texts = {3: "one two three four five six", 10: None, 11: "", 40: "🙂é alpha beta gamma delta epsilon", 77: "z" * 50}
    rows = [(i, t, "s") for i, t in texts.items()] + [(None, "free of id", "s"), (3, texts[3], "s")]
    got = {r.doc_id: r for r in order_minhash.compare_neighbours(docs_of(spark, rows).repartition(4)).collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        t, following = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
    plain = dict(zip(ids, plain_sketches(spark, [texts[i] for i in ids]), strict=True))
    halves = {i: (texts[i] or "")[: len(texts[i] or "") - len(texts[i] or "") // 2] + (texts[ids[(k + 1) % len(ids)]] or "")[: len(texts[i] or "") // 2] for k, i in enumerate(ids)}
    edited = dict(zip(ids, plain_sketches(spark, [halves[i] for i in ids]), strict=True))
    for k, i in enumerate(ids):
        assert got[i].near_edited == plain_likeness(plain[i], edited[i]) and got[i].near_next == plain_likeness(plain[i], plain[ids[(k + 1) % len(ids)]])
        assert len(got[i].fingerprint) == 8 * len(plain[i]) and len(got[i].edited_fingerprint) == 8 * len(edited[i])
    assert got[None].near_next is None and got[None].near_edited == 1.0 and got[10].fingerprint == got[11].fingerprint == ""
    assert order_minhash.compare_neighbours(docs_of(spark, rows)).count() == 7
