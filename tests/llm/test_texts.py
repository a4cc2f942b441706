"""Personal data, URL rules, language, tokenizers and packing."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tintype.llm import byte_bpe, kneser_ney, language, packing, pii, queries, url_rules

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 0 or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 14 <= len(digits) <= 19 and pii._luhn(digits)) or (k == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(30_000):
        t = "".join(rng.choice("ab1230 .-@+()%é\n") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("4111 1111-1111 1111 a.b@c.de +1 (212) 555-0199") == [(0, 2, 19), (20, 0, 28), (29, 3, 46)]
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def test_columns_of_the_personal_data_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op2_personal_data(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(docs) == len(got) and any(len({k for _, k, _ in plain_spans(d.text or "")}) > 1 for d in docs)
    for d in docs:
        r, base = got[d.doc_id], plain_spans(d.text or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, x, _ in base) for k in range(4)]
        shown = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest() and not set(shown) - set(r.spans.split(","))


def test_contexts_find_unseen_identifiers_and_spare_others(spark):
    rows = [(i, f"please call me at: +1 212 555 {1000 + i} today") for i in range(12)]
    rows += [(100 + i, f"please call me at: 212 555 {2000 + i} today") for i in range(2)]  # no plus sign
    rows += [(200, "room 212 555 3000 is free"), (201, None), (202, ""), (None, "call me at: 212 555 4000 today"), (203, "please call me at: someone today"), (0, rows[0][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, base string, more int")
    got = [(r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in pii.find_personal_data(df).collect()]
    assert len(got) == len(rows)
    spans = {i: s for i, _, s in got}
    assert spans[100] == [(19, 3, 31)] == spans[101] and spans[None] == [(12, 3, 24)]
    assert spans[200] == spans[201] == spans[202] == spans[203] == [] and all(len(spans[i]) == 1 for i in range(12))
    masked = pii.mask_personal_data(df)
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert masked.columns == df.columns and texts[3] == texts[100] == "please call me at: <PHONE> today" and texts[201] is None
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_found_identifiers_induce_contexts_until_nothing_is_new(spark):
    rows = [f"call me at: +1 212 555 {1000 + i} today" for i in range(60)]
    rows += [f"{w} 212 555 {2000 + i} {end}" for i in range(30) for w, end in (("call me at:", "today"), ("fax number is", "again"))]
    rows += [f"{w} 212 555 {3000 + i} {end}" for i in range(8) for w, end in (("fax number is", "again"), ("ring us under", "daily"))]
    rows.append("ring us under 212 555 7777 daily")  # two contexts from the last seed
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    masked = {r.doc_id: r.text for r in pii.mask_personal_data(df).collect()}
    assert masked[len(rows) - 1] == "ring us under <PHONE> daily"


def plain_discovery(texts):
    """Spans that dictionaries give by the same rounds: {(text number, start, kind, end)}, outer ones only."""
    seen = [(t, m) for t, text in enumerate(texts) for m in pii.mentions(text, pii.base_spans(text))]
    pairs = {(m[4], m[5], m[2], m[3], p) for _, m in seen for p in m[6]}
    sizes = defaultdict(set)
    for _, grp, _, _, p in pairs:
        sizes[p].add(grp)
    seeds = {(i, k): 1.0 for i, _, k, _, _ in pairs if k >= 0}
    accepted, found = dict(seeds), {}
    while True:
        chains = {}
        for (i, of), w in accepted.items():
            for j, grp, _, _, p in pairs:
                if i == j:
                    chains[p, of, grp] = max(chains.get((p, of, grp), (0, 0)), (w, i))
        support = defaultdict(list)
        for (p, of, _), best in chains.items():
            support[p, of].append(best)
        scores = {k: sum(w for w, _ in v) / (len(sizes[k[0]]) + 1) for k, v in support.items() if len({i for _, i in v}) >= 3}
        patterns = {k: v for k, v in scores.items() if v >= 0.6}
        miss = defaultdict(lambda: 1.0)
        for p, i, of in {(p, i, of) for i, _, k, forms, p in pairs if k < 0 for of in range(4) if forms >> of & 1}:
            if (p, of) in patterns:
                miss[i, of] *= 1 - patterns[p, of]
        last, found = found, {k: 1 - v for k, v in miss.items() if 1 - v >= 0.6}
        if found.keys() == last.keys() and all(abs(found[k] - last[k]) < 1e-9 for k in found):
            break
        accepted = {k: max(seeds.get(k, 0), found.get(k, 0)) for k in seeds.keys() | found.keys()}
    kind = {}
    for (i, of), w in found.items():
        kind[i] = max(kind.get(i, (0, 0)), (w, -of))
    spans = {(t, m[0], -kind[m[4]][1], m[1]) for t, m in seen if m[2] < 0 and m[4] in kind and any((p, -kind[m[4]][1]) in patterns for p in m[6])}
    return {x for x in spans if not any(y[0] == x[0] and y != x and y[1] <= x[1] and x[3] <= y[3] for y in spans)}


def planted_identifiers(rng):
    """Texts, and the (text, identifier) pairs that only their contexts give away."""
    plain = lambda: " ".join(rng.choice(["stone", "river", "walks", "green", "under", "table"]) for _ in range(rng.randrange(3, 9)))
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))

    def card():
        digits = number(15)
        return next(digits + c for c in "0123456789" if pii._luhn(digits + c))

    known = [lambda: f"write to {number(3)}.x@mail.example.com please", lambda: f"from host {rng.randrange(256)}.{rng.randrange(256)}.7.9 today", lambda: f"paid by card: {card()} ok", lambda: f"ring us at +49 {number(9)} soon"]
    hidden = [lambda: f"user{number(4)}@localnet", lambda: f"fe80::{number(2)}:{number(3)}:{number(2)}", lambda: number(12), lambda: number(10)]
    forms = ["write to {} please", "from host {} today", "paid by card: {} ok", "ring us at {} soon"]
    texts = [f"{plain()} {known[i % 4]()} {plain()}" for i in range(160)]
    wanted = []
    for i in range(24):
        x = hidden[i % 4]()
        wanted.append((len(texts), x))
        texts.append(f"{plain()} {forms[i % 4].format(x)} {plain()}")
    texts += [f"{plain()} {number(rng.choice([7, 10, 12]))} {plain()} a@b {plain()}" for _ in range(60)]
    return texts, wanted


def test_discovery_equals_dictionaries_and_finds_what_is_planted(spark):
    texts, wanted = planted_identifiers(random.Random(11))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, s.start, s.kind, s.end) for r in pii.find_personal_data(df).collect() for s in r.spans if tuple(s) not in {tuple(b) for b in r.base}}
    assert got == plain_discovery(texts)
    shown = {(t, texts[t][s:e]) for t, s, _, e in got}
    assert all(any(t == u and x in y for u, y in shown) for t, x in wanted)
    assert len(shown - set(wanted)) <= 0.1 * len(wanted)


def test_contexts_are_of_whole_words():
    q = "q" * 100
    one, two = (pii.mentions(f"{w} {q} 5551000", [])[0][6] for w in "ab")
    assert one[0] != two[0] and one[1] == two[1]
    assert pii.mentions("u" * 300 + "@host is far away", []) and len(pii.mentions("9 " * 50_000 + "x@y.zz", pii.base_spans("9 " * 50_000 + "x@y.zz"))) > 50_000


def test_every_token_and_run_of_numbers_is_a_candidate():
    def offered(t):
        return {t[s:e] for s, e, kind, *_ in pii.mentions(t, pii.base_spans(t)) if kind < 0}

    assert offered("card 7536784127813050 4845168114407329 end") == {"7536784127813050", "4845168114407329"}
    assert {"212 555 1000", "555 1000"} == offered("tel 212 555 1000 4111111111111111 x") - {"4111111111111111"}
    assert "5551000" in offered("9" * 300 + " 5551000")


def test_chains_equal_one_pattern():
    """The scan by tokens gives what one backtracking pattern of the same chains gives, on texts short enough for it."""
    chain = re.compile(r"[^\s]*[0-9@][^\s]*(?: [().0-9-]*[0-9][().0-9-]*(?!\S))*")
    rng = random.Random(12)
    for _ in range(20_000):
        t = "".join(rng.choice("ab1 2@.-() \n\x85é+") for _ in range(rng.randrange(40)))
        assert list(pii.chains(t)) == [m.span() for m in chain.finditer(t)], t


def test_long_tokens_cost_no_more_than_their_length():
    n = 1 << 20
    texts = ["q" * n + " 1", "中" * n + "1" + "文" * n, "7" * n + "a", "7" * n, "7-" * n, "a@" * (n // 2), "x@y.zz" * (n // 6), "1." * (n // 2), "+" * n + "1", "((" * n + "1 23", "A1b2+/" * (n // 6) + "==", "+1 " + "(" * n]
    for t in texts:
        began = time.process_time()
        found = pii.mentions(t, pii.base_spans(t))
        assert time.process_time() - began < 2 + 2e-4 * len(found), t[:12]


def test_short_identifiers_are_candidates():
    assert [x[:4] for x in pii.mentions("to a@b now", [])] == [(3, 6, -1, 1)] and [x[:4] for x in pii.mentions("at 1::2 now", [])] == [(3, 7, -1, 2)]


def test_masks_overlapping_spans_once():
    assert pii.masked_text("x 1234 y", [(2, 2, 6), (3, 3, 5)]) == "x <CARD> y" and pii.masked_text("ab", []) == "ab"


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("deep.org/a/b", "block"), ("deep.org/a/b", "allow"), ("host", "block"), ("x.host/", "allow")]


def plain_rule(host, path):
    fits = []
    for rule, verdict in RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((h.count(".") + 1, len(slash + p), verdict == "block", rule, verdict))
    return max(fits)[3:] if fits else (None, "allow")


def test_urls_equal_a_scan_of_the_rules(spark, monkeypatch):
    rng = random.Random(3)
    urls = [None, "", "no scheme", "http://", "https://A.NET", "http://net/", "http://net?x/", "http://x.example.net/en/1#a?b", "a://b://c.net/d", "http://xnet/", "http://deep.org/a/bc", "http://deep.org/a/b/", "http://host", "http://y.x.host/", "http://ÄNET.net/"]
    for _ in range(3000):
        host = ".".join(rng.choice(["net", "org", "com", "example", "deep", "host", "x", ""]) for _ in range(rng.randint(1, 4)))
        urls.append(f"http://{host}" + "".join(rng.choice(["/", "/en", "/de/", "/fr/", "/a", "/b", "?q", "#f"]) for _ in range(rng.randrange(5))))
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_rules.judge_urls(df, RULES).collect()}
    assert len(got) == len(urls)
    monkeypatch.setattr(url_rules, "MAX_RULES", 3)  # as by a join
    assert {r.page_id: r for r in url_rules.judge_urls(df, RULES).collect()} == got
    for i, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        assert (got[i].host, got[i].path) == (host, path) and (got[i].rule, got[i].verdict) == plain_rule(host, path), u
    with pytest.raises(ValueError):
        url_rules.UrlTrie([("a/", "maybe")])
    assert url_rules.judge_urls(df.limit(0), RULES).count() == 0
    long = "http://a.net/" + "x/" * 100_000
    assert url_rules.judge_urls(spark.createDataFrame([(1, long), (1, long), (None, long)], "page_id long, url string"), RULES).where("verdict = 'block'").count() == 3


def test_many_rules_of_one_host_cost_no_scan():
    trie = url_rules.UrlTrie([(f"host.org/p{i}", "block") for i in range(200_000)] + [("host.org/p12345", "allow"), ("host.org/p1234567", "allow")])
    assert trie.match("host.org", "/p123456") == ("host.org/p123456", "block") and trie.match("host.org", "/p123456789") == ("host.org/p1234567", "allow")
    assert trie.match("host.org", "/q") is None and trie.match("host.org", "/p12345")[1] == "block"
    began = time.process_time()
    for i in range(2000):
        trie.match("www.host.org", f"/p{i * 97}x/y")
    assert (time.process_time() - began) / 2000 < 1e-4


@pytest.fixture(scope="module")
def json_file():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def ranks_file():
    return byte_bpe.tokenizer_of_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def odd_texts(n):
    rng = random.Random(2)
    alphabet = list("abé ßñ.,  \n\n\t'stre12!?<|>中🙂‍́ŁŞ\r\x1c\x85 ")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]
    texts += ["".join(chr(rng.randrange(32, 0x3000)) if rng.random() < 0.5 else " " for _ in range(20)) for _ in range(n // 5)]
    return [*texts, "<|endoftext|> a <|endoftext|>", "don't it's we're  x", "", " ", "\n", " \n", "a \n b", "a\n b", "x.\ny,\nz. ", "word " * 3000, "unbroken" * 3000]


def test_ids_equal_the_libraries(json_file, ranks_file):
    texts = odd_texts(8000)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_str(json_file)
    table = byte_bpe.ByteTable(ranks_file)
    a, b = byte_bpe.PieceEncoder(ranks_file, store_bytes=200_000), byte_bpe.PieceEncoder(json_file)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for t, x, y, z in zip(part, a.encode(part), b.encode(part), whole.encode_batch_fast(part, add_special_tokens=False), strict=True):
            ids = np.frombuffer(x, "<u4").tolist()
            assert ids == reference.encode_ordinary(t) and table.decode(ids) == t
            assert np.frombuffer(y, "<u4").tolist() == z.ids
            starts, ends = table.offsets(ids)
            assert all(t[s:e].encode().find(table.bytes[i].strip(b"\x80")) >= 0 or e - s == 1 for i, s, e in zip(ids, starts, ends, strict=True) if e > s)
            assert not ids or (starts[0], ends[-1]) == (0, len(t))


def test_added_tokens_are_taken_as_the_library_takes_them(json_file):
    own, library = byte_bpe.PieceEncoder(json_file), Tokenizer.from_str(json_file)
    texts = ["a <|endoftext|> b", "x  <|endoftext|>\n y", "<|endoftext|>", "a<|endoftext|><|endoftext|> \n\n b", "plain text", "", " <|endoftext|>"]
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for batch in (texts, texts[4:6]):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(batch)] == [library.encode(t, add_special_tokens=False).ids for t in batch]


def test_store_is_bounded_and_holds_no_long_piece(json_file):
    rng = random.Random(3)
    own = byte_bpe.PieceEncoder(json_file, store_bytes=100_000)
    for _ in range(30):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(300)) + " " + "x" * 500 + " " + "中文" * 200
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == own.own.encode(text, add_special_tokens=False).ids
        assert sum(a.nbytes for a in (own.words, own.ids, *own.older)) < 150_000
        assert all(len(w.encode()) <= byte_bpe.LONGEST for w in own.words.to_pylist())


def test_encode_and_decode_tables(spark, ranks_file):
    df = spark.createDataFrame([(1, "a 🙂 b", "q"), (2, None, "q"), (None, "", "q"), (1, "a 🙂 b", "q")], "doc_id long, text string, ids string")
    encoded = byte_bpe.encode_documents(df, ranks_file)
    assert sorted((r.doc_id or 0, r.text) for r in byte_bpe.decode_documents(encoded, ranks_file).collect()) == [(0, ""), (1, "a 🙂 b"), (1, "a 🙂 b"), (2, "")]
    assert byte_bpe.round_trip(df, ranks_file).count() == 4 and byte_bpe.round_trip(df.limit(0), ranks_file).count() == 0


def plain_level(count, size, window):
    """The fill level that a loop over all levels chooses."""
    best = None
    for level in range(window - size + 1):
        if level and not count[level]:
            continue
        after = count.copy()
        if level:
            after[level] -= 1
        if level + size < window:
            after[level + size] += 1
        total = sum(int(c) ** 2 for c in after[1:window])
        if best is None or total <= best[0]:
            best = (total, level)
    return best[1]


def test_packer_chooses_by_sum_of_squares_and_loses_nothing():
    rng = random.Random(6)
    for window, most in ((16, 1000), (16, 5), (1024, 4096)):
        p, put = packing.Packer(7, window, most), {}
        for doc in range(400):
            n = rng.randrange(1, 3 * window if window < 100 else 2500)
            put[doc] = np.array([rng.randrange(1 << 32) for _ in range(n)], "<u4")
            if window == 16 and n % window:
                assert p.level_for(n % window) == plain_level(p.count, n % window, window)
            p.add(doc, put[doc].tobytes())
        p.close()
        back, sequences = defaultdict(dict), defaultdict(list)
        for doc, start, length, crc, total, sequence, offset, ids in p.rows:
            assert zlib.crc32(ids) == crc and len(ids) == 4 * length and total == len(put[doc])
            back[doc][start] = ids
            sequences[sequence].append((offset, length))
        assert all(b"".join(back[d][s] for s in sorted(back[d])) == put[d].tobytes() for d in put)
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= window and (at == window or at & (at - 1) == 0)


def test_only_the_fullest_window_is_closed_when_too_many_are_open():
    p = packing.Packer(0, 16, most_open=3)
    for doc, n in enumerate((15, 13, 11)):
        p.add(doc, bytes(4 * n))
    p.add(3, bytes(4 * 9))
    assert [(d, s, n) for d, s, n, *_ in p.rows] == [(0, 0, 15), (3, 0, 1)] and p.count.sum() == 3 and p.count[[8, 11, 13]].tolist() == [1, 1, 1]
    p.close()
    assert sum(r[2] for r in p.rows) == 48


def test_packing_of_a_table(spark, json_file):
    df = spark.createDataFrame([(1, "some words here", 1), (2, None, 1), (None, "", 1), (4, "long text " * 3000, 1), (1, "some words here", 1)], "doc_id long, text string, start int")
    rows = packing.pack_documents(df, json_file, with_ids=True).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 1 and sum(r.length for r in rows if r.doc_id is None) == 1
    assert all(len(r.ids) == r.length and r.doc_tokens >= r.start + r.length for r in rows)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and packing.pack_documents(df.limit(0), json_file).count() == 0


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None), (-1, "", "en"), (-2, "1234 !?", "de"), (-3, "²³", None)], "doc_id long, text string, lang string")
    both = docs.unionByName(extra, allowMissingColumns=True)
    got = language.identify(both, language.train(both)).join(both.select("doc_id", "lang", "text"), "doc_id")
    held = got.where("held_out and doc_id >= 0")
    assert held.count() > 20 and held.where("lang_pred = lang").count() / held.count() > 0.95
    assert {r.lang_pred for r in got.where("doc_id < 0").collect()} == {"und"} and got.where("score < 0 or score > 1").count() == 0
    nothing = both.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(nothing, language.train(nothing)).collect()} == {"und"}


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(language, "ALL_LANGUAGES", 300)
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 40, f"l{i % 250:03d}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    x, y, names = language.training_windows(docs, "doc_id", "text", "lang", 1500, 2)
    held = {r.doc_id for r in docs.where(language.held_out(F.col("doc_id"))).collect()}
    assert set(names) == {c for i, _, c in rows if i not in held} and len(names) == 250 and len(x) == len(y)
    monkeypatch.setattr(language, "MOST_LANGUAGES", 100)
    with pytest.raises(ValueError):
        language.training_windows(docs, "doc_id", "text", "lang", 1500, 2)


def test_identify_with_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(i, "abc def " * 9 if i % 2 else "xyz uvw " * 9, "en" if i % 2 else "de", "x", 1.0) for i in range(60)], "doc_id long, text string, lang string, lang_pred string, score double")
    model = language.train(docs)
    got = language.identify(docs, model)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got.collect())
    assert language.identify(docs.limit(0), model).count() == 0 and language.train(docs.limit(0)) is None


def test_convolution_and_gradient_equal_plain_loops():
    rng = np.random.default_rng(5)
    net = language.ByteCnn(["a", "b", "c"], seed=3)
    x, y = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8), np.array([2, 0, 1])
    pooled = net.pooled(x)
    for i in range(3):
        k = 0
        for table, width in zip(net.tables, language.WIDTHS, strict=True):
            for f in range(language.FILTERS):
                best = max(sum(float(table[j][x[i, at + j], f]) for j in range(width)) for at in range(language.WINDOW - width + 1))
                assert pooled[i, k] == pytest.approx(best, abs=1e-4)
                k += 1
    z = np.maximum(pooled + net.bias, 0) @ net.dense + net.offset
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert net.probabilities(x) == pytest.approx(p, rel=1e-4)

    def loss(model):
        return -np.log(model.probabilities(x)[np.arange(3), y]).astype(np.float64).mean()

    one, rate = language.ByteCnn(["a", "b", "c"], seed=3), 0.01
    one.train(x, y, epochs=1, batch=3, rate=rate)  # Adam's first step is the rate against the gradient's sign
    for name in ("bias", "dense", "offset"):
        before, after = getattr(net, name), getattr(one, name)
        for at in list(np.ndindex(before.shape))[:40:7]:
            step = 2e-2
            before[at] += step
            up = loss(net)
            before[at] -= 2 * step
            slope = (up - loss(net)) / (2 * step)
            before[at] += step
            if abs(slope) > 1e-3:
                assert np.sign(before[at] - after[at]) == np.sign(slope) and abs(before[at] - after[at]) == pytest.approx(rate, rel=0.05)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    net = language.ByteCnn(["a", "b"])
    x, y = rng.integers(0, 256, (6, language.WINDOW)).astype(np.uint8), np.array([0, 1] * 3)
    before = -np.log(net.probabilities(x)[np.arange(6), y]).mean()
    net.train(x, y, epochs=60, batch=6)
    assert -np.log(net.probabilities(x)[np.arange(6), y]).mean() < before / 10


def plain_model(texts):
    """Interpolated modified Kneser-Ney of order three, by dictionaries; returns the log probability of a text."""
    c3, c2, start = defaultdict(int), defaultdict(int), defaultdict(int)
    for t in texts:
        w = ["<s>", *t.lower().split(), "</s>"]
        for i in range(2, len(w)):
            c3[tuple(w[i - 2 : i + 1])] += 1
        start[w[0], w[1]] += 1
    for a, b, c in c3:
        c2[b, c] += 1
    c2 |= start
    c1 = defaultdict(int)
    for _, b in c2:
        c1[b] += 1

    def discount(table):
        n = [0] + [sum(v == k for v in table.values()) for k in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        return [0.0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1), k - 0.05) if n[k] and y else k / 2 for k in (1, 2, 3)]

    d1, d2, d3 = discount(c1), discount(c2), discount(c3)
    cut = lambda d, v: d[min(v, 3)]
    unknown = sum(cut(d1, v) for v in c1.values()) / sum(c1.values()) / (len(c1) + 1)

    def one(w):
        return (c1[w] - cut(d1, c1[w])) / sum(c1.values()) + unknown if w in c1 else unknown

    def above(table, d, context, word, lower):
        there = {k: v for k, v in table.items() if k[:-1] == context}
        if not there:
            return lower
        total, v = sum(there.values()), there.get((*context, word), 0)
        return (v - cut(d, v) if v else 0) / total + sum(cut(d, x) for x in there.values()) / total * lower

    def score(t):
        w = ["<s>", *(t or "").lower().split(), "</s>"]
        out = 0.0
        for i in range(1, len(w)):
            p = above(c2, d2, (w[i - 1],), w[i], one(w[i]))
            if i > 1:
                p = above(c3, d3, (w[i - 2], w[i - 1]), w[i], p)
            out += np.log(p)
        return out

    return score


def test_log_probabilities_equal_a_plain_model(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    asked = [*texts[:10], "a b zz c", None, "", "zz", "A B\tC", "a b zz c"]
    df = spark.createDataFrame([(i, t, "en", 1.0) for i, t in enumerate(asked)], "doc_id long, text string, lang string, weight double")
    score = plain_model(texts)
    for in_place in (1 << 16, 5):  # most n-grams in place, or most by the join
        monkeypatch.setattr(kneser_ney, "IN_PLACE", in_place)
        model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"))
        for r in kneser_ney.log_probabilities(df, *model).collect():
            assert r.logp == pytest.approx(score(asked[r.doc_id]), rel=1e-6), asked[r.doc_id]
            assert r.n_words == len((asked[r.doc_id] or "").split())


def test_ngrams_are_on_disk_a_slice_at_a_time(spark, monkeypatch):
    rng = random.Random(10)
    texts = [" ".join(f"{rng.choice('abc')}{rng.randrange(60)}" for _ in range(rng.randrange(1, 90))) for _ in range(100)]
    asked = [*texts[:20], *texts[:2], "a1 b2 zz c3", None, "", f"a\u00a0{'x' * 40} é"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(asked)], "doc_id long, text string, lang string")
    score, rows, write = plain_model(texts), [], kneser_ney.write_table
    monkeypatch.setattr(kneser_ney, "ONE_SLICE", 0, raising=False)
    monkeypatch.setattr(kneser_ney, "SLICES", 3, raising=False)
    monkeypatch.setattr(kneser_ney, "IN_PLACE", 30)
    monkeypatch.setattr(kneser_ney, "write_table", lambda table, name: rows.append((written := write(table, name)).count()) or written)
    for r in kneser_ney.log_probabilities(df, *kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"))).collect():
        assert r.logp == pytest.approx(score(asked[r.doc_id]), rel=1e-6), asked[r.doc_id]
    words = [["<s>", *t.split(), "</s>"] for t in texts]
    known = sum(len({tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)}) for n in (1, 2, 3))
    assert max(rows) < 0.75 * known


def test_ngrams_are_written_a_row_for_each_part(spark, monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(f"{rng.choice('abc')}{rng.randrange(60)}" for _ in range(rng.randrange(1, 90))) for _ in range(100)]
    asked = [*texts[:20], *texts[:20], "a1 b2 zz c3", None]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(asked)], "doc_id long, text string, lang string").repartition(3)
    score, rows, write = plain_model(texts), defaultdict(list), kneser_ney.write_table

    def counted(table, name):
        written = write(table, name)
        rows[name].append(written.count())
        return written

    for name, value in (("ONE_SLICE", 0), ("SLICES", 2), ("IN_PLACE", 40), ("BATCH", 300), ("PART", 500), ("LEAST_PARTS", 3), ("LOOKED_UP", 200), ("write_table", counted)):
        monkeypatch.setattr(kneser_ney, name, value, raising=False)
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    for r in kneser_ney.log_probabilities(df, *model).collect():
        assert r.logp == pytest.approx(score(asked[r.doc_id]), rel=1e-9), asked[r.doc_id]
        assert r.n_words == len((asked[r.doc_id] or "").split())
    assert len(rows["weights"]) == 2
    for name in set(rows) - {"training-texts", "words", "bigrams", "every", "sums", "scored"}:  # bigrams and words: a row for each pair of parts at most, as every
        assert max(rows[name]) <= sum(len(t) for t in texts) // 200 + 3, name
    assert max(rows["words"] + rows["bigrams"] + rows["every"]) < 1500  # of some 4000 n-grams


def test_words_are_split_at_every_space():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(13)
    odd = [c for c in chars if c.isspace()] + ["a", "é", "漢", "\U0001f600", "\u2010", "\u3001", "\u00c5", "xyz" * 9]
    texts = [f"a{c}b" for c in chars] + [None, "", " ", "\u3000", "\u3000a", "a\u00a0"] + ["".join(rng.choice(odd) for _ in range(rng.randrange(20))) for _ in range(3000)]
    batch = pa.array(["cut off", *texts], pa.string()).slice(1)
    split = pc.list_value_length(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(batch.slice(0, len(chars))))))
    x = kneser_ney.positions(batch)
    assert x["words"][: len(chars)].tolist() == split.to_pylist()
    words = [(t or "").lower().split() for t in texts[len(chars) :]]
    assert x["words"][len(chars) :].tolist() == [len(w) for w in words]
    got = x["u"][np.flatnonzero(np.isin(x["doc"], np.arange(len(chars), len(texts))) & ~x["last"] & (x["place"] > 0))]
    hashes = dict(zip([w for t in words for w in t], got.tolist(), strict=True))
    assert all(hashes[w] == g for w, g in zip([w for t in words for w in t], got.tolist(), strict=True)) and len(set(hashes.values())) == len(hashes)


def test_packed_rows_and_filter_lose_nothing():
    rng = np.random.default_rng(3)
    for n, parts in ((0, 3), (1, 3), (5000, 3), (5000, 70_000)):
        key, n_ = rng.integers(0, 1 << 64, n, dtype=np.uint64), np.arange(n)
        t = kneser_ney._dealt("key n weight", key, parts, key=key, n=n_)
        got = {}
        for i in range(len(t)):
            k, m, none = kneser_ney._values(t.slice(i, 1), "key n weight")
            assert len(k) == len(m) > 0 == len(none) and (kneser_ney._part(k, parts) == t["part"][i].as_py()).all()
            got |= dict(zip(m.tolist(), k.tolist(), strict=True))
        assert got == dict(zip(n_.tolist(), key.tolist(), strict=True))
    bits = np.concatenate([np.frombuffer(kneser_ney._bits(key[kneser_ney._part(key, 3) == k], k, 3).tobytes(), np.uint64) for k in range(3)])
    assert len(bits) == 1 << kneser_ney.WORD_BITS and kneser_ney._maybe(bits, key).all()
    assert kneser_ney._maybe(bits, rng.integers(0, 1 << 64, 100_000, dtype=np.uint64)).mean() < 0.001


def test_quality_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "a b", None), (None, None, "en"), (1, "a b", None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = kneser_ney.quality(docs, none).collect()
    assert len(got) == 3 and all(r.kept for r in got)
    assert kneser_ney.quality(docs.limit(0), none).count() == 0


def test_thresholds_and_verdicts_follow_trusted_text(spark, monkeypatch):
    rng = random.Random(12)
    words = {"en": "the cat sat on a mat and ran".split(), "fr": "le chat dort sur un tapis et part".split()}
    rows, labels = [], []
    for i in range(700):
        lang = "en" if i < 600 else "fr"
        bad = i % 10 == 0
        rows.append((i, " ".join(rng.choice(words[lang]) if not bad else f"zq{rng.randrange(9999)}" for _ in range(rng.randrange(5, 30))), lang, 0.5))
        if i % 3:
            labels.append((i, int(not bad), int(i % 50 == 1)))
    rows += [(900, None, "en", 0.5), (901, "", "en", 0.5), (902, " ".join(words["en"]) * 4000, "xx", 0.5), (5, rows[5][1], "en", 0.5)]
    labels += [(7, 0, 0), (None, 1, 0)]  # labelled twice, once as bad
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, threshold double")
    seen, train = [], kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda sample, text: seen.append({r.doc_id for r in sample.collect()}) or train(sample, text))
    got = kneser_ney.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), least_rows=100).collect()
    worst = defaultdict(lambda: (1, 0))
    for i, q, t in labels:
        worst[i] = min(worst[i][0], q), max(worst[i][1], t)
    trusted = {i for i, (q, t) in worst.items() if i is not None and q == 1 and t == 0}
    assert seen[0] <= trusted and 0.3 < len(seen[0]) / len(trusted) < 0.7
    held = [r for r in got if r.doc_id in trusted - seen[0] and r.n_words]
    score = plain_model([t for i, t, *_ in rows if i in seen[0]])
    for r in got:
        assert r.perplexity == pytest.approx(np.exp(-score(next(t for i, t, *_ in rows if i == r.doc_id)) / (r.n_words + 1)), rel=1e-5)
    for lang in ("en", "fr"):
        own = sorted(r.perplexity for r in held if r.lang == lang or lang == "fr")  # few held rows are French: they take the line of all
        line = {r.threshold for r in got if r.lang == lang}
        assert len(line) == 1 and min(line) == pytest.approx(1.05 * own[int(np.ceil(0.995 * len(own))) - 1], rel=1e-6)
    assert len(got) == len(rows) and all(r.kept == (r.perplexity <= r.threshold) for r in got)
    assert not any(r.kept for r in got if r.doc_id < 700 and r.doc_id % 10 == 0) and sum(r.kept for r in got if r.doc_id < 700) >= 620


def test_model_trains_on_a_share_of_all_trusted_documents(spark, monkeypatch):
    seen, train = [], kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda sample, text: seen.append(sample.count()) or train(sample, text))
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    labels = docs.where("doc_id < 7000").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert kneser_ney.quality(docs, labels).count() == 8000
    assert 0.45 * 7000 < seen[0] < 0.55 * 7000
