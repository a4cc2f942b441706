"""The pipeline's stages, each held against a plain version of what it may keep."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tests.llm.test_native import counts
from tests.llm.test_pairs import classes, plain_fingerprint
from tests.llm.test_texts import plain_spans

from tintype.llm import byte_bpe, pii
from tintype.llm.line_quality import document_lines
from tintype.llm.queries import tokenizer_file
from tintype.plans.worktables import write_table


def plain_frequent(docs):
    """The places of frequent lines by document, when near-equal texts count once."""
    lines = document_lines(docs).withColumn("again", F.xxhash64("lk")).collect()
    minima = {}
    for r in lines:
        one, two = minima.get(r.th, (r.lk, r.again))
        minima[r.th] = min(one, r.lk), min(two, r.again)
    led = [{}, {}]
    for th, m in minima.items():
        for k in (0, 1):
            led[k][m[k]] = min(led[k].get(m[k], th), th)
    sets = defaultdict(set)
    for r in lines:
        sets[r.th].add(r.lk)
    close = lambda a, b: 2 * len(sets[a] & sets[b]) > max(len(sets[a]), len(sets[b]))
    of = {th: min(x for x in (th, led[0][m[0]], led[1][m[1]]) if close(th, x)) for th, m in minima.items()}
    hosts, held = defaultdict(set), defaultdict(set)
    for r in lines:
        hosts[r.hh].add(of[r.th])
        held[r.hh, r.lk].add(of[r.th])
    frequent = {lk for (hh, lk), c in held.items() if len(c) > 10 and (len(c) > 0.01 * len(hosts[hh]) or len(c) > 1000)}
    places = defaultdict(set)
    for r in lines:
        if r.lk in frequent:
            places[r.doc_id].add(r.pos)
    return places


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash", "personal data", "packing"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(write_table(stage(spark, tables[-1], sf_dir), name.replace(" ", "-")))
    assert all(t.columns == docs.columns and t.dtypes == docs.dtypes for t in tables[:5])
    start, ruled, lined, single, masked = ({r.doc_id: r for r in t.collect()} for t in tables[:5])

    places = plain_frequent(docs)
    for i, r in start.items():
        n, _, _, _, repeated = counts(r.text or "")
        cut = places.get(i, set())
        kept = [x for p, x in enumerate((r.text or "").split("\n")) if p not in cut]
        left = n - sum(len(x.split()) for p, x in enumerate((r.text or "").split("\n")) if p in cut)
        assert (i in ruled) == (not (n < 20 or 100 * repeated > 30 * n) and left >= 0.3 * n), i
        if i in ruled:
            assert ruled[i].text == "\n".join(kept) and ruled[i].n_chars == len(ruled[i].text)

    seen = set()
    for i in sorted(ruled):
        lines = [" ".join(x.lower().split()) for x in lined[i].text.split("\n")] if i in lined else []
        for x in lines:
            if len(x.split()) >= 5:
                assert x not in seen
                seen.add(x)
    assert {x for r in ruled.values() for x in (" ".join(y.lower().split()) for y in r.text.split("\n")) if len(x.split()) >= 5} >= seen

    ids = sorted(lined)
    prints = [plain_fingerprint(lined[i].text) for i in ids]
    component = classes(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert sorted(single) == sorted(ids[k] for k in set(component))

    spans = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.find_personal_data(tables[3]).collect()}
    for i, r in single.items():
        assert set(plain_spans(r.text)) <= set(spans[i])
        assert masked[i].text == pii.masked_text(r.text, spans[i]) and masked[i].n_chars == len(masked[i].text)

    pieces, own = defaultdict(dict), byte_bpe.PieceEncoder(tokenizer_file())
    for r in tables[5].collect():
        pieces[r.doc_id][r.start] = r.length
    for i, r in masked.items():
        n = len(np.frombuffer(own.encode([r.text])[0], "<u4")) + 1
        assert sum(pieces[i].values()) == n and all(s + length in pieces[i] or s + length == n for s, length in pieces[i].items())


def test_stages_take_nulls_repeats_extra_columns_and_no_rows(spark):
    body = lambda w: " ".join(w + chr(97 + i // 26) + chr(97 + i % 26) for i in range(40))
    rows = [(1, body("a")), (1, body("a")), (None, body("b")), (2, None), (3, ""), (4, body("c") + "\nmail: x@y.example.org end of it"), (4, body("d"))]
    df = spark.createDataFrame([(i, t, None, "s", None, 7, "k", "own", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, lk int, _key string, removed_lines string, more string")
    for table, many in ((df, [5, 5, 4, 4, 4]), (df.limit(0), [0] * 5)):
        for (name, stage), n in zip(corpus_pipeline.STAGES, many, strict=True):
            table = write_table(stage(spark, table, ""), "edge")
            if name == "packing":
                assert len({(r.doc_id, r.doc_tokens) for r in table.collect()}) == n
            else:
                assert table.columns == df.columns and table.count() == n, name
                assert {r.removed_lines for r in table.collect()} <= {"own"}
            if name == "personal data" and n:
                assert sorted((r.doc_id or 0, r.n_chars == len(r.text), "<EMAIL>" in r.text) for r in table.collect()) == [(0, True, False), (1, True, False), (4, True, False), (4, True, True)]


def test_run_leaves_no_work_tables_behind(spark, sf_dir):
    import os

    from tintype.plans.worktables import work_folder

    folder = work_folder(spark).removeprefix("file://") + "/tables"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 0 and {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"packing"}
