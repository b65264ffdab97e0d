import random

import corpus_pipeline as P
import pytest

from tests.llm.test_jaccard_join import shingles
from tests.llm.test_line_dedup import brute as brute_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnr"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passage, leak = prose(55), "Tom has 5 boxes and gives 3 of them to every child that walks by the old red house"
    docs = []
    for i in range(60):
        t = "\n".join(prose(rng.randint(9, 40)) for _ in range(rng.randint(1, 4)))
        if i == 4:
            t = prose(150)
        if i % 7 == 1:
            t += "\n" + passage
        if i % 11 == 2:
            t += " " + leak.replace("5", str(i)) + " " + prose(5)
        if i % 5 == 3:
            t = " ".join(w + "!!" for w in t.upper().split(" "))
        docs.append((i, t, "en", "s", len(t)))
    w = docs[4][1].replace("\n", " ").split()
    docs += [(100 + k, " ".join([*w[:k], *w[k + 1 :]]), "en", "s", 1) for k in (0, 3)] + [(200, docs[6][1], "en", "s", 2)]
    docs += [(None, prose(20), None, None, None), (300, None, "en", None, 0), (301, "", None, "s", None), docs[8], docs[8]]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, SCHEMA).coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 3), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_each_stage_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = P.quality(spark, docs, tables)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not {i for i in range(60) if i % 5 == 3} & ids and {i for i in range(60) if i % 5 != 3} <= ids
    kept = spark.createDataFrame(kept.collect(), SCHEMA).coalesce(1)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    lines = P.lines(spark, kept, tables)
    want = [(k, t) for k, t, cut in brute_lines(rows, 8) if not cut or t]
    got = lines.collect()
    assert lines.columns == docs.columns and sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    near = P.near_copies(spark, docs, tables).collect()
    by = {}
    for r in docs.collect():
        by.setdefault((r.doc_id is None, r.doc_id or 0), []).append(r)
    kept_sets = [shingles(r.text, 5) for r in near]
    assert all(not a or not b or 100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(kept_sets) for b in kept_sets[:i])
    assert {100, 103, 200} & {r.doc_id for r in near} == set() and sum(r.doc_id == 8 for r in near) == 1 and {300, 301, 4, 6} <= {r.doc_id for r in near}
    clean = P.leaks(spark, docs, tables).collect()
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean} == {i for i in range(60) if i % 11 == 2}


def test_run_packs_what_is_left(spark, tables):
    out = P.run(spark, tables).collect()
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_copies", "leaks", "packing"]
    docs = {r.doc_id for r in out}
    assert not docs & {100, 103, 200, 3, 2} and {4, 6, 7, None} <= docs
    total = {}
    for r in out:
        total.setdefault((r.doc_id, r.doc_tokens), []).append(r.length)
    assert all(sum(v) % k[1] == 0 for k, v in total.items())


def test_two_pipelines_and_other_queries_do_not_disturb_each_other(spark, tables, tmp_path):
    """Stages of two pipelines in turn, results of other queries in between, each used after the other's next stage."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    other = P.dedup_lines(docs)
    a, b = docs, docs
    for k, (name, stage) in enumerate(P.STAGES):
        x, y = stage(spark, a, tables), stage(spark, b, tables)
        if k + 1 == len(P.STAGES):
            assert x.count() == y.count() > 0
            break
        x.write.parquet(f"{tmp_path}/a{name}")
        a = spark.read.parquet(f"{tmp_path}/a{name}")
        y.write.parquet(f"{tmp_path}/b{name}")
        b = spark.read.parquet(f"{tmp_path}/b{name}")
        assert a.count() == b.count()
    assert other.count() == docs.count()


def test_empty_and_clashing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    odd = docs.selectExpr("*", "1 as _rid", "2 as lines_cut", "3 as score", "4 as k", "5 as f1", "6 as n").limit(12)
    for frame in (docs.limit(0), odd):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, frame, tables)
            assert out.columns == frame.columns and out.count() <= frame.count()
        assert P.packing(spark, frame, tables).count() >= 0


def test_run_gives_the_ids_of_whole_sequences(spark, tables):
    import zlib

    import numpy as np

    out = P.run(spark, tables).collect()
    assert out and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    at = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + len(r.ids)
    assert all(at[r.sequence_id] == r.sequence_tokens for r in out)
