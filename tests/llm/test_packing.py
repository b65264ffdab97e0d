import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ferrowick.llm.packing import MAX_LOSS, MAX_SEGMENTS, MAX_TOKENS, Packer, WordTokenizer, pack
from ferrowick.llm.queries import op5_vector_packing

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "..", "a.b,c", "(.x)", "It's. don't,we'll be", "ΣΑΣ Σ. İstanbul", "x_.y", "á.", "3.14,5 and 1,000.", "ﬀ.", "\x1c a.　b", " .", "é É. ÀÉ", "Ⅷ.x", "ª.º,", "word. " * 900, "Ein Straßenfest, größer.\nNeu!", "😀.a é."]
TEXTS += ["a <|endoftext|> b", "x<|StartOfText|>y <|startoftext|>"]


def test_ids_equal_the_library(spark):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = [e.ids for e in t.encode_batch(TEXTS, add_special_tokens=False)]
    assert [x.tolist() for x in WordTokenizer(PATH).encode(TEXTS)] == want
    assert [x.tolist() for x in WordTokenizer(PATH, most=0).encode(TEXTS)] == want


def test_special_tokens_are_text_unless_asked_for():
    t = Tokenizer.from_file(PATH)
    want = [e.ids for e in t.encode_batch(TEXTS, add_special_tokens=False)]
    got = [x.tolist() for x in WordTokenizer(PATH, special=True).encode(TEXTS)]
    assert got == want and 49407 in want[-2] and 49407 not in WordTokenizer(PATH).encode(TEXTS[-2:])[0]


def test_every_limit_of_the_query_binds(spark):
    """At sf0.01 some sequence reaches each of the three limits, none passes one, and nothing is lost."""
    out = op5_vector_packing(spark, SF).collect()
    seqs = {}
    for r in out:
        s = seqs.setdefault(r.sequence_id, [r.sequence_tokens, r.sequence_segments, r.sequence_loss, 0, 0, 0])
        s[3:] = [s[3] + r.length, s[4] + 1, s[5] + r.loss_tokens]
    limits = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS)
    for k in range(3):
        assert max(s[k] for s in seqs.values()) == limits[k] and all(s[k] == s[k + 3] for s in seqs.values())
    assert all(s[0] == 4096 or s[0] & (s[0] - 1) == 0 for s in seqs.values())
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for doc, got in {r.doc_id: r.doc_tokens for r in out[:200]}.items():
        assert got == len(t.encode(texts[doc], add_special_tokens=False).ids) + 1
    whole = {}
    for r in out:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert whole == {r.doc_id: r.doc_tokens for r in out} and len(whole) == len(texts)


def test_pieces_cover_every_id_once_and_sequences_need_no_padding(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (None, "no key"), (7, "again"), (7, "again"), (60, "long " * 20_000)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH).collect()
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = sorted(str(t.encode(x or "", add_special_tokens=False).ids + [2]) for _, x in rows)
    docs, seqs = {}, {}
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
        seqs.setdefault(r.sequence_id, []).append(r)
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in s])
        assert [r.offset for r in s] == [0, *ends[:-1].tolist()] and s[0].sequence_tokens == ends[-1]
        assert ends[-1] == 4096 or (ends[-1] < 4096 and ends[-1] & (ends[-1] - 1) == 0)
    got = []
    for p in docs.values():
        p.sort(key=lambda r: r.start)
        n = sum(r.start == 0 for r in p)  # rows that are equal
        for k in range(n):
            got.append(str([i for r in p[k::n] for i in r.ids]))
    assert sorted(got) == want


def test_three_limits_hold_together():
    rng = np.random.default_rng(3)
    p = Packer(max_tokens=64, max_segments=3, max_loss=40, pool=16)
    seqs, sizes = [], []
    for i in range(300):
        n = int(rng.integers(1, 150))
        sizes.append((n, int(rng.integers(0, n + 1))))
        seqs += p.put(i, *sizes[-1])
    seqs += p.close()
    seen = [np.zeros(n, int) for n, _ in sizes]
    for s in seqs:
        assert sum(x[2] for x in s) <= 64 and len(s) <= 3
        assert sum(max(0, a + n - max(a, sizes[i][1])) for i, a, n in s) <= 40
        for i, a, n in s:
            seen[i][a : a + n] += 1
    assert all((x == 1).all() for x in seen)
    with pytest.raises(ValueError):
        Packer(max_tokens=0)


def test_prompts_bear_no_loss_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a question", "an answer"), (2, None, None)], "doc_id long, prompt string, text string")
    by = {r.doc_id: r for r in pack(df.coalesce(1), PATH, prompt="prompt").collect()}
    assert by[1].loss_tokens <= 3 and by[1].doc_tokens == 5 and by[2].doc_tokens == 1
    assert pack(df.limit(0), PATH).count() == 0
    assert pack(df.selectExpr("doc_id", "text", "1 as start", "2 as length"), PATH, with_ids=False).columns[0] == "doc_id"
