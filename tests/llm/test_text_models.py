import os
import random
import zlib

import numpy as np
import pytest

from ferrowick.llm import nnpu, subword


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(20, 80))
        junk, toxic = rng.random() < 0.3, rng.random() < 0.2
        if junk:
            w = rng.choice([[x + "$$$" for x in w], [x for x in w[:8] for _ in range(9)]])
        if toxic:
            w = w + rng.choices(["zztopo", "vexum"], k=2)
        docs.append((i, " ".join(w)))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(None, "abc def"), (n, None), (n + 1, ""), docs[3]]
    labels += [(None, 1, 1), (5000, 0, 1), (n, None, None)]
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k: (q, t) for k, q, t in labels}


@pytest.mark.parametrize("score,mod,rest,at", [(subword.score_quality, 5, 0, 0), (nnpu.score_toxicity, 4, 2, 1)])
def test_held_out_rows_are_told_apart(frames, score, mod, rest, at):
    docs, labels, truth = frames
    out = score(docs, labels).collect()
    assert len(out) == docs.count()
    right = total = 0
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % mod == rest)
        if r.held_out and r.doc_id < 400:
            right, total = right + (r.predicted == truth[r.doc_id][at]), total + 1
    assert total > 50 and right / total > 0.95
    blank = [r.score for r in out if r.doc_id in (400, 401)]
    assert blank[0] == blank[1]
    again = {(r.doc_id, r.score) for r in score(docs, labels).collect()}
    assert again == {(r.doc_id, r.score) for r in out}


def test_held_out_labels_do_not_matter(spark, frames):
    docs, labels, _ = frames
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) toxic")
    assert sorted(map(str, subword.score_quality(docs, labels).collect())) == sorted(map(str, subword.score_quality(docs, flipped).collect()))
    key = lambda d: sorted((str(r.doc_id), round(r.score, 9)) for r in d.collect())
    assert key(nnpu.score_toxicity(docs, labels, prior=0.2)) == key(nnpu.score_toxicity(docs, flipped, prior=0.2))


def test_no_labels_and_empty_tables(spark, frames):
    docs, labels, _ = frames
    none = labels.where("false")
    assert {r.score for r in subword.score_quality(docs, none).collect()} == {0.5}
    assert {r.score for r in nnpu.score_toxicity(docs, none).collect()} == {0.0}
    assert subword.score_quality(docs.where("false"), labels).count() == 0 == nnpu.score_toxicity(docs.where("false"), labels).count()
    assert subword.keep_quality(docs, none).count() == docs.count()


def test_keep_quality_agrees_with_scores(spark, frames):
    docs, labels, _ = frames
    extra = docs.selectExpr("*", "doc_id as score", "1 as predicted")
    kept = subword.keep_quality(extra, labels)
    assert kept.columns == extra.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in subword.score_quality(docs, labels).collect() if r.predicted)


def test_subword_hashes_equal_a_plain_loop():
    words = [b"a", b"abcde", "né".encode()]

    def slow(w):
        x = b"<" + w + b">"
        out = [int(subword._mix(np.array([zlib.crc32(w)], np.uint32))[0])]
        for n in range(subword.LOW, subword.HIGH + 1):
            for i in range(len(x) - n + 1):
                h = (x[i] + 1) & 0xFFFFFFFF
                for c in x[i + 1 : i + n]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                out.append(int(subword._mix(np.array([(h + n * 0x9E3779B1) & 0xFFFFFFFF], np.uint32))[0]))
        return sorted(f % (subword.BUCKETS - 1) + 1 for f in out)

    ids, feats = subword.subwords(words)
    assert [sorted(feats[ids == i].tolist()) for i in range(3)] == [slow(w) for w in words]


def test_toxicity_scores_equal_a_plain_loop(spark, frames):
    docs, labels, _ = frames
    model = nnpu.train_toxicity(docs, labels)
    weight = dict(zip(model.chosen.tolist(), model.weights.tolist(), strict=True))
    long = "zztopo " + "abcd efgh, " * 60_000
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9000, long), (9001, "x" * 200_000), (9002, "(ZZTOPO!) vexum")]
    df = spark.createDataFrame([(k, t, 1.0, "n") for k, t in rows], "doc_id long, text string, score double, _text string")
    got = sorted((str(r.doc_id), r.score) for r in nnpu.score_features(df, model).collect())

    def slow(t):
        seen = set()
        for w in (t or "").lower().encode().split():
            h = zlib.crc32(w.strip(nnpu.SIGNS))
            h ^= h >> 15
            h = h * 0x2C1B3C6D & 0xFFFFFFFF
            seen.add((h ^ h >> 12) % nnpu.BUCKETS)
        return 1 / (1 + np.exp(-(model.bias + sum(weight.get(b, 0) for b in sorted(seen)))))

    for (k, s), (k2, s2) in zip(got, sorted((str(k), slow(t)) for k, t in rows), strict=True):
        assert k == k2 and abs(s - s2) < 1e-9


def test_the_prior_is_estimated_from_two_samples():
    rng = random.Random(4)
    clean = lambda: " ".join(rng.choices([f"w{i}" for i in range(80)], k=20))
    bad = lambda: clean() + " " + " ".join(rng.sample([f"slur{i}" for i in range(12)], 3))
    m = nnpu.NonNegativePU()
    p, u = m._present([bad() for _ in range(300)]), m._present([bad() if rng.random() < 0.15 else clean() for _ in range(3000)])
    dp, du = (np.bincount(np.concatenate(x), minlength=m.buckets) / len(x) for x in (p, u))
    assert 0.1 < m.estimated_prior(dp, du, 300, 3000) < 0.2


def test_negative_labels_are_not_read(spark, frames):
    docs, labels, _ = frames
    key = lambda d: sorted((str(r.doc_id), r.score) for r in d.collect())
    assert key(nnpu.score_toxicity(docs, labels)) == key(nnpu.score_toxicity(docs, labels.where("toxic = 1")))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_labels_of_the_tables(spark):
    from ferrowick.llm import queries

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for query, label, least in ((queries.op7_subword_quality, "quality", 0.97), (queries.op9_nnpu_toxicity, "toxic", 0.93)):
        got = query(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").select("predicted", label).collect()
        assert sum(r[0] == r[1] for r in got) / len(got) >= least, label


def test_quality_fit_and_scores_equal_a_plain_loop(spark, frames):
    """A small model trained and applied feature by feature, without numpy's vectors."""
    docs, labels, _ = frames
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None][:30]
    y = [int(k % 2) for k, _ in rows]
    m = subword.SubwordModel(buckets=512, dim=4)
    embed, out, bias = m.embed.astype(float).tolist(), m.out.astype(float).tolist(), [0.0, 0.0]
    m.fit([t for _, t in rows], y, epochs=2)

    def units(t):
        words, found = (t or "").encode().split(), {}
        n = len(words) + sum(a == b for a, b in zip(words, words[1:]))
        for i, w in enumerate(words):
            ids, feats = subword.subwords([w], 512)
            for f in feats.tolist():
                found[f] = found.get(f, 0) + 1 / len(feats) / n
            if i and words[i - 1] == w:
                found[subword.REPEAT] = found.get(subword.REPEAT, 0) + 1 / n
        return found

    steps, step, rng = 2 * len(rows), 0, np.random.default_rng(7)
    for _ in range(2):
        for i in rng.permutation(len(rows)):
            lr = 1.0 * (1 - step / steps)
            step += 1
            f = units(rows[i][1])
            mean = [sum(w * embed[b][d] for b, w in f.items()) for d in range(4)]
            z = [sum(mean[d] * out[d][c] for d in range(4)) + bias[c] for c in range(2)]
            p = [float(np.exp(v - max(z))) for v in z]
            p = [v / sum(p) - (c == y[i]) for c, v in enumerate(p)]
            back = [sum(out[d][c] * p[c] for c in range(2)) for d in range(4)]
            for c in range(2):
                bias[c] -= lr * 0.2 * p[c]
                for d in range(4):
                    out[d][c] -= lr * 0.2 * mean[d] * p[c]
            size = len({*f, subword.REPEAT})
            for b, w in f.items():
                for d in range(4):
                    embed[b][d] -= lr * size**0.5 * w * back[d]
    table, shift = m.folded()
    got = subword.scorer(table, shift)([t for _, t in rows])
    for (_, t), s in zip(rows, got, strict=True):
        mean = [sum(w * embed[b][d] for b, w in units(t).items()) for d in range(4)]
        z = sum(mean[d] * (out[d][1] - out[d][0]) for d in range(4)) + bias[1] - bias[0]
        assert abs(1 / (1 + np.exp(-z)) - s) < 2e-3


def test_non_negative_risk_finds_unlabelled_positives():
    rng = random.Random(1)
    clean = lambda: " ".join(rng.choices([f"w{i}" for i in range(60)], k=20))
    bad = lambda: clean() + " slur" + rng.choice("ab")
    m = nnpu.NonNegativePU().fit([bad() for _ in range(150)], [bad() if rng.random() < 0.2 else clean() for _ in range(600)], 0.2)
    w = dict(zip(m.chosen.tolist(), m.weights, strict=True))
    score = lambda t: m.bias + sum(w.get(x, 0) for x in m._present([t])[0].tolist())
    assert min(score(bad()) for _ in range(50)) > max(score(clean()) for _ in range(50))
