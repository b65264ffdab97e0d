import random

import numpy as np

from ferrowick.llm import jaccard_join as J


def shingles(t, k=4):
    w = (t or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if union and sets[i] and sets[j] and 100 * inter >= 85 * union:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted((str(k), len(sets[i]), str(least.get(find(i)) if sets[i] else k)) for i, (k, _) in enumerate(rows))


def corpus(seed, groups, size, edits):
    rng, rows = random.Random(seed), []
    passage = [rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(25)]
    for g in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 120))]
        if g % 3 == 0:
            base += passage
        for _ in range(rng.choice([1, 2, size])):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.jaccard_components(df).collect())


def test_small_and_large_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "VOLUME", 1500)  # several blocks a group
    rows = corpus(1, 12, 30, 3) + [(None, "a b c d e"), (None, "A  b\tc d e"), (5000, None), (5001, ""), (5002, "one two"), (5003, "One two"), (5004, "one two three four"), (5004, "one two three four")]
    assert got(spark, rows) == brute(rows)


def test_group_pairs_agree_with_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.choice(1 << 40, 80, replace=False).astype(np.uint64)
    make = lambda: np.unique(np.concatenate([base[rng.random(80) > 0.06], rng.integers(0, 1 << 40, 3).astype(np.uint64)]))
    a, b = [make() for _ in range(40)], [make() for _ in range(40)]
    pack = lambda s, o: (np.arange(len(s)) + o, np.array([len(x) for x in s]), np.concatenate(s))
    x, y = J.group_pair_links(pack(a, 0), pack(b, 100), False, 85)
    truth = {(i, j + 100) for i, p in enumerate(a) for j, q in enumerate(b) if 100 * len(np.intersect1d(p, q)) >= 85 * len(np.union1d(p, q))}
    assert truth and set(zip(x.tolist(), y.tolist())) <= truth

    def parts(links):
        r = {i: i for i in [*range(40), *range(100, 140)]}
        f = lambda v: v if r[v] == v else f(r[v])
        for u, v in links:
            r[f(u)] = f(v)
        return {frozenset(k for k in r if f(k) == f(i)) for i in r}

    assert parts(truth) == parts(zip(x.tolist(), y.tolist()))


def test_empty(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string, n int, f1 int")).count() == 0


def test_similar_sets_have_a_part_and_their_sketches_allow_the_link():
    rng = np.random.default_rng(3)
    for percent in (85, 80):
        band = lambda s: int(np.floor(np.log(len(s)) / (np.log(100 / percent) * (1 + 1e-9))))
        for n in [*range(1, 30), 60, 150, 700]:
            for _ in range(8):
                x = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
                gone = int(rng.integers(0, len(x) * (100 - percent) // 100 + 1))
                new = max(0, (100 * (len(x) - gone)) // percent - len(x))  # as different as a link allows
                y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 1 << 48, new).astype(np.uint64)]))
                assert 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))
                assert np.intersect1d(J.part_names(x, band(x), percent), J.part_names(y, band(y), percent)).size
                assert J.may_link([J.sketch(x)], np.array([len(x)]), [J.sketch(y)], np.array([len(y)]), percent).all()


def test_sets_that_no_deal_suits_are_still_paired(monkeypatch):
    monkeypatch.setattr(J, "DEALS", 0)
    x = np.arange(9, dtype=np.uint64)
    assert np.intersect1d(J.part_names(x, 13, 85), J.part_names(x[1:], 12, 85)).size


def test_level_tables_grow_with_the_repeated_tokens(spark, monkeypatch):
    from ferrowick.llm.common import Workspace

    monkeypatch.setattr(J, "BITS", (10, 29))
    tokens = np.random.default_rng(5).choice(1 << 38, 30_000, replace=False)
    often, twice, once = tokens[:100], tokens[100:10_000], tokens[10_000:]
    rows = [(k, k, np.concatenate([often, twice if k < 2 else [], once[k * 2000 : k * 2000 + 2000]]).astype(int).tolist()) for k in range(10)]
    levels = J.level_table(Workspace(spark, "levels"), spark.createDataFrame(rows, "f1 long, f2 long, region array<long>"))
    of = lambda t: levels.of(np.asarray(t).astype(np.uint64))
    assert (of(often) >= 2).all() and (of(twice) >= 1).all()
    assert (of(twice) == 1).mean() > 0.9 and (of(once) == 0).mean() > 0.7


def test_groups_that_share_passages_only_are_not_opened(spark, monkeypatch):
    from ferrowick.llm.common import Workspace

    rng = random.Random(8)
    passages = [[f"p{k}w{i}" for i in range(25)] for k in range(40)]
    rows = [(k, " ".join(w for p in rng.sample(passages, 6) for w in p)) for k in range(150)]
    rows += [(150 + k, rows[k][1] + " more") for k in range(5)]
    save, made = Workspace.save, {}

    def counted(ws, df, name, codec="zstd"):
        out = save(ws, df, name, codec)
        made[name] = out.count()
        return out

    monkeypatch.setattr(Workspace, "save", counted)
    assert got(spark, rows) == brute(rows)
    assert made["heavy"] >= 100 and made["grouppairs"] < 40


def test_parities_allow_all_links():
    rng = np.random.default_rng(6)
    for percent in (85, 80):
        for n in [*range(1, 20), 64, 65, 300, 700]:
            x = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
            gone = int(rng.integers(0, len(x) * (100 - percent) // 100 + 1))
            new = max(0, (100 * (len(x) - gone)) // percent - len(x))  # as different as a link allows
            y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 1 << 48, new).astype(np.uint64)]))
            assert 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))
            other = [np.unique(rng.integers(0, 1 << 48, n + 40).astype(np.uint64)) for _ in range(3)]
            groups = [[other[0], x], None, [other[1]], [y, other[2]], None]
            sizes = [np.array([len(s) for s in g or []], np.int64) for g in groups]
            found = {p for a, b in J.alike(sizes, [g and [J.parity(s) for s in g] for g in groups], percent) for p in np.broadcast(a, b)}
            assert {(0, 3), (0, 1), (1, 2), (1, 3), (0, 4), (1, 4), (2, 4), (3, 4)} <= found and all(a < b for a, b in found)
            assert n < 64 or not found & {(0, 2), (2, 3)}


def test_parities_are_compared_by_parts(monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 48, 90).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(90) > 0.08], rng.integers(0, 1 << 48, 3).astype(np.uint64)])) for _ in range(30)]
    pairs = lambda: {p for a, b in J.alike([np.array([len(s)]) for s in sets], [[J.parity(s)] for s in sets], 80) for p in np.broadcast(a, b)}
    whole = pairs()
    monkeypatch.setattr(J, "COMPARED", 100)
    assert whole and pairs() == whole


def test_texts_with_one_passage_in_common_are_not_paired(spark, monkeypatch):
    from ferrowick.llm.common import Workspace

    monkeypatch.setattr(J, "VOLUME", 200)  # a block for each set or two
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(90)]
    edited = lambda: [f"e{rng.randint(0, 99999)}" if rng.random() < 0.02 else w for w in passage]
    rows = [(k, " ".join(edited() + [f"o{k}w{i}" for i in range(40)])) for k in range(160)]
    rows += [(160 + k, rows[k][1] + " more") for k in range(5)]
    save, made = Workspace.save, {}

    def counted(ws, df, name, codec="zstd"):
        out = save(ws, df, name, codec)
        made[name] = out.count()
        return out

    monkeypatch.setattr(Workspace, "save", counted)
    assert got(spark, rows) == brute(rows)
    assert made["drawn"] < 200 and made["heavy"] >= 100
