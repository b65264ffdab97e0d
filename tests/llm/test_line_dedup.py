import random

from ferrowick.llm.line_dedup import SPACE, dedup_lines


def without_lines(text, cut):
    kept, n, any_left = [], 0, False
    for line in text.split("\n"):
        if line.strip(SPACE):
            n += 1
            if n - 1 in cut:
                continue
            any_left = True
        kept.append(line)
    return "\n".join(kept) if any_left else ""


def brute(rows, min_words):
    """Every run with an earlier copy and min_words words, by comparing all pairs of places."""
    docs = [[x.strip(SPACE) for x in (t or "").split("\n") if x.strip(SPACE)] for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    places = [(d, p) for d in order for p in range(len(docs[d]))]
    cuts = [set() for _ in rows]
    for b, (d, p) in enumerate(places):
        best = 0
        for e, q in places[:b]:
            n = 0
            while p + n < len(docs[d]) and q + n < len(docs[e]) and docs[d][p + n] == docs[e][q + n]:
                n += 1
            best = max(best, n)
        if sum(len(x.split()) for x in docs[d][p : p + best]) >= min_words:
            cuts[d] |= set(range(p, p + best))
    return [(k, None if t is None else without_lines(t, c) if c else t, len(c)) for (k, t), c in zip(rows, cuts)]


def check(spark, rows, min_words):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in dedup_lines(df.coalesce(1), min_words=min_words).collect()]
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted(got, key=key) == sorted(brute(rows, min_words), key=key)


def test_random_runs_match_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        lines = [rng.choice(["a", "b", "c d", " c d ", "", "e f g h i j k l"]) for _ in range(rng.randint(0, 9))]
        rows.append((rng.choice([i, i, 3, None]) if i > 3 else i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), rows[5], rows[5]]
    check(spark, rows, 5)


def test_long_passage_is_cut_once_and_short_lines_stay(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"one\n{passage}\nthree"), (2, f"{passage}\nfour"), (3, "one\nthree"), (4, passage)]
    check(spark, rows, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(df).collect()} == {1: rows[0][1], 2: "four", 3: "one\nthree", 4: ""}


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lines_cut int, _rid int, pos int")
    out = dedup_lines(df)
    assert out.count() == 0 and out.columns == [*df.columns, "_lines_cut"]
