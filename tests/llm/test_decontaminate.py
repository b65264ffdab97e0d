import random
import re

from ferrowick.llm import decontaminate as D

ITEM = "Sara buys 12 apples for 3 kg and then meets Peter at the market where 40 people wait for 2 hours before noon"


def template(text):
    """The canonical words with their values, written anew over Python's regular expressions."""
    t = re.sub(r"((?<=[^\W_]\s)|(?<=[,;]\s))([A-ZÀ-Þ][a-zß-ÿ]+)", r"qqna\2", text or "").lower()
    t = re.sub(r"(?<=[0-9])[.,:/](?=[0-9])", "x", t)
    t = re.sub(r"([0-9][0-9x]*)", r" qqnu\1 ", t)
    t = re.sub(r"(qqnu[0-9x]+)\s+(" + "|".join(D.UNITS) + r")(?![^\W_])", r"\1 qqun\2", t)
    return re.findall(r"[^\W_]+", t)


def brute(docs, items):
    kind = lambda w: w[:4] if w.startswith("qq") else w
    found = set()
    for k, t in docs:
        d = template(t)
        for i, b in items:
            b = template(b)
            n = len(b) - D.WINDOW + 1
            if n < 1:
                continue
            regions = {}
            for p in range(len(d) - D.WINDOW + 1):
                for q in range(n):
                    x, y = d[p : p + D.WINDOW], b[q : q + D.WINDOW]
                    if sum(not w.startswith("qq") for w in y) >= D.LITERALS and list(map(kind, x)) == list(map(kind, y)):
                        regions.setdefault(p - q, set()).add(q)
            total = 0
            for shift, qs in regions.items():
                lo, hi = min(qs), max(qs) + D.WINDOW
                slots = {(y, x) for y, x in zip(b[lo:hi], d[lo + shift : hi + shift]) if y.startswith("qq") and y[:4] == x[:4]}
                if len({y for y, _ in slots}) == len(slots) == len({x for _, x in slots}):
                    total += len(qs)
            if total and total >= min(n, D.RUN - D.WINDOW + 1):
                found.add((k, i, total))
    return found


def got(spark, docs, items):
    out = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id, r.windows) for r in out.collect()}


def test_matches_brute_force(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    items = [(i, " ".join(rng.choice(words + ["12", "7 kg", "Anna"]) for _ in range(rng.randint(3, 40)))) for i in range(12)] + [(99, ITEM), (98, None), (97, "")]
    docs = []
    for k in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        if k % 2:
            b = rng.choice(items[:13])[1].split()
            a = rng.randint(0, 6)
            b = [w if rng.random() > 0.05 else rng.choice(words) for w in b[a:]]
            b = [rng.choice(["13", "99"]) if w == "12" and rng.random() < 0.3 else w for w in b]
            t += b + [rng.choice(words) for _ in range(10)]
        docs.append((k, " ".join(t)))
    docs += [(200, None), (201, ""), (None, ITEM), (202, ITEM), (202, ITEM)]
    want = brute(docs, items)
    assert len(want) > 10 and got(spark, docs, items) == want


def test_reparameterised_questions_and_consistent_slots(spark):
    other = ITEM.replace("12", "15").replace("3 kg", "9 km").replace("Peter", "Maria").replace("40", "77").replace("2 hours", "6 days")
    mixed = ITEM.replace("12", "40")  # two values of the item become one
    docs = [(1, "Before. " + other + ". After"), (2, mixed), (3, "nothing of that kind is said here at all, only prose"), (4, ITEM.upper())]
    out = {r.doc_id: r for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, ITEM)], "item_id long, text string")).collect()}
    assert 1 in out and not out[1].exact and 2 not in out and 3 not in out
    assert out[1].first_word == 1


def test_drop_keeps_all_else(spark):
    docs = spark.createDataFrame([(1, ITEM, 7), (2, "clean", 7), (None, None, 7), (2, "clean", 7)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in D.drop_contaminated(docs, bench).collect()) == ["2", "2", "None"]
    assert D.drop_contaminated(docs.limit(0), bench).count() == 0
    assert D.drop_contaminated(docs, bench.limit(0)).count() == 4


def test_plan_runs_no_python(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    plan = D.contaminated(docs, docs.selectExpr("doc_id item_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_items_with_few_literal_words_are_found_word_for_word(spark):
    items = [
        (1, "Which River Flows Through Both The City Of Vienna And The City Of Budapest"), (2, "Anna has 5 kg, Peter 7 kg, Maria 9 kg; who has most of all?"),
        (3, "In welchem Jahr wurde der Vertrag zwischen Frankreich, Deutschland, Italien und Belgien unterzeichnet"), (4, "Who wrote the Old Testament?"), (5, "Yes"), (6, ITEM), (7, None), (8, "")]
    docs = [(i, f"Some words before. {t} And 3 words after it") for i, t in items[:6]]
    docs += [(11, items[0][1].lower()), (12, items[1][1].replace("7", "8")), (13, "who wrote the new testament?"), (14, "yes!"), (15, None), (16, ""), (None, items[3][1])]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in D.contaminated(docs, items, whole=True).collect()}
    assert set(out) == {(1, 1), (2, 2), (3, 3), (4, 4), (6, 6), (11, 1), (14, 5), (None, 4)}
    assert (out[4, 4].windows, out[4, 4].first_word, out[4, 4].last_word) == (1, 3, 7)
    assert {r.doc_id for r in D.drop_contaminated(docs, items).collect()} == {5, 12, 13, 15, 16}


def test_clashing_slots_cut_a_region_and_leave_its_consistent_parts(spark):
    twice = "There are 12 red boxes on the left side of the hall and later another 12 blue boxes on the right side of it"
    swapped = "we met Anna then Anna met Paul then Paul met Anna here and so on"
    items = spark.createDataFrame([(9, ITEM), (8, twice), (7, swapped)], "item_id long, text string")
    docs = [(1, ITEM.replace("12", "40")), (2, twice.replace("12 blue", "13 blue")), (3, ITEM), (4, "we met Tom then Kim met Eva then Leo met Ian here and so on")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()} == {(3, 9)}
    out = {(r.doc_id, r.item_id): r for r in D.contaminated(docs, items, split=True).collect()}
    assert set(out) == {(1, 9), (2, 8), (3, 9)} and [out[k].exact for k in sorted(out)] == [False, False, True]
    assert {r.doc_id for r in D.drop_contaminated(docs, items).collect()} == {4}
