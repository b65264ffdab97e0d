import random

from ferrowick.llm.oracles import QUOTES
from ferrowick.llm.quotes import link_quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows, schema=SCHEMA):
    return {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame(rows, schema)).collect()}


def test_nested_quotes_link_across_conversations(spark):
    rows = [
        (1, 0, "user", "How do I bake bread?"),
        (1, 1, "assistant", "On Monday X wrote:\n> how do I bake   bread\nUse flour.\nAnd water."),
        (2, 5, "user", "> > How do I bake bread?\n> Use flour.\n> And water.\nThanks!"),
        (3, 0, "user", "> nothing anyone said\nHello"),
        (4, 0, "user", None), (None, None, None, ""),
    ]
    got = run(spark, rows)
    assert got[1, 1].text == "Use flour.\nAnd water." and (got[1, 1].parent_conv, got[1, 1].parent_turn, got[1, 1].depth) == (1, 0, 1)
    r = got[2, 5]
    assert r.text == "Thanks!" and (r.parent_conv, r.parent_turn, r.thread, r.depth, r.max_level, r.n_quotes) == (1, 1, 1, 2, 2, 2)
    assert r.sort_path == "1.0000000000/1.0000000001/2.0000000005"
    assert got[3, 0].parent_conv is None and got[3, 0].text == "Hello"
    assert got[4, 0].text == "" and got[None, None].depth == 0
    assert len(got) == 6


def test_ties_repeats_later_originals_and_empty(spark):
    rows = [(1, 0, "u", "> same words here\nx"), (1, 1, "u", "same words here"), (2, 0, "u", "same words here"), (2, 1, "a", "> Same words here!\ny"), (2, 1, "a", "> Same words here!\ny")]
    out = link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 5
    by = {(r.conv_id, r.turn): r for r in out}
    assert by[1, 0].parent_conv is None  # what it quotes is said later
    assert (by[2, 1].parent_conv, by[2, 1].parent_turn) == (2, 0)  # its own conversation first
    assert link_quotes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "u", "a", 5, 6)], SCHEMA + ", thread int, id int")
    assert link_quotes(df).columns == ["conv_id", "turn", "role", "text", "n_quotes", "max_level", "parent_conv", "parent_turn", "thread", "depth", "sort_path"]


def test_random_threads_match_sql(spark):
    import duckdb
    import pandas as pd

    rng, rows, said = random.Random(5), [], []
    for conv in range(25):
        for turn in range(rng.randint(1, 5)):
            lines = []
            for _ in range(rng.randint(0, 3)):
                if said and rng.random() < 0.6:
                    lines += ["On Friday A wrote:"] * rng.randint(0, 1) + [rng.choice([">", "> > ", ">>"]) + x for x in rng.choice(said).split("\n")]
                lines += [rng.choice(["", "yes", " ".join(rng.choices("abcdefg", k=4))])]
            text = "\n".join(lines)
            said.append("\n".join(x for x in lines if not x.startswith(">")).strip() or "nothing")
            rows.append((conv, turn, rng.choice(["user", "assistant"]), text))
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    res = con.execute(QUOTES)
    names = [d[0] for d in res.description]
    want = sorted(map(tuple, res.fetchall()), key=str)
    got = sorted(map(tuple, link_quotes(spark.createDataFrame(rows, SCHEMA)).select(*names).collect()), key=str)
    assert got == want and max(r[names.index("depth")] for r in want) > 1


def test_partial_and_joined_quotes_link(spark):
    three = "The first line is here.\nA second line follows it.\nThe third line ends it."
    wrapped = "One paragraph that\nis wrapped by hand.\n\nAnother one that is\nwrapped by hand too.\n\nBye"
    long = "We start here. The sentence in the middle is quoted. We end there."
    quote = lambda t: "\n".join("> " + x for x in t.split("\n"))
    rows = [
        (1, 0, "u", three), (1, 1, "a", wrapped), (1, 2, "u", long), (1, 3, "a", "Yes"), (1, 4, "u", "No"),
        (2, 0, "u", quote("The first line is here.\nA second line follows it.") + "\nOk"),
        (2, 1, "u", quote("Another one that is\nwrapped by hand too.") + "\nOk"),
        (2, 2, "u", quote("Another one that is wrapped\nby hand too.") + "\nOk"),
        (2, 3, "u", quote("The sentence in the middle is quoted.") + "\nOk"),
        (2, 4, "u", quote("Yes\nNo") + "\nOk"),
        (2, 5, "u", quote("Yes\nnobody ever said this") + "\nOk"),
        (2, 6, "u", quote("A second line follows it.\nThe third line ends it.") + "\nMine\n" + quote("The sentence in the middle is quoted.")),
        (2, 7, "u", quote(three) + "\nOk"), (2, 8, "u", None), (None, 1, "u", quote("the first LINE is here\nand an edited one") + "\nOk"),
        (2, 9, "u", "> Yes\n> No\n> Maybe so, who knows\nOk"), (3, 0, "u", "Maybe so, who knows"), (4, 0, "u", quote("Wrapped by hand too\n\nBye")),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    parents = lambda **kw: {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in link_quotes(df, **kw).collect()}
    got = parents(partial=True)
    assert {k: v for k, v in got.items() if v[0] is not None} == {
        (2, 0): (1, 0), (2, 1): (1, 1), (2, 2): (1, 1), (2, 3): (1, 2), (2, 4): (1, 3), (2, 6): (1, 0), (2, 7): (1, 0), (4, 0): (1, 1)}
    assert len(got) == len(rows)
    assert {k for k, v in parents().items() if v[0] is not None} == {(2, 7)}
