"""Chat formatting by quotation linking, in DataFrame functions only.

A message's lines are cut into its own text and its quoted passages (lines in a row at one quote
level). Passages and the messages' own texts are normalised and hashed; a passage is joined to the
earliest message that says it, first in its own conversation, then anywhere. A message replies to
the original of its outermost linked passage. With ``partial``, a passage that no message says as
it stands is linked by its parts: paragraphs, pairs of consecutive lines, lines and sentences.
Conversations that replies connect are one thread;
within it a message comes right after what it replies to, and all quotes are gone.

Hash tables of originals are aggregated to one row a hash before they are joined, so a text that
a third of all messages share stays one row. No step orders or gathers a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components

_PREFIX = r"^[ \t]*>[> \t]*"
#: The line that mail programs put before a quote.
_INTRO = r"(?i)^(on|le|am|el)\b.*\b(wrote|écrit|schrieb|escribió)\s*:\s*$"

#: Words of a single part of a passage that link it alone.
WORDS = 4


def parsed_lines(text: Column) -> Column:
    """array<struct<level, line>>: the count of leading ``>`` and the rest of each line, introductions of quotes left out."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    cut = F.transform(lines, lambda s: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(s, _PREFIX, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(s, _PREFIX, "").alias("line")))
    quoted = F.filter(cut, lambda x: x["level"] > 0)
    return F.when(F.size(quoted) == 0, cut).otherwise(F.filter(cut, lambda x: ~((x["level"] == 0) & x["line"].rlike(_INTRO))))


def own_text(lines: Column) -> Column:
    own = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"])
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), "\n{3,}", "\n\n"), r"^\n+|\n+$", ""))


def passages(lines: Column) -> Column:
    """array<struct<level, text>>: runs of lines at one level above 0."""
    zero = F.array().cast("array<struct<level:int,text:string>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        new = F.struct(x["level"].cast("int").alias("level"), x["line"].alias("text"))
        return (
            F.when(F.size(acc) == 0, F.array(new))
            .when(last["level"] == x["level"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["level"].alias("level"), F.concat_ws("\n", last["text"], x["line"]).alias("text")))))
            .otherwise(F.concat(acc, F.array(new)))
        )

    runs = F.aggregate(F.transform(lines, lambda x: F.struct(x["level"].cast("int").alias("level"), x["line"].alias("line"))), zero, add)
    return F.filter(runs, lambda p: p["level"] > 0)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def with_pieces(df: DataFrame, text: str, paragraphs: str, lines: str, pairs: str, sentences: str) -> DataFrame:
    """df with four arrays of normalised pieces of ``text``; lines are those that say something, pairs two of them in a row."""
    said = lambda xs: F.filter(F.transform(xs, normalised), lambda x: x != "")
    cut = F.split(F.col(text), r"\n\s*\n")
    df = df.withColumns({paragraphs: said(cut), lines: said(F.split(F.col(text), "\n")), sentences: said(F.flatten(F.transform(cut, lambda x: F.split(x, r"(?<=[.!?])\s+"))))})
    return df.withColumn(pairs, F.transform(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(lines, i + 1))))


def hashed(df: DataFrame, n: str = "n") -> DataFrame:
    return df.withColumns({"ph": F.xxhash64(n), "ph2": F.xxhash64(F.lit(1), n)}).drop(n)


def originals(ws: Workspace, q: DataFrame, said: DataFrame, name: str) -> DataFrame:
    """q (id, ph, ph2, ...) with ``to``: the earliest message before id that says it, first in its conversation; else null. said: (id, n)."""
    said = hashed(said).join(q.select("ph", "ph2").distinct(), ["ph", "ph2"], "left_semi")
    here = ws.save(said.groupBy("ph", "ph2", F.col("id.c").alias("c")).agg(F.min("id").alias("near")), name)
    any_ = here.groupBy("ph", "ph2").agg(F.min("near").alias("far"))
    linked = q.withColumn("c", F.col("id.c")).join(here.withColumnRenamed("c", "hc").withColumnsRenamed({"ph": "a", "ph2": "b"}), (F.col("ph") == F.col("a")) & (F.col("ph2") == F.col("b")) & F.col("c").eqNullSafe(F.col("hc")), "left").drop("a", "b", "hc")
    to = F.when(F.col("near") < F.col("id"), F.col("near")).when(F.col("far") < F.col("id"), F.col("far"))
    return linked.join(any_, ["ph", "ph2"], "left").withColumn("to", to)


def linked_by_parts(ws: Workspace, m: DataFrame, lost: DataFrame) -> DataFrame:
    """(id, level, at, to) of those passages of ``lost`` (id, at) that have parts which messages say.

    The whole passage as a paragraph or sentence of a longer message comes first, then its
    paragraphs, pairs of lines, lines and sentences. Two lines in a row of one original are
    evidence enough; a single part counts from WORDS words on, or if each line of the passage
    is said somewhere.
    """
    p = m.where(F.size("passages") > 0).select("id", F.posexplode("passages").alias("at", "p")).select(F.col("id").alias("pi"), F.col("at").alias("pa"), "p.level", F.col("p.text").alias("text")).distinct()
    p = p.join(lost, F.col("pi").eqNullSafe(F.col("id")) & (F.col("pa") == F.col("at")), "left_semi").withColumnsRenamed({"pi": "id", "pa": "at"})
    p = with_pieces(p, "text", "p2", "p4", "p3", "p5").withColumn("p1", F.array(normalised(F.col("text"))))
    each = lambda tier: F.transform(f"p{tier}", lambda x, i: F.struct(F.lit(tier).alias("tier"), i.alias("i"), x.alias("n")))
    q = p.select("id", "level", "at", F.size("p4").alias("lines"), F.explode(F.concat(*map(each, range(1, 6)))).alias("x")).select("id", "level", "at", "lines", "x.tier", "x.i", "x.n", F.size(F.split("x.n", " ")).alias("words"))
    q = ws.save(hashed(q), "parts")
    said = with_pieces(m.where("own <> ''").select("id", "own"), "own", "s1", "s2", "s3", "s4")
    said = said.select("id", F.explode(F.array_distinct(F.concat(F.array(normalised(F.col("own"))), "s1", "s2", "s3", "s4"))).alias("n")).where("n <> ''")
    found = originals(ws, q, said, "near_parts").where("to is not null")
    found = found.groupBy("id", "level", "at", "lines").agg(F.collect_set(F.struct("tier", "i", "to", "words")).alias("f"))
    every = F.size(F.filter("f", lambda x: x["tier"] == 4)) == F.col("lines")
    best = F.array_min(F.filter("f", lambda x: x["tier"].isin(1, 3) | (x["words"] >= WORDS) | every))
    return found.select("id", "level", "at", best["to"].alias("to")).where("to is not null")


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", partial: bool = False) -> DataFrame:
    """One row per message: conv, turn, role, text (own, without quotes), n_quotes, max_level,
    parent_conv, parent_turn (null without a linked quote), thread (least conv of those linked),
    depth (links to its first message) and sort_path (orders a thread: each message after the one
    it replies to).

    A message is told by conv, turn and, among equals, its text; fully repeated rows are each
    returned with the same links. Null convs form a conversation of their own; null turns come
    first; null and empty texts say nothing and quote nothing. A quote of something said later,
    or nowhere, links to nothing. A quote of part of a message, or of several messages at once, links
    with ``partial`` only, unless it is one line. Other columns are ignored; an empty table gives no rows.
    """
    ws = Workspace(messages.sparkSession, "quotes")
    lines = parsed_lines(F.col(text).cast("string"))
    m = messages.select(
        F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(role).alias("role"), F.xxhash64(F.col(text).cast("string")).alias("h"), lines.alias("lines"))
    m = m.select("c", "t", "role", "h", own_text(F.col("lines")).alias("own"), F.size(F.filter("lines", lambda x: x["level"] > 0)).alias("quoted"), "lines")
    m = m.withColumn("passages", F.when(F.col("quoted") > 0, passages(F.col("lines"))).otherwise(F.array().cast("array<struct<level:int,text:string>>"))).drop("lines", "quoted")
    m = ws.save(m.withColumn("id", F.struct("c", "t", "h")), "messages")
    # what quotes say: few rows, as most messages quote nothing
    q = m.where(F.size("passages") > 0).select("id", F.posexplode("passages").alias("at", "p")).select("id", "at", "p.level", normalised(F.col("p.text")).alias("n")).where("n <> ''")
    q = ws.save(hashed(q).select("id", "at", "level", "ph", "ph2").distinct(), "quotes")
    # what messages say: whole own texts and their lines
    said = m.where("own <> ''").select("id", F.explode(F.array_distinct(F.transform(F.concat(F.array("own"), F.split("own", "\n")), normalised))).alias("n")).where("n <> ''")
    linked = originals(ws, q, said, "near").select("id", "level", "at", "to")
    if partial:
        linked = ws.save(linked, "whole")
        lost = linked.where("to is null").select("id", "at")
        if not lost.isEmpty():
            linked = linked.unionByName(linked_by_parts(ws, m, lost))
    linked = linked.where("to is not null")
    parent = ws.save(linked.groupBy("id").agg(F.min_by("to", F.struct("level", "at", "to")).alias("parent")), "parents")
    # depth and path by doubling: every round reaches twice as far up
    up = parent.select("id", F.col("parent").alias("top"), F.lit(1).alias("depth"), F.array("parent").alias("path"))
    step = 0
    while True:
        up = ws.save(up, f"up{step}")
        far = up.select(F.col("id").alias("top"), F.col("top").alias("top2"), F.col("depth").alias("d2"), F.col("path").alias("p2"))
        joined = ws.save(up.join(far, "top", "left"), f"join{step}")
        if step:
            ws.drop(f"up{step - 1}", f"join{step - 1}")
        if joined.where("top2 is not null").isEmpty():
            break
        up = joined.select("id", F.coalesce("top2", "top").alias("top"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.concat(F.coalesce("p2", F.array().cast(up.schema["path"].dataType)), "path").alias("path"))
        step += 1
    # conversations that replies connect are one thread
    edges = parent.where("not (id.c <=> parent.c) and id.c is not null and parent.c is not null").select(F.col("id.c").alias("a"), F.col("parent.c").alias("b"))
    threads = components(ws, edges).select(F.col("node").alias("tc"), F.col("root").alias("thread"))
    out = m.join(parent.withColumnRenamed("id", "pid"), F.col("id").eqNullSafe(F.col("pid")), "left").drop("pid")
    out = out.join(up.select(F.col("id").alias("uid"), "depth", "path"), F.col("id").eqNullSafe(F.col("uid")), "left").drop("uid")
    out = out.join(threads, F.col("c") == F.col("tc"), "left")
    levels = F.array_max(F.transform("passages", lambda p: p["level"]))
    spot = lambda x: F.concat_ws(".", F.coalesce(F.format_string("%d", x["c"].cast("long")), F.lit("")), F.coalesce(F.format_string("%010d", x["t"].cast("long")), F.lit("")))
    path = F.array_join(F.transform(F.concat(F.coalesce("path", F.array().cast(up.schema["path"].dataType)), F.array("id")), spot), "/")
    return out.select(
        F.col("c").alias(conv), F.col("t").alias(turn), F.col("role").alias(role), F.col("own").alias(text), F.size("passages").alias("n_quotes"), F.coalesce(levels, F.lit(0)).alias("max_level"),
        F.col("parent.c").alias("parent_conv"), F.col("parent.t").alias("parent_turn"), F.coalesce("thread", "c").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), path.alias("sort_path"))
