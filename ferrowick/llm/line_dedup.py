"""Line dedup over a suffix order of line-id sequences.

Every non-blank line gets an id by its trimmed text. The suffixes of all documents' line-id
sequences are ordered by distributed prefix doubling: the rank of a suffix by its first 2k lines
comes from the pair (its rank by k lines, the rank by k lines of the suffix k lines on). Suffixes
of one rank are an interval of the suffix array whose common prefix is at least that long. A run
of w lines is named exactly by w and the ranks, at the greatest power of two up to w, of its
start and of the block that ends it, so runs of any length meet in their interval.

A run is repeated if the same lines stood earlier (by document, then position) and it has at
least ``min_words`` words. Its later copies are deleted. Every maximal repeated run is covered by
its minimal runs: the shortest ones that reach ``min_words`` from each start, and to each end. So
it is enough to look these up, and doubling ends at the longest of them (at most ``min_words``
lines), however long the documents are.

Ranks are taken over distinct pairs, counted before the shuffle, and only over lines that occur
twice; a line that fills a third of the corpus is one row there, and the joins back to it have the
unique side to be matched, so Spark may split the other at will.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, free_name

MIN_WORDS = 8
SPACE = " \t\n\x0b\f\r"  # what \\s means to the JVM


def _words(line: Column) -> Column:
    return F.size(F.split(line, r"\s+"))


def line_table(base: DataFrame, min_words: int) -> DataFrame:
    """base: (rid, k, text). One row per non-blank line: rid, k, pos (among non-blank lines), nw,
    h1, h2 (its id), fw and bw: lines of the shortest run from it, and to it, with min_words
    words (null if the document ends before)."""
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.btrim(s, F.lit(SPACE)))
    lines = base.select("rid", "k", F.filter(trimmed, lambda s: s != "").alias("lines"))
    lines = lines.withColumn("nws", F.transform("lines", _words)).withColumn("back", F.reverse("nws"))

    def reach(counts: str, at: Column) -> Column:
        """Lines from place ``at`` (from 1) until the words reach min_words."""
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
        end = F.aggregate(F.slice(counts, at, min_words), start, lambda a, x: F.when(a["words"] >= min_words, a).otherwise(F.struct((a["words"] + x).alias("words"), (a["n"] + 1).alias("n"))))
        return F.when(end["words"] >= min_words, end["n"])

    n = F.size("nws")
    each = F.transform("lines", lambda s, i: F.struct(
        i.alias("pos"), F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), s).alias("h2"), F.get("nws", i).alias("nw"),
        F.when(F.get("nws", i) >= min_words, 1).otherwise(reach("nws", i + 1)).alias("fw"),
        F.when(F.get("nws", i) >= min_words, 1).otherwise(reach("back", n - i)).alias("bw")))
    # outer: else a filter on the array works it out a second time
    return lines.select("rid", "k", F.explode_outer(each).alias("x")).where("x is not null").select("rid", "k", "x.*")


def ranks(ws: Workspace, pairs: DataFrame, by: list[str], name: str) -> DataFrame:
    """The distinct rows of ``by`` that occur at least twice, with ``rank``: increasing in their order.

    A range partition sorts them; a row's number within it, after all earlier partitions, is the rank.
    """
    twice = pairs.groupBy(*by).agg(F.count("*").alias("count")).where(F.col("count") > 1).drop("count")
    ordered = twice.repartitionByRange(*by).sortWithinPartitions(*by)
    return ws.save(ordered.withColumn("rank", F.monotonically_increasing_id()), name)


def suffix_ranks(ws: Workspace, lines: DataFrame, most: int) -> list[DataFrame]:
    """For k = 0, 1, ... while 2**k <= most: (rid, pos, rank) of the blocks of 2**k lines that occur twice.

    lines: (rid, pos, r0) with r0 the rank of the line. ``most`` is the longest run looked up.
    """
    levels, size = [lines.select("rid", "pos", F.col("r0").alias("rank"))], 1
    while size * 2 <= most:
        level = levels[-1]
        on = Window.partitionBy("rid").orderBy("pos").rangeBetween(size, size)
        pairs = ws.save(level.select("rid", "pos", F.col("rank").alias("r1"), F.max("rank").over(on).alias("r2")).where("r2 is not null"), f"pairs{size}")
        named = ranks(ws, pairs, ["r1", "r2"], f"ranks{size}")
        levels.append(ws.save(pairs.join(named, ["r1", "r2"]).select("rid", "pos", "rank"), f"blocks{size}"))
        ws.drop(f"pairs{size}", f"ranks{size}")
        size *= 2
    return levels


def repeated_lines(ws: Workspace, base: DataFrame, min_words: int) -> DataFrame:
    """base: (rid, k, text), rid unique, k orderable. (rid, pos, run): lines in later copies of repeated runs."""
    lines = ws.save(line_table(base, min_words), "lines")
    first = F.struct("k", "rid", "pos")
    known = lines.groupBy("h1", "h2").agg(F.count("*").alias("count"), F.min(first).alias("first")).where(F.col("count") > 1).drop("count")
    known = ws.save(known.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2").withColumn("r0", F.monotonically_increasing_id()), "known")
    lines = ws.save(lines.join(known, ["h1", "h2"]).select("rid", "k", "pos", "fw", "bw", "r0", (first != F.col("first")).alias("later")), "twice")
    ws.drop("lines", "known")
    single = lines.where("later and fw = 1").select("rid", "pos")
    # runs of several lines: those whose start, or end, is too short alone
    runs = lines.where("fw > 1").select("rid", "k", "pos", F.col("fw").alias("w"))
    runs = ws.save(runs.union(lines.where("bw > 1").select("rid", "k", (F.col("pos") - F.col("bw") + 1).alias("pos"), F.col("bw"))).distinct(), "runs")
    most = runs.agg(F.max("w")).first()[0] or 1
    deleted = single
    if most > 1:
        # only blocks within such runs are asked for: lines short alone, and the long ones that open or close a run
        near = lines.where("fw is null or fw > 1 or bw is null or bw > 1").select("rid", "pos", "r0")
        ends = runs.select("rid", "pos").union(runs.select("rid", F.col("pos") + F.col("w") - 1)).distinct().join(lines.select("rid", "pos", "r0"), ["rid", "pos"])
        levels = suffix_ranks(ws, ws.save(near.union(ends).distinct(), "near"), most)
        found = None
        for k, level in enumerate(levels):
            size = 1 << k
            part = runs.where((F.col("w") >= size) & (F.col("w") < 2 * size))
            start = level.select("rid", "pos", F.col("rank").alias("ra"))
            close = level.select("rid", (F.col("pos") + size).alias("over"), F.col("rank").alias("rb"))
            named = part.withColumn("over", F.col("pos") + F.col("w")).join(start, ["rid", "pos"]).join(close, ["rid", "over"])
            named = named.select("rid", "k", "pos", "w", "ra", "rb")
            found = named if found is None else found.union(named)
        found = ws.save(found, "named")
        firsts = ws.save(found.groupBy("w", "ra", "rb").agg(F.min(F.struct("k", "rid", "pos")).alias("first")), "firsts")
        later = found.join(firsts, ["w", "ra", "rb"]).where(F.struct("k", "rid", "pos") != F.col("first"))
        deleted = single.union(later.select("rid", F.explode(F.sequence("pos", F.col("pos") + F.col("w") - 1)).alias("pos")))
    return ws.save(deleted.distinct(), "deleted")


def without_lines(df: DataFrame, text: str, cut: str, out: str) -> DataFrame:
    """df with ``out``: ``text`` without its non-blank lines of the numbers in array ``cut``; empty if none is left.

    Each step is a column of its own: an expression that is used twice would be worked out twice.
    """
    raw, full = free_name(df, "_raw"), free_name(df, "_full")
    df = df.withColumn(raw, F.split(text, "\n"))
    # the places of the non-blank lines among all lines
    places = F.transform(raw, lambda s, i: F.when(F.btrim(s, F.lit(SPACE)) != "", i))
    df = df.withColumn(full, F.array_compact(places))
    gone = F.transform(cut, lambda p: F.get(full, p))
    kept = F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), gone)
    short = F.array_join(F.transform(kept, lambda i: F.get(raw, i)), "\n")
    return df.withColumn(out, F.when(F.size(cut) < F.size(full), short).otherwise("")).drop(raw, full)


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """df with later copies of repeated line runs cut out of ``text``, and the column lines_cut
    (named with leading underscores where df has one).

    Documents count in the order of ``key`` (nulls last), then of their place in the input, so of
    equal rows the first keeps its lines. Blank lines are no lines: they match nothing and stay; a
    text that loses all its lines becomes empty, all others keep the rest byte for byte. Null
    texts stay null, empty ones empty. Runs with fewer than ``min_words`` words in all are left
    alone. All rows and all other columns pass through.
    """
    ws = Workspace(df.sparkSession, "lines")
    rid, cut = free_name(df, "_rid"), free_name(df, "_cut")
    rows = ws.save(df.withColumn(rid, F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"))
    found = repeated_lines(ws, rows.select(F.col(rid).alias("rid"), order.alias("k"), F.col(text).cast("string").alias("text")), min_words)
    cuts = found.groupBy("rid").agg(F.collect_list("pos").alias(cut)).withColumnRenamed("rid", "_r")  # of one document

    # the cuts grow with the input, so they are dealt out with the rows at every size
    out = rows.join(cuts.hint("merge"), F.col(rid) == F.col("_r"), "left")
    has, short = F.col(cut).isNotNull(), free_name(out, "_short")
    whole = free_name(out, "_whole")
    # only texts that lose lines are taken apart
    out = without_lines(out.withColumn(whole, F.when(has, F.col(text).cast("string"))), whole, cut, short)
    out = out.withColumn(text, F.when(has, F.col(short)).otherwise(F.col(text)))
    return out.select(*df.columns, F.coalesce(F.size(cut), F.lit(0)).alias(free_name(df, "lines_cut")))
