"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, mid-sentence names and units after numbers become typed placeholders that keep their
value beside the type. Windows of WINDOW template words (placeholders count by type) are hashed
from the hashes of their words. Benchmark windows with enough literal words are hash-joined to document windows; hits are gathered by document, item
and offset, and a hit region stands only if its slots are consistent: within a type, one value of
the item always meets one value of the document and the other way round. So a question is found
again when its numbers or names were changed throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, free_name

WINDOW, LITERALS, RUN = 8, 4, 13
# fixed values: units of measure recognised after a number
UNITS = ("kg", "g", "mg", "km", "m", "cm", "mm", "mi", "mile", "miles", "ft", "feet", "foot", "in", "inch", "inches", "yd", "yards", "l", "ml", "litre", "litres", "liter", "liters", "s", "sec", "seconds", "min", "minutes", "h", "hr", "hours", "hour", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "usd", "eur", "dollars", "euros", "pounds", "lb", "lbs", "oz", "mph", "kmh", "hz", "khz", "mhz", "w", "kw", "v", "kb", "mb", "gb", "tb")


def with_tokens(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the template words of string column ``text`` as ``out``, in place of it; a placeholder is
    qqnu, qqna or qqun before its value. Null and blank texts have none.

    Each step is a column of its own: an expression that is used twice would be worked out twice.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(text, F.lower(F.regexp_replace(t, r"(?<=[\p{L}\p{N},;]\s)(\p{Lu}\p{Ll}+)", "qqna$1")))
    t = F.regexp_replace(F.col(text), r"(?<=[0-9])[.,:/](?=[0-9])", "x")
    t = F.regexp_replace(t, r"([0-9][0-9x]*)", " qqnu$1 ")
    t = F.regexp_replace(t, r"(qqnu[0-9x]+)\s+(" + "|".join(UNITS) + r")(?![\p{L}\p{N}])", "$1 qqun$2")
    df = df.withColumn(text, F.when(F.col(text).rlike("[0-9]"), t).otherwise(F.col(text)))
    return df.withColumn(out, F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")).drop(text)


def with_windows(df: DataFrame, words: str, out: str, size: int = WINDOW, plain: bool = False) -> DataFrame:
    """df with the hashes of all windows of ``size`` words; empty for shorter arrays. By the words' types, or
    plain: by the words themselves, slot values included and whether or not they were taken for slots."""
    h = free_name(df, "_h")
    kind = lambda w: F.when(w.startswith("qq"), F.substring(w, 1, 4)).otherwise(w)
    bare = lambda w: F.when(w.startswith("qq"), F.regexp_replace(w, "^qq(nu|na|un)", "")).otherwise(w)
    seed = [F.lit(1)] if plain else []
    df = df.withColumn(h, F.transform(words, lambda w: F.xxhash64(bare(w) if plain else kind(w))))
    starts = F.slice(h, 1, F.greatest(F.size(h) - (size - 1), F.lit(0)))
    return df.withColumn(out, F.transform(starts, lambda x, i: F.xxhash64(*seed, x, *[F.get(h, i + k) for k in range(1, size)]))).drop(h)


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", whole: bool = False) -> DataFrame:
    """(h, item, ipos, need, size, plain): the windows with at least LITERALS literal words; need: windows that make a hit.

    Items shorter than WINDOW words have no such window, and others may have fewer than they need.
    These match nothing, or with ``whole`` word for word: by all their plain windows, of the whole
    item where it is shorter than WINDOW words. Null texts have no window.
    """
    words = with_tokens(benchmark.select(F.col(item).alias("item"), F.col(text).cast("string").alias("t")), "t", "w").distinct()
    need = F.least(F.size("w") - (WINDOW - 1), F.lit(RUN - WINDOW + 1))
    literals = lambda i: F.size(F.filter(F.slice("w", i + 1, WINDOW), lambda x: ~x.startswith("qq")))
    w = with_windows(words.where(F.size("w") >= WINDOW), "w", "hs").select("item", "w", F.posexplode_outer("hs").alias("ipos", "h")).where("h is not null")
    w = w.where(literals(F.col("ipos")) >= LITERALS)
    out = w.select("h", "item", "ipos", need.alias("need"), F.lit(WINDOW).alias("size"), F.lit(False).alias("plain")).distinct()
    if not whole:
        return out
    good = F.size(F.filter(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: literals(i) >= LITERALS))
    rest = words.where(F.when(F.size("w") < WINDOW, F.size("w") > 0).otherwise(good < need))
    for size in range(1, WINDOW + 1):
        x = with_windows(rest.where(F.size("w") >= WINDOW if size == WINDOW else F.size("w") == size), "w", "hs", size, True)
        x = x.select("item", F.greatest(need, F.lit(1)).alias("need"), F.posexplode("hs").alias("ipos", "h"))
        out = out.union(x.select("h", "item", "ipos", "need", F.lit(size), F.lit(True)))
    return out


def slots_of(at: Column, n: Column) -> Column:
    """The distinct slots of n words from the item's word ``at`` on, (b, d): the item's value and the document's."""
    both = F.arrays_zip(F.slice("bw", at + 1, n).alias("b"), F.slice("dw", at + F.col("shift") + 1, n).alias("d"))
    return F.array_distinct(F.filter(both, lambda x: F.coalesce(x["b"].startswith("qq") & (F.substring(x["b"], 1, 4) == F.substring(x["d"], 1, 4)), F.lit(False))))


def one_to_one(slots: Column) -> Column:
    values = lambda f: F.size(F.array_distinct(F.transform(slots, lambda x: x[f])))
    return (values("b") == F.size(slots)) & (values("d") == F.size(slots))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", whole: bool = False, split: bool = False, item_text: str = "text") -> DataFrame:
    """One row per (document row content, benchmark item) that meet: key, text_hash, item, windows
    (different item windows found again), first_word and last_word (of the document's region),
    exact (all slots have the item's own values).

    A pair counts when the consistent regions hold windows of at least RUN words in all, or the
    whole item where it is shorter. Items with too few literal words for that (fewer than WINDOW
    words, title case, many numbers) are found with ``whole`` only, and word for word; those of fewer
    than LITERALS words only where they are the whole document. A region with inconsistent slots
    counts for nothing, or with ``split`` is cut where they clash and each consistent part counts:
    that is every window whose own slots are consistent, copies word for word among them. Rows are told apart by key and text, so repeated rows give
    one result and null keys are kept as a key of their own; null and empty texts match nothing;
    empty tables give no rows; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "leaks")
    bench = ws.save(benchmark_windows(benchmark, item, item_text, whole=whole), "windows")
    sizes = [r[0] for r in bench.where("plain").select("size").distinct().collect()] if whole else []
    base = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("t"))
    hits = with_windows(with_tokens(base, "t", "w"), "w", "hs")
    for size in sizes:
        hits = with_windows(hits, "w", f"hs{size}", size, True)
        if size < LITERALS:
            hits = hits.withColumn(f"hs{size}", F.when(F.size("w") == size, F.col(f"hs{size}")).otherwise(F.array().cast("array<bigint>")))
    if sizes:
        placed = lambda c: F.transform(c, lambda x, i: F.struct(i.alias("pos"), x.alias("h")))
        hits = hits.select("k", "th", F.explode_outer(F.concat(*[placed(c) for c in ("hs", *[f"hs{size}" for size in sizes])])).alias("x")).select("k", "th", "x.pos", "x.h")
    else:
        hits = hits.select("k", "th", F.posexplode_outer("hs").alias("pos", "h"))  # outer: else a filter on the array works it out a second time
    hits = hits.join(bench, "h")  # Spark broadcasts the benchmark's windows only below its own size limit
    regions = hits.groupBy("k", "th", "item", "need", "size", "plain", (F.col("pos") - F.col("ipos")).alias("shift")).agg(
        F.countDistinct("ipos").alias("n"), F.min("ipos").alias("lo"), F.max("ipos").alias("hi"), *([F.collect_set("ipos").alias("at")] if split else []))
    regions = ws.save(regions, "regions")
    pairs = regions.groupBy("k", "th", "item").agg(F.sum("n").alias("all"), F.max("need").alias("need")).where(F.col("all") >= F.col("need"))
    regions = ws.save(regions.drop("need").join(pairs.withColumnsRenamed({"k": "pk", "th": "pth", "item": "pi"}), (F.col("k").eqNullSafe(F.col("pk"))) & (F.col("th").eqNullSafe(F.col("pth"))) & (F.col("item").eqNullSafe(F.col("pi")))).drop("pk", "pth", "pi", "all"), "likely")
    # the regions' slots: only documents with a likely region are read again
    who = regions.select(F.col("k").alias("rk"), F.col("th").alias("rth")).distinct()
    texts = base.join(who, F.col("k").eqNullSafe(F.col("rk")) & F.col("th").eqNullSafe(F.col("rth")), "left_semi").distinct()
    texts = ws.save(with_tokens(texts.withColumnsRenamed({"k": "dk", "th": "dth"}), "t", "dw"), "texts")
    items = with_tokens(benchmark.select(F.col(item).alias("bi"), F.col(item_text).cast("string").alias("t")), "t", "bw").distinct()
    r = regions.join(texts, F.col("k").eqNullSafe(F.col("dk")) & F.col("th").eqNullSafe(F.col("dth"))).join(items, F.col("item").eqNullSafe(F.col("bi")))
    if split:
        # a window stays if its own slots are consistent; the region then reaches from the first to the last that stays
        r = r.withColumn("at", F.when(F.col("plain"), F.col("at")).otherwise(F.filter("at", lambda i: one_to_one(slots_of(i, F.lit(WINDOW)))))).where(F.size("at") > 0)
        r = r.withColumns({"n": F.size("at").cast("long"), "lo": F.array_min("at"), "hi": F.array_max("at")})
    r = r.select("k", "th", "item", "need", "n", "lo", "hi", "shift", "size", "plain", slots_of(F.col("lo"), F.col("hi") - F.col("lo") + F.col("size")).alias("s"))
    if not split:
        r = r.where(F.col("plain") | one_to_one(F.col("s")))
    same = F.forall("s", lambda x: x["b"] == x["d"])
    out = r.groupBy("k", "th", "item").agg(
        F.max("need").alias("need"), F.sum("n").alias("windows"), F.min(F.col("lo") + F.col("shift")).alias("first_word"),
        F.max(F.col("hi") + F.col("shift") + F.col("size") - 1).alias("last_word"), F.min(same).alias("exact"))
    return out.where(F.col("windows") >= F.col("need")).select(F.col("k").alias(key), F.col("th").alias("text_hash"), F.col("item").alias(item), "windows", "first_word", "last_word", "exact")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that meet a benchmark item; all columns and all other rows stay."""
    ws = Workspace(docs.sparkSession, "leaky")
    found = ws.save(contaminated(docs, benchmark, key, text, whole=True, split=True).select(F.col(key).alias("_fk"), F.col("text_hash").alias("_fh")).distinct(), "found")
    h = free_name(docs, "_th")
    marked = docs.withColumn(h, F.xxhash64(F.col(text).cast("string")))
    return marked.join(found, marked[key].eqNullSafe(found["_fk"]) & marked[h].eqNullSafe(found["_fh"]), "left_anti").select(docs.columns)
