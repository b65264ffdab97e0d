"""URL filters by a tree of path templates.

Each host has a tree of path segments. Segments that vary by nature (numbers, hex names, slugs,
names with digits) become typed wildcards, and so do the unlabelled literals of a node with labels
or with more than FANOUT different ones. Sibling branches whose labelled share of bad pages does
not differ significantly from that of all their labelled siblings merge into one. A template is
rejected when its labelled purity, smoothed towards its parent's, reaches the threshold.

Above its tree a host hangs on its parent domains: the share of bad pages of all hosts, of the
domain, of the site in it and of the host itself, each smoothed towards the one before, is what
the root of the tree starts from. So a host with few labelled pages borrows from its siblings.

The tree is built over counts per distinct typed path, never over single pages, level by level
with aggregates and joins; no step gathers a host in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS, FANOUT, ALPHA, CUT, Z2 = 8, 30, 4.0, 0.6, 3.84
#: Parents of a host that its tree's root is smoothed towards: its last so many labels, then all of them.
PARENTS = (2, 3, 99)
#: (block or allow, host/path); a rule fits its host and all subdomains where the path starts alike.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# fixed values: words of hosts and paths that label a page as bad where no rule decides
BAD_WORDS = ("adserver", "ads", "adult", "bet", "bets", "betting", "casino", "cialis", "crack", "escort", "gambling", "lottery", "malware", "phishing", "pills", "poker", "porn", "spam", "track", "tracker", "viagra", "warez", "xxx")
WORD = "(^|[^a-z])(" + "|".join(BAD_WORDS) + ")([^a-z]|$)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def listed_word(host: Column, path: Column) -> Column:
    """Whether the host or path has a word of BAD_WORDS, between signs that are no letters of A-Z."""
    return F.translate(F.concat(host, F.lit("/"), path), UPPER, LOWER).rlike(WORD)


def typed_segments(path: Column, levels: int = LEVELS) -> Column:
    """The path's non-empty segments, lower-cased, without file endings, variable ones typed; those past ``levels`` fold into ``**``."""

    def typed(s: Column) -> Column:
        s = F.lower(F.regexp_replace(s, r"\.[A-Za-z0-9]{1,5}$", ""))
        return (
            F.when(s.rlike(r"^[0-9]+$"), "{n}")
            .when(s.rlike(r"^[0-9a-f-]{8,}$") & s.rlike("[0-9]"), "{h}")
            .when(s.rlike("[0-9]"), "{x}")
            .when(s.rlike(r"^[^-]+(-[^-]+){3,}$"), "{slug}")
            .otherwise(s)
        )

    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    head = F.transform(F.slice(segs, 1, levels), typed)
    return F.when(F.size(segs) > levels, F.concat(head, F.array(F.lit("**")))).otherwise(head)


def parent_of(host: Column, labels: int) -> Column:
    """The host's last ``labels`` labels."""
    return F.substring_index(host, ".", -labels)


def host_purity(hosts: DataFrame) -> DataFrame:
    """hosts: (host, l, b). (host, purity): the share of bad pages among all, smoothed down the host's parents to itself.

    Each parent is counted over hosts, of which there are far fewer than pages.
    """
    total = hosts.agg(F.sum("b").cast("double").alias("tb"), F.sum("l").cast("double").alias("tl"))
    out = hosts.crossJoin(F.broadcast(total)).select("host", F.when(F.col("tl") > 0, F.col("tb") / F.col("tl")).otherwise(F.lit(0.0)).alias("purity"))  # one row
    for n in PARENTS:
        of = hosts.groupBy(parent_of(F.col("host"), n).alias("parent")).agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
        out = out.withColumn("parent", parent_of(F.col("host"), n)).join(of, "parent").select("host", ((F.col("b") + ALPHA * F.col("purity")) / (F.col("l") + ALPHA)).alias("purity"))
    return out


def template_verdicts(ws: Workspace, counts: DataFrame, levels: int) -> DataFrame:
    """counts: (host, segs, n, labelled, bad), one row per host and typed path. Adds template and purity.

    ``levels`` is the number of segments of the longest path. A level reads the level above several
    times, so each is written to the workspace.
    """
    hosts = ws.save(counts.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")), "hosts")
    rows = counts.withColumn("template", F.lit("")).join(ws.save(host_purity(hosts), "roots"), "host")
    for level in range(levels):
        rows = rows.withColumn("seg", F.get("segs", F.lit(level)))
        nodes = rows.where("seg is not null").groupBy("host", "template", "seg").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        literal = ~F.col("seg").rlike(r"^\{|^\*\*$")
        parents = nodes.groupBy("host", "template").agg(
            F.sum(literal.cast("long")).alias("literals"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        n, p = nodes.alias("n"), parents.alias("p")
        share, pooled = F.col("b") / F.col("l"), F.col("pb") / F.col("pl")
        same = (share - pooled) * (share - pooled) * F.col("l") <= Z2 * pooled * (1 - pooled)
        to = (
            F.when((F.col("l") == 0) & (F.col("pl") > 0), "*")
            .when((F.col("l") > 0) & same & literal & (F.col("literals") > 1), "+")
            .when(literal & (F.col("literals") > FANOUT) & (F.col("l") == 0), "*")
            .otherwise(F.col("seg"))
        )
        joined = ws.save(n.join(p, ["host", "template"]).select("host", "template", "seg", to.alias("to"), "l", "b"), f"branches{level}")
        merged = joined.groupBy("host", "template", "to").agg(F.sum("l").alias("tl"), F.sum("b").alias("tb"))
        moves = joined.select("host", "template", "seg", "to").join(merged, ["host", "template", "to"])
        rows = ws.save(rows.join(moves, ["host", "template", "seg"], "left").select(
            "host", "segs", "n", "labelled", "bad",
            F.when(F.col("to").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "to")).alias("template"),
            F.when(F.col("to").isNull(), F.col("purity")).otherwise((F.col("tb") + ALPHA * F.col("purity")) / (F.col("tl") + ALPHA)).alias("purity"),
        ), f"level{level}")
        ws.drop(f"branches{level}", f"level{level - 1}")
    return rows


def url_filter(pages: DataFrame, key: str = "page_id", url: str = "url", bad: Column | None = None, rules=RULES, cut: float = CUT, levels: int = LEVELS) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, template, purity.

    ``bad`` is a boolean column over ``pages`` (null: unlabelled) that labels the templates. If it is
    not given, a page is labelled by the rule that decides it, and else by whether its host or path
    has a word of BAD_WORDS. These are noisy: a page's verdict is not its own label but the rule's,
    else block where the template's smoothed purity reaches ``cut``, so one bad word in a clean
    section does no harm and a page without one goes with a bad section. Segments of a path past
    ``levels`` make one wildcard. A null url, or one without
    ``://``, has an empty host and path and the empty template. Rows are judged each, so null
    keys and repeats pass through; an empty table gives no rows; other columns are ignored.
    """
    u = F.col(url).cast("string")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = pages.select(F.col(key), host_of(u).alias("host"), path_of(u).alias("path"), (bad if bad is not None else F.lit(None).cast("boolean")).alias("_bad"))
    base = base.select(key, "host", "path", rule.alias("rule"), verdict.alias("_said"), "_bad")
    if bad is None:
        base = base.withColumn("_bad", F.when(F.col("_said").isNotNull(), F.col("_said") == "block").otherwise(listed_word(F.col("host"), F.col("path"))))
    base = base.withColumn("segs", typed_segments(F.col("path"), levels))
    counts = base.groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.sum(F.col("_bad").isNotNull().cast("long")).alias("labelled"), F.sum(F.coalesce(F.col("_bad").cast("long"), F.lit(0))).alias("bad"))
    ws = Workspace(pages.sparkSession, "urls")
    counts = ws.save(counts, "counts")
    deepest = counts.agg(F.max(F.size("segs"))).first()[0] or 0
    verdicts = template_verdicts(ws, counts, deepest).select("host", "segs", "template", "purity")
    out = base.join(verdicts, ["host", "segs"], "left")
    said = F.coalesce(F.col("_said"), F.when(F.col("purity") >= cut, "block").otherwise("allow"))
    return out.select(key, "host", "path", "rule", said.alias("verdict"), "template", F.round("purity", 9).alias("purity"))


def oracle_sql() -> str:
    """The query op4 as DuckDB SQL over ``pages``."""
    typed = """list_transform({x}, lambda s: (CASE WHEN regexp_full_match(s, '[0-9]+') THEN '{{n}}' WHEN regexp_full_match(s, '[0-9a-f-]{{8,}}') AND regexp_matches(s, '[0-9]') THEN '{{h}}' WHEN regexp_matches(s, '[0-9]') THEN '{{x}}' WHEN regexp_full_match(s, '[^-]+(-[^-]+){{3,}}') THEN '{{slug}}' ELSE s END))"""
    ending = "list_transform(list_slice(raw, 1, {n}), lambda s: lower(regexp_replace(s, '\\.[A-Za-z0-9]{{1,5}}$', '')))".format(n=LEVELS)
    fits = []
    for kind, r in sorted(RULES, key=lambda x: (-len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits.append((f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '/{p}')", r, kind))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    said = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, _, k in fits) + " END"
    parents = ", ".join(f"array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - {n - 1}, 1), len(string_split(host, '.'))), '.') AS p{k}" for k, n in enumerate(PARENTS))
    sql = f"""WITH cut AS MATERIALIZED (SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
base AS MATERIALIZED (SELECT page_id, host, path, {rule} AS rule, {said} AS said, regexp_matches(translate(host || '/' || path, '{UPPER}', '{LOWER}'), '{WORD}') AS word, list_filter(string_split(path, '/'), lambda s: s <> '') AS raw FROM cut),
typed AS MATERIALIZED (SELECT *, {typed.format(x=ending)} || CASE WHEN len(raw) > {LEVELS} THEN ['**'] ELSE []::VARCHAR[] END AS segs FROM base),
counts AS MATERIALIZED (SELECT host, segs, count(*) AS labelled, count(*) FILTER (CASE WHEN said IS NULL THEN word ELSE said = 'block' END) AS bad FROM typed GROUP BY ALL),
h0 AS (SELECT host, {parents}, sum(labelled)::DOUBLE AS l, sum(bad)::DOUBLE AS b, (SELECT sum(bad)::DOUBLE / sum(labelled)::DOUBLE FROM counts) AS pa FROM counts GROUP BY host)"""
    for k, _ in enumerate(PARENTS):
        sql += f""",
h{k + 1} AS MATERIALIZED (SELECT * REPLACE ((sum(b) OVER (PARTITION BY p{k}) + {ALPHA}::DOUBLE * pa) / (sum(l) OVER (PARTITION BY p{k}) + {ALPHA}::DOUBLE) AS pa) FROM h{k})"""
    sql += f""",
r0 AS (SELECT c.*, '' AS template, pa AS purity FROM counts c JOIN h{len(PARENTS)} h ON c.host = h.host)"""
    for k in range(LEVELS + 1):
        sql += f""",
n{k} AS MATERIALIZED (SELECT host, template, segs[{k + 1}] AS seg, sum(labelled)::DOUBLE AS l, sum(bad)::DOUBLE AS b, NOT regexp_matches(segs[{k + 1}], '^\\{{|^\\*\\*$') AS literal FROM r{k} WHERE segs[{k + 1}] IS NOT NULL GROUP BY ALL),
p{k} AS MATERIALIZED (SELECT host, template, sum(literal::INT) AS literals, sum(l) AS pl, sum(b) AS pb FROM n{k} GROUP BY ALL),
j{k} AS MATERIALIZED (SELECT host, template, seg, l, b, CASE WHEN l = 0 AND pl > 0 THEN '*' WHEN l > 0 AND literal AND literals > 1 AND (b / l - pb / pl) * (b / l - pb / pl) * l <= {Z2}::DOUBLE * (pb / pl) * (1 - pb / pl) THEN '+' WHEN literal AND literals > {FANOUT} AND l = 0 THEN '*' ELSE seg END AS "to" FROM n{k} JOIN p{k} USING (host, template)),
m{k} AS MATERIALIZED (SELECT host, template, "to", sum(l) AS tl, sum(b) AS tb FROM j{k} GROUP BY ALL),
r{k + 1} AS MATERIALIZED (SELECT r.host, r.segs, r.labelled, r.bad, CASE WHEN j."to" IS NULL THEN r.template ELSE r.template || '/' || j."to" END AS template, CASE WHEN j."to" IS NULL THEN r.purity ELSE (m.tb + {ALPHA}::DOUBLE * r.purity) / (m.tl + {ALPHA}::DOUBLE) END AS purity FROM r{k} r LEFT JOIN j{k} j ON r.host = j.host AND r.template = j.template AND r.segs[{k + 1}] = j.seg LEFT JOIN m{k} m ON j.host = m.host AND j.template = m.template AND j."to" = m."to")"""
    return sql + f"""
SELECT t.page_id, t.host, t.path, t.rule, coalesce(t.said, CASE WHEN r.purity >= {CUT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, r.template, round(r.purity, 9) AS purity FROM typed t LEFT JOIN r{LEVELS + 1} r ON t.host = r.host AND t.segs = r.segs"""
