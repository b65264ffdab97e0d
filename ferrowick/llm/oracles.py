"""DuckDB SQL for queries of this package, worked out by plainer means than the operators use."""

from __future__ import annotations

from .decontaminate import LITERALS, RUN, UNITS, WINDOW
from .line_dedup import MIN_WORDS
from .quotes import _INTRO

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: op1: every run of at most MIN_WORDS lines that just reaches MIN_WORDS words, by its lines' text.
LINES = rf"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS raw, text FROM documents),
t AS (SELECT doc_id, raw, text, list_filter(list_transform(raw, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ls FROM d),
n AS (SELECT *, list_transform(ls, lambda s: len(regexp_split_to_array(s, '\s+'))) AS nw FROM t),
p AS (SELECT doc_id, ls, nw, unnest(range(1, len(ls) + 1)) AS p FROM n),
w AS (SELECT *, list_filter(range(1, {MIN_WORDS + 1}), lambda w: p + w - 1 <= len(ls) AND list_sum(nw[p:p + w - 1]) >= {MIN_WORDS})[1] AS fw, list_filter(range(1, {MIN_WORDS + 1}), lambda w: p - w + 1 >= 1 AND list_sum(nw[p - w + 1:p]) >= {MIN_WORDS})[1] AS bw FROM p),
r AS (SELECT DISTINCT doc_id, s, w, ls[s:s + w - 1] AS run FROM (SELECT doc_id, ls, p AS s, fw AS w FROM w WHERE fw IS NOT NULL UNION ALL SELECT doc_id, ls, p - bw + 1, bw FROM w WHERE bw IS NOT NULL)),
f AS (SELECT run, min((doc_id, s)) AS first FROM r GROUP BY run),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + w)) AS p FROM r JOIN f USING (run) WHERE (doc_id, s) <> first),
g AS (SELECT doc_id, list(p) AS cut FROM c GROUP BY doc_id),
k AS (SELECT n.doc_id, coalesce(len(cut), 0) AS lines_cut, CASE WHEN cut IS NULL THEN text WHEN len(cut) = len(ls) THEN '' ELSE array_to_string(list_filter(raw, lambda s, i: regexp_full_match(s, '\s*') OR NOT list_contains(cut, len(list_filter(raw[1:i], lambda x: NOT regexp_full_match(x, '\s*'))))), chr(10)) END AS kept FROM n LEFT JOIN g USING (doc_id))
SELECT doc_id, lines_cut, length(kept) AS kept_chars, md5(kept) AS kept_md5 FROM k"""

#: op2: all pairs that share a shingle, counted.
JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda s: s <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (t) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, c.b FROM r JOIN c ON r.b = c.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a), z AS (SELECT s, count(*) AS z FROM s GROUP BY s)
SELECT doc_id, len(s) AS n_shingles, m AS component_id, CASE WHEN len(s) = 0 THEN 1 ELSE z END AS class_size FROM s JOIN m ON doc_id = a JOIN z USING (s)"""


def _template(table: str, key: str) -> str:
    """(k, w): the canonical words. RE2 has no look-around, so replacements that may touch run twice."""
    name, sep = r"'([\p{L}\p{N},;]\s)(\p{Lu}\p{Ll}+)', '\1qqna\2', 'g'", r"'([0-9])[.,:/]([0-9])', '\1x\2', 'g'"
    t = f"lower(regexp_replace(regexp_replace(text, {name}), {name}))"
    t = f"regexp_replace(regexp_replace({t}, {sep}), {sep})"
    t = rf"regexp_replace({t}, '([0-9][0-9x]*)', ' qqnu\1 ', 'g')"
    t = rf"regexp_replace({t}, '(qqnu[0-9x]+)\s+({'|'.join(UNITS)})([^\p{{L}}\p{{N}}]|$)', '\1 qqun\2\3', 'g')"
    return rf"SELECT DISTINCT {key} AS k, list_filter(regexp_split_to_array({t}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {table} WHERE text IS NOT NULL"


_KINDS = "list_transform(w, lambda x: CASE WHEN x LIKE 'qq%' THEN left(x, 4) ELSE x END)"

#: op6: the windows themselves instead of their hashes.
LEAKS = f"""WITH d AS ({_template("documents", "doc_id")}), b AS ({_template("benchmark", "item_id")}),
dk AS (SELECT k, w, {_KINDS} AS t FROM d WHERE len(w) >= {WINDOW}), bk AS (SELECT k, w, {_KINDS} AS t FROM b WHERE len(w) >= {WINDOW}),
dp AS (SELECT k, t, unnest(range(0, len(t) - {WINDOW - 1})) AS pos FROM dk), dw AS (SELECT k, pos, array_to_string(t[pos + 1:pos + {WINDOW}], ' ') AS h FROM dp),
bp AS (SELECT k, w, t, unnest(range(0, len(t) - {WINDOW - 1})) AS ipos FROM bk),
bw AS (SELECT k AS item, ipos, array_to_string(t[ipos + 1:ipos + {WINDOW}], ' ') AS h, least(len(t) - {WINDOW - 1}, {RUN - WINDOW + 1}) AS need FROM bp WHERE len(list_filter(w[ipos + 1:ipos + {WINDOW}], lambda x: NOT x LIKE 'qq%')) >= {LITERALS}),
g AS (SELECT k, item, need, pos - ipos AS shift, count(DISTINCT ipos) AS n, min(ipos) AS lo, max(ipos) AS hi FROM dw JOIN bw USING (h) GROUP BY ALL),
s AS (SELECT g.*, list_distinct(list_filter(list_zip(bk.w[lo + 1:hi + {WINDOW}], dk.w[lo + shift + 1:hi + shift + {WINDOW}]), lambda x: coalesce(x[1] LIKE 'qq%' AND left(x[1], 4) = left(x[2], 4), false))) AS s FROM g JOIN dk ON g.k = dk.k JOIN bk ON g.item = bk.k),
o AS (SELECT * FROM s WHERE len(list_distinct(list_transform(s, lambda x: x[1]))) = len(s) AND len(list_distinct(list_transform(s, lambda x: x[2]))) = len(s))
SELECT k AS doc_id, item AS item_id, CAST(sum(n) AS BIGINT) AS windows, min(lo + shift) AS first_word, max(hi + shift + {WINDOW - 1}) AS last_word, min(len(list_filter(s, lambda x: x[1] <> x[2])) = 0) AS exact
FROM o GROUP BY k, item HAVING sum(n) >= max(need)"""

_NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

#: op8: passages and own paragraphs by their normalised text, replies by recursion.
QUOTES = rf"""WITH RECURSIVE l AS (SELECT conv_id AS c, turn AS t, role, list_transform(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)), lambda s: {{'level': length(regexp_replace(regexp_extract(s, '^[ \t]*>[> \t]*'), '[^>]', '', 'g')), 'line': regexp_replace(s, '^[ \t]*>[> \t]*', '')}}) AS ls FROM conversations),
m AS (SELECT c, t, role, CASE WHEN len(list_filter(ls, lambda x: x.level > 0)) = 0 THEN ls ELSE list_filter(ls, lambda x: NOT (x.level = 0 AND regexp_matches(x.line, '{_INTRO}'))) END AS ls FROM l),
o AS (SELECT c, t, role, ls, trim(regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(ls, lambda x: x.level = 0), lambda x: x.line), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS own FROM m),
u AS (SELECT c, t, ls, unnest(range(1, len(ls) + 1)) AS i FROM o), v AS (SELECT c, t, i, ls[i].level AS level, ls[i].line AS line FROM u),
x AS (SELECT *, i - row_number() OVER (PARTITION BY c, t, level ORDER BY i) AS g FROM v WHERE level > 0),
p AS (SELECT c, t, level, min(i) AS i, string_agg(line, chr(10) ORDER BY i) AS said FROM x GROUP BY c, t, level, g),
q AS (SELECT c, t, level, i, {_NORMAL.format("said")} AS n FROM p),
a AS (SELECT DISTINCT c, t, {_NORMAL.format("y")} AS n FROM (SELECT c, t, unnest(list_concat([own], string_split(own, chr(10)))) AS y FROM o WHERE own <> '')),
near AS (SELECT n, c, min((c, t)) AS near FROM a WHERE n <> '' GROUP BY n, c), far AS (SELECT n, min(near) AS far FROM near GROUP BY n),
k AS (SELECT q.c, q.t, level, i, CASE WHEN near < (q.c, q.t) THEN near WHEN far < (q.c, q.t) THEN far END AS "to" FROM q LEFT JOIN near ON q.n = near.n AND q.c = near.c LEFT JOIN far ON q.n = far.n WHERE q.n <> ''),
f AS (SELECT c, t, min((level, i, "to"))[3] AS "to" FROM k WHERE "to" IS NOT NULL GROUP BY c, t),
y AS (SELECT o.c, o.t, f."to"[1] AS pc, f."to"[2] AS pt, o.c || '.' || lpad(o.t::VARCHAR, 10, '0') AS spot FROM o LEFT JOIN f ON o.c = f.c AND o.t = f.t),
d AS (SELECT c, t, 0 AS depth, spot AS path FROM y WHERE pc IS NULL UNION ALL SELECT y.c, y.t, d.depth + 1, d.path || '/' || y.spot FROM y JOIN d ON y.pc = d.c AND y.pt = d.t),
e AS (SELECT c AS a, pc AS b FROM y WHERE pc <> c UNION SELECT pc, c FROM y WHERE pc <> c),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), h AS (SELECT a, least(a, min(b)) AS thread FROM r GROUP BY a),
z AS (SELECT c, t, count(*) AS n, max(level) AS hi FROM p GROUP BY c, t)
SELECT o.c AS conv_id, o.t AS turn, o.role, o.own AS text, coalesce(z.n, 0)::INTEGER AS n_quotes, coalesce(z.hi, 0)::INTEGER AS max_level, y.pc AS parent_conv, y.pt AS parent_turn, coalesce(h.thread, o.c) AS thread, d.depth::INTEGER AS depth, d.path AS sort_path
FROM o JOIN y ON o.c = y.c AND o.t = y.t JOIN d ON o.c = d.c AND o.t = d.t LEFT JOIN h ON o.c = h.a LEFT JOIN z ON o.c = z.c AND o.t = z.t"""

ORACLES = {"op8_quotation_linking": QUOTES, "op1_line_dedup": LINES, "op2_jaccard_groups": JACCARD, "op6_template_decontamination": LEAKS}
