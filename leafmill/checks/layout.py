"""DuckDB SQL of the layout queries."""

from leafmill.checks import duck as D
from leafmill.checks.inputs import NOISY_DOCS
from leafmill.operators import layout as L

BOXES = f"""{NOISY_DOCS},
b0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM noisy_docs),
boxes AS (SELECT doc_id, pos, trim(raw) AS text, {D.collapse('raw')} AS t, (pos * 40 + pos % 3)::int AS top, CASE WHEN pos % 5 = 4 THEN 160 ELSE 40 END AS l,
  (pos * 40 + pos % 3 + 32)::int AS bottom, pos = 0 AS heading, pos % 7 = 3 AS clickable, CASE WHEN pos % 29 = 28 THEN 'com.android.systemui' ELSE 'org.example.browser' END AS package FROM b0),
bx AS (SELECT *, l + least(length(text) * 8, 980) AS r FROM boxes)"""


def letters(x):
    return D.count_of(x, r"\p{L}")


def inline(x, low, blocked):
    return f"(length({x}) BETWEEN {low} AND 72 AND NOT {D.in_list(f'lower({x})', blocked)} AND {D.words(x)} BETWEEN 1 AND 6 AND {letters(x)} >= greatest({low}, length({x}) // 2))"


def link(x):
    return f"({inline(x, 3, L.LINK_BLOCKED)} AND ({D.words(x)} > 1 OR {D.rx(x, r'^\p{L}')}))"


def article(x):
    return (
        f"({inline(x, 4, L.TEXT_BLOCKED)} AND CASE WHEN {D.words(x)} = 1 THEN {D.rx(x, r'^\p{L}')} "
        f"ELSE {D.rx(x, r'(?:^|\s)\p{Lu}')} OR contains({x}, ',') END)"
    )


def punct(x):
    return D.rx(x, "^[.,;:!?]+$")


def title(x):
    return f"(length({x}) BETWEEN 6 AND 140 AND {D.words(x)} BETWEEN 2 AND 18 AND NOT {D.rx(x, '[.?!]$')} AND {D.rx(x, r'\p{Lu}')})"


NOISY = (
    "(" + " OR ".join(f"lower(t) = {D.lit(p)} OR starts_with(lower(t), {D.lit(p + ' ')})" for p in L.BAD_LABELS)
    + f" OR contains(package, 'systemui') OR (clickable AND length(t) < 36 AND {D.words('t')} < 6 AND NOT {link('t')})"
    f" OR (length(t) < 18 AND {D.words('t')} < 3 AND NOT heading AND NOT (CASE WHEN clickable THEN {link('t')} ELSE {article('t')} END) AND NOT {punct('t')}))"
)
CAND = f"""cand AS (SELECT *, CASE WHEN pos % 11 = 10 THEN 'button' WHEN pos % 13 = 12 THEN 'toolbarview' ELSE 'textview' END AS widget, CASE WHEN pos % 6 <> 5 AND t <> '' THEN t
   WHEN d <> '' AND NOT regexp_matches(lower(d), '^(?:https?://|www\\.)|%2f|%3a') AND {D.count_of('d', r'[^\p{L}\p{Nd}\s]')} <= greatest(4, length(d) // 3) THEN d END AS c
  FROM (SELECT *, trim('Picture of ' || t) AS d FROM bx))"""
INCLUDED = f"""CASE WHEN c IS NULL OR c = '' OR contains(package, 'systemui') OR (length(c) <= 32 AND {D.in_list('lower(c)', L.EXACT_LABELS)})
   OR (length(c) <= 48 AND {D.starts('lower(c)', L.PREFIX_LABELS)}) OR widget = 'toolbarview' THEN false
  WHEN widget = 'button' THEN length(c) >= 70 AND {D.words('c')} >= 10 WHEN {punct('c')} THEN true
  WHEN length(c) < 36 AND {D.words('c')} < 6 AND NOT heading THEN CASE WHEN clickable THEN {link('c')} ELSE {article('c')} END
  ELSE {D.words('c')} >= 8 OR length(c) >= 52 OR heading OR {title('c')} END"""
CONT = f"({D.rx('t', r'^[,;:.)\]}]')} OR ({D.rx('t', r'^\p{Ll}')} AND (length(t) >= 40 OR {D.words('t')} >= 7)))"
SOLID = f"(NOT heading AND (length(t) >= 120 OR {D.words('t')} >= 18))"
EDGE = f"""e AS (SELECT *, {SOLID} AS solid FROM bx),
m AS (SELECT *, min(pos) FILTER (solid) OVER w AS f, max(pos) FILTER (solid) OVER w AS z FROM e WINDOW w AS (PARTITION BY doc_id)),
k AS (SELECT *, CASE WHEN f IS NULL THEN true WHEN pos < f THEN heading OR {title('t')} OR (length(t) >= 40 AND {D.words('t')} >= 6 AND NOT clickable)
   WHEN pos > z THEN NOT clickable AND (length(t) >= 60 OR {D.words('t')} >= 10) ELSE true END AS keep FROM m)
SELECT doc_id, top, text FROM (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY doc_id) AS n FROM k) WHERE keep OR n = 0"""
ANCHOR = f"""e AS (SELECT *, {SOLID} AS solid FROM bx),
a AS (SELECT doc_id, count(*) AS n, list_sort(list(l) FILTER (solid)) AS ls, list_sort(list(r - l) FILTER (solid)) AS ws FROM e GROUP BY doc_id),
q AS (SELECT e.*, a.n, a.ls, a.ws, coalesce(lag(solid) OVER w, false) AND coalesce(lead(solid) OVER w, false) AS mid, abs(l - ls[len(ls) // 2 + 1]) AS delta, ws[len(ws) // 2 + 1] AS width FROM e JOIN a USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, top, text FROM q WHERE CASE WHEN n < 3 OR ls IS NULL OR len(ls) = 0 OR heading OR solid THEN true
  WHEN mid AND NOT clickable AND {D.words('t')} <= 8 AND length(t) <= 52 AND delta >= 100 THEN false WHEN clickable AND {link('t')} AND mid AND delta <= 72 THEN true
  WHEN clickable AND length(t) <= 60 AND {D.words('t')} <= 10 THEN false WHEN delta >= 120 AND length(t) <= 90 AND r - l <= floor(width * 0.55) THEN false ELSE true END"""

CHECKS = {
    "s04_box_table": f"""WITH {BOXES} SELECT translate(text, chr(9) || chr(13), '  ') AS text, top, l AS "left", bottom, r AS "right", heading::int AS heading, clickable::int AS clickable
 FROM bx WHERE {D.collapse('text')} <> ''""",
    "l01_box_noise": f"WITH {BOXES} SELECT doc_id, pos, {NOISY}::int AS noisy FROM bx",
    "l02_box_include": f"WITH {BOXES}, {CAND} SELECT doc_id, pos, c AS text, ({INCLUDED})::int AS included FROM cand",
    "l03_reading_order": f"""WITH {BOXES}, o AS (SELECT *, CASE WHEN top - lag(top) OVER (PARTITION BY doc_id ORDER BY top, l) > 14 THEN 1 ELSE 0 END AS brk FROM bx),
 g AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY top, l) AS line FROM o)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, {CONT}, l, bottom - top, top) - 1 AS rank, line, top, l AS "left" FROM g""",
    "l05_edge_trim": f"WITH {BOXES}, {EDGE}",
    "l06_off_anchor": f"WITH {BOXES}, {ANCHOR}",
}
