"""DuckDB SQL of the paged text queries."""

from leafmill.checks import duck as D
from leafmill.functions import paged as L
from leafmill.functions.rules import any_of
from leafmill.plans.inputs import FRONT_LINES, PAGE_SIZE, PAGE_TAILS

TAILS = "[" + ", ".join(D.lit(s) for s in PAGE_TAILS) + "]"
FRONT = D.lit("\n".join(FRONT_LINES) + "\n")
PAGED = f"""paged AS (
  SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN source || '.pdf' ELSE 'A short note from ' || source END AS given_title,
    CASE WHEN doc_id % 3 = 0 THEN {FRONT} ELSE '' END || list_aggregate(list_transform(string_split(text, chr(10)), lambda line, i:
      CASE WHEN (i - 1) % 4 = 3 THEN line || chr(10) || ({TAILS})[((doc_id + (i - 1) // 4) % {len(PAGE_TAILS)} + 1)::int] ELSE line END), 'string_agg', chr(10)) AS text
  FROM documents)"""


def repair(x: str) -> str:
    t = f"translate({x}, chr(160), ' ')"
    t = D.sub(t, "(\\p{L})[\\x02\\x{AD}\\x{2010}\\x{2011}\\x{2060}\\x{FEFF}]+\\s*$", "\\1-")
    for _ in range(2):
        t = D.sub(t, "(\\p{L})[\\x00-\\x1f\\x7f\\x{AD}\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}]+(\\p{L})", "\\1\\2")
    for _ in range(2):
        t = D.sub(t, "(\\p{L})[\\x{FFFD}\\x{2022}\\x{2023}\\x{2043}\\x{2219}\\x{25A0}-\\x{25FF}]+(\\p{L})", "\\1\\2")
    return D.sub(D.sub(t, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"), "[\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}]")


LINES = f"""{PAGED},
raws AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM paged),
lines AS (SELECT doc_id, source, pos, trim({repair('raw')}) AS text FROM raws)"""


def letters(x):
    return D.count_of(x, r"\p{L}")


def prose(x):
    n = D.count_of(x, r"(?:^|\s)\p{Ll}")
    return f"(length({x}) >= 45 AND ({n} >= 6 OR ({n} >= 4 AND {D.rx(x, '[.?!]')})))"


def boundary(x):
    return f"(lower({x}) IN ('abstract', 'summary', 'introduction') OR {D.rx(f'lower({x})', r'^(?:[1i][.]?)\s+introduction$')})"


def heading(x):
    return (
        f"({x} <> '' AND length({x}) <= 90 AND {D.words(x)} <= 12 AND NOT {D.rx(x, '[.?!:;]$')} AND "
        f"(({x} = upper({x}) AND {letters(x)} > 1) OR {D.rx(x, r'^[0-9IVX.]+\s+[A-Z]')} OR "
        f"{D.count_of(x, r'(?:^|\s)\p{Lu}')} >= {D.words(x)} * 0.7))"
    )


def name_lists(x):
    segs = f"list_filter(list_transform(string_split_regex({x}, '(?i)\\s*,\\s*|\\s+(?:and|&)\\s+'), lambda s: trim(s)), lambda s: s <> '')"
    return f"list_transform({segs}, lambda s: list_transform(list_filter(string_split_regex(s, '\\s+'), lambda w: w <> ''), lambda w: {D.sub('w', r'[^\p{L}]')}))"


def author_line(x):
    c = D.collapse(D.sub(D.sub(D.collapse(x), r"(\p{L})[\d*†‡§∗]+", "\\1"), r"(\p{L})\((?:\d+|[*†‡§∗]+)\)", "\\1"))
    ss = name_lists(c)
    name = D.rx("w", L.NAME_WORD)
    return (
        f"(length({c}) BETWEEN 8 AND 160 AND NOT {D.rx(c, r'[@\p{Nd}]|[.]$')} AND NOT {D.has(f'lower({c})', L.AUTHOR_LINE_STOPS)} "
        f"AND {D.words(c)} BETWEEN 2 AND 12 AND len({ss}) >= 2 "
        f"AND len(list_filter({ss}, lambda ws: len(ws) NOT BETWEEN 1 AND 4 OR len(list_filter(ws, lambda w: NOT {name})) > 0)) = 0 "
        f"AND len(list_filter({ss}, lambda ws: len(ws) >= 2)) >= 2)"
    )


def metadata(x):
    low = f"lower({x})"
    return (
        f"({x} <> '' AND (contains({x}, '@') OR {D.has(low, L.METADATA_WORDS)} OR {D.rx(low, r'^(?:received|published|revised|accepted)\b')} "
        f"OR {D.rx(x, r'^\d+(?:\s*,\s*\d+)*$')} OR {D.rx(x, L.AFFILIATION_START)} OR ({x} <> upper({x}) AND {D.rx(x, L.NAME_LIST)}) OR {author_line(x)}))"
    )


def footnote(x):
    return (
        f"({x} <> '' AND (starts_with(lower({x}), 'footnote') OR contains({x}, '@') OR {D.rx(x, r'^[*†‡§]\s+.+$')} OR {D.rx(x, r'^\d{1,2}[A-Z]')} "
        f"OR (NOT {heading(x)} AND NOT {boundary(x)} AND length({x}) <= 160 AND {D.rx(x, r'^\d{1,2}[.)]?\s+.+$')})))"
    )


def running(x):
    return (
        f"(length({x}) BETWEEN 2 AND 60 AND NOT {D.rx(x, r'^\d+$|[.!?]$|@')} AND {D.words(x)} <= 10 "
        f"AND {D.count_of(x, r'[^\p{L}\p{Nd}\s]')} <= 4 AND {letters(x)} >= 2)"
    )


def pattern_line(x, first):
    rest = f"trim({D.sub(x, r'^\d+\s+')})"
    return (
        f"({D.rx(x, L.ARXIV_HEADER)} OR {D.rx(x, r'^\d+$')} OR {D.rx(x, r'(?i)^page\s+\d+(?:\s+of\s+\d+)?$')} OR (NOT {first} AND {D.rx(x, r'^\d+\s+\S')} "
        f"AND ({author_line(rest)} OR ({rest} = upper({rest}) AND NOT ends_with({rest}, '.') AND {letters(rest)} >= 8))))"
    )


def abstract_body(x):
    b = f"trim(regexp_extract({x}, '(?is)^(?:abstract|summary)\\s*[:.\\-–—]?\\s+(.+)$', 1))"
    return f"({D.rx(x, '(?i)^(?:abstract|summary)')} AND length({b}) >= 40 AND {prose(b)})"


def join_lines(left, right):
    frag = f"regexp_extract({left}, '([\\p{{L}}\\p{{Nd}}]*)-$', 1)"
    start = f"regexp_extract({right}, '[\\p{{L}}\\p{{Nd}}]')"
    pre = D.rx(f"lower({frag})", "^" + any_of(L.HYPHENATED_PREFIXES) + "$")
    keep = f"({frag} <> '' AND ({D.rx(start, r'[\p{Lu}\p{Nd}]')} OR {pre} OR ({D.rx(frag, r'\p{L}')} AND NOT {D.rx(frag, r'\p{Ll}')})))"
    drop = f"({frag} <> '' AND {D.rx(start, r'\p{Ll}')} AND {D.rx(frag, r'\p{Ll}')} AND NOT {pre})"
    return (
        f"(CASE WHEN {right} = '' THEN {left} WHEN {left} = '' THEN {right} WHEN ends_with({left}, '-') AND {start} <> '' THEN "
        f"CASE WHEN {keep} THEN {left} || {right} WHEN {drop} THEN substr({left}, 1, length({left}) - 1) || {right} ELSE {left} || ' ' || {right} END "
        f"ELSE {left} || ' ' || {right} END)"
    )


ASSEMBLED = f"""WITH RECURSIVE {PAGED},
runs AS (SELECT doc_id, unnest(r) AS run, generate_subscripts(r, 1) - 1 AS pos FROM (
  SELECT doc_id, string_split({D.sub('text', r'([.!?])\n', chr(92) + '1' + chr(10) + chr(10))}, chr(10) || chr(10)) AS r FROM paged)),
items AS (SELECT doc_id, pos, list_transform(string_split(run, chr(10)), lambda x: trim({repair('x')})) AS ls FROM runs),
walk AS (SELECT doc_id, pos, 0 AS n, ls, '' AS para FROM items
  UNION ALL SELECT doc_id, pos, n + 1, ls, {join_lines('para', 'ls[n + 1]')} FROM walk WHERE n < len(ls))
SELECT doc_id, pos, {D.collapse('para')} AS text FROM walk WHERE n = len(ls)"""

MERGE_OK = (
    f"(w.type = 'Paragraph' AND s.type = 'Paragraph' AND w.text <> '' AND s.text <> '' AND (NOT {D.rx('w.text', '[.!?:]$')} OR {D.rx('s.text', r'^\p{Ll}')} "
    f"OR (length(w.text) < 90 AND {D.rx('s.text', r'^[(\[]')})) AND NOT s.is_heading AND NOT s.is_meta)"
)
SHORT_MERGE = f"""WITH RECURSIVE {LINES},
seq AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, text, is_heading, {metadata('text')} AS is_meta,
   CASE WHEN is_heading THEN 'Heading' ELSE 'Paragraph' END AS type FROM (SELECT *, {heading('text')} AS is_heading FROM lines WHERE text <> '')),
walk AS (SELECT doc_id, n, 0::bigint AS pos, type, text FROM seq WHERE n = 1
  UNION ALL SELECT doc_id, n, CASE WHEN m THEN pos ELSE pos + 1 END, CASE WHEN m THEN wtype ELSE type END, CASE WHEN m THEN wtext || ' ' || text ELSE text END FROM (
    SELECT w.doc_id, s.n, w.pos, w.type AS wtype, s.type, w.text AS wtext, s.text, {MERGE_OK} AS m FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.n = w.n + 1))
SELECT doc_id, pos, arg_max(type, n) AS type, arg_max(text, n) AS text FROM walk GROUP BY doc_id, pos"""

LOW = "lower(text)"
BLOB_N = D.n_contained(LOW, L.TRANSCRIPT_MARKS)
BLOB = (
    f"({BLOB_N} >= 2 OR ({BLOB_N} >= 1 AND {D.rx('text', r'\b\d{1,3}(?:\.\d{1,3}){3}\b')}) OR (starts_with(text, '[...]') AND ({BLOB_N} >= 1 OR "
    + D.rx("text", '(?i)\\b[a-z_]+\\s*=\\s*["(]') + ")))"
)
STARTS = f"({D.rx(LOW, r'^\([a-z]\)\s+|^(?:figure|fig\.|table)\s+\d+[:.]')} OR {D.starts(LOW, L.SPEAKERS)} OR contains({LOW}, 'figure 1:') OR {BLOB})"
GOES_ON = f"({STARTS} OR {D.rx(LOW, r'^\([ab]\)|follow-up q&a|model exfiltration')})"
FIGURES = f"""WITH cut AS (SELECT conv_id, turn AS t, role, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations),
talk AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY t, n) AS turn, CASE WHEN n > 1 THEN '' WHEN t % 3 = 1 THEN role || ': ' WHEN t % 3 = 2 THEN '(a) ' ELSE '' END || x AS text FROM cut),
m AS (SELECT *, {STARTS} AS st, {GOES_ON} AS go FROM talk WHERE trim(text) <> ''),
-- a run opens at a start and stays open while rows continue it; every start continues, so rows without 'go' close it
g AS (SELECT *, count(*) FILTER (NOT go) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM m),
o AS (SELECT *, go AND coalesce(max(st::int) OVER (PARTITION BY conv_id, island, go ORDER BY turn), 0) = 1 AS taken FROM g),
notes AS (SELECT conv_id, island, string_agg(trim({repair('text')}), ' ' ORDER BY turn) AS text FROM o WHERE taken GROUP BY conv_id, island)
SELECT conv_id, 'kept' AS part, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text FROM o WHERE NOT taken
UNION ALL SELECT conv_id, 'note', row_number() OVER (PARTITION BY conv_id ORDER BY island) - 1, text FROM notes"""

NUMERIC = "len(list_filter(string_split_regex(text, '\\s+'), lambda t: regexp_matches(regexp_replace(t, '^[,;:()]+|[,;:()]+$', '', 'g'), '^[-–—]?\\d+(?:\\.\\d+)?%?$') OR t IN ('-', '–', '—')))"
DIGITS = D.count_of("text", r"\p{Nd}")
TABULAR = (
    f"(length(text) >= 24 AND NOT {prose('text')} AND {D.words('text')} >= 10 AND (({NUMERIC} >= 8 AND {DIGITS} >= {letters('text')}) "
    f"OR ({NUMERIC} >= 6 AND contains(text, '0.0') AND {DIGITS} >= 12)))"
)

CHECKS = {
    "s03_page_lines": f"WITH {D.LINES} SELECT doc_id, (pos // 40)::int AS page, (pos % 40)::int AS line, raw AS text FROM lines",
    "p01_line_repair": f"WITH {LINES} SELECT doc_id, pos, text FROM lines",
    "p02_running_lines": f"""WITH {LINES}, s AS (SELECT doc_id, pos, {D.signature('text')} AS sig, {running('text')} AS ok, max(pos) OVER (PARTITION BY doc_id) // {PAGE_SIZE} + 1 AS n_pages FROM lines)
 SELECT doc_id, sig FROM s WHERE ok GROUP BY doc_id, sig, n_pages HAVING count(*) >= CASE WHEN n_pages <= 2 THEN 2 ELSE 3 END""",
    "p02_corpus_running_lines": f"WITH {LINES} SELECT source, {D.signature('text')} AS sig, count(*) AS n FROM lines WHERE {running('text')} GROUP BY ALL HAVING count(*) >= 3",
    "p03_front_protection": f"""WITH {LINES}, f AS (SELECT *, max((text = '' OR {boundary('text')} OR {abstract_body('text')} OR {prose('text')})::int) OVER (PARTITION BY doc_id ORDER BY pos) AS stopped FROM lines WHERE pos < {PAGE_SIZE})
 SELECT doc_id, {D.signature('text')} AS sig FROM f WHERE stopped = 0""",
    "p04_pattern_lines": f"WITH {LINES} SELECT doc_id, pos, {pattern_line('text', f'(pos < {PAGE_SIZE})')}::int AS dropped FROM lines",
    "p07_line_types": f"""WITH {LINES} SELECT doc_id, pos, {boundary('text')}::int AS boundary, {heading('text')}::int AS heading, {metadata('text')}::int AS metadata,
  {prose('text')}::int AS prose, {author_line('text')}::int AS author, {footnote('text')}::int AS footnote FROM lines""",
    "p09_assembled": ASSEMBLED,
    "p13_figure_sections": FIGURES,
    "p14_tabular_lines": f"WITH {LINES} SELECT doc_id, pos, {TABULAR}::int AS tabular FROM lines",
    "p15_short_merge": SHORT_MERGE,
}
