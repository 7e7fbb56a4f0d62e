"""DuckDB SQL of the sentence and progress queries."""

from leafmill.checks import duck as D
from leafmill.checks.inputs import blocks_of
from leafmill.plans.inputs import LINE_TAILS

TAILS = "[" + ", ".join(D.lit(s) for s in LINE_TAILS) + "]"
CITED = f"""cited_docs AS (
  SELECT doc_id, source, list_aggregate(list_transform(string_split(text, chr(10)), lambda line, i:
    CASE WHEN (i - 1) % 5 = 0 THEN 'Part ' || ((i - 1) // 5 + 1)::varchar || chr(10) ELSE '' END || line
    || ({TAILS})[((doc_id + i - 1) % {len(LINE_TAILS)} + 1)::int]), 'string_agg', chr(10))
    || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '6. References' || chr(10) || 'Smith, J. 2001. A book.' || chr(10) || 'Conclusion' || chr(10) || 'Last words.'
       ELSE chr(10) || 'Conclusion and outlook' || chr(10) || 'First words.' || chr(10) || 'Last words.' END AS text
  FROM documents),
{blocks_of('cited_docs')}"""

DOT = "․"


def shield(x: str) -> str:
    edge, end = r"(^|[^\p{L}\d])", r"($|[^\p{L}\d])"
    for n in (4, 3, 2):
        body = "".join(r"([A-Z])\." for _ in range(n))
        new = "\\1" + "".join(f"\\{i + 2}{DOT}" for i in range(n)) + f"\\{n + 2}"
        for _ in range(2):
            x = D.sub(x, edge + body + end, new)
    for pat, new in [
        (edge + r"([eEiI])\.([gGeE])\." + end, f"\\1\\2{DOT}\\3{DOT}\\4"),
        (edge + r"((?i:etc|mr|mrs|ms|dr|prof|sr|jr|vs|no))\." + end, f"\\1\\2{DOT}\\3"),
    ]:
        for _ in range(2):
            x = D.sub(x, pat, new)
    return x


def sentence_rows(source: str, keys: str) -> str:
    """CTE sents(keys, idx, s, e, text) of a (keys, text) relation with collapsed text."""
    return f"""sp AS (SELECT {keys}, text, regexp_extract_all({shield('text')}, '[^.!?]+[.!?]?|[.!?]') AS parts FROM {source}),
se AS (SELECT {keys}, text, unnest(parts) AS p, generate_subscripts(parts, 1) AS idx FROM sp),
so AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY {keys} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS at_ FROM se),
sents AS (SELECT {keys}, idx, (at_ + length(p) - length(ltrim(p)))::int AS s, (at_ + length(rtrim(p)))::int AS e,
   substr(text, (at_ + length(p) - length(ltrim(p)) + 1)::int, length(trim(p))::int) AS text
  FROM so WHERE trim(p) <> '' AND NOT regexp_matches(p, '^[.!?]$'))"""


YEAR = r"\b(?:19|20)\d{2}[a-z]?\b"
AUTHOR = r"\b[A-Z][A-Za-z'`\-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z'`\-]+)?(?:\s+et al\.?)?(?:,\s*|\s+)(?:19|20)\d{2}[a-z]?\b"
INLINE_AUTHOR = r"\b[A-Z][A-Za-z'`\-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z'`\-]+)?(?:\s+et al\.)?,\s*(?:19|20)\d{2}[a-z]?\b"
REF = r"[\p{L}\d+]*\d[\p{L}\d+]*"


def is_citation(c: str, author: str, starts: bool) -> str:
    opening = f" OR regexp_matches(lower(trim({c}, '() ')), '^(?:see |cf |cf\\. |e\\.g\\. |i\\.e\\. |compare |contra )')" if starts else ""
    return (
        f"({D.rx(c, YEAR)} AND (contains(lower({c}), 'et al'){opening} OR contains({c}, ';') OR {D.rx(c, author)} "
        f"OR {D.count_of(c, YEAR)} >= 2))"
    )


def strip_citations(x: str) -> str:
    t = D.sub(x, r"([\p{L}\]).,;:!?])[¹²³⁰⁴-⁹]+", "\\1")
    t = D.sub(t, rf"\[\s*{REF}(?:\s*[-,;–—]\s*{REF})*\s*\]", " ")
    t = D.sub(t, r"\(\s*\d{1,3}(?:\s*[-,;–—]\s*\d{1,3})*\s*\)", " ")
    parts = f"regexp_extract_all({t}, '\\([^()]*\\)|[^()]+|[()]')"
    t = f"list_aggregate(list_transform({parts}, lambda c: CASE WHEN regexp_matches(c, '^\\([^()]*\\)$') AND {is_citation('c', AUTHOR, True)} THEN ' ' ELSE c END), 'string_agg', '')"
    t = f"coalesce({t}, '')"
    t = D.sub(t, r"\s+([,.;:!?])", "\\1")
    t = D.sub(t, r"([,.;:!?])(?:\s*[,.;:!?])+", "\\1")
    t = D.sub(D.sub(t, r"\(\s*\)"), r"\[\s*\]")
    return f"trim({D.sub(t, r'\s{2,}', ' ')})"


STRIPPED = "CASE WHEN regexp_matches(t, '[\\p{L}\\p{Nd}]') THEN t ELSE '' END"
REFHEAD = (
    "trim(" + D.sub(D.sub(D.sub("lower(text)", r"^[0-9ivxlcdm.\-\s]+"), r"[^a-z\s]", " "), r"\s+", " ")
    + ") IN ('references','reference list','bibliography','works cited','citations','references and notes','notes and references','literature cited')"
)
BEFORE = f"""cut AS (SELECT doc_id, min(pos) FILTER (type = 'Heading' AND {REFHEAD}) AS at_ FROM blocks GROUP BY doc_id),
body AS (SELECT b.* FROM blocks b JOIN cut USING (doc_id) WHERE at_ IS NULL OR pos < at_)"""

# sentences of 260 characters at_ most, as the reader hears them
SLICES = """long_c AS (SELECT doc_id, pos, idx, s, e, text, regexp_extract_all(text, '[^,;:]+[,;:]?|[,;:]') AS parts FROM sents WHERE e - s > 260),
long_e AS (SELECT *, unnest(parts) AS p, generate_subscripts(parts, 1) AS ci FROM long_c),
long_o AS (SELECT *, s + coalesce(sum(length(p)) OVER (PARTITION BY doc_id, pos, idx ORDER BY ci ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS at_ FROM long_e),
clauses AS (SELECT doc_id, pos, idx, s AS ss, e AS ee, text AS st, ci, (at_ + length(p) - length(ltrim(p)))::int AS s, (at_ + length(rtrim(p)))::int AS e
  FROM long_o WHERE trim(p) <> '' AND NOT regexp_matches(p, '^[,;:]$')),
nclauses AS (SELECT *, count(*) OVER (PARTITION BY doc_id, pos, idx) AS n FROM clauses),
parts0 AS (
  SELECT doc_id, pos, idx, 0 AS ci, s, e, text, s AS bs FROM sents WHERE e - s <= 260
  UNION ALL SELECT doc_id, pos, idx, ci, s, e, st, ss FROM nclauses WHERE n > 1
  UNION ALL SELECT DISTINCT doc_id, pos, idx, 0, ss, ee, st, ss FROM nclauses WHERE n <= 1
  UNION ALL SELECT doc_id, pos, idx, 0, s, e, text, s FROM sents x WHERE e - s > 260 AND NOT EXISTS (SELECT 1 FROM clauses c WHERE c.doc_id = x.doc_id AND c.pos = x.pos AND c.idx = x.idx)),
parts1 AS (SELECT *, unnest(range(s, e, 260)) AS at_ FROM parts0),
slices AS (SELECT doc_id, pos, idx, ci, at_::int AS s, least(at_ + length(t), e)::int AS e, t AS text FROM (
  SELECT *, CASE WHEN e - s > 260 THEN trim(substr(text, (at_ - bs + 1)::int, least(260, e - at_)::int)) ELSE substr(text, (s - bs + 1)::int, (e - s)::int) END AS t FROM parts1) WHERE t <> '')"""

SEGS = f"""{BEFORE},
paras AS (SELECT doc_id, pos, {D.collapse('text')} AS text FROM body WHERE type = 'Paragraph'),
{sentence_rows('paras', 'doc_id, pos')},
{SLICES},
seg0 AS (SELECT doc_id, pos AS block, idx, ci, s, e, {STRIPPED} AS text FROM (SELECT *, {strip_citations('text')} AS t FROM slices)
  UNION ALL SELECT doc_id, pos, 0, 0, 0, length(text), text || '.' FROM body WHERE type = 'Heading'),
seg1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block, idx, ci, s) - 1 AS seg,
   greatest(length(text), 1) AS u, greatest({D.count_of('text', r"[\p{L}\p{N}][\p{L}\p{N}'’\-]*")}, 1) AS w FROM seg0 WHERE text <> ''),
segs AS (SELECT doc_id, seg, block, s, e, text, (sum(u) OVER q - u)::int AS u0, (sum(u) OVER q)::int AS u1, (sum(w) OVER q - w)::int AS w0, (sum(w) OVER q)::int AS w1
  FROM seg1 WINDOW q AS (PARTITION BY doc_id ORDER BY seg))"""

POS = """pos AS (SELECT event_id, user_id, event_id // 10 AS doc_id, k % 10 AS block, (floor(value)::int % 200) AS off, k
  FROM (SELECT *, (props->>'$.k')::int AS k FROM events))"""
LOCATED = f"""{POS},
tot AS (SELECT doc_id, max(u1) AS total_units, max(w1) AS total_words, max(seg) AS last_seg FROM segs GROUP BY doc_id),
hit AS (SELECT p.event_id, min(g.seg) FILTER (g.block = p.block AND p.off >= g.s AND p.off < g.e) AS exact,
   max(g.seg) FILTER (g.block = p.block AND p.off >= g.s) AS before, min(g.seg) FILTER (g.block = p.block) AS first_in,
   min(g.seg) FILTER (g.block > p.block) AS later, max(g.seg) AS last, count(g.seg) AS n
  FROM pos p JOIN (SELECT DISTINCT doc_id FROM documents) d USING (doc_id) LEFT JOIN segs g USING (doc_id) GROUP BY p.event_id),
loc AS (SELECT p.*, h.exact, h.before, h.first_in, h.later, h.last, coalesce(h.exact, h.before, h.first_in, h.later, h.last) AS seg FROM pos p JOIN hit h USING (event_id)),
located AS (SELECT l.*, g.u0, g.w0, g.w1, g.text, t.total_units, t.total_words,
   coalesce(least(greatest(l.off - g.s, 0), greatest(length(g.text) - 1, 0)), 0) AS inner_at
  FROM loc l LEFT JOIN segs g ON g.doc_id = l.doc_id AND g.seg = l.seg LEFT JOIN tot t ON t.doc_id = l.doc_id)"""
FRACTION = "coalesce(CASE WHEN total_units > 0 THEN least(greatest((u0 + inner_at)::double / total_units, 0), 1) END, 0)"
SECONDS = """floor(round(greatest(total_words - (w0 + (w1 - w0) * (inner_at::double / greatest(length(text), 1))), 0)
  / (greatest(0.5 + (k % 4) * 0.5, 0.1)::double * 170) * 60, 6))::int"""
LABEL = """CASE WHEN seconds < 45 THEN '<1m left' WHEN seconds < 3600 THEN greatest((seconds + 30) // 60, 1)::varchar || 'm left'
  WHEN (seconds % 3600 + 30) // 60 <= 0 THEN (seconds // 3600)::varchar || 'h left'
  ELSE (seconds // 3600)::varchar || 'h ' || ((seconds % 3600 + 30) // 60)::varchar || 'm left' END"""

CONCLUSION = "regexp_matches(" + D.sub("lower(text)", r"[^a-z\s]", " ") + ", 'conclusion|discussion|final remarks|closing')"
SKIM = f"""WITH {CITED},
r AS (SELECT *, count(*) FILTER (type = 'Heading') OVER w AS section, count(*) FILTER (type = 'Paragraph') OVER w AS n,
   count(*) FILTER (type = 'Paragraph') OVER (PARTITION BY doc_id) AS total, count(*) FILTER (type = 'Heading') OVER (PARTITION BY doc_id) AS heads
  FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
q AS (SELECT *, count(*) FILTER (type = 'Paragraph') OVER (PARTITION BY doc_id, section ORDER BY pos) AS rank,
   max(CASE WHEN type = 'Heading' AND {CONCLUSION} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section) AS ending FROM r),
l AS (SELECT doc_id, pos, text, CASE WHEN heads = 0 THEN CASE WHEN type <> 'Paragraph' THEN NULL WHEN n = 1 THEN 'Opening' WHEN n <= 4 THEN 'Key passage' WHEN n = total THEN 'Closing' END
  WHEN type = 'Heading' THEN 'Heading' WHEN section = 0 AND n = 1 THEN 'Opening' WHEN section = 0 AND n = 2 THEN 'Lead-in'
  WHEN section > 0 AND rank = 1 THEN 'Key passage' WHEN section > 0 AND rank = 2 AND ending = 1 THEN 'Closing' WHEN n = total THEN 'Closing' END AS label FROM q)
SELECT doc_id, pos, label, text FROM l WHERE label IS NOT NULL"""

RULES = [("mr\\.", "Mister"), ("mrs\\.", "Misses"), ("ms\\.", "Miss"), ("dr\\.", "Doctor"), ("prof\\.", "Professor"),
         ("u\\.s\\.(?:a\\.)?", "United States"), ("u\\.k\\.", "United Kingdom"), ("e\\.u\\.", "European Union"),
         ("u\\.n\\.", "United Nations"), ("e\\.g\\.", "for example"), ("i\\.e\\.", "that is"), ("etc\\.", "et cetera"),
         ("ph\\.d\\.", "P H D"), ("m\\.d\\.", "M D")]


def spoken(x: str) -> str:
    """Token-wise expansion: words are split at_ blanks, so edges are the token ends or signs."""
    word = "w"
    arms = ""
    lead = f"regexp_extract({word}, '^[^\\p{{L}}\\d]*')"
    for pat, out in RULES:
        arms += f" WHEN regexp_matches({word}, '(?i)^[^\\p{{L}}\\d]*{pat}[^\\p{{L}}\\d]*$') THEN regexp_replace({word}, '(?i){pat}', '{out}')"
    acro = f" WHEN regexp_matches({word}, '^[^\\p{{L}}\\d]*(?:[A-Z]\\.){{2,}}[^\\p{{L}}\\d]*$') THEN {lead} || trim(regexp_replace(regexp_replace(regexp_extract({word}, '(?:[A-Z]\\.){{2,}}'), '\\.', '', 'g'), '(.)', '\\1 ', 'g')) || regexp_extract({word}, '(?:[A-Z]\\.){{2,}}([^\\p{{L}}\\d]*)$', 1)"
    return f"list_aggregate(list_transform(string_split({x}, ' '), lambda w: CASE{arms}{acro} ELSE w END), 'string_agg', ' ')"


FULL = "list_transform(regexp_extract_all(text, '(?i)https?://[^\\s<>\"''()]+'), lambda u: regexp_replace(u, '[.,;:!?)\\]}]+$', ''))"
BARE = "list_transform(regexp_extract_all(text, '(?i)\\b(?:[a-z0-9-]+\\.)+[a-z]{2,}(?:/[^\\s<>\"'']*)?'), lambda u: 'https://' || regexp_replace(u, '[.,;:!?)\\]}]+$', ''))"
URLS = f"""urls AS (SELECT doc_id, pos, unnest(u) AS url, generate_subscripts(u, 1) - 1 AS n FROM (
  SELECT doc_id, pos, CASE WHEN len({FULL}) > 0 THEN {FULL} ELSE {BARE} END AS u FROM blocks))"""

PARAS = f"paras AS (SELECT doc_id, pos, {D.collapse('text')} AS text FROM blocks WHERE type = 'Paragraph')"

CHECKS = {
    "n01_sentence_table": f"WITH {CITED}, {PARAS}, {sentence_rows('paras', 'doc_id, pos')} SELECT doc_id, pos, s, e, text FROM sents",
    "n02_oversize_split": f"WITH paras AS (SELECT doc_id, 0 AS pos, {D.collapse(D.sub('text', r'[.!?\n]+', ' '))} AS text FROM documents), {sentence_rows('paras', 'doc_id, pos')}, {SLICES} SELECT doc_id, s, e, text FROM slices",
    "n03_citations_stripped": f"WITH {CITED} SELECT doc_id, pos, {STRIPPED} AS text FROM (SELECT doc_id, pos, {strip_citations('text')} AS t FROM blocks)",
    "n04_citation_ranges": f"""WITH {CITED},
p AS (SELECT doc_id, pos, regexp_extract_all(text, '\\[\\s*\\d+(?:\\s*[-,;–—]\\s*\\d+)*\\s*\\]|\\([^()]*\\)|[^\\[(]+|[\\[(]') AS parts FROM blocks),
x AS (SELECT doc_id, pos, unnest(parts) AS c, generate_subscripts(parts, 1) AS i FROM p),
o AS (SELECT *, coalesce(sum(length(c)) OVER (PARTITION BY doc_id, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS s FROM x)
SELECT doc_id, pos, s, (s + length(c))::int AS e FROM o WHERE regexp_matches(c, '^\\[\\s*\\d') OR (regexp_matches(c, '^\\([^()]*\\)$') AND {is_citation('c', INLINE_AUTHOR, False)})""",
    "n05_back_matter_cut": f"WITH {CITED}, {BEFORE} SELECT doc_id, pos, type, text FROM body",
    "n06_abbreviations": f"WITH {CITED} SELECT doc_id, pos, {spoken('text')} AS spoken FROM blocks",
    "n08_sections": f"""WITH {CITED} SELECT doc_id, pos, type, coalesce(last_value(CASE WHEN type = 'Heading' THEN {D.collapse('text')} END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY pos), 'Report ' || doc_id::varchar) AS section FROM blocks""",
    "n09_skim": SKIM,
    "n11_listing": f"""WITH {CITED}, k AS (SELECT * FROM blocks WHERE doc_id % 3 <> 0 OR (type = 'Heading' AND doc_id % 9 <> 0)),
 a AS (SELECT doc_id, arg_min(text, pos) FILTER (type = 'Paragraph') AS para, arg_min(text, pos) FILTER (type = 'Heading' AND lower(text) <> 'report ' || doc_id::varchar) AS head FROM k GROUP BY doc_id)
 SELECT d.doc_id, coalesce(para, head, CASE CASE WHEN d.doc_id % 9 = 0 THEN d.doc_id // 9 % 5 ELSE 0 END WHEN 1 THEN 'Captured text' WHEN 2 THEN 'Local PDF file' WHEN 3 THEN source WHEN 4 THEN source ELSE 'www.example.com • ' || source END) AS summary FROM documents d LEFT JOIN a USING (doc_id)""",
    "n12_summary_sources": f"""WITH {CITED}, p AS (SELECT doc_id, pos, type, {D.collapse('text')} AS t, lag(type) OVER w AS ptype, lag({D.collapse('text')}) OVER w AS pt FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
 SELECT d.doc_id, coalesce(s, '') AS source_text FROM documents d LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN ptype = 'Heading' THEN '[' || pt || '] ' || t ELSE t END, chr(10) ORDER BY pos) AS s FROM p WHERE type = 'Paragraph' GROUP BY doc_id) USING (doc_id)""",
    "n14_url_mentions": f"WITH {CITED}, {URLS} SELECT doc_id, pos, n, url FROM urls",
    "n15_best_urls": f"""WITH {CITED}, {URLS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY contains(url, 'example.org') DESC, length(url) DESC, url DESC) AS rn FROM urls WHERE regexp_matches(url, '^https?://[^/]+'))
 SELECT doc_id, url, CASE WHEN ends_with(lower(url), '.pdf') THEN url END AS pdf_url FROM r WHERE rn = 1""",
    "a01_cumulative_units": f"WITH {CITED}, {SEGS} SELECT doc_id, seg, block, u0, u1, w0, w1 FROM segs",
    "a02_progress": f"WITH {CITED}, {SEGS}, {LOCATED} SELECT event_id, doc_id, round({FRACTION}, 6) AS fraction FROM located",
    "a03_seeks": f"""WITH {CITED}, {SEGS}, {POS}, tot AS (SELECT doc_id, max(u1) AS total_units FROM segs GROUP BY doc_id),
 t AS (SELECT p.event_id, p.doc_id, least(greatest(floor((k / 100.0)::double * total_units)::int, 0), greatest(total_units - 1, 0)) AS target FROM pos p JOIN tot USING (doc_id))
 SELECT t.event_id, t.target, g.seg, (t.target - g.u0)::int AS "inner" FROM t JOIN segs g ON g.doc_id = t.doc_id AND t.target >= g.u0 AND t.target < g.u1""",
    "a04_remaining_time": f"WITH {CITED}, {SEGS}, {LOCATED}, s AS (SELECT event_id, {SECONDS} AS seconds, {FRACTION} AS fraction FROM located) SELECT event_id, seconds, floor(fraction * 100)::int::varchar || '% · ' || {LABEL} AS label FROM s",
    "a05_position_segments": f"""WITH {CITED}, {SEGS}, {LOCATED} SELECT event_id, seg, inner_at AS "inner", coalesce(exact, first_in, later, last) AS seg_or_first, coalesce(exact, first_in) AS seg_in_block FROM located""",
}
