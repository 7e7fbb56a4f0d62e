"""DuckDB SQL of the clean-up queries."""

from leafmill.checks import duck as D
from leafmill.checks.sentences import CITED
from leafmill.operators import cleanup as C

# --- fixed values: written here once more, so that a wrong list in the operator shows; a test compares both ---
IGNORED_IMPORTANT = (
    "share comments comment print email copy link facebook twitter linkedin reddit whatsapp telegram safeframe container "
    "advertisement adchoices related the this that these those"
).split()
IGNORED_PROTECTED = (
    "a an and as at be but by for from if in into is it its of on or so than that the their there these this those to was we "
    "were while with you your after before during when where why how however meanwhile although because since today tomorrow "
    "yesterday share comments comment print email copy link facebook twitter linkedin reddit whatsapp telegram safeframe "
    "container related latest read more photo photos image images credit credits caption captions source sources "
    "advertisement adchoices newsletter subscribe"
).split()


def para(x):
    return D.collapse(f"translate({x}, chr(160), ' ')")


def eligible(x, p):
    ok = (
        f"length({x}) BETWEEN {p.min_chars} AND {p.max_chars} AND length({D.sub(x, r'[^\p{L}\p{Nd}]')}) >= length({x}) * 0.45::double "
        f"AND NOT {D.has(x, C.CODE_MARKS)}"
    )
    if p.name == "PDF":
        ok += (
            f" AND NOT {D.rx(x, r'(?i)^(?:figure|table|algorithm|appendix)\s+\d')} AND NOT {D.rx(x, r'^\s*(?:\[\d+\]|\d+\.)\s+[A-Z]')} "
            f"AND {D.n_contained(x, C.MATH_MARKS)} < 3"
        )
    return f"({ok})"


def packed(p, tag):
    """CTEs <tag>_chunks(doc_id, chunk, i0, i1, idx, paras, before, after)."""
    return f"""{tag}_b AS (SELECT doc_id, i, text, (type = 'Paragraph' AND {eligible('text', p)}) AS ok FROM nb),
{tag}_w AS (SELECT doc_id, i, text, ok, CASE WHEN ok THEN 0 ELSE -1 END AS chunk, 1 AS n, length(text) AS chars FROM {tag}_b WHERE i = 0
  UNION ALL SELECT b.doc_id, b.i, b.text, b.ok,
    CASE WHEN b.ok AND (NOT w.ok OR w.n >= {p.chunk_paragraphs} OR w.chars + length(b.text) > {p.chunk_chars}) THEN w.chunk + 1 ELSE w.chunk END,
    CASE WHEN b.ok AND w.ok AND w.n < {p.chunk_paragraphs} AND w.chars + length(b.text) <= {p.chunk_chars} THEN w.n + 1 ELSE 1 END,
    CASE WHEN b.ok AND w.ok AND w.n < {p.chunk_paragraphs} AND w.chars + length(b.text) <= {p.chunk_chars} THEN w.chars + length(b.text) ELSE length(b.text) END
   FROM {tag}_w w JOIN {tag}_b b ON b.doc_id = w.doc_id AND b.i = w.i + 1),
{tag}_g AS (SELECT doc_id, chunk, min(i) AS i0, max(i) AS i1, string_agg(i::varchar, ',' ORDER BY i) AS idx, list(i ORDER BY i) AS idxs, list(text ORDER BY i) AS paras FROM {tag}_w WHERE ok GROUP BY doc_id, chunk),
{tag}_chunks AS (SELECT '{p.name}' AS profile, g.*, a.text AS before, z.text AS after FROM {tag}_g g
   LEFT JOIN {tag}_b a ON a.doc_id = g.doc_id AND a.i = g.i0 - 1 AND a.ok LEFT JOIN {tag}_b z ON z.doc_id = g.doc_id AND z.i = g.i1 + 1 AND z.ok)"""


BASE = f"""{CITED},
nb AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, pos, type, text AS raw, {para('text')} AS text FROM blocks)"""
BOTH = f"WITH RECURSIVE {BASE}, {packed(C.WEB, 'w')}, {packed(C.PDF, 'p')}, chunks AS (SELECT * FROM w_chunks UNION ALL SELECT * FROM p_chunks)"


def important(x):
    keep = f"length(t) >= 2 AND {D.rx('t', C.IMPORTANT)} AND NOT {D.in_list('lower(t)', IGNORED_IMPORTANT)}"
    return f"list_distinct(list_filter(regexp_extract_all({x}, {D.lit(C.WORD_RUN)}), lambda t: {keep}))"


def protected(x):
    keep = f"length(t) >= 3 AND {D.rx('t', C.PROTECTED)} AND NOT {D.in_list('lower(t)', IGNORED_PROTECTED)}"
    bare = D.sub("t", r"^['’.\-]+|['’.\-]+$")
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, {D.lit(C.NAME_RUN)}), lambda t: {bare}), lambda t: {keep}))"


def content(x):
    keep = f"length(t) >= 3 AND NOT {D.in_list('t', C.STOP_WORDS)}"
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), {D.lit(C.CONTENT_RUN)}), lambda t: {keep}))"


def similarity(a, b):
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::double ELSE len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) END)"


def rewrite(p, rule):
    return (
        f"(CASE {rule} WHEN 1 THEN {D.sub(p, r'\s+', '  ')} WHEN 2 THEN substr({p}, 1, length({p}) - length({p}) // 3) "
        f"WHEN 3 THEN {D.sub(p, r'\s*\[[^\]]*\]')} WHEN 4 THEN {D.sub(p, r'^([^\p{Lu}]*)\p{Lu}\S*\s*', chr(92) + '1')} WHEN 5 THEN {D.lit(C.DROP)} "
        f"WHEN 6 THEN '- ' || {p} ELSE {p} END)"
    )


REWRITTEN = f"""m0 AS (SELECT *, (doc_id * 5 + chunk) % 11 AS c, (doc_id * 5 + chunk) % 13 = 12 AS failed FROM chunks),
m1 AS (SELECT *, list_transform(paras, lambda p, i: {rewrite('p', 'CASE WHEN c < 5 THEN 0 ELSE (doc_id + chunk + i - 1) % 7 END')}) AS plain FROM m0),
m2 AS (SELECT *, CASE WHEN c = 3 AND len(paras) > 1 THEN plain[1:len(paras) - 1] WHEN c = 4 AND len(paras) > 1 THEN list_transform(paras, lambda p: paras[1]) ELSE plain END AS cleaned FROM m1)"""


def pdf_text(x):
    t = D.sub(x, r"(\p{L})-\s+(\p{L})", "\\1\\2")
    t = D.sub(D.sub(t, rf"\[{C.CITATION_LIST}\]", " "), rf"\({C.CITATION_LIST}\)", " ")
    t = D.collapse(D.sub(t, "[¹²³⁰-⁹]+", " "))
    return D.collapse(D.sub(D.collapse(D.sub(t, C.ARXIV_LINE, " ")), C.HEADER_RUN, " "))


def vtext(x):
    return f"(CASE WHEN profile = 'WEB' THEN {x} ELSE {pdf_text(x)} END)"


def lim(field):
    return f"(CASE WHEN profile = 'WEB' THEN {getattr(C.WEB, field)} ELSE {getattr(C.PDF, field)} END)::double"


def lost(a, b, field):
    return f"(len({a}) > 0 AND len(list_intersect({a}, {b})) * 100 < len({a}) * {lim(field)})"


def ratio_out(b, a, low, high):
    return f"(length({b})::double / greatest(length({a}), 1) < {lim(low)} OR length({b})::double / greatest(length({a}), 1) > {lim(high)})"


JOIN = "list_aggregate({}, 'string_agg', chr(10) || chr(10))"
VALIDATED = f"""{REWRITTEN},
v1 AS (SELECT *, {JOIN.format('paras')} AS a_text, {JOIN.format(f"list_transform(cleaned, lambda p: CASE WHEN p = {D.lit(C.DROP)} THEN '' ELSE p END)")} AS b_text FROM m2),
v2 AS (SELECT *, {vtext('a_text')} AS va, {vtext('b_text')} AS vb FROM v1),
pairs AS (SELECT profile, doc_id, chunk, k, a, b FROM (SELECT profile, doc_id, chunk, unnest(paras) AS a, unnest(cleaned) AS b, unnest(range(1, len(paras) + 1)) AS k FROM m2 WHERE len(paras) = len(cleaned)) WHERE b <> {D.lit(C.DROP)}),
pv AS (SELECT *, {vtext('a')} AS va, {vtext(para('b'))} AS vb FROM pairs),
pt AS (SELECT *, {important('va')} AS ia, {important('vb')} AS ib, {protected('va')} AS pa, {protected('vb')} AS pb, {content('va')} AS ca, {content('vb')} AS cb FROM pv),
pr AS (SELECT profile, doc_id, chunk, k, CASE WHEN vb = '' THEN 'blank_paragraph'
   WHEN {ratio_out('vb', 'va', 'min_paragraph_ratio', 'max_paragraph_ratio')} THEN 'paragraph_length_out_of_range'
   WHEN {lost('ia', 'ib', 'keep_paragraph_tokens')} OR (profile = 'WEB' AND len(list_filter(pa, lambda t: NOT list_contains(pb, t))) > 0) THEN 'paragraph_token_loss'
   WHEN {lost('ca', 'cb', 'keep_content')} THEN 'paragraph_content_loss' END AS reason FROM pt),
pf AS (SELECT profile, doc_id, chunk, arg_min(reason, k) AS reason FROM pr WHERE reason IS NOT NULL GROUP BY ALL),
allp AS (SELECT profile, doc_id, chunk, k, a, b, {content('a')} AS ta, {content('b')} AS tb FROM (SELECT profile, doc_id, chunk, unnest(paras) AS a, unnest(cleaned) AS b, unnest(range(1, len(paras) + 1)) AS k FROM m2 WHERE len(paras) = len(cleaned))),
nx AS (SELECT *, lag(ta) OVER q AS pta, lag(tb) OVER q AS ptb, lag(b) OVER q AS prev FROM allp WINDOW q AS (PARTITION BY profile, doc_id, chunk ORDER BY k)),
dup AS (SELECT DISTINCT profile, doc_id, chunk FROM nx WHERE prev IS NOT NULL AND prev <> {D.lit(C.DROP)} AND b <> {D.lit(C.DROP)}
   AND {similarity('ptb', 'tb')} >= 0.82 AND {similarity('ptb', 'tb')} > {similarity('pta', 'ta')} + 0.20),
validated AS (SELECT v.*, CASE WHEN failed THEN 'model_failure' WHEN len(cleaned) = 0 THEN 'empty_output' WHEN len(cleaned) <> len(paras) THEN 'paragraph_count_mismatch'
   WHEN v.profile = 'PDF' AND list_contains(cleaned, {D.lit(C.DROP)}) THEN 'paragraph_drop_not_allowed'
   WHEN {D.sub('b_text', r'\s')} = '' THEN 'blank_combined_output'
   WHEN {ratio_out('vb', 'va', 'min_ratio', 'max_ratio').replace('profile', 'v.profile')} THEN 'length_ratio_out_of_range'
   WHEN {D.has('lower(b_text)', C.SUSPICIOUS)} THEN 'suspicious_formatting'
   WHEN {lost(important('va'), important('vb'), 'keep_tokens').replace('profile', 'v.profile')} THEN 'important_token_loss'
   WHEN pf.reason IS NOT NULL THEN pf.reason WHEN dup.doc_id IS NOT NULL THEN 'unexpected_duplication' END AS reason
  FROM v2 v LEFT JOIN pf ON pf.profile = v.profile AND pf.doc_id = v.doc_id AND pf.chunk = v.chunk LEFT JOIN dup ON dup.profile = v.profile AND dup.doc_id = v.doc_id AND dup.chunk = v.chunk)"""

FINAL = f"CASE WHEN {para('b')} = {D.lit(C.DROP)} THEN '' ELSE {para('b')} END"
ACCEPTED = f"""acc AS (SELECT profile, doc_id, chunk, i AS block, a AS before, {FINAL} AS after FROM (
  SELECT profile, doc_id, chunk, unnest(idxs) AS i, unnest(paras) AS a, unnest(cleaned) AS b FROM validated WHERE reason IS NULL))"""
NEW = """blk AS (SELECT p.profile, n.doc_id, n.i AS block, n.type, n.raw, n.text AS norm, a.after FROM nb n, (VALUES ('WEB'), ('PDF')) p(profile)
  LEFT JOIN acc a ON a.profile = p.profile AND a.doc_id = n.doc_id AND a.block = n.i)"""


def n_marks(x):
    return f"(CASE WHEN profile = 'WEB' THEN {D.n_contained(f'lower({x})', C.MARKERS['WEB'])} ELSE {D.n_contained(f'lower({x})', C.MARKERS['PDF'])} END)"


KINDS = f"""k1 AS (SELECT *, list_filter([
   CASE WHEN {D.sub('before', r'\s+')} = {D.sub('after', r'\s+')} AND before <> after THEN 'whitespace_cleanup' END,
   CASE WHEN {D.count_of('before', r'\p{L}-\s+\p{L}')} > {D.count_of('after', r'\p{L}-\s+\p{L}')} THEN 'dehyphenation' END,
   CASE WHEN {D.count_of('before', C.CITATION_MARK)} > {D.count_of('after', C.CITATION_MARK)} THEN 'citation_cleanup' END,
   CASE WHEN {n_marks('before')} > {n_marks('after')} THEN 'boilerplate_removal' END], lambda x: x IS NOT NULL) AS ks,
   {similarity(content(vtext('before')), content(vtext('after')))} AS sim FROM acc WHERE before <> after)
SELECT profile, doc_id, block, CASE WHEN trim(after) = '' THEN 'paragraph_drop' ELSE list_aggregate(list_concat(ks,
   CASE WHEN sim < 0.76 THEN ['substantial_rewrite'] WHEN len(ks) = 0 OR sim < 0.96 THEN ['minor_rewrite'] ELSE []::varchar[] END), 'string_agg', ',') END AS kinds FROM k1"""

PER_DOC = """per AS (SELECT profile, doc_id, count(*) AS chunks, sum(len(paras)) AS eligible, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected FROM validated GROUP BY profile, doc_id),
chg AS (SELECT profile, doc_id, count(*) FILTER (before <> after) AS changed, count(*) FILTER (after = '') AS dropped, sum(length(after)) AS after_acc FROM acc GROUP BY profile, doc_id),
chars AS (SELECT profile, doc_id, sum(list_sum(list_transform(paras, lambda p: length(p)))) AS cb, sum(CASE WHEN reason IS NOT NULL THEN list_sum(list_transform(paras, lambda p: length(p))) ELSE 0 END) AS cr FROM validated GROUP BY profile, doc_id)"""

SUMMARY_SRC = f"""sp AS (SELECT doc_id, pos, type, {D.collapse('text')} AS t, lag(type) OVER w AS ptype, lag({D.collapse('text')}) OVER w AS pt FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ss AS (SELECT d.doc_id, d.source, coalesce(s, '') AS src FROM documents d LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN ptype = 'Heading' THEN '[' || pt || '] ' || t ELSE t END, chr(10) ORDER BY pos) AS s FROM sp WHERE type = 'Paragraph' GROUP BY doc_id) USING (doc_id))"""
SUMMARY_HEAD = D.lit(
    "Summarise this article from its text only, in one short overview and three bullet points.\nOverview:\nKey points:\nTitle: Report "
)
RESP = f"""r AS (SELECT profile, doc_id, chunk, paras, CASE chunk % 3 WHEN 0 THEN list_aggregate(paras, 'string_agg', {D.lit(C.BREAK)}) WHEN 1 THEN list_aggregate(paras, 'string_agg', chr(10) || ' ' || chr(10)) ELSE list_aggregate(paras, 'string_agg', chr(10)) END AS t FROM chunks),
q AS (SELECT *, list_filter(list_transform(string_split(t, {D.lit(C.BREAK)}), lambda p: {para('p')}), lambda p: p <> '') AS x, list_filter(list_transform(string_split_regex(t, '\\n\\s*\\n+'), lambda p: {para('p')}), lambda p: p <> '') AS y FROM r),
z AS (SELECT profile, doc_id, chunk, CASE WHEN len(x) = len(paras) THEN x WHEN len(y) = len(paras) THEN y ELSE []::varchar[] END AS got FROM q)
SELECT profile, doc_id, chunk, len(got) AS n, coalesce(list_aggregate(got, 'string_agg', '|'), '') AS text FROM z"""

CHECKS = {
    "c01_eligibility": f"WITH {BASE} SELECT doc_id, pos, {eligible('text', C.WEB)}::int AS web, {eligible('text', C.PDF)}::int AS pdf FROM nb WHERE type = 'Paragraph'",
    "c02_chunk_packing": f"{BOTH} SELECT profile, doc_id, chunk, idx, list_aggregate(paras, 'string_agg', '|') AS paras FROM chunks",
    "c03_chunk_context": f"{BOTH} SELECT profile, doc_id, chunk, before, after FROM chunks",
    "c04_prompts": f"""{BOTH} SELECT profile, doc_id, chunk, concat_ws(chr(10), CASE WHEN profile = 'WEB' THEN {D.lit(C.INSTRUCTIONS['WEB'])} ELSE {D.lit(C.INSTRUCTIONS['PDF'])} END, 'Return ' || len(paras) || ' paragraphs separated by {C.BREAK}.',
   'Text before (do not change): ' || before, 'Text after (do not change): ' || after, list_aggregate(list_transform(paras, lambda p, i: 'Paragraph ' || i || ': ' || p), 'string_agg', chr(10))) AS prompt FROM chunks""",
    "c04_summary_prompts": f"WITH {CITED}, {SUMMARY_SRC} SELECT doc_id, {SUMMARY_HEAD} || doc_id || chr(10) || 'Text:' || chr(10) || src AS prompt FROM ss",
    "c05_response_split": f"{BOTH}, {RESP}",
    "c06_token_sets": f"""WITH {BASE} SELECT doc_id, pos, coalesce(list_aggregate(list_sort({important('text')}), 'string_agg', ' '), '') AS important,
   coalesce(list_aggregate(list_sort({protected('text')}), 'string_agg', ' '), '') AS protected, coalesce(list_aggregate(list_sort({content('text')}), 'string_agg', ' '), '') AS content FROM nb WHERE type = 'Paragraph'""",
    "c07_neighbour_similarity": f"""WITH {BASE}, t AS (SELECT doc_id, pos, {content('raw')} AS t FROM nb WHERE type = 'Paragraph'), l AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM t)
 SELECT doc_id, pos, round({similarity('p', 't')}, 6) AS similarity FROM l WHERE p IS NOT NULL""",
    "c08_validation": f"{BOTH}, {VALIDATED} SELECT profile, doc_id, chunk, reason FROM validated",
    "c09_duplication": f"{BOTH}, {VALIDATED} SELECT v.profile, v.doc_id, v.chunk, (d.doc_id IS NOT NULL)::int AS duplicated FROM validated v LEFT JOIN dup d ON d.profile = v.profile AND d.doc_id = v.doc_id AND d.chunk = v.chunk",
    "c10_change_kinds": f"{BOTH}, {VALIDATED}, {ACCEPTED}, {KINDS}",
    "c11_applied": f"{BOTH}, {VALIDATED}, {ACCEPTED}, {NEW} SELECT profile, doc_id, block, type, coalesce(after, raw) AS text, coalesce(after <> raw, false)::int AS changed FROM blk",
    "c12_diagnostics": f"""{BOTH}, {VALIDATED}, {ACCEPTED}, {PER_DOC} SELECT p.profile, p.doc_id, chunks, eligible, accepted, rejected, coalesce(changed, 0) AS changed, coalesce(dropped, 0) AS dropped,
   cb AS chars_before, (cr + coalesce(after_acc, 0)) AS chars_after FROM per p JOIN chars USING (profile, doc_id) LEFT JOIN chg USING (profile, doc_id)""",
    "c12_diagnostics_rollup": f"""{BOTH}, {VALIDATED}, {ACCEPTED}, {PER_DOC}, x AS (SELECT d.source, CASE WHEN chunks > 5 THEN 'long' ELSE 'short' END AS size_class, p.* FROM per p JOIN documents d USING (doc_id))
 SELECT source, size_class, sum(chunks) AS chunks, sum(accepted) AS accepted, sum(rejected) AS rejected FROM x GROUP BY ROLLUP (source, size_class)""",
    "c13_rejection_counts": f"{BOTH}, {VALIDATED} SELECT reason, count(*) AS n FROM validated WHERE reason IS NOT NULL GROUP BY reason",
    "c14_diffs": f"{BOTH}, {VALIDATED}, {ACCEPTED}, {NEW} SELECT profile, doc_id, block, norm AS before, after FROM blk WHERE type = 'Paragraph' AND after IS NOT NULL AND after <> norm",
    "c16_skip_current": f"""WITH {CITED}, {SUMMARY_SRC}, d AS (SELECT doc_id, doc_id % 3 = 0 AS a, ({C.PROMPT_VERSION} - 1 + doc_id % 4) AS v, doc_id % 5 <> 0 AS fresh FROM documents)
 SELECT doc_id, 'rewrite' AS task FROM d WHERE NOT ((a AND v = {C.PROMPT_VERSION}) OR v > {C.PROMPT_VERSION}) UNION ALL SELECT doc_id, 'summary' FROM d WHERE NOT (a AND v = {C.PROMPT_VERSION} AND fresh)""",
    "c17_signatures": f"""WITH {CITED}, {SUMMARY_SRC}, c AS (SELECT doc_id, string_agg(type || chr(0) || text || chr(0), '' ORDER BY pos) AS body FROM blocks GROUP BY doc_id)
 SELECT s.doc_id, sha256(s.source || body) AS content, sha256(src) AS summary_source, sha256(s.source) AS cache_key FROM ss s JOIN c USING (doc_id)""",
    "c18_failure_counts": f"""{BOTH}, e AS (SELECT CASE WHEN chunk % 2 = 0 THEN 'TimeoutError' ELSE 'ValueError' END || ': no answer for ' || source || CASE WHEN c.doc_id % 3 = 0 THEN ' | caused by OSError' ELSE '' END AS digest FROM chunks c JOIN documents d USING (doc_id))
 SELECT digest, count(*) AS n FROM e GROUP BY digest""",
}

# the nested records add up to the same figures
CHECKS["c12_run_reports"] = CHECKS["c12_diagnostics"]
