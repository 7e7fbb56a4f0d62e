"""DuckDB SQL of the library queries."""

from leafmill.checks import duck as D
from leafmill.checks.inputs import blocks_of
from leafmill.checks.sentences import CITED, POS

KIND = "CASE WHEN regexp_matches(source_label, '^(?:content|file)://') OR ends_with(lower(source_label), '.pdf') THEN 'PDF' ELSE 'WEB' END"
CANON = (
    "CASE WHEN regexp_matches(source_label, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN lower(regexp_extract(source_label, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || '://' || "
    "regexp_extract(source_label, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) || rtrim(regexp_extract(source_label, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')) ELSE "
    + D.token_key("source_label") + " END"
)
KEY = f"CASE WHEN kind = 'PDF' THEN 'pdf|' || {D.token_key('title')} || '|' || {D.token_key('summary')} ELSE 'web|' || {CANON} END"
ACTS = f"""acts0 AS (SELECT e.*, (props->>'$.k')::int AS k, epoch_us(ts) // 1000 AS at_ms FROM events e),
acts1 AS (SELECT a.*, p.page_id, rtrim(regexp_extract(p.url, '^[^?#]*'), '/') AS base FROM acts0 a JOIN pages p ON p.page_id = (a.event_id * 7 + a.k) % (SELECT count(*) FROM pages)),
acts2 AS (SELECT *, CASE WHEN page_id % 6 = 0 THEN base || '.pdf' WHEN event_id % 3 = 1 THEN base || '?utm=' || k WHEN event_id % 3 = 2 THEN base || '/' ELSE base END AS source_label FROM acts1),
acts3 AS (SELECT event_id, user_id, event_type, at_ms, k, page_id, source_label, {KIND} AS kind, 'Page ' || page_id % 40 AS title, 'About ' || page_id % 25 AS summary, floor(value)::int % 200 AS off, k % 10 AS block FROM acts2),
acts AS (SELECT *, {KEY} AS key FROM acts3)"""
HIST = f"""{ACTS},
h0 AS (SELECT * FROM acts WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY at_ms DESC, event_id DESC) = 1),
hist AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_ms DESC, event_id DESC) AS rank FROM h0)"""
LIST = """ad AS (SELECT *, event_id % 2 AS par, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS was_done FROM acts WHERE event_type = 'purchase'
   QUALIFY row_number() OVER (PARTITION BY user_id, key, event_id % 2 ORDER BY at_ms DESC, event_id DESC) = 1),
marks AS (SELECT user_id, key, arg_max(k % 2, at_ms) AS done FROM acts WHERE event_type = 'signup' GROUP BY ALL),
rl0 AS (SELECT user_id, key, coalesce(n.title, o.title) AS title, coalesce(n.summary, o.summary) AS summary, coalesce(n.source_label, o.source_label) AS source_label, coalesce(o.at_ms, n.at_ms) AS added_at, coalesce(o.was_done, 0) AS is_done
  FROM (SELECT * FROM ad WHERE par = 0) o FULL JOIN (SELECT * FROM ad WHERE par = 1) n USING (user_id, key)),
rl AS (SELECT r.* EXCLUDE (is_done), coalesce(done, is_done) AS is_done FROM rl0 r LEFT JOIN marks USING (user_id, key))"""
BM = """bm AS (SELECT event_id, user_id, title, 'https://example.org/b/' || page_id % 5 AS source_label, source_label AS full_label, block, off, CASE WHEN event_id % 3 = 0 THEN 'Label ' || k END AS label,
   'A passage number ' || k % 5 || ' on  page ' || page_id % 3 AS snippet, at_ms AS created_at FROM acts WHERE event_type = 'click')"""


def upsert(source, label):
    return f"""alive AS (SELECT b.* FROM {source} b WHERE NOT EXISTS (SELECT 1 FROM {source} l WHERE l.user_id = b.user_id AND l.{label} = b.{label} AND l.block = b.block
   AND abs(l.off - b.off) < 4 AND (l.created_at, l.event_id) > (b.created_at, b.event_id))),
bms AS (SELECT * FROM alive)"""


STORE = """st0 AS (SELECT * FROM acts WHERE event_type IN ('view', 'purchase', 'error') QUALIFY row_number() OVER (PARTITION BY user_id, source_label ORDER BY at_ms DESC, event_id DESC) = 1),
store AS (SELECT user_id, source_label, at_ms AS modified_at, (k + 1)::bigint * 1000000 AS bytes, k * 20 AS chars,
   (CASE WHEN kind = 'PDF' THEN k % 9 + k % 3 >= 1 AND k * 20 >= 200 ELSE k % 9 >= 3 AND k * 20 >= 800 END)::int AS usable FROM st0)"""
FULL = f"{BM}, {upsert('bm', 'full_label')}"
LAST = "lst AS (SELECT user_id, arg_max(source_label, {'a': at_ms, 'e': event_id}) AS source_label FROM acts GROUP BY user_id)"
KNOWN = f"""{FULL}, {LAST}, known AS (SELECT user_id, source_label FROM hist UNION SELECT user_id, full_label FROM bms
  UNION SELECT user_id, source_label FROM rl UNION SELECT user_id, source_label FROM lst)"""
SNIP = "lower(" + D.collapse("snippet") + ")"
SPAN = f"""{POS},
nb AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block, text FROM blocks),
r AS (SELECT p.*, n.text, CASE WHEN event_id % 2 = 0 THEN substr(text, off + 4, 30) ELSE 'no such text' END AS snippet, least(off, length(text) - 1) AS st FROM pos p JOIN nb n USING (doc_id, block)),
f AS (SELECT *, {D.collapse('snippet')} AS pre, least(st + 220, length(text) - 1) AS lim FROM r),
g AS (SELECT *, instr(substr(text, st + 1, length(pre) + 12), pre) AS found, substr(text, st + 1, lim - st) AS ahead, substr(text, greatest(st - 220, 0) + 1, st - greatest(st - 220, 0)) AS behind FROM f),
h AS (SELECT *, length(regexp_extract(ahead, '^[^.!?]*')) AS k2, st - length(regexp_extract(behind, '[^.!?\\n]*$')) AS s0 FROM g)
SELECT event_id, CASE WHEN pre <> '' AND found > 0 THEN st + found - 1 ELSE st END AS first,
  CASE WHEN pre <> '' AND found > 0 THEN least(st + found + length(pre) - 2, length(text) - 1) WHEN k2 < length(ahead) THEN st + k2 ELSE lim END AS last,
  least(s0 + length(regexp_extract(substr(text, s0 + 1), '^\\s*')), length(text) - 1) AS sentence_start FROM h"""

PROG_CANON = f"CASE WHEN regexp_matches(source_label, '^https?://') THEN {CANON} ELSE source_label END"

LOG = f"""{ACTS}, nar AS (SELECT event_id, user_id, event_type, at_ms, k, title, summary, block, off, 'https://example.org/b/' || page_id % 5 AS lab FROM acts),
ch AS (SELECT *, 'web|' || lab AS lkey, CASE WHEN event_type = 'purchase' THEN 'add' WHEN k % 5 = 0 THEN 'remove' ELSE 'done' END AS op,
   lead({{'at': at_ms, 'seq': event_id}}) OVER w AS nxt FROM nar WHERE event_type IN ('purchase', 'signup') WINDOW w AS (PARTITION BY user_id, lab ORDER BY at_ms, event_id)),
lf AS (SELECT *, coalesce(count(*) FILTER (op = 'remove') OVER (PARTITION BY user_id, lkey ORDER BY at_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM ch),
st AS (SELECT *, count(*) FILTER (op = 'add') OVER w AS adds, min(at_ms) FILTER (op = 'add') OVER w AS added_at,
   arg_max(title, (at_ms, event_id)) FILTER (op = 'add') OVER w AS t, arg_max(summary, (at_ms, event_id)) FILTER (op = 'add') OVER w AS s FROM lf WINDOW w AS (PARTITION BY user_id, lkey, life ORDER BY at_ms, event_id)),
lv AS (SELECT user_id, lkey, lab, t, s, added_at, coalesce(arg_max(k % 2, (at_ms, event_id)) FILTER (op = 'done') OVER (PARTITION BY user_id, lkey, life ORDER BY at_ms, event_id), 0) AS is_done,
   op, at_ms, event_id, nxt FROM st WHERE adds > 0),
lvs AS (SELECT * FROM lv WHERE op <> 'remove'),
del AS (SELECT e.event_id, e.user_id, e.lab, e.at_ms, EXISTS (SELECT 1 FROM lvs v WHERE v.user_id = e.user_id AND v.lab = e.lab AND (v.at_ms, v.event_id) < (e.at_ms, e.event_id)
   AND (v.nxt IS NULL OR (v.nxt.at, v.nxt.seq) > (e.at_ms, e.event_id))) AS preserved FROM nar e WHERE event_type = 'error'),
cl AS (SELECT * FROM nar WHERE event_type = 'click'),
ends AS (SELECT a.*, least((SELECT min((b.at_ms, b.event_id)) FROM cl b WHERE b.user_id = a.user_id AND b.lab = a.lab AND b.block = a.block AND abs(b.off - a.off) < 4 AND (b.at_ms, b.event_id) > (a.at_ms, a.event_id)),
   (SELECT min((b.at_ms + 3600000, b.event_id)) FROM cl b WHERE b.k % 7 = 3 AND b.user_id = a.user_id AND b.lab = a.lab AND b.block = a.block AND b.off = a.off AND b.at_ms = a.at_ms),
   (SELECT min((d.at_ms, d.event_id)) FROM del d WHERE NOT preserved AND d.user_id = a.user_id AND d.lab = a.lab AND (d.at_ms, d.event_id) > (a.at_ms, a.event_id))) AS e FROM cl a),
bv AS (SELECT user_id, lab, block, off, at_ms, event_id, e, NULL AS label, (at_ms, event_id) AS f FROM ends
  UNION ALL SELECT a.user_id, a.lab, a.block, a.off, a.at_ms, a.event_id, e, 'New label ' || b.k, (b.at_ms + 1800000, b.event_id) FROM ends a JOIN cl b USING (user_id, lab, block, off, at_ms)
    WHERE b.k % 7 IN (1, 2) AND (e IS NULL OR (b.at_ms + 1800000, b.event_id) < e)),
bvs AS (SELECT *, least(lead(f) OVER (PARTITION BY user_id, lab, block, off, at_ms, event_id ORDER BY f), e) AS t FROM bv)"""

CHECKS = {
    "s05_document_kinds": f"WITH {ACTS} SELECT DISTINCT source_label, kind, regexp_matches(lower(trim(source_label)), '^(?:content|file)://|\\.pdf$|/pdf/')::int AS session_pdf FROM acts",
    "s06_oversize_inputs": "SELECT page_id, octet_length(encode(html)) AS bytes, CASE WHEN octet_length(encode(html)) <= 6000 THEN 'accepted' ELSE 'quarantined' END AS route FROM pages",
    "j01_source_keys": f"""WITH {ACTS} SELECT DISTINCT source_label, {CANON} AS canonical,
   lower(regexp_extract(source_label, '^[a-z]+://[^/?#]+')) || rtrim(regexp_extract(source_label, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') || regexp_extract(source_label, '\\?.+$') AS identity,
   CASE WHEN NOT regexp_matches(source_label, '//www\\.') AND len(string_split({D.url_host('source_label')}, '.')) = 2 THEN replace(source_label, '://', '://www.') END AS www FROM acts""",
    "j02_www_groups": f"""SELECT regexp_replace({D.url_host('url')}, '^www\\.', '') AS host, count(*) AS pages,
   sum((regexp_replace(url, '//www\\.', '//', 'g') LIKE '%//www.%' OR 'www.' || {D.url_host("regexp_replace(url, '//www\\.', '//', 'g')")} = 'www.' || {D.url_host('url')})::int) AS kept_www FROM pages GROUP BY 1""",
    "j03_history": f"WITH {HIST} SELECT user_id, key, title, source_label, at_ms AS opened_at FROM hist",
    "j04_reading_list": f"WITH {ACTS}, {LIST} SELECT user_id, key, title, summary, added_at, is_done FROM rl",
    "j04_reading_list_log": f"""WITH {LOG} SELECT user_id, lkey AS key, t AS title, s AS summary, lab AS source_label, added_at, is_done,
   at_ms AS from_at, event_id AS from_seq, nxt.at AS to_at, nxt.seq AS to_seq FROM lvs""",
    "j05_bookmark_log": f"""WITH {LOG} SELECT user_id, lab AS source_label, block, off AS "offset", at_ms AS created_at, event_id AS seq, label, f[1] AS from_at, f[2] AS from_seq, t[1] AS to_at, t[2] AS to_seq FROM bvs""",
    "j12_cascade_log": f"""WITH {LOG} SELECT d.event_id, d.user_id, d.lab AS source_label, preserved, (SELECT count(*) FROM bvs b WHERE b.user_id = d.user_id AND b.lab = d.lab AND b.t[1] = d.at_ms AND b.t[2] = d.event_id) AS bookmarks_gone FROM del d""",
    "j05_bookmarks": f'WITH {ACTS}, {BM}, {upsert("bm", "source_label")} SELECT user_id, source_label, block, off AS "offset", event_id FROM bms',
    "j06_nearest_bookmarks": f"""WITH {ACTS}, {BM}, t AS (SELECT event_id AS target_id, user_id, 'https://example.org/b/' || page_id % 5 AS source_label, block, off, 'a passage number ' || k % 5 || ' on page' AS ts FROM acts WHERE event_type = 'view'),
 c AS (SELECT target_id, b.off AS boff, abs(b.off - t.off) AS d, b.created_at, b.event_id FROM t JOIN (SELECT *, {SNIP} AS sn FROM bm) b USING (user_id, source_label, block)
   WHERE abs(b.off - t.off) <= 12 OR (length(sn) >= 16 AND length(ts) >= 16 AND (starts_with(sn, ts) OR starts_with(ts, sn))))
 SELECT target_id, boff AS "offset" FROM c QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY d, created_at DESC, event_id DESC) = 1""",
    "j07_bookmark_spans": f"WITH {CITED}, {SPAN}",
    "j08_section_enrichment": f"""WITH {CITED}, {POS}, s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block,
   coalesce(last_value(CASE WHEN type = 'Heading' THEN {D.collapse('text')} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), 'Report ' || doc_id) AS found FROM blocks)
 SELECT p.event_id, CASE WHEN event_id % 4 = 0 THEN 'Kept ' || k ELSE found END AS section FROM pos p LEFT JOIN s USING (doc_id, block)""",
    "j09_history_overview": f"""WITH {HIST}, {LIST}, {BM}, {upsert('bm', 'full_label')}, n AS (SELECT user_id, full_label AS source_label, count(*) AS bookmarks FROM bms GROUP BY ALL), l AS (SELECT DISTINCT user_id, source_label, 1 AS listed FROM rl)
 SELECT user_id, kind, source_label, coalesce(bookmarks, 0) AS bookmarks, coalesce(listed, 0) AS listed FROM hist LEFT JOIN n USING (user_id, source_label) LEFT JOIN l USING (user_id, source_label)""",
    "j10_bookmark_search": f"""WITH {ACTS}, {BM}, q AS (SELECT *, max(created_at) OVER (PARTITION BY user_id, source_label) AS group_latest FROM bm WHERE contains(lower(snippet), 'passage number 3 on  page') OR contains(lower(title), 'passage number 3 on  page') OR contains(lower(label), 'passage number 3 on  page'))
 SELECT user_id, source_label, (source_label = 'https://example.org/b/2')::int AS is_current, group_latest, block, off AS "offset", event_id FROM q""",
    "j11_reading_list_split": f"WITH {ACTS}, {LIST} SELECT user_id, sum(1 - is_done) AS to_read, sum(is_done) AS done FROM rl GROUP BY user_id",
    "j12_delete_cascade": f"""WITH {HIST}, {LIST}, {STORE}, {FULL}, {LAST}, gone AS (SELECT DISTINCT user_id, source_label FROM acts WHERE event_type = 'error'),
 cleared AS (SELECT * FROM gone WHERE NOT EXISTS (SELECT 1 FROM rl WHERE rl.user_id = gone.user_id AND rl.source_label = gone.source_label)),
 hl AS (SELECT h.* FROM hist h ANTI JOIN gone g USING (user_id, source_label)), fl AS (SELECT s.* FROM store s ANTI JOIN cleared c USING (user_id, source_label)),
 bl AS (SELECT b.* FROM bms b WHERE NOT EXISTS (SELECT 1 FROM cleared c WHERE c.user_id = b.user_id AND c.source_label = b.full_label)),
 m AS (SELECT *, {PROG_CANON} AS canon FROM acts), al AS (SELECT user_id, canon AS key FROM m UNION SELECT user_id, source_label FROM m),
 ck AS (SELECT user_id, {PROG_CANON} AS key FROM cleared UNION SELECT user_id, source_label FROM cleared), pl AS (SELECT a.* FROM al a ANTI JOIN ck USING (user_id, key))
 SELECT u.user_id, (SELECT count(*) FROM hl WHERE hl.user_id = u.user_id) AS history_left, (SELECT count(*) FROM fl WHERE fl.user_id = u.user_id) AS files_left,
  (SELECT count(*) FROM bl WHERE bl.user_id = u.user_id) AS bookmarks_left, (SELECT count(*) FROM pl WHERE pl.user_id = u.user_id) AS progress_left,
  CASE WHEN NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = u.user_id AND g.source_label = u.source_label) THEN u.source_label ELSE
   coalesce((SELECT arg_min(source_label, rank) FROM hl WHERE hl.user_id = u.user_id), (SELECT arg_max(source_label, {{'a': added_at, 'k': key}}) FROM rl WHERE rl.user_id = u.user_id)) END AS last_opened
 FROM lst u""",
    "j13_protected_keys": f"WITH {HIST}, {LIST}, {KNOWN} SELECT user_id, source_label FROM known",
    "j14_orphans": f"WITH {HIST}, {LIST}, {STORE}, {KNOWN} SELECT user_id, count(*) AS removed, sum(bytes) AS freed FROM store ANTI JOIN known USING (user_id, source_label) GROUP BY user_id",
    "j15_retention": f"""WITH {HIST}, {LIST}, {STORE}, {KNOWN}, tot AS (SELECT user_id, count(*) AS files, sum(bytes) AS total FROM store GROUP BY 1),
 loose AS (SELECT s.*, row_number() OVER w - 1 AS n, sum(bytes) OVER w - bytes AS b FROM store s ANTI JOIN known USING (user_id, source_label) WINDOW w AS (PARTITION BY user_id ORDER BY modified_at, source_label ROWS UNBOUNDED PRECEDING))
 SELECT user_id, source_label, modified_at, bytes FROM loose JOIN tot USING (user_id) WHERE files - n > 24 OR total - b > 96 * 1024 * 1024""",
    "j17_cache_lookup": f"""WITH {ACTS}, {STORE}, ok AS (SELECT * FROM store WHERE usable = 1 AND chars % 40 <> 20), v AS (SELECT user_id, source_label, max(at_ms) AS t, {CANON} AS canon FROM acts WHERE event_type = 'view' GROUP BY user_id, source_label),
 alt AS (SELECT a.user_id, a.source_label, arg_max(b.source_label, b.t) AS other FROM v a JOIN v b ON a.user_id = b.user_id AND a.canon = b.canon AND a.source_label <> b.source_label GROUP BY ALL)
 SELECT v.user_id, v.source_label, coalesce(e.source_label, o.source_label) AS document, coalesce(e.chars, o.chars) AS chars FROM v LEFT JOIN ok e ON e.user_id = v.user_id AND e.source_label = v.source_label
  LEFT JOIN alt ON alt.user_id = v.user_id AND alt.source_label = v.source_label LEFT JOIN ok o ON o.user_id = v.user_id AND o.source_label = alt.other""",
    "j18_progress": f"""WITH {ACTS}, m AS (SELECT *, {PROG_CANON} AS canon FROM acts), al AS (SELECT user_id, canon AS key, block, off, at_ms, event_id FROM m UNION ALL SELECT user_id, source_label, block, off, at_ms, event_id FROM m WHERE canon <> source_label),
 p AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY at_ms DESC, event_id DESC) = 1)
 SELECT r.user_id, r.source_label, coalesce(a.block, b.block) AS block, coalesce(a.off, b.off) AS "offset" FROM (SELECT DISTINCT user_id, source_label, canon FROM m WHERE event_type = 'view') r
  LEFT JOIN p a ON a.user_id = r.user_id AND a.key = r.canon LEFT JOIN p b ON b.user_id = r.user_id AND b.key = r.source_label""",
    "j19_last_opened": f"""WITH {HIST}, {STORE}, f AS (SELECT user_id, source_label FROM store WHERE usable = 1), l AS (SELECT user_id, arg_max(source_label, {{'a': at_ms, 'e': event_id}}) AS source_label FROM acts GROUP BY user_id)
 SELECT l.user_id, coalesce((SELECT f.source_label FROM f WHERE f.user_id = l.user_id AND f.source_label = l.source_label), (SELECT arg_min(h.source_label, rank) FROM hist h SEMI JOIN f USING (user_id, source_label) WHERE h.user_id = l.user_id)) AS document FROM l""",
    "j20_store_summary": "SELECT count(*) AS files, sum(octet_length(encode(text))) AS bytes FROM documents",
    "j22_window_union": f"""WITH {blocks_of('documents')}, k AS (SELECT *, {D.token_key('text')} AS key, pos % 3 <> 1 AS part FROM blocks), n AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY part, pos) = 1)
 SELECT doc_id AS session, key, part::int AS part, pos, text FROM n""",
}
