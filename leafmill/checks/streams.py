"""DuckDB SQL of the streaming and store queries."""

from leafmill.checks import duck as D
from leafmill.checks.blocks import paragraphs
from leafmill.checks.cleanup import packed
from leafmill.checks.inputs import GIVEN_TITLE, blocks_of
from leafmill.checks.sentences import CITED
from leafmill.operators import cleanup as C

EV = "ev AS (SELECT *, (props->>'$.k')::int AS k, epoch_us(ts) // 1000 AS ms FROM events)"
ASKS = f"""{EV}, l AS (SELECT user_id, event_id AS lookup_id, ms, k % 2 AS package, k // 50 AS sig FROM ev WHERE event_type IN ('view', 'error')),
t AS (SELECT user_id, event_id, ms, k % 2 AS package, k // 50 AS sig, 'https://example.org/p/' || k AS url FROM ev WHERE event_type IN ('click', 'signup')),
j AS (SELECT l.user_id, l.lookup_id, l.ms, l.package, l.sig, t.ms AS tms, t.package AS tp, t.sig AS ts, t.url FROM l LEFT JOIN t ON t.user_id = l.user_id AND t.ms <= l.ms
  QUALIFY row_number() OVER (PARTITION BY l.lookup_id ORDER BY t.ms DESC, t.event_id DESC) = 1)"""
GOOD = "tp = package AND ts = sig AND ms - tms <= 21600000"
PLAIN_BLOCKS = f"""{blocks_of('documents')}, nb AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, pos, type, text AS raw, {D.collapse("translate(text, chr(160), ' ')")} AS text FROM blocks)"""

SESSIONS = f"""WITH RECURSIVE {EV}, q AS (SELECT user_id, k % 3 AS fresh, k * 2 AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev),
w AS (SELECT DISTINCT user_id, 0::bigint AS n, 0::bigint AS session, 0::bigint AS steps, 0::bigint AS stalled, 0::bigint AS blocks, 0::bigint AS chars, false AS closed FROM q
  UNION ALL SELECT user_id, n, session, steps, stalled, blocks, chars, steps >= 10 OR stalled >= 2 FROM (
    SELECT q.user_id, q.n, w.session + w.closed::int AS session, CASE WHEN w.closed THEN 1 ELSE w.steps + 1 END AS steps, CASE WHEN q.fresh > 0 THEN 0 WHEN w.closed THEN 1 ELSE w.stalled + 1 END AS stalled,
      CASE WHEN w.closed THEN 0 ELSE w.blocks END + q.fresh AS blocks, CASE WHEN w.closed THEN 0 ELSE w.chars END + CASE WHEN q.fresh > 0 THEN q.size ELSE 0 END AS chars
    FROM w JOIN q ON q.user_id = w.user_id AND q.n = w.n + 1))
SELECT user_id, session, steps, blocks, chars FROM w WHERE closed AND chars >= 120"""
FRAGMENTS = """WITH RECURSIVE f AS (SELECT conv_id || ':' || turn AS response_id, list_transform(range(0, length(text), 40), lambda p, i: CASE (i - 1) % 4 WHEN 1 THEN substr(text, 1, least(p + 40, length(text)))
    WHEN 3 THEN substr(text, greatest(p - 9, 1), least(p + 40, length(text)) - greatest(p - 9, 1) + 1) ELSE substr(text, p + 1, least(p + 40, length(text)) - p) END) AS ps FROM conversations WHERE role = 'assistant' AND length(text) > 0),
w AS (SELECT response_id, ps, 0 AS n, '' AS t FROM f UNION ALL SELECT response_id, ps, n + 1, CASE WHEN trim(ps[n + 1]) = '' THEN t WHEN trim(t) = '' THEN ps[n + 1] WHEN starts_with(ps[n + 1], t) THEN ps[n + 1] WHEN ends_with(t, ps[n + 1]) THEN t
    ELSE t || substr(ps[n + 1], coalesce(list_max(list_filter(range(1, least(length(t), length(ps[n + 1])) + 1), lambda m: ends_with(t, substr(ps[n + 1], 1, m)))), 0) + 1) END FROM w WHERE n < len(ps))
SELECT response_id, t AS text FROM w WHERE n = len(ps)"""
THROTTLE = f"""WITH RECURSIVE {EV}, acc AS (SELECT user_id, min(ms) AS t FROM ev GROUP BY user_id UNION ALL SELECT a.user_id, min(e.ms) FROM acc a JOIN ev e ON e.user_id = a.user_id AND e.ms >= a.t + 21600000 GROUP BY a.user_id, a.t)
 SELECT a.user_id, arg_min(e.event_id, (e.ts, e.event_id)) AS event_id FROM acc a JOIN ev e ON e.user_id = a.user_id AND e.ms = a.t GROUP BY a.user_id, a.t"""

_KINDS = {
    "bat": ("click", "k::varchar"), "chg": ("click", "(k % 2 = 0)::varchar"), "v": ("purchase", "3 + k / 10"), "a": ("purchase", "(k - 50) / 100"),
    "tmp": ("error", "printf('%.1f', 20 + k / 10)"), "mem": ("signup", "(k * 10)::varchar"), "thr": ("signup", "(k + 1)::varchar"), "acc": ("signup", "(k % 3 = 0)::varchar"),
    "sm": ("error", "'step \"' || k || '\" '"), "pb": ("view", "CASE k % 3 WHEN 0 THEN 'speaking' WHEN 1 THEN 'paused' ELSE 'idle' END"),
}
_LAST = ", ".join(f"arg_max({v}, {{'a': ms, 'b': event_id}}) FILTER (event_type = '{t}') AS {n}" for n, (t, v) in _KINDS.items())
_CARRY = ", ".join(f"last_value({n} IGNORE NULLS) OVER w AS {n}" for n in _KINDS)
TELEMETRY = f"""WITH {EV}, s AS (SELECT user_id, ms - ms % 5000 AS win, sum(k) AS busy, {_LAST} FROM ev GROUP BY ALL),
c AS (SELECT user_id, win, busy, win - lag(win) OVER w AS wall, (win - min(win) OVER w) // 1000 AS el, {_CARRY} FROM s WINDOW w AS (PARTITION BY user_id ORDER BY win)),
d AS (SELECT *, ((20000 * busy + wall) // (2 * wall))::bigint AS h FROM c)
SELECT user_id, strftime(make_timestamp(win * 1000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp_iso, el::varchar AS elapsed_seconds, coalesce(bat, '') AS battery_percent, coalesce(chg, '') AS is_charging,
  coalesce(printf('%.3f', v), '') AS voltage_volts, coalesce(printf('%.6f', a), '') AS current_amps, coalesce(printf('%.3f', abs(a) * v), '') AS draw_watts, coalesce(tmp, '') AS battery_temp_c,
  coalesce((h // 100) || '.' || lpad((h % 100)::varchar, 2, '0'), '') AS process_cpu_percent, coalesce(mem, '0') AS process_memory_mb, coalesce(thr, '0') AS thread_count,
  coalesce(acc, 'false') AS accessibility_service_enabled, coalesce(sm, 'idle') AS summary_status, coalesce(pb, 'idle') AS playback_status FROM d"""

CHECKS = {
    "t03_capture_sessions": SESSIONS,
    "t03_capture_sessions_stream": SESSIONS,
    "t07_fragment_assembly": FRAGMENTS,
    "t07_fragment_stream": FRAGMENTS,
    "s02_plain_documents": f"""WITH src AS (SELECT doc_id, {GIVEN_TITLE} AS given, text FROM documents), {paragraphs('src')},
 p1 AS (SELECT s.doc_id, nullif(trim({D.sub('s.given', r'\s+', ' ')}), '') AS given, p.text AS first FROM src s LEFT JOIN paras p ON p.doc_id = s.doc_id AND p.pos = 0),
 p2 AS (SELECT *, coalesce(CASE WHEN given IS NOT NULL THEN {D.token_key('first')} = {D.token_key('given')} ELSE {D.plain_title('first')} END, false) AS take FROM p1),
 rest AS (SELECT p.doc_id, p.pos - take::int AS pos, p.text FROM paras p JOIN p2 USING (doc_id) WHERE p.pos >= take::int),
 fl AS (SELECT *, min({D.plain_metadata('text')}::int) OVER (PARTITION BY doc_id ORDER BY pos) = 1 AND pos < 3 AS meta FROM rest),
 n AS (SELECT doc_id, count(*) FILTER (meta) AS m, count(*) FILTER (NOT meta) AS b, count(*) FILTER (NOT meta AND NOT {D.plain_heading('text')}) AS np FROM fl GROUP BY doc_id)
 SELECT doc_id, coalesce(given, CASE WHEN take THEN first END, 'Captured text') AS title, coalesce(m, 0) AS n_metadata, CASE WHEN coalesce(b, 0) = 0 THEN 1 ELSE np END AS n_paragraphs FROM p2 LEFT JOIN n USING (doc_id)""",
    "s07_versioned_store": f"WITH {CITED} SELECT doc_id, 'Report ' || doc_id AS title, count(*) AS n_blocks FROM blocks GROUP BY doc_id",
    "s08_json_round_trip": f"""WITH {CITED}, g AS (SELECT doc_id, any_value(b.type) AS t0, count(*) AS n, count(*) FILTER (type = 'Paragraph') AS p, string_agg(type || '=' || text, '|' ORDER BY pos) AS body FROM blocks b GROUP BY doc_id)
 SELECT doc_id, 'Report ' || doc_id AS title, 'WEB' AS kind, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS page_count, p AS paragraphs, n AS n_blocks, CASE WHEN doc_id % 6 = 0 THEN n END AS shown, NULL::varchar AS backend,
  CASE WHEN doc_id % 8 = 0 THEN 'A text' END AS summary, body FROM g""",
    "s09_telemetry_csv": "SELECT event_id, event_type, round(value, 2) AS value, props || ' \"end\"' AS note FROM events",
    "s09_telemetry_samples": TELEMETRY,
    "t01_samples": f"""WITH {EV}, s AS (SELECT ms // 5000 * 5000 AS window_ms, user_id, arg_max(value, {{'a': ts, 'b': event_id}}) AS level, arg_max(k, {{'a': ts, 'b': event_id}}) AS cur, count(*) AS n, sum(k) AS busy FROM ev GROUP BY ALL),
 c AS (SELECT *, sum(busy) OVER w AS total FROM s WINDOW w AS (PARTITION BY user_id ORDER BY window_ms))
 SELECT window_ms, user_id, level, round(abs(cur) * level, 4) AS watts, n, round(100.0::double * (total - lag(total) OVER w) / (window_ms - lag(window_ms) OVER w), 6) AS cpu FROM c WINDOW w AS (PARTITION BY user_id ORDER BY window_ms)""",
    "t02_session_dedupe": f"WITH {EV} SELECT DISTINCT user_id, event_type || ':' || k AS key FROM ev",
    "t04_recent_lookup": f"WITH {ASKS} SELECT user_id, lookup_id, CASE WHEN {GOOD} THEN url END AS url FROM j",
    "t04_recent_lookup_stream": f"WITH {ASKS} SELECT user_id, lookup_id, url FROM j WHERE {GOOD}",
    "t05_throttle": THROTTLE,
    "t05_throttle_stream": THROTTLE,
    "t06_latest_positions": f"""WITH {EV} SELECT user_id, k % 7 AS item, k % 10 AS block, floor(value)::int % 200 AS "offset", event_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, k % 7 ORDER BY ms DESC, event_id DESC) = 1""",
    "t08_incremental_cleanup": f"""WITH RECURSIVE {PLAIN_BLOCKS}, {packed(C.WEB, 'w')} SELECT doc_id, count(*) AS chunks, sum(len(paras)) AS eligible, sum(list_sum(list_transform(paras, lambda p: length(p)))) AS chars_before FROM w_chunks GROUP BY doc_id""",
    "t09_activity_status": f"""WITH {EV}, s AS (SELECT ms // 3600000 * 3600000 AS window_ms, user_id, arg_max(event_type, {{'a': ts, 'b': event_id}}) AS last, max((k % 4 <> 0)::int) AS seg FROM ev GROUP BY ALL)
 SELECT window_ms, CASE WHEN last = 'view' THEN 'speaking' WHEN seg = 1 THEN 'paused' ELSE 'idle' END AS status, count(*) AS users FROM s GROUP BY ALL""",
}
