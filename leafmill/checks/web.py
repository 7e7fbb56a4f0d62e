"""DuckDB SQL of the web page queries."""

from leafmill.checks import duck as D
from leafmill.functions import rules as R
from leafmill.functions.rules import any_of
from leafmill.operators import html as H
from leafmill.operators import web as W
from leafmill.operators.sentences import AUTHOR_STOP_WORDS
from leafmill.plans import inputs as I

NO_POSSESSIVE = {"article": W.ARTICLE_BODY.replace("*+", "*"), "body": W.BODY_HTML.replace("*+", "*")}
PLAIN = D.sub(
    D.sub(
        "replace(" + D.sub("html", r"(?is)<script.*?</script>|<style.*?</style>|<title.*?</title>") + r", '<p>', '\n\n')",
        I.TAGS, " ",
    ),
    r"""[\n\t\r"]""", " ",
)


def _steps() -> str:
    nn = r"replace(plain, '\n\n', '</p><p>')"
    steps = [
        ("</h1>", D.lit("</h1>" + I.BYLINE + I.SHARE_BAR), "page_id % 3 = 0"),
        ("</article>", D.lit(I.EXTRA + I.RELATED + "</article>"), "page_id % 2 = 0"),
        ("<article>", D.lit('<main class="post-content"><article>'), "page_id % 5 = 1"),
        ("</article>", D.lit("</article></main>"), "page_id % 5 = 1"),
        ("<article>", D.lit('<div class="entry-body">'), "page_id % 5 = 2"),
        ("</article>", D.lit("</div>"), "page_id % 5 = 2"),
        ("<article>", D.lit('<article class="available-content"><div class="body markup">'), "page_id % 11 = 3"),
        ("</head>", D.lit(I.HEAD_META + "</head>"), "page_id % 4 = 1"),
        ("</head>", "'<script type=\"application/ld+json\">{\"@type\":\"Article\",\"articleBody\":\"' || plain || '\"}</script></head>'", "page_id % 4 = 2"),
        ("</head>", "'<script>var d={\"body_html\" : \"<p>' || " + nn + " || '<\\/p>\"};</script></head>'", "page_id % 4 = 3"),
        ("</head>", D.lit(I.CHALLENGE + "</head>"), "page_id % 10 = 7"),
    ]
    ctes = [f"rp0 AS (SELECT page_id, url, html, {PLAIN} AS plain FROM pages)"]
    for i, (where, new, cond) in enumerate(steps):
        ctes.append(
            f"rp{i + 1} AS (SELECT page_id, url, plain, replace(html, {D.lit(where)}, CASE WHEN {cond} THEN {new} ELSE {D.lit(where)} END) AS html FROM rp{i})"
        )
    ctes.append(f"rich AS MATERIALIZED (SELECT page_id, url, html FROM rp{len(steps)})")
    return ",\n".join(ctes)


RICH = _steps()


def attr(x: str, name: str) -> str:
    pat = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return "(" + " || ".join(f"regexp_extract({x}, {D.lit(pat)}, {g})" for g in (1, 2, 3)) + ")"


def decode(x: str) -> str:
    for name, char in H.ENTITIES:
        x = f"replace({x}, {D.lit(name)}, {D.lit(char)})"
    return x


def marker(*parts: str) -> str:
    joined = "concat_ws(' ', " + ", ".join(parts) + ")"
    low = f"lower({D.sub(joined, '([a-z])([A-Z])', chr(92) + '1 ' + chr(92) + '2')})"
    return f"trim({D.sub(low, '[^a-z0-9]+', ' ')})"


def marker_has(x: str, phrases) -> str:
    return D.rx(x, "(?:^| )" + any_of(phrases) + "(?:$| )")


def has_class(x: str, names) -> str:
    return D.rx(f"lower({x})", r"(?:^|\s)" + any_of(names) + r"(?:$|\s)")


BODIED = f"CASE WHEN regexp_matches(h, '(?i)<body') THEN h ELSE '<body>' || h || '</body>' END"
DROPPED = (
    f"({D.in_list('tag', R.DROPPED_TAGS + ['head'])} OR lower({attr('tok', 'aria-hidden')}) = 'true' OR {has_class(attr('tok', 'class'), R.DROPPED_CLASSES)} "
    f"OR {D.in_list(attr('tok', 'role'), R.DROPPED_ROLES)} OR {attr('tok', 'id')} = 'discussion' OR contains({attr('tok', 'data-testid')}, 'comments'))"
)
BLOCKED = H.INNER_BLOCKS
TOKENS = f"""{RICH},
tk0 AS (SELECT page_id, unnest(ts) AS tok, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all({BODIED}, {D.lit(H.TOKEN)}) AS ts FROM (SELECT page_id, {D.sub('html', H.RAW_TEXT)} AS h FROM rich))),
tk1 AS (SELECT *, lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1)) AS tag FROM tk0),
tk2 AS (SELECT *, CASE WHEN regexp_matches(tok, '^</[A-Za-z]') THEN 'close' WHEN regexp_matches(tok, '^<[A-Za-z]') THEN CASE WHEN {D.in_list('tag', R.VOID_TAGS)} OR ends_with(tok, '/>') THEN 'void' ELSE 'open' END
   WHEN regexp_matches(tok, '^<[!?]') THEN 'other' ELSE 'text' END AS kind FROM tk1),
tk3 AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, tag ORDER BY pos) AS s FROM tk2),
tk4 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id, tag ORDER BY pos)) AS r FROM tk3),
tk5 AS (SELECT *, (CASE kind WHEN 'open' THEN r WHEN 'close' THEN lag(r, 1, 0) OVER (PARTITION BY page_id, tag ORDER BY pos) ELSE 0 END)::int AS level, {D.in_list('tag', H.BOUNDARY_TAGS)} AND kind IN ('open', 'close', 'void') AS bound FROM tk4),
tk6 AS (SELECT *, lead(kind) OVER w AS nk, lead(pos) OVER w AS np, CASE WHEN bound THEN lead(pos) OVER (PARTITION BY page_id, bound ORDER BY pos) END AS bp FROM tk5 WINDOW w AS (PARTITION BY page_id, tag, level ORDER BY pos)),
tk7 AS (SELECT *, CASE WHEN kind = 'open' AND level > 0 AND nk = 'close' THEN np END AS by_tag, {D.in_list('tag', H.ENDS_AT_BLOCK)} AS implicit FROM tk6),
tk8 AS (SELECT *, CASE WHEN implicit THEN CASE WHEN bp = by_tag THEN by_tag END ELSE by_tag END AS paired,
   CASE WHEN kind = 'open' THEN CASE WHEN implicit THEN bp WHEN tag = 'li' THEN coalesce(by_tag, bp) WHEN tag = 'body' THEN coalesce(by_tag, {H.PAGE_END}) ELSE by_tag END END AS end_pos FROM tk7),
tk9 AS (SELECT *, paired IS NOT NULL AND {DROPPED} AS drp FROM tk8),
tk10 AS (SELECT *, kind = 'close' AND coalesce(lag(paired) OVER w = pos, false) AS ends, coalesce(lag(drp) OVER w, false) AS ends_drp FROM tk9 WINDOW w AS (PARTITION BY page_id, tag, level ORDER BY pos)),
tk11 AS (SELECT *, CASE WHEN paired IS NOT NULL THEN 1 WHEN ends THEN -1 ELSE 0 END AS d FROM tk10),
tk12 AS (SELECT *, sum(d) OVER w AS depth, CASE WHEN sum(CASE WHEN drp THEN 1 WHEN ends AND ends_drp THEN -1 ELSE 0 END) OVER w > 0 THEN 0 ELSE 1 END AS live,
   sum(CASE WHEN tag = 'a' THEN d ELSE 0 END) OVER w > 0 AS in_link, sum(CASE WHEN tag IN ('li', 'blockquote') THEN d ELSE 0 END) OVER w AS quote FROM tk11 WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
tk13 AS (SELECT *, last_value(CASE WHEN paired IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY page_id, depth ORDER BY pos) AS parent,
   CASE WHEN kind = 'text' AND live = 1 THEN {D.norm(decode('tok'))} ELSE '' END AS txt FROM tk12),
tk14 AS (SELECT *, txt <> '' AS has, sum((({D.in_list('tag', R.BLOCK_TAGS)} AND kind IN ('open', 'close', 'void')) OR (kind = 'text' AND txt = ''))::int) OVER (PARTITION BY page_id ORDER BY pos) AS gaps FROM tk13),
tk15 AS (SELECT *, regexp_matches(tok, '^(?:\\s|&nbsp;)') OR coalesce(lag(regexp_matches(tok, '(?:\\s|&nbsp;)$')) OVER w, true) OR gaps <> lag(gaps, 1, 0) OVER w AS gap FROM tk14 WINDOW w AS (PARTITION BY page_id, has ORDER BY pos)),
tokens AS MATERIALIZED (SELECT *, CASE WHEN NOT has THEN '' WHEN gap AND NOT regexp_matches(txt, '^[,.;:!?]') THEN ' ' || txt ELSE txt END AS piece FROM tk15)"""

OPENED = "(kind = 'open' AND live = 1)"
ELS = f"""{TOKENS},
sm AS (SELECT *, sum(({OPENED} AND tag = 'p')::int) OVER w AS c_p, sum(({OPENED} AND tag IN ('h1', 'h2', 'h3', 'h4'))::int) OVER w AS c_h, sum(({OPENED} AND tag = 'li')::int) OVER w AS c_li,
   sum(length(piece)) OVER w AS c_n, sum(CASE WHEN in_link AND piece <> '' THEN length(trim(piece)) + 1 ELSE 0 END) OVER w AS c_link, sum(({OPENED} AND tag IN ('article', 'main'))::int) OVER w AS c_art,
   sum(({OPENED} AND {D.in_list('tag', BLOCKED)})::int) OVER w AS c_blk, max(pos) OVER (PARTITION BY page_id) AS last_pos FROM tokens WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
el0 AS (SELECT a.page_id, a.pos AS op, a.end_pos AS en, a.tag, a.quote, {attr('a.tok', 'class')} AS cls, {attr('a.tok', 'id')} AS id, {attr('a.tok', 'role')} AS role, {attr('a.tok', 'aria-label')} AS aria, {attr('a.tok', 'data-testid')} AS testid,
   CASE WHEN a.tag = 'a' THEN trim({attr('a.tok', 'href')}) ELSE '' END AS href, z.c_p - a.c_p AS n_p, z.c_h - a.c_h AS n_h, z.c_li - a.c_li AS n_li, z.c_n - a.c_n AS raw_len, z.c_link - a.c_link AS raw_link, z.c_art - a.c_art AS n_art, z.c_blk - a.c_blk AS n_blk
  FROM sm a JOIN sm z ON z.page_id = a.page_id AND z.pos = least(a.end_pos, a.last_pos) WHERE a.kind = 'open' AND a.live = 1 AND a.end_pos IS NOT NULL),
el AS MATERIALIZED (SELECT *, {marker('cls', 'id', 'role', 'aria', 'testid')} AS mark, {marker('cls', 'id', 'aria', 'testid')} AS imark FROM el0)"""


def n(x=""):
    return f"greatest({x}raw_len - 1, 0)"


def density(empty, x=""):
    return f"(CASE WHEN {n(x)} = 0 THEN {empty}::double ELSE greatest({x}raw_link - 1, 0)::double / {n(x)} END)"


ARTICLE = (
    f"(tag IN ('article', 'main') OR n_art > 0 OR (n_p >= 5 AND {n()} >= 1000 AND {density(0)} < 0.35 AND (n_h >= 1 OR "
    f"{D.has(chr(108) + 'ower(cls || chr(32) || id)', R.ARTICLE_MARKERS)})))"
)
NOISY = f"(mark <> '' AND {marker_has('mark', R.NOISY_CONTAINER_PHRASES)} AND NOT {ARTICLE})"


def outermost(source):
    return f"SELECT a.* FROM {source} a WHERE NOT EXISTS (SELECT 1 FROM {source} o WHERE o.page_id = a.page_id AND a.op > o.op AND a.op < o.en)"


def without(source, removed):
    """Elements outside removed ranges, counts lowered by what was removed inside them."""
    return f"""SELECT e.* REPLACE (e.raw_len - coalesce(g.raw_len, 0) AS raw_len, e.raw_link - coalesce(g.raw_link, 0) AS raw_link, e.n_p - coalesce(g.n_p, 0) AS n_p, e.n_h - coalesce(g.n_h, 0) AS n_h, e.n_li - coalesce(g.n_li, 0) AS n_li)
 FROM {source} e LEFT JOIN (SELECT e.page_id, e.op, sum(r.raw_len) AS raw_len, sum(r.raw_link) AS raw_link, sum(r.n_p + (r.tag = 'p')::int) AS n_p, sum(r.n_h + (r.tag IN ('h1', 'h2', 'h3', 'h4'))::int) AS n_h, sum(r.n_li + (r.tag = 'li')::int) AS n_li
   FROM {source} e JOIN {removed} r ON r.page_id = e.page_id AND r.op > e.op AND r.op < e.en GROUP BY ALL) g ON g.page_id = e.page_id AND g.op = e.op
 WHERE NOT EXISTS (SELECT 1 FROM {removed} r WHERE r.page_id = e.page_id AND e.op >= r.op AND e.op < r.en)"""


UI = (
    f"(body <> '' AND length(body) <= 260 AND ({D.social_share('body')} OR {D.action_utility('body', 'false')} OR {D.site_info('body')} OR {D.ad_tech('body', 'false')} OR {D.media_credit('body', 'false')})) "
    f"OR ({marker_has('imark', R.INLINE_NOISE_PHRASES)} AND (length(body) <= 120 OR full_text = '' OR NOT {D.article_remainder('full_text')}))"
)
STAGES = f"""{ELS},
noisy0 AS (SELECT * FROM el WHERE {NOISY}), noisy AS MATERIALIZED ({outermost('noisy0')}),
els2 AS MATERIALIZED ({without('el', 'noisy')}),
txt2 AS MATERIALIZED (SELECT page_id, pos, piece, parent FROM tokens t WHERE piece <> '' AND NOT EXISTS (SELECT 1 FROM noisy r WHERE r.page_id = t.page_id AND t.pos > r.op AND t.pos < r.en)),
et AS (SELECT e.page_id, e.op, trim(coalesce(string_agg(t.piece, '' ORDER BY t.pos), '')) AS full_text, trim(coalesce(string_agg(t.piece, '' ORDER BY t.pos) FILTER (t.parent = e.op), '')) AS own FROM els2 e LEFT JOIN txt2 t ON t.page_id = e.page_id AND t.pos > e.op AND t.pos < e.en GROUP BY ALL),
eu AS (SELECT e.*, et.full_text, CASE WHEN own <> '' THEN own ELSE et.full_text END AS body FROM els2 e JOIN et USING (page_id, op)),
ui0 AS MATERIALIZED (SELECT * FROM eu WHERE tag NOT IN ('html', 'body', 'article', 'main') AND ({UI}))"""
PRUNED_STAGE = f"""{STAGES},
ui AS MATERIALIZED ({outermost('ui0')}),
els3 AS MATERIALIZED ({without('els2', 'ui')}),
pruned AS MATERIALIZED (SELECT * FROM els3 WHERE tag NOT IN ('html', 'body') AND ({has_class('cls', R.PRUNED_CLASSES)} OR id = 'discussion' OR {D.in_list('role', R.DROPPED_ROLES)} OR regexp_matches(testid, 'share|sidebar|newsletter|comments')
  OR ({D.in_list('tag', R.STRUCTURAL_TAGS)} AND ({n()} = 0 OR ({density(0)} > 0.72 AND {n()} < 700)))))"""
CID = "lower(cls || ' ' || id)"
SCORE = (
    f"(n_p * 14.0::double + n_h * 8.0::double + least(n_li, 12) * 2.0::double + least({n()}, 12000)::double / 18.0 + CASE tag WHEN 'article' THEN 90 WHEN 'main' THEN 75 ELSE 0 END "
    f"+ CASE WHEN regexp_matches({CID}, 'article|content|post|story') THEN 40 ELSE 0 END + CASE WHEN regexp_matches({CID}, 'body|entry|markdown') THEN 24 ELSE 0 END "
    f"- CASE WHEN {density(1)} > 0.55 THEN 90 WHEN {density(1)} > 0.35 THEN 35 ELSE 0 END)"
)
CONTAINERS = D.in_list("tag", W.CANDIDATE_TAGS)
CHOICE = f"""{PRUNED_STAGE},
cand0 AS (SELECT e.*, {SCORE} AS score, {n()} AS chars, tag || '|' || id || '|' || cls || '|' || {D.dedupe_key('full_text')} AS ckey FROM els2 e JOIN et USING (page_id, op) WHERE {CONTAINERS} AND {n()} >= 250),
cand1 AS (SELECT * FROM cand0 QUALIFY row_number() OVER (PARTITION BY page_id, ckey ORDER BY op) = 1),
cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, op) AS rk FROM cand1),
pick AS (SELECT page_id, rk, [{{'op': op, 'en': en, 'chars': chars, 'tag': tag, 'score': score}}] AS kept FROM cand WHERE rk = 1
  UNION ALL SELECT p.page_id, c.rk, CASE WHEN len(p.kept) < 4 AND len(list_filter(p.kept, lambda k: ((c.op > k.op AND c.op < k.en) OR (k.op > c.op AND k.op < c.en)) AND least(c.chars, k.chars) >= greatest(c.chars, k.chars) * 0.8)) = 0
    THEN list_append(p.kept, {{'op': c.op, 'en': c.en, 'chars': c.chars, 'tag': c.tag, 'score': c.score}}) ELSE p.kept END FROM pick p JOIN cand c ON c.page_id = p.page_id AND c.rk = p.rk + 1),
chosen0 AS (SELECT page_id, arg_max(kept, rk) AS kept FROM pick GROUP BY page_id),
chosen1 AS (SELECT page_id, unnest(kept) AS k, generate_subscripts(kept, 1) AS choice FROM chosen0),
fall AS (SELECT page_id, op, en, {n()} AS chars, tag, {SCORE} AS score FROM els2 WHERE {CONTAINERS} AND {n()} > 0 AND page_id NOT IN (SELECT page_id FROM chosen0)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY NOT (tag = 'article' AND n_p >= 3 AND {n()} >= 500), score DESC, op) = 1),
chosen AS MATERIALIZED (SELECT page_id, choice::int AS choice, k.op AS op, k.en AS en, k.chars AS chars, k.tag AS tag, k.score AS score FROM chosen1 UNION ALL SELECT page_id, 1, op, en, chars, tag, score FROM fall)"""

USABLE = (
    f"(text <> '' AND CASE WHEN starts_with(tag, 'h') THEN {D.words('text')} BETWEEN 1 AND 18 AND length(text) BETWEEN 4 AND 140 ELSE (length(text) >= 45 OR {D.words('text')} >= 8) "
    f"AND length({D.sub('text', r'[^\p{L}\p{Nd}]')}) >= length(text) * 0.55::double "
    f"AND NOT {D.starts('lower(text)', R.NOISY_BLOCK_STARTS)} AND NOT {D.action_utility('text', 'false')} END)"
)
BLOCK_ELS = f"""txt3 AS MATERIALIZED (SELECT * FROM txt2 t WHERE NOT EXISTS (SELECT 1 FROM ui r WHERE r.page_id = t.page_id AND t.pos > r.op AND t.pos < r.en)),
divs AS (SELECT * FROM els3 WHERE tag = 'div' AND {n()} >= 40),
be0 AS (SELECT * FROM els3 e WHERE (tag IN ('h1', 'h2', 'h3', 'h4', 'p', 'pre') AND quote = 0) OR (tag IN ('li', 'blockquote') AND quote = 1)
  OR (tag = 'div' AND n_blk = 0 AND {n()} >= 45 AND NOT {marker_has('mark', R.UI_MARKER_PHRASES)} AND {density(1)} <= 0.72 AND NOT EXISTS (SELECT 1 FROM divs d WHERE d.page_id = e.page_id AND d.op > e.op AND d.op < e.en))),
bet AS (SELECT b.page_id, b.op, b.en, b.tag, b.mark, trim(coalesce(string_agg(t.piece, '' ORDER BY t.pos), '')) AS text FROM be0 b LEFT JOIN txt3 t ON t.page_id = b.page_id AND t.pos > b.op AND t.pos < b.en GROUP BY ALL),
bels AS MATERIALIZED (SELECT * FROM bet WHERE text <> '' AND (tag <> 'div' OR (length(text) >= 45 AND {D.words('text')} >= 8 AND regexp_matches(text, '\\p{{Ll}}') AND regexp_matches(text, '[.!?,]'))))"""
WHOLE_KEY = D.token_key("text")
SHAPED = "CASE WHEN starts_with(tag, 'h') THEN 'Heading' ELSE 'Paragraph' END AS type, CASE WHEN starts_with(tag, 'h') THEN regexp_replace(text, ':$', '') ELSE text END AS text"
BEST_BLOCKS = f"""{CHOICE}, {BLOCK_ELS},
cb0 AS (SELECT b.*, c.op AS cop, c.en AS cen FROM bels b JOIN chosen c ON c.page_id = b.page_id AND c.choice = 1 AND b.op > c.op AND b.op < c.en
  WHERE NOT EXISTS (SELECT 1 FROM pruned p WHERE p.page_id = b.page_id AND p.op > c.op AND p.op < c.en AND b.op >= p.op AND b.op < p.en)),
cb1 AS (SELECT b.page_id, b.op, b.tag, b.mark, CASE WHEN EXISTS (SELECT 1 FROM pruned p WHERE p.page_id = b.page_id AND p.op > b.op AND p.op < b.en) THEN
   coalesce((SELECT trim(string_agg(t.piece, '' ORDER BY t.pos)) FROM txt3 t WHERE t.page_id = b.page_id AND t.pos > b.op AND t.pos < b.en AND NOT EXISTS (SELECT 1 FROM pruned p WHERE p.page_id = b.page_id AND p.op > b.op AND p.op < b.en AND t.pos >= p.op AND t.pos < p.en)), '') ELSE b.text END AS text FROM cb0 b),
cb AS (SELECT *, {WHOLE_KEY} AS k FROM cb1 WHERE NOT {marker_has('mark', R.UI_MARKER_PHRASES)} AND {USABLE})
SELECT page_id, op AS pos, {SHAPED} FROM cb WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY page_id, k ORDER BY op) = 1"""


def meta(x, key_attr, key):
    tags = f"regexp_extract_all({x}, '(?i)<meta\\b[^>]*>')"
    return decode(attr(f"coalesce(list_filter({tags}, lambda t: lower({attr('t', key_attr)}) = '{key}')[1], '')", "content"))


def blank_null(x):
    return f"nullif({D.trim_ws(x)}, '')"


LAST = f"regexp_extract({D.url_path('url')}, '([^/]*)$', 1)"
URL_TITLE = f"(CASE WHEN trim({LAST}) <> '' THEN url_decode({LAST}) ELSE 'Remote PDF' END)"
TITLE = (
    f"coalesce({blank_null(meta('html', 'property', 'og:title'))}, {blank_null(meta('html', 'name', 'twitter:title'))}, "
    f"{blank_null(D.norm(decode('regexp_extract(html, ' + D.lit('(?is)<title[^>]*>(.*?)</title') + ', 1)')))}, {URL_TITLE})"
)
GOOD_META = f"(length(x) BETWEEN 3 AND 220 AND lower(x) <> lower(title) AND NOT {D.starts('lower(x)', R.METADATA_BAD_STARTS)})"
METADATA = f"""WITH {RICH}, t AS (SELECT page_id, html, {TITLE} AS title FROM rich),
m AS (SELECT page_id, title, {D.norm(meta('html', 'name', 'author'))} AS author, {D.norm("string_split(coalesce(" + blank_null(meta('html', 'property', 'article:published_time')) + ", " + blank_null(meta('html', 'name', 'article:published_time')) + ", ''), 'T')[1]")} AS day,
   {D.norm("coalesce(" + blank_null(meta('html', 'name', 'description')) + ", " + blank_null(meta('html', 'property', 'og:description')) + ", " + blank_null(meta('html', 'name', 'twitter:description')) + ", '')")} AS des,
   list_transform(regexp_extract_all(html, {D.lit(W.BYLINE_ELEMENT)}, 1), lambda b: {D.norm(decode('b'))}) AS bys FROM t),
u AS (SELECT page_id, title, 0 AS o, 'By ' || author AS text FROM (SELECT *, author AS x FROM m) WHERE {GOOD_META} UNION ALL SELECT page_id, title, 1, 'Published ' || day FROM m WHERE day <> ''
  UNION ALL SELECT page_id, title, 2, des FROM m WHERE length(des) BETWEEN 40 AND 220 AND lower(des) <> lower(title)
  UNION ALL SELECT page_id, title, 2 + o, x FROM (SELECT page_id, title, unnest(bys) AS x, generate_subscripts(bys, 1) AS o FROM m) WHERE {GOOD_META}),
d AS (SELECT page_id, text, min(o) AS o FROM u GROUP BY page_id, text)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS pos, text FROM d"""

BASE = "regexp_extract(url, '^[^?#]*')"
ROOT = "regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1)"
LINKS = f"""WITH {ELS}, l AS (SELECT e.page_id, e.op, e.href, trim(string_agg(t.piece, '' ORDER BY t.pos)) AS label FROM el e JOIN tokens t ON t.page_id = e.page_id AND t.pos > e.op AND t.pos < e.en AND t.piece <> '' WHERE e.tag = 'a' AND e.href <> '' GROUP BY ALL),
r AS (SELECT l.page_id, op, label, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:') || href WHEN starts_with(href, '/') THEN {ROOT} || href
   WHEN starts_with(href, '#') THEN regexp_replace(url, '#.*$', '') || href WHEN starts_with(href, '?') THEN {BASE} || href
   ELSE CASE WHEN regexp_matches({BASE}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+.*/') THEN regexp_extract({BASE}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+.*/') ELSE {ROOT} || '/' END || href END AS href FROM l JOIN pages USING (page_id))
SELECT page_id, label, href, min(op) AS pos FROM r WHERE label <> '' GROUP BY ALL"""

JSON_TEXT = "json_extract_string('{\"v\":\"' || {} || '\"}', '$.v')"
SHEAD = f"({D.words('text')} BETWEEN 1 AND 12 AND length(text) BETWEEN 4 AND 110 AND NOT regexp_matches(text, '[.!?]$') AND regexp_matches(text, '\\p{{Lu}}') AND NOT starts_with(lower(text), 'http'))"
LD = f"""WITH {RICH}, s AS (SELECT page_id, array_to_string(regexp_extract_all(html, {D.lit(W.LD_JSON)}, 1), chr(10)) AS js FROM rich),
v AS (SELECT page_id, unnest(regexp_extract_all(js, {D.lit(NO_POSSESSIVE['article'])}, 1)) AS raw FROM s),
b0 AS (SELECT page_id, json_extract_string('{{"v":"' || raw || '"}}', '$.v') AS t FROM v),
b AS (SELECT page_id, {D.trim_ws(D.sub(D.sub(D.sub('t', chr(13) + chr(10) + '?', chr(10)), '[ ' + chr(92) + 't]+' + chr(92) + 'n', chr(10)), chr(92) + 'n{3,}', chr(10) + chr(10)))} AS body FROM b0),
o AS (SELECT * FROM b WHERE length(body) >= 500 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(body) DESC) = 1),
p0 AS (SELECT page_id, string_split_regex(body, '\\n\\s*\\n+') AS ps FROM o),
p AS (SELECT page_id, unnest(ps) AS x, generate_subscripts(ps, 1) - 1 AS pos FROM p0), q AS (SELECT page_id, pos, {D.norm('x')} AS text, 'p' AS tag FROM p)
SELECT page_id, pos, CASE WHEN {SHEAD} THEN 'Heading' ELSE 'Paragraph' END AS type, CASE WHEN {SHEAD} THEN regexp_replace(text, ':$', '') ELSE text END AS text FROM q WHERE {SHEAD} OR {USABLE}"""
TKEY = D.token_key("title")
ANCHORED = f"""WITH {PRUNED_STAGE}, {BLOCK_ELS}, ti AS (SELECT page_id, {TITLE} AS title, {D.url_host('url')} AS host FROM rich),
a0 AS (SELECT b.*, {D.token_key('text')} AS k, {TKEY} AS tk, host FROM bels b JOIN ti USING (page_id)),
a1 AS (SELECT *, max((starts_with(tag, 'h') AND (contains(k, tk) OR contains(tk, k)))::int) OVER (PARTITION BY page_id ORDER BY op) AS started FROM a0 WHERE tk <> ''),
a2 AS (SELECT *, {WHOLE_KEY} AS k2 FROM a1 WHERE started = 1 AND NOT ({D.starts('lower(text)', R.ANCHOR_STOPS)} OR (starts_with(tag, 'h') AND length(text) < 80 AND {D.has('lower(text)', R.ANCHOR_STOPS)})
   OR (contains(host, 'siam.org') AND {D.starts('lower(text)', R.ANCHOR_STOPS_BY_HOST['siam.org'])})) AND (starts_with(tag, 'h') OR {USABLE}))
SELECT page_id, op AS pos, {SHAPED} FROM a2 WHERE k2 <> '' QUALIFY row_number() OVER (PARTITION BY page_id, k2 ORDER BY op) = 1"""

FIRST = "list_filter(list_transform(string_split_regex({}, '(?i)\\s*(?:,|;|\\band\\b|&)\\s*'), lambda p: trim(p)), lambda p: p <> '')[1]"
NAME_WORDS = "list_transform(string_split_regex(nm, '\\s+'), lambda w: regexp_replace(w, '^[.,;]+|[.,;]+$', '', 'g'))"
AUTHORS = f"""WITH meta AS ({METADATA}),
a AS (SELECT page_id, pos, text, {FIRST.format('text')} AS nm, {FIRST.format("regexp_replace(text, '(?i)^by\\s+', '')")} AS byname FROM (SELECT page_id, pos, {D.collapse('text')} AS text FROM meta)),
b AS (SELECT page_id, pos, CASE WHEN regexp_matches(text, '(?i)^by .+$') THEN byname WHEN NOT {D.has('lower(text)', AUTHOR_STOP_WORDS)} AND length(nm) BETWEEN 4 AND 60 AND NOT regexp_matches(nm, '[@:]')
   AND len({NAME_WORDS}) BETWEEN 2 AND 5 AND len(list_filter({NAME_WORDS}, lambda w: NOT regexp_matches(w, '^\\p{{Lu}}'))) = 0 THEN nm END AS author FROM a)
SELECT p.page_id, (SELECT arg_min(author, pos) FROM b WHERE b.page_id = p.page_id AND author IS NOT NULL) AS author FROM pages p"""

CHECKS = {
    "n10_authors": AUTHORS,
    "s01_page_scan": f"SELECT page_id, url, {URL_TITLE} AS title, length(html) AS n_chars FROM pages",
    "w01_live_text": f"WITH {TOKENS} SELECT page_id, trim(string_agg(piece, '' ORDER BY pos)) AS text FROM tokens GROUP BY page_id",
    "w02_tag_events": f"WITH {TOKENS} SELECT page_id, pos, kind, tag, level, end_pos, depth, parent, live, quote, piece FROM tokens",
    "w03_noisy_containers": f'WITH {ELS} SELECT page_id, op AS "open", en AS "end", tag, mark AS marker FROM el WHERE {NOISY}',
    "w04_pruned_elements": f'WITH {PRUNED_STAGE} SELECT page_id, op AS "open", en AS "end", tag, raw_len, raw_link FROM pruned',
    "w05_container_scores": f'WITH {STAGES} SELECT page_id, op AS "open", tag, n_p, n_h, n_li, {n()} AS n_chars, round({SCORE}, 4) AS score FROM els2 WHERE {CONTAINERS}',
    "w06_container_choice": f'WITH RECURSIVE {CHOICE} SELECT page_id, choice, op AS "open", tag, chars AS n_chars, round(score, 4) AS score FROM chosen',
    "w07_container_blocks": f"WITH RECURSIVE {BEST_BLOCKS}",
    "w08_inline_ui": f'WITH {STAGES} SELECT page_id, op AS "open", en AS "end", tag FROM ui0',
    "w09_links": LINKS,
    "w10_titles": f"WITH {RICH} SELECT page_id, {TITLE} AS title FROM rich",
    "w11_metadata": METADATA,
    "w12_json_ld": LD,
    "w15_title_anchored": ANCHORED,
    "w19_challenge_pages": f"WITH {RICH} SELECT page_id, {D.has('lower(html)', R.CHALLENGE_PHRASES)}::int AS is_challenge FROM rich",
}
