"""DuckDB SQL fragments used by the check queries.

Each function returns a SQL expression.  They restate the text rules for the
other engine, so a query and its check share word lists but no logic.
"""

from __future__ import annotations

from leafmill.functions import rules as R
from leafmill.functions.rules import any_of


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def sub(x: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(new)}, 'g')"


def in_list(x: str, values) -> str:
    return f"{x} IN (" + ", ".join(lit(v) for v in values) + ")"


def trim_ws(x: str) -> str:
    return sub(x, r"^\s+|\s+$")


def collapse(x: str) -> str:
    return f"trim({sub(x, r'\s+', ' ')})"


def norm(x: str) -> str:
    return f"trim({sub(sub(f'translate({x}, chr(160) || chr(173), {lit('  ')})', r'\s+', ' '), ' ([,.;:!?])', chr(92) + '1')})"


def dedupe_key(x: str) -> str:
    return collapse(sub(f"lower({norm(x)})", "[^a-z0-9 ]"))


def token_key(x: str) -> str:
    return f"trim({sub(sub(f'lower({x})', r'\s+', ' '), '[^a-z0-9 ]')})"


def signature(x: str) -> str:
    return collapse(sub(f"lower({x})", r"\d+", "#"))


def count_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def words(x: str) -> str:
    return count_of(x, r"\S+")


def starts(x: str, phrases) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {lit(p)})" for p in phrases) + ")"


def has(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in phrases) + ")"


def n_contained(x: str, phrases) -> str:
    return "(" + " + ".join(f"contains({x}, {lit(p)})::int" for p in phrases) + ")"


def article_remainder(x: str) -> str:
    return f"(length({x}) >= 40 AND {words(x)} >= 8 AND {rx(x, r'\p{Ll}')} AND {rx(x, '[.,;:]')})"


def article_or_title(x: str) -> str:
    title = f"(length({x}) BETWEEN 12 AND 220 AND {words(x)} BETWEEN 2 AND 24 AND {rx(x, r'\p{Ll}')})"
    return f"({article_remainder(x)} OR {title})"


def _strip_stage(name: str, prev: str, keys: str, pattern: str) -> str:
    return f"""
{name}_m AS (SELECT *, trim({sub('cur', pattern)}) AS rest FROM {prev}),
{name} AS (SELECT {keys}, CASE WHEN {rx('cur', pattern)} AND {article_or_title('rest')}
   THEN rest ELSE cur END AS cur FROM {name}_m)"""


def strip_ctes(prefix: str, source: str, keys: str, text: str) -> str:
    """CTEs ending in <prefix>_out(keys, cur): the five footer strips over normalised text."""
    p = prefix
    ends = [
        f"CASE WHEN instr(lower(cur), {lit(m)}) > 0 THEN {{'at': instr(lower(cur), {lit(m)}), 'rank': {i}, 'n': {len(m)}}} END"
        for i, m in enumerate(R.FOOTER_PUBLISHERS)
    ]
    return f"""
{p}_0 AS (SELECT {keys}, trim({text}) AS cur FROM {source}),
{_strip_stage(p + '_1', p + '_0', keys, R.LEAD_PUBLISHER_LABEL)},
{p}_2a AS (SELECT *, list_max([{', '.join(ends)}]) AS pub, regexp_extract(cur, {lit(R.RIGHTS_SENTENCE)}) AS rr FROM {p}_1),
{p}_2b AS (SELECT *, trim({sub(f"substr(cur, (CASE WHEN pub IS NOT NULL THEN pub.at + pub.n - 1 ELSE instr(cur, rr) + length(rr) - 1 END)::int + 1)", R.COPYRIGHT_TAIL_NOISE)}) AS rest FROM {p}_2a),
{p}_2 AS (SELECT {keys}, CASE WHEN (starts_with(lower(cur), 'copyright') OR starts_with(cur, '©'))
    AND contains(lower(cur), 'all rights reserved') AND {article_remainder('rest')} THEN rest ELSE cur END AS cur FROM {p}_2b),
{_strip_stage(p + '_3', p + '_2', keys, R.LEAD_PUBLISHER_FOOTER)},
{_strip_stage(p + '_4', p + '_3', keys, R.TRAIL_COPYRIGHT_FOOTER)},
{_strip_stage(p + '_5', p + '_4', keys, R.TRAIL_PUBLISHER_FOOTER)},
{p}_out AS (SELECT {keys}, trim(cur) AS cur FROM {p}_5)"""


def tokens(x: str) -> str:
    edge = f"^[{R.TOKEN_TRIM}]+|[{R.TOKEN_TRIM}]+$"
    return (
        f"list_filter(list_transform(string_split_regex(lower({x}), '\\s+'), "
        f"lambda t: {sub('t', edge)}), lambda t: t <> '')"
    )


def social_share(x: str) -> str:
    low = f"lower({x})"
    hits = " + ".join(
        f"({low} = {lit(t)} OR contains({low}, {lit(' ' + t)}) OR starts_with({low}, {lit(t + ' ')}))::int"
        for t in R.SOCIAL_TOKENS
    )
    return f"(length({x}) <= 220 AND (({hits}) >= 2 OR {starts(low, R.SOCIAL_STARTS)}))"


def ad_tech(x: str, heading: str) -> str:
    low = f"lower({x})"
    return (
        f"(length({x}) <= 180 AND ({in_list(low, R.AD_EXACT)} OR ({has(low, R.AD_TOKENS)} AND "
        f"({words(x)} <= 8 OR ({heading} AND length({x}) <= 80)))))"
    )


def copyright_footer(x: str) -> str:
    low = f"lower({x})"
    mark = f"(contains({low}, 'copyright') OR contains({x}, '©'))"
    rights = f"contains({low}, 'all rights reserved')"
    pub = has(low, R.RIGHTS_PUBLISHERS)
    return (
        f"(length({x}) <= 360 AND (({mark} AND {rights}) OR ({mark} AND {pub}) OR "
        f"({rights} AND ({pub} OR {rx(low, R.HASH_PATTERN)}))))"
    )


def publisher_footer(x: str) -> str:
    low = f"lower({x})"
    return (
        f"(length({x}) <= 220 AND {has(low, R.FOOTER_PUBLISHERS)} AND ({rx(low, R.HASH_PATTERN)} "
        f"OR ({words(x)} <= 10 AND NOT {rx(x, '[.!?]')})))"
    )


def action_utility(x: str, heading: str) -> str:
    t = tokens(x)
    acts = f"len(list_filter({t}, lambda t: {in_list('t', R.ACTION_TOKENS)}))"
    utils = f"len(list_filter({t}, lambda t: {in_list('t', R.UTILITY_TOKENS)}))"
    short = f"(len(list_filter({t}, lambda t: length(t) <= 14)) >= len({t}) - 1)"
    return (
        f"(length({x}) <= 180 AND len({t}) > 0 AND (({short} AND {acts} >= 2) OR ({heading} AND {acts} >= 1 "
        f"AND len({t}) <= 4) OR ({short} AND {utils} >= 3 AND len({t}) <= 10)))"
    )


def site_info(x: str) -> str:
    low = f"lower({x})"
    return (
        f"(length({x}) <= 260 AND ({n_contained(low, R.SITE_INFO_PHRASES)} >= 2 OR "
        f"{starts(low, ['site information', 'site index'])}))"
    )


def nav_line(x: str) -> str:
    arms = " ".join(
        f"WHEN len(string_split({x}, {lit(s)})) >= 3 THEN len(list_filter(string_split({x}, {lit(s)}), "
        f"lambda p: trim(p) <> '' AND length(trim(p)) <= 22 AND {words('p')} <= 3))"
        for s in R.NAV_SEPARATORS
    )
    return f"(length({x}) <= 220 AND (CASE {arms} ELSE 0 END) >= 3)"


def media_credit(x: str, heading: str) -> str:
    low = f"lower({x})"
    hit = " OR ".join(
        f"{low} = {lit(p)} OR starts_with({low}, {lit(p + ' ')}) OR starts_with({low}, {lit(p + ':')})"
        for p in R.CREDIT_PREFIXES
    )
    return f"(NOT {heading} AND length({x}) <= 160 AND ({hit}))"


def acknowledgement(x: str) -> str:
    low = f"lower({x})"
    hit = " OR ".join(
        f"{low} = {lit(p)} OR starts_with({low}, {lit(p + ' ')})" for p in R.ACK_PREFIXES
    )
    return f"(length({x}) <= 220 AND {words(x)} <= 28 AND ({hit}))"


def boilerplate_rules(x: str, heading: str) -> dict[str, str]:
    low = f"lower({x})"
    return {
        "hard_prefix": starts(low, R.HARD_PREFIXES),
        "heading_phrase": f"({heading} AND length({x}) <= 180 AND {has(low, R.HEADING_PHRASES)})",
        "ui_phrase": f"({words(x)} <= 6 AND length({x}) <= 180 AND {starts(low, R.UI_PHRASES)})",
        "social_share": social_share(x),
        "ad_tech": ad_tech(x, heading),
        "copyright_footer": copyright_footer(x),
        "publisher_footer": publisher_footer(x),
        "action_utility": action_utility(x, heading),
        "site_info": site_info(x),
        "nav_line": nav_line(x),
        "media_credit": media_credit(x, heading),
        "acknowledgement": acknowledgement(x),
    }


def is_boilerplate(x: str, heading: str) -> str:
    return "(" + " OR ".join(boilerplate_rules(x, heading).values()) + ")"


def is_stop_heading(x: str, heading: str) -> str:
    return f"(({heading} AND {has(f'lower({x})', R.STOP_HEADINGS)}) OR (NOT {heading} AND {acknowledgement(x)}))"


def url_host(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


def url_path(x: str) -> str:
    return f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def plain_heading(x: str) -> str:
    low = f"lower({x})"
    return (
        f"(length({x}) BETWEEN 3 AND 110 AND {words(x)} BETWEEN 1 AND 14 AND NOT {rx(x, '[.?!]$')} AND NOT "
        f"(starts_with({low}, 'http://') OR starts_with({low}, 'https://')) AND {rx(x, r'[\p{Lu}\p{Nd}]')})"
    )


def plain_title(x: str) -> str:
    return (
        f"(length({x}) BETWEEN 4 AND 140 AND {words(x)} BETWEEN 1 AND 18 AND NOT {rx(x, '[.?!]$')} "
        f"AND {rx(x, r'\p{Lu}')})"
    )


def plain_metadata(x: str) -> str:
    low = f"lower({x})"
    return (
        f"(length({x}) BETWEEN 3 AND 220 AND NOT {starts(low, ['abstract', 'introduction'])} AND "
        f"({has(low, R.PLAIN_METADATA_MARKERS)} OR ({words(x)} <= 20 AND {rx(x, '[,;]')} AND "
        f"{count_of(x, r'\p{Lu}')} >= 2 AND NOT ends_with({x}, '.'))))"
    )


# document lines as blocks: the shared input of the block operators
LINES = """lines AS (
  SELECT doc_id, i - 1 AS pos, raw FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
           generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""
LINE_BLOCKS = f"""{LINES},
line_blocks AS (
  SELECT doc_id, pos, text, CASE WHEN {plain_heading('text')} THEN 'Heading' ELSE 'Paragraph' END AS type
  FROM (SELECT doc_id, pos, {norm('raw')} AS text FROM lines))"""
