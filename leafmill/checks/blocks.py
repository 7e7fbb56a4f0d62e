"""DuckDB SQL of the block queries."""

from leafmill.checks import duck as D
from leafmill.checks.inputs import GIVEN_TITLE, NOISY_BLOCKS, NOISY_DOCS, blocks_of, wrapped  # noqa: F401

HEAD = "(type = 'Heading')"


def _short(x: str) -> str:
    return D.dedupe_key(x)


NL = "chr(10)"


def _continues(left: str, right: str) -> str:
    return (
        f"(length({left}) <= 420 AND length({right}) <= 420 AND {left} <> '' AND NOT {D.rx(left, '[.!?]$')} "
        f"AND {D.rx(right, chr(94) + chr(91) + chr(92) + 'p{Ll}' + chr(92) + 'p{Nd}' + chr(34) + chr(39) + '(]')})"
    )


def _joined(left: str, right: str) -> str:
    return (
        f"(CASE WHEN ends_with({left}, '-') THEN substr({left}, 1, length({left}) - 1) || {right} "
        f"ELSE {left} || ' ' || {right} END)"
    )


MERGE = f"""WITH RECURSIVE {NOISY_BLOCKS},
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM blocks),
walk AS (
  SELECT doc_id, n, pos AS start, type, text FROM seq WHERE n = 1
  UNION ALL
  SELECT doc_id, n, CASE WHEN m THEN start ELSE pos END, CASE WHEN m THEN ptype ELSE type END,
         CASE WHEN m THEN {_joined('ptext', 'text')} ELSE text END
  FROM (SELECT w.doc_id, s.n, w.start, s.pos, w.type AS ptype, s.type, w.text AS ptext, s.text,
               (w.type = 'Paragraph' AND s.type = 'Paragraph' AND {_continues('w.text', 's.text')}) AS m
        FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.n = w.n + 1))
SELECT doc_id, start AS pos, arg_max(type, n) AS type, arg_max(text, n) AS text FROM walk GROUP BY doc_id, start"""


def fold(seq: str, ignored: str | None, merge: bool) -> str:
    """Recursive CTEs over <seq>(doc_id, n, pos, type, text, skey, key): the cleanup fold, one block per step."""
    lead = f"(NOT w.started AND list_contains({ignored}, s.skey))" if ignored else "false"
    merges = (
        f"(len(w.kept) > 0 AND w.kept[-1].type = 'Paragraph' AND s.type = 'Paragraph' AND {_continues('w.kept[-1].text', 's.text')})"
        if merge
        else "false"
    )
    replaces = (
        "(len(w.kept) > 0 AND w.kept[-1].type = s.type AND length(s.key) > length(w.kept[-1].key) "
        "AND contains(s.key, w.kept[-1].key) AND length(w.kept[-1].key) >= 40)"
    )
    dup = (
        "(len(list_filter(w.kept, lambda e: e.type = s.type AND e.key <> '' AND (e.key = s.key "
        "OR (contains(e.key, s.key) AND length(s.key) >= 40) OR (contains(s.key, e.key) AND length(e.key) >= 40)))) > 0 "
        "OR list_contains(w.seen, s.skey))"
    )
    act = f"CASE WHEN {lead} THEN 'skip' WHEN {merges} THEN 'merge' WHEN {replaces} THEN 'replace' WHEN {dup} THEN 'skip' ELSE 'add' END"
    new_text = _joined("kept[-1].text", "text")
    head_text = "CASE WHEN type = 'Heading' THEN regexp_replace(text, ':$', '') ELSE text END"

    def ent(pos, typ, text, key):
        return f"{{'pos': {pos}, 'type': {typ}, 'text': {text}, 'key': {key}}}"

    body = f"""
  SELECT doc_id, n, act <> 'skip' OR started AS started,
    CASE WHEN act = 'add' THEN list_append(seen, skey) ELSE seen END AS seen,
    CASE act WHEN 'skip' THEN kept
      WHEN 'merge' THEN list_append(kept[:-2], {ent('kept[-1].pos', 'kept[-1].type', new_text, D.dedupe_key(new_text))})
      WHEN 'replace' THEN list_append(kept[:-2], {ent('kept[-1].pos', 'kept[-1].type', 'text', 'key')})
      ELSE list_append(kept, {ent('pos', 'type', head_text, 'key')}) END AS kept
  FROM (SELECT w.doc_id, s.n, w.started, w.seen, w.kept, s.pos, s.type, s.text, s.skey, s.key, {act} AS act
        FROM walk w JOIN {seq} s ON s.doc_id = w.doc_id AND s.n = w.n + 1)"""
    return f"""walk AS (
  SELECT DISTINCT doc_id, 0::BIGINT AS n, false AS started, []::VARCHAR[] AS seen,
         []::STRUCT(pos BIGINT, type VARCHAR, text VARCHAR, key VARCHAR)[] AS kept FROM {seq}
  UNION ALL {body}),
folded AS (SELECT doc_id, unnest(arg_max(kept, n)) AS b FROM walk GROUP BY doc_id)"""


def keyed_seq(source: str, extra: str = "") -> str:
    return f"""seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM (
  SELECT doc_id, pos, type, text{extra}, {_short('text')} AS skey, {D.dedupe_key('text')} AS key FROM {source}) WHERE skey <> '')"""


FILTERED = f"""{D.strip_ctes('st', 'blocks', 'doc_id, pos, type', 'text')},
filtered AS (SELECT doc_id, pos, type, cur AS text FROM st_out WHERE cur <> ''
   AND NOT {D.is_boilerplate('cur', HEAD)} AND NOT {D.is_stop_heading('cur', HEAD)})"""

CLEANUP = f"""WITH RECURSIVE {NOISY_BLOCKS}, {FILTERED}, {keyed_seq('filtered')},
ign AS (SELECT doc_id, list_filter([{D.dedupe_key('title')}], lambda k: k <> '') AS ignored FROM titles),
seq2 AS (SELECT s.*, i.ignored FROM seq s JOIN ign i USING (doc_id)),
{fold('seq2', 's.ignored', True)}
SELECT doc_id, b.pos AS pos, b.type AS type, b.text AS text FROM folded"""

CONTAINMENT = f"""WITH RECURSIVE {NOISY_BLOCKS}, {keyed_seq('blocks')}, {fold('seq', None, False)}
SELECT doc_id, b.pos AS pos, b.type AS type, b.text AS text FROM folded"""

_JOIN = D.sub(D.sub(D.sub(D.sub("chunk", r"^\s+|\s+$"), r"\s*\n\s*", "\n"), r"-\n(\p{Ll})", "\\1"), "([/—–])\n", "\\1")
_JOINED = f"trim({D.sub(D.collapse(_JOIN), ' ([,.;:!?])', chr(92) + '1')})"


def paragraphs(source: str, keys: str = "doc_id") -> str:
    """CTEs ending in paras(doc_id, pos, text): plain text split on blank lines, lines joined."""
    body = D.sub(D.sub(f"translate(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(160), ' ')", r"\n{3,}", "\n\n"), r"^\s+|\s+$")
    return f"""chunks AS (SELECT {keys}, unnest(parts) AS chunk, generate_subscripts(parts, 1) AS i FROM (
  SELECT {keys}, string_split_regex({body}, '\\n\\s*\\n+') AS parts FROM {source})),
paras AS (SELECT {keys}, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, text FROM (
  SELECT {keys}, i, {_JOINED} AS text FROM chunks) WHERE text <> '')"""


PEEL = f"""WITH src AS (
  SELECT doc_id, {GIVEN_TITLE} AS given, replace(CASE WHEN doc_id % 2 = 0 THEN 'Notes From ' || upper(source[1]) || source[2:] ||
     chr(10) || 'By The Desk, University' || chr(10) || 'One Two; Three Four' || chr(10) || text ELSE text END, chr(10), chr(10) || chr(10)) AS text
  FROM documents),
{paragraphs('src')},
p1 AS (SELECT s.doc_id, nullif(trim({D.sub('s.given', r'\s+', ' ')}), '') AS given, p.text AS first
       FROM src s LEFT JOIN paras p ON p.doc_id = s.doc_id AND p.pos = 0),
p2 AS (SELECT doc_id, given, first, coalesce(CASE WHEN given IS NOT NULL THEN {D.token_key('first')} = {D.token_key('given')}
         ELSE {D.plain_title('first')} END, false) AS take FROM p1),
p3 AS (SELECT doc_id, take, coalesce(given, CASE WHEN take THEN first END, 'Captured text') AS title FROM p2),
rest AS (SELECT p.doc_id, p.pos - take::int AS pos, p.text FROM paras p JOIN p3 USING (doc_id) WHERE p.pos >= take::int),
flags AS (SELECT *, min({D.plain_metadata('text')}::int) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM rest),
parts AS (SELECT *, (run = 1 AND pos < 3) AS meta FROM flags),
body AS (SELECT doc_id, count(*) FILTER (NOT meta) AS n_blocks,
   count(*) FILTER (NOT meta AND {D.plain_heading('text')}) AS n_headings,
   string_agg(CASE WHEN {D.plain_heading('text')} THEN regexp_replace(text, ':$', '') ELSE text END, '|' ORDER BY pos) FILTER (NOT meta) AS body,
   string_agg(text, '|' ORDER BY pos) FILTER (meta) AS metadata FROM parts GROUP BY doc_id),
allp AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS whole FROM paras GROUP BY doc_id)
SELECT p3.doc_id, p3.title, coalesce(metadata, '') AS metadata,
  CASE WHEN coalesce(n_blocks, 0) = 0 THEN 1 ELSE n_blocks END AS n_blocks, coalesce(n_headings, 0) AS n_headings,
  CASE WHEN coalesce(n_blocks, 0) = 0 THEN coalesce(nullif(whole, ''), 'Captured text') ELSE body.body END AS body
FROM p3 LEFT JOIN body USING (doc_id) LEFT JOIN allp USING (doc_id)"""

_FLAGS = ", ".join(f"{v}::int AS {k}" for k, v in D.boilerplate_rules("text", HEAD).items())

CHECKS = {
    "b01_block_normalised": f"WITH {D.LINES} SELECT doc_id, pos, {D.norm('raw')} AS text, {D.dedupe_key('raw')} AS dedupe_key, {D.token_key('raw')} AS token_key, {D.signature('raw')} AS signature FROM lines",
    "b02_footer_strip": f"WITH {NOISY_BLOCKS}, {D.strip_ctes('st', 'blocks', 'doc_id, pos', 'text')} SELECT doc_id, pos, cur AS text FROM st_out",
    "b03_boilerplate_rules": f"WITH {NOISY_BLOCKS} SELECT doc_id, pos, type, {_FLAGS} FROM blocks",
    "b04_stop_headings": f"WITH {NOISY_BLOCKS} SELECT doc_id, pos, type, text FROM blocks WHERE NOT {D.is_stop_heading('text', HEAD)}",
    "b05_leading_title": f"""WITH {NOISY_BLOCKS},
 f AS (SELECT b.*, max(({_short('b.text')} <> {D.dedupe_key('t.title')} OR {D.dedupe_key('t.title')} = '')::int)
        OVER (PARTITION BY b.doc_id ORDER BY b.pos) AS started FROM blocks b JOIN titles t USING (doc_id))
 SELECT doc_id, pos, text FROM f WHERE started = 1""",
    "b06_continuation_merge": MERGE,
    "b07_exact_dedupe": f"""WITH {NOISY_BLOCKS}, k AS (SELECT *, {_short('text')} AS key FROM blocks)
 SELECT doc_id, pos, type, text FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) = 1""",
    "b08_containment_dedupe": CONTAINMENT,
    "b09_block_cleanup": CLEANUP,
    "b10_plain_paragraphs": f"WITH src AS (SELECT doc_id, {wrapped('text')} AS text FROM documents), {paragraphs('src')} SELECT doc_id, pos, text FROM paras",
    "b11_plain_peel": PEEL,
    "b12_plain_headings": f"WITH {NOISY_BLOCKS} SELECT doc_id, pos, type, CASE WHEN type = 'Heading' THEN regexp_replace(text, ':$', '') ELSE text END AS text FROM blocks",
}
