"""DuckDB twins of the derived inputs."""

from leafmill.checks.duck import LINES, dedupe_key, lit, norm, plain_heading, sub  # noqa: F401
from leafmill.plans.inputs import NOISE_LINES

NOISE = "[" + ", ".join(lit(s) for s in NOISE_LINES) + "]"
NOISY_DOCS = f"""noisy_docs AS (
  SELECT doc_id, source, lang, list_aggregate(list_transform(string_split(text, chr(10)), lambda line, i:
     CASE WHEN (doc_id + i - 1) % 3 = 0
          THEN line || chr(10) || ({NOISE})[((doc_id * 7 + i - 1) % {len(NOISE_LINES)} + 1)::int]
          ELSE line END), 'string_agg', chr(10)) AS text FROM documents)"""


def blocks_of(source: str, name: str = "blocks", keys: str = "doc_id") -> str:
    """CTEs giving <name>(doc_id, pos, type, text) from a (doc_id, text) relation."""
    return f"""{name}_raw AS (
  SELECT {keys}, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {source}),
{name} AS (
  SELECT {keys}, pos, CASE WHEN {plain_heading('text')} THEN 'Heading' ELSE 'Paragraph' END AS type, text
  FROM (SELECT {keys}, pos, {norm('raw')} AS text FROM {name}_raw) WHERE text <> '')"""


NOISY_BLOCKS = NOISY_DOCS + ",\n" + blocks_of("noisy_docs") + """,
titles AS (SELECT doc_id, arg_min(text, pos) AS title FROM blocks GROUP BY doc_id)"""


def wrapped(x: str) -> str:
    t = sub(x, r"([.!?])\n", "\\1\n \n")
    t = f"replace({t}, 'ing ', 'ing-' || chr(10))"
    t = f"replace({t}, ' and ', ' and/ ' || chr(10))"
    return f"replace({t}, ' de ', ' de' || chr(13) || chr(10))"


GIVEN_TITLE = "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN string_split(text, chr(10))[1] ELSE source END"
