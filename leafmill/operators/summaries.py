"""Generated summaries as a table of display lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import col

# --- fixed values: summary marks ---
MARK = r"(?:[-*·•▪◦]|\d+[.)])"
BROKEN_BULLETS = ["â€¢", "Â·", "â–ª", "â—¦"]
LINE = "struct<kind:string,text:string>"


def normalised(c) -> Column:
    """Fences gone, broken bullets repaired, the two headings and every bullet on a line of their own."""
    t = F.regexp_replace(F.regexp_replace(col(c), r"```(?:[\w-]+)?", ""), "\r\n?", "\n")
    t = F.regexp_replace(t, rf"(?<=\S)\s+(?={MARK}\s+)", "\n")
    for broken in BROKEN_BULLETS:
        t = F.replace(t, F.lit(broken), F.lit("•"))
    t = F.regexp_replace(t, r"(?i)\boverview:\s*", "Overview:\n")
    t = F.regexp_replace(t, r"(?i)\bkey points:\s*", "\n\nKey points:\n")
    t = F.regexp_replace(t, r"(?m)^\s*[·•▪◦]\s*", "• ")
    t = F.regexp_replace(t, r"(?m)^\s*[-*]\s+", "• ")
    t = F.regexp_replace(t, rf"(?<=[.!?])\s*(?={MARK}\s*)", "\n")
    t = F.regexp_replace(t, rf"(?m)^(\s*{MARK})(?=\S)", "$1 ")
    t = F.regexp_replace(F.regexp_replace(t, rf"(?<=\S)\s+(?={MARK}\s+)", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def bullet_items(line) -> Column:
    """Texts after each bullet mark of a line."""
    parts = F.split(line, rf"(?:^|(?<=[\s.!?])){MARK}\s*", -1)
    return F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), F.trim), lambda x: x != "")


def summary_lines(c) -> Column:
    """ARRAY<STRUCT<kind, text>> with kind Heading, Bullet, Paragraph or Spacer."""
    start = F.struct(F.lit(False).alias("inside"), F.array().alias("out")).cast(
        f"struct<inside:boolean,out:array<{LINE}>>"
    )

    def row(kind, text):
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    def step(acc, raw):
        t = F.regexp_replace(raw, r"^\s+|\s+$", "")
        heading = F.lower(t).isin("overview:", "key points:")
        items = bullet_items(t)
        bullets = F.size(items) > 0
        marks = F.transform(acc.out, lambda r: r.kind == "Bullet")
        last_at = F.size(acc.out) - F.array_position(F.reverse(marks), F.lit(True)).cast("int")
        has_bullet = F.exists(marks, lambda m: m)
        last = F.get(acc.out, last_at)
        implicit = has_bullet & t.rlike(r"^[\p{Lu}\p{Nd}\"'(]") & last.text.rlike(r"[.!?)\"]$")
        grown = F.transform(
            acc.out,
            lambda r, i: F.when(
                i == last_at, F.struct(r.kind.alias("kind"), F.concat_ws(" ", r.text, t).alias("text"))
            ).otherwise(r),
        )
        plus = lambda new: F.concat(acc.out, new)
        out = (
            F.when(t == "", plus(F.array(row("Spacer", F.lit("")))))
            .when(heading, plus(F.array(row("Heading", t))))
            .when(bullets, plus(F.transform(items, lambda x: row("Bullet", x))))
            .when(acc.inside & has_bullet & ~implicit, grown)
            .when(acc.inside, plus(F.array(row("Bullet", t))))
            .otherwise(plus(F.array(row("Paragraph", t))))
        )
        inside = (
            F.when(t == "", F.lit(False)).when(heading, F.lower(t) == "key points:").when(bullets, True).otherwise(acc.inside)
        )
        return F.struct(inside.alias("inside"), out.alias("out"))

    return F.aggregate(F.split(normalised(c), "\n"), start, step).out
