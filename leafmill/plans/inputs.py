"""Inputs derived from the given tables by fixed rules, the same rules in both engines.

The given prose is invented, so phrase rules rarely fire on it.  Lines and fields
that make them fire are added to the whole tables here; nothing is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import strings
from leafmill.operators.blocks import line_blocks
from leafmill.sources.corpus import read_documents

# Added lines, own wording; one follows every third line of a document.
NOISE_LINES = [
    "Share this story",
    "Related articles from our archive",
    "Photo: a quiet harbour in the morning",
    "Home | World | Sport | Weather",
    "Privacy policy · Terms of service · Contact us",
    "Copyright 2024 Bloomberg. All rights reserved.",
    "Additional reporting by the night desk",
    "Print Email Share",
    "About the author:",
    "Sponsored",
    "Facebook Twitter",
    "help center privacy terms",
    "Dow Jones weekly letter",
    "The New Harbour Plan:",
    "the plan was agreed, and the town (which had waited for it) was glad",
    "A long walk along the river showed that the bridge was safe, dry and well kept",
    "A long walk along the river showed that the bridge was safe, dry and well kept by the town.",
    "Menu",
    "x marks the spot",
    "The council met in the new-",
    "Copyright 2023 Dow Jones & Company, Inc. All Rights Reserved aaaabbbbccccdddd00001111 The mayor said, after the vote, that work would start soon.",
    "Washington Post: The mayor spoke about the bridge",
    "The mayor spoke about the old bridge and its long repair Copyright © 2024 Acme. All rights reserved.",
    "The mayor spoke about the old bridge - Associated Press",
    "bloomberg",
    "Illustration by a friend",
    "Follow on any channel",
    "Site index",
    "Latest news",
    "deadbeefdeadbeefdeadbeef all rights reserved",
]


def noise_at(index: Column, lines=NOISE_LINES) -> Column:
    return F.element_at(strings(lines), (index % len(lines) + 1).cast("int"))


def noisy_text(doc_id: Column, text: Column) -> Column:
    """Text with an added line after every line whose (doc_id + position) is a multiple of 3."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda line, i: F.when(
            (doc_id + i) % 3 == 0,
            F.concat(line, F.lit("\n"), noise_at(doc_id * 7 + i)),
        ).otherwise(line),
    )
    return F.array_join(lines, "\n")


def noisy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return docs.withColumn("text", noisy_text(F.col("doc_id"), F.col("text")))


def noisy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title, blocks): the first line is also the document title."""
    docs = noisy_documents(spark, sf_dir)
    return line_blocks(docs).select(
        "doc_id",
        "source",
        F.coalesce(F.try_element_at("blocks.text", F.lit(1)), F.lit("")).alias("title"),
        "blocks",
    )


def wrapped_text(text: Column) -> Column:
    """Hard-wrapped variant: sentence ends close a paragraph, some words break at line ends."""
    t = F.regexp_replace(text, r"([.!?])\n", "$1\n \n")
    t = F.replace(t, F.lit("ing "), F.lit("ing-\n"))
    t = F.replace(t, F.lit(" and "), F.lit(" and/ \n"))
    return F.replace(t, F.lit(" de "), F.lit(" de\r\n"))


def given_title(doc_id: Column, text: Column, source: Column) -> Column:
    """No title, the first line, or the source name, by doc_id."""
    return (
        F.when(doc_id % 3 == 0, F.lit(None).cast("string"))
        .when(doc_id % 3 == 1, F.substring_index(text, "\n", 1))
        .otherwise(source)
    )


# ----- pages ------------------------------------------------------------------------------
# The given pages have few kinds of markup; by page_id these parts are put around and into them.
SHARE_BAR = '<div class="share-bar"><a href="#">Share</a> <a href="/mail">Email</a></div>'
RELATED = (
    '<div class="relatedStories"><p>A second story that has nothing to do with this page, told at length.</p></div>'
)
EXTRA = (
    "<h2>What happened next:</h2><p>See <a href=\"report.html?x=1\">the full report</a> , which the council of the"
    " town had asked for, and the long reply.</p><blockquote><p>We asked for a bridge that would last, and we were"
    " given one.</p></blockquote><ul><li>The first point was about the price of the stone, which had risen.</li>"
    "<li>Short</li></ul><div>The plan is now before the council, and a vote is due in the spring of the year."
    "</div><p class=\"promo\">Sign up for our weekly letter and never miss a story from the town again.</p>"
    "<div class=\"links\"><a href=\"/a\">One link with words</a> <a href=\"//cdn.example.com/b\">Another link</a></div>"
    "<h3>Related reading</h3><p>Photo: the old bridge</p>"
)
HEAD_META = (
    '<meta property="og:title" content="The Bridge &amp; The Town"><meta name="author" content="Jane Field">'
    '<meta property="article:published_time" content="2024-03-02T10:00:00Z">'
    '<meta name="description" content="How a town of three thousand people paid for a new bridge.">'
)
BYLINE = '<span class="byline">By Sam Hill and Kim Lake</span><time>2 March</time>'
CHALLENGE = "<title>Checking your browser before access</title>"
TAGS = r"<[^>]*>"


def page_words(html: Column) -> Column:
    """Words of the page inside its paragraphs, fit for a JSON string."""
    body = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<title.*?</title>", "")
    body = F.replace(body, F.lit("<p>"), F.lit("\\n\\n"))
    body = F.regexp_replace(F.regexp_replace(body, TAGS, " "), r"""[\n\t\r"]""", " ")
    return body


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.sources.corpus import read_pages

    p, h = F.col("page_id"), F.col("html")

    def put(where, before, after, text, cond):
        # one reference to html, so later filters do not multiply the chain of steps
        new = F.concat(F.lit(before), text, F.lit(after))
        return F.replace(F.col("html"), F.lit(where), F.when(cond, new).otherwise(F.lit(where)))

    df = read_pages(spark, sf_dir).withColumn("plain", page_words(h))
    steps = [
        put("</h1>", "</h1>" + BYLINE + SHARE_BAR, "", F.lit(""), p % 3 == 0),
        put("</article>", EXTRA + RELATED, "</article>", F.lit(""), p % 2 == 0),
        put("<article>", '<main class="post-content"><article>', "", F.lit(""), p % 5 == 1),
        put("</article>", "</article>", "</main>", F.lit(""), p % 5 == 1),
        put("<article>", '<div class="entry-body">', "", F.lit(""), p % 5 == 2),
        put("</article>", "</div>", "", F.lit(""), p % 5 == 2),
        put("<article>", '<article class="available-content"><div class="body markup">', "", F.lit(""), p % 11 == 3),
        put("</head>", HEAD_META, "</head>", F.lit(""), p % 4 == 1),
        put(
            "</head>", '<script type="application/ld+json">{"@type":"Article","articleBody":"', '"}</script></head>',
            F.col("plain"), p % 4 == 2,
        ),
        put(
            "</head>", '<script>var d={"body_html" : "<p>', '<\\/p>"};</script></head>',
            F.replace(F.col("plain"), F.lit("\\n\\n"), F.lit("</p><p>")), p % 4 == 3,
        ),
        put("</head>", CHALLENGE, "</head>", F.lit(""), p % 10 == 7),
    ]
    for step in steps:
        df = df.withColumn("html", step)
    return df.drop("plain")


# ----- documents with headings, citations and abbreviations --------------------------------
LINE_TAILS = [
    "", " As shown [12, 13].", " (Smith et al., 2019).", " Dr. Hall met the U.S. team, e.g. in May.",
    " See (see Jones 2001; Lee 2003) for more¹².", " It cost (12) or (3, 4) in 2004 (about 1990).",
    " Visit https://example.org/a_b?x=1), or example.com/news.", " Mr. A. B. Cole, Ph.D. said so [a] [3b].",
]


def cited_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line blocks with a tail after each line, a heading before every fifth, references in every fourth document."""
    doc = F.col("doc_id")
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            F.when(i % 5 == 0, F.concat(F.lit("Part "), (i / 5 + 1).cast("int").cast("string"), F.lit("\n"))).otherwise(""),
            line,
            noise_at(doc + i, LINE_TAILS),
        ),
    )
    refs = F.when(doc % 4 == 0, "\n6. References\nSmith, J. 2001. A book.\nConclusion\nLast words.").otherwise(
        "\nConclusion and outlook\nFirst words.\nLast words."
    )
    docs = read_documents(spark, sf_dir).withColumn("text", F.concat(F.array_join(lines, "\n"), refs))
    return line_blocks(docs).select(
        "doc_id", "source", F.concat(F.lit("Report "), doc.cast("string")).alias("title"), "blocks"
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading positions from events: (event_id, user_id, doc_id, block, offset, k)."""
    from leafmill.sources.corpus import read_table

    k = F.get_json_object("props", "$.k").cast("int")
    return (
        read_table(spark, sf_dir, "events")
        .withColumn("k", k)
        .select(
            "event_id",
            "user_id",
            F.floor(F.col("event_id") / 10).cast("long").alias("doc_id"),
            (F.col("k") % 10).alias("block"),
            (F.floor("value") % 200).cast("int").alias("offset"),
            "k",
        )
    )


# ----- paged documents ----------------------------------------------------------------------
FRONT_LINES = [
    "Journal of Harbour Studies 12",
    "Bridges and Towns in the North",
    "Jane Field, Sam Hill and Kim Lake",
    "Department of Rivers, Harbour University",
    "Abstract",
    "We show that the bridge was safe and that the town could pay for it over many years.",
]
PAGE_TAILS = [
    "Journal of Harbour Studies 12",
    "3 JANE FIELD AND SAM HILL",
    "1 Supplementary note with the data is available at the town hall of Harbour.",
    "Page 3 of 9",
    "arXiv:2401.01234v2 [cs.CL] 12 Jan 2024",
    "Figure 2: The bridge seen from the north side of the river.",
    "12 14 15.5 17% 0.0 18 21 22 23.1 24 25 26 total",
    "user: how long is the bridge",
    "the inter-",
    "(and so on",
    "17",
    "con­tent with the well‐",
]


def paged_text(doc: Column, text: Column) -> Column:
    """Front lines on every third document, a tail line after every fourth line."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda line, i: F.when(
            i % 4 == 3, F.concat(line, F.lit("\n"), noise_at(doc + (i / 4).cast("int"), PAGE_TAILS))
        ).otherwise(line),
    )
    front = F.when(doc % 3 == 0, F.lit("\n".join(FRONT_LINES) + "\n")).otherwise("")
    return F.concat(front, F.array_join(lines, "\n"))


def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, text, given_title)."""
    docs = read_documents(spark, sf_dir)
    given = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(".pdf"))).otherwise(
        F.concat(F.lit("A short note from "), F.col("source"))
    )
    return docs.select(
        "doc_id", "source", paged_text(F.col("doc_id"), F.col("text")).alias("text"), given.alias("given_title")
    )


PAGE_SIZE = 8


# ----- clean-up ------------------------------------------------------------------------------
def model_rewrite(p: Column, rule: Column) -> Column:
    """A deterministic stand-in for a model, by rule number."""
    n = F.length(p)
    return (
        F.when(rule == 1, F.regexp_replace(p, r"\s+", "  "))
        .when(rule == 2, F.substr(p, F.lit(1), n - F.floor(n / 3).cast("int")))
        .when(rule == 3, F.regexp_replace(p, r"\s*\[[^\]]*\]", ""))
        .when(rule == 4, F.regexp_replace(p, r"^([^\p{Lu}]*)\p{Lu}\S*\s*", "$1"))
        .when(rule == 5, F.lit("<DROP_PARAGRAPH>"))
        .when(rule == 6, F.concat(F.lit("- "), p))
        .otherwise(p)
    )


def model_paragraphs(doc: Column, chunk: Column, paras: Column) -> Column:
    """Rule by chunk and position; some chunks repeat a neighbour or lose a paragraph."""
    c = (doc * 5 + chunk) % 11
    plain = F.transform(
        paras, lambda p, i: model_rewrite(p, F.when(c < 5, 0).otherwise((doc + chunk + i) % 7))
    )
    return F.when((c == 3) & (F.size(paras) > 1), F.slice(plain, F.lit(1), F.size(paras) - 1)).when(
        (c == 4) & (F.size(paras) > 1), F.transform(paras, lambda p: F.element_at(paras, 1))
    ).otherwise(plain)
