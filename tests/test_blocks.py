from pyspark.sql import functions as F

from leafmill.functions import plain
from leafmill.operators import blocks as K
from tests.helpers import blocks_frame, one, texts

BODY = "The council agreed on Monday that the bridge would be repaired before the winter, at last."


def clean(spark, items, title="A Title", metadata=None):
    df = blocks_frame(spark, items, title, metadata)
    return texts(K.clean_blocks(df, metadata=F.col("metadata")))


def test_leading_title_and_byline_go(spark):
    got = clean(
        spark,
        [("Heading", "A Title"), ("Paragraph", "By Jane Field"), ("Paragraph", BODY),
         ("Heading", "Related articles"), ("Paragraph", "More from our archive of towns")],
        metadata=["By Jane Field"],
    )
    assert got == [BODY]


def test_sentence_cut_in_two_is_joined(spark):
    got = clean(spark, [("Paragraph", "The bridge was closed because the"), ("Paragraph", "river had risen in the night.")])
    assert got == ["The bridge was closed because the river had risen in the night."]


def test_hyphen_at_the_cut_is_dropped(spark):
    got = clean(spark, [("Paragraph", "The bridge was recon-"), ("Paragraph", "structed in the spring of that year.")])
    assert got == ["The bridge was reconstructed in the spring of that year."]


def test_buttons_credits_and_acknowledgements_go(spark):
    got = clean(
        spark,
        [("Paragraph", "Open in app"), ("Paragraph", "Photo: the river at night"), ("Paragraph", BODY),
         ("Paragraph", "Additional reporting by the night desk"), ("Paragraph", "Edited by a colleague")],
    )
    assert got == [BODY]


def test_longer_version_replaces_the_previous_block(spark):
    longer = BODY + " The vote was close."
    assert clean(spark, [("Paragraph", BODY), ("Paragraph", longer)]) == [longer]


def test_social_nav_and_site_lines_go(spark):
    got = clean(
        spark,
        [("Paragraph", "Facebook Twitter Email"), ("Heading", "Comments"), ("Paragraph", "Home | World | Sport"),
         ("Paragraph", "Privacy policy Terms of service"), ("Paragraph", BODY)],
    )
    assert got == [BODY]


def test_cleanup_is_idempotent(spark):
    items = [("Heading", "First part:"), ("Paragraph", BODY), ("Paragraph", BODY), ("Paragraph", "Share this")]
    once = K.clean_blocks(blocks_frame(spark, items))
    twice = K.clean_blocks(once)
    assert texts(once) == texts(twice) == ["First part", BODY]


def test_exact_duplicates_keep_the_first_and_the_order(spark):
    df = blocks_frame(spark, [("Paragraph", "b two"), ("Paragraph", "a one"), ("Paragraph", "B two!"), ("Paragraph", "…")])
    assert texts(K.drop_exact_duplicates(df)) == ["b two", "a one"]


def test_plain_paragraphs_join_lines(spark):
    text = "First line of-\nfered text and/\nor more\n\n \n\nSecond  paragraph ."
    assert one(spark, plain.paragraphs(F.lit(text))) == ["First line offered text and/or more", "Second paragraph."]


def test_plain_peel_without_any_text(spark):
    df = spark.createDataFrame([(1, "", None)], "doc_id long, text string, given_title string")
    row = K.peel_plain_text(df).first()
    assert row["title"] == "Captured text" and [b["text"] for b in row["blocks"]] == ["Captured text"]


def test_leading_repeats_end_at_the_first_other_block(spark):
    items = [("Heading", "A Title"), ("Paragraph", "a title!"), ("Paragraph", BODY), ("Paragraph", "A Title")]
    df = blocks_frame(spark, items).withColumn("blocks", K.drop_leading("blocks", "title"))
    assert texts(df) == [BODY, "A Title"]
    # keys are made until then only, not as a list of all blocks
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position(" not in plan
    only = blocks_frame(spark, items[:2]).withColumn("blocks", K.drop_leading("blocks", "title"))
    assert texts(only) == []
    none = blocks_frame(spark, items).withColumn("blocks", K.drop_leading("blocks", F.lit(None).cast("string")))
    assert len(texts(none)) == 4


def test_lower_case_of_a_block_is_made_once_for_all_rules(spark):
    from leafmill.functions import boilerplate as B

    long = "share this " + "and the town was glad of the bridge " * 20
    rows = ["Share Print Email", "Comments", BODY, "Copyright 2024 Dow Jones", "Menu | Home | Sport", "x", "", None, long, "Site index, privacy policy"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(B.is_boilerplate("t", F.lit(False))).collect()]
    assert got == [True, True, False, True, True, True, False, None, True, True]
    plan = df.select(B.is_boilerplate("t", F.lit(False)).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    # once for the rules, once for the tokens of the few blocks that have a listed word
    assert plan.count("lower(") == 2
