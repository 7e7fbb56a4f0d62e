from pyspark.sql import functions as F

from leafmill.functions import paged as L
from leafmill.functions import text as T
from leafmill.operators import paged as P
from tests.helpers import lit_array, one

PROSE = "We measured the old bridge for two years and found that it moved less than anyone had feared before."
MORE = "The second winter was colder than the first, and the stones in the middle arch were the ones that moved."


def formatted(spark, pages, title="file.pdf"):
    df = spark.createDataFrame([(1, pages, title)], "doc_id long, pages array<array<string>>, given_title string")
    return P.format_pages(df).first()


def test_running_header_abstract_and_notes(spark):
    row = formatted(
        spark,
        [
            ["A Long Study of Old Bridges", "Jane Field, Sam Hill", "Harbour University", "Abstract", PROSE, "", "Journal of Bridges", "1. Results", MORE],
            ["Journal of Bridges", "Journal of Bridges", MORE + " Again.", "1 Supplementary data are available at the town hall."],
        ],
    )
    assert row["title"] == "A Long Study of Old Bridges"
    body = [b["text"] for b in row["body"]]
    assert "Journal of Bridges" not in body
    assert PROSE in [m["text"] for m in row["meta"]]
    assert row["notes"] == ["1 Supplementary data are available at the town hall."]


def test_page_tail_that_is_body_stays(spark):
    row = formatted(spark, [["Intro", PROSE, "", MORE]])
    assert row["notes"] == [] and row["body"][-1]["text"].endswith(MORE)


def test_artifacts_inside_words(spark):
    assert one(spark, L.repair(F.lit("brid­ge and sto•ne"))) == "bridge and stone"
    assert one(spark, L.repair(F.lit("the well‐"))) == "the well-"


def test_hyphen_rules(spark):
    join = lambda *x: one(spark, L.assemble(lit_array(x)))
    assert join("the recon-", "struction") == "the reconstruction"
    assert join("the inter-", "national") == "the inter-national"
    assert join("pages 12-", "14") == "pages 12-14"
    assert join("NATO-", "style") == "NATO-style"


def test_line_types(spark):
    assert one(spark, L.heading(F.lit("2.1 Methods And Data")))
    assert not one(spark, L.heading(F.lit("This ends like a sentence.")))
    assert one(spark, L.author_line(F.lit("Jane Field1, Sam Hill2 and Kim Lake")))
    assert one(spark, L.metadata(F.lit("Department of Rivers")))
    assert one(spark, L.tabular(F.lit("12 14 15.5 17% 18 19 20 21 22 23 24 25")))


def test_transcript_run_becomes_one_note(spark):
    blocks = F.array(*[P.block("Paragraph", F.lit(t)) for t in ["Before.", "user: how long", "assistant: very", "After it."]])
    got = one(spark, P.figure_runs(blocks))
    assert [k["text"] for k in got["kept"]] == ["Before.", "After it."]
    assert got["notes"] == ["user: how long assistant: very"]


def test_clean_candidate_scores_higher(spark):
    meta = F.array(P.block("Metadata", F.lit("Jane Field, Sam Hill")), P.block("Metadata", F.lit("Abstract")))
    good = F.array(P.block("Heading", F.lit("Results")), P.block("Paragraph", F.lit(PROSE)))
    bad = F.array(P.block("Paragraph", F.lit("12 JANE FIELD AND SAM HILL")), P.block("Paragraph", F.lit("re-peated and inter-rupted words")))
    empty = F.array().cast("array<string>")
    score = lambda m, b: one(spark, P.selection_score(m, b, empty))
    assert score(meta, good) > score(P.none(), bad)


def test_lists_of_a_document_are_made_once(spark):
    lines = ["Harbour Notes", "The harbour was quiet and the boats of the town were at rest for the night.", "1 " + "Word " * 3] * 3
    df = spark.createDataFrame([(1, [lines, lines, lines], "A Title")], "doc_id long, pages array<array<string>>, title string")
    done = P.clean_lines(df)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    # the argument is a bound variable, not the expression that makes the list
    assert "array_contains(lambda" in plan
    assert "array_contains(array_distinct" not in plan and "array_contains(concat" not in plan
    kept = [x["text"] for x in done.first()["lines"]]
    # on the first page the line is protected, as the leading lines are
    assert kept.count("Harbour Notes") == 3 and len(kept) > 3


def test_long_lines_are_no_author_lines_and_marks_do_not_count(spark):
    rows = ["Jane Field1, Sam Hill* and Kim Lake(3)", "Jane Field", "Jane Field, Sam Hill, " + "Kim Lake, " * 6, "", None, "Jane\tField,\nSam Hill"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = [r["x"] for r in df.select("i", L.author_line("t").alias("x")).orderBy("i").collect()]
    assert got == [True, False, False, False, False, True]
    plan = df.select(L.author_line("t").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("*†‡§∗]+, ") == 1


def test_prefixes_are_cut_only_in_front_of_capitals(spark):
    head = "Harbour University, Department of Rivers, Jane Field"
    body = "The town had paid for a bridge that would last and the people were glad of it."
    df = spark.createDataFrame([(f"{head} {body}",), (f"{head} - 12 {body}",), (f"{head} {body.lower()}",)], "t string")
    got = [r["x"] for r in df.select(L.split_prefix("t", F.lit("A Title")).alias("x")).collect()]
    assert got[0]["prefix"] == head and got[0]["body"] == body
    assert got[1] is not None and got[1]["body"].endswith(body)
    assert got[2]["prefix"].endswith("Jane") and got[2]["body"] == f"Field {body.lower()}"
    plan = df.select(L.split_prefix("t", F.lit("A Title")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "[^A-Za-z]*[a-z]" in plan


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_kind_of_a_title_line_is_asked_once(spark):
    pages = [["Journal of Harbour Studies 12", "Bridges and Towns", "of the Old North", "Jane Field, Sam Hill", "Abstract", PROSE]]
    df = spark.createDataFrame([(1, pages, "file.pdf")], "doc_id long, pages array<array<string>>, given_title string")
    done = df.select(P.infer_title("pages", "given_title").alias("t"))
    assert done.first()["t"] == "Bridges and Towns of the Old North"
    # the words of metadata: once for the run of title lines, once for the second try
    assert optimized(done).count("research group") == 2


def test_words_and_characters_are_counted_in_the_pattern(spark):
    rows = ["", " ", None, "a", " a b ", "A b\tc D", "é Éa -x 1a", "🙂 b", "one two three four five six"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    for n in (1, 2, 3, 6):
        for fast, slow in [
            (T.has_words("t", n), T.words("t") >= n),
            (T.has_words("t", n, r"\p{Ll}"), T.count_of("t", r"(?:^|\s)\p{Ll}") >= n),
            (T.has_chars("t", n, r"\p{L}", r"\P{L}"), T.count_of("t", r"\p{L}") >= n),
            (T.length_to("t", n) >= n, F.length("t") >= n),
        ]:
            assert df.filter(~fast.eqNullSafe(slow)).collect() == []
    # no list of words is made for a comparison
    assert "regexp_extract_all" not in optimized(df.select(L.prose("t"), L.running_candidate("t")))


def test_lines_without_odd_characters_are_not_rewritten(spark):
    rows = ["plain line", "café naïve", "a­b", "end‐ ", "\x01x", "b•c", "■", "x​y", None, ""]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(L.repair("t")).collect()]
    assert got == ["plain line", "café naïve", "ab", "end-", "x", "bc", "■", "xy", None, ""]
    assert "RLIKE" in optimized(df.select(L.repair("t")))


def test_notes_of_a_page_are_cut_once(spark):
    page = [PROSE, MORE, "", "1 Supplementary data are available at the town hall of Harbour."]
    df = spark.createDataFrame([(page,)], "page array<string>")
    done = df.select(P.page_parts(F.col("page")).alias("p"))
    assert done.first()["p"]["note"] == page[-1] and done.first()["p"]["lines"] == page[:-1]
    # the filter over the lines compares with a bound list
    assert "array_contains(CASE" not in optimized(done)
