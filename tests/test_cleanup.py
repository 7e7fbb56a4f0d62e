from pyspark.sql import functions as F

from leafmill.operators import cleanup as C
from leafmill.sources import store
from tests.helpers import blocks_frame, lit_array, one

LONG = "The council of the town agreed on Monday that the old bridge would be repaired. " * 6


def reason(spark, before, after, profile=C.WEB):
    df = spark.createDataFrame([(before, after)], "paras array<string>, cleaned array<string>")
    return df.select(C.rejection_reason(profile).alias("r")).first()["r"]


def chunks(spark, items, profile=C.WEB):
    return C.cleanup_chunks(blocks_frame(spark, items), profile).orderBy("chunk").collect()


def test_packing_closes_at_other_blocks(spark):
    p = "A paragraph that is long enough to be taken."
    got = chunks(spark, [("Heading", "H"), ("Paragraph", p), ("Paragraph", p), ("Paragraph", p), ("Metadata", "m"), ("Paragraph", p)])
    assert [r["idx"] for r in got] == [[1, 2, 3], [5]]
    assert all(r["before"] is None and r["after"] is None for r in got)


def test_packing_by_length_gives_context(spark):
    got = chunks(spark, [("Paragraph", LONG)] * 4)
    assert [r["idx"] for r in got] == [[0, 1], [2, 3]]
    assert got[0]["after"] == LONG.strip() and got[1]["before"] == LONG.strip()


def test_validator_reasons(spark):
    a = "The mayor Jane Field said the bridge costs 300 euro and opens in spring."
    b = "Workers will start on Monday after the long holiday weekend is over."
    assert reason(spark, [a, b], [a]) == "paragraph_count_mismatch"
    assert reason(spark, [a, b], []) == "empty_output"
    assert reason(spark, [a, "Share this page"], [a, C.DROP]) is None
    assert reason(spark, [a, "Share this page"], [a, C.DROP], C.PDF) == "paragraph_drop_not_allowed"
    # two of three names and numbers gone from the whole text, then one name gone from a longer list
    assert reason(spark, [a], [a.replace("Jane Field ", "")]) == "important_token_loss"
    names = "In May the mayor Jane Field met Sam Hill and Kim Lake of Harbour to plan the work."
    assert reason(spark, [names], [names.replace("Lake ", "")]) == "paragraph_token_loss"
    assert reason(spark, [b], ["Workers on Monday seldom notice anything truly important anyway, nobody does."]) == "paragraph_content_loss"
    assert reason(spark, [a], ["- " + a]) == "suspicious_formatting"
    assert reason(spark, [a, b], [a, b]) is None


def test_citations_may_go_from_paged_text(spark):
    assert reason(spark, ["It held well for many years [12, 13] in the har- bour."], ["It held well for many years in the harbour."], C.PDF) is None


def test_copy_of_the_neighbour_is_caught(spark):
    a = "green fields surround every village along northern rivers today"
    b = "green fields surround every village along southern roads always"
    assert one(spark, C.duplicated(lit_array([a, b]), lit_array([a, a])))
    assert not one(spark, C.duplicated(lit_array([a, a]), lit_array([a, a])))


def test_change_kinds(spark):
    kinds = lambda a, b: one(spark, C.change_kinds(F.lit(a), F.lit(b), C.PDF))
    assert kinds("a  longer text here", "a longer text here") == ["whitespace_cleanup"]
    assert "dehyphenation" in kinds("the har- bour was full", "the harbour was full")
    assert "citation_cleanup" in kinds("the bridge held [3]", "the bridge held")
    assert kinds("anything", " ") == ["paragraph_drop"]


def test_external_model_failure_is_a_row(spark):
    def model(paras, before, after, profile):
        raise RuntimeError("no  memory") from OSError("disk")

    rows = C.cleanup_chunks(blocks_frame(spark, [("Paragraph", LONG)]), C.WEB)
    row = C.validated(C.run_cleaner(rows, model, pandas=True), C.WEB).first()
    assert row["failure"] == "RuntimeError: no memory | caused by OSError: disk"
    assert row["reason"] == "model_failure"


def test_response_split(spark):
    split = lambda t, n: one(spark, C.split_response(F.lit(t), F.lit(n)))
    assert split(f"```a b{C.BREAK}c```", 2) == ["a b", "c"]
    assert split("a\n\nb", 2) == ["a", "b"]
    assert split("a", 2) == []


def test_ranked_counts(spark):
    rows = spark.createDataFrame([("b",)] * 3 + [("a",)] * 3 + [("c",)], "k string")
    assert [tuple(r) for r in C.ranked_counts(rows, "k").collect()] == [("a", 3), ("b", 3), ("c", 1)]


def test_lists_agree_with_the_check():
    from leafmill.checks import cleanup as checks

    assert C.IGNORED_PROTECTED == checks.IGNORED_PROTECTED and len(C.IGNORED_PROTECTED) == 84
    assert C.IGNORED_IMPORTANT == checks.IGNORED_IMPORTANT


def test_interface_words_may_be_lost_and_names_may_not(spark):
    body = "In May the mayor Jane Field met Sam Hill and Kim Lake of Harbour to plan the work on the old bridge. "

    def reason(tail):
        before, after = F.array(F.lit(body + tail)), F.array(F.lit(body.strip()))
        return one(spark, C.rejection_reason(C.WEB, before, after))

    for word in ("Share", "Photo", "Newsletter", "Credit", "Subscribe", "Read", "Latest"):
        assert reason(word) is None
    assert reason("Kowalski") == "paragraph_token_loss"


def test_tokens_after_the_sixty_fourth_count(spark):
    names = " ".join(f"Name{chr(65 + i // 26)}{chr(97 + i % 26)}" for i in range(100))
    assert len(one(spark, C.protected_tokens(F.lit(names)))) == 100


def test_run_reports_survive_json_and_parquet(spark, tmp_path):
    a, b = "The old bridge would be re- paired in spring.", "Workers start on Monday."
    rows = [
        (1, 1, [4], [b], [b], "ctx", None, "token_loss", None),
        (1, 0, [0, 2], [a, "Share this page"], [a.replace("re- paired", "repaired"), C.DROP], None, b, None, None),
        (2, 0, [1], [b], [], None, None, "model_failure", "TimeoutError"),
        (3, 0, [1], [b], [b], None, None, None, None),
    ]
    schema = "doc_id long, chunk int, idx array<int>, paras array<string>, cleaned array<string>, before string, after string, reason string, failure string"
    runs = C.run_reports(spark.createDataFrame(rows, schema).repartition(3), C.WEB, "m", 2)
    lines = runs.select("doc_id", store.to_json_line(F.struct("diagnostics")).alias("line"))
    back = lines.select("doc_id", store.from_json_line("line").getField("diagnostics").alias("d"))
    back.write.parquet(str(tmp_path / "runs"))
    got = {r.doc_id: r.d for r in spark.read.parquet(str(tmp_path / "runs")).collect()}
    assert [(c.status, c.firstBlockIndex, c.lastBlockIndex, c.cleanedChars is None) for c in got[1].chunkReports] == [
        ("AcceptedChanged", 0, 2, False), ("Rejected", 4, 4, True)
    ]
    first = got[1].chunkReports[0]
    assert [(p.blockIndex, p.afterText) for p in first.paragraphReports] == [(0, a.replace("re- paired", "repaired")), (2, "")]
    assert "dehyphenation" in first.paragraphReports[0].changeKinds and first.paragraphReports[0].beforeText == a
    assert (first.contextBeforeChars, first.contextAfterChars, first.droppedParagraphs) == (0, len(b), 1)
    assert (got[1].acceptedChunks, got[1].rejectedChunks, got[1].changedParagraphs, got[1].promptVersion) == (1, 1, 2, 2)
    assert [tuple(c) for c in got[1].rejectionReasonCounts] == [("token_loss", 1)]
    assert got[2].chunkReports[0].failureSummary == "TimeoutError" and got[2].eligibleCharsAfter == len(b)
    assert got[3].chunkReports[0].status == "AcceptedUnchanged" and got[3].changeKindCounts == []
    # an older record: fields are missing or blank
    old = '{"diagnostics": {"modelId": "m", "changeKindCounts": [{"key": " "}, {"key": "k"}], "chunkReports": [{"rejectionReason": "", "paragraphReports": [{}]}]}}'
    d = spark.range(1).select(store.from_json_line(F.lit(old)).getField("diagnostics").alias("d")).first().d
    assert [tuple(c) for c in d.changeKindCounts] == [("k", 0)] and d.chunkReports[0].status == "AcceptedUnchanged"
    assert d.chunkReports[0].rejectionReason is None and d.chunkReports[0].paragraphReports[0].changeKinds == []
    assert spark.range(1).select(store.from_json_line(F.lit('{"title": "x"}')).getField("diagnostics").alias("d")).first().d is None


def test_diffs_validate_once(spark, tmp_path):
    from leafmill.plans.cleanup import diffs

    docs = [(i, "\n".join([LONG.strip() + f" It cost {i} euro."] * 3), "en", "town") for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = diffs(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # the branches read the result of the validation: the tokens it needs are not looked for in any of them
    assert C.IMPORTANT not in plan
    assert {r["profile"] for r in df.collect()} == {"WEB", "PDF"}


def test_tokens_are_looked_for_once_a_text(spark):
    df = spark.createDataFrame([(["a"], ["b"])], "paras array<string>, cleaned array<string>")
    plan = df.select(C.rejection_reason(C.WEB).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    # before and after, of the whole text and of a paragraph
    assert plan.count(C.IMPORTANT) == 4


def test_unchanged_text_has_lost_nothing(spark):
    same = "The mayor Jane Field met Sam Hill in May and paid 300 euro for the bridge of the town."
    assert reason(spark, [same, same], [same, same]) is None
    assert reason(spark, [same, ""], [same, ""]) == "blank_paragraph"


def _documents(spark, folder, n=6):
    docs = [(i, "\n".join([LONG.strip() + f" It cost {i} euro."] * 3), "en", "town") for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_reasons_are_computed_once_for_their_counts(spark, tmp_path):
    from leafmill.plans.cleanup import rejection_counts, validation

    sf = _documents(spark, tmp_path, 40)
    df = rejection_counts(spark, sf)
    # one validation of each profile; a filter on the reason would be pushed down and judge each chunk a second time
    assert df._jdf.queryExecution().optimizedPlan().toString().count("paragraph_count_mismatch") == 2
    want = {r["reason"]: r["count"] for r in validation(spark, sf).filter("reason is not null").groupBy("reason").count().collect()}
    assert want and {r["reason"]: r["n"] for r in df.collect()} == want


def test_run_records_are_parsed_once(spark, tmp_path):
    from leafmill.plans.cleanup import run_reports

    df = run_reports(spark, _documents(spark, tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2  # one of each profile
    assert df.count() == 12


def test_pairs_behind_the_first_fault_are_not_judged_and_same_texts_once(spark):
    rows = spark.createDataFrame([(["a b", LONG], ["a b", LONG])], "paras array<string>, cleaned array<string>")
    plan = rows.select(C.rejection_reason(C.PDF).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    # a fold that stops takes the place of a list of all answers
    assert "element_at(filter(transform(arrays_zip" not in plan
    same = "The bridge held [3] in May, as Jane Field had said, and the town of Harbour was glad."
    pair = one(spark, C.validation_pair(F.lit(same), F.lit(same), C.PDF))
    assert pair["a"] == pair["b"] and "[3]" not in pair["a"]


def test_tokens_are_those_of_all_runs(spark):
    texts = ["12Ab 1a2B AB ab Ab_c A Bc's 3,4 5. NATO-style O'Neil x-Ray McDonald 7% Émile Abé 2024", "", None, "'-A-'", "1a NASA1 Ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.array_distinct(
        F.filter(F.regexp_extract_all("t", F.lit(C.WORD_RUN), F.lit(0)), lambda t: (F.length(t) >= 2) & t.rlike(C.IMPORTANT) & ~F.lower(t).isin(C.IGNORED_IMPORTANT))
    )
    assert df.filter(~C.important_tokens("t").eqNullSafe(old)).collect() == []
    bare = F.transform(F.regexp_extract_all("t", F.lit(C.NAME_RUN), F.lit(0)), lambda t: F.regexp_replace(t, r"^['’.\-]+|['’.\-]+$", ""))
    names = F.array_distinct(F.filter(bare, lambda t: (F.length(t) >= 3) & t.rlike(C.PROTECTED) & ~F.lower(t).isin(C.IGNORED_PROTECTED)))
    assert df.filter(~C.protected_tokens("t").eqNullSafe(names)).collect() == []
    # runs without a capital are not taken out of the text
    assert C.CAPITAL_RUN in df.select(C.protected_tokens("t").alias("p"))._jdf.queryExecution().optimizedPlan().toString()
