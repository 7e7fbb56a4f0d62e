import pytest
from pyspark.sql import functions as F

from leafmill.operators import html as H
from leafmill.operators import web as W

P1 = "The council agreed on Monday that the old bridge would be repaired before the winter came."
P2 = "Work starts in the spring, and the town has set aside the money for it over three years."
P3 = "The engineers looked at every stone, wrote a long report, and found that most of it was sound."


def pages(spark, *htmls):
    rows = [(i, "https://example.org/news/bridge", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def extract(spark, html):
    row = W.extract_pages(pages(spark, html)).first()
    return row, [b["text"] for b in row["blocks"]]


def test_article_without_chrome(spark):
    html = (
        "<html><head><title>The Bridge</title><script>var x='</p><p>fake</p>';</script></head><body>"
        "<nav><a href='/'>Home</a></nav><!-- <div class='ad'>ad</div> --><article><h1>The Bridge</h1>"
        "<div class='share-bar'><a href='#'>Share</a> <a href='#'>Email</a></div>"
        f"<p>{P1}</p><div class='comments'><p>A comment that is long enough to be kept if it were not a comment.</p></div>"
        f"<p>{P2}</p><p>{P3}</p></article><footer><p>{P1} footer</p></footer></body></html>"
    )
    row, got = extract(spark, html)
    assert row["title"] == "The Bridge"
    assert got == [P1, P2, P3]


def test_inline_links_and_unclosed_tags_keep_their_text(spark):
    html = (
        f"<body><article><p>{P1} <a href='/r'>the report</a>, and <b>more<p>{P2}<p>{P3}</article></body>"
    )
    _, got = extract(spark, html)
    assert got[0].endswith("the report, and more") and got[1:] == [P2, P3]


def test_paragraph_like_divs(spark):
    html = f"<body><main><div>{P1}</div><div>{P2}</div><div><div>{P3}</div></div></main></body>"
    _, got = extract(spark, html)
    assert got == [P1, P2, P3]


def test_known_layout_short_circuits(spark):
    html = f"<body><article class='available-content'><div class='body markup'><p>{P1}</p><p>{P2}</p></div></article></body>"
    row, got = extract(spark, html)
    assert row["strategy"] == "site_rule" and got == [P1, P2]


def test_links_are_resolved(spark):
    html = "<body><p><a href='/a'>One</a> <a href='b'>Two</a> <a href='//c.org/x'>Three</a> <a href='/a'>One</a></p></body>"
    rows = {r["label"]: r["href"] for r in W.page_links(pages(spark, html)).collect()}
    assert rows == {"One": "https://example.org/a", "Two": "https://example.org/news/b", "Three": "https://c.org/x"}


def test_title_order_and_challenge(spark):
    df = pages(
        spark,
        "<meta content='From meta' property='og:title'><title>Other</title>",
        "<title> </title>",
        "<title>Checking your browser</title>",
    )
    rows = df.select(W.page_title("html", "url").alias("t"), W.is_challenge("html").alias("c")).collect()
    assert [r["t"] for r in rows] == ["From meta", "bridge", "Checking your browser"]
    assert [r["c"] for r in rows] == [False, False, True]


def test_one_exchange_for_the_whole_extraction(spark, sf_dir):
    from leafmill.plans import all_queries

    df = all_queries()["w07_container_blocks"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(page_id") == 1


def test_tasks_follow_the_markup(spark):
    few = spark.createDataFrame([(1, "<p>One</p>")], "page_id long, html string")
    assert H.page_tasks(few) == spark.sparkContext.defaultParallelism
    assert H.page_tasks(few.limit(0)) == spark.sparkContext.defaultParallelism
    many = spark.range(9).select(F.col("id").alias("page_id"), F.repeat(F.lit("x" * 1024), 2048).alias("html"))
    plan = H.raw_tokens(many)._jdf.queryExecution().optimizedPlan().toString()
    assert H.page_tasks(many) == 9 and "RepartitionByExpression [page_id" in plan and ", 9" in plan


@pytest.mark.parametrize("step", [W.strategies, W.prepare])
def test_tasks_grow_with_the_pages(spark, monkeypatch, step):
    """The first is the step of w16 and w17, the second that of w04 to w07."""
    monkeypatch.setattr(H, "TASK_BYTES", 8192)
    html = F.repeat(F.lit("<p>A sentence of a page.</p>"), F.col("id") % 2 * 16 + 32)
    tasks = []
    for n in (40, 160):
        some = spark.range(n).select(F.col("id").alias("page_id"), F.lit("https://example.com/a").alias("url"), html.alias("html"))
        node, dealt = step(some)._jdf.queryExecution().analyzed(), []
        while not node.children().isEmpty():
            if node.nodeName() == "RepartitionByExpression":
                dealt.append(node.optNumPartitions().get())
            node = node.children().head()
        # one exchange, whose partitions have a number and so are not merged later
        tasks += dealt
    assert tasks == [n * 40 * len("<p>A sentence of a page.</p>") // 8192 + 1 for n in (40, 160)]


def test_tokens_are_sorted_once_for_every_order(spark):
    pages = spark.createDataFrame([(1, "u", "<p>One</p>")], "page_id long, url string, html string")

    def sorts(df):
        return df._jdf.queryExecution().executedPlan().toString().count("- Sort [")

    assert sorts(H.html_tokens(pages.drop("url"))) == 5
    assert sorts(H.page_elements(pages.drop("url"))) == 5
    # the embedded body comes to its page in one order more
    assert sorts(W.strategies(pages).select("page_id", "sets")) == 6


def test_pieces_know_the_text_before_them(spark):
    html = "<div>One<b>two</b> <i>three&nbsp;</i><i>four</i><br>five<nav> no </nav>six<i></i>, seven<script>x</script>.</div>"
    rows = H.html_tokens(spark.createDataFrame([(1, html), (2, "a"), (2, None)], "page_id long, html string"))
    pieces = [r["piece"] for r in rows.filter("page_id = 1 and piece != ''").orderBy("pos").collect()]
    assert pieces == [" One", "two", " three", " four", " five", " six", ", seven."]
    assert [r["piece"] for r in rows.filter("page_id = 2 and piece != ''").collect()] == [" a"]
