"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import html as H
from leafmill.operators import web as W
from leafmill.operators.blocks import explode_rows
from leafmill.plans.inputs import rich_pages
from leafmill.sources import corpus


def live_text(spark, sf):
    tokens = H.html_tokens(rich_pages(spark, sf))
    pieces = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    return tokens.groupBy("page_id").agg(
        F.trim(F.array_join(F.transform(pieces, lambda t: t.piece), "")).alias("text")
    )


def tag_events(spark, sf):
    return H.html_tokens(rich_pages(spark, sf)).select(
        "page_id", "pos", "kind", "tag", "level", "end_pos", "depth", "parent", "live", "quote", "piece"
    )


def _elements(df, column, *fields):
    picked = F.transform(column, lambda e: F.struct(*[e[f].alias(f) for f in fields]))
    return explode_rows(df, picked, "page_id")


def noisy_containers(spark, sf):
    df = H.page_elements(rich_pages(spark, sf))
    return _elements(
        df.withColumn("noisy", F.filter("els", W.noisy_container)), "noisy", "open", "end", "tag", "marker"
    )


def pruned_elements(spark, sf):
    return _elements(W.prepare(rich_pages(spark, sf)), "pruned", "open", "end", "tag", "raw_len", "raw_link")


def container_scores(spark, sf):
    df = W.prepare(rich_pages(spark, sf))
    rows = F.transform(
        F.filter("els2", lambda e: e.tag.isin(W.CANDIDATE_TAGS)),
        lambda e: F.struct(
            e.open.alias("open"),
            e.tag.alias("tag"),
            e.n_p.alias("n_p"),
            e.n_h.alias("n_h"),
            e.n_li.alias("n_li"),
            W.text_len(e).alias("n_chars"),
            F.round(W.container_score(e), 4).alias("score"),
        ),
    )
    return explode_rows(df, rows, "page_id")


def container_choice(spark, sf):
    df = W.candidates(W.prepare(rich_pages(spark, sf)))
    rows = F.transform(
        "chosen",
        lambda c, i: F.struct(
            (i + 1).cast("int").alias("choice"), c.open.alias("open"), c.tag.alias("tag"), c.n.alias("n_chars"),
            F.round(-c.neg_score, 4).alias("score"),
        ),
    )
    return explode_rows(df, rows, "page_id")


def container_block_rows(spark, sf):
    df = W.candidates(W.prepare(rich_pages(spark, sf)))
    return explode_rows(df, W.container_blocks(F.col("chosen")[0]), "page_id")


def inline_ui(spark, sf):
    df = H.page_elements(rich_pages(spark, sf))
    df = df.withColumn("noisy", W.outermost(F.filter("els", W.noisy_container)))
    df = df.withColumn("els2", W.without("els", "noisy")).withColumn("txt2", W.mute("txt", "noisy"))
    df = df.withColumn("ui", F.filter("els2", lambda e: W.inline_ui(e, "txt2")))
    return _elements(df, "ui", "open", "end", "tag")


def links(spark, sf):
    return W.page_links(rich_pages(spark, sf))


def titles(spark, sf):
    return rich_pages(spark, sf).select("page_id", W.page_title("html", "url").alias("title"))


def metadata(spark, sf):
    df = rich_pages(spark, sf).withColumn("title", W.page_title("html", "url"))
    return df.select("page_id", F.posexplode(W.page_metadata("html", "title")).alias("pos", "text"))


def json_ld(spark, sf):
    df = rich_pages(spark, sf).withColumn("body", W.json_ld_body("html"))
    blocks = F.when(F.col("body").isNotNull(), W.structured_blocks("body"))
    return explode_rows(df, blocks, "page_id")


def embedded_body(spark, sf):
    pages = rich_pages(spark, sf).withColumn("html", W.embedded_body_html("html"))
    df = W.prepare(pages.filter(F.col("html").isNotNull()))
    df = df.withColumn("body", F.try_element_at(F.filter("els2", lambda e: e.tag == "body"), F.lit(1)))
    return explode_rows(df, W.container_blocks(F.col("body"), prune=False), "page_id")


def site_rules(spark, sf):
    df = W.prepare(rich_pages(spark, sf)).withColumn("site", W.site_rule_blocks())
    return explode_rows(df, F.when(W.usable_site_set(F.col("site")), F.col("site")), "page_id")


def title_anchored(spark, sf):
    df = W.prepare(rich_pages(spark, sf).withColumn("title", W.page_title("html", "url")), "url", "title")
    return explode_rows(df, W.title_anchored_blocks("title", "url"), "page_id")


def strategy_scores(spark, sf):
    df = W.strategies(rich_pages(spark, sf))
    rows = F.transform(
        "sets",
        lambda s: F.struct(
            s["name"].alias("strategy"), s.score.alias("score"), F.size(s.blocks).alias("n_blocks"),
            W.block_chars(s.blocks).alias("n_chars"),
        ),
    )
    return explode_rows(df, rows, "page_id")


def strategy_choice(spark, sf):
    df = W.choose(W.strategies(rich_pages(spark, sf)))
    return df.select("page_id", "strategy", F.size("picked").alias("n_blocks"))


def sentence_fallback(spark, sf):
    df = W.extract_pages(rich_pages(spark, sf))
    return explode_rows(df, F.when(F.col("fallback"), F.col("blocks")), "page_id")


def challenge_pages(spark, sf):
    return rich_pages(spark, sf).select("page_id", W.is_challenge("html").cast("int").alias("is_challenge"))


def page_documents(spark, sf):
    pages = rich_pages(spark, sf)
    df = W.extract_pages(pages.filter(~W.is_challenge("html")))
    return df.select(
        "page_id",
        "title",
        F.array_join("metadata", "|").alias("metadata"),
        "strategy",
        "n_paragraphs",
        "n_headings",
        "n_chars",
        F.array_join(F.transform("blocks", lambda b: b.text), "|").alias("body"),
    )


def extraction_report(spark, sf):
    df = W.extract_pages(rich_pages(spark, sf))
    return df.select(
        "page_id",
        F.array_join(
            F.transform("ranked", lambda c: F.concat_ws(":", c.tag, c.open, c.n)), " "
        ).alias("candidates"),
        F.array_join(
            F.transform(
                F.array_sort(
                    F.transform(
                        F.filter("sets", lambda s: s.score.isNotNull()),
                        lambda s: F.struct((-s.score).alias("o"), s.rank.alias("rank"), s["name"].alias("name")),
                    )
                ),
                lambda s: s["name"],
            ),
            " ",
        ).alias("strategies"),
        "strategy",
        F.col("fallback").cast("int").alias("fallback"),
        F.size("raw_blocks").alias("n_raw"),
        F.size("blocks").alias("n_final"),
    )


def page_scan(spark, sf):
    return corpus.read_pages(spark, sf).select(
        "page_id", "url", corpus.title_from_url("url").alias("title"), F.length("html").alias("n_chars")
    )


QUERIES = {
    "s01_page_scan": page_scan,
    "w01_live_text": live_text,
    "w02_tag_events": tag_events,
    "w03_noisy_containers": noisy_containers,
    "w04_pruned_elements": pruned_elements,
    "w05_container_scores": container_scores,
    "w06_container_choice": container_choice,
    "w07_container_blocks": container_block_rows,
    "w08_inline_ui": inline_ui,
    "w09_links": links,
    "w10_titles": titles,
    "w11_metadata": metadata,
    "w12_json_ld": json_ld,
    "w13_embedded_body": embedded_body,
    "w14_site_rules": site_rules,
    "w15_title_anchored": title_anchored,
    "w16_strategy_scores": strategy_scores,
    "w17_strategy_choice": strategy_choice,
    "w18_sentence_fallback": sentence_fallback,
    "w19_challenge_pages": challenge_pages,
    "w20_page_documents": page_documents,
    "s10_extraction_report": extraction_report,
}
