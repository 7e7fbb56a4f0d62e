"""Token counts, pieces, fingerprints, licences and page text against plain versions of the same rules."""

import hashlib
import itertools
import os
import random
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafmill.llm import pieces as P
from leafmill.llm import queries as Q
from leafmill.llm.fingerprints import (
    PrefixHash,
    code_points,
    common_extension,
    edited,
    fingerprint,
    fingerprints,
    likeness,
    same_span,
)
from leafmill.llm.html_text import joined_runs, main_text, trimmed_runs
from leafmill.llm.licences import KNOWN, license_scan, license_sql
from leafmill.llm.token_counts import merger, token_counts

BPE = public_tokenizers.path(Q.BYTE_BPE)
MODEL = public_tokenizers.path(Q.PIECES)
ODD = ["", " ", "a", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "a" * 5000, "ab" * 3000, "日本語" * 400, "\x00\x1c  ", "▁x ▁▁"]


def awkward(spark, texts):
    """Rows with a null text, repeated rows, a null id and an extra column."""
    rows = [(i, t, "ids") for i, t in enumerate(texts)] + [(0, texts[0], "ids"), (None, "no id", None), (900, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)


# -- operator 5 --


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80), max_size=8))
def test_counts_equal_the_library(texts):
    tokens = [len(e.ids) for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert merger(BPE).count(texts) == tokens


def test_counts_of_documents_and_odd_texts(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = docs.unionByName(awkward(spark, ODD).select("doc_id", "text"))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(both, BPE).collect())
    rows = [(r.doc_id, r.text or "") for r in both.collect()]
    tokens = [len(e.ids) for e in library.encode_batch([t for _, t in rows], add_special_tokens=False)]
    assert got == sorted((str(i), len(t.encode()), n) for (i, t), n in zip(rows, tokens, strict=True))


# -- operator 2 --


def test_pieces_without_dropout_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé ñ\n\t12²日😀<s>.,-_") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += [t for t in ODD if "▁" not in t]
    ids, counts = P.pieces(MODEL).encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == library.encode(text)
        at += n


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=5), st.integers(0, 2**40), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
def test_dropout_is_lossless_and_repeatable(texts, seed, dropout):
    table = P.pieces(MODEL)
    ids, counts = table.encode(texts, seed, dropout)
    assert table.decode(ids, counts) == texts
    alone = [table.encode([t], seed, dropout)[0].tolist() for t in texts]
    assert sum(alone, []) == ids.tolist()


def agenda(table, text, seed, rate):
    """The agenda of one text, written plainly: best candidate first, a skipped one never comes back."""
    import numpy as np
    import xxhash

    from leafmill.llm.common import U64, mix

    symbols = [(int(table.chars[ord(c)]), i, i + 1) for i, c in enumerate(" " + text)]
    key = mix(np.array([xxhash.xxh3_64_intdigest(text.encode(), seed)], U64))

    def rank(x, y):
        row = int(table.pairs.find(np.array([x[0] * table.size + y[0]]))[0]) if min(x[0], y[0]) >= 0 else -1
        place = np.array([(x[1] << 42) ^ (y[1] << 21) ^ y[2]], U64)
        skipped = int(mix(key ^ mix(place))[0]) < rate
        return None if row < 0 or skipped else (int(table.ranks[row]), x[1], int(table.made[row]))

    while True:
        found = [(rank(x, y), k) for k, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False))]
        found = [f for f in found if f[0]]
        if not found:
            return [s[0] for s in symbols]
        (_, _, made), k = min(found)
        symbols[k : k + 2] = [(made, symbols[k][1], symbols[k + 1][2])]


def test_dropout_follows_the_agenda(monkeypatch):
    table = P.pieces(MODEL)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdeth") for _ in range(rng.randint(1, 14))) for _ in range(6)) for _ in range(12)]
    for long in (P.LONG, 4):
        monkeypatch.setattr(P, "LONG", long)
        for rate in (0.1, 0.5):
            for text in texts:
                assert table.encode([text], 9, rate)[0].tolist() == agenda(table, text, 9, int(rate * 2**64))


def test_seeds_give_other_segmentations():
    text = ["a rather ordinary sentence about internationalisation and reconsideration " * 4]
    table = P.pieces(MODEL)
    made = {tuple(table.encode(text, seed, 0.2)[0].tolist()) for seed in range(5)}
    assert len(made) == 5


def test_piece_query_on_awkward_rows(spark):
    df = awkward(spark, ODD)
    rows = Q.piece_digest(df.select("doc_id", "text"), MODEL).collect()
    assert len(rows) == df.count() and all(r.lossless for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (0, 900)} == {0}
    with pytest.raises(ValueError):
        P.encode_pieces(df, MODEL, into="score")
    assert Q.piece_digest(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


# -- operator 8 --


def test_spans_and_extensions():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(2))
        x, y = PrefixHash(code_points(a)), PrefixHash(code_points(b))
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        assert common_extension(x, i, y, j) == len(os.path.commonprefix([a[i:], b[j:]]))
        n = rng.randint(0, 5)
        fits = i + n <= len(a) and j + n <= len(b)
        assert same_span(x, i, y, j, n) == (fits and a[i : i + n] == b[j : j + n])


def test_fingerprints_against_a_sorted_list(spark):
    rng = random.Random(1)
    rows = [(i * 7 % 1000 if i % 50 else None, "".join(rng.choice("ab cdé😀") for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(5, "x"), (5, "x"), (5, None), (6, "y" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ordered = sorted(((a, b or "") for a, b in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    expected = []
    for k, (doc_id, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        other = edited(text, following)
        a, b, c = fingerprint(text), fingerprint(other), fingerprint(following)
        digest = hashlib.sha256(other.encode()).hexdigest()
        expected.append((doc_id, len(text), digest, a, b, likeness(a, b), likeness(a, c), len(os.path.commonprefix([text, other]))))
    assert sorted(map(str, (tuple(r) for r in fingerprints(df).collect()))) == sorted(map(str, expected))
    for few in ([], [(1, "abcd")], [(None, None)]):
        assert fingerprints(spark.createDataFrame(few, "doc_id long, text string")).count() == len(few)


def test_likeness_tells_near_from_far(spark, sf_dir):
    rows = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    long = [r for r in rows if r.n_chars > 200]
    assert sum(r.near_edited for r in long) / len(long) > 0.4
    assert sum(r.near_next > 0.2 for r in long) / len(long) < 0.1


# -- operator 3 --


def test_licences_equal_their_sql(spark):
    rows = [
        (1, "Some text.\nLICENSED under the Apache Licence,  version 2.0!\nmore"),
        (2, KNOWN[-3][2].replace("<year> <holder>", "2020 Somebody Else").upper()),
        (3, "copyright 2001 me"),
        (4, None),
        (5, ""),
        (6, "Released under the MIT License"),
        (6, "Released under the MIT License"),
        (None, "All rights reserved"),
        (7, "Released under the MIT License, mostly"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in license_scan(docs).collect())))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(map(str, con.execute(license_sql()).fetchall()))
    found = {(r.doc_id, r.unit, r.license_id) for r in license_scan(docs).collect()}
    assert found >= {(1, "line", "Apache-2.0"), (2, "document", "MIT"), (6, "document", "MIT"), (None, "line", "proprietary")}
    assert not {i for i, _, _ in found} & {3, 4, 5, 7}


def test_full_texts_are_found_whole_and_inside_documents(spark):
    import textwrap

    from leafmill.llm.licences import full_texts

    full = full_texts()
    assert {i for i, _, _ in full} >= {"BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Apache-2.0", "CC0-1.0"}
    bodies = {i: t for i, _, t in reversed(full)}
    mit = [t for i, k, t in KNOWN if (i, k) == ("MIT", "text")][0]
    wrapped = {n: "\n\n".join(textwrap.fill(p, n) for p in mit.split("\n\n")) for n in range(40, 90)}
    rows = [(k, bodies[i]) for k, i in enumerate(sorted(bodies))]
    rows += [(100 + k, f"Some words before.\n\n{bodies[i]}\n\nand some after.") for k, i in enumerate(sorted(bodies))]
    rows += [(200 + n, t) for n, t in wrapped.items()]
    rows += [(300, "Copyright The Holder\n\n" + bodies["BSD-2-Clause"]), (301, bodies["GPL-3.0"][:20_000])]
    found = {(r.doc_id, r.unit, r.license_id) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, i in enumerate(sorted(bodies)):
        assert (k, "document", i) in found and (100 + k, "block", i) in found, i
    assert {d for d, unit, i in found if unit == "document" and i == "MIT" and d >= 200} == {200 + n for n in wrapped}
    assert (300, "document", "BSD-2-Clause") in found and not any(d == 301 for d, _, _ in found)


def test_licences_in_comments_and_runs_of_lines(spark):
    import textwrap

    mit = [t for i, k, t in KNOWN if (i, k) == ("MIT", "text")][0].replace("<year> <holder>", "2020 Me\nAll rights reserved.")
    lines = textwrap.fill(mit, 70, replace_whitespace=False).split("\n")
    rows = [(k, "int main;\n" + "\n".join((mark + x).rstrip() for x in lines) + "\nreturn 0;") for k, mark in enumerate(("# ", " * ", "// ", "-- ", ""))]
    rows += [(10, "before\n" + mit.replace("\n\n", "\n") + "\nafter"), (11, "x\nAll rights reserved.\ny"), (12, "Copyright 2020 Me\nAll rights reserved.\ntext")]
    rows += [(13, mit[:-20]), (14, "word " * 200_000 + "\nMIT License\n" * 50_000), (15, "Permission\nis\nhereby")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, row int")
    found = [(r.doc_id, r.unit, r.line_no, r.license_id) for r in license_scan(frame).collect()]
    assert sorted(f for f in found if f[0] < 10) == [(k, "block", None, "MIT") for k in range(5)]
    assert sorted(f for f in found if f[0] >= 10) == [(10, "block", None, "MIT"), (11, "line", 2, "proprietary")]
    assert license_scan(frame.limit(0)).collect() == []
    own = spark.createDataFrame([("own", "text", "two words"), ("none", "text", "!!"), ("null", "text", None)], "license_id string, kind string, text string")
    mine = spark.createDataFrame([(1, "TWO\n# words\n"), (2, "a\ntwo words")], "doc_id long, text string")
    assert sorted((r.doc_id, r.unit, r.license_id) for r in license_scan(mine, own).collect()) == [(1, "document", "own"), (2, "line", "own")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in rows if r[0] != 14])
    names = ["doc_id", "unit", "line_no", "license_id", "kind", "digest"]
    got = sorted(map(str, (tuple(r[n] for n in names) for r in license_scan(frame).collect())))
    assert got == sorted(map(str, con.execute(license_sql()).fetchall()))


# -- operator 4 --

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div id=cookie-notice>We use cookies <button>ok</button></div><aside><p>Side text that is long enough to be seen as a text</p></aside>
<main><article><header><h2>Title &amp; more</h2></header><p>First  para<p>Second para with <b>bold</b> words,
to be long enough for a text.<br>And on.<div class="ad-slot">Buy now, a very good offer for all of you</div><ul><li>one<li>two</ul>
<form><label>Name</label><input></form><script>var a = "</p>"</script><!-- no --><p>&lt;end&gt;&nbsp;</p></article>
<section id=comments><h3>Comments</h3><article><p>A reader said something long, much longer than all of the article above it, again and again and again.
</p></article></section></main><footer>&copy; foot</footer></body></html>"""


def test_article_without_what_stands_around_it():
    assert main_text(PAGE).split("\n\n") == [
        "Title & more", "First para", "Second para with bold words, to be long enough for a text. And on.", "one", "two", "<end>"
    ]


def test_pages_without_an_article_element():
    text = "A sentence of the article that has quite a few words in it. " * 5
    rows = "".join(f"<div class=item><a href=/{i}>Link {i}</a></div>" for i in range(30))
    page = f"<body><div class=links>{rows}</div><div class=story><p>{text}</p><p>Short.</p><p>{text}</p></div><div>{rows}</div></body>"
    assert main_text(page) == "\n\n".join([text.strip(), "Short.", text.strip()])
    assert [main_text(x) for x in ("", "plain", "<p></p>", "<nav>only a menu</nav>")] == ["", "plain", "", ""]
    assert main_text("<div>" * 3000 + "deep") == "deep"


def test_no_name_silences_the_article():
    text = "A sentence of the article that has quite a few words in it. " * 5
    body = f"<h1>Title</h1><p>{text}</p><p>Short.</p>"
    whole = "\n\n".join(["Title", text.strip(), "Short."])
    for around in ("div class='layout has-sidebar'", "div class=no-sidebar", "div id=page-with-comments", "article class='post sharing-enabled'",
                   "article class='post tag-social'", "div class='elementor-widget'", "form id=aspnetForm", "div class=widget><div class=sidebar"):
        tag = around.split()[0]
        ends = f"</{tag}>" * around.count("<div") + f"</{tag}>"
        assert main_text(f"<body><nav>Menu</nav><{around}>{body}<div class=sidebar>Other things</div>{ends}</body>") == whole, around
    assert main_text(f"<div class=widget><article>{body}</article></div><div class=sidebar>Other</div>") == whole
    assert main_text("".join(f"<div class=elementor-widget><p>{k} {text}</p></div>" for k in range(4))).count("A sentence") == 20
    remarks = "<div class=comment><p>A reader said something long, again and again.</p></div>" * 40
    assert main_text(f"<article>{body}<section id=comments>{remarks}</section></article>") == whole


def test_a_head_ends_where_the_body_begins():
    for page in ("<html><head><title>t</title><body><p>Some text</p></body>", "<head><meta charset=utf-8><title>t</title><p>Some text</p>",
                 "<html><head><title>t</title><noscript><link></noscript>Some text", "<head><noscript><body>Some text"):
        assert main_text(page) == "Some text", page
    assert main_text("<head><template><div>no</div></template></head><body>Some text") == "Some text"


def test_sections_beside_each_other_without_an_article():
    text = "A sentence of the article that has quite a few words in it. " * 8
    links = "<div class=links>" + "<div><a href=/>Link</a></div>" * 20 + "</div>"
    intro = "<div class=intro><h1>Title</h1><p>Lead</p></div>"
    end = "<div class=end><h2>Last part</h2><p>Few words.</p></div>"
    whole = ["Title", "Lead", text.strip(), "Last part", "Few words."]
    assert main_text(f"<div id=wrap>{intro}<div class=text>{text}</div></div>") == "\n\n".join(whole[:3])
    for before, after in (("", ""), (links, ""), ("", links), (links, links)):
        page = f"<body>{before}{intro}<div class=text><p>{text}</p></div>{end}{after}</body>"
        assert main_text(page).split("\n\n") == whole
        page = f"<body>{before}<div id=wrap>{intro}<div class=text><p>{text}</p></div>{end}</div>{after}</body>"
        assert main_text(page).split("\n\n") == whole
    part = "A sentence of a table of words. " * 5
    page = f"<div><div>{text * 4}</div><div>{part}</div><ul><li><a href=/>A source of it</a></ul><div>{text}</div></div>"
    assert main_text(page).split("\n\n") == [(text * 4).strip(), part.strip(), "A source of it", text.strip()]


def test_every_page_has_a_row(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "u", "<p>" + "x " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Q.extract_text(pages).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {r.n_chars for r in got if r.page_id in (2, None)} == {0}


def test_ids_decode_to_their_texts(spark):
    df = awkward(spark, ODD).select("doc_id", "text")
    rows = P.decode_pieces(P.encode_pieces(df, MODEL, 3, 0.3, decoded="again"), MODEL).collect()
    assert all(r.decoded == r.again == (r.text or "") for r in rows)
    none = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in P.decode_pieces(none, MODEL).collect()] == ["", ""]


# -- operator 4: names, clusters, depth --

LONG = "A sentence of the article that goes on for a while, so that its line has many characters. " * 3


@pytest.mark.parametrize(
    "part",
    [
        '<section id="related-work"><h2>Related work</h2><p>{0}</p></section>',
        '<section id="discussion"><h2>Discussion</h2><p>{0}</p></section>',
        '<section id="search-algorithms"><p>{0}</p></section>',
        '<h2 id="legal-notice">Legal notice</h2><p>{0}</p>',
        '<h2 id="comments">Comments</h2><p>{0}</p>',
        '<div class="section" id="legal"><p>{0}</p></div>',
    ],
)
def test_sections_named_after_their_headings_stay(part):
    text = main_text(f"<html><body><article><h1>Title</h1><p>{LONG}</p>{part.format('Words of the section.')}<p>End.</p></article></body></html>")
    assert text.startswith("Title\n\n") and "Words of the section." in text and text.endswith("\n\nEnd.")


def test_named_parts_of_an_article_go():
    for part in ('<section id="comments"><p>A remark.</p></section>', '<section id="related"><p>A remark.</p></section>',
                 '<p class="notice">A remark.</p>', '<h2 id="comments">Comments</h2><ol class="commentlist"><li>A remark.</li></ol>'):
        assert main_text(f"<article><h1>Title</h1><p>{LONG}</p>{part}</article>") == f"Title\n\n{LONG.strip()}"


def test_head_and_foot_lines_without_a_known_name_go():
    body = "".join(f"<p>{LONG}</p>" for _ in range(6))
    page = f'<body><div class="site-line"><b>The</b> <i>Site</i> <a href="/">Start</a> <a href="/n">News</a> <i>x</i></div><div><h1>Title</h1>{body}</div>' \
        '<div class="site-bottom"><span>(c)</span> <b>2024</b> <i>Site</i> Inc.</div></body>'
    text = main_text(page)
    assert text.startswith("Title\n\nA sentence") and "2024" not in text and text.count("goes on") == 18


def test_short_last_blocks_of_an_article_of_divs_stay():
    assert main_text(f"<body><div>{LONG}</div><div>{LONG}</div><div>The end.</div></body>").endswith("\n\nThe end.")


def test_runs_join_the_cluster():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 12)
        cluster, prose = (np.array([rng.random() < 0.4 for _ in range(n)]) for _ in range(2))
        expected = cluster.copy()
        while True:
            more = [k for k in range(n) if not expected[k] and prose[k] and any(0 <= j < n and expected[j] for j in (k - 1, k + 1))]
            if not more:
                break
            expected[more] = True
        assert (joined_runs(cluster, prose) == expected).all()
        runs = [list(g) for on, g in itertools.groupby(range(n), lambda k: cluster[k]) if on]
        inner = {k for run in runs for k in run if any(prose[j] for j in run if j <= k) and any(prose[j] for j in run if j >= k)}
        assert np.flatnonzero(trimmed_runs(cluster, prose)).tolist() == sorted(inner)


@pytest.mark.parametrize("tag", ["<div>", "<span>", '<div class="menu">', "<ul><li>", "<b><p>", "<section id='related'><h2>"])
def test_deep_pages_take_linear_time(tag):
    began = time.monotonic()
    main_text(tag * 50_000 + "text")
    assert time.monotonic() - began < 10
