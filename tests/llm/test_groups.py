"""Joins, archives and decontamination against brute force."""

import gzip
import hashlib
import io
import random
import re
from collections import Counter, defaultdict

import pytest

from leafmill.checks.compare import compare, duck
from leafmill.llm import ngram_join as N
from leafmill.llm import queries as Q
from leafmill.llm.common import hot_join
from leafmill.llm.decontamination import decontaminate, templates
from leafmill.llm.graph import components
from leafmill.llm.ngram_join import ngram_join
from leafmill.llm.warc import BadArchive, members, parse, read_archives, read_warc, record, write_archives

# -- operator 6 --


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        met = Counter(j for g in s for j in where[g])
        for g in s:
            where[g].append(k)
        for j, n in met.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                up[root(k)] = root(j)
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        low[root(k)] += [i] if i is not None else []
    return sorted(((i, len(sets[k]), min(low[root(k)], default=None)) for k, (i, _) in enumerate(rows)), key=str)


def near_copies(seed, groups=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([2, 4, 5, 6, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 3 % 997, rng.choice(["%s", "%s ", "\t%s", "%s\n"]) % " ".join(copy)))
    return rows


def joined(df):
    return sorted((tuple(r)[:3] for r in ngram_join(df).collect()), key=str)


def test_components_equal_brute_force(spark, monkeypatch):
    rows = near_copies(5) + [(1, None), (2, ""), (3, "  \n"), (None, "alone with a null id"), (7, "É é x y z"), (8, "é É x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    expected = brute_components(rows)
    assert joined(df) == expected
    # small chunks, so that most links lie between chunks
    monkeypatch.setattr(N, "CHUNK_SETS", 3)
    assert joined(df) == expected


def test_components_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert joined(docs) == brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_meeting_finds_every_link():
    import numpy as np

    rows = near_copies(11, 12)
    sets = N.shingle_sets([t.encode() for _, t in rows])
    exact = [shingles(t) for _, t in rows]
    assert [len(s) for s in sets] == [len(s) for s in exact]
    keys = [bytes([i]) * 16 for i in range(len(sets))]
    sizes = np.array([len(s) for s in sets])
    count = Counter(t for s in sets for t in s.tolist())
    ordered = [np.array(sorted(s.tolist(), key=lambda t: (count[t], t)), np.uint64) for s in sets]
    links = N.meet((keys, sizes, ordered), None, 80)
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        up[root(a)] = root(b)
    for i, a in enumerate(exact):
        for j in range(i):
            if 100 * len(a & exact[j]) >= 80 * len(a | exact[j]):
                assert root(keys[i]) == root(keys[j])


def test_join_of_an_empty_table(spark):
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string, component_id int")).count() == 0


def test_star_rounds(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    hubs = [(5, i) for i in range(1000, 3000)] + [(2, i) for i in range(3000, 3500)] + [(2, 1000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(hubs, "a long, b long")).collect()}
    assert got == {i: 2 for i in (2, 5, *range(1000, 3500))}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_of_hot_keys(spark, how):
    rows = spark.createDataFrame([(1, i) for i in range(900)] + [(i, i) for i in range(2, 300)] + [(None, 0)], "k long, v long")
    facts = spark.createDataFrame([(1, "a", 900)] + [(i, "b", 1) for i in range(2, 200)], "k long, f string, n long")
    got = sorted((tuple(r) for r in hot_join(rows, facts, "k", "n", how).select("k", "v", "f").collect()), key=str)
    assert got == sorted((tuple(r) for r in rows.join(facts, "k", how).select("k", "v", "f").collect()), key=str)
    assert hot_join(rows, facts.limit(0), "k", "n", how).count() == (1199 if how == "left" else 0)


# -- operator 1 --

ITEM = "Yesterday evening Natalia sold 48 clips to her friends in April, and then Natalia sold half as many clips in May."


def test_slots_must_be_filled_consistently(spark):
    other = ITEM.replace("Natalia", "Betty").replace("48", "61").replace("April", "June")
    docs = [
        (10, "Noise before. " + other + " more noise"),
        (11, other.replace("then Betty", "then Anna")),
        (12, ITEM),
        (12, ITEM),
        (13, None),
        (14, ""),
        (15, ITEM.upper().replace("NATALIA", "x")[:30]),
        (None, "nothing of it here at all, to be seen by anyone"),
        (16, "word " * 30_000 + ITEM),
    ]
    items = [(1, ITEM), (2, "short"), (3, None), (4, "")]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate(df, benchmark).collect()}
    assert got == {(10, 1): "reparameterised", (12, 1): "copy", (16, 1): "copy"}
    blocks = {(r.doc_id, r.item_id): r.kind for r in decontaminate(df, benchmark, block=3).collect()}
    assert blocks == got
    assert decontaminate(df, benchmark.filter("item_id = 3")).count() == 0
    assert decontaminate(df.filter("doc_id < 0"), benchmark).count() == 0


def found_pairs(spark, docs, items):
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.kind for r in decontaminate(df, benchmark).collect()}


def test_short_items_and_items_of_numbers_and_names_are_found(spark):
    items = [
        (1, "What is 12 + 7 * 3 - 4?"),
        (2, "2 4 8 16 32 64 128 256 512 1024"),
        (3, "Alice, Bob, Carol, Dave, Erin, Frank, Grace, Heidi, Ivan, Judy"),
        (4, "Capital of Peru?"),
    ]
    docs = [(10 * i, f"some words stand in front of {t} and others follow it") for i, t in items]
    docs += [(5, "What is 12 + 7 * 3 - 5?"), (6, "2 4 8 15 32 64 127 256 511 1024"), (7, "Alice met Bob and Carol"), (8, "Capital of Chile?")]
    assert found_pairs(spark, docs, items) == {(10 * i, i): "copy" for i, _ in items}


def test_templates_tolerate_a_coincidence(spark):
    first = "a farmer sells 3 eggs and buys 4 hens before noon while his brother sells 6 ducks and keeps 9 geese"
    second = "a box has 2 red balls and the bag has 2 blue balls so we count"
    third = "Tom has 5 apples. Ann has 7 pears."
    items = [(1, first), (2, second), (3, third)]
    docs = [
        (10, first.replace("3", "5").replace("4", "5").replace("6", "8").replace("9", "7")),
        (20, second.replace("2 blue", "5 blue")),
        (30, "Joe has 8 apples. Eve has 2 pears."),
        (31, "Then Joe has 8 apples. Eve has 2 pears."),
        (40, "Joe sees 8 apples. Eve has 2 dogs."),
    ]
    expected = {(10, 1): "reparameterised", (20, 2): "reparameterised", (30, 3): "reparameterised", (31, 3): "reparameterised"}
    assert found_pairs(spark, docs, items) == expected


def test_template_tokens():
    owner, _, kind, _ = templates(["We met Tom Smith at 3,000 km. Tom ran two miles with Élise and ANNA", "", "x"])
    assert kind.tolist() == [0, 0, 2, 0, 1, 3, 0, 0, 1, 3, 0, 2, 0, 0, 0] and owner.tolist() == [0] * 14 + [2]


def test_planted_items_are_found(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    plain = lambda s: " " + " ".join(re.findall(r"\w+", (s or "").lower())) + " "
    texts = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    expected = {(d, r.item_id) for r in items.collect() for d, t in texts if plain(r.text) in t}
    assert {(r.doc_id, r.item_id) for r in decontaminate(docs, items).collect()} == expected


# -- operator 10 --


def test_archives_equal_their_sql(spark, sf_dir):
    con = duck(sf_dir)
    ok, message = compare(Q.op10_warc(spark, sf_dir), con, Q.CHECKS["op10_warc"])
    assert ok, message


def test_records_survive_the_round_trip(spark):
    same = "é" * 60
    rows = [(5, "http://a/ü\r\nX: y", same), (3, None, same), (9, "b", same), (9, "b", same), (1, "c", "short"), (2, "c", "short"),
            (4, "d", None), (7, "e", ""), (8, "f", "x" * 3_000_000), (None, "g", same), (6, "h", "a\r\n\r\nb" * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = read_archives(write_archives(pages, archive_bytes=500)).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    by = {r.page_id: r for r in got}
    for page_id, url, html in rows:
        r, raw = by[page_id], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(raw), hashlib.sha256(raw).hexdigest(), url)
        expected = 3 if page_id in (5, 9) else None
        assert r.refers_to == expected and r.record_type == ("revisit" if expected else "response")
        if not expected:
            assert bytes(r.payload) == raw
    assert write_archives(pages.filter("page_id < 0")).count() == 0


def test_each_record_is_a_member_and_damage_is_seen(spark, tmp_path):
    digest = hashlib.sha256(b"hello").hexdigest()
    data = record("response", 1, "http://a", b"hello", digest) + record("revisit", 2, "http://b", b"hello", digest, 1)
    assert len(list(members(data))) == 2
    assert gzip.GzipFile(fileobj=io.BytesIO(data)).read().count(b"WARC/1.1") == 2
    first = next(members(data))
    assert parse(first)["intact"] and not parse(first.replace(b"hello", b"hallo"))["intact"]
    with pytest.raises(BadArchive):
        list(members(data[:-5]))
    with pytest.raises(BadArchive):
        parse(first[:-12])
    (tmp_path / "a.warc.gz").write_bytes(data)
    rows = read_warc(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in rows] == [(1, "response", 5, None), (2, "revisit", 5, 1)]


def test_records_of_other_writers(spark, tmp_path):
    import base64
    import gzip
    import hashlib

    def member(fields, block):
        head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
        return gzip.compress(b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n")

    block = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>hello</p>"
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    named = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>"), ("WARC-Target-URI", "http://e.org/a")]
    data = member([("WARC-Type", "warcinfo")], b"software: other\r\n")
    data += member([*named, ("WARC-Block-Digest", sha1(block)), ("WARC-Payload-Digest", sha1(b"<p>hello</p>"))], block)
    data += member([*named, ("WARC-Payload-Digest", sha1(b"else"))], block) + member(named, block) + member([("WARC-Type", "request"), named[1]], b"GET / HTTP/1.1\r\n\r\n")
    (tmp_path / "b.warc.gz").write_bytes(data)
    rows = read_warc(spark, str(tmp_path)).collect()
    assert [r.intact for r in rows] == [True, False, None]
    assert {(r.page_id, r.record_id, r.url, bytes(r.payload), r.payload_bytes) for r in rows} == {
        (None, "urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0", "http://e.org/a", b"<p>hello</p>", 12)
    }
