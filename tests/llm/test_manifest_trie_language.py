"""Language profiles, Merkle manifest and prefix trie against plain versions of the same rules."""

import hashlib
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from leafmill.llm import language_id as L
from leafmill.llm.common import held_out
from leafmill.llm.merkle import FIELDS, merkle_manifest, merkle_report, merkle_sql
from leafmill.llm.ordering import crc32_sql, ranked
from leafmill.llm.prefix_trie import prefix_trie, trie_sql

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, pos int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# -- places in an order --


def test_places_of_a_hot_group_and_equal_rows(spark):
    rows = [("hot", i % 7) for i in range(300)] + [("cold", 5), ("cold", None), ("alone", 1)]
    got = ranked(spark.createDataFrame(rows, "g string, v int").repartition(5), "g", ["v"], "test").collect()
    for group in ("hot", "cold", "alone"):
        mine = sorted((r.pos, r.v is not None, r.v or 0) for r in got if r.g == group)
        assert [p for p, *_ in mine] == list(range(len(mine)))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        assert {r.n for r in got if r.g == group} == {len(mine)}


def test_crc32_sql():
    for text in ("0", "77", "-12", "9007199254740993"):
        assert duckdb.sql(f"SELECT {crc32_sql(repr(text))}").fetchall()[0][0] == zlib.crc32(text.encode())


# -- operator 12 --


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, **changed):
    return h(*[field(changed.get(f, row[f])) for f in FIELDS])


def plain_manifest(rows):
    """Report of each row as a multiset, by rebuilding all levels in memory."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def path(tree, at):
        steps = []
        for level in tree[:-1]:
            low = at // 3 * 3
            steps.append((level[low:at], level[at + 1 : low + 3]))
            at //= 3
        return steps

    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in sources[s]]) for s in names]
    upper = levels([t[-1][0] for t in trees])
    out = Counter()
    for k, s in enumerate(names):
        for at, r in enumerate(sources[s]):
            steps = path(trees[k], at) + path(upper, k)
            changed = r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            node = leaf(r, text=r["text"].replace("\n", "")) if changed else leaf(r)
            for before, after in steps:
                node = h(*before, node, *after)
            proof = h(*[x for b, a in steps for x in b + a])
            root = upper[-1][0]
            out[(r["doc_id"], leaf(r), trees[k][-1][0], root, proof, node, node == root)] += 1
    return out


def awkward_documents():
    rows = [dict(doc_id=i, source=f"s{i % 2}", lang="en", n_chars=i, text=f"line {i}\nend") for i in range(23)]
    rows += [dict(rows[3]), dict(rows[3]), rows[4] | {"text": "another"}]
    rows += [dict(doc_id=None, source=None, lang=None, n_chars=None, text=None), dict(doc_id=None, source="s0", lang="é", n_chars=-1, text="")]
    rows += [dict(doc_id=50, source="", lang="", n_chars=0, text="x\n" * 50_000), dict(doc_id=51, source="日本", lang="ja", n_chars=2, text="日\n本")]
    rows += [dict(doc_id=-(2**60), source="lone", lang="en", n_chars=1, text="a")]
    return rows


def test_manifest_equals_rebuilt_levels(spark):
    rows = awkward_documents()
    frame = spark.createDataFrame([(*(r[f] for f in FIELDS), "x", "y", 1) for r in rows], DOCS).repartition(4)
    got = Counter(tuple(r) for r in merkle_report(frame).collect())
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle_report(empty).collect() == []
    one = spark.createDataFrame([(1, "s", "en", 1, "a", "", "", 0)], DOCS)
    (row,) = merkle_report(one).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == h()


def test_other_fanouts_verify_too(spark):
    frame = spark.createDataFrame([(*(r[f] for f in FIELDS), "x", "y", 1) for r in awkward_documents()], DOCS)
    for fanout in (2, 5):
        rows = merkle_manifest(frame, fanout).collect()
        for r in rows:
            node = bytes(r.leaf).hex()
            for step in r.path:
                node = h(bytes(step.before).hex(), node, bytes(step.after).hex())
            assert node == bytes(r.root).hex()


def test_manifest_sql(spark, sf_dir):
    from leafmill.checks.compare import compare, duck

    ok, said = compare(merkle_report(spark.read.parquet(f"{sf_dir}/documents.parquet")), duck(sf_dir), merkle_sql())
    assert ok, said


# -- operator 13 --


def plain_trie(rows):
    """Nodes by walking every prefix."""
    given = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            given[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in given.items()}
    built = {}
    for c, own in turns.items():
        k = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - int(np.fmod(c, 100)), [])[:k] + own[k:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    out = []
    for key, cs in members.items():
        under = [k for k in members if k[: len(key)] == key]
        ends = h(",".join(str(c) for c in sorted(cs) if len(built[c]) == len(key)))
        spare = sum((len(members[k]) - 1) * len(k[-1][1]) for k in under if k)
        parent = min(members[key[:-1]]) if key else None
        out.append((min(cs), len(key), parent, len(cs), children[key], sum(not children[k] for k in under), spare, ends))
    return Counter(out)


TURNS = "conv_id long, turn long, role string, text string, depth int, block int"


def awkward_conversations():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 3} of {c // 4 if t > 3 else 0}") for c in range(0, 24) for t in range(c % 9)]
    rows += [(500 + c, t, "user", f"of the head {t}") for c in (0, 3, 7, 8) for t in range(7)]
    rows += [(901, 0, "user", "no family"), (902, 0, "user", "no family"), (-105, 1, "user", "negative"), (-100, 1, "a", "b"), (-100, None, None, None)]
    rows += [(None, 0, "user", "nobody"), (700, None, None, "null turn"), (700, 1, "x", None), (700, 1, "x", "tie"), (700, 1, "x", "tie")]
    rows += [(c, t, "user", "x" * t) for c in (1000, 1001) for t in range(50)] + [(1002, 0, "r", "long " * 20_000)]
    return rows


@pytest.mark.parametrize("width", [3, 8])
def test_trie_equals_all_prefixes(spark, width):
    rows = awkward_conversations()
    # the order of equal turns is that of their ids, which is no order of texts: give ties one text
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows if r[3] is not None or r[0] != 700], TURNS).repartition(4)
    kept = [r for r in rows if r[3] is not None or r[0] != 700]
    assert Counter(tuple(r) for r in prefix_trie(frame, width).collect()) == plain_trie(kept)


def test_trie_of_nothing_and_of_a_turnless_conversation(spark):
    assert prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    # 1 takes h turns of an absent family and has none left
    assert zlib.crc32(b"1") % 6 >= 1
    (root,) = prefix_trie(spark.createDataFrame([(1, 0, "user", "gone", 0, 0)], TURNS)).collect()
    assert tuple(root) == (1, 0, None, 1, 0, 1, 0, h("1"))


def test_many_ends_are_joined_in_order(spark):
    ids = [c for c in range(1, 6000) if zlib.crc32(str(c).encode()) % 6 == 0]
    frame = spark.createDataFrame([(c, 0, "user", "same", 0, 0) for c in ids], TURNS).repartition(7)
    got = {r.depth: r for r in prefix_trie(frame).collect()}
    assert got[1].ends_sha256 == h(",".join(map(str, ids))) and got[1].n_convs == len(ids)
    assert got[1].saved_tokens == 4 * (len(ids) - 1) == got[0].saved_tokens


def test_trie_sql(spark, sf_dir):
    from leafmill.checks.compare import compare, duck

    ok, said = compare(prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")), duck(sf_dir), trie_sql())
    assert ok, said


# -- operator 11 --


def plain_grams(text):
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split()
    return Counter(
        g for w in words for n in L.SIZES for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) != " "
    )


def hashed(gram):
    value = np.ones(1, np.uint64)
    for c in gram:
        value = L.blended(value, np.full(1, 0 if c == " " else ord(c), np.uint64))
    return int(value[0] >> np.uint64(64 - L.BITS))


def top(counts):
    return {g: i for i, (g, _) in enumerate(sorted(((hashed(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))[: L.RANKS])}


ODD_TEXTS = ["", "a", "The cat, the dog!? and -- the\nbird.", "日本語のテキスト 123", "éÉ ße İstanbul ΣΑΣ", "12 3 !!", "x" * 3000, "ab " * 2000, "été"]


def test_grams_equal_the_plain_count(monkeypatch):
    for step in (7, 1_000_000):
        monkeypatch.setattr(L, "STEP", step)
        keys, counts = L.gram_counts(*L.words_of(ODD_TEXTS))
        for i, text in enumerate(ODD_TEXTS):
            mine = (keys >> np.uint64(L.BITS)) == i
            got = dict(zip((keys[mine] & np.uint64((1 << L.BITS) - 1)).tolist(), counts[mine].tolist(), strict=True))
            assert got == {hashed(g): n for g, n in plain_grams(text).items()}, text


def test_predictions_equal_the_plain_distance(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", held_out("doc_id").alias("out")).collect()
    totals, seen = defaultdict(Counter), Counter()
    for r in rows:
        if not r.out and r.lang is not None and r.doc_id is not None:
            totals[r.lang] += plain_grams(r.text or "")
            seen[r.lang] += 1
    profiles = {lang: top(c) for lang, c in totals.items()}
    names = sorted(seen, key=lambda x: (-seen[x], x))
    got = {r.doc_id: r for r in L.identify(docs, L.learn_profiles(docs)).collect()}
    right = 0
    for r in rows:
        mine = top(plain_grams(r.text or ""))
        distance = [sum(abs(k - profiles[n][g]) if g in profiles[n] else L.RANKS for g, k in mine.items()) for n in names]
        assert got[r.doc_id].lang_pred == names[distance.index(min(distance))]
        right += got[r.doc_id].lang_pred == r.lang
    assert right > 0.97 * len(rows)


def test_awkward_language_rows(spark):
    schema = "doc_id long, text string, lang string, score string, gram int"
    learn = [(i, t, lang, "s", 1) for i in range(1, 40) for t, lang in ((f"the cat and the dog number{i}", "en"), ("der Hund und die Katze", "de"))]
    odd = [(900, None, "en", None, None), (901, "12 ?!", None, None, None), (None, "the dog", "en", None, None), (902, "the dog and the cat", None, None, None)]
    odd += [(902, "the dog and the cat", None, None, None), (903, "жук", "ru", None, None), (904, "der und die " * 100_000, None, None, None), (905, "", "de", None, None)]
    docs = spark.createDataFrame(learn + odd, schema).repartition(3)
    got = [tuple(r) for r in L.identify(docs.filter("doc_id >= 900 OR doc_id IS NULL"), L.learn_profiles(docs)).collect()]
    named = Counter((i, p) for i, p, _ in got)
    assert named[(900, "und")] == named[(901, "und")] == named[(905, "und")] == 1
    assert named[(902, "en")] == 2 and named[(None, "en")] == 1 and named[(904, "de")] == 1
    assert all(0 <= s <= 1 for *_, s in got) and all(s == 0 for _, p, s in got if p == "und")
    empty = spark.createDataFrame([], schema)
    assert L.identify(empty, L.learn_profiles(docs)).collect() == []
    assert {r.lang_pred for r in L.identify(docs, L.learn_profiles(empty)).collect()} == {"und"}


def test_held_out_rows_are_never_learned(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(i, "abc def", "xx") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert L.learn_profiles(spark.createDataFrame(rows, schema)).languages == []
