"""The operators against brute-force versions, on small tables with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())


def docs_frame(spark, texts, langs=None, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def vocabulary(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


# --- the hashing kernel ---------------------------------------------------------------------------------------------


def test_kernel_words_are_those_of_the_pattern():
    from llm import kernel

    texts = ["Ab  cD\tef\nÄÖ", "", None, "x", "  ", "cd ab", "a\u00a0b a\x1fb"]
    for chunk in (1, 4, 1 << 20):
        got = []
        for w in kernel.words(pa.array(texts), chunk):
            got += [w.hashes[w.bounds[i] : w.bounds[i + 1]].tolist() for i in range(w.n_docs)]
        want = [kernel.hash_words(words(t)).tolist() if words(t) else [] for t in texts]
        assert got == want
    assert len({h for g in got for h in g}) == len({x for t in texts for x in words(t)})


def test_kernel_shingles():
    from llm import kernel

    texts = ["a b c d e f", "a b c", "", "A B C", "a b c d e", "x a b c d e"]
    sets = []
    for w in kernel.words(pa.array(texts)):
        s, b = kernel.shingles(w)
        sets += [set(s[b[i] : b[i + 1]].tolist()) for i in range(w.n_docs)]
    assert [len(x) for x in sets] == [2, 1, 0, 1, 1, 2]
    assert sets[1] == sets[3] and sets[4] < sets[0] and sets[4] < sets[5] and not sets[1] & sets[0]


# --- 7: Jaccard join ------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed, n_base=12, copies=6):
    r = random.Random(seed)
    v = vocabulary(60, seed)
    common = [" ".join(r.choice(v) for _ in range(r.randint(6, 30))) for _ in range(3)]
    texts = []
    for _ in range(n_base):
        base = [r.choice(v) for _ in range(r.choice([3, 6, 20, 60, 150]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                if w:
                    w[r.randrange(len(w))] = r.choice(v)
            if r.random() < 0.3:
                w += r.choice(common).split()
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("seed,limits", [(1, None), (2, (3, 256, 2)), (3, (4096, 16 << 20, 2))])
def test_jaccard_components(spark, monkeypatch, seed, limits):
    """Also with blocks of a few sets, and with hot keys joined in the sending task."""
    from llm import jaccard_join as j

    if limits:
        monkeypatch.setattr(j, "BLOCK", limits[0])
        monkeypatch.setattr(j, "BLOCK_BYTES", limits[1])
        monkeypatch.setattr(j, "HOT", limits[2])
    texts = near_copies(seed) + [None, "", " \n", "a b", "A  b", "one two three four five " * 3000]
    texts += texts[:5]
    d = docs_frame(spark, texts).withColumn("digest", F.lit(1)).withColumn("component", F.lit("x"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.jaccard_components(d).collect()}
    assert got == brute_components(list(enumerate(texts)))
    empty = j.jaccard_components(d.limit(0))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0


def test_tree_finds_all_connections():
    from llm.jaccard_join import tree_links

    r = np.random.default_rng(0)
    sets = []
    for _ in range(30):
        base = r.integers(0, 1 << 62, r.integers(1, 200)).astype(np.uint64)
        for _ in range(5):
            s = base.copy()
            s[: r.integers(0, len(s) // 4 + 1)] = r.integers(0, 1 << 62)
            sets.append(np.unique(s))
    links = tree_links(list(range(len(sets))), sets)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(b)] = root(a)
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                assert root(a) == root(b)


def test_components(spark):
    from llm.common import components

    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: root(x) for x in parent if any(root(y) == root(x) and y != x for y in parent)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    # chunks of a few edges (the tasks cut them), many partitions, nodes with very many edges above and below them
    hot = edges + [(7, 2000 + i) for i in range(300)] + [(9000, 3000 + i) for i in range(300)] + [(9000, 900)]
    want |= {7: root(7), 900: 900, 9000: 900} | {2000 + i: root(7) for i in range(300)} | {3000 + i: 900 for i in range(300)}
    for chunk, n in ((7, 1), (50, 40), (2, 2)):
        got = [(r["node"], r["component"]) for r in components(spark.createDataFrame(hot, "a long, b long").repartition(n), chunk).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_components_above_one_chunk(spark):
    from llm.common import components

    n = 700_000  # paths of three nodes, more edges in one task than it contracts at once
    e = spark.range(0, n, 1, 1).selectExpr("explode(array(struct(id as a, id + 1000000 as b), struct(id + 2000000 as a, id + 1000000 as b))) as e").select("e.*")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = components(e).selectExpr("count(*) as n", "count(distinct node) as nodes", "count_if(node % 1000000 <> component) as wrong").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert tuple(got) == (3 * n, 3 * n, 0)


def test_small_batches_give_the_settings_back(spark):
    from llm.common import BATCH, small_batches

    rows, size = BATCH
    spark.conf.set(rows, "77")
    before = spark.conf.get(size)
    try:
        with pytest.raises(ZeroDivisionError), small_batches(spark):
            assert {k: spark.conf.get(k) for k in BATCH} == BATCH
            raise ZeroDivisionError
        assert spark.conf.get(rows) == "77" and spark.conf.get(size) == before
    finally:
        spark.conf.unset(rows)


# --- 5: Merkle fingerprints -----------------------------------------------------------------------------------------


def brute_fingerprint(text):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    tree = [[[md5(leaf)[:8] for leaf in re.findall(r"[^\n]{1,48}", p)] for p in s.split("\n")] for s in re.split("\n\n+", text)]
    return brute_root(text) + ":" + ";".join(",".join("".join(p) for p in s) for s in tree), {x for s in tree for p in s for x in p}


def brute_root(text):
    """Full digests upward, with the newlines between sections."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out = ""
    for part in re.split("(\n\n+)", text):
        out += f"{len(part)}." if part.startswith("\n\n") else md5("".join(md5("".join(md5(x) for x in re.findall(r"[^\n]{1,48}", p))) for p in part.split("\n")))
    return hashlib.sha256(out.encode()).hexdigest()


def test_roots_separate_different_texts(spark):
    """Texts that differ in newlines alone, in one leaf or in the order of leaves; equal texts have equal roots."""
    from llm.merkle import fingerprints

    texts = ["\n" * n for n in range(6)] + [f"a{chr(10) * n}b" for n in range(6)] + ["\na\n\nb", "a\n\nb\n", "a\n\nb\n\n", "a\n\n\nb\n\nc", "a\n\nb\n\n\nc"]
    texts += ["x" * 48 + "y" * 48, "y" * 48 + "x" * 48, "x" * 47 + "y" * 48, "x" * 48 + "\n" + "y" * 48]
    d = docs_frame(spark, texts + texts)
    rows = fingerprints(d).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r["doc_id"] % len(texts)], set()).add(r["fingerprint"])
        assert r["root"] == brute_root(texts[r["doc_id"] % len(texts)])
    assert all(len(x) == 1 for x in by_text.values()) and len(set.union(*by_text.values())) == len(set(texts))


def test_fingerprints(spark):
    from llm.merkle import differing_branches, fingerprints

    r = random.Random(3)
    v = vocabulary(30)
    texts = [None, "", "a", "ab", "ä€😀" * 40, "x" * 30_000, "p one\np two\n\n\nsection two", "\n\n", "same", "same"]
    texts += ["\n".join(" ".join(r.choice(v) for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 6))) for _ in range(40)]
    d = docs_frame(spark, texts).withColumn("tree", F.lit(1)).withColumn("next_text", F.lit("x"))
    got = {r["doc_id"]: r for r in fingerprints(d).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""  # after the last (0): the first, which is the highest id
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        fp, leaves = brute_fingerprint(t)
        efp, eleaves = brute_fingerprint(edited)
        _, nleaves = brute_fingerprint(nxt)
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (fp, efp)
        assert (got[i]["root"], got[i]["edited_root"]) == (brute_root(t), brute_root(edited))
        assert got[i]["near_edited"] == pytest.approx(like(leaves, eleaves)) and got[i]["near_next"] == pytest.approx(like(leaves, nleaves))
    assert got[8]["fingerprint"] == got[9]["fingerprint"]
    assert fingerprints(d.limit(0)).count() == 0
    assert fingerprints(d.limit(1)).count() == 1
    assert fingerprints(docs_frame(spark, ["a", "b", "c"], ids=[None, 1, None])).count() == 3
    # many ranges, most of them empty: the plan doesn't grow with them
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        plans = []
        for n in ("300", "20"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            many = fingerprints(d)
            plans.append(many._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        assert plans[0] == plans[1]
        assert sorted(map(repr, many.collect())) == sorted(map(repr, got.values()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    pair = spark.createDataFrame([(1, brute_fingerprint("a\nb\n\nc")[0], brute_fingerprint("a\nx\n\nc")[0]), (2, "q:", "q:")], "id int, l string, r string")
    assert [tuple(x) for x in differing_branches(pair.select("id", "l", "r"), "l", "r").select("id", "section", "paragraph", "leaf").collect()] == [(1, 0, 1, 0)]


# --- 8: mixing ------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        t = {s: 3 * sizes[s] if s in capped else (weight[s] * rest / w if w else 0) for s in order}
        over = {s for s in order if s not in capped and t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mixing(spark):
    from llm.mixing import mix, quality_weights

    r = random.Random(1)
    v = vocabulary(20)
    sources = ["b", "a", None, "é", "z", "tiny", "empty"]
    rows = []
    for i in range(400):
        s = sources[min(r.choice([0, 0, 0, 0, 1, 2, 3, 4, 5]), 5 if i % 40 == 0 else 4)]
        rows.append((i, None if i % 50 == 7 else " ".join(r.choice(v) for _ in range(r.randint(0, 60)))) + ("en", s, 1))
    rows += [(900, "", "en", "empty", 0), (None, "no id here", "en", "a", 1), (3, rows[3][1], "en", rows[3][3], 1), (901, "w " * 20_000, "en", "b", 1)]
    d = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("clash")).withColumn("bucket", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 400, 3)] + [(0, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = mix(d, quality_weights(labels)).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    want = brute_targets(dict(sizes))
    taken = Counter()
    for x in out:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(want[x["source"]])
        assert 0 <= x["taken"] <= 3 * x["size"]
        taken[x["source"]] += x["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mix(d.repartition(7), quality_weights(labels)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    # rows that repeat an id, or have none, with texts of other lengths: one result in any layout
    many = d.unionByName(d.where("doc_id < 60").withColumn("doc_id", F.when(F.col("doc_id") < 30, 5)).withColumn("text", F.concat("text", F.lit(" more"))))
    layouts = [sorted(map(str, mix(many.repartition(n, *c), quality_weights(labels), ("text",)).collect())) for n, c in ((1, ()), (3, ("text",)), (5, ("doc_id",)), (7, ()))]
    assert all(x == layouts[0] for x in layouts[1:])
    assert mix(d.limit(0), quality_weights(labels)).count() == 0


# --- 10: URL filter -------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    from llm.url_filter import RULES, judge

    urls = [None, "", "nothing", "http://ORG/", "https://a.org", "https://a.org/x", "http://example.org/es/1", "http://www.example.org/en/1", "http://example.org/en/2", "http://x.com/fr/9?q", "http://x.com/de/9#f"]
    urls += ["http://notorg/x", "http://example.net/en/1", "a://b://c/d", "http://h?x=/y", "http://x.com/fr/\n", "http://" + "y" * 50_000 + ".org/z"]
    urls += [f"http://s{i}.example.{t}/{p}/{i}" for i in range(60) for t, p in (("com", "fr"), ("com", "de"), ("net", "en"))]
    d = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in judge(d).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"(?s)[^/?#]*", rest)[0]
            path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
            host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or ("allow" if got[i]["score"] >= 0.5 else "block"))
    french = [got[i]["score"] for i, u in enumerate(urls) if u and ".com/fr/" in u]
    german = [got[i]["score"] for i, u in enumerate(urls) if u and ".com/de/" in u]
    assert min(french) > 0.5 > max(german)
    assert judge(d.limit(0)).count() == 0 and judge(d.limit(1)).first()["verdict"] in ("allow", "block")


def test_url_filter_learns_from_repeated_urls(spark, monkeypatch):
    """Many rows of few URLs teach the model what the distinct URLs do, and the sample has a bound."""
    from llm import url_filter

    urls = [f"http://s{i}.example.com/{p}/{i}" for i in range(30) for p in ("fr", "de")]
    new = ["http://q.example.com/fr/x", "http://q.example.com/de/x"]
    frame = lambda u: spark.createDataFrame(list(enumerate(u)), "page_id long, url string")
    rules = [("allow", f"s{i}.example.com", "/fr") for i in range(30)] + [("block", f"s{i}.example.com", "/de") for i in range(30)]
    monkeypatch.setattr(url_filter, "TRAIN_URLS", 60)
    sizes, real = [], url_filter.train
    monkeypatch.setattr(url_filter, "train", lambda t: sizes.append(t.count()) or real(t))
    once = {r["page_id"]: r["score"] for r in url_filter.judge(frame(new + urls), rules).collect()}
    often = {r["page_id"]: r["score"] for r in url_filter.judge(frame(new + urls * 200), rules).collect()}
    assert sizes == [60, 60]
    assert [often[k] for k in (0, 1)] == pytest.approx([once[k] for k in (0, 1)]) and once[0] > 0.5 > once[1]


# --- 3: WARC --------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, monkeypatch):
    from llm import warc

    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 3)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 500)
    html = [None, "", "<p>ä</p>", "x\r\n\r\ny", "dup", "dup", "dup", "z" * 200_000] + [f"page {i % 17}" for i in range(60)]
    rows = [(i, None if i == 3 else f"http://H{i % 5}.example.org/a b/{i % 7}?q={i}", h, "clash") for i, h in enumerate(html)]
    rows += [rows[5], (None, "http://n.org/", "dup", "c"), (None, None, "alone", "c")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    out = warc.round_trip(spark, d).collect()
    last = {}
    for i, _, h, _ in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", -1))
    want = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        o = last.get(h or "")
        visit = o is not None and i != o
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if visit else "response", o if visit else None))
    got = [(x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in out]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert warc.round_trip(spark, d.limit(0)).count() == 0
    # below the threshold nothing is a revisit
    assert {x["record_type"] for x in warc.round_trip(spark, d, least=10**7).collect()} == {"response"}


def test_warc_lookup_reads_payloads(spark):
    from llm import warc
    from llm.common import new_path

    d = spark.createDataFrame([(i, f"http://a{i}.org/", f"body {i}") for i in range(50)], "page_id long, url string, html string")
    top = warc.build_index(warc.write_archives(d, new_path(spark, "w")), new_path(spark, "i"))
    keys = spark.createDataFrame([(bytearray(b"org,a7)/ 7"),), (bytearray(b"org,nowhere)/ 7"),)], "key binary")
    found = warc.lookup(keys, top).collect()
    assert [(r["page_id"], bytes(r["payload"]), r["url"]) for r in found] == [(7, b"body 7", "http://a7.org/")]


# --- 6: decontamination ---------------------------------------------------------------------------------------------


def test_decontamination(spark, monkeypatch):
    from llm import decontaminate as dc

    r = random.Random(9)
    v = vocabulary(3000, 9)
    text = lambda n: [r.choice(v) for _ in range(n)]
    items = {i: text(n) for i, n in enumerate([1, 3, 5, 6, 14, 15, 22, 40, 59, 120])}
    items[0] = ["einziges-wort"]
    docs, want = [], {}
    for i, w in items.items():
        for shift in range(4):
            docs.append(" ".join(text(30 + shift) + [x.upper() for x in w] + text(25)))
            want[len(docs) - 1] = i
    changed = list(items[8])
    changed[30] = "replaced"
    docs.append("\n".join(text(9) + changed + text(9)))  # one word of 59: 50 of 55 shingles stay
    want[len(docs) - 1] = 8
    half = items[9][:60]
    docs += [" ".join(text(40) + half + text(40)), None, "", "word", " ".join(text(5000))]
    bench = spark.createDataFrame([(i, " ".join(w), 0.5) for i, w in items.items()] + [(99, None, 1.0), (98, "", 1.0)], "item_id long, text string, similarity double")
    d = docs_frame(spark, docs).withColumn("similarity", F.lit(1)).withColumn("_text", F.lit("x"))
    for block in (1000, 3):
        monkeypatch.setattr(dc, "ITEM_BLOCK", block)
        got = {x["doc_id"]: x for x in dc.contamination(d, bench).collect()}
        assert len(got) == len(docs)
        assert {i for i, x in got.items() if x["contaminated"]} == set(want)
        for i, item in want.items():
            assert got[i]["item_id"] == item and got[i]["n_items"] == 1 and got[i]["similarity"] >= 0.75
    assert not any(x["contaminated"] for x in dc.contamination(d, bench.limit(0)).collect())
    assert dc.contamination(d.limit(0), bench).count() == 0


def brute_similarity(item, doc, weights, size, span):
    """The largest weighted share of the item's shingles in ``span`` words of the document in a row."""
    shingle = lambda w: {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    own = shingle(item)
    best = max(sum(weights[s] for s in own & shingle(doc[a : a + span])) for a in range(max(1, len(doc) - span + 1)))
    return best / sum(weights[s] for s in own)


def test_edited_copies_equal_brute_force():
    """Copies cut in front or at the end, with a replaced or an inserted block, or with scattered changes."""
    from llm import decontaminate as dc

    r = random.Random(21)
    v = vocabulary(2000, 21)
    text = lambda n: [r.choice(v) for _ in range(n)]
    items = [text(n) for n in (15, 16, 40, 40, 60, 60, 100, 100, 150)]
    items[3][:12] = items[2][:12]  # common to two items: less weight
    docs = []
    for w in items:
        for part in (0.1, 0.2, 0.24, 0.3):
            k, a = int(part * len(w)), r.randint(1, len(w) // 2)
            scattered = [r.choice(v) if i % 23 == 11 else x for i, x in enumerate(w)]
            copies = (w[k:], w[: len(w) - k], w[:a] + text(k) + w[a + k :], w[:a] + text(k) + w[a:], text(1) + w[1:k] + text(2) + w[k:], scattered)
            docs += [text(r.randint(0, 40)) + c + text(r.randint(0, 40)) for c in copies]
    docs.append(items[2] * 3 + text(9) + items[3])
    index = dc.build_items([(i, " ".join(w)) for i, w in enumerate(items)])
    got = dc.matches(pa.array([" ".join(d) for d in docs]), index)
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]
    counts = Counter(s for own in shingles for s in own)
    weights = {s: math.log1p(len(items) / c) for s, c in counts.items()}
    n = found = 0
    for j, d in enumerate(docs):
        for i, w in enumerate(items):
            want = brute_similarity(w, d, weights, 5, len(w) + 2 * max(2, len(w) // 4))
            hit = want >= 0.75 - 1e-9
            n += hit
            found += i in got.get(j, {})
            if i in got.get(j, {}):
                assert hit and got[j][i] == pytest.approx(want), (i, j, want)
    assert n > 100 and found >= 0.98 * n, (found, n)


@pytest.mark.parametrize("kind", ["front", "end", "replaced", "inserted", "scattered"])
def test_simhash_windows_find_edited_copies(kind):
    """The Hamming search finds nearly all copies that keep 0.75 of the shingles, of items of all lengths."""
    from llm import decontaminate as dc

    r = random.Random(22)
    v = vocabulary(3000, 22)
    text = lambda n: [r.choice(v) for _ in range(n)]
    items = [text(n) for n in (16, 20, 30, 45, 59, 100, 250, 600, 1500) for _ in range(6)]
    docs = []
    for w in items:
        n = len(w)
        k, a = max(1, int(0.17 * n)), r.randint(1, n // 2)
        docs.append(text(r.randint(20, 60)) + {
            "front": w[k:], "end": w[: n - k], "replaced": w[:a] + text(max(1, k - 4)) + w[a + max(1, k - 4) :], "inserted": w[:a] + text(k) + w[a:],
            "scattered": [r.choice(v) if i % 29 == 14 else x for i, x in enumerate(w)],
        }[kind] + text(r.randint(20, 60)))
    got = dc.matches(pa.array([" ".join(d) for d in docs]), dc.build_items([(i, " ".join(w)) for i, w in enumerate(items)]))
    ones = Counter()
    for w in items:
        ones.update({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    weights = {k: math.log1p(len(items) / c) for k, c in ones.items()}
    want = {i for i, (w, d) in enumerate(zip(items, docs, strict=True)) if brute_similarity(w, d, weights, 5, len(w) + 2 * max(2, len(w) // 4)) >= 0.75 - 1e-9}
    assert len(want) >= 30  # of short items, few edits are enough to fall below the similarity
    assert set(got) <= want and len(got) >= 0.98 * len(want), (len(got), len(want))


def test_decontamination_does_not_depend_on_blocks(spark, monkeypatch):
    """Weights and counts are those of all items: repeated items, ids with several texts, common shingles, ties."""
    from llm import decontaminate as dc

    r = random.Random(5)
    v = vocabulary(500, 5)
    text = lambda n: [r.choice(v) for _ in range(n)]
    common = text(12)
    items = [(i % 9, " ".join(common[: r.randint(0, 12)] + text(20))) for i in range(14)]
    items += [items[3], items[4], (None, items[5][1]), (11, items[6][1]), (10, items[6][1])]
    docs = [" ".join(text(15) + t.split()[: r.randint(20, 33)] + text(15)) for _, t in items] + [" ".join(t for _, t in items), None, ""]
    docs += docs[:3]
    bench = spark.createDataFrame(items, "item_id long, text string")
    results = []
    for block, chain in ((1000, 4), (4, 2), (2, 1)):
        monkeypatch.setattr(dc, "ITEM_BLOCK", block)
        monkeypatch.setattr(dc, "CHAIN", chain)
        results.append(sorted((x["doc_id"], x["contaminated"], x["n_items"], x["item_id"], round(x["similarity"], 12)) for x in dc.contamination(docs_frame(spark, docs), bench).collect()))
    assert results[0] == results[1] == results[2]
    assert results[0][len(items)][2] == len({i for i, _ in items}) and results[0][6][3] == min(6, 10)


def test_hamming_index_misses_nothing(monkeypatch):
    from llm import decontaminate as dc

    r = np.random.default_rng(2)
    items = dc.build_items([(i, " ".join(f"w{x}" for x in r.integers(0, 500, 20))) for i in range(30)])
    index = items.index[16, 2, dc.RADIUS]
    fp = r.integers(0, 1 << 63, 4000).astype(np.uint64)
    fp[:2000] = index[0][r.integers(0, len(index[0]), 2000)]
    for row in range(2000):
        for bit in r.choice(64, r.integers(0, 14), replace=False):
            fp[row] ^= np.uint64(1) << np.uint64(bit)
    monkeypatch.setattr(dc, "PAIRS", 500)
    for key, index in items.index.items():
        got = {x for at, entry in dc.candidates(fp, index, key[2]) for x in zip(at.tolist(), entry.tolist(), strict=True)}
        close = np.bitwise_count(fp[:, None] ^ index[0][None]) <= key[2]
        assert got == set(zip(*(x.tolist() for x in np.nonzero(close)), strict=True))


def test_decontamination_finds_nothing_without_its_index():
    from llm import decontaminate as dc

    r = random.Random(3)
    v = vocabulary(500, 3)
    items = [(i, " ".join(r.choice(v) for _ in range(30))) for i in range(20)]
    index = dc.build_items(items)
    docs = pa.array(["x " + t for _, t in items])
    assert {row: set(got) for row, got in dc.matches(docs, index).items()} == {i: {i} for i in range(20)}
    index.index = {}
    assert dc.matches(docs, index) == {}


def test_decontamination_of_a_repeated_passage_is_bounded():
    """A text of one word, and one of a repeated passage, against many items that hold that run or passage."""
    import tracemalloc

    from llm import decontaminate as dc

    r = random.Random(8)
    v = vocabulary(2000, 8)
    passage = " ".join(r.choice(v) for _ in range(12))
    items = [(i, "eins " * 20 + " ".join(r.choice(v) for _ in range(i % 5))) for i in range(200)] + [(300 + i, passage + " " + " ".join(r.choice(v) for _ in range(3))) for i in range(200)]
    index = dc.build_items(items)
    docs = pa.array(["eins " * 100_000, (passage + " ") * 5000])
    tracemalloc.start()
    got = dc.matches(docs, index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(got) == {0} and set(got[0]) >= {i for i in range(0, 200, 5)} and peak < 300e6, peak


# --- 9: language model ----------------------------------------------------------------------------------------------


def test_lm_scores(spark):
    from llm.lm_score import scores

    r = random.Random(4)
    v = vocabulary(300, 4)
    texts = [" ".join(r.choice(v[: r.choice([5, 50, 300])]) for _ in range(r.randint(0, 80))) for _ in range(150)] + [None, "", "UNSEEN words", "A a Ä ä", "w " * 5000]
    ids = list(range(len(texts)))
    d = docs_frame(spark, texts, ids=ids).withColumn("row", F.lit(1)).withColumn("train", F.lit(2))
    d = d.unionByName(d.where("doc_id = 3"))
    out = scores(d).collect()
    assert len(out) == len(texts) + 1
    rows = list(zip(ids, texts, strict=True)) + [(3, texts[3])]
    c, n = Counter(), 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            c.update([*words(t), None])
    n = sum(c.values())
    norm = math.log10(n + 0.1 * (len(c) + 1))
    for x in out:
        w = [*words(texts[x["doc_id"]]), None]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"], x["held_out"]) == (len(w), sum(c[y] > 0 for y in w), n, zlib.crc32(str(x["doc_id"]).encode()) % 10 == 0)
        assert x["base_score"] == pytest.approx(sum(math.log10(c[y] + 0.1) for y in w) - len(w) * norm)
        assert x["score"] < 0
    assert scores(d.limit(0)).count() == 0


def test_network_learns_from_every_training_document(spark, monkeypatch):
    """A habit of texts that are longer than the start's, and outside its sample, shows in the scores."""
    from llm import lm_score

    r = random.Random(8)
    long = " ".join(r.choice(("a b c d", "e f g h")) for _ in range(4000))
    texts = [long] * 8 + ["a c e g b d f h"] * 4
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10][: len(texts)]
    d = docs_frame(spark, texts, ids=ids)
    monkeypatch.setattr(lm_score, "RATE", 2e-2)
    learnt, real = [], lm_score.learn_all
    monkeypatch.setattr(lm_score, "learn_all", lambda *a: learnt.append(real(*a)))
    got = {x["doc_id"]: x for x in lm_score.scores(d).collect()}
    assert learnt == [sum(len(t.split()) + 1 for t in texts)]
    assert got[ids[0]]["score"] > 0.8 * got[ids[0]]["base_score"]


def test_gru_scores_are_a_distribution_and_carry_state():
    from llm.gru import Gru

    g = Gru(np.array([5.0, 3, 2, 1, 1, 1, 4]), hidden=6, n_classes=3)
    r = np.random.default_rng(1)
    ids = r.integers(0, 7, 4000)
    losses = g.train(np.where(np.arange(4000) % 2 == 0, ids, 6), streams=8, window=10, epochs=3)
    assert losses[-1] < losses[0]
    h = np.tile(r.standard_normal((1, 6)).astype(np.float32), (7, 1))
    assert np.exp(g.log_probs(h, np.arange(7))).sum() == pytest.approx(1, abs=1e-4)
    text = np.array([1, 2, 3, 0, 5, 6] * 20)
    bounds = np.array([0, 50, 50, 120])
    got = g.score(text, bounds, window=7)
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        h, x, total = np.zeros((1, 6), np.float32), g.start, 0.0
        for y in text[a:b]:
            h, _ = g.step((g.emb[[x]] @ g.wx + g.bh).astype(np.float32), h)
            total += float(g.log_probs(h, np.array([y]))[0])
            x = y
        assert got[k] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_head_words_are_found_in_little_time():
    """As by binary search, also where many share their leading bits, in less than its time."""
    import time

    from llm.lm_score import _Head

    def seconds(f):
        def one():
            start = time.process_time()
            f()
            return time.process_time() - start

        return min(one() for _ in range(4))

    r = np.random.default_rng(3)
    hashes = np.unique(np.append(r.integers(0, 2**64, 131_072, dtype=np.uint64), r.integers(5 << 44, 6 << 44, 50, dtype=np.uint64)))
    head, h = _Head(hashes), np.concatenate([r.choice(hashes, 10**6), hashes, hashes + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    assert np.array_equal(head.find(h), np.where(hashes[at] == h, at, len(hashes)))
    assert seconds(lambda: head.find(h)) < 0.6 * seconds(lambda: np.searchsorted(hashes, h))


def test_gru_gradients():
    from llm.gru import Gru

    g = Gru(np.array([5.0, 3, 2, 1, 4]), hidden=4, n_classes=2)
    for k in g.NAMES:
        setattr(g, k, getattr(g, k).astype(np.float64))
    r = np.random.default_rng(0)
    g.wc += r.standard_normal(g.wc.shape) * 0.3
    g.wo += r.standard_normal(g.wo.shape) * 0.3
    x, y, h = r.integers(0, 5, (3, 2)), r.integers(0, 5, (3, 2)), r.standard_normal((2, 4))
    _, _, grad = g._window(x, y, h)
    for k in g.NAMES:
        w = getattr(g, k)
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 7)]:
            old = w[at]
            if old < -1e8:
                continue
            w[at] = old + 1e-5
            up = g._window(x, y, h)[0]
            w[at] = old - 1e-5
            down = g._window(x, y, h)[0]
            w[at] = old
            assert grad[k][at] == pytest.approx((up - down) / 2e-5, rel=2e-3, abs=1e-5), (k, at)


# --- 2: language identification ---------------------------------------------------------------------------------------


def brute_forward(word, prob, pieces):
    from llm import language_id as li

    w = li.MARK + word
    alpha = [1.0] + [0.0] * len(w)
    for j in range(1, len(w) + 1):
        for k in range(1, j + 1):
            p = pieces.get(w[j - k : j])
            if p is not None:
                alpha[j] += alpha[j - k] * prob[p]
            elif k == 1:
                alpha[j] += alpha[j - 1] * li.UNKNOWN
    return alpha[-1]


def test_language_model_sums_segmentations(spark):
    from llm import language_id as li

    pieces = li.vocabulary()
    seg = li.Segmenter(pieces)
    place = {p: i for i, p in enumerate(pieces)}
    prob = li.learn(["the cat sat on the mat", "the thing there"], seg, len(pieces))
    assert prob.sum() == pytest.approx(1)
    assert max(map(len, pieces)) > 8
    texts = ["the THE zq", "mat—cat", None, "", "12 !!", "größe " * 3, "x" * 100, "日本語 the", "thethingthere" * 5 + " " + "thing" * 11]
    scorer = li.Scorer(pieces, prob[:, None])
    for _ in range(2):  # the second time from memory
        logs, n = scorer.scores(texts)
        for t, got, k in zip(texts, logs[:, 0], n, strict=True):
            runs = re.findall(r"[^\W\d_]+", (t or "").lower())
            assert k == len(runs)
            assert got == pytest.approx(sum(math.log(brute_forward(r, prob, place)) for r in runs), rel=1e-6)
    # a word too unlikely for numbers without logarithms, and one longer than any chunk
    rare = np.full(len(pieces), 1e-30)
    one, other = (li.Scorer(pieces, rare[:, None]).scores([t])[0][0, 0] for t in ("q" * 31, "q" * 310))
    assert -2000 < one < math.log(li.LEAST) and other == pytest.approx(10 * one, rel=0.1)
    assert np.isfinite(scorer.scores(["ab" * 30_000, "word " * 3])[0]).all()


def test_language_model_learns_from_long_words():
    """Expectation-maximisation over a long word gives what it gives in the matrix of short ones."""
    from llm import language_id as li

    pieces = li.vocabulary()
    texts = ["donaudampfschiff fahrt und donaudampf", "schifffahrt gesellschaft"]
    want = li.learn(texts, li.Segmenter(pieces), len(pieces))
    old, li.SHORT_WORD = li.SHORT_WORD, 3
    try:
        got = li.learn(texts, li.Segmenter(pieces), len(pieces))
    finally:
        li.SHORT_WORD = old
    assert np.allclose(got, want, rtol=1e-6)


def test_language_id(spark):
    from llm.language_id import identify, train

    en, de = "the house and the garden with that which have been there".split(), "das haus und der garten mit dem welche sind dort gewesen".split()
    r = random.Random(0)
    texts = [" ".join(r.choice(en if i % 2 else de) for _ in range(12)) for i in range(60)]
    d = docs_frame(spark, texts + [None, "12 34 !", "", "haus und garten"], langs=["en" if i % 2 else "de" for i in range(60)] + [None, "en", "de", None]).withColumn("lang_pred", F.lit("x"))
    d = d.withColumn("held_out", F.col("doc_id") % 3 == 1)
    out = {x["doc_id"]: x for x in identify(d, train(d.where("not held_out"))).collect()}
    assert all(out[i]["lang_pred"] == ("en" if i % 2 else "de") and 0.5 < out[i]["score"] <= 1 for i in range(60))
    # repeated rows, one very long text and a word of both languages alike
    more = docs_frame(spark, ["das haus " * 40_000, "und der garten", "und der garten", "ohne"], langs=[None] * 4, ids=[1, 7, 7, 9]).withColumn("held_out", F.lit(True))
    again = identify(more, train(d.where("not held_out"))).collect()
    assert sorted((x["doc_id"], x["lang_pred"]) for x in again if x["doc_id"] != 9) == [(1, "de"), (7, "de"), (7, "de")] and len({x["score"] for x in again if x["doc_id"] == 7}) == 1
    assert [out[i]["lang_pred"] for i in (60, 61, 62, 63)] == ["und", "und", "und", "de"] and out[60]["score"] == 0
    none = identify(d, train(d.where("lang = 'xx'"))).collect()
    assert {x["lang_pred"] for x in none} == {"und"}
    assert identify(d.limit(0), train(d)).count() == 0


# --- 4 and 1: classifiers -----------------------------------------------------------------------------------------------


def labelled(spark, n=600):
    r = random.Random(8)
    v = vocabulary(400, 8)
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(v) for _ in range(r.randint(20, 80))]
        toxic, poor = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(6):
                w[r.randrange(len(w))] = r.choice(["vileword", "badterm!", "Nastyname"])
        if poor:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x for x in w for _ in range(4)]
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 1))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "long " * 30_000, "en", "s", 5), (None, "some text", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(None, 1, 1), (9002, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    from llm.toxicity import fold, score, train

    docs, labels = labelled(spark)
    docs = docs.withColumn("toxic", F.lit(7)).withColumn("score", F.lit("x"))
    model = train(docs.where(~fold()), labels.where(~fold()))
    out = {r["doc_id"]: r["score"] for r in score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    good = sum((out[i] >= 0.5) == (i % 5 == 0) for i in held)
    assert good / len(held) > 0.9
    assert all(0 <= s <= 1 for s in out.values()) and out[9001] < 0.5 and out[9002] < 0.5
    empty = train(docs.limit(0), labels)
    assert all(r["score"] < 0.5 for r in score(docs, empty).collect())
    assert score(docs.limit(0), model).count() == 0


def test_label_model_weighs_voters():
    from llm.toxicity import LEXICONS, label_model

    r = np.random.default_rng(0)
    y = r.random(3000) < 0.2
    good = (r.random((3000, 2 * LEXICONS)) < np.where(y, 0.8, 0.01)[:, None]).astype(float)
    noise = (r.random((3000, 5)) < 0.3).astype(float)
    p, rates, weight = label_model(np.concatenate([good, noise], 1), 0.2)
    assert ((p > 0.5) == y).mean() > 0.98
    assert np.abs(rates[1, -5:] - rates[0, -5:]).max() < 0.1 and (rates[1, :-5] - rates[0, :-5]).min() > 0.5
    twins = np.repeat(good[:, :1], 4, 1)
    _, _, w = label_model(np.concatenate([good, noise[:, :1], twins], 1), 0.2)
    assert w[-4:].max() < w[1 : 2 * LEXICONS].min()


def test_quality(spark):
    from llm.quality import co_train, score, train

    docs, labels = labelled(spark)
    docs = docs.withColumn("x", F.lit(7)).withColumn("score", F.lit("x"))
    model = train(docs, labels)
    out = {r["doc_id"]: r["score"] for r in score(docs, model).collect()}
    assert sum((out[i] < 0.5) == (i % 7 == 0) for i in range(600)) / 600 > 0.95
    assert all(0 <= s <= 1 for s in out.values())
    none = train(docs, labels.limit(0))
    assert {r["score"] for r in score(docs, none).collect()} == {0.5}
    assert score(docs.limit(0), model).count() == 0
    # each view teaches the other: with two informative views, few labels and a pool
    r = np.random.default_rng(0)
    y = (r.random(1000) < 0.5).astype(float)
    xt, xm = y[:, None] * 2 + r.standard_normal((1000, 1)), y[:, None] * 2 + r.standard_normal((1000, 1))
    m = co_train(xt[:60], xm[:60], y[:60], xt[60:], xm[60:])
    both = m.parts(xt, xm)[2]
    assert ((both > 0.5) == (y > 0.5)).mean() > 0.88


# --- the classifiers against brute force -----------------------------------------------------------------------------------


def brute_text_features(text):
    raw = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    low = [x.lower() for x in w]
    size, n = max(1, len(raw)), max(1, len(w))
    near = lambda k: sum(low[i] == low[i - k] for i in range(k, len(low))) / n
    double = sum(len(x) > 1 and x[-1] == x[-2] and x[-1] < 128 and not 97 <= x[-1] <= 122 for x in w) / n
    return [
        sum(65 <= c <= 90 for c in raw) / size, sum(48 <= c <= 57 for c in raw) / size, raw.count(b"!") / size, sum(c in b"#$%&*@|<>^~=+_\\{}[]" for c in raw) / size,
        raw.count(b"|") / size, (raw.count(b".") + raw.count(b",")) / size, raw.count(b"\n") / size, near(1), near(2), near(3), double,
        sum(x[-1] in b"#$%&*@|!" for x in w) / n, sum(65 <= x[0] <= 90 for x in w) / n, min(1, len(raw) / n / 20), math.log1p(len(w)) / 10, float(len(w) < 20),
    ]


def quality_rows():
    r = random.Random(12)
    v = vocabulary(200, 12)
    good = lambda n: " ".join(r.choice(v).capitalize() if k % 9 == 0 else r.choice(v) for k in range(n)) + "."
    poor = lambda n: " ".join(r.choice(("BUY!!", "#1", "$$$", "now now", r.choice(v))) for _ in range(n))
    rows = []
    for i in range(900):
        bad = i % 3 == 0
        text = (poor if bad else good)(r.randint(5, 60))
        rows.append((i, text, r.choice(("en", "de", None)), f"s{r.choice((7, 8)) if bad else r.choice((1, 2, 3, None))}", r.choice((len(text), None))))
    rows += [rows[4], rows[5], (5, "another text", "en", "s1", 3), (None, "no id", "en", None, 4), (2000, None, None, None, None), (2001, "", "en", "s1", 0), (2002, "W " * 20_000, "en", "s1", 40_000)]
    labels = [(i, 0 if i % 3 == 0 else 1) for i in range(0, 300, 2)] + [(4, 1), (10, 0), (None, 1), (12, None), (9999, 1)]
    return rows, labels


def test_quality_is_brute_force_co_training(spark):
    """Features, the pools of every round, and scores by plain loops over the collected table give the distributed model."""
    from llm import quality as q

    rows, labels = quality_rows()
    d = spark.createDataFrame(rows, DOCS).withColumn("x", F.lit("clash")).withColumn("y", F.lit(1)).repartition(7)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    truth = {}
    for i, y in labels:
        if i is not None and y is not None:
            truth[i] = min(truth.get(i, 1), y)
    # rows by the hash that names them, with plain features of the text and the metadata's slots
    named = d.select("doc_id", "text", F.xxhash64("doc_id", "text", "source", "lang", "n_chars").alias("row"), *q._metadata(d)).collect()

    def meta(x):
        m = [0.0] * (2 * q.BUCKETS + 2)
        m[x["m_source"]] = m[q.BUCKETS + x["m_lang"]] = 1.0
        m[-2], m[-1] = x["m_length"] / 10, float(x["m_length"] < 0)
        return m

    every = {x["row"]: (x["doc_id"], np.array(brute_text_features(x["text"])), np.array(meta(x))) for x in named}
    known = sorted(k for k, (i, _, _) in every.items() if i in truth)
    pool = [k for k, (i, _, _) in every.items() if i not in truth]
    get = lambda keys, at: np.array([every[k][at] for k in keys])

    def pick(views, share, taken):
        out = []
        for teacher, view in enumerate(views):
            p = dict(zip(pool, q.sigmoid(view.logit(get(pool, 1 + teacher))), strict=True))
            names, ys = [], []
            for y, n in ((1, int(q.GAIN * share)), (0, int(q.GAIN * (1 - share)))):
                sure = sorted((-(p[k] if y else 1 - p[k]), k) for k in pool if (p[k] if y else 1 - p[k]) >= q.SURE and k not in taken[teacher])[:n]
                names += [k for _, k in sure]
                ys += [float(y)] * len(sure)
            out.append((np.array(names, np.int64), get(names, 1).reshape(-1, q.TEXT_FEATURES), get(names, 2).reshape(-1, 2 * q.BUCKETS + 2), np.array(ys)))
        return out

    want = q._co_train(get(known, 1), get(known, 2), np.array([float(truth[every[k][0]]) for k in known]), pick)
    model = q.train(d, lab)
    for a, b in ((model.text, want.text), (model.meta, want.meta)):
        assert np.allclose(a.weights, b.weights, atol=1e-6) and np.isclose(a.slope, b.slope, atol=1e-6)
    got = q.score(d, model).collect()
    assert len(got) == len(rows)
    scored = sorted((repr(x["doc_id"]), round(x["score"], 6)) for x in got)
    assert scored == sorted((repr(x["doc_id"]), round(float(want.parts(get([x["row"]], 1), get([x["row"]], 2))[2][0]), 6)) for x in named)


def test_toxicity_is_brute_force_weak_supervision(spark):
    """Mined features, votes of every training row, the label model and scores by plain loops give the distributed model."""
    from llm import kernel
    from llm import toxicity as t

    r = random.Random(13)
    v, bad = vocabulary(300, 13), ["zorniger", "zornige", "hassrede", "hass", "widerlich"]
    rows, labels = [], []
    for i in range(700):
        toxic = i % 4 == 0
        w = [r.choice(v) for _ in range(r.randint(5, 50))] + ([r.choice(bad) for _ in range(r.randint(1, 6))] + (["!!!"] if i % 8 == 0 else []) if toxic else [])
        r.shuffle(w)
        rows.append((i, " ".join(x.upper() if toxic and r.random() < 0.3 else x for x in w), "en", "s", 0))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    rows += [rows[8], rows[9], (900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, "hass hass", "en", "s", 0), (902, "Hassrede " * 5000, "en", "s", 0)]
    labels += [(8, 0), (None, 1), (10, None)]
    d = spark.createDataFrame(rows, DOCS).withColumn("toxic", F.lit("clash")).repartition(5)
    model = t.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))

    def features(text):
        w = words(text)
        return {("w", x) for x in w} | {(n, x[:n]) for x in w for n in t.BEGINNINGS if len(x) >= n}

    truth = {}
    for i, y in labels:
        if i is not None and y is not None:
            truth[i] = max(truth.get(i, 0), y)
    known = sorted({(i, x or "") for i, x, *_ in rows if i in truth})
    a, b = Counter(), Counter()
    for i, x in known:
        (a if truth[i] else b).update(features(x))
    share = sum(truth[i] for i, _ in known) / len(known)
    mined = set()
    for f, n_bad in a.items():
        n = n_bad + b[f]
        ratio = n_bad * math.log(n_bad / (n * share)) + (b[f] * math.log(b[f] / (n * (1 - share))) if b[f] else 0)
        if n_bad >= t.LEAST and ratio >= t.RATIO and n_bad >= t.SHARE * n:
            mined.add(f)

    def hashed(f):
        w = next(kernel.words(pa.array([f[1].decode()])))
        return int(w.hashes[0]) if f[0] == "w" else int(w.prefix_hashes(f[0])[0][0])

    of = {f: hashed(f) for f in mined}
    assert mined and set(model.lexicon.hashes.tolist()) == set(of.values())
    voter = dict(zip(model.lexicon.hashes.tolist(), model.lexicon.voter.tolist(), strict=True))
    weight = dict(zip(model.lexicon.hashes.tolist(), model.weights.tolist(), strict=True))

    def hits(text):
        out = []
        for x in words(text):
            out += [of[f] for f in [("w", x), *((n, x[:n]) for n in t.BEGINNINGS if len(x) >= n)] if f in of]
        return out

    def brute_votes(text):
        raw, w, count = (text or "").encode(), words(text), Counter(voter[h] for h in hits(text))
        size = max(1, len(raw))
        patterns = [sum(65 <= c <= 90 for c in raw) / size, raw.count(b"!") / size, sum(c in b"#$%&*@|" for c in raw) / size, sum(48 <= c <= 57 for c in raw) / size, sum(w[k] == w[k - 1] for k in range(1, len(w))) / max(1, len(w))]
        return [*(count[k] >= 1 for k in range(t.LEXICONS)), *(count[k] >= 3 for k in range(t.LEXICONS)), *(p > x for p, x in zip(patterns, t.PATTERN_LIMITS, strict=True))]

    chunks = list(kernel.words(pa.array([x for _, x, *_ in rows])))
    assert np.concatenate([t.votes(model.lexicon, w) for w in chunks]).tolist() == [brute_votes(x) for _, x, *_ in rows]
    # the label model over rows is the one over counted patterns
    v_rows = np.array([brute_votes(x) for _, x, *_ in rows])
    seen, count = t.patterns(d.select(F.coalesce("text", F.lit("")).alias("text")), model.lexicon)
    prior = (sum(truth[i] for i, _ in known) + 0.5) / (len(known) + 1)
    p_rows, p_seen = t.label_model(v_rows, prior)[0], t.label_model(seen, prior, count=count)[0]
    place = {tuple(map(int, x)): k for k, x in enumerate(seen)}
    assert np.allclose(p_rows, [p_seen[place[tuple(map(int, x))]] for x in v_rows], atol=1e-6)
    # the regression fits the posteriors of the labelled rows
    got = t.score(d, model).collect()
    want = sorted((repr(i), round(1 / (1 + math.exp(-(model.intercept + sum(weight[h] for h in set(hits(x)))))), 9)) for i, x, *_ in rows)
    assert sorted((repr(x["doc_id"]), round(x["score"], 9)) for x in got) == want
    by = {(i, x or ""): p for (i, x, *_), p in zip(rows, p_rows, strict=True)}
    fitted = {repr(x["doc_id"]): x["score"] for x in got}
    assert np.mean([abs(fitted[repr(i)] - by[i, x]) for i, x in known]) < 0.05


# --- interleaved shards ------------------------------------------------------------------------------------------------


def test_interleaved_shards(spark, tmp_path):
    from llm import sharding as h

    r = random.Random(3)
    v = vocabulary(60)
    rows = [(i, " ".join(r.choice(v) for _ in range(r.randrange(40))), "en", f"s{min(r.randrange(9), 4)}", 0) for i in range(700)]
    rows += [(7000 + i, "the same text", "en", "hot", 0) for i in range(900)]
    rows += [(None, "no id", "en", None, 0)] * 40 + [(5, "twice", None, "s1", 1), (5, "twice", None, "s1", 2), (5, "other", None, "s1", 1), (6, None, "de", "s2", None), (8, "", "de", "s2", 0), (9, "é€", "de", "Ä", 0)]
    rows += [(8000 + i, "small source", "en", f"single{i}", 0) for i in range(64)]
    d = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash")).repartition(5)
    for n_shards in (16, 7):
        got = h.interleaved(d, n_shards).collect()
        assert sorted((repr(x["doc_id"]), repr(x["source"]), x["size"], x["text_crc32"]) for x in got) == sorted((repr(i), repr(s), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, s, _ in rows)
        shards = {}
        for x in got:
            shards.setdefault(x["shard"], []).append(x)
        assert sorted(shards) == list(range(n_shards)) and {len(x) for x in shards.values()} <= {len(rows) // n_shards, len(rows) // n_shards + 1}
        assert all(sorted(x["slot"] for x in s) == list(range(len(s))) for s in shards.values())
        # every shard has the mixture: hardly more than one row of a source off its share
        for source, n in Counter(x[3] for x in rows).items():
            for s in shards.values():
                assert abs(sum(x["source"] == source for x in s) - n / n_shards) <= 4
        assert max(sum((x["source"] or "").startswith("single") for x in s) for s in shards.values()) < 40
        flat = lambda t: sorted(map(repr, t))
        assert flat(h.interleaved(d.repartition(2, "text"), n_shards).collect()) == flat(got)
    assert h.interleaved(d, 16, "other seed").exceptAll(h.interleaved(d)).count() > 0
    assert h.interleaved(d.limit(0)).count() == 0 and sorted(x["shard"] for x in h.interleaved(d.where("doc_id < 3")).collect()) == [0, 5, 10]
    h.write_shards(d, h.interleaved(d), f"file://{tmp_path}/shards", 6)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted((repr(x["doc_id"]), repr(x["text"]), x["shard"], x["slot"]) for x in back.where("text <> ''").collect()) == sorted(
        (repr(x["doc_id"]), repr({(i, s, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())): t for i, t, _, s, _ in rows}[x["doc_id"], x["source"], x["size"], x["text_crc32"]]), x["shard"], x["slot"])
        for x in h.interleaved(d).where("size > 1").collect()
    )


# --- filter interaction ---------------------------------------------------------------------------------------------------


def test_transducer(monkeypatch):
    from llm import transducer as t

    r = random.Random(1)
    texts = ["", "a", None, " a b\ta  ", "Äö ß€ 𝄞x 𝄞x", "x" * 9 + " " + "x" * 9 + " " + "x" * 8 + " " + "x" * 17 + " " + "x" * 16 + "y", " A B#$ |", "tail ", "é", "€", "\x0b\x0c\r", "a\x1fb c"]
    texts += ["".join(r.choice("ab é€𝄞\n\tAB#") for _ in range(r.randrange(300))) for _ in range(80)]

    def brute(x):
        b = (x or "").encode()
        w = re.findall(rb"[^\x20\x09-\x0d]+", b)
        return len(w), len(set(w)), sum(65 <= c <= 90 for c in b), len(x or ""), sum(c in b"#$%&*|" for c in b)

    for chunk, strip in ((1, 64), (50, 1), (1 << 18, 100), (1 << 18, 1 << 20)):
        monkeypatch.setattr(t, "STRIP", strip)
        got = []
        for s in t.scan(pa.array(texts), chunk):
            got += zip(*(x.tolist() for x in (np.diff(s.bounds), t.distinct(s), s.count(t.CAPITAL), s.count(t.POINT), s.count(t.SYMBOL))), strict=True)
            data = s.raw.tobytes()
            for i in range(s.n_docs):
                spans = zip(s.starts[s.bounds[i] : s.bounds[i + 1]], s.ends[s.bounds[i] : s.bounds[i + 1]], strict=True)
                assert [data[a:b] for a, b in spans] == re.findall(rb"[^\x20\x09-\x0d]+", data[s.bytes[i] : s.bytes[i + 1]])
        assert got == [brute(x) for x in texts]


def test_word_table_verifies_bytes():
    from llm import transducer as t

    words_ = [f"w{i % 37}" + "y" * (i % 23) for i in range(400)]
    s = next(t.scan(pa.array([" ".join(words_), " ".join(words_[::-1])])))
    # hashes that say nothing: all words meet in one slot, or in three
    for n in (1, 3):
        out = t.residents(s.raw, s.starts, s.ends, s.docs(), lambda loaded, starts, ends, docs, n=n: (starts % n).astype(np.uint64))
        data = s.raw.tobytes()
        of = [(int(d), data[a:b]) for d, a, b in zip(s.docs(), s.starts, s.ends, strict=True)]
        assert len(set(out.tolist())) == len(set(of)) and all(of[i] == of[j] for i, j in enumerate(out.tolist()))
    r = random.Random(2)
    s = next(t.scan(pa.array([" ".join(str(r.randrange(3000)) for _ in range(20000))])))
    assert t.distinct(s, 500).tolist() == t.distinct(s).tolist() == [len(set(s.raw.tobytes().split()))]


def test_filter_audit(spark):
    from itertools import permutations

    from llm import filter_audit as a

    r = random.Random(9)
    v = vocabulary(400)
    text = lambda n, k=400: " ".join(r.choice(v[:k]) for _ in range(n))
    texts = [text(r.choice((5, 150, 199, 200, 201, 320)), r.choice((20, 99, 400))) + r.choice(("", "", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3)) for _ in range(60)]
    rows = [(i, t, r.choice(("en", "de", None, "")), "s", 0) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % 7], r.choice(("en", "fr")), "s", 0) for i in range(50)]
    rows += [(3, texts[3], "en", "s", 0), (3, texts[3], "de", "s", 1), (300, None, "en", "s", None), (301, "", "de", "s", 0), (None, texts[0], "en", "s", 0), (None, None, None, None, None)]
    labels = [(i, r.choice((0, 1, None)), r.choice((0, 1))) for i in range(0, 140, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    d = spark.createDataFrame(rows, DOCS).withColumn("mask", F.lit("clash")).withColumn("part", F.lit(1)).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    said = lambda i, k: i is not None and any(x[0] == i and x[k] == 1 for x in labels)
    found = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        found.append((lang or "", {k for k, x in fails.items() if x}, said(i, 1), said(i, 2)))
    want = {}
    for part in {f[0] for f in found}:
        own, total = [f for f in found if f[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [f for f in left if k in f[1]]
                left = [f for f in left if k not in f[1]]
                total[k] += len(gone)
                want[part, "".join(order), step] = [len(left), len(gone), sum(k in f[1] for f in own) - len(gone), sum(f[1] == {k} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for order in permutations("ABCDE"):
            for step, k in enumerate(order, 1):
                want[part, "".join(order), step].append(total[k])
    got = {(x[0], x[1], x[2]): list(x[3:]) for x in a.audit(a.failures(d, lab)).collect()}
    assert got == want
    assert a.audit(a.failures(d.limit(0), lab)).count() == 0
    none = a.audit(a.failures(d.where("doc_id = 300"), lab.limit(0))).collect()
    assert len(none) == 600 and {x["removed"] for x in none if x["filter_order"][x["step"] - 1] == "A"} == {1}


# --- periodic runs ------------------------------------------------------------------------------------------------------


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(6, 4 * q) and not any(all(w[j] == w[j + p] for j in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_periodic_runs_are_those_of_brute_force():
    from llm import periodic_runs as p

    r = random.Random(4)
    cases = [[], [1], [1] * 5, [1] * 6, [1, 2] * 4, [1, 2] * 3 + [1], list(range(50)), [0] * 200, ([0] * 9 + [1]) * 8]
    for _ in range(250):
        w = []
        for _ in range(r.randrange(1, 5)):
            unit = [r.randrange(r.choice((2, 3, 50))) for _ in range(r.choice((1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40)))]
            w += (unit * r.choice((1, 2, 4, 5, 6)))[: r.randrange(1, 400)] + [r.randrange(60) for _ in range(r.randrange(6))]
        cases.append(w)
    # nested: runs of a long period that hold runs of short ones
    cases += [(([5] * 7 + list(range(9, 20))) * 5 + [1]) * 4, ([1, 2] * 40 + [3]) * 6, [k // 3 % 12 for k in range(500)]]
    lengths = np.cumsum([0, *map(len, cases)])
    numbers = np.concatenate([np.array(c, np.int64) + 1000 * i for i, c in enumerate(cases)])
    found = p.runs_of(numbers, lengths)
    got = [[(s - int(a), n, q) for s, n, q in found if a <= s < b] for a, b in zip(lengths[:-1], lengths[1:], strict=True)]
    assert got == [brute_runs(c) for c in cases] and sum(map(len, got)) > 200


def test_periodic_runs(spark):
    from llm.queries import QUERIES

    r = random.Random(6)
    v = vocabulary(30)
    texts = [" ".join(r.choice(v) for _ in range(r.randrange(260))) for _ in range(150)]
    texts += [None, "", " \n ", "Ja " * 40, "ja Ja " * 9, "a\tb\nc  " * 8 + "é", " ".join(v * 9), "x " * 3000 + " ".join(v * 30) * 5, "no repeats here at all"]
    rows = [(i * 7, t, "en", "s", 0) for i, t in enumerate(texts)] + [(14, texts[2], None, None, None)] * 2 + [(None, "u v " * 9, "en", "s", 0)]
    d = spark.createDataFrame(rows, DOCS).withColumn("runs", F.lit("clash"))

    def brute(i, text):
        w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        gone = {k for s, n_, q in runs for k in range(s + q, s + n_)}
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        told = "".join(f"{s},{n_},{q}\n" for s, n_, q in runs)
        tail = [*best, 1000 * best[1] // best[2]] if best else [None] * 4
        return [i, len(runs), *tail, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()]

    from llm import queries

    was = queries.table
    queries.table = lambda *a: d
    try:
        got = [list(x) for x in QUERIES["op13_periodic_runs"](spark, "").collect()]
    finally:
        queries.table = was
    assert sorted(map(repr, got)) == sorted(repr(brute(i, t)) for i, t, *_ in rows)
    assert sum(x[1] for x in got) >= 10
    from llm.periodic_runs import periodic_runs

    assert periodic_runs(d.limit(0)).count() == 0
    kept = periodic_runs(d, ("doc_id", "text")).where("doc_id = 1064").first()
    assert kept["n_words"] == 0 or kept["collapsed"]


def test_op9_head_counts_all_training_documents(spark):
    """A word of each document and one of all: the head has those of every training document, the common one first."""
    from llm import kernel, lm_score

    d = lm_score._prepared(spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common w"), "id").alias("text")))
    head = lm_score.head_words(d)
    assert len(head) == d.where("train").count() + 1
    assert head[0] == next(iter(kernel.words(pa.array(["common"])))).hashes[0]


def test_jaccard_passages_connect_no_candidates(spark, monkeypatch):
    """Documents that share passages with their neighbours, each less than a link needs, are no candidates, however long the
    chain; the sample that orders shingles first sees almost nothing here, as it does of a large table."""
    from llm import jaccard_join

    tables = {}
    keep = jaccard_join.stored

    def stored(df, tag):
        tables[tag] = keep(df, tag)
        return tables[tag]

    monkeypatch.setattr(jaccard_join, "stored", stored)
    monkeypatch.setattr(jaccard_join, "SAMPLE_DOCS", 1)
    passage = lambda i: [f"p{i % 60}_{k}" for k in range(44)]
    docs = [(i, " ".join(passage(i) + [f"u{i}_{k}" for k in range(112)] + passage(i + 1))) for i in range(60)]
    near = [f"n{k}" for k in range(200)]
    docs += [(100, " ".join(near)), (101, " ".join([*near[:-4], "a", "b", "c", "d"])), (102, " ".join(near[:100] + [f"x{k}" for k in range(100)]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: 100 if i == 101 else i for i, _ in docs}
    assert tables["viable"].count() > 30  # by their prefixes they might
    assert {r["node"] for r in tables["groups"].collect()} == {100, 101}
