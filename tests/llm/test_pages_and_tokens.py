"""HTML extraction, URL filters, WARC, tokens, sharding and decontamination."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from conftest import pairs
from pyspark.sql import functions as F
from tapeworks.llm import op2_html_extraction as op2
from tapeworks.llm.op2_html_extraction import extract_texts, forest, labelled_layouts, page_texts, parse
from tapeworks.llm.op5_url_filters import filter_urls, gram_ratios, grams, op5_url_filters
from tapeworks.llm.op6_warc import read_warc, write_warc
from tapeworks.llm.op8_sentencepiece import (
    MARK, MODEL, Pieces, _marked, combined, decode_ids, encode_texts, op8_sentencepiece,
)
from tapeworks.llm.op9_sharding import op9_sharding, shard_rows, text_keys
from tapeworks.llm.op10_decontamination import decontaminate, is_contaminated, window_hits
from tapeworks.llm.queries import QUERIES, SQL
from tapeworks.llm.shared import table
from tapeworks.session import scratch_path


@pytest.fixture(scope="module")
def odd_pages(spark):
    html = "<p>" + "word " * 400 + "</p>"
    rows = [
        (0, None, None), (1, "", ""), (2, "no scheme", html), (3, "http://A.Example.org/en/1x?q#f", html),
        (4, "http://example.org/es/2", html), (5, "https://x.org", "<p>short"), (6, "https://x.org?a/b", "<p>short"),
        (7, "http://b.example.com/fr/é", "plain & <b>bold"), (8, "http://com/de/", html * 50), (None, "http://q.net/", html),
        (3, "http://A.Example.org/en/1x?q#f", html),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "path", "rest", "rule", "text", "high", "shard", "_row", "gram", "digest"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


@pytest.fixture(scope="module")
def extractor(spark, sf_dir):
    return op2.fit_extractor(table(spark, sf_dir, "pages"))


def test_layouts_kept_out_of_the_fit(extractor):
    trees = [parse(page) for page in labelled_layouts(150, seed=77)]
    f, labels = forest(trees), np.concatenate([op2._labels(tree) for tree in trees])
    marginal, pair = extractor.beliefs(f)
    assert ((marginal[f.leaves] >= 0.5) == labels[f.leaves]).mean() > 0.98
    assert np.allclose(pair.sum(axis=(1, 2)), 1)


def test_fit_takes_pages_with_telling_markup(spark, monkeypatch):
    plain = ["<p>a", "<article>a</article><article>b</article>", "<!-- <main> --><p>a", "<script>'<article>'</script>a", None]
    telling = [
        "<article>a", "<ARTICLE class=x>a</ARTICLE><!-- <article> -->", "<main>a</main><noscript><main></noscript>",
        "<main/>a<articles>", "<article>a</article><article>b</article><main>c", "<script src=x/></script><article\n>a",
    ]
    rows = [(i, plain[i % len(plain)]) for i in range(200)] + [(1000 + i, html) for i, html in enumerate(telling)]
    pages = spark.createDataFrame([*rows, (2000, "<main>" + "long " * 100)], "page_id long, html string")
    for html in telling + [h or "" for h in plain]:
        assert (op2._markup_labels(parse(html)) is not None) == (html in telling)
    monkeypatch.setattr(op2, "fit_model", lambda f, labels: int(f.page.max()) + 1)
    fit = lambda **options: op2.fit_extractor(pages, layouts=2, **options) - 2
    assert [fit(max_pages=3), fit(max_pages=10), fit(max_pages=10, max_chars=300)] == [3, len(telling) + 1, len(telling)]


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(2)
    f = forest([parse("<body><nav><p>a b</p></nav><div class=ad>c</div><p>d e f")])
    model = op2.Model(rng.normal(size=len(op2.NAMES)), rng.normal(size=(len(op2.KINDS), 2, 2)))
    own = np.add.reduceat(model.unary[f.features], f.offsets[:-1])
    n = len(f.parent)
    total, content = 0.0, np.zeros(n)
    for mask in range(1 << n):
        y = [(mask >> i) & 1 for i in range(n)]
        weight = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(
            model.pair[f.kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0
        ))
        total += weight
        content += weight * np.array(y)
    assert np.allclose(model.beliefs(f)[0], content / total)


def test_articles_of_the_table(spark, sf_dir, extractor):
    pages = table(spark, sf_dir, "pages")
    htmls = {r["page_id"]: r["html"] for r in pages.collect()}
    import html as markup

    for r in extract_texts(pages, extractor, ["page_id"]).collect():
        body = htmls[r["page_id"]].partition("<article>")[2].partition("</article>")[0]
        blocks = (re.sub(r"</?b>|<br>", " ", b) for b in re.split(r"</?(?:p|h1)>", body))
        want = "\n".join(t for t in (" ".join(markup.unescape(b).split()) for b in blocks) if t)
        assert r["text"] == want


def test_broken_markup_and_odd_pages(spark, odd_pages, extractor):
    assert page_texts(extractor, [None, "", "<", "<p", "</div></div>", "<!-- x", "<script>a", "&amp"])[:2] == ["", ""]
    odd = ["<p>a <![x] b</p>", "<p>x <![ y</p>", "<![İf x]>a", "<p>a &#" + "1" * 5000 + "; b", "&#" + "0" * 5000 + "65;"]
    assert [[t for t in parse(html).text if t] for html in odd] == [["a"], ["x"], ["a"], ["a \ufffd b"], ["A"]]
    assert len(page_texts(extractor, odd)) == len(odd)
    deep = "<div>" * 3000 + "text"
    assert len(page_texts(extractor, [deep, "<p>" * 5000])) == 2
    out = extract_texts(odd_pages, extractor, ["page_id", "url"])
    assert out.count() == odd_pages.count() and out.where("text is null").count() == 0
    assert extract_texts(odd_pages.where("false"), extractor, ["page_id"]).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "text" + "</div>" * 100_000, "<div>text</unknown>" * 100_000])
def test_nesting_takes_linear_time(page):
    start = time.process_time()
    tree = parse(page)
    assert len(tree.tag) > 100_000 and time.process_time() - start < 60  # minutes where each tag searches what is open


@pytest.mark.parametrize(("html", "want"), [
    ("<p>a</p><svg viewBox='0 0 1 1'/><p>b</p><math/><p>c</p>", ["a", "b", "c"]),
    ("<p>a <svg><g/><svg/><text>no</text></svg> b</p>", ["a b"]),
    ("<head><title>T</title><p>a</p><p>b", ["a", "b"]),
    ("<head><meta charset=utf-8><title>T</title><link rel=x>a<p>b", ["a", "b"]),
    ("<head><title>T</head><body><p>a</p>", ["a"]),
    ("<html><head><title>T</title><style>no</style><noscript><img></noscript></head><body>a", ["a"]),
    ("<div><noscript>no</div><p>a</p><noscript><p>no</p></noscript>b", ["a", "b"]),
    ("<div><object data=x>no</div>a", ["a"]), ("<p>a</p><object data=x />b<p>c", ["a", "b", "c"]),
    ("<form><select><option>no<option>no</form><p>a", ["a"]), ("<body><select><option>no<p>a</body>", ["a"]),
    ("<p><a href=x><svg><path></a>a</p><p>b", ["a", "b"]), ("<svg><path><span>a</span><p>b", ["a", "b"]),
    ("<svg><foreignObject><p>no</p></foreignObject></svg><p>a", ["a"]),
    ("<iframe src=x /><p>a</p><iframe src=y><p>no</p></iframe>b", ["a", "b"]), ("<script src=x /><p>a", ["a"]),
    ("<title>the <script> element</title><p>a", ["a"]), ("<textarea><style></textarea><p>a", ["a"]),
    ("<script>if (a<b) '<svg><title>'</script ><p>a</p><script>'</svg>'</script>b", ["a", "b"]),
    ("<!-- <svg> --><p>a</p><svg><!-- </svg> --><p>no</p></svg>b", ["a", "b"]),
    ("<object><object><p>no</p></object><p>no</p></object><p>a", ["a"]), ("<div title='<svg>'>a</div>", ["a"]),
    ("a & b <svg/> c &am", ["a & b c &am"]),
])
def test_silent_elements_hide_no_more_than_themselves(html, want):
    assert [text for text in parse(html).text if text] == want


def test_rules_of_odd_urls(odd_pages):
    rows = filter_urls(odd_pages).collect()
    got = {(r["page_id"], r["host"], r["path"], r["rule"]) for r in rows}
    assert len(rows) == odd_pages.count()
    assert got == {
        (0, "", "", None), (1, "", "", None), (2, "", "", None), (3, "a.example.org", "/en/1x", "example.org/en/1"),
        (4, "example.org", "/es/2", "example.org/es/"), (5, "x.org", "", None), (6, "x.org", "", None),
        (7, "b.example.com", "/fr/é", "com/fr/"), (8, "com", "/de/", "com/de/"), (None, "q.net", "/", None),
    }
    assert {r["verdict"] for r in rows if r["rule"] == "com/de/"} == {"block"}
    assert filter_urls(odd_pages.where("false")).count() == 0


def test_url_verdicts_follow_the_labelled_urls(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        good = rng.random() < 0.5
        word = "".join(rng.choice("abcde" if good else "vwxyz") for _ in range(8))
        known = rng.random() < 0.6
        host = f"{word}.{'org' if good else 'com'}" if known else f"{word}.net"
        rows.append((i, f"http://{host}/{'a' if good else 'de/x'}", good))
    found = filter_urls(spark.createDataFrame(rows, "page_id long, url string, good boolean"))
    verdict = {r["page_id"]: r for r in found.collect()}
    judged = [(verdict[i]["verdict"] == "allow") == good for i, _, good in rows if verdict[i]["rule"] is None]
    assert sum(judged) > 0.95 * len(judged)


def test_gram_probabilities_add_up(spark):
    frame = spark.createDataFrame([("abcab", 1, 0), ("abd", 0, 1), ("bcd", 1, 0)], "rest string, a int, b int")
    counts = grams(frame).groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ratios = {r["gram"]: r["ratio"] for r in gram_ratios(counts).collect()}
    assert ratios["^^^a"] > ratios["^abd"] and all(np.isfinite(v) for v in ratios.values())


def test_url_query_keeps_all_rows(spark, sf_dir):
    rows = op5_url_filters(spark, sf_dir).collect()
    assert len(rows) == table(spark, sf_dir, "pages").count() and {r["verdict"] for r in rows} == {"allow", "block"}


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 4000, "roll_bytes": 300}])
def test_warc_round_trip(spark, odd_pages, sizes):
    folder = scratch_path(spark, "warc-test")
    manifest = [r.asDict() for r in write_warc(odd_pages, folder, **sizes).collect()]
    back = read_warc(spark, folder).collect()
    texts = {}
    for r in odd_pages.collect():
        texts.setdefault(r["page_id"], (r["html"] or "").encode())
    assert len(back) == odd_pages.count() == sum(m["records"] for m in manifest)
    top = {}
    for key, payload in texts.items():
        if key is not None:
            top[payload] = max(top.get(payload, key), key)
    for r in back:
        payload = texts[r["page_id"]]
        again = r["page_id"] is not None and len(payload) >= 1000 and top[payload] != r["page_id"]
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha1(payload).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", top[payload]) if again else ("response", None))
        assert r["payload"] is None if again else bytes(r["payload"]) == payload
    other = scratch_path(spark, "warc-test")
    again = [r.asDict() for r in write_warc(odd_pages.repartition(5), other, **sizes).collect()]
    key = lambda m: (m["shard"], m["seq"])
    assert sorted(manifest, key=key) == sorted(again, key=key)
    if sizes:
        assert len(manifest) > 3


def test_warc_of_no_pages(spark, odd_pages):
    folder = scratch_path(spark, "warc-test")
    assert write_warc(odd_pages.where("false"), folder).count() == 0 and read_warc(spark, folder).count() == 0


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def pieces():
    with open(MODEL, "rb") as file:
        return Pieces(file.read())


def _ids(data):
    return np.frombuffer(data, "<i4").tolist()


def test_merge_scan_and_chunks_are_the_library_encoding(pieces, library):
    rng = random.Random(1)
    parts = ["a", "b", "é", "e", "th", "in", " ", "  ", "\n", "中", "\t", "the ", MARK, "   ", "😀", "ing", "0", ".", "\x00", "ß"]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        marked, want = _marked(text), library.encode(text)
        assert _ids(pieces.encode(marked)) == want
        if not marked:
            continue
        assert _ids(pieces.packed(pieces.trace(pieces.scan(marked, 0, "", len(marked)), 0, len(marked)))) == want
        size, near, rows, matrices = rng.choice([3, 7, 17, 40]), pieces.longest, [], []
        for i, start in enumerate(range(0, len(marked), size)):
            stop, low = min(len(marked), start + size), max(0, start - near)
            rows.append((marked[low : stop + near], start - low, stop - low))
            matrices.append(pieces.transfer(*rows[-1], i == 0))
        path = combined(matrices)
        assert _ids(b"".join(pieces.between(*r, a, b) for r, (a, b) in zip(rows, path, strict=True))) == want
        assert MARK in text or pieces.decode(pieces.encode(marked))[1:] == text


def test_long_texts_without_spaces(pieces, library):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghinorst") for _ in range(3000))
    assert _ids(pieces.encode(_marked(text))) == library.encode(text)


def test_giants_and_odd_rows(odd_docs, no_docs, library):
    for options in ({}, {"giant": 40, "chunk": 25}):
        rows = encode_texts(odd_docs.withColumn("doc_text", F.col("text")), ["doc_id", "doc_text"], **options).collect()
        assert len(rows) == odd_docs.count() and all(r["round_trip"] for r in rows)
        assert all(r["token_ids"] == library.encode(r["doc_text"] or "") for r in rows)
    assert encode_texts(no_docs, ["doc_id"]).count() == 0
    back = decode_ids(encode_texts(odd_docs, ["doc_id", "text"])).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)


def test_token_query(spark, sf_dir):
    assert op8_sentencepiece(spark, sf_dir).where("round_trip").count() == table(spark, sf_dir, "documents").count()


def test_shards_are_even_and_gapless(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = op9_sharding(spark, sf_dir).collect()
    sizes, slots = {}, {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == 1000 and set(sizes) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)


def test_hot_copies_are_cut_between_ids(spark):
    frame = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "copy").otherwise(F.col("id").cast("string")).alias("text")
    )
    rows = shard_rows(text_keys(frame), 10, bins=8, most_rows=100).collect()
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(10)]
    assert max(sizes) - min(sizes) <= 40 and len({(r["shard"], r["slot"]) for r in rows}) == 3000
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [(r["high"], r["low"]) for r in order] == sorted((r["high"], r["low"]) for r in rows)


def test_groups_up_to_a_shard_stay_whole(spark):
    # groups of 0.2, 0.4, 0.6 and 0.9 shards, one of two and a half shards, and single rows
    groups = {"a": 400, "b": 600, "c": 900, "d": 2500, "e": 200, "f": 600}
    texts = [name * 10 for name, n in groups.items() for _ in range(n)] + [f"{i:010d}" for i in range(4800)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({}, {"bins": 8, "most_rows": 100}):
        rows = shard_rows(text_keys(frame), 10, **options).join(frame, "doc_id").collect()
        shards, sizes = {}, [0] * 10
        for r in rows:
            shards.setdefault(r["text"], set()).add(r["shard"])
            sizes[r["shard"]] += r["size"]
        assert len(rows) == len(texts) == len({(r["shard"], r["slot"]) for r in rows})
        assert all(len(found) == 1 for text, found in shards.items() if text != "d" * 10)
        assert max(sizes) - min(sizes) <= 3 * 26
        assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s] // 26)) for s in range(10))


def test_no_group_of_the_table_is_cut(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = op9_sharding(spark, sf_dir).join(docs, "doc_id")
    found = rows.groupBy("text").agg(F.count_distinct("shard").alias("n"), F.sum("size").alias("bytes"))
    loads = [r[0] for r in rows.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert found.where(f"n > 1 and bytes <= {sum(loads) / 40}").count() == 0
    assert max(loads) - min(loads) <= 0.01 * sum(loads) / 40 + docs.agg(F.max(F.octet_length("text"))).first()[0]


def test_odd_rows_of_the_shards(odd_docs, no_docs):
    rows = shard_rows(text_keys(odd_docs), 5).collect()
    assert len(rows) == odd_docs.count() == len({(r["shard"], r["slot"]) for r in rows})
    assert shard_rows(text_keys(no_docs), 5).count() == 0


def _brute_hits(docs, items, width=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: word.findall((t or "").translate(lower))
    windows = [(k, tuple(w[i : i + min(width, len(w))])) for k, t in items for w in [cut(t)] if w
               for i in range(len(w) - min(width, len(w)) + 1)]
    for key, text in docs:
        own, hit, found = cut(text), set(), set()
        for item, window in windows:
            for i in range(len(own) - len(window) + 1):
                if tuple(own[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    if item is not None:
                        found.add(str(item))
        yield str(key), len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [48 << 20, 2000])
def test_hits_against_brute_force(spark, block_bytes):
    rng = random.Random(9)
    vocabulary = ["aa", "b", "Cc", "É", "é", "d1", "e", "f", "g_h", "ÉA", "K"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 9, 14, 20])))) for i in range(14)]
    items += [(None, "only nameless here"), (90, None), (91, " . "), items[0], (92, items[3][1].lower())]
    docs = []
    for i in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        at = rng.randint(0, len(own))
        own[at:at] = (rng.choice(items)[1] or "").split() if rng.random() < 0.6 else []
        docs.append((i, rng.choice([" ", ", "]).join(own)))
    docs += [(None, docs[0][1]), (None, None), docs[1], docs[1]]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_row", F.monotonically_increasing_id())
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("x"))
    got = window_hits(frame, bench, ["_row", "doc_id"], block_bytes=block_bytes).collect()
    rows = [(str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got]
    assert sorted(rows) == sorted(_brute_hits(docs, items))
    dirty = window_hits(frame, bench, ["doc_id", "text"]).where(is_contaminated())
    kept = decontaminate(frame.drop("_row"), bench)
    assert set(pairs(kept)) == set(docs) - set(pairs(dirty))


def test_odd_rows_of_the_decontamination(spark, odd_docs, no_docs, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    for b in (bench, bench.where("false")):
        assert decontaminate(odd_docs, b).columns == odd_docs.columns
        assert decontaminate(odd_docs, b).count() == odd_docs.count() and decontaminate(no_docs, b).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_give_the_rows_of_their_sql(spark, sf_dir, name):
    from compare import connect, differences

    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) == []
