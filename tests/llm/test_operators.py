"""The operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quireworks.llm import chat, common, decontam, dedup, graph, html_extract, lm_score, ngram_join, packing, pii, toxicity, warc
from quireworks.llm.queries import tokenizer_path

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # columns whose names an operator might use itself
    return df.withColumns({"digest": F.lit("x"), "unit": F.lit(1), "kept": F.lit(True), "score": F.lit(2.0)}) if extra else df


EDGE = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (6, "one two three four five six"), (6, "one two three four five six"), (None, "no id"), (7, "x" * 300_000), (8, "ab " * 60_000)]


@pytest.fixture(scope="module")
def edge(spark):
    return docs_of(spark, EDGE)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


# --- exact dedup ---


def test_exact_dedup_against_brute_force(spark, edge, empty):
    got = {(r.doc_id, r.text_sha256): r for r in dedup.exact_dedup(edge).collect()}
    groups = {}
    for i, t in {(i, t) for i, t in EDGE}:
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
        groups.setdefault(digest, []).append(i)
    assert len(got) == sum(map(len, groups.values()))
    for digest, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            r = got[i, digest]
            assert r.keep_id == (min(known) if known else None) and r.group_size == len(ids) and r.kept == (i == r.keep_id)
    assert got[6, hashlib.sha256(b"one two three four five six").hexdigest()].n_rows == 2
    assert dedup.exact_dedup(empty).count() == 0


def test_index_takes_batches(spark):
    path = common.new_path(spark, "index-test")
    first = dedup.DigestIndex(spark, path, 4).add(docs_of(spark, [(10, "a b"), (11, "c")]))
    assert first.where("kept").count() == 2
    again = dedup.DigestIndex(spark, path, 4).add(docs_of(spark, [(1, "a  b"), (2, "d"), (3, "d")]))
    assert {(r.doc_id, r.keep_id, r.kept) for r in again.collect()} == {(1, 10, False), (2, 2, True), (3, 2, False)}
    assert dedup.DigestIndex(spark, path, 4).digests().count() == 3
    # the index is read in its buckets: only the new side of the join is shuffled
    fresh = spark.range(1000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    joined = fresh.join(dedup.DigestIndex(spark, path, 4).digests().hint("merge"), "digest", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_index_in_another_session(spark):
    """The bucket count is the index's own: another session with other shuffle partitions finds every digest."""
    path = common.new_path(spark, "index-test")
    docs = docs_of(spark, [(i, f"text {i}") for i in range(200)])
    first = {r.doc_id: r for r in dedup.DigestIndex(spark, path, 8).add(docs).collect()}
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "3")
    other.sql(f"DROP TABLE IF EXISTS {dedup.DigestIndex(spark, path).table}")  # as where the catalog does not outlive a session
    index = dedup.DigestIndex(other, path)
    assert index.buckets == 8
    later = other.createDataFrame([(1000 + i, f"text  {i}") for i in range(200)], "doc_id long, text string")
    assert index.add(later).where("kept").count() == 0 and index.digests().count() == 200
    # a batch that is added again appends nothing and gets the same answer
    assert {r.doc_id: r for r in dedup.DigestIndex(spark, path).add(docs).collect()} == first and index.digests().count() == 200
    with pytest.raises(ValueError):
        dedup.DigestIndex(spark, path, 3)
    index.drop()


def test_index_is_read_sorted(spark):
    """Segments are joined without a sort or a shuffle of theirs, small batches rewrite no large one, full buckets double."""
    path = common.new_path(spark, "index-test")
    index = dedup.DigestIndex(spark, path, 4)
    index.add(docs_of(spark, [(i, f"text {i}") for i in range(400)]))
    large = index.segments[0]
    index.add(docs_of(spark, [(1000 + i, f"text {390 + i}") for i in range(20)]))
    assert index.segments[0] == large and [s["rows"] for s in index.segments] == [400, 10]
    joined = spark.range(1000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    with index.in_order():
        for segment in index.segments:
            joined = joined.join(index._open(segment).select("digest").hint("merge"), "digest", "left_anti")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1
    index.add(docs_of(spark, [(2000 + i, f"text {410 + i}") for i in range(200)]))
    assert [s["rows"] for s in index.segments] == [610] and index.digests().distinct().count() == 610
    grown = dedup.DigestIndex(spark, path, 4, per_bucket=150)
    answer = grown.add(docs_of(spark, [(3000, "text 5"), (3001, "new"), (3002, "new")]))
    assert {(r.doc_id, r.keep_id, r.group_size) for r in answer.collect()} == {(3000, 5, 1), (3001, 3001, 2), (3002, 3001, 2)}
    assert grown.buckets == 8 and dedup.DigestIndex(spark, path, 4).digests().count() == 611
    again = dedup.DigestIndex(spark, path).add(docs_of(spark, [(i, f"text {i}") for i in range(610)]))
    # texts 400 to 609 first came under other ids
    assert again.where("keep_id <> doc_id").count() == 210 and again.where("group_size <> 1").count() == 0
    dedup.DigestIndex(spark, path).drop()


def test_columns_with_the_names_of_helpers(spark):
    names = ["__id", "__digest", "__sha", "sha", "kept_id", "kept_sha", "HIT", "dropped_id", "Score", "__score", "__drop", "__hit"]
    df = spark.createDataFrame([(1, "a b c", 7), (2, "a  b c", 8), (3, "d", 9)], "doc_id long, text string, n int").withColumns({c: F.col("n") for c in names})
    labels, bench = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    steps = [dedup.drop_copies, lambda d: toxicity.drop_toxic(d, labels), ngram_join.one_per_class, lambda d: decontam.drop_contaminated(d, bench)]
    for step in steps:
        out = step(df)
        assert out.columns == df.columns and all(set(r[2:]) == {r[0] + 6} for r in out.collect())


def test_drop_copies_keeps_columns(spark, edge):
    kept = dedup.drop_copies(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 6, 7, 8]


# --- web pages ---

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var a="</p><article>no</article>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- c --><div class="cookie-notice">We use cookies</div>
<article><h1>{title}</h1><p>First <b>bold</b>tail &amp; &eacute;&#8364;<p>Second<br>line {n}<ul><li>one<li>two</ul>
<div class="ad">Buy now</div><aside>More</aside><form><label>Mail</label><input></form><div class="share">Share this</div><blockquote>Said {n}</blockquote>
<section id="comments"><p>Nice!</p></section></article><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, "http://h.org/%d" % i, PAGE.format(title=f"Title {i}", n=i)) for i in range(12)]
    rows += [(100, "http://h.org/x", None), (101, None, ""), (102, "no url", "<p>Only <i>this</i></p>"), (103, "http://solo.net/", "<div><div class='menu'>M</div><div><p>Long text stands here, as the body of it.</p></div></div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("x")).withColumn("host", F.lit(1))
    got = {r.page_id: r for r in html_extract.main_text(df).collect()}
    for i in range(12):
        assert got[i].text == f"Title {i} First boldtail & é€ Second line {i} one two Said {i}"
        assert got[i].n_chars == len(got[i].text) and got[i].url == f"http://h.org/{i}"
    assert got[100].text == "" and got[101].text == "" and got[102].text == "Only this" and got[103].text.startswith("Long text") and len(got) == 16
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_pages_table(spark, sf):
    """The article of every page of the table, by a pattern that only fits their template."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body)).split())


def test_wrappers_find_repeats_and_optionals():
    one = html_extract.wrapper_of(html_extract.parse("<ul><li>a</li><li>b</li></ul><p>x</p>")[2])
    two = html_extract.wrapper_of(html_extract.parse("<ul><li>c</li></ul><h2>t</h2><p>x</p>")[2])
    both = html_extract.align(one, two)
    shape = [(q, n[1]) for q, n in both]
    assert shape == [("1", "ul"), ("?", "h2"), ("1", "p")]
    assert both[0][1][3][0][0] == "+" and both[0][1][3][0][1][3][0][1][1] is None  # li repeats, its text is a slot
    assert both[2][1][3][0][1][1] == "x"  # the same on both pages: fixed text
    # what changes places becomes a repeated group, and the wrapper stays as long as there are kinds of elements
    rng = random.Random(5)
    kinds = [[rng.choice(["p", "h2", "ul", "pre"]) for _ in range(30)] + ["p", "h2", "ul", "pre", "p"] for _ in range(40)]
    pages = ["".join(f"<{k}>x</{k}>" for k in page) for page in kinds]
    whole = html_extract.wrapper_of(html_extract.parse(pages[0])[2])
    for page in pages[1:]:
        whole = html_extract.align(whole, html_extract.wrapper_of(html_extract.parse(page)[2]))
    assert [(q, n[0]) for q, n in whole] == [("*", "g")] and len(whole[0][1][1]) == 4


@pytest.mark.parametrize("copies", [1, 5, 50])
def test_copies_of_a_page_change_nothing(spark, copies):
    page = "<body><nav>Menu</nav><article><div class='lead'>Lead text</div><p>Body</p><section>More</section></article></body>"
    df = spark.createDataFrame([(i, "http://h.org/a", page) for i in range(copies)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.main_text(df).collect()} == {"Lead text Body More"}


def test_hosts_without_article(spark):
    """The wrapper alone shows the main region: where the text differs from page to page, with the page's heading."""
    rng = random.Random(21)
    rows, want = [], {}
    for i in range(30):
        title, body = f"Title {i}", [prose(rng, 20) for _ in range(rng.randrange(1, 4))]
        promo = "<div class='box'>Read our other sites, all of which are very good and quite long to name here.</div>" if i % 2 else ""
        main = f"<div class='content'><h1>{title}</h1><div class='text'>{''.join(f'<p>{b}</p>' for b in body)}</div></div>"
        rows.append((i, "http://plain.org/%d" % i, f"<body class='has-sidebar'><div class='top'>Plain Org</div>{promo}{main}<div class='box'>All rights are ours</div></body>"))
        want[i] = " ".join([title, *body])
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == want


def test_names_in_an_article():
    page = (
        "<body class='single no-sidebar'><article class='post header-fixed'><h2 id='related-work'>W</h2><div class='side-effects'>Drug</div>"
        "<p id='search-algorithms'>P</p><div class='search-results'>R</div><div class='ad-slot-1'>x</div><div id='sideBar'>x</div>"
        "<div class='cookie-notice'>x</div><section id='comments'><p>x</p></section>a<span class='ad'>x<span>x</span>x</span>b</article></body>"
    )
    assert html_extract.page_text(page, None) == "W Drug P R ab"


def test_deep_and_broken_pages():
    deep = "<div>" * 5000 + "text" + "</div>" * 3
    assert html_extract.page_text(deep, None) == "text"
    for n in (120, 200, 3000):
        assert html_extract.page_text("<div>" * n + "<nav>MENU</nav>main" + "</div>" * n, None) == "main"
    wide = "<div>" + "".join(f"<h2>{i}</h2><p>a</p><p>b</p>" for i in range(20_000)) + "</div>"
    assert html_extract.page_text(wide, None) == " ".join(f"{i} a b" for i in range(20_000))
    assert len(html_extract.align(html_extract.wrapper_of(html_extract.parse(wide)[2]), html_extract.wrapper_of(html_extract.parse(wide + wide)[2]))) == 1
    assert html_extract.page_text("<p>a < b & c &unknown; <b", None).startswith("a < b & c")


# --- chat ---


def test_chat_round_trip():
    rng = random.Random(3)
    signs = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "a", "\n", "é", "<\\s>", "[\\\\INST]"]
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "a]<s>"]), "".join(rng.choice(signs) for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(5))]
        text, mask = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescaped(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_fold_of_events(spark):
    log = [
        (1, 1, "m1", "message", "user", "hi"), (1, 2, "m2", "delta", "assistant", "he"), (1, 3, "m2", "delta", "assistant", "llo"), (1, 4, "m3", "message", "user", "later"),
        (1, 5, "m1", "edit", "user", "hi!"), (1, 6, "m2", "regenerate", "assistant", "A"), (1, 7, "m2", "delta", "assistant", "B"), (1, 8, "m4", "message", None, None),
        (2, 1, None, None, "assistant", "x"), (None, 1, "m", "delta", "user", "q"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message_id string, kind string, role string, text string").withColumn("mask", F.lit(0))
    got = {r.conv_id: (chat.parse(r.formatted), [r.formatted[m.start : m.end] for m in r["mask"]]) for r in chat.reconstruct(events).collect()}
    assert got[1] == ([("user", "hi!"), ("assistant", "AB"), ("", "")], ["AB"])
    assert got[2] == ([("assistant", "x")], ["x"]) and got[None][0] == [("user", "q")]
    assert chat.reconstruct(events.limit(0)).count() == 0


def test_conversations_read_back(spark):
    rows = [(5, 2, "assistant", "b" * 200_000), (5, 1, "user", None), (5, 1, "user", None), (6, 1, None, "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = {r.conv_id: r for r in chat.read_back(chat.reconstruct(chat.as_events(df))).collect()}
    assert got[5].n_turns == 3 and got[5].loss_chars == 200_000
    assert got[5].turns_sha256 == hashlib.sha256(("user\n\n" * 2 + "assistant\n" + "b" * 200_000 + "\n").encode()).hexdigest()
    assert got[6].turns_sha256 == hashlib.sha256(b"\n</s>[INST] ok [/INST]\n").hexdigest() and got[6].loss_sha256 == hashlib.sha256(b"").hexdigest()


# --- near duplicates ---


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute_links(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in links[a]:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return links, {i: find(i) for i in ids}


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # so that the larger groups are compared in blocks
    rng = random.Random(11)
    rows, n = [], 0
    for g in range(25):
        base = prose(rng, rng.randrange(60, 200)).split()
        for _ in range(rng.choice([1, 2, 3, 30])):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n + 1, rows[0][1].upper()), (n + 2, "a b"), (n + 3, "A  b"), (n + 4, "a b c"), (n + 5, ""), (n + 6, None), (n + 7, None), (n + 8, "ab " * 30_000), (n + 9, "ab " * 30_001)]
    df = docs_of(spark, rows).repartition(7)
    got = {r.doc_id: r for r in ngram_join.near_duplicates(df).collect()}
    links, classes = brute_links(rows)
    assert set(got) == set(classes)
    sizes = {c: sum(1 for x in classes.values() if x == c) for c in classes.values()}
    for i in classes:
        assert (got[i].class_id, got[i].n_links, got[i].class_size) == (classes[i], len(links[i]), sizes[classes[i]]), i
    kept = {r.doc_id for r in ngram_join.one_per_class(df).collect()}
    assert kept == set(classes.values())


def test_repeated_rows_and_null_ids_link_once(spark):
    rng = random.Random(13)
    base = prose(rng, 80)
    rows = [(1, base), (1, base), (2, base + " more"), (2, base + " more"), (3, base.upper()), (None, base), (None, None), (4, None), (4, None)]
    got = sorted(((r.doc_id or 0, r.class_id or 0, r.n_links, r.class_size) for r in ngram_join.near_duplicates(docs_of(spark, rows)).collect()))
    assert got == [(0, 0, 0, 1), (0, 0, 0, 1), (1, 1, 2, 3), (2, 1, 2, 3), (3, 1, 2, 3), (4, 4, 0, 1)]


def test_chain_of_common_phrases(spark, monkeypatch):
    """Neighbours in a long chain share much text and few are near duplicates: links are exact, blocks stay few."""
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    rng = random.Random(17)
    words = prose(rng, 1500).split()
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(300)] + [(1000 + i, " ".join(words[9 * i : 9 * i + 90])) for i in range(120)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs_of(spark, rows).repartition(5)).collect()}
    links, classes = brute_links(rows)
    assert got == {i: (classes[i], len(links[i])) for i in classes}


def test_large_groups_form_no_pairs(spark, monkeypatch):
    """Texts of one common line, and very many near copies of one text: links are exact, texts compared in proportion."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    compared, stage = [], ngram_join.stage

    def counting(df, name):
        out, at = stage(df, name)
        if name == "links":
            compared.append(out.count())
        return out, at

    monkeypatch.setattr(ngram_join, "stage", counting)
    rng = random.Random(19)
    line, base, rows = prose(rng, 60), prose(rng, 400).split(), []
    for i in range(120):
        rows.append((i, line + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))))
        rows.append((1000 + i, " ".join([*base[: 3 * i], f"x{i}", *base[3 * i + 1 :]])))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs_of(spark, rows).repartition(5)).collect()}
    links, classes = brute_links(rows)
    assert got == {i: (classes[i], len(links[i])) for i in classes}
    assert {len(links[1000 + i]) for i in range(120)} == {119} and sum(compared) <= len(rows)


def test_near_duplicates_edges(spark, empty):
    assert ngram_join.near_duplicates(empty).count() == 0
    alone = docs_of(spark, [(1, None), (2, "")])
    assert {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(alone).collect()} == {(1, 1, 0), (2, 2, 0)}
    bands, rows = ngram_join.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL and bands * rows <= ngram_join.MAX_HASHES


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(90)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- toxicity ---


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        w, toxic = prose(rng, 60).split(), i % 6 == 0
        for _ in range(4 * toxic):
            w.insert(rng.randrange(60), rng.choice(["vilewort", "vilerisch", "nastyx", "foulness."]))
        rows.append((i, " ".join(w)))
        if i % 5 < 3:
            labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "vilewort"), (2002, "x" * 200_000)]
    df, lab = docs_of(spark, rows), spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, lab)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    hits = [r.predicted == (r.doc_id % 6 == 0) for r in held]
    assert sum(hits) / len(hits) > 0.97
    kept = {r.doc_id for r in toxicity.drop_toxic(df, lab).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_toxicity_ignores_held_out_labels(spark, empty):
    df = docs_of(spark, [(i, f"text {i} bad{i % 2}") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert (toxicity.fit(df, labels) == toxicity.fit(df, flipped)).all()
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    plain = toxicity.score(docs_of(spark, [(1, "nothing of note"), (2, None)]), toxicity.fit(empty, labels)).collect()
    assert len({r.score for r in plain}) == 1 and all(r.predicted == 0 for r in plain)


def test_risk_and_its_gradient():
    """The risk against its formula, and its gradient against differences of it, on both sides of the correction."""
    import numpy as np

    rng = np.random.default_rng(3)
    loss = lambda x, y: math.log(1 + math.exp(-y * x))
    seen = set()
    for shift in (-3.0, 0.0, 3.0):
        score, is_p, prior = rng.standard_normal(40) + shift, np.arange(40) < 12, 0.3
        score[is_p] += 4

        def parts(x):
            plus, minus = (sum(loss(v, y) for v in x[is_p]) / 12 for y in (1, -1))
            return 0.3 * plus, sum(loss(v, -1) for v in x[~is_p]) / 28 - 0.3 * minus

        whole, bracket = parts(score)
        risk, g = toxicity.pu_risk(score, is_p, prior)
        assert abs(risk - (whole + max(0.0, bracket))) < 1e-9
        seen.add(bracket >= 0)
        target = (lambda x: sum(parts(x))) if bracket >= 0 else (lambda x: -parts(x)[1])
        for i in range(40):
            up, down = score.copy(), score.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            assert abs((target(up) - target(down)) / 2e-5 - g[i]) < 1e-6
    assert seen == {True, False}


def test_posterior_crossing():
    """Where the posterior of two known densities reaches the level."""
    import numpy as np

    rng = np.random.default_rng(8)
    toxic, clean = rng.normal(2, 1, 30_000), rng.normal(-2, 1, 30_000)
    mixed = np.where(rng.random(30_000) < 0.2, rng.normal(2, 1, 30_000), clean)
    logit, positive = np.concatenate([toxic, mixed]), np.arange(60_000) < 30_000
    # log(0.2 / 0.8) + 4 x = log(0.7 / 0.3)
    assert abs(toxicity.crossing(logit, positive, 0.2, 0.7) - (math.log(0.7 / 0.3) + math.log(4)) / 4) < 0.15
    assert toxicity.crossing(np.zeros(4), np.array([True, True, False, False]), 0.2, 0.7) is None


def test_scores_against_plain_sums(spark):
    """Each score is the bias and the weights of the text's distinct features, added up one by one."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    weights = np.where(rng.random((1 << toxicity.BITS) + 1) < 0.3, rng.standard_normal((1 << toxicity.BITS) + 1), 0).astype(np.float32)
    weights[0] = -1.5
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["(Under)standing", "ab", "abcd", "abcde", "Häuser,", "x.", "--"]) + r.choice(["", "s", "!"]) for _ in range(r.randrange(12)))) for i in range(60)] + [(90, None)]
    for row in toxicity.score(docs_of(spark, rows), weights).collect():
        number = lambda w, k: 1 + ((int(common.string_hashes(pa.array([w]))[0]) * (2 * k + 1) % (1 << 64)) >> (40 - toxicity.BITS)) % (1 << toxicity.BITS)
        found = set()
        for word in (dict(rows)[row.doc_id] or "").lower().split():
            bare = word.strip(toxicity.EDGES)
            found |= {number(bare[:size] if size else bare, k) for k, size in enumerate((0, *toxicity.PREFIXES)) if len(bare) > size}
        total = float(weights[0]) + sum(float(weights[n]) for n in found)
        assert abs(row.score - 1 / (1 + math.exp(-total))) < 1e-9


# --- decontamination ---


def test_decontamination(spark, edge, empty):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randrange(15, 50))) for i in range(20)] + [(50, None), (51, ""), (52, "just three words"), (53, "seven words that stand on their own")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i, t in items[:20]:
        w = t.split()
        for k in range(3, len(w), 7):
            w[k] = "changed"
        rows.append((i, prose(rng, 40) + " " + (" ".join(w) if i % 2 else t.upper()) + " " + prose(rng, 30)))
    rows += [(100 + i, prose(rng, 150)) for i in range(40)] + [(200, "so seven words that stand on their own too"), (201, None), (202, "These are JUST three words here")]
    got = decontam.contaminated(docs_of(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(20)} | {(200, 53), (202, 52)}
    for r in got:
        if r.doc_id < 20:
            assert r.doc_start - r.item_start == 40 and r.identity >= 0.8
    kept = {r.doc_id for r in decontam.drop_contaminated(docs_of(spark, rows), bench).collect()}
    assert kept == {100 + i for i in range(40)} | {201}
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(edge, bench.limit(0)).count() == 0
    assert decontam.contaminated(edge, bench).count() == 0


def brute_overlaps(text, item, min_words=12, identity=0.8):
    """The most equal words of any overlap that passes, over every shift, start and end."""
    d, w, best = text.lower().split(), item.lower().split(), 0
    for shift in range(-len(w) + 1, len(d)):
        same = [0 <= k + shift < len(d) and d[k + shift] == w[k] for k in range(len(w))]
        for a in range(len(w)):
            m = 0
            for b in range(a, len(w)):
                if not 0 <= b + shift < len(d):
                    if b + shift >= len(d):
                        break
                    m = -10_000
                m += same[b]
                if m >= min(min_words, len(w)) and m >= identity * (b - a + 1):
                    best = max(best, m)
    return best


def test_overlaps_against_every_alignment(spark):
    rng = random.Random(31)
    items = [(i, " ".join(rng.choice(WORDS[:60]) for _ in range(rng.randrange(1, 26)))) for i in range(40)]
    rows = []
    for i in range(120):
        item = rng.choice(items)[1].split()
        a = rng.randrange(len(item))
        part = [w if rng.random() > rng.choice([0, 0.1, 0.25]) else "new" for w in item[rng.choice([0, a]) :]]
        rows.append((i, " ".join([rng.choice(WORDS[:60]) for _ in range(rng.randrange(12))] + part + [rng.choice(WORDS[:60]) for _ in range(rng.randrange(12))])))
    want = {(i, j): m for i, t in rows for j, x in items if (m := brute_overlaps(t, x))}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matches for r in decontam.contaminated(docs_of(spark, rows + rows[:5]).repartition(6), bench).collect()}
    # every overlap found is one; seeds find all that have the words, but for overlaps whose equal words lie too far apart
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and len(want) > 60
    assert all(got[k] <= want[k] for k in got)


@pytest.mark.parametrize(("words", "changed"), [(12, 0), (14, 2), (15, 3), (20, 4)])
def test_masks_bridge_every_placement(words, changed):
    from itertools import combinations

    for places in combinations(range(words), changed):
        same = [i not in places for i in range(words)]
        assert any(all(same[a + k] for k, bit in enumerate(mask) if bit == "1") for mask in decontam.MASKS for a in range(words - len(mask) + 1))


def test_benchmark_phrases_of_many_items(spark):
    """A phrase that many items and documents share: every pair is found, whatever the number."""
    phrase = "which of the following statements about the given passage is the most likely to be true"
    bench = spark.createDataFrame([(i, f"{phrase} w{i} end") for i in range(150)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x{i} {phrase} y{i}") for i in range(200)], "doc_id long, text string")
    assert decontam.contaminated(docs, bench).count() == 150 * 200


# --- WARC ---


def test_warc(spark, tmp_path):
    rows = [(i, f"https://{'ab'[i % 2]}.Example.org:80/p/{i}?q=1#f", f"<p>page {i % 7} é</p>") for i in range(60)] + [(100, None, None), (101, "", ""), (102, "http://[bad/", "x" * 100_000), (103, "http://x/\r\nInjected: 1", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    archive = warc.Archive.write(df.repartition(5), str(tmp_path / "w"), block_lines=7)
    got = {r.page_id: r for r in archive.records().collect()}
    assert set(got) == {r[0] for r in rows}
    last = {}
    for i, _, t in rows:
        last[t or ""] = max(i, last.get(t or "", -1))
    for i, _, t in rows:
        payload, r = (t or "").encode(), got[i]
        assert r.payload_bytes == len(payload) and r.payload_digest == warc._sha1(payload)
        assert (r.record_type, r.refers_to) == (("response", None) if last[t or ""] == i else ("revisit", last[t or ""]))
    found = archive.lookup(["http://A.example.org/p/4?q=1", "http://nowhere.org/"]).collect()
    assert [r.page_id for r in found] == [4]
    assert archive.records(archive.lookup(["https://a.example.org/p/4?q=1"])).first().page_id == 4
    blocks = archive.directory.orderBy("first_key").collect()
    assert len(blocks) > 3 and all(a.last_key <= b.first_key for a, b in zip(blocks, blocks[1:], strict=False))
    assert warc.url_key("http://www.Example.com/a?b") == "com,example,www)/a?b"
    assert warc.Archive.write(df.limit(0), str(tmp_path / "e")).records().count() == 0
    everything = archive.records(archive.lookup(df.select("url"))).collect()
    assert sorted(map(str, everything)) == sorted(map(str, got.values()))
    small = warc.Archive.write(df, str(tmp_path / "s"), min_revisit_bytes=1).records()
    assert {r.record_type for r in small.where("page_id in (100, 101)").collect()} == {"response"}


def test_warc_urls_with_controls(spark, tmp_path):
    signs = "\x00\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u2028\u2029"
    rows = [(i, f"http://h.org/a{c}b", "x") for i, c in enumerate(signs)] + [(50 + k, "http://h.org/same", str(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    archive = warc.Archive.write(df, str(tmp_path / "c"), block_lines=3)
    found = archive.records(archive.lookup(df.select("url"))).collect()
    assert sorted(r.page_id for r in found) == sorted(r[0] for r in rows)
    # one key over many blocks
    assert sorted(r.page_id for r in archive.lookup(["http://h.org/same"]).collect()) == list(range(50, 90))
    assert archive.lookup(["http://h.org/a\u2028b", "http://h.org/none", None]).count() == 1
    assert warc.Archive.write(df.limit(0), str(tmp_path / "n")).lookup(["http://h.org/same"]).count() == 0


# --- packing ---


def test_packing_round_trip(spark, empty):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(0, 900)) + rng.choice(["", "\n\nA\tb", " é’s 12", "  "])) for i in range(40)] + [(90, None), (91, ""), (92, "tok" * 9000), (None, "x y"), (93, "same"), (93, "same")]
    pieces = packing.pack(docs_of(spark, rows).repartition(6), tokenizer_path(), per_partition=9000).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = sorted((-1 if i is None else i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in rows)
    parts = {}
    for p in pieces:
        ids = list(memoryview(bytes(p.ids)).cast("I"))
        assert len(ids) == p.length and zlib.crc32(bytes(p.ids)) == p.ids_crc32
        parts.setdefault(-1 if p.doc_id is None else p.doc_id, []).append((p.start, ids, p.doc_tokens))
    twice = parts.pop(93)
    assert sum(len(x[1]) for x in twice) == 2 * twice[0][2]
    joined = sorted((i, tuple(x for _, ids, _ in sorted(v) for x in ids)) for i, v in parts.items())
    assert joined == [w for w in want if w[0] != 93]
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length, p.sequence_length))
    for s in sequences.values():
        at = 0
        for offset, length, _ in sorted(s):
            assert offset == at
            at += length
        assert at == s[0][2] and at <= 2048 and at & (at - 1) == 0
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_hilbert_neighbours():
    import numpy as np

    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert_key(grid, 3)
    assert sorted(key) == list(range(512))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# --- language model ---


def test_cross_entropy_difference(spark, edge, empty):
    rng = random.Random(9)
    own = [w + "q" for w in WORDS[:60]]
    rows = [(i, " ".join(rng.choice(own if i % 2 else WORDS) for _ in range(80))) for i in range(200)]
    target = spark.createDataFrame([(i,) for i in range(1, 100, 2)] + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs_of(spark, rows), target).collect()}
    assert all(r.n_tokens == 80 and abs(r.score - (r.target_loss - r.background_loss)) < 1e-9 for r in got.values())
    unseen = [got[i].score for i in range(101, 200, 2)]
    seen = [got[i].score for i in range(1, 100, 2)]
    assert max(seen) < min(got[i].score for i in range(0, 200, 2))
    assert sum(unseen) / len(unseen) < sum(got[i].score for i in range(0, 200, 2)) / 100
    odd = {r.doc_id: r for r in lm_score.cross_entropy_difference(edge, target).collect()}
    assert odd[1].score == 0 and odd[2].n_tokens == 0 and lm_score.cross_entropy_difference(empty, target).count() == 0


def test_own_counts_are_left_out(spark):
    """A document of words nobody else uses gains nothing from being in the target."""
    rows = [(i, "common words all the same here") for i in range(20)] + [(50, "zig zag zog"), (51, "zig zag zog".replace("z", "y"))]
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs_of(spark, rows), spark.createDataFrame([(50,), (1,), (3,)], "doc_id long")).collect()}
    assert abs(got[50].target_loss - got[51].target_loss) < 1.0


def test_model_counts_are_exact(spark):
    """Losses against counts of the words themselves, with more different pairs than a fixed table of numbers keeps apart."""
    rng = random.Random(19)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.3)) % 300_000}" for _ in range(2000))) for i in range(250)]
    rows += [(300, None), (301, rows[0][1]), (302, "Once only"), (303, "")]
    wanted = {i for i, _ in rows if i % 3 == 0}
    counts = {True: [Counter(), Counter(), Counter()], False: [Counter(), Counter(), Counter()]}
    grams = {}
    for i, t in rows:
        w = (t or "").lower().split()
        b = [None, *w[:-1]] if w else []
        grams[i] = (w, b, list(zip(b, w, strict=True)))
        for c, g in zip(counts[i in wanted], grams[i], strict=True):
            c.update(g)
    vocabulary = len(counts[True][0] | counts[False][0]) + 1
    totals = {m: sum(c[0].values()) for m, c in counts.items()}

    def loss(i, model):
        trained = (i in wanted) == model
        own = [Counter(g) if trained else Counter() for g in grams[i]]
        out = 0.0
        for gram in zip(*grams[i], strict=True):
            word, context, pair = (counts[model][k][g] - own[k][g] for k, g in enumerate(gram))
            base = (word + 0.1) / (totals[model] - (len(grams[i][0]) if trained else 0) + 0.1 * vocabulary)
            out -= math.log2((pair + 8.0 * base) / (max(context, pair) + 8.0))
        return out / max(len(grams[i][0]), 1)

    target = spark.createDataFrame([(i,) for i in wanted], "doc_id long")
    got = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs_of(spark, rows), target).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        assert got[i].n_tokens == len(grams[i][0])
        assert abs(got[i].target_loss - loss(i, True)) < 1e-9 and abs(got[i].background_loss - loss(i, False)) < 1e-9


# --- personal data ---

PY = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PY.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_against_brute_force(spark, edge, empty):
    rng = random.Random(10)
    bits = ["a@b.c", "x.y+z@mail.example.com", "@", ".", " ", "1.2.3.4", "300.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "12", "+49 (30) 123-4567", "+1", "é𝄞", "a_b", "-", "a@b", "+", "\n", "9" * 20]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for i in range(400)] + [(1000, "a@b.c_x@d.e f@g.h.i@j.k"), (1001, "é a@b.c"), (1002, None), (1003, "1" * 50_000), (1004, "a" * 200_000 + "@"), (1005, "a@b" + ".c" * 20_000)]
    got = {r.doc_id: r for r in pii.personal_data(docs_of(spark, rows)).collect()}
    for i, t in rows:
        want = brute_spans(t or "")
        r = got[i]
        mine = [s for s in r.spans.split(",") if s and not s.startswith("term")]
        assert mine == want, (t or "")[:200]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in PY]
    assert pii.personal_data(edge).count() == len(EDGE) and pii.personal_data(empty).count() == 0


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 40)) for i in range(200)]
    rows += [(300 + i, f"{prose(rng, 5)} Marmaduke writes from ann.lee@corp.org w1 {prose(rng, 5)}") for i in range(4)]
    got = {r.doc_id: r.spans for r in pii.personal_data(docs_of(spark, rows)).collect()}
    assert all(got[i] == "" for i in range(200))
    text = dict(rows)
    for i in range(300, 304):
        spans = [s.split(":") for s in got[i].split(",")]
        hidden = {text[i][int(a) : int(b)] for k, a, b in spans if k == "term"}
        assert {"Marmaduke", "writes", "from"} <= hidden and "w1" not in hidden
    clean = {r.doc_id: r.text for r in pii.sanitised(docs_of(spark, rows)).collect()}
    assert set(clean) == set(range(300, 304)) and all("[EMAIL]" in t and "Marmaduke" not in t and "ann.lee" not in t for t in clean.values())


def test_terms_against_brute_force(spark):
    """Every term span, from documents counted one by one: short, numeric and far terms, copies, lists of addresses."""
    rng = random.Random(14)
    names = ["Bo", "Ann", "7", "K9", "Quentin", "Österreich", "été"]
    people = [f"p{i}@mail{i % 4}.org" for i in range(12)]
    rows = [(i, prose(rng, 30)) for i in range(60)] + [(70, None), (71, "")]
    for i in range(80):
        who = sorted(rng.sample(range(12), rng.choice([0, 1, 2])))
        body = prose(rng, 10).split() + [people[k] for k in who] + [names[k % 7] for k in who if rng.random() < 0.8] + prose(rng, 60).split() + [names[k % 7].upper() for k in who]
        rows.append((100 + i, " ".join(body)))
    many = " ".join(f"u{i}@list.net" for i in range(400))
    rows += [(300, f"Members {many} zebra1"), (301, f"members of {many} zebra1"), (302, rows[-1][1]), (303, rows[-1][1])]
    base = {i: brute_spans(t or "") for i, t in rows}
    spans = {i: [tuple(map(int, s.split(":")[1:])) for s in found] for i, found in base.items()}
    ents, terms, seen = {}, {}, {}
    for i, t in rows:
        ents[i] = {f"{s.split(':')[0]}:" + (t[a:b].lower() if s[0] in "ei" else re.sub("[^0-9]", "", t[a:b])) for s, (a, b) in zip(base[i], spans[i], strict=True)}
        found = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t or "")]
        seen[i] = {w for _, _, w in found}
        terms[i] = [x for x in found if not any(a < x[1] and x[0] < b for a, b in spans[i])]
    n, text = len(rows), dict(rows)
    n_e, n_t = Counter(e for i in ents for e in ents[i]), Counter(w for i in seen for w in seen[i])
    both, texts = Counter(), {}
    for i in ents:
        for e in ents[i]:
            for w in {x[2] for x in terms[i]}:
                both[e, w] += 1
                texts.setdefault((e, w), set()).add(text[i])
    told = lambda e, w: len(texts[e, w]) >= 2 and n_e[e] < n and math.log2(both[e, w] * n / (n_e[e] * n_t[w])) / math.log2(n / n_e[e]) >= 0.7 - 1e-12
    hits = 0
    for r in pii.personal_data(docs_of(spark, rows).repartition(5)).collect():
        want = [f"term:{a}:{b}" for a, b, w in terms[r.doc_id] if any(told(e, w) for e in ents[r.doc_id])]
        assert [s for s in r.spans.split(",") if s.startswith("term")] == want, r.doc_id
        hits += len(want)
    assert hits > 50
