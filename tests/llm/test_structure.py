"""Substring dedup, periodic runs and the manifest against brute force: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireworks.llm import manifest, repeats, runs

EDGE = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (6, "a b c d e f"), (6, "a b c d e f"), (None, "no id"), (7, "x" * 300_000), (8, "ab " * 60_000), (9, "nbsp stays one\x1cword"), (9, None)]
CLASH = ["key", "block", "n", "start", "total", "first", "runs", "path", "tree", "place", "leaf", "digest", "rank", "__row", "__part"]
words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})


def prose(rng, n, size=300):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def without_repeats(rows, width):
    """Rows of (doc_id, text), judged by the first place of each window; equal places of one doc_id are one."""
    order = lambda d: (d is None, d)
    first = {}
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, (order(d), i)), (order(d), i))
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] != (order(d), i) for j in range(i, i + width)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("width", [20, 7, 3])
def test_repeats_against_brute_force(spark, width):
    rng = random.Random(width)
    shared = [prose(rng, rng.randint(width - 2, 3 * width)) for _ in range(8)]
    rows = [(rng.randrange(80) if i % 9 else None, " ".join(rng.choice(shared) if rng.random() < 0.4 else prose(rng, rng.randint(0, 40)) for _ in range(rng.randint(0, 6)))) for i in range(150)]
    rows += [(500 + i, shared[0]) for i in range(60)] + [(700, "a b " * 50), (701, "a b " * 40), *EDGE[:7], *EDGE[10:]]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")  # many blocks
    try:
        got = repeats.without_repeats(docs_of(spark, rows).repartition(5), width).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, without_repeats(rows, width)))


def test_repeats_edges(spark):
    got = repeats.without_repeats(docs_of(spark, EDGE)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, without_repeats(EDGE, 20)))
    assert repeats.without_repeats(docs_of(spark, [])).count() == 0
    assert repeats.lengths(20) == [5, 10, 20] and repeats.lengths(25) == [4, 7, 13, 25] and repeats.lengths(3) == [3]


def runs_of(w, least=6, times=4):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, times * q) and not any(found.get((i, p)) == n for p in range(1, q)):
                found[i, q] = n
            i = j + 1
    return sorted((s, n, q) for (s, q), n in found.items())


def test_squares_and_stretches_against_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6 and s:
            at, q = rng.randrange(len(s)), rng.randint(1, 7)
            part = s[at : at + q]
            s = s[:at] + part * rng.randint(2, 8) + part[: rng.randrange(len(part))] + s[at:]
        for least, times in ((6, 4), (5, 2), (2, 3)):
            wanted = runs_of(s, least, times)
            assert sorted((a, e - a, q) for (a, q), e in runs.squares(s).items() if e - a >= max(least, times * q)) == wanted
            lows, highs = runs._stretches(np.array(s, np.int64), np.array([0, len(s)]), least, times)
            pieces = [(a + lo, e - a, q) for lo, hi in zip(lows.tolist(), highs.tolist(), strict=True) for (a, q), e in runs.squares(s[lo:hi]).items()]
            assert sorted(x for x in pieces if x[1] >= max(least, times * x[2])) == wanted


def test_runs_of_documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join([prose(rng, rng.randint(0, 30)), (prose(rng, rng.randint(1, 6)) + " ") * rng.randint(1, 9), prose(rng, 5)])) for i in range(200)] + EDGE
    got = runs.periodic_runs(docs_of(spark, rows)).collect()
    wanted = []
    for d, t in rows:
        w = words_of(t)
        found = [(0, len(w), 1)] if t and t.startswith("ab ab") else runs_of(w)
        gone = {j for s, n, q in found for j in range(s + q, s + n)}
        wanted.append((d, len(w), found, " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert sorted(repr((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text)) for r in got) == sorted(map(repr, wanted))
    assert runs.periodic_runs(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs_of(spark, EDGE), least=1)


def test_strongest_run(spark):
    listed = [[], [(0, 8, 2), (10, 4, 1), (20, 40, 10)], [(3, 25, 6), (40, 21, 5), (80, 42, 10)]]
    df = spark.createDataFrame([([*x],) for x in listed], f"runs array<{runs.RUN}>")
    assert [r.b and tuple(r.b) for r in df.select(runs.strongest(F.col("runs")).alias("b")).collect()] == [None, (0, 8, 2), (40, 21, 5)]


def test_repeated_tail(spark):
    rows = [(i, " ".join(f"t{j}" for j in range(i % 57))) for i in range(300)] + [(None, "a b"), (3, None)]
    for r in spark.createDataFrame(rows, "doc_id long, text string").withColumn("made", runs.repeated_tail(F.col("text"), F.col("doc_id"))).collect():
        h, w = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1, words_of(r.text)
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r.made.split() == [w[i if i < a else a + (i - a) % p] for i in range(n)]
        else:
            assert r.made == r.text


# --- manifest ---


def tree_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def proof_of(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i // 16 * 16
        out.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 16])))
        i //= 16
    return out


def proofs_of(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H("".join(map(field, (*r[:4], text))))
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    dealt = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s in sources]
    trees = [tree_of([leaf(r, r[4]) for r in d]) for d in dealt]
    top = tree_of([t[-1][0] for t in trees])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for k, d in enumerate(dealt):
        for i, r in enumerate(d):
            path, x = proof_of(trees[k], i) + proof_of(top, k), trees[k][0][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                x = leaf(r, r[4] and r[4].translate(lower))
            for a, b in path:
                x = H(a + x + b)
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], H("".join(a + b for a, b in path)), x, x == top[-1][0]))
    return sorted(map(repr, out))


SHAPE = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [[1], [17], [1, 300, 16, 1, 2, *[1] * 20], [0]])
def test_proofs_against_brute_force(spark, sizes):
    rng = random.Random(str(sizes))
    rows = [(rng.randrange(10**6), None if k == 0 and len(sizes) > 1 else f"sé{k}", rng.choice(["en", None]), rng.choice([5, None]), rng.choice(["Some Text É", "plain", "", None])) for k, n in enumerate(sizes) for _ in range(n)]
    if len(rows) > 20:
        rows += [(None, None, "en", 1, "No Id"), rows[0], rows[0], rows[-1], (7, "￿", None, None, None), (8, "\U0001f600", "A", 3, "B")]
        rows += [(15, "same", "en", 2, "Copies")] * 70  # equal rows: equal digests at places of their own
    docs = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit(1) for c in CLASH})
    assert sorted(map(repr, map(tuple, manifest.manifest_proofs(docs).collect()))) == (proofs_of(rows) if rows else [])


def test_requests_and_tampering(spark):
    rows = [(i, f"s{i % 3}", "en", 1, f"Text {i}") for i in range(900)]
    made = manifest.Manifest.write(spark.createDataFrame(rows, SHAPE))
    asked = made.leaves.where("doc_id in (0, 5, 899)").select("tree", "place", "doc_id", "leaf").unionByName(spark.createDataFrame([(0, 5000, -1, "x"), (9, 0, -2, "y")], "tree long, place long, doc_id long, leaf string"))
    got = {r.doc_id: r for r in made.proofs(asked).withColumn("root", manifest.folded(F.col("leaf"), F.col("path"))).collect()}
    assert set(got) == {0, 5, 899} and {r.root for r in got.values()} == {made.root}
    # a record answers to the digest of what it holds
    assert made.records.where(F.sha2("children", 256) != F.col("digest")).count() == 0 and made.records.groupBy("digest").count().where("count > 1").count() == 0
    wrong = made.proofs(asked).select(manifest.folded(F.sha2("leaf", 256), F.col("path")).alias("root")).collect()
    assert all(r.root != made.root for r in wrong)
    made.drop()


@pytest.mark.parametrize(("inner", "want"), [
    ('<p>see <a href="/hidden-gems">our guide</a></p>', "see our guide"), ('<p>see <a href="/x?id=search">our guide</a></p>', "see our guide"), ('<div title="the hidden cost">Body text</div>', "Body text"),
    ('<div data-id="sidebar">kept</div>', "kept"), ('<div data-hidden="false">kept</div>', "kept"), ('<section id="search">Searching trees</section>', "Searching trees"), ('<table class="header"><tr><td>cell</td></tr></table>', "cell"),
    ('<p title="unbalanced>foo</p>', "foo"), ('<p>a</p><div class="comment-body">Nice!</div><div id="comments">x</div>', "a"), ('<p>a</p><div class="share">Share</div><div class="ad">Buy</div><div hidden>gone</div><p aria-hidden="true">gone</p>', "a"),
])
def test_attributes_are_read_by_name(inner, want):
    from quireworks.llm.html_extract import page_text

    assert page_text(f"<html><body><nav>menu</nav><article>{inner}</article></body></html>", ["html", "body", "article"]) == want
