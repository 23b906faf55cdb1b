"""Known inputs and results, one operator at a time."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quireworks.functions import formats
from quireworks.functions import text as T
from quireworks.functions.encodings import PAGES, guess
from quireworks.operators import catalog as C
from quireworks.operators import search as S
from quireworks.operators import texts as X
from quireworks.operators import upkeep as U


def one(spark, value, make, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("text", "want"), [
    ("scaling paper", ["scaling*", "paper*"]), ("a", ["a"]), ("a paper", ["paper*"]), ("I a", ["I", "a"]), ("AND OR NOT NEAR", ["AND*", "OR*", "NOT*", "NEAR*"]),
    ("paper-trail, (draft)!", ["paper*", "trail*", "draft*"]), ("scal*", ["scal*"]), ("Grüße naïve", ["Grüße*", "naïve*"]), ("!!", []), ("one two three four five six seven eight nine", [w + "*" for w in "one two three four five six seven eight".split()]),
])
def test_search_parse(spark, text, want):
    rows = S.search_parse(spark.createDataFrame([(1, text)], "query_id int, text string")).orderBy("term_no").collect()
    assert [r.term + ("*" if r.is_prefix else "") for r in rows] == want


@pytest.mark.parametrize(("n", "df", "tf", "length", "avg", "want"), [
    (4, 3, 1, 5, 6, 0.3827731105683958), (4, 3, 4, 14, 6, 0.49042804791575706), (4, 3, 1, 3, 6, 0.4483913580944065), (100, 1, 1, 6, 6, math.log(1 + 99.5 / 1.5)), (4, 0, 1, 5, 6, 0.0),
])
def test_bm25(spark, n, df, tf, length, avg, want):
    row = spark.createDataFrame([(n, df, tf, length, avg)], "n long, df long, tf long, l long, a long").select(S.bm25_score(*map(F.col, ("n", "df", "tf", "l", "a"))).alias("s")).first()
    assert row.s == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize(("marked", "text", "ranges"), [("the ⟨scale⟩ of ⟨paper⟩", "the scale of paper", [(4, 9), (13, 18)]), ("the ⟨scal", "the scal", [(4, 8)]), ("a ⟨⟩ b", "a  b", [])])
def test_marker_ranges(spark, marked, text, ranges):
    plain, at = S.marker_ranges(F.col("v"))
    row = spark.createDataFrame([(marked,)], "v string").select(plain.alias("t"), at.alias("r")).first()
    assert row.t == text and [tuple(r) for r in row.r] == ranges


def ordered(spark, names):
    df = spark.createDataFrame(list(enumerate(names)), "i int, title string")
    return [r.title for r in df.orderBy(C.natural_key(F.col("title")), "i").collect()]


@pytest.mark.parametrize("want", [
    ["file1", "file2", "file10", "file100"], ["v1.2", "v1.9", "v1.10", "v2.1"], ["7zip", "alpha", "Beta"], ["report", "report2", "reports"], ["Åsa", "Bo", "Zoe"], ["rest", "resume", "résumé"],
    ["x5", "x" + "9" * 60, "x" + "9" * 60 + "1"],
])
def test_natural_order(spark, want):
    assert ordered(spark, want[::-1]) == want


@pytest.mark.parametrize(("name", "mime", "want"), [
    ("a.PDF", None, "PDF"), ("report.conf.txt", None, "TEXT"), ("makefile", None, "CODE"), ("x", "Application/PDF", "PDF"), ("a.xyz", "text/csv", "CSV"), (None, None, "UNKNOWN"), ("a.", None, "UNKNOWN"), ("conf", None, "CODE"),
])
def test_detect(spark, name, mime, want):
    assert spark.createDataFrame([(name, mime)], "n string, m string").select(formats.detect(F.col("n"), F.col("m")).alias("r")).first().r == want


@pytest.mark.parametrize(("text", "want"), [
    ("First line\nsecond line.\n\n\nThird paragraph\nover two lines.", ["First line second line.", "Third paragraph over two lines."]), ("one\rtwo\r\rthree", ["one two", "three"]), ("\n \n", []),
])
def test_paragraphs(spark, text, want):
    rows = X.paragraph_units(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("para_no").collect()
    assert [r.text for r in rows] == want


def test_paragraph_offsets(spark):
    rows = X.paragraph_units(spark.createDataFrame([(1, "alpha\n\nbeta\n\ngamma")], "doc_id int, text string")).orderBy("para_no").collect()
    assert [r.start for r in rows] == [0, 7, 13]


def split(spark, text, delimiter=",", **limits):
    row = spark.createDataFrame([(text, delimiter)], "t string, d string").select(X.split_delimited(F.col("t"), F.col("d"), **limits).alias("r")).first()
    return row.r.rows, row.r.truncated


@pytest.mark.parametrize(("text", "want"), [
    ("a,b\rc,d\ne,f\r\ng,h", [["a", "b"], ["c", "d"], ["e", "f"], ["g", "h"]]), ("a\n\n\r\n\nb\n\n", [["a"], ["b"]]), ("a,,c\n,,\nx,", [["a", "", "c"], ["", "", ""], ["x", ""]]),
    ('"a,b",c', [["a,b", "c"]]), ('"a""b"', [['a"b']]), ('"a\nb",c', [["a\nb", "c"]]), ('""\nx', [[""], ["x"]]), ('a"b,c', [['a"b', "c"]]), ("", []), ("﻿a,b", [["a", "b"]]), ('"open, to\nthe end', [["open, to\nthe end"]]),
])
def test_split_delimited(spark, text, want):
    assert split(spark, text) == (want, False)


def test_split_delimited_caps(spark):
    assert split(spark, "x" * 12, max_chars=10) == ([["x" * 10 + "…"]], False)
    assert split(spark, "a,b\nc,d\ne,f", max_cells=4) == ([["a", "b"], ["c", "d"]], True)
    assert split(spark, "a,b\nc,", cut=True) == ([["a", "b"]], True)
    assert split(spark, "a,b,c", max_columns=2) == ([["a", "b"]], True)


def test_split_delimited_stops_at_a_row_boundary(spark):
    abc = ["a", "b", "c"]
    assert split(spark, "\n".join(["a,b,c"] * 10), max_cells=7) == ([abc] * 3, True)
    assert split(spark, "a,b,c\n" * 3, max_cells=7) == ([abc] * 3, False)
    assert split(spark, "a,b,c\n" * 3, max_cells=6) == ([abc] * 2, True)
    assert split(spark, "a,b,c\nd", max_cells=2, max_columns=2) == ([["a", "b"]], True)


@pytest.mark.parametrize(("text", "want"), [
    ("see https://a.org/x.", ["https://a.org/x"]), ("is it https://a.org?", ["https://a.org"]), ("https://en.org/Foo_(language) ok", ["https://en.org/Foo_(language)"]), ("(https://en.org/a)", ["https://en.org/a"]),
    ("www.example.com/path?x=1", ["https://www.example.com/path?x=1"]), ("README.md", []), ("mail dev@example.org now", ["mailto:dev@example.org"]), ("a@b", []), ("https://user@host.com/", ["https://user@host.com/"]), ("www.localhost", []),
    ("me@www.example.org", ["mailto:me@www.example.org"]), ("https://a.org/x\u00a0then", ["https://a.org/x"]), ('"https://example.com",', ["https://example.com"]), ("a.b+c@sub.example.co.uk", ["mailto:a.b+c@sub.example.co.uk"]),
    ("Open README.md, run setup.sh, edit main.py and lib.rs", []), ("an @mention and a@b", []), ("Try www.example.com/path?x=1, then", ["https://www.example.com/path?x=1"]),
])
def test_autolinks(spark, text, want):
    assert [r.destination for r in one(spark, text, T.autolinks)] == want


DEPTHS = [0, 1, 2, 1, 0, 1, 0]


@pytest.mark.parametrize(("folds", "want"), [({0}, [0, 4, 5, 6]), ({1}, [0, 1, 3, 4, 5, 6]), ({4}, [0, 1, 2, 3, 4, 6]), ({2, 3, 6, 40}, list(range(7)))])
def test_outline_visible(spark, folds, want):
    outline = spark.createDataFrame([(1, i, d) for i, d in enumerate(DEPTHS)], "doc_id int, pos int, depth int")
    rows = X.outline_visible(outline, spark.createDataFrame([(1, f) for f in folds], "doc_id int, pos int"))
    assert sorted(r.pos for r in rows.collect()) == want


def test_outline_initial_folds(spark):
    outline = spark.createDataFrame([(1, i, (0, 1, 1)[i % 3]) for i in range(120)], "doc_id int, pos int, depth int")
    folds = X.outline_initial_folds(outline)
    assert folds.count() == 40 and X.outline_visible(outline, folds).count() == 40


@pytest.mark.parametrize(("line", "n", "chunk", "inside", "fraction"), [(41, 1000, 1, 0, 0.0), (100, 100, 2, 19, 0.95), (80, 80, 1, 39, 0.975), (1, 1, 0, 0, 0.0)])
def test_go_to_line(spark, line, n, chunk, inside, fraction):
    df = spark.createDataFrame([(line, n)], "l int, n int")
    at = T.go_to_line(F.col("l"), F.col("n"))
    row = df.select(at["chunk"].alias("c"), at["line"].alias("i"), at["fraction"].alias("f"), T.line_at(at["chunk"], at["fraction"], F.col("n")).alias("back")).first()
    assert (row.c, row.i, row.back) == (chunk, inside, line) and row.f == pytest.approx(fraction)
    assert df.select(T.go_to_line(F.lit(0), F.col("n")).alias("r")).first().r is None


@pytest.mark.parametrize(("text", "want"), [
    ("failed on /storage/emulated/0/Documents/My Contract.pdf", "failed on [redacted]"), ("from content://media/external/12 failed", "from [redacted] failed"), ("in docs/data/file.txt", "in docs/data/file.txt"), ("at /data/user/0/x\nnext", "at [redacted]\nnext"),
])
def test_redact(spark, text, want):
    assert one(spark, text, lambda c: T.redact(c, ["/opt/root"])) == want


def test_find_spans_chunks(spark):
    """Offsets in the whole text are the same whether it is searched whole or read as joined chunks."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b", "ab", "A", "\n", " ", "x", "é"]) for _ in range(rng.randrange(1, 200))) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for needle in ("ab", "a\nb", "É", "(", "x x"):
        got = {}
        for r in X.find_rows(docs, needle).collect():
            got.setdefault(r.doc_id, []).append((r.start, r.end))
        for i, t in enumerate(texts):
            want, at, low, q = [], 0, t.lower(), needle.lower()
            while (at := low.find(q, at)) >= 0:
                want.append((at, at + len(q)))
                at += len(q)
            assert sorted(got.get(i, [])) == want
    chunks = X.chunk_offsets(docs, 3)
    found = X.find_rows(docs, "ab").select("doc_id", F.col("start").cast("long").alias("offset"))
    for r in X.join_asof_chunk(found, chunks).join(chunks, ["doc_id", "chunk_no"]).collect():
        assert r.start_offset + r.chunk_offset == r.offset and 0 <= r.chunk_offset <= len(r.text)


@pytest.mark.parametrize(("code", "value", "want"), [
    ("General", 3.0, "3"), ("General", 2.5, "2.5"), ("0.00", 1.005, "1.00"), ("#,##0", 1234567.0, "1,234,567"), ("0%", 0.256, "26%"), ("#,##0.00 €", 1234.5, "1,234.50€"), ("$#,##0", 1234.0, "$1,234"), ("#,##0,", 1500000.0, "1,500"), ("yyyy-mm-dd", 45292.0, "2024-01-01"),
    ("0", 2.5, "2"), ("0.0,,", 2500000.0, "2.5"), ("0.0%", 0.256, "26%"), ("[$€-407] #,##0.00", 1234.5, "€1,234.50"), ("mmm yy", 45292.0, "Jan 24"), ("mm/dd", 45292.0, "01/01"), ("d mmm yyyy", 45292.0, "Jan 24"), ("0.000", 1.23456, "1.23456"), ("£0", 7.0, "£7"),
])
def test_number_format(spark, code, value, want):
    assert one(spark, value, lambda c: T.number_format(c, code), "double") == want


@pytest.mark.parametrize(("n", "fmt", "want"), [(27, "lowerLetter", "aa"), (702, "lowerLetter", "zz"), (703, "upperLetter", "AAA"), (1994, "upperRoman", "MCMXCIV"), (4000, "lowerRoman", "4000"), (7, "decimalZero", "07"), (0, "lowerLetter", "0")])
def test_list_number(spark, n, fmt, want):
    assert one(spark, n, lambda c: T.list_number(c, F.lit(fmt)), "int") == want


@pytest.mark.parametrize(("data", "want"), [
    (b"\xff\xfe", False), (b"\xef\xbb\xbf\x01\x02\x03", False), (b"\xef\xbb\xbfabc", True), ("\x85\x86 é".encode(), False), (("a" * 8191 + "é").encode()[:8192], True), (("é" * 50 + "\x01").encode(), True),
    (b"plain text", True), (b"", False), (b"%PDF-1.7", False), (b"a\x00b", False), (b"\xff\xfea\x00", True), (b"\x01" * 5 + b"a" * 100, False), ("Grüße".encode("cp1252"), True),
])
def test_looks_like_text(spark, data, want):
    assert one(spark, bytearray(data), T.looks_like_text, "binary") is want


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16-le", "utf-16-be", "cp1252"])
def test_encodings(spark, encoding):
    text = "Grüße, naïve – plain words and more of them"
    enc, made = X.decoded(F.col("v"))
    row = spark.createDataFrame([(bytearray(text.encode(encoding)),)], "v binary").select(enc.alias("e"), made.alias("t")).first()
    assert row.t == text and row.e == {"utf-8": "UTF-8", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "cp1252": "windows-1252"}[encoding]


@pytest.mark.parametrize(("encoding", "text"), [
    ("windows-1251", "Съешь же ещё этих мягких французских булок, да выпей чаю."), ("KOI8-R", "Съешь же ещё этих мягких французских булок, да выпей чаю."),
    ("windows-1253", "Καλημέρα κόσμε, τι κάνετε σήμερα;"), ("windows-1250", "Zażółć gęślą jaźń i idź spać, proszę"), ("ISO-8859-2", "Příliš žluťoučký kůň úpěl ďábelské ódy"),
    ("windows-1250", "Szeretném megköszönni a segítségét, nagyon örülök, hogy eljött őszi ünnepségünkre"), ("windows-1254", "Bugün hava çok güzel, dışarı çıkıp yürüyüş yapmak istiyorum"),
    ("windows-1255", "שלום עולם, מה שלומך היום"), ("windows-1256", "مرحبا بالعالم كيف حالك اليوم"), ("Shift_JIS", "こんにちは、世界。今日はいい天気ですね。"), ("EUC-JP", "こんにちは、世界。今日はいい天気ですね。"),
    ("GB18030", "今天天气很好，我们去公园玩吧。"), ("Big5", "今天天氣很好，我們去公園玩吧。"), ("EUC-KR", "안녕하세요, 세계. 오늘은 날씨가 좋네요."), ("windows-1252", "Le café est prêt et déjà réservé pour René et sa fiancée."),
    ("windows-1252", "ÜBERGRÖSSE, ÄÖÜ – äöü ß"), ("windows-1252", "Ñandú, señor: mañana será otro día"),
])
def test_legacy_encodings(spark, encoding, text):
    """Bytes that nothing names are read in the likeliest encoding, whole and cut inside a sign."""
    data = text.encode(PAGES[encoding][0])
    rows = spark.createDataFrame([(0, bytearray(data), False), (1, bytearray(data * 50 + data[:1]), True)], "id int, v binary, cut boolean")
    enc, made = X.decoded(F.col("v"), F.col("cut"))
    got = {r.id: (r.e, r.t) for r in rows.select("id", enc.alias("e"), made.alias("t")).collect()}
    assert got[0] == (encoding, text) and got[1][0] == encoding and got[1][1].startswith(text * 50)


def test_legacy_guess_edges():
    """Signs of other scripts in a little of the text are not enough; no bytes, and few that tell nothing, are the default."""
    assert guess(b"plain") == guess(b"") == guess(b"a\xe9\xe9") == "windows-1252"
    assert guess(b"word " * 40 + "слово".encode("cp1251")) == "windows-1252" and guess(b"word " * 2 + "слово слово".encode("cp1251")) == "windows-1251"


@pytest.mark.parametrize(("data", "cut", "encoding", "text"), [
    (b"", False, "UTF-8", ""), ("é€".encode("utf-32-le"), False, None, None), (b"\xff\xfe\0\0" + "aé😀".encode("utf-32-le"), False, "UTF-32LE", "aé😀"), (b"\0\0\xfe\xff" + "aé😀".encode("utf-32-be"), False, "UTF-32BE", "aé😀"),
    ("ééé".encode()[:3], True, "UTF-8", "é"), ("ééé".encode()[:3], False, "windows-1252", "Ã©Ã"), ("a€".encode()[:3], True, "UTF-8", "a"), ("x😀".encode()[:4], True, "UTF-8", "x"), (b"a\xe9\xe9", True, "windows-1252", "aéé"),
])
def test_decoding_edges(spark, data, cut, encoding, text):
    enc, made = X.decoded(F.col("v"), F.lit(cut))
    row = spark.createDataFrame([(bytearray(data),)], "v binary").select(enc.alias("e"), made.alias("t")).first()
    assert encoding is None or (row.e, row.t) == (encoding, text)


@pytest.mark.parametrize(("head", "extension", "want"), [
    ("#import <UIKit/UIKit.h>", "h", "OBJC"), ("@interface A : B", "h", "OBJC"), ('x = @"s";', "m", "OBJC"), ("NSString *s;", "h", "OBJC"), ("class Foo {\n public:\n};", "h", "CPP"), ("template <typename T>", "h", "CPP"), ("#include <vector>", "h", "CPP"),
    ("#include <stdio.h>\nint x;", "h", "C"), ("std::string s;", "h", "CPP"), ("  \n", "h", None), ("int main(void) {}", "m", "OBJC"), ("#include <a.h>", "m", "OBJC"), ("% comment\nx = 1;", "m", "MATLAB"), ("function y = f(x)\nend", "m", "MATLAB"),
    ("x = [1, ...\n 2];", "m", "MATLAB"), ("close all\nclc", "m", "MATLAB"), ("plain words", "m", None), ("using namespace std;", "h", "CPP"), ("typedef struct node node;", "h", "C"), ("  endif;", "m", "MATLAB"),
])
def test_languages(spark, head, extension, want):
    assert one(spark, head, lambda c: T.content_kind(c, F.lit(extension))) == want


def test_hidden_elements_and_link_targets(spark):
    page = "<p>a</p><div hidden><p>secret</p><div>more <div>deep</div></div></div><section class='x' hidden>gone<b>too</b></section><p>b</p>"
    blocks = X.html_blocks(spark.createDataFrame([(1, page)], "page_id long, html string"))
    assert [(r.block_no, r.text) for r in blocks.collect()] == [(0, "a"), (1, "b")]
    rows = [(1, 0, "PARAGRAPH", "see the docs here", [(4, 12, "http://find.me"), (4, 12, "http://find.me/2"), (0, 3, "http://other")]), (1, 1, "PARAGRAPH", "find it", [(0, 7, "http://find.me")]), (1, 2, "IMAGE", "find", []), (1, 3, "PARAGRAPH", "x", [(0, 9, "FIND")])]
    df = spark.createDataFrame(rows, "page_id long, block_no long, kind string, text string, spans array<struct<start:int,end:int,link:string>>")
    assert sorted((r.block_no, r.hit_no) for r in X.block_find(df, "find").collect()) == [(0, 1), (1, 1), (3, 1)]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode("cp1252"))
    (tmp_path / "b.tsv").write_text("x\ty\n1\t\"2\n3\"\n")
    rows = {r.path.rsplit("/", 1)[1]: r for r in X.read_text_corpus(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "é" and not rows["a.txt"].truncated
    cells = X.read_delimited_corpus(spark, f"{tmp_path}/b.tsv").orderBy("row_no", "col_no").collect()
    assert [(c.row_no, c.col_no, c.value) for c in cells] == [(0, 0, "x"), (0, 1, "y"), (1, 0, "1"), (1, 1, "2\n3")]


def test_unique_names_past_taken(spark):
    names = [(1, "a.txt"), (2, "a (1).txt"), (3, "a.txt"), (4, "a.txt"), (5, "b"), (6, "b")]
    got = {r.id: r.unique_name for r in C.unique_names(spark.createDataFrame(names, "id int, name string")).collect()}
    assert got == {1: "a.txt", 2: "a (1).txt", 3: "a (2).txt", 4: "a (3).txt", 5: "b", 6: "b (1)"}


def test_snapshot_survives_a_failed_write(spark, tmp_path):
    path = str(tmp_path / "t")
    U.write_snapshot(spark.range(3), path)
    (tmp_path / "t" / "v2").mkdir()
    assert U.current_version(spark, path) == 1 and U.read_snapshot(spark, path).count() == 3


def test_plans(spark, sf):
    """No Cartesian product; filters and columns reach the scan."""
    from quireworks.plans import registry

    found = registry.queries()
    for name in ("library_view", "bm25_rank", "join_asof_unit", "join_rect_touch", "M1", "S10"):
        plan = found[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
    plan = found["lookup_by_id"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in plan
    plan = found["scan_uris"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan


@pytest.mark.parametrize(("text", "want"), [
    ("a@b.co,c@d.org", [(0, 6, "mailto:a@b.co"), (7, 14, "mailto:c@d.org")]), ("a@b.co@d.org", [(0, 6, "mailto:a@b.co")]), ("x <me@a.bc> y", [(3, 10, "mailto:me@a.bc")]), ("a@b.c0m a@b..co a@-.co1", [(16, 22, "mailto:a@-.co")]),
    ("xhttp://a.b http://a.b/?m=q@r.st", [(12, 32, "http://a.b/?m=q@r.st")]), ("é@www.a.bc HTTP://É.org/(x]).", [(11, 28, "HTTP://É.org/(x])")]), ("(www.a.b),me@c.de", [(1, 17, "https://www.a.b),me@c.de")]), ("http:// www.", []),
])
def test_autolink_places(spark, text, want):
    got = [(r.start, r.end, r.destination) for r in one(spark, text, T.autolinks)]
    assert got == want and all(text[a:b] in d for a, b, d in got)


@pytest.mark.parametrize(("text", "want"), [
    ("/opt/root/a b\r\nok", "[redacted]\r\nok"), ("see content://a/data/b c", "see [redacted] c"), ("content:// x", "content:// x"), ("a file:///x y\n/mnt", "a [redacted]\n/mnt"), ("x/y/imports/z w", "[redacted]"), ("a x/imports/z", "a [redacted]"),
    ("(/cache/x) y", "([redacted]"), ("b/data/x /data/y", "b/data/x [redacted]"), ("/database/x", "/database/x"), ("content://a content://b", "[redacted] [redacted]"), ("", ""), ("line\n\n", "line\n\n"),
])
def test_redacted_lines(spark, text, want):
    assert one(spark, text, lambda c: T.redact(c, ["/opt/root"])) == want


@pytest.mark.parametrize(("head", "extension", "want"), [
    ("/* a class of new friends: delete this */\nint f(void);", "h", "C"), ("// std::x\nint f(void);", "h", "C"), ("const char *s = \"template <class T>\";", "h", "C"), ("virtual void f() noexcept;", "h", "CPP"), ("#  import <a.h>", "h", "OBJC"),
    ("x = 1\nend", "m", "MATLAB"), ("classdef A\nend", "m", "MATLAB"), ("NSLOG is not a class", "m", None), ("the end of it", "m", None),
])
def test_evidence_of_languages(spark, head, extension, want):
    assert one(spark, head, lambda c: T.content_kind(c, F.lit(extension))) == want


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [([rng.randrange(-5, 99) for _ in range(n)],) for n in (0, 1, 255, 256, 257, 512, 3000)]
    for r in spark.createDataFrame(rows, "v array<bigint>").select("v", T.running_sums(F.col("v")).alias("s")).collect():
        assert r.s == [sum(r.v[: i + 1]) for i in range(len(r.v))]


def test_offsets_of_very_many_hits(spark):
    docs = spark.createDataFrame([(1, "ab tion. " * 100_000)], "doc_id long, text string")
    assert X.find_rows(docs, "tion").agg(F.count("*"), F.sum("start")).first() == (100_000, sum(9 * i + 3 for i in range(100_000)))


def test_span_cover_by_sweep(spark):
    rng = random.Random(8)
    side = lambda n, width: [(d, a, a + rng.randrange(width)) for d in range(40) for a in (rng.randrange(40) for _ in range(rng.randrange(n)))]
    direct, linked = side(6, 6), side(9, 9)
    got = X.join_span_cover(spark.createDataFrame(direct, "doc_id int, start int, end int"), spark.createDataFrame(linked, "doc_id int, start int, end int"))
    want = {k for k in linked if not any(d[0] == k[0] and d[1] < k[2] and k[1] < d[2] for d in direct)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    hits = spark.range(100_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 4).cast("int").alias("end"))
    links = spark.range(10_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 100 + 4).cast("int").alias("start"), (F.col("id") * 100 + F.when(F.col("id") % 2 == 0, 10).otherwise(11)).cast("int").alias("end"))
    assert X.join_span_cover(hits, links).count() == 5_000
