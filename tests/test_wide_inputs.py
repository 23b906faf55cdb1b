"""Queries against their SQL on tables with rows that the small tables lack: wide delimited rows, large numbers, mixed languages."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quireworks.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def both(spark, folder, name, docs):
    """The rows of a query and of its SQL over documents of (doc_id, text)."""
    pq.write_table(pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": [t for _, t in docs]}), f"{folder}/documents.parquet")
    df = QUERIES[name](spark, str(folder))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = db.execute(ORACLES[name])
    assert [c[0] for c in found.description] == df.columns
    return sorted(map(tuple, df.collect())), sorted(found.fetchall())


def test_delimited_caps(spark, tmp_path):
    """Rows end at 1,024 columns and tables at 200,000 cells, and whatever was cut says so."""
    wide = ",".join(map(str, range(1030)))
    docs = [(0, f"a,b\n\n{wide}\nc"), (1, ",".join(["x"] * 1024)), (2, "\n".join([wide] * 196)), (3, "\n".join(["1,2"] * 100_000)), (4, "\n".join(["1,2"] * 100_000) + '\n\n""\nz')]
    got, want = both(spark, tmp_path, "F11", docs)
    assert got == want
    cells = {d: sum(r[0] == d for r in got) for d, _ in docs}
    assert cells == {0: 2 + 1024 + 1, 1: 1024, 2: 195 * 1024, 3: 200_000, 4: 200_000}
    assert {(r[0], r[4]) for r in got} == {(0, True), (1, False), (2, True), (3, False), (4, True)}


def test_row_that_reaches_the_limit(spark, tmp_path):
    """The row in which the 200,000th cell lies is kept whole, and only rows behind it are a cut."""
    docs = [(n, "\n\n".join(["1,2,3"] * n)) for n in (66_666, 66_667, 66_668)]
    got, want = both(spark, tmp_path, "F11", docs)
    assert got == want
    assert {n: sum(r[0] == n for r in got) for n, _ in docs} == {66_666: 199_998, 66_667: 200_001, 66_668: 200_001}
    assert {(r[0], r[4]) for r in got} == {(66_666, False), (66_667, False), (66_668, True)}


def test_list_numbers_of_large_ids(spark, tmp_path):
    """Letters go on beyond three: 18,278 is zzz and 18,279 aaaa."""
    ids = [-11, -1, 0, 1, 9, 10, 26, 27, 702, 703, 3999, 4000, 18278, 18279, 475254, 475255, 12356630, 12356631, 321272406, 321272407, 2**31 - 1]
    got, want = both(spark, tmp_path, "F15", [(n, "") for n in ids])
    assert got == want
    letters = {r[0]: r[1] for r in got}
    assert [letters[n] for n in (0, 27, 18278, 18279, 475255, 12356631, 321272407)] == ["0", "aa", "zzz", "aaaa", "aaaaa", "aaaaaa", "aaaaaaa"]


#: Invented prose that mixes French and Spanish, and a few words over and over; then short texts
MIXED = [(3, "Étion et en ench èanier, ierque vi èenaioi en èenque oieau éçaux. Ciónasasta ciónuellí íquega de el y. Se ezllll osdoado ciónqueue íll ciónosarco."), (7, "Épare éauxre éauxre éauxre " * 60)]
SHORT = [(2, "pour oi, la re le ou sur."), (5, "la le " * 70 + "anpa oi queeau ouch du")]


@pytest.mark.parametrize("name", ["F9", "read_text_corpus"])
def test_mixed_languages(spark, tmp_path, name):
    """Bytes of windows-1252 stay so where languages are mixed, and where another code page reads them alike."""
    got, want = both(spark, tmp_path, name, MIXED)
    assert got == want


def test_control_signs_in_corpus(spark, tmp_path):
    """Bytes 80 to 9F are signs of windows-1252, and those without a meaning there stay."""
    docs = [(3, "café \x85 \x92s \x81\x9d"), (7, "\x85"), (11, "plain"), (4, "caf\x85"), (5, "\x92 é")]
    got, want = both(spark, tmp_path, "read_text_corpus", docs)
    assert got == want
    assert {r[0]: r[2] for r in got}[3] == "café … ’s \x81\x9d"


def test_null_texts_in_corpus(spark, tmp_path):
    """No bytes have no encoding."""
    got, want = both(spark, tmp_path, "read_text_corpus", [(d, None) for d in range(4)])
    assert got == want == [(d, None, None, None) for d in range(4)]


def test_ends_of_utf16(spark):
    """An odd byte or half a pair at the end is a replacement sign; of the head of a longer file it is left out."""
    from quireworks.operators import texts as X

    whole = "ab\U0001F600"
    rows = [(f"{name}{cut}", mark + whole.encode(name)[: 8 - cut]) for name, mark in (("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")) for cut in range(4)]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: r.text for r in X.from_bytes(df).collect()}
    assert got == {f"{name}{cut}": whole if not cut else "ab\uFFFD" for name in ("utf-16-le", "utf-16-be") for cut in range(4)}
    longer = spark.createDataFrame([("x", b"\xff\xfe" + whole.encode("utf-16-le"))], "path string, content binary")
    assert {r.text for n in (7, 8, 9) for r in X.from_bytes(longer, max_source_bytes=n).collect()} == {"ab"}


def test_short_legacy_texts(spark, tmp_path):
    """Words that come again are no further evidence, and Hebrew has no final forms inside words."""
    got, want = both(spark, tmp_path, "F9_legacy", SHORT)
    assert got == want


#: Texts whose bytes are likelier in another encoding than that they were written in, and texts that have none
UNTOLD = [(2, "a."), (5, "de."), (8, "aux."), (3, "er."), (9, "lllldoado."), (14, "ereaea."), (6, " aux en pa."), (12, "queeuxaux aux eauhcnb ier."), (10, "xa xo"), (0, None), (1, ""), (-1, "abc"), (-3, ""), (4, "\x01ab \x02c\n\x7f"), (7, "12 …")]


def test_untold_legacy_texts(spark, tmp_path):
    """The SQL states which encoding is likeliest, also where it is not the one that a text was written in."""
    docs = UNTOLD + [(100 + 3 * i + k, a + b) for i, (a, b) in enumerate((a, b) for a in "etaoinshrdlcumwfgypbvkxjqz" for b in ("t", "qn.", "x@", "j0b1", "\tmm")) for k in range(3)]
    got, want = both(spark, tmp_path, "F9_legacy", docs)
    assert got == want
    named = {r[0]: r[1] for r in got}
    assert [named[d] for d in (2, 8, 0, 1, -1, 7)] == ["windows-1252", "windows-1255", None, "UTF-8", None, "UTF-8"]
    assert {r[0]: r[2] for r in got}[2] == "é."


def test_likelihoods_are_whole_numbers():
    """Sums do not depend on their order."""
    from quireworks.functions.encodings import PAGES, likelihood

    assert {type(likelihood("слово и слова".encode("cp1251"), name, mixed=mixed)) for name in PAGES for mixed in (False, True)} <= {int, type(None)}


def test_postings_without_shuffle(spark, tmp_path):
    """Terms are counted in their document's row, whatever it holds; nothing is shuffled for it."""
    from quireworks.operators import search as S

    docs = spark.createDataFrame([(1, "b a b, É é e"), (2, ""), (3, None), (4, " ,"), (5, "x " * 30_000)], "doc_id long, text string")
    postings = S.postings_of(docs)
    assert sorted(map(tuple, postings.collect())) == [("a", 1, 1, 6), ("b", 1, 2, 6), ("e", 1, 3, 6), ("x", 5, 30_000, 30_000)]
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, S.build_postings(docs)[1].collect())) == [(1, 6), (2, 0), (3, None), (4, 0), (5, 30_000)]


def test_kept_index_has_few_files(spark, tmp_path):
    """A folder of terms that are not many is one file."""
    from quireworks.operators import search as S

    S.write_postings(spark.range(200).selectExpr("id AS doc_id", "'word other words' AS text"), str(tmp_path))
    files = {f.name: len(list(f.glob("*.parquet"))) for f in (tmp_path / "postings").glob("head=*")}
    assert files == {"head=wo": 1, "head=ot": 1}
    assert S.read_postings(spark, str(tmp_path))[0].count() == 600


def test_segment_tasks_do_not_grow(spark, tmp_path):
    """Postings of a batch are dealt to tasks of one size, so more than there are shuffle partitions where they are many."""
    from quireworks.operators.segments import SegmentIndex

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "4k")
    try:
        index = SegmentIndex(spark, str(tmp_path))
        words = "concat_ws(' ', transform(sequence(1, 60), i -> concat(char(97 + i % 20), 'x', id * 61 + i)))"
        index.apply(spark.range(0, 400, 1, 8).selectExpr("id AS doc_id", f"{words} AS text"))
    finally:
        spark.conf.unset(key)
    assert len(list(tmp_path.glob("segment-*/postings/*.parquet"))) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert index.postings().count() == 400 * 60
