"""Tables that change together: cascades, upserts, refused writers, and changes that fail half-way."""

import pytest
from pyspark.sql import functions as F

from quireworks.operators import store as ST
from quireworks.operators import upkeep as U

SHAPE = "id long, uri string, title string, format string, size_bytes long, last_opened_at long, created_at long, is_starred boolean"


@pytest.fixture
def store(spark, tmp_path):
    made = ST.Store(spark, str(tmp_path / "store"))
    docs = spark.range(200).select("id", F.format_string("u%d", "id").alias("uri"), F.lit("t").alias("title"), F.lit("PDF").alias("format"), F.lit(1).cast("long").alias("size_bytes"), F.lit(5).cast("long").alias("last_opened_at"), F.lit(5).cast("long").alias("created_at"), F.lit(False).alias("is_starred"))
    child = spark.range(600).select(F.col("id"), (F.col("id") % 200).alias("document_id"), F.lit("x").alias("text"))
    made.create({"documents": (docs, "id")} | {t: (child, c) for t, c in ST.CHILDREN.items()}, buckets=8)
    return made


def contents(store):
    return {t: sorted(map(repr, store.read(t).collect())) for t in ("documents", *ST.CHILDREN)}


def test_cascade_is_one_change(spark, store, monkeypatch):
    ids = spark.createDataFrame([(3,), (77,), (9999,)], "id long")
    before, written, write = contents(store), [], ST.Store._write

    def breaks(self, table, *rest):
        if len(written) == 3:
            raise OSError("disk full")
        written.append(table)
        return write(self, table, *rest)

    monkeypatch.setattr(ST.Store, "_write", breaks)
    with pytest.raises(OSError):
        ST.delete_documents(store, ids)
    monkeypatch.undo()
    assert len(written) == 3 and contents(store) == before  # three of six tables were written, none changed
    folders = store.manifests.read()[1]["bookmarks"]["folders"]
    early = store.read("documents")
    ST.delete_documents(store, ids)
    after = contents(store)
    assert len(after["documents"]) == 198 and all(len(after[t]) == 594 for t in ST.CHILDREN)
    assert early.count() == 200  # who began with the old state reads it to the end
    now = store.manifests.read()[1]["bookmarks"]["folders"]
    assert 1 <= sum(folders.get(b) != now.get(b) for b in folders) <= 3  # only buckets of these three documents are new
    store.vacuum()
    assert contents(store) == after


def test_upserts_rebinding_and_texts(spark, store):
    library = store.read("documents")
    updates = spark.createDataFrame([(1, "u5", "new", "CODE", 9, 50), (2, "u5", "newer", "CODE", 9, 60), (3, "v1", "fresh", "PDF", 2, 70), (4, "v0", "fresh", "PDF", 2, 70)], "update_no long, uri string, title string, format string, size_bytes long, opened_at long")
    want = sorted(map(repr, U.upsert_by_uri(library, updates).select(*library.columns).collect()))
    ST.upsert_documents(store, updates)
    assert sorted(map(repr, store.read("documents").collect())) == want and len(want) == 202
    requests = spark.createDataFrame([(1, "free"), (2, "free"), (3, "u9"), (4, "u4")], "id long, new_uri string")
    whole, refused = U.rebind_uri(store.read("documents"), requests)
    want, no = sorted(map(repr, whole.select(*library.columns).collect())), sorted(map(tuple, refused.collect()))
    assert sorted(map(tuple, ST.rebind_documents(store, requests)[1].collect())) == no
    assert sorted(map(repr, store.read("documents").collect())) == want
    rows = spark.createDataFrame([(900, 7, "y"), (901, 5000, "z")], "id long, document_id long, text string")
    ST.replace_texts(store, rows)
    assert sorted((r.id, r.text) for r in store.read("document_text").where("document_id = 7 or document_id > 900").collect()) == [(900, "y")]


def test_two_writers_and_growth(spark, store):
    other, number = ST.Store(spark, store.path), store.manifests.read()[0]
    read = ST.Manifests.read
    stale = other.manifests.read()
    ST.delete_documents(store, spark.createDataFrame([(1,)], "id long"))
    other.manifests.read = lambda: stale
    with pytest.raises(RuntimeError):
        ST.delete_documents(other, spark.createDataFrame([(2,)], "id long"))
    assert store.read("documents").where("id = 2").count() == 1 and read(store.manifests)[0] == number + 1
    whole = sorted(map(repr, store.read("documents").collect()))
    assert not store.grow("documents") and store.grow("documents", most=10)
    assert store.manifests.read()[1]["documents"]["buckets"] == 32 and sorted(map(repr, store.read("documents").collect())) == whole
    # an emptied table
    ST.delete_documents(store, store.read("documents").select("id"), {})
    assert store.read("documents").count() == 0 and store.read("documents").columns == SHAPE.replace(" long", "").replace(" string", "").replace(" boolean", "").split(", ")
