"""The index of segments against scores from the texts, after changes, removals, merges and failed writes."""

import random

import pytest
from pyspark.sql import functions as F

from quireworks.operators import search as S
from quireworks.operators.segments import SegmentIndex
from quireworks.sources.manifests import Manifests, children

QUERIES = [(1, "al be"), (2, "x"), (3, "gamma one"), (4, "é")]


def scores(df):
    return {(r.query_id, r.doc_id): round(r.score, 9) for r in df.collect()}


def test_segments_equal_texts(spark, tmp_path):
    rng = random.Random(4)
    words = ["alpha", "Álpine", "beta", "gamma", "x1", "one", "été", "x"]
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    index, living = SegmentIndex(spark, str(tmp_path / "i"), fan=2), {}
    for batch in range(5):
        ids = rng.sample(range(40), 25 if not batch else 9)
        rows = [(i, None if rng.random() < 0.3 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in ids]
        before = {n for n in children(spark, index.path)}
        index.apply(spark.createDataFrame(rows, "doc_id long, text string"), batch)
        assert before <= set(children(spark, index.path))  # nothing old is rewritten
        living.update(rows)
        now = spark.createDataFrame([(i, t) for i, t in living.items() if t is not None], "doc_id long, text string")
        state = index.state()[1]
        assert (state["n_docs"], state["n_tokens"]) == tuple(now.agg(F.count("*"), F.sum(F.size(S.tokens_of(F.col("text"))))).first())
        assert scores(index.scored(queries)) == scores(S.scored(now, queries))
    assert sorted(map(tuple, index.texts().collect())) == sorted(map(tuple, now.collect()))
    assert sorted(map(tuple, index.postings(S.search_parse(queries.where("query_id = 2"))).collect())) == sorted(map(tuple, S.build_postings(now)[0].where("term like 'x%'").collect()))
    assert len(state["segments"]) == 2  # five batches: one of four, one of one
    index.vacuum()
    assert len([n for n in children(spark, index.path) if n.startswith("segment-")]) == 2 and scores(index.scored(queries)) == scores(S.scored(now, queries))
    index.apply(spark.createDataFrame([(0, "again")], "doc_id long, text string"), 4)  # a batch sent again
    assert index.state()[1] == state


def test_failed_batches_leave_the_state(spark, tmp_path, monkeypatch):
    index = SegmentIndex(spark, str(tmp_path / "i"))
    assert index.texts().count() == 0 and index.postings().count() == 0
    index.apply(spark.createDataFrame([(1, "one two")], "doc_id long, text string"))

    def broken(self, postings, place):
        raise OSError("disk full")

    monkeypatch.setattr(SegmentIndex, "_write_postings", broken)
    with pytest.raises(OSError):
        index.apply(spark.createDataFrame([(1, "three")], "doc_id long, text string"))
    monkeypatch.undo()
    assert [r.text for r in index.texts().collect()] == ["one two"] and index.state()[1]["n_tokens"] == 2
    # two writers that began from the same state
    first, second = Manifests(spark, str(tmp_path / "m")), Manifests(spark, str(tmp_path / "m"))
    first.commit(0, {"a": 1})
    with pytest.raises(RuntimeError):
        second.commit(0, {"a": 2})
    assert second.read() == (1, {"a": 1})
