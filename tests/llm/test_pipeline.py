"""The pipeline, stage by stage, against plain Python on a small planted corpus."""

import random

import pytest
from pyspark.sql import functions as F

from quireworks.llm import common, toxicity
from quireworks.llm.queries import tokenizer_path
from test_operators import WORDS, brute_links, brute_overlaps, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """documents, labels and benchmark with planted toxic texts, copies, near copies and passages."""
    rng, rows, labels = random.Random(41), [], []
    items = [(i, prose(rng, 25)) for i in range(6)] + [(7, None)]
    for i in range(420):
        words = prose(rng, 50).split()
        if i % 5 == 0:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(["vilewort", "vilerisch", "nastyx", "foulness."]))
        elif i % 7 == 0:
            words[20:20] = items[i % 6][1].split()
        rows.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, int(i % 5 == 0)))
    rows += [(1000 + i, rows[i][1].replace(" ", "  ", 3)) for i in range(0, 200, 3)]
    rows += [(2000 + i, rows[i][1] + " more") for i in range(0, 300, 11)]
    rows += [(3000, None), (3001, ""), (3002, "short one"), rows[1], (3003, "x" * 100_000)]
    rng.shuffle(rows)
    place = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "score": F.lit(1), "Hit": F.lit(2), "sha": F.lit("s")})
    docs.repartition(5).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def test_stages_against_brute_force(spark, corpus):
    import corpus_pipeline
    from tokenizers import Tokenizer

    steps = dict(corpus_pipeline.STAGES)
    held = lambda df: common.stage(df, "test-stage")[0]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    texts = lambda df: sorted((r.doc_id, r.text or "") for r in df.collect())

    clean = held(steps["toxicity"](spark, docs, corpus))
    kept = texts(clean)
    vile = {i for i, t in texts(docs) if any(w in t for w in ("vilewort", "vilerisch", "nastyx", "foulness"))}
    gone = {i for i, _ in texts(docs)} - {i for i, _ in kept}
    assert gone <= vile and len(gone) > 0.9 * len(vile)
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"))).collect()}
    assert kept == sorted((i, t) for i, t in texts(docs) if not scores[i])

    single = held(steps["exact_dedup"](spark, clean, corpus))
    first = {}
    for i, t in kept:
        key = " ".join(t.split(" ")) if "  " not in t else __import__("re").sub(" +", " ", t)
        first.setdefault(key, i)
    assert [i for i, _ in texts(single)] == sorted(first.values())

    apart = held(steps["near_duplicates"](spark, single, corpus))
    _, classes = brute_links(texts(single))
    assert [i for i, _ in texts(apart)] == sorted(set(classes.values()))

    pure = held(steps["decontamination"](spark, apart, corpus))
    items = [r.text for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect() if r.text]
    assert [i for i, _ in texts(pure)] == [i for i, t in texts(apart) if not any(brute_overlaps(t, x) for x in items)]
    assert pure.columns == docs.columns

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = {}
    before = len(common.STAGED)
    for p in corpus_pipeline.run(spark, corpus).collect():
        pieces.setdefault(p.doc_id, []).append((p.start, memoryview(bytes(p.ids)).cast("I").tolist()))
    assert {i: [x for _, ids in sorted(v) for x in ids] for i, v in pieces.items()} == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts(pure)}
    assert len(common.STAGED) == before + 1  # only the result's own table is left
    assert len(WORDS) == 400


def test_empty_corpus(spark, corpus, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
