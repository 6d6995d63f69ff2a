import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.functions.materialize import ROW_GROUP, stored
from loomspark.llm import quality, queries
from tests.llm import tables
from tests.llm.test_documents import fingerprint, rejected

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "quality classifier", "near duplicates", "source mix", "packing"]
    results = []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF).cache()
        results.append(kept)
    assert all(r.columns == columns for r in results[:-1])
    ids = [[r["doc_id"] for r in x.collect()] for x in results]
    assert Counter(ids[0]) == Counter(i for i, t in texts.items() if not rejected(t))
    assert set(ids[1]) <= set(ids[0]) and not [i for i in set(ids[0]) - set(ids[1]) if quality.get(i) == 1]
    fp = np.array([fingerprint(texts[i]) for i in sorted(ids[1])], np.uint64)
    label = np.arange(len(fp))
    while True:  # smallest place of a class by plain propagation
        after = np.array([label[np.bitwise_count(fp ^ f) <= 3].min() for f in fp])
        if (after == label).all():
            break
        label = after
    assert sorted(ids[2]) == sorted({sorted(ids[1])[c] for c in label})
    assert set(ids[3]) <= set(ids[2]) and max(Counter(ids[3]).values()) <= 3
    copies = Counter(ids[3])
    tokens = Counter()
    for r in results[4].collect():
        tokens[r["doc_id"]] += r["length"]
    per = {r["doc_id"]: r["doc_tokens"] for r in results[4].collect()}
    assert tokens == Counter({i: n * per[i] for i, n in copies.items()})


def test_classifier_stage_acts_on_what_reaches_it(spark):
    """The rules leave it next to nothing, so it is judged here on all documents: on labels that it has not learned from."""
    folder = "/root/testdata/sf0.01"
    kept = {r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).select("doc_id").collect()}
    held = [(r["doc_id"] in kept, r["quality"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    bad, good = [k for k, q in held if q == 0], [k for k, q in held if q == 1]
    assert len(bad) >= 10 and sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.99 * len(good)


def test_run_gives_what_the_stages_give(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    pieces = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.collect() if r["start"] == 0)
    assert pieces(corpus_pipeline.run(spark, SF)) == pieces(docs)


def test_run_hands_stages_on_as_parquet(spark, monkeypatch):
    read = []
    note = lambda name, stage: (name, lambda s, docs, folder: read.append(docs) or stage(s, docs, folder))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [note(*x) for x in corpus_pipeline.STAGES])
    corpus_pipeline.run(spark, SF)
    for (name, _), docs in zip(corpus_pipeline.STAGES, read[1:]):
        files = docs.inputFiles()
        assert files and all(f.endswith(".parquet") and f"/{name.replace(' ', '_')}-" in f for f in files)


def test_stages_take_awkward_and_empty_tables(spark):
    for docs in (tables.docs(spark), tables.none(spark)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            assert k == 4 or docs.columns == columns
        docs.collect()


def test_stages_take_texts_that_are_not_utf8(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    broken = F.expr("CAST(concat(CAST(text AS BINARY), X'20FFFE20C3') AS STRING)")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, broken).otherwise(F.col("text")))
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in quality.with_score(docs, model).collect() if r["score"] >= model.least}
    assert any(i % 3 == 0 for i in good)
    assert {r["doc_id"] for r in quality.keep_good(docs, model).select("doc_id").collect()} == good
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert any(r["doc_id"] % 3 == 0 for r in docs.collect())


def test_stages_hand_on_small_row_groups(spark):
    """Else a task holds 128 MB that it writes, and 128 MB that it reads, in the next stage."""
    docs = spark.range(0, 16000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(*[F.sha2((F.col("id") * 40 + k).cast("string"), 256) for k in range(40)]).alias("text"))
    got = stored(docs, "row groups")
    (path,) = got.inputFiles()
    groups = pq.ParquetFile(path.removeprefix("file://")).metadata
    assert got.count() == 16000
    sizes = [groups.row_group(k).column(1).total_compressed_size for k in range(groups.num_row_groups)]
    assert sum(sizes) > 2 * ROW_GROUP and max(sizes) < 1.5 * ROW_GROUP


def test_every_query_is_registered():
    found = queries.QUERIES
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(found)
