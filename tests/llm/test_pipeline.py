import corpus_pipeline
from lexiloom.llm import bpe, langid, mixing, secrets, simhash

from . import brute_force
from .test_simhash import edited_texts

DIR = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    """Each stage against what its operator decides on the whole of the stage's own input."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        before, rows = docs.collect(), after.collect()
        if k < 4:
            assert after.columns == docs.columns
        if name == "language ID":
            bad = {r["doc_id"] for r in langid.identify_languages(docs).filter("not accepted").collect()}
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before} - bad
        elif name == "near-dedup":
            fps, _ = simhash.fingerprints([r["text"] for r in before])
            fps = fps.view("uint64")
            kept = {r["doc_id"] for r in rows}
            near = [(before[a]["doc_id"], before[b]["doc_id"]) for a in range(len(before)) for b in range(a) if simhash.hamming(fps[a], fps[b]) <= simhash.MAX_DISTANCE]
            assert near and sum(a in kept and b in kept for a, b in near) <= 0.1 * len(near)
            assert kept >= {r["doc_id"] for r in before} - {i for p in near for i in p}
        elif name == "secrets":
            assert len(rows) == len(before) and not secrets.scan_secrets(after).count()
        elif name == "mixing":
            want = mixing.mix_sources(docs, marks=True).groupBy("doc_id").count().collect()
            got = after.groupBy("doc_id").count().collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want))
        else:
            assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in before)
            assert all(len(r["token_ids"]) == r["n_tokens"] > 0 for r in rows)
        sizes.append(len(rows))
        docs = after
    assert corpus_pipeline.run(spark, DIR).count() == sizes[-1]


def test_near_dedup_keeps_no_pair_near_the_limit(spark):
    texts = edited_texts()
    _, want = brute_force.near_groups(list(range(len(texts))), texts, simhash.MAX_DISTANCE)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.deduplicate(spark, docs, DIR).collect())
    assert kept == [i for i in range(len(texts)) if i not in want]
