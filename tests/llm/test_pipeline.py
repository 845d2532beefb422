"""The pipeline's stages one by one, against plain versions of what each must do."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from corvane.llm import mixing, secret_crf, simhash, toxicity
from corvane.llm.common import documents


def test_stages_in_order(spark, small, tmp_path):
    docs = documents(spark, small)
    first = docs
    steps = {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = steps.get("last", first)
        f(spark, before, small).write.parquet(str(tmp_path / name))
        steps[name] = steps["last"] = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert steps[name].columns == docs.columns
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    labels = spark.read.parquet(f"{small}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.score(docs, labels).collect() if r["predicted"]}
    assert toxic and Counter(ids(steps["toxicity"])) == Counter(set(ids(docs)) - toxic)
    groups = {r["component_id"] for r in simhash.near_duplicates(steps["toxicity"]).collect()}
    assert Counter(ids(steps["near_dedup"])) == Counter(groups)
    texts = {r["doc_id"]: r["text"] for r in steps["secrets"].collect()}
    model = secret_crf.train()
    for r in steps["near_dedup"].collect():
        assert texts[r["doc_id"]] == secret_crf.redact(r["text"], model)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(steps["secrets"]).collect() if r["taken"]}
    words = Counter()
    for r in steps["mixing"].collect():
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert {k: v for k, v in words.items() if v} == taken
    copies = Counter(ids(steps["mixing"]))
    per = Counter()
    for r in steps["packing"].collect():
        per[r["doc_id"]] += r["length"]
    assert per.keys() == copies.keys()


def test_run_is_all_stages(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got.columns)
    assert got.count() > 0
