"""What a Python worker holds between tasks."""

from __future__ import annotations

import subprocess
import sys

from conftest import ROOT

import corpus_pipeline
from corvane.llm import packing, toxicity
from corvane.llm.common import documents, keyed_texts

HELD = """
import re
import pyarrow as pa
from corvane.llm.common import texts

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    for k in range(4):
        pool = [chr(97 + k) * (1500 + j % 999) for j in range(10_000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(pool)], names=["doc_id", "text"])

before = held()
for _ in texts(batches()):
    pass
print(held() - before)
"""


def test_a_worker_gives_back_what_it_has_read():
    said = subprocess.run([sys.executable, "-c", HELD], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert float(said) < 60  # MB, of 80 read; 142 where nothing is given back


def test_small_tables_change_no_result(spark, small):
    rows = keyed_texts(documents(spark, small))
    grams = [{r["g"] for r in toxicity.corpus_grams(rows, *most).collect()} for most in ((1 << 30, 1 << 30), (50, 100))]
    assert grams[0] == grams[1] == {g for r in rows.collect() for w in toxicity.words_of(r["text"]) for g in toxicity.word_grams(w)}


def test_the_pipeline_packs_with_a_table_of_its_own(spark, small):
    docs = documents(spark, small)
    assert corpus_pipeline.TABLE_BYTES < packing.TABLE_BYTES // 2
    columns = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got, want = (sorted(map(tuple, df.select(*columns).collect())) for df in (corpus_pipeline.packing_stage(spark, docs, small), packing.pack(docs)))
    assert got == want and got
