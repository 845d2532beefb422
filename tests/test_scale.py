"""Operators whose rows depend on order or on repeated keys, over many partitions."""

from __future__ import annotations

from pyspark.sql import functions as F


def test_every_nth_row_of_many_partitions(spark):
    from corvane.operators import curation as C

    n = 1_200_000
    wide = spark.range(n, numPartitions=13).select(((F.col("id") * 7919) % n).alias("k"), *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(j))), 256).alias(f"w{j}") for j in range(4)])
    got = C.every_nth(wide, "k", 1000)
    assert got.columns == wide.columns
    assert sorted(r["k"] for r in got.select("k").collect()) == list(range(0, n, 1000))
    assert C.every_nth(wide.limit(0), "k", 10).count() == 0


def test_gate_keeps_a_row_for_each_row(spark):
    from corvane.operators import curation as C

    text = "words of a long enough text " * 10
    rows = [(1, text), (1, text), (1, text + "b"), (2, text), (3, None), (None, text + "c"), (None, text + "c"), (0, "  " + text.replace(" ", "\n"))]
    got = C.gate(spark.createDataFrame(rows, "doc_id long, text string"), carry=["text"])
    assert got.count() == len(rows)
    passed = sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(r["text"])) for r in got.where("reason is null").collect())
    assert passed == [(-1, len(text) + 1), (0, len(text) + 2), (1, len(text) + 1)]
    assert got.where("reason = 'too_short'").count() == 1
    scans = C.gate(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "text" not in scans  # what is joined is what was written


def test_gate_of_many_copies(spark):
    from corvane.operators import curation as C

    text = F.concat(F.repeat(F.lit("one long text "), 30), F.when(F.col("id") % 3 == 0, "").otherwise((F.col("id") % 5000).cast("string")))
    got = C.gate(spark.range(200_000, numPartitions=9).select(F.col("id").alias("doc_id"), text.alias("text")))
    kinds = {r["reason"]: r["count"] for r in got.groupBy("reason").count().collect()}
    assert kinds[None] == 5001 and sum(kinds.values()) == 200_000


def test_triples_contradict_in_the_shared_number_alone(spark):
    from corvane.operators import claim_evidence as E
    from corvane.plans.generation import claim_rows

    s = E.sentences(claim_rows(spark, "/root/testdata/sf0.001").where("doc < 40"), "doc").withColumn("id", F.xxhash64("doc", "place", "sentence"))
    rows = E.triples(s.where("claim"), s.where("evidence")).collect()
    by = {}
    for r in rows:
        by.setdefault((r["doc"], r["claim"]), {})[r["label"]] = r
    assert len(by) > 40 and all(set(x) == {"entail", "neutral", "contradict"} for x in by.values())
    for x in by.values():
        said, right, wrong, far = x["entail"]["said"].split(), x["entail"]["text"].split(), x["contradict"]["text"].split(), x["neutral"]["text"].split()
        number = said[said.index("mg") - 1]
        assert number in right and number not in wrong and right.index(number) >= 0
        assert [w for w in right if w != number] == [b for a, b in zip(right, wrong) if a != number]  # nothing else changed
        assert far[far.index("mg") - 1] != number and len(set(said) & set(far)) >= 2


def test_pieces_keep_their_digits(spark):
    from corvane.functions import text as T

    got = spark.createDataFrame([("0 ab 1\n 1 cd 2! 2 e 3. 12 x",)], "t string").select(T.claims(F.col("t"))).first()
    assert got[0] == ["0 ab 1", "1 cd 2!", "2 e 3.", "12 x"]


def test_sources_are_bounded_and_confined(spark, tmp_path):
    import pytest

    from corvane.sources import tables as S

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.txt").write_text("abc")
    (tmp_path / "y.txt").write_text("de")
    got = S.inventory(spark, str(tmp_path)).first()
    assert (got["ext"], got["files"], got["bytes"], got["depth"]) == (".txt", 2, 5, 3)
    assert S.confined("/data/x/../y", "/data") == "/data/x/../y"
    with pytest.raises(ValueError):
        S.confined("/data/../etc", "/data")
    csv = tmp_path / "p.csv"
    csv.write_text("id,NoteId,fileName,page,text\n" + "".join(f"{k},n,f,{k},t\n" for k in range(9)))
    assert sorted(r["page"] for r in S.read_pages_csv(spark, str(csv), skip=2, limit=3).collect()) == [2, 3, 4]
