"""Rules on literal cases, most of them in languages the driver's tables lack."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.functions import scores as S
from corvane.functions import text as T
from corvane.operators import curation as C
from corvane.operators import evaluation as E
from corvane.operators import records as R
from corvane.operators import relations as J


def value(spark, c, **cols):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for k, v in cols.items()) or "x int"
    return spark.createDataFrame([tuple(cols.values()) or (1,)], kinds).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize("text, evidence, want", [
    ("10 mg 투여", "10 ug 투여", ["10mg"]), ("5 초 유지", "5 sec 유지", []), ("10 mM 용액", "10 mm 간격", []),
    ("1 g 투여", "1,000 mg 투여", []), ("1분당 60 증가", "1초당 1 증가", []),
])
def test_unit_swaps(spark, text, evidence, want):
    assert value(spark, S.unit_swaps(F.col("a"), F.col("b")), a=text, b=evidence) == want


@pytest.mark.parametrize("text, evidence, want", [("5,000 nM 처리", "5 uM 처리", ["5,000"]), ("2,927명 등록", "2927 명 등록", []), (None, None, [])])
def test_novel_numbers(spark, text, evidence, want):
    assert value(spark, S.novel_numbers(F.col("a"), F.col("b")), a=text, b=evidence) == want


def test_year_and_metadata_scores(spark):
    for a, b, want in ((2024, 2024, 1.0), (2024, 2023, 0.5), (2024, 2019, 0.0)):
        assert value(spark, S.year_similarity(F.col("a"), F.col("b")), a=a, b=b) == want
    none = F.lit(None).cast("double")
    assert value(spark, S.metadata_score(F.lit(1.0), none, none)) == pytest.approx(1.0)
    assert value(spark, S.metadata_score(none, none, none)) == 0.0


def test_cascade_and_decision(spark):
    for enc, llm, novel, swap, want in ((0.001, 0.7, False, False, 0.001), (0.95, 0.7, False, False, 0.95), (0.5, 0.7, False, False, 0.7), (0.99, 0.2, True, False, 0.2), (0.9, 0.9, False, True, 0.0)):
        assert value(spark, S.cascade(F.lit(enc), F.lit(llm), F.lit(swap), F.lit(novel))) == want
    for score, regen, want in ((0.9, 0, "pass"), (0.1, 0, "regen"), (0.1, 3, "block")):
        assert value(spark, S.decision(F.lit(score), F.lit(0.6), F.lit(True), F.array(), F.lit(regen))) == want


def test_mcnemar_and_wilson(spark):
    for b, d, want in ((0, 0, 1.0), (5, 5, 1.0), (0, 10, 2 / 2**10), (3, 9, 0.14599609375)):
        assert value(spark, S.mcnemar(F.col("b"), F.col("d")), b=b, d=d) == pytest.approx(want)
    low, high = S.wilson(F.col("k"), F.col("n"))
    assert value(spark, low, k=0, n=0) == 0 and value(spark, high, k=5, n=10) == pytest.approx(0.7634, abs=1e-3)


def test_tampered_numbers(spark):
    for s, want in (("held at 37 C", "held at 57 C"), ("n was 120 of 9", "n was 60 of 9"), ("dose 2.5 mg", "dose 2.25 mg"), ("dose 2.0 mg", "dose 2 mg"), ("none", None)):
        assert value(spark, S.tamper_number(F.col("s")), s=s) == want


def test_polarity(spark):
    tokens = lambda *w: F.array(*[F.lit(x) for x in w])
    assert value(spark, S.polarity_conflict(tokens("rate", "increased"), tokens("rate", "decreased")))
    assert value(spark, S.polarity_conflict(tokens("effect", "not"), tokens("effect")))
    assert not value(spark, S.polarity_conflict(tokens("rate"), tokens("rate", "up")))


def test_dates_particles_and_masks(spark):
    for s, want in (("2O24-O3-3O", "2024-03-30"), ("2024년 11월 1일", "2024-11-01일"), ("am 2024.1.2, bm 2O23/3/4", "am 2024-01-02, bm 2023-03-04"), ("no date", "no date")):
        assert value(spark, T.ocr_dates(F.col("s")), s=s) == want
    for s, want in (("서울대학교병원", True), ("연세대학교", False), ("abc", False)):
        assert value(spark, T.final_consonant(F.col("s")), s=s) is want
    assert value(spark, T.shape_mask(F.col("s")), s="김a1-Z9") == "KAD-AD"
    assert value(spark, T.unescape(F.col("s")), s=r"a\nb\tc\r\nd") == "a\nb\tc\nd"


def test_sensitive_and_bounded(spark):
    for s, want in (("환자에게 투여 후 부작용 관찰", ["adverse", "subject_health"]), ("홍길동은 당뇨 진단 후 투약", ["clinical"]), ("당뇨 유발 마우스 진단 키트", []), ("weather report", []), (None, [])):
        assert value(spark, C.sensitive_signals(F.col("s")), s=s) == want
    for s, want in (("pH 15.2", ["pH"]), ("pH 7.4, 수율 82%", []), ("수율 340%", ["수율"])):
        assert value(spark, C.bounded_violations(F.col("s")), s=s) == want


def test_gate_takes_duplicates_among_survivors_alone(spark):
    long = "text of letters and words " * 12
    rows = [(1, long), (2, long + " "), (3, "short"), (4, "1" * 400), (5, long + " side effect"), (6, long + " side effect"), (7, None), (8, long)]
    got = {r["doc_id"]: r["reason"] for r in C.gate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: None, 2: "dup", 3: "too_short", 4: "low_letter", 5: "sensitive", 6: "sensitive", 7: "too_short", 8: "dup"}
    assert C.gate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_auc_kappa_and_quantile_edges(spark):
    rows = lambda p, n: spark.createDataFrame([(x, 1) for x in p] + [(x, 0) for x in n], "s double, y int")
    auc = lambda p, n: E.auc(rows(p, n), "s", "y").first()["auc"]
    assert (auc([0.9, 0.8], [0.1, 0.2]), auc([0.1, 0.2], [0.9, 0.8]), auc([0.5], [0.5])) == (1.0, 0.0, 0.5)
    assert auc([0.5], []) != auc([0.5], [])
    k = lambda a, b: E.kappa(spark.createDataFrame(list(zip(a, b)), "a int, b int"), "a", "b").first()["kappa"]
    assert (k([1, 0, 1, 0], [1, 0, 1, 0]), k([1, 1, 0, 0], [1, 0, 1, 0]), k([1, 1], [1, 1])) == (1.0, 0.0, 1.0)
    q = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)], "g string, v long")
    assert E.upper_quantile(q, "v", "g").first()["quantile"] == 3


def test_audit_chain(spark):
    """Entries are hashed as JSON with sorted keys and a space after each colon and comma, content included."""
    import hashlib
    import json

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows, prev = [], "0" * 64
    for k, (action, content) in enumerate([("create", 'a "수율"\n\t\\'), ("sign", "a"), ("modify", "b"), ("view", "")]):
        e = {"seq": k, "ts": "t", "actor": "u", "action": action, "record_id": "r", "content": content, "content_sha256": sha(content or "b"), "reason": "", "meaning": "", "prev": prev}
        h = sha(json.dumps(e, ensure_ascii=False, sort_keys=True))
        rows.append(["c", k, "t", "u", action, "r", content, sha(content or "b"), None, None, prev, h])
        prev = h
    schema = "chain string, seq long, ts string, actor string, action string, record_id string, content string, content_sha256 string, reason string, meaning string, prev string, hash string"
    assert R.chain_findings(spark.createDataFrame(rows, schema)).count() == 0
    rows[0][6] = "tampered"
    assert [(r["seq"], r["finding"]) for r in R.chain_findings(spark.createDataFrame(rows, schema)).collect()] == [(0, "content"), (0, "hash")]
    del rows[1]
    assert {r["finding"] for r in R.chain_findings(spark.createDataFrame(rows, schema)).collect()} >= {"seq", "prev"}
    assert R.current_content(spark.createDataFrame(rows, schema)).first()["content"] == "b"


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 200)], "a long, b long")
    assert {r["node"]: r["root"] for r in J.components(e).collect()} == {**dict.fromkeys(range(1, 41), 1), 100: 100, 200: 100}


def test_sharing_pairs_lose_none(spark):
    import itertools
    import random

    r = random.Random(3)
    sets = {k: {f"w{r.randint(0, 30) ** 2 // 20}" for _ in range(8)} for k in range(40)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, w array<string>")
    got = {(x["a"], x["b"], x["shared"]) for x in J.sharing_pairs(df, "id", F.col("w"), 3).collect()}
    assert got == {(a, b, n) for a, b in itertools.combinations(sets, 2) if (n := len(sets[a] & sets[b])) >= 3}


def test_streaming_first_seen(spark, tmp_path):
    from corvane.streaming.dedup import first_seen

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a b"), (2, "a  b "), (3, "c")], "id long, text string").coalesce(1).write.json(src)
    stream = spark.readStream.schema("id long, text string").json(src)
    q = first_seen(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 2


def test_sources(spark, tmp_path):
    from corvane.sources import tables as S_

    f = tmp_path / "p.csv"
    f.write_text('id,NoteId,fileName,page,text\n1, n ,A.PDF,2,"x\\ny, ""q"""\n2,n,b,?,first\n')
    got = {r["id"]: r for r in S_.read_pages_csv(spark, str(f)).collect()}
    assert (got["1"]["page"], got["1"]["text"], got["1"]["note_id"], got["2"]["page"]) == (2, 'x\ny, "q"', "n", 0)
    n = S_.notes(S_.read_pages_csv(spark, str(f))).first()
    assert (n["n_pages"], n["text"]) == (2, 'first\n\nx\ny, "q"')
    S_.write_jsonl(spark.createDataFrame([(1, "é")], "a long, b string"), str(tmp_path / "j"))
    assert S_.read_jsonl(spark, str(tmp_path / "j")).collect()[0]["b"] == "é"
    assert S_.inventory(spark, str(f)).first()["files"] == 1
    m = spark.createDataFrame([({"b": [1], "a": [0, 2]},)], "m map<string, array<int>>")
    assert m.select(S_.inverted_index_text(F.col("m")).alias("t")).first()["t"] == "a b a"


def test_claims_and_evidence(spark):
    from corvane.functions import claims as Q

    for s, want in (("처리군의 수율이 대조군보다 유의하게 증가하였다", True), ("fix: increase the lower bound", False), ("보고서_결과 향상.pdf 확인됨 자료", False)):
        assert value(spark, Q.is_claim(F.col("s")), s=s) is want, s
    assert value(spark, Q.is_evidence(F.col("s")), s="반응 온도 37 ℃ 시료 농도 10 mM 조건")
    assert not value(spark, Q.is_evidence(F.col("s")), s="온도 37 ℃ 하나")
    assert value(spark, Q.exact_numbers(F.col("s")), s="60% 이하 및 25 ℃ 및 > 7 mM 제품 F-3340M-20") == ["25℃"]
    assert value(spark, Q.supports(F.col("a"), F.col("b")), a="수율 82% 달성", b="수율 82% 기록") and not value(spark, Q.supports(F.col("a"), F.col("b")), a="수율 달성", b="온도 기록")
    assert value(spark, Q.has_quantitative(F.col("s")), s="dose of 5 mg") and not value(spark, Q.has_quantitative(F.col("s")), s="in 2024")
    w = value(spark, Q.windows(F.col("s"), 40), s="first sentence here\nsecond sentence here\nthird sentence here\nfourth one")
    assert w == ["first sentence here second sentence here"[:40], "second sentence here third sentence here", "third sentence here fourth one"]


def test_record_integrity(spark):
    from corvane.functions import integrity as I

    good = "과제명: 가\n연구자: 김민준\n점검자: 이서연\n실험일: 2024-03-01\n기록일: 2024-03-02\n4. 결과\n수율 82 % 온도 37 ℃\n5. 고찰\n수율은 82 %로 확인되었다. 차기에는 90 %를 검토할 예정이다.\n"
    one = lambda f, s, **k: value(spark, f(F.col("s")), s=s)
    assert [one(f, good) for f in (I.attributable, I.contemporaneous, I.complete, I.consistent)] == [1.0] * 4
    assert one(I.attributable, good.replace("이서연", "(서명 없음)")) == pytest.approx(0.6)
    assert one(I.contemporaneous, good.replace("03-02", "03-19")) == pytest.approx(0.5) and one(I.contemporaneous, good.replace("03-02", "02-02")) == 0.0
    assert one(I.consistent, good.replace("수율은 82", "수율은 72")) == 0.0 and one(I.complete, good + "추후 기재") == 0.0
    ori = lambda a, b: value(spark, I.original(F.col("a"), F.col("b")), a=a, b=b)
    assert (ori(good.replace("37 ℃", "25 ℃"), good), ori(good, good), ori(good.replace("37 ℃", "25 ℃") + "정정 이력", good), ori(good, None)) == (0.0, 1.0, 1.0, 1.0)
    assert value(spark, I.changed_numbers(F.col("a"), F.col("b")), a="at 25 ℃ and 5 mg", b="at 37 ℃") == 1.0
    assert one(I.specimen_findings, "검체 채취") == ["id", "date"] and one(I.specimen_findings, "no such") == []
    assert one(I.projects, "과제명: 가\n과제명: 나") == 2 and len(one(I.undocumented_deviations, "계획 변경 있음.\n이탈 사유 승인")) == 1
    assert value(spark, I.alcoa(F.col("s"), F.lit(True), F.lit(True)), s="10 % 20 % 30 % TBD") == pytest.approx(0.375)


def test_pseudonyms(spark):
    from corvane.functions import privacy as P

    s = "연구자: 김민준 010-1234-5678 a.b@c.kr 900101-1234567 연구자: 김민준"
    a, b = (value(spark, P.deidentified(F.col("s"), salt), s=s) for salt in ("x", "y"))
    assert a != b and not any(x in a for x in ("김민준", "010-1234", "a.b@c.kr", "900101"))
    assert len(set(__import__("re").findall("연구자_[0-9A-F]{4}", a))) == 1
    assert value(spark, P.residual(F.col("s")), s=a) == 0 and value(spark, P.deidentified(F.col("s"), "x"), s=None) is None


def test_judges(spark):
    from corvane.operators import judging as G

    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    assert value(spark, G.consensus(arr(0.9, 0.9, 0.9), [0.5, 0.5, 0.5])) == "entail" and value(spark, G.consensus(arr(0.9, 0.1, 0.1), [0.5] * 3)) == "neutral"
    assert value(spark, G.consensus(arr(0.9, 0.9, 0.1), [0.5] * 3)) is None
    assert not value(spark, G.passed(F.array().cast("array<double>"))) and value(spark, G.passed(arr(0.6, 0.7)))
    assert value(spark, G.line_consensus(F.array(arr(0.9, 0.9, 0.1, 0.9)), 4)) and not value(spark, G.line_consensus(F.array(arr(0.9, 0.1)), 2))


def test_citations_against_a_registry(spark):
    from corvane.operators import judging as G

    reg = spark.createDataFrame([("10.1/A", "Deep learning for protein folding", 2021, 1), ("10.1/b", "Old title", 2000, 2), ("10.1/B", "Transfer of thermal energy in alloys", 2019, 3)], "doi string, title string, year int, position int")
    cites = [(1, "10.1/a", "Deep Learning for Protein Folding", 2021), (2, "10.9/none", "Nothing like these words", 2020), (3, None, "Transfer of thermal energy in alloys", 2019), (4, None, None, None), (5, "10.1/a", "Deep learning for protein folding", 2011), (6, "10.1/b", None, None)]
    got = {r["id"]: r["status"] for r in G.verify_citations(spark.createDataFrame(cites, "id int, doi string, title string, year int"), reg).collect()}
    assert got == {1: "valid", 2: "hallucinated", 3: "valid", 4: "unverified", 5: "partially_valid", 6: "valid"}


def test_citations_in_texts(spark):
    from corvane.functions import citations as Q

    c = lambda s, merge=True: value(spark, Q.citations(F.col("s"), merge), s=s)
    s = "Claim here. (Alam et al. (2024); DOI: 10.1101/2024.01.02)"
    assert len(c(s)) == 1 and c(s)[0]["year"] == 2024 and c(s)[0]["doi"] == "10.1101/2024.01.02" and len(c(s, False)) == 2
    assert c("김철수 외 (2023)에 따르면 증가")[0]["year"] == 2023
    k = c("본문 (출처: 서울대학교병원, 2020, 과제번호 NCT04490642)")[0]
    assert (k["author"], k["year"], k["doi"]) == ("서울대학교병원", 2020, "NCT04490642")
    assert c("no source at all") == [] and c(None) == []
    b = lambda *x: F.array(*[F.lit(v) for v in x])
    assert value(spark, Q.covered(b(False, True, False, False))) == 0.5 and value(spark, Q.covered(b(False))) == 0.0


def test_note_fields_and_sections(spark):
    from corvane.functions import notes as N

    s = "과제번호: A-1\n과제명: 합성\n연구자: 김민준\n1. 실험 목적\n수율 확인\n2. 재료 및 방법\n가열\n4. 실험 결과\n82 %\n5. 고찰\n좋다\n"
    m, p = value(spark, N.meta(F.col("s")), s=s), value(spark, N.sections(F.col("s")), s=s)
    assert (m["project_no"], m["researcher"]) == ("A-1", "김민준") and set(p) == {"purpose", "methods", "results", "discussion"}
    assert p["discussion"] == "좋다" and p["purpose"].startswith("수율 확인")


def test_bootstrap_and_grid(spark):
    rows = spark.createDataFrame([(k // 4, 1.0 if k % 10 < 3 else 0.0) for k in range(400)], "c int, d double")
    t = E.cluster_bootstrap(rows, "c", "d", 200).first()
    assert t["mean"] == pytest.approx(0.3) and 0.2 < t["low"] < 0.3 < t["high"] < 0.4
    g = spark.createDataFrame([(0.9, 0.9, 1), (0.6, 0.1, 0), (0.4, 0.9, 1), (0.1, 0.0, 0)], "e double, l double, y int")
    best = E.grid_search(g, "e", "l", "y", [0.0, 0.2, 0.45], [0.5, 0.8]).first()
    assert (best["lo"], best["hi"], best["f1"], best["calls"]) == (0.2, 0.8, 1.0, 2)
