"""Forms that fail sooner, and rules found sooner, against the plain ones."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

NOISE = [" ", "\n", "\n\n", ".", ", ", ": ", "(", ")", "[3]", "#", "=> ", "{ \n", "};\n", "5", "12.5 ", "2023-04-05", "é", "가", "x", "Kim", "Smith et al. ", "aSmith et  al", "a.py", "b_c.json ", "\t", "™", "😀", "010-1234-5678", "@", "_9F3A"]


def texts(patterns, n=400, seed=5):
    r = random.Random(seed)
    words = sorted({w for p in patterns for w in re.findall(r"[A-Za-z]{2,}|[가-힣]+", p)})
    out = []
    for _ in range(n):
        t = [r.choice(words) if r.random() < 0.5 else r.choice(NOISE) for _ in range(r.randint(0, 60))]
        out.append("".join(x.upper() if r.random() < 0.1 else x for x in t))
    return out


def plain(pattern):
    return pattern.replace("(?m)", "(?md)").replace("(?im)", "(?imd)")


def test_quick_patterns_find_the_same_matches(spark):
    from corvane.functions import claims, classify, integrity, privacy, scores
    from corvane.functions.patterns import quick
    from corvane.operators import assets, curation

    every = [*classify.SIGNALS.values(), *classify.DOMAINS.values(), *classify.ACTIVITIES.values(), *classify.PAPER.values(), *classify.RECORD.values(), *classify.COMMIT_FLAGS.values(), classify.COMMIT_LINE, classify.CONVENTIONAL, classify.RESEARCH_CODE, classify.INFRA_CODE]
    every += [assets.UNIT, assets.NEGATIVE, assets.RETRY, assets.PROTOCOL, assets.REPLICATE, assets.DATE, scores.NUMBER_UNIT, claims.BOUND_BEFORE + scores.NUMBER_UNIT + claims.BOUND_AFTER, "(?i)" + claims.CLAIM, "(?i)" + claims.NOT_CLAIM, integrity.RECORD_UNIT]
    every += ["(?i)" + p for p in (integrity.ALCOA_UNIT, integrity.HALLUC_UNIT, integrity.CORRECTION, integrity.RECORD_INCOMPLETE, *integrity.COVER.values())]
    every += ["(?i)" + p for p in (curation.SUBJECT, curation.SUBJECT_LATIN, curation.HEALTH, curation.HEALTH_LATIN, curation.ADVERSE, curation.ADVERSE_LATIN, curation.CLINICAL, curation.NONHUMAN, *(b[0] for b in curation.BOUNDED.values()))]
    every += [f"(?>{p})(?!_[0-9A-F]{{4}})" for p, _ in privacy.RULES]
    assert sum(quick(plain(p)) != plain(p) for p in every) > 80
    d = spark.createDataFrame([(t,) for t in texts(every)], "t string").repartition(8).cache()
    for k in range(0, len(every), 12):
        some = [plain(p) for p in every[k : k + 12]]
        found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
        row = d.agg(*[F.count_if(found(p) != found(quick(p))).alias(f"d{j}") for j, p in enumerate(some)], *[F.sum(F.size(found(p))).alias(f"n{j}") for j, p in enumerate(some)]).first()
        assert all(row[f"d{j}"] == 0 for j in range(len(some))), [p for j, p in enumerate(some) if row[f"d{j}"]]
    from corvane.functions.patterns import bit, may

    for k in range(0, len(every), 30):
        some = every[k : k + 30]
        m = d.withColumn("m", may(F.col("t"), some))
        row = m.agg(*[F.count_if(~bit(F.col("m"), j) & F.col("t").rlike(plain(p))).alias(f"d{j}") for j, p in enumerate(some)], F.count_if(F.col("m") == 0).alias("none")).first()
        assert all(row[f"d{j}"] == 0 for j in range(len(some))), [p for j, p in enumerate(some) if row[f"d{j}"]]
        assert row["none"] > 0
    first = "(?i)" + curation.BOUNDED["pH"][0]  # groups keep their numbers
    assert spark.range(1).select(F.regexp_extract_all(F.lit("pH 15, ph: 3,5"), F.lit(quick(first)), F.lit(1))).first()[0] == ["15", "3,5"]


def test_rules_found_sooner_are_the_same():
    from corvane.functions import privacy as P

    def left(text):
        return sum(1 for p, _ in P.ALL_RULES for m in re.finditer(p, text) if not re.match(r"_[0-9A-F]{4}\b", text[m.end() : m.end() + 8]))

    def replaced(text, salt):
        put = 0
        for done in range(1, P.PASSES + 1):
            for pattern, prefix in P.ALL_RULES:

                def one(m, prefix=prefix):
                    nonlocal put
                    put += 1
                    value = m[1] if m.re.groups else m[0]
                    return m[0].replace(value, P.pseudonym(value, prefix, salt))

                text = re.sub(pattern, one, text)
            if not left(text):
                break
        return text, put, done, left(text)

    r = random.Random(9)
    bits = ["김민준", "박서연", "남궁민수", " ", " ", ": ", "：", "연구자", "작성자: ", "성명 ", "확인자:", "교수", "박사", "연구원", "님", "씨", "은", "a.b", "a_b%+", "@", "@c.kr", "c-d.co.kr", "x" * 64, "y", "010-1234-5678", "0101234567", "900101-1234567", "9001011234567", ".", "_9F3A", "\n", "공동"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        for k, (p, _) in enumerate(P.ALL_RULES):
            assert [m.span() for m in P.matches(k, t)] == [m.span() for m in re.finditer(p, t)], (p, t)
        assert P.judged(t, "s") == replaced(t, "s"), t


def test_rows_of_a_text_are_made_once(spark):
    from corvane.operators import classification, gateway

    d = spark.createDataFrame([(1, "an assay of 5 mg and 6 mg in vitro")], "doc_id long, text string")
    for rows in (classification.triage(d).select("bucket"), classification.domains(d).select("domain")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("substring(") == 1, plan
    pairs = spark.createDataFrame([(1, "the yield increases", "the yield decreases not")], "k long, p string, h string")
    weights = gateway.fitted_idf(d, "text")
    plan = gateway.fitted_entailment(pairs, ["k"], weights, "p", "h")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("arrays_overlap")  # polarities are judged below the explode, once a pair
