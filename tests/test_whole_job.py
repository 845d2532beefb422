"""Results that need the whole text, the whole registry or the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F


def test_residual_shapes_stand_anywhere(spark):
    from corvane.functions import privacy as P

    texts = ["x" * 5000 + " 문의 010-1234-5678 끝", "연구자: 김민준, 메일 a.b@c.kr", "연구자: 연구자_9F3A 만", "a@b.co,c@d.co", None, ""]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(F.inline(P.residual_shapes(F.col("text"))))
    want = [
        ("연락처", "AAAAAAAAAA KK DDD-DDDD-DDDD K"),
        ("이메일", "KKK: KKK, KK A.A@A.AA"), ("연구자", "KKK: KKK, KK A.A@A.AA"),
        ("이메일", "A@A.AA,A@A.AA"), ("이메일", "A@A.AA,A@A.AA"),
    ]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_citations_are_sought_in_the_whole_registry(spark):
    """Against the reference's rule written plainly: the equal title's last record, else the best of the five nearest."""
    import difflib
    import random

    from corvane.operators import judging as G

    r = random.Random(7)
    titles = ["김치 유산균 연구", "빛과 열의 합", "물 속 빛 열", "a b c of d", "deep learning for proteins", "ab cd"]
    titles += [" ".join("".join(r.choice("abcde") for _ in range(r.randint(2, 6))) for _ in range(r.randint(2, 5))) for _ in range(60)]
    reg = [(f"10.1/{k}", t, r.choice([2019, 2020, 2021, None]), k) for k, t in enumerate(titles * 2)] + [(None, "deep learning for proteins", y, 900 + k) for k, y in enumerate(range(2000, 2008))]
    cites = [(None, "김치 유산균 연구", 2020), (None, "빛과 열의 합", None), ("10.9/no", "a b c of d", 2019), (None, "deeq leaming fer protelns", 2021), (None, "물 속 빛 옅", 2020), (None, "zz", 2020)]
    for _ in range(40):
        t = list(r.choice(titles))
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice("abcdexyz ")
        cites.append((None, "".join(t), r.choice([2019, 2020, 2021, None])))
    cites = [(k, *c) for k, c in enumerate(cites)]

    def score(x, a, b):
        return x if a is None or b is None else (0.6 * x + 0.1 * {0: 1.0, 1: 0.5}.get(abs(a - b), 0.0)) / 0.7

    def plain(title, year):
        t = " ".join(title.lower().split())
        if same := [y for _, u, y, _ in reg if u == t]:
            return score(1.0, year, same[-1])
        by = sorted(((difflib.SequenceMatcher(None, t, u).ratio(), y) for _, u, y, _ in reg), key=lambda p: -p[0])[:5]
        return max([score(x, year, y) for x, y in by if x > 0], default=0.0)

    old = G.CITE_BLOCK, G.TITLE_BLOCK
    G.CITE_BLOCK, G.TITLE_BLOCK = 7, 11  # many blocks
    try:
        df = spark.createDataFrame(cites, "id int, doi string, title string, year int")
        got = {x["id"]: x for x in G.verify_citations(df, spark.createDataFrame(reg, "doi string, title string, year int, position int")).collect()}
    finally:
        G.CITE_BLOCK, G.TITLE_BLOCK = old
    for k, _, title, year in cites:
        want = plain(title, year)
        assert abs(got[k]["score"] - want) < 1e-9, (title, got[k], want)
        assert got[k]["status"] == ("valid" if want >= 0.92 else "partially_valid" if want >= 0.70 else "hallucinated")
