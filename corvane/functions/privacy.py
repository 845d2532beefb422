"""Pseudonyms for personal data; the same value has the same pseudonym under the same salt."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import quick

# Surnames, words that begin like names but are none, and what is replaced, in this order, with the pseudonym's prefix.
SURNAME = "김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용예경봉사부"
NOT_NAME = (
    "(?:공동|참여|담당|외부|소속|해당|전체|신규|기존|주관|위탁|객원|학생|대학원|연구|기술|"
    "실험|분석|품질|개발|기획|영업|관리|생산|이번|이전|정부|조사|장비|고객|전문|선임|수석|"
    "책임|주임|박사|교수|대표|원장|소장|사업|부서|본부|센터|각|모든|현|전|신임|"
    "인턴|파견|계약|정규|비정규|우리|귀사|당사|협력|연구소|고객사|협력사|회사|"
    "연구실|연구팀|연구진|회의|의견|검토|요청|확인|승인|면담|미팅|문의|보고|지시|결재|"
    "석사|이름|성명|서명|주소|"
    "구분|현황|이미지|소속|직위|직급|명칭|대상|비고|기관|"
    "오전|오후|제목|변경|제조일|채용|모집|공고|국토|경제|공학|기계|유사한|어머)(?![가-힣])"
    "|(?:선임|책임|수석|주임|박사후|석사후|전임|사외|사내|지도|선생|사장|부사장|이사|"
    "한국|서울|부산|대구|광주|대전|울산|세종|경기|강원|충남|충북|전남|전북|경남|경북|제주|"
    "국립|고등|첨단|미래|산업|연구|기반|고객|사용자|회원|공동|박사|전무|상무|담당|참여|학생|선배|후배|"
    "차장|원장|부장|소장|강사|팀장|실장|과장|대리|사원|기사|부모|인건비|전공|선택|부재|기술)"
)
RULES = [
    (r"\d{6}\s*[-–]\s*[1-4]\d{6}", "주민번호"),
    (r"01[016789][-. ]?\d{3,4}[-. ]?\d{4}", "연락처"),
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+", "이메일"),
    (r"(?<=연구자[:： ])\s*([가-힣]{2,4})", "연구자"),
    (r"(?<=작성자[:： ])\s*([가-힣]{2,4})", "작성자"),
    (r"(?<=점검자[:： ])\s*([가-힣]{2,4})", "점검자"),
    (r"(?<=확인자[:： ])\s*([가-힣]{2,4})", "확인자"),
    (r"(?<=성명[:： ])\s*([가-힣]{2,4})", "성명"),
]
#: Names before and after titles; their look-around keeps them out of SQL, so the shapes and sums over RULES leave them aside.
NAME_RULES = [
    (
        r"(?<![가-힣])((?!" + NOT_NAME + r")[" + SURNAME + r"][가-힣]{1,3}(?<![의을를은는와과로에]))\s?"
        r"(?=(?:책임|선임|수석|주임)?(?:연구원|변리사|변호사|박사|교수|대표|이사|팀장|실장|과장|부장|"
        r"원장|소장|센터장|님|씨)(?![가-힣]{2}))",
        "인명",
    ),
    (
        r"(?:연구원|변리사|변호사|박사|교수|대표|팀장|실장)\s((?!" + NOT_NAME + r")"
        r"(?:(?:(?:남궁|황보|제갈|선우|독고|사공|서문)[가-힣]{1,2}|[" + SURNAME + r"][가-힣]{2})"
        r"(?<![의을를은는와과로에이가])(?=(?:은|는|이|가|을|를|과|와|의|에게|께서|께|도|만)?(?![가-힣_]))"
        r"|[" + SURNAME + r"][가-힣](?![가-힣_])))",
        "인명",
    ),
]
ALL_RULES = RULES + NAME_RULES
PASSES = 5
#: Characters on either side of a match that its shape takes in.
CONTEXT = 14


def pseudonym(value: str, prefix: str, salt: str) -> str:
    return f"{prefix}_{hashlib.sha256(f'{salt}::{value.strip()}'.encode()).hexdigest()[:4].upper()}"


#: Without any of these no rule matches.
ANY = re.compile(r"[@가-힣]|01[016789]|\d{6}\s*[-–]")
HANGUL = re.compile("[가-힣]+")
#: What a text must hold for a rule to match: a plain string, by the rule's prefix.
NEEDS = {"연락처": "01", "이메일": "@"} | {name: name for _, name in RULES[3:]}
COMPILED = [(re.compile(p), prefix) for p, prefix in ALL_RULES]
LABELS = {prefix: re.compile(prefix + "[:： ]") for _, prefix in RULES[3:]}
MAIL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _mails(text: str) -> Iterator[int]:
    at = text.find("@")
    while at >= 0:
        k = at
        while k > 0 and at - k <= 64 and text[k - 1] in MAIL:
            k -= 1
        if 0 < at - k <= 64:
            yield k
        at = text.find("@", at + 1)


def _begins(k: int, prefix: str, text: str) -> Iterator[int] | None:
    """Where a rule's match can begin, from left to right; None: anywhere.

    A name before a title begins with a run of Hangul, a labelled one with what
    follows the label, an address with a run of its characters before an @.
    """
    if k == len(RULES):
        return (m.start() for m in HANGUL.finditer(text))
    if prefix in LABELS:
        return (m.end() for m in LABELS[prefix].finditer(text))
    if prefix == "이메일":
        return _mails(text)
    return None


def matches(k: int, text: str) -> Iterable[re.Match]:
    """What finditer gives for the k-th rule, found sooner."""
    pattern, prefix = COMPILED[k]
    need = NEEDS.get(prefix)
    if need and need not in text:
        return
    begins = _begins(k, prefix, text)
    if begins is None:
        yield from pattern.finditer(text)
        return
    done = 0
    for at in begins:
        if at >= done and (m := pattern.match(text, at)):
            yield m
            done = m.end()


def left(text: str) -> dict[str, int]:
    """Matches by prefix that are left, pseudonyms aside."""
    out: dict[str, int] = {}
    for k, (_, prefix) in enumerate(ALL_RULES):
        n = sum(1 for m in matches(k, text) if not re.match(r"_[0-9A-F]{4}\b", text[m.end() : m.end() + 8]))
        if n:
            out[prefix] = out.get(prefix, 0) + n
    return out


def judged(text: str, salt: str) -> tuple[str, int, int, int]:
    """The text with pseudonyms, how many were put, passes (at least one, more while something is left, at most PASSES), and how many matches are left."""
    put = 0
    if not ANY.search(text):
        return text, put, 1, 0
    for done in range(1, PASSES + 1):
        before, rest = put, {}
        for k, (_, prefix) in enumerate(ALL_RULES):
            parts, at = [], 0
            for m in matches(k, text):
                value = m[1] if m.re.groups else m[0]
                parts += (text[at : m.start()], m[0].replace(value, pseudonym(value, prefix, salt)))
                at = m.end()
                put += 1
            if parts:
                text = "".join((*parts, text[at:]))
        if put > before:  # else no rule matches the text, so nothing is left
            rest = left(text)
        if not rest:
            break
    return text, put, done, sum(rest.values())


def replaced(text: str, salt: str) -> tuple[str, int, int]:
    """The first three of judged."""
    return judged(text, salt)[:3]


def deidentified(text: Column, salt: str) -> Column:
    """Text with pseudonyms; nulls stay null. Arrow batches, as the replacement is computed from each match."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: replaced(t, salt)[0], na_action="ignore")

    return run(text)


def deidentification(text: Column, salt: str) -> Column:
    """Struct of text, put (pseudonyms), passes and left (what still matches a rule); null for a null text."""

    @F.pandas_udf("struct<text:string,put:int,passes:int,left:int>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None, None) if t is None else judged(t, salt) for t in s]
        return pd.DataFrame(rows, columns=["text", "put", "passes", "left"])

    return run(text)


def _found(text: Column, pattern: str, prefix: str, search) -> Column:
    """search for a rule's match that no pseudonym follows, where the text holds what each match holds; null elsewhere."""
    found = search(text, F.lit(quick(f"(?>{pattern})(?!_[0-9A-F]{{4}})")))
    return F.when(text.contains(NEEDS[prefix]), found) if prefix in NEEDS else found


def residual(text: Column) -> Column:
    """Matches of the rules that are left, pseudonyms aside."""
    return sum((F.when(text.isNotNull(), F.coalesce(_found(text, p, prefix, F.regexp_count), F.lit(0))) for p, prefix in RULES), F.lit(0))


def has_residual(text: Column) -> Column:
    """Whether any is left; the first that is settles it."""
    return reduce(or_, [F.coalesce(_found(text, p, prefix, F.regexp_like), F.lit(False)) for p, prefix in RULES])


def _mask(text: str) -> str:
    for pattern, c in (("[A-Za-z]", "A"), (r"\d", "D"), ("[가-힣]", "K")):  # letters first, as the marks are letters
        text = re.sub(pattern, c, text)
    return text


def _shapes(text: str, context: int) -> list[dict]:
    out = []
    for pattern, prefix in RULES:
        for m in re.finditer(pattern, text):
            if not re.match(r"_[0-9A-F]{4}\b", text[m.end() : m.end() + 8]):
                out.append({"rule": prefix, "mask": _mask(text[max(0, m.start() - context) : m.end() + context])})
    return out


def residual_shapes(text: Column, context: int = CONTEXT) -> Column:
    """Rule and masked surroundings of each match of the rules that is left anywhere in a text; a null text has none.

    Spark SQL does not tell where the matches after the first stand, so this runs in Arrow batches; only masks leave it.
    """

    @F.pandas_udf("array<struct<rule:string,mask:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _shapes(t, context))

    return run(F.coalesce(text, F.lit("")))


def rrn_valid(digits: Column) -> Column:
    """Weighted check digit of a 13-digit number, and a plausible month and day."""
    weights = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]
    total = sum((F.substring(digits, k + 1, 1).cast("int") * w for k, w in enumerate(weights)), F.lit(0))
    month, day = F.substring(digits, 3, 2).cast("int"), F.substring(digits, 5, 2).cast("int")
    return ((11 - total % 11) % 10 == F.substring(digits, 13, 1).cast("int")) & month.between(1, 12) & day.between(1, 31)
