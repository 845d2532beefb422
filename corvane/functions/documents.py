"""Checks of research documents: each an array of findings, empty where there is nothing to say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import integrity as I
from .classify import stripped_ends

# What signature lines, amendments and reports must hold, and what is said where they do not.
SIGN_LINE = r"서명|signed|signature"
NAME = r"[가-힣]{2,4}(?![가-힣])|인명_[0-9A-F]{4}|[A-Z][a-z]+\s[A-Z][a-z]+"
TIME = r"\d{1,2}\s*[:시]\s*\d{2}"
MEANING = r"작성|검토|승인|확인|책임|authorship|author|review|approv|responsib"
SIGN_WORDS = r"서명|확인자|기록자|작성자|검토자|승인자|일시|날짜|일자|시각"
AMEND = r"^\s*[\[(<]?\s*(?:정정|수정\s*이력|변경\s*이력|삭제|개정|amendment|correction)(?![A-Za-z0-9_가-힣])"
REASON = r"사유|이유|reason|because|때문"
SIGNER = r"서명|확인|initial|signed|인명_[0-9A-F]{4}|[가-힣]{2,4}\s*\(인\)"
REPORT = {
    "58.185(a)(1)": ("시험기관·개시/종료일", r"시험\s*기관|연구\s*기관|수행\s*기관|facility", r"개시|시작|종료|initiat|complet"),
    "58.185(a)(2)": ("목적·절차", r"목적|objective", r"절차|방법|계획서|protocol|procedure"),
    "58.185(a)(3)": ("통계 방법", r"통계|statistic"),
    "58.185(a)(4)": ("시험·대조물질", r"시험\s*물질|대조\s*물질|시료|test article|control article|CAS"),
    "58.185(a)(5)": ("물질 안정성", r"안정성|stability"),
    "58.185(a)(6)": ("방법", r"방법|method"),
    "58.185(a)(7)": ("시험계", r"시험계|시험\s*동물|세포주|test system|동물|균주"),
    "58.185(a)(8)": ("용량·투여·기간", r"용량|투여|농도|처리\s*(?:시간|기간)|dosage|dose|route|duration"),
    "58.185(a)(9)": ("데이터 품질 영향 상황", r"품질|무결성|영향을\s*(?:준|줄|미친|미칠)|이탈|일탈|deviation|circumstance|integrity"),
    "58.185(a)(10)": ("책임자·참여자", r"책임자|study director|담당자|참여\s*연구원"),
    "58.185(a)(11)": ("요약·분석·결론", r"결론|요약|고찰|분석\s*결과|conclusion|summary"),
    "58.185(a)(12)": ("참여자 개별 보고", r"개별\s*보고|분담\s*보고|individual report|참여자\s*보고"),
    "58.185(a)(13)": ("자료 보관 위치", r"보관\s*(?:위치|장소)|보존\s*(?:위치|장소)|저장\s*위치|archive|stored at"),
    "58.185(a)(14)": ("QA 진술", r"신뢰성\s*보증|품질\s*보증|QA|quality assurance"),
}
RETENTION_YEARS = 30


def _found(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike("(?i)" + pattern), F.lit(False))


def _said(*cases: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in cases]))


def _tag(line: Column) -> Column:
    return F.substring(stripped_ends(line), 1, 30)


def signature_manifest(text: Column) -> Column:
    """For each line about a signature: its name, date, time and meaning."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r"), lambda x: _found(x, SIGN_LINE))

    def check(line: Column) -> Column:
        with_tag = lambda m: F.concat(F.lit(m + ": "), _tag(line))
        dated = line.rlike(I.DATE)
        return _said(
            (~F.regexp_replace(line, SIGN_WORDS, " ").rlike(NAME), with_tag("[11.50(a)(1)] 서명자 성명 없음")), (~dated, with_tag("[11.50(a)(2)] 서명 일자 없음")),
            (dated & ~line.rlike(TIME), with_tag("[11.50(a)(2)] 서명 시각 없음(일자만)")), (~_found(line, MEANING), with_tag("[11.50(a)(3)] 서명 의미(작성·검토·승인) 없음")),
        )

    return F.when(F.size(lines) == 0, F.array(F.lit("[11.50(a)/58.185(b)] 서명 표시 없음"))).otherwise(F.flatten(F.transform(lines, check)))


def amendment_trail(text: Column) -> Column:
    """For each line that begins with an amendment: its reason, date and signer."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: _found(x, AMEND))

    def check(line: Column) -> Column:
        with_tag = lambda m: F.concat(F.lit(m + ": "), _tag(line))
        return _said(
            (~_found(line, REASON), with_tag("[58.130(e)/58.185(c)] 정정 사유 없음")), (~line.rlike(I.DATE), with_tag("[58.130(e)/지침8⑥1] 정정 일자 없음")),
            (~_found(line, SIGNER), with_tag("[58.130(e)/지침8⑥1] 정정자 서명 없음")),
        )

    return F.flatten(F.transform(lines, check))


def deviation_documented(text: Column) -> Column:
    told = I.undocumented_deviations(F.coalesce(text, F.lit("")))
    return F.transform(told, lambda s: F.concat(F.lit("[58.35(b)(5)] 이탈 승인·사유 없음: "), _tag(s)))


def specimen_labels(text: Column) -> Column:
    said = {"id": "[58.130(c)] 검체 식별번호 없음", "date": "[58.130(c)] 검체 채취·기록 일자 없음"}
    return F.transform(I.specimen_findings(text), lambda x: F.when(x == "id", said["id"]).otherwise(said["date"]))


def single_project(text: Column) -> Column:
    n = I.projects(F.coalesce(text, F.lit("")))
    return _said((n > 1, F.concat(F.lit("[지침8②] 한 노트에 과제 "), n.cast("string"), F.lit("개 — 과제마다 구분 작성"))))


def report_elements(text: Column) -> Column:
    missing = []
    for clause, (name, *patterns) in REPORT.items():
        held = F.lit(True)
        for p in patterns:
            held = held & _found(text, p)
        missing.append((~held, f"[{clause}] 최종보고서 항목 누락: {name}"))
    return _said(*missing)


def labnote_cover(text: Column) -> Column:
    return F.transform(I.cover_findings(text), lambda k: F.concat(F.lit("[지침7②1] 연구노트 "), k, F.lit(" 없음")))


def retention_until(end: Column, years: int = RETENTION_YEARS) -> Column:
    """The end of retention; 29 February falls on 28 February."""
    return F.add_months(end, 12 * years)


def retention_findings(end: Column, disposal: Column, years: int = RETENTION_YEARS) -> Column:
    until = retention_until(end, years)
    told = F.concat(F.lit(f"[지침10④/58.195(b)] 보존기간({years}년, "), until.cast("string"), F.lit("까지) 전 폐기 예정 "), disposal.cast("string"))
    return _said((F.coalesce(disposal < until, F.lit(False)), told))


#: The checks that need the text alone, by the key that clauses name.
TEXT_CHECKS = {
    "onto.amendment": amendment_trail, "onto.deviation": deviation_documented, "onto.labnote_cover": labnote_cover, "onto.report_elements": report_elements,
    "onto.signature": signature_manifest, "onto.single_project": single_project, "onto.specimen": specimen_labels,
}
