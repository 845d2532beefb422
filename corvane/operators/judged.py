"""Answers that judges have scored: verdicts, reports, agreement of several judges, preference pairs, training sets and splits.

A judged row has doc, passage, task, question, answer, pii, sensitive, qa_ok and
sents: array of struct<text, unit_swap, novel_num, llm, enc>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.scores import cascade, wilson
from .order import placed
from .relations import components

#: Thresholds of the cascade, of questions, of key-value lines, and how much easy entailment may outnumber the rest.
LO, HI, PASS, QA_PASS, KV_PASS, RATIO = 0.005, 0.98, 0.01, 0.5, 0.5, 2
KEY_VALUE = r"^[-•*\d.\s]*([^:：]{1,40})[:：]\s*(\S.*)$"
ONE_WINDOW = 800
# What a task asks, and what its source is called.
ASKS = {"note": "[연구노트]", "abstract": "[논문 초록]"}


def sentence_score(s: Column) -> Column:
    return cascade(s["enc"], s["llm"], s["unit_swap"], s["novel_num"], LO, HI)


def verdicts(rows: DataFrame) -> DataFrame:
    """rows with cascade, llm (every sentence supported, nothing personal) and qa_fits."""
    clean = ~F.col("pii") & ~F.col("sensitive") & (F.size("sents") > 0)
    return rows.withColumns({
        "cascade": clean & F.forall("sents", lambda s: sentence_score(s) >= PASS), "llm": clean & F.forall("sents", lambda s: s["llm"] >= PASS),
        "qa_fits": F.coalesce(F.col("qa_ok") >= QA_PASS, F.lit(True)),
    })


def report(rows: DataFrame) -> DataFrame:
    """By task and in all (task null): n, shares of cascade, llm, either alone, fitting questions, and the final verdict."""
    c, m = F.col("cascade"), F.col("llm")
    return verdicts(rows).rollup("task").agg(
        F.count("*").alias("n"), F.avg(c.cast("double")).alias("cascade"), F.avg(m.cast("double")).alias("llm"), F.avg((c & ~m).cast("double")).alias("cascade_only"),
        F.avg((m & ~c).cast("double")).alias("llm_only"), F.avg(F.when(F.col("qa_ok").isNotNull(), F.col("qa_fits").cast("double"))).alias("qa_ok"), F.avg((c & F.col("qa_fits")).cast("double")).alias("final"),
    )


def key_value(line: Column) -> Column:
    """Struct of key and value of a line of that form; null for a sentence."""
    t = T.squeeze(line)
    return F.when(t.rlike(KEY_VALUE), F.struct(F.trim(F.regexp_extract(t, KEY_VALUE, 1)).alias("key"), F.trim(F.regexp_extract(t, KEY_VALUE, 2)).alias("value")))


def is_key_value(line: Column) -> Column:
    return F.coalesce(T.squeeze(line).rlike(KEY_VALUE), F.lit(False))


def kv_row_passes(kv: Column, sentences: Column) -> Column:
    """kv: for each judge its scores by line, null for sentences; sentences: the former verdict by line.

    A line of key and value needs all judges, or all but one of more than three; a sentence keeps its verdict; no lines: false.
    """

    def passes(kv: Column) -> Column:
        need = F.when(F.size(kv) > 3, F.size(kv) - 1).otherwise(F.size(kv))
        line = lambda ok, j: F.when(F.get(kv[0], j).isNull(), ok).otherwise(F.size(F.filter(kv, lambda k: F.get(k, j) >= KV_PASS)) >= need)
        return (F.size(sentences) > 0) & F.forall(F.transform(sentences, line), lambda x: x)

    return T.let(kv, passes)


def aligned(judges: dict[str, DataFrame], key: list[str], same: str = "answer") -> DataFrame:
    """key and a struct for each judge, by name: rows of the same key, whose answers must be equal or the query fails."""
    out = None
    for name, df in judges.items():
        one = df.select(*key, F.struct(*[c for c in df.columns if c not in key]).alias(name))
        out = one if out is None else out.join(one, key)
    first, *others = judges
    for name in others:
        wrong = ~F.col(f"{name}.{same}").eqNullSafe(F.col(f"{first}.{same}"))
        out = out.withColumn(name, F.when(wrong, F.raise_error(F.lit(f"judges {first} and {name} differ in {same}"))).otherwise(F.col(name)))
    return out


def agreed(rows: DataFrame, judges: dict[str, float], heldout: DataFrame | None = None) -> DataFrame:
    """Rows of aligned() with verdict good (all judges support every sentence), bad (fewer than half do) or null.

    Rows with personal data, without sentences, or questions without text go; so do those whose passage is held out.
    """
    first = next(iter(judges))
    r = rows.where(~F.col(f"{first}.pii") & ~F.col(f"{first}.sensitive") & (F.size(f"{first}.sents") > 0))
    r = r.withColumn("passage_key", F.regexp_replace(F.col(f"{first}.passage"), T.SPACES, "")).withColumn("task", F.col(f"{first}.task"))
    r = r.withColumn("question", F.when(F.col("task") == "qa", F.trim(F.coalesce(f"{first}.question", F.lit("")))).otherwise(""))
    r = r.where((F.col("task") != "qa") | (F.col("question") != ""))
    if heldout is not None:
        keys = heldout.select(F.regexp_replace("passage", T.SPACES, "").alias("passage_key")).distinct()
        r = r.join(keys, "passage_key", "left_anti")
    reaches = lambda t: lambda s: s["llm"] >= t
    ok = F.array(*[F.forall(f"{n}.sents", reaches(t)) for n, t in judges.items()])
    fit = F.array(*[F.coalesce(F.col(f"{n}.qa_ok") >= QA_PASS, F.lit(False)) for n in judges])
    yes = lambda a: F.size(F.filter(a, lambda x: x))
    good, bad = yes(ok) == len(judges), yes(ok) * 2 < len(judges)
    qa = F.col("task") == "qa"
    good, bad = good & (~qa | (yes(fit) == len(judges))), bad | (qa & (yes(fit) * 2 < len(judges)))
    return r.withColumns({"votes": yes(ok), "verdict": F.when(good, "good").when(bad, "bad")})


def preference_pairs(rows: DataFrame, judges: dict[str, float], order: list[str]) -> DataFrame:
    """passage_key, task, question, chosen, rejected: the i-th good with the i-th bad answer of a prompt, where they differ."""
    first = next(iter(judges))
    g = ["passage_key", "task", "question"]
    r = rows.where("verdict is not null").select(*g, "verdict", F.col(f"{first}.answer").alias("answer"), *order)
    r = r.withColumn("_i", F.row_number().over(Window.partitionBy(*g, "verdict").orderBy(*order)))
    good = r.where("verdict = 'good'").select(*g, "_i", F.col("answer").alias("chosen"))
    bad = r.where("verdict = 'bad'").select(*g, "_i", F.col("answer").alias("rejected"))
    return good.join(bad, [*g, "_i"]).where("chosen <> rejected").drop("_i")


def distilled(rows: DataFrame, judges: dict[str, float], key: list[str], cap: int = 60_000, seed: str = "d", heldout: DataFrame | None = None) -> DataFrame:
    """key, sentence, doc, premise, hypothesis, label: sentences on which judges agree, for training.

    entail: all judges; neutral: fewer than half. Lines of key and value, swapped units and passages beyond one window go.
    All neutral rows stay, entailed ones up to twice as many; beyond cap both shrink alike. Which stay is decided by a
    seeded digest's order over all rows, without gathering them.
    """
    first = next(iter(judges))
    r = rows.where(F.length(f"{first}.passage") <= ONE_WINDOW)
    if heldout is not None:
        held = heldout.select(F.regexp_replace("passage", T.SPACES, "").alias("_p")).distinct()
        r = r.withColumn("_p", F.regexp_replace(F.col(f"{first}.passage"), T.SPACES, "")).join(held, "_p", "left_anti")
    s = r.select(*key, F.col(f"{first}.doc").alias("doc"), F.col(f"{first}.passage").alias("premise"), F.posexplode(F.arrays_zip(*[F.col(f"{n}.sents").alias(n) for n in judges])).alias("sentence", "s"))
    s = s.where(~F.col(f"s.{first}.unit_swap") & key_value(F.col(f"s.{first}.text")).isNull())
    votes = sum((F.when(F.col(f"s.{n}.llm") >= t, 1).otherwise(0) for n, t in judges.items()), F.lit(0))
    label = F.when(votes == len(judges), "entail").when(votes * 2 < len(judges), "neutral")
    s = s.select(*key, "sentence", "doc", "premise", F.col(f"s.{first}.text").alias("hypothesis"), label.alias("label")).where("label is not null")
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key], F.col("sentence").cast("string")))
    p = placed(s.withColumn("_h", digest), ["label", "_h", *key, "sentence"], "distilled")  # entail before neutral
    n = p.agg(F.count_if(F.col("label") == "entail").alias("_e"), F.count_if(F.col("label") == "neutral").alias("_n"))
    p = p.join(F.broadcast(n))  # one row
    most = F.least(F.col("_e"), RATIO * F.col("_n"))
    share = F.least(F.lit(1.0), cap / (most + F.col("_n")))
    place = F.col("_place") - F.when(F.col("label") == "neutral", F.col("_e")).otherwise(0)
    keep = F.when(share < 1.0, F.floor(F.when(F.col("label") == "entail", most).otherwise(F.col("_n")) * share)).otherwise(F.when(F.col("label") == "entail", most).otherwise(F.col("_n")))
    return p.where(place < keep).drop("_h", "_e", "_n", "_place")


def without_bad_pairs(examples: DataFrame, judged: DataFrame) -> DataFrame:
    """examples (prompt, answer) but those that a judged question row of the same prompt and answer found unfit."""
    bad = judged.where((F.col("task") == "qa") & (F.col("qa_ok") < QA_PASS)).select("prompt", "answer").distinct()
    return examples.join(bad, ["prompt", "answer"], "left_anti")


def accepted_pairs(pairs: DataFrame, theta: float = 0.0) -> DataFrame:
    """Preference pairs whose chosen answer scores theta or more (if theta is above 0) and more than the rejected one."""
    c, r = F.coalesce("vcr_chosen", F.lit(1.0)), F.coalesce("vcr_rejected", F.lit(0.0))
    return pairs.where((c > r) & ((c >= theta) if theta > 0 else F.lit(True)))


def sft_examples(pairs: DataFrame) -> DataFrame:
    """One example for each prompt and chosen answer, as a message array."""
    one = pairs.select("prompt", "chosen").dropDuplicates(["prompt", "chosen"])
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return one.select("prompt", "chosen", F.array(message("user", "prompt"), message("assistant", "chosen")).alias("messages"))


def prompt(task: Column, question: Column, passage: Column, kind: Column, asks: dict[str, str]) -> Column:
    """The task's instruction, or the question, before the marked passage."""
    told = F.when(task == "qa", question)
    for name, text in asks.items():
        told = told.when(task == name, text)
    return F.concat(told, F.lit("\n\n"), F.when(kind == "abstract", ASKS["abstract"]).otherwise(ASKS["note"]), F.lit("\n"), passage)


def question_of(task: Column, question: Column, prompt_: Column) -> Column:
    """The question of a row: its own, or what stands before the marked passage of a question's prompt; else empty."""
    own = F.nullif(question, F.lit(""))
    return F.coalesce(own, F.when(task == "qa", F.element_at(F.split(prompt_, r"\n\n\[(?:연구노트|논문 초록)\]\n"), 1)), F.lit(""))


def sampled_question(task: Column, question: Column, qa_ok: Column, qa: bool = False) -> Column:
    """The question under which a row is sampled: empty for other tasks, null for rows that are not."""
    q = F.trim(F.coalesce(question, F.lit("")))
    fits = (q != "") & F.coalesce(qa_ok >= QA_PASS, F.lit(True))
    return F.when(task != "qa", F.lit(None).cast("string") if qa else F.lit("")).when(F.lit(qa) & fits, q)


def rejudged(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: n, agree, before_only, after_only of two judgements' pass verdicts."""
    b, a = before.select(key, (F.col("reason") == "pass").alias("b")), after.select(key, (F.col("reason") == "pass").alias("a"))
    t = b.join(a, key)
    return t.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agree"), F.count_if(F.col("b") & ~F.col("a")).alias("before_only"), F.count_if(~F.col("b") & F.col("a")).alias("after_only"))


def run_summary(rows: DataFrame) -> DataFrame:
    """By task and in all (task null): pass rate with its Wilson interval, supported sentences, sentences a row, number recall, reasons."""
    ok = F.count_if(F.col("reason") == "pass")
    g = rows.rollup("task").agg(
        F.count("*").alias("n"), ok.alias("k"), (F.sum("n_supported") / F.greatest(F.lit(1), F.sum("n_sent"))).alias("supported"), F.avg("n_sent").alias("sentences"), F.avg("num_recall").alias("number_recall"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in ("empty", "pii", "sensitive", "unsupported")],
    )
    low, high = wilson(F.col("k"), F.col("n"))
    return g.withColumns({"pass_rate": F.col("k") / F.col("n"), "low": low, "high": high}).drop("k")


def heldout_group(key: Column, mod: int) -> Column:
    """Whether a group's SHA-256, as one whole number, is divisible by mod: folded by chunks of 32 bits."""
    h = F.sha2(key, 256)
    rest = F.lit(0).cast("bigint")
    for k in range(8):
        rest = (rest * ((1 << 32) % mod) + F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint")) % mod
    return rest == 0


def document_groups(rows: DataFrame, doc: str = "doc", passage: str = "passage") -> DataFrame:
    """doc, group: documents that share a passage, white space aside, are one group, named by its smallest document."""
    d = rows.select(F.col(doc).alias("doc"), F.sha2(F.regexp_replace(passage, T.SPACES, ""), 256).alias("p")).distinct()
    hub = d.groupBy("p").agg(F.min("doc").alias("b"))  # a star about the smallest document: no pairs within a passage
    edges = d.join(hub, "p").where("doc <> b").select(F.col("doc").alias("a"), "b").distinct()
    roots = components(edges).select(F.col("node").alias("doc"), F.col("root").alias("group"))
    return d.select("doc").distinct().join(roots, "doc", "left").select("doc", F.coalesce("group", "doc").alias("group"))


def leakage_safe_split(rows: DataFrame, mod: int, seen: DataFrame | None = None) -> DataFrame:
    """rows (doc, passage, ...) with group and held: whole groups are held out, but none with a document or passage of seen."""
    g = document_groups(rows)
    r = rows.join(g, "doc").withColumn("held", heldout_group(F.col("group").cast("string"), mod))
    if seen is None:
        return r
    p = F.sha2(F.regexp_replace("passage", T.SPACES, ""), 256)
    dirty = r.join(seen.select("doc").distinct(), "doc", "left_semi").select("group")
    dirty = dirty.union(r.withColumn("_p", p).join(seen.select(p.alias("_p")).distinct(), "_p", "left_semi").select("group")).distinct().withColumn("_dirty", F.lit(True))
    return r.join(dirty, "group", "left").withColumn("held", F.col("held") & F.col("_dirty").isNull()).drop("_dirty")
