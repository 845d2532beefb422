"""Audit trails, access decisions and regulation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Roles, actions, meanings of signatures.
ROLES = ("recorder", "reviewer", "manager", "viewer", "agent")
ACTIONS = ("create", "modify", "delete", "sign", "view")
WRITTEN, CONFIRMED, APPROVED = "작성", "확인", "승인"


def allowed() -> Column:
    """Decision over columns role, action, in_project, is_owner, state, sensitive, location, retention_expired, meaning."""
    c = F.col
    manager = (c("action") == "view") | ((c("action") == "delete") & (c("state") == "archived") & c("retention_expired"))
    agent = c("action").isin("create", "modify") & (c("state") == "draft")
    sign = F.when(c("role") == "recorder", c("is_owner") & (c("meaning") == WRITTEN)).when(
        c("role") == "reviewer", ~c("is_owner") & c("meaning").isin(CONFIRMED, APPROVED)
    )
    by_action = (
        F.when(c("action") == "delete", (c("state") == "draft") & c("is_owner"))
        .when(c("action") == "create", c("role") == "recorder")
        .when(c("action") == "modify", (c("role") == "recorder") & c("is_owner"))
        .otherwise(sign)
    )
    out = (
        F.when(~c("role").isin(*ROLES) | ~c("action").isin(*ACTIONS), False)
        .when(c("sensitive") & (c("location") != "onprem"), False)
        .when(c("role") == "manager", manager)
        .when(~c("in_project"), False)
        .when(c("action") == "view", True)
        .when((c("state") == "archived") | (c("role") == "viewer"), False)
        .when(c("role") == "agent", agent)
        .otherwise(by_action)
    )
    return F.coalesce(out, F.lit(False))


GENESIS = "0" * 64
#: An entry's fields, in the order of their names, as its hash takes them.
FIELDS = ("action", "actor", "content", "content_sha256", "meaning", "prev", "reason", "record_id", "seq", "ts")


def json_literal(c: Column) -> Column:
    """A string as JSON writes it, other scripts as they are."""
    quoted = F.to_json(F.array(c))
    return F.substr(quoted, F.lit(2), F.length(quoted) - 2)


def canonical_json(*columns: str, numbers: tuple[str, ...] = ("seq",)) -> Column:
    """The columns as one JSON object: keys in the order of their names, a space after each colon and comma."""
    parts = []
    for k in sorted(columns):
        value = F.col(k).cast("string") if k in numbers else json_literal(F.coalesce(F.col(k).cast("string"), F.lit("")))
        parts += [F.lit(("{" if not parts else ", ") + f'"{k}": '), value]
    return F.concat(*parts, F.lit("}"))


def entry_hash(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns), 256)


def chain_findings(entries: DataFrame, genesis: str = GENESIS) -> DataFrame:
    """chain, seq, finding: gaps in seq, links that do not hold, contents and entries that do not match their hashes."""
    w = Window.partitionBy("chain").orderBy("seq")
    e = entries.withColumn("want_seq", F.row_number().over(w) - 1).withColumn("want_prev", F.coalesce(F.lag("hash").over(w), F.lit(genesis)))
    held = F.when(F.coalesce("content", F.lit("")) == "", F.lit("")).otherwise(F.sha2("content", 256))
    found = F.array_compact(
        F.array(
            F.when(F.col("seq") != F.col("want_seq"), "seq"),
            F.when(F.col("prev") != F.col("want_prev"), "prev"),
            F.when((F.col("content_sha256") != held) & ~F.col("action").isin("view", "access_denied"), "content"),
            F.when(F.col("hash") != entry_hash(*FIELDS), "hash"),
        )
    )
    return e.select("chain", "seq", F.explode(found).alias("finding"))


def chain_heads(entries: DataFrame) -> DataFrame:
    """chain, head: the last entry's hash; partial maxima alone."""
    return entries.groupBy("chain").agg(F.max_by("hash", "seq").alias("head"))


def signatures(entries: DataFrame) -> DataFrame:
    """record_id, seq, actor, meaning of the signatures given to what a record holds now."""
    now = current_content(entries).select("record_id", F.sha2("content", 256).alias("_now"))
    signed = entries.where("action = 'sign'").join(now, "record_id").where("content_sha256 = _now")
    return signed.select("record_id", "seq", "actor", "meaning")


def refused(entries: DataFrame) -> DataFrame:
    """record_id, seq, reasons: entries that may not be appended, for what they lack or where they stand."""
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    acts = ("create", "modify", "delete", "sign", "view", "access_denied")
    own = F.array_compact(
        F.array(
            F.when(~F.col("action").isin(*acts), "action"), F.when(missing("actor"), "actor"), F.when(F.col("action").isin("modify", "delete") & missing("reason"), "reason"),
            F.when((F.col("action") == "sign") & missing("meaning"), "meaning"),
        )
    )
    t = transitions(entries).select("record_id", "seq", "legal")
    late = F.when(F.col("action").isin("create", "modify", "sign", "delete") & ~F.col("legal"), F.array(F.lit("order"))).otherwise(F.array().cast("array<string>"))
    e = entries.join(t, ["record_id", "seq"]).select("record_id", "seq", F.concat(own, late).alias("reasons"))
    return e.where(F.size("reasons") > 0)


def dump_chain(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines, each chain's together and in order."""
    entries.repartitionByRange("chain", "seq").sortWithinPartitions("chain", "seq").write.json(path)


def load_chain(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def current_content(entries: DataFrame) -> DataFrame:
    """record_id, seq and content of each record's last create or modify, unless deleted later; partial maxima alone."""
    some = entries.where(F.col("action").isin("create", "modify", "delete"))
    last = some.groupBy("record_id").agg(F.max(F.struct("seq", "action", "content")).alias("x"))
    return last.where("x.action <> 'delete'").select("record_id", "x.seq", "x.content")


def transitions(entries: DataFrame) -> DataFrame:
    """record_id, seq, action, legal: creation only of what is absent, all else only of what is present."""
    w = Window.partitionBy("record_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("action") == "create", 1).when(F.col("action") == "delete", 0)
    before = F.coalesce(F.last(change, ignorenulls=True).over(w), F.lit(0)) == 1
    legal = F.when(F.col("action") == "create", ~before).otherwise(before)
    return entries.select("record_id", "seq", "action", legal.alias("legal"))


def automation(log: DataFrame, *by: str) -> DataFrame:
    """Share of automatic nodes among those neither skipped nor gates; 0 without any."""
    counts = log.groupBy(*by).agg(F.count_if((F.col("status") == "auto") & ~F.col("gate")).alias("auto"), F.count_if((F.col("status") != "skipped") & ~F.col("gate")).alias("counted"))
    return counts.select(*by, "auto", "counted", F.when(F.col("counted") > 0, F.col("auto") / F.col("counted")).otherwise(F.lit(0.0)).alias("rate"))


def retention_until(date: Column, years: int = 30) -> Column:
    return F.add_months(date, 12 * years)
