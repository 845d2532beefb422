r"""Chat formatting in budgeted windows, with DataFrame functions alone.

A turn's place is the prefix sum of its conversation's turn tokens (words, and
a few for the marks around them). A window's ``budget`` pays for all it holds:
the system turn, at most ``history`` tokens of repeated turns, and new ones. So
new turns have step = budget - history - system tokens to themselves, and spans
are turn-aligned and follow from the prefix sums in closed form: span number =
start // step, and a turn that crosses a multiple of the step is a span of its
own. No window exceeds the budget but for one turn that is longer than the step
alone, or a system turn of more than half of what history leaves; then the step
is as long as the system turn, so that a conversation, whose crossing turns have
windows of their own, at most triples. No turn waits for the choice made before it.

The formatted window repeats the conversation's system turn, if it opens with
one, and then the last turns of the span before, as far as they fit into
``history`` tokens; only new assistant texts are under the loss mask, repeated
ones are not. Prefix sums are taken in blocks of ``BLOCK`` turns first, so that
a conversation with very many turns is summed in many tasks.

Template, for each turn:   <|role|>\n text </s>\n   (without the spaces)

Inside roles and texts a backslash is doubled and one is put after the first
character of each control string (<|, |>, <s>, </s>, [INST], [/INST], <<SYS>>,
<</SYS>>), which unescape() takes back.

Defined results: a null text or role is empty; rows are ordered by turn (null
first), then role and text; equal rows are repeated turns; an empty text is a
turn; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET = 512
HISTORY = 128
#: Tokens that a turn's marks count for.
MARKS = 4
BLOCK = 4096
CONTROL = r"\\|<(?=\||s>|/s>|<SYS>>|</SYS>>)|\|(?=>)|\[(?=INST\]|/INST\])"
END = "</s>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)(.)\\", "$1")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + MARKS


def spans(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, role, text, n (tokens), start (prefix sum before it), number (in its conversation), span, alone."""
    t = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    t = t.withColumn("n", tokens(F.col("text")).cast("long"))
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    t = t.withColumn("in_block", F.sum("n").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("row", F.row_number().over(in_block))
    blocks = t.groupBy("conv_id", "block").agg(F.sum("n").alias("block_n"), F.count("*").alias("block_rows"))
    of_conv = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("_conv"),
        F.col("block").alias("_block"),
        F.coalesce(F.sum("block_n").over(of_conv), F.lit(0)).alias("before"),
        F.coalesce(F.sum("block_rows").over(of_conv), F.lit(0)).alias("rows_before"),
    )
    t = t.join(blocks, t["conv_id"].eqNullSafe(blocks["_conv"]) & (t["block"] == blocks["_block"]))
    start = F.col("before") + F.col("in_block") - F.col("n")
    t = t.withColumn("start", start).withColumn("number", F.col("rows_before") + F.col("row"))
    opening = t.where((F.col("number") == 1) & (F.col("role") == "system")).select(F.col("conv_id").alias("_opens"), F.col("n").alias("system_n"))
    t = t.join(opening, t["conv_id"].eqNullSafe(opening["_opens"]), "left")  # one row at most for each conversation
    held = F.coalesce("system_n", F.lit(0))
    step = F.greatest(budget - history - held, held, F.lit(1))
    low, high = F.floor(F.col("start") / step), F.floor((F.col("start") + F.col("n") - 1) / step)
    t = t.withColumn("span", low).withColumn("alone", low != high)
    return t.select("conv_id", "role", "text", "n", "start", "number", "span", "alone")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, first_turn (from 1), repeated (turns before the new ones), formatted, loss_mask.

    loss_mask: places (from 1, in code points of formatted) and lengths of the new assistant texts.
    """
    s = spans(turns, budget, history)
    # a turn that crosses a multiple comes after all turns that end below it
    w = s.groupBy("conv_id", "span", "alone").agg(
        F.sort_array(F.collect_list(F.struct("number", "start", "n", "role", "text"))).alias("new"),
    )
    order = Window.partitionBy("conv_id").orderBy("span", "alone")
    w = w.withColumn("prior", F.lag("new").over(order))
    opening = F.when((F.col("new")[0]["number"] == 1) & (F.col("new")[0]["role"] == "system"), F.col("new")[0])
    w = w.withColumn("system", F.first(opening).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.col("new")[0]["start"]
    recent = F.filter(
        F.col("prior"),
        lambda x: (x["start"] >= begin - history) & ((x["number"] > 1) | (x["role"] != "system")),
    )
    again = F.concat(
        F.when(F.col("system").isNotNull() & (F.col("new")[0]["number"] > 1), F.array("system")).otherwise(F.array()),
        F.coalesce(recent, F.array()),
    )
    w = w.withColumn("again", again)
    head = F.transform(F.concat("again", "new"), lambda x: F.concat(F.lit("<|"), escape(x["role"]), F.lit("|>\n")))
    w = w.withColumn("heads", head)
    w = w.withColumn("bodies", F.transform(F.concat("again", "new"), lambda x: escape(x["text"])))
    w = w.withColumn("parts", F.transform(F.arrays_zip("heads", "bodies"), lambda x: F.concat(x["heads"], x["bodies"], F.lit(END))))
    # lengths before each turn, in pairs (turn, characters so far)
    ends = F.aggregate(
        F.transform("parts", lambda p: F.length(p).cast("long")),
        F.array(F.lit(0).cast("long")),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )
    w = w.withColumn("at", ends)
    mask = F.transform(
        F.col("bodies"),
        lambda b, i: F.when(
            (i >= F.size("again")) & (F.concat("again", "new")[i]["role"] == "assistant"),
            F.struct(
                (F.col("at")[i] + F.length(F.col("heads")[i]) + 1).alias("place"),
                F.length(b).cast("long").alias("length"),
            ),
        ),
    )
    return w.select(
        "conv_id",
        F.col("new")[0]["number"].alias("first_turn"),
        F.size("again").alias("repeated"),
        F.array_join("parts", "").alias("formatted"),
        F.filter(mask, lambda x: x.isNotNull()).alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What windows() wrote, per conversation, from the formatted strings and their masks alone."""
    parts = F.filter(F.split("formatted", END, -1), lambda p: p != "")
    new = F.slice(parts, F.col("repeated") + 1, F.greatest(F.size(parts) - F.col("repeated"), F.lit(0)))
    head = r"(?s)^<\|(.*?)\|>\n(.*)$"
    turns = F.transform(
        new,
        lambda p: F.concat(unescape(F.regexp_extract(p, head, 1)), F.lit("\n"), unescape(F.regexp_extract(p, head, 2)), F.lit("\n")),
    )
    loss = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), m["place"].cast("int"), m["length"].cast("int"))))
    w = formatted.select(
        "conv_id",
        F.struct(
            F.col("first_turn"),
            F.size(turns).alias("n"),
            F.array_join(turns, "").alias("turns"),
            F.array_join(loss, "").alias("loss"),
        ).alias("w"),
        F.length("formatted").cast("long").alias("chars"),
    )
    g = w.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    text = F.array_join(F.col("w.loss"), "")
    return g.select(
        "conv_id",
        F.aggregate(F.col("w.n"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_turns"),
        F.sha2(F.array_join(F.col("w.turns"), ""), 256).alias("turns_sha256"),
        F.length(text).cast("long").alias("loss_chars"),
        F.sha2(text, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """conversations and conversation -1, whose two texts consist of control strings."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    ).unionByName(probe)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
counted AS (
  SELECT *, (len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4)::BIGINT AS n,
         length(text) + len(regexp_extract_all(text, '\\|<\||<s>|</s>|<<SYS>>|<</SYS>>|\|>|\[INST\]|\[/INST\]'))
         + length(role) + 10 AS chars
  FROM t),
placed AS (
  SELECT *, sum(n) OVER o - n AS start, row_number() OVER o AS number FROM counted
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
stepped AS (
  SELECT *, greatest(512 - 128 - coalesce(max(n) FILTER (number = 1 AND role = 'system') OVER c, 0), coalesce(max(n) FILTER (number = 1 AND role = 'system') OVER c, 0)) AS step FROM placed WINDOW c AS (PARTITION BY conv_id)),
spanned AS (
  SELECT *, start // step AS span, (start // step) <> ((start + n - 1) // step) AS alone,
         number = 1 AND role = 'system' AS opening
  FROM stepped),
w AS (
  SELECT conv_id, span, alone, min(start) AS begin, min(number) AS first_turn, sum(chars) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY span, alone) AS k
  FROM spanned GROUP BY conv_id, span, alone),
history AS (
  SELECT b.conv_id, b.k, sum(s.chars) AS chars
  FROM w b JOIN w a ON a.conv_id = b.conv_id AND a.k = b.k - 1
  JOIN spanned s ON s.conv_id = a.conv_id AND s.span = a.span AND s.alone = a.alone
  WHERE s.start >= b.begin - 128 AND NOT s.opening GROUP BY ALL),
formatted AS (
  SELECT w.conv_id, sum(w.chars + coalesce(h.chars, 0) + CASE WHEN w.first_turn > 1 THEN coalesce(o.chars, 0) ELSE 0 END)::BIGINT AS formatted_chars
  FROM w LEFT JOIN history h USING (conv_id, k)
  LEFT JOIN (SELECT conv_id, chars FROM spanned WHERE opening) o USING (conv_id) GROUP BY ALL),
digests AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY number)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY number) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM spanned GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM digests JOIN formatted USING (conv_id)
"""
