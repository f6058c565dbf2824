r"""Chat formatting with relational and array expressions.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into a
block; blocks are written as

    <s> block ... </s>
    user: [INST]text[INST,]text[/INST]     assistant: [OUT]...[/OUT]     system: [SYS]...[/SYS]
    others: [ROLE]name[:]text[ROLE,]name[:]text[/ROLE], with [NONE] for a null name

where "[INST,]" parts the turns of a merged block, so reading back gives every single turn. Inside texts and
names a control string gets a backslash behind its bracket ("[\INST]"), and one that has backslashes there
already gets one more; reading takes one away. The output holds the text both whole and as segments with a
loss flag: the loss mask covers each assistant text and nothing else.

Null texts are empty; rows without a conversation id form one conversation of their own; turns with equal
numbers are ordered by role and text, null numbers first; repeated rows are turns of their own; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_NAMES = "INST|OUT|SYS|ROLE"
_BODY = rf"/?s>|/?(?:{_NAMES})\]|(?:{_NAMES}),\]|:\]|NONE\]"
CONTROL = rf"[<\[](?:{_BODY})"
_ESCAPE = rf"([<\[])(\\*)({_BODY})"
_UNESCAPE = rf"([<\[])\\(\\*)({_BODY})"
KINDS = {"user": "INST", "assistant": "OUT", "system": "SYS"}
LOSS = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _kind(role: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, kind in KINDS.items():
        out = out.when(role == name, F.lit(kind))
    return out.otherwise(F.lit("ROLE"))


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, segments (array of text and loss, whose texts joined are `formatted`), n_blocks."""
    rows = turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    n = F.size("ts")
    at = lambda i: F.element_at("ts", i)["role"]
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | ~at(i).eqNullSafe(at(F.greatest(i - 1, F.lit(1)))))
    chats = chats.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))), F.array(n + 1))
    chats = chats.withColumn("blocks", F.transform(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b")), lambda x: F.slice("ts", x["a"], x["b"] - x["a"])))

    def block(turns_: Column) -> Column:
        """The segments of a block: for each of its turns the tag and the text, then the end tag."""
        kind, own = _kind(turns_[0]["role"]), turns_[0]["role"]
        name = F.when(kind == "ROLE", F.concat(F.coalesce(escape(own), F.lit("[NONE]")), F.lit("[:]"))).otherwise(F.lit(""))
        each = F.transform(
            turns_,
            lambda t, i: F.array(
                F.struct(F.concat(F.lit("["), kind, F.when(i == 0, F.lit("]")).otherwise(F.lit(",]")), name).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("text"), F.coalesce(own == LOSS, F.lit(False)).alias("loss")),
            ),
        )
        return F.concat(F.flatten(each), F.array(F.struct(F.concat(F.lit("[/"), kind, F.lit("]")).alias("text"), F.lit(False).alias("loss"))))

    edge = lambda tag: F.array(F.struct(F.lit(tag).alias("text"), F.lit(False).alias("loss")))
    segments = F.concat(edge("<s>"), F.flatten(F.transform("blocks", block)), edge("</s>"))
    out = chats.select("conv_id", segments.alias("segments"), F.size("blocks").cast("long").alias("n_blocks"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "n_blocks")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    tags, pieces = F.regexp_extract_all(formatted, F.lit(CONTROL), F.lit(0)), F.split(formatted, CONTROL, -1)
    opens = [f"[{k}{c}]" for k in ("INST", "OUT", "SYS", "ROLE") for c in ("", ",")]
    held = F.struct(tags.alias("tags"), pieces.alias("pieces"))
    # One struct for all, so that the text is parsed once.
    at = F.transform(F.array(held), lambda h: F.transform(
        F.filter(F.transform(h["tags"], lambda tag, i: F.struct(tag.alias("tag"), i.alias("i"))), lambda x: x["tag"].isin(opens)),
        lambda x: F.struct(
            F.when(x["tag"].startswith("[INST"), F.lit("user")).when(x["tag"].startswith("[OUT"), F.lit("assistant")).when(x["tag"].startswith("[SYS"), F.lit("system"))
            .when(h["tags"][x["i"] + 1] == "[NONE]", F.lit(None).cast("string")).otherwise(unescape(h["pieces"][x["i"] + 1])).alias("role"),
            unescape(F.when(~x["tag"].startswith("[ROLE"), h["pieces"][x["i"] + 1]).when(h["tags"][x["i"] + 1] == "[NONE]", F.get(h["pieces"], x["i"] + 3)).otherwise(F.get(h["pieces"], x["i"] + 2))).alias("text"),
        ),
    ))
    return at[0]


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT CAST(c AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, role, text FROM VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}') AS v(c, t, role, text)")
    chats = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(more))
    found = chats.select("conv_id", "formatted", "n_blocks", read_turns(F.col("formatted")).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "n_blocks",
    )


SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
marked AS (
  SELECT *, length(regexp_replace(text, '{_ESCAPE}', '\1' || chr(92) || chr(92) || '\2\3', 'g')) AS escaped,
         CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 3 WHEN 'system' THEN 3 ELSE 4 END AS kind,
         CASE WHEN role IN ('user', 'assistant', 'system') THEN 0 ELSE 3 + coalesce(length(role), 6) END AS name,
         coalesce(row_number() OVER w > 1 AND role IS NOT DISTINCT FROM lag(role) OVER w, false) AS same
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text), '')) AS loss_sha256,
       CAST(7 + sum(escaped + name + kind + CASE WHEN same THEN 3 ELSE 2 + kind + 3 END) AS BIGINT) AS formatted_chars,
       count(*) FILTER (NOT same) AS n_blocks
FROM marked GROUP BY conv_id
"""

QUERIES = {"op7_chat": op7_chat}
ORACLES = {"op7_chat": SQL}
