"""Chat formatting with a grammar that reads back exactly, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grammar. A conversation is a sequence of turns, each one of
#   <s>[INST] text [/INST]                    role user
#   <s>text </s>                              role assistant; its text is what the loss covers
#   <s>[ROLE] role [TEXT] text [/ROLE]        any other role
# where texts and role names hold no control string unless one or more backslashes stand before it. Reading takes one of
# these backslashes away, writing adds one.
CONTROL = r"(?:</?s>|\[/?INST\]|\[/?ROLE\]|\[TEXT\])"
BARE = r"(?<!\\)" + CONTROL
START = r"(?<!\\)<s>"


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*" + CONTROL + ")", r"\\$1")


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*" + CONTROL + ")", "$1")


def _written(turns: Column, escape: bool) -> Column:
    """Turns (role, text) as pieces: the characters before the text, the text, the characters after it."""

    def piece(turn: Column) -> Column:
        role, text = turn["role"], _escaped(turn["text"]) if escape else turn["text"]
        user, assistant = role == "user", role == "assistant"
        before = (
            F.when(user, "<s>[INST] ")
            .when(assistant, "<s>")
            .otherwise(F.concat(F.lit("<s>[ROLE] "), _escaped(role), F.lit(" [TEXT] ")))
        )
        after = F.when(user, " [/INST]").when(assistant, " </s>").otherwise(" [/ROLE]")
        return F.struct(before.alias("before"), text.alias("text"), after.alias("after"), assistant.alias("loss"))

    return F.transform(turns, piece)


def _joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["before"], p["text"], p["after"])), "")


def parsed(formatted: Column) -> Column:
    """Turns (role, text) read from a formatted conversation. A turn that breaks the grammar has a null text."""

    def turn(body: Column) -> Column:
        length = F.char_length(body)
        user, other = body.startswith("[INST] "), body.startswith("[ROLE] ")
        # an escape would stand between the space and the bracket
        parts = F.split(body, r" \[TEXT\] ", 2)
        named = F.get(parts, F.lit(1))
        text = (
            F.when(user & body.endswith(" [/INST]"), body.substr(F.lit(8), length - 15))
            .when(other & named.endswith(" [/ROLE]"), named.substr(F.lit(1), F.char_length(named) - 8))
            .when(~user & ~other & body.endswith(" </s>"), body.substr(F.lit(1), length - 5))
        )
        role = (
            F.when(user, "user")
            .when(other, _unescaped(F.get(parts, F.lit(0)).substr(F.lit(8), F.char_length(F.get(parts, F.lit(0))))))
            .otherwise("assistant")
        )
        return F.struct(role.alias("role"), F.when(~text.rlike(BARE), _unescaped(text)).alias("text"))

    bodies = F.split(formatted, START)
    return F.transform(F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))), turn)


def loss_texts(formatted: Column, mask: Column) -> Column:
    """The texts below the mask, one per turn that has any, escapes taken away."""
    bodies = F.split(formatted, START)
    turns = F.arrays_zip(F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))).alias("body"), mask.alias("mask"))
    covered = F.filter(turns, lambda t: t["mask"]["loss"] >= 0)
    return F.transform(
        covered,
        lambda t: _unescaped(F.concat(F.lit("<s>"), t["body"]).substr(t["mask"]["before"] + 1, t["mask"]["loss"])),
    )


def formatted_chats(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask, escaped, sound.

    rows: conv_id, turn, role, text; turns in order of ``turn``. The conversation is written as it is, read back by the
    parser and compared with its turns; where they differ, control strings in its texts and roles are escaped and it is read
    and compared again, which then agrees (``sound``; ``escaped`` tells which form was needed). ``loss_mask`` has per turn
    the characters before the text, of the text if the loss covers it (else -1), and after.

    Null roles and texts count as empty. Turns of equal number, null ones first, are ordered by role and text; repeated rows
    stay. Rows without conv_id are one conversation. A conversation is one output string, so its turns meet in one row, the
    only thing here that grows with a group. An empty table gives no rows. Other columns are not read.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_rows"))
    chats = chats.select(
        "conv_id",
        F.transform("_rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("_turns"),
    )
    tried = chats.withColumn("_plain", _written(F.col("_turns"), False))
    tried = tried.withColumn("_fits", F.coalesce(parsed(_joined(F.col("_plain"))) == F.col("_turns"), F.lit(False)))
    chosen = tried.select(
        "conv_id", "_turns", F.when(F.col("_fits"), F.col("_plain")).otherwise(_written(F.col("_turns"), True)).alias("_pieces"),
        (~F.col("_fits")).alias("escaped"),
    )
    mask = F.transform(
        "_pieces",
        lambda p: F.struct(
            F.char_length(p["before"]).alias("before"),
            F.when(p["loss"], F.char_length(p["text"])).otherwise(F.lit(-1)).alias("loss"),
            F.char_length(p["after"]).alias("after"),
        ),
    )
    written = chosen.select("conv_id", "_turns", _joined(F.col("_pieces")).alias("formatted"), mask.alias("loss_mask"), "escaped")
    sound = F.coalesce(parsed(F.col("formatted")) == F.col("_turns"), F.lit(False))
    return written.select("conv_id", "formatted", "loss_mask", "escaped", sound.alias("sound"))


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as counts and digests."""
    read = chats.select(
        "conv_id",
        parsed(F.col("formatted")).alias("turns"),
        F.array_join(loss_texts(F.col("formatted"), F.col("loss_mask")), "").alias("loss"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        "escaped",
        "sound",
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "escaped",
        "sound",
    )


PROBE = "</s>[INST] ok [/INST]"


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts are control strings."""
    probe = rows.sparkSession.sql(
        f"select -7L as conv_id, 0L as turn, 'user' as role, '{PROBE}' as text "
        f"union all select -7L, 1L, 'assistant', '{PROBE}'"
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


CHAT_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
pieces as (
  select *, regexp_replace(text, '(\\*(?:</?s>|\[/?INST\]|\[/?ROLE\]|\[TEXT\]))', '\\\1', 'g') as safe,
         regexp_replace(role, '(\\*(?:</?s>|\[/?INST\]|\[/?ROLE\]|\[TEXT\]))', '\\\1', 'g') as safe_role
  from rows)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(safe) + case role when 'user' then 18 when 'assistant' then 8 else 26 + length(safe_role) end)::bigint
         as formatted_chars,
       bool_or(safe <> text or safe_role <> role) as escaped, true as sound
from pieces group by conv_id"""
