"""Conversation records: one shape for all spellings, exchange checks, keys, and reasoning wrapped into answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "array<struct<role:string,content:string,reasoning_content:string>>"

_ROLES = {"human": "user", "gpt": "assistant"}


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def from_share_form(turns: Column) -> Column:
    """Messages of a list of (from, value) turns."""
    role = lambda t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _ROLES.items() for x in kv]), t["from"]), t["from"])
    return F.transform(turns, lambda t: F.struct(role(t).alias("role"), t["value"].alias("content"), F.lit(None).cast("string").alias("reasoning_content")))


def from_instruction_form(instruction: Column, extra: Column, answer: Column) -> Column:
    """Messages of an instruction record; the input follows the instruction after an empty line, blanks count as absent."""
    present = lambda c: F.nullif(_strip(c), F.lit(""))
    prompt = F.concat_ws("\n\n", present(instruction), present(extra))
    make = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"), F.lit(None).cast("string").alias("reasoning_content"))
    return F.array(make("user", prompt), make("assistant", answer))


def one_shape(df: DataFrame) -> DataFrame:
    """All columns with ``messages`` filled and ``shape``: messages, conversations or instruction, whichever a record has first, else unknown.

    Columns messages, conversations, instruction, input and output may be absent; a blank instruction counts as absent.
    """
    have = set(df.columns)
    share = from_share_form(F.col("conversations")) if "conversations" in have else F.lit(None).cast(MESSAGE)
    told = F.col("instruction") if "instruction" in have else F.lit(None).cast("string")
    extra, answer = (F.col(c) if c in have else F.lit(None).cast("string") for c in ("input", "output"))
    own = F.col("messages") if "messages" in have else F.lit(None).cast(MESSAGE)
    filled = F.nullif(_strip(told), F.lit("")).isNotNull()
    shape = F.when(own.isNotNull(), "messages").when(share.isNotNull(), "conversations").when(filled, "instruction").otherwise("unknown")
    messages = F.coalesce(own, share, F.when(filled, from_instruction_form(told, extra, answer)))
    return df.withColumns({"shape": shape, "messages": messages})


def of_role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m.role == role)


def single_exchange(messages: Column) -> Column:
    """struct(system, user, assistant, skip): the last system turn and the only user and assistant turns, else why not."""
    users, answers = of_role(messages, "user"), of_role(messages, "assistant")
    skip = F.when(messages.isNull(), "no_messages").when(F.size(users) != 1, "user_turns").when(F.size(answers) != 1, "assistant_turns").when(F.trim(F.get(users, 0).content) == "", "empty_user")
    return F.struct(F.try_element_at(of_role(messages, "system"), F.lit(-1)).content.alias("system"), F.get(users, 0).content.alias("user"), F.get(answers, 0).content.alias("assistant"), skip.alias("skip"))


def user_texts(df: DataFrame, messages: str = "messages", key: str = "id") -> DataFrame:
    """(id, user): the first user turn of each id; records without one give none, of repeated ids the first text by order counts."""
    d = df.select(key, F.get(F.transform(F.filter(messages, lambda m: m.role == "user"), lambda m: m.content), 0).alias("user")).where("user is not null")
    return d.groupBy(key).agg(F.min("user").alias("user"))


def prompt_key(messages: Column) -> Column:
    """All user turns, stripped, as a groupable key."""
    return F.transform(of_role(messages, "user"), lambda m: _strip(m.content))


def answer_text(messages: Column) -> Column:
    return F.array_join(F.transform(of_role(messages, "assistant"), lambda m: m.content), "\n")


def wrap_reasoning(messages: Column) -> Column:
    """Reasoning moved into the answer between think tags; an answer that has tags is wrapped anew, so twice is once."""
    tagged = r"(?s)^\s*<think>(.*?)</think>\n*(.*)$"

    def merged(m: Column) -> Column:
        inner, rest = F.regexp_extract(m.content, tagged, 1), F.regexp_extract(m.content, tagged, 2)
        has = m.content.rlike(tagged)
        thought = F.coalesce(F.nullif(_strip(m.reasoning_content), F.lit("")), F.when(has, _strip(inner)))
        body = F.when(has, rest).otherwise(m.content)
        content = F.when((m.role == "assistant") & thought.isNotNull(), F.concat(F.lit("<think>\n"), thought, F.lit("\n</think>\n\n"), body)).otherwise(m.content)
        return F.struct(m.role.alias("role"), content.alias("content"), F.lit(None).cast("string").alias("reasoning_content"))

    return F.transform(messages, merged)


def with_reasoning_only(df: DataFrame, messages: str = "messages") -> DataFrame:
    return df.where(F.exists(messages, lambda m: (m.role == "assistant") & (F.length(F.trim(F.coalesce(m.reasoning_content, F.lit("")))) > 0)))


def superseded(corpus: DataFrame, reasoning: DataFrame, key: str = "key", answer: str = "answer", keep_exact: bool = False) -> DataFrame:
    """Corpus with a ``verdict``: superseded (its prompt is in ``reasoning``), duplicate (an earlier row has prompt and answer), keep.

    Rows need file and line, which decide what is earlier.
    """
    from pyspark.sql import Window

    known = reasoning.select(key).distinct().withColumn("_known", F.lit(True))
    w = Window.partitionBy(key, answer).orderBy("file", "line")
    d = corpus.withColumn("_rn", F.row_number().over(w)).join(known, key, "left")
    verdict = F.when(F.col("_known"), "superseded").when((F.col("_rn") > 1) & F.lit(not keep_exact), "duplicate").otherwise("keep")
    return d.withColumn("verdict", verdict).drop("_rn", "_known")
