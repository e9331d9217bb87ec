"""Format adapters: from the shapes of raw records to texts, messages and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Markers of the chat template and prompts.
ROLES = ("system", "user", "assistant")
END = "<|endoftext|>"
ALPACA_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request.\n\n### Instruction:\n{i}\n\n### Input:\n{x}\n\n### Response: "
)
ALPACA = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n{i}\n\n### Response: "


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def format_math(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Problem:\n"), _blank(question), F.lit("\n\nSolution:\n"), _blank(answer))


def format_qa(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Question: "), _blank(question), F.lit("\nAnswer: "), _blank(answer))


def format_instruction(inputs: Column, targets: Column) -> Column:
    return F.concat(_blank(inputs), F.lit("\n"), _blank(targets))


def fill(template: str, **values: Column) -> Column:
    """template with {name} replaced by the columns; values are not searched again."""
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(head), _blank(values[name])]
    return F.concat(*out, F.lit(rest))


def alpaca_prompt(instruction: Column, context: Column) -> Column:
    return F.when(_blank(context) != "", fill(ALPACA_INPUT, i=instruction, x=context)).otherwise(fill(ALPACA, i=instruction))


def two_messages(question: Column, answer: Column) -> Column:
    return F.array(
        F.struct(F.lit("user").alias("role"), _blank(question).alias("content")),
        F.struct(F.lit("assistant").alias("role"), _blank(answer).alias("content")),
    )


def rename_roles(messages: Column) -> Column:
    """human becomes user, anything else assistant."""
    return F.transform(messages, lambda m: F.struct(F.when(m["role"] == "human", "user").otherwise("assistant").alias("role"), m["content"].alias("content")))


def render_chat(messages: Column, prompt: bool = False) -> Column:
    """<|role|>, a line break, the content, line by line; ends with the end marker, or opens the assistant's turn."""
    known = F.filter(messages, lambda m: m["role"].isin(*ROLES))
    turns = F.transform(known, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), _blank(m["content"])))
    return F.concat(F.array_join(turns, "\n"), F.lit("\n<|assistant|>\n" if prompt else f"\n{END}"))


def parse_role_markers(text: Column, instruction: Column | None = None, output: Column | None = None) -> Column:
    """Messages of a text with '### Human:' and '### Assistant:' markers; text before the first is dropped, and so are blank
    turns. A text without any marker gives instruction and output as two messages where both are known, else none."""
    turns = F.filter(F.split(text, r"(?=### (?:Human|Assistant):)"), lambda x: x.rlike(r"^### (?:Human|Assistant):"))
    messages = F.transform(
        turns,
        lambda x: F.struct(
            F.when(x.startswith("### Human:"), "user").otherwise("assistant").alias("role"),
            T.strip(F.regexp_replace(x, r"^### (?:Human|Assistant):", "")).alias("content"),
        ),
    )
    marked = F.filter(messages, lambda m: m["content"] != "")
    if instruction is None or output is None:
        return marked
    plain = ~F.coalesce(text, F.lit("")).rlike("### (?:Human|Assistant):") & instruction.isNotNull() & output.isNotNull()
    return F.when(plain, two_messages(instruction, output)).otherwise(marked)


def messages_of(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per conversation: its messages in order. Equal order is broken by role and text."""
    turn = F.struct(F.col(order), F.col(role).alias("role"), F.col(text).alias("content"))
    listed = F.transform(F.array_sort(F.collect_list(turn)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return turns.groupBy(key).agg(listed.alias("messages"))


def pairs_of(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, order, question, answer): each user turn that an assistant turn follows at once."""
    w = Window.partitionBy(key).orderBy(order)
    rows = turns.select(key, order, role, F.col(text).alias("question"), F.lead(role).over(w).alias("_next"), F.lead(text).over(w).alias("answer"))
    return rows.where((F.col(role) == "user") & (F.col("_next") == "assistant")).select(key, order, "question", "answer")


def split_system(messages: Column) -> tuple[Column, Column]:
    """System texts joined by a blank line, and the rest with assistant turned into model and others into user."""
    system = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: _blank(m["content"])), "\n\n")
    rest = F.transform(
        F.filter(messages, lambda m: m["role"] != "system"),
        lambda m: F.struct(F.when(m["role"] == "assistant", "model").otherwise("user").alias("role"), m["content"].alias("content")),
    )
    return system, rest


def conversation_title(turns: DataFrame, key: str = "conv_id", n: int = 50) -> DataFrame:
    first = F.min_by("text", "turn")
    return turns.where("role = 'user'").groupBy(key).agg(T.preview(first, n).alias("title"))


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(spark, d):
    return pairs_of(_read(spark, d, "conversations"))


def _chat(spark, d):
    return messages_of(_read(spark, d, "conversations"))


PAIRS_SQL = """(SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"""


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fill_sql(template: str, **names: str) -> str:
    for name, column in names.items():
        template = template.replace("{" + name + "}", f"\x00{column}\x00")
    return " || ".join(_lit(x) if k % 2 == 0 else x for k, x in enumerate(template.split("\x00")))


QUERIES = {
    "a01_format_text": lambda s, d: _read(s, d, "documents").select("doc_id", "text"),
    "a02_format_content": lambda s, d: _read(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("content_text")),
    "a03_format_math": lambda s, d: _pairs(s, d).select("conv_id", "turn", format_math(F.col("question"), F.col("answer")).alias("text")),
    "a04_format_instruction": lambda s, d: _pairs(s, d).select("conv_id", "turn", format_instruction(F.col("question"), F.col("answer")).alias("text")),
    "a05_format_qa": lambda s, d: _pairs(s, d).select("conv_id", "turn", format_qa(F.col("question"), F.col("answer")).alias("text")),
    "a06_chat_passthrough": lambda s, d: _chat(s, d).select("conv_id", F.size("messages").cast("long").alias("n"), F.to_json("messages").alias("messages")),
    "a07_two_messages": lambda s, d: _pairs(s, d).select("conv_id", "turn", F.to_json(two_messages(F.col("question"), F.col("answer"))).alias("messages")),
    "a08_role_markers": lambda s, d: _chat(s, d).select(
        "conv_id",
        F.array_join(F.transform("messages", lambda m: F.concat(F.when(m["role"] == "user", "### Human: ").otherwise("### Assistant: "), m["content"])), "\n").alias("t"),
    ).select("conv_id", F.to_json(parse_role_markers(F.col("t"))).alias("messages")),
    "a08_instruction_fallback": lambda s, d: _pairs(s, d).select(
        "conv_id", "turn", parse_role_markers(F.when(F.col("turn") % 4 == 0, F.concat(F.lit("x ### Human: "), "question")).otherwise(F.col("question")), F.col("question"), F.col("answer")).alias("m"),
    ).select("conv_id", "turn", F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(": "), T.strip(m["content"]))), "|").alias("messages")),
    "a09_rename_roles": lambda s, d: _read(s, d, "conversations").groupBy(F.when(F.col("role") == "user", "user").otherwise("assistant").alias("role")).agg(F.count("*").alias("n")),
    "a10_render_chat": lambda s, d: _chat(s, d).select("conv_id", render_chat(F.col("messages")).alias("text")),
    "a11_chat_prompt": lambda s, d: _chat(s, d).select("conv_id", render_chat(F.col("messages"), prompt=True).alias("text")),
    "a12_alpaca_prompt": lambda s, d: _pairs(s, d).select("conv_id", "turn", alpaca_prompt(F.col("question"), F.when(F.col("turn") % 2 == 0, F.col("answer"))).alias("text")),
    "a18_pair_length": lambda s, d: _pairs(s, d).select("conv_id", "turn", (F.length("question") + F.length("answer")).cast("long").alias("length")),
    "a20_prompt_prefix": lambda s, d: _read(s, d, "documents").select("doc_id", F.concat(F.lit("summarize: "), "text").alias("text")),
    "a21_text_by_presence": lambda s, d: _read(s, d, "documents").select("doc_id", F.coalesce("text", "lang", F.lit("")).alias("text")),
    "a22_text_by_truth": lambda s, d: _read(s, d, "documents").select("doc_id", F.coalesce(F.nullif("text", F.lit("")), "lang", F.lit("")).alias("text")),
    "a27_binary_label": lambda s, d: _read(s, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", 1).otherwise(0).cast("long").alias("label")),
    "a31_payload_preview": lambda s, d: _read(s, d, "events").select("event_id", F.left("props", F.lit(5)).alias("preview")),
    "a33_provider_messages": lambda s, d: _chat(s, d).select("conv_id", split_system(F.col("messages"))[0].alias("system"), F.to_json(split_system(F.col("messages"))[1]).alias("messages")),
    "a34_session_title": lambda s, d: conversation_title(_read(s, d, "conversations")),
    "a37_preview": lambda s, d: _read(s, d, "documents").select("doc_id", T.preview(F.col("text"), 80).alias("preview"), F.upper("source").alias("source")),
}

_CHAT_SQL = "(SELECT conv_id, list({{'role': role, 'content': text}} ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id)"
_RENDER = "array_to_string(list_transform(list_filter(m, lambda x: x.role IN ('system', 'user', 'assistant')), lambda x: '<|' || x.role || '|>' || chr(10) || coalesce(x.content, '')), chr(10))"
_CHAT_SQL = _CHAT_SQL.replace("{{", "{").replace("}}", "}")
_JSON = "to_json(m)::VARCHAR"

SQL = {
    "a01_format_text": "SELECT doc_id, text FROM documents",
    "a02_format_content": "SELECT conv_id, turn, text AS content_text FROM conversations",
    "a03_format_math": f"SELECT conv_id, turn, 'Problem:' || chr(10) || question || chr(10) || chr(10) || 'Solution:' || chr(10) || answer AS text FROM {PAIRS_SQL}",
    "a04_format_instruction": f"SELECT conv_id, turn, question || chr(10) || answer AS text FROM {PAIRS_SQL}",
    "a05_format_qa": f"SELECT conv_id, turn, 'Question: ' || question || chr(10) || 'Answer: ' || answer AS text FROM {PAIRS_SQL}",
    "a06_chat_passthrough": f"SELECT conv_id, len(m) AS n, {_JSON} AS messages FROM {_CHAT_SQL}",
    "a07_two_messages": f"SELECT conv_id, turn, to_json([{{'role': 'user', 'content': question}}, {{'role': 'assistant', 'content': answer}}])::VARCHAR AS messages FROM {PAIRS_SQL}",
    "a09_rename_roles": "SELECT CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, count(*) AS n FROM conversations GROUP BY 1",
    "a10_render_chat": f"SELECT conv_id, {_RENDER} || chr(10) || '<|endoftext|>' AS text FROM {_CHAT_SQL}",
    "a11_chat_prompt": f"SELECT conv_id, {_RENDER} || chr(10) || '<|assistant|>' || chr(10) AS text FROM {_CHAT_SQL}",
    "a08_instruction_fallback": rf"""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 OR contains(question, '### Human:') OR contains(question, '### Assistant:') THEN 'user: ' || regexp_replace(question, '^\s+|\s+$', '', 'g')
      ELSE 'user: ' || regexp_replace(question, '^\s+|\s+$', '', 'g') || '|assistant: ' || regexp_replace(answer, '^\s+|\s+$', '', 'g') END AS messages FROM {PAIRS_SQL}""",
    "a12_alpaca_prompt": f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND answer <> '' THEN 'Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || question || chr(10) || chr(10) || '### Input:' || chr(10) || answer || chr(10) || chr(10) || '### Response: ' ELSE 'Below is an instruction that describes a task. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || question || chr(10) || chr(10) || '### Response: ' END AS text FROM {PAIRS_SQL}",
    "a18_pair_length": f"SELECT conv_id, turn, length(question) + length(answer) AS length FROM {PAIRS_SQL}",
    "a20_prompt_prefix": "SELECT doc_id, 'summarize: ' || text AS text FROM documents",
    "a21_text_by_presence": "SELECT doc_id, coalesce(text, lang, '') AS text FROM documents",
    "a22_text_by_truth": "SELECT doc_id, coalesce(nullif(text, ''), lang, '') AS text FROM documents",
    "a27_binary_label": "SELECT conv_id, turn, CAST(role = 'assistant' AS BIGINT) AS label FROM conversations",
    "a31_payload_preview": "SELECT event_id, left(props, 5) AS preview FROM events",
    "a33_provider_messages": f"""SELECT conv_id, coalesce(array_to_string(list_transform(list_filter(m, lambda x: x.role = 'system'), lambda x: coalesce(x.content, '')), chr(10) || chr(10)), '') AS system,
      to_json(list_transform(list_filter(m, lambda x: x.role <> 'system'), lambda x: {{'role': CASE WHEN x.role = 'assistant' THEN 'model' ELSE 'user' END, 'content': x.content}}))::VARCHAR AS messages FROM {_CHAT_SQL}""",
    "a34_session_title": "SELECT conv_id, CASE WHEN length(t) > 50 THEN left(t, 50) || '...' ELSE t END AS title FROM (SELECT conv_id, min_by(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)",
    "a37_preview": "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview, upper(source) AS source FROM documents",
}
