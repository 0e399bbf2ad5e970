"""Queries over instruction pairs, chats and token rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DEFAULT_SYSTEM_TEXT, PAD_TOKEN_ID, SPECIAL_TOKENS, STRIP_CHARS, TOOLS_FOOTER, TOOLS_HEADER
from ..functions import chat as H
from ..functions import text as X
from ..functions import tokens as TK
from ..operators import projections as P
from ..operators import registry as U
from ..operators import steps as S
from ..operators import tokens as K
from ..operators.filters import quarantine_bad_rows, require_rows
from ..operators.ranking import shuffle_rank
from ..session import spread, write_through
from .catalog import query
from .standins import V_INSTRUCTION
from .text_data import prepare_chat_tokens, prepare_instruction_tokens
from .turns import first_two_turns, min_turns, render_turns

ID = ["conv_id", "turn"]
WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in STRIP_CHARS) + ")"
SYS = f"<|im_start|>system\n{DEFAULT_SYSTEM_TEXT}<|im_end|>\n"
TOOLS = [{"type": "function", "function": {"name": "lookup", "parameters": {"type": "object"}}}]
TOOL_TEXT = '\n{"type": "function", "function": {"name": "lookup", "parameters": {"type": "object"}}}'

# ---- schema mapping -----------------------------------------------------------------------


@query("dolly_to_instruction", "SELECT conv_id, turn, instruction, input, output FROM v_instruction", (V_INSTRUCTION,))
def _(t):
    raw = t.instruction.withColumnsRenamed({"input": "context", "output": "response"})
    return P.dolly_to_instruction(raw, ID)


FIRST_TWO = """heads AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, text FROM conversations)"""


@query(
    "chat_to_instruction",
    """SELECT a.conv_id, a.text AS instruction, '' AS input, b.text AS output
       FROM heads a JOIN heads b ON a.conv_id = b.conv_id AND a.rn = 1 AND b.rn = 2""",
    (FIRST_TWO,),
)
def _(t):
    return first_two_turns(t.conversations)


@query(
    "min_messages",
    "SELECT conv_id, COUNT(*) AS n_messages FROM conversations GROUP BY 1 HAVING COUNT(*) >= 2",
)
def _(t):
    return min_turns(t.conversations)


@query(
    "chat_messages",
    """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS lines
       FROM conversations GROUP BY 1 HAVING COUNT(*) >= 2""",
)
def _(t):
    chats = P.min_messages(t.messages)
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return chats.select("conv_id", F.array_join(lines, "\n").alias("lines"))


@query(
    "coalesce_fields",
    """SELECT conv_id, turn, COALESCE(NULLIF(input, ''), output) AS answer, 'none' AS label,
              COALESCE(instruction, 'x') AS question FROM v_instruction""",
    (V_INSTRUCTION,),
)
def _(t):
    rows = t.instruction.withColumn("input", F.nullif("input", F.lit("")))
    made = P.coalesce_fields(
        rows, answer=(["missing", "input", "output"], ""), label=(["absent"], "none"), question=(["instruction"], "x")
    )
    return made.select(*ID, "answer", "label", "question")


@query(
    "detect_format",
    """SELECT conv_id, turn, 'alpaca' AS by_schema,
              CASE WHEN input <> '' THEN 'dolly' ELSE 'alpaca' END AS by_row FROM v_instruction""",
    (V_INSTRUCTION,),
)
def _(t):
    # a mixed source: rows with a system text carry it as a response
    mixed = t.instruction.withColumn("response", F.nullif("input", F.lit("")))
    return mixed.select(
        *ID, F.lit(P.detect_format(t.instruction)).alias("by_schema"), P.detect_format_per_row(mixed).alias("by_row")
    )


# ---- chat formats ---------------------------------------------------------------------------


def _flat(df):
    m = F.col("messages")
    return df.select(
        *ID,
        m[0]["role"].alias("first_role"), m[0]["content"].alias("prompt"),
        m[1]["role"].alias("second_role"), m[1]["content"].alias("answer"),
    )


def _chat_sql(label: str) -> str:
    return f"""SELECT conv_id, turn, 'user' AS first_role,
      CASE WHEN input <> '' THEN concat(instruction, '\n\n{label}: ', input) ELSE instruction END AS prompt,
      'assistant' AS second_role, output AS answer FROM v_instruction"""


@query("format_dolly", _chat_sql("Context"), (V_INSTRUCTION,))
def _(t):
    raw = t.instruction.withColumnsRenamed({"input": "context", "output": "response"})
    return _flat(P.to_chat(raw, ID))


@query("format_alpaca", _chat_sql("Input"), (V_INSTRUCTION,))
def _(t):
    return _flat(P.to_chat(t.instruction, ID))


@query(
    "format_simple",
    """SELECT conv_id, turn, 'user' AS first_role, instruction AS prompt,
              'assistant' AS second_role, output AS answer FROM v_instruction""",
    (V_INSTRUCTION,),
)
def _(t):
    raw = t.instruction.select(*ID, F.col("instruction").alias("text"), F.col("output").alias("output"))
    return _flat(P.to_chat(raw, ID))


TURN_PROMPT = f"""concat('<start_of_turn>user\n', instruction,
  CASE WHEN trim(input, {WS}) <> '' THEN concat('\n', input) ELSE '' END,
  '<end_of_turn>\n<start_of_turn>model\n')"""
TURN_RESPONSE = "concat(output, '<end_of_turn>')"


@query(
    "format_gemma_turns",
    f"""SELECT conv_id, turn, concat({TURN_PROMPT}, {TURN_RESPONSE}) AS text, {TURN_PROMPT} AS prompt,
               {TURN_RESPONSE} AS response FROM v_instruction""",
    (V_INSTRUCTION,),
)
def _(t):
    return P.format_gemma_turns(t.instruction, keep=ID)


TEMPLATE_SQL = """SELECT conv_id, turn, concat('### Q {', instruction, '}\n### A\n') AS prompt,
  concat(output, '</s>') AS response, concat('### Q {', instruction, '}\n### A\n', output, '</s>') AS text,
  input <> '' AS has_image, CASE WHEN input <> '' THEN concat('img_', conv_id, '.jpg') END AS image FROM v_instruction"""


@query("format_template", TEMPLATE_SQL, (V_INSTRUCTION,))
def _(t):
    image = F.concat(F.lit("img_"), F.col("conv_id").cast("string"), F.lit(".jpg"))
    rows = t.instruction.withColumn("image", F.when(F.col("input") != "", image).otherwise(""))
    return P.format_template(rows, "### Q {{{instruction}}}\n### A\n", "{output}</s>", keep=ID)


CHATML_SQL = f"""SELECT conv_id,
    CASE WHEN min_by(role, turn) <> 'system' THEN '{SYS}' ELSE '' END
    || string_agg('<|im_start|>' || role || '\n' || text || '<|im_end|>\n', '' ORDER BY turn) AS text
  FROM conversations GROUP BY 1"""


@query("render_chatml", CHATML_SQL)
def _(t):
    return render_turns(t.conversations)


@query(
    "generation_prompt",
    f"SELECT conv_id, text || '<|im_start|>assistant\n' AS text FROM ({CHATML_SQL}) q",
)
def _(t):
    return render_turns(t.conversations, generation_prompt=True)


TOOLS_SQL = f"""SELECT conv_id, turn,
      '<|im_start|>system\n' || CASE WHEN input <> '' THEN input ELSE '{DEFAULT_SYSTEM_TEXT}' END
      || '{TOOLS_HEADER}{TOOL_TEXT}{TOOLS_FOOTER}'
      || '<|im_start|>user\n' || instruction || '<|im_end|>\n'
      || '<|im_start|>assistant\n<tool_call>\n{{"name": "lookup", "arguments": {{"turn": ' || turn || '}}}}\n</tool_call><|im_end|>\n'
      || '<|im_start|>user\n<tool_response>\n' || length(output) || '\n</tool_response>\n<tool_response>\n' || output || '\n</tool_response><|im_end|>\n'
      || '<|im_start|>assistant\n' || output || '<|im_end|>\n' AS text FROM v_instruction"""


def tool_chats(t, wrapped: bool):
    """Chats in which the assistant calls a tool; the call is plain or inside ``function``."""
    arguments = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}"))
    call = F.struct(F.lit("lookup").alias("name"), arguments.alias("arguments"))
    kind = "struct<name:string,arguments:string>"
    call, kind = (F.struct(call.alias("function")), f"struct<function:{kind}>") if wrapped else (call, kind)
    none = F.lit(None).cast(f"array<{kind}>")

    def m(role, content, calls=none):
        return F.struct(F.lit(role).alias("role"), content.alias("content"), calls.alias("tool_calls"))

    chat = F.array(
        m("user", F.col("instruction")),
        m("assistant", F.lit(None).cast("string"), F.array(call)),
        m("tool", F.length("output").cast("string")),
        m("tool", F.col("output")),
        m("assistant", F.col("output")),
    )
    system = F.array(m("system", F.col("input")))
    messages = F.when(F.col("input") != "", F.concat(system, chat)).otherwise(chat)
    return t.instruction.select(*ID, messages.alias("messages"))


@query("render_chatml_tools", TOOLS_SQL, (V_INSTRUCTION,))
def _(t):
    return tool_chats(t, wrapped=False).select(*ID, H.render_chatml_tools(F.col("messages"), TOOLS).alias("text"))


@query("render_chatml_function_calls", TOOLS_SQL, (V_INSTRUCTION,))
def _(t):
    text = H.render_chatml_tools(F.col("messages"), TOOLS, call_form="function")
    return tool_chats(t, wrapped=True).select(*ID, text.alias("text"))


# ---- text helpers -----------------------------------------------------------------------------


@query(
    "extract_answer",
    f"""SELECT conv_id, turn,
      trim(string_split(concat('user ', instruction, ' assistant\n', output), 'assistant')[-1], {WS}) AS marked,
      trim(substr(concat(instruction, output), length(instruction) + 1), {WS}) AS unmarked FROM v_instruction""",
    (V_INSTRUCTION,),
)
def _(t):
    marked = F.concat(F.lit("user "), "instruction", F.lit(" assistant\n"), "output")
    unmarked = F.concat("instruction", "output")
    return t.instruction.select(
        *ID,
        X.extract_answer(marked).alias("marked"),
        X.extract_answer(unmarked, prompt=F.col("instruction")).alias("unmarked"),
    )


@query(
    "preview",
    """SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS shown,
              substr(text, 1, 50) AS cut, concat(substr(text, 1, 100), '...') AS always FROM documents""",
)
def _(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id", X.preview(text).alias("shown"), X.preview(text, 50, "never").alias("cut"),
        X.preview(text, 100, "always").alias("always"),
    )


@query(
    "is_blank",
    f"""SELECT conv_id, turn, trim(input, {WS}) = '' AS blank, input = '' AS empty,
               trim(concat(chr(9), text, chr(10), chr(160)), {WS}) AS stripped
        FROM (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN concat(' ', chr(9), chr(10))
              ELSE text END AS input FROM conversations) q""",
)
def _(t):
    rest = F.col("turn") % 3
    rows = t.conversations.withColumn("input", F.when(rest == 0, "").when(rest == 1, " \t\n").otherwise(F.col("text")))
    padded = F.concat(F.lit("\t"), F.col("text"), F.lit("\n\xa0"))
    return rows.select(
        *ID, X.is_blank(F.col("input")).alias("blank"), X.is_empty(F.col("input")).alias("empty"),
        X.strip(padded).alias("stripped"),
    )


# ---- row checks -------------------------------------------------------------------------------


@query(
    "quarantine_bad_rows",
    """SELECT event_id, 'kept' AS fate, CAST(json_extract(props, '$.k') AS VARCHAR) AS content
       FROM events WHERE event_type <> 'error'
       UNION ALL SELECT event_id, 'rejected', substr(props, 1, length(props) - 1) FROM events WHERE event_type = 'error'""",
)
def _(t):
    # the error events lose their closing brace
    cut = F.substr(F.col("props"), F.lit(1), F.length("props") - 1)
    rows = t.table("events").select("event_id", F.when(F.col("event_type") == "error", cut).otherwise(F.col("props")).alias("props"))
    good, bad = quarantine_bad_rows(rows, "props", T.StructType([T.StructField("k", T.LongType())]))
    return good.select("event_id", F.lit("kept").alias("fate"), F.col("k").cast("string").alias("content")).unionByName(
        bad.select("event_id", F.lit("rejected").alias("fate"), F.col("props").alias("content"))
    )


@query("require_rows", "SELECT doc_id, lang FROM documents")
def _(t):
    return require_rows(t.documents.select("doc_id", "lang"), "documents")


# ---- tokens -----------------------------------------------------------------------------------

CASES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SPECIAL_TOKENS.items())
TOKENS = f"regexp_extract_all({{}}, '{TK.TOKEN_PATTERN}', 1)"
TOKEN_ID = f"CASE x {CASES} ELSE ('0x' || substr(md5(x), 1, 8))::BIGINT % {PAD_TOKEN_ID} END"


def ids_sql(column: str) -> str:
    return f"list_transform({TOKENS.format(column)}, lambda x: {TOKEN_ID})"


V_TURNS = f"""v_turns AS (
  SELECT conv_id, turn, concat({TURN_PROMPT}, {TURN_RESPONSE}) AS text, {TURN_PROMPT} AS prompt FROM v_instruction)"""
LENGTH = 512


@query(
    "tokenize_pad",
    f"""SELECT doc_id, array_to_string(list_resize(ids, {LENGTH}, {PAD_TOKEN_ID}), ' ') AS input_ids,
               least(len(ids), {LENGTH}) AS n_real, {LENGTH} AS n_mask
        FROM (SELECT doc_id, {ids_sql('text')} AS ids FROM documents) q""",
)
def _(t):
    rows = K.tokenize_pad(t.documents.select("doc_id", "text"), LENGTH, partitions=t.tasks_for("documents"))
    return rows.select(
        "doc_id", K.joined(F.col("input_ids")).alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n_real"),
        F.size("attention_mask").alias("n_mask"),
    )


@query("tokenize", f"SELECT doc_id, array_to_string({ids_sql('text')}, ' ') AS input_ids FROM documents")
def _(t):
    rows = K.tokenize(t.documents.select("doc_id", "text"), partitions=t.tasks_for("documents"))
    return rows.select("doc_id", K.joined(F.col("input_ids")).alias("input_ids"))


@query(
    "mask_prompt_labels",
    f"""SELECT conv_id, turn, array_to_string(list_transform(list_resize(ids, {LENGTH}, {PAD_TOKEN_ID}),
          lambda x, i: CASE WHEN i <= plen THEN -100 ELSE x END), ' ') AS labels
        FROM (SELECT conv_id, turn, {ids_sql('text')} AS ids, len({TOKENS.format('prompt')}) AS plen FROM v_turns) q""",
    (V_INSTRUCTION, V_TURNS),
)
def _(t):
    rows = prepare_instruction_tokens(t.instruction, LENGTH, keep=ID)
    return rows.select(*ID, K.joined(F.col("labels")).alias("labels"))


V_RENDERED = f"""v_rendered AS (
  SELECT conv_id, turn, concat('{SYS}<|im_start|>user\n',
    CASE WHEN input <> '' THEN concat(instruction, '\n\nInput: ', input) ELSE instruction END,
    '<|im_end|>\n<|im_start|>assistant\n', output, '<|im_end|>\n') AS text FROM v_instruction)"""


@query(
    "mask_pad_labels",
    f"""SELECT conv_id, turn, array_to_string(list_transform(list_resize(ids, {LENGTH}, {PAD_TOKEN_ID}),
          lambda x: CASE WHEN x = {PAD_TOKEN_ID} THEN -100 ELSE x END), ' ') AS labels
        FROM (SELECT conv_id, turn, {ids_sql('text')} AS ids FROM v_rendered) q""",
    (V_INSTRUCTION, V_RENDERED),
)
def _(t):
    rows = prepare_chat_tokens(t.instruction, LENGTH, keep=ID)
    return rows.select(*ID, K.joined(F.col("labels")).alias("labels"))


BATCH = 8


@query(
    "pad_to_batch_longest",
    f"""SELECT doc_id, batch_id, padded_length, array_to_string(list_resize(ids, padded_length, {PAD_TOKEN_ID}), ' ') AS input_ids
        FROM (SELECT doc_id, batch_id, ids, CAST(ceil(max(len(ids)) OVER (PARTITION BY batch_id) / 8.0) * 8 AS INTEGER) AS padded_length
              FROM (SELECT doc_id, ids, (row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) - 1) // {BATCH} AS batch_id
                    FROM (SELECT doc_id, {ids_sql('text')} AS ids FROM documents) a) b) c""",
)
def _(t):
    # ids and token counts are ranked; the texts meet their batch's length once, and are tokenised after that
    texts = t.documents.select("doc_id", "text")
    sizes = write_through(spread(texts, t.tasks_for("documents")).select("doc_id", F.size(TK.split_tokens(F.col("text"))).alias("n_tokens")), "sizes")
    batches = S.assign_steps(shuffle_rank(sizes, "doc_id"), batch_size=BATCH).withColumnRenamed("micro", "batch_id")
    lengths = batches.join(K.batch_lengths(batches, multiple_of=8), "batch_id").select("doc_id", "batch_id", "padded_length")
    # dealt by a fixed number, so that tasks are not merged by bytes before the costly step
    dealt = texts.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    rows = K.tokenize(dealt.join(lengths, "doc_id"))
    return K.pad_to_column(rows).select("doc_id", "batch_id", "padded_length", K.joined(F.col("input_ids")).alias("input_ids"))


@query(
    "flag_overlength",
    f"""SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, len({TOKENS.format('text')}) > {LENGTH} AS over_length FROM documents""",
)
def _(t):
    rows = t.documents.select("doc_id", "text").select("doc_id", TK.split_tokens(F.col("text")).alias("input_ids"))
    flagged = K.flag_overlength(rows, LENGTH)
    return flagged.select("doc_id", F.size("input_ids").cast("long").alias("n_tokens"), "over_length")


@query(
    "default_pad_token",
    """SELECT doc_id, COALESCE(CASE WHEN toxic = 1 THEN 0 END, 151645) AS pad_token_id FROM labels""",
)
def _(t):
    config = t.table("labels").select(
        "doc_id", F.when(F.col("toxic") == 1, 0).alias("pad_token_id"), F.lit(151645).alias("eos_token_id")
    )
    return K.default_pad_token(config).select("doc_id", "pad_token_id")


@query(
    "special_token_ids",
    f"""SELECT conv_id, turn, token, count(*) AS n, min(position) AS first_position,
               CASE token {CASES} END AS id
        FROM (SELECT conv_id, turn, unnest({TOKENS.format('text')}) AS token,
                     unnest(range(len({TOKENS.format('text')}))) AS position FROM v_rendered) q
        WHERE token IN ({', '.join(repr(k) for k in SPECIAL_TOKENS)}) GROUP BY conv_id, turn, token""",
    (V_INSTRUCTION, V_RENDERED),
)
def _(t):
    rendered = P.format_alpaca(t.instruction, ID).select(*ID, H.render_chatml(F.col("messages")).alias("text"))
    found = K.special_token_ids(rendered)
    return found.groupBy(*ID, "token").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").cast("long").alias("first_position"), F.first("id").alias("id")
    )


# ---- caller-supplied functions ------------------------------------------------------------------


@query("map_rows", "SELECT doc_id, upper(lang) AS lang, length(text) AS n FROM documents")
def _(t):
    return U.map_rows(t.documents, doc_id=F.col("doc_id"), lang=F.upper("lang"), n=F.length("text").cast("long"))


@query("map_batches", "SELECT doc_id, len(string_split(text, ' ')) AS pieces FROM documents")
def _(t):
    def count(batch):
        return batch.assign(pieces=batch["text"].str.count(" ") + 1)[["doc_id", "pieces"]]

    return U.map_batches(t.documents.select("doc_id", "text"), count, "doc_id long, pieces long")


@query("filter_rows", "SELECT doc_id, lang FROM documents WHERE n_chars > 400 AND lang <> 'en'")
def _(t):
    return U.filter_rows(t.documents, (F.col("n_chars") > 400) & (F.col("lang") != "en")).select("doc_id", "lang")


@query(
    "formatter_registry",
    "SELECT doc_id, concat('<image>User: Describe this image.\nAssistant: ', text) AS text FROM documents",
)
def _(t):
    return t.documents.select("doc_id", "text").transform(lambda df: U.formatter("inline_prompt")(df, keep=["doc_id"]))


@query("template_strings", f"SELECT conv_id, turn, prompt, response, text FROM ({TEMPLATE_SQL}) q", (V_INSTRUCTION,))
def _(t):
    prompt = P.fill_template("### Q {{{instruction}}}\n### A\n", instruction=F.col("instruction"))
    response = P.fill_template("{output}</s>", output=F.col("output"))
    return t.instruction.select(*ID, prompt.alias("prompt"), response.alias("response"), F.concat(prompt, response).alias("text"))
