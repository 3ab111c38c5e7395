"""Queries over ``conversations``: turn assembly, chat and instruction paths, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunegrain.functions import chat
from tunegrain.operators import normalize as norm
from tunegrain.operators import validate
from tunegrain.plans.fixtures import (
    CHAT_MAPPING,
    CHAT_SQL,
    conversations,
    normalized_conversations,
    strip_sql,
    table,
    tokens_sql,
)
from tunegrain.schema import FieldMapping, TaskFormat
from tunegrain.session import materialize
from tunegrain.sources.loading import explode_document

CHATML = chat.ChatTemplate.named("chatml", suffix="<|im_end|>\n")
LLAMA = chat.ChatTemplate.named("llama-3.1", suffix="<|eot_id|>")
REVIEW = "Summarize what was said."


def _lines(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "\n")


def assemble_turns(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(spark, folder).select(
        "conv_id", F.size("messages").alias("n_turns"), _lines(F.col("messages")).alias("turns")
    )


def chat_accessors(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(spark, folder).select(
        "conv_id",
        chat.system_text(F.col("messages")).alias("system_text"),
        chat.last_assistant(F.col("messages")).alias("last_reply"),
    )


def chat_with_system(spark: SparkSession, folder: str) -> DataFrame:
    return normalized_conversations(spark, folder).select("row_id", _lines(F.col("messages")).alias("turns"), "drop_reason")


def chat_flags(spark: SparkSession, folder: str) -> DataFrame:
    return validate.measure(normalized_conversations(spark, folder), max_seq_length=512).select(
        "row_id", "tokens", "output_len", "empty_output", "tiny_output", "exceeds_seq_len"
    )


def has_system_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """How many conversations bring a system turn of their own, and whether any does."""
    own = chat.system_text(F.col("messages")).isNotNull()
    return conversations(spark, folder).agg(
        F.bool_or(chat.speaks_as_system(F.col("messages"))).alias("has_system"), F.count_if(own).alias("n_with_system")
    )


def _as_public_json(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation as JSON text the way public data sets write it, some of it broken.

    By conversation number: from/value turns, role/content turns, speaker/message turns,
    text that is not JSON, an object instead of a list, a list of strings, an empty list,
    a list with trailing text.
    """
    messages = F.col("messages")

    def written(role_key: str, content_key: str, roles: dict[str, str]):
        names = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
        return F.to_json(
            F.transform(
                messages,
                lambda m: F.struct(
                    F.try_element_at(names, m["role"]).alias(role_key), m["content"].alias(content_key)
                ),
            )
        )

    share = written("from", "value", {"user": "human", "assistant": "gpt", "system": "system"})
    plain = written("role", "content", {"user": "User ", "assistant": "ASSISTANT", "system": "system"})
    spoken = written("speaker", "message", {"user": "question", "assistant": "critic", "system": "system"})
    shape = F.col("conv_id") % 8
    text = (
        F.when(shape == 0, share)
        .when(shape == 1, plain)
        .when(shape == 2, spoken)
        .when(shape == 3, F.array_join(messages["content"], " "))
        .when(shape == 4, F.to_json(F.struct(messages.alias("messages"))))
        .when(shape == 5, F.to_json(messages["content"]))
        .when(shape == 6, F.lit("[]"))
        .otherwise(F.concat(plain, F.lit(" end")))
    )
    return conversations(spark, folder).select("conv_id", text.alias("messages"))


def _from_json(spark: SparkSession, folder: str) -> DataFrame:
    return norm.normalize(_as_public_json(spark, folder), CHAT_MAPPING, "conv_id")


def chat_from_json(spark: SparkSession, folder: str) -> DataFrame:
    return _from_json(spark, folder).select("row_id", _lines(F.col("messages")).alias("turns"), "drop_reason")


def chat_dropped(spark: SparkSession, folder: str) -> DataFrame:
    return norm.dropped(_from_json(spark, folder))


def chat_drop_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return norm.drop_reason_counts(_from_json(spark, folder))


def chat_issues(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(validate.measure(_from_json(spark, folder), 256).drop("messages", "text"), "measured")
    return validate.issues(rows, 256).select(
        "rank", "level", "code", "message", "n_rows", F.array_join("rows", ",").alias("sample")
    )


def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations written as JSON documents of five shapes, read back as records."""
    turns = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    shape = F.col("conv_id") % 5
    doc = (
        F.when(shape == 0, F.to_json(turns))
        .when(shape == 1, F.to_json(F.struct(F.lit(1).alias("v"), turns.alias("data"))))
        .when(shape == 2, F.to_json(F.struct(turns.alias("rows"), F.lit("x").alias("data"))))
        .when(shape == 3, F.to_json(F.struct(F.element_at("messages", 1)["role"].alias("role"), F.element_at("messages", 1)["content"].alias("content"))))
        .otherwise(F.to_json(F.struct(turns.alias("items"))))
    )
    docs = conversations(spark, folder).select("conv_id", doc.alias("doc"))
    return explode_document(docs, "doc").select(
        "conv_id",
        F.col("_pos").cast("bigint").alias("pos"),
        F.try_variant_get("v", "$.role", "string").alias("role"),
        F.try_variant_get("v", "$.content", "string").alias("content"),
    )


def instruction_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every user turn with the answer right after it (none if another turn follows), system text as extra input."""
    turns = table(spark, folder, "conversations")
    role, text, turn = F.col("role"), F.col("text"), F.col("turn")
    following = Window.partitionBy("conv_id").orderBy("turn")
    before = following.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flat = turns.select(
        F.concat_ws("/", "conv_id", "turn").alias("pair_id"),
        role.alias("role"),
        text.alias("question"),
        F.last(F.when(role == "system", text), ignorenulls=True).over(before).alias("context"),
        F.when(F.lead(role).over(following) == "assistant", F.lead(text).over(following)).alias("answer"),
    ).where("role = 'user'")
    mapping = FieldMapping(
        TaskFormat.INSTRUCTION,
        instruction_field="question",
        input_field="context",
        output_field="answer",
        system_prompt="Answer briefly.",
        input_template="{input}\n---\n{instruction}",
    )
    pairs = norm.normalize(flat, mapping, "pair_id")
    return pairs.select("row_id", _lines(F.col("messages")).alias("turns"), "drop_reason")


def render_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = normalized_conversations(spark, folder)
    return rows.select(
        "row_id",
        CHATML.render(F.col("messages")).alias("chatml"),
        LLAMA.render(F.col("messages")).alias("llama"),
    )


def response_spans(spark: SparkSession, folder: str) -> DataFrame:
    spans = chat.response_spans(F.col("messages"), F.col("text"), CHATML)
    rows = normalized_conversations(spark, folder).select("row_id", F.posexplode(spans).alias("i", "span"))
    return rows.select("row_id", "i", F.col("span.start").alias("begin"), F.col("span.end").alias("finish"))


def preview_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = normalized_conversations(spark, folder)
    return rows.select("row_id", chat.render_preview(F.col("messages"), F.col("text")).alias("preview"))


def document_preview(spark: SparkSession, folder: str) -> DataFrame:
    nothing = F.lit(None).cast("array<struct<role:string,content:string>>")
    return table(spark, folder, "documents").select("doc_id", chat.render_preview(nothing, F.col("text")).alias("preview"))


def history_filter(spark: SparkSession, folder: str) -> DataFrame:
    prompt = chat.history_prompt(F.col("messages"), F.lit("You help with fine-tuning."), F.lit(REVIEW))
    return conversations(spark, folder).select("conv_id", _lines(prompt).alias("turns"))


def plain_prompt(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(spark, folder).select("conv_id", chat.plain_prompt(F.col("messages")).alias("prompt"))


def document_prompt(spark: SparkSession, folder: str) -> DataFrame:
    prompt = chat.plain_prompt(chat.prompt_for(F.col("text")))
    return table(spark, folder, "documents").select("doc_id", prompt.alias("prompt"))


QUERIES = {
    f.__name__: f
    for f in (
        assemble_turns, chat_accessors, chat_with_system, chat_flags, has_system_prompt, chat_from_json, chat_dropped,
        chat_drop_reasons, chat_issues, json_documents, instruction_pairs, render_chat, response_spans, preview_text,
        document_preview, history_filter, plain_prompt, document_prompt,
    )
}

_NL = "chr(10)"
_TURNS = "string_agg(role || '=' || content, chr(10) ORDER BY turn)"
_REASON = """
    CASE conv_id % 8 WHEN 3 THEN 'messages field is a non-JSON string' WHEN 4 THEN 'messages field is not a list'
    WHEN 5 THEN 'conversation turn is not an object' WHEN 6 THEN 'conversation has no turns'
    WHEN 7 THEN 'messages field is a non-JSON string' END
"""
# What the JSON forms mean once read: speakers called "critic" keep that role.
_JSON_TURNS = f"""
    SELECT conv_id, turn, CASE WHEN conv_id % 8 = 2 AND role = 'assistant' THEN 'critic' ELSE role END AS role, content
    FROM ({CHAT_SQL}) WHERE conv_id % 8 <= 2
"""
_MEASURED = f"""
    SELECT conv_id, {tokens_sql('body')} AS tokens, output_len, body
    FROM (SELECT conv_id, string_agg(content, chr(10) ORDER BY turn) AS body,
                 coalesce(length(max_by(content, turn) FILTER (role = 'assistant')), 0) AS output_len
          FROM ({{turns}}) GROUP BY conv_id)
"""
_CHATML_PIECES = f"""
    SELECT conv_id, turn, role, length('<|im_start|>' || role || {_NL}) AS opening,
           length(content || '<|im_end|>' || {_NL}) AS rest FROM ({CHAT_SQL})
"""


def _rendered(opening: str, closing: str) -> str:
    return f"string_agg({opening} || content || {closing}, '' ORDER BY turn)"


ORACLES = {
    "assemble_turns": """
        SELECT conv_id, count(*) AS n_turns, string_agg(role || '=' || text, chr(10) ORDER BY turn) AS turns
        FROM conversations GROUP BY conv_id""",
    "chat_accessors": """
        SELECT conv_id, min_by(text, turn) FILTER (role = 'system') AS system_text,
               max_by(text, turn) FILTER (role = 'assistant') AS last_reply FROM conversations GROUP BY conv_id""",
    "chat_with_system": f"""
        SELECT conv_id AS row_id, {_TURNS} AS turns, NULL::VARCHAR AS drop_reason FROM ({CHAT_SQL}) GROUP BY conv_id""",
    "chat_flags": f"""
        SELECT conv_id AS row_id, tokens, output_len, output_len <= 2 AS empty_output,
               output_len BETWEEN 3 AND 9 AS tiny_output, tokens > 512 AS exceeds_seq_len
        FROM ({_MEASURED.format(turns=CHAT_SQL)})""",
    "has_system_prompt": """
        SELECT bool_or(role = 'system' AND text <> '') AS has_system,
               count(DISTINCT conv_id) FILTER (role = 'system') AS n_with_system FROM conversations""",
    "chat_from_json": f"""
        SELECT conv_id AS row_id, turns, {_REASON} AS drop_reason
        FROM (SELECT DISTINCT conv_id FROM conversations)
        LEFT JOIN (SELECT conv_id, {_TURNS} AS turns FROM ({_JSON_TURNS}) GROUP BY conv_id) USING (conv_id)""",
    "chat_dropped": f"""
        SELECT conv_id AS row_id, {_REASON} AS drop_reason FROM (SELECT DISTINCT conv_id FROM conversations)
        WHERE conv_id % 8 > 2""",
    "chat_drop_reasons": f"""
        SELECT {_REASON} AS drop_reason, count(*) AS n_rows FROM (SELECT DISTINCT conv_id FROM conversations)
        WHERE conv_id % 8 > 2 GROUP BY 1""",
    "chat_issues": f"""
        WITH m AS ({_MEASURED.format(turns=_JSON_TURNS)}),
        flagged AS (
            SELECT 'unparsed_rows' AS code, conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 8 > 2
            UNION ALL SELECT 'empty_output', conv_id FROM m WHERE output_len <= 2
            UNION ALL SELECT 'tiny_output', conv_id FROM m WHERE output_len BETWEEN 3 AND 9
            UNION ALL SELECT 'exceeds_seq_len', conv_id FROM m WHERE tokens > 256
            UNION ALL SELECT 'duplicates', conv_id
            FROM (SELECT conv_id, row_number() OVER (PARTITION BY {strip_sql('body')} ORDER BY conv_id) AS copy FROM m)
            WHERE copy > 1),
        found AS (
            SELECT code, count(*) AS n_rows, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (i <= 5) AS sample
            FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY conv_id) AS i FROM flagged) GROUP BY code),
        size AS (SELECT count(*) AS n FROM m)
        SELECT CASE code WHEN 'unparsed_rows' THEN 0 WHEN 'empty_output' THEN 4 WHEN 'tiny_output' THEN 5
                         WHEN 'exceeds_seq_len' THEN 6 ELSE 7 END AS rank,
               CASE code WHEN 'empty_output' THEN 'error' ELSE 'warning' END AS level, code,
               CASE code
                   WHEN 'unparsed_rows' THEN n_rows || ' raw row(s) were skipped during structuring (empty/invalid).'
                   WHEN 'empty_output' THEN 'Examples with an empty/near-empty response.'
                   WHEN 'tiny_output' THEN 'Very short responses (<10 chars) — verify these are intentional.'
                   WHEN 'exceeds_seq_len' THEN 'Examples longer than max_seq_length (256) will be truncated.'
                   ELSE 'Duplicate examples found; consider de-duplicating.' END AS message,
               n_rows, sample FROM found
        UNION ALL SELECT 2, 'error', 'too_few', 'Only ' || n || ' examples — need at least 10 to train.', 0, NULL
        FROM size WHERE n BETWEEN 1 AND 9
        UNION ALL SELECT 3, 'warning', 'small_dataset',
               n || ' examples is small; expect limited gains. 50+ is better.', 0, NULL FROM size WHERE n BETWEEN 10 AND 49""",
    "json_documents": """
        SELECT conv_id, i - 1 AS pos, role, text AS content
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
        WHERE conv_id % 5 <> 3 OR i = 1""",
    "instruction_pairs": f"""
        WITH flat AS (
            SELECT pair_id, coalesce({strip_sql("text")}, '') AS question, coalesce({strip_sql("system")}, '') AS context,
                   coalesce({strip_sql("reply")}, '') AS answer
            FROM (SELECT conv_id || '/' || turn AS pair_id, role, text,
                         last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (
                             PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS system,
                         CASE WHEN lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant'
                              THEN lead(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS reply
                  FROM conversations) WHERE role = 'user')
        SELECT pair_id AS row_id,
               CASE WHEN question <> '' AND answer <> '' THEN 'system=Answer briefly.' || chr(10) || 'user='
                    || CASE WHEN context <> '' THEN {strip_sql("context || chr(10) || '---' || chr(10) || question")}
                            ELSE question END || chr(10) || 'assistant=' || answer END AS turns,
               CASE WHEN question = '' THEN 'empty instruction' WHEN answer = '' THEN 'empty output' END AS drop_reason
        FROM flat""",
    "render_chat": f"""
        SELECT conv_id AS row_id,
               {_rendered("'<|im_start|>' || role || chr(10)", "'<|im_end|>' || chr(10)")} AS chatml,
               {_rendered("'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10)", "'<|eot_id|>'")} AS llama
        FROM ({CHAT_SQL}) GROUP BY conv_id""",
    "response_spans": f"""
        SELECT conv_id AS row_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i,
               CAST(finish - rest AS INTEGER) AS begin, CAST(finish AS INTEGER) AS finish
        FROM (SELECT *, sum(opening + rest) OVER (PARTITION BY conv_id ORDER BY turn) AS finish FROM ({_CHATML_PIECES}))
        WHERE role = 'assistant'""",
    "preview_text": f"""
        SELECT row_id, CASE WHEN length(t) > 1200 THEN substr(t, 1, 1200) || '…' ELSE t END AS preview
        FROM (SELECT conv_id AS row_id,
                     string_agg('<' || upper(role) || '>' || chr(10) || content, chr(10) || chr(10) ORDER BY turn) AS t
              FROM ({CHAT_SQL}) GROUP BY conv_id)""",
    "document_preview": """
        SELECT doc_id, CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || '…' ELSE text END AS preview
        FROM documents""",
    "history_filter": f"""
        SELECT conv_id, 'system=You help with fine-tuning.' || chr(10)
               || coalesce(string_agg(role || '=' || text, chr(10) ORDER BY turn)
                           FILTER (role IN ('user', 'assistant') AND text <> '') || chr(10), '')
               || 'user={REVIEW}' AS turns
        FROM conversations GROUP BY conv_id""",
    "plain_prompt": """
        SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) || 'assistant:' AS prompt
        FROM conversations GROUP BY conv_id""",
    "document_prompt": "SELECT doc_id, 'user: ' || text || chr(10) || 'assistant:' AS prompt FROM documents",
}
