"""Quality checks over normalized rows: per-row flags, duplicates, issues, statistics.

Row ids may be any unique, orderable column; "first" and "lowest" follow its order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunegrain.functions import chat
from tunegrain.functions.text import estimate_tokens, py_round, strip_computed
from tunegrain.operators.toplist import first_per_key
from tunegrain.session import materialize

# Thresholds of the checks.
MIN_EXAMPLES_ERROR = 10
MIN_EXAMPLES_WARN = 50
SHORT_OUTPUT_CHARS = 2
TINY_OUTPUT_CHARS = 10
SAMPLE_ROWS = 5
DEFAULT_MAX_SEQ_LENGTH = 2048

ERROR, WARNING = "error", "warning"
ICONS = {"error": "❌", "warning": "⚠️", "info": "ℹ️"}


def measure(
    normalized: DataFrame,
    max_seq_length: int = DEFAULT_MAX_SEQ_LENGTH,
    tokenizer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add per-row facts: token count, output length, flags and a duplicate key.

    Dropped rows stay in, with null facts, so that one pass over the result can count
    everything. A 32-byte digest stands for the text: passes that need only facts leave the
    text columns unread.
    """
    usable = F.col("drop_reason").isNull()
    full = chat.example_text(F.col("messages"), F.col("text"))
    # Completion text is stripped already; joined turns may have blank ends.
    joined = strip_computed(chat.example_text(F.col("messages"), F.lit("")))
    compared = F.when(F.col("messages").isNotNull(), joined).otherwise(F.col("text"))
    facts = normalized.withColumns(
        {
            "tokens": F.when(usable, estimate_tokens(full, tokenizer)),
            "output_len": F.when(usable, chat.output_length(F.col("messages"), F.col("text"))),
            "dup_key": F.when(usable, F.unhex(F.sha2(compared, 256))),
            "has_system": F.coalesce(chat.speaks_as_system(F.col("messages")), F.lit(False)),
        }
    )
    length = F.col("output_len")
    return facts.withColumns(
        {
            "empty_output": length <= SHORT_OUTPUT_CHARS,
            "tiny_output": (length > SHORT_OUTPUT_CHARS) & (length < TINY_OUTPUT_CHARS),
            "exceeds_seq_len": F.col("tokens") > max_seq_length,
        }
    )


def first_occurrences(measured: DataFrame) -> DataFrame:
    """``row_id`` (lowest) and ``n_copies`` per distinct text.

    The minimum is taken on the map side first, so a text that a third of all rows share
    reaches the reducer as one row per task.
    """
    return (
        measured.where(F.col("drop_reason").isNull())
        .groupBy("dup_key")
        .agg(F.min("row_id").alias("row_id"), F.count("*").alias("n_copies"))
        .drop("dup_key")
    )


def duplicate_rows(measured: DataFrame) -> DataFrame:
    """Ids of rows whose text occurred at a lower row id.

    These are all usable ids except the first occurrences. The anti join runs on the unique
    row id, so no group of copies ever meets in one task.
    """
    ids = measured.where(F.col("drop_reason").isNull()).select("row_id")
    return ids.join(first_occurrences(measured).select("row_id"), "row_id", "left_anti")


def keep_first(measured: DataFrame) -> DataFrame:
    """Usable rows without later copies of the same text.

    The ids of the copies, which are few, are stored first; their size is known then, so the planner
    sends them to the text if they are small and moves the text only if they are not.
    """
    copies = materialize(duplicate_rows(measured), "copies")
    return measured.where(F.col("drop_reason").isNull()).join(copies, "row_id", "left_anti")


def _p95_index(n: Column) -> Column:
    return F.least(n - 1, F.floor(F.lit(0.95) * n.cast("double")))


def summarize(measured: DataFrame) -> DataFrame:
    """One row of counts and token statistics.

    Rows are reduced to a histogram over token counts before the running sum, so the only
    window without a partition is as long as the number of distinct token counts.
    """
    histogram = measured.groupBy("tokens").agg(
        F.count("*").alias("c"),
        F.count_if("empty_output").alias("empty"),
        F.count_if("tiny_output").alias("tiny"),
        F.count_if("exceeds_seq_len").alias("long"),
    )
    usable = F.col("tokens").isNotNull()
    size = F.when(usable, F.col("c")).otherwise(0)
    upto = Window.orderBy(F.col("tokens").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = histogram.withColumns({"cum": F.sum(size).over(upto), "n": F.sum(size).over(everything)})

    def at(index: Column) -> Column:
        return F.min(F.when(usable & (F.col("cum") > index), F.col("tokens")))

    n = F.col("n")
    folded = ranked.agg(
        F.coalesce(F.max(n), F.lit(0)).alias("n_examples"),
        F.coalesce(F.sum(F.when(~usable, F.col("c"))), F.lit(0)).alias("n_dropped"),
        F.coalesce(F.sum("empty"), F.lit(0)).alias("empty_output_count"),
        F.coalesce(F.sum("tiny"), F.lit(0)).alias("tiny_output_count"),
        F.coalesce(F.sum("long"), F.lit(0)).alias("exceeds_seq_len_count"),
        F.min("tokens").alias("token_min"),
        at(F.floor((n - 1) / 2)).alias("mid_low"),
        at(F.floor(n / 2)).alias("mid_high"),
        F.sum(F.col("tokens").cast("bigint") * F.col("c")).alias("token_sum"),
        at(_p95_index(n)).alias("token_p95"),
        F.max("tokens").alias("token_max"),
    )
    copies = first_occurrences(measured).agg(
        F.coalesce(F.sum(F.col("n_copies") - 1), F.lit(0)).alias("duplicate_count")
    )
    return folded.select(
        "n_examples",
        "n_dropped",
        (F.col("n_examples") - F.col("empty_output_count")).alias("n_valid"),
        "empty_output_count",
        "tiny_output_count",
        "exceeds_seq_len_count",
        copies.scalar().alias("duplicate_count"),
        "token_min",
        F.floor((F.col("mid_low") + F.col("mid_high")) / 2).cast("bigint").alias("token_median"),
        py_round(F.col("token_sum").cast("double") / F.col("n_examples"), 1).alias("token_mean"),
        "token_p95",
        "token_max",
    )


def issues_from(summary: DataFrame, max_seq_length: int = DEFAULT_MAX_SEQ_LENGTH) -> DataFrame:
    """Findings, without sample rows: ``rank, level, code, message, n_rows`` in report order."""
    n = F.col("n_examples")

    def finding(when: Column, level: str, code: str, message: Column | str, count: Column | int = 0) -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        count = F.lit(count) if isinstance(count, int) else count
        entry = F.struct(
            F.lit(level).alias("level"),
            F.lit(code).alias("code"),
            text.alias("message"),
            count.cast("bigint").alias("n_rows"),
        )
        return F.when(when, entry)

    def counted(level: str, code: str, message: str, column: str) -> Column:
        return finding((n > 0) & (F.col(column) > 0), level, code, message, F.col(column))

    # Levels, codes and wording of the findings.
    unparsed = F.format_string("%d raw row(s) were skipped during structuring (empty/invalid).", F.col("n_dropped"))
    few = F.format_string(f"Only %d examples — need at least {MIN_EXAMPLES_ERROR} to train.", n)
    small = F.format_string(
        f"%d examples is small; expect limited gains. {MIN_EXAMPLES_WARN}+ is better.", n
    )
    too_long = f"Examples longer than max_seq_length ({max_seq_length}) will be truncated."
    findings = [
        finding(F.col("n_dropped") > 0, WARNING, "unparsed_rows", unparsed, F.col("n_dropped")),
        finding(n == 0, ERROR, "no_examples", "No usable examples after structuring."),
        finding((n > 0) & (n < MIN_EXAMPLES_ERROR), ERROR, "too_few", few),
        finding((n >= MIN_EXAMPLES_ERROR) & (n < MIN_EXAMPLES_WARN), WARNING, "small_dataset", small),
        counted(ERROR, "empty_output", "Examples with an empty/near-empty response.", "empty_output_count"),
        counted(
            WARNING,
            "tiny_output",
            f"Very short responses (<{TINY_OUTPUT_CHARS} chars) — verify these are intentional.",
            "tiny_output_count",
        ),
        counted(WARNING, "exceeds_seq_len", too_long, "exceeds_seq_len_count"),
        counted(WARNING, "duplicates", "Duplicate examples found; consider de-duplicating.", "duplicate_count"),
    ]
    return summary.select(F.posexplode(F.array(*findings)).alias("rank", "finding")).where(
        F.col("finding").isNotNull()
    ).select("rank", "finding.*")


def sample_rows(measured: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """``code, rows``: the lowest ``n`` row ids behind each per-row finding."""
    flags = {
        "unparsed_rows": F.col("drop_reason").isNotNull(),
        "empty_output": F.col("empty_output"),
        "tiny_output": F.col("tiny_output"),
        "exceeds_seq_len": F.col("exceeds_seq_len"),
    }
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in flags.items()]))
    flagged = measured.select("row_id", F.explode(codes).alias("code"))
    repeats = duplicate_rows(measured).select("row_id", F.lit("duplicates").alias("code"))
    lowest = first_per_key(
        flagged.unionByName(repeats), ["code"], [F.col("row_id").asc()], n
    )
    # At most n ids per code reach this point.
    return lowest.groupBy("code").agg(F.array_sort(F.collect_list("row_id")).alias("rows"))


def issues(
    measured: DataFrame, max_seq_length: int = DEFAULT_MAX_SEQ_LENGTH, summary: DataFrame | None = None
) -> DataFrame:
    """Findings with up to five sample row ids each; ``rank`` gives the report order."""
    summary = summarize(measured) if summary is None else summary
    return issues_from(summary, max_seq_length).join(sample_rows(measured), "code", "left").select(
        "rank", "level", "code", "message", "n_rows", "rows"
    )


def verdict(summary: DataFrame, max_seq_length: int = DEFAULT_MAX_SEQ_LENGTH) -> DataFrame:
    """``summary`` plus ``has_errors``, ``n_warnings`` and ``ok``."""
    found = issues_from(summary, max_seq_length).agg(
        F.coalesce(F.bool_or(F.col("level") == ERROR), F.lit(False)).alias("has_errors"),
        F.count_if(F.col("level") == WARNING).alias("n_warnings"),
    )
    both = summary.withColumn("found", found.select(F.struct("has_errors", "n_warnings")).scalar())
    return both.select(
        *summary.columns,
        "found.has_errors",
        "found.n_warnings",
        (~F.col("found.has_errors") & (F.col("n_valid") > 0)).alias("ok"),
    )


def report_markdown(verdict_row: DataFrame, issue_rows: DataFrame) -> DataFrame:
    """The report as one Markdown string (the issue list has at most eight rows)."""
    icon = F.create_map(*[F.lit(part) for pair in ICONS.items() for part in pair])
    times = F.when(F.col("n_rows") > 0, F.concat(F.lit(" ×"), F.col("n_rows"))).otherwise("")
    where = F.when(
        F.size("rows") > 0,
        F.concat(F.lit(" _(e.g. rows ["), F.array_join(F.transform("rows", lambda r: r.cast("string")), ", "), F.lit("])_")),
    ).otherwise("")
    line = F.concat(
        F.lit("- "), F.try_element_at(icon, F.col("level")), F.lit(" **"), F.col("code"), F.lit("**"),
        times, F.lit(": "), F.col("message"), where,
    )
    listed = issue_rows.agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("found"))
    lines = listed.select(F.transform("found", lambda f: f["line"])).scalar()
    head = F.format_string("**Examples:** %d · **Usable:** %d", F.col("n_examples"), F.col("n_valid"))
    tokens = F.when(
        F.col("token_max").isNotNull(),
        F.format_string(
            "**Est. tokens/example:** median %d, max %d, p95 %d",
            F.col("token_median"), F.col("token_max"), F.col("token_p95"),
        ),
    )
    body = F.when(F.size("found") == 0, F.lit("\n✅ No issues found.")).otherwise(
        F.concat(F.lit("\n**Findings:**\n"), F.array_join("found", "\n"))
    )
    return verdict_row.withColumn("found", lines).select(F.concat_ws("\n", head, tokens, body).alias("markdown"))
