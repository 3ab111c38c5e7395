"""Raw table to prepared dataset: normalize, validate, split, write."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrain.functions.text import named_id
from tunegrain.operators import normalize as norm
from tunegrain.operators import split as splitting
from tunegrain.operators import validate
from tunegrain.schema import DatasetInfo, FieldMapping
from tunegrain.session import fit_shuffles, materialize
from tunegrain.sources import prepared


@dataclass(frozen=True)
class Analysis:
    """Stored per-row table (text and facts) and what follows from its facts."""

    rows: DataFrame
    report: DataFrame
    issues: DataFrame
    split: DataFrame


def analyze(
    raw: DataFrame,
    mapping: FieldMapping,
    *,
    row_id: str = "row_id",
    eval_ratio: float = splitting.DEFAULT_EVAL_RATIO,
    seed: int = splitting.DEFAULT_SEED,
    max_seq_length: int = validate.DEFAULT_MAX_SEQ_LENGTH,
    shuffle: bool = True,
    tokenizer: Callable[[Column], Column] | None = None,
) -> Analysis:
    """Normalize and measure once into a stored table; everything after reads its columns.

    The text is written once. Report and split read only ids and facts, and the cut between
    train and eval is stored, so every later read sees the same split.
    """
    normalized = norm.normalize(fit_shuffles(raw), mapping, row_id)
    rows = materialize(validate.measure(normalized, max_seq_length, tokenizer), "measured")
    summary = materialize(validate.summarize(rows), "summary")
    kept = splitting.usable(rows)
    cut = materialize(splitting.find_cut(kept, eval_ratio, seed, shuffle), "cut")
    return Analysis(
        rows,
        validate.verdict(summary, max_seq_length),
        validate.issues(rows, max_seq_length, summary),
        splitting.mark(kept, cut.scalar(), seed, shuffle),
    )


def make_dataset_id(raw: DataFrame, name: str) -> str:
    named = raw.sparkSession.range(1).select(named_id(F.lit(name), F.lit(uuid.uuid4().hex[:8])).alias("id"))
    return named.first().id


def _stats(report: dict) -> dict:
    """The statistics block; absent when there was nothing to measure."""
    if not report["n_examples"]:
        return {}
    return {
        "token_len": {key: report[f"token_{key}"] for key in ("min", "median", "mean", "p95", "max")},
        "duplicate_count": report["duplicate_count"],
        "empty_output_count": report["empty_output_count"],
    }


def prepare(
    raw: DataFrame,
    mapping: FieldMapping,
    root: str,
    *,
    name: str,
    row_id: str = "row_id",
    eval_ratio: float | None = None,
    seed: int | None = None,
    max_seq_length: int | None = None,
    shuffle: bool = True,
    dataset_id: str | None = None,
    source_files: list[str] | None = None,
    tokenizer: Callable[[Column], Column] | None = None,
) -> prepared.PreparedDataset:
    """Write a train-ready dataset below ``root``; unset options take their defaults."""
    spark = raw.sparkSession
    dataset_id = dataset_id or make_dataset_id(raw, name)
    done = analyze(
        raw,
        mapping,
        row_id=row_id,
        eval_ratio=splitting.DEFAULT_EVAL_RATIO if eval_ratio is None else eval_ratio,
        seed=splitting.DEFAULT_SEED if seed is None else seed,
        max_seq_length=max_seq_length or validate.DEFAULT_MAX_SEQ_LENGTH,
        shuffle=shuffle,
        tokenizer=tokenizer,
    )
    directory = f"{root}/{dataset_id}"
    prepared.write_splits(done.split, directory)
    counts = splitting.split_counts(done.split, F.bool_or("has_system").alias("has_system")).first()
    report = done.report.first().asDict()
    findings = [
        {"level": r.level, "code": r.code, "message": r.message, "count": r.n_rows, "rows": r.rows or []}
        for r in done.issues.orderBy("rank").collect()
    ]
    info = DatasetInfo(
        dataset_id=dataset_id,
        name=name,
        task_format=mapping.task_format,
        n_examples=counts.n_examples,
        n_train=counts.n_train,
        n_eval=counts.n_eval,
        has_system=bool(counts.has_system),
        source_columns=[c for c in raw.columns if c != row_id],
        mapping=mapping.to_dict(),
        source_files=source_files or [],
        stats=_stats(report),
    )
    validation = {key: report[key] for key in ("n_examples", "n_valid", "ok", "has_errors")}
    validation |= {"issues": findings, "stats": info.stats}
    prepared.write_json_file(spark, f"{directory}/{prepared.VALIDATION_FILE}", validation)
    preview = prepared.preview_text(spark, prepared.split_folder(directory, prepared.TRAIN))
    prepared.files.write_small_text(spark, f"{directory}/{prepared.PREVIEW_FILE}", preview)
    # Written last: a dataset is listed only once it is complete.
    prepared.write_json_file(spark, f"{directory}/{prepared.INFO_FILE}", info.to_dict())
    return prepared.PreparedDataset(directory, info, validation)
