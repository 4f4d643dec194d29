"""Record schemas and row checks. Unknown fields of a file are ignored, missing ones take defaults, required ones are asserted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1

#: DDL of each record table.
SCHEMAS: dict[str, str] = {
    "question": "qid string, question string, final_answer string, domain string, meta map<string,string>",
    "rollout": "qid string, sample_idx int, prompt_text string, prompt_token_ids array<int>, response_text string, response_token_ids array<int>, finish_reason string, gen struct<temperature:double,top_p:double,max_tokens:int,seed:bigint>, model_path string, iter int",
    "verdict": "qid string, sample_idx int, correct boolean, extracted_answer string, verifier string, meta map<string,string>",
    "solved": "qid string, sample_idx int, question string, final_answer string, prompt_token_ids array<int>, response_token_ids array<int>, response_text string, source string, iter int",
    "unsolved": "qid string, question string, final_answer string, failed_sample_idxs array<int>, iter int",
    "anchor": "qid string, base_sample_idx int, policy string, anchor_token_ids array<int>, anchor_text string, anchor_len int, base_response_len int, meta map<string,string>, iter int",
    "candidate": "qid string, base_sample_idx int, attempt_idx int, prompt_token_ids array<int>, anchor_token_ids array<int>, continuation_token_ids array<int>, continuation_text string, correct boolean, operator string, op_meta map<string,string>, external_context string, iter int",
    "sft_example": "uid string, qid string, source string, input_ids array<int>, prompt_len int, anchor_len int, completion_len int, text string, iter_created int",
    "dpo_example": "uid string, qid string, prompt_token_ids array<int>, chosen_token_ids array<int>, rejected_token_ids array<int>, prompt_text string, chosen_text string, rejected_text string, iter_created int",
    "graded_sample": "qid string, sample_idx int, correct boolean, formatted boolean, extracted string, finish_reason string, n_tokens int, response_text string, raw_correct boolean",
}
DEFAULTS = {"question": {"domain": "math"}, "solved": {"source": "rollout"}}
REQUIRED = {"question": ("qid", "question", "final_answer"), "rollout": ("qid", "sample_idx"), "verdict": ("qid", "sample_idx", "correct"), "candidate": ("qid", "attempt_idx")}


def conform(df: DataFrame, record: str) -> DataFrame:
    """Fills defaults and raises, when rows are read, where a required field is null."""
    for name, value in DEFAULTS.get(record, {}).items():
        df = df.withColumn(name, F.coalesce(name, F.lit(value)))
    for name in REQUIRED.get(record, ()):
        df = df.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{record}.{name} is missing"))).otherwise(F.col(name)))
    return df


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("schema_version", F.lit(SCHEMA_VERSION))


def region_violation(input_ids: Column | str = "input_ids", source: Column | str = "source") -> Column:
    """Region lengths must sum to the number of ids; a rollout row has no anchor."""
    total = F.col("prompt_len") + F.col("anchor_len") + F.col("completion_len")
    ids = F.col(input_ids) if isinstance(input_ids, str) else input_ids
    src = F.col(source) if isinstance(source, str) else source
    return (total != F.size(ids)) | ((src == "rollout") & (F.col("anchor_len") != 0))
