"""Readers, writers and ingest pipelines with an account of what was dropped and why."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import predicates as P
from quern.functions import text as T
from quern.operators.ranking import first_wins, hash_sample
from quern.registry import Registry
from quern.schemas import SCHEMAS, conform, stamped

ADAPTERS: Registry = Registry("adapter")

#: Ingest settings of known public question sets. Fixed values.
PRESETS = {
    "openr1": {"where": {"question_type": ["math-word-problem"]}, "require_any_true": ["correctness_math_verify"]},
    "openthoughts": {"require_boxed_gold": True, "require_any_true": ["correct"], "exclude_question_regex": r"(?i)^\s*(prove|show)\b|\b(prove that|show that)\b"},
    "deepmath": {"solution_col": "r1_solution_1", "solution_alt_cols": ["r1_solution_2", "r1_solution_3"], "solution_strip_think": True, "meta_cols": ["difficulty", "topic"], "exclude_answer_regex": r"^(?:\\text\{)?(?:(?i:yes|no|true|false)|[A-E])\}?$"},
}


#: Where known public benchmarks are and what is taken of them. Fixed values.
BENCHMARKS = {
    "aime24": {"hf_name": "HuggingFaceH4/aime_2024", "split": "train"},
    "aime25": {"hf_name": "yentinglin/aime_2025", "split": "train"},
    "aime26": {"hf_name": "MathArena/aime_2026", "split": "train"},
    "hmmt25": {"hf_name": "MathArena/hmmt_feb_2025", "split": "train"},
    "math500": {"hf_name": "HuggingFaceH4/MATH-500", "split": "test"},
    "math500_hard": {"hf_name": "HuggingFaceH4/MATH-500", "split": "test", "min_level": 5},
}


def resolve_benchmark(cfg: dict) -> tuple[str, dict]:
    """(adapter, arguments) of a benchmark: its own adapter, else the preset of its name; own arguments go on top."""
    name, own = cfg["name"], dict(cfg.get("adapter_args") or {})
    if cfg.get("adapter"):
        return cfg["adapter"], {"name": name, **own}
    if name not in BENCHMARKS:
        raise KeyError(f"benchmark {name!r} is no preset ({sorted(BENCHMARKS)}) and names no adapter")
    return "benchmark", {"name": name, **BENCHMARKS[name], **own}


def benchmark_questions(raw: DataFrame, cfg: dict, ordinal: str = "row_idx") -> DataFrame:
    """A benchmark's questions by whichever adapter; no id can be taken for one of the training questions."""
    adapter, args = resolve_benchmark(cfg)
    found = ADAPTERS[adapter](raw, args, ordinal)
    space = f"bench-{cfg['name']}-"
    return found.withColumn("qid", F.when(F.col("qid").startswith("bench-"), F.col("qid")).otherwise(F.concat(F.lit(space), F.col("qid").cast("string"))))


def read_jsonl(spark: SparkSession, path: str, record: str | None = None) -> DataFrame:
    """JSON lines; with a record name, by its schema: unknown fields are ignored, blank lines skipped, bad lines an error."""
    if record is None:
        return spark.read.json(path)
    return conform(spark.read.schema(SCHEMAS[record]).option("mode", "FAILFAST").json(path), record)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Writes with Spark's commit protocol and returns the number of rows, counted on the way."""
    from pyspark.sql import Observation

    seen = Observation()
    stamped(df).observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def expand_preset(args: dict) -> dict:
    """The preset's settings with explicit ones on top."""
    if args.get("preset") is None:
        return dict(args)
    if args["preset"] not in PRESETS:
        raise KeyError(f"unknown preset {args['preset']!r}; known: {sorted(PRESETS)}")
    return {**PRESETS[args["preset"]], **{k: v for k, v in args.items() if k != "preset"}}


def source_key(adapter: str, args: dict) -> str:
    """A cache key over the expanded settings."""
    return hashlib.sha256(json.dumps([adapter, expand_preset(args)], sort_keys=True).encode()).hexdigest()[:16]


class Ingested:
    """The questions that were kept, and how many rows each reason dropped."""

    def __init__(self, marked: DataFrame, questions: DataFrame):
        self.marked, self.questions = marked, questions

    def drops(self) -> DataFrame:
        return self.marked.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@ADAPTERS.register("general")
def general(raw: DataFrame, args: dict, parsable: Column | None = None, ordinal: str = "row_idx") -> Ingested:
    """Rows of a question set as questions. ``raw`` has an ordinal given before any filter.

    Settings: where, require_any_true, exclude_question_regex, require_boxed_gold, exclude_answer_regex,
    solution_col, solution_alt_cols, solution_strip_think, meta_cols, n, seed, limit, prefix.
    """
    args = expand_preset(args)
    question_col = args.get("question_col") or P.first_present(raw, ["problem", "question", "prompt"])
    gold_col = args.get("gold_col") or P.first_present(raw, ["answer", "final_answer", "solution"])
    solution_col = args.get("solution_col") or P.first_present(raw, ["solution"])
    alternates, meta = args.get("solution_alt_cols", []), args.get("meta_cols", [])
    P.require_columns(raw, ordinal, *args.get("where", {}), *args.get("require_any_true", []), *alternates, *meta, *[c or "question and gold" for c in (question_col, gold_col)])
    question, gold = T.strip(question_col), T.strip(gold_col)
    rules = [(f"where:{c}", ~P.listed(raw, c, v)) for c, v in args.get("where", {}).items()]
    rules += [(f"any_true:{c}", ~P.any_true(raw, c)) for c in args.get("require_any_true", [])]
    rules.append(("empty", P.blank(question_col) | P.blank(gold_col)))
    if args.get("exclude_question_regex"):
        rules.append(("question_regex", P.matches(question, args["exclude_question_regex"])))
    if args.get("require_boxed_gold"):
        rules.append(("unboxed", P.unboxed(gold)))
    if args.get("exclude_answer_regex"):
        rules.append(("answer_regex", P.matches(T.final_answer(gold), args["exclude_answer_regex"])))
    if parsable is not None:
        rules.append(("unparsable", ~parsable))
    marked = raw.withColumn("drop_reason", P.drop_reason(*rules))
    solution = (lambda c: T.clean_solution(c, bool(args.get("solution_strip_think")))["text"]) if solution_col else None
    columns = [
        T.question_id(args.get("prefix", "q-"), question).alias("qid"), question.alias("question"), T.final_answer(gold).alias("final_answer"), F.col(ordinal).alias("row_idx"),
        (F.nullif(solution(solution_col), F.lit("")) if solution else F.lit(None).cast("string")).alias("gold_solution"),
        F.filter(F.array(*[solution(c) for c in alternates]), lambda s: s != "").alias("gold_solutions_alt") if alternates else F.array().cast("array<string>").alias("gold_solutions_alt"),
        *meta,
    ]
    kept = marked.where("drop_reason is null").select(*columns)
    if args.get("limit"):
        kept = kept.orderBy("row_idx").limit(args["limit"])
    kept = first_wins(kept, ["qid"], ["row_idx"])
    if args.get("n"):
        kept = hash_sample(kept, args["n"], args.get("seed", 0), T.quoted("qid"), "qid")
    return Ingested(marked, kept)


@ADAPTERS.register("local_jsonl")
def local(raw: DataFrame, args: dict, ordinal: str = "row_idx") -> DataFrame:
    """Canonical questions; a missing or empty qid comes from the text."""
    own = F.coalesce(F.nullif("qid", F.lit("")), T.question_id("local-", "question")) if "qid" in raw.columns else T.question_id("local-", "question")
    out = raw.withColumn("qid", own)
    return first_wins(out.orderBy(ordinal).limit(args["limit"]) if args.get("limit") else out, ["qid"], [ordinal])


@ADAPTERS.register("openthoughts")
def openthoughts(raw: DataFrame, args: dict, ordinal: str = "row_idx") -> DataFrame:
    """Questions of one domain whose gold is the last box of the solution."""
    domain = P.first_present(raw, ["domain"])
    gold = T.final_answer(T.strip(P.first_present(raw, ["solution", "answer"])))
    question = T.strip(P.first_present(raw, ["problem", "question"]))
    out = raw.where(P.in_domain(domain, args.get("domain", "math"))).select(T.question_id("ot-", question).alias("qid"), question.alias("question"), gold.alias("final_answer"), F.col(ordinal).alias("row_idx"))
    return first_wins(out.where((F.col("question") != "") & (F.col("final_answer") != "")), ["qid"], ["row_idx"])


@ADAPTERS.register("benchmark")
def benchmark(raw: DataFrame, args: dict, ordinal: str = "row_idx") -> DataFrame:
    """A benchmark's rows, none dropped for its gold; ids by name and position."""
    if args.get("min_level"):
        raw = raw.where(P.at_least_level("level", args["min_level"]))
    question = P.first_present(raw, ["problem", "question"])
    gold = P.first_present(raw, ["answer", "final_answer", "solution"])
    return raw.select(F.format_string(f"bench-{args['name']}-%04d", F.col(ordinal).cast("int")).alias("qid"), T.strip(question).alias("question"), T.final_answer(T.strip(F.col(gold).cast("string"))).alias("final_answer"))


def gold_solutions(questions: DataFrame) -> DataFrame:
    """(qid, gold_solution) without blank ones."""
    return questions.select("qid", T.strip("gold_solution").alias("gold_solution")).where("gold_solution <> ''")


def cliff_set(stats: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions never solved, with where they come from."""
    return stats.where("c = 0").join(questions, "qid").withColumn("source", F.lit("cliff"))
