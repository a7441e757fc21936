"""Small reference tables: claim registries, code tables, policies, prices, labelled examples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Declared shape of the registry: one JSON object that holds five arrays.
REGISTRY_SCHEMA = (
    "members array<struct<member_id:string,date_of_birth:date,gender:string,plan_type:string,coverage_start:date,coverage_end:date>>,"
    "providers array<struct<npi:string,name:string,specialty:string,network:string>>,"
    "authorizations array<struct<auth_number:string,member_id:string,cpt:string,valid_from:date,valid_to:date>>,"
    "referrals array<struct<referral_number:string,member_id:string,provider_npi:string>>,"
    "history array<struct<member_id:string,provider_npi:string,service_date:date,cpt:string,claim_id:string>>"
)


def load_registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five registry tables. History rows are numbered in file order."""
    whole = spark.read.schema(REGISTRY_SCHEMA).json(path, multiLine=True)
    tables = {}
    for name in ("members", "providers", "authorizations", "referrals"):
        tables[name] = whole.select(F.inline(name))
    tables["history"] = whole.select(F.posexplode("history").alias("seq", "h")).select("seq", "h.*")
    return tables


CODE_SCHEMA = (
    "code string, ref_cost double, mue bigint, requires_auth boolean, necessity array<string>, policy string, "
    "age_min int, age_max int, review_level boolean"
)


def code_table(spark: SparkSession, codes: Mapping[str, Mapping]) -> DataFrame:
    """Code settings as they come out of a YAML or JSON file, one row per code."""
    names = [part.split()[0] for part in CODE_SCHEMA.split(", ")][1:]
    flags = ("requires_auth", "review_level")
    rows = [
        (code, *[float(v[n]) if n == "ref_cost" else bool(v.get(n, False)) if n in flags else v.get(n) for n in names])
        for code, v in codes.items()
    ]
    return spark.createDataFrame(rows, CODE_SCHEMA)


# The default governance policy.
DEFAULT_POLICY = {
    "capture_content": True,
    "pii": "redact",
    "allowed_models": [],
    "forbidden_tools": [],
    "max_tokens_per_call": 32000,
    "max_cost_per_trace_usd": 0.5,
    "max_steps_per_trace": 60,
    "daily_budget_usd": 100.0,
    "retention_days": 30,
    "content_retention_days": 7,
}
POLICY_SCHEMA = (
    "capture_content boolean, pii string, allowed_models array<string>, forbidden_tools array<string>, "
    "max_tokens_per_call bigint, max_cost_per_trace_usd double, max_steps_per_trace bigint, daily_budget_usd double, "
    "retention_days int, content_retention_days int"
)


def policy_overrides(spark: SparkSession, overrides: Mapping[str, Mapping]) -> DataFrame:
    """Per-project settings; keys that a project does not set stay null."""
    names = [part.split()[0] for part in POLICY_SCHEMA.split(", ")]
    rows = [(project, *[settings.get(n) for n in names]) for project, settings in overrides.items()]
    return spark.createDataFrame(rows, f"project_id string, {POLICY_SCHEMA}")


def price_table(spark: SparkSession, default: tuple[float, float], models: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rates per million tokens; the row without a model is the default."""
    rows = [(None, *map(float, default)), *[(m, *map(float, r)) for m, r in models.items()]]
    return spark.createDataFrame(rows, "model string, rate_in double, rate_out double")


def read_labelled_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line under a declared schema."""
    return spark.read.schema(schema).json(path)


# Line numbers are the keys of expected_lines, as text: JSON maps have no other keys.
LABELLED_CLAIMS = (
    "scenario string, claim struct<claim_id:string,member_id:string,provider_npi:string,service_date:date,submitted_date:date,"
    "place_of_service:string,diagnosis_codes:array<string>,lines:array<struct<line_no:int,cpt:string,units:bigint,charge:double,"
    "modifiers:array<string>>>,prior_auth_number:string,referral_number:string,clinical_note:string>, "
    "expected_lines map<string,string>, expected_rules array<string>, needs_judgment boolean"
)
QUESTION_EXAMPLES = "id string, template string, difficulty string, question string, sql string, split string"


def visible_columns(df: DataFrame, denied: Sequence[str]) -> DataFrame:
    return df.drop(*denied)
