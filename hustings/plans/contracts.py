"""Declared contracts of tables: columns they must have, and rules their rows must keep."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """columns: name to type (None: any). rules: name to an SQL condition; a row keeps a rule unless the condition is false (null keeps it)."""

    name: str
    columns: dict[str, str | None]
    rules: dict[str, str] = field(default_factory=dict)

    def guard(self, df: DataFrame) -> DataFrame:
        """The table itself, or an error that names every missing column and every one of another type."""
        kinds = dict(df.dtypes)
        missing = [c for c in self.columns if c not in kinds]
        other = [f"{c} is {kinds[c]}, not {t}" for c, t in self.columns.items() if t and c in kinds and kinds[c] != t]
        if missing or other:
            raise ValueError(f"{self.name}: " + "; ".join([*(f"{c} is missing" for c in missing), *other]))
        return df

    def broken(self) -> Column:
        """The names of the rules that a row breaks, in the order of the contract."""
        return F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(True)), F.lit(name)) for name, rule in self.rules.items()), F.lit(None).cast("string")))

    def violations(self, df: DataFrame, *key: str) -> DataFrame:
        """key columns and rule, a row for each rule that a row breaks."""
        return self.guard(df).select(*key, F.explode(self.broken()).alias("rule"))

    def split(self, df: DataFrame, observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows that keep all rules, rows that do not with their rules in broken_rules).

        With an observation, the counts of rows and of broken rules come with the action that reads the good rows: no pass of their own.
        """
        df = self.guard(df).withColumn("broken_rules", self.broken())
        bad = df.where(F.size("broken_rules") > 0)
        if observation is not None:
            df = df.observe(observation, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.array_contains("broken_rules", r)).alias(r) for r in self.rules))
        return df.where(F.size("broken_rules") == 0).drop("broken_rules"), bad

    def enforce(self, df: DataFrame, quarantine: str) -> DataFrame:
        """The good rows; the others are added to the Parquet table `quarantine`, with the contract's name."""
        good, bad = self.split(df)
        bad.withColumn("contract", F.lit(self.name)).write.mode("append").parquet(quarantine)
        return good


def one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def share(column: str) -> str:
    return f"NOT isnan({column}) AND {column} BETWEEN 0 AND 1"


#: Values that the evidence contract allows.
KINDS = ("stat_fdr", "calibrated_empirical", "heuristic")
TIERS = ("high", "medium", "watch")
EXPLANATIONS = ("data_quality_artifact", "legitimate_mobilization", "potential_manipulation", "mixed", "insufficient_evidence", "none")

SIGNALS = Contract(
    "evidence signals",
    {"signal_id": "string", "evidence_kind": "string", "signal_score": "double", "support_n": "bigint", "effect_size": "double", "p_value": "double", "q_value": "double", "explanation_hint": "string"},
    {
        "signal_id_blank": "signal_id IS NOT NULL AND trim(signal_id) <> ''",
        "evidence_kind_unknown": f"evidence_kind IS NOT NULL AND {one_of('evidence_kind', KINDS)}",
        "explanation_hint_unknown": one_of("explanation_hint", EXPLANATIONS),
        "signal_score_range": f"signal_score IS NOT NULL AND {share('signal_score')}",
        "support_n_negative": "support_n IS NOT NULL AND support_n >= 0",
        "p_value_range": share("p_value"),
        "q_value_range": share("q_value"),
        "effect_size_finite": "NOT isnan(effect_size) AND abs(effect_size) < double('infinity')",
    },
)
_ITEM = {
    "score_range": f"score IS NOT NULL AND {share('score')}",
    "support_n_negative": "support_n IS NOT NULL AND support_n >= 0",
    "evidence_tier_unknown": f"evidence_tier IS NOT NULL AND {one_of('evidence_tier', TIERS)}",
    "primary_explanation_unknown": f"primary_explanation IS NOT NULL AND {one_of('primary_explanation', EXPLANATIONS)}",
    "secondary_explanation_unknown": one_of("secondary_explanation", EXPLANATIONS),
    "contributors_missing": "source_detectors IS NOT NULL AND source_detectors <> ''",
}
_JUDGED = {"score": "double", "support_n": "bigint", "evidence_tier": "string", "primary_explanation": "string", "secondary_explanation": "string", "source_detectors": "string"}
WINDOWS = Contract("window evidence", {"window_id": "string"} | _JUDGED, {"window_id_blank": "window_id IS NOT NULL AND trim(window_id) <> ''"} | _ITEM)
RECORDS = Contract("record evidence", {"record_id": "string"} | _JUDGED, {"record_id_blank": "record_id IS NOT NULL AND trim(record_id) <> ''"} | _ITEM)
CLUSTERS = Contract("cluster evidence", {"cluster_id": "string"} | _JUDGED, {"cluster_id_blank": "cluster_id IS NOT NULL AND trim(cluster_id) <> ''"} | _ITEM)
#: Stored tables.
SUBMISSIONS = Contract(
    "submissions",
    {"submission_key": "string", "source_file": "string", "source_row_number": "bigint", "source_hash": "string", "name_raw": "string", "position_normalized": "string", "organization_is_blank": "boolean", "signed_at": "timestamp_ntz", "minute_bucket": "timestamp_ntz"},
    {
        "submission_key_blank": "submission_key IS NOT NULL AND submission_key <> ''",
        "source_row_number_positive": "source_row_number IS NOT NULL AND source_row_number > 0",
        "source_hash_form": "source_hash IS NOT NULL AND source_hash RLIKE '^[0-9a-f]{40}$'",
        "position_unknown": one_of("position_normalized", ("Pro", "Con", "Unknown")),
        "minute_of_signed_at": "minute_bucket <=> CAST(date_trunc('MINUTE', signed_at) AS TIMESTAMP_NTZ)",
    },
)
IMPORTS = Contract("imports", {"import_id": "string", "status": "string", "rows": "bigint"}, {"status_unknown": f"status IS NOT NULL AND {one_of('status', ('completed', 'failed', 'skipped'))}", "rows_negative": "rows IS NOT NULL AND rows >= 0"})
#: What operators need of the record frame.
CANONICAL = Contract("canonical records", {"id": None, "name_display": "string", "last": "string", "first_canonical": "string", "canonical_name": "string", "position_normalized": "string", "organization": "string", "timestamp": "timestamp_ntz", "minute_bucket": "timestamp_ntz"})
