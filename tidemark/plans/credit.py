"""A worked plan: credit risk features of an application from five reports, eight features on top of them.

The functions are columns over typed payloads, so the whole plan is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from . import registry

#: Payload schemas of the sources.
SCHEMAS = {
    "application_request": "requested_amount int, term_months int",
    "tax_report": "periods array<struct<period: string, taxable_income: int>>",
    "credit_bureau_report": "report_ts string, bureau_score int, active_loans int, total_outstanding_amount int, total_monthly_payment int, max_dpd_12m int, inquiries_30d int, last_delinquency_date string",
    "telco_report": "sim_age_days int, active_days_30d int, avg_monthly_topup double, telco_score int",
    "socdem_report": "age int, region_code string, residence_tenure_months int",
}
#: Features that are fields of a payload: name to (source, field, dtype).
FIELDS = {
    "requested_amount": ("application_request", "requested_amount", "int"), "term_months": ("application_request", "term_months", "int"),
    "bureau_score": ("credit_bureau_report", "bureau_score", "int"), "active_loans_count": ("credit_bureau_report", "active_loans", "int"),
    "total_outstanding_amount": ("credit_bureau_report", "total_outstanding_amount", "int"), "total_monthly_debt_payment": ("credit_bureau_report", "total_monthly_payment", "int"),
    "max_dpd_12m": ("credit_bureau_report", "max_dpd_12m", "int"), "inquiries_30d": ("credit_bureau_report", "inquiries_30d", "int"),
    "sim_age_days": ("telco_report", "sim_age_days", "int"), "active_days_30d": ("telco_report", "active_days_30d", "int"), "avg_monthly_topup": ("telco_report", "avg_monthly_topup", "float"), "telco_score": ("telco_report", "telco_score", "int"),
    "age": ("socdem_report", "age", "int"), "region_code": ("socdem_report", "region_code", "string"), "residence_tenure_months": ("socdem_report", "residence_tenure_months", "int"),
}


def _six(x: Column) -> Column:
    return scoring.round_exact(x.cast("double"))


def _months(n: int):
    return lambda s, d: scoring.trailing(s["tax_report"]["periods"], n)


def _over_income(s, d, paid: Column) -> Column:
    return _six(scoring.capped_ratio(paid, d["income_avg_12m"]))


#: Features computed from one source's payload: name to (source, dtype, function).
SHAPED = {
    "income_avg_3m": ("tax_report", "float", lambda s, d: _six(scoring.fixed_mean(_months(3)(s, d), 3))),
    "income_avg_6m": ("tax_report", "float", lambda s, d: _six(scoring.fixed_mean(_months(6)(s, d), 6))),
    "income_avg_12m": ("tax_report", "float", lambda s, d: _six(scoring.fixed_mean(_months(12)(s, d), 12))),
    "income_std_12m": ("tax_report", "float", lambda s, d: _six(scoring.spread(_months(12)(s, d)))),
    "income_trend_6m": ("tax_report", "float", lambda s, d: _six(scoring.trend(_months(6)(s, d)))),
    "months_with_income_12m": ("tax_report", "int", lambda s, d: scoring.count_positive(_months(12)(s, d))),
    "days_since_last_delinquency": ("credit_bureau_report", "int", lambda s, d: scoring.days_since(s["credit_bureau_report"]["report_date"], s["credit_bureau_report"]["last_delinquency_date"])),
}
#: Features of features: name to (dtype, dependencies, function).
DERIVED = {
    "requested_monthly_payment": ("float", ["requested_amount", "term_months"], lambda s, d: _six(d["requested_amount"] / d["term_months"])),
    "existing_payment_to_income": ("float", ["total_monthly_debt_payment", "income_avg_12m"], lambda s, d: _over_income(s, d, d["total_monthly_debt_payment"])),
    "total_payment_to_income": ("float", ["requested_monthly_payment", "total_monthly_debt_payment", "income_avg_12m"], lambda s, d: _over_income(s, d, d["requested_monthly_payment"] + d["total_monthly_debt_payment"])),
    "income_stability_index": ("float", ["income_avg_12m", "income_std_12m", "months_with_income_12m"], lambda s, d: _six(scoring.stability(d["income_avg_12m"], d["income_std_12m"], d["months_with_income_12m"]))),
    "recent_delinquency_flag": ("int", ["days_since_last_delinquency", "max_dpd_12m"], lambda s, d: scoring.recent_delinquency(d["days_since_last_delinquency"], d["max_dpd_12m"])),
    "thin_file_flag": ("int", ["active_loans_count", "sim_age_days"], lambda s, d: scoring.thin_file(d["active_loans_count"], d["sim_age_days"])),
    "affordability_index": ("float", ["income_stability_index", "total_payment_to_income"], lambda s, d: _six(d["income_stability_index"] * (1.0 - F.least(d["total_payment_to_income"], F.lit(1.0))))),
    "combined_risk_index": ("float", ["affordability_index", "recent_delinquency_flag", "thin_file_flag", "bureau_score"], lambda s, d: _six(
        (1.0 - d["affordability_index"]) * 0.50 + d["recent_delinquency_flag"] * 0.25 + d["thin_file_flag"] * 0.10 + scoring.clamp(1.0 - (d["bureau_score"] - 300) / 550.0) * 0.15)),
}
FUNCTIONS = (
    {f"credit.{n}": (lambda s, d, src=src, f=f: s[src][f]) for n, (src, f, _) in FIELDS.items()}
    | {f"credit.{n}": f for n, (_, _, f) in SHAPED.items()}
    | {f"credit.{n}": f for n, (_, _, f) in DERIVED.items()}
)


def definition() -> dict:
    """The plan as a registry mapping."""
    one = lambda n, dtype, **more: {"kind": "udf", "feature_version": 1, "udf": f"credit.{n}", "dtype": dtype, "status": "live", **more}
    features = {n: one(n, t, inputs=[s]) for n, (s, _, t) in FIELDS.items()} | {n: one(n, t, inputs=[s]) for n, (s, t, _) in SHAPED.items()} | {n: one(n, t, deps=deps) for n, (t, deps, _) in DERIVED.items()}
    groups = {f"{s}_group": [n for n, (src, *_) in (FIELDS | SHAPED).items() if src == s] for s in SCHEMAS} | {"affordability": list(DERIVED)}
    return {
        "registry_version": "credit-1",
        "entities": {"application": {"key_fields": ["user_id", "application_id"]}},
        "sources": {s: {"type": "raw_report", "report_type": s, "ts_field": "report_ts"} for s in SCHEMAS},
        "feature_views": {"credit_decision": {"entity": "application", "key_fields": ["user_id", "application_id"], "view_version": 1, "owner": "risk", "status": "live", "max_dependency_depth": 4, "features": features, "feature_groups": groups}},
    }


def view() -> registry.View:
    return registry.build(definition()).views["credit_decision"]


def attach(entities: DataFrame, reports: DataFrame, needed: list[str]) -> DataFrame:
    """Entities with a struct column per needed source: its newest report's payload, typed, with the report's stamps.

    `reports` are rows (entity_key, report_type, report_ts, payload_json, content_hash, available_at, report_ref).
    All sources come from one aggregation and one join."""
    newest = F.struct("report_ts", "report_ref", "payload_json", "content_hash", "available_at")
    by = reports.where(F.col("report_type").isin(*needed)).groupBy("entity_key").agg(*(F.max(F.when(F.col("report_type") == s, newest)).alias(f"_{s}") for s in needed))
    df = entities.join(by, "entity_key", "left")
    for s in needed:
        raw, body = F.col(f"_{s}"), F.from_json(F.col(f"_{s}")["payload_json"], SCHEMAS[s])
        names = [x.split()[0] for x in SCHEMAS[s].split(", ")] if "<" not in SCHEMAS[s] else ["periods"]
        fields = [body[n].alias(n) for n in names if n != "report_ts"]
        if s == "credit_bureau_report":
            fields.append(body["report_ts"].alias("report_date"))
        df = df.withColumn(s, F.when(raw.isNotNull(), F.struct(*fields, raw["report_ts"].alias("report_ts"), raw["content_hash"].alias("content_hash"), raw["available_at"].alias("available_at"))))
    return df.drop(*(f"_{s}" for s in needed))
