"""Synthetic industry tables, drawn from row ids.

Each field is a pure function of (row id, salt): a lost task rebuilds the same rows, and the
same text of rules works on any engine. Ids come from any table or from ``spark.range``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workloom.functions import draws as dr


class Field(NamedTuple):
    """A field as a Column of the row id, and the same rule as SQL text."""

    column: Callable[[Column], Column]
    sql: Callable[[str], str]


def pick(salt: int, values: list, weights: list[int]) -> Field:
    return Field(lambda i: dr.pick(i, salt, values, weights), lambda i: dr.pick_sql(i, salt, values, weights))


def number(salt: int, low: int, high: int) -> Field:
    return Field(lambda i: dr.between(i, salt, low, high), lambda i: dr.between_sql(i, salt, low, high))


def coded(prefix: str, salt: int, width: int) -> Field:
    """A code of fixed width; wide codes are put together from nine-digit draws."""
    widths = [9] * (width // 9) + ([width % 9] if width % 9 else [])
    return Field(
        lambda i: F.concat(F.lit(prefix), *[dr.digits(i, salt + 11 * k, w) for k, w in enumerate(widths)]),
        lambda i: f"concat('{prefix}', " + ", ".join(dr.digits_sql(i, salt + 11 * k, w) for k, w in enumerate(widths)) + ")")


def day(salt: int, start: str, days: int) -> Field:
    return Field(
        lambda i: F.date_add(F.lit(start).cast("date"), dr.between(i, salt, 0, days - 1).cast("int")),
        lambda i: f"(DATE '{start}' + CAST({dr.between_sql(i, salt, 0, days - 1)} AS INTEGER))")


def moment(salt: int, start: str, seconds: int, step: int = 1) -> Field:
    return Field(
        lambda i: F.timestamp_add("SECOND", dr.between(i, salt, 0, seconds // step - 1) * step, F.lit(start).cast("timestamp_ntz")),
        lambda i: f"(TIMESTAMP '{start}' + {dr.between_sql(i, salt, 0, seconds // step - 1)} * {step} * INTERVAL '1' SECOND)")


def _money(value: Column, low: float, high: float, digits: int, kind: str) -> Column:
    scale = float(10 ** digits)
    return (F.floor(F.least(F.greatest(value, F.lit(low)), F.lit(high)) * scale + 0.5) / scale).cast(kind)


def _money_sql(value: str, low: float, high: float, digits: int, kind: str) -> str:
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"CAST(floor(least(greatest({value}, {low}::DOUBLE), {high}::DOUBLE) * {scale} + 0.5::DOUBLE) / {scale} AS {kind})"


def normal(salt: int, mean: float, stddev: float, low: float, high: float, digits: int, kind: str) -> Field:
    return Field(
        lambda i: _money(dr.normal(i, salt, mean, stddev), low, high, digits, kind),
        lambda i: _money_sql(dr.normal_sql(i, salt, mean, stddev), low, high, digits, kind))


def skewed(salt: int, low: float, high: float, shape: int, digits: int, kind: str) -> Field:
    return Field(
        lambda i: _money(dr.gamma(i, salt, low, high, shape), low, high, digits, kind),
        lambda i: _money_sql(dr.gamma_sql(i, salt, low, high, shape), low, high, digits, kind))


def derived(spark_sql: str, other: str | None = None) -> tuple[str, str]:
    """A field computed from the fields before it, as SQL text for both engines."""
    return spark_sql, other or spark_sql


# Word lists for names and addresses.
FIRST = ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gail", "Hugo", "Iris", "Jon"]
LAST = ["Abbot", "Baker", "Cole", "Dunn", "Evans", "Frost", "Grant", "Hale", "Irwin", "Jones"]
AREAS = ["AB", "BS", "CF", "EH", "LS", "M", "NE", "SW"]
EVEN = [1] * 10
YEAR_S = 366 * 86400


def full_name(salt: int) -> Field:
    first, last = pick(salt, FIRST, EVEN), pick(salt + 1, LAST, EVEN)
    return Field(lambda i: F.concat(first.column(i), F.lit(" "), last.column(i)), lambda i: f"concat({first.sql(i)}, ' ', {last.sql(i)})")


def email(salt: int) -> Field:
    name, box = pick(salt, [n.lower() for n in LAST], EVEN), coded("", salt + 1, 5)
    return Field(
        lambda i: F.concat(name.column(i), box.column(i), F.lit("@example.com")),
        lambda i: f"concat({name.sql(i)}, {box.sql(i)}, '@example.com')")


def postcode(salt: int) -> Field:
    area, a, b = pick(salt, AREAS, [1] * 8), coded("", salt + 1, 2), coded("", salt + 2, 1)
    return Field(
        lambda i: F.concat(area.column(i), a.column(i), F.lit(" "), b.column(i), F.lit("QX")),
        lambda i: f"concat({area.sql(i)}, {a.sql(i)}, ' ', {b.sql(i)}, 'QX')")


def dashed(salt: int) -> Field:
    parts = [coded("", salt, 3), coded("", salt + 1, 3), coded("", salt + 2, 4)]
    return Field(
        lambda i: F.concat_ws("-", *[p.column(i) for p in parts]),
        lambda i: "concat_ws('-', " + ", ".join(p.sql(i) for p in parts) + ")")


ID = Field(lambda i: i.cast("bigint"), lambda i: f"CAST({i} AS BIGINT)")


def shifted(offset: int) -> Field:
    return Field(lambda i: i.cast("bigint") + offset, lambda i: f"CAST({i} AS BIGINT) + {offset}")


# Value lists and weights of the demo tables.
TABLES: dict[str, dict] = {
    "financial_customers": {
        "customer_id": shifted(1000000), "account_number": coded("ACCT", 1, 10), "name": full_name(3), "email": email(5),
        "kyc_status": pick(7, ["active", "pending", "suspended", "closed"], [70, 15, 10, 5]),
        "risk_rating": pick(8, ["low", "medium", "high", "critical"], [40, 35, 20, 5]),
        "registration_date": day(9, "2020-01-01", 1827),
        "account_balance": normal(10, 50000, 30000, 0, 1000000, 2, "decimal(12,2)"),
    },
    "financial_transactions": {
        "transaction_id": coded("TXN", 21, 16), "customer_id": number(22, 1000000, 1000999),
        "amount": skewed(23, 0.01, 50000, 2, 2, "decimal(10,2)"), "transaction_date": day(24, "2024-01-01", 366),
        "merchant_category": pick(25, ["Retail", "Restaurant", "Gas Station", "Grocery", "Online", "Travel", "Entertainment", "Healthcare", "Utilities", "Other"],
                                  [25, 20, 10, 15, 15, 5, 5, 2, 2, 1]),
        "country_code": pick(26, ["US", "GB", "CA", "DE", "FR", "AU", "JP", "BR"], [40, 25, 10, 8, 7, 5, 3, 2]),
        "is_suspicious": derived("amount > 10000"),
    },
    "financial_fraud_alerts": {
        "alert_id": shifted(1), "transaction_id": coded("TXN", 21, 16),
        "alert_type": pick(31, ["unusual_amount", "velocity", "location", "merchant_risk"], [30, 25, 25, 20]),
        "severity": pick(32, ["low", "medium", "high", "critical"], [20, 35, 30, 15]),
        "investigation_status": pick(33, ["open", "investigating", "resolved", "false_positive"], [25, 30, 30, 15]),
    },
    "healthcare_patients": {
        "patient_id": shifted(1000000), "nhs_number": dashed(41), "name": full_name(44), "date_of_birth": day(46, "1940-01-01", 29585),
        "postcode": postcode(47),
        "condition_category": pick(50, ["Cardiovascular", "Respiratory", "Diabetes", "Cancer", "Mental Health", "None"], [25, 20, 20, 15, 15, 5]),
    },
    "healthcare_appointments": {
        "appointment_id": shifted(1), "patient_id": number(51, 1000000, 1000999), "doctor_id": number(52, 1, 1000), "appointment_date": day(53, "2024-01-01", 366),
        "department": pick(54, ["Emergency", "Cardiology", "Orthopedics", "Pediatrics", "Oncology", "Neurology", "Radiology", "Surgery", "Primary Care", "Mental Health"],
                           [15, 12, 10, 10, 8, 8, 8, 8, 15, 6]),
        "duration_mins": normal(55, 45, 15, 15, 120, 0, "int"), "cost_gbp": skewed(56, 50, 2000, 2, 2, "decimal(8,2)"),
    },
    "healthcare_prescriptions": {
        "prescription_id": shifted(1), "patient_id": number(61, 1000000, 1000999),
        "medication_name": pick(62, ["Aspirin", "Ibuprofen", "Paracetamol", "Amoxicillin", "Metformin", "Lisinopril", "Atorvastatin", "Omeprazole", "Simvastatin", "Levothyroxine"],
                                [15, 12, 15, 10, 8, 8, 10, 10, 7, 5]),
        "dosage": pick(63, ["10mg", "20mg", "50mg", "100mg", "250mg", "500mg"], [10, 20, 25, 25, 15, 5]), "prescribed_date": day(64, "2024-01-01", 366),
    },
    "energy_customers": {
        "customer_id": shifted(1000000), "account_number": coded("EGY", 71, 10), "postcode": postcode(73),
        "tariff_type": pick(76, ["Standard", "Economy 7", "Fixed Rate", "Variable", "Green Energy"], [30, 25, 20, 15, 10]),
        "vulnerability_flag": pick(77, [True, False], [10, 90]),
    },
    "energy_smart_meter_readings": {
        "reading_id": coded("RD", 81, 14), "meter_id": coded("M", 83, 10), "customer_id": number(85, 1000000, 1000999),
        "reading_datetime": moment(86, "2024-01-01 00:00:00", YEAR_S, 1800), "kwh_consumed": normal(87, 3.5, 2.0, 0.1, 50.0, 3, "decimal(8,3)"),
        "tariff_rate": derived("CASE WHEN tariff_draw < 40 THEN 0.15 WHEN tariff_draw < 80 THEN 0.20 ELSE 0.28 END"),
        "_tariff_draw": number(88, 0, 99),
    },
    "energy_outages": {
        "outage_id": shifted(1), "region": pick(91, ["North", "South", "East", "West", "Central"], [20] * 5),
        "start_time": moment(92, "2024-01-01 00:00:00", YEAR_S), "duration_mins": skewed(93, 5, 7200, 3, 0, "int"),
        "end_time": derived("start_time + duration_mins * INTERVAL '1' MINUTE"), "customers_affected": skewed(94, 100, 50000, 2, 0, "int"),
    },
    "enterprise_users": {
        "user_id": shifted(1), "email": email(101), "registration_date": day(103, "2020-01-01", 1827),
        "country": pick(104, ["US", "GB", "CA", "DE", "FR", "AU", "JP", "BR"], [35, 20, 10, 10, 10, 5, 5, 5]),
        "subscription_tier": pick(105, ["free", "basic", "premium", "enterprise"], [60, 25, 12, 3]),
    },
    "enterprise_events": {
        "event_id": coded("EVT", 111, 16), "user_id": number(113, 1, 5000),
        "event_type": pick(114, ["page_view", "click", "purchase", "signup", "logout"], [50, 30, 10, 5, 5]),
        "timestamp": moment(115, "2024-01-01 00:00:00", YEAR_S), "session_id": coded("SES", 116, 12),
        "properties": pick(118, ['{"page": "/home", "duration": 45}', '{"page": "/products", "duration": 120}', '{"page": "/checkout", "duration": 180}', '{"page": "/account", "duration": 60}'], [1] * 4),
    },
    "enterprise_products": {
        "product_id": shifted(1), "name": coded("Product ", 121, 8),
        "category": pick(122, ["Electronics", "Clothing", "Books", "Home", "Sports", "Toys"], [25, 20, 15, 20, 10, 10]),
        "price": skewed(123, 10, 5000, 2, 2, "decimal(10,2)"), "stock_level": normal(124, 500, 300, 0, 10000, 0, "int"),
    },
}


def build(name: str, ids: DataFrame, id_column: str) -> DataFrame:
    """The named demo table with one row per id."""
    spec = TABLES[name]
    row_id = F.col(id_column)
    plain = {k.lstrip("_"): f for k, f in spec.items() if isinstance(f, Field)}
    drawn = ids.select(*[f.column(row_id).alias(k) for k, f in plain.items()])
    computed = {k: F.expr(f[0]) for k, f in spec.items() if not isinstance(f, Field)}
    out = drawn.withColumns(computed) if computed else drawn
    return out.select(*[k for k in spec if not k.startswith("_")])


def build_sql(name: str, source: str, id_column: str) -> str:
    """The same table as SQL text."""
    spec = TABLES[name]
    plain = ", ".join(f"{f.sql(id_column)} AS {k.lstrip('_')}" for k, f in spec.items() if isinstance(f, Field))
    shown = ", ".join(k if isinstance(f, Field) else f"{f[1]} AS {k}" for k, f in spec.items() if not k.startswith("_"))
    return f"(SELECT {shown} FROM (SELECT {plain} FROM {source}))"
