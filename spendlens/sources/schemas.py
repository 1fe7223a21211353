"""Canonical relational schema of the customer-analytics domain.

One registry drives typed reads (``readers``), column defaults (``clean``)
and the data-quality checks (``operators.quality``): not-null columns, key
uniqueness, foreign keys, enumerations, string lengths and numeric ranges.
"""

from __future__ import annotations

from pyspark.sql import types as T

from spendlens.functions import labels as L

S, I, D, TS = T.StringType(), T.IntegerType(), T.DateType(), T.TimestampType()


def dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


def _f(name, typ, nullable=True):
    return T.StructField(name, typ, nullable)


CUSTOMERS = T.StructType([
    _f("id", S, False), _f("first_name", S, False), _f("last_name", S, False),
    _f("email", S, False), _f("phone", S), _f("country", S, False), _f("city", S),
    _f("signup_date", D, False), _f("loyalty_tier", S), _f("status", S), _f("created_at", TS),
])

CATEGORIES = T.StructType([
    _f("id", I, False), _f("name", S, False), _f("description", S), _f("created_at", TS),
])

PRODUCTS = T.StructType([
    _f("id", S, False), _f("sku", S, False), _f("name", S, False), _f("category_id", I, False),
    _f("price", dec(10, 2), False), _f("stock_quantity", I, False), _f("rating", dec(3, 2), False),
    _f("created_at", TS),
])

ORDERS = T.StructType([
    _f("id", S, False), _f("customer_id", S, False), _f("order_date", D, False), _f("status", S),
    _f("total_amount", dec(15, 2), False), _f("shipping_cost", dec(10, 2)),
    _f("discount_amount", dec(10, 2)), _f("payment_method", S, False), _f("created_at", TS),
])

# ``line_amount`` and ``is_returned`` extend the relational table: the gross
# value of the line and whether it came back.  They default to
# quantity * unit_price and false.
ORDER_ITEMS = T.StructType([
    _f("id", T.LongType(), False), _f("order_id", S, False), _f("product_id", S, False),
    _f("quantity", I, False), _f("unit_price", dec(10, 2), False), _f("discount_applied", dec(10, 2)),
    _f("line_amount", dec(15, 2)), _f("is_returned", T.BooleanType()),
])

PAYMENTS = T.StructType([
    _f("id", I, False), _f("order_id", S, False), _f("payment_date", TS),
    _f("amount", dec(15, 2), False), _f("payment_gateway", S, False), _f("transaction_status", S),
])

CUSTOMER_SEGMENTS = T.StructType([
    _f("customer_id", S, False), _f("recency_days", I, False), _f("frequency_count", I, False),
    _f("monetary_spend", dec(15, 2), False), _f("recency_score", I, False),
    _f("frequency_score", I, False), _f("monetary_score", I, False), _f("segment_name", S, False),
    _f("clv_estimated", dec(15, 2), False), _f("churn_risk_probability", dec(5, 2), False),
    _f("last_updated", TS),
])

# Flat CSV inputs of the modelling notebook.
ORDERS_CSV = T.StructType([
    _f("order_id", S), _f("customer_id", S), _f("order_date", S),
    _f("total_amount", T.DoubleType()), _f("status", S),
])
CUSTOMERS_CSV = T.StructType([_f("customer_id", S), _f("signup_date", S), _f("country", S)])

# Batch scoring records (six numeric inputs).
SCORING_INPUT = T.StructType([
    _f("customer_id", S), _f("recency", T.DoubleType()), _f("frequency", T.DoubleType()),
    _f("avg_order_value", T.DoubleType()), _f("support_tickets", T.DoubleType()),
    _f("discount_usage", T.DoubleType()), _f("satisfaction", T.DoubleType()),
])

TABLES = {
    "customers": CUSTOMERS, "categories": CATEGORIES, "products": PRODUCTS, "orders": ORDERS,
    "order_items": ORDER_ITEMS, "payments": PAYMENTS, "customer_segments": CUSTOMER_SEGMENTS,
}

# Column defaults applied when a value is missing.
DEFAULTS = {
    "customers": {"loyalty_tier": "standard", "status": "active"},
    "products": {"stock_quantity": 0, "rating": 5.0},
    "orders": {"status": "completed", "shipping_cost": 0.0, "discount_amount": 0.0},
    "order_items": {"discount_applied": 0.0, "is_returned": False},
    "payments": {"transaction_status": "captured"},
    "customer_segments": {"clv_estimated": 0.0, "churn_risk_probability": 0.0},
}

# Timestamps that default to the time of the load.
LOAD_TIMES = {
    "customers": ["created_at"], "categories": ["created_at"], "products": ["created_at"], "orders": ["created_at"],
    "payments": ["payment_date"], "customer_segments": ["last_updated"],
}

# Primary keys and unique columns.
UNIQUE_KEYS = {
    "customers": ["id", "email"],
    "categories": ["id", "name"],
    "products": ["id", "sku"],
    "orders": ["id"],
    "order_items": ["id"],
    "payments": ["id"],
    "customer_segments": ["customer_id"],
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("products", "category_id", "categories", "id"),
    ("orders", "customer_id", "customers", "id"),
    ("order_items", "order_id", "orders", "id"),
    ("order_items", "product_id", "products", "id"),
    ("payments", "order_id", "orders", "id"),
    ("customer_segments", "customer_id", "customers", "id"),
]

ENUMS = {
    ("customers", "loyalty_tier"): L.LOYALTY_TIERS,
    ("customers", "status"): L.CUSTOMER_STATUSES,
    ("orders", "status"): L.ORDER_STATUSES,
    ("payments", "payment_gateway"): L.PAYMENT_GATEWAYS,
    ("payments", "transaction_status"): L.TRANSACTION_STATUSES,
}

# VARCHAR(n) limits.
MAX_LENGTHS = {
    ("customers", "id"): 50, ("customers", "first_name"): 50, ("customers", "last_name"): 50,
    ("customers", "email"): 100, ("customers", "phone"): 30, ("customers", "country"): 100,
    ("customers", "city"): 100,
    ("categories", "name"): 100,
    ("products", "id"): 50, ("products", "sku"): 50, ("products", "name"): 150,
    ("orders", "id"): 100, ("orders", "customer_id"): 50, ("orders", "payment_method"): 50,
    ("order_items", "order_id"): 100, ("order_items", "product_id"): 50,
    ("payments", "order_id"): 100,
    ("customer_segments", "customer_id"): 50, ("customer_segments", "segment_name"): 50,
}

# Inclusive numeric ranges (lo, hi); None = open.
RANGES = {
    ("customer_segments", "recency_score"): (1, 5),
    ("customer_segments", "frequency_score"): (1, 5),
    ("customer_segments", "monetary_score"): (1, 5),
    ("customer_segments", "churn_risk_probability"): (0, 100),
    ("products", "rating"): (0, 5),
    ("order_items", "quantity"): (0, None),
}

# Decimal precision a value must fit in (precision, scale): every DECIMAL column.
PRECISION = {(t, f.name): (f.dataType.precision, f.dataType.scale)
             for t, table in TABLES.items() for f in table.fields if isinstance(f.dataType, T.DecimalType)}


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in TABLES[table].fields if not f.nullable]
