"""Fixed values of the domain.

FIXED VALUES – these must equal the reference's labels for results to match;
they are listed plainly, in the reference's own order.
"""

from __future__ import annotations

# Segment labels in display order: (id, name, description).
SEGMENTS = [
    ("champions", "Champions",
     "Loyal high frequency buyers who place orders continuously and require personalized premium experiences."),
    ("loyalists", "Loyalists",
     "Highly repetitive purchasers. Engage them with tier programs and upcoming private previews."),
    ("potential", "Potential Loyalists",
     "Active recent buys. Offer onboarding campaigns or starter product bundles."),
    ("new", "New Customers",
     "Discovered product catalog recently. Nurture with initial feedback forms and welcome codes."),
    ("attention", "Need Attention",
     "Moderate recency spacing. Needs immediate hyper-personalized email recommendations."),
    ("risk", "At Risk / Sleeping",
     "Dormant since last month. Deploy reactivation campaigns and exit-intent strategies."),
    ("hibernating", "Hibernating / Lost",
     "No transaction for 180+ days. Targeted surveys are ideal to diagnose loss causes."),
]

CHAMPIONS = "Champions"
LOYALISTS = "Loyalists"
POTENTIAL = "Potential Loyalists"
NEW_CUSTOMERS = "New Customers"
NEED_ATTENTION = "Need Attention"
AT_RISK = "At Risk / Sleeping"
HIBERNATING = "Hibernating / Lost"

# Pareto bracket labels.
CORE_BRACKET = "Core 25% (High Value)"
REST_BRACKET = "Remaining 75% (General)"

# Retention actions of the churn watch-list, highest threshold first.
ACTION_CRITICAL = "CRITICAL TRIGGER: Immediate Reactivation Discount"
ACTION_WARNING = "WARNING: Active Email Feed Trigger"
ACTION_STABLE = "STABLE: Onboard to Premium newsletter"

# Risk band levels.
HIGH, MEDIUM, LOW = "high", "medium", "low"

# Recommended-action codes (our own short wording for the five advice rules).
REACTIVATION_25 = "reactivation_discount_25pct"
REACTIVATION_15 = "reactivation_discount_15pct"
CX_CALL = "cx_follow_up_call"
SECOND_PURCHASE = "second_purchase_journey"
SUPPORT_CREDIT = "support_credit_coupon"
NEWSLETTER = "loyalty_newsletter"

# Allowed values of the enumerated columns of the relational schema.
LOYALTY_TIERS = ["standard", "bronze", "silver", "gold", "platinum"]
CUSTOMER_STATUSES = ["active", "inactive", "dormant"]
ORDER_STATUSES = ["completed", "processing", "shipped", "cancelled", "refunded"]
PAYMENT_GATEWAYS = ["Stripe", "PayPal", "ApplePay", "GooglePay", "DirectTransfer"]
TRANSACTION_STATUSES = ["authorized", "captured", "reversed", "failed"]
