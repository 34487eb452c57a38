"""The library of actions: what each needs to be known, where it fits, what it costs and what it should bring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EVERY = "FOCUSED PARTIAL DIFFUSE"
_NEAR = "FOCUSED PARTIAL"
_WIDE = "PARTIAL DIFFUSE"

# Id, tier, kind, required slots, shapes that it suits, days of effort, reversible,
# expected reduction, cooldown in days; the sentence is this library's own around the same slots.
ACTIONS = {
    "LateDelivery": [
        ("LD-AUDIT-REGION", "baseline", "INVESTIGATE", "region", _NEAR, 1, True, 0.15, 14, "Compare delivery times in {region}: {topShare} of the late reports, {topBaselineShare} before."),
        ("LD-AUDIT-ALL", "baseline", "INVESTIGATE", "", _WIDE, 2, True, 0.12, 14, "Compare delivery times by carrier and region: late reports are spread out."),
        ("LD-PEAK-CAPACITY", "baseline", "INTERNAL_FIX", "hour", _NEAR, 2, True, 0.2, 21, "Add pickup capacity in {hour}: {topShare} of the late reports."),
        ("LD-PARTNER-SLA", "escalated", "CONTACT_PARTNER", "region", _NEAR, 3, True, 0.35, 30, "Ask the carrier of {region} for a written time; {affected} customers, orders worth {revenue}."),
        ("LD-REROUTE", "escalated", "INTERNAL_FIX", "region", "FOCUSED", 2, True, 0.45, 30, "Route {region} through the reserve carrier until the rate is back at {baselineRate}."),
        ("LD-PROACTIVE-NOTICE", "escalated", "CUSTOMER_CONTACT", "region", _EVERY, 1, False, 0.25, 7, "Tell customers with open orders in {region}, about {affected}, of the delay."),
    ],
    "DamagedInTransit": [
        ("DT-PACKAGING", "baseline", "INVESTIGATE", "productGroup", _NEAR, 1, True, 0.2, 21, "Check the packaging of {productGroup}: {topShare} of the damage reports."),
        ("DT-PHOTO-LOG", "baseline", "INTERNAL_FIX", "", _EVERY, 1, True, 0.1, 30, "Photograph parcels as they leave the warehouse for a week."),
        ("DT-UPGRADE-PACK", "escalated", "INTERNAL_FIX", "productGroup", _NEAR, 3, True, 0.4, 45, "Use better padding for {productGroup} from the next lot."),
        ("DT-CLAIM", "escalated", "CONTACT_PARTNER", "region", "FOCUSED", 3, True, 0.15, 30, "Record the damage rate {currentRate} in {region} and claim {revenue} from the carrier."),
        ("DT-VOUCHER", "escalated", "FINANCIAL", "", _EVERY, 1, False, 0.2, 30, "Send {affected} customers a voucher."),
    ],
    "LostPackage": [
        ("LP-TRACE", "baseline", "INVESTIGATE", "", _EVERY, 1, True, 0.1, 7, "Trace the {evidenceCount} parcels reported lost."),
        ("LP-FORMAL-CLAIM", "escalated", "CONTACT_PARTNER", "region", _NEAR, 3, True, 0.3, 30, "Open a formal claim for parcels lost in {region}, worth {revenue}."),
        ("LP-REFUND", "escalated", "FINANCIAL", "", _EVERY, 2, False, 0.35, 14, "Replace or refund for {affected} customers, about {revenue}."),
    ],
    "CourierAttitude": [
        ("CA-REPORT", "baseline", "CONTACT_PARTNER", "region", _NEAR, 1, True, 0.2, 21, "Send the carrier the {evidenceCount} reports from {region}."),
        ("CA-REPLACE", "escalated", "CONTACT_PARTNER", "region", "FOCUSED", 2, True, 0.45, 45, "Ask for other couriers in {region}: {topShare} of the reports."),
    ],
    "TechnicalDefect": [
        ("TD-TRACE-SKU", "baseline", "INVESTIGATE", "product", _NEAR, 1, True, 0.15, 14, "Trace the lots of {product}: {topShare} of the defects."),
        ("TD-DEFECT-RATE", "baseline", "INVESTIGATE", "", _EVERY, 2, True, 0.15, 14, "Compare the defect rate {currentRate} with {baselineRate} before."),
        ("TD-HALT-SALE", "escalated", "INTERNAL_FIX", "product", "FOCUSED", 1, True, 0.6, 30, "Stop selling {product} until it is checked; {revenue} at risk."),
        ("TD-STOCK-CHECK", "escalated", "INTERNAL_FIX", "product", _NEAR, 3, True, 0.4, 45, "Check the stock of {product}."),
        ("TD-PROACTIVE-SWAP", "escalated", "FINANCIAL", "product", "FOCUSED", 5, False, 0.5, 60, "Offer buyers of {product} an exchange."),
    ],
    "NotAsDescribed": [
        ("NAD-REVIEW-PAGE", "baseline", "INTERNAL_FIX", "product", _NEAR, 1, True, 0.3, 30, "Review the page of {product}."),
        ("NAD-REVIEW-ALL", "baseline", "INTERNAL_FIX", "", _WIDE, 3, True, 0.25, 45, "Review the pages of all products named in {evidenceCount} reports."),
        ("NAD-FIX-SPEC", "escalated", "INTERNAL_FIX", "product", _NEAR, 2, True, 0.45, 30, "Correct the specification of {product}."),
        ("NAD-AUDIT-ADS", "escalated", "INTERNAL_FIX", "product", "FOCUSED", 1, True, 0.2, 30, "Pause and check the advertising of {product}."),
    ],
    "SuspectedCounterfeit": [
        ("SC-DOCS", "baseline", "INVESTIGATE", "product", _NEAR, 2, True, 0.2, 30, "Ask the supplier of {product} for papers of origin."),
        ("SC-DELIST", "escalated", "INTERNAL_FIX", "product", "FOCUSED", 1, True, 0.7, 30, "Take {product} off sale; {revenue} at risk."),
        ("SC-DOSSIER", "escalated", "INVESTIGATE", "", _EVERY, 3, True, 0.2, 30, "Put the {evidenceCount} reports together for legal advice."),
    ],
    "GatewayError": [
        ("GE-LOG", "baseline", "INVESTIGATE", "hour", _NEAR, 1, True, 0.2, 7, "Read the gateway's logs of {hour}: {topShare} of the errors."),
        ("GE-LOG-ALL", "baseline", "INVESTIGATE", "", _WIDE, 1, True, 0.2, 7, "Read the gateway's logs of {windowDays}."),
        ("GE-ESCALATE", "escalated", "CONTACT_PARTNER", "", _EVERY, 1, True, 0.4, 14, "Report the errors of {hour} to the gateway."),
        ("GE-FAILOVER", "escalated", "INTERNAL_FIX", "", _EVERY, 1, True, 0.65, 14, "Switch to the second gateway; {revenue} at risk."),
    ],
    "DoubleCharge": [
        ("DC-RECONCILE", "baseline", "INVESTIGATE", "", _EVERY, 1, True, 0.15, 7, "Reconcile the payments of {windowDays}."),
        ("DC-LIST", "escalated", "INVESTIGATE", "", _EVERY, 1, True, 0.2, 7, "List the payments charged twice, about {revenue}."),
        ("DC-REFUND", "escalated", "FINANCIAL", "", _EVERY, 2, False, 0.6, 7, "Pay {affected} customers back, about {revenue}."),
    ],
    "SlowResponse": [
        ("SR-MEASURE", "baseline", "INVESTIGATE", "hour", _NEAR, 1, True, 0.15, 14, "Measure response times in {hour}: {topShare} of the reports."),
        ("SR-STAFFING", "escalated", "INTERNAL_FIX", "hour", _NEAR, 3, True, 0.45, 30, "Put more staff on {hour}."),
        ("SR-CALLBACK", "escalated", "CUSTOMER_CONTACT", "channel", _NEAR, 1, False, 0.3, 7, "Call back {affected} customers who wrote through {channel}."),
    ],
    "BadAttitude": [
        ("BA-EXTRACT", "baseline", "INVESTIGATE", "channel", _NEAR, 1, True, 0.15, 14, "Take out the conversations of {channel}."),
        ("BA-ESCALATE-MGR", "escalated", "INTERNAL_FIX", "", _EVERY, 1, True, 0.3, 21, "Hand the {evidenceCount} reports to the team's lead."),
        ("BA-TRAINING", "escalated", "INTERNAL_FIX", "hour", "FOCUSED", 5, True, 0.4, 60, "Train the shift of {hour}."),
    ],
    "WrongInformation": [
        ("WI-REVIEW-SCRIPT", "baseline", "INTERNAL_FIX", "product", _NEAR, 1, True, 0.25, 30, "Review what staff say about {product}."),
        ("WI-UPDATE-SCRIPT", "escalated", "INTERNAL_FIX", "", _EVERY, 2, True, 0.4, 45, "Rewrite the answers behind {evidenceCount} reports."),
    ],
    "AppSlowOrCrash": [
        ("AS-CORRELATE", "baseline", "INVESTIGATE", "hour", _NEAR, 1, True, 0.2, 7, "Compare server load in {hour}: {topShare} of the reports."),
        ("AS-ALERT-ENG", "escalated", "INTERNAL_FIX", "", _EVERY, 1, True, 0.45, 7, "Call the engineers on duty in {hour}."),
        ("AS-NOTIFY-USERS", "escalated", "CUSTOMER_CONTACT", "", _EVERY, 1, False, 0.2, 7, "Show a notice of the disturbance in the app."),
    ],
    "SlowRefund": [
        ("SRF-MEASURE", "baseline", "INVESTIGATE", "", _EVERY, 1, True, 0.15, 14, "Measure each step of the refunds of {windowDays}."),
        ("SRF-PRIORITIZE", "escalated", "INTERNAL_FIX", "", _EVERY, 2, True, 0.5, 14, "Pay overdue refunds first, about {revenue}."),
        ("SRF-NOTIFY", "escalated", "CUSTOMER_CONTACT", "", _EVERY, 1, False, 0.25, 7, "Tell {affected} customers when they are paid."),
    ],
    "MisleadingPromo": [
        ("MP-REVIEW-TERMS", "baseline", "INTERNAL_FIX", "channel", _NEAR, 1, True, 0.25, 21, "Review the terms of offers on {channel}."),
        ("MP-FIX-COPY", "escalated", "INTERNAL_FIX", "", _EVERY, 1, True, 0.45, 21, "Correct the offers behind {evidenceCount} reports."),
    ],
}
# The same for a category whose cause has no actions of its own, and for any other.
FALLBACK = {
    "Delivery": ("FB-DELIVERY", "baseline", "INVESTIGATE", "", _EVERY, 2, True, 0.1, 14, "Read the delivery reports; the rate is {currentRate}, {baselineRate} before."),
    "ProductQuality": ("FB-QUALITY", "baseline", "INVESTIGATE", "", _EVERY, 2, True, 0.1, 14, "Read the quality reports on {product}."),
    "CustomerService": ("FB-CS", "baseline", "INVESTIGATE", "", _EVERY, 2, True, 0.1, 14, "Read the {evidenceCount} service reports."),
    "Payment": ("FB-PAYMENT", "baseline", "INVESTIGATE", "", _EVERY, 1, True, 0.1, 14, "Read the {evidenceCount} payment reports."),
    "TechnicalApp": ("FB-TECH", "baseline", "INVESTIGATE", "", _EVERY, 1, True, 0.1, 14, "Read the {evidenceCount} reports on the app."),
    "ReturnRefund": ("FB-REFUND", "baseline", "INVESTIGATE", "", _EVERY, 2, True, 0.1, 14, "Read the {evidenceCount} reports on returns."),
    "PricePromotion": ("FB-PROMO", "baseline", "INVESTIGATE", "", _EVERY, 1, True, 0.1, 14, "Read the {evidenceCount} reports on prices."),
}
GENERIC = ("FB-GENERIC", "baseline", "INVESTIGATE", "", _EVERY, 1, True, 0.05, 14, "Read the {evidenceCount} reports of {windowDays}.")
# What is worth recording when a cause's slot is unknown: id, effort, cooldown, strategic value.
INSTRUMENT = {"carrier": ("INS-CARRIER", 3, 90, 0.8), "batch": ("INS-BATCH", 5, 90, 0.75), "agent": ("INS-AGENT", 2, 90, 0.6), "appVersion": ("INS-APPVER", 1, 90, 0.7)}
GAP = {
    "LateDelivery": "carrier", "DamagedInTransit": "carrier", "LostPackage": "carrier", "CourierAttitude": "carrier", "TechnicalDefect": "batch",
    "SuspectedCounterfeit": "batch", "SlowResponse": "agent", "BadAttitude": "agent", "AppSlowOrCrash": "appVersion",
}

SCHEMA = """pool string, place int, role string, action_id string, tier string, kind string, requires array<string>, works_when array<string>,
effort_days int, reversible boolean, effect double, cooldown_days int, gap_slot string, template string"""


def rows() -> list[tuple]:
    """The library as rows of ``SCHEMA``: a pool for each cause, each category and the rest, and each pool's safety net."""

    def row(pool, place, role, a, gap=None):
        return (pool, place, role, *a[:3], a[3].split(), a[4].split(), *a[5:9], gap, a[9])

    out = []
    for cause, actions in ACTIONS.items():
        out += [row(f"cause/{cause}", i, "action", a) for i, a in enumerate(actions)]
        if gap := GAP.get(cause):
            name, effort, cooldown, value = INSTRUMENT[gap]
            out.append((f"cause/{cause}", 100, "instrument", name, "baseline", "INTERNAL_FIX", [], _EVERY.split(), effort, True, value, cooldown, gap, f"Record the {gap} with each order."))
    for category, a in [*FALLBACK.items(), ("", GENERIC)]:
        out += [row(f"category/{category}", 0, "action", a), row(f"net/{category}", 200, "net", a)]
    return out


def library(spark: SparkSession) -> DataFrame:
    """The library; a fixed handful of rows."""
    return spark.createDataFrame(rows(), SCHEMA)
