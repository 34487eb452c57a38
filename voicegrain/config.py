"""Thresholds and model constants, in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Source tiers, source groups, score coefficients, severity weights and
# bands, taxonomy impacts.
TIER_WEIGHT = {"P1": 1.0, "P2": 0.9, "P3": 0.6, "P4": 0.4, "P5": 0.15}
RECONCILABLE_SOURCES = ["Shopee", "Lazada", "Tiki", "TikTok", "TikTokShop", "CSKH", "Email", "Hotline", "Form"]
IDENTIFIED_SOURCES = ["CSKH", "Email", "Hotline", "Form", "Ticket"]
ANONYMOUS_AUTHOR = r"(?i)^(anonymous|ẩn danh|user\d*|khach_\d+)$"
AUTHENTICITY = {"intercept": -3.2, "duplicate": 4.0, "burst": 2.5, "account": 2.6, "star": 2.8, "transaction": 4.5}
SEVERITY_WEIGHTS = {"wcr": 0.25, "z": 0.25, "velocity": 0.2, "impact": 0.2, "coverage": 0.1}
SEVERITY_BANDS = [(0.25, "Low"), (0.5, "Medium"), (0.75, "High")]
CATEGORIES = {
    "Delivery": (0.55, ["LateDelivery", "LostPackage", "DamagedInTransit", "WrongAddress", "CourierAttitude"]),
    "ProductQuality": (0.70, ["NotAsDescribed", "TechnicalDefect", "ExpiredOrStale", "MissingAccessory", "SuspectedCounterfeit"]),
    "CustomerService": (0.45, ["SlowResponse", "BadAttitude", "WrongInformation", "UnresolvedCase"]),
    "Payment": (0.90, ["GatewayError", "DoubleCharge", "WrongPromotion", "WrongInvoice"]),
    "TechnicalApp": (0.60, ["AppSlowOrCrash", "LoginError", "DisplayError", "SearchError"]),
    "ReturnRefund": (0.75, ["SlowRefund", "ReturnRejected", "ComplexProcess"]),
    "PricePromotion": (0.30, ["HigherThanExpected", "MisleadingPromo"]),
}
# Labels of older records and the category each stands for.
OLD_CATEGORIES = {
    "Product Quality": "ProductQuality", "Product": "ProductQuality", "Customer Service": "CustomerService", "Technical Issue": "TechnicalApp", "Software": "TechnicalApp",
    "App": "TechnicalApp", "Refund": "ReturnRefund", "Return": "ReturnRefund", "Pricing": "PricePromotion", "Price": "PricePromotion",
}


@dataclass(frozen=True)
class Trust:
    new_account_days: float = 7
    reject: float = 0.7
    gray: float = 0.4
    coverage_floor: float = 0.5
    early_hours: float = 12
    half_life_days: float = 180
    burst_minutes: int = 30
    burst_min_rows: int = 8
    burst_z: float = 3.0


@dataclass(frozen=True)
class Alerts:
    window_days: int = 7
    baseline_days: int = 28
    min_support: int = 3
    p_value: float = 0.01
    delta_points: float = 0.5
    affected: int = 20
    fdr: float = 0.05
    p5_cap: float = 0.49


TRUST = Trust()
ALERTS = Alerts()


@dataclass(frozen=True)
class PainThresholds:
    negatives: int = 15  # complaints that a product group needs
    customers: int = 3
    days: int = 2
    z: float = 2.5
    side_z: float = 1.5  # against the group's other rows and other groups' complaints
    lift: float = 2.0
    background: int = 10  # rows that a background needs to be tested
    spread: float = 0.5  # share of the groups from which a phrase is the shop's matter
    groups: int = 3  # groups from which there is one
    shown: int = 6
    overlap: float = 0.5
    touching: float = 0.5
    subset: float = 0.8
    label_cover: float = 0.7
    group_cause: float = 0.5
    shop_cause: float = 0.6
    trend_days: int = 28


PAIN = PainThresholds()
