"""Label, display and risk expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label codes, their names, and the limits of the risk bands.
UNLABELLED, REAL, FAKE = -1, 0, 1
LABEL_NAMES = {REAL: "Real News", FAKE: "Fake News", UNLABELLED: "Unlabeled"}
LOW_RISK_BELOW = 0.3
MEDIUM_RISK_BELOW = 0.7
TITLE_WIDTH = 100


def label_code(is_fake: Column) -> Column:
    """1 fake, 0 real, -1 not labelled."""
    return F.coalesce(is_fake.cast("int"), F.lit(UNLABELLED))


def label_name(code: Column) -> Column:
    """Name of a label code."""
    name = F.concat(F.lit("Label "), code.cast("string"))
    for value, text in LABEL_NAMES.items():
        name = F.when(code == value, text).otherwise(name)
    return name


def verdict(code: Column) -> Column:
    """FAKE for 1, otherwise REAL."""
    return F.when(code == FAKE, "FAKE").otherwise("REAL")


def short_title(title: Column) -> Column:
    return F.coalesce(F.substring(title, 1, TITLE_WIDTH), F.lit("N/A"))


def shown_source(source: Column) -> Column:
    return F.coalesce(source, F.lit("Unknown"))


def risk_band(probability: Column) -> Column:
    """low / medium / high risk of being fake."""
    return (
        F.when(probability < LOW_RISK_BELOW, "low")
        .when(probability < MEDIUM_RISK_BELOW, "medium")
        .otherwise("high")
    )
