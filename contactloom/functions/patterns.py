"""The role-address pattern dimension and the ways to choose from it."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import WORD

# List position, local part, confidence, category, description,
# in category order and member order within the category.
PATTERN_ROWS = [
    (1, "info", 0.95, "general", "General information email"),
    (2, "contact", 0.90, "general", "Contact/inquiry email"),
    (3, "hello", 0.85, "general", "Friendly contact email"),
    (24, "office", 0.50, "general", "General office"),
    (25, "team", 0.50, "general", "General team email"),
    (26, "mail", 0.45, "general", "General mail"),
    (4, "sales", 0.80, "business", "Sales inquiries"),
    (12, "business", 0.70, "business", "Business inquiries"),
    (13, "partnerships", 0.60, "business", "Partnership opportunities"),
    (14, "bd", 0.60, "business", "Business development"),
    (18, "admin", 0.65, "technical", "Administrative contact"),
    (19, "webmaster", 0.55, "technical", "Website administrator"),
    (20, "it", 0.60, "technical", "IT department"),
    (5, "support", 0.80, "support", "Customer support"),
    (6, "help", 0.75, "support", "Help and support"),
    (7, "service", 0.75, "support", "Customer service"),
    (8, "hr", 0.70, "hr", "Human resources"),
    (9, "careers", 0.70, "hr", "Career opportunities"),
    (10, "jobs", 0.65, "hr", "Job applications"),
    (11, "recruitment", 0.65, "hr", "Recruitment team"),
    (15, "marketing", 0.65, "marketing", "Marketing team"),
    (16, "media", 0.60, "marketing", "Media inquiries"),
    (17, "press", 0.60, "marketing", "Press inquiries"),
    (21, "finance", 0.60, "finance", "Finance department"),
    (22, "accounting", 0.60, "finance", "Accounting department"),
    (23, "legal", 0.55, "legal", "Legal department"),
]
# Keywords in name or website that add categories.
TECHNICAL_WORDS = ["tech", "software", "digital", "it", "computer", "data", "ai", "ml"]
SUPPORT_WORDS = ["service", "support", "consulting", "solutions"]
LARGE_WORDS = ["corp", "corporation", "inc", "ltd", "group", "holdings"]


@dataclass(frozen=True)
class Pattern:
    position: int
    name: str
    confidence: float
    category: str
    description: str


ALL_PATTERNS = tuple(Pattern(*row) for row in PATTERN_ROWS)


def pattern_dimension(spark: SparkSession) -> DataFrame:
    """The 26 rows as a DataFrame, with ``ord`` as the tie-break."""
    rows = [(i, *row) for i, row in enumerate(PATTERN_ROWS, 1)]
    return spark.createDataFrame(
        rows,
        "ord int, position int, pattern string, confidence double, category string, description string",
    )


def by_category(categories: Iterable[str] | None) -> list[Pattern]:
    """Caller's category order, then member order; None gives all in list order."""
    if categories is None:
        return sorted(ALL_PATTERNS, key=lambda p: p.position)
    wanted = list(dict.fromkeys(categories))
    return [p for category in wanted for p in ALL_PATTERNS if p.category == category]


def by_confidence(minimum: float) -> list[Pattern]:
    return [p for p in by_category(None) if p.confidence >= minimum]


def by_name(names: Iterable[str]) -> list[Pattern]:
    known = {p.name: p for p in ALL_PATTERNS}
    return [known[name] for name in dict.fromkeys(names) if name in known]


def override(patterns: Iterable[Pattern], confidences: Mapping[str, float]) -> list[Pattern]:
    return [replace(p, confidence=float(confidences.get(p.name, p.confidence))) for p in patterns]


def configured(
    names: Iterable[str] | None = None,
    categories: Iterable[str] | None = None,
    minimum: float = 0.5,
) -> list[Pattern]:
    """Named patterns, else those of the categories, else by confidence."""
    if names:
        return by_name(names)
    return by_category(categories) if categories else by_confidence(minimum)


def ranked(patterns: Iterable[Pattern], minimum: float, k: int) -> list[Pattern]:
    """The k best at or above the minimum; equal confidence keeps the given order."""
    kept = [p for p in patterns if p.confidence >= minimum]
    return sorted(kept, key=lambda p: -p.confidence)[:k]


def _mentions(text: Column, words: list[str], match: str) -> Column:
    if match == "word":
        return text.rlike(rf"(?<![{WORD}])(?:{'|'.join(words)})(?![{WORD}])")
    return reduce(or_, [F.contains(text, F.lit(word)) for word in words])


def category_flags(name: Column, website: Column, match: str = "substring") -> tuple[Column, Column, Column]:
    """(technical, support, large) by keywords in lower(name + ' ' + website)."""
    text = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(website, F.lit(""))))
    return tuple(_mentions(text, w, match) for w in (TECHNICAL_WORDS, SUPPORT_WORDS, LARGE_WORDS))


def chosen_categories(technical: bool, support: bool, large: bool) -> list[str]:
    chosen = ["general", "business"]
    chosen += ["technical"] if technical else []
    chosen += ["support"] if support else []
    return chosen + (["hr", "marketing"] if large else [])


_ITEM = "struct<pattern:string,confidence:double,category:string,description:string>"


def _constant(value, kind: str) -> Column:
    """A nested constant; Spark folds it into a literal before anything runs."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _items(patterns: Iterable[Pattern]) -> list[dict]:
    return [
        {"pattern": p.name, "confidence": p.confidence, "category": p.category, "description": p.description}
        for p in patterns
    ]


def pattern_list(patterns: Iterable[Pattern]) -> Column:
    """A constant array of pattern structs."""
    return _constant(_items(patterns), f"array<{_ITEM}>")


def smart_list(
    technical: Column,
    support: Column,
    large: Column,
    minimum: float,
    k: int,
    confidences: Mapping[str, float] | None = None,
) -> Column:
    """Ranked pattern list of a company.

    Three flags give eight possible lists, all known beforehand, so choosing
    the top k needs neither a join nor a window: the flags form an index into
    a constant.
    """
    lists = []
    for flags in product((False, True), repeat=3):
        found = override(by_category(chosen_categories(*flags)), confidences or {})
        lists.append(_items(ranked(found, minimum, k)))
    weighted = [F.when(flag, weight).otherwise(0) for flag, weight in ((technical, 4), (support, 2), (large, 1))]
    return F.get(_constant(lists, f"array<array<{_ITEM}>>"), weighted[0] + weighted[1] + weighted[2])
