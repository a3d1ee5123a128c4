"""Arrays that were written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """array<double> of numbers in brackets, with commas, spaces or line breaks between them; null for other texts."""
    inner = F.regexp_replace(F.regexp_replace(text, r"[\[\](),]", " "), r"\s+", " ")
    parts = F.filter(F.split(F.trim(inner), " "), lambda p: p != "")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    return F.when(text.rlike(r"(?s)^\s*[\[(].*[\])]\s*$") & F.forall(numbers, lambda v: v.isNotNull()), numbers)
