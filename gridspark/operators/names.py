"""Identifier normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(c: Column) -> Column:
    """White space and hyphens become one underscore, other characters than A-Z, a-z, 0-9 and _ go
    (before lower-casing, so letters that fold into ASCII go too), runs of underscores become one."""
    joined = F.regexp_replace(c, r"(?U)[\s-]+", "_")
    kept = F.lower(F.regexp_replace(joined, "[^A-Za-z0-9_]", ""))
    return F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^_|_$", "")
