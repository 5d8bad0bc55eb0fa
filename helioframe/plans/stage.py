"""Per-sample table: phases of derived columns, assembled on (day, bin) and masked by quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import missing_report

KEYS = ["day", "bin"]


def assemble(flags: DataFrame, phases: dict[str, DataFrame], flag: str = "flag") -> DataFrame:
    """Outer join of phase tables on (day, bin); a column name already taken gets the phase as prefix;
    values of rows that are not GOOD become NULL.

    All phases are partitioned by day already, so each join is a sort-merge on co-located days.
    """
    taken: set[str] = set()
    out = flags.select(*KEYS, flag)
    for name, phase in phases.items():
        renamed = {c: f"{name}_{c}" for c in phase.columns if c not in KEYS and c in taken}
        phase = phase.withColumnsRenamed(renamed)
        taken |= {c for c in phase.columns if c not in KEYS}
        out = out.join(phase, KEYS, "full")
    good = F.coalesce(F.col(flag) == 0, F.lit(False))
    return out.select(*KEYS, flag, *[F.when(good, F.col(c)).alias(c) for c in out.columns if c not in (*KEYS, flag)])


def missing_by_column(matrix: DataFrame, flag: str = "flag") -> DataFrame:
    """Share of missing values per assembled column, one pass."""
    return missing_report(matrix, [c for c in matrix.columns if c not in (*KEYS, flag)])
