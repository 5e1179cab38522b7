"""The corpus pipeline: ``STAGES``, ``run`` and ``ORACLE_SQL`` of ``viewgrade.llm.pipeline``."""

from viewgrade.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
