"""The corpus pipeline of ``lodestone.llm.pipeline``: its stages, its run, and its SQL."""

from lodestone.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
