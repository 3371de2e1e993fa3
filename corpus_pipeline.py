"""The corpus pipeline: stages over the documents, in order."""

from ordinate.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
