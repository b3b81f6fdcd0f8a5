"""The document pipeline: stages that each take and return the documents table."""

from __future__ import annotations

from corpusloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["STAGES", "run", "ORACLE_SQL"]
