"""From raw documents to packed training sequences: the stages, their order and their run over a folder of tables."""

from chronoframe.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, line_dedup, mixture, near_duplicates, packing, quality, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "line_dedup", "mixture", "near_duplicates", "packing", "quality", "run"]
