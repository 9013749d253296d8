"""From raw documents to packed sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; between stages the result is written as Parquet to the shared folder and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from geoloom.llm.pipeline import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: Hash fingerprints, trained trees and tokenizers cannot be written as SQL.
ORACLE_SQL = None
