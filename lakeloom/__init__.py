"""lakeloom: table-pipeline operators expressed as Spark DataFrame transformations.

Every operator is a plain function ``fn(df, ...) -> DataFrame`` (or a ``Split``
/ ``dict`` of DataFrames for operators with reject or branch outputs), so
Catalyst sees one logical plan for a whole chain and can push filters and
projections to the scan, pick join strategies and re-plan adaptively.
"""

from lakeloom.core import Split, split_by, with_result, col_list
from lakeloom.session import build_session

__all__ = ["Split", "split_by", "with_result", "col_list", "build_session"]
