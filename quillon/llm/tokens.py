"""Token counts that stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_tokens(text: str = "text") -> Column:
    """How many runs of characters other than ASCII white space the text has; 0 for a null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \\t\\n\\f\\r]+")), F.lit(0)).cast("long")
