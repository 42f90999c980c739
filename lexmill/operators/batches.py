"""How much goes to a Python worker at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Most rows, and about how many bytes: texts can be long, and a worker holds a batch more than once.
ROWS = 1024
BYTES = 8 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df; from now on the session sends Python workers at most ROWS rows and about BYTES bytes at once, whatever the size of the input.

    Spark reads both settings when a plan runs, which is after this returns, so they stay; settings that are lower are kept.
    """
    conf = df.sparkSession.conf
    for name, most in ((_ROWS, ROWS), (_BYTES, BYTES)):
        given = conf.get(name, None)
        if not (given and given.isdigit() and 0 < int(given) <= most):
            conf.set(name, str(most))
    return df
