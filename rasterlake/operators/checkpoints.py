"""What a checkpoint leaves behind in a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Digits (of two) of an estimated size from which on it is forgotten.
ESTIMATE = 512


def plain(df: DataFrame, most: int = ESTIMATE) -> DataFrame:
    """A checkpointed df without its estimated size if that has become a very long number.

    A checkpoint cuts the plan but keeps its estimate, and a join's estimate is the product of its sides'. So in rounds of
    joins its digits multiply with each round, up to hundreds of megabytes in the driver, and then an overflow.
    """
    plan = df._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes().bit_length() <= most:
        return df
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(plan.toRdd(), df._jdf.schema(), False), session)
