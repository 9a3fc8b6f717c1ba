"""The one place where outside batch code (a model, an observer) plugs in."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def score_with(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    keys: list[str],
) -> DataFrame:
    """Run ``fn`` on Arrow batches; a failing row becomes an error row.

    ``fn`` returns the columns of ``schema``, one row per row it gets, in their
    order. The result has ``keys`` (taken from the input) first, then ``schema``
    and ``error``. A failing batch is halved
    until the bad rows are found, so one bad row costs no other row its result. Call it after
    ``distinct`` or a semi join: Spark does not move those below the hook.
    """
    out = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    full = T.StructType(
        [df.schema[k] for k in keys]
        + [f for f in out.fields if f.name not in keys]
        + [T.StructField("error", T.StringType())]
    )
    names = full.names

    columns = [f.name for f in out.fields if f.name not in keys]

    def results(rows: pd.DataFrame, offset: int, good: list, errors: dict, known_bad: bool = False) -> bool:
        """Collect results of ``rows`` in order; False when one of them failed.

        ``known_bad``: they must hold a bad row, so they are halved without a try.
        """
        if not known_bad or len(rows) == 1:
            try:
                got = fn(rows)
                if len(got) != len(rows):
                    raise ValueError(f"{len(got)} results for {len(rows)} rows")
                good.append(got[columns])
                return True
            except Exception as problem:
                if len(rows) == 1:
                    errors[offset] = f"{type(problem).__name__}: {problem}"
                    return False
        middle = len(rows) // 2
        left = results(rows.iloc[:middle], offset, good, errors)
        right = results(rows.iloc[middle:], offset + middle, good, errors, known_bad=left)
        return left and right

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Pieces are put together once per batch, however many were tried.
            good, errors = [], {}
            results(batch, 0, good, errors)
            fine = batch[keys].reset_index(drop=True).drop(index=list(errors))
            if good:
                values = pd.concat(good, ignore_index=True).set_index(fine.index)
                yield pd.concat([fine, values], axis=1).assign(error=None)[names]
            if errors:
                failed = batch[keys].iloc[list(errors)]
                yield failed.assign(error=list(errors.values())).reindex(columns=names)

    return df.mapInPandas(run, full)
