"""All registered queries of the library and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import book_queries, factor_queries, panel_queries, research_queries

_MODULES = [factor_queries, panel_queries, book_queries, research_queries]
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import evaluation, factors, transforms
    from .sources import panel

    d = panel.returns(spark, sf_dir, weekly=True)
    signal = factors.compute(d, ["STR_1W"])
    signal = transforms.zscore(transforms.winsorize(transforms.handle_missing(signal, "STR_1W"), "STR_1W"), "STR_1W")
    return evaluation.ic_series(signal.join(evaluation.forward_returns(d, (1,)).select("date", "ticker", "fwd_1"), ["date", "ticker"]), "STR_1W", "fwd_1")
