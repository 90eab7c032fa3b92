"""Training-data operators: deduplication, packing, tokens, scoring, search.

Nothing outside this folder imports it.  ``queries()`` and ``oracle_sql()``
list what the driver entry registers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The ``opN_<name>`` queries of the operators in this subpackage."""
    from pricelake.llm import registry

    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those queries that SQL can express."""
    from pricelake.llm import registry

    return registry.ORACLES
