"""Named queries over the test tables (``queries()``) and their DuckDB twins (``oracle_sql()``)."""

from corpuslens.plans import q_counts, q_more, q_predict, q_scores, q_stream, q_text, q_wordbias, q_worklist  # noqa: F401
from corpuslens.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
