"""All named queries."""

from lunario.plans import (  # noqa: F401  (register on import)
    export_queries,
    file_queries,
    model_queries,
    panel_queries,
    regression_queries,
    run_queries,
    text_queries,
)
from lunario.plans.registry import ORACLES, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
