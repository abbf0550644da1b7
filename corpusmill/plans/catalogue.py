"""All registered queries, in the order of their areas."""

from corpusmill.plans import (  # noqa: F401
    access,
    evaluation,
    maintenance,
    metrics,
    reports,
    retrieval,
    reuse,
    sources,
    text,
)
from corpusmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
