"""The queries of this subpackage; importing the modules registers them."""

from logtarn.llm import (  # noqa: F401
    importance,
    linedup,
    merkle,
    pii,
    raking,
    repetition,
    secrets,
    simhash,
    substrings,
    toxicity,
    urls,
    vafile,
    winnowing,
)
from logtarn.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
