"""Queries of the general data-pipeline operators."""

from talkmill.operators import rejects, timestamps
from talkmill.plans.sql_general import ORACLES

QUERIES = {
    "p6_found": timestamps.p6_found,
    "p6_chosen": timestamps.p6_chosen,
    "p7_found": rejects.p7_found,
    "p7_loaded": rejects.p7_loaded,
    "p7_files": rejects.p7_files,
}

__all__ = ["ORACLES", "QUERIES"]
