"""Imports every query module, so that the registry is complete."""

from dunlin.plans.registry import ORACLES, QUERIES  # noqa: F401
from dunlin.plans import q_allocation, q_diagnosis, q_functions, q_ingest, q_measure, q_models, q_rules, q_state, q_streaming  # noqa: F401
