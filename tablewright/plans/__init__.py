"""Registered queries: every operator bound to the shared tables, with equivalent SQL."""

from tablewright.plans import (  # noqa: F401
    association_plans,
    error_plans,
    evaluation_plans,
    feature_plans,
    model_plans,
    profile_plans,
    run_plans,
    split_plans,
    text_plans,
)
from tablewright.plans.base import REGISTRY, Plan

__all__ = ["REGISTRY", "Plan"]
