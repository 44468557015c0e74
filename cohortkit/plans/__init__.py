"""Whole analyses over a wide person table, and the registered queries."""

from cohortkit.plans.analyses import Analyses, ModelRun
from cohortkit.plans.layout import PEOPLE, VOTER_FILE, Layout

__all__ = ["PEOPLE", "VOTER_FILE", "Analyses", "Layout", "ModelRun"]
