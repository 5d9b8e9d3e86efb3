"""rinsework: profile, audit, clean and standardise messy tables on Spark."""

from .plans.diagnose import Diagnosis, diagnose
from .plans.optimize import CleanResult, optimize
from .plans.overrides import Overrides
from .session import Staging, local_session, ship

__all__ = [
    "CleanResult", "Diagnosis", "Overrides", "Staging", "diagnose", "local_session", "optimize", "ship",
]
