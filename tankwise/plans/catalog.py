"""Imports every registered-job module so the registry is complete."""

from tankwise.plans import q_views  # noqa: F401
from tankwise.plans import q_features  # noqa: F401
from tankwise.plans import q_patterns  # noqa: F401
from tankwise.plans import q_anomaly  # noqa: F401
from tankwise.plans import q_insights  # noqa: F401
from tankwise.plans import q_sources  # noqa: F401
from tankwise.plans import q_ml  # noqa: F401
from tankwise.plans import q_streaming  # noqa: F401
