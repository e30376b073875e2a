"""Imports every plan module; importing registers its queries."""

from riskweave.plans import feature_plans  # noqa: F401
from riskweave.plans import report_plans  # noqa: F401
from riskweave.plans import split_plans  # noqa: F401
from riskweave.plans import routing_plans  # noqa: F401
from riskweave.plans import curve_plans  # noqa: F401
from riskweave.plans import drift_plans  # noqa: F401
from riskweave.plans import window_plans  # noqa: F401
from riskweave.plans import store_plans  # noqa: F401
from riskweave.plans import io_plans  # noqa: F401
from riskweave.plans import stream_plans  # noqa: F401
from riskweave.plans import model_plans  # noqa: F401
