"""Imports every query module so that the registry is complete."""

from . import q_catalog, q_causal, q_detect, q_learning, q_match, q_pipeline, q_reports, q_rolling, q_scalar, q_spectra, q_stream, q_timed, q_windows  # noqa: F401, I001
from . import q_interpretation, q_master  # noqa: F401  (made of the others)
from .registry import ORACLES, QUERIES  # noqa: F401
