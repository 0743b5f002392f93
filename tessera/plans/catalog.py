"""Imports every catalogue module so that the registry is complete."""

from . import (q_attributes, q_evaluate, q_exact, q_fingerprint, q_pairs, q_runs, q_textruns,  # noqa: F401
               q_rows, q_search, q_sources, q_tokens, q_vectors)
from .registry import ORACLES, QUERIES  # noqa: F401
