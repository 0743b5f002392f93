"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import (q_byte_bpe, q_classify, q_decontaminate, q_dedup, q_divergence, q_fill_in_middle,  # noqa: F401
               q_lines, q_minhash, q_mix, q_rules, q_url)
from .registry import ORACLES, QUERIES, register

register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
