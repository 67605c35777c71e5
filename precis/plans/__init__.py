"""Corpus pipelines and the registry of named queries with their SQL oracles."""

from . import q_clean, q_eval, q_gsg, q_order, q_punkt, q_vocab  # noqa: F401  (registration side effects)
from .registry import ORACLE, QUERIES  # noqa: F401
