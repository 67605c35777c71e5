"""All queries of the subpackage."""

from . import (  # noqa: F401  (registration side effects)
    q_chat, q_conversations, q_decontaminate, q_licenses, q_lm, q_minhash, q_packing, q_periodic, q_sharding, q_simhash,
    q_suffix, q_topk, q_toxicity)
from .registry import ORACLE, QUERIES  # noqa: F401
