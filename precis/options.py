"""All tunables in one frozen dataclass; every operator takes them as arguments.

The reference reads these from environment variables without shipping values; the
defaults below are ours, except where a literal appears in the reference code
(500-word cap, > 2 sentences, > 10 characters per sentence piece, 1,000,000 rows per
chunk, 32,000 validation rows, batch 128, candidate threshold 0.3, vocabulary 16,000,
sentence sample 800,000).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Options:
    # cleaning / length filters
    max_words: int = 500
    min_sentences: int = 3          # keep docs with more than 2 sentences
    min_piece_chars: int = 11       # keep dot pieces whose stripped length is > 10
    # gap-sentence generation
    gsg_rate: float = 0.3
    return_mask_rate: float = 0.2
    gsg_mode: str = "with_replacement"  # or "all"
    seed: int = 42
    abbreviations: tuple = ()      # words whose trailing dot does not end a sentence
    # encoding
    model_max_length: int = 512
    max_summary_length: int = 128
    vocab_size: int = 16_000
    sentence_sample: int = 800_000
    # packing
    rows_per_file: int = 1_000_000
    rows_per_shard: int = 10_000
    val_size: int = 32_000
    batch_size: int = 128
    # scoring
    candidate_threshold: float = 0.3
    num_candidates: int = 4
    # physical knobs
    index_buckets: int = 0          # 0 -> spark.sql.shuffle.partitions
    extra: dict = field(default_factory=dict)


DEFAULT = Options()
