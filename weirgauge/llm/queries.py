"""All queries of the text operators."""

from weirgauge.llm import embedding_dedup, importance, line_dedup, lm_scoring, mixing, ngram_join, packing, quality_rules, secret_scan, sharding, suffix_dedup, token_counts, whitening  # noqa: F401
from weirgauge.llm.common import ORACLES, QUERIES  # noqa: F401
