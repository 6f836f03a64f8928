"""All queries of the subpackage, by name."""

from . import alignment, chat_format, divergence, hilbert_ann, html_extract, line_dedup, minhash, mixing, packing, quality_classifier, quality_rules, sharding, toxicity

_MODULES = [sharding, quality_rules, packing, minhash, mixing, line_dedup, quality_classifier, hilbert_ann, html_extract, chat_format, toxicity, alignment, divergence]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
