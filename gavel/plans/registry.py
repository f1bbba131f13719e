"""All queries of the moderation engine, with their SQL."""

from gavel.plans import model_queries, quant_queries, scale_queries, table_queries, tensor_queries, text_queries, token_queries

_PARTS = (tensor_queries, text_queries, token_queries, table_queries, scale_queries, quant_queries, model_queries)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
