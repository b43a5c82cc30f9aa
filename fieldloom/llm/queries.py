"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm.bpe import encode_documents, token_counts
from fieldloom.llm.leaks import leaked_items, leaked_passages
from fieldloom.llm.truncation import truncated_documents, truncation_rates
from fieldloom.plans.scale import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    documents = lambda s, d: table(s, d, "documents")
    items = lambda s, d: table(s, d, "eval_items")
    return {
        "p7_ids": lambda s, d: encode_documents(documents(s, d)),
        "p7_counts": lambda s, d: token_counts(documents(s, d)),
        "p8_found": lambda s, d: leaked_items(documents(s, d), items(s, d)),
        "p8_passages": lambda s, d: leaked_passages(documents(s, d), items(s, d)),
        "p9_found": lambda s, d: truncated_documents(documents(s, d)),
        "p9_rates": lambda s, d: truncation_rates(documents(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    """Exact leaks as a join of 12-grams; the others aren't expressible in SQL, and tests compare them with brute force."""
    words = "list_transform(regexp_extract_all(nfc_normalize({0}), '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x))".replace("list_transform(", "[lower(x) for x in ").replace(", lambda x: lower(x))", "]")
    grams = "SELECT DISTINCT {1}, unnest([array_to_string(w[i:i + 11], ' ') for i in generate_series(1, len(w) - 11)]) AS g FROM (SELECT {1}, " + words + " AS w FROM {2} WHERE {0} IS NOT NULL) WHERE len(w) >= 12"
    return {"p8_found": f"WITH d AS ({grams.format('text', 'doc_id', 'documents')}), i AS ({grams.format('item_text', 'item_id', 'eval_items')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)"}
