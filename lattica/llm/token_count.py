"""Token counts by a compiled finite-state transducer.

The vocabulary's merges are compiled into a deterministic transducer whose
transitions carry emitted-token counts (automaton). Every text is walked
through it: texts are joined to one stream of symbols, the stream is cut into
equal chunks that run in lockstep, chunk maps of states are composed, and the
counts of documents are differences of the prefix sums over all transitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import id_and_text, map_columns, utf8
from .vocabulary import load

LIMIT = 2048


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens, over_limit) for each document, without a shuffle.

    A null text is empty and has no tokens. Null ids and repeated rows pass
    through; other columns are ignored; an empty table gives an empty result.
    The vocabulary file has to be at the same path on every executor.
    """
    docs = id_and_text(docs, id_col, text_col)
    schema = StructType([docs.schema["doc_id"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

    def make():
        vocabulary = load(vocabulary_path)

        def count(ids, texts):
            tokens = vocabulary.count(texts)
            return {"doc_id": ids, "n_bytes": [len(utf8(t)) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

        return count

    return map_columns(docs, schema, make, keeps=True)
