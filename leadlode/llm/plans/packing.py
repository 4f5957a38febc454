"""op7: all documents packed into sequences of 2048 tokens."""

from __future__ import annotations

from leadlode.llm.common import documents
from leadlode.llm.packing import pack

VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op7_pack(spark, folder):
    return pack(documents(spark, folder), vocabulary())


QUERIES = {"op7_pack": op7_pack}
SQL = {}
