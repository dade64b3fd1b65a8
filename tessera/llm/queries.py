"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from .bpe import op5_bpe
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .langid import op4_langid
from .media import op10_media
from .mixing import OP2_SQL, op2_mixing
from .ngram_join import OP1_SQL, op1_ngram_join
from .pii import op9_pii
from .sharding import OP3_SQL, op3_sharding
from .token_counts import op7_token_counts
from .warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_langid": op4_langid,
    "op5_bpe": op5_bpe,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_pii": op9_pii,
    "op10_media": op10_media,
}
SQL = {"op1_ngram_join": OP1_SQL, "op2_mixing": OP2_SQL, "op3_sharding": OP3_SQL, "op6_warc": OP6_SQL, "op8_exact_dedup": OP8_SQL}
