"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import functools

from .bpe import op8_bpe
from .common import ship
from .decontamination import op1_decontamination
from .hmm import op3_hmm
from .near_dedup import op10_near_dedup
from .pii import op6_pii
from .quality import op2_quality
from .sharding import op7_sharding
from .sql import ORACLE_SQL as ORACLE_SQL
from .substring import op5_substring
from .url_filter import op4_url_filter
from .wrapper import op9_wrapper


def _shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {q.__name__: _shipped(q) for q in (op1_decontamination, op2_quality, op3_hmm, op4_url_filter, op5_substring, op6_pii, op7_sharding, op8_bpe, op9_wrapper, op10_near_dedup)}
