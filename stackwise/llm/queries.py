"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import op01_minhash_dedup as op01
from . import op02_exact_dedup as op02
from . import op03_packing as op03
from . import op04_topk_search as op04
from . import op05_sharding as op05
from . import op06_token_counts as op06
from . import op07_repeat_removal as op07
from . import op08_quality as op08
from . import op09_mixing as op09
from . import op10_url_filter as op10


def queries() -> dict:
    return {
        "op1_minhash_dedup": op01.op1_minhash_dedup,
        "op2_exact_dedup": op02.op2_exact_dedup,
        "op3_packing": op03.op3_packing,
        "op4_topk_search": op04.op4_topk_search,
        "op5_sharding": op05.op5_sharding,
        "op6_token_counts": op06.op6_token_counts,
        "op7_repeat_removal": op07.op7_repeat_removal,
        "op8_quality": op08.op8_quality,
        "op9_mixing": op09.op9_mixing,
        "op10_url_filter": op10.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    """Operators without an entry are tested against brute force instead."""
    return {
        "op2_exact_dedup": op02.ORACLE,
        "op4_topk_search": op04.ORACLE,
        "op9_mixing": op09.ORACLE,
        "op10_url_filter": op10.ORACLE,
    }
