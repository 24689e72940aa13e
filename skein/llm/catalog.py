"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import decontamination, embedding_join, sharding, warc
from .decontamination import op3_decontamination
from .embedding_join import op8_embedding_join
from .language_id import op1_language_id
from .packing import op4_packing
from .quality import op6_quality
from .sharding import op7_sharding
from .simhash import op10_simhash
from .substring_dedup import op9_substring_dedup
from .token_records import op2_token_records
from .warc import op5_warc

QUERIES = {f.__name__: f for f in (op1_language_id, op2_token_records, op3_decontamination, op4_packing, op5_warc, op6_quality, op7_sharding, op8_embedding_join, op9_substring_dedup, op10_simhash)}
QUERIES["sharding_law"] = sharding.sharding_law  # the part of op7 that SQL can say
ORACLE_SQL = {"op3_decontamination": decontamination.ORACLE, "op5_warc": warc.ORACLE, "op8_embedding_join": embedding_join.ORACLE, "sharding_law": sharding.LAW}
