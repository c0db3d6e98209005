"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .byte_bpe import op13_byte_bpe
from .exact_dedup import ORACLE_OP4, op4_exact_dedup
from .licenses import op6_licenses
from .merkle import ORACLE_OP11, op11_merkle
from .mixing import ORACLE_OP1, op1_mixing
from .nearest import op9_nearest
from .pieces import op3_pieces
from .quality import op5_quality
from .resample import ORACLE_OP12, op12_resample
from .secrets import op7_secrets
from .simhash import op8_simhash
from .toxicity import op2_toxicity
from .warc import ORACLE_OP10, op10_warc

QUERIES = {f.__name__: f for f in (op1_mixing, op2_toxicity, op3_pieces, op4_exact_dedup, op5_quality, op6_licenses, op7_secrets, op8_simhash, op9_nearest, op10_warc, op11_merkle, op12_resample, op13_byte_bpe)} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op1_mixing": ORACLE_OP1, "op4_exact_dedup": ORACLE_OP4, "op10_warc": ORACLE_OP10, "op11_merkle": ORACLE_OP11, "op12_resample": ORACLE_OP12} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
