"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import oracles
from .op1_pivots import op1_pivot_permutation
from .op2_suffix import op2_longest_previous
from .op3_anisotropic import op3_score_aware
from .op4_toxicity import op4_crf
from .op5_mixing import ORACLE as MIX_SQL
from .op5_mixing import op5_poisson
from .op6_minhash import op6_multi_index
from .op7_pieces import op7_merge_rounds
from .op8_secrets import op8_ownership
from .op9_pii import op9_disclosure
from .op10_sharding import op10_hash_tree
from .op11_runs import op11_recompression
from .op12_bytes import op12_rank_file
from .op13_manifest import op13_pointer_jumping

QUERIES = {f.__name__: f for f in (
    op1_pivot_permutation, op2_longest_previous, op3_score_aware, op4_crf, op5_poisson, op6_multi_index, op7_merge_rounds, op8_ownership, op9_disclosure, op10_hash_tree,
    op11_recompression, op12_rank_file, op13_pointer_jumping)}
ORACLE_SQL = {"op1_pivot_permutation": oracles.VECTORS, "op2_longest_previous": oracles.REPEATS, "op3_score_aware": oracles.NEAREST, "op5_poisson": MIX_SQL, "op6_multi_index": oracles.DOCUMENTS, "op8_ownership": oracles.SECRETS, "op9_disclosure": oracles.PRIVATE, "op10_hash_tree": oracles.SHARDS, "op13_pointer_jumping": oracles.MANIFEST}
