"""Queries of this subpackage by name, and DuckDB SQL where SQL can express them."""

from .imagecopies import op5_copy_pairs, op5_local_descriptors
from .langid import op1_marginal_unigrams
from .lmscore import op2_elias_fano_trie
from .partenum import OP7_SQL, op7_partenum_join
from .pii import op3_surrogates
from .sampling import op8_sampled_pieces
from .shuffle import op4_two_pass_shuffle
from .toxicity import op9_string_kernel
from .warc import OP10_SQL, op10_capture_order, op10_index_merge
from .wumanber import OP6_SQL, op6_wu_manber

QUERIES = {
    "op1_marginal_unigrams": op1_marginal_unigrams,
    "op2_elias_fano_trie": op2_elias_fano_trie,
    "op3_surrogates": op3_surrogates,
    "op4_two_pass_shuffle": op4_two_pass_shuffle,
    "op5_local_descriptors": op5_local_descriptors,
    "op5_copy_pairs": op5_copy_pairs,
    "op6_wu_manber": op6_wu_manber,
    "op7_partenum_join": op7_partenum_join,
    "op8_sampled_pieces": op8_sampled_pieces,
    "op9_string_kernel": op9_string_kernel,
    "op10_index_merge": op10_index_merge,
    "op10_capture_order": op10_capture_order,
}

ORACLE_SQL: dict[str, str] = {
    "op6_wu_manber": OP6_SQL,
    "op7_partenum_join": OP7_SQL,
    "op10_index_merge": OP10_SQL,
}
