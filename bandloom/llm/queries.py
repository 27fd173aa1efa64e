"""The queries of the corpus operators, by name, and SQL for those that it can express."""

from .chat import op13_chat_format
from .decontaminate import op3_decontaminate
from .language_id import op8_language_id
from .line_dedup import OP7_SQL, op7_line_dedup
from .merkle import op12_merkle_manifest
from .mixing import op5_mix_sources
from .near_dedup import op4_minhash_near_dedup
from .oracle import OP2_SQL, OP3_SQL, OP4_SQL, OP10_SQL, OP11_SQL, OP12_SQL, OP13_SQL
from .secrets import op1_secret_forest
from .token_counts import op9_token_counts
from .token_files import op6_token_files
from .vector_codes import op11_vector_codes
from .vector_dedup import op10_vector_near_dedup
from .warc import op2_warc_index_merge

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_forest,
        op2_warc_index_merge,
        op3_decontaminate,
        op4_minhash_near_dedup,
        op5_mix_sources,
        op6_token_files,
        op7_line_dedup,
        op8_language_id,
        op9_token_counts,
        op10_vector_near_dedup,
        op11_vector_codes,
        op12_merkle_manifest,
        op13_chat_format,
    )
}

ORACLE_SQL = {"op2_warc_index_merge": OP2_SQL, "op3_decontaminate": OP3_SQL, "op4_minhash_near_dedup": OP4_SQL, "op7_line_dedup": OP7_SQL, "op10_vector_near_dedup": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_chat_format": OP13_SQL}
