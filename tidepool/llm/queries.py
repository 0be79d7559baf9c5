"""Registered queries of the training-data operators and their SQL."""

from tidepool.llm.decontaminate import OP10_SQL, op10_decontaminate
from tidepool.llm.embedding_dedup import op5_embedding_dedup
from tidepool.llm.exact_dedup import OP12_SQL, op12_exact_dedup
from tidepool.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from tidepool.llm.language_id import op2_language_id
from tidepool.llm.lm_score import op8_lm_scoring
from tidepool.llm.minhash_dedup import op7_minhash_dedup
from tidepool.llm.packing import op3_best_fit_packing
from tidepool.llm.quality_classifier import op6_quality_classifier
from tidepool.llm.secret_scan import op4_secret_scans
from tidepool.llm.url_filter import OP1_SQL, op1_url_filters
from tidepool.llm.vector_codes import OP13_SQL, op13_vector_codes
from tidepool.llm.warc_zip import op9_warc_zip

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_secret_scans": op4_secret_scans,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_warc_zip": op9_warc_zip,
    "op10_decontaminate": op10_decontaminate,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_vector_codes": op13_vector_codes,
}

SQL = {"op1_url_filters": OP1_SQL, "op10_decontaminate": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_vector_codes": OP13_SQL}
