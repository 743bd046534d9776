"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from sleuthframe.llm.decontamination import OP2_SQL, op2_decontamination
from sleuthframe.llm.language_id import op12_language_id
from sleuthframe.llm.lexical_search import OP11_SQL, op11_lexical_search
from sleuthframe.llm.main_text import op6_main_text
from sleuthframe.llm.mixing import OP9_SQL, op9_mixing
from sleuthframe.llm.nearest import op5_nearest
from sleuthframe.llm.ngram_join import OP4_SQL, op4_ngram_join
from sleuthframe.llm.pii import OP3_SQL, op3_pii
from sleuthframe.llm.resampling import OP13_SQL, op13_resampling
from sleuthframe.llm.token_counts import op7_token_counts
from sleuthframe.llm.token_files import op8_token_files
from sleuthframe.llm.toxicity import op1_toxicity
from sleuthframe.llm.warc_zip import OP10_SQL, op10_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_pii": op3_pii,
    "op4_ngram_join": op4_ngram_join,
    "op5_nearest": op5_nearest,
    "op6_main_text": op6_main_text,
    "op7_token_counts": op7_token_counts,
    "op8_token_files": op8_token_files,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
    "op11_lexical_search": op11_lexical_search,
    "op12_language_id": op12_language_id,
    "op13_resampling": op13_resampling,
}
ORACLES: dict[str, str] = {"op2_decontamination": OP2_SQL, "op3_pii": OP3_SQL, "op4_ngram_join": OP4_SQL, "op9_mixing": OP9_SQL, "op10_warc": OP10_SQL, "op11_lexical_search": OP11_SQL, "op13_resampling": OP13_SQL}
