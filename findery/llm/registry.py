"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from findery.llm.ann import op2_adaptive_ann
from findery.llm.chat import OP3_SQL, op3_chat_collapse
from findery.llm.langid import op5_language_id
from findery.llm.mixing import op7_mix_sources
from findery.llm.nearjoin import op6_ngram_jaccard_join
from findery.llm.packing import op10_best_fit_packing
from findery.llm.quality import OP4_SQL, op4_host_quality
from findery.llm.records import op8_token_records
from findery.llm.toxicity import op9_toxicity
from findery.llm.warc import OP1_SQL, op1_warc_fixity

QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_fixity,
        op2_adaptive_ann,
        op3_chat_collapse,
        op4_host_quality,
        op5_language_id,
        op6_ngram_jaccard_join,
        op7_mix_sources,
        op8_token_records,
        op9_toxicity,
        op10_best_fit_packing,
    )
}
ORACLE_SQL = {"op1_warc_fixity": OP1_SQL, "op3_chat_collapse": OP3_SQL, "op4_host_quality": OP4_SQL}
