"""Queries of this folder and the SQL they are checked against."""

from lunario.llm.bpe import op8_transducer_bpe
from lunario.llm.chat import OP6_SQL, op6_chat_formatting
from lunario.llm.decontamination import OP4_SQL, op4_positional_index_decontamination
from lunario.llm.divergence import OP12_SQL, op12_pair_merge_divergence
from lunario.llm.toxicity import op7_levenshtein_toxicity
from lunario.llm.language import op9_rank_order_language
from lunario.llm.licenses import OP2_SQL, op2_minhash_license_scan
from lunario.llm.neighbours import op1_proximity_graph_search
from lunario.llm.packing import op11_island_packing
from lunario.llm.quality import op5_importance_resampling
from lunario.llm.records import op3_framed_records
from lunario.llm.simhash import op10_simhash_near_dedup
from lunario.llm.vector_codes import OP13_SQL, op13_adaptive_bound_codes

QUERIES = {
    "op1_proximity_graph_search": op1_proximity_graph_search,
    "op2_minhash_license_scan": op2_minhash_license_scan,
    "op3_framed_records": op3_framed_records,
    "op4_positional_index_decontamination": op4_positional_index_decontamination,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_levenshtein_toxicity": op7_levenshtein_toxicity,
    "op8_transducer_bpe": op8_transducer_bpe,
    "op9_rank_order_language": op9_rank_order_language,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_island_packing": op11_island_packing,
    "op12_pair_merge_divergence": op12_pair_merge_divergence,
    "op13_adaptive_bound_codes": op13_adaptive_bound_codes,
}

ORACLES = {
    "op2_minhash_license_scan": OP2_SQL,
    "op4_positional_index_decontamination": OP4_SQL,
    "op6_chat_formatting": OP6_SQL,
    "op12_pair_merge_divergence": OP12_SQL,
    "op13_adaptive_bound_codes": OP13_SQL,
}
