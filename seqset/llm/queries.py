"""The registered queries of this folder, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from seqset.llm.codes import OP13_SQL, op13_grid_codes
from seqset.llm.katz import op9_katz_lm
from seqset.llm.mixing import op6_mix_sainte_lague
from seqset.llm.nearest import OP10_SQL, op10_pivot_topk
from seqset.llm.packing import op5_pack_bfd
from seqset.llm.partenum import op11_partenum_join
from seqset.llm.preference import OP3_SQL, op3_preference_format
from seqset.llm.quality import op2_compression_bands
from seqset.llm.repair import OP12_SQL, op12_dawg_repair
from seqset.llm.secrets import op8_secret_markov
from seqset.llm.sharding import op7_shard_splitters
from seqset.llm.simhash import op1_simhash_vp
from seqset.llm.toxicity import op4_toxicity_cnn

QUERIES = {
    "op1_simhash_vp": op1_simhash_vp,
    "op2_compression_bands": op2_compression_bands,
    "op3_preference_format": op3_preference_format,
    "op4_toxicity_cnn": op4_toxicity_cnn,
    "op5_pack_bfd": op5_pack_bfd,
    "op6_mix_sainte_lague": op6_mix_sainte_lague,
    "op7_shard_splitters": op7_shard_splitters,
    "op8_secret_markov": op8_secret_markov,
    "op9_katz_lm": op9_katz_lm,
    "op10_pivot_topk": op10_pivot_topk,
    "op11_partenum_join": op11_partenum_join,
    "op12_dawg_repair": op12_dawg_repair,
    "op13_grid_codes": op13_grid_codes,
}

SQL = {"op3_preference_format": OP3_SQL, "op10_pivot_topk": OP10_SQL, "op12_dawg_repair": OP12_SQL, "op13_grid_codes": OP13_SQL}
