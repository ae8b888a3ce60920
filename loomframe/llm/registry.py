"""Queries of this subpackage and, where SQL can express them, the SQL that gives the same rows."""

from .decontaminate import OP5_SQL, op5_decontamination
from .fill_middle import OP13_SQL, op13_fill_in_middle
from .language import op1_language
from .minhash import OP3_SQL, op3_minhash
from .pieces import op2_sentencepiece
from .repeats import OP8_SQL, op8_suffix_dedup
from .sharding import OP10_SQL, op10_sharding
from .token_ids import op11_token_ids
from .topk import OP4_SQL, op4_top_k
from .toxicity import op7_toxicity
from .trie import OP12_SQL, op12_prefix_trie
from .url_filter import OP6_SQL, op6_url_filters
from .warc import OP9_SQL, op9_warc

QUERIES = {f.__name__: f for f in (op1_language, op2_sentencepiece, op3_minhash, op4_top_k, op5_decontamination, op6_url_filters, op7_toxicity, op8_suffix_dedup, op9_warc, op10_sharding, op11_token_ids, op12_prefix_trie, op13_fill_in_middle)}
ORACLE_SQL = {"op3_minhash": OP3_SQL, "op4_top_k": OP4_SQL, "op5_decontamination": OP5_SQL, "op6_url_filters": OP6_SQL, "op8_suffix_dedup": OP8_SQL, "op9_warc": OP9_SQL, "op10_sharding": OP10_SQL, "op12_prefix_trie": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
