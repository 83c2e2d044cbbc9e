"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import fim, mixing, prefix_trie, vafile
from .ann import op5_ann
from .decontaminate import op10_decontaminate
from .fim import op13_fim
from .html_text import op2_html
from .langid import op1_langid
from .mixing import op8_mix
from .pii import op4_pii
from .prefix_trie import op11_prefixes
from .sharding import op7_shard
from .simhash import op6_simhash
from .substrings import op3_substrings
from .toxicity import op9_toxicity
from .vafile import op12_topk

QUERIES = {f.__name__: f for f in (op1_langid, op2_html, op3_substrings, op4_pii, op5_ann, op6_simhash, op7_shard, op8_mix, op9_toxicity, op10_decontaminate, op11_prefixes, op12_topk, op13_fim)}
ORACLES: dict[str, str] = {"op8_mix": mixing.SQL, "op11_prefixes": prefix_trie.SQL, "op12_topk": vafile.SQL, "op13_fim": fim.SQL}
