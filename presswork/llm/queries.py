"""The queries of this subpackage by name, and their SQL where SQL can tell the result."""

from __future__ import annotations

from presswork.llm import op4_topk as _op4
from presswork.llm.op1_media import op1_media
from presswork.llm.op2_training_order import op2_training_order
from presswork.llm.op3_lines import op3_lines
from presswork.llm.op4_topk import op4_topk
from presswork.llm.op5_packing import op5_packing
from presswork.llm.op6_quality import op6_quality
from presswork.llm.op7_jaccard import op7_jaccard
from presswork.llm.op8_substring import op8_substring
from presswork.llm.op9_pii import op9_pii
from presswork.llm.op10_bpe import op10_bpe
from presswork.llm.op11_trie import op11_trie
from presswork.llm.op12_merkle import op12_merkle
from presswork.llm.op13_simhash import op13_simhash

QUERIES = {f.__name__: f for f in (op1_media, op2_training_order, op3_lines, op4_topk, op5_packing, op6_quality, op7_jaccard, op8_substring, op9_pii, op10_bpe, op11_trie, op12_merkle, op13_simhash)}
SQL: dict[str, str] = {"op4_topk": _op4.SQL}
