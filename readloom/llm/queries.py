"""Queries of the operators in this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import topk, trie, warc
from .bpe import op9_bpe
from .chat import op10_chat
from .hpylm import op8_hpylm
from .langid import op4_langid
from .packing import op2_packing
from .pii import op5_pii
from .simhash import op7_simhash
from .suffixes import op11_suffixes
from .telephony import op3_telephony
from .topk import op6_topk
from .trie import op12_trie
from .warc import op1_warc
from .whitening import op13_whitening

QUERIES = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_telephony": op3_telephony,
    "op4_langid": op4_langid,
    "op5_pii": op5_pii,
    "op6_topk": op6_topk,
    "op7_simhash": op7_simhash,
    "op8_hpylm": op8_hpylm,
    "op9_bpe": op9_bpe,
    "op10_chat": op10_chat,
    "op11_suffixes": op11_suffixes,
    "op12_trie": op12_trie,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL = {"op1_warc": warc.ORACLE_SQL, "op6_topk": topk.ORACLE_SQL, "op12_trie": trie.ORACLE_SQL}
