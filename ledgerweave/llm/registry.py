"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, licenses, phrases, secrets
from .bpe import op7_bpe
from .chat import op8_chat
from .fingerprints import op2_fingerprints
from .flac import op9_flac
from .jaccard import op4_jaccard
from .langid import op10_langid
from .licenses import op1_licenses
from .packing import op3_packing
from .phrases import op12_phrases
from .pii import op5_pii
from .secrets import op6_secrets
from .slack import op13_slack
from .whitening import op11_whitening

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_fingerprints": op2_fingerprints,
    "op3_packing": op3_packing,
    "op4_jaccard": op4_jaccard,
    "op5_pii": op5_pii,
    "op6_secrets": op6_secrets,
    "op7_bpe": op7_bpe,
    "op8_chat": op8_chat,
    "op9_flac": op9_flac,
    "op10_langid": op10_langid,
    "op11_whitening": op11_whitening,
    "op12_phrases": op12_phrases,
    "op13_slack": op13_slack,
}

ORACLE_SQL: dict[str, str] = {"op1_licenses": licenses.ORACLE_SQL, "op6_secrets": secrets.ORACLE_SQL, "op8_chat": chat.ORACLE_SQL, "op12_phrases": phrases.ORACLE_SQL}
