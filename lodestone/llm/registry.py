"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .backoff import op7_backoff
from .codes import op13_codes
from .decontaminate import op3_decontaminate
from .embeddings import op8_embeddings
from .jaccard import op5_jaccard
from .langid import op1_language
from .packing import op9_pack
from .pii import op10_pii
from .quality import op2_quality
from .partitions import op11_partitions
from .repeats import op4_repeats
from .tree import op12_tree
from .warc import op6_warc
from .sql import SQL  # noqa: F401

QUERIES = {
    "op1_language": op1_language,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_repeats": op4_repeats,
    "op5_jaccard": op5_jaccard,
    "op6_warc": op6_warc,
    "op7_backoff": op7_backoff,
    "op8_embeddings": op8_embeddings,
    "op9_pack": op9_pack,
    "op10_pii": op10_pii,
    "op11_partitions": op11_partitions,
    "op12_tree": op12_tree,
    "op13_codes": op13_codes,
}
