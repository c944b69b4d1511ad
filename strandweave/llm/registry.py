"""The registered queries of the training-data operators, and their SQL where there is any."""

from .chatformat import OP6_SQL, op6_chatformat
from .decontam import OP5_SQL, op5_decontam
from .fingerprint import op7_fingerprint
from .htmltext import op2_htmltext
from .langid import op4_langid
from .neardup import OP1_SQL, op1_neardup
from .packing import op8_packing
from .quality import op3_quality
from .sharding import op10_sharding
from .tokencount import op9_tokencount

QUERIES = {
    f.__name__: f
    for f in (
        op1_neardup, op2_htmltext, op3_quality, op4_langid, op5_decontam,
        op6_chatformat, op7_fingerprint, op8_packing, op9_tokencount, op10_sharding,
    )
}

#: The others hold checksums, models or hashes that DuckDB's SQL has no function for; tests hold
#: them against brute force.
ORACLES = {"op1_neardup": OP1_SQL, "op5_decontam": OP5_SQL, "op6_chatformat": OP6_SQL}
