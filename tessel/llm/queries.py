"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from .bpe import op3_bpe
from .fertility import op7_quality
from .interactions import OP12_SQL, op12_filter_audit
from .language import op10_language
from .lines import OP6_SQL, op6_line_dedup
from .media import op8_media
from .mixing import OP4_SQL, op4_mixing
from .neighbours import op11_neighbours
from .repair import op13_repair
from .secrets import op2_secrets
from .simhash import op9_simhash
from .substrings import op1_substrings
from .toxicity import op5_toxicity

QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_secrets": op2_secrets,
    "op3_bpe": op3_bpe,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_media": op8_media,
    "op9_simhash": op9_simhash,
    "op10_language": op10_language,
    "op11_neighbours": op11_neighbours,
    "op12_filter_audit": op12_filter_audit,
    "op13_repair": op13_repair,
}
ORACLE = {"op4_mixing": OP4_SQL, "op6_line_dedup": OP6_SQL, "op12_filter_audit": OP12_SQL}
