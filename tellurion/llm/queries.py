"""The registered queries of this subpackage: one for each operator."""

from .hilbert import op9_hilbert
from .language import op1_language
from .licenses import op6_licenses
from .mixing import op7_mixing
from .mtree import ORACLE_SQL as MTREE_SQL
from .mtree import op10_mtree
from .neardup import op2_neardup
from .packing import op3_packing
from .pages import op8_pages
from .pieces import op5_pieces
from .toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_language, op2_neardup, op3_packing, op4_toxicity, op5_pieces, op6_licenses, op7_mixing, op8_pages, op9_hilbert, op10_mtree)}

#: DuckDB SQL of those that SQL can express.
ORACLE_SQL: dict[str, str] = {"op10_mtree": MTREE_SQL}
