"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, filter_audit, url_filter
from .bpe import op4_bpe
from .exact_dedup import op9_exact_dedup
from .filter_audit import op11_filter_audit
from .hmm import op10_hmm_score
from .html_text import op7_html_text
from .langid import op3_language_id
from .licenses import op2_license_scan
from .neighbours import op1_neighbours
from .packing import op8_packing
from .pii import op6_pii
from .simhash import op5_simhash
from .url_filter import op12_url_filter
from .whitening import op13_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_neighbours, op2_license_scan, op3_language_id, op4_bpe, op5_simhash, op6_pii, op7_html_text, op8_packing,
        op9_exact_dedup, op10_hmm_score, op11_filter_audit, op12_url_filter, op13_whitening,
    )
}
ORACLES = {"op9_exact_dedup": exact_dedup.SQL, "op11_filter_audit": filter_audit.SQL, "op12_url_filter": url_filter.SQL}
