"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import decontam, divergence, url_filter, warc
from .ann import op4_nearest
from .decontam import op10_decontamination
from .divergence import op11_divergence
from .langid import op6_language_id
from .mixing import op9_mixing
from .repeats import op13_repeats
from .secret_scan import op7_secret_scan
from .simhash import op8_simhash
from .spelling import op12_spelling
from .token_count import op2_token_counts
from .token_pack import op3_token_pack
from .url_filter import op1_url_filter
from .warc import op5_warc

QUERIES = {f.__name__: f for f in (op1_url_filter, op2_token_counts, op3_token_pack, op4_nearest, op5_warc, op6_language_id, op7_secret_scan, op8_simhash, op9_mixing, op10_decontamination, op11_divergence, op12_spelling, op13_repeats)}
SQL = {"op1_url_filter": url_filter.ORACLE, "op5_warc": warc.ORACLE, "op10_decontamination": decontam.ORACLE, "op11_divergence": divergence.ORACLE}
