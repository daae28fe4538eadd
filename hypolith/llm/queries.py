"""The queries of this subpackage, and their DuckDB SQL where that can express them."""

from __future__ import annotations

from hypolith.llm.op1_secrets import op1_secrets
from hypolith.llm.op10_quotes import op10_quotes
from hypolith.llm.op11_phrases import OP11_SQL, op11_phrases
from hypolith.llm.op12_pii import op12_pii
from hypolith.llm.op13_divergence import OP13_SQL, op13_divergence
from hypolith.llm.op2_quality import op2_quality
from hypolith.llm.op3_html import op3_html
from hypolith.llm.op4_minhash import op4_minhash
from hypolith.llm.op5_templates import op5_templates
from hypolith.llm.op6_fuse import OP6_SQL, op6_fuse
from hypolith.llm.op7_urls import op7_urls
from hypolith.llm.op8_packing import op8_packing
from hypolith.llm.op9_lm import op9_lm

QUERIES = {f.__name__: f for f in (op1_secrets, op2_quality, op3_html, op4_minhash, op5_templates, op6_fuse, op7_urls, op8_packing, op9_lm, op10_quotes, op11_phrases, op12_pii, op13_divergence)}
SQL = {"op6_fuse": OP6_SQL, "op11_phrases": OP11_SQL, "op13_divergence": OP13_SQL}
