"""The subpackage's queries and their SQL."""

from __future__ import annotations

from halyard.llm.chat import SQL as CHAT_SQL
from halyard.llm.chat import op12_chat_format
from halyard.llm.exact_dedup import SQL as EXACT_SQL
from halyard.llm.exact_dedup import op8_exact_dedup
from halyard.llm.filter_audit import SQL as AUDIT_SQL
from halyard.llm.filter_audit import op11_filter_audit
from halyard.llm.html_text import op9_html_extract
from halyard.llm.line_dedup import op3_line_dedup
from halyard.llm.manifest import SQL as MANIFEST_SQL
from halyard.llm.manifest import op13_merkle_manifest
from halyard.llm.media import op2_media_columns
from halyard.llm.mixing import op1_mix_sources
from halyard.llm.packing import op10_pack
from halyard.llm.pii import op6_pii
from halyard.llm.simhash import op4_simhash
from halyard.llm.suffix_dedup import op5_suffix_dedup
from halyard.llm.toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_media_columns, op3_line_dedup, op4_simhash, op5_suffix_dedup, op6_pii, op7_toxicity, op8_exact_dedup, op9_html_extract, op10_pack, op11_filter_audit, op12_chat_format, op13_merkle_manifest)}

#: The others depend on hashes, models or layouts that SQL can't express. tests/llm holds 1 to 5, 9 and 10 and the fixed patterns of 6 against brute
#: force, and the spans that 6 adds and the grades of 7 against data held out.
ORACLES = {"op8_exact_dedup": EXACT_SQL, "op11_filter_audit": AUDIT_SQL, "op12_chat_format": CHAT_SQL, "op13_merkle_manifest": MANIFEST_SQL}
