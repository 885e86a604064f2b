"""The queries of this subpackage for the driver's registry, with SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tilewright.llm.chat_format import ORACLE_SQL as CHAT_SQL
from tilewright.llm.chat_format import op9_chat_format
from tilewright.llm.decontaminate import op2_decontaminate
from tilewright.llm.html_text import op5_html_text
from tilewright.llm.language_id import op3_language_id
from tilewright.llm.mixing import op7_mixing
from tilewright.llm.revisits import ORACLE_SQL as REVISIT_SQL
from tilewright.llm.revisits import op6_warc_revisits
from tilewright.llm.secrets import op10_secret_scan
from tilewright.llm.simhash_dedup import op8_simhash_dedup
from tilewright.llm.url_filter import op1_url_filter
from tilewright.llm.winnowing import op4_winnowing

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_id": op3_language_id,
    "op4_winnowing": op4_winnowing,
    "op5_html_text": op5_html_text,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_mixing": op7_mixing,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op9_chat_format": op9_chat_format,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op6_warc_revisits": REVISIT_SQL, "op9_chat_format": CHAT_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
