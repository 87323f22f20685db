"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from tapeworks.llm.op1_quality_rules import op1_quality_rules
from tapeworks.llm.op2_html_extraction import op2_html_extraction
from tapeworks.llm.op3_jaccard_join import OP3_SQL, op3_jaccard_join
from tapeworks.llm.op4_quality_classifier import op4_quality_classifier
from tapeworks.llm.op5_url_filters import op5_url_filters
from tapeworks.llm.op6_warc import OP6_SQL, op6_warc
from tapeworks.llm.op7_substring_dedup import OP7_SQL, op7_substring_dedup
from tapeworks.llm.op8_sentencepiece import op8_sentencepiece
from tapeworks.llm.op9_sharding import op9_sharding
from tapeworks.llm.op10_decontamination import OP10_SQL, op10_decontamination
from tapeworks.llm.op11_bpe import op11_bpe
from tapeworks.llm.op12_periodic_runs import op12_periodic_runs
from tapeworks.llm.op13_lexical_search import OP13_SQL, op13_lexical_search

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_extraction": op2_html_extraction,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_url_filters": op5_url_filters,
    "op6_warc": op6_warc,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_bpe": op11_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_lexical_search": op13_lexical_search,
}
SQL: dict[str, str] = {
    "op3_jaccard_join": OP3_SQL,
    "op6_warc": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op10_decontamination": OP10_SQL,
    "op13_lexical_search": OP13_SQL,
}
