"""The queries of this subpackage by name, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from terralens.llm.chat_format import ORACLE_SQL as CHAT_SQL
from terralens.llm.chat_format import op3_chat_format
from terralens.llm.collocations import ORACLE_SQL as COLLOCATIONS_SQL
from terralens.llm.collocations import op11_collocations
from terralens.llm.decontam import op7_decontamination
from terralens.llm.fm_toxicity import op9_toxicity
from terralens.llm.forced_bpe import op6_forced_bpe
from terralens.llm.host_rules import ORACLE_SQL as HOST_SQL
from terralens.llm.host_rules import op5_host_rules
from terralens.llm.katz import op8_katz
from terralens.llm.merkle import ORACLE_SQL as MERKLE_SQL
from terralens.llm.merkle import op12_merkle_manifest
from terralens.llm.ngram_jaccard import ORACLE_SQL as JACCARD_SQL
from terralens.llm.ngram_jaccard import op2_ngram_jaccard
from terralens.llm.passage_mil import op13_passage_quality
from terralens.llm.pii import ORACLE_SQL as PII_SQL
from terralens.llm.pii import op10_pii
from terralens.llm.secret_scan import ORACLE_SQL as SECRETS_SQL
from terralens.llm.secret_scan import op1_secret_scan
from terralens.llm.sst import op4_token_shards

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_chat_format": op3_chat_format,
    "op4_token_shards": op4_token_shards,
    "op5_host_rules": op5_host_rules,
    "op6_forced_bpe": op6_forced_bpe,
    "op7_decontamination": op7_decontamination,
    "op8_katz": op8_katz,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_collocations": op11_collocations,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_passage_quality": op13_passage_quality,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": SECRETS_SQL,
    "op2_ngram_jaccard": JACCARD_SQL,
    "op3_chat_format": CHAT_SQL,
    "op5_host_rules": HOST_SQL,
    "op10_pii": PII_SQL,
    "op11_collocations": COLLOCATIONS_SQL,
    "op12_merkle_manifest": MERKLE_SQL,
}
