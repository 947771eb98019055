"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from gridspark.llm.align import op12_tokenizer_alignment
from gridspark.llm.chat import op1_chat_formatting
from gridspark.llm.decontamination import op3_benchmark_decontamination
from gridspark.llm.jaccard_join import op9_jaccard_join
from gridspark.llm.langid import op2_language_id
from gridspark.llm.merkle import OP11_SQL, op11_merkle_manifest
from gridspark.llm.packing import op10_nnls_packing
from gridspark.llm.quality import op5_quality_classifier
from gridspark.llm.secrets import op8_secret_scan
from gridspark.llm.simple8b import op7_simple8b
from gridspark.llm.topk import OP4_SQL, op4_exact_top_k
from gridspark.llm.url_rules import op13_url_rules
from gridspark.llm.warc import OP6_SQL, op6_warc_revisits

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_language_id,
        op3_benchmark_decontamination,
        op4_exact_top_k,
        op5_quality_classifier,
        op6_warc_revisits,
        op7_simple8b,
        op8_secret_scan,
        op9_jaccard_join,
        op10_nnls_packing,
        op11_merkle_manifest,
        op12_tokenizer_alignment,
        op13_url_rules,
    )
}

OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), t AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS every,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learn,
    CAST(3 + sum(length(text)
      + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 9 ELSE 20 + length(role) END
      + len(regexp_extract_all(text, '[\[<]\\*/?(?:INST\]|SYS\]|OUT\]|ROLE\]|TURN\]|s>)'))) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(learn) AS loss_chars, sha256(learn) AS loss_sha256,
       formatted_chars
FROM t
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'
    ), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS m FROM documents
  UNION
  SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.m) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id
"""

ORACLE = {
    "op1_chat_formatting": OP1_SQL,
    "op4_exact_top_k": OP4_SQL,
    "op6_warc_revisits": OP6_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
}
