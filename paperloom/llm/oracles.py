"""SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

from paperloom.llm.token_budget import LANG3

_TYPE = "regexp_replace(lower(trim({0})), '[ -]+', '_', 'g')"
_CHUNKS = f"""
WITH rules AS (SELECT {_TYPE.format('source_type')} AS t, max_chunk_chars, chars_per_token_estimate AS rate FROM legal_rag_config),
latest AS (SELECT chunk_id, max_by(struct_pack(t := {_TYPE.format('source_type')}, s := estimated_tokens, n := length(text)), loaded_at) AS v FROM chunks_legal GROUP BY chunk_id)"""

_BASE = "regexp_extract(lower(trim({0})), '^([a-z]+)', 1)"
_CODES = ", ".join(f"'{a}': '{b}'" for a, b in LANG3.items())
_LANG = f"nullif(coalesce(MAP {{{{{_CODES}}}}}[{_BASE}], {_BASE}), '')"

ORACLES = {
    "p4_chunk_slices": f"""WITH rules AS (SELECT {_TYPE.format('source_type')} AS t, chars_per_token_estimate AS rate FROM legal_rag_config),
 one AS (SELECT *, {_TYPE.format('source_type')} AS t, {_LANG.format('lang')} AS l, length(text) AS n FROM chunks_legal QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) = 1),
 e AS (SELECT one.*, CASE WHEN n IS NOT NULL AND rate > 0 THEN greatest(1, ceil(n / rate)) END AS est FROM one LEFT JOIN rules USING (t))
 SELECT t AS source_type, source_year, l AS lang, count(*) AS n_chunks, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_chars, CAST(sum(coalesce(est, 0)) AS BIGINT) AS estimated_tokens, CAST(sum(coalesce(estimated_tokens, 0)) AS BIGINT) AS stored_tokens,
 count(*) FILTER (WHERE n IS NOT NULL AND est IS NOT NULL AND estimated_tokens IS DISTINCT FROM est) AS n_wrong FROM e GROUP BY ALL""",
    "p4_document_slices": f"SELECT source, {_LANG.format('lang')} AS lang, domain, count(*) AS n_docs, count(*) FILTER (WHERE coalesce(length(text), 0) = 0) AS n_empty, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars FROM documents GROUP BY ALL",
    "p5_whole": f"""WITH rules AS (SELECT {_TYPE.format('source_type')} AS t, max_chunk_chars AS most, overlap_chars AS o FROM legal_rag_config),
 one AS (SELECT *, {_TYPE.format('source_type')} AS t FROM chunks_legal QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) = 1)
 SELECT chunk_id, md5(text) AS digest, true AS within, CAST(o AS VARCHAR) AS overlaps FROM one JOIN rules USING (t) WHERE length(text) > most""",
    "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p4_found": f"""{_CHUNKS} SELECT chunk_id FROM latest JOIN rules ON rules.t = v.t
 WHERE v.n IS NOT NULL AND (v.s IS NULL OR v.s <> greatest(1, ceil(v.n / rate)))""",
    "p5_found": f"{_CHUNKS} SELECT chunk_id FROM latest JOIN rules ON rules.t = v.t WHERE v.n > max_chunk_chars",
}
