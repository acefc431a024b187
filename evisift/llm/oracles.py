"""SQL of the registered queries that SQL can express, on the same tables."""

ORACLES: dict[str, str] = {}

ORACLES["op5_url_filter"] = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, rest, length(regexp_extract(rest, '^[^/?#]*')) AS n FROM parts
), named AS (
  SELECT page_id,
    translate(substr(rest, 1, n), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, n + 1), '^[^?#]*') AS path
  FROM split
), rules(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT page_id, host, path,
  (SELECT max_by(rhost || rpath, length(rhost || rpath)) FROM rules
    WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  coalesce((SELECT max_by(verdict, length(rhost || rpath)) FROM rules
    WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM named
"""

ORACLES["op9_chat_format"] = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
      + len(regexp_extract_all(text, '\[/?INST\]|<</?SYS>>|</?s>|<\|role\|>|<\|text\|>|<\|end\|>')) AS body,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6
      ELSE 23 + length(role) + length(role) - length(replace(role, '\', ''))
        + len(regexp_extract_all(role, '\[/?INST\]|<</?SYS>>|</?s>|<\|role\|>|<\|text\|>|<\|end\|>')) END AS marks
  FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(body + marks)::BIGINT AS formatted_chars, 0::BIGINT AS rewritten_turns
FROM sized GROUP BY conv_id
"""


def _codebook_rounds(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """SQL of ``op12_vector_codes``: each round is a full search and an exact floor of the mean."""
    ctes = [f"""kept AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
)""", f"""pts AS MATERIALIZED (
  SELECT r, p.part, v[p.part * len(v) // {parts} + 1 : (p.part + 1) * len(v) // {parts}] AS x
  FROM kept, (SELECT unnest(range({parts})) AS part) p
)""", f"""book0 AS MATERIALIZED (
  SELECT part, r - 1 AS entry, x AS c FROM pts WHERE r <= {entries}
)"""]
    for k in range(rounds + 1):
        ctes.append(f"""near{k} AS MATERIALIZED (
  SELECT r, part, best.d AS d, best.e AS entry FROM (
    SELECT r, part, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': entry}}) AS best
    FROM pts JOIN book{k} USING (part) GROUP BY r, part
  )
)""")
        if k < rounds:
            ctes.append(f"""sums{k} AS MATERIALIZED (
  SELECT part, entry, list((s - (s % n + n) % n) // n ORDER BY i) AS c FROM (
    SELECT part, entry, i, sum(xi)::HUGEINT AS s, count(*) AS n
    FROM (SELECT part, entry, unnest(x) AS xi, generate_subscripts(x, 1) AS i FROM pts JOIN near{k} USING (r, part))
    GROUP BY part, entry, i
  ) GROUP BY part, entry
), book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(s.c::BIGINT[], b.c) AS c FROM book{k} b LEFT JOIN sums{k} s USING (part, entry)
)""")
    return "WITH " + ", ".join(ctes) + f"""
, coded AS (
  SELECT r, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""


ORACLES["op12_vector_codes"] = _codebook_rounds()
