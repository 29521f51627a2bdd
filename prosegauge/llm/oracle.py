"""SQL for DuckDB of those columns of the corpus operators that SQL can express."""

from __future__ import annotations

from .licences import BASE

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Targets by filling: sources in the order of cap over weight are full as long as the rate of the rest is above that.
MIX_TARGETS = r"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS words FROM s GROUP BY source),
w AS (SELECT *, 2 * words AS cap, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM t),
o AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source) AS k FROM w),
r AS (SELECT a.k, a.cap::DOUBLE / a.weight AS ratio, ((SELECT 1.5 * sum(words) FROM t) - coalesce(sum(b.cap) FILTER (b.k < a.k), 0))::DOUBLE / sum(b.weight) FILTER (b.k >= a.k) AS rate FROM o a, o b GROUP BY a.k, a.cap, a.weight)
SELECT doc_id, size, words AS source_size, round(least(cap::DOUBLE, (SELECT arg_min(rate, k) FROM r WHERE rate <= ratio) * weight), 4) AS target FROM s JOIN w ON s.source IS NOT DISTINCT FROM w.source"""

MEDIA_PAYLOAD = """WITH b AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n FROM documents), p AS (SELECT *, CASE WHEN n = 0 THEN 64 ELSE (64 - n % 64) % 64 END AS more FROM b)
SELECT doc_id, n::BIGINT AS n_bytes, (n + more)::BIGINT AS payload_bytes, sha256(text || repeat(chr(0), more::INT)) AS payload_sha256 FROM p"""


def licence_base() -> str:
    hits = " UNION ALL ".join(
        f"SELECT doc_id, pos, '{label}' AS label FROM n WHERE " + " AND ".join(f"w{i} = '{x}'" if i else f"word = '{x}'" for i, x in enumerate(phrase.split())) for phrase, label in BASE.items()
    )
    return rf"""WITH l AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos FROM l), n AS (SELECT *, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), h AS ({hits}),
g AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM l LEFT JOIN g USING (doc_id)"""


ORACLE_SQL = {"mix_targets": MIX_TARGETS, "media_payload": MEDIA_PAYLOAD, "licence_base": licence_base()}
