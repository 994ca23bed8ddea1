"""Equivalent SQL of the training-data queries that SQL can express."""

from __future__ import annotations

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Codebooks by plain rounds: every part against every entry, then floor of the mean."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
    far{k} AS (SELECT x.rid, x.part, c.entry, sum((x.val - c.val) * (x.val - c.val)) AS d
             FROM x JOIN book{k} c USING (part, pos) GROUP BY ALL),
    near{k} AS (SELECT rid, part, entry, d FROM far{k} QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) = 1)""")
        if k < rounds:
            steps.append(f"""
    mean{k} AS (SELECT part, entry, pos, floor(sum(val) / count(*))::BIGINT AS val FROM x JOIN near{k} USING (rid, part) GROUP BY ALL),
    book{k + 1} AS (SELECT part, entry, pos, coalesce(m.val, b.val) AS val FROM book{k} b LEFT JOIN mean{k} m USING (part, entry, pos))""")
    return f"""WITH kept AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    comp AS (SELECT rid, unnest(list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT)) AS val,
                    generate_subscripts(embedding, 1) - 1 AS spot, len(embedding) // {parts} AS width FROM kept),
    x AS (SELECT rid, spot // width AS part, spot % width AS pos, val FROM comp),
    book0 AS (SELECT part, rid AS entry, pos, val FROM x WHERE rid < {entries}),{",".join(steps)},
    digest AS (SELECT sha256(string_agg(val::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{rounds}),
    coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY rid)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
    FROM kept JOIN coded USING (rid) CROSS JOIN digest"""


def lexical_search(top: int = 50) -> str:
    """Every score of every item and document that share a term."""
    lower = f"translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}')"
    split = f"list_filter(string_split_regex({lower}, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda t: t <> '')"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {split} AS terms FROM documents),
    whole AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS total FROM docs),
    counts AS (SELECT r, doc_id, n, term, count(*) AS times FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) GROUP BY ALL),
    items AS (SELECT row_number() OVER () AS q, item_id, {split} AS terms FROM benchmark),
    asked AS (SELECT DISTINCT q, item_id, unnest(terms) AS term FROM items),
    weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, whole GROUP BY term, docs),
    scores AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * times) // (1000 * times + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
               FROM asked JOIN counts USING (term) JOIN weights USING (term) CROSS JOIN whole GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
    QUALIFY rank <= {top}"""


def warc_round_trip(least: int = 1000) -> str:
    """What the records of the archives must say, from the table itself."""
    return f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    q AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
            CASE WHEN octet_length(payload) >= {least} AND page_id IS NOT NULL
                 THEN nullif(max(page_id) OVER (PARTITION BY payload), page_id) END AS refers_to FROM p)
    SELECT *, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type FROM q"""


def url_filter() -> str:
    """Rules in the order of their length; the list is every canonical URL that two URLs share."""
    lower = f"translate(regexp_extract(rest, '^[^/?#]*'), '{CAPITALS}', '{CAPITALS.lower()}')"
    return f"""WITH r AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, url, {lower} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '(/index)?(\\.html?)?/*$', '') END AS canonical,
            CASE WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM h),
    l AS (SELECT canonical FROM c WHERE canonical IS NOT NULL GROUP BY canonical HAVING min(url) < max(url)),
    f AS (SELECT page_id, host, path, canonical, rule, rule IS NULL AND canonical IS NOT NULL AND canonical IN (SELECT canonical FROM l) AS listed FROM c)
    SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict FROM f"""


def build() -> dict[str, str]:
    return {
        "op6_warc_round_trip": warc_round_trip(), "op10_url_filter": url_filter(),
        "op11_vector_codes": vector_codes(), "op12_lexical_search": lexical_search(),
    }
