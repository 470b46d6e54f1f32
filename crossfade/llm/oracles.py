"""DuckDB twins of the corpus queries that SQL can express, written from the definitions."""

from crossfade.llm.decontaminate import UNITS
from crossfade.llm.urlfilter import _HOST, _PATH

#: Shards of op4_sharding and slots of its table.
SHARDS, SLOTS = 32, 4099


def _hash(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


SHARDING = f"""
WITH RECURSIVE walks AS (
    SELECT i, {_hash("name || '/first'")} % {SLOTS} AS first, {_hash("name || '/step'")} % {SLOTS - 1} + 1 AS step
    FROM (SELECT i, printf('shard-%02d', i) AS name FROM range({SHARDS}) t(i))
), fill(n, owner, spot, step) AS (
    SELECT 0, [-1 FOR x IN range({SLOTS})], list(first ORDER BY i), list(step ORDER BY i) FROM walks
    UNION ALL
    SELECT n + 1,
        owner[1:claimed] || [n % {SHARDS}] || owner[claimed + 2:],
        spot[1:n % {SHARDS}] || [claimed] || spot[n % {SHARDS} + 2:],
        step
    FROM (
        SELECT *, (walk + step[n % {SHARDS} + 1] * list_position([owner[(walk + step[n % {SHARDS} + 1] * k) % {SLOTS} + 1] FOR k IN range({SLOTS})], -1)
            - step[n % {SHARDS} + 1]) % {SLOTS} AS claimed
        FROM (SELECT *, spot[n % {SHARDS} + 1] AS walk FROM fill WHERE n < {SLOTS})
    )
), owners AS (SELECT owner FROM fill WHERE n = {SLOTS})
SELECT doc_id, CAST(slot AS INTEGER) AS slot, printf('shard-%02d', owner[slot + 1]) AS shard
FROM (SELECT doc_id, {_hash("CAST(doc_id AS VARCHAR)")} % {SLOTS} AS slot FROM documents), owners
"""

URL_FILTER = rf"""
WITH captures AS (
    SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS fetched,
        lower(regexp_extract(url, '{_HOST}', 1)) AS host,
        array_to_string([p FOR p IN string_split(regexp_extract(url, '{_PATH}', 1), '/') IF p <> ''], '/') AS path
    FROM pages
), named AS (
    SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS domain, host || '/' || string_split(path, '/')[1] AS section FROM captures WHERE host <> ''
), firsts AS (
    SELECT 'host' AS scope, host AS pattern, min(page_id) AS f FROM named GROUP BY host
    UNION ALL SELECT 'domain', domain, min(page_id) FROM named GROUP BY domain
    UNION ALL SELECT 'prefix', section, min(page_id) FROM named WHERE path <> '' GROUP BY section
), entries AS (
    SELECT scope, pattern, CASE WHEN scope = 'host' AND f % 3 = 1 THEN 'allow' ELSE 'block' END AS action, (f * 7) % 300 AS day FROM firsts WHERE scope = 'domain' OR f % 3 < 2
    UNION ALL SELECT scope, pattern, 'clear', (f * 7) % 300 + 50 FROM firsts WHERE scope = 'domain' OR f % 6 < 2
    UNION ALL SELECT scope, pattern, 'block', (f * 7) % 300 + 110 FROM firsts WHERE f % 5 = 0
), weighed AS (
    SELECT scope, pattern, DATE '2024-01-01' + CAST(day AS INTEGER) AS since, max(CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) AS weight FROM entries GROUP BY ALL
), active AS (
    SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY scope, pattern ORDER BY since) AS until FROM weighed) WHERE weight > 0
), held AS (
    SELECT page_id, url, fetched, a.scope, a.pattern, weight,
        CASE a.scope WHEN 'domain' THEN len(string_split(a.pattern, '.')) WHEN 'host' THEN 1000 ELSE 1000 + len(string_split(a.pattern, '/')) END AS rank
    FROM captures c JOIN active a ON c.host <> '' AND c.fetched >= a.since AND (a.until IS NULL OR c.fetched < a.until) AND (
        a.scope = 'domain' AND (c.host = a.pattern OR ends_with(c.host, '.' || a.pattern))
        OR a.scope = 'host' AND c.host = a.pattern
        OR a.scope = 'prefix' AND starts_with(c.host || '/' || c.path || '/', a.pattern || '/'))
), best AS (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY page_id, url, fetched ORDER BY rank DESC) = 1)
SELECT c.page_id, c.url, c.fetched, coalesce(b.weight = 2, false) AS blocked, b.scope, b.pattern
FROM captures c LEFT JOIN best b ON c.page_id = b.page_id AND c.url = b.url AND c.fetched = b.fetched
"""

_ENDS = "('.', '!', '?', chr(10))"


def _words(names: bool, inner: bool) -> str:
    """Template words of the tokens ``t`` with their values, without sentence ends."""
    digit = "substr({0}, 1, 1) BETWEEN '0' AND '9'".format
    name = f"WHEN {'' if inner else 'i > 1 AND'} (i = 1 OR t[i - 1] NOT IN {_ENDS}) AND t[i] <> lower(t[i]) AND t[i] <> upper(t[i]) THEN '<name>'"
    word = (
        f"CASE WHEN {digit('t[i]')} THEN '<num>' WHEN i > 1 AND {digit('t[i - 1]')} AND lower(t[i]) IN {UNITS} THEN '<unit>' "
        f"{name if names else ''} ELSE lower(t[i]) END"
    )
    return f"[{{'w': {word}, 'v': lower(t[i])}} FOR i IN range(1, len(t) + 1) IF t[i] NOT IN {_ENDS}]"


DECONTAMINATION = rf"""
WITH doc_tokens AS (
    SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*|\p{{L}}[\p{{L}}\p{{M}}]*|[.!?\n]') AS t FROM documents
), item_tokens AS (
    SELECT item_id, regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*|\p{{L}}[\p{{L}}\p{{M}}]*|[.!?\n]') AS t FROM benchmark
), docs AS (SELECT doc_id, {_words(True, False)} AS x FROM doc_tokens
), items AS (
    SELECT *, len(x) AS item_words, least(len(x), 8) AS n FROM (
        SELECT item_id, 0 AS form, {_words(True, False)} AS x FROM item_tokens
        UNION ALL SELECT item_id, 1, {_words(True, True)} FROM item_tokens
        UNION ALL SELECT item_id, 2, {_words(False, False)} FROM item_tokens)
    WHERE len(x) >= 5
), item_windows AS (
    SELECT item_id, form, n, i, array_to_string([e.w FOR e IN x[i:i + n - 1]], ' ') AS win,
        len([e FOR e IN x[i:i + n - 1] IF e.w NOT IN ('<num>', '<name>', '<unit>')]) AS literal
    FROM (SELECT *, unnest(range(1, item_words - n + 2)) AS i FROM items)
), doc_windows AS (
    SELECT doc_id, n, j, array_to_string([e.w FOR e IN x[j:j + n - 1]], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(x) - n + 2)) AS j FROM docs, (SELECT DISTINCT n FROM items))
), met AS (
    SELECT DISTINCT doc_id, item_id, form, j - i AS shift, unnest(range(i, i + a.n)) AS p
    FROM item_windows a JOIN doc_windows b ON a.win = b.win AND a.n = b.n WHERE literal >= least(4, a.n)
), pairs AS (
    SELECT met.*, item_words, items.x[p].w AS kind, items.x[p].v AS was, docs.x[p + shift].v AS now
    FROM met JOIN items USING (item_id, form) JOIN docs USING (doc_id)
), aligned AS (
    SELECT doc_id, item_id, form, item_words, count(*) AS reached,
        coalesce(bool_or(was <> now) FILTER (WHERE kind IN ('<num>', '<name>', '<unit>')), false) AS changed
    FROM pairs GROUP BY doc_id, item_id, form, item_words, shift
    HAVING count(DISTINCT (kind, was, now)) FILTER (WHERE kind IN ('<num>', '<name>', '<unit>'))
        = count(DISTINCT (kind, was)) FILTER (WHERE kind IN ('<num>', '<name>', '<unit>'))
), summed AS (
    SELECT doc_id, item_id, form, item_words, least(sum(reached), item_words) AS words, bool_or(changed) AS changed
    FROM aligned GROUP BY doc_id, item_id, form, item_words
)
SELECT doc_id, item_id, CAST(words AS INTEGER) AS words, CAST(item_words AS INTEGER) AS item_words, changed
FROM summed WHERE words >= least(item_words, 13)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, item_words DESC, changed DESC) = 1
"""
