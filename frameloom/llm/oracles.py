"""DuckDB SQL, by brute force, for the operators that SQL can express."""

from __future__ import annotations

#: A text's words as this package counts them.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: A-Z as a-z; other letters stay.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(nodes: str, links: str) -> str:
    """CTEs `both` and `found` (node, least node reached) of links (a, b)."""
    return f"""both_ AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
    reach(node, other) AS (SELECT node, node FROM {nodes} UNION SELECT r.node, b.b FROM reach r JOIN both_ b ON b.a = r.other),
    found AS (SELECT node, min(other) AS least FROM reach GROUP BY node)"""


def ngram_join(n: int, percent: int) -> str:
    return f"""
    WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {WORDS.replace("coalesce(text, '')", LOWERED)} AS words FROM documents),
    g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[k : k + {n - 1}], ' ') AS gram
          FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {n} + 1, least(len(words), 1)) + 1)) AS k FROM w)),
    s AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
    links AS MATERIALIZED (SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * common >= {percent} * (p.size + q.size - common)),
    nodes AS (SELECT doc_id AS node FROM documents),
    {_components("nodes", "links")},
    n AS (SELECT a, count(*) AS links FROM both_ GROUP BY a)
    SELECT d.doc_id, coalesce(s.size, 0)::BIGINT AS n_shingles, found.least AS component_id, coalesce(n.links, 0)::BIGINT AS n_links
    FROM documents d JOIN found ON found.node = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN n ON n.a = d.doc_id"""


def substring_dedup(window: int) -> str:
    return f"""
    WITH d AS MATERIALIZED (SELECT doc_id, {WORDS} AS words FROM documents),
    w AS (SELECT doc_id, k, array_to_string(words[k : k + {window - 1}], ' ') AS run
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - {window} + 2)) AS k FROM d)),
    again AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY sha256(run)) AS n FROM w) WHERE n > 1),
    each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM d),
    last AS (SELECT e.doc_id, e.k, e.word, max(a.k) OVER (PARTITION BY e.doc_id ORDER BY e.k ROWS UNBOUNDED PRECEDING) AS start
             FROM each e LEFT JOIN again a ON a.doc_id = e.doc_id AND a.k = e.k),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM last WHERE start IS NULL OR k >= start + {window} GROUP BY doc_id)
    SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


def suffix_dedup(length: int) -> str:
    return f"""
    WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS size FROM documents),
    w AS (SELECT doc_id, k, md5(h[k : k + {length - 1}]) AS run FROM (SELECT doc_id, h, unnest(range(1, size - {length} + 2)) AS k FROM d)),
    again AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY run ORDER BY doc_id, k) AS n FROM w) WHERE n > 1),
    each AS (SELECT doc_id, unnest(range(1, size + 1)) AS k FROM d),
    last AS (SELECT e.doc_id, e.k, coalesce(e.k < {length} + max(a.k) OVER (PARTITION BY e.doc_id ORDER BY e.k ROWS UNBOUNDED PRECEDING), false) AS gone
             FROM each e LEFT JOIN again a ON a.doc_id = e.doc_id AND a.k = e.k),
    runs AS (SELECT *, coalesce(gone <> lag(gone) OVER (PARTITION BY doc_id ORDER BY k), true) AS begins FROM last),
    spans AS (SELECT doc_id, k AS lo, gone, coalesce(lead(k) OVER (PARTITION BY doc_id ORDER BY k) - 1, (SELECT size FROM d WHERE d.doc_id = runs.doc_id)) AS hi FROM runs WHERE begins),
    told AS (SELECT doc_id, sum(hi - lo + 1) FILTER (gone) AS n, count(*) FILTER (gone) AS spans, string_agg(hex(h[lo : hi]), '' ORDER BY lo) FILTER (NOT gone) AS kept FROM spans JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT d.doc_id, size::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
    FROM d LEFT JOIN told ON told.doc_id = d.doc_id"""


_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0"


def vector_dedup(least: float) -> str:
    return f"""
    WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= {least}::DOUBLE),
    nodes AS (SELECT vec_id AS node FROM embeddings),
    {_components("nodes", "links")},
    n AS (SELECT a, count(*) AS links FROM both_ GROUP BY a)
    SELECT node AS vec_id, coalesce(n.links, 0)::BIGINT AS n_links, least AS component_id, node = least AS kept FROM found LEFT JOIN n ON n.a = node"""


def top_k(every: int, k: int, scale: int) -> str:
    return f"""
    WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS y FROM embeddings WHERE {_FINITE}),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.y, c.y)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.y) = len(c.y) WHERE q.vec_id % {every} = 0)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {k}"""


def exact_dedup() -> str:
    return r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size, row_number() OVER w = 1 AS kept, sha256(plain) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY plain ORDER BY length(text) DESC, doc_id NULLS LAST)"""


def centroid_clusters(k: int, rounds: int, scale: int, dimension: int, seed: int) -> str:
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimension})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1)::INT AS k, v AS c FROM v QUALIFY k < {k})",
    ]
    nearest = "SELECT vec_id, min({'d': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'k': k}) AS m FROM v, %s GROUP BY vec_id"
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({nearest % f'c{r}'})")
        parts.append(f"s{r} AS (SELECT m.k AS k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id), range(1, {dimension + 1}) t(i) GROUP BY 1, 2)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k, list((s - (s % n + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY k UNION ALL SELECT k, c FROM c{r} WHERE k NOT IN (SELECT k FROM s{r}))")
    parts.append(f"a AS MATERIALIZED ({nearest % f'c{rounds}'})")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, m.k AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a JOIN c{rounds} ON k = m.k"""


def spelling_variants(length: int, count: int, ratio: int, noise: int) -> str:
    def crc(byte: int) -> int:
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        return byte

    steps = "[" + ", ".join(f"{crc(b)}::UINTEGER" for b in range(256)) + "]"
    return rf"""
    WITH RECURSIVE r AS MATERIALIZED (SELECT doc_id, run, count(*) AS c, hex(encode(doc_id || ':' || run)) AS x
          FROM (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= {length} GROUP BY ALL),
    h AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::UBIGINT)),
          lambda a, b: xor(a >> 8, {steps}[(xor(a & 255, b) + 1)::INT])))::UBIGINT AS h FROM r),
    e AS (SELECT CASE WHEN h % {noise} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
    w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM e WHERE length(word) >= {length} GROUP BY word HAVING sum(c) >= {count}),
    d AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
    near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.v = b.v AND a.p = b.p AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM d a JOIN w b ON a.v = b.word UNION SELECT b.word, a.word, a.n FROM d a JOIN w b ON a.v = b.word),
    f AS MATERIALIZED (SELECT w.word, w.n, (SELECT count(*) FROM near x WHERE x.word = w.word) AS n_near, t.other AS form, t.n AS form_n
          FROM w LEFT JOIN (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1) t ON t.word = w.word AND t.n >= {ratio} * w.n),
    up(word, root) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL),
    top AS (SELECT up.word, up.root FROM up JOIN f ON f.word = up.root WHERE f.form IS NULL)
    SELECT f.word, form, root, n, n_near::BIGINT AS n_near, form_n FROM f JOIN top ON top.word = f.word"""
