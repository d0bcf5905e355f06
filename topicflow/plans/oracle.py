"""SQL twins of the queries, for DuckDB on the same tables."""

from __future__ import annotations

from topicflow.plans.queries import EPS, LATIN, STOPWORDS, THRESHOLD

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _clean(lower: bool, alphabet: str, stop: str) -> str:
    text = "lower(text)" if lower else "text"
    flags = "g" if lower else "gi"
    return rf"""
    SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(
        {text}, 'http\S+|www\S+', ' ', 'g'), '[^{alphabet}\s]', ' ', '{flags}'), '\s+'),
        lambda x: length(x) >= 3 AND NOT list_contains({stop}, x)), ' ') AS clean
    FROM documents"""


def _tokens(min_len: int, source: str = "documents", key: str = "lang") -> str:
    """CTE body ``doc_id, key, pos, term``."""
    return rf"""SELECT doc_id, {key} AS cluster_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM (
        SELECT doc_id, {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{{min_len},}}') AS l FROM {source})"""


_GRAMS = f"""
    toks AS ({_tokens(2)}),
    grams AS (
        SELECT doc_id, cluster_id, term FROM toks
        UNION ALL
        SELECT doc_id, cluster_id, term || ' ' || nxt FROM (
            SELECT *, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM toks) WHERE nxt IS NOT NULL),
    gdf AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM grams GROUP BY term)"""

_WEIGHTS = f"""
    toks AS ({_tokens(2)}),
    tf AS (SELECT doc_id, cluster_id, term, count(*) AS tf FROM toks GROUP BY ALL),
    nd AS (SELECT count(*) AS n FROM documents),
    vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term
        HAVING count(*) >= 10 AND count(*) <= 0.5 * (SELECT n FROM nd) ORDER BY total DESC, term LIMIT 2000),
    w AS (SELECT doc_id, cluster_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term), nd),
    weights AS (SELECT doc_id, cluster_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w)"""


def _cluster_topics(key: str, top_n: int) -> str:
    return f"""
    toks AS ({_tokens(1, key=key)}),
    tf AS (SELECT doc_id, cluster_id, term, count(*) AS tf FROM toks GROUP BY ALL),
    sizes AS (SELECT {key} AS cluster_id, count(*) AS n FROM documents GROUP BY 1),
    idf AS (SELECT cluster_id, term, n, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf JOIN sizes USING (cluster_id)
        WHERE n >= 2 GROUP BY cluster_id, term, n HAVING count(*) >= 3 AND count(*) <= 0.8 * n),
    w AS (SELECT doc_id, cluster_id, term, n, tf * idf AS w FROM tf JOIN idf USING (cluster_id, term)),
    x AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM w),
    scores AS (SELECT cluster_id, term AS word, sum(x) / any_value(n) AS score FROM x GROUP BY cluster_id, term),
    topics AS (SELECT * FROM (SELECT cluster_id, word, score,
        row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, word) AS rank FROM scores) WHERE rank <= {top_n})"""


_ARTICLES = r"""
    a AS (SELECT page_id, CASE WHEN length(html) > 1500 THEN html ELSE '' END AS content,
        CASE WHEN length(html) > 800 THEN url END AS description,
        array_to_string(string_split(url, '/')[1:3], '/') AS title,
        CASE WHEN contains(url, '/en/') THEN '2024-01-02 03:04:05' END AS pub,
        CASE WHEN contains(url, '/fr/') THEN '' ELSE array_to_string(string_split(url, '/')[1:3], '/') END AS source_id,
        CASE WHEN contains(url, '?') THEN NULL ELSE url END AS link FROM pages),
    t AS (SELECT *, coalesce(nullif(content, ''), nullif(description, '')) AS text FROM a),
    articles AS (SELECT page_id, coalesce(link, sha256(title || coalesce(pub, '') || text)) AS external_id, title,
        coalesce(nullif(source_id, ''), 'pages') AS source, pub AS published_at, text, link AS url
        FROM t WHERE text IS NOT NULL)"""

_MESSAGES = r"""
    m AS (SELECT doc_id, text, source, doc_id % 10 AS kind, CASE doc_id % 10 WHEN 2 THEN '2024-13-45' WHEN 3 THEN ''
        WHEN 4 THEN '2024-01-05T06:07:08+02:00' ELSE '' END AS pub FROM documents),
    parsed AS (
        SELECT 0 AS partition, doc_id AS "offset",
            CASE WHEN kind = 2 THEN 'bad_published_at' WHEN kind IN (7, 8) THEN 'missing_text'
                 WHEN kind = 6 THEN 'not_an_object'
                 WHEN kind = 9 OR (kind = 5 AND NOT json_valid(text)) THEN 'invalid_json'
                 WHEN kind = 5 THEN 'not_an_object' END AS reason,
            CASE WHEN kind = 1 THEN source ELSE sha256(source || '||' || pub || '|' || text) END AS ext,
            CASE WHEN kind = 4 THEN '2024-01-05 04:07:08' END AS published_at, text
        FROM m
        UNION ALL
        SELECT 1, event_id, 'missing_text', NULL, NULL, NULL FROM events),
    stored AS (SELECT DISTINCT source AS ext FROM documents WHERE source IN ('src1', 'src3'))"""

_STATUS = r"""
    log AS (SELECT 'news-' || user_id AS id, CASE WHEN event_type IN ('view', 'signup') THEN 'new'
        WHEN event_type = 'click' THEN 'processing' WHEN event_type = 'purchase' THEN 'processed' ELSE 'failed' END AS status,
        CASE WHEN event_type = 'error' THEN props END AS error_message, ts AS updated_at FROM events),
    cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC,
        list_position(['new', 'processing', 'processed', 'failed'], status) DESC) AS rn FROM log) WHERE rn = 1),
    news AS (SELECT 'news-' || user_id AS id, min(ts) AS created_at FROM events GROUP BY 1)"""

_SCORED = r"""
    e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    cells AS (SELECT label, i, avg(x) AS m FROM (
        SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i),
    cents AS (SELECT label AS cluster, list(m ORDER BY i) AS c FROM cells GROUP BY label),
    dist AS (SELECT vec_id, label, cluster, list_distance(v, c) AS d FROM e, cents),
    scored AS (SELECT vec_id, label, cluster, exp(-d) AS score FROM (SELECT *, row_number() OVER (
        PARTITION BY vec_id ORDER BY d, cluster) AS rn FROM dist) WHERE rn = 1)"""

_META = r"""
    meta AS (SELECT label AS cluster_id, 'topic ' || label AS tlabel, 'w' || label || ',n' || count(*) AS words
        FROM embeddings WHERE label < 8 GROUP BY label)"""

_REPORTS = f"""{_SCORED}, {_META},
    reports AS (SELECT vec_id, label, score, tlabel IS NOT NULL AND score >= {THRESHOLD} AS known, cluster, tlabel, words
        FROM scored LEFT JOIN meta ON cluster = cluster_id)"""


def _silhouette(where: str = "", squared: bool = False) -> str:
    d = "list_distance(a.v, b.v)"
    d = f"power({d}, 2)" if squared else d
    return f"""
    e AS (SELECT vec_id, label::BIGINT AS cluster, embedding::DOUBLE[] AS v FROM embeddings {where}),
    sums AS (SELECT a.vec_id, a.cluster, b.cluster AS other, sum({d}) AS s, count(*) AS n
        FROM e a, e b GROUP BY ALL),
    ab AS (SELECT vec_id, cluster, max(CASE WHEN other = cluster THEN n END) AS size,
        max(CASE WHEN other = cluster AND n > 1 THEN s / (n - 1) END) AS a,
        min(CASE WHEN other <> cluster THEN s / n END) AS b FROM sums GROUP BY ALL),
    sil AS (SELECT vec_id, cluster, CASE WHEN b IS NULL THEN NULL WHEN size = 1 THEN 0.0
        ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab)"""


_DENSITY = f"""
    e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a, e b WHERE list_distance(a.v, b.v) <= {EPS}),
    core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 4),
    edges AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach(id, r) AS (SELECT id, id FROM core UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.r = edges.a),
    comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id),
    big AS (SELECT c FROM comp GROUP BY c HAVING count(*) >= 3),
    clusters AS (SELECT vec_id, coalesce(big.c, -1) AS cluster, comp.id IS NOT NULL AS is_core
        FROM e LEFT JOIN comp ON vec_id = comp.id LEFT JOIN big ON comp.c = big.c)"""

_HIDDEN = r"""
    h AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"""

_FMT = "'%Y-%m-%d %H:%M:%S.%f'"

ORACLE: dict[str, str] = {
    "corpus_content": r"""
        SELECT doc_id, length(content) AS n, sha256(content) AS digest FROM (
            SELECT doc_id, regexp_replace(source || ' ' || text, '^\s+|\s+$', '', 'g') AS content FROM documents)
        WHERE length(content) > 20""",
    "clean_text": _clean(True, "a-zа-яё", _STOP),
    "clean_text_keepcase": _clean(False, "a-zа-яё", _STOP),
    "clean_text_latin": _clean(True, LATIN, _STOP),
    "sql_functions": f"""
        SELECT c.doc_id, c.clean, sha256(source || '|' || lang || '||' || text) AS external_id
        FROM ({_clean(True, "a-zа-яё", "[]::VARCHAR[]")}) c JOIN documents d ON c.doc_id = d.doc_id""",
    "strip_html": r"""
        SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages""",
    "lemmatize": r"""
        WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{4,}')) AS token FROM documents),
        dict AS (SELECT token, left(token, length(token) - 1) AS lemma FROM v
            WHERE suffix(token, 's') AND left(token, length(token) - 1) IN (SELECT token FROM v)),
        l AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS l FROM documents),
        toks AS (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) AS pos FROM l)
        SELECT doc_id, string_agg(coalesce(lemma, tok), ' ' ORDER BY pos) AS lemmatized
        FROM toks LEFT JOIN dict ON tok = token GROUP BY doc_id
        UNION ALL SELECT doc_id, '' FROM l WHERE len(l) = 0""",
    "join_corpora": r"""
        WITH d AS (SELECT source, text, lang, o_orderdate AS dt FROM documents LEFT JOIN orders ON o_orderkey = doc_id)
        SELECT source AS title, sha256(text) AS digest, CASE WHEN lang = 'en' THEN lang END AS topic,
            strftime(dt, '%Y-%m-%d') AS day FROM d WHERE lang <> 'en' OR year(dt) > 1997""",
    "dedupe_exact": r"""
        SELECT doc_id FROM (SELECT doc_id, row_number() OVER (
            PARTITION BY lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
    "temporal_split": r"""
        SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-24' THEN 'train' ELSE 'test' END AS split FROM (
            SELECT *, row_number() OVER (PARTITION BY event_type, props, value ORDER BY ts, event_id) AS rn FROM events)
        WHERE rn = 1""",
    "random_split": r"""
        SELECT doc_id, CASE WHEN ('0x' || substr(sha256('42|' || doc_id), 1, 6))::BIGINT < 3355443 THEN 'test' ELSE 'train' END
            AS split
        FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
    "articles_per_year": "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1",
    "length_p99": r"""
        SELECT quantile_cont(length(regexp_replace(text, '^\s+|\s+$', '', 'g')), 0.99) AS p99 FROM documents""",
    "length_histogram": r"""
        WITH l AS (SELECT length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS len FROM documents),
        kept AS (SELECT len FROM l WHERE len <= floor((SELECT quantile_cont(len, 0.99) FROM l))),
        b AS (SELECT min(len)::DOUBLE AS lo, (max(len) - min(len)) / 30.0::DOUBLE AS w FROM kept)
        SELECT least(floor((len - lo) / w), 29)::INT AS bin,
            round(lo + least(floor((len - lo) / w), 29) * w, 6) AS low,
            round(lo + (least(floor((len - lo) / w), 29) + 1) * w, 6) AS high, count(*) AS n
        FROM kept, b GROUP BY 1, 2, 3""",
    "external_id": r"""
        WITH x AS (SELECT doc_id, CASE WHEN n_chars < 500 THEN 'doc-' || doc_id
            ELSE sha256(source || '|' || lang || '||' || text) END AS external_id FROM documents)
        SELECT doc_id, external_id, sha256(external_id) AS news_id FROM x""",
    "iso_dates": f"""
        SELECT event_id, form, strftime(p, {_FMT}) AS parsed FROM (
            SELECT event_id, unnest(['day', 'basic', 'minute', 'zulu', 'offset', 'micros', 'loose', 'words']) AS form,
                unnest([date_trunc('day', ts), date_trunc('day', ts), date_trunc('minute', ts), date_trunc('second', ts),
                    date_trunc('second', ts) - INTERVAL 3 HOUR, ts, NULL, NULL]) AS p FROM events)""",
    "normalize_articles": f"""
        WITH {_ARTICLES}
        SELECT page_id, external_id, title, source, published_at, sha256(text) AS digest, url FROM articles""",
    "validate_payloads": f"""
        WITH {_MESSAGES}
        SELECT partition, "offset", reason, CASE WHEN reason IS NULL THEN ext END AS external_id,
            CASE WHEN reason IS NULL THEN published_at END AS published_at FROM parsed""",
    "ingest_dedupe": f"""
        WITH {_MESSAGES}
        SELECT ext AS external_id, 0 AS partition, min("offset") AS "offset" FROM parsed
        WHERE reason IS NULL AND ext NOT IN (SELECT ext FROM stored) GROUP BY ext""",
    "ingest_outcomes": f"""
        WITH {_MESSAGES},
        per AS (SELECT ext, count(*) AS n, CASE WHEN ext IN (SELECT ext FROM stored) THEN 0 ELSE 1 END AS fresh
            FROM parsed WHERE reason IS NULL GROUP BY ext),
        c AS (SELECT 'stored' AS outcome, sum(fresh)::BIGINT AS n FROM per
            UNION ALL SELECT 'duplicate', sum(n - fresh)::BIGINT FROM per
            UNION ALL SELECT reason, count(*) FROM parsed WHERE reason IS NOT NULL GROUP BY reason)
        SELECT outcome, n FROM c WHERE n > 0""",
    "rejected_messages": f"""
        WITH {_MESSAGES} SELECT partition, "offset", reason FROM parsed WHERE reason IS NOT NULL""",
    "status_transitions": f"""
        WITH {_STATUS} SELECT id, status, error_message, strftime(updated_at, {_FMT}) AS updated_at FROM cur""",
    "next_batch": f"""
        WITH {_STATUS} SELECT id, strftime(created_at, {_FMT}) AS created_at FROM (
            SELECT news.id, created_at FROM news JOIN cur USING (id) WHERE status = 'new' ORDER BY created_at, news.id LIMIT 32)""",
    "claim_new": f"WITH {_STATUS} SELECT id, 'processing' AS status FROM cur WHERE status = 'new'",
    "mark_failed": r"""
        SELECT doc_id::VARCHAR AS id, 'failed' AS status, sha256(substr(text, 1, 1000)) AS digest FROM documents""",
    "upsert_metadata": r"""
        WITH u AS (SELECT (c_nationkey + 10)::INT AS cluster_id, 'customer ' || c_custkey AS label, c_mktsegment AS words
            FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS rn FROM customer)
            WHERE rn = 1)
        SELECT cluster_id, label, words, true AS is_active, '2024-02-01 00:00:00.000000' AS updated_at FROM u
        UNION ALL
        SELECT n_nationkey::INT, n_name, n_name, n_regionkey > 1, '2024-01-01 00:00:00.000000' FROM nation
        WHERE n_nationkey NOT IN (SELECT cluster_id FROM u)""",
    "reports_referential": r"""
        SELECT doc_id AS news_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "ngram_counts": f"WITH {_GRAMS} SELECT term, df, tf FROM gdf",
    "doc_freq": f"""
        WITH toks AS ({_tokens(1)})
        SELECT cluster_id AS lang, term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM toks GROUP BY 1, 2""",
    "vocabulary": f"""
        WITH {_GRAMS} SELECT term, df, tf FROM gdf
        WHERE df >= 10 AND df <= 0.5 * (SELECT count(*) FROM documents) ORDER BY tf DESC, term LIMIT 2000""",
    "tfidf": f"WITH {_WEIGHTS} SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM weights",
    "tfidf_test_rows": rf"""
        WITH s AS (SELECT doc_id, text, lang, ('0x' || substr(sha256('42|' || doc_id), 1, 6))::BIGINT < 3355443 AS test FROM documents),
        toks AS ({_tokens(2, "s", "test")}),
        tf AS (SELECT doc_id, cluster_id AS test, term, count(*) AS tf FROM toks GROUP BY ALL),
        nd AS (SELECT count(*) AS n FROM s WHERE NOT test),
        vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf WHERE NOT test GROUP BY term
            HAVING count(*) >= 10 AND count(*) <= 0.5 * (SELECT n FROM nd) ORDER BY total DESC, term LIMIT 2000),
        w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term), nd WHERE test)
        SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w""",
    "top_words_centroid": f"""
        WITH {_WEIGHTS}, sizes AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
        s AS (SELECT cluster_id, term AS word, sum(tfidf) / any_value(n) AS score
            FROM weights JOIN sizes ON lang = cluster_id GROUP BY 1, 2)
        SELECT * FROM (SELECT cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, word))::INT AS rank,
            word, round(score, 6) AS score FROM s) WHERE rank <= 10""",
    "top_words_cluster": f"""
        WITH {_cluster_topics("lang", 10)}
        SELECT cluster_id, rank::INT AS rank, word, round(score, 6) AS score FROM topics""",
    "top_words_by_source": f"""
        WITH {_cluster_topics("source", 5)}
        SELECT cluster_id, rank::INT AS rank, word, round(score, 6) AS score FROM topics""",
    "topic_diversity": f"""
        WITH {_cluster_topics("source", 10)}
        SELECT round(count(DISTINCT word) / count(word), 6) AS diversity FROM topics""",
    "coherence_cv": rf"""
        WITH {_cluster_topics("lang", 10)},
        l AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS l FROM documents),
        total AS (SELECT sum(greatest(len(l) - 109, 1)) AS nw FROM l),
        pos AS (SELECT doc_id, len(l) AS n, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS p FROM l),
        seen AS (SELECT DISTINCT doc_id, word, unnest(range(greatest(p - 109, 0), least(p, greatest(n - 110, 0)) + 1)) AS s
            FROM pos WHERE word IN (SELECT word FROM topics)),
        single AS (SELECT word, count(*) / (SELECT nw FROM total) AS p FROM seen GROUP BY word),
        tw AS (SELECT cluster_id, word, p FROM topics JOIN single USING (word)),
        st AS (SELECT cluster_id, doc_id, s, word FROM seen JOIN tw USING (word)),
        co AS (SELECT x.cluster_id, x.word AS a, y.word AS b, count(*) AS n FROM st x JOIN st y
            ON x.cluster_id = y.cluster_id AND x.doc_id = y.doc_id AND x.s = y.s GROUP BY ALL),
        cells AS (SELECT x.cluster_id, x.word AS a, y.word AS b,
            coalesce(n, 0) / (SELECT nw FROM total) + 1e-12 AS j, x.p AS pa, y.p AS pb
            FROM tw x JOIN tw y ON x.cluster_id = y.cluster_id
            LEFT JOIN co ON co.cluster_id = x.cluster_id AND co.a = x.word AND co.b = y.word),
        npmi AS (SELECT cluster_id, a, b, ln(j / (pa * pb)) / -ln(j) AS v FROM cells),
        tv AS (SELECT cluster_id, b, sum(v) AS t FROM npmi GROUP BY 1, 2),
        cosines AS (SELECT cluster_id, a, sum(v * t) / (sqrt(sum(v * v)) * sqrt(sum(t * t))) AS c
            FROM npmi JOIN tv USING (cluster_id, b) GROUP BY 1, 2)
        SELECT cluster_id, round(avg(c), 6) AS coherence FROM cosines GROUP BY 1""",
    "embed_hashed": f"""
        WITH toks AS ({_tokens(1)}),
        b AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 6))::BIGINT % 256)::INT AS pos, count(*) AS n FROM toks GROUP BY 1, 2)
        SELECT doc_id, pos, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS x FROM b""",
    "l2_normalize": f"""
        WITH {_HIDDEN}
        SELECT vec_id, i::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM h""",
    "mean_pooling": f"""
        WITH {_HIDDEN}
        SELECT vec_id, (i % 8)::INT AS pos,
            round(sum(CASE WHEN i // 8 < label THEN x ELSE 0 END) / greatest(least(any_value(label), 8), 1e-9), 6) AS x
        FROM h GROUP BY 1, 2""",
    "cls_pooling": f"WITH {_HIDDEN} SELECT vec_id, i::INT AS pos, round(x, 6) AS x FROM h WHERE i < 8",
    "nearest_centroid": f"WITH {_SCORED} SELECT vec_id, cluster, round(score, 6) AS score FROM scored",
    "assign_topics": f"""
        WITH {_REPORTS}
        SELECT vec_id, CASE WHEN known THEN cluster END AS cluster_id, CASE WHEN known THEN tlabel ELSE 'unknown' END
            AS cluster_label, CASE WHEN known THEN words ELSE '' END AS words, round(score, 6) AS score FROM reports""",
    "assign_topics_api": f"""
        WITH {_SCORED}, {_META}
        SELECT vec_id, cluster AS cluster_id, coalesce(tlabel, 'cluster_' || cluster) AS topic_label,
            coalesce(words, '') AS words, round(score, 6) AS score FROM scored LEFT JOIN meta ON cluster = cluster_id""",
    "unknown_rate": f"""
        WITH {_REPORTS}
        SELECT count(*) AS n, count(*) FILTER (NOT known) AS unknown,
            round(avg(CASE WHEN known THEN 0.0 ELSE 1.0 END), 6) AS rate FROM reports""",
    "cluster_summary": r"""
        WITH c AS (SELECT CASE WHEN label = 9 THEN -1 WHEN label < 8 THEN label END AS c FROM embeddings)
        SELECT count(*) AS n_samples, count(DISTINCT CASE WHEN c <> -1 THEN c END) AS n_clusters_found,
            round(count(*) FILTER (c = -1) / count(*), 6) AS noise_fraction,
            round(count(*) FILTER (c <> -1) / count(*), 6) AS coverage FROM c""",
    "cluster_agreement": f"""
        WITH {_SCORED},
        t AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM scored GROUP BY 1, 2),
        s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS ab,
            (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY label)) AS a,
            (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY cluster)) AS b,
            (SELECT sum(n) FROM t) AS n)
        SELECT round((ab - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS adjusted_rand_index
        FROM s""",
    "review_sample": r"""
        SELECT * FROM (SELECT label AS cluster, (row_number() OVER (PARTITION BY label
            ORDER BY sha256('42|' || vec_id), vec_id))::INT AS pick, vec_id FROM embeddings) WHERE pick <= 20""",
    "silhouette": f"""
        WITH {_silhouette("WHERE label <> 9")} SELECT round(avg(silhouette), 6) AS silhouette FROM sil""",
    "silhouette_samples": f"""
        WITH {_silhouette()} SELECT vec_id, cluster, round(silhouette, 6) AS silhouette FROM sil""",
    "silhouette_sq": f"""
        WITH {_silhouette(squared=True)} SELECT vec_id, cluster, round(silhouette, 6) AS silhouette FROM sil""",
    "silhouette_by_bucket": rf"""
        WITH {_silhouette()},
        n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents)
        SELECT CASE WHEN n < 120 THEN 'short' WHEN n > 400 THEN 'long' ELSE 'medium' END AS bucket,
            count(*) AS n, round(avg(silhouette), 6) AS silhouette
        FROM sil JOIN n ON vec_id = doc_id GROUP BY 1""",
    "density_clusters": f"WITH RECURSIVE {_DENSITY} SELECT vec_id, cluster, is_core FROM clusters",
    "density_assign": f"""
        WITH RECURSIVE {_DENSITY},
        d AS (SELECT a.vec_id, c.cluster, list_distance(a.v, b.v) AS d FROM e a, e b
            JOIN clusters c ON b.vec_id = c.vec_id WHERE c.cluster <> -1),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS rn FROM d
            WHERE d <= {EPS}) WHERE rn = 1)
        SELECT e.vec_id, coalesce(cluster, -1) AS cluster, round(coalesce(1 - d / {EPS}, 0), 5) AS strength
        FROM e LEFT JOIN best ON e.vec_id = best.vec_id""",
    "density_reduced": f"WITH RECURSIVE {_DENSITY} SELECT vec_id, cluster, is_core FROM clusters",
    "pca_reduce": r"""
        SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS distance
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "kmeans_embeddings": "SELECT vec_id, true AS in_range, true AS nearest, true AS cheaper FROM embeddings",
    "kmeans_tfidf": "SELECT doc_id, true AS in_range, true AS equal_together FROM documents",
    "dedupe_near": r"""
        SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' '))
            AS first_copy, true AS together, true AS not_above_first FROM documents""",
    "run_summary": rf"""
        WITH content AS (SELECT doc_id, regexp_replace(source || ' ' || text, '^\s+|\s+$', '', 'g') AS c FROM documents),
        kept AS (SELECT doc_id, lower(c) AS c FROM content WHERE length(c) > 20),
        clean AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(
            c, 'http\S+|www\S+', ' ', 'g'), '[^{LATIN}\s]', ' ', 'g'), '\s+'),
            lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x)) AS l FROM kept),
        usable AS (SELECT * FROM clean WHERE len(l) > 0),
        toks AS (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM usable),
        grams AS (SELECT doc_id, term FROM toks UNION ALL
            SELECT doc_id, term || ' ' || nxt FROM (
                SELECT *, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM toks) WHERE nxt IS NOT NULL),
        vocab AS (SELECT term FROM grams GROUP BY term HAVING count(DISTINCT doc_id) >= 10
            AND count(DISTINCT doc_id) <= 0.5 * (SELECT count(*) FROM usable) LIMIT 500),
        m AS (SELECT unnest(['model', 'n_samples', 'n_clusters_found', 'noise_fraction', 'silhouette_score', 'coherence',
            'topic_diversity', 'n_clusters', 'n_features']) AS metric,
            unnest([NULL, (SELECT count(*) FROM usable), 4, 0, NULL, NULL, NULL, 4, (SELECT count(*) FROM vocab)])::DOUBLE AS value,
            unnest(['tfidf_kmeans', NULL, NULL, NULL, 'in range', 'in range', 'in range', NULL, NULL]) AS text)
        SELECT 'tfidf' AS run_id, metric, value, text FROM m""",
    "pca_norms": r"""
        WITH h AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        m AS (SELECT i, avg(x) AS m FROM h GROUP BY i)
        SELECT vec_id, round(sqrt(sum((x - m) * (x - m))), 6) AS norm FROM h JOIN m USING (i) GROUP BY vec_id""",
    "topic_distribution": r"""
        SELECT event_type AS topic, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share
        FROM events GROUP BY 1""",
    "topic_dynamics": r"""
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS topic, count(*) AS n
        FROM events GROUP BY 1, 2""",
    "topic_spikes": r"""
        WITH c AS (SELECT date_trunc('day', ts) AS d, event_type AS topic, count(*) AS n FROM events GROUP BY 1, 2),
        s AS (SELECT *, avg(n) OVER w AS m, stddev_samp(n) OVER w AS sd FROM c
            WINDOW w AS (PARTITION BY topic ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
        SELECT strftime(d, '%Y-%m-%d') AS day, topic, n, round(m, 6) AS mean, round(sd, 6) AS sd,
            coalesce(n > m + 1.5 * sd, false) AS is_spike FROM s""",
    "batch_summary": r"""
        WITH b AS (SELECT user_id, date_trunc('day', ts) AS d, count(*) AS size, sum(value) AS seconds FROM events GROUP BY 1, 2)
        SELECT count(*) AS batches, sum(size)::BIGINT AS "rows", round(avg(size), 4) AS mean_size,
            round(avg(seconds), 4) AS mean_seconds, round(quantile_cont(seconds, 0.95), 4) AS p95_seconds,
            round(sum(size) / sum(seconds), 4) AS rows_per_second FROM b""",
    "stream_ingest": f"""
        WITH {_MESSAGES}
        SELECT ext AS external_id, sha256(text) AS digest FROM (
            SELECT *, row_number() OVER (PARTITION BY ext ORDER BY partition, "offset") AS rn FROM parsed WHERE reason IS NULL)
        WHERE rn = 1""",
    "stream_publish": f"""
        WITH {_ARTICLES}
        SELECT external_id, a.title, a.source, a.published_at, a.url, sha256(a.text) AS digest,
            'external_id,payload,published_at,source,text,title,url' AS keys, a.page_id,
            CASE WHEN length(html) > 800 THEN p.url END AS description, 'fr' AS lang, a.title AS tag
        FROM articles a JOIN pages p USING (page_id)""",
    "stream_scoring": f"""
        WITH {_REPORTS}
        SELECT vec_id::VARCHAR AS news_id, CASE WHEN label = 5 THEN 'failed' ELSE 'processed' END AS status,
            CASE WHEN known AND label <> 5 THEN cluster END AS cluster_id,
            CASE WHEN label = 5 THEN NULL WHEN known THEN tlabel ELSE 'unknown' END AS cluster_label FROM reports""",
}
ORACLE["stream_spikes"] = ORACLE["topic_spikes"]
ORACLE["density_pivots"] = ORACLE["density_clusters"]
ORACLE["vocabulary_sketched"] = ORACLE["vocabulary"]
ORACLE["lemmatize_guess"] = r"""
WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{4,}')) AS token FROM documents),
dict AS (SELECT token, left(token, length(token) - 1) AS lemma FROM v
    WHERE suffix(token, 's') AND left(token, length(token) - 1) IN (SELECT token FROM v)),
ex AS (SELECT DISTINCT token, lemma FROM (SELECT token, lemma FROM dict UNION ALL SELECT lemma, lemma FROM dict) WHERE length(token) > 0),
shaped AS (
    SELECT token, lemma, (SELECT count(*) FROM range(1, least(length(token), length(lemma)) + 1) r(i)
                          WHERE left(token, i::INT) = left(lemma, i::INT)) AS p FROM ex),
ends AS (
    SELECT right(token, k::INT) AS ending, length(token) - p AS strip, substr(lemma, p + 1) AS tail
    FROM shaped, unnest(range(greatest(length(token) - p, 1), least(length(token) - p + 2, length(token)) + 1)) t(k)),
counted AS (SELECT ending, strip, tail, count(*) AS support FROM ends GROUP BY ALL),
rules AS (
    SELECT ending, strip, tail, support FROM (
        SELECT *, row_number() OVER (PARTITION BY ending ORDER BY support DESC, strip, tail) AS rn FROM counted) WHERE rn = 1),
l AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS l FROM documents),
toks AS (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) AS pos FROM l),
unknown AS (SELECT DISTINCT tok FROM toks WHERE tok NOT IN (SELECT token FROM dict)),
guessed AS (
    SELECT tok, arg_max(left(tok, length(tok) - strip) || tail, k) AS lemma
    FROM unknown, unnest(range(1, length(tok) + 1)) t(k) JOIN rules ON rules.ending = right(tok, k::INT) AND support >= 2
    GROUP BY tok),
lemmas AS (SELECT token AS tok, lemma FROM dict UNION ALL SELECT tok, lemma FROM guessed)
SELECT doc_id, string_agg(coalesce(lemma, tok), ' ' ORDER BY pos) AS lemmatized
FROM toks LEFT JOIN lemmas USING (tok) GROUP BY doc_id
UNION ALL SELECT doc_id, '' FROM l WHERE len(l) = 0"""
ORACLE["value_quantiles"] = r"""
WITH b AS (
    SELECT CAST(ts AS DATE) AS day, sign(value)::INT AS sign,
           CASE WHEN value = 0 THEN 0 ELSE ceil(ln(abs(value)) / 0.020000666706669435)::BIGINT END AS bucket
    FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
spans AS (SELECT 'all' AS span, sign, bucket, count(*) AS n FROM b GROUP BY ALL
          UNION ALL
          SELECT 'first_week', sign, bucket, count(*) FROM b WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-07' GROUP BY ALL),
keyed AS (SELECT *, CASE WHEN sign < 0 THEN -bucket - 1099511627776 WHEN sign = 0 THEN -549755813888 ELSE bucket END AS k FROM spans),
run AS (SELECT *, sum(n) OVER (PARTITION BY span ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
               sum(n) OVER (PARTITION BY span) AS total,
               CASE WHEN sign = 0 THEN 0.0 ELSE sign * 2.0 * pow(1.02020202020202, bucket::DOUBLE) / 2.02020202020202 END AS v FROM keyed)
SELECT span, max(total)::BIGINT AS n,
       round(arg_min(v, k) FILTER (WHERE upto >= greatest(ceil(0.5 * total), 1)), 6) AS q50,
       round(arg_min(v, k) FILTER (WHERE upto >= greatest(ceil(0.95 * total), 1)), 6) AS q95,
       round(arg_min(v, k) FILTER (WHERE upto >= greatest(ceil(0.99 * total), 1)), 6) AS q99
FROM run GROUP BY span"""
