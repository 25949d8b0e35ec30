"""DuckDB SQL for the queries that SQL can express, built from the operators' own tables of fixed values."""

from __future__ import annotations

from corvane.llm import decontam, licenses, preference, quality
from corvane.llm.common import SPACE

UPPER, LOWER = licenses.UPPER, licenses.LOWER


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def licences() -> str:
    of = licenses.tokens()
    known = ", ".join(f"({text(s)}, {text(of[name])})" for name, s in licenses.SENTENCES.items())
    runs = [(r.licence, "".join(of[s] for s in r.sentences)) for r in licenses.RULES]
    steps = ", ".join(f"replace(s{i}, {text(run)}, '_') AS s{i + 1}" for i, (_, run) in enumerate(runs))
    names = ", ".join(f"CASE WHEN contains(s{i}, {text(run)}) THEN {text(name)} END" for i, (name, run) in enumerate(runs))
    many = " + ".join(f"(length(s{i}) - length(s{i + 1})) // {len(run) - 1}" for i, (_, run) in enumerate(runs))
    return rf"""
    WITH parts AS (
      SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '\b([vV])[.][{SPACE}]+([0-9])', '\1 \2', 'g'), '([.!?;:])[{SPACE}]+', '\1' || chr(10), 'g'), '[\n\r]+') AS p FROM documents
    ), lines AS (
      SELECT doc_id, u.i, trim(regexp_replace(translate(p[u.i], '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) AS s FROM parts, unnest(range(1, len(p) + 1)) AS u(i)
    ), known(s, token) AS (VALUES {known}
    ), found AS (
      SELECT doc_id, count(*) AS n, count(token) AS k, regexp_replace(string_agg(coalesce(token, '_'), '' ORDER BY i), '_+', '_', 'g') AS s0
      FROM lines LEFT JOIN known USING (s) WHERE s <> '' GROUP BY doc_id
    ), tried AS (SELECT *, {steps} FROM found
    ), named AS (
      SELECT doc_id, n, k, array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), ',') AS licences, {many} AS n_matches FROM tried
    )
    SELECT d.doc_id, coalesce(licences, '') AS licences, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(k, 0)::BIGINT AS n_known
    FROM documents d LEFT JOIN named USING (doc_id)
    """


def quality_rules() -> str:
    tests = []
    for r in quality.THRESHOLDS:
        tests += [f"{r.measure} < {r.low}"] * (r.low is not None) + [f"{r.measure} > {r.high}"] * (r.high is not None)
    stop = ", ".join(map(text, quality.ALL_STOP_WORDS))
    part = lambda a, b: f"coalesce({a}::DOUBLE / nullif({b}, 0), 0)"
    return rf"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS x FROM documents
    ), windows AS (
      SELECT doc_id, u.i, [w[u.i], w[u.i + 1], w[u.i + 2]] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)
    ), repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
    ), covered AS (SELECT doc_id, count(DISTINCT v.k) AS n FROM repeated, unnest([i, i + 1, i + 2]) AS v(k) GROUP BY doc_id
    ), counts AS (
      SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[{SPACE}]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        len(x) - len(list_distinct(x)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        len(list_distinct(list_filter(list_transform(w, lambda y: lower(y)), lambda y: y IN ({stop})))) AS n_stop_words,
        len(list_filter(w, lambda y: regexp_matches(y, '\p{{L}}'))) AS n_alpha_words, len(x) AS n_lines,
        len(list_filter(x, lambda y: regexp_matches(y, '^[{SPACE}]*[-*•]'))) AS n_bullets,
        len(list_filter(x, lambda y: regexp_matches(y, '(\.\.\.|…)[{SPACE}]*$'))) AS n_ellipses,
        length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_upper, length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS n_letters
      FROM d LEFT JOIN covered USING (doc_id)
    ), measures AS (
      SELECT *, {part("word_chars", "n_words")} AS mean_word_chars, {part("n_symbols", "word_chars")} AS symbol_ratio, {part("n_alpha_words", "n_words")} AS alpha_ratio,
        {part("n_upper", "n_letters")} AS upper_ratio, {part("n_bullets", "n_lines")} AS bullet_ratio, {part("n_ellipses", "n_lines")} AS ellipsis_ratio,
        {part("n_dup_lines", "n_lines")} AS dup_line_ratio, {part("n_repeat_words", "n_words")} AS repeat_ratio,
        (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counts
    )
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
      base_failed, NOT base_failed AND NOT ({" OR ".join(tests)}) AS kept FROM measures
    """


def leaks() -> str:
    words = r"[a-z0-9\x{00DF}-\x{00F6}\x{00F8}-\x{024F}\x{0370}-\x{10FFFF}]+"
    return rf"""
    WITH s AS (
      SELECT item_id, regexp_split_to_array(regexp_replace(text, '([.!?])[{SPACE}]+', '\1' || chr(10), 'g'), '\n+') AS p FROM benchmark
    ), w AS (
      SELECT item_id, list_filter(list_transform(p, lambda x: regexp_extract_all(lower(x), '{words}')), lambda x: len(x) > 0) AS p FROM s
    ), own AS (
      SELECT item_id, side, ws FROM (
        SELECT item_id, 'q' AS side, CASE WHEN len(p) > 1 THEN flatten(p[:len(p) - 1]) ELSE flatten(p) END AS ws FROM w
        UNION ALL SELECT item_id, 'a', p[len(p)] FROM w) WHERE len(ws) > 0
    ), grams AS (
      SELECT DISTINCT item_id, side, least({decontam.GRAM}, len(ws)) AS n, ws[u.i:u.i + least({decontam.GRAM}, len(ws)) - 1] AS g
      FROM own, unnest(range(1, len(ws) - least({decontam.GRAM}, len(ws)) + 2)) AS u(i)
    ), d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{words}') AS ws FROM documents
    ), have AS (
      SELECT DISTINCT doc_id, ws[u.i:u.i + k.n - 1] AS g FROM d, (SELECT DISTINCT n FROM grams) AS k, unnest(range(1, len(ws) - k.n + 2)) AS u(i)
    ), total AS (SELECT item_id, side, count(*) AS n FROM grams GROUP BY ALL
    ), shares AS (
      SELECT doc_id, item_id, side, count(*)::DOUBLE / any_value(total.n) AS share FROM have JOIN grams USING (g) JOIN total USING (item_id, side) GROUP BY ALL
    )
    SELECT q.doc_id, q.item_id, round(q.share, 6) AS question_overlap, round(a.share, 6) AS answer_overlap
    FROM shares q JOIN shares a ON q.doc_id = a.doc_id AND q.item_id = a.item_id AND q.side = 'q' AND a.side = 'a'
    WHERE q.share >= {decontam.OVERLAP} AND a.share >= {decontam.OVERLAP}
    """


def preferences() -> str:
    turn = f"'{preference.START}' || role || chr(10) || text || '{preference.END}' || chr(10)"
    extra = len(preference.START) + 1
    end = len(preference.END)
    return f"""
    WITH t AS (
      SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'user'), coalesce(text, '')) AS i FROM conversations
    ), last AS (
      SELECT conv_id, count(*) AS n, max(i) FILTER (role = 'assistant') AS l FROM t GROUP BY conv_id
    ), instead AS (
      SELECT last.conv_id, n, l, coalesce(max_by(t.text, t.i) FILTER (role = 'assistant' AND t.i < l), '') AS other, max(t.text) FILTER (t.i = l) AS own FROM last JOIN t USING (conv_id) GROUP BY ALL
    ), common AS (
      SELECT conv_id, other, CASE WHEN l IS NULL THEN n WHEN own = other THEN l ELSE l - 1 END AS n_common, l IS NOT NULL AND own <> other AS differs FROM instead
    ), r AS (
      SELECT t.*, n_common, {turn} AS shown FROM t JOIN common USING (conv_id)
    ), placed AS (
      SELECT *, coalesce(sum(length(shown)) FILTER (i > n_common) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun FROM r
    ), joined AS (
      SELECT conv_id, coalesce(string_agg(shown, '' ORDER BY i) FILTER (i <= n_common), '') AS prompt, coalesce(string_agg(shown, '' ORDER BY i) FILTER (i > n_common), '') AS chosen,
        coalesce(string_agg((begun + {extra} + length(role)) || ':' || (begun + {extra} + length(role) + length(text) + {end}), ',' ORDER BY i) FILTER (i > n_common AND role = 'assistant'), '') AS chosen_mask
      FROM placed GROUP BY conv_id
    )
    SELECT conv_id, n_common::BIGINT AS n_common, prompt, chosen, CASE WHEN differs THEN '{preference.START}assistant' || chr(10) || other || '{preference.END}' || chr(10) ELSE '' END AS rejected,
      chosen_mask, CASE WHEN differs THEN '{extra + 9}:' || ({extra + 9 + end} + length(other)) ELSE '' END AS rejected_mask
    FROM common JOIN joined USING (conv_id)
    """


def near_duplicates(size: int = 4, percent: int = 80) -> str:
    return rf"""
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{SPACE}]+') AS w FROM documents
    ), grams AS (
      SELECT DISTINCT doc_id, w[u.i:u.i + least({size}, len(w)) - 1] AS g FROM d, unnest(range(1, len(w) - least({size}, len(w)) + 2)) AS u(i) WHERE len(w) > 0
    ), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
    ), common AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
    ), links AS (
      SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * common.n >= {percent} * (a.n + b.n - common.n)
    ), reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
    ), smallest AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM smallest LEFT JOIN sizes USING (doc_id)
    """


def ranking(k: int) -> str:
    term = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
    words = lambda key, table: f"SELECT {key}, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{term}')) AS w FROM {table}"
    return f"""
    WITH d AS ({words("doc_id", "documents")}
    ), lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id
    ), whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths
    ), q AS (SELECT item_id, w, count(*) AS times FROM ({words("item_id", "benchmark")}) GROUP BY ALL
    ), tf AS (SELECT doc_id, w, count(*) AS tf FROM d WHERE w IN (SELECT w FROM q) GROUP BY ALL
    ), weights AS (SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, whole GROUP BY w, docs
    ), impacts AS (
      SELECT doc_id, w, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words))) AS s
      FROM tf JOIN weights USING (w) JOIN lengths USING (doc_id), whole
    ), scores AS (SELECT item_id, doc_id, sum(times * s)::BIGINT AS score FROM q JOIN impacts USING (w) GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= {k}
    """


def inner_products(k: int, scale: int, every: int) -> str:
    return f"""
    WITH v AS (
      SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scores AS (
      SELECT q.row, q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v AS q JOIN v ON q.row <> v.row WHERE q.vec_id % {every} = 0
    )
    SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scores QUALIFY rank <= {k}
    """


def centroids(clusters: int, rounds: int, scale: int, size: int, seed: int) -> str:
    """Every round as a pair of tables: the nearest centroid of each vector, then the new centroids. Ids are unique."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT vec_id, k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{r} AS c USING (i) GROUP BY ALL
        ), a{r} AS MATERIALIZED (SELECT vec_id, min(k) AS k, d FROM d{r} JOIN (SELECT vec_id, min(d) AS d FROM d{r} GROUP BY vec_id) USING (vec_id, d) GROUP BY vec_id, d)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY k, i
            ), c{r + 1} AS MATERIALIZED (SELECT k, i, coalesce((s - ((s % n) + n) % n) // n, x)::BIGINT AS x FROM c{r} LEFT JOIN s{r} USING (k, i))""")
    return f"""
    WITH v AS MATERIALIZED (
      SELECT vec_id, unnest(range(1, {size} + 1)) AS i, floor({scale} * unnest(embedding)::DOUBLE)::BIGINT AS x FROM embeddings
      WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), starts AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k FROM (SELECT DISTINCT vec_id FROM v) QUALIFY k < {clusters}
    ), c0 AS MATERIALIZED (SELECT k, i, x FROM v JOIN starts USING (vec_id)
    ), {", ".join(steps)}
    SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
    FROM a{rounds} JOIN (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k) USING (k)
    """


def sql() -> dict[str, str]:
    return {"op4_licenses": licences(), "op5_quality": quality_rules(), "op7_decontam": leaks(), "op8_preference": preferences(), "op10_neardup": near_duplicates(), "op11_lexical": ranking(20), "op12_topk": inner_products(5, 256, 50), "op13_lloyd": centroids(8, 10, 1024, 64, 3)}
