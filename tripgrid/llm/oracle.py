"""The corpus queries that SQL can express, for DuckDB; tests compare the others with brute force."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

# Each level of the mix: its columns, the columns of the level above, and the weight of a node.
_LEVELS = (
    ("domain", "", "CASE domain WHEN 'web' THEN 50e0 WHEN 'forum' THEN 30e0 ELSE 20e0 END"),
    ("domain, lang", "domain", "CASE lang WHEN 'en' THEN 60e0 WHEN 'de' THEN 15e0 WHEN 'fr' THEN 15e0 WHEN 'es' THEN 10e0 ELSE 1e0 END"),
    ("domain, lang, source", "domain, lang", "CASE source WHEN 'src0' THEN 8e0 ELSE 1e0 END"),
)


def _mix() -> str:
    """Budgets level by level: siblings by capacity per weight, full up to the common level."""
    parts = [
        f"""docs AS (
            SELECT doc_id, lang, source, len({_WORDS}) AS n,
                CASE WHEN source IN ('src10', 'src11', 'src12', 'src13', 'src14') THEN 'forum'
                    WHEN source IN ('src15', 'src16', 'src17', 'src18', 'src19') THEN 'books' ELSE 'web' END AS domain,
                md5(concat_ws('|', doc_id::VARCHAR, coalesce(text, ''))) AS own
            FROM documents
        ), leaves AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens FROM docs GROUP BY ALL)"""
    ]
    for k, (own, parent, weight) in enumerate(_LEVELS):
        group = f"PARTITION BY {parent}" if parent else ""
        sort = f"ORDER BY cap / weight, {own}"
        budget = f"(SELECT share FROM level{k - 1} u WHERE {' AND '.join(f'u.{c} = n.{c}' for c in parent.split(', '))})" if parent else "(SELECT sum(tokens)::DOUBLE FROM leaves)"
        parts.append(
            f"""nodes{k} AS (SELECT {own}, (sum(tokens) * 2)::DOUBLE AS cap, {weight} AS weight FROM leaves GROUP BY {own}),
            summed{k} AS (
                SELECT n.*, ({budget} - coalesce(sum(cap) OVER ({group} {sort} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
                    / sum(weight) OVER ({group} {sort} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS height
                FROM nodes{k} n
            ), level{k} AS (
                SELECT *, CASE WHEN cap <= weight * height THEN cap
                    ELSE weight * max(CASE WHEN cap > weight * height THEN height END) OVER ({group}) END AS share
                FROM summed{k}
            )"""
        )
    last = _LEVELS[-1][0]
    parts.append(
        f"""goals AS (
            SELECT {last}, CASE WHEN tokens > 0 THEN floor(share)::BIGINT // tokens ELSE 0 END AS epochs, floor(share)::BIGINT AS target, tokens
            FROM level2 JOIN leaves USING ({last})
        ), keyed AS (
            SELECT d.*, epochs, target - epochs * tokens AS rest, md5(concat_ws('|', '11', epochs::VARCHAR, own)) AS key
            FROM docs d JOIN goals USING ({last})
        ), ranked AS (
            SELECT *, sum(n) OVER (PARTITION BY {last} ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed
        )
        SELECT doc_id, domain, lang, source, epochs + (upto <= rest AND rest < tokens_of)::BIGINT AS copies
        FROM (SELECT *, sum(n) OVER (PARTITION BY {last}) AS tokens_of FROM ranked)
        WHERE epochs > 0 OR upto <= rest"""
    )
    return "WITH " + ", ".join(parts)


# CRC-32 byte by byte over the bytes of ``{0}``, by the table ``t`` of 256 entries.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({0}) + 1), lambda i: ('0x' || substr(hex({0}), 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _spelling() -> str:
    """Words that are near differ by one place: the same without it, or one is the other without it."""
    return f"""
        WITH RECURSIVE bits(i, k, c) AS (
            SELECT unnest(range(256)), 0, unnest(range(256))
            UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
        ), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
        runs AS (
            SELECT coalesce(doc_id::VARCHAR, '') || ':' AS p, {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+'))")} AS w
            FROM documents
        ), counted AS (SELECT p, w, p || w AS s, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY p, w),
        checked AS (SELECT w, n, {_CRC32.format("s")} AS h FROM counted, crc),
        spoiled AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM checked),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM spoiled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
        holes AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places),
        near AS (
            SELECT x.word, y.word AS other, y.n AS other_n FROM holes x JOIN holes y USING (i, a, b) WHERE x.word <> y.word
            UNION SELECT x.word, y.word, y.n FROM holes x JOIN words y ON x.a || x.b = y.word
            UNION SELECT y.word, x.word, x.n FROM holes x JOIN words y ON x.a || x.b = y.word
        ), best AS (
            SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
        ), forms AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
            FROM words LEFT JOIN best USING (word)
        ), chain(word, root, next) AS (
            SELECT word, word, form FROM forms
            UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN forms f ON f.word = c.next
        )
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word) WHERE next IS NULL
    """


def _phrases() -> str:
    """All phrases of up to five words by their places; no structure is shared between lengths."""
    ngrams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM places WHERE i + {k - 1} <= len(w)" for k in range(1, 6)
    )
    return f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
        totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
        found AS (SELECT lang, k, phrase, count(*) AS a FROM ({ngrams}) GROUP BY ALL HAVING count(*) >= 100),
        cuts AS (
            SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM found WHERE k > 1
        ), scored AS (
            SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, n,
                ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
            FROM cuts c JOIN totals t ON t.lang = c.lang
                JOIN found x ON x.lang = c.lang AND x.phrase = array_to_string(w[:j], ' ')
                JOIN found y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:], ' ')
        ), weakest AS (SELECT DISTINCT ON (lang, phrase) * FROM scored ORDER BY lang, phrase, score, j),
        outside AS (
            SELECT * FROM weakest s WHERE NOT EXISTS (
                SELECT 1 FROM weakest b WHERE b.lang = s.lang AND length(b.phrase) > length(s.phrase)
                    AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= 100 * s.a
            )
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM outside)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
    """


ORACLES: dict[str, str] = {
    "op11_spelling": _spelling(),
    "op13_phrases": _phrases(),
    "op3_links": r"""
        WITH parts AS (
            SELECT page_id,
                translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
                html
            FROM pages
        ), rules(rule, verdict, rule_host, rule_path) AS (
            VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
                ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
                ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
        ), ruled AS (
            SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled
            FROM parts LEFT JOIN rules
                ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY page_id, host, path
        ), seeds AS (
            SELECT host, avg((coalesce(ruled, '') = 'allow')::INT) AS good, avg((coalesce(ruled, '') = 'block')::INT) AS bad
            FROM ruled WHERE host <> '' GROUP BY host
        ), hosts AS (
            -- No page links to another host, so all scores stay with the seeds.
            SELECT host, good / sum(good) OVER () AS trust, bad / sum(bad) OVER () AS distrust FROM seeds
        )
        SELECT page_id, host, path, rule,
            coalesce(ruled, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
        FROM ruled LEFT JOIN hosts USING (host)
    """,
    "op5_mixing": _mix(),
    "op9_quality": rf"""
        WITH docs AS (
            SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs)
        ), twice AS (
            SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
        ), measured AS (
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
                len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters,
                length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS n_letters, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_capitals
            FROM docs LEFT JOIN covered USING (doc_id)
        ), judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * n_capitals > n_letters
                OR 2 * n_stutters > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
        FROM judged
    """,
}
