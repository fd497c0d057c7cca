"""DuckDB twins of the corpus queries, where SQL expresses them."""

BLANKS = r"[\x20\x09-\x0D]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWERED}, '{BLANKS}'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

QUALITY = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANKS}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines
  FROM documents
), lines AS (
  SELECT doc_id, unnest(full_lines) AS line, generate_subscripts(full_lines, 1) AS i FROM split
), judged AS (
  SELECT *, list_filter(regexp_split_to_array(line, '{BLANKS}'), lambda x: x <> '') AS lw,
    length(line) - length(translate(line, '#*$%&<>', '')) AS symbols, length(line) - length(replace(line, '|', '')) AS bars,
    length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) AS capitals
  FROM lines
), stay AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS clean FROM judged
  WHERE NOT (symbols > 0.2 * len(lw) OR (len(lw) >= 3 AND capitals > 0.6 * letters)
    OR (len(lw) >= 3 AND bars > 0.3 * len(lw)) OR (len(lw) < 3 AND NOT regexp_matches(line, '[.!?:;,"'')\]]\s*$'))
    OR (len(lw) <= 40 AND regexp_matches(lower(line), 'accept cookies|all rights reserved|click here|cookie policy|privacy policy|sign up for our newsletter|subscribe to our|terms of use|terms of service|enable javascript|lorem ipsum'))
    OR (len(lw) >= 10 AND len(list_distinct(lw)) < 0.25 * len(lw) AND pow(len(list_distinct(lw)), 2) < 4 * len(lw)))
  GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY doc_id
), counts AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    CAST(length(regexp_replace(coalesce(t.clean, ''), '{BLANKS}', '', 'g')) AS BIGINT) AS kept_chars
  FROM split s LEFT JOIN covered c USING (doc_id) LEFT JOIN stay t USING (doc_id)
)
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND word_chars - kept_chars <= 0.5 * word_chars AS kept
FROM counts
"""

LICENSES = rf"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), found AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t,
    list_filter(range(1, len(w)), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS mit,
    list_filter(range(1, len(w)), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS apache,
    list_filter(range(1, len(w) - 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS gpl
  FROM split
), labelled AS (
  SELECT *, list_concat(list_concat(mit, apache), gpl) AS places,
    list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS base,
    list_filter([
      CASE WHEN regexp_matches(t, ' under the (terms of the )?mit license ') THEN 'mit' END,
      CASE WHEN regexp_matches(t, ' permission is hereby granted free of charge to any person obtaining a copy of [a-z]+( [a-z]+)?( [a-z]+)? software and associated documentation files ') THEN 'mit-grant' END,
      CASE WHEN contains(t, ' licensed under the apache license ') THEN 'apache' END,
      CASE WHEN regexp_matches(t, ' under the (terms of the )?(gnu )?general public license ') THEN 'gpl' END,
      CASE WHEN contains(t, ' this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation ') THEN 'gpl-grant' END,
      CASE WHEN contains(t, ' redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met ') THEN 'bsd' END,
      CASE WHEN regexp_matches(t, ' licensed under (a )?(the )?cc by ') THEN 'cc-by' END,
      CASE WHEN contains(t, ' subject to the terms of the mozilla public license ') THEN 'mpl' END
    ], lambda x: x IS NOT NULL) AS method
  FROM found
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, method))), ','), '') AS labels,
  CAST(CASE WHEN len(method) > 0 THEN 1 WHEN len(base) > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS score
FROM labelled
"""


def _strength(table: str) -> str:
    """The prior's weight from the rates of a level, as in ``reputation._strength``."""
    return f"""(SELECT CASE WHEN m IS NULL THEN 2.0 WHEN v - m * (1 - m) * noise > 1e-9 THEN least(1000.0, greatest(1.0, m * (1 - m) / (v - m * (1 - m) * noise) - 1)) ELSE 1000.0 END
    FROM (SELECT avg(bad / n) AS m, coalesce(var_pop(bad / n), 0) AS v, avg(1.0::DOUBLE / n) AS noise FROM {table}))"""


REPUTATION = rf"""
WITH base AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM base
), ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts
), judged AS (
  SELECT *, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS verdict FROM ruled
), names AS (
  SELECT host, regexp_matches(host, '^[0-9.]+(:[0-9]+)?$|^\[') AS address, string_split(regexp_replace(host, ':[0-9]+$|\.+$', '', 'g'), '.') AS l FROM (SELECT DISTINCT host FROM judged)
), levels AS (
  SELECT host, CASE WHEN address THEN host ELSE array_to_string(l[-2:], '.') END AS domain, CASE WHEN address THEN '' ELSE l[-1] END AS suffix FROM names
), by_host AS (
  SELECT host, domain, suffix, count(*)::DOUBLE AS n, count_if(verdict = 'block')::DOUBLE AS bad FROM judged JOIN levels USING (host) WHERE verdict IS NOT NULL GROUP BY ALL
), total AS (
  SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 1) / (sum(n) + 2) ELSE 0.5 END AS mean FROM by_host
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM by_host GROUP BY suffix
), s1 AS (
  SELECT suffix, bad + w * mean AS a, n - bad + w * (1 - mean) AS b FROM s0, total, (SELECT {_strength("s0")} AS w)
), d0 AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM by_host GROUP BY ALL
), d1 AS (
  SELECT domain, bad + w * p AS a, n - bad + w * (1 - p) AS b FROM (SELECT d0.*, a / (a + b) AS p FROM d0 JOIN s1 USING (suffix)), (SELECT {_strength("d0")} AS w)
), h1 AS (
  SELECT host, bad + w * p AS a, n - bad + w * (1 - p) AS b FROM (SELECT by_host.*, a / (a + b) AS p FROM by_host JOIN d1 USING (domain)), (SELECT {_strength("by_host")} AS w)
), best AS (
  SELECT l.host, coalesce(h1.a, d1.a, s1.a, 2 * mean) AS a, coalesce(h1.b, d1.b, s1.b, 2 * (1 - mean)) AS b
  FROM levels l CROSS JOIN total LEFT JOIN h1 ON h1.host = l.host LEFT JOIN d1 ON d1.domain = l.domain LEFT JOIN s1 ON s1.suffix = l.suffix
), bound AS (
  SELECT host, greatest(0, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1))) AS bad_rate FROM best
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad_rate > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(bad_rate, 6) AS bad_rate
FROM judged JOIN bound USING (host)
"""
