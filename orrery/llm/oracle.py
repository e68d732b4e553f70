"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from . import licenses

SQL: dict[str, str] = {}

SQL["op2_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, regexp_matches(text, '\\|\[INST\]|\[/INST\]|\[SYS\]|\[/SYS\]|\[ROLE |\[/ROLE\]|</?s>') AS clash,
    replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '[INST]', '\[INST]'), '[/INST]', '\[/INST]'),
      '[SYS]', '\[SYS]'), '[/SYS]', '\[/SYS]'), '[ROLE ', '\[ROLE '), '[/ROLE]', '\[/ROLE]'), '<s>', '\<s>'), '</s>', '\</s>') AS escaped
  FROM rows
), sized AS (
  SELECT *, length(CASE WHEN clash THEN escaped ELSE text END)
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 13 ELSE 16 + length(role) END AS piece_chars
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(piece_chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SQL["op4_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(w[s:s+19], ' ') AS phrase FROM d, unnest(range(1, len(w) - 18)) AS t(s)),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, s) AS rn FROM windows),
gone AS (SELECT DISTINCT doc_id, i FROM ranked, unnest(range(s, s + 20)) AS t(i) WHERE rn > 1),
words AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (
  SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.i) AS body
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(string_split_regex({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_BIGRAMS = "SELECT {0}, w[i] || ' ' || w[i + 1] AS gram, count(*) AS k FROM {1}, unnest(range(1, len(w))) AS t(i) GROUP BY ALL"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL["op3_license_scan"] = f"""
WITH templates(name, number, body) AS (VALUES {", ".join(f"({_quoted(name)}, {i}, {_quoted(t)})" for name in sorted(licenses.TEMPLATES) for i, t in enumerate(licenses.TEMPLATES[name][1]))}),
template_words AS (SELECT name, number, {_SPLIT.format(_LOW.format("body"))} AS w FROM templates),
template_grams AS ({_BIGRAMS.format("name, number", "template_words")}),
lines AS (
  SELECT doc_id, i - 1 AS line, {_SPLIT.format(_LOW.format("l[i]"))} AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i)
),
worded AS (
  SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS part FROM lines WHERE len(w) > 0
),
units AS (
  SELECT doc_id, 'line' AS unit, line AS start_line, line + 1 AS end_line, w FROM worded
  UNION ALL
  SELECT doc_id, 'paragraph', min(line), max(line) + 1, flatten(list(w ORDER BY line)) FROM worded GROUP BY doc_id, part HAVING count(*) > 1
  UNION ALL
  SELECT doc_id, 'text', min(line), max(line) + 1, flatten(list(w ORDER BY line)) FROM worded GROUP BY doc_id HAVING count(DISTINCT part) > 1
),
unit_grams AS ({_BIGRAMS.format("doc_id, unit, start_line, end_line, len(w) - 1 AS n", "units")}),
shared AS (
  SELECT doc_id, unit, start_line, end_line, name, number, n, sum(least(u.k, t.k)) AS common
  FROM unit_grams u JOIN template_grams t USING (gram) GROUP BY ALL
),
scored AS (
  SELECT doc_id, unit, start_line, end_line, name, 2.0::DOUBLE * common / (n + (SELECT sum(k) FROM template_grams g WHERE g.name = s.name AND g.number = s.number)) AS dice
  FROM shared s
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, unit, start_line, end_line ORDER BY dice DESC, name) AS rn FROM scored WHERE dice >= {licenses.THRESHOLD}
)
SELECT doc_id, name AS license, unit, start_line, end_line, round(dice, 6) AS dice FROM ranked WHERE rn = 1
"""

SQL["op11_jaccard_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOW.format("coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, len(w) - 1)) AS t(i)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least ON a = d.doc_id
"""

SQL["op12_collocations"] = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex({_LOW.format("coalesce(text, '')")}, '[.,;:!?\n\x0B\f\r]')), '[^ \t]+') AS w FROM documents
),
grams AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m FROM pieces, unnest(range(1, 5)) AS t(m), unnest(range(1, len(w) - m + 2)) AS u(i)),
f AS (SELECT lang, phrase, m, count(*) AS n FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(n) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, m, n AS a FROM f WHERE m > 1 AND n >= 30),
inside AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM c, unnest(range(2, m)) AS t(s), unnest(range(1, m - s + 2)) AS u(i) GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
cut AS (
  SELECT k.lang, k.phrase, k.a, i, x.n AS l, y.n AS r, CAST(2000000 * k.a::HUGEINT // (x.n::HUGEINT + y.n) AS BIGINT) AS score
  FROM kept k, unnest(range(1, k.m)) AS t(i)
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:i], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[i + 1:k.m], ' ')
),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest QUALIFY rank <= 2000)
SELECT lang, rank, phrase, a, l, r, CAST(total.n AS BIGINT) AS n, score FROM ranked JOIN total USING (lang)
"""
