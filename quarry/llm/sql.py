"""DuckDB SQL with the results of the registered queries."""

from quarry.llm import host_rules, licenses, sharding, spans, words

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD3 = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORD = r"'[^\x20\x09-\x0D]+'"

OP2 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, {_WORD}), []) AS w FROM documents),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, run) AS often
  FROM (SELECT r, i, array_to_string(list_slice(w, i, i + 2), ' ') AS run FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2))),
repeated AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 3)) AS at FROM windows WHERE often > 1) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS x FROM d),
m AS (
  SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(x) - len(list_distinct(x)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d JOIN lines USING (r) LEFT JOIN repeated USING (r)),
rules AS (
  SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE bad) AS failed
  FROM (
    SELECT source, unnest(['short', 'repetitive', 'symbols', 'dup_lines']) AS rule,
      unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > 3 * word_chars, 4 * n_dup_lines > n_words]) AS bad
    FROM m WHERE source IS NOT NULL)
  GROUP BY source, rule),
sums AS (
  SELECT rule, count(*) AS hosts, sum(n) AS every, sum(n * n) AS squares, sum(failed) / sum(n) AS mean, sum(failed * failed / n) AS spread FROM rules GROUP BY rule),
varied AS (
  SELECT rule, mean,
    ((spread - every * mean * mean) / nullif(mean * (1 - mean), 0) - (hosts - 1)) / nullif(every - squares / every - (hosts - 1), 0) AS alike FROM sums),
strength AS (
  SELECT rule, mean, CASE WHEN alike > 0 THEN greatest({host_rules.LEAST_STRENGTH}, least({host_rules.MAX_STRENGTH}, 1 / alike - 1)) ELSE {host_rules.MAX_STRENGTH} END AS strength FROM varied),
rejected AS (
  SELECT DISTINCT source FROM rules JOIN strength USING (rule) WHERE (failed + mean * strength) / (n + strength) > 2.0 / 3)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r.source IS NULL AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m) m LEFT JOIN rejected r ON m.source = r.source
"""

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_FOLD}, {_WORD3}), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD}, {_WORD3}) AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT r, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS run
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT r, i, g.size, item_id FROM grams g JOIN windows USING (size, run)),
n_hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS at FROM hits) GROUP BY r),
n_items AS (
  SELECT r, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS hash
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit.n, 0) AS n_hit, coalesce(n_items.n, 0) AS n_items,
  coalesce(hash, sha256('')) AS items_sha256, n_hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN n_items USING (r)
"""

# The clamped sources are a prefix of the sources by cap over weight: the shortest one after which none is above.
OP4 = f"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {_WORD})), 0) AS BIGINT) AS size,
    ('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
weights AS (
  SELECT source, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS INTEGER) + 1]::DOUBLE AS weight
  FROM (SELECT DISTINCT source FROM rows)),
sources AS (
  SELECT s.source, weight, source_size, sum(source_size) OVER () AS total
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source) s
  JOIN weights w ON s.source IS NOT DISTINCT FROM w.source),
ordered AS (
  SELECT *, row_number() OVER o - 1 AS k, coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM sources WINDOW o AS (ORDER BY source_size / weight, encode(source))),
level AS (
  SELECT k, fixed, free FROM ordered
  WHERE weight * CAST(total - fixed AS DOUBLE) / free <= 3 * source_size ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size,
    CASE WHEN o.k < level.k THEN CAST(3 * source_size AS DOUBLE) ELSE weight * CAST(total - level.fixed AS DOUBLE) / level.free END AS target
  FROM ordered o, level),
plan AS (
  SELECT *, CAST(round(target) AS BIGINT) AS words,
    CASE WHEN source_size > 0 THEN least(3, CAST(round(target) AS BIGINT) // source_size) ELSE 0 END AS whole
  FROM targets),
running AS (
  SELECT doc_id, size, h, p.source_size, target, whole, words - whole * p.source_size AS extra,
    sum(size) OVER (PARTITION BY r.source ORDER BY h, size) AS through, sum(size) OVER (PARTITION BY r.source, h, size) AS own,
    count(*) OVER (PARTITION BY r.source, h, size) AS n
  FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + CASE WHEN through <= extra THEN size WHEN through - own <= extra THEN (extra - (through - own)) // n ELSE 0 END AS BIGINT) AS taken
FROM running
"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in row) + ")" for row in rows)


_CLEAN = "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
_RULE_PARTS = [(rule, part, name, len(names)) for rule, (_, names) in enumerate(licenses.RULES) for part, name in enumerate(names)]

# A document's known sentences are numbered; at each number the first rule that fits takes as many as it has, or none
# and the next is tried.
OP1 = rf"""
WITH RECURSIVE known(name, body) AS (VALUES {_values([(k, v) for k, v in licenses.SENTENCES.items()])}),
rules(rule, part, name, size) AS (VALUES {_values(_RULE_PARTS)}),
licences(rule, licence) AS (VALUES {_values([(k, licence) for k, (licence, _) in enumerate(licenses.RULES)])}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
pieces AS (
  SELECT r, unnest(x) AS body, unnest(range(len(x))) AS piece
  FROM (SELECT r, string_split_regex(text, '[.;:!?]+([ \t\r\n]|$)|\n[ \t\r]*\n') AS x FROM d)),
parts AS (
  SELECT r, body, row_number() OVER (PARTITION BY r ORDER BY piece) - 1 AS position FROM pieces WHERE regexp_matches(body, '[^\x20\x09-\x0D]')),
wholes AS (SELECT r, position, body, name FROM (SELECT *, {_CLEAN.format("body")} AS clean FROM parts) p LEFT JOIN (SELECT name, body AS clean FROM known) k USING (clean)),
lines AS (
  SELECT r, position, unnest(x) AS body, unnest(range(len(x))) AS line
  FROM (SELECT r, position, string_split(body, chr(10)) AS x FROM wholes WHERE name IS NULL)),
every_found AS (
  SELECT r, position, 0 AS line, name FROM wholes WHERE name IS NOT NULL UNION ALL
  SELECT r, position, line, name FROM (SELECT *, {_CLEAN.format("body")} AS clean FROM lines) JOIN (SELECT name, body AS clean FROM known) k USING (clean)),
found AS (
  SELECT r, position, line, name
  FROM (SELECT *, lag(name) OVER w AS name_before, lag(position) OVER w AS position_before FROM every_found WINDOW w AS (PARTITION BY r ORDER BY position, line))
  WHERE NOT starts_with(name, 'spdx ') OR coalesce(name_before = 'spdx' AND position_before = position - 1, FALSE)),
seq AS (SELECT r, position, name, row_number() OVER (PARTITION BY r ORDER BY position, line) - 1 AS i FROM found),
steps AS (SELECT *, position - lag(position) OVER (PARTITION BY r ORDER BY i) AS gap FROM seq),
fits AS (
  SELECT s.r, s.i, t.rule, t.size, max(n.position) AS last
  FROM seq s JOIN rules t ON t.part = 0 AND t.name = s.name
  JOIN rules u ON u.rule = t.rule JOIN steps n ON n.r = s.r AND n.i = s.i + u.part AND n.name = u.name AND (u.part = 0 OR n.gap <= {licenses.GAP})
  GROUP BY s.r, s.i, t.rule, t.size HAVING count(*) = t.size),
best AS (SELECT r, i, min(rule) AS rule, arg_min(size, rule) AS size, arg_min(last, rule) AS last FROM fits GROUP BY r, i),
walk AS (
  SELECT s.r, s.i, s.position, b.rule, b.last, coalesce(b.size, 1) AS size FROM seq s LEFT JOIN best b USING (r, i) WHERE s.i = 0 UNION ALL
  SELECT s.r, s.i, s.position, b.rule, b.last, coalesce(b.size, 1) AS size
  FROM walk w JOIN seq s ON s.r = w.r AND s.i = w.i + w.size LEFT JOIN best b ON b.r = s.r AND b.i = s.i),
matches AS (SELECT r, string_agg(position || ':' || last || ':' || licence, ',' ORDER BY i) AS x FROM walk JOIN licences USING (rule) GROUP BY r),
named AS (SELECT r, string_agg(position || ':' || name, ',' ORDER BY i) AS x FROM seq GROUP BY r),
counts AS (SELECT r, count(*) AS n FROM parts GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(named.x, '') AS identifiers, coalesce(matches.x, '') AS licences
FROM d LEFT JOIN counts USING (r) LEFT JOIN named USING (r) LEFT JOIN matches USING (r)
"""

# A word's digest is a polynomial over its bytes modulo 2^64, mixed. A document is a text under an id. A sentence of more than LONGEST words is cut before each word whose digest is not more than
# those of the NEAR words before and after it.
OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
one AS (SELECT min(r) AS r, doc_id, text FROM d WHERE doc_id IS NOT NULL GROUP BY doc_id, text),
every AS (SELECT d.r, coalesce(one.r, d.r) AS own, d.doc_id FROM d LEFT JOIN one ON d.doc_id = one.doc_id AND d.text IS NOT DISTINCT FROM one.text),
texts AS (SELECT r, doc_id, text FROM one UNION ALL SELECT r, doc_id, text FROM d WHERE doc_id IS NULL),
lines AS (
  SELECT r, unnest(x) AS body, unnest(range(len(x))) AS line FROM (SELECT r, string_split(text, chr(10)) AS x FROM texts)),
pieces AS (
  SELECT r, line, unnest(x) AS body, unnest(range(len(x))) AS piece
  FROM (SELECT r, line, string_split(regexp_replace(body, '([.!?]+)([ \t\r]|$)', '\1' || chr(10), 'g'), chr(10)) AS x FROM lines)),
spoken AS (
  SELECT r, line, piece, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM pieces),
every_word AS (SELECT r, line, piece, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS nth FROM spoken WHERE len(w) > 0),
vocabulary AS (SELECT DISTINCT word, hex(encode(word)) AS hexed FROM every_word),
polynomials AS (
  SELECT word, list_reduce(list_prepend(0::UHUGEINT, list_reverse(list_transform(range(length(hexed) // 2), lambda i: ('0x' || substr(hexed, 2 * i + 1, 2))::INTEGER::UHUGEINT))),
    lambda h, b: (h * {words.BYTE_FACTOR}::UHUGEINT + b) % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM vocabulary),
digests AS (SELECT word, ((xor(h, h >> 31)::UHUGEINT * {words.BYTE_MIXER}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT >> 1 AS digest FROM polynomials),
ranked_words AS (
  SELECT e.*, digest,
    min(digest) OVER (PARTITION BY r, line, piece ORDER BY nth ROWS BETWEEN {spans.NEAR} PRECEDING AND 1 PRECEDING) AS ahead,
    min(digest) OVER (PARTITION BY r, line, piece ORDER BY nth ROWS BETWEEN 1 FOLLOWING AND {spans.NEAR} FOLLOWING) AS behind
  FROM every_word e JOIN digests USING (word)),
cut_words AS (
  SELECT *, nth = 0 OR (n > {spans.LONGEST} AND digest <= ahead AND (behind IS NULL OR digest <= behind)) AS first FROM ranked_words),
numbered AS (SELECT *, CAST(sum(first::INT) OVER (PARTITION BY r ORDER BY line, piece, nth) AS BIGINT) - 1 AS i FROM cut_words),
s AS (SELECT r, i, string_agg(word, ' ' ORDER BY nth) AS body, count(*) AS n FROM numbered GROUP BY r, i),
through AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY i) AS total, sum(n) OVER (PARTITION BY r ORDER BY i) - n AS before FROM s),
long AS (
  SELECT a.r, a.i, b.i AS j FROM through a
  JOIN through b ON a.r = b.r AND b.i >= a.i + {spans.SENTENCES - 1} AND b.total >= a.before + {spans.WORDS} AND b.i < a.i + {spans.SENTENCES + spans.WORDS}),
ends AS (SELECT r, i, min(j) AS j FROM long GROUP BY r, i UNION SELECT r, max(i) AS i, j FROM long GROUP BY r, j),
runs AS (
  SELECT e.r, e.i, e.j, string_agg(s.body, ' ' ORDER BY s.i) AS run
  FROM ends e JOIN s ON s.r = e.r AND s.i BETWEEN e.i AND e.j GROUP BY e.r, e.i, e.j),
ranked AS (
  SELECT r, i, j, first_value(doc_id) OVER (PARTITION BY run ORDER BY doc_id, r, i) AS home, row_number() OVER (PARTITION BY run ORDER BY doc_id, r, i) AS k
  FROM runs JOIN one USING (r)),
gone AS (SELECT r, home, unnest(range(i, j + 1)) AS i FROM ranked WHERE k > 1),
homes AS (SELECT r, min(home) AS first_doc_id, count(DISTINCT i) AS n_removed FROM gone GROUP BY r),
kept AS (
  SELECT s.r, count(*) AS n_sentences, CAST(sum(n) AS BIGINT) AS n_words, CAST(coalesce(sum(n) FILTER (WHERE g.i IS NULL), 0) AS BIGINT) AS n_kept_words,
    sha256(coalesce(string_agg(body, ' ' ORDER BY s.i) FILTER (WHERE g.i IS NULL), '')) AS words_sha256
  FROM s LEFT JOIN (SELECT DISTINCT r, i FROM gone) g ON g.r = s.r AND g.i = s.i GROUP BY s.r)
SELECT e.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(n_words, 0) AS n_words,
  coalesce(n_kept_words, 0) AS n_kept_words, coalesce(words_sha256, sha256('')) AS words_sha256, coalesce(first_doc_id, e.doc_id) AS first_doc_id
FROM every e LEFT JOIN kept ON kept.r = e.own LEFT JOIN homes ON homes.r = e.own
"""


def op7(shards: list[str], slots: int) -> str:
    """The table of slots as a list, and the slot of each document from the digest of its id."""
    table = sharding.fill(shards, slots)
    return (
        f"WITH t AS (SELECT {table}::INTEGER[] AS owner, {shards}::VARCHAR[] AS shards), placed AS ("
        f"SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {slots} AS INTEGER) AS slot FROM documents)"
        " SELECT doc_id, slot, shards[owner[slot + 1] + 1] AS shard FROM placed, t"
    )
