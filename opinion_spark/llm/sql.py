"""Equivalent DuckDB SQL of the queries that SQL can express.

Token ids, trained models and hashes of kept words are beyond it; those queries are tested against brute force,
the library's own encoding and held-out rows.
"""

from __future__ import annotations

from opinion_spark.llm.chat import BLOCK
from opinion_spark.llm.licenses import TEMPLATES
from opinion_spark.llm.quality_rules import (
    CLASS_NOISE,
    CLASSES,
    COMMON_WORDS,
    MAX_CLASS_DISTANCE,
    MAX_WORD_DISTANCE,
    MIN_CHARS,
    MIN_LANGUAGE_WORDS,
    MIN_WORDS,
    WORD_NOISE,
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_scan() -> str:
    values = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in TEMPLATES.items())
    words = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""
WITH templates(license, text) AS (VALUES {values}),
template_words AS (SELECT license, {words.format("text")} AS w FROM templates),
template_shingles AS (SELECT DISTINCT license, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s FROM template_words, unnest(range(1, len(w) - 3)) u(i)),
sizes AS (SELECT license, count(*) AS n_template FROM template_shingles GROUP BY ALL),
doc_words AS (SELECT doc_id, {words.format("text")} AS w FROM documents WHERE text IS NOT NULL),
doc_shingles AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s FROM doc_words, unnest(range(1, len(w) - 3)) u(i)),
shared AS (SELECT doc_id, license, count(*) AS n_shared FROM doc_shingles JOIN template_shingles USING (s) GROUP BY ALL)
SELECT doc_id, license, n_template, n_shared FROM shared JOIN sizes USING (license) WHERE 100 * n_shared >= 75 * n_template
"""


def _quality_rules() -> str:
    blank = r"[\x20\x09-\x0D]"
    classes = [f"(length(t) - length(regexp_replace(t, {_quoted(p)}, '', 'g')))" for p in CLASSES]
    common = ", ".join(map(_quoted, COMMON_WORDS))
    distance = """sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda x:
        (CASE WHEN x[1] > 0 THEN x[1] * log2(2 * x[1] / (x[1] + x[2])) ELSE 0 END
         + CASE WHEN x[2] > 0 THEN x[2] * log2(2 * x[2] / (x[1] + x[2])) ELSE 0 END) / 2))))"""
    shares = "list_transform({c}, lambda x: x / list_sum({c})::DOUBLE)"
    classes_apart = distance.format(p=shares.format(c="k"), q=shares.format(c="rk"))
    words_apart = distance.format(p=shares.format(c="v"), q=shares.format(c="rv"))
    n_common = len(COMMON_WORDS) + 1
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{blank}+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
             list_filter(string_split_regex(lower(t), '{blank}+'), lambda x: x <> '') AS low FROM d),
windows AS (SELECT row, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS g FROM w, unnest(range(1, len(w) - 3)) u(i)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM windows) WHERE c > 1),
inside AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, range(0, 5) r(k) GROUP BY row),
counted AS (
  SELECT w.row, doc_id, lang, length(t) AS chars, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(inside.n, 0)::BIGINT AS n_repeat_words,
         [{", ".join(classes)}, length(t) - coalesce(length(array_to_string(w, '')), 0)] AS known,
         list_transform([{common}], lambda c: len(list_filter(low, lambda x: x = c))) AS listed
  FROM w LEFT JOIN inside ON inside.row = w.row),
histograms AS (
  SELECT *, list_append(known, chars - list_sum(known)::BIGINT) AS k, list_append(listed, n_words - list_sum(listed)::BIGINT) AS v FROM counted),
sums AS (
  SELECT lang, [{", ".join(f"sum(k[{i}])::DOUBLE" for i in range(1, len(CLASSES) + 3))}] AS rk,
         [{", ".join(f"sum(v[{i}])::DOUBLE" for i in range(1, n_common + 1))}] AS rv FROM histograms GROUP BY lang),
judged AS (
  SELECT h.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN list_sum(rv) >= {MIN_LANGUAGE_WORDS} AND chars >= {MIN_CHARS} THEN {classes_apart} END AS dk,
         CASE WHEN list_sum(rv) >= {MIN_LANGUAGE_WORDS} AND n_words >= {MIN_WORDS} THEN {words_apart} END AS dv
  FROM histograms h JOIN sums ON h.lang IS NOT DISTINCT FROM sums.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(dk <= greatest({MAX_CLASS_DISTANCE}, {CLASS_NOISE} / sqrt(chars)), true)
       AND coalesce(dv <= greatest({MAX_WORD_DISTANCE}, {WORD_NOISE} / sqrt(n_words)), true) AS kept
FROM judged
"""


_CHAT = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body, turn FROM conversations),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, speaker, body) - 1 AS rank FROM turns),
people AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM turns WHERE speaker <> 'system'),
headed AS (
  SELECT conv_id, perspective, rank, rank // {BLOCK} AS block, speaker = perspective AS own, body,
         CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || replace(speaker, '<|', '< |') || '|>' || chr(10) END AS head
  FROM ranked JOIN people ON conv_id IS NOT DISTINCT FROM c),
segments AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM segments)
SELECT conv_id, perspective, block, min(place) AS start, count(*) AS n_turns, string_agg(segment, '' ORDER BY rank) AS dialogue,
       coalesce(string_agg((place + length(head))::VARCHAR || '-' || (place + length(segment))::VARCHAR, ',' ORDER BY rank) FILTER (own), '') AS masks
FROM placed GROUP BY conv_id, perspective, block
"""

_SHINGLES = """
{name}_words AS (SELECT {key}, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM {table} WHERE text IS NOT NULL),
{name}_shingles AS (
  SELECT DISTINCT {key}, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s FROM {name}_words, unnest(range(1, greatest(len(w) - 3, 2))) u(i) WHERE len(w) > 0)"""

_CONTAINED = f"""
WITH {_SHINGLES.format(name="d", key="doc_id", table="documents")},
{_SHINGLES.format(name="b", key="item_id", table="benchmark")},
sizes AS (SELECT item_id, count(*) AS n_item FROM b_shingles GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d_shingles JOIN b_shingles USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared FROM shared JOIN sizes USING (item_id) WHERE 100 * n_shared >= 75 * n_item
"""

_LINKED = f"""
WITH RECURSIVE {_SHINGLES.format(name="d", key="doc_id", table="documents")},
sizes AS (SELECT doc_id, count(*) AS n FROM d_shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM d_shingles a JOIN d_shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reached JOIN links ON other = a)
SELECT documents.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM documents JOIN reached USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY documents.doc_id
"""

_NEAR = _LINKED.replace("100 * o >= 75 *", "100 * o >= 85 *")
_DEDUPLICATED = f"SELECT *, doc_id = component_id AS kept FROM ({_NEAR})"

_FIELDS = "[doc_id::VARCHAR, source, lang, {}::VARCHAR, text]"
_LEAF = "sha256(list_aggregate(list_transform({}, lambda x: coalesce(octet_length(encode(x))::VARCHAR || ':' || x, '-')), 'string_agg', ''))"
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""
_TREE = """
{name}(g, level, i, d, n) AS (
  SELECT g, 0, i, d, n FROM {leaves}
  UNION ALL
  SELECT g, level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, level, i // 2)"""
_MANIFEST = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format(_FIELDS.format("n_chars"))} AS leaf,
         {_LEAF.format(_FIELDS.format("(n_chars + 1)"))} AS changed, {_CRC} % 7 = 0 AS tampered FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM rows),
{_TREE.format(name="tree", leaves="leaves")},
subroots AS (SELECT g AS name, d FROM tree WHERE n = 1),
tops AS (SELECT 0 AS g, name, d, row_number() OVER (ORDER BY encode(name)) - 1 AS i, count(*) OVER () AS n FROM subroots),
{_TREE.format(name="top", leaves="tops")},
own(doc_id, tree, g, level, i, n, sofar, node, proof) AS (
  SELECT doc_id, 0, g, 0, i, n, leaf, CASE WHEN tampered THEN changed ELSE leaf END, '' FROM leaves
  UNION ALL
  SELECT o.doc_id, 0, o.g, o.level + 1, o.i // 2, (o.n + 1) // 2, o.sofar,
         sha256(CASE WHEN s.d IS NULL THEN o.node WHEN o.i % 2 = 1 THEN s.d || o.node ELSE o.node || s.d END), o.proof || coalesce(s.d, '')
  FROM own o LEFT JOIN tree s ON s.g = o.g AND s.level = o.level AND s.i = xor(o.i, 1) WHERE o.n > 1),
lifted(doc_id, name, level, i, n, leaf, node, proof) AS (
  SELECT o.doc_id, t.name, 0, t.i, t.n, o.sofar, o.node, o.proof FROM own o JOIN tops t ON t.name = o.g WHERE o.n = 1
  UNION ALL
  SELECT o.doc_id, o.name, o.level + 1, o.i // 2, (o.n + 1) // 2, o.leaf,
         sha256(CASE WHEN s.d IS NULL THEN o.node WHEN o.i % 2 = 1 THEN s.d || o.node ELSE o.node || s.d END), o.proof || coalesce(s.d, '')
  FROM lifted o LEFT JOIN top s ON s.level = o.level AND s.i = xor(o.i, 1) WHERE o.n > 1)
SELECT doc_id, leaf, s.d AS subroot, r.d AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = r.d AS verified
FROM lifted l JOIN subroots s ON s.name = l.name JOIN top r ON r.n = 1 WHERE l.n = 1
"""

_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, row_number() OVER () AS p, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
placed AS (SELECT lang, p, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM words),
runs AS (SELECT lang, w1, lead(w1, 1) OVER x AS w2, lead(w1, 2) OVER x AS w3, lead(w1, 3) OVER x AS w4, lead(w1, 4) OVER x AS w5
  FROM placed WINDOW x AS (PARTITION BY p ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM runs GROUP BY ALL HAVING f >= 100
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING f >= 100
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING f >= 100
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) AS f FROM runs WHERE w4 IS NOT NULL GROUP BY ALL HAVING f >= 100
  UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, count(*) AS f FROM runs WHERE w5 IS NOT NULL GROUP BY ALL HAVING f >= 100),
n AS (SELECT lang, count(*) AS n FROM placed GROUP BY lang),
keyed AS MATERIALIZED (SELECT k, phrase, f, lang || chr(10) || phrase AS key FROM f),
split AS (SELECT lang, k, f AS a, phrase, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS MATERIALIZED (
  SELECT lang, phrase, a, c::INTEGER AS cut, k, lang || chr(10) || list_aggregate(w[1:c], 'string_agg', ' ') AS x,
         lang || chr(10) || list_aggregate(w[c + 1:k], 'string_agg', ' ') AS y
  FROM split, unnest(range(1, k)) u(c)),
gone AS MATERIALIZED (
  SELECT DISTINCT key FROM (SELECT x AS part, a FROM cuts WHERE cut = k - 1 UNION ALL SELECT y, a FROM cuts WHERE cut = 1) q
  JOIN keyed ON key = part WHERE 100 * a >= 100 * f),
with_left AS MATERIALIZED (SELECT cuts.*, f AS l FROM cuts JOIN keyed ON key = x),
with_right AS MATERIALIZED (SELECT with_left.*, f AS r FROM with_left JOIN keyed ON key = y),
scored AS (SELECT *, ((1000::HUGEINT * a * n) // (l::HUGEINT * r))::BIGINT AS score FROM with_right JOIN n USING (lang)),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score, cut
FROM lowest WHERE lang || chr(10) || phrase NOT IN (SELECT key FROM gone) QUALIFY rank <= 2000
"""

SQL: dict[str, str] = {
    "op2_license_scan": _license_scan(),
    "op4_quality_rules": _quality_rules(),
    "op7_chat_formatting": _CHAT,
    "op9_benchmark_decontamination": _CONTAINED,
    "op10_ngram_jaccard_join": _LINKED,
    "op11_merkle_manifest": _MANIFEST,
    "op12_minhash_near_dedup": _DEDUPLICATED,
    "op13_phrase_collocations": _PHRASES.replace("\\\\", "\\"),
}
