"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from graphloom.llm import quality_rules
from graphloom.llm.quality_rules import COUNTS, LENGTHS, LEVELS, QUANTILES, RATIOS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def jaccard(n: int = 5, threshold: int = 80) -> str:
    """Links by a join on shingles, components by their transitive closure."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, chr(10))]
  ELSE list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], chr(10)))) END AS s FROM w),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM rows x JOIN rows y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
  HAVING 100 * count(*) >= {threshold} * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, len(s) AS n_shingles, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id) AS component_id FROM sets"""


def quality(least_docs: int = 50, spread: int = 8, weight: int = 20, grow: int = 2, step: int = 50) -> str:
    """Counts by list functions, sketches and their quantiles by groups and windows."""

    def ratio(r: str) -> str:
        over, under, occurrences = RATIOS[r]
        sure = f"greatest(0, {over} - CAST(ceil(2 * sqrt({over})) AS BIGINT))" if occurrences else over
        return f"CASE WHEN {under} > 0 THEN 1000 * {sure} // {under} ELSE 0 END"

    each = " UNION ALL ".join(f"SELECT g_lang, g_source, '{r}' AS ratio, CAST({ratio(r)} AS BIGINT) AS v FROM once" for r in RATIOS)

    def level(name: str, keys: str) -> str:
        return f"""
{name}_m AS (SELECT {keys} ratio, v, sum(n) AS n FROM sketch GROUP BY {keys} ratio, v),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ratio ORDER BY v) AS upto, sum(n) OVER (PARTITION BY {keys} ratio) AS total FROM {name}_m),
{name} AS (SELECT {keys} ratio, max(total) AS total, {", ".join(f"min(CASE WHEN 1000 * upto >= {p} * total THEN v END) AS q{p}" for p in QUANTILES)}
  FROM {name}_c GROUP BY {keys} ratio)"""

    low, mid, high = LENGTHS
    own = {p: f"CASE WHEN s0.total >= {least_docs} THEN s0.q{p} WHEN s1.total >= {least_docs} THEN s1.q{p} ELSE s2.q{p} END" for p in LENGTHS}
    language = [f"coalesce((s1.total * s1.q{p} + {weight} * s2.q{p}) // (s1.total + {weight}), s2.q{p}) AS l{p}" for p in LEVELS]
    group = [f"coalesce((n0 * g{p} + {weight} * l{p}) // (n0 + {weight}), l{p})" for p in LEVELS]
    reached = f"list_reduce([{', '.join(group)}], lambda a, v: CASE WHEN v <= {grow} * a + {step} THEN v ELSE a END)"
    bounds = [f"max(CASE WHEN ratio = '{r}' THEN {b} END) AS {side}_{r}" for r, (*_, occurrences) in RATIOS.items() for side, b in (("hi", f"{grow} * reached + {step}" if occurrences else "hi"), ("lo", "0" if occurrences else "lo"))]
    kept = " AND ".join(f"({ratio(r)}) BETWEEN coalesce(lo_{r}, -1) AND coalesce(hi_{r}, 9223372036854775807)" for r in RATIOS)
    base = quality_rules.base_failed()
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS g_lang, coalesce('=' || source, '') AS g_source, coalesce(text, '') AS text, {_WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
windows AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d),
grams AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM windows),
again AS (SELECT rid, count(DISTINCT i + k) AS n FROM grams, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY rid),
counts AS (SELECT doc_id, g_lang, g_source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, len(l) AS n_lines FROM d LEFT JOIN again USING (rid)),
once AS (SELECT DISTINCT g_lang, g_source, {", ".join(COUNTS)} FROM counts WHERE NOT {base}),
each_ AS ({each}),
sketch AS (SELECT g_lang, g_source, ratio, v - v % CAST(pow(2, greatest(length(bin(v)) - 8, 0)) AS BIGINT) AS v, count(*) AS n FROM each_ GROUP BY ALL),
{level("s0", "g_lang, g_source,")},{level("s1", "g_lang,")},{level("s2", "")},
near_ AS (SELECT g.g_lang, g.g_source, s2.ratio, {", ".join(f"s0.q{p} AS g{p}" for p in LEVELS)}, s0.total AS n0, {", ".join(language)}, {", ".join(f"{own[p]} AS {c}" for p, c in zip(LENGTHS, "lmh", strict=True))},
  s2.q{low} AS a_l, s2.q{mid} AS a_m, s2.q{high} AS a_h
  FROM (SELECT DISTINCT g_lang, g_source FROM counts) g CROSS JOIN s2 LEFT JOIN s1 ON s1.g_lang = g.g_lang AND s1.ratio = s2.ratio LEFT JOIN s0 ON s0.g_lang = g.g_lang AND s0.g_source = g.g_source AND s0.ratio = s2.ratio),
pick AS (SELECT g_lang, g_source, ratio, {reached} AS reached, h + {spread} * greatest(h - m, a_h - a_m) AS hi, l - {spread} * greatest(m - l, a_m - a_l) AS lo FROM near_),
limits AS (SELECT g_lang, g_source, {", ".join(bounds)} FROM pick GROUP BY g_lang, g_source)
SELECT doc_id, {", ".join(COUNTS)}, {base} AS base_failed, NOT {base} AND {kept} AS kept FROM counts LEFT JOIN limits USING (g_lang, g_source)"""


def archives() -> str:
    """Digests by SHA-1 of the payloads, their 160 bits shown five by five."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS code FROM p),
first AS (SELECT code, min(page_id) AS first FROM d GROUP BY code)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{letters}', CAST((CAST('0x' || substr(code, CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM d JOIN first USING (code)"""


_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, over the table of `_CRC_TABLE`."""
    codes = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc.t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295)"


_CRC_TABLE = """crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(0, 256) r(i)))"""


def resampled(buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> str:
    """Gains by bucket counts, the draw by a window over all documents."""
    words = rf"unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"
    return f"""
WITH {_CRC_TABLE}, d AS (SELECT doc_id, {words} AS w FROM documents), g AS (SELECT {words} AS w FROM benchmark),
v AS MATERIALIZED (SELECT w, {_crc("w")} % {buckets} AS bucket FROM (SELECT w FROM d UNION SELECT w FROM g) x, crc),
s AS (SELECT bucket, count(*) AS n FROM d JOIN v USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM g JOIN v USING (w) GROUP BY bucket),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT sum(n) FROM s) + {buckets})::DOUBLE / ((s.n + 1.0::DOUBLE) * (coalesce((SELECT sum(n) FROM t), 0) + {buckets})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
scores AS (SELECT doc_id, count(w) AS n_features, CASE WHEN count(w) > 0 THEN CAST(floor(CAST(sum(gain) AS DOUBLE) / count(w)) AS BIGINT) ELSE 0 END AS weight FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN v USING (w) LEFT JOIN gain USING (bucket) GROUP BY doc_id),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scores),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM noisy WHERE n_features >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {percent} * n // 100 THEN rank END AS rank FROM noisy LEFT JOIN drawn USING (doc_id)"""


def spelling(every: int = 97, least: int = 5, times: int = 3, ratio: int = 2) -> str:
    """Words one edit apart by what is left of them without one letter."""
    crc = _crc("(doc_id || ':' || r)")
    return rf"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOW}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
hashed AS (SELECT r, n, {crc} AS h FROM (SELECT doc_id, r, count(*) AS n FROM runs GROUP BY doc_id, r) x, crc),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {every} = 0 THEN left(r, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, n FROM hashed) x WHERE length(word) >= {least} GROUP BY word HAVING sum(n) >= {times}),
less AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM v) x),
near AS (SELECT a.word, b.word AS other FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word UNION SELECT less.word, v.word FROM less JOIN v ON v.word = rest UNION SELECT v.word, less.word FROM less JOIN v ON v.word = rest),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-v.n, other)) AS best, max(v.n) AS best_n FROM near JOIN v ON v.word = other GROUP BY near.word),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {ratio} * v.n THEN best END AS form, CASE WHEN best_n >= {ratio} * v.n THEN best_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
up AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form FROM up JOIN forms f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT forms.word, form, coalesce(ends.root, forms.word) AS root, n, n_near, form_n FROM forms
  LEFT JOIN (SELECT up.word, up.root FROM up JOIN forms f ON f.word = up.root WHERE f.form IS NULL) ends ON ends.word = forms.word"""


def near_embeddings(least: float = 0.95) -> str:
    """Links by all cosines, components by their transitive closure."""
    return f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
one AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {least}),
links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), low AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id"""
