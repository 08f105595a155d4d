"""DuckDB SQL of the queries that SQL can express. SQL has no XXH64, CRC-32, classifier or byte-pair encoder of its own,
so operators 2, 4, 5, 6, 7, 11 and 13 are tested against brute force instead; operator 12's CRC-32 is spelt out below."""

from __future__ import annotations


from trefoil.llm import anchors, cascade, importance, mixing, secrets, suffix

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH s AS (SELECT doc_id, source, len({WORDS}) AS size,
             CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) % {mixing.BINS} AS bin
           FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM s GROUP BY source),
w AS (SELECT source, size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM src),
r AS (SELECT *, 3.0::DOUBLE * size AS cap, 3.0::DOUBLE * size / weight AS ratio FROM w),
f AS (SELECT *, (SELECT sum(size) FROM w)::DOUBLE AS total,
        coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
        sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS free FROM r),
l AS (SELECT min_by((total - held) / free, ratio) AS level FROM f WHERE (total - held) / free * weight <= cap),
t AS (SELECT source, size AS source_size, least(cap, weight * level) AS target FROM r, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
b AS (SELECT source, bin, sum(sum(size)) OVER (PARTITION BY source ORDER BY bin) AS upto FROM s GROUP BY source, bin),
c AS (SELECT q.source, any_value(target - whole * source_size) AS rest,
        min({{'off': abs(upto - (target - whole * source_size)), 'cut': bin + 1}}) AS best
      FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source GROUP BY q.source)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, q.source_size, q.target,
  CAST(s.size * (q.whole + CASE WHEN s.bin < (CASE WHEN c.rest <= c.best.off THEN 0 ELSE c.best.cut END) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source JOIN c ON s.source IS NOT DISTINCT FROM c.source
"""


def _located(name: str, pattern: str, source: str = "d") -> str:
    """Matches of a pattern with their places, from the lengths of what stands between them."""
    return rf"""
{name}_m AS (SELECT doc_id, t, regexp_extract_all(t, $re${pattern}$re$) AS h, string_split_regex(t, $re${pattern}$re$) AS p FROM {source}
  WHERE regexp_matches(t, $re${pattern}$re$)),
{name} AS (SELECT doc_id, hit, sum(gap + prev) OVER (PARTITION BY doc_id ORDER BY i) AS a, i FROM (
  SELECT doc_id, i, h[i] AS hit, length(p[i]) AS gap, CASE WHEN i > 1 THEN length(h[i - 1]) ELSE 0 END AS prev
  FROM {name}_m, unnest(range(1, len(h) + 1)) AS u(i)))"""


def _entropy(name: str, kind: str) -> str:
    pattern, _, bits = secrets.CLASSES[kind]
    number, width, terms = secrets.KINDS.index(kind), secrets.WINDOW, secrets.terms()
    told = " OR ".join(f"regexp_full_match(span, $re${rule}$re$)" for rule in secrets.ALLOWED_SPANS)
    return rf"""{_located(name, pattern, 'blank')},
{name}_k AS MATERIALIZED (SELECT * FROM {name} WHERE NOT regexp_full_match(hit, $re${secrets.ALLOWED}$re$)),
{name}_p AS MATERIALIZED (SELECT doc_id, a, w, substr(hit, CAST(w + 1 AS BIGINT), {width}) AS piece FROM {name}_k, unnest(range(0, length(hit) - {width} + 1)) AS u(w)),
{name}_w AS (SELECT doc_id, a, w, sum({terms}[n + 1]) AS s FROM (
  SELECT doc_id, a, w, substr(piece, j, 1) AS c, count(*) AS n FROM {name}_p, unnest(range(1, {width} + 1)) AS v(j) GROUP BY ALL) GROUP BY ALL),
{name}_g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, a ORDER BY w) AS run FROM (
  SELECT *, CASE WHEN w <= lag(w) OVER (PARTITION BY doc_id, a ORDER BY w) + {width} THEN 0 ELSE 1 END AS fresh
  FROM {name}_w WHERE s <= {secrets.most(bits)})),
{name}_r AS (SELECT doc_id, a, min(w) AS v, max(w) + {width} AS w FROM {name}_g GROUP BY doc_id, a, run),
{name}_s AS (SELECT doc_id, {number} AS k, a + v AS a, a + w AS b FROM (
  SELECT r.*, substr(hit, CAST(v + 1 AS BIGINT), CAST(w - v AS BIGINT)) AS span FROM {name}_r r JOIN {name}_k USING (doc_id, a)) WHERE NOT ({told}))"""


_NAMED = "CASE k " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(secrets.KINDS)) + " END || ':' || a || ':' || b"
_BLANK = "t"
for _word in secrets.WORDS:
    _BLANK = f"regexp_replace({_BLANK}, '(?i){_word}', '{' ' * len(_word)}', 'g')"

OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
blank AS (SELECT doc_id, {_BLANK} AS t FROM d),
{_located('x0', secrets.ASSIGN)}, {_located('x1', secrets.ACCESS)}, {_located('x2', secrets.HEX)},
base AS (
  SELECT doc_id, 0 AS k, a, a + length(hit) AS b FROM x0 WHERE length(regexp_extract(hit, $re${secrets.ASSIGN}$re$, 2)) >= 6
  UNION ALL SELECT doc_id, 1, a, a + length(hit) FROM x1 WHERE length(hit) >= 20
  UNION ALL SELECT doc_id, 2, a, a + length(hit) FROM x2),
{_entropy('e0', 'entropy_hex')},
{_entropy('e1', 'entropy_base64')},
found AS (SELECT * FROM e0_s UNION ALL SELECT * FROM e1_s),
cuts AS (SELECT doc_id, k, a, b FROM found UNION
  SELECT found.doc_id, k, base.b, found.b FROM found JOIN (SELECT doc_id, a, b FROM base) base ON base.doc_id = found.doc_id AND base.b > found.a AND base.b < found.b),
added AS (SELECT doc_id, k, a, least(b, coalesce((SELECT min(base.a) FROM base WHERE base.doc_id = cuts.doc_id AND base.a > cuts.a), b)) AS b
  FROM cuts WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = cuts.doc_id AND base.a <= cuts.a AND cuts.a < base.b)),
every AS (SELECT doc_id, string_agg({_NAMED}, ',' ORDER BY a, k, b) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access,
  count(*) FILTER (WHERE k = 2) AS n_hex, string_agg({_NAMED}, ',' ORDER BY a, k, b) AS spans FROM base GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(g.spans, '')) AS base_sha256, coalesce(every.spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN every USING (doc_id)
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
again AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, unnest([0, 1, 2]) AS u(j) GROUP BY doc_id),
b AS (SELECT d.doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
c AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    n_words < {cascade.MIN_WORDS} OR 100 * n_repeat_words > {cascade.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper_n, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS letter_n,
    length(t) - length(regexp_replace(t, '!', '', 'g')) AS bang_n, length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS any_n FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= 3 * n_words AND 2 * word_chars >= 5 * n_words AND word_chars <= 14 * n_words
  AND 10 * n_dup_lines <= 5 * len(string_split(t, chr(10))) AND 10 * upper_n <= 5 * letter_n AND 10 * bang_n <= 5 * n_words
  AND 10 * any_n >= 5 * word_chars AS kept
FROM c
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {anchors.WINDOW - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {anchors.WINDOW - 2})) AS u(i)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY g) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM again, unnest(range(0, {anchors.WINDOW})) AS u(j)),
every AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
each AS (SELECT every.doc_id, every.i, word, gone.i IS NOT NULL AS removed FROM every LEFT JOIN gone ON every.doc_id = gone.doc_id AND every.i = gone.i),
kept AS (SELECT doc_id, count(*) FILTER (WHERE removed) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT removed) AS k FROM each GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * suffix.LENGTH})) AS g FROM d, unnest(range(0, length(h) // 2 - {suffix.LENGTH - 1})) AS u(i)),
again AS (SELECT doc_id, i FROM win QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + {suffix.LENGTH} AS b FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {suffix.LENGTH} THEN 0 ELSE 1 END AS fresh FROM again))
  GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
sums AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS k
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""

def _crc(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes: a fold with the usual table, which comes from the polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    places = f"range(CAST(length(hex(encode({text}))) // 2 AS BIGINT))"
    octets = f"list_transform({places}, lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, {table}[xor(c & 255, b) + 1])), 4294967295)"


def _features(table: str, key: str) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""{table}_w AS (SELECT {key} AS id, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}),
{table}_f AS (SELECT id, array_to_string(w[i:i + n - 1], ' ') AS g FROM {table}_w, unnest(range(1, len(w) + 1)) AS u(i), unnest([1, 2, 3]) AS v(n)
  WHERE i + n - 1 <= len(w))"""


OP12 = rf"""
WITH {_features('documents', 'doc_id')}, {_features('benchmark', 'item_id')},
named AS (SELECT g, {_crc('g')} % {importance.BUCKETS} AS k FROM (SELECT g FROM documents_f UNION SELECT g FROM benchmark_f)),
raw AS (SELECT k, count(*) AS n FROM documents_f JOIN named USING (g) GROUP BY k),
aim AS (SELECT k, count(*) AS n FROM benchmark_f JOIN named USING (g) GROUP BY k),
gain AS (SELECT raw.k, CAST(floor(1000 * ln(
    ((coalesce(aim.n, 0) + 1) * ((SELECT count(*) FROM documents_f) + {importance.SMOOTHING}))::DOUBLE
    / ((raw.n + 1) * ((SELECT count(*) FROM benchmark_f) + {importance.SMOOTHING}))::DOUBLE)) AS BIGINT) AS v
  FROM raw LEFT JOIN aim ON aim.k = raw.k),
weighed AS (SELECT id, count(*) AS n, CAST(sum(v) AS BIGINT) AS weight FROM documents_f JOIN named USING (g) JOIN gain USING (k) GROUP BY id),
scored AS (SELECT d.id AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.id), 1, 8))::BIGINT + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM documents_w d LEFT JOIN weighed ON weighed.id = d.id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= {importance.LEAST_WORDS})
SELECT s.doc_id, n_features, weight, score,
  CASE WHEN rank <= {importance.PERCENT} * (SELECT count(*) FROM placed) // 100 THEN rank END AS rank
FROM scored s LEFT JOIN placed ON placed.doc_id = s.doc_id
"""

ORACLES: dict[str, str] = {
    "op1_mix_sources": OP1, "op3_secret_scan": OP3, "op8_rule_cascade": OP8, "op9_block_anchors": OP9, "op10_suffix_dedup": OP10,
    "op12_importance_resampling": OP12,
}
