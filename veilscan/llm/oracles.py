"""SQL, for another engine, of the queries that SQL can express."""

from __future__ import annotations

from .ball_clusters import CLUSTERS, DIMENSIONS, ROUNDS, SCALE, SEED as BALL_SEED
from .lexical_search import B, BEST, K
from .line_dedup import MIN_CHARS
from .quality_rules import COMMON_WORDS, COMPARE_WORDS, DIGITS, MAX_CLASS_DISTANCE, MAX_REPEAT_PERCENT, MAX_WORD_DISTANCE, MIN_WORDS, POINTS, POINTS_AS_GAPS, SYMBOLS, UPPER
from .shards import SEED, SHARDS
from .url_filter import ALPHABET, FOLDS, ORDER, RULES, UNIT

#: Unsigned CRC-32 of the bytes of `hex`, their hexadecimal digits: a step for each byte, through the usual table.
CRC32 = """(SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc32(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"


def shards() -> str:
    """Slots by one ordering of all rows; a row's place in it decides both shard and slot."""
    return f"""
WITH tab AS {CRC32},
b AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc32("coalesce(text, '')")} AS text_crc32, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, coalesce('=' || source, '') AS s FROM documents, tab),
f AS (SELECT *, (2 * row_number() OVER (PARTITION BY s ORDER BY h, doc_id, size, text_crc32) - 1) / (2 * count(*) OVER (PARTITION BY s))::DOUBLE AS f FROM b),
r AS (SELECT *, row_number() OVER (ORDER BY f, s, h, doc_id, size, text_crc32) - 1 AS r, count(*) OVER () AS n FROM f)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, ((r * {SHARDS}) // n)::INTEGER AS shard, (r - (((r * {SHARDS}) // n) * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard, source FROM r"""


def quality() -> str:
    esc = lambda s: "".join("\\" + c if not c.isalnum() else c for c in s).replace("'", "''")
    n = lambda chars: f"length(t) - length(regexp_replace(t, '[{esc(chars)}]', '', 'g'))"
    gap = f"regexp_replace(lower(t), '[{esc(POINTS_AS_GAPS)}\\x20\\x09-\\x0D]', ' ', 'g')"
    words = ", ".join(f"('{lang}', {i}, '{w}')" for lang, ws in COMMON_WORDS.items() for i, w in enumerate(ws))
    langs = ", ".join(f"'{x}'" for x in COMMON_WORDS)
    classes = {"upper": UPPER, "digits": DIGITS, "points": POINTS, "symbols": SYMBOLS}
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
g AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT k, count(DISTINCT i + j) AS n FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g), range(3) r(j) WHERE c > 1 GROUP BY k),
lines AS (SELECT k, count(*) - count(DISTINCT x) AS n FROM (SELECT k, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY k),
b AS (SELECT k, doc_id, lang, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, ({n(SYMBOLS)})::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d JOIN w USING (k) LEFT JOIN rep USING (k) LEFT JOIN lines USING (k)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
c1 AS (SELECT k, length(t) - word_chars AS spaces, {", ".join(f"{n(v)} AS {c}" for c, v in classes.items())}, octet_length(encode(t)) - length(t) AS other_bytes, length(t) AS chars FROM f),
cls AS (UNPIVOT (SELECT k, chars - spaces - upper - digits - points - symbols AS letters, upper, digits, spaces, points, symbols, other_bytes FROM c1) ON letters, upper, digits, spaces, points, symbols, other_bytes INTO NAME bin VALUE n),
tok AS (SELECT k, lang, x FROM (SELECT k, lang, unnest(string_split({gap}, ' ')) AS x FROM f WHERE lang IN ({langs})) WHERE x <> ''),
voc(lang, i, x) AS (VALUES {words}),
tw AS (SELECT k, tok.lang, coalesce(i, 99) AS i, count(*) AS n FROM tok LEFT JOIN voc ON voc.lang = tok.lang AND voc.x = tok.x GROUP BY ALL),
wrd AS (SELECT f.k, v.i::VARCHAR AS bin, coalesce(tw.n, 0) AS n FROM f JOIN (SELECT lang, i FROM voc UNION SELECT DISTINCT lang, 99 FROM voc) v ON v.lang = f.lang LEFT JOIN tw ON tw.k = f.k AND tw.i = v.i),
h AS (SELECT 'c' AS kind, * FROM cls UNION ALL SELECT 'w', * FROM wrd),
p AS (SELECT h.*, f.lang, f.base_failed, f.n_words, sum(n) OVER (PARTITION BY kind, k) AS total FROM h JOIN f USING (k)),
ref AS (SELECT kind, lang, bin, sum(n) AS n FROM p WHERE NOT base_failed AND n_words >= {COMPARE_WORDS} AND lang IS NOT NULL GROUP BY ALL),
q AS (SELECT *, n / sum(n) OVER (PARTITION BY kind, lang) AS q FROM ref),
s AS (SELECT p.kind, p.k, p.n / p.total AS a, q.q AS b FROM p JOIN q ON p.kind = q.kind AND p.lang = q.lang AND p.bin = q.bin WHERE p.n_words >= {COMPARE_WORDS} AND p.total > 0),
js AS (SELECT kind, k, sqrt(greatest(0, sum(0.5 * CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + 0.5 * CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END))) AS d FROM s GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(c.d, 0) > {MAX_CLASS_DISTANCE} OR coalesce(x.d, 0) > {MAX_WORD_DISTANCE}) AS kept, round(c.d, 9) AS class_distance, round(x.d, 9) AS word_distance
FROM f LEFT JOIN (SELECT * FROM js WHERE kind = 'c') c ON c.k = f.k LEFT JOIN (SELECT * FROM js WHERE kind = 'w') x ON x.k = f.k"""


def urls() -> str:
    u = "coalesce(url, '')"
    fits = {r.text: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in RULES}
    longest = sorted(RULES, key=lambda r: -len(r.text))
    rule = "CASE " + " ".join(f"WHEN {fits[r.text]} THEN '{r.text}'" for r in longest) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits[r.text]} THEN '{r.verdict}'" for r in longest) + " END"
    lower = lambda x: f"translate({x}, '{UPPER}', '{UPPER.lower()}')"
    part = "(?s)^.*?://"
    steps, below = [], ""
    for k in range(ORDER + 1):
        of = f"SELECT right(gram, {k + 1}) AS g, sum(na) AS na, sum(nr) AS nr FROM counts GROUP BY 1"
        tot = f"SELECT *, sum(na) OVER w AS ta, sum(nr) OVER w AS tr, sum((na > 0)::INT) OVER w AS ka, sum((nr > 0)::INT) OVER w AS kr FROM ({of}) WINDOW w AS (PARTITION BY left(g, {k}))"
        low = ("1.0::DOUBLE / %d" % ALPHABET, "1.0::DOUBLE / %d" % ALPHABET) if not k else ("b.pa", "b.pr")
        p = ", ".join(f"CASE WHEN t{c} > 0 THEN (n{c} + k{c} * {lo}) / (t{c} + k{c})::DOUBLE ELSE {lo} END AS p{c}" for c, lo in zip("ar", low, strict=True))
        steps.append(f"m{k} AS (SELECT x.g, {p} FROM ({tot}) x{f' JOIN m{k - 1} b ON b.g = right(x.g, {k})' if k else ''})")
        below = f"m{k}"
    return f"""
WITH tab AS {CRC32},
u AS (SELECT row_number() OVER () AS k, page_id, {lower(f"regexp_extract({u}, '{part}([^/?#]*)', 1)")} AS host, regexp_extract({u}, '{part}[^/?#]*([^?#]*)', 1) AS path, regexp_replace({lower(u)}, '{part}', '') AS s FROM pages),
j AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM u),
texts AS (SELECT s, ruled, count(*) AS m, {crc32("s")} % {FOLDS} = 0 AS held FROM j, tab GROUP BY s, ruled, t),
grams AS (SELECT s, ruled, m, held, substr(repeat(chr(2), {ORDER}) || s || chr(3), i::BIGINT, {ORDER + 1}) AS gram FROM (SELECT *, unnest(generate_series(1, length(s) + 1)) AS i FROM texts)),
counts AS (SELECT gram, sum(CASE WHEN ruled = 'allow' AND NOT held THEN m ELSE 0 END) AS na, sum(CASE WHEN ruled = 'block' AND NOT held THEN m ELSE 0 END) AS nr FROM grams GROUP BY gram),
{", ".join(steps)},
scores AS (SELECT s, floor(sum(round(ln(pa / pr) * {UNIT})::BIGINT) / count(*))::BIGINT AS score FROM (SELECT DISTINCT s, gram, i FROM (SELECT s, substr(repeat(chr(2), {ORDER}) || s || chr(3), i::BIGINT, {ORDER + 1}) AS gram, i FROM (SELECT s, unnest(generate_series(1, length(s) + 1)) AS i FROM (SELECT DISTINCT s FROM texts)))) JOIN {below} ON g = gram GROUP BY s),
stat AS (SELECT ruled, sum(m * score) / sum(m)::DOUBLE AS mean, sum(m * score::DOUBLE * score) / sum(m) AS square FROM texts JOIN scores USING (s) WHERE held AND ruled IS NOT NULL GROUP BY ruled),
ab AS (SELECT max(mean) FILTER (ruled = 'allow') AS ma, max(mean) FILTER (ruled = 'block') AS mr, max(sqrt(greatest(0, square - mean * mean))) FILTER (ruled = 'allow') AS da, max(sqrt(greatest(0, square - mean * mean))) FILTER (ruled = 'block') AS dr FROM stat),
cut AS (SELECT coalesce(floor(CASE WHEN da + dr > 0 THEN (ma * dr + mr * da) / (da + dr) ELSE (ma + mr) / 2 END), 0) AS cut FROM ab)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN ruled IS NULL THEN score END AS url_score FROM j JOIN scores USING (s), cut"""


def clusters() -> str:
    """Lloyd's rounds by comparing every vector with every centroid."""
    n = DIMENSIONS
    dist = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    near = lambda i: f"a{i} AS MATERIALIZED (SELECT k, id, v, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT k, id, v, j, {dist} AS d FROM kept, c{i}) GROUP BY k, id, v)"
    rounds = []
    for i in range(ROUNDS):
        sums = f"SELECT j, p, ((s - ((s % m) + m) % m) // m)::BIGINT AS x FROM (SELECT j, p, sum(v[p])::HUGEINT AS s, count(*)::HUGEINT AS m FROM a{i}, range(1, {n + 1}) r(p) GROUP BY j, p)"
        rounds += [near(i), f"c{i + 1} AS MATERIALIZED (SELECT c{i}.j, coalesce(m.v, c) AS c FROM c{i} LEFT JOIN (SELECT j, list(x ORDER BY p) AS v FROM ({sums}) GROUP BY j) m USING (j))"]
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id AS id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {n} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (SELECT sha256('{BALL_SEED}' || coalesce(id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT {CLUSTERS})),
{", ".join(rounds)}, {near(ROUNDS)}
SELECT id AS vec_id, a{ROUNDS}.j::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a{ROUNDS}.j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (j)"""


def search() -> str:
    """Scores of every document that holds a term of an item."""
    terms = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {terms("text")} AS t FROM documents),
n AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS len FROM d WHERE len(t) > 0),
q AS MATERIALIZED (SELECT DISTINCT i, item_id, term FROM (SELECT row_number() OVER () AS i, item_id, unnest({terms("text")}) AS term FROM benchmark)),
p AS MATERIALIZED (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY k, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, n GROUP BY term, docs),
m AS (SELECT k, doc_id, {100 - B} + ({B} * len(t) * docs) // len AS m FROM d, n WHERE len(t) > 0),
s AS (SELECT i, item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + {K} * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= {BEST}"""


def lines() -> str:
    """Lines with the smallest document of their key, joined in order again."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT k, doc_id, i, x[i] AS line, translate(trim(x[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM d)),
f AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT l.*, coalesce(first <> doc_id, false) AS gone FROM l LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY k, doc_id"""
