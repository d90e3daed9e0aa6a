"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tesserine.llm import quality, sharding, urls

WORDS = "regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\x0c\\r]+')"

_MEASURES = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, floor({quality.STEPS} * ln(1 + {m}))::INT AS bucket FROM shares" for m in quality.MEASURES)
_LEVELS = " UNION ALL ".join(
    f"SELECT {level} AS level, {lang} AS lang, {source} AS source, measure, bucket, count(*) AS n FROM buckets GROUP BY ALL"
    for level, lang, source in ((2, "lang", "source"), (1, "lang", "NULL"), (0, "NULL", "NULL")))
_LEAST = " ".join(f"WHEN '{m}' THEN {v}" for m, v in quality.MEASURES.items())


def _limit(level: int) -> str:
    keys = " AND ".join(f"f.{k} = s.{k}" for k in ("lang", "source")[:level]) or "true"
    return f"(SELECT fence FROM fences f WHERE f.level = {level} AND {keys} AND f.measure = m.measure AND (f.level = 0 OR f.total >= {quality.OWN_SKETCH}))"


QUALITY = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \\t\\n\\x0b\\x0c\\r]')) AS lines FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM docs)),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM windows GROUP BY doc_id, x HAVING count(*) > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {quality.WINDOW})) AS p FROM twice) GROUP BY doc_id),
counts AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals FROM docs d LEFT JOIN repeats r USING (doc_id)),
shares AS (SELECT *, 1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * n_capitals // greatest(word_chars, 1) AS capitals FROM counts),
buckets AS ({_MEASURES}), levels AS ({_LEVELS}),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto FROM levels),
quart AS (SELECT level, lang, source, measure, total, min(bucket) FILTER (100 * upto >= 25 * total) AS q25, min(bucket) FILTER (100 * upto >= 50 * total) AS q50 FROM ranked GROUP BY ALL),
vals AS (SELECT *, round(exp((q25 + 1) / {quality.STEPS}.0) - 1)::BIGINT AS v25, round(exp((q50 + 1) / {quality.STEPS}.0) - 1)::BIGINT AS v50 FROM quart),
fences AS (SELECT level, lang, source, measure, total, v50 + {quality.REACH} * greatest(v50 - v25, CASE measure {_LEAST} END) AS fence FROM vals),
limits AS (SELECT s.lang, s.source, m.measure, coalesce({_limit(2)}, {_limit(1)}, {_limit(0)}) AS fence
    FROM (SELECT DISTINCT lang, source FROM shares) s, (SELECT DISTINCT measure FROM fences) m),
wide AS (SELECT lang, source, {', '.join(f"max(fence) FILTER (measure = '{m}') AS f_{m}" for m in quality.MEASURES)} FROM limits GROUP BY ALL),
judged AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words AS base_failed,
    {' AND '.join(f'{m} <= f_{m}' for m in quality.MEASURES)} AS within FROM shares JOIN wide USING (lang, source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND within AS kept FROM judged
"""

_DIGITS = "[('0x' || substr(sha, 5 * i + 1, 5))::BIGINT for i in range(8)]"
WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
d AS (SELECT *, {_DIGITS} AS v FROM p)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM d
"""


def url_filter(rules: list[urls.Rule]) -> str:
    """The URL filter as SQL, a few tables per level."""
    rule = verdict = "NULL"
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{host}{path}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{says}' ELSE {verdict} END"
    sums = "sum(n)::BIGINT AS n, sum(labelled)::BIGINT AS labelled, sum(blocked)::BIGINT AS blocked"
    ctes = [
        "h AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, "
        "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"g AS (SELECT *, {rule} AS rule, {verdict} AS given, list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda s: s <> '') AS seg FROM h)",
        f"u AS (SELECT * EXCLUDE seg, CASE WHEN len(seg) > {urls.DEPTH} THEN list_append(seg[1:{urls.DEPTH}], '**') ELSE seg END AS shape FROM g)",
        "l0 AS (SELECT host, shape, []::VARCHAR[] AS template, count(*) AS n, count(given) AS labelled, count(*) FILTER (given = 'block') AS blocked FROM u GROUP BY host, shape)",
        f"r0 AS (SELECT host, []::VARCHAR[] AS template, {sums}, (sum(blocked) + {urls.WEIGHT / 2}) / (sum(labelled) + {urls.WEIGHT}) AS rate FROM l0 GROUP BY host)"]
    for d in range(urls.DEPTH + 1):
        ctes += [
            f"c{d} AS (SELECT host, template, shape[{d + 1}] AS s, sum(n) AS n FROM l{d} WHERE shape[{d + 1}] IS NOT NULL GROUP BY ALL)",
            f"o{d} AS (SELECT *, n >= {urls.OWN_URLS} AND 100 * n >= {urls.OWN_PERCENT} * sum(n) OVER (PARTITION BY host, template) AS own FROM c{d})",
            f"l{d + 1} AS (SELECT l.host, shape, CASE WHEN shape[{d + 1}] IS NULL THEN l.template ELSE list_append(l.template, CASE WHEN own THEN s ELSE '*' END) END AS template, l.n, labelled, blocked "
            f"FROM l{d} l LEFT JOIN o{d} o ON l.host = o.host AND l.template = o.template AND shape[{d + 1}] = s)",
            f"b{d} AS (SELECT host, template, {sums} FROM l{d + 1} WHERE len(template) = {d + 1} GROUP BY ALL)",
            f"r{d + 1} AS (SELECT b.host, b.template, b.n, b.labelled, b.blocked, CASE WHEN pow(b.blocked::DOUBLE * (r.labelled - b.labelled) - (r.blocked - b.blocked)::DOUBLE * b.labelled, 2) * r.labelled "
            f"> {urls.DIFFER**2} * r.blocked * (r.labelled - r.blocked) * b.labelled * (r.labelled - b.labelled) THEN (b.blocked + {urls.WEIGHT} * r.rate) / (b.labelled + {urls.WEIGHT}) ELSE r.rate END AS rate "
            f"FROM b{d} b JOIN r{d} r ON b.host = r.host AND b.template[1:{d}] = r.template)"]
    rates = " UNION ALL ".join(f"SELECT host, template, rate FROM r{d}" for d in range(urls.DEPTH + 2))
    return f"""WITH {', '.join(ctes)}, rates AS ({rates})
SELECT u.page_id, u.host, u.path, u.rule, coalesce(u.given, CASE WHEN t.rate >= {urls.PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
  '/' || array_to_string(l.template, '/') AS template, round(t.rate, 6) AS rate
FROM u JOIN l{urls.DEPTH + 1} l ON u.host = l.host AND u.shape = l.shape JOIN rates t ON l.host = t.host AND l.template = t.template"""


def contaminated(docs: str, percent: int = 80, shingle: int = 5) -> str:
    """Pairs of a document of table ``docs`` and a benchmark item it holds."""

    def sets(table: str, key: str) -> str:
        words = WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
        return (f"SELECT DISTINCT {key}, array_to_string(w[i:i + {shingle - 1}], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, len(w) - {shingle - 2})) AS i "
                f"FROM (SELECT {key}, {words} AS w FROM {table}))")

    return f"""WITH d AS ({sets(docs, 'doc_id')}), i AS ({sets('benchmark', 'item_id')}), n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY ALL HAVING 100 * count(*) >= {percent} * n_shingles"""


_LOWER_WORDS = WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w) + 1, 2)))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
old AS (SELECT doc_id, i FROM (SELECT doc_id, i, rank() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM v) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM old),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


def _crc_table() -> list[int]:
    """The checksum of each byte, from the reversed polynomial of CRC-32."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, x: xor(a >> 8, ({_crc_table()}::BIGINT[])[(xor(a, x) & 255) + 1])), 4294967295)"


TRIE = f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
known AS (SELECT conv_id, turn, md5(length(role)::VARCHAR || ':' || role || text) AS turn_id, strlen(text) AS bytes FROM turns),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, turn_id) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM known),
convs AS (SELECT DISTINCT conv_id, n, conv_id - conv_id % 5 AS leader, {crc32("conv_id::VARCHAR")} % 9 AS h FROM own),
heads AS (SELECT c.conv_id, o.p, o.turn_id, o.bytes FROM convs c JOIN own o ON o.conv_id = c.leader AND o.p <= c.h),
seqs AS (SELECT conv_id, 0 AS part, p, turn_id, bytes FROM heads UNION ALL SELECT o.conv_id, 1, o.p, turn_id, bytes FROM own o JOIN convs c USING (conv_id) WHERE o.p > c.h),
paths AS (SELECT conv_id, count(*) OVER w AS depth, bytes, string_agg(turn_id, '/') OVER w AS path FROM seqs WINDOW w AS (PARTITION BY conv_id ORDER BY part, p)
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lasts AS (SELECT conv_id, arg_max(path, depth) AS path FROM paths GROUP BY conv_id),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM lasts GROUP BY path),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, CASE depth WHEN 0 THEN NULL WHEN 1 THEN '' ELSE left(path, length(path) - 33) END AS above FROM paths GROUP BY path, depth),
children AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
below AS (SELECT a.path, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved_tokens
    FROM nodes a JOIN nodes b ON b.depth >= a.depth AND starts_with(b.path, a.path) LEFT JOIN children k ON k.path = b.path GROUP BY a.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens,
    coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN below b USING (path) LEFT JOIN nodes u ON u.path = n.above LEFT JOIN children k ON k.path = n.path LEFT JOIN ends e ON e.path = n.path
"""


def shards(n: int) -> str:
    """The slot map of ``n`` shards and every document's place, as SQL."""
    return f"""
WITH docs AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, {crc32("coalesce(text, '')")} AS crc,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {sharding.SLOTS} AS vslot FROM documents),
total AS (SELECT sum(size)::BIGINT AS total FROM docs),
heavy AS (SELECT vslot FROM docs GROUP BY vslot HAVING sum(size) * {sharding.HEAVY * n} > (SELECT total FROM total)),
parted AS (SELECT *, CASE WHEN vslot IN (SELECT vslot FROM heavy) THEN crc % {sharding.PARTS} ELSE -1 END AS part FROM docs),
units AS (SELECT vslot, part, sum(size)::BIGINT AS bytes, count(*) AS n_rows, vslot % {n} AS old FROM parted GROUP BY vslot, part),
ranked AS (SELECT *, sum(bytes) OVER (PARTITION BY old ORDER BY bytes DESC, vslot, part) * {n} <= (SELECT total FROM total) AS stays FROM units),
held AS (SELECT s AS shard, (SELECT total FROM total) - {n} * coalesce((SELECT sum(bytes) FROM ranked WHERE stays AND old = s), 0) AS gap FROM range({n}) r(s)),
gaps AS (SELECT shard, gap, sum(gap) OVER (ORDER BY gap DESC, shard) - gap AS lo FROM held),
pool AS (SELECT vslot, part, {n} * (2 * sum(bytes) OVER (ORDER BY bytes DESC, vslot, part) - bytes) AS middle FROM ranked WHERE NOT stays),
dealt AS (SELECT vslot, part, arg_max(shard, lo) AS shard FROM pool JOIN gaps ON gap > 0 AND 2 * lo <= middle GROUP BY vslot, part),
mapped AS (SELECT vslot, part, n_rows, coalesce(d.shard, old) AS shard FROM ranked LEFT JOIN dealt d USING (vslot, part))
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY vslot, part, doc_id NULLS FIRST, crc, size) - 1 AS slot, NULL::INT AS grown_shard, vslot AS virtual_slot
FROM parted JOIN mapped USING (vslot, part)
"""
