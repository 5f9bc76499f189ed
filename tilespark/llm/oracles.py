"""SQL for another engine that gives the rows of the queries which SQL can express."""

from __future__ import annotations

from tilespark.llm.licences import EQUIVALENT, known_texts
from tilespark.llm.quality_rules import Rules
from tilespark.llm.url_trust import RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SOURCE_MIX = rf"""
WITH w AS (SELECT doc_id, source, len({_WORDS}) AS n, substr(md5(coalesce(cast(doc_id AS varchar), '')), 1, 3) AS b FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n, b, doc_id) AS k FROM w),
s AS (SELECT source, cast(sum(n) AS bigint) AS source_size FROM w GROUP BY 1),
v AS (SELECT *, 3e0*source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS wt FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap/wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS held,
  (SELECT sum(wt) FROM v) - sum(wt) OVER (ORDER BY cap/wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + wt AS free,
  (SELECT cast(sum(source_size) AS double) FROM v) AS total FROM v),
l AS (SELECT (total-held)/free AS level FROM o WHERE (total-held)/free*wt <= cap ORDER BY cap/wt, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l)*wt, cap)) AS target,
  cast(concat('0x', substr(md5(concat('7:', CASE WHEN source IS NULL THEN '' ELSE concat('=', source) END)), 1, 8)) AS bigint)/4294967296e0 AS u FROM o),
j AS (SELECT doc_id, n, k, source_size, target, u, CASE WHEN source_size > 0 THEN target/source_size ELSE 0e0 END AS rate
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, cast(floor(k*rate+u) - floor((k-1)*rate+u) AS bigint) AS copies FROM j)
SELECT doc_id, cast(n AS bigint) AS size, source_size, target, copies, copies*n AS taken FROM c"""


def _quality(rules: Rules = Rules()) -> str:
    failed = {
        "short": f"n_words < {rules.least_words}", "repeats": f"100*n_repeat_words > {rules.most_repeat_pct}*n_words",
        "symbols": f"100*n_symbols > {rules.most_symbol_pct}*n_words", "lines": f"100*n_dup_lines > {rules.most_dup_line_pct}*n_lines",
        "word_length": f"word_chars < {rules.least_word_chars}*n_words OR word_chars > {rules.most_word_chars}*n_words"}
    sums = ", ".join(f"sum(CASE WHEN {c} THEN 1e0 ELSE 0e0 END) AS k_{r}" for r, c in failed.items())
    totals = ", ".join(f"sum(k_{r}) AS t_{r}, sum(k_{r}*k_{r}/n) AS q_{r}" for r in failed)
    spread = ", ".join(
        f"(q_{r} - tn*(t_{r}/tn)*(t_{r}/tn) - (hosts-1)*(t_{r}/tn)*(1e0-t_{r}/tn))/nullif(tn - nn/tn, 0e0) AS v_{r}" for r in failed)
    share = " OR ".join(
        f"(CASE WHEN v_{r} > 0 THEN (k_{r} + t_{r}/tn*greatest(t_{r}/tn*(1e0-t_{r}/tn)/v_{r}-1e0, 1e0))/(n + greatest(t_{r}/tn*(1e0-t_{r}/tn)/v_{r}-1e0, 1e0)) "
        f"ELSE t_{r}/tn END) > {rules.most_host_share}" for r in failed)
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body, {_WORDS} AS w FROM documents),
lines AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
nl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY 1),
win AS (SELECT doc_id, i, list_transform(range(8), lambda k: w[i+k]) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w)-6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM win GROUP BY doc_id, x HAVING count(*) > 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i+8)) AS p FROM twice) GROUP BY 1),
f AS (SELECT doc_id, source, cast(len(w) AS bigint) AS n_words, cast(length(array_to_string(w, '')) AS bigint) AS word_chars,
  cast(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS bigint) AS n_symbols, cast(coalesce(n_dup_lines, 0) AS bigint) AS n_dup_lines,
  coalesce(n_lines, 0) AS n_lines, cast(coalesce(hit.n, 0) AS bigint) AS n_repeat_words FROM d LEFT JOIN nl USING (doc_id) LEFT JOIN hit USING (doc_id)),
h AS (SELECT source, cast(count(*) AS double) AS n, {sums} FROM f GROUP BY 1),
a AS (SELECT sum(n) AS tn, sum(n*n) AS nn, cast(count(*) AS double) AS hosts, {totals} FROM h),
s AS (SELECT *, {spread} FROM a),
o AS (SELECT source, {share} AS host_out FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({failed['short']} OR {failed['repeats']}) AS base_failed,
  NOT ({' OR '.join(f'({c})' for c in failed.values())}) AND NOT host_out AS kept, host_out FROM f JOIN o ON f.source IS NOT DISTINCT FROM o.source"""


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _test_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_test_words('text')} AS w FROM documents), b AS (SELECT item_id, {_test_words('text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, list_transform(range(n), lambda k: w[i+k]) AS x
  FROM (SELECT item_id, w, n, unnest(range(1, len(w)-n+2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0) q) p),
dw AS (SELECT doc_id, i, n, list_transform(range(n), lambda k: w[i+k]) AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w)-n+2)) AS i FROM d JOIN (SELECT DISTINCT n FROM iw) k ON len(w) >= n) p),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, x)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+n)) AS p FROM h) q GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM h) q GROUP BY 1)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licences() -> str:
    spelled = "concat(' ', plain, ' ')"
    for other, one in EQUIVALENT.items():
        spelled = f"replace({spelled}, ' {other} ', ' {one} ')"
    known = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in known_texts())
    mark = r"copyright|\(c\)|©|all rights reserved"
    return rf"""
WITH known AS (SELECT * FROM (VALUES {known}) v(licence, body)),
u AS (SELECT doc_id, 0 AS part, coalesce(text, '') AS body FROM documents
  UNION ALL SELECT doc_id, 1, l FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[\r\n]+')) AS l FROM documents WHERE contains(text, chr(10))) q WHERE length(trim(l, ' ')) > 0
  UNION ALL SELECT NULL, 2, body FROM known),
a AS (SELECT DISTINCT body, lower(body) AS low FROM u),
p AS (SELECT body, trim(regexp_replace(CASE WHEN regexp_matches(low, '{mark}') THEN regexp_replace(low, '(?mi)^\W*(?:copyright\b|\(c\)|©|all rights reserved).*$', ' ', 'g')
  ELSE low END, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ') AS plain FROM a),
f AS (SELECT body, CASE WHEN regexp_matches(plain, '\b(?:{'|'.join(EQUIVALENT)})\b') THEN trim({spelled}, ' ') ELSE plain END AS form FROM p),
k AS (SELECT sha256(form) AS digest, min(licence) AS licence FROM known JOIN f USING (body) WHERE form <> '' GROUP BY 1),
g AS (SELECT doc_id, part, sha256(form) AS digest FROM u JOIN f USING (body) WHERE part < 2),
j AS (SELECT g.*, licence FROM g LEFT JOIN k USING (digest))
SELECT doc_id, max(CASE WHEN part = 0 THEN digest END) AS text_digest, max(CASE WHEN part = 0 THEN licence END) AS whole_licence,
  coalesce(array_to_string(list_sort(list(DISTINCT licence) FILTER (WHERE licence IS NOT NULL)), ','), '') AS licences, count(CASE WHEN part = 1 THEN licence END) AS n_notices FROM j GROUP BY 1"""


ORACLES = {"op1_source_mix": SOURCE_MIX, "op8_quality_rules": _quality(), "op9_decontamination": DECONTAMINATION, "op10_license_scan": _licences()}


def _crc32(text: str) -> str:
    """Unsigned checksum of a text of ASCII and Latin-1 letters, bit by bit."""
    rest = "0, 0, 0, 0, 0, 0, 0"
    steps = (f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c), {rest}] "
             f"ELSE [195, {rest}, unicode(c)-64, {rest}] END))")
    return (f"xor(list_reduce(list_concat([4294967295], {steps}), lambda a, b: xor(xor(a, b) >> 1, "
            "CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)")


PREFIX_TRIE = rf"""
WITH t AS (SELECT conv_id, turn, {{'r': coalesce(role, ''), 't': coalesce(text, ''), 'w': len({_WORDS})}} AS x,
  md5(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, ''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(x ORDER BY turn NULLS FIRST, k) AS xs FROM t GROUP BY 1),
h AS (SELECT o.conv_id, o.xs, b.xs AS head, {_crc32("cast(o.conv_id AS varchar)")} % 4 AS h FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20),
c AS (SELECT conv_id, list_concat(coalesce(head[1:h], []), xs[h+1:]) AS xs FROM h),
m AS (SELECT conv_id, len(xs) AS d_all, d, xs[1:d] AS p FROM (SELECT *, unnest(range(0, len(xs)+1)) AS d FROM c)),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(p[d].w, 0)*(count(*)-1) AS own,
  sha256(coalesce(string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (WHERE d = d_all), '')) AS ends_sha256 FROM m GROUP BY p, d),
k AS (SELECT p[1:d-1] AS p, d-1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (p, d)),
s AS (SELECT p[1:a] AS p, a AS d, sum(own) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d+1)) AS a FROM f) GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, cast(s.saved_tokens AS bigint) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (p, d) LEFT JOIN n u ON u.d = f.d-1 AND u.p = f.p[1:f.d-1]"""

SPELLING = f"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UP}', '{_LOW}') AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= 6 GROUP BY 1, 2),
h AS (SELECT *, {_crc32("concat(doc_id, ':', w)")} AS h FROM d),
s AS (SELECT n, CASE WHEN h % 199 = 0 THEN concat(w[1:h % length(w)], w[h % length(w) + 2:]) ELSE w END AS word FROM h),
v AS (SELECT word, cast(sum(n) AS bigint) AS n FROM s WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
x AS (SELECT word, n, i, concat(word[1:i-1], word[i+1:]) AS less FROM (SELECT *, unnest(range(1, length(word)+1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON v.word = x.less UNION SELECT v.word, x.word, x.n FROM x JOIN v ON v.word = x.less),
b AS (SELECT word, count(*) AS n_near, first(struct_pack(o := other, m := m) ORDER BY m DESC, other) AS best FROM near GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.m >= 5*v.n THEN best.o END AS form, CASE WHEN best.m >= 5*v.n THEN best.m END AS form_n
  FROM v LEFT JOIN b USING (word)),
roots AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT roots.word, f.form, step+1 FROM roots JOIN f ON f.word = roots.root WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(root, step) AS root FROM roots GROUP BY 1)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN last USING (word)"""


NGRAM_JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w)-3), lambda i: array_to_string(w[i:i+4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
k AS (SELECT doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN md5(array_to_string(g, chr(10))) END AS k, g FROM g),
c AS (SELECT k, min(doc_id) AS c, any_value(n) AS n, any_value(g) AS g FROM k WHERE k IS NOT NULL GROUP BY 1),
s AS (SELECT c, n, unnest(g) AS s FROM c),
p AS (SELECT a.c AS a, b.c AS b FROM s a JOIN s b ON a.s = b.s AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100*count(*) >= 80*(a.n+b.n-count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT c AS f, c AS t FROM c UNION SELECT r.f, e.b FROM r JOIN e ON e.a = r.t),
m AS (SELECT f, min(t) AS component FROM r GROUP BY 1)
SELECT doc_id, cast(k.n AS bigint) AS n_shingles, coalesce(component, doc_id) AS component_id FROM k LEFT JOIN c USING (k) LEFT JOIN m ON m.f = c.c"""


def _url_trust(steps: int = 20, damping: float = 0.85, floor: float = 0.05) -> str:
    fits = "\n  ".join(
        f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '/{rest}') THEN '{verdict} {rule}'"
        for verdict, rule in sorted(RULES, key=lambda r: (len(r[1]), r[1], r[0]), reverse=True) for d, _, rest in [rule.partition("/")])
    rounds = ",\n".join(
        f"s{i} AS (SELECT kind, host, sum(score) AS score FROM (SELECT e.kind, dst AS host, {damping!r}e0*score*share AS score FROM s{i-1} s JOIN e ON e.kind = s.kind AND e.src = s.host "
        f"UNION ALL SELECT kind, host, {1-damping!r}e0*score FROM s0) q GROUP BY 1, 2)" for i in range(1, steps + 1))
    url, link = r"(?s)^.*?://([^/?#]*)([^?#]*)", r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)""".replace("'", "''")
    return rf"""
WITH u AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '{url}', 1), ''), '{_UP}', '{_LOW}') AS host, coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages),
p AS (SELECT *, CASE {fits} END AS fit FROM u),
j AS (SELECT page_id, html, host, path, split_part(fit, ' ', 1) AS ruled, split_part(fit, ' ', 2) AS rule FROM p),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE ruled='allow') AS allowed, count(*) FILTER (WHERE ruled='block') AS blocked FROM j WHERE host <> '' GROUP BY 1),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{_UP}', '{_LOW}') AS dst FROM j WHERE host <> ''),
n AS (SELECT src, dst, cast(count(*) AS double) AS links FROM l WHERE src <> dst GROUP BY 1, 2),
b AS (SELECT 'trust' AS kind, src, dst, links FROM n UNION ALL SELECT 'distrust', dst, src, links FROM n),
e AS (SELECT kind, src, dst, links/sum(links) OVER (PARTITION BY kind, src) AS share FROM b),
k AS (SELECT host, CASE WHEN 2*allowed > n THEN 'trust' WHEN 2*blocked > n THEN 'distrust' END AS kind FROM h),
s0 AS (SELECT kind, host, 1e0/count(*) OVER (PARTITION BY kind) AS score FROM k WHERE kind IS NOT NULL),
{rounds},
t AS (SELECT host, coalesce(sum(score) FILTER (WHERE kind='trust'), 0e0)*(SELECT count(*) FROM h) AS trust,
  coalesce(sum(score) FILTER (WHERE kind='distrust'), 0e0)*(SELECT count(*) FROM h) AS distrust FROM s{steps} GROUP BY 1)
SELECT page_id, j.host, path, nullif(rule, '') AS rule, CASE WHEN ruled <> '' THEN ruled WHEN coalesce(distrust, 0e0) > {floor!r}e0 AND distrust > trust THEN 'block' ELSE 'allow' END AS verdict,
  round(coalesce(trust, 0e0), 6) AS trust, round(coalesce(distrust, 0e0), 6) AS distrust FROM j LEFT JOIN t ON t.host = j.host"""


ORACLES |= {"op3_url_trust": _url_trust(), "op7_ngram_jaccard": NGRAM_JACCARD, "op12_prefix_trie": PREFIX_TRIE, "op13_spelling": SPELLING}
