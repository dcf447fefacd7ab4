"""The same results in SQL for DuckDB, where SQL can express them: the methods differ, the rows do not."""

from __future__ import annotations

from plinth.llm import mixing, quality_rules

SPLIT = r"'[ \t-\r]+'"
_words = lambda x: f"list_filter(string_split_regex({x}, {SPLIT}), lambda w: w <> '')"
_quoted = lambda s: "'" + s.replace("'", "''") + "'"
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

CONTENT_SORT = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

REPEATED_WINDOWS = f"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT win, min(doc_id) AS least FROM p GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM p JOIN f USING (win) WHERE least < doc_id),
lists AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(js, k)), lambda k: w[k]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)"""


def line_spread(min_sites: int = 10, min_words: int = 3) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, i, ls[i] AS line, trim(ls[i], {WHITE}) AS body FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
wide AS (SELECT body FROM l WHERE len({_words('body')}) >= {min_words} GROUP BY body HAVING count(DISTINCT coalesce(source, 'null')) >= {min_sites}),
o AS (SELECT doc_id, i, line, body IN (SELECT body FROM wide) AS gone FROM l),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS t FROM o GROUP BY doc_id)
SELECT doc_id, n AS n_removed, length(t) AS n_chars_kept, sha256(t) AS text_sha256 FROM k"""


def _n(text: str, chars: str) -> str:
    return f"(length({text}) - length(translate({text}, {chars}, '')))"


def line_first_rules(most_lost_pct: int = 50) -> str:
    symbols, separators = _quoted(quality_rules.SYMBOLS), _quoted(quality_rules.SEPARATORS)
    solid = lambda x: f"length(translate({x}, {WHITE}, ''))"
    spaces = _n("b", "' ' || chr(9)")
    named = " OR ".join(f"contains(lower(b), {_quoted(p)})" for p in quality_rules.BOILERPLATE)
    fails = f"""b <> '' AND ((NOT contains({_quoted(quality_rules.ENDINGS)}, right(b, 1)) AND {spaces} >= 7)
      OR ({_n('b', separators)} >= 3 AND {_n('b', separators)} * 4 >= {spaces}) OR ({_n('b', symbols)} >= 3 AND {_n('b', symbols)} * 10 >= {solid('b')})
      OR ({_n('b', "'!'")} >= 3 AND {_n('b', "'!'")} * 3 >= {spaces}) OR (length(b) <= {quality_rules.BOILERPLATE_CHARS} AND ({named})))"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM p) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM again) GROUP BY doc_id),
l AS (SELECT doc_id, i, ls[i] AS line, trim(ls[i], {WHITE}) AS b FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE b <> '' GROUP BY doc_id),
c AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT ({fails})), '') AS cleaned FROM l GROUP BY doc_id),
t AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, {solid('text')} AS word_chars, {_n('text', symbols)} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, cleaned, {solid('text')} - {solid('cleaned')} AS lost_chars
      FROM d LEFT JOIN r USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN c USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= {most_lost_pct} * word_chars AS kept, lost_chars, sha256(cleaned) AS cleaned_sha256 FROM v"""


def source_mixing(weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, block: int = 16, seed: int = 17) -> str:
    """Seats go by highest quotient, ranked over all quotients that can win."""
    weigh = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))

    def seats(table: str, group: str, tie: str, claim: str, total: str, out: str) -> str:
        return f"""{out}_q AS (SELECT {group}, {tie}, {claim} / (2 * k - 1) AS q, k, {total} AS n FROM (SELECT *, unnest(range(1, CAST(ceil({claim} * ({total} + parts) / nullif(claims, 0)) AS BIGINT) + 3)) AS k
      FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS parts, sum({claim}) OVER (PARTITION BY {group}) AS claims FROM {table})) WHERE {claim} > 0),
    {out}_s AS (SELECT {group}, {tie}, count(*) AS {out} FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY q DESC, {tie}, k) AS place FROM {out}_q) WHERE place <= n GROUP BY {group}, {tie})"""

    return f"""
WITH d AS (SELECT doc_id, source, CAST(len({_words("coalesce(text, '')")}) AS BIGINT) AS size, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS mix FROM documents),
tot AS (SELECT sum(size) AS n, least({mixing.MOST_SHARDS}, greatest(1, CAST(ceil(sum(size) / {float(mixing.SHARD_TOKENS)}) AS BIGINT))) AS shards FROM d),
e AS (SELECT d.*, (CAST('0x' || substr(mix, 1, 8) AS BIGINT) + size) % shards AS shard FROM d, tot),
s0 AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM e GROUP BY source),
s1 AS (SELECT *, CASE rank % {len(weights)} {weigh} END AS weight, source_size * {float(epochs)} AS cap FROM s0),
s2 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM s1 WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap / weight <= level AS filled, (SELECT x.level FROM s2 x WHERE x.cap / x.weight > x.level ORDER BY x.cap / x.weight, x.rank LIMIT 1) AS holds FROM s2),
s4 AS (SELECT source, rank, CAST(source_size AS BIGINT) AS source_size, CASE WHEN filled OR holds IS NULL THEN cap ELSE weight * holds END AS target, 0 AS every_, CAST(round((SELECT n FROM tot) / {float(block)}) AS BIGINT) AS seats FROM s3),
{seats('s4', 'every_', 'rank', 'target', 'seats', 'blocks')},
cells AS (SELECT s4.rank, e.shard, CAST(sum(size) AS DOUBLE) AS cell, coalesce(max(blocks), 0) AS blocks FROM e JOIN s4 ON e.source IS NOT DISTINCT FROM s4.source LEFT JOIN blocks_s b ON b.rank = s4.rank GROUP BY s4.rank, e.shard),
{seats('cells', 'rank', 'shard', 'cell', 'blocks', 'quota')},
q AS (SELECT c.rank, c.shard, c.cell, coalesce(quota, 0) AS quota, least(coalesce(quota, 0) * {block}, c.cell * {epochs}) AS wanted FROM cells c LEFT JOIN quota_s x ON x.rank = c.rank AND x.shard = c.shard),
j AS (SELECT e.*, s4.source_size, s4.target, q.quota, q.cell, q.wanted, CASE WHEN cell > 0 THEN floor(wanted / cell) ELSE 0 END AS rounds,
      sum(size) OVER (PARTITION BY s4.rank, e.shard ORDER BY mix, size ROWS UNBOUNDED PRECEDING) AS done FROM e JOIN s4 ON e.source IS NOT DISTINCT FROM s4.source JOIN q ON q.rank = s4.rank AND q.shard = e.shard)
SELECT doc_id, size, source_size, target, CAST(rounds * size + least(size, greatest(0, wanted - rounds * cell - (done - size))) AS BIGINT) AS taken, source, CAST(quota AS BIGINT) AS quota_blocks FROM j"""


ADAPTIVE_PREFIX_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS name FROM s GROUP BY doc_id),
c AS (SELECT name, min(doc_id) AS rep, any_value(n) AS n FROM n GROUP BY name),
t AS (SELECT rep, n, g FROM c JOIN s ON s.doc_id = c.rep),
pairs AS (SELECT a.rep AS a, b.rep AS b, count(*) AS x, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
link AS (SELECT a, b FROM pairs WHERE 100 * x >= 75 * (na + nb - x)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.name = n.name LEFT JOIN comp ON comp.a = c.rep"""

_terms = lambda x: f"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_share = lambda n, whole: f"1 + CAST(1000000000 AS HUGEINT) * ({n} + 1) // ({whole})"
SOURCE_DIVERGENCE = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_terms("coalesce(text, '')")} AS ts, row_number() OVER () AS r FROM documents),
o AS (SELECT lang, source, r, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
cell AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(max(v), 0) AS v, coalesce(max(l.whole), 0) AS lang_whole, (SELECT coalesce(sum(n), 0) FROM cell c WHERE c.lang = x.lang AND c.source = x.source) AS whole
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN l USING (lang) GROUP BY lang, source),
dense AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, {_share("coalesce(c.n, 0)", "g.whole + g.v")} AS p, {_share("total", "lang_whole + g.v")} AS q
  FROM g JOIN kept USING (lang) LEFT JOIN cell c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every_pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
every_ AS (SELECT * FROM every_pair UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every_) WHERE part = 'pair' OR rank <= 200"""

ORACLES = {
    "op2_source_mixing": source_mixing(),
    "op3_repeated_windows": REPEATED_WINDOWS,
    "op4_line_spread": line_spread(),
    "op6_line_first_rules": line_first_rules(),
    "op9_adaptive_prefix_join": ADAPTIVE_PREFIX_JOIN,
    "op10_content_sort": CONTENT_SORT,
    "op11_source_divergence": SOURCE_DIVERGENCE,
}
