"""Registered queries of this subpackage: query(spark, sf_dir) -> DataFrame, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (bpe, filter_audit, host_rules, iblt, licences, main_text, mixing, packing, ppm_language, quality_net, reversed_search,
               superminhash, warc_bundles)
from .common import table


def op1_warc_bundles(spark, sf_dir):
    """Every page written as a WARC record and read back."""
    return warc_bundles.round_trip(spark, table(spark, sf_dir, "pages")).drop("url")


def op2_host_rules(spark, sf_dir):
    """Quality rules and host verdicts over every document."""
    judged = host_rules.quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    q = F.col("quality")
    return judged.select("doc_id", q.n_words.alias("n_words"), q.word_chars.alias("word_chars"), q.n_symbols.alias("n_symbols"),
                         q.n_dup_lines.alias("n_dup_lines"), q.n_repeat_words.alias("n_repeat_words"),
                         q.base_failed.alias("base_failed"), q.kept.alias("kept"), q.host_rejected.alias("host_rejected"))


def op3_ss_packing(spark, sf_dir):
    """Every document packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_forced_bpe(spark, sf_dir):
    """Every document encoded and decoded."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_main_text(spark, sf_dir):
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.extract(pages, main_text.learn(pages))


def op6_iblt(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    return iblt.edited_likeness(table(spark, sf_dir, "documents"))


def op7_superminhash(spark, sf_dir):
    """Near copies among all documents."""
    return superminhash.near_copies(table(spark, sf_dir, "documents"))


def op8_ppm_language(spark, sf_dir):
    """The language of every document."""
    return ppm_language.identify(table(spark, sf_dir, "documents"))


def op9_licences(spark, sf_dir):
    """Licences named or quoted in every document."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op10_quality_net(spark, sf_dir):
    """The quality score of every document."""
    return quality_net.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_mixing(spark, sf_dir):
    """Every document's part in the mix."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op12_reversed_search(spark, sf_dir):
    """The 20 best documents of every benchmark item."""
    return reversed_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark, sf_dir):
    """Every order and step of five filters, by language."""
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_warc_bundles": op1_warc_bundles,
    "op2_host_rules": op2_host_rules,
    "op3_ss_packing": op3_ss_packing,
    "op4_forced_bpe": op4_forced_bpe,
    "op5_main_text": op5_main_text,
    "op6_iblt": op6_iblt,
    "op7_superminhash": op7_superminhash,
    "op8_ppm_language": op8_ppm_language,
    "op9_licences": op9_licences,
    "op10_quality_net": op10_quality_net,
    "op11_mixing": op11_mixing,
    "op12_reversed_search": op12_reversed_search,
    "op13_filter_audit": op13_filter_audit,
}

#: The same by nested lists: words, equal lines, and word positions that any repeated window covers.
OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
ld AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (SELECT rid, i, array_to_string(ws[i : i + 7], ' ') AS k
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 8)) AS j) GROUP BY rid),
m AS (SELECT rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN ld USING (rid) LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 20 AS few_words, 100 * n_repeat_words > 30 * n_words AS repeats,
        100 * n_symbols > 30 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup_lines FROM m),
r AS (SELECT rid, source, unnest([few_words, repeats, symbols, dup_lines]) AS fail,
        unnest(['few_words', 'repeats', 'symbols', 'dup_lines']) AS rule FROM f WHERE source IS NOT NULL),
h AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(fail::INT)::DOUBLE AS bad FROM r GROUP BY ALL),
s AS (SELECT rule, count(*)::DOUBLE AS k, sum(n) AS n, sum(bad) AS bad, sum(bad * bad / n) AS sq, sum(n * n) AS n2 FROM h GROUP BY rule),
v AS (SELECT *, (sq - bad * bad / n) / (k - 1) AS msb, (bad - sq) / (n - k) AS msw, (n - n2 / n) / (k - 1) AS n0 FROM s),
o AS (SELECT *, CASE WHEN msb + (n0 - 1) * msw > 0 THEN (msb - msw) / (msb + (n0 - 1) * msw) ELSE 0 END AS rho FROM v),
b AS (SELECT DISTINCT h.source FROM h JOIN o USING (rule)
      WHERE CASE WHEN o.k < 2 OR o.n <= o.k THEN (h.bad + o.bad / o.n) / (h.n + 1)
                 WHEN rho <= 0 THEN o.bad / o.n
                 ELSE (h.bad + o.bad / o.n * (1 - rho) / rho) / (h.n + (1 - rho) / rho) END > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeats AS base_failed,
       NOT (few_words OR repeats) AND b.source IS NULL AS kept, b.source IS NOT NULL AS host_rejected
FROM f LEFT JOIN b ON f.source = b.source
"""

OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM l
"""

#: Shingles as texts, pairs by joining them, and what each row reaches over links.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[i : i + 4], ' ') AS shingle
      FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid < b.rid GROUP BY a.rid, b.rid),
e AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT rid AS x, rid AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT r.x AS rid, min(w.doc_id) AS least FROM r JOIN w ON w.rid = r.y GROUP BY r.x),
f AS (SELECT doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN doc_id ELSE least END AS component_id
      FROM w LEFT JOIN n USING (rid) LEFT JOIN c USING (rid))
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM f
"""

#: The levels by sorting: in the order of bound by share, a source stops if what those before it leave is above its bound.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS DOUBLE) AS solid,
        CAST(length(regexp_replace(t, '[^\x21-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) AS DOUBLE) AS odd,
        (CAST(CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t)), 1, 13) AS BIGINT) AS DOUBLE)
         + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d),
k AS (SELECT doc_id, source, size, -ln(u) / greatest(0.1::DOUBLE, 1::DOUBLE - 4::DOUBLE * CASE WHEN solid > 0 THEN odd / solid ELSE 0::DOUBLE END) AS key FROM m),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
r AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS share, 3 * source_size AS bound FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(share) OVER () AS shares,
        coalesce(sum(bound) OVER w, 0) AS bounds_before, coalesce(sum(share) OVER w, 0) AS shares_before FROM r
      WINDOW w AS (ORDER BY bound::DOUBLE / share, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, (total - bounds_before)::DOUBLE / (shares - shares_before)::DOUBLE * share > bound AS stops FROM o),
l AS (SELECT *, CAST(total - sum(CASE WHEN stops THEN bound ELSE 0 END) OVER () AS BIGINT) AS rest_words,
        CAST(sum(CASE WHEN stops THEN 0 ELSE share END) OVER () AS BIGINT) AS rest_shares FROM p),
g AS (SELECT source, source_size, CASE WHEN stops THEN bound::DOUBLE ELSE (share * rest_words)::DOUBLE / rest_shares::DOUBLE END AS target,
        CAST(CASE WHEN stops THEN bound ELSE (share * rest_words) // rest_shares END AS BIGINT) AS words FROM l),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, size, b.source AS source, source_size, target,
       CAST(size * (words // greatest(source_size, 1)) + least(size, greatest(0, words % greatest(source_size, 1) - before)) AS BIGINT) AS taken
FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source
"""

OP12_SQL = r"""
WITH t AS (SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
tf AS (SELECT rid, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY rid),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
i AS (SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
u AS (SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
q AS (SELECT item, item_id, term, count(*) AS times FROM u GROUP BY ALL),
s AS (SELECT item, item_id, rid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (rid), c GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""

#: Every order and step counted anew from the documents' masks, without the walk.
OP13_SQL = r"""
WITH w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws
           FROM (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents)),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
g AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM g a, g b, g c, g d, g e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INTEGER) AS earlier
      FROM (SELECT *, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""

ORACLES = {"op1_warc_bundles": OP1_SQL, "op2_host_rules": OP2_SQL, "op7_superminhash": OP7_SQL, "op11_mixing": OP11_SQL, "op12_reversed_search": OP12_SQL, "op13_filter_audit": OP13_SQL}
