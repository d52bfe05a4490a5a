"""The ``opN_`` queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import common as C
from lotwise.llm import token_files
from lotwise.llm.collocations import collocations
from lotwise.llm.decontaminate import decontaminate
from lotwise.llm.filter_audit import filter_audit
from lotwise.llm.license_scan import license_scan
from lotwise.llm.line_dedup import kept_text, line_dedup
from lotwise.llm.mixing import mix
from lotwise.llm.near_dedup import NearParams, near_dedup
from lotwise.llm.quality_rules import QualityParams, quality_rules
from lotwise.llm.substring_dedup import substring_dedup
from lotwise.llm.suffix_dedup import suffix_dedup
from lotwise.llm.toxicity import toxicity
from lotwise.llm.url_filter import url_filter


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(C.read(spark, sf_dir, "documents"), most_broadcast=0, texts=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(C.read(spark, sf_dir, "documents"), QualityParams())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_boiler_words")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(C.read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(C.read(spark, sf_dir, "documents"), most_broadcast=0, texts=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{C.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(C.read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_index(spark, path)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(C.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(C.read(spark, sf_dir, "documents"), NearParams(k=3, percent=85)).drop("body")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(C.read(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(C.read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(C.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("text"), F.col("keep")), 256).alias("kept_sha256"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontaminate": op3_decontaminate,
    "op4_license_scan": op4_license_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_files": op6_token_files,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_near_dedup": op9_near_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_filter_audit": op12_filter_audit,
    "op13_line_dedup": op13_line_dedup,
}

_OP2 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line FROM d),
ln AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l),
hosts AS (SELECT source, count(DISTINCT doc_id) AS n_host FROM d GROUP BY source),
freq AS (SELECT ln.source, norm FROM ln JOIN hosts ON ln.source IS NOT DISTINCT FROM hosts.source
         GROUP BY ln.source, norm, n_host HAVING count(DISTINCT doc_id) > 20 AND (count(DISTINCT doc_id) > 0.1e0 * n_host OR count(DISTINCT doc_id) > 50000)),
boiler AS (SELECT doc_id, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS n FROM ln JOIN freq ON ln.source IS NOT DISTINCT FROM freq.source AND ln.norm = freq.norm GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS win FROM d, unnest(range(1, len(ws) - 3)) AS r(i)),
rep AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(5) AS r(j) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(boiler.n, 0) AS BIGINT) AS n_boiler_words
      FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN boiler USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_boiler_words >= 0.3e0 * n_words AS kept, n_boiler_words FROM b
"""

_OP3 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win FROM iw, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS r(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM dw, sizes, unnest(range(1, len(ws) - n + 2)) AS r(i)),
met AS (SELECT doc_id, i, occ.n, item_id FROM occ JOIN win ON occ.win = win.win AND occ.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM met), unnest(range(n)) AS r(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_PASSAGES = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS win FROM w, unnest(range(1, len(ws) - 48)) AS r(i)),
late AS (SELECT doc_id, i FROM g QUALIFY doc_id > min(doc_id) OVER (PARTITION BY win)),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM late, range(50) AS r(j)),
words AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS r(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + least(len(ws), 3) - 1], ' '), least(len(ws), 3)) AS s FROM d, unnest(range(1, len(ws) - least(len(ws), 3) + 2)) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS hits FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * hits >= 85 * (na.n + nb.n - hits)),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS node, b AS other FROM s UNION SELECT reach.node, s.b FROM reach JOIN s ON reach.other = s.a),
c AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(doc_id, coalesce(low, doc_id)) AS BIGINT) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = doc_id
"""

_OP11 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws[i:i + k - 1] AS ph FROM w, range(1, 4) AS q(k), unnest(range(1, len(ws) - k + 2)) AS r(i)),
f AS (SELECT lang, ph, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
c AS (SELECT * FROM f WHERE len(ph) > 1 AND a >= 10),
cuts AS (SELECT c.lang, c.ph, c.a, k, x.a AS l, y.a AS r, 1000000 * c.a * c.a // (x.a * y.a) AS score
         FROM c, range(1, 3) AS q(k) JOIN f x ON x.lang = c.lang AND x.ph = c.ph[1:k] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[k + 1:] WHERE k < len(c.ph)),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
longer AS (SELECT lang, sub, max(a) AS m FROM (SELECT lang, ph[1:2] AS sub, a FROM c WHERE len(ph) = 3 UNION ALL SELECT lang, ph[2:3], a FROM c WHERE len(ph) = 3) GROUP BY ALL),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
o AS (SELECT low.lang, array_to_string(ph, ' ') AS phrase, a, l, r, score FROM low LEFT JOIN longer ON longer.lang = low.lang AND longer.sub = low.ph WHERE m IS NULL OR 100 * m < 50 * a)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o JOIN n ON n.lang = o.lang QUALIFY rank <= 2000
"""

_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lab AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
fl AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(ws) < 100 AS A, 100 * len(list_distinct(ws)) < 80 * len(ws) AS B,
         100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D,
         coalesce(d.doc_id, 9223372036854775807) > min(coalesce(d.doc_id, 9223372036854775807)) OVER (PARTITION BY t) AS E
       FROM d LEFT JOIN lab ON d.doc_id = lab.doc_id),
m AS (SELECT part, A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fl GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, CAST(list_sum(bits[1:step]) AS INT) - bits[step] AS before FROM o, unnest(range(1, 6)) AS r(step)),
r AS (SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed,
        coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
        coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""

_OP13 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, p, ls[p] AS line, regexp_replace(translate(ls[p], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key
      FROM d, unnest(range(1, len(ls) + 1)) AS r(p)),
common AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS t FROM l ANTI JOIN common USING (key) GROUP BY doc_id)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": _PASSAGES,
    "op2_quality_rules": _OP2,
    "op3_decontaminate": _OP3,
    "op5_substring_dedup": _PASSAGES,
    "op9_near_dedup": _OP9,
    "op11_collocations": _OP11,
    "op12_filter_audit": _OP12,
    "op13_line_dedup": _OP13,
}
