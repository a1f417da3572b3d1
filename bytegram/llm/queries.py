"""Registered queries of the training-data operators, over the whole given tables, and their DuckDB SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegram.llm import (decontam, gam, langid, licenses, merkle, mixing, packing, pfor, quality_rules, simhash, spelling,
                          suffix_dedup, warc)
from bytegram.llm.common import shared, table

documents, pages, labels, benchmark = (table(t) for t in ("documents", "pages", "labels", "benchmark"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pfor_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared(spark, "token-ids")
    pfor.write_token_ids(documents(spark, sf_dir), path, _tokenizer("word_bpe_49k.json"), keep_space=False, end_id=2)
    return pfor.read_token_ids(spark, path, digest=True).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    name, shelf = F.col("doc_id").cast("string"), (F.col("doc_id") / 1000).cast("long")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")),
                       F.when(shelf > 0, shelf.cast("string")), F.coalesce(name, F.lit("_")))
    return licenses.scan_licenses(docs.select("doc_id", path.alias("path"), "text"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), keep_space=True, end_id=0,
                                  capacity=2048)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), length=200).drop("text_hash")


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared(spark, "warc")
    row = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("row")
    warc.write_captures(pages(spark, sf_dir).select("page_id", "url", "html", row), path, min_revisit_bytes=1000)
    return warc.capture_digests(warc.whole_captures(warc.assemble(warc.read_records(spark, path))))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir)).drop("text_hash")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, max_bits=4).select(
        "doc_id", "fingerprint", "component_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.score_quality(documents(spark, sf_dir), labels(spark, sf_dir), threshold=0.7)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir)).drop("text_hash")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(documents(spark, sf_dir), weights=(1, 2, 3), most=3).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir), min_length=5, min_count=3)


def _license_sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, *(x.replace("'", "''") for x in t)) for i, t in enumerate(licenses.TEMPLATES))
    low = f"translate({{}}, '{licenses.UPPER}', '{licenses.LOWER}')"
    tokens = "unnest(list_distinct(regexp_extract_all({0}, '%s')))" % licenses.TOKEN
    return f"""
WITH templates(template, license, text) AS (VALUES {rows}),
tt AS (SELECT template, license, {tokens.format(low.format('text'))} AS token FROM templates),
n AS (SELECT count(*)::DOUBLE AS n FROM templates),
idf AS (SELECT token, ln((1 + any_value(n.n)) / (1 + count(*))) + 1 AS idf FROM tt, n GROUP BY token),
tw AS (SELECT template, license, token, idf AS w FROM tt JOIN idf USING (token)),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
files AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', coalesce(source, '_'), coalesce(lang, '_'),
                 CASE WHEN doc_id // 1000 > 0 THEN (doc_id // 1000)::VARCHAR END, doc_id::VARCHAR) AS path FROM documents),
named AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
lowered AS (SELECT doc_id, low, l, list_position(list_transform(l, lambda x: NOT regexp_matches(x, '{licenses.COMMENT}')), true) AS stop
            FROM (SELECT doc_id, {low.format('text')} AS low, string_split({low.format('text')}, chr(10)) AS l FROM files)),
parts AS (SELECT doc_id, [low, CASE WHEN stop > 1 THEN array_to_string(l[1:stop - 1], chr(10)) ELSE '' END]
                 || string_split_regex(low, '{licenses.BLANK_LINES}') || l AS u FROM lowered),
units AS (SELECT doc_id, unnest(u) AS text, generate_subscripts(u, 1) - 1 AS place FROM parts),
ut AS (SELECT doc_id, place, {tokens.format('text')} AS token FROM units),
uw AS (SELECT doc_id, place, token, coalesce(idf, ln(1 + n.n) + 1) AS q FROM ut LEFT JOIN idf USING (token), n),
un AS (SELECT doc_id, place, sqrt(sum(q * q)) AS norm FROM uw GROUP BY ALL),
dots AS (SELECT doc_id, place, template, license, sum(q * w / tn.norm) AS dot
         FROM uw JOIN tw USING (token) JOIN tn USING (template) GROUP BY ALL),
scored AS (SELECT doc_id, place, license, round(dot / norm, 6) AS score FROM dots JOIN un USING (doc_id, place)),
found AS (SELECT doc_id, CASE WHEN place < 2 THEN 1 ELSE 2 END AS level, place, license, score FROM scored WHERE score >= 0.6
          UNION ALL SELECT doc_id, 0, 1, regexp_extract(text, '{licenses.SPDX}', 1), 1.0 FROM files
                    WHERE regexp_extract(text, '{licenses.SPDX}', 1) <> ''),
own AS (SELECT doc_id, license, score, bool_or(place = 0) OVER (PARTITION BY doc_id) AS whole FROM found
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level, score DESC, place, license) = 1),
head AS (SELECT named.*, license, score, whole, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_words
         FROM named LEFT JOIN own USING (doc_id)),
above AS (SELECT dir AS license_dir, license AS above, score AS above_score FROM head
          WHERE license IS NOT NULL
            AND (whole OR n_words <= 40 OR regexp_matches(lower(split_part(path, '/', -1)), '{licenses.LICENSE_NAME}'))
          QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
dirs AS (SELECT DISTINCT dir FROM named),
near AS (SELECT dir, license_dir, above, above_score FROM dirs JOIN above
         ON dir = license_dir OR starts_with(dir, license_dir || '/')
         QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(license_dir) DESC) = 1)
SELECT doc_id, path, coalesce(license, above) AS license,
       CASE WHEN license IS NOT NULL THEN 'header' WHEN above IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       coalesce(score, above_score) AS score, CASE WHEN license IS NULL THEN license_dir END AS license_dir
FROM head LEFT JOIN near USING (dir)"""


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_LEAKS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 5 * count(*) >= 4 * any_value(n_shingles)"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM m"""

def _crc32_sql(codes: str) -> str:
    """Unsigned crc32 of a list of bytes; the table follows from the polynomial."""
    def entry(c: int) -> int:
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        return c

    return (f"xor(list_reduce(list_prepend(4294967295, {codes}), "
            f"lambda c, b: xor(c >> 8, {[entry(i) for i in range(256)]}[(xor(c, b) & 255) + 1])), 4294967295)")


_UTF8 = ("flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] "
         "ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))")  # code points below 2048
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CODED = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"

_MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({" || ".join(_CODED.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
         CASE WHEN {_crc32_sql(_UTF8.format('doc_id::VARCHAR'))} % 3 = 0
              THEN sha256({" || ".join(_CODED.format(c) for c in ("doc_id", "source", "lang", "n_chars",
                                      f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"))}) END AS now
  FROM documents),
trees AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d GROUP BY lang),
leaves AS (SELECT d.*, n, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
           FROM d JOIN trees ON d.lang IS NOT DISTINCT FROM trees.lang),
low(tree, level, pos, n, h) AS (
  SELECT tree, 0::BIGINT, pos, n, leaf FROM leaves
  UNION ALL
  SELECT tree, any_value(level) + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos))
  FROM low WHERE n > 1 GROUP BY tree, pos // 8),
top(tree, level, pos, n, h) AS (
  SELECT -1::BIGINT, 0::BIGINT, tree, (SELECT count(*) FROM trees), h FROM low WHERE n = 1
  UNION ALL
  SELECT -1, any_value(level) + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY pos // 8),
nodes AS (SELECT * FROM low UNION ALL SELECT * FROM top),
runs AS (SELECT tree, level, pos // 8 AS p, string_agg(h, '' ORDER BY pos) AS run FROM nodes GROUP BY ALL),
links AS (SELECT tree AS t, level AS l, pos AS at_pos, CASE WHEN n > 1 THEN tree ELSE -1 END AS up_tree,
                 CASE WHEN n > 1 THEN level ELSE 0 END AS up_level, CASE WHEN n > 1 THEN pos ELSE tree END AS up_pos
          FROM nodes WHERE n > 1 OR tree >= 0),
up AS (SELECT t, l, at_pos, up_tree, up_level + 1 AS up_level, up_pos // 8 AS up_pos, run[1:up_pos % 8 * 64] AS below,
              run[up_pos % 8 * 64 + 65:] AS behind
       FROM links JOIN runs ON runs.tree = up_tree AND runs.level = up_level AND p = up_pos // 8),
climb(doc_id, leaf, first, tree, level, pos, folded, proof) AS (
  SELECT doc_id, leaf, tree, tree, 0::BIGINT, pos, coalesce(now, leaf), '' FROM leaves
  UNION ALL
  SELECT doc_id, leaf, first, up_tree, up_level, up_pos, sha256(below || folded || behind), proof || below || behind
  FROM climb JOIN up ON t = tree AND l = level AND at_pos = pos)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = top.h AS verified
FROM climb JOIN low sub ON sub.tree = first AND sub.n = 1 JOIN top ON top.n = 1 AND top.level = climb.level
WHERE climb.tree = -1"""

_MIX = """
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
      FROM d GROUP BY source),
shares(rest, weight, capped) AS (
  SELECT sum(source_size)::DOUBLE, sum(weight)::DOUBLE, 0::BIGINT FROM s
  UNION ALL
  SELECT whole - 3 * held, open_weight, now FROM (
    SELECT any_value(shares.capped) AS capped, sum(source_size)::DOUBLE AS whole,
           count(*) FILTER (s.weight * rest / shares.weight > 3 * source_size) AS now,
           coalesce(sum(source_size) FILTER (s.weight * rest / shares.weight > 3 * source_size), 0)::DOUBLE AS held,
           sum(s.weight) FILTER (NOT s.weight * rest / shares.weight > 3 * source_size)::DOUBLE AS open_weight
    FROM shares, s) WHERE now > capped),
last AS (SELECT * FROM shares ORDER BY capped DESC LIMIT 1),
t AS (SELECT source, source_size, least(s.weight * rest / last.weight, (3 * source_size)::DOUBLE) AS target FROM s, last),
p AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296::DOUBLE AS u,
             row_number() OVER (PARTITION BY d.source ORDER BY size, md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + floor((pos + 1) * (rate - floor(rate)) + u) - floor(pos * (rate - floor(rate)) + u)))::BIGINT AS taken
FROM p"""

_SPELLING = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run
                     FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {_crc32_sql(_UTF8.format("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM c),
o AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM v),
x AS (SELECT word, n, place, word[1:place - 1] || word[place + 1:] AS rest FROM i),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM x a JOIN x b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word
         UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS form_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n,
             CASE WHEN form_n >= 2 * v.n THEN (SELECT min(other) FROM near WHERE near.word = v.word AND other_n = form_n) END AS form
      FROM v LEFT JOIN best USING (word)),
chain(word, root) AS (SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON chain.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n
FROM f JOIN chain ON chain.word = f.word JOIN f last ON last.word = chain.root WHERE last.form IS NULL"""

QUERIES = {f.__name__: f for f in (
    op1_pfor_token_ids, op2_license_scan, op3_best_fit_packing, op4_suffix_array_dedup, op5_warc_transactions,
    op6_decontamination, op7_simhash_near_dedup, op8_quality_classifier, op9_quality_rules, op10_language_id,
    op11_merkle_manifest, op12_source_mix, op13_spelling_variants)}

SQL = {"op2_license_scan": _license_sql(), "op5_warc_transactions": _WARC, "op6_decontamination": _LEAKS,
       "op11_merkle_manifest": _MERKLE, "op12_source_mix": _MIX, "op13_spelling_variants": _SPELLING}
