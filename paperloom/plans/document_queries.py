"""Queries of layout, grounding, duplicates and typography, over documents seen as recognised pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import checks, dedup, grounding, layout, quality, scoring
from paperloom.plans.catalog import dealt, register, table
from paperloom.scratch import written

#: Every word of a document with a box made from its place: 40 lines are a page.
WORDS_SQL = """
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS l FROM documents),
wd AS (SELECT doc_id, l, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS w FROM ln),
words AS (SELECT doc_id AS document_id, 1 + l // 40 AS page, l * 1000000 + w AS word_idx, l AS line_num, text, (doc_id * 7 + l * 13 + w * 31) % 101 AS pct,
  w * 90 AS x, (l % 40) * 20 AS y, length(text) * 8 AS width, 10 + (length(text) * 3 + w) % 5 AS height FROM wd WHERE trim(text) <> ''),
lines AS (SELECT document_id, page, row_number() OVER (PARTITION BY document_id, page ORDER BY min(word_idx)) - 1 AS line_idx, line_num, string_agg(text, ' ' ORDER BY x, word_idx) AS text,
  floor((2 * sum(pct * 100) + count(*)) / (2 * count(*))) / 10000.0 AS confidence, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM words GROUP BY document_id, page, line_num)
"""


def texts_of(spark, d):
    """Documents dealt by id: their words, lines and values are made of a text where it is, and meet without a further deal."""
    return dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def words_of(spark, d, texts=None):
    rows = (texts_of(spark, d) if texts is None else texts).select("doc_id", F.posexplode(F.split("text", "\n")).alias("l", "line")).select("doc_id", "l", F.posexplode(F.split("line", " ")).alias("w", "text"))
    made = rows.select(
        F.col("doc_id").alias("document_id"),
        (F.floor(F.col("l") / 40) + 1).alias("page"),
        (F.col("l").cast("long") * 1_000_000 + F.col("w")).alias("word_idx"),
        "text",
        (((F.col("doc_id") * 7 + F.col("l") * 13 + F.col("w") * 31) % 101) / 100.0).alias("confidence"),
        (F.col("w") * 90).alias("x"),
        ((F.col("l") % 40) * 20).alias("y"),
        (F.length("text") * 8).alias("width"),
        (10 + (F.length("text") * 3 + F.col("w")) % 5).alias("height"),
        F.lit(0).alias("block_num"),
        F.lit(0).alias("par_num"),
        F.col("l").alias("line_num"),
    )
    return layout.without_noise(made)


def fields_of(words):
    """Two boxes on each first page: a band at its top, and one that no word touches."""
    pages = words.select("document_id", "page").distinct()
    boxes = F.explode(F.array(
        F.struct(F.lit("band").alias("name"), (F.col("document_id") % 5 * 90).alias("x"), (F.col("document_id") % 7 * 20).alias("y"), F.lit(180).alias("width"), F.lit(25).alias("height")),
        F.struct(F.lit("nowhere").alias("name"), F.lit(-900).cast("long").alias("x"), F.lit(-900).cast("long").alias("y"), F.lit(10).alias("width"), F.lit(10).alias("height")),
    ))
    return pages.filter("page = 1").select("document_id", "page", boxes.alias("b")).select("document_id", "page", "b.*")


@register("words_to_lines", f"WITH {WORDS_SQL} SELECT document_id, page, line_idx, text, confidence, x, y, width, height FROM lines")
def words_to_lines(spark, d):
    return layout.words_to_lines(words_of(spark, d), dealt=True)


@register("page_text", f"""WITH {WORDS_SQL}
, p AS (SELECT document_id, page, string_agg(text, chr(10) ORDER BY line_idx) AS t FROM lines GROUP BY 1, 2)
SELECT document_id, string_agg('--- Page ' || page || ' ---' || chr(10) || t, chr(10) || chr(10) ORDER BY page) AS document_text FROM p GROUP BY 1""")
def page_text(spark, d):
    return layout.document_texts(layout.page_texts(layout.words_to_lines(words_of(spark, d), dealt=True)))


@register("ocr_metrics", f"""WITH {WORDS_SQL}
SELECT document_id, floor((2 * sum(pct * 100) + count(*)) / (2 * count(*))) / 10000.0 AS average_confidence, count(*) FILTER (WHERE pct < 60) AS low_confidence_word_count FROM words GROUP BY 1""")
def ocr_metrics(spark, d):
    return layout.metrics(words_of(spark, d))


@register("field_ocr_confidence", f"""WITH {WORDS_SQL}
, f AS (SELECT DISTINCT document_id, page, unnest(['band', 'nowhere']) AS name FROM words WHERE page = 1),
b AS (SELECT *, CASE name WHEN 'band' THEN document_id % 5 * 90 ELSE -900 END AS fx, CASE name WHEN 'band' THEN document_id % 7 * 20 ELSE -900 END AS fy, CASE name WHEN 'band' THEN 180 ELSE 10 END AS fw, CASE name WHEN 'band' THEN 25 ELSE 10 END AS fh FROM f)
SELECT b.document_id, name, coalesce(floor((2 * sum(pct * 100) + count(pct)) / (2 * nullif(count(pct), 0))) / 10000.0, 0.0) AS ocr_confidence
FROM b LEFT JOIN words w ON w.document_id = b.document_id AND w.page = b.page AND fx - 3 + fw + 6 > x AND x + width > fx - 3 AND fy - 3 + fh + 6 > y AND y + height > fy - 3 GROUP BY 1, 2""")
def field_ocr_confidence(spark, d):
    words = words_of(spark, d)
    return grounding.field_confidence(fields_of(words), words)


def values_of(texts):
    """Words 2 to 4 of one line of each document, as a field's value."""
    parts = F.split(F.element_at(F.split("text", "\n"), (F.col("doc_id") % F.size(F.split("text", "\n")) + 1).cast("int")), " ")
    return texts.select(F.col("doc_id").alias("document_id"), F.lit("value").alias("name"), F.array_join(F.slice(parts, 2, 3), " ").alias("value"))


VALUES_SQL = r"""
vals AS (SELECT doc_id AS document_id, trim(array_to_string(list_slice(string_split(string_split(text, chr(10))[CAST(doc_id % len(string_split(text, chr(10))) AS INT) + 1], ' '), 2, 4), ' ')) AS value FROM documents),
v AS (SELECT *, regexp_replace(lower(value), '[^\p{L}\p{N}_]', '', 'g') AS norm FROM vals WHERE lower(value) NOT IN ('', 'null', 'none')),
m AS (SELECT v.document_id, value, norm, page, line_idx, lines.text AS line_text, lines.x AS lx, lines.y AS ly, lines.width AS lw, lines.height AS lh, regexp_replace(lower(lines.text), '[^\p{L}\p{N}_]', '', 'g') AS ln FROM v JOIN lines USING (document_id) WHERE norm <> ''),
h AS (SELECT *, 1.0 + length(norm) / greatest(length(ln), 1) AS score FROM m WHERE contains(lower(line_text), lower(value)) OR contains(ln, norm)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, page, line_idx) AS r FROM h) WHERE r = 1),
part AS (SELECT best.document_id, string_agg(words.text, ' ' ORDER BY word_idx) AS raw, min(words.x) AS x, min(words.y) AS y, max(words.x + words.width) - min(words.x) AS width, max(words.y + words.height) - min(words.y) AS height
  FROM best JOIN words ON words.document_id = best.document_id AND words.page = best.page AND contains(norm, regexp_replace(lower(words.text), '[^\p{L}\p{N}_]', '', 'g')) AND words.y BETWEEN ly - 10 AND ly + lh + 10 GROUP BY 1)
"""


@register("value_grounding", f"""WITH {WORDS_SQL}, {VALUES_SQL}
SELECT best.document_id, 'value' AS name, 'line' AS method, round(score, 6) AS score, coalesce(raw, line_text) AS raw_text, page, coalesce(x, lx) AS x, coalesce(y, ly) AS y, coalesce(width, lw) AS width, coalesce(height, lh) AS height FROM best LEFT JOIN part ON part.document_id = best.document_id""")
def value_grounding(spark, d):
    texts = texts_of(spark, d)
    words = words_of(spark, d, texts)
    found = grounding.by_line(values_of(texts), layout.words_to_lines(words, dealt=True), words)
    return found.withColumn("score", F.round("score", 6))


@register("word_fallback", f"""WITH {WORDS_SQL}
, v AS (SELECT document_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS norm FROM words WHERE word_idx = 1),
w AS (SELECT *, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS norm FROM words)
SELECT document_id, 'value' AS name, 'word' AS method, CAST(1.0 AS DOUBLE) AS score, text AS raw_text, page, x, y, width, height FROM (
  SELECT w.*, row_number() OVER (PARTITION BY w.document_id ORDER BY page, word_idx) AS r FROM w JOIN v ON v.document_id = w.document_id AND v.norm = w.norm WHERE v.norm <> '') WHERE r = 1""")
def word_fallback(spark, d):
    words = words_of(spark, d)
    values = words.filter("word_idx = 1").select("document_id", F.lit("value").alias("name"), F.concat(F.col("text"), F.lit("!")).alias("value"))
    return grounding.by_word(values, words)


@register("similar_line_fallback")
def similar_line_fallback(spark, d):
    """Ratios of matching characters cannot be written in SQL; tests compare them with difflib."""
    lines = layout.words_to_lines(words_of(spark, d), dealt=True)
    values = lines.filter("line_idx = 0 and page = 1").select("document_id", F.lit("value").alias("name"), F.concat(F.substring("text", 1, 40), F.lit("#")).alias("value"))
    return grounding.by_similarity(values, lines)


@register("font_zscore", f"""WITH {WORDS_SQL}
, base AS (SELECT document_id, sum(height) * 1.0 / count(*) AS m, greatest(sqrt((count(*) * sum(height * height) - sum(height) * sum(height)) * 1.0 / (count(*) * count(*))), 2.0) AS s FROM words WHERE height >= 6 GROUP BY 1 HAVING count(*) >= 5),
f AS (SELECT DISTINCT document_id, document_id % 5 * 90 AS fx, document_id % 7 * 20 AS fy, 180 AS fw, 8 + document_id % 23 AS fh FROM words WHERE page = 1),
o AS (SELECT f.document_id, sum(height) * 1.0 / count(*) AS own FROM f JOIN words w ON w.document_id = f.document_id AND x BETWEEN fx AND fx + fw AND y BETWEEN fy + 1 AND fy + 1 + fh GROUP BY 1),
z AS (SELECT f.document_id, coalesce(own, fh) AS own, m, abs(coalesce(own, fh) - m) / s AS z FROM f JOIN base USING (document_id) LEFT JOIN o USING (document_id))
SELECT document_id, 'font_inconsistency' AS flag_type, 'band' AS affected_field, CASE WHEN own > m THEN 'larger' ELSE 'smaller' END AS evidence, CASE WHEN z >= 3.5 THEN 'high' WHEN z >= 2.5 THEN 'medium' ELSE 'low' END AS severity FROM z WHERE z > 2.0""")
def font_zscore(spark, d):
    words = words_of(spark, d)
    fields = fields_of(words).filter("name = 'band'").withColumn("y", F.col("y") + 1).withColumn("height", (8 + F.col("document_id") % 23).cast("int"))
    return checks.font_flags(fields, words)


@register("table_boxes", """
WITH c AS (SELECT l_orderkey AS document_id, CAST(l_linenumber AS BIGINT) AS r, l_partkey % 100 AS x, l_suppkey % 100 AS y, CAST(l_quantity AS BIGINT) AS w FROM lineitem WHERE CAST(l_quantity AS BIGINT) % 5 <> 0)
SELECT document_id, 0 AS table_idx, max(r) % 3 + 1 AS page, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS width, max(y + w) - min(y) AS height FROM c GROUP BY 1
""")
def table_boxes(spark, d):
    q = F.col("l_quantity").cast("long")
    cells = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(0).alias("table_idx"), F.col("l_linenumber").cast("long").alias("row_index"), F.lit(0).alias("col_pos"), (F.col("l_linenumber").cast("long") % 3 + 1).alias("page"), F.when(q % 5 != 0, F.col("l_partkey") % 100).alias("x"), (F.col("l_suppkey") % 100).alias("y"), q.alias("width"), q.alias("height"))
    return scoring.table_boxes(cells)


@register("exact_dup", """
WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), f AS (SELECT h, min(doc_id) AS m FROM h GROUP BY 1)
SELECT doc_id AS document_id, m AS matched_document_id, 'exact_hash' AS match_type FROM h JOIN f USING (h) WHERE doc_id <> m
""")
def exact_dup(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("file_hash"), F.lit(None).cast("string").alias("perceptual_hash"), F.col("doc_id").alias("seq"))
    return dedup.find_duplicates(docs, docs).drop("distance")


def _signs(spark, d):
    """64 signs of an embedding about its median, as 16 digits: the shape of a perceptual hash. With the query side
    changed in up to 8 low bits the distances straddle the threshold."""
    # What a lambda takes from outside is computed again for every element, so the median goes in as an array.
    median = F.array_repeat(F.element_at(F.array_sort("embedding"), F.lit(33)), F.size("embedding"))
    bits = F.array_join(F.zip_with("embedding", median, lambda x, m: F.when(x >= m, "1").otherwise("0")), "")
    digits = F.array_join(F.transform(F.regexp_extract_all(bits, F.lit("([01]{4})"), F.lit(1)), lambda g: F.lower(F.conv(g, 2, 16))), "")
    return written(table(spark, d, "embeddings").select("vec_id", digits.alias("h")), "signs")


HASH_SQL = """
b AS (SELECT vec_id, list_transform(embedding, lambda x: x >= list_sort(embedding)[33]) AS s FROM embeddings),
f AS (SELECT vec_id, s, list_transform(range(1, 65), lambda i: CASE WHEN i > 56 AND (vec_id % 256 >> (64 - i)) & 1 = 1 THEN NOT s[i] ELSE s[i] END) AS q FROM b)
"""


@register("hamming_dup", f"""WITH {HASH_SQL},
p AS (SELECT a.vec_id AS document_id, b.vec_id AS m, list_sum(list_transform(list_zip(a.q, b.s), lambda z: CAST(z[1] <> z[2] AS INT))) AS dist FROM f a, f b)
SELECT document_id, m + 1000000 AS matched_document_id, 'perceptual_hash_similarity' AS match_type, CAST(dist AS INTEGER) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY dist, m) AS r FROM p WHERE dist <= 5) WHERE r = 1""")
def hamming_dup(spark, d):
    held = _signs(spark, d)
    low = F.lower(F.lpad(F.hex(F.conv(F.substring("h", 15, 2), 16, 10).cast("long").bitwiseXOR(F.col("vec_id") % 256)), 2, "0"))
    new = held.select(F.col("vec_id").alias("document_id"), F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("file_hash"), F.concat(F.substring("h", 1, 14), low).alias("perceptual_hash"), F.col("vec_id").alias("seq"))
    stored = held.select((F.col("vec_id") + 1_000_000).alias("document_id"), F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("file_hash"), F.col("h").alias("perceptual_hash"), F.col("vec_id").alias("seq"))
    return dedup.find_duplicates(new, stored)


@register("dedup_in_order")
def dedup_in_order(spark, d):
    """Each vector twice, the second time with up to 8 bits changed: those near one kept before are dropped. The order
    of decisions cannot be written in SQL; tests compare it with a loop."""
    held = _signs(spark, d)
    low = F.lower(F.lpad(F.hex(F.conv(F.substring("h", 15, 2), 16, 10).cast("long").bitwiseXOR(F.col("vec_id") % 256)), 2, "0"))
    rows = F.explode(F.array(F.struct(F.col("vec_id").alias("seq"), F.col("h").alias("p")), F.struct((F.col("vec_id") + 1_000_000).alias("seq"), F.concat(F.substring("h", 1, 14), low).alias("p"))))
    docs = held.select(rows.alias("r")).select(F.col("r.seq").alias("document_id"), F.sha2(F.col("r.p"), 256).alias("file_hash"), F.col("r.p").alias("perceptual_hash"), F.col("r.seq").alias("seq"))
    return dedup.accepted_in_order(docs)


@register("quality_rollup", """
WITH p AS (SELECT l_orderkey AS document_id, l_quantity * 8 AS blur, CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE -1 END * (l_partkey % 50) / 4.0 AS skew, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS page FROM lineitem)
SELECT document_id, bool_or(blur < 100) AS is_too_degraded, round(min(blur), 2) AS blur_score, round(arg_max(skew, abs(skew) * 100000 - page), 2) AS skew_angle_degrees, CASE WHEN bool_or(blur < 100) THEN 'rejected_too_degraded' ELSE 'ok' END AS status FROM p GROUP BY 1
""")
def quality_rollup(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    sign = F.when(F.col("l_partkey") % 2 == 0, 1).otherwise(-1)
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_quantity") * 8).alias("blur_score"), (sign * (F.col("l_partkey") % 50) / 4.0).alias("skew_angle"), F.row_number().over(order).alias("page"))
    return quality.rollup(pages)
