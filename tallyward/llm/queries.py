"""One query per operator, over its whole table, with production parameters; and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import (
    chat_repair,
    decontaminate,
    license_scan,
    line_dedup,
    line_quality,
    near_dup,
    ordinal,
    packing,
    spelling,
    substring_dedup,
    suffix_tree,
    toxicity,
    vector_codes,
)


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_repair(spark: SparkSession, folder: str) -> DataFrame:
    return chat_repair.repair(_read(spark, folder, "conversations"))


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, folder, "documents"), percent=85)


def op3_packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return line_quality.judged(_read(spark, folder, "documents")).drop("cleaned_text", "lost_words")


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.licenses(_read(spark, folder, "documents"))


def op6_quality_grades(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    return ordinal.graded(docs, ordinal.train(docs, _read(spark, folder, "labels")))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, folder, "documents"))
    return out.withColumn("kept_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text", "input_hash")


def op8_benchmark_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.overlaps(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op9_suffix_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.suffix_tree_scores(_read(spark, folder, "documents"))


def op10_repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated_spans(_read(spark, folder, "documents"), width=20)


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    return toxicity.scored(docs, toxicity.train(docs, _read(spark, folder, "labels")))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(_read(spark, folder, "documents"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.encode(_read(spark, folder, "embeddings")).drop("label")


QUERIES = {f.__name__: f for f in (op1_chat_repair, op2_near_duplicates, op3_packed_sequences, op4_line_quality, op5_license_scan, op6_quality_grades,
    op7_line_dedup, op8_benchmark_overlaps, op9_suffix_tree_scores, op10_repeated_spans, op11_toxicity, op12_spelling_variants, op13_vector_codes)}

def _vector_code_sql(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """Every part against every entry of its codebook, round by round. The distance less the part's own square is ranked."""
    out = [f"""
        WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
                      WHERE len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        part AS (SELECT vec_id, p, v[p * {width} + 1 : p * {width} + {width}] AS v FROM kept, range({parts}) r(p)),
        b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM part
               WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""]
    for k in range(rounds + 1):
        out.append(f"""
        a{k} AS (SELECT vec_id, p, min({{'d': list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v), 'e': e}}) AS best
                 FROM part x JOIN b{k} b USING (p) GROUP BY vec_id, p)""")
        if k < rounds:
            out.append(f"""
        s{k} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (
                   SELECT p, best.e AS e, i, floor(sum(v[i]) / count(*)) AS m FROM a{k} JOIN part USING (vec_id, p), range(1, {width + 1}) r(i) GROUP BY p, best.e, i) GROUP BY p, e),
        b{k + 1} AS (SELECT p, e, coalesce(s{k}.v, b{k}.v) AS v FROM b{k} LEFT JOIN s{k} USING (p, e))""")
    out.append(f"""
        c AS (SELECT vec_id, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN kept USING (vec_id), h""")
    return ",".join(out[:-1]) + "," + out[-1]


ORACLE: dict[str, str] = {
    # The checksum byte by byte; near words share a deletion, or one is a deletion of the other.
    "op12_spelling_variants": r"""
        WITH RECURSIVE bit AS (SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL
                SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
        tab AS (SELECT list(c ORDER BY b) AS t FROM bit WHERE k = 8),
        run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r FROM documents),
        own AS (SELECT doc_id, r, count(*) AS n FROM run GROUP BY doc_id, r),
        sums AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''),
                        lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END))),
                        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM own, tab),
        made AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word, n FROM sums),
        v AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
        near AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b USING (rest, i) WHERE a.word <> b.word
                 UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON rest = v.word UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON rest = v.word),
        best AS (SELECT word, count(*) AS n_near, min({'less': -m, 'other': other}) AS b FROM near GROUP BY word),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 2 * v.n THEN b.other END AS form,
                     CASE WHEN -b.less >= 2 * v.n THEN -b.less END AS form_n FROM v LEFT JOIN best USING (word)),
        walk AS (SELECT word, coalesce(form, word) AS at, form IS NULL AS done FROM f UNION ALL
                 SELECT walk.word, coalesce(f.form, f.word), f.form IS NULL FROM walk JOIN f ON f.word = walk.at WHERE NOT done)
        SELECT word, form, walk.at AS root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN walk USING (word) WHERE done""",
    "op13_vector_codes": _vector_code_sql(),
    "op4_line_quality": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        g AS (SELECT doc_id, i, words[i:i+2] AS gram
              FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
        r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (
                SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (
                  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
        l AS (SELECT doc_id, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
                     length(x) - length(replace(replace(x, '|', ''), '»', '')) AS seps,
                     length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS syms,
                     len(regexp_extract_all(x || ' ', '!![\x20\x09-\x0D]')) AS shouts,
                     regexp_matches(x, '(?i)\b(all rights reserved|licensed under|released under|terms of (use|service)|privacy policy|cookie policy|accept cookies|click here|read more|sign up|log ?in|subscribe|share (this|on)|javascript)\b') AS boiler,
                     regexp_matches(x, '[.,!?:;…]') AS punct
              FROM (SELECT doc_id, unnest(lines) AS x FROM w)),
        b AS (SELECT doc_id, sum(n) AS lost FROM l
              WHERE seps >= 3 OR 100 * syms > 30 * n OR 100 * shouts > 50 * n OR boiler OR (n >= 12 AND NOT punct) GROUP BY doc_id),
        f AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                     (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                     coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
              FROM w LEFT JOIN r USING (doc_id) LEFT JOIN b USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 40 * n_words AS kept
        FROM f""",
    # Eleven of thirteen tokens that agree hold four in a row, so runs of four find every candidate.
    "op8_benchmark_overlaps": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
        dt AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
        bt AS (SELECT item_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM b),
        dg AS (SELECT doc_id, i, w[i:i+3] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d)),
        bg AS (SELECT item_id, i, w[i:i+3] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM b WHERE len(w) >= 13)),
        c AS (SELECT DISTINCT doc_id, item_id, dg.i - bg.i AS shift FROM dg JOIN bg USING (g)),
        e AS (SELECT c.doc_id, c.item_id, shift, bt.p, (dt.t IS NOT NULL AND dt.t = bt.t)::INT AS same
              FROM c JOIN bt USING (item_id) LEFT JOIN dt ON dt.doc_id = c.doc_id AND dt.p = bt.p + c.shift),
        s AS (SELECT doc_id, item_id, shift, p, sum(same) OVER k AS matched, count(*) OVER k AS width
              FROM e WINDOW k AS (PARTITION BY doc_id, item_id, shift ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW))
        SELECT doc_id, item_id, max(matched)::BIGINT AS matched, min(greatest(shift + p - 13, 0))::BIGINT AS first_token
        FROM s WHERE width = 13 AND matched >= 11 GROUP BY doc_id, item_id""",
}
