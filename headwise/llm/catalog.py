"""Registered queries of the corpus operators, with production parameters over whole tables."""
from pyspark.sql import functions as F

from headwise.llm import decontamination, importance, language, licenses, near_dedup, packing, quality, sharding, substring, token_counts, url_filter, warc, whitening
from headwise.llm.common import table


def op1_sharding(spark, sf_dir):
    return sharding.sharded_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    judged = language.identify(docs.select("doc_id", "text"), *language.learn(docs))
    return judged.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op6_quality_rules(spark, sf_dir):
    return quality.host_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload")


def op8_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op9_decontamination(spark, sf_dir):
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op10_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_importance(spark, sf_dir):
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_license_scan": op5_license_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc": op7_warc,
    "op8_near_dedup": op8_near_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_packing": op10_packing,
    "op11_importance": op11_importance,
    "op12_whitening": op12_whitening,
    "op13_token_counts": op13_token_counts,
}

ORACLES = {
    "op2_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), starts AS (
            SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, ws FROM w
        ), wins AS (
            SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS win FROM starts
        ), later AS (
            SELECT doc_id, s FROM (
                SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM wins
            ) WHERE k > 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later
        ), each_word AS (
            SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
        ), marked AS (
            SELECT e.doc_id, e.word, e.i, g.i IS NOT NULL AS out
            FROM each_word e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i
        ), kept AS (
            SELECT doc_id, count(*) FILTER (out) AS n_removed,
                   coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT out), '') AS kept
            FROM marked GROUP BY doc_id
        )
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id""",
    "op6_quality_rules": r"""
        WITH w AS (
            SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ), starts AS (
            SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w
        ), repeated AS (
            SELECT rid, i FROM (
                SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS k FROM starts
            ) WHERE k > 1
        ), covered AS (
            SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM repeated) GROUP BY rid
        ), lines AS (
            SELECT rid, count(*) AS all_lines, count(*) - count(DISTINCT line) AS n
            FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM w)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
        ), counts AS (
            SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                   CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                   coalesce(l.n, 0) AS n_dup_lines, coalesce(l.all_lines, 0) AS n_lines, coalesce(c.n, 0) AS n_repeat_words
            FROM w LEFT JOIN lines l ON l.rid = w.rid LEFT JOIN covered c ON c.rid = w.rid
        ), judged AS (
            SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 100 * n_symbols > 10 * n_words AND n_words > 0 AS f3,
                   100 * n_dup_lines > 30 * n_lines AS f4, word_chars < 2 * n_words OR word_chars > 10 * n_words AS f5 FROM counts
        ), failed AS (
            SELECT source, count(*) AS n, unnest(range(1, 6)) AS rule, unnest([count(*) FILTER (f1), count(*) FILTER (f2),
                   count(*) FILTER (f3), count(*) FILTER (f4), count(*) FILTER (f5)]) AS bad FROM judged GROUP BY source
        ), moments AS (
            SELECT rule, sum(bad) / sum(n) AS mean, avg((bad / n) * (bad / n)) - avg(bad / n) * avg(bad / n) AS spread, avg(1 / n) AS noise
            FROM failed GROUP BY rule
        ), prior AS (
            SELECT rule, mean, CASE WHEN spread - mean * (1 - mean) * noise > 0
                THEN least(greatest(mean * (1 - mean) / (spread - mean * (1 - mean) * noise) - 1, 1), 1000) ELSE 1000 END AS weight
            FROM moments
        ), posterior AS (
            SELECT source, rule, mean, n + weight + 1 AS m, (bad + mean * weight) / (n + weight) AS rate FROM failed JOIN prior USING (rule)
        ), sure AS (
            SELECT source, rule, mean, rate - 3 * sqrt(greatest(rate * (1 - rate), 0) / m) AS least FROM posterior
        ), hosts AS (
            SELECT source, bool_or(least > (1 + mean) / 2) AS whole, bool_or(rule = 3 AND least > mean) AS h3,
                   bool_or(rule = 4 AND least > mean) AS h4, bool_or(rule = 5 AND least > mean) AS h5 FROM sure GROUP BY source
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
               NOT (f1 OR f2 OR whole OR (f3 AND h3) OR (f4 AND h4) OR (f5 AND h5)) AS kept
        FROM judged j JOIN hosts h ON h.source IS NOT DISTINCT FROM j.source""",
    "op7_warc": """
        WITH digests AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
        ), coded AS (
            SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i:
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(list_sum(list_transform(range(0, 5), lambda j:
                    CAST(substr(CAST(CAST(unhex(hex) AS BIT) AS VARCHAR), CAST(5 * i + j + 1 AS INT), 1) AS INT) * (16 >> j))) AS BIGINT)
                ]), 'string_agg', '') AS payload_digest
            FROM digests
        ), roles AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM coded
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM roles""",
    "op8_near_dedup": r"""
        WITH RECURSIVE folded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])
                ELSE ws END) AS sh
            FROM folded
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
            FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * k >= 80 * (p.n + q.n - k)
        ), both_ways AS (
            SELECT x, y FROM links UNION SELECT y, x FROM links
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM folded
            UNION
            SELECT r.a, l.y FROM reach r JOIN both_ways l ON l.x = r.b
        ), least AS (
            SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT f.doc_id, coalesce(n, 0) AS n_shingles, component_id, f.doc_id = component_id AS kept
        FROM folded f JOIN least l ON l.doc_id = f.doc_id LEFT JOIN sizes s ON s.doc_id = f.doc_id""",
    "op9_decontamination": r"""
        WITH folded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM documents
        ), items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM benchmark
        ), item_starts AS (
            SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s
            FROM items WHERE len(ws) > 0
        ), item_wins AS (
            SELECT DISTINCT item_id, k, array_to_string(ws[s:s + k - 1], ' ') AS win FROM item_starts
        ), lengths AS (
            SELECT DISTINCT k FROM item_wins
        ), starts AS (
            SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM folded, lengths WHERE len(ws) >= k
        ), wins AS (
            SELECT doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS win FROM starts
        ), hits AS (
            SELECT w.doc_id, w.s, w.k, i.item_id FROM wins w JOIN item_wins i ON i.win = w.win AND i.k = w.k
        ), covered AS (
            SELECT doc_id, count(DISTINCT i) AS n_hit
            FROM (SELECT doc_id, unnest(range(s, s + k)) AS i FROM hits) GROUP BY doc_id
        ), listed AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS item_list
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        )
        SELECT f.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(item_list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM folded f LEFT JOIN covered c ON c.doc_id = f.doc_id LEFT JOIN listed l ON l.doc_id = f.doc_id""",
    "op11_importance": r"""
        WITH table256 AS (
            SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab
        ), texts AS (
            SELECT true AS corpus, row_number() OVER () AS rid, doc_id, text FROM documents
            UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark
        ), folded AS (
            SELECT corpus, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM texts
        ), features AS (
            SELECT corpus, rid, unnest(ws) AS word FROM folded
        ), spelled AS (
            SELECT word, hex(encode(word)) AS digits FROM (SELECT DISTINCT word FROM features)
        ), coded AS (
            SELECT word, list_transform(range(0, length(digits) // 2), lambda i:
                CAST(16 * (position(digits[2 * i + 1] IN '0123456789ABCDEF') - 1)
                     + position(digits[2 * i + 2] IN '0123456789ABCDEF') - 1 AS BIGINT)) AS bytes
            FROM spelled
        ), hashed AS (
            SELECT word, xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]), 4294967295)) % 10000 AS bucket
            FROM coded, table256
        ), placed AS (
            SELECT corpus, rid, bucket FROM features JOIN hashed USING (word)
        ), totals AS (
            SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM placed GROUP BY bucket
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln(
                CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM totals) + 10000 AS DOUBLE)
                / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM totals) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
            FROM totals
        ), weights AS (
            SELECT rid, sum(gain) AS total, count(*) AS n FROM placed JOIN gains USING (bucket) WHERE corpus GROUP BY rid
        ), scored AS (
            SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features,
                   CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
                   CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
            FROM folded f LEFT JOIN weights w ON w.rid = f.rid WHERE corpus
        ), noisy AS (
            SELECT doc_id, n_features, weight,
                   weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
            FROM scored
        ), places AS (
            SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place
            FROM noisy
        )
        SELECT doc_id, n_features, weight, score,
               CASE WHEN place <= (SELECT count(*) FROM noisy WHERE n_features >= 20) * 10 // 100 THEN place END AS rank
        FROM places""",
}
