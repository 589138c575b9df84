"""The registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, importance, language_id, ngram_join, packing, sentencepiece_codec, simhash, spelling, suffix_dedup, toxicity, url_filter, warc
from .common import Scratch, id_crc32

#: Where the public tokenizers' files are; every executor has the package.
PACKING_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_codec.encode(docs, tokenizer_path(PIECE_MODEL), dropout=0.1, seed=20)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(id_crc32(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    index = toxicity.fit(docs, labels.where(~held_out), Scratch(spark, "toxicity"))
    out = toxicity.score(docs, index)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(PACKING_TOKENIZER))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(id_crc32(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    prototypes = language_id.fit(docs.where(~held_out))
    out = language_id.predict(docs, prototypes)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), damage=97)


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece_dropout, op2_simhash_near_dedup, op3_toxicity, op4_best_fit_packing, op5_suffix_array_dedup, op6_exact_dedup, op7_language_id, op8_warc, op9_url_filters, op10_nearest_neighbours, op11_spelling_variants, op12_ngram_jaccard, op13_importance_resampling)}

#: ``t``: the crc32 table, a number for each byte.
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i:
            list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)),
            lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295)"""
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FEATURES = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op11_spelling_variants": rf"""
        WITH RECURSIVE {_CRC_TABLE},
        runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
        per AS (SELECT doc_id, run, count(*) AS c, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS tag FROM runs GROUP BY doc_id, run),
        h AS (SELECT run, c, {_CRC.format("tag")} AS h FROM per, crc),
        made AS (SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
        words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
        cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS k FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
        pairs AS (SELECT a.word AS u, b.word AS v FROM cut a JOIN cut b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
            UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.k = w.word UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.k = w.word),
        near AS (SELECT u AS word, count(*) AS n_near, min({{'less': -n, 'v': v}}) AS best FROM pairs JOIN words ON v = word GROUP BY u),
        known AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * n THEN best.v END AS form,
            CASE WHEN -best.less >= 2 * n THEN -best.less END AS form_n FROM words LEFT JOIN near USING (word)),
        chain AS (SELECT word, word AS place, 0 AS steps FROM known UNION ALL SELECT c.word, k.form, steps + 1 FROM chain c JOIN known k ON c.place = k.word WHERE k.form IS NOT NULL),
        ends AS (SELECT word, arg_max(place, steps) AS root FROM chain GROUP BY word)
        SELECT word, form, root, n, n_near, form_n FROM known JOIN ends USING (word)
    """,
    "op12_ngram_jaccard": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM d),
        nodes AS MATERIALIZED (SELECT min(doc_id) AS node, len(s) AS n, s FROM sets WHERE len(s) > 0 GROUP BY s),
        grams AS (SELECT node, n, unnest(s) AS g FROM nodes),
        pairs AS (SELECT a.node AS u, b.node AS v, a.n AS nu, b.n AS nv, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.node < b.node GROUP BY ALL),
        links AS MATERIALIZED (SELECT u, v FROM pairs WHERE 100 * c >= 80 * (nu + nv - c)),
        ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
        reach AS (SELECT node, node AS other FROM nodes UNION SELECT r.node, w.v FROM reach r JOIN ways w ON r.other = w.u),
        tops AS (SELECT node, min(other) AS top FROM reach GROUP BY node)
        SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(top, doc_id) AS component_id
        FROM sets LEFT JOIN nodes ON sets.s = nodes.s LEFT JOIN tops USING (node)
    """,
    "op13_importance_resampling": rf"""
        WITH {_CRC_TABLE},
        d AS (SELECT doc_id, coalesce({_FEATURES}, []) AS w FROM documents),
        sw AS (SELECT doc_id, unnest(w) AS word FROM d),
        tw AS (SELECT unnest({_FEATURES}) AS word FROM benchmark),
        vocab AS (SELECT DISTINCT word FROM (SELECT word FROM sw UNION ALL SELECT word FROM tw)),
        v AS MATERIALIZED (SELECT word, {_CRC.format("word")} % 10000 AS b FROM vocab, crc),
        s AS (SELECT b, count(*) AS s FROM sw JOIN v USING (word) GROUP BY b),
        t AS (SELECT b, count(*) AS t FROM tw JOIN v USING (word) GROUP BY b),
        total AS (SELECT (SELECT count(*) FROM sw) AS all_s, (SELECT count(*) FROM tw) AS all_t),
        g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000)))) AS BIGINT) AS gain
            FROM s LEFT JOIN t USING (b), total),
        sums AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM sw JOIN v USING (word) JOIN g USING (b) GROUP BY doc_id),
        scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
                + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM d LEFT JOIN sums USING (doc_id)),
        enough AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN enough USING (doc_id)
    """,
    "op9_url_filters": r"""
        WITH u AS (
            SELECT page_id, coalesce(url, '') AS url,
                translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        fixed(says, rule, h, p) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
            ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
        f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says FROM u, fixed
            WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
        t AS (SELECT u.page_id, host, path, f.rule, f.says, list_sort(list_distinct(list_concat(
                list_transform(regexp_extract_all(url, '^([A-Za-z]+)://', 1), lambda x: 's:' || x),
                list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
                list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(path, '\.[A-Za-z0-9]{1,5}$', ''), '[0-9]+', '#', 'g'), '[/_.-]+'),
                    lambda x: x <> ''), lambda x: 'p:' || x),
                list_transform(regexp_extract_all(path, '\.([A-Za-z0-9]{1,5})$', 1), lambda x: 'e:' || x),
                list_transform(regexp_extract_all(regexp_extract(url, '\?([^#]*)', 1), '(?:^|&)([^=&]+)', 1), lambda x: 'q:' || x)))) AS tokens
            FROM u LEFT JOIN f USING (page_id)),
        one AS (SELECT page_id, says, unnest(tokens) AS a FROM t WHERE says IS NOT NULL),
        two AS (SELECT x.page_id, x.says, x.a, y.a AS b FROM one x JOIN one y ON x.page_id = y.page_id AND x.a < y.a),
        three AS (SELECT x.page_id, x.says, x.a, x.b, y.a AS c FROM two x JOIN one y ON x.page_id = y.page_id AND x.b < y.a),
        sets AS (SELECT [a] AS s, says FROM one UNION ALL SELECT [a, b], says FROM two UNION ALL SELECT [a, b, c], says FROM three),
        n AS (SELECT count(*) AS n FROM t WHERE says IS NOT NULL),
        counted AS (SELECT s, says, count(*) AS hits, sum(count(*)) OVER (PARTITION BY s) AS total FROM sets GROUP BY s, says),
        rules AS (SELECT s, says, round(hits / total, 9) AS confidence, round(hits / n, 9) AS support FROM counted, n
            WHERE hits >= ceil(0.01::DOUBLE * n) AND hits / total >= 0.8),
        kept AS (SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules g WHERE g.says = r.says AND len(g.s) < len(r.s)
            AND list_has_all(r.s, g.s) AND g.confidence >= r.confidence)),
        best AS (SELECT page_id, arg_min(kept.says, (-confidence, -support, array_to_string(s, ' '), kept.says)) AS says
            FROM t JOIN kept ON list_has_all(tokens, s) WHERE t.says IS NULL GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(t.says, best.says, 'allow') AS verdict FROM t LEFT JOIN best USING (page_id)
    """,
    "op8_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
        f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    1 + ((('0x' || substr(p.hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '') AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p JOIN f USING (hex)
    """,
    "op6_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
            FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
        FROM d JOIN g USING (body)
    """,
}
