"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    exact_dedup,
    fingerprints,
    importance,
    infill,
    jaccard_join,
    mixing,
    quality_classifier,
    quality_rules,
    sentencepieces,
    sharding,
    token_counts,
    token_files,
    toxicity,
)
from barloom.llm.common import documents
from barloom.session import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


@query(
    r"""WITH sizes AS (SELECT doc_id, source,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
        (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT)
            AS DOUBLE) + 0.5) / 281474976710656.0::DOUBLE AS u FROM documents),
    totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
    ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM totals),
    weighed AS (SELECT source, source_size,
        CAST(CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w,
        CAST(source_size * 2 AS DOUBLE) AS cap FROM ranked),
    levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level FROM weighed
        WINDOW before AS (ORDER BY cap / w, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    chosen AS (SELECT arg_min(level, cap / w) AS level FROM levels WHERE level * w <= cap),
    targets AS (SELECT source, source_size, coalesce(least(cap, w * chosen.level), cap) AS target
        FROM levels, chosen),
    rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio
        FROM targets),
    parts AS (SELECT *, CAST(floor(ratio) AS BIGINT) AS whole, ratio - floor(ratio) AS p,
        target - floor(ratio) * source_size AS goal FROM rated),
    drawn AS (SELECT s.doc_id, s.source, s.size, p.* EXCLUDE (source),
        CASE WHEN p.p > 0 THEN (u / (1 - u)) / (p.p / (1 - p.p)) END AS rank
        FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
    run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING)
        AS upto FROM drawn WHERE rank IS NOT NULL),
    fit AS (SELECT *, upto <= goal AS inside FROM run),
    reached AS (SELECT source, coalesce(max(upto) FILTER (inside), 0) AS reached FROM fit GROUP BY source),
    gaps AS (SELECT f.*, goal - reached AS gap FROM fit f
        JOIN reached r ON f.source IS NOT DISTINCT FROM r.source WHERE NOT inside),
    closing AS (SELECT source, arg_min(doc_id, (abs(size - gap), rank)) AS doc_id FROM gaps
        WHERE abs(size - gap) < gap GROUP BY source)
    SELECT d.doc_id, d.size, d.source_size, d.target,
        CAST(d.size * (d.whole + CASE WHEN coalesce(f.inside, false) OR c.doc_id IS NOT NULL
            THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM drawn d LEFT JOIN fit f ON d.doc_id = f.doc_id
    LEFT JOIN closing c ON d.doc_id = c.doc_id"""
)
def op1_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.pareto_mix(documents(spark, folder)).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query()
def op2_scaled_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edit_likeness(documents(spark, folder))


@query()
def op3_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, folder), 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    r"""WITH split AS (SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)),
            lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
    windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
    counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM windows),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM counted WHERE n > 1) GROUP BY doc_id),
    measured AS (SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*\x{2022}]'))) AS BIGINT)
            AS n_bullet_lines,
        CAST(len(list_filter(l, lambda x: regexp_matches(x, '([.][.][.]|\x{2026})[ \t\r]*$'))) AS BIGINT)
            AS n_ellipsis_lines,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_upper
        FROM split s LEFT JOIN covered c USING (doc_id)),
    judged AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
        + 4 * (n_words > 100000)::INT + 8 * (10 * word_chars < 25 * n_words)::INT
        + 16 * (word_chars > 12 * n_words)::INT + 32 * (10 * n_symbols > n_words)::INT
        + 64 * (2 * n_dup_lines > n_lines)::INT + 128 * (10 * n_upper > 3 * word_chars)::INT
        + 256 * (10 * n_bullet_lines > 9 * n_lines)::INT
        + 512 * (10 * n_ellipsis_lines > 3 * n_lines)::INT AS INTEGER) AS failures FROM measured)
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        failures = 0 AS kept FROM judged"""
)
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(documents(spark, folder)))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


@query()
def op8_quality_nbsvm(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = quality_classifier.train(docs, labels(spark, folder))
    return quality_classifier.score_quality(docs.select("doc_id", "text"), model)


@query()
def op9_toxicity_mil(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = toxicity.train(docs, labels(spark, folder))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model)


@query()
def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return sentencepieces.encode_texts(docs, check=True).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip"
    )


@query()
def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.linked_components(documents(spark, folder), n=4, percent=85)


@query()
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, folder).select("doc_id", "text"))


@query()
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    token_files.write_token_files(documents(spark, folder), path)
    return token_files.read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query(
    r"""WITH texts AS (SELECT doc_id, length(coalesce(text, '')) AS n,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
        count(*) OVER (PARTITION BY text_sha256) AS group_size,
        doc_id = first_value(doc_id) OVER best AS kept, text_sha256 FROM texts
    WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)"""
)
def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, folder))


@query(
    r"""WITH RECURSIVE steps AS (SELECT b, 0 AS k, b AS c FROM range(256) t(b)
        UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
        FROM steps WHERE k < 8),
    crc AS (SELECT list(c ORDER BY b) AS bytes FROM steps WHERE k = 8),
    texts AS (SELECT doc_id, 0 AS kind, text FROM documents
        UNION ALL SELECT item_id, 1, text FROM benchmark),
    cut AS (SELECT row_number() OVER () AS row, doc_id, kind, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM texts),
    features AS (SELECT row, kind, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
        AS feature FROM cut),
    names AS (SELECT DISTINCT feature FROM features),
    hexed AS (SELECT feature, hex(encode(feature)) AS h FROM names),
    hashed AS (SELECT feature, xor(list_reduce(
        list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT)),
        lambda a, b: xor(bytes[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
        FROM hexed, crc),
    placed AS (SELECT row, kind, bucket FROM features JOIN hashed USING (feature)),
    held AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM placed
        GROUP BY bucket),
    totals AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM held),
    gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (ss + 10000)
        / ((s + 1.0::DOUBLE) * (tt + 10000)))) AS BIGINT) AS gain FROM held, totals),
    weights AS (SELECT row, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
        FROM placed JOIN gains USING (bucket) WHERE kind = 0 GROUP BY row),
    scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
        coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
        (CAST('0x' || sha256('7:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT)
        AS score FROM cut LEFT JOIN weights USING (row) WHERE kind = 0),
    drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
        FROM scored WHERE n_words >= 20)
    SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
        CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
    FROM scored LEFT JOIN drawn USING (doc_id)"""
)
def op12_importance_resample(spark: SparkSession, folder: str) -> DataFrame:
    target = spark.read.parquet(f"{folder}/benchmark.parquet")
    return importance.resample(documents(spark, folder), target).select(
        "doc_id", "n_features", "weight", "score", "rank"
    )


@query(
    r"""WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h,
        regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
    numbers AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM cut),
    placed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
            OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
    parts AS (SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m,
        array_to_string(u[high + 1:], '') AS s FROM placed)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form,
        CASE WHEN form != 'plain' THEN length(p) END AS prefix_chars,
        CASE WHEN form != 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(text) AS restored_sha256 FROM parts"""
)
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = infill.fill_in_middle(documents(spark, folder))

    def sha(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        sha(F.col("output")).alias("output_sha256"),
        sha(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
