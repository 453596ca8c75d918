"""Document collections (DOC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import documents
from workload import inputs
from workload.registry import query


@query(
    """SELECT doc_id AS _id, lang, source, n_chars FROM documents WHERE lang = 'en'
    ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 5"""
)
def doc_find(spark, folder):
    return documents.find(
        inputs.documents(spark, folder),
        F.col("lang") == "en",
        ["lang", "source", "n_chars"],
        [F.desc("n_chars"), F.col("_id")],
        skip=5,
        limit=50,
    )


@query(
    """SELECT doc_id AS _id, lang, source, n_chars, has_more,
        CASE WHEN has_more THEN max(doc_id) OVER () END AS next_cursor
    FROM (SELECT *, (SELECT count(*) FROM documents WHERE doc_id > 99) > 100 AS has_more
        FROM documents WHERE doc_id > 99 ORDER BY doc_id LIMIT 100)"""
)
def doc_page(spark, folder):
    slim = inputs.documents(spark, folder).drop("text")
    return documents.page_after(slim, size=100, cursor=99)


@query("SELECT count(*) FILTER (n_chars > 1000) AS n FROM documents")
def doc_count(spark, folder):
    return documents.count(inputs.documents(spark, folder), F.col("n_chars") > 1000)


@query(
    """SELECT lang, source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars,
    max(n_chars) AS longest, CAST(count_if(contains(text, chr(10))) AS BIGINT) AS multi_line
    FROM documents WHERE n_chars > 100 GROUP BY lang, source"""
)
def doc_aggregate(spark, folder):
    return documents.aggregate(
        inputs.documents(spark, folder),
        ["lang", "source"],
        {
            "documents": F.count(F.lit(1)),
            "chars": F.sum("n_chars"),
            "longest": F.max("n_chars"),
            "multi_line": F.count_if(F.contains("text", F.lit("\n"))),
        },
        F.col("n_chars") > 100,
    )


@query(
    """SELECT conv_id AS _id, count(*) AS copies,
        conv_id IN (SELECT doc_id FROM documents) AS stored
    FROM conversations GROUP BY conv_id
    HAVING count(*) > 1 OR conv_id IN (SELECT doc_id FROM documents)"""
)
def doc_duplicate_keys(spark, folder):
    incoming = inputs.table(spark, folder, "conversations").withColumnRenamed("conv_id", "_id")
    return documents.colliding_keys(inputs.documents(spark, folder), incoming)


_LONG = "n_chars > 2000"


def _changes():
    return {"source": F.lit("long"), "reviewed": F.col("n_chars") % 2 == 0}


@query(
    f"""SELECT doc_id AS _id, md5(text) AS text, lang,
    CASE WHEN {_LONG} THEN 'long' ELSE source END AS source, n_chars,
    CASE WHEN {_LONG} THEN n_chars % 2 = 0 END AS reviewed FROM documents"""
)
def doc_update(spark, folder):
    updated = documents.update_many(inputs.documents(spark, folder), F.expr(_LONG), _changes())
    return updated.withColumn("text", F.md5("text"))


@query(
    f"""SELECT CAST(count_if({_LONG}) AS BIGINT) AS matched,
    CAST(count_if({_LONG} AND (source IS DISTINCT FROM 'long' OR lang IS DISTINCT FROM 'en'))
        AS BIGINT) AS modified FROM documents"""
)
def doc_update_counts(spark, folder):
    changes = {"source": F.lit("long"), "lang": F.lit("en")}
    return documents.update_counts(inputs.documents(spark, folder), F.expr(_LONG), changes)


_FIRST = f"(SELECT min(doc_id) FROM documents WHERE {_LONG})"


@query(
    f"""SELECT doc_id AS _id, lang, n_chars,
    CASE WHEN doc_id = {_FIRST} THEN 'first' ELSE source END AS source FROM documents
    UNION ALL SELECT -1, 'xx', 0, 'added' WHERE {_FIRST} IS NULL"""
)
def doc_update_one(spark, folder):
    slim = inputs.documents(spark, folder).drop("text")
    extra = spark.sql("SELECT -1L AS _id, 'xx' AS lang, 'added' AS source, 0L AS n_chars")
    return documents.update_one(slim, F.expr(_LONG), {"source": F.lit("first")}, extra)


@query(
    """SELECT page_id AS _id, md5(html) AS text, '--' AS lang, url AS source,
        CAST(length(html) AS BIGINT) AS n_chars FROM pages
    UNION ALL SELECT doc_id, md5(text), lang, source, n_chars FROM documents
    WHERE doc_id NOT IN (SELECT page_id FROM pages)"""
)
def doc_upsert(spark, folder):
    incoming = inputs.table(spark, folder, "pages").select(
        F.col("page_id").alias("_id"),
        F.col("html").alias("text"),
        F.lit("--").alias("lang"),
        F.col("url").alias("source"),
        F.length("html").cast("long").alias("n_chars"),
    )
    merged = documents.replace(inputs.documents(spark, folder), incoming, upsert=True)
    return merged.withColumn("text", F.md5("text"))


@query(
    """SELECT doc_id AS _id, md5(text) AS text, lang, source, n_chars FROM documents
    WHERE NOT (lang = 'fr' AND n_chars < 1500)"""
)
def doc_delete(spark, folder):
    condition = (F.col("lang") == "fr") & (F.col("n_chars") < 1500)
    left = documents.delete_many(inputs.documents(spark, folder), condition)
    return left.withColumn("text", F.md5("text"))


@query(
    f"""SELECT doc_id AS _id, lang, source, n_chars FROM documents
    WHERE doc_id IS DISTINCT FROM {_FIRST}"""
)
def doc_delete_one(spark, folder):
    slim = inputs.documents(spark, folder).drop("text")
    return documents.delete_one(slim, F.expr(_LONG))


@query(
    """SELECT doc_id AS _id, lang, source, n_chars FROM documents
    UNION ALL SELECT -1 - doc_id, lang, source, n_chars FROM documents"""
)
def doc_insert(spark, folder):
    slim = inputs.documents(spark, folder).drop("text")
    return documents.insert(slim, slim.withColumn("_id", -1 - F.col("_id")))


@query(
    """SELECT doc_id AS _id, lang, source, n_chars FROM documents
    UNION ALL SELECT -1, 'xx', 'added', 0"""
)
def doc_update_one_upsert(spark, folder):
    """No document matches, so the given one is added."""
    slim = inputs.documents(spark, folder).drop("text")
    extra = spark.sql("SELECT -1L AS _id, 'xx' AS lang, 'added' AS source, 0L AS n_chars")
    return documents.update_one(slim, F.col("n_chars") < 0, {"source": F.lit("first")}, extra)


@query(
    """SELECT page_id AS _id, '--' AS lang, url AS source, CAST(length(html) AS BIGINT) AS n_chars
    FROM pages WHERE page_id IN (SELECT doc_id FROM documents)
    UNION ALL SELECT doc_id, lang, source, n_chars FROM documents
    WHERE doc_id NOT IN (SELECT page_id FROM pages)"""
)
def doc_replace(spark, folder):
    incoming = inputs.table(spark, folder, "pages").select(
        F.col("page_id").alias("_id"),
        F.lit("--").alias("lang"),
        F.col("url").alias("source"),
        F.length("html").cast("long").alias("n_chars"),
    )
    return documents.replace(inputs.documents(spark, folder).drop("text"), incoming)


@query(
    f"""SELECT CAST(count_if({_LONG}) AS BIGINT) AS deleted_many,
    least(CAST(count_if({_LONG}) AS BIGINT), 1) AS deleted_one FROM documents"""
)
def doc_delete_counts(spark, folder):
    return documents.delete_counts(inputs.documents(spark, folder), F.expr(_LONG))


@query(
    """SELECT _id, lang, n_chars FROM (SELECT doc_id AS _id, lang, n_chars,
        row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents)
    WHERE place > 100"""
)
def doc_find_skip(spark, folder):
    slim = inputs.documents(spark, folder).drop("text")
    order = [F.desc("n_chars"), F.asc("_id")]
    return documents.find(slim, columns=["lang", "n_chars"], sort=order, skip=100)
