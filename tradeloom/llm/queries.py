"""The dealt operators over the given tables, with their production parameters."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import (
    codes, cotrain, embed_dedup, infill, jaccard, langid, mixing, neighbours, packing, secrets, topk, url_filter, warc,
)
from tradeloom.materialize import new_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ALLOW, BLOCK = ["org/", "com/fr/"], ["example.org/es/", "example.org/en/1", "com/de/"]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), ALLOW, BLOCK)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("values")
    )
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return topk.top_k(rows, asked, 5).withColumnRenamed("id", "vec_id")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup(_read(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    warc.write(_read(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.read(spark, path, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def held_out() -> Column:
    """True for the documents that no model may learn from; a null id is neither held out nor learned."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()).select("text", "lang"))
    predicted = langid.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(i)).cast("long").alias(f"n_{kind}") for i, kind in enumerate(secrets.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.span_text(of(0, 1, 2)), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    models = cotrain.fit(docs, _read(spark, sf_dir, "labels"))
    return cotrain.score(docs, models).select("doc_id", "score", "label_pred", "text_score", "meta_score")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"), words=3, percent=90).withColumnRenamed("id", "doc_id")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = neighbours.nearest(rows, rows.where("vec_id % 20 = 0"), k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = infill.transform(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    again = infill.restored(F.col("output"), F.col("form"))
    return docs.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(again, 256).alias("restored_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    coded = codes.with_group_error(coded.drop("embedding"), "label", "label_error")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.books_digest(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_top_k, op3_embedding_dedup, op4_warc_round_trip, op5_language, op6_secret_scan, op7_source_mix, op8_pack,
    op9_quality, op10_jaccard_join, op11_nearest, op12_fill_in_middle, op13_vector_codes,
)}

_USABLE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_REACH = """
    reach(id, place) AS (
        SELECT id, id FROM nodes UNION
        SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.place),
    lowest AS (SELECT id, min(place) AS component_id FROM reach GROUP BY id)"""



def _codes_sql(rounds: int = 6) -> str:
    """One pair of CTEs a round: the nearest entry of each part, then the floored means."""
    assign = lambda k: f"""
        a{k} AS MATERIALIZED (SELECT id, pos, min(d) AS d, arg_min(e, d * 16 + e) AS e FROM (
            SELECT p.id, p.pos, b.e, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
            FROM p JOIN b{k} b ON b.pos = p.pos) GROUP BY id, pos)"""  # noqa: E731
    learn = lambda k: f"""
        b{k + 1} AS MATERIALIZED (SELECT b.pos, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
            SELECT pos, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM (
                SELECT a.pos, a.e, j, CAST(sum(p.x[j]) AS BIGINT) AS s, count(*) AS n
                FROM a{k} a JOIN p ON p.id = a.id AND p.pos = a.pos, range(1, len(p.x) + 1) r(j) GROUP BY ALL) GROUP BY pos, e) m
            ON m.pos = b.pos AND m.e = b.e)"""  # noqa: E731
    steps = ",".join(assign(k) + "," + learn(k) for k in range(rounds))
    return f"""
        WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
                   FROM embeddings WHERE embedding IS NOT NULL AND {_USABLE}),
        p AS MATERIALIZED (SELECT id, pos, x[(pos * len(x) // 8 + 1):((pos + 1) * len(x) // 8)] AS x FROM v, range(8) r(pos)),
        b0 AS MATERIALIZED (SELECT pos, x, row_number() OVER (PARTITION BY pos ORDER BY id) - 1 AS e FROM p WHERE id IN (SELECT id FROM v ORDER BY id LIMIT 16)),
        {steps}, {assign(rounds)},
        c AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY id)
        SELECT v.id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY pos, e)) FROM b{rounds}) AS codebooks_sha256
        FROM v JOIN c ON c.id = v.id"""


ORACLE: dict[str, str] = {
    "op2_top_k": f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
                   FROM embeddings WHERE embedding IS NOT NULL AND {_USABLE}),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op3_embedding_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL AND {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id
                  AND list_cosine_similarity(p.x, q.x) >= 0.98),
        nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}
        SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN lowest ON lowest.id = e.vec_id""",
    "op4_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
                  substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', hex[i]) - 3, 4)), '') AS bits,
              min(page_id) OVER (PARTITION BY hex) AS first FROM p)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT)
                   + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM b""",
    "op10_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 3 THEN CASE WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
        nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
        FROM documents d JOIN lowest ON lowest.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op12_fill_in_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                       regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
        d AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS p1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS p2,
                  CASE WHEN x = '' OR regexp_matches(x, '<[PSM]>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
                       WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
        c AS (SELECT *, array_to_string(u[1:least(p1, p2)], '') AS p, array_to_string(u[least(p1, p2) + 1:greatest(p1, p2)], '') AS m,
                  array_to_string(u[greatest(p1, p2) + 1:n], '') AS s FROM d)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(x) AS restored_sha256
        FROM c""",
    "op13_vector_codes": _codes_sql(),
}
