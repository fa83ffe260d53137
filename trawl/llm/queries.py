"""The operators' registered queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread
from . import collocations, decontam, language, line_dedup, packing, quality, recompression, simhash, suffix_array, topk, url_reputation, warc, whitening
from .common import ID, KEY, Stored, plain

QUALITY_THRESHOLD = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents in fewer parts than there are cores are dealt out, as all work on them is by row."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def fold(doc_id: F.Column | str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % folds


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def quality_model(docs: DataFrame, labels: DataFrame):
    """Learns from the folds 1 to 4 of 5."""
    return quality.train(docs, labels.where(fold("doc_id", 5) != 0).select("doc_id", "quality"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(True))
    scored = quality.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.train(docs.where(fold("doc_id", 4) != 2).select("text", "lang"))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(True))
    return language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), profiles)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines (that take part), n_removed, removed (their places, from 0, comma-separated)."""
    docs = table(spark, sf_dir, "documents")
    lines, removed = line_dedup.duplicate_lines(docs, short=True)
    counts = lines.select(ID, KEY, F.lit(1).alias("a"), F.lit(None).cast("int").alias("line")).unionByName(removed.select(ID, KEY, F.lit(0).alias("a"), "line"))
    counts = counts.groupBy(ID, KEY).agg(F.sum("a").alias("n_lines"), F.sort_array(F.collect_list("line")).alias("removed"))
    rows = plain(docs).select("doc_id", ID, KEY).join(counts, [ID, KEY], "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.size(gone).alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: ``labels.quality`` of the row with the page's id, the only labelled outcomes there are."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_reputation.judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


# ---- stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality_model(docs, table(spark, sf_dir, "labels")), QUALITY_THRESHOLD)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; ``n_chars`` follows the text, and those of which nothing is left go, as each line has an earlier copy."""
    lists = Stored(spark).put(line_dedup.removals(docs, short=True))
    out = line_dedup.without_lines(docs, lists).where("NOT __lost").drop("__lost")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, at a similarity of 0.8 or more of their sets of five-word shingles."""
    return simhash.one_of_similar(docs, shingle=5, similarity=0.8)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, packed."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", stage_quality), ("line_dedup", stage_lines), ("simhash_near_dedup", stage_near_duplicates), ("benchmark_decontamination", stage_decontamination), ("best_fit_packing", stage_packing)]

QUERIES = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_simhash_near_dedup, op3_benchmark_decontamination, op4_suffix_array_dedup, op5_quality_classifier, op6_substring_dedup, op7_language_id, op8_line_dedup, op9_exact_top_k, op10_url_reputation, op11_warc, op12_embedding_whitening, op13_phrase_collocations)
}

ORACLE_SQL = {
    "op6_substring_dedup": r"""
        WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        words AS (SELECT rid, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs),
        windows AS (SELECT rid, doc_id, p.pos AS pos, md5(array_to_string(list_slice(w, p.pos, p.pos + 19), ' ')) AS h
            FROM docs, unnest(range(1, greatest(1, len(w) - 18))) AS p(pos)),
        ranked AS (SELECT rid, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM windows),
        marks AS (SELECT words.rid, words.doc_id, words.pos, words.word,
            coalesce(sum(CASE WHEN ranked.k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY words.rid ORDER BY words.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS hit
            FROM words LEFT JOIN ranked ON words.rid = ranked.rid AND words.pos = ranked.pos),
        kept AS (SELECT rid, sum(CASE WHEN hit > 0 THEN 1 ELSE 0 END) AS n_removed, string_agg(CASE WHEN hit = 0 THEN word END, ' ' ORDER BY pos) AS t FROM marks GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM docs LEFT JOIN kept ON docs.rid = kept.rid""",
    "op9_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        asked AS (SELECT vec_id, min(v) AS v FROM v GROUP BY vec_id),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM asked q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_url_reputation": r"""
        WITH pg AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        got AS (SELECT doc_id, CAST(min(quality) AS DOUBLE) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
        hs AS (SELECT host, CAST(count(good) AS DOUBLE) AS n, coalesce(sum(good), 0.0) AS s FROM pg LEFT JOIN got ON page_id = doc_id GROUP BY host),
        h AS (SELECT host, n, s, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, array_to_string(list_slice(string_split(host, '.'), -1, -1), '.') AS suffix FROM hs),
        g AS (SELECT (sum(s) + 1.0) / (sum(n) + 2.0) AS p FROM h),
        x0 AS (SELECT suffix, sum(n) AS n, sum(s) AS s FROM h GROUP BY suffix),
        k1 AS (SELECT least(1000.0, greatest(2.0, coalesce(sp / nullif(greatest(var - sp * m / tot, sp * 1e-6), 0) - 1, 2.0))) AS k FROM (
            SELECT sum(n * p) / sum(n) * (1 - sum(n * p) / sum(n)) AS sp, sum(n * (s / n - p) * (s / n - p)) / sum(n) AS var, count(*) AS m, sum(n) AS tot FROM x0, g WHERE n > 0)),
        x AS (SELECT suffix, (s + k * p) / (n + k) AS p FROM x0, g, k1),
        d0 AS (SELECT h.suffix AS suffix, domain, x.p AS p, sum(n) AS n, sum(s) AS s FROM h, x WHERE h.suffix = x.suffix GROUP BY h.suffix, domain, x.p),
        k2 AS (SELECT least(1000.0, greatest(2.0, coalesce(sp / nullif(greatest(var - sp * m / tot, sp * 1e-6), 0) - 1, 2.0))) AS k FROM (
            SELECT sum(n * p) / sum(n) * (1 - sum(n * p) / sum(n)) AS sp, sum(n * (s / n - p) * (s / n - p)) / sum(n) AS var, count(*) AS m, sum(n) AS tot FROM d0 WHERE n > 0)),
        d AS (SELECT domain, (s + k * p) / (n + k) AS p FROM d0, k2),
        h0 AS (SELECT host, n, s, d.p AS p FROM h, d WHERE h.domain = d.domain),
        k3 AS (SELECT least(1000.0, greatest(2.0, coalesce(sp / nullif(greatest(var - sp * m / tot, sp * 1e-6), 0) - 1, 2.0))) AS k FROM (
            SELECT sum(n * p) / sum(n) * (1 - sum(n * p) / sum(n)) AS sp, sum(n * (s / n - p) * (s / n - p)) / sum(n) AS var, count(*) AS m, sum(n) AS tot FROM h0 WHERE n > 0)),
        r AS (SELECT host, (s + k * p) / (n + k) AS m, n + k AS w FROM h0, k3)
        SELECT page_id, pg.host AS host, path,
            CASE WHEN (pg.host = 'example.org' OR pg.host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
                 WHEN (pg.host = 'example.org' OR pg.host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
                 WHEN (pg.host = 'com' OR pg.host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
                 WHEN (pg.host = 'com' OR pg.host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
                 WHEN (pg.host = 'org' OR pg.host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule,
            CASE WHEN (pg.host = 'example.org' OR pg.host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'block'
                 WHEN (pg.host = 'example.org' OR pg.host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'block'
                 WHEN (pg.host = 'com' OR pg.host LIKE '%.com') AND path LIKE '/fr/%' THEN 'allow'
                 WHEN (pg.host = 'com' OR pg.host LIKE '%.com') AND path LIKE '/de/%' THEN 'block'
                 WHEN (pg.host = 'org' OR pg.host LIKE '%.org') AND path LIKE '/%' THEN 'allow'
                 WHEN m - 1.645 * sqrt(m * (1 - m) / (w + 1)) >= 0.6 THEN 'allow' ELSE 'block' END AS verdict
        FROM pg, r WHERE pg.host = r.host""",
    "op11_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, html, strlen(html) AS size, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, size AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
            CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d""",
    "op13_phrase_collocations": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        grams AS (SELECT lang, m, list_slice(w, b, b + m - 1) AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS b FROM w, (VALUES (1), (2), (3), (4)) AS t(m) WHERE len(w) >= m)),
        f AS (SELECT lang, m, g, array_to_string(g, ' ') AS phrase, count(*) AS f FROM grams GROUP BY lang, m, g HAVING count(*) >= 30),
        cuts AS (SELECT c.lang AS lang, c.phrase AS phrase, c.f AS a, k, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.f AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
            FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c
            JOIN f x ON x.lang = c.lang AND x.m = k AND x.g = list_slice(c.g, 1, k)
            JOIN f y ON y.lang = c.lang AND y.m = c.m - k AND y.g = list_slice(c.g, k + 1, c.m)),
        low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
        longer AS (SELECT lang, array_to_string(list_slice(g, b, b + s - 1), ' ') AS phrase, max(f) AS f
            FROM (SELECT lang, g, f, s, unnest(range(1, m - s + 2)) AS b FROM f, (VALUES (2), (3)) AS t(s) WHERE m > s) GROUP BY ALL),
        kept AS (SELECT low.lang AS lang, low.phrase AS phrase, a, l, r, score FROM low LEFT JOIN longer ON low.lang = longer.lang AND low.phrase = longer.phrase
            WHERE place = 1 AND (longer.f IS NULL OR 100 * CAST(longer.f AS HUGEINT) < 80 * CAST(a AS HUGEINT))),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT ranked.lang AS lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total ON ranked.lang = total.lang WHERE rank <= 2000""",
}
