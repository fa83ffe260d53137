"""The engine's registered queries over the driver's tables, each with SQL for comparison.

All run over whole tables; limits stand only where a top-k report is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vector as V
from .operators import chunking, clusters, conversation, graph, maintain, postings, rank, scope, storage
from .plans import search
from .sources.tables import chunks, shared_folder, spread, table, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TERMS = ["the", "and", "erer"]
QUERY = "the and erer of"
LIMITS = chunking.Limits(optimal=400, smallest=50, largest=600, overlap=60)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and text, over all cores."""
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


BUILT: dict[tuple[str, str, bool], postings.Index] = {}


def keyword_index(spark: SparkSession, sf: str, embedded: bool = False) -> postings.Index:
    """The inverted index of all documents, or of those with a vector; built by the first query of a session that needs it."""
    key = (spark.sparkContext.applicationId, sf, embedded)
    if key not in BUILT:
        rows = searchable(spark, sf)
        rows = rows.join(vectors(spark, sf).select("doc_id"), "doc_id", "left_semi") if embedded else rows
        BUILT[key] = postings.write(rows, shared_folder(spark), keep=("file_path", "lang", "tags"))
    return BUILT[key]


# ---- SQL pieces
TOKENS = r"list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
CHUNKS = r"""SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, (CASE WHEN doc_id % 5 = 0 THEN 'docs/' ELSE 'src/' END) || source || '/' || lang || '/d' || CAST(doc_id AS VARCHAR) || (CASE WHEN doc_id % 7 = 0 THEN '.md' ELSE '.txt' END) AS file_path,
    regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*', 0) AS symbol, sha1(text) AS sha, lang, text FROM documents"""
IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"


def bm25_sql(terms: list[str], source: str = "documents") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""d AS (SELECT doc_id, {TOKENS} AS t FROM {source}),
        tf AS (SELECT doc_id, len(t) AS len, term, CAST(len(list_filter(t, lambda x: x = term)) AS DOUBLE) AS tf FROM d, (SELECT unnest([{listed}]) AS term)),
        st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS mean FROM d),
        df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf WHERE tf > 0 GROUP BY term),
        bm AS (SELECT doc_id, sum({IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS bm25 FROM tf, df, st WHERE tf.term = df.term AND tf > 0 AND n >= 3 GROUP BY doc_id)"""


@query(f"WITH {bm25_sql(TERMS)} SELECT doc_id, round(bm25, 6) AS bm25 FROM (SELECT doc_id, round(bm25, 9) AS bm25 FROM bm ORDER BY bm25 DESC, doc_id LIMIT 20)")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return postings.search(keyword_index(spark, sf), postings.one_query(spark, TERMS), 20, digits=9).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(f"""WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents), q AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS term FROM benchmark),
    p AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS mean FROM d),
    tf AS (SELECT doc_id, len, term, CAST(count(*) AS DOUBLE) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY doc_id, len, term), df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term),
    s AS (SELECT item_id, doc_id, round(sum({IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS bm25 FROM q, tf, df, st WHERE q.term = tf.term AND tf.term = df.term GROUP BY item_id, doc_id)
    SELECT item_id, doc_id, bm25, CAST(rank AS INTEGER) AS rank FROM (SELECT item_id, doc_id, bm25, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def bm25_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "benchmark").select("item_id", T.tokens(F.col("text")).alias("terms"))
    return postings.search(keyword_index(spark, sf), asked, 5, "item_id").withColumnRenamed("query", "item_id")


COSINE = "round(CASE WHEN len(a.v) <> len(b.v) OR list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0 ELSE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) END, 6)"
VECS = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"


def query_vector(spark: SparkSession, sf: str, vec_id: int = 7) -> list[float]:
    """The fixed vector that the vector queries search for."""
    return table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


@query(f"WITH e AS ({VECS}) SELECT a.vec_id AS vec_id, {COSINE} AS score FROM e a, e b WHERE b.vec_id = 7 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.vector_top(table(spark, sf, "embeddings"), query_vector(spark, sf), 10)


@query(ORACLE_SQL["vector_topk"])
def vector_topk_clustered(spark: SparkSession, sf: str) -> DataFrame:
    """The same list from clusters, of which only those that may hold a better vector are read."""
    index = clusters.Clusters.build(table(spark, sf, "embeddings").select("vec_id", "embedding"), shared_folder(spark))
    return index.search(query_vector(spark, sf), 10).rows


@query(f"WITH e AS ({VECS}), s AS (SELECT a.label AS label, a.vec_id AS vec_id, {COSINE} AS score FROM e a, e b WHERE b.vec_id = 7) SELECT label, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 3")
def vector_topk_per_label(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    scored = e.select("label", "vec_id", F.round(V.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query_vector(spark, sf)])), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))).where("rank <= 3")


@query(f"WITH e AS ({VECS}), c AS (SELECT label, [" + ", ".join(f"avg(v[{i + 1}])" for i in range(64)) + f"] AS v FROM e GROUP BY label) SELECT b.label AS label, a.vec_id AS vec_id, {COSINE} AS score FROM e a, c b WHERE a.label = b.label")
def vector_to_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector's cosine to the mean of its label: sums per component, no all-pairs join."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroid = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select("label", F.transform("c", lambda s: s["x"]).alias("c"))
    return e.join(F.broadcast(centroid), "label").select("label", "vec_id", F.round(V.cosine(F.col("embedding"), F.col("c")), 6).alias("score"))


TOPICS_SQL = "CASE WHEN lang = 'en' THEN ['the', lower(source)] ELSE [lower(lang), lower(source)] END"


def searchable(spark: SparkSession, sf: str) -> DataFrame:
    source = F.lower(F.split_part("file_path", F.lit("/"), F.lit(2)))
    return chunks(spark, sf).withColumn("tags", F.when(F.col("lang") == "en", F.array(F.lit("the"), source)).otherwise(F.array(F.lower("lang"), source)))


def hybrid_sql(terms: list[str], text: str, where: str = "TRUE", fallback: bool = False) -> str:
    pool = "SELECT * FROM sc" if fallback else "SELECT sc.* FROM sc JOIN hits ON sc.doc_id = hits.doc_id"
    blist = "SELECT NULL AS doc_id, NULL AS brank WHERE FALSE" if fallback else "SELECT doc_id, row_number() OVER (ORDER BY bm25 DESC, doc_id) - 1 AS brank FROM (SELECT doc_id, bm25 FROM hits ORDER BY bm25 DESC, doc_id LIMIT 60)"
    return f"""WITH ch AS ({CHUNKS}), e AS ({VECS}), inside AS (SELECT ch.*, {TOPICS_SQL.replace("source", "split_part(file_path, '/', 2)")} AS tags, e.v AS v FROM ch JOIN e ON ch.doc_id = e.vec_id WHERE {where}),
        {bm25_sql(terms, "inside")},
        hits AS (SELECT doc_id, round(bm25, 9) AS bm25 FROM bm ORDER BY 2 DESC, doc_id LIMIT 500),
        sc0 AS (SELECT a.doc_id AS doc_id, a.file_path AS file_path, a.tags AS tags, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS cos FROM inside a, e b WHERE b.vec_id = 7),
        sc AS (SELECT doc_id, least(1.0, greatest(0.0, cos + 0.1 * len(list_filter(tags, lambda t: instr('{text}', t) > 0)) + CASE WHEN file_path LIKE 'docs/%' OR file_path LIKE '%.md' THEN 0.15 ELSE 0 END)) AS score FROM sc0),
        pool AS ({pool}), v AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS vrank FROM (SELECT doc_id, score FROM pool ORDER BY score DESC, doc_id LIMIT 60)), b AS ({blist}),
        f AS (SELECT coalesce(v.doc_id, b.doc_id) AS doc_id, coalesce(1.0 / (61 + vrank), 0) + coalesce(1.0 / (61 + brank), 0) AS rrf, vrank, brank FROM v FULL OUTER JOIN b ON v.doc_id = b.doc_id),
        cut AS (SELECT * FROM f ORDER BY rrf DESC, vrank NULLS LAST, brank NULLS LAST, doc_id LIMIT 10)
        SELECT cut.doc_id AS doc_id, round(sc.score, 6) AS score, round(CAST(rrf AS DOUBLE), 9) AS rrf, CAST(vrank AS BIGINT) AS vrank, CAST(brank AS BIGINT) AS brank FROM cut JOIN sc ON cut.doc_id = sc.doc_id"""


@query(hybrid_sql(TERMS, QUERY))
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.hybrid(searchable(spark, sf), vectors(spark, sf), TERMS, QUERY, query_vector(spark, sf), index=keyword_index(spark, sf, True))


@query(hybrid_sql(["nosuchword"], "nosuchword", fallback=True))
def hybrid_keyword_empty(spark: SparkSession, sf: str) -> DataFrame:
    return search.hybrid(searchable(spark, sf), vectors(spark, sf), ["nosuchword"], "nosuchword", query_vector(spark, sf), index=keyword_index(spark, sf, True))


@query(hybrid_sql(TERMS, QUERY, where="file_path LIKE 'src/%' AND ch.lang = 'en'"))
def hybrid_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return search.hybrid(searchable(spark, sf), vectors(spark, sf), TERMS, QUERY, query_vector(spark, sf), where=scope.Scope(path_glob=["src/**"], lang=["en"]), index=keyword_index(spark, sf, True))


@query(f"""WITH ch AS ({CHUNKS}), e AS ({VECS}), inside AS (SELECT ch.*, {TOPICS_SQL.replace("source", "split_part(file_path, '/', 2)")} AS tags, e.v AS v FROM ch JOIN e ON ch.doc_id = e.vec_id),
    q AS (SELECT item_id AS query, CASE WHEN item_id % 10 = 3 THEN ['nosuchword'] ELSE list_distinct({TOKENS}) END AS terms, lower(text) AS qtext, e.v AS qv FROM benchmark JOIN e ON item_id = e.vec_id),
    d AS (SELECT doc_id, {TOKENS} AS t FROM inside), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS mean FROM d),
    w AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d), tf AS (SELECT doc_id, len, term, CAST(count(*) AS DOUBLE) AS tf FROM w GROUP BY doc_id, len, term), df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term),
    asked AS (SELECT query, unnest(terms) AS term FROM q),
    bm AS (SELECT query, doc_id, round(sum({IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS bm25 FROM asked, tf, df, st WHERE asked.term = tf.term AND tf.term = df.term AND n >= 3 GROUP BY query, doc_id),
    hits AS (SELECT * FROM (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY bm25 DESC, doc_id) - 1 AS brank FROM bm) WHERE brank < 500),
    pairs AS (SELECT query, doc_id, brank FROM hits UNION ALL SELECT query, doc_id, NULL FROM q, inside WHERE query NOT IN (SELECT query FROM hits)),
    sc AS (SELECT p.query AS query, p.doc_id AS doc_id, CASE WHEN brank < 60 THEN brank END AS brank, least(1.0, greatest(0.0, round(list_dot_product(i.v, qv) / (sqrt(list_dot_product(i.v, i.v)) * sqrt(list_dot_product(qv, qv))), 9)
        + 0.1 * len(list_filter(tags, lambda t: instr(qtext, t) > 0)) + CASE WHEN file_path LIKE 'docs/%' OR file_path LIKE '%.md' THEN 0.15 ELSE 0 END)) AS score FROM pairs p JOIN inside i ON p.doc_id = i.doc_id JOIN q ON p.query = q.query),
    v0 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) - 1 AS v FROM sc), v1 AS (SELECT query, doc_id, score, brank, CASE WHEN v < 60 THEN v END AS vrank FROM v0),
    f AS (SELECT *, coalesce(1.0 / (61 + vrank), 0) + coalesce(1.0 / (61 + brank), 0) AS rrf FROM v1 WHERE vrank IS NOT NULL OR brank IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, vrank NULLS LAST, brank NULLS LAST, doc_id) AS place FROM f)
    SELECT query, doc_id, round(score, 6) AS score, round(CAST(rrf AS DOUBLE), 9) AS rrf, CAST(coalesce(vrank, -1) AS BIGINT) AS vrank, CAST(coalesce(brank, -1) AS BIGINT) AS brank FROM r WHERE place <= 10""")
def hybrid_many(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item as a query, with the vector of its number; each tenth has no known word."""
    items = table(spark, sf, "benchmark").join(vectors(spark, sf).select(F.col("doc_id").alias("item_id"), F.col("embedding").alias("vector")), "item_id")
    terms = F.when(F.col("item_id") % 10 == 3, F.array(F.lit("nosuchword"))).otherwise(T.tokens(F.col("text")))
    asked = items.select(F.col("item_id").alias("query"), terms.alias("terms"), F.lower("text").alias("text"), "vector")
    found = search.hybrid_many(searchable(spark, sf), vectors(spark, sf), asked, keyword_index(spark, sf, True))
    return found.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("vrank", "brank")})


@query(f"WITH ch AS ({CHUNKS}) SELECT doc_id, file_path FROM ch WHERE regexp_matches(file_path, '^src/[^/]*/(en|fr)/.*\\.md$')")
def scope_path_glob(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).where(scope.path_matches(F.col("file_path"), ["src/*/{en,fr}/**/*.md"])).select("doc_id", "file_path")


@query(f"WITH ch AS ({CHUNKS}) SELECT doc_id, lang FROM ch WHERE lower(lang) IN ('de', 'es')")
def scope_lang(spark: SparkSession, sf: str) -> DataFrame:
    return scope.apply(chunks(spark, sf), scope.Scope.of(lang=["DE", " es "])).select("doc_id", "lang")


@query(f"WITH ch AS (SELECT doc_id, {TOPICS_SQL} AS tags FROM documents) SELECT doc_id FROM ch WHERE list_contains(tags, 'src3') OR list_contains(tags, 'fr')")
def scope_tags_any(spark: SparkSession, sf: str) -> DataFrame:
    return searchable(spark, sf).where(scope.has_tag(F.col("tags"), ["src3", "fr"])).select("doc_id")


@query(f"WITH ch AS ({CHUNKS}), e AS ({VECS}), s AS (SELECT a.doc_id AS doc_id, a.file_path AS file_path, list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))) AS c FROM ch a JOIN e ON a.doc_id = e.vec_id, e q WHERE q.vec_id = 7) SELECT doc_id, round(least(1.0, greatest(0.0, c + CASE WHEN file_path LIKE 'docs/%' OR file_path LIKE '%.md' THEN 0.15 ELSE 0 END)), 6) AS score FROM s")
def doc_boost_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks(spark, sf).join(vectors(spark, sf), "doc_id")
    similarity = V.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query_vector(spark, sf)]))
    score, _ = rank.candidate_score(similarity, F.col("file_path"), F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(QUERY))
    return rows.select("doc_id", F.round(score, 6).alias("score"))


WORDS_SQL = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9_]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[ _]+'), lambda x: x <> '')"


@query(f"SELECT p_partkey, array_to_string({WORDS_SQL.format('p_name || p_type')}, '|') AS words FROM part")
def symbol_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.symbol_words(F.concat("p_name", "p_type")), "|").alias("words"))


STRENGTH_QUERY = "large brushed steel part"
STRENGTH_SQL = f"""WITH w AS (SELECT p_partkey, p_name, p_brand, {WORDS_SQL.format("p_type")} AS ws, p_type FROM part),
    m AS (SELECT p_partkey, p_type, p_brand, CAST(len(list_filter(list_distinct(ws), lambda x: len(x) >= 3 AND instr(' {STRENGTH_QUERY}', ' ' || x) > 0)) AS DOUBLE) AS n FROM w)
    SELECT p_partkey, p_brand, least(1.0, (CASE WHEN instr('{STRENGTH_QUERY}', lower(p_type)) > 0 AND p_type <> '' THEN 4.0 ELSE 0.0 END + CASE WHEN n > 0 THEN 1 + 0.5 * (n - 1) ELSE 0 END) / 4) AS strength FROM m"""


def strengths(spark: SparkSession, sf: str) -> DataFrame:
    s = rank.signature_strength(F.col("p_type"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(STRENGTH_QUERY))
    return table(spark, sf, "part").select("p_partkey", "p_brand", s.alias("strength"))


@query(f"SELECT p_partkey, round(strength, 6) AS strength FROM ({STRENGTH_SQL})")
def symbol_strength(spark: SparkSession, sf: str) -> DataFrame:
    return strengths(spark, sf).select("p_partkey", F.round("strength", 6).alias("strength"))


@query(f"WITH s AS ({STRENGTH_SQL}), b AS (SELECT p_brand, max(strength) AS best FROM s GROUP BY p_brand) SELECT p_partkey, round(least(0.45, 0.3 * strength + 0.15 * best), 6) AS boost FROM s JOIN b ON s.p_brand = b.p_brand")
def symbol_boost_capped(spark: SparkSession, sf: str) -> DataFrame:
    s = strengths(spark, sf)
    best = s.groupBy("p_brand").agg(F.max("strength").alias("best"))
    return s.join(best, "p_brand").select("p_partkey", F.round(rank.symbol_boost(F.col("strength"), F.col("best")), 6).alias("boost"))


# suppliers call the suppliers that their parts' numbers point to
EDGES_SQL = """WITH n AS (SELECT count(*) AS n FROM supplier), c AS (SELECT l_suppkey AS src, l_partkey % n + 1 AS dst, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem, n GROUP BY 1, 2)
    SELECT src, dst, ord FROM c WHERE src <> dst AND dst IN (SELECT s_suppkey FROM supplier)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n"))
    calls = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")).crossJoin(F.broadcast(n))
    calls = calls.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % F.col("n") + 1).alias("to")).agg(F.min("ord").alias("ord"))
    symbols = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sha"), F.lit("f").alias("file"), F.col("s_suppkey").cast("string").alias("name"), F.col("s_suppkey").alias("place"))
    return graph.resolve_calls(calls.select("src", F.lit("f").alias("file"), "ord", F.col("to").cast("string").alias("name")), symbols)


@query(EDGES_SQL)
def call_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf)


@query(f"""WITH e AS ({EDGES_SQL}), o AS (SELECT src AS node, dst AS other, row_number() OVER (PARTITION BY src ORDER BY ord, dst) AS k FROM e), i AS (SELECT dst AS node, src AS other, row_number() OVER (PARTITION BY dst ORDER BY ord, src) AS k FROM e)
    SELECT CAST(coalesce(a.node, b.node) AS VARCHAR) AS node, coalesce(a.x, '') AS callees, coalesce(b.x, '') AS callers FROM (SELECT node, string_agg(CAST(other AS VARCHAR), ',' ORDER BY k) AS x FROM o WHERE k <= 12 GROUP BY node) a
    FULL OUTER JOIN (SELECT node, string_agg(CAST(other AS VARCHAR), ',' ORDER BY k) AS x FROM i WHERE k <= 12 GROUP BY node) b ON a.node = b.node""")
def call_graph_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(edges(spark, sf)).select("node", F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers"))


@query(r"SELECT conv_id, turn, regexp_replace(regexp_replace(trim(lower(text)), '[¿?]', '', 'g'), '\s+', ' ', 'g') AS q FROM conversations WHERE role = 'user'")
def query_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", T.normalize_query(F.col("text")).alias("q"))


@query(r"""WITH q AS (SELECT regexp_replace(regexp_replace(trim(lower(text)), '[¿?]', '', 'g'), '\s+', ' ', 'g') AS q FROM conversations WHERE role = 'user')
    SELECT pattern, count(*) AS frequency FROM (SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '(?i)\b[\w-]+Session\b', '[SESSION]', 'g'), '(?i)\bstripe\b', '[PAYMENT_PROVIDER]', 'g'), '(?i)\b\w+Service\b', '[SERVICE]', 'g'), '(?i)\b\w+Controller\b', '[CONTROLLER]', 'g')) AS pattern FROM q) GROUP BY pattern""")
def query_patterns(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "conversations").where("role = 'user'").select(T.query_pattern(T.normalize_query(F.col("text"))).alias("pattern"))
    return q.groupBy("pattern").agg(F.count(F.lit(1)).alias("frequency"))


INTENT_SQL = "SELECT CAST(user_id AS VARCHAR) AS query, event_type AS target, count(*) AS usage, round(arg_max(value, epoch_us(ts) * 1000 + event_id % 1000), 6) AS confidence FROM events GROUP BY user_id, event_type"


def intention_rows(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("query"), F.col("event_type").alias("target"), F.col("value").alias("confidence"), "ts", F.col("event_id").alias("seq"))
    return maintain.intentions(log).select("query", "target", "usage", F.round("confidence", 6).alias("confidence"))


@query(INTENT_SQL)
def intention_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return intention_rows(spark, sf)


@query(f"WITH i AS ({INTENT_SQL}) SELECT query, target, usage, confidence FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY confidence DESC, usage DESC, target) AS k FROM i) WHERE k = 1")
def intention_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.best_intention(intention_rows(spark, sf))


@query("SELECT sha, doc_id, n_chars FROM (SELECT sha1(text) AS sha, doc_id, n_chars, row_number() OVER (PARTITION BY sha1(text) ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_best_score(spark: SparkSession, sf: str) -> DataFrame:
    return rank.best_per(table(spark, sf, "documents").select(F.sha1("text").alias("sha"), "doc_id", "n_chars"), "sha", "n_chars", "doc_id")


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("""SELECT decision, count(*) AS n, CAST(sum(parts) AS BIGINT) AS parts FROM (SELECT CASE WHEN length(text) < 320 THEN 'too_small' WHEN length(text) > 7200 THEN 'too_large' WHEN length(text) >= 3200 AND length(text) <= 4800 THEN 'optimal' ELSE 'single' END AS decision,
    CASE WHEN length(text) <= 6000 THEN 1 ELSE ceil(length(text) / 4000.0) END AS parts FROM documents) GROUP BY decision""")
def size_decision(spark: SparkSession, sf: str) -> DataFrame:
    size, limits = F.length("text"), chunking.Limits()
    rows = table(spark, sf, "documents").select(chunking.size_decision(size, limits).alias("decision"), chunking.estimated_parts(size, limits).alias("parts"))
    return rows.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.sum("parts").alias("parts"))


PACKING_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS s FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, s, list_prepend(CAST(0 AS HUGEINT), list_transform(range(1, len(s) + 1), lambda i: list_sum(s[1:i]))) AS c FROM d),
    r AS (SELECT doc_id, s, c, 0 AS k, 0 AS b, FALSE AS cut, 0 AS first, 0 AS fresh FROM p UNION ALL
        SELECT doc_id, s, c, k + 1, CASE WHEN over THEN CASE WHEN t = b AND k - b > 1 THEN b + 1 ELSE t END ELSE b END, over, b, CASE WHEN over THEN 1 ELSE fresh + 1 END FROM (
            SELECT *, fresh > 0 AND c[k + 2] - c[b + 1] > {LIMITS.largest} AS over, coalesce(list_max(list_filter(range(b, k), lambda t: c[k + 1] - c[t + 1] >= {max(LIMITS.overlap, LIMITS.largest // 5)})), b) AS t FROM r WHERE k < len(s))),
    x AS (SELECT doc_id, s, first AS a, k - 2 AS e FROM r WHERE cut UNION ALL SELECT doc_id, s, b, k - 1 FROM r WHERE k = len(s))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY e, a) - 1 AS INTEGER) AS part, CAST(a AS INTEGER) AS first_line, CAST(e AS INTEGER) AS last_line, CAST(list_sum(s[a + 1:e + 1]) + e - a AS INTEGER) AS n_chars FROM x"""


@query(PACKING_SQL)
def chunk_lines_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_lines(texts(spark, sf), LIMITS)


@query()
def chunk_sources(spark: SparkSession, sf: str) -> DataFrame:
    files = chunks(spark, sf).select(F.col("file_path").alias("path"), F.lit("markdown").alias("lang"), F.col("text").alias("content"))
    return chunking.chunk(files, LIMITS).select("id", "file_path", "symbol", "chunk_type", "start_line", "end_line")


TAG_WORDS = "list_filter(regexp_split_to_array(lower(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[\\s_-]+'), lambda x: length(x) > 2)"
PARTS_SQL = "flatten(list_transform(string_split(file_path, '/'), lambda p: " + TAG_WORDS.format("regexp_replace(p, '\\.(php|js|ts|tsx)$', '')") + "))"
TOPICS_ALL = "list_filter([" + ", ".join(f"'{w}'" for w in T.TOPIC_WORDS) + "], lambda k: instr(lower(text), k) > 0)"


@query(f"WITH ch AS ({CHUNKS}), l AS (SELECT doc_id, list_concat(list_concat({PARTS_SQL}, {TAG_WORDS.format('symbol')}), {TOPICS_ALL}) AS x FROM ch), u AS (SELECT doc_id, x, unnest(x) AS w, generate_subscripts(x, 1) AS k FROM l), f AS (SELECT doc_id, w, min(k) AS k FROM u GROUP BY doc_id, w), r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k FROM f) SELECT doc_id, string_agg(w, '|' ORDER BY k) AS tags FROM r WHERE k <= 10 GROUP BY doc_id")
def semantic_tags(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    return c.select("doc_id", F.array_join(T.semantic_tags(F.col("file_path"), F.col("symbol"), F.col("text")), "|").alias("tags"))


@query(r"SELECT page_id, len(list_distinct(list_filter(regexp_extract_all(md, '\[([^\]]+)\]\(([^)]+)\)', 2), lambda x: NOT starts_with(x, 'http://') AND NOT starts_with(x, 'https://')))) AS n FROM (SELECT page_id, regexp_replace(html, '<a href=" + '"([^"]*)"' + r"[^>]*>([^<]*)</a>', '[\2](\1)', 'g') AS md FROM pages)")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    md = F.regexp_replace("html", '<a href="([^"]*)"[^>]*>([^<]*)</a>', "[$2]($1)")
    return table(spark, sf, "pages").select("page_id", F.size(T.citations(md)).cast("long").alias("n"))


def redact_sql(column: str) -> str:
    for name in T.ENV_NAMES:
        column = f"regexp_replace({column}, '(?i)\\b{name}\\s*=\\s*([^\\s;]+)', '{name}=[REDACTED]', 'g')"
    for p in T.SECRETS:
        column = f"regexp_replace({column}, '{p.replace('(?s:.*?)', '[^~]*?')}', '[REDACTED]', 'g')"
    return column


@query(f"SELECT doc_id, md5({redact_sql('text')}) AS digest, (length({redact_sql('text')}) - length(replace({redact_sql('text')}, '[REDACTED]', ''))) // 10 AS n FROM documents")
def redact_secrets(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf).select("doc_id", T.redact(F.col("text")).alias("t"))
    n = (F.length("t") - F.length(F.replace("t", F.lit(T.MARK), F.lit("")))) / len(T.MARK)
    return d.select("doc_id", F.md5("t").alias("digest"), n.cast("long").alias("n"))


SANITIZE_SQL = r"regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
for _role in T.ROLES:
    SANITIZE_SQL = f"regexp_replace({SANITIZE_SQL}, '(?im)^(\\s*){_role}\\s*:', '\\1{_role.upper()} (untrusted):', 'g')"
SANITIZE_SQL = f"trim(replace(replace(replace(replace({SANITIZE_SQL}, '<', '&lt;'), '>', '&gt;'), '```', '```{T.ZERO_WIDTH}'), '`', '`{T.ZERO_WIDTH}'))"


@query(f"SELECT page_id, md5(CASE WHEN length(t) > 2000 THEN substr(t, 1, 2000) || '... [truncated]' ELSE t END) AS digest FROM (SELECT page_id, {SANITIZE_SQL.replace('{0}', 'html')} AS t FROM pages)")
def sanitize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(T.sanitize(F.col("html"))).alias("digest"))


@query("SELECT conv_id, turn, " + " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in T.COMPLEX) + " AS complex FROM conversations")
def complex_question(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.is_complex_question(F.col("text")).alias("complex"))


@query(f"WITH ch AS ({CHUNKS}) SELECT doc_id, file_path, symbol, CAST(1.0 AS DOUBLE) AS score FROM ch ORDER BY file_path, symbol, doc_id LIMIT 50")
def overview(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).orderBy("file_path", "symbol", "doc_id").limit(50).select("doc_id", "file_path", "symbol", F.lit(1.0).alias("score"))


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM documents GROUP BY lang")
def stats_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return g.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT DISTINCT label, len(embedding) AS dims FROM embeddings")
def existing_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("label", F.size("embedding").cast("long").alias("dims")).distinct()


# two versions of the index: the stored one has all documents but each third, texts of each fourth differ
STORED_SQL = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN sha1(text || 'old') ELSE sha1(text) END AS h FROM documents WHERE doc_id % 3 <> 0"


def versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents")
    stored = d.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.sha1(F.concat("text", F.lit("old")))).otherwise(F.sha1("text")).alias("file_hash"))
    return stored, d.select("doc_id", F.sha1("text").alias("file_hash"))


@query(f"SELECT d.doc_id AS doc_id, sha1(text) AS file_hash FROM documents d LEFT JOIN ({STORED_SQL}) s ON d.doc_id = s.doc_id WHERE h IS NULL OR h <> sha1(text)")
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    stored, current = versions(spark, sf)
    return maintain.changed(current, stored, key="doc_id")


@query(f"SELECT doc_id FROM ({STORED_SQL}) s WHERE h NOT IN (SELECT sha1(text) FROM documents)")
def stale_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    stored, current = versions(spark, sf)
    return maintain.missing(stored, current, "file_hash").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.missing(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    return maintain.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS k FROM conversations) WHERE k <= 5")
def history_window(spark: SparkSession, sf: str) -> DataFrame:
    return conversation.history(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))


@query("SELECT conv_id, count(DISTINCT turn) AS turns, count(DISTINCT role) AS roles, count(DISTINCT text) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def conversation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return conversation.summary(table(spark, sf, "conversations"))


@query("""WITH s AS (SELECT conv_id, turn, sha1(role || text) AS sha FROM conversations), l AS (SELECT conv_id, max(turn) AS last FROM s GROUP BY conv_id),
    p AS (SELECT s.conv_id AS conv_id, sha, min(turn) AS first, max(turn) AS latest, max(last) AS last FROM s JOIN l ON s.conv_id = l.conv_id GROUP BY s.conv_id, sha)
    SELECT conv_id, sha, first, rank FROM (SELECT conv_id, sha, first, row_number() OVER (PARTITION BY conv_id ORDER BY first, sha) AS rank FROM p WHERE latest < last) WHERE rank <= 5""")
def previously_seen(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return conversation.previously_seen(c.select("conv_id", "turn", F.sha1(F.concat("role", "text")).alias("sha")))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM g GROUP BY user_id, s""")
def debounce_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = maintain.sessions(table(spark, sf, "events").select("user_id", "ts"), "user_id", 600)
    return s.select("user_id", "n", F.unix_micros(F.col("begin").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("last_us"))


@query("SELECT CAST(user_id AS VARCHAR) AS path, CASE WHEN arg_max(event_type, epoch_us(ts) * 1000 + event_id % 1000) = 'error' THEN 'delete' ELSE 'upsert' END AS op FROM events GROUP BY user_id")
def coalesce_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "error", "unlink").otherwise("change").alias("op"), "ts", F.col("event_id").alias("seq"))
    return maintain.coalesced(e)


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_window(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.rate_window(table(spark, sf, "events").select("event_id", "event_type", "ts"), "event_type").select("event_id", "in_window")


@query("""WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS d FROM documents), r AS (SELECT doc_id, list_transform(range(32), lambda i: CAST(('0x' || substr(d, i * 2 + 1, 2)) AS INTEGER) / 255.0 * (1 + (i % 5) * 0.05)) AS v FROM h)
    SELECT doc_id, round(CAST(v[1] / sqrt(list_dot_product(v, v)) AS DOUBLE), 6) AS x0, round(CAST(v[32] / sqrt(list_dot_product(v, v)) AS DOUBLE), 6) AS x31 FROM r""")
def mock_embedding(spark: SparkSession, sf: str) -> DataFrame:
    v = V.mock_embedding(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", v.alias("v")).select("doc_id", F.round(F.col("v")[0], 6).alias("x0"), F.round(F.col("v")[31], 6).alias("x31"))


@query("SELECT sha1(text) AS sha, sha1(text) AS back FROM documents GROUP BY text")
def blob_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    key = bytes(range(32))
    blobs = storage.write_blobs(table(spark, sf, "documents").select(F.sha1("text").alias("sha"), F.col("text").alias("code")), key)
    return storage.read_blobs(blobs, [bytes(32), key]).select("sha", F.sha1("code").alias("back"))


@query("SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(text || ' call(x) if (y) run_it (', '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in T.NOT_CALLS) + ")))) AS n FROM documents")
def call_names(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat("text", F.lit(" call(x) if (y) run_it ("))
    return table(spark, sf, "documents").select("doc_id", F.size(T.call_names(code)).cast("long").alias("n"))


@query("SELECT doc_id, length(text) > 5000 AS too_long, substr(text, 1, 400) AS head FROM documents")
def truncate_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", (F.length("text") > 5000).alias("too_long"), T.truncate(F.col("text"), 100).alias("head"))


COMMENT_SQL = f"SELECT doc_id, '// @trawl-tags: ' || lang || ', ' || symbol || chr(10) || '// @trawl-intent: ' || symbol || chr(10) || 'x' AS c FROM ({CHUNKS})"


@query(rf"SELECT doc_id, coalesce(array_to_string(list_transform(string_split(nullif(trim(regexp_extract(c, '@trawl-tags:[ \t]*([^\n]+)', 1)), ''), ','), lambda x: trim(x)), '|'), '') AS tags, nullif(trim(regexp_extract(c, '@trawl-intent:[ \t]*([^\n]+)', 1)), '') AS intent FROM ({COMMENT_SQL})")
def doc_annotations(spark: SparkSession, sf: str) -> DataFrame:
    comment = F.concat(F.lit("// @trawl-tags: "), "lang", F.lit(", "), "symbol", F.lit("\n// @trawl-intent: "), "symbol", F.lit("\nx"))
    return chunks(spark, sf).select("doc_id", F.array_join(T.annotation_tags(comment), "|").alias("tags"), T.annotation(comment, "intent").alias("intent"))


@query(f"SELECT doc_id, round(CAST(0.1 AS DOUBLE) * len(list_filter([symbol, lang], lambda x: contains('{QUERY}', lower(x)))) + CASE WHEN symbol <> '' AND contains('{QUERY}', lower(symbol)) THEN 0.2 ELSE 0 END, 6) AS boost FROM ({CHUNKS}) WHERE text IS NOT NULL")
def tag_intent_boost(spark: SparkSession, sf: str) -> DataFrame:
    boost = rank.tag_boost(F.array("symbol", "lang"), F.lit(QUERY)) + rank.intent_boost(F.col("symbol"), F.lit(QUERY))
    return chunks(spark, sf).where("text IS NOT NULL").select("doc_id", F.round(boost, 6).alias("boost"))


from . import queries_more  # noqa: E402, F401  (registers its queries)
