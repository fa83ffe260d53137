"""More registered queries with SQL: metadata, the symbol map, search entry, storage failures, updates, streaming state.

The driver's tables hold no source code, so queries on code build small pieces of it from ``part``: one line form
for each remainder of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vector as V
from .operators import chunking, codemap, conversation, graph, maintain, rank, scope, storage
from .plans import answer, search
from .queries import CHUNKS, LIMITS, QUERY, STRENGTH_SQL, TERMS, hybrid_sql, keyword_index, query, query_vector, searchable, strengths, versions
from .sources import files, packs
from .sources.tables import chunks, table, vectors

# ---- metadata of code

CODE = {
    0: ("const ", "Config = {a: 1}"), 1: ("export const ", " = 2"), 2: ("let plain", " = 3"), 3: ("static final MAX_", " = 4"),
    4: ("function run_", "(first, b = 2, *args, cb = g(1, 2)) : string {"), 5: ("class Big_", " extends Base {"), 6: ("  $this->repo_", "->find_it(x)"), 7: ("if (", ") { x }"),
}
CODE_SQL = "SELECT p_partkey, p_partkey % 8 AS form, replace(p_name, ' ', '_') AS word, CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN '{a}' || replace(p_name, ' ', '_') || '{b}'" for k, (a, b) in CODE.items()) + " END AS code FROM part"


def code(spark: SparkSession, sf: str) -> DataFrame:
    """p_partkey, form, word, code."""
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 8).alias("form"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("word"))
    out = F.lit(None).cast("string")
    for k, (a, b) in CODE.items():
        out = F.when(F.col("form") == k, F.concat(F.lit(a), "word", F.lit(b))).otherwise(out)
    return rows.withColumn("code", out)


@query(f"SELECT p_partkey, {' OR '.join(f"regexp_matches(code, '{p}')" for p in T.IMPORTANT)} AS important FROM ({CODE_SQL})")
def important_variable(spark: SparkSession, sf: str) -> DataFrame:
    return code(spark, sf).select("p_partkey", T.is_important_variable(F.col("code")).alias("important"))


@query(f"""SELECT p_partkey, CASE WHEN taken THEN regexp_extract(d, '([A-Za-z_$][A-Za-z0-9_$]*)[ ]*=', 1) ELSE '' END AS name, CASE WHEN taken THEN length(d) ELSE 0 END AS n
    FROM (SELECT p_partkey, d, {' OR '.join(f"regexp_matches(d, '{p}')" for p in T.IMPORTANT)} AS taken FROM (SELECT p_partkey, regexp_extract(code, '^[ ]*((?:export +)?(?:const|let|var|static|final)[^;]*)', 1) AS d FROM ({CODE_SQL})))""")
def collected_variables(spark: SparkSession, sf: str) -> DataFrame:
    v = T.variables(F.concat(F.lit("// head\n"), "code"))
    rows = code(spark, sf).select("p_partkey", v.alias("v"))
    value = F.coalesce(F.length(F.try_element_at("v", F.lit(1))["value"]), F.lit(0)).cast("long")
    return rows.select("p_partkey", F.coalesce(F.try_element_at("v", F.lit(1))["name"], F.lit("")).alias("name"), value.alias("n"))


CALL_SQL = r"regexp_extract(trim(substr(code, 1, 120)), '(?:\$?[A-Za-z_][A-Za-z0-9_]*->|[A-Za-z_][A-Za-z0-9_]*::|[A-Za-z_][A-Za-z0-9_]*\.)*([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)"


@query(f"SELECT p_partkey, CASE WHEN c NOT IN ('', {', '.join(f"'{w}'" for w in T.NOT_CALLS)}) THEN c END AS name FROM (SELECT p_partkey, {CALL_SQL} AS c FROM ({CODE_SQL}))")
def call_name_of_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return code(spark, sf).select("p_partkey", T.call_name(F.col("code")).alias("name"))


@query("SELECT p_partkey, coalesce(" + ", ".join(f"nullif(regexp_extract(code, '{p}', 1), '')" for p in T.NAME_FORMS) + f", 'node_' || CAST(p_partkey AS VARCHAR)) AS name FROM ({CODE_SQL})")
def symbol_name(spark: SparkSession, sf: str) -> DataFrame:
    return code(spark, sf).select("p_partkey", T.symbol_name(F.col("code"), F.lit("node"), F.col("p_partkey")).alias("name"))


@query(f"""SELECT p_partkey, CASE WHEN code LIKE 'class%' THEN 'class ' || word WHEN p IS NULL THEN word || '()' ELSE word || '(' || array_to_string(list_filter(list_transform(string_split(p, ','), lambda x: trim(ltrim(trim(split_part(x, '=', 1)), '*&'))), lambda x: x <> ''), ', ') || ')'
    || coalesce(' : ' || nullif(regexp_extract(code, '[)] *: *([A-Za-z]+)', 1), ''), '') END AS signature
    FROM (SELECT p_partkey, word, code, nullif(regexp_extract(code, '^[^(]*[(]((?:[^()]|[(][^()]*[)])*)[)]', 1), '') AS p FROM ({CODE_SQL}))""")
def symbol_signature(spark: SparkSession, sf: str) -> DataFrame:
    """A default that holds a call is cut at its comma too, as parameters are cut at every comma."""
    kind = F.when(F.col("form") == 5, "class_declaration").otherwise("function_definition")
    return code(spark, sf).select("p_partkey", T.signature(F.col("word"), F.col("code"), kind)["signature"].alias("signature"))




@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/** of ' || source || ' */' WHEN 1 THEN '# ' || source WHEN 2 THEN '-- ' || source END AS comment FROM documents")
def doc_comments(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", (F.col("doc_id") % 4).alias("k"))
    before = F.when(F.col("k") == 0, F.concat(F.lit("/** first */ x /** of "), "source", F.lit(" */"))).when(F.col("k") == 1, F.concat(F.lit("# a\n# "), "source", F.lit("\n"))).when(F.col("k") == 2, F.concat(F.lit("-- "), "source", F.lit("\n"))).otherwise(F.concat(F.lit("/** far */"), F.repeat(F.lit("x"), F.lit(600))))
    lang = F.when(F.col("k") == 0, "java").when(F.col("k") == 1, "ruby").when(F.col("k") == 2, "lua").otherwise("php")
    return d.select("doc_id", T.doc_comment(before, lang).alias("comment"))


@query(f"""SELECT doc_id, md5(concat_ws(chr(10) || chr(10), CASE WHEN doc_id % 2 = 0 THEN '/** ' || lang || ' */' END, text, CASE WHEN symbol <> '' THEN '// Intent: ' || symbol END, '// Description: ' || lang, '// Tags: a, ' || lang, '// Uses variables: v')) AS digest,
    md5(concat_ws(chr(10), CASE WHEN trim(symbol) <> '' THEN symbol END, file_path, text)) AS keyword_digest FROM ({CHUNKS})""")
def embedding_and_keyword_text(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    doc = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/** "), "lang", F.lit(" */")))
    e = T.embedding_text(doc, F.col("text"), F.col("symbol"), F.col("lang"), F.array(F.lit("a"), "lang"), F.array(F.lit("v")))
    return c.select("doc_id", F.md5(e).alias("digest"), F.md5(T.keyword_document(F.col("symbol"), F.col("file_path"), F.lit("  "), F.lit(None).cast("string"), F.col("text"))).alias("keyword_digest"))


MATCH_QUERY = "show the blue bolts and small_ring code"


@query(f"""SELECT p_partkey, contains('{MATCH_QUERY}', replace(p_name, ' ', '_')) OR len(list_filter(string_split(p_name, ' '), lambda w: len(w) >= 3 AND contains(' {MATCH_QUERY}', ' ' || w))) > 0 OR contains('{MATCH_QUERY}', lower(p_brand)) AS hit FROM part""")
def query_names_symbol(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    hit = T.names_symbol(F.lit(MATCH_QUERY), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(None).cast("string"), F.array("p_brand"), F.split("p_name", " "))
    return p.select("p_partkey", hit.alias("hit"))


@query("""SELECT conv_id, turn, array_to_string(list_slice(list_filter(list_transform(CAST(CASE WHEN turn % 3 = 2 THEN '[]' ELSE r END AS VARCHAR[]), lambda x: trim(x)), lambda x: x <> ''), 1, 4), '|') AS queries
    FROM (SELECT conv_id, turn, CAST(json_array(role, '  ' || md5(text) || ' ', '', CAST(turn AS VARCHAR), role, 'e', 'f') AS JSON) AS r FROM conversations)""")
def sub_query_parsing(spark: SparkSession, sf: str) -> DataFrame:
    items = F.array("role", F.concat(F.lit("  "), F.md5("text"), F.lit(" ")), F.lit(""), F.col("turn").cast("string"), "role", F.lit("e"), F.lit("f"))
    reply = F.when(F.col("turn") % 3 == 2, "no list here").otherwise(F.concat(F.lit("Sure:\n"), F.to_json(items), F.lit("\nDone.")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(T.sub_queries(reply), "|").alias("queries"))


REPLY_SQL = "CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN '  ' WHEN 2 THEN text || ' </Code_Context>' ELSE 'My System Prompt <user_query>' END"


@query(f"SELECT conv_id, turn, concat_ws(',', CASE WHEN trim(r) = '' THEN 'empty_response' END, CASE WHEN regexp_matches(r, '{T.LEAKS}') THEN 'prompt_structure_leak' END, CASE WHEN regexp_matches(r, '{T.OBEYS}') THEN 'injection_acknowledgment' END) AS issues FROM (SELECT conv_id, turn, {REPLY_SQL} AS r FROM conversations)")
def response_issues(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("turn") % 4
    reply = F.when(k == 0, F.col("text")).when(k == 1, "  ").when(k == 2, F.concat("text", F.lit(" </Code_Context>"))).otherwise("My System Prompt <user_query>")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(T.response_issues(reply), ",").alias("issues"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE 'see [a](src/' || source || ') and [b](http://x) and [c](' || lang || '.md)' || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || 'The following files were referenced in this answer:' || chr(10) || chr(10)
    || '1. `src/' || source || '`' || chr(10) || '2. `' || lang || '.md`' || chr(10) END AS answer FROM documents""")
def citation_footer(spark: SparkSession, sf: str) -> DataFrame:
    md = F.concat(F.lit("see [a](src/"), "source", F.lit(") and [b](http://x) and [c]("), "lang", F.lit(".md)"))
    return table(spark, sf, "documents").select("doc_id", T.with_references(F.when(F.col("doc_id") % 3 == 0, "none").otherwise(md)).alias("answer"))


KEYS = ("apiKey", "user-name", "Session_ID", "clientSecret", "path", "GH_TOKEN", "author", "access.token")


@query(f"""WITH e AS (SELECT event_id, event_type, list_value({', '.join(f"'{k}'" for k in KEYS)})[event_id % 8 + 1] AS key FROM events),
    w AS (SELECT *, string_split(lower(trim(regexp_replace(regexp_replace(key, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[^a-zA-Z0-9]+', '_', 'g'), '_')), '_') AS words FROM e)
    SELECT event_id, CASE WHEN len(list_intersect(words, list_value({', '.join(f"'{x}'" for x in T.SENSITIVE_WORDS)}))) > 0 {' '.join(f"OR (list_contains(words, '{a}') AND list_contains(words, '{b}'))" for a, b in T.SENSITIVE_PAIRS)}
        OR array_to_string(words, '_') IN ({', '.join(f"'{x.lower()}'" for x in T.ENV_NAMES)}) THEN '[REDACTED]' ELSE event_type END AS own, regexp_replace('key sk-abcdefghij' || lpad(CAST(event_id AS VARCHAR), 10, '0'), '{T.SECRETS[0]}', '[REDACTED]', 'g') AS other FROM w""")
def redact_by_key(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.element_at(F.array(*map(F.lit, KEYS)), (F.col("event_id") % 8 + 1).cast("int"))
    m = T.redact_map(F.create_map(F.lit("own"), F.lit("x"), keys, F.col("event_type"), F.lit("note"), F.concat(F.lit("key sk-abcdefghij"), F.lpad(F.col("event_id").cast("string"), 10, "0"))))
    return table(spark, sf, "events").select("event_id", m[keys].alias("own"), m["note"].alias("other"))


@query(f"""SELECT doc_id, CAST(1 + length(substr(text, 1, 100)) - length(replace(substr(text, 1, 100), chr(10), '')) AS INTEGER) AS line, trim(string_split(text, '.')[1]) AS head FROM documents""")
def line_numbers_and_heads(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", T.line_number(F.col("text"), F.lit(100)).alias("line"), T.head(F.replace("text", F.lit("."), F.lit("{"))).alias("head"))


# ---- files and scope

PATHS_SQL = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'src/vendor/a.php' WHEN 1 THEN 'app/' || source || '/x.py' WHEN 2 THEN 'bin/run.sh' WHEN 3 THEN '.git/hook.py' WHEN 4 THEN 'deep/examples/x/y.md' WHEN 5 THEN 'package-lock.json'
    WHEN 6 THEN '../out/of.py' WHEN 7 THEN 'lib/x.min.json' ELSE 'notes.txt' END AS path FROM documents"""


def paths(spark: SparkSession, sf: str) -> DataFrame:
    out = F.lit("notes.txt")
    for k, v in enumerate(("src/vendor/a.php", None, "bin/run.sh", ".git/hook.py", "deep/examples/x/y.md", "package-lock.json", "../out/of.py", "lib/x.min.json")):
        out = F.when(F.col("doc_id") % 9 == k, F.concat(F.lit("app/"), "source", F.lit("/x.py")) if v is None else F.lit(v)).otherwise(out)
    return table(spark, sf, "documents").select("doc_id", out.alias("path"))


SOURCE_SQL = f"regexp_matches(lower(path), '[.]({'|'.join(files.LANGUAGES)})$')"


@query(f"""SELECT doc_id, path, {SOURCE_SQL} AS supported, {SOURCE_SQL} AND NOT regexp_matches(path, '(^|/)[.][^/]') AND NOT (path GLOB '**/*.min.json' OR {' OR '.join(f"contains('/' || path, '/{d}/')" for d in ('vendor', 'node_modules', '.git', 'storage', 'dist', 'build', 'tmp', 'temp', '.npm', '.yarn', 'Library', 'System', '.Trash', 'examples', 'assets'))}
    OR regexp_extract(path, '[^/]*$') IN ('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml') OR path LIKE '%.min.json') AS taken, NOT list_contains(string_split(path, '/'), '..') AND path <> '' AND NOT starts_with(path, '/') AS safe FROM ({PATHS_SQL})""")
def scanned_paths(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return paths(spark, sf).select("doc_id", "path", files.is_supported(path).alias("supported"), files.is_source(path).alias("taken"), files.is_safe(path).alias("safe"))


@query(f"WITH ch AS ({CHUNKS}) SELECT DISTINCT file_path FROM ch")
def file_paths(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("file_path").distinct().orderBy("file_path")


@query("SELECT vec_id FROM embeddings WHERE label = 3 AND len(embedding) = 64")
def chunks_of_provider(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumn("embedding_provider", F.col("label").cast("string"))
    return scope.apply(e, scope.Scope(provider="3")).where(F.size("embedding") == 64).select("vec_id")


@query("SELECT vec_id, least(1.0, greatest(0.0, round(x * 3, 6))) AS score FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)")
def score_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", V.clip(F.round(F.col("embedding")[0].cast("double") * 3, 6)).alias("score"))


# ---- index maintenance


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def chunks_without_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Only chunks that are not stored yet need a vector."""
    from .plans.indexing import new_chunks

    stored, current = versions(spark, sf)
    return new_chunks(current.withColumnRenamed("doc_id", "id"), stored.withColumnRenamed("doc_id", "id")).select(F.col("id").alias("doc_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.delete(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query(f"WITH ch AS ({CHUNKS}) SELECT doc_id FROM ch WHERE file_path NOT IN (SELECT file_path FROM ch WHERE doc_id % 11 = 0)")
def delete_by_file_path(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf).select("doc_id", "file_path")
    return maintain.delete(c, c.where("doc_id % 11 = 0"), "file_path").select("doc_id")


@query("SELECT DISTINCT sha1(text) AS sha FROM documents WHERE sha1(text) IN (SELECT sha1(text) FROM documents WHERE doc_id % 4 <> 0)")
def live_blobs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("sha"))
    return maintain.live_blobs(d.select("sha").distinct(), d.where("doc_id % 4 <> 0"))


ENTRY_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, CASE WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE p_name END AS file, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS symbol, 'unknown' AS sha,
    CAST(greatest(p_size - 10, 0) AS DOUBLE) AS path_weight, least(1.0, p_size / 40.0) AS success_rate, greatest(p_size - 20, 0) AS variable_count, p_type || '|' || p_brand AS calls FROM part"""


def entries(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("chunk_id"), F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_name")).alias("file"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("symbol"),
        (F.col("p_size") - 10).cast("double").alias("path_weight"), (F.col("p_size") / 40).alias("success_rate"), (F.col("p_size") - 20).alias("variable_count"),
        F.array("p_type", F.lit(" "), F.concat(F.lit(" "), "p_brand"), "p_type").alias("symbol_calls"),
    )


@query(ENTRY_SQL)
def symbol_map_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return codemap.normalized(entries(spark, sf)).select("chunk_id", "file", "symbol", "sha", "path_weight", F.col("success_rate").alias("success_rate"), "variable_count", F.array_join("symbol_calls", "|").alias("calls"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 <> 0 THEN 'new' WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE p_name END AS file, CASE WHEN p_partkey % 2 = 0 THEN 'N' || p_size WHEN p_partkey % 7 <> 0 THEN p_brand END AS symbol,
    p_type || '|' || p_brand AS calls FROM part""")
def symbol_map_merged(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("chunk_id"), F.when(F.col("p_partkey") % 4 != 0, "new").alias("file"), F.concat(F.lit("N"), F.col("p_size").cast("string")).alias("symbol"))
    return codemap.merged(codemap.normalized(entries(spark, sf)), new).select("chunk_id", "file", "symbol", F.array_join("symbol_calls", "|").alias("calls"))


@query("SELECT event_id, count(*) OVER w AS in_window, CAST(sum(floor(value)) OVER w AS BIGINT) AS tokens_in_window FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)")
def token_rate_window(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "event_type", "ts", F.floor("value").alias("tokens"))
    return maintain.rate_window(e, "event_type", tokens="tokens").select("event_id", "in_window", "tokens_in_window")


@query("""WITH r AS (SELECT user_id AS key, max(CAST(epoch_us(ts) AS HUGEINT) * 100000 + event_id) AS last, max(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) AS s FROM events WHERE event_type <> 'view' GROUP BY user_id)
    SELECT CAST(key AS VARCHAR) AS key, CAST(last // 100000 AS BIGINT) AS last_us FROM r WHERE s IS NOT NULL ORDER BY last DESC LIMIT 20""")
def cache_state(spark: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("event_type") == "purchase", "set").when(F.col("event_type") == "view", "peek").otherwise("get")
    log = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), op.alias("op"), "ts", F.col("event_id").alias("seq"))
    return maintain.cached(log, 20).select("key", F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"))


@query("""WITH l AS (SELECT user_id AS path, arg_max(event_type, CAST(epoch_us(ts) AS HUGEINT) * 100000 + event_id) AS size, max(epoch_us(ts)) AS seen FROM events GROUP BY user_id),
    o AS (SELECT e.user_id AS path, max(epoch_us(ts)) AS other FROM events e JOIN l ON e.user_id = l.path WHERE e.event_type <> l.size GROUP BY e.user_id),
    s AS (SELECT l.path AS path, size, seen, min(epoch_us(ts)) AS since FROM events e JOIN l ON e.user_id = l.path AND e.event_type = l.size LEFT JOIN o ON o.path = l.path WHERE other IS NULL OR epoch_us(ts) > other GROUP BY l.path, size, seen)
    SELECT CAST(path AS VARCHAR) AS path, size, since AS since_us FROM s WHERE (seen // 1000 - since // 1000) >= 60000""")
def stable_files(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), "ts", F.col("event_type").alias("size"))
    return maintain.stable(e, 60_000).select("path", "size", F.unix_micros(F.col("since").cast("timestamp")).alias("since_us"))


@query("SELECT CAST(count(*) AS BIGINT) AS done, CAST(200000 - least(count(*), 200000) AS BIGINT) AS left_over, round(100.0 * count(*) / 200000, 1) AS percent, round((200000 - least(count(*), 200000)) * avg(event_id % 7 + 1), 3) AS seconds_left FROM events")
def indexing_progress(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "events").select(F.col("event_id").alias("file"), F.col("ts").cast("timestamp").alias("begin"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") % 7 + 1) * 1_000_000).alias("end"))
    return maintain.progress(done, 200_000).select("done", F.col("left").cast("long").alias("left_over"), "percent", F.round("seconds_left", 3).alias("seconds_left"))


@query("SELECT count(*) FILTER (op = 'upsert') AS changes, count(*) FILTER (op = 'delete') AS deletes FROM (SELECT user_id, CASE WHEN arg_max(event_type, CAST(epoch_us(ts) AS HUGEINT) * 100000 + event_id) = 'error' THEN 'delete' ELSE 'upsert' END AS op FROM events GROUP BY user_id)")
def pending_changes(spark: SparkSession, sf: str) -> DataFrame:
    from .streaming import watch

    e = table(spark, sf, "events").select(F.concat(F.col("user_id").cast("string"), F.lit(".py")).alias("path"), F.when(F.col("event_type") == "error", "unlink").otherwise("change").alias("op"), "ts", F.col("event_id").alias("seq"))
    return watch.pending(e)


# ---- storage


@query("""SELECT reason, count(*) AS n, round(100.0 * count(*) / (SELECT count(DISTINCT text) FROM documents), 1) AS share FROM (SELECT text, CASE min(doc_id) % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'damaged' WHEN 2 THEN 'encrypted' WHEN 3 THEN 'version' END AS reason FROM documents GROUP BY text)
    WHERE reason IS NOT NULL GROUP BY reason""")
def blob_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Blobs of which some were lost, cut, sealed by another key, or written by a later version."""
    first = table(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("k")).select(F.col("text").alias("code"), F.sha1("text").alias("sha"), (F.col("k") % 5).alias("k"))
    key, other = bytes(range(32)), bytes(32)
    sealed = storage.write_blobs(first.where("k <> 2"), key).unionByName(storage.write_blobs(first.where("k = 2"), other))
    k = F.col("k")
    changed = F.when(k == 0, F.lit(None).cast("binary")).when(k == 1, F.substring("payload", 1, 40)).when(k == 3, F.concat(F.substring("payload", 1, 8), F.lit(b"\x07"), F.substring("payload", F.lit(10), F.length("payload")))).otherwise(F.col("payload"))
    return storage.load_failures(storage.read_blobs(sealed.join(first.select("sha", "k"), "sha").select("sha", changed.alias("payload"), "encrypted"), [key])).select("reason", "n", "share")


@query("""SELECT sha, path, CASE WHEN doc_id % 6 <> 0 THEN md5(substr(text, 1, 300)) END AS code, doc_id % 6 <> 0 AND length(text) > 300 AS truncated, CASE WHEN doc_id % 6 = 0 THEN 'missing' END AS error
    FROM (SELECT min(doc_id) AS doc_id, sha1(text) AS sha, text, 'd' || min(doc_id) AS path FROM documents GROUP BY text)""")
def search_with_code(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).withColumn("sha", F.sha1("text"))
    blobs = storage.write_blobs(d.where("doc_id % 6 <> 0").select("sha", F.col("text").alias("code")))
    results = d.select("sha", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"))
    return storage.with_code(results, blobs, most=300).select("sha", "path", F.md5("code").alias("code"), "truncated", "error")


@query("SELECT sha1(text) AS sha, md5(text) AS code FROM documents WHERE doc_id = 17")
def chunk_by_sha(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.sha1("text").alias("sha"), F.col("text").alias("code"), "doc_id")
    wanted = d.where("doc_id = 17").select("sha")
    blobs = storage.write_blobs(d, bytes(32))
    return storage.read_blobs(blobs.join(F.broadcast(wanted), "sha", "left_semi"), [bytes(32)]).select("sha", F.md5("code").alias("code"))


# ---- ranking

NEIGHBOUR_SQL = f"WITH s AS ({STRENGTH_SQL})"


@query(f"{NEIGHBOUR_SQL} SELECT CAST(a.p_partkey AS VARCHAR) AS id, max(b.strength) AS neighbour FROM s a JOIN s b ON b.p_partkey IN (a.p_partkey + 1, a.p_partkey + 2, a.p_partkey * 2) GROUP BY a.p_partkey")
def best_neighbour(spark: SparkSession, sf: str) -> DataFrame:
    s = strengths(spark, sf)
    nodes = s.select(F.col("p_partkey").cast("string").alias("id"), F.array(F.col("p_partkey") + 1, F.col("p_partkey") + 2, F.col("p_partkey") * 2).alias("both"))
    return graph.best_neighbour(nodes, s.select(F.col("p_partkey").alias("sha"), "strength"))


BOOSTED_SQL = """SELECT p_partkey AS id, round(p_size / 50.0, 6) AS score, CASE WHEN p_partkey % 3 = 0 THEN 0.1 ELSE 0.0 END AS symbol_boost, 1.0 / (61 + p_partkey * 7 % 997) AS rrf FROM part"""


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY score DESC, symbol_boost DESC, rrf DESC, id) AS INTEGER) AS place FROM (SELECT * FROM ({BOOSTED_SQL}) ORDER BY rrf DESC, id LIMIT 100)")
def boosted_order(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(F.col("p_size") / 50.0, 6).alias("score"), F.when(F.col("p_partkey") % 3 == 0, 0.1).otherwise(0.0).alias("symbol_boost"), (1.0 / (61 + F.col("p_partkey") * 7 % 997)).alias("rrf"))
    ordered = rank.boosted_order(p, 100).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("symbol_boost"), F.desc("rrf"), "id")))
    return ordered.select("id", "place")


@query("SELECT doc_id AS id, CAST(CASE WHEN k <= 50 THEN length(text) % 101 END AS DOUBLE) AS rerank, k > 50 AS rest FROM (SELECT doc_id, text, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents)")
def reranked(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), "text")
    out = rank.rerank(d, lambda texts: [float(len(t) % 101) for t in texts])
    return out.select("id", "rerank", F.col("rerank").isNull().alias("rest"))


@query("""WITH a AS (SELECT sha1(text) AS sha, doc_id, CAST(n_chars AS DOUBLE) AS score, 0 AS q FROM documents WHERE lang = 'en' UNION ALL SELECT sha1(text), doc_id, CAST(n_chars * 1.5 AS DOUBLE), 1 FROM documents WHERE doc_id % 2 = 0)
    SELECT sha, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY score DESC, q, doc_id) AS k FROM a) WHERE k = 1 ORDER BY score DESC, sha LIMIT 40""")
def multi_query_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.sha1("text").alias("sha"), "doc_id", F.col("n_chars").cast("double").alias("score"), "lang")
    one = rank.best_per(d.where("lang = 'en'").select("sha", "doc_id", "score"), "sha", "score", "doc_id")
    two = rank.best_per(d.where("doc_id % 2 = 0").select("sha", "doc_id", (F.col("score") * 1.5).alias("score")), "sha", "score", "doc_id")
    return rank.multi_query([one, two], 40)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, sha1(text)) AS k FROM conversations) WHERE k <= 3")
def context_cap(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("turn").alias("inserted"), F.sha1("text").alias("sha"))
    return conversation.newest(c, 3).select("conv_id", "turn", "role")


BOTH_SQL = """WITH n AS (SELECT count(*) AS n FROM supplier), e AS (SELECT l_suppkey AS src, l_partkey % n + 1 AS dst, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem, n WHERE l_suppkey <> l_partkey % n + 1 AND l_partkey % n + 1 IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2),
    o AS (SELECT src AS node, dst AS other, row_number() OVER (PARTITION BY src ORDER BY ord, dst) AS k FROM e), i AS (SELECT dst AS node, src AS other, row_number() OVER (PARTITION BY dst ORDER BY ord, src) AS k FROM e),
    a AS (SELECT node, other, k FROM o WHERE k <= 12 UNION ALL SELECT node, other, 100 + k FROM i WHERE k <= 12), f AS (SELECT node, other, min(k) AS k FROM a GROUP BY node, other),
    r AS (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY k) AS k FROM f)
    SELECT CAST(node AS VARCHAR) AS node, string_agg(CAST(other AS VARCHAR), ',' ORDER BY k) AS neighbours FROM r WHERE k <= 24 GROUP BY node"""


@query(BOTH_SQL)
def neighbours_both(spark: SparkSession, sf: str) -> DataFrame:
    from .queries import edges

    return graph.neighbours(edges(spark, sf)).select("node", F.array_join("both", ",").alias("neighbours"))


# ---- search entry


@query("""SELECT conv_id, turn, CASE WHEN length(q) > 600 THEN 'query_too_long' WHEN q = '' THEN 'overview' ELSE 'ok' END AS status FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(trim(lower(CASE WHEN turn % 5 = 4 THEN ' ? ' ELSE text END)), '[¿?]', '', 'g'), '\\s+', ' ', 'g') AS q FROM conversations)""")
def query_guard(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, " ? ").otherwise(F.col("text")).alias("query"))
    return search.guard(c, most=600).select("conv_id", "turn", "status")


@query(f"WITH ch AS ({CHUNKS}) SELECT file_path AS path, id, symbol, least(1.0, greatest(0.0, doc_id / 500.0 - 0.2)) AS score, 'vector' AS kind, CAST(NULL AS DOUBLE) AS symbol_boost FROM ch")
def mapped_results(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    found = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") / 500 - 0.2).alias("score"))
    return search.mapped(found, c, "vector").select("path", "meta.id", "meta.symbol", "meta.score", "meta.kind", "meta.symbol_boost")


@query(hybrid_sql(TERMS, QUERY).replace("AS score, round(CAST(rrf", "+ 0.0 AS score, round(CAST(rrf").replace(
    "cut AS (SELECT * FROM f ORDER BY rrf DESC, vrank NULLS LAST, brank NULLS LAST, doc_id LIMIT 10)",
    f"""cut0 AS (SELECT f.doc_id AS doc_id, rrf, vrank, brank, sc.score AS base FROM f JOIN sc ON f.doc_id = sc.doc_id ORDER BY rrf DESC, vrank NULLS LAST, brank NULLS LAST, f.doc_id LIMIT 60),
        sy AS (SELECT doc_id, least(1.0, ((CASE WHEN len(w) > 0 AND contains('{QUERY}', lower(symbol)) THEN 4.0 ELSE 0.0 END) + (CASE WHEN len(w) >= 3 AND contains(' {QUERY}', ' ' || w) THEN 1.0 ELSE 0.0 END)) / 4) AS strength FROM (SELECT doc_id, symbol, lower(symbol) AS w FROM ch)),
        bo AS (SELECT a.doc_id AS doc_id, least(0.45, 0.3 * a.strength + 0.15 * coalesce(b.strength, 0)) AS boost FROM sy a LEFT JOIN sy b ON b.doc_id = a.doc_id + 1),
        cut1 AS (SELECT cut0.*, boost, least(1.0, least(1.0, greatest(0.0, base)) + boost) AS final FROM cut0 JOIN bo ON cut0.doc_id = bo.doc_id),
        cut AS (SELECT * FROM cut1 ORDER BY CASE WHEN (SELECT max(boost) FROM cut1) > 0 THEN final END DESC NULLS LAST, CASE WHEN (SELECT max(boost) FROM cut1) > 0 THEN boost END DESC NULLS LAST, rrf DESC, vrank NULLS LAST, brank NULLS LAST, doc_id LIMIT 10)""",
).replace("round(sc.score, 6) + 0.0 AS score", "round(cut.final, 6) AS score, round(boost, 6) AS symbol_boost").replace("CAST(vrank AS BIGINT)", "CAST(coalesce(vrank, -1) AS BIGINT)").replace("CAST(brank AS BIGINT)", "CAST(coalesce(brank, -1) AS BIGINT)"))
def hybrid_symbol_boost(spark: SparkSession, sf: str) -> DataFrame:
    """The symbol map: each document's first name; its neighbour is the next document."""
    c = chunks(spark, sf)
    ids = c.select("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("sha"), "symbol")
    symbols = codemap.normalized(ids.select(F.col("doc_id").cast("string").alias("chunk_id"), "sha", "symbol", F.array(F.concat(F.lit("k"), (F.col("doc_id") + 1).cast("string"))).alias("symbol_neighbors")))
    found = search.hybrid(searchable(spark, sf), vectors(spark, sf), TERMS, QUERY, query_vector(spark, sf), symbols=symbols, index=keyword_index(spark, sf, True))
    place = lambda c: F.coalesce(c, F.lit(-1).cast("long")).alias(c)
    return found.select("doc_id", "score", F.round("symbol_boost", 6).alias("symbol_boost"), "rrf", place("vrank"), place("brank"))


@query(r"""SELECT p_partkey, '<chunk path="' || replace(p_name, ' ', '_') || '.ts" symbol="&quot;' || p_brand || '&lt;" lang="ts" relevance="' || printf('%.1f', p_size / 50.0 * 100) || '%">' || chr(10) || 'description=' || p_type || chr(10) || '```ts' || chr(10)
    || CASE WHEN p_partkey % 4 = 0 THEN '[code not available]' ELSE 'SYSTEM (untrusted): ' || p_type || '&gt;' END || chr(10) || '```' || chr(10) || '</chunk>' AS section FROM part""")
def prompt_sections(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    rows = p.select(
        "p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".ts")).alias("path"), F.concat(F.lit('"'), "p_brand", F.lit("<")).alias("symbol"), F.lit("ts").alias("lang"), (F.col("p_size") / 50).alias("score"),
        F.col("p_type").alias("description"), F.lit("").alias("intent"), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("system: "), "p_type", F.lit(">"))).alias("code"),
    )
    return answer.sections(rows).select("p_partkey", "section")


# ---- providers and budgets


class Lengths(packs.EmbeddingProvider):
    """A vector of a text's length and its share of vowels; fails on batches that hold an empty text."""

    name, dims = "lengths", 2

    def embed(self, texts: list[str]) -> list[list[float]]:
        if len(texts) > 1 and not all(texts):
            raise ValueError("empty text")
        return [[float(len(t)), float(sum(t.count(v) for v in "aeiou"))] for t in texts]


@query("SELECT conv_id, turn, CAST(length(t) AS DOUBLE) AS x, CAST(length(t) - length(regexp_replace(t, '[aeiou]', '', 'g')) AS DOUBLE) AS y FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS t FROM conversations)")
def embed_batches(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("text")).alias("code"))
    return packs.embed(c, Lengths(), batch=7).select("conv_id", "turn", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, least(length(text), 4000) AS n FROM conversations),
    r AS (SELECT conv_id, k, n AS total, 0 AS batch FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.k, CASE WHEN r.total + t.n > 4000 THEN t.n ELSE r.total + t.n END, r.batch + CASE WHEN r.total + t.n > 4000 THEN 1 ELSE 0 END FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1)
    SELECT conv_id, CAST(batch AS BIGINT) AS batch, count(*) AS n FROM r GROUP BY conv_id, batch""")
def batch_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's turns, cut to 4000 characters, in batches of at most 4000."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    size = F.least(F.length("text"), F.lit(4000))
    return chunking.batches(turns, "conv_id", ["turn", "role", "text"], size, 4000).groupBy("conv_id", "batch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens, round(100.0 * sum(CASE WHEN octet_length(encode(text)) <= 800 THEN 1 ELSE 0 END) / count(*), 1) AS uncounted FROM documents GROUP BY lang")
def token_statistics(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"), F.round(100.0 * F.count_if(F.octet_length("text") <= 800) / F.count(F.lit(1)), 1).alias("uncounted"))


@query()
def chunking_statistics(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks(spark, sf).select(F.col("file_path").alias("path"), F.lit("markdown").alias("lang"), F.col("text").alias("content"))
    return chunking.chunk_statistics(rows, LIMITS)
