"""Queries of the record store's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palimpsest.functions import json_text, text
from palimpsest.operators import feedback as fb
from palimpsest.operators import filters, fusion, graph, lexical, models, mutate, paging, postings, segments, shape, snapshot, temporal, vectors
from palimpsest.plans import search
from palimpsest.plans.problems import json_nodes
from palimpsest.sources.tables import read

NOW, AT = "2024-06-30 00:00:00", "2023-09-01 00:00:00"
QUERY = "retention plan allergy-notice Šaldytuvo"
us = F.unix_micros


# -- tables, redelivered rows once ----------------------------------------------------------

def revisions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    df = read(spark, d, "memory_revisions")
    return (df.select("id", *columns) if columns else df).dropDuplicates(["id"])


def delivered(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Revisions as delivered. Redelivered rows are equal in every column: filters go first, and
    what picks one row per key needs no other removal of repeats."""
    df = read(spark, d, "memory_revisions")
    return df.select("id", *columns) if columns else df


def once(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["id"])


def memories(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "memories").dropDuplicates(["id"])


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "memory_state_events").dropDuplicates(["id"])


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """Feedback rows from the event stream."""
    e = read(spark, d, "events")
    content = F.create_map(*[F.lit(x) for x in ("purchase", "verified", "signup", "correct", "error", "incorrect")])
    retrieval = F.create_map(*[F.lit(x) for x in ("click", "relevant", "view", "irrelevant")])
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("revision_id"), F.when(F.col("event_type").isin("click", "view"), "retrieval").otherwise("content").alias("scope"),
        F.coalesce(F.try_element_at(content, F.col("event_type")), F.try_element_at(retrieval, F.col("event_type"))).alias("signal"), F.col("ts").alias("created_at"),
    )


def links(spark: SparkSession, d: str) -> DataFrame:
    """Supplier-part links from the line items."""
    li = read(spark, d, "lineitem")
    src, dst = F.concat(F.lit("S"), F.col("l_suppkey")), F.concat(F.lit("P"), F.col("l_partkey"))
    grouped = li.groupBy(src.alias("src"), dst.alias("dst"), F.col("l_returnflag").alias("relation")).agg(F.min("l_shipdate").alias("created_at"), F.max("l_shipdate").alias("m"))
    return grouped.select(
        F.concat_ws("-", "src", "dst", "relation").alias("link_id"), "src", "dst", "relation", "created_at",
        F.when(F.col("relation") == "R", F.col("m") + F.expr("INTERVAL 400 DAYS")).alias("deleted_at"),
        F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
    )


def redirects(spark: SparkSession, d: str) -> DataFrame:
    """Each copy of a text redirects to the copy before it."""
    doc = read(spark, d, "documents").select("doc_id", F.md5("text").alias("h")).dropDuplicates(["doc_id"])
    before = F.lag("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))
    return doc.withColumn("before", before).filter("before IS NOT NULL").select(
        F.concat(F.lit("r"), F.col("doc_id")).alias("id"), F.col("doc_id").cast("string").alias("source_memory_id"), F.col("before").cast("string").alias("canonical_memory_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("created_at"), F.lit(True).alias("direct"),
    )


_REV = "rev AS (SELECT DISTINCT ON (id) * FROM memory_revisions)"
_MEM = "mem AS (SELECT DISTINCT ON (id) * FROM memories)"
_ST = "st AS (SELECT DISTINCT ON (id) * FROM memory_state_events)"
_FB = """fb AS (SELECT event_id AS id, user_id AS revision_id, CASE WHEN event_type IN ('click','view') THEN 'retrieval' ELSE 'content' END AS scope,
  CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'signup' THEN 'correct' WHEN 'error' THEN 'incorrect' WHEN 'click' THEN 'relevant' WHEN 'view' THEN 'irrelevant' END AS signal,
  ts AS created_at FROM events)"""
_LINKS = """links AS (SELECT concat_ws('-', src, dst, relation) AS link_id, src, dst, relation, created_at, CASE WHEN relation = 'R' THEN m + INTERVAL 400 DAY END AS deleted_at
  FROM (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, l_returnflag AS relation, min(l_shipdate) AS created_at, max(l_shipdate) AS m FROM lineitem GROUP BY ALL))"""
_RED = """red AS (SELECT 'r' || doc_id AS id, doc_id::VARCHAR AS source_memory_id, before::VARCHAR AS canonical_memory_id, 1700000000 + doc_id AS created_s
  FROM (SELECT doc_id, lag(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS before FROM (SELECT DISTINCT doc_id, text FROM documents)) WHERE before IS NOT NULL)"""
_HEADS = "heads AS (SELECT * FROM rev QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY revision_number DESC, id DESC) = 1)"
_STATES = "states AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY event_number DESC, id DESC) = 1)"


def _ts(value: str) -> str:
    return f"TIMESTAMPTZ '{value}+00'"


_REV_AT = f"rev_at AS (SELECT * FROM rev WHERE recorded_at <= {_ts(AT)} QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY revision_number DESC, id DESC) = 1)"
_ST_AT = f"st_at AS (SELECT * FROM st WHERE recorded_at <= {_ts(AT)} QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY recorded_at DESC, event_number DESC, id DESC) = 1)"
_VALID = f"(valid_from IS NULL OR valid_from <= {_ts(NOW)}) AND (valid_to IS NULL OR valid_to > {_ts(NOW)})"
_ELIGIBLE = f"""eligible AS (SELECT * FROM heads WHERE (expires_at IS NULL OR expires_at > {_ts(NOW)}) AND {_VALID}
  AND memory_id IN (SELECT memory_id FROM states WHERE state = 'active') AND space_id IN (SELECT id FROM spaces WHERE deleted_at IS NULL))"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


# -- scans and lookups ------------------------------------------------------------------------

@query("SELECT id, memory_id, revision_number, confidence, salience FROM memory_revisions WHERE confidence >= 0.5")
def scan_project(spark, d):
    return read(spark, d, "memory_revisions").filter(F.col("confidence") >= 0.5).select("id", "memory_id", "revision_number", "confidence", "salience")


@query(f"WITH {_MEM} SELECT id, space_id, state FROM mem WHERE id = (SELECT max(id) FROM memories)")
def key_lookup(spark, d):
    wanted = read(spark, d, "memories").agg(F.max("id")).first()[0]
    return once(read(spark, d, "memories").filter(F.col("id") == wanted).select("id", "space_id", "state"))


@query(f"WITH {_MEM}, k AS (SELECT logical_key FROM mem WHERE logical_key IS NOT NULL ORDER BY logical_key LIMIT 1) SELECT id, space_id, logical_key FROM mem WHERE logical_key = (SELECT logical_key FROM k)")
def logical_key_lookup(spark, d):
    first = read(spark, d, "memories").agg(F.min("logical_key")).first()[0]
    wanted = filters.literal(f"  {first} ")
    return once(read(spark, d, "memories").filter(F.col("logical_key") == wanted).select("id", "space_id", "logical_key"))


@query("""SELECT id, name, CASE WHEN lower(id) = 'ops' THEN 0 WHEN lower(name) = 'ops' THEN 1 WHEN starts_with(lower(id), 'ops') THEN 2 WHEN starts_with(lower(name), 'ops') THEN 3 ELSE 4 END AS match_rank
FROM spaces WHERE deleted_at IS NULL AND (starts_with(lower(id), 'ops') OR starts_with(lower(name), 'ops') OR
 len(list_filter(regexp_extract_all(lower(name || ' ' || coalesce(description, '')), '[\\p{L}\\p{N}]+'), lambda x: starts_with(x, 'ops'))) > 0)
ORDER BY match_rank, lower(name), id LIMIT 21""")
def space_search_rank(spark, d):
    q = "ops"
    s = read(spark, d, "spaces").filter(F.col("deleted_at").isNull())
    found = lexical.all_prefixes(text.tokens(F.concat_ws(" ", "name", "description")), lexical.prefix_terms(q))
    rank = (
        F.when(filters.nocase_equal("id", q), 0).when(filters.nocase_equal("name", q), 1).when(filters.prefix_nocase("id", q), 2)
        .when(filters.prefix_nocase("name", q), 3).when(found, 4)
    )
    ranked = s.withColumn("match_rank", rank).filter("match_rank IS NOT NULL").withColumn("lower_name", F.lower("name"))
    return paging.page(ranked, [("match_rank", True), ("lower_name", True), ("id", True)], 20).select("id", "name", "match_rank")


# -- record time and valid time ------------------------------------------------------------------

@query(f"WITH {_REV}, {_ST}, {_HEADS}, {_STATES} SELECT h.memory_id, h.id AS revision_id, h.revision_number, s.state, greatest(epoch_us(h.recorded_at), epoch_us(s.recorded_at)) AS updated_us FROM heads h JOIN states s USING (memory_id)")
def current_head(spark, d):
    h = temporal.revisions_as_of(delivered(spark, d, "memory_id", "revision_number", "recorded_at"))
    s = temporal.states_as_of(read(spark, d, "memory_state_events")).select("memory_id", "state", F.col("recorded_at").alias("state_at"))
    return h.join(s, "memory_id").select("memory_id", F.col("id").alias("revision_id"), "revision_number", "state", us(F.greatest("recorded_at", "state_at")).alias("updated_us"))


@query(f"WITH {_REV}, {_REV_AT} SELECT memory_id, id AS revision_id, revision_number FROM rev_at")
def asof_revision(spark, d):
    return temporal.revisions_as_of(delivered(spark, d, "memory_id", "revision_number", "recorded_at"), AT).select("memory_id", F.col("id").alias("revision_id"), "revision_number")


@query(f"WITH {_ST}, {_ST_AT} SELECT memory_id, state, event_number FROM st_at")
def asof_state(spark, d):
    return temporal.states_as_of(read(spark, d, "memory_state_events"), AT).select("memory_id", "state", "event_number")


@query(f"WITH {_REV}, {_ST}, {_REV_AT}, {_ST_AT} SELECT r.memory_id, r.id AS revision_id, s.state, r.title, r.kind FROM rev_at r JOIN st_at s USING (memory_id)")
def asof_get(spark, d):
    r = temporal.revisions_as_of(delivered(spark, d, "memory_id", "revision_number", "recorded_at", "title", "kind"), AT)
    s = temporal.states_as_of(read(spark, d, "memory_state_events"), AT).select("memory_id", "state")
    return r.join(s, "memory_id").select("memory_id", F.col("id").alias("revision_id"), "state", "title", "kind")


@query(f"WITH {_REV} SELECT id FROM rev WHERE {_VALID}")
def valid_at(spark, d):
    return once(delivered(spark, d, "valid_from", "valid_to").filter(temporal.valid_at(NOW)).select("id"))


@query(f"WITH {_REV} SELECT id, CASE WHEN review_after <= {_ts(NOW)} THEN TRUE ELSE FALSE END AS review_due FROM rev WHERE expires_at IS NULL OR expires_at > {_ts(NOW)}")
def expiry_filter(spark, d):
    kept = once(delivered(spark, d, "expires_at", "review_after").filter(temporal.unexpired(NOW)))
    return kept.select("id", F.coalesce(F.col("review_after") <= temporal.instant(NOW), F.lit(False)).alias("review_due"))


def _eligible(spark, d, **more):
    return filters.candidates(delivered(spark, d), read(spark, d, "memory_state_events"), read(spark, d, "spaces"), filters.Candidates(now=NOW, **more))


@query(f"WITH {_REV}, {_ST}, {_HEADS}, {_STATES}, {_ELIGIBLE} SELECT id, memory_id, space_id FROM eligible")
def candidate_filter(spark, d):
    return _eligible(spark, d).select("id", "memory_id", "space_id")


@query(f"""WITH {_REV}, {_ST}, {_REV_AT}, {_ST_AT} SELECT id, memory_id FROM rev_at WHERE (expires_at IS NULL OR expires_at > {_ts(AT)})
AND memory_id IN (SELECT memory_id FROM st_at WHERE state IN ('active', 'archived')) AND space_id IN (SELECT id FROM spaces WHERE deleted_at IS NULL)""")
def candidate_filter_asof(spark, d):
    return _eligible(spark, d, at_time=AT, states=["active", "archived"]).select("id", "memory_id")


@query(f"WITH {_REV}, {_HEADS} SELECT id FROM heads WHERE kind IN ('decision', 'incident') AND confidence >= 0.5 AND salience >= 0.25")
def kind_score_filter(spark, d):
    every = filters.Candidates(now=NOW, kinds=["decision", "incident"], min_confidence=0.5, min_salience=0.25)
    h = temporal.revisions_as_of(delivered(spark, d, "memory_id", "revision_number", "kind", "confidence", "salience"))
    return h.filter(filters.scored(every)).select("id")


_TAGS = "list_sort(list_distinct(list_filter(list_transform(tags, lambda t: lower(trim(t, ' '))), lambda t: t IS NOT NULL AND t <> '')))"


@query(f"WITH {_REV} SELECT id FROM rev WHERE len(list_intersect({_TAGS}, ['operations', 'preference'])) = 2")
def tag_all_filter(spark, d):
    return once(delivered(spark, d, "tags").filter(filters.all_tags("tags", [" Operations", "preference", ""])).select("id"))


@query(f"WITH {_REV} SELECT id, array_to_string({_TAGS}, ',') AS tags FROM rev WHERE tags IS NOT NULL")
def tag_normalise(spark, d):
    return revisions(spark, d, "tags").filter("tags IS NOT NULL").select("id", F.array_join(filters.normalise_tags("tags"), ",").alias("tags"))


@query(f"WITH {_REV} SELECT id FROM rev WHERE translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = (SELECT translate(min(title), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM memory_revisions)")
def title_nocase(spark, d):
    wanted = read(spark, d, "memory_revisions").agg(F.min("title")).first()[0] or ""
    return once(delivered(spark, d, "title").filter(filters.nocase_equal("title", wanted.swapcase() if wanted.isascii() else wanted)).select("id"))


@query("""WITH g(principal, space_id, level) AS (VALUES ('reader', '*', 1), ('reader', 'field-ops', 0), ('reader', 'default', 2), ('other', '*', 3)), m AS (SELECT DISTINCT ON (id) * FROM memories)
SELECT m.id, m.space_id FROM m LEFT JOIN g ON g.principal = 'reader' AND g.space_id = m.space_id WHERE coalesce(g.level, 1) >= 1""")
def grants_filter(spark, d):
    grants = spark.createDataFrame([("reader", "*", 1), ("reader", "field-ops", 0), ("reader", "default", 2), ("other", "*", 3)], "principal string, space_id string, level int")
    return filters.readable(memories(spark, d), grants, "reader", 1).select("id", "space_id")


# -- listing and pages ---------------------------------------------------------------------------

_LISTED = "SELECT m.id, epoch_us(m.updated_at) AS updated_us, r.title FROM mem m JOIN rev r ON r.id = m.current_revision_id WHERE m.state = 'active'"


def _listed(spark, d):
    m = once(read(spark, d, "memories").filter("state = 'active'").select("id", "current_revision_id", us("updated_at").alias("updated_us")))
    return once(m.join(delivered(spark, d, "title").withColumnRenamed("id", "current_revision_id"), "current_revision_id").select("id", "updated_us", "title"))


@query(f"WITH {_MEM}, {_REV} {_LISTED} ORDER BY updated_us DESC, id DESC LIMIT 51")
def list_active(spark, d):
    return paging.page(_listed(spark, d), [("updated_us", False), ("id", False)], 50)


@query(f"WITH {_MEM}, {_REV}, l AS ({_LISTED}), c AS (SELECT * FROM l ORDER BY updated_us DESC, id DESC LIMIT 1 OFFSET 49) SELECT l.* FROM l, c WHERE l.updated_us < c.updated_us OR (l.updated_us = c.updated_us AND l.id < c.id) ORDER BY l.updated_us DESC, l.id DESC LIMIT 51")
def keyset_page2(spark, d):
    keys = [("updated_us", False), ("id", False)]
    first = paging.page(_listed(spark, d), keys, 50).collect()[:50]
    cursor = paging.encode([first[-1]["updated_us"], first[-1]["id"]], {"state": "active"})
    return paging.page(_listed(spark, d), keys, 50, paging.decode(cursor, {"state": "active"}))


@query(f"WITH {_REV}, w AS (SELECT memory_id FROM rev GROUP BY 1 ORDER BY count(*) DESC, memory_id LIMIT 1) SELECT id, revision_number, kind FROM rev WHERE memory_id = (SELECT memory_id FROM w) ORDER BY revision_number DESC, id DESC LIMIT 21")
def history_page(spark, d):
    r = revisions(spark, d, "memory_id", "revision_number", "kind")
    longest = r.groupBy("memory_id").count().orderBy(F.desc("count"), "memory_id").limit(1).select("memory_id")
    own = r.join(F.broadcast(longest), "memory_id", "left_semi").select("id", "revision_number", "kind")
    return paging.page(own, [("revision_number", False), ("id", False)], 20)


# -- feedback ------------------------------------------------------------------------------------

_SUMMARY = """summary AS (SELECT revision_id, count(*) FILTER (scope = 'content') AS content_count, count(*) FILTER (scope = 'retrieval') AS retrieval_count,
  arg_max(signal, {'c': created_at, 'i': id}) FILTER (scope = 'content') AS latest_content, arg_max(signal, {'c': created_at, 'i': id}) FILTER (scope = 'retrieval') AS latest_retrieval
  FROM fb WHERE signal IS NOT NULL GROUP BY revision_id)"""
_STATUS = "CASE WHEN latest_content IS NULL THEN 'unreviewed' WHEN latest_content = 'verified' THEN 'verified' WHEN latest_content = 'correct' THEN 'supported' ELSE 'needs-review' END"


@query(f"WITH {_FB}, {_SUMMARY} SELECT *, {_STATUS} AS status FROM summary")
def feedback_summary(spark, d):
    return fb.summary(feedback(spark, d))


@query(f"WITH {_FB}, {_SUMMARY} SELECT c_custkey FROM customer LEFT JOIN summary ON revision_id = c_custkey WHERE {_STATUS} = 'needs-review'")
def feedback_status_filter(spark, d):
    c = read(spark, d, "customer").select("c_custkey")
    return fb.with_status(c, feedback(spark, d), "needs-review", "c_custkey")


@query(f"WITH {_FB} SELECT id, revision_id, scope, signal FROM fb WHERE scope = 'content' AND created_at <= TIMESTAMP '2024-01-15' ORDER BY created_at DESC, id DESC LIMIT 21")
def feedback_page(spark, d):
    seen = fb.listed(feedback(spark, d), scope="content", at="2024-01-15 00:00:00")
    return paging.page(seen, [("created_at", False), ("id", False)], 20).select("id", "revision_id", "scope", "signal")


# -- identity ------------------------------------------------------------------------------------

@query(f"WITH {_RED} SELECT source_memory_id, canonical_memory_id FROM red")
def latest_redirect(spark, d):
    return graph.latest_redirects(redirects(spark, d)).select("source_memory_id", "canonical_memory_id")


@query("""WITH docs AS (SELECT DISTINCT doc_id, text FROM documents), r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) - 1 AS hops FROM docs)
SELECT doc_id::VARCHAR AS memory_id, first::VARCHAR AS canonical_id, hops::INTEGER AS hops FROM r WHERE doc_id > first""")
def canonical_resolve(spark, d):
    return graph.resolve_canonical(redirects(spark, d))


@query(f"WITH {_RED} SELECT canonical_memory_id AS memory_id, count(*) AS merged_count FROM red GROUP BY 1")
def merged_count(spark, d):
    return graph.merged_counts(redirects(spark, d))


# -- status --------------------------------------------------------------------------------------

@query(f"""WITH {_MEM} SELECT space_id, count(*) AS total, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'archived') AS archived, count(*) FILTER (state = 'deleted') AS deleted,
count(*) FILTER (index_status = 'pending') AS pending, count(*) FILTER (index_status = 'ready') AS ready, count(*) FILTER (index_status = 'lexical-only') AS lexical_only, count(*) FILTER (index_status = 'failed') AS failed,
count(logical_key) AS logical_keys FROM mem GROUP BY space_id""")
def status_counts(spark, d):
    return snapshot.status(memories(spark, d))


@query(f"""WITH {_REV}, {_ST} SELECT (SELECT count(*) FROM spaces) AS spaces, (SELECT count(*) FROM rev) AS revisions, (SELECT count(DISTINCT memory_id) FROM rev) AS revised_memories,
(SELECT count(*) FROM st) AS state_events, (SELECT count(DISTINCT segment_id) FROM memory_vectors) AS segments, (SELECT count(DISTINCT model_profile_id) FROM memory_vectors) AS profiles""")
def scalar_counts(spark, d):
    r = read(spark, d, "memory_revisions").agg(F.count_distinct("id").alias("revisions"), F.count_distinct("memory_id").alias("revised_memories"))
    v = read(spark, d, "memory_vectors").agg(F.count_distinct("segment_id").alias("segments"), F.count_distinct("model_profile_id").alias("profiles"))
    one = lambda df: df.scalar()
    e = read(spark, d, "memory_state_events").agg(F.count_distinct("id").alias("state_events"))
    s = read(spark, d, "spaces").agg(F.count(F.lit(1)).alias("spaces"))
    return r.select("revisions", "revised_memories", one(e).alias("state_events"), one(s).alias("spaces"), one(v.select("segments")).alias("segments"), one(v.select("profiles")).alias("profiles"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_percentiles(spark, d):
    e = read(spark, d, "events").filter("value IS NOT NULL")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


# -- text ----------------------------------------------------------------------------------------

_M, _P = text.accent_pairs()


def _sql_tokens(column: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({column}, '')), '{_M}', '{_P}'), '[\\p{{L}}\\p{{N}}]+')"


@query(f"WITH {_REV} SELECT id, len({_sql_tokens('searchable_text')})::INTEGER AS n_tokens, md5(array_to_string({_sql_tokens('title')}, ' ')) AS title_tokens FROM rev")
def tokenise(spark, d):
    r = revisions(spark, d, "title", "searchable_text")
    return r.select("id", F.size(text.tokens("searchable_text")).alias("n_tokens"), F.md5(F.array_join(text.tokens("title"), " ")).alias("title_tokens"))


@query("SELECT doc_id, greatest(1, ceil(length(text) / 4.0))::INTEGER AS token_estimate, sha256(text) AS content_hash FROM (SELECT DISTINCT ON (doc_id) * FROM documents) WHERE text IS NOT NULL")
def text_measures(spark, d):
    doc = read(spark, d, "documents").filter("text IS NOT NULL").dropDuplicates(["doc_id"])
    return doc.select("doc_id", text.estimate_tokens("text").alias("token_estimate"), F.sha2("text", 256).alias("content_hash"))


@query(f"""WITH {_REV} SELECT id, concat_ws(chr(10), 'Title: ' || title, 'Kind: ' || kind, CASE WHEN len({_TAGS}) > 0 THEN 'Tags: ' || array_to_string({_TAGS}, ', ') END) AS header FROM rev""")
def projection_header(spark, d):
    r = revisions(spark, d, "title", "kind", "tags").withColumn("tags", filters.normalise_tags("tags"))
    return r.select("id", text.header("title", "kind", "tags").alias("header"))


_LEAVES = json_nodes("SELECT 't' AS t, 'f' AS f, id, content_json AS x FROM (SELECT DISTINCT ON (id) * FROM memory_revisions)")


@query(f"WITH RECURSIVE {_LEAVES} SELECT id AS record_id, path, CASE WHEN json_type(v) = 'VARCHAR' THEN v ->> '$' ELSE v::VARCHAR END AS text FROM node WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY')")
def json_flatten(spark, d):
    return json_text.flatten(revisions(spark, d, "content_json"), "id", "content_json").drop("position")


@query()
def canonical_hash(spark, d):
    return json_text.canonical_hash(revisions(spark, d, "content_json"), "id", "content_json")


@query()
def chunk_documents(spark, d):
    return segments.build(read(spark, d, "documents").dropDuplicates(["doc_id"]), "doc_id", "text")


@query()
def chunk_revisions(spark, d):
    r = revisions(spark, d, "title", "kind", "tags", "searchable_text").withColumn("tags", filters.normalise_tags("tags"))
    return segments.build(r.withColumn("head", text.header("title", "kind", "tags")), "id", "searchable_text", "head")


# -- retrieval -----------------------------------------------------------------------------------

_indexes: dict[tuple[str, str], postings.Index] = {}


def index_of(spark: SparkSession, d: str) -> postings.Index:
    """The inverted index of the revisions in ``d``, built when a session first asks for it."""
    return kept_index(spark, d, lambda: postings.build(search.corpus(delivered(spark, d)), list(search.WEIGHTS)))


def unit_index(spark: SparkSession, d: str, units) -> postings.Index:
    """The index of the lines or segments of all revisions."""
    return kept_index(spark, f"{d} {units.__name__}", lambda: postings.build(units(delivered(spark, d, "searchable_text")), ["text"], "unit"))


def kept_index(spark: SparkSession, name: str, build) -> postings.Index:
    """The session's index of that name, built again where its files are gone."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _indexes or not postings.exists(_indexes[key]):
        _indexes[key] = build()
    return _indexes[key]


_WEIGHTS = {"title": 2.0, "searchable_text": 1.0, "tag_text": 0.5}


def _sql_bm25(query_text: str) -> str:
    """CTEs ending in ``scored(id, memory_id, score)``."""
    phrases = lexical.query_phrases(query_text)
    columns = list(_WEIGHTS)
    toks = ", ".join(f"{_sql_tokens(c)} AS t{i}" for i, c in enumerate(columns))
    hits = []
    for p, phrase in enumerate(phrases):
        for i in range(len(columns)):
            if len(phrase) == 1:
                hits.append(f"len(list_filter(t{i}, lambda x: x = '{phrase[0]}')) AS h{p}_{i}")
            else:
                test = " AND ".join(f"t{i}[i{'+' + str(j) if j else ''}] = '{w}'" for j, w in enumerate(phrase))
                hits.append(f"len(list_filter(range(1, len(t{i}) + 1), lambda i: {test})) AS h{p}_{i}")
    tf = [" + ".join(f"{w} * h{p}_{i}" for i, w in enumerate(_WEIGHTS.values())) for p in range(len(phrases))]
    counts = ", ".join(f"count(*) FILTER (({t}) > 0) AS n{p}" for p, t in enumerate(tf))
    terms = " + ".join(
        f"greatest(ln((rows - n{p} + 0.5) / (n{p} + 0.5)), 1e-6) * ({t}) * 2.2 / (({t}) + 1.2 * (0.25 + 0.75 * dlen / mean))" for p, t in enumerate(tf)
    )
    return f"""idx AS (SELECT id, memory_id, title, searchable_text, array_to_string(tags, ' ') AS tag_text FROM rev), tok AS (SELECT id, memory_id, {toks} FROM idx),
h AS (SELECT id, memory_id, len(t0) + len(t1) + len(t2) AS dlen, {', '.join(hits)} FROM tok), stat AS (SELECT count(*) AS rows, avg(dlen) AS mean, {counts} FROM h),
scored AS (SELECT id, memory_id, {terms} AS score FROM h, stat WHERE {' OR '.join(f'({t}) > 0' for t in tf)})"""


@query(f"WITH {_REV}, {_sql_bm25(QUERY)} SELECT rows, round(mean, 6) AS mean FROM stat")
def index_statistics(spark, d):
    """Builds the index, if the session has none of this folder yet, and shows what it counts."""
    return index_of(spark, d).statistics.select("rows", F.round("mean", 6).alias("mean"))


@query(f"WITH {_REV}, {_sql_bm25(QUERY)} SELECT id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 100")
def bm25_topk(spark, d):
    scored = postings.search(index_of(spark, d), list(search.WEIGHTS.values()), QUERY)
    return lexical.top(scored, 100, "id").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_REV}, {_ST}, {_HEADS}, {_STATES}, {_ELIGIBLE}, {_sql_bm25(QUERY)} SELECT id, round(score, 6) AS score FROM scored WHERE id IN (SELECT id FROM eligible) ORDER BY scored.score DESC, id LIMIT 100")
def bm25_filtered(spark, d):
    scored = postings.search(index_of(spark, d), list(search.WEIGHTS.values()), QUERY).join(_eligible(spark, d).select("id"), "id", "left_semi")
    return lexical.top(scored, 100, "id").select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {_REV}, {_MEM}, {_HEADS}, q AS (SELECT trim(min(title)) AS q FROM heads), b AS (
SELECT id, recorded_at, 0 AS rank_value FROM heads WHERE memory_id IN (SELECT id FROM mem, q WHERE logical_key = q.q)
UNION ALL SELECT id, recorded_at, 1 FROM heads, q WHERE memory_id = q.q OR id = q.q
UNION ALL SELECT id, recorded_at, 2 FROM heads, q WHERE translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = translate(q.q, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
SELECT id, min(rank_value) AS rank_value FROM b GROUP BY id, recorded_at ORDER BY min(rank_value), recorded_at DESC, id LIMIT 10""")
def exact_candidates(spark, d):
    heads = temporal.revisions_as_of(revisions(spark, d, "memory_id", "revision_number", "recorded_at", "title"))
    wanted = heads.agg(F.min("title")).first()[0] or "none"
    return lexical.exact(heads, memories(spark, d), wanted, 10).select("id", "rank_value")


def _vectors(spark, d):
    return read(spark, d, "memory_vectors").filter(F.size("embedding") == 64).dropDuplicates(["segment_id"])


def _query_vector(spark, d):
    """The first segment's vector, as a stand-in for an embedded query."""
    row = _vectors(spark, d).orderBy("segment_id").select("model_profile_id", "embedding").first()
    return row["model_profile_id"], row["embedding"]


_VEC = """vec AS (SELECT DISTINCT ON (segment_id) * FROM memory_vectors WHERE len(embedding) = 64), qv AS (SELECT * FROM vec ORDER BY segment_id LIMIT 1),
dist AS (SELECT v.segment_id, split_part(v.segment_id, ':', 1) AS id, sqrt(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))) AS distance
 FROM vec v, qv q WHERE v.model_profile_id = q.model_profile_id)"""


@query(f"WITH {_VEC} SELECT segment_id, round(distance, 6) AS distance FROM dist WHERE distance IS NOT NULL AND NOT isnan(distance) ORDER BY dist.distance, segment_id LIMIT 100")
def l2_topk(spark, d):
    profile, vector = _query_vector(spark, d)
    near = vectors.nearest(_vectors(spark, d).filter(F.col("model_profile_id") == profile), "embedding", vector, 100, "segment_id")
    return near.select("segment_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_REV}, {_ST}, {_HEADS}, {_STATES}, {_ELIGIBLE}, {_VEC} SELECT segment_id, round(distance, 6) AS distance FROM dist WHERE distance IS NOT NULL AND NOT isnan(distance) AND id IN (SELECT id FROM eligible) ORDER BY dist.distance, segment_id LIMIT 100")
def l2_topk_filtered(spark, d):
    profile, vector = _query_vector(spark, d)
    rows = _vectors(spark, d).filter(F.col("model_profile_id") == profile).withColumn("id", F.substring_index("segment_id", ":", 1))
    near = vectors.nearest(rows.join(_eligible(spark, d).select("id"), "id", "left_semi"), "embedding", vector, 100, "segment_id")
    return near.select("segment_id", F.round("distance", 6).alias("distance"))


_FUSED = f"""WITH {_REV}, {_ST}, {_HEADS}, {_STATES}, {_ELIGIBLE}, {_sql_bm25(QUERY)}, {_VEC},
lex AS (SELECT memory_id, 1 AS channel, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM scored WHERE id IN (SELECT id FROM eligible) ORDER BY score DESC, id LIMIT 100)),
near AS (SELECT e.memory_id, segment_id, distance FROM dist JOIN eligible e USING (id) WHERE distance IS NOT NULL AND NOT isnan(distance) ORDER BY distance, segment_id LIMIT 100),
firsts AS (SELECT memory_id, min(n) AS n FROM (SELECT memory_id, row_number() OVER (ORDER BY distance, segment_id) AS n FROM near) GROUP BY 1),
sem AS (SELECT memory_id, 2 AS channel, row_number() OVER (ORDER BY n) AS rank FROM firsts),
fused AS (SELECT memory_id, sum(1.0 / (60 + rank)) AS fused, min(rank) FILTER (channel = 1) AS lexical_rank, min(rank) FILTER (channel = 2) AS semantic_rank, min(channel * 1000 + rank) AS seen
 FROM (SELECT * FROM lex UNION ALL SELECT * FROM sem) GROUP BY memory_id)"""


def _tables(spark, d):
    return search.Tables(memories(spark, d), delivered(spark, d), read(spark, d, "memory_state_events"), read(spark, d, "spaces"), _vectors(spark, d), index_of(spark, d))


def _fused(spark, d):
    profile, vector = _query_vector(spark, d)
    return fusion.fuse(*search.channels(_tables(spark, d), filters.Candidates(now=NOW), QUERY, vector, profile, 100))


@query(f"{_FUSED} SELECT memory_id, round(fused, 9) AS fused, lexical_rank::INTEGER AS lexical_rank, semantic_rank::INTEGER AS semantic_rank FROM fused ORDER BY fused.fused DESC, seen LIMIT 50")
def rrf_hybrid(spark, d):
    best = _fused(spark, d).orderBy(*fusion.order()).limit(50)
    return best.select("memory_id", F.round("fused", 9).alias("fused"), "lexical_rank", "semantic_rank")


@query(f"""{_FUSED}, q AS (SELECT lower(min(title)) AS q FROM eligible WHERE memory_id IN (SELECT memory_id FROM fused)), b AS (SELECT f.memory_id, f.seen, f.fused + CASE WHEN lower(e.title) = q.q THEN 0.04 WHEN contains(lower(e.title), q.q) THEN 0.02 ELSE 0 END AS fused
 FROM fused f JOIN eligible e USING (memory_id), q) SELECT memory_id, round(fused, 9) AS fused FROM b ORDER BY b.fused DESC, seen LIMIT 5""")
def title_boost(spark, d):
    fused = _fused(spark, d).join(_eligible(spark, d).select("memory_id", "title"), "memory_id")
    wanted = fused.agg(F.min("title")).first()[0] or "none"
    best = fusion.title_boost(fused, wanted).orderBy(*fusion.order()).limit(5)
    return best.select("memory_id", F.round("fused", 9).alias("fused"))


@query(f"""{_FUSED}, top AS (SELECT *, row_number() OVER (ORDER BY fused DESC, seen) AS place FROM fused), r AS (SELECT *, (abs(hash_free) % 100) / 100.0 AS reranker FROM (SELECT *, ascii(memory_id) * 7 + place AS hash_free FROM top WHERE place <= 30))
SELECT memory_id, round(fused + 0.05 * reranker, 9) AS fused FROM r ORDER BY fused + 0.05 * reranker DESC, seen LIMIT 10""")
def rerank_fuse(spark, d):
    place = F.row_number().over(Window.partitionBy().orderBy(*fusion.order()))
    top = _fused(spark, d).orderBy(*fusion.order()).limit(30).withColumn("place", place)
    scores = top.select("memory_id", (F.pmod(F.ascii("memory_id") * 7 + F.col("place"), F.lit(100)) / 100.0).alias("reranker"))
    return fusion.rerank(top, scores).orderBy(*fusion.order()).limit(10).select("memory_id", F.round("fused", 9).alias("fused"))


_TOP30 = f"{_FUSED}, top AS (SELECT memory_id, row_number() OVER (ORDER BY fused DESC, seen) AS place FROM fused ORDER BY fused DESC, seen LIMIT 30)"


def _scored30(spark, d, others):
    """The best 30, every seventh an exact hit, with scores as a reranker would give them."""
    place = F.row_number().over(Window.partitionBy().orderBy(*fusion.order()))
    top = _fused(spark, d).orderBy(*fusion.order()).limit(30).withColumn("n", place)
    exact = F.when(F.col("n") % 7 == 0, F.col("n"))
    return top.withColumns({"reranker": F.when(F.col("n") == 1, 0.9).otherwise(others / F.col("n")), "exact_rank": exact}).drop("n")


@query(f"{_TOP30} SELECT memory_id FROM top WHERE place = 1 OR place % 7 = 0")
def decisive_prune(spark, d):
    return fusion.prune_decisive(_scored30(spark, d, 0.03)).select("memory_id")


@query(f"{_TOP30} SELECT memory_id FROM top")
def indecisive_prune(spark, d):
    return fusion.prune_decisive(_scored30(spark, d, 0.04)).select("memory_id")


@query()
def excerpts(spark, d):
    """The best lexical hits with the field of their best line and its neighbours."""
    r = revisions(spark, d)
    best = lexical.top(postings.search(index_of(spark, d), list(search.WEIGHTS.values()), QUERY), 50, "id")
    return search.excerpts(r, best, QUERY, unit_index(spark, d, search.line_units))


@query()
def rerank_documents(spark, d):
    """Scores of the best hits' documents by the stand-in reranker."""
    r = revisions(spark, d)
    best = lexical.top(postings.search(index_of(spark, d), list(search.WEIGHTS.values()), QUERY), 30, "id").select("id")
    return search.rerank_scores(r, best, QUERY, models.OverlapReranker(), unit_index(spark, d, search.segment_units))


def _compact_sql(**columns: str) -> str:
    shown = ", ".join(f"CASE WHEN {has} THEN '\"{c}\":' || to_json({c})::VARCHAR END" for c, has in columns.items())
    return f"'{{' || array_to_string(list_filter([{shown}], lambda x: x IS NOT NULL), ',') || '}}'"


_COMPACT = _compact_sql(memory_id="memory_id <> ''", title="title <> ''", kind="kind <> ''", tags="len(tags) > 0", confidence="confidence IS NOT NULL", salience="salience IS NOT NULL")


@query(f"WITH {_REV} SELECT id, {_COMPACT} AS body FROM rev")
def compact_output(spark, d):
    r = revisions(spark, d, "memory_id", "title", "kind", "tags", "confidence", "salience")
    return r.select("id", shape.compact(["memory_id", "title", "kind", "tags", "confidence", "salience"], r.schema).alias("body"))


@query()
def embed_segments(spark, d):
    built = segments.build(revisions(spark, d, "searchable_text"), "id", "searchable_text")
    return models.embed(built, "segment_id", "text", models.HashingEmbedder(64))


# -- graph ---------------------------------------------------------------------------------------

LINK_AT = "1998-06-01 00:00:00"
_LIVE = f"live AS (SELECT * FROM links WHERE created_at <= TIMESTAMP '{LINK_AT}' AND (deleted_at IS NULL OR deleted_at > TIMESTAMP '{LINK_AT}'))"


@query(f"WITH {_LINKS}, {_LIVE} SELECT link_id, src, dst, relation FROM live")
def links_live_at(spark, d):
    return graph.live_links(links(spark, d), LINK_AT).select("link_id", "src", "dst", "relation")


@query(f"WITH {_RED} SELECT id AS link_id, source_memory_id AS src, canonical_memory_id AS dst, 'merged-into' AS relation FROM red WHERE created_s <= 1700105000")
def merged_links(spark, d):
    at = F.timestamp_seconds(F.lit(1_700_105_000))
    return graph.redirect_links(redirects(spark, d), at).select("link_id", "src", "dst", "relation")


def _walk(spark, d, root, depth, direction, relations=None):
    edges = graph.directed(graph.live_links(links(spark, d), LINK_AT), direction, relations)
    return graph.traverse(edges, root, depth, 5000).select("memory_id", "depth")


@query(f"""WITH {_LINKS}, {_LIVE}, e AS (SELECT src AS a, dst AS b FROM live UNION ALL SELECT dst, src FROM live),
one AS (SELECT DISTINCT b AS id FROM e WHERE a = 'P1'), two AS (SELECT DISTINCT b AS id FROM e WHERE a IN (SELECT id FROM one) AND b <> 'P1' AND b NOT IN (SELECT id FROM one))
SELECT 'P1' AS memory_id, 0 AS depth UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two""")
def bfs_depth2(spark, d):
    return _walk(spark, d, "P1", 2, "both")


@query(f"WITH {_LINKS}, {_LIVE} SELECT 'P2' AS memory_id, 0 AS depth UNION ALL SELECT DISTINCT src, 1 FROM live WHERE dst = 'P2' AND relation = 'A'")
def bfs_directed_relation(spark, d):
    return _walk(spark, d, "P2", 3, "in", ["a"])


@query(f"""WITH {_REV}, {_HEADS} SELECT memory_id, round(0.35 * CASE WHEN contains(lower(searchable_text), 'retention plan') THEN 1.0 ELSE 0.0 END
 + 0.40 * (CASE WHEN contains(lower(searchable_text), 'plan') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(searchable_text), 'retention') THEN 1.0 ELSE 0.0 END) / 2
 + 0.15 / 2 + 0.05 * coalesce(salience, 0.5) + 0.05 * coalesce(confidence, 0.5), 6) AS relevance FROM heads""")
def traversal_score(spark, d):
    h = temporal.revisions_as_of(revisions(spark, d, "memory_id", "revision_number", "searchable_text", "salience", "confidence"))
    score = graph.traversal_score(F.col("searchable_text"), "Retention plan", F.lit(1), F.col("salience"), F.col("confidence"))
    return h.select("memory_id", F.round(score, 6).alias("relevance"))


@query(f"""WITH {_LINKS}, {_LIVE}, f AS (SELECT src AS memory_id, count(*) AS c FROM live GROUP BY 1), top AS (SELECT memory_id, row_number() OVER (ORDER BY c DESC, memory_id) AS seed FROM f ORDER BY c DESC, memory_id LIMIT 10),
n AS (SELECT l.dst AS b, t.seed, row_number() OVER (PARTITION BY l.src ORDER BY l.created_at, l.link_id) AS n FROM live l JOIN top t ON t.memory_id = l.src)
SELECT DISTINCT b AS memory_id FROM n WHERE n <= 100""")
def relation_expand(spark, d):
    live = graph.live_links(links(spark, d), LINK_AT)
    fused = live.groupBy(F.col("src").alias("memory_id")).agg(F.count(F.lit(1)).alias("fused")).withColumns({"first_channel": F.lit(0), "first_rank": F.lit(0)})
    edges = graph.directed(live, "out").select("a", "b", "created_at", "link_id")
    return fusion.expand_relations(fused, edges, live.select(F.col("dst").alias("memory_id")).distinct()).select("memory_id")


# -- mutations -----------------------------------------------------------------------------------

@query("""WITH i AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, lower(l_returnflag) AS relation, l_shipdate FROM lineitem),
have AS (SELECT DISTINCT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, lower(l_returnflag) AS relation FROM lineitem WHERE l_returnflag <> 'R')
SELECT DISTINCT src, dst, relation FROM i WHERE (src, dst, relation) NOT IN (SELECT (src, dst, relation) FROM have)""")
def link_dedupe(spark, d):
    have = links(spark, d)
    incoming = read(spark, d, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("link_id"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("P"), F.col("l_partkey")).alias("dst"),
        F.lower("l_returnflag").alias("relation"), F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
    )
    return mutate.new_links(have, incoming).select("src", "dst", "relation")


@query(f"WITH {_MEM} SELECT min(id) AS id, space_id, idempotency_key FROM mem WHERE idempotency_key IS NOT NULL AND (space_id, idempotency_key) NOT IN (SELECT (space_id, idempotency_key) FROM mem WHERE state = 'archived' AND idempotency_key IS NOT NULL) GROUP BY space_id, idempotency_key UNION ALL SELECT id, space_id, idempotency_key FROM mem WHERE idempotency_key IS NULL OR space_id IS NULL")
def idempotent_append(spark, d):
    m = memories(spark, d).select("id", "space_id", "idempotency_key", "state")
    return mutate.append_once(m.filter("state = 'archived'"), m.drop("state"), ["space_id", "idempotency_key"], [F.asc("id")]).select("id", "space_id", "idempotency_key")


@query(f"""WITH {_REV}, {_HEADS}, c AS (SELECT r.id AS command_id, r.memory_id, r.parent_revision_id AS expected, r.recorded_at AS arrival, h.id AS head, h.revision_number AS n FROM rev r LEFT JOIN heads h USING (memory_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY memory_id, head = expected ORDER BY arrival, command_id) AS place FROM c)
SELECT command_id, memory_id, CASE WHEN head IS NULL THEN 'unknown' WHEN head = expected AND place = 1 THEN 'applied' ELSE 'stale' END AS outcome, CASE WHEN head = expected AND place = 1 THEN n + 1 END AS revision_number FROM p""")
def revise_compare_and_append(spark, d):
    r = revisions(spark, d, "memory_id", "revision_number", "parent_revision_id", "recorded_at")
    commands = r.select(F.col("id").alias("command_id"), "memory_id", F.col("parent_revision_id").alias("expected_revision_id"), F.col("recorded_at").alias("arrival"))
    return mutate.compare_and_append(temporal.revisions_as_of(r), commands)


@query(f"""WITH {_MEM}, {_ST}, {_STATES} SELECT m.id AS memory_id, coalesce(s.event_number, 0) + 1 AS event_number, 'archived' AS state,
greatest(epoch_us({_ts(NOW)}), coalesce(epoch_us(s.recorded_at) + 1000, 0)) AS recorded_us FROM mem m LEFT JOIN states s ON s.memory_id = m.id WHERE s.state IS NULL OR s.state NOT IN ('archived', 'deleted')""")
def state_transition_plan(spark, d):
    commands = memories(spark, d).select(F.col("id").alias("memory_id"), F.lit("archived").alias("state"), temporal.instant(NOW).alias("at"))
    planned = mutate.transitions(temporal.states_as_of(events(spark, d)), commands)
    return planned.select("memory_id", "event_number", "state", us("recorded_at").alias("recorded_us"))


@query(f"""WITH {_RED}, m AS (SELECT canonical_memory_id AS dup, 'target' AS canon FROM red GROUP BY 1)
SELECT dup AS source_memory_id, canon AS canonical_memory_id, TRUE AS direct FROM m UNION ALL
SELECT r.source_memory_id, m.canon, FALSE FROM red r JOIN m ON r.canonical_memory_id = m.dup WHERE r.source_memory_id NOT IN (SELECT dup FROM m)""")
def merge_plan(spark, d):
    r = redirects(spark, d)
    merges = r.select(F.col("canonical_memory_id").alias("duplicate_id")).distinct().select("duplicate_id", F.lit("target").alias("canonical_id"), temporal.instant(NOW).alias("at"))
    return mutate.merge(r, merges).select("source_memory_id", "canonical_memory_id", "direct")


@query(f"WITH {_LINKS} SELECT link_id, epoch_us(least(deleted_at, CASE WHEN relation IN ('A', 'R') THEN TIMESTAMP '1999-01-01' END)) AS deleted_us FROM links")
def unlink_tombstones(spark, d):
    have = links(spark, d)
    gone = have.filter(F.col("relation").isin("A", "R")).select("link_id", temporal.instant("1999-01-01 00:00:00").alias("at"))
    return mutate.unlink(have, gone.unionByName(gone)).select("link_id", us("deleted_at").alias("deleted_us"))


@query(f"WITH {_REV} SELECT id, memory_id FROM rev WHERE memory_id NOT IN (SELECT id FROM memories WHERE state = 'deleted')")
def purge_deleted(spark, d):
    gone = memories(spark, d).filter("state = 'deleted'").select(F.col("id").alias("memory_id"))
    return mutate.purge(revisions(spark, d, "memory_id"), gone).select("id", "memory_id")


@query(f"WITH {_REV}, {_MEM}, {_HEADS} SELECT id FROM heads WHERE memory_id NOT IN (SELECT id FROM mem WHERE state = 'deleted') AND id NOT IN (SELECT current_revision_id FROM mem WHERE index_status IN ('pending', 'running') AND current_revision_id IS NOT NULL)")
def reindex_queue(spark, d):
    heads = temporal.revisions_as_of(revisions(spark, d, "memory_id", "revision_number", "recorded_at"))
    jobs = memories(spark, d).select(F.col("current_revision_id").alias("revision_id"), F.col("index_status").alias("status"))
    gone = memories(spark, d).filter("state = 'deleted'").select(F.col("id").alias("memory_id"))
    return mutate.reindex_queue(mutate.purge(heads, gone), jobs).select("id")


@query(f"WITH {_VEC}, {_REV}, {_HEADS} SELECT v.segment_id, h.memory_id, h.space_id, coalesce(h.confidence, -1.0) AS confidence FROM vec v JOIN heads h ON h.id = split_part(v.segment_id, ':', 1)")
def current_vectors(spark, d):
    heads = temporal.revisions_as_of(revisions(spark, d, "memory_id", "space_id", "revision_number", "confidence"))
    v = _vectors(spark, d).select("segment_id", F.substring_index("segment_id", ":", 1).alias("id"))
    return v.join(heads, "id").select("segment_id", "memory_id", "space_id", F.coalesce("confidence", F.lit(-1.0)).alias("confidence"))


@query(f"""WITH {_MEM}, {_REV}, {_ST}, h AS (SELECT memory_id, revision_number // 1000 AS part, string_agg(id, ',' ORDER BY revision_number, id) AS revision_ids FROM rev GROUP BY ALL),
s AS (SELECT memory_id, event_number // 1000 AS part, string_agg(state, ',' ORDER BY event_number, state) AS states FROM st GROUP BY ALL), b AS (SELECT * FROM h FULL JOIN s USING (memory_id, part))
SELECT m.id AS memory_id, b.part::BIGINT AS part, revision_ids, states FROM mem m LEFT JOIN b ON b.memory_id = m.id""")
def export_nested(spark, d):
    out = snapshot.export_nested(memories(spark, d), revisions(spark, d, "memory_id", "revision_number", "title", "kind"), events(spark, d))
    join = lambda c, f: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda x: x[f]), ","))
    return out.select("memory_id", "part", join("revisions", "revision_id").alias("revision_ids"), join("events", "state").alias("states"))


@query()
def stream_index(spark, d):
    """Run again on the same folder it reads only the files that have come since."""
    import hashlib

    from palimpsest.streaming.ingest import index_available

    table = read(spark, d, "memory_revisions")
    path = f"{d}/memory_revisions.parquet"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    source, pattern = (path, "*.parquet") if folder else (d, "memory_revisions.parquet")
    return index_available(spark, source, pattern, table.schema, hashlib.md5(d.encode()).hexdigest())
