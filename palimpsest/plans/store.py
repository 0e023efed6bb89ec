"""Queries of whole records, write commands, the traversal service and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palimpsest.operators import commands, filters, graph, hydrate, lexical, models, mutate, paging, postings, projection, shape, snapshot, temporal, traversal, validate
from palimpsest.plans import records, search
from palimpsest.plans.records import _ELIGIBLE, _FUSED, _HEADS, _LINKS, _LIVE, _MEM, _REV, _REV_AT, _ST, _ST_AT, _STATES, _TAGS, AT, LINK_AT, NOW, QUERY, _ts, delivered, us
from palimpsest.sources.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def heads(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    df = delivered(spark, d, "memory_id", "revision_number", *columns) if columns else delivered(spark, d)
    return temporal.revisions_as_of(df)


def states(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "memory_state_events")


def memory_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Feedback on current revisions: what a state event says about them."""
    m = records.memories(spark, d).filter("current_revision_id IS NOT NULL").select(F.col("id").alias("memory_id"), F.col("current_revision_id").alias("revision_id"))
    signal = F.when(F.col("state") == "active", "verified").when(F.col("state") == "archived", "correct").otherwise("stale")
    e = records.events(spark, d).select("id", "memory_id", F.lit("content").alias("scope"), signal.alias("signal"), F.col("recorded_at").alias("created_at"))
    return e.join(m, "memory_id")


def memory_redirects(spark: SparkSession, d: str) -> DataFrame:
    """Memories whose hashed id begins with 0 redirect to the smallest other memory of their space."""
    m = records.memories(spark, d).select("id", "space_id", "updated_at", (F.substring(F.md5("id"), 1, 1) == "0").alias("moved"))
    target = m.filter(~F.col("moved")).groupBy("space_id").agg(F.min("id").alias("canonical_memory_id"))
    return m.filter("moved").join(target, "space_id").select(
        F.concat(F.lit("r-"), "id").alias("id"), F.col("id").alias("source_memory_id"), "canonical_memory_id", F.concat(F.lit("op-"), F.substring(F.md5("id"), 2, 2)).alias("operation_id"),
        F.lit(True).alias("direct"), F.col("updated_at").alias("created_at"),
    )


_FB2 = """fb AS (SELECT s.id, s.memory_id, m.current_revision_id AS revision_id, CASE s.state WHEN 'active' THEN 'verified' WHEN 'archived' THEN 'correct' ELSE 'stale' END AS signal, s.recorded_at AS created_at
  FROM st s JOIN mem m ON m.id = s.memory_id WHERE m.current_revision_id IS NOT NULL)"""
_RED2 = """tgt AS (SELECT space_id, min(id) AS canonical FROM mem WHERE substr(md5(id), 1, 1) <> '0' GROUP BY 1),
red AS (SELECT 'r-' || m.id AS id, m.id AS source_memory_id, t.canonical AS canonical_memory_id, 'op-' || substr(md5(m.id), 2, 2) AS operation_id, m.updated_at AS created_at FROM mem m JOIN tgt t USING (space_id) WHERE substr(md5(m.id), 1, 1) = '0')"""
_BASE = f"{_REV}, {_MEM}, {_ST}, {_HEADS}, {_STATES}"


# -- whole records -------------------------------------------------------------------------------

@query(f"""WITH {_BASE}, {_FB2}, {_RED2}, f AS (SELECT revision_id, count(*) AS n, arg_max(signal, {{'c': created_at, 'i': id}}) AS latest FROM fb GROUP BY 1), mc AS (SELECT canonical_memory_id, count(*) AS n FROM red GROUP BY 1)
SELECT h.id, h.memory_id, s.state, array_to_string(coalesce({_TAGS}, []), ',') AS tags, coalesce(len(h.sources), 0)::INTEGER AS n_sources, coalesce(f.n, 0) AS content_count,
CASE WHEN f.latest IS NULL THEN 'unreviewed' WHEN f.latest = 'verified' THEN 'verified' WHEN f.latest = 'correct' THEN 'supported' ELSE 'needs-review' END AS feedback_status,
coalesce(r.canonical_memory_id, h.memory_id) AS canonical_id, coalesce(mc.n, 0) AS merged_count
FROM heads h JOIN states s USING (memory_id) LEFT JOIN f ON f.revision_id = h.id LEFT JOIN red r ON r.source_memory_id = h.memory_id LEFT JOIN mc ON mc.canonical_memory_id = h.memory_id""")
def hydrate_records(spark, d):
    whole = hydrate.records(heads(spark, d, "tags", "sources", "title"), states(spark, d), memory_feedback(spark, d), memory_redirects(spark, d))
    return whole.select("id", "memory_id", "state", F.array_join("tags", ",").alias("tags"), F.size("sources").alias("n_sources"), "content_count", "feedback_status", "canonical_id", "merged_count")


def _longest(spark, d):
    """The memory with the most revisions by the fixed instant."""
    seen = delivered(spark, d, "memory_id", "recorded_at").filter(F.col("recorded_at") <= temporal.instant(AT))
    known = seen.join(states(spark, d).filter(F.col("recorded_at") <= temporal.instant(AT)).select("memory_id"), "memory_id", "left_semi")
    return known.groupBy("memory_id").agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), "memory_id").first()["memory_id"]


@query(f"""WITH {_BASE}, {_REV_AT}, {_ST_AT}, w AS (SELECT memory_id FROM rev WHERE recorded_at <= {_ts(AT)} AND memory_id IN (SELECT memory_id FROM st_at) GROUP BY 1 ORDER BY count(*) DESC, memory_id LIMIT 1)
SELECT 'current' AS asked, h.id, s.state FROM heads h JOIN states s USING (memory_id) WHERE memory_id = (SELECT memory_id FROM w)
UNION ALL SELECT 'as of', r.id, s.state FROM rev_at r JOIN st_at s USING (memory_id) WHERE memory_id = (SELECT memory_id FROM w)
UNION ALL SELECT 'named', (SELECT min(id) FROM rev WHERE memory_id = s.memory_id), s.state FROM st_at s WHERE memory_id = (SELECT memory_id FROM w)""")
def point_read(spark, d):
    memory = _longest(spark, d)
    r, e = delivered(spark, d, "memory_id", "revision_number", "recorded_at"), states(spark, d)
    first = r.filter(F.col("memory_id") == memory).agg(F.min("id")).first()[0]
    reads = {"current": {}, "as of": {"at": AT}, "named": {"revision": first, "at": AT}}
    shown = [hydrate.point_read(r, e, memory, **how).select(F.lit(name).alias("asked"), "id", "state") for name, how in reads.items()]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query(f"""WITH {_REV}, s AS (SELECT id, unnest(sources) AS s, generate_subscripts(sources, 1) - 1 AS i FROM rev WHERE sources IS NOT NULL),
l AS (SELECT id, i, 0 AS k, 'uri' AS name, s.uri AS v FROM s UNION ALL SELECT id, i, 1, 'label', s.label FROM s UNION ALL SELECT id, i, 2, 'type', s.type FROM s
 UNION ALL SELECT id, i, 3, 'observedAt', strftime(s.observed_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') FROM s)
SELECT id, string_agg('sources/' || i || '/' || name || ': ' || v, chr(10) ORDER BY i, k) AS lines FROM l WHERE v <> '' GROUP BY id""")
def source_fields(spark, d):
    lines = records.once(delivered(spark, d, "sources").filter("sources IS NOT NULL")).select("id", projection.source_lines("sources").alias("l"))
    return lines.filter(F.size("l") > 0).select("id", F.array_join("l", "\n").alias("lines"))


@query()
def field_segments(spark, d):
    """Index segments of the fields of every revision."""
    return projection.field_segments(records.once(delivered(spark, d)))


@query(f"WITH {_REV} SELECT id || ':0' AS segment_id, id AS record_id, 0 AS ordinal FROM rev")
def first_segments(spark, d):
    return projection.first_segments(projection.field_segments(records.once(delivered(spark, d)))).select("segment_id", "record_id", "ordinal")


@query(f"WITH {_REV} SELECT id, memory_id, epoch_us(recorded_at) AS recorded_us FROM rev WHERE recorded_at <= {_ts(AT)}")
def revisions_until(spark, d):
    seen = records.once(delivered(spark, d, "memory_id", "recorded_at").filter(F.col("recorded_at") <= temporal.instant(AT)))
    return seen.select("id", "memory_id", us("recorded_at").alias("recorded_us")).orderBy("recorded_us", "id")


@query(f"WITH {_REV}, w AS (SELECT memory_id, space_id FROM rev GROUP BY ALL ORDER BY count(*) DESC, memory_id, space_id LIMIT 1) SELECT id, revision_number, title, length(content_json)::INTEGER AS content_chars FROM rev JOIN w USING (memory_id, space_id)")
def read_address(spark, d):
    r = delivered(spark, d, "memory_id", "space_id", "revision_number", "title", "content_json")
    best = r.groupBy("memory_id", "space_id").agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), "memory_id", "space_id").first()
    found = validate.read_address(r, validate.address(best["space_id"], best["memory_id"], history=True))
    return found.select("id", "revision_number", "title", F.length("content_json").alias("content_chars"))


@query("SELECT memory_id, revision_number, count(DISTINCT id) AS n_versions FROM memory_revisions GROUP BY ALL HAVING count(DISTINCT id) > 1")
def number_conflicts(spark, d):
    return validate.duplicate_keys(delivered(spark, d), ["memory_id", "revision_number"])


@query(f"WITH {_MEM}, {_REV} SELECT m.id, m.space_id, r.title FROM mem m JOIN rev r ON r.id = m.current_revision_id WHERE m.state = 'archived' AND m.space_id = 'default' AND list_contains({_TAGS}, 'operations')")
def list_filtered(spark, d):
    found = filters.listed(read(spark, d, "memories"), delivered(spark, d, "title", "kind", "tags"), space="default", state="archived", tags=["Operations"])
    return found.select("id", "space_id", "title")


@query(f"WITH {_MEM}, {_ST}, {_FB2}, w AS (SELECT memory_id FROM fb GROUP BY 1 ORDER BY count(*) DESC, memory_id LIMIT 1) SELECT id, memory_id, revision_id, signal FROM fb WHERE memory_id = (SELECT memory_id FROM w) AND created_at <= {_ts(NOW)}")
def feedback_of_memory(spark, d):
    from palimpsest.operators import feedback

    every = memory_feedback(spark, d)
    busiest = every.groupBy("memory_id").count().orderBy(F.desc("count"), "memory_id").first()["memory_id"]
    return feedback.listed(every, memory=busiest, scope="content", at=NOW).select("id", "memory_id", "revision_id", "signal")


@query("""WITH g(principal, space_id, level) AS (VALUES ('reader', '*', 1), ('reader', 'default', 3)), m AS (SELECT DISTINCT ON (id) * FROM memories)
SELECT m.id FROM m LEFT JOIN g ON g.space_id = m.space_id WHERE coalesce(g.level, 1) >= 2""")
def grants_capped(spark, d):
    grants = spark.createDataFrame([("reader", "*", 1), ("reader", "default", 3)], "principal string, space_id string, level int")
    m = records.memories(spark, d).select("id", "space_id")
    return filters.readable(m, grants, "reader", 2, cap=2).select("id").unionByName(filters.readable(m, grants, "reader", 3, cap=2).select("id"))


class Unwilling(models.HashingEmbedder):
    """A stand-in that refuses texts about retention."""

    def embed_documents(self, texts):
        if any("retention" in t for t in texts):
            raise ValueError("refused")
        return super().embed_documents(texts)


@query(f"WITH {_REV} SELECT id AS record_id, CASE WHEN contains(searchable_text, 'retention') THEN 'lexical-only' ELSE 'ready' END AS status, CASE WHEN contains(searchable_text, 'retention') THEN 'refused' END AS error FROM rev WHERE searchable_text IS NOT NULL AND searchable_text <> ''")
def index_pipeline(spark, d):
    """Segments and vectors of every revision; where a text is refused, its revision has words only."""
    from palimpsest.operators import segments

    texts = records.once(delivered(spark, d, "searchable_text").filter("searchable_text <> ''"))
    built = segments.build(texts, "id", "searchable_text")
    return models.index_status(built, models.embed_each(built, "segment_id", "text", Unwilling(64))).select("record_id", "status", "error")


@query("SELECT doc_id AS id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::INTEGER AS n_tokens FROM (SELECT DISTINCT ON (doc_id) * FROM documents) WHERE lang = 'en'")
def count_tokens(spark, d):
    doc = read(spark, d, "documents").filter("lang = 'en'").dropDuplicates(["doc_id"])
    return models.count_tokens(doc, "doc_id", "text", models.HashingEmbedder())


_HEADLESS = "regexp_replace(searchable_text, '^(Title: [^\n]*\n)?(Kind: [^\n]*\n)?(Tags: [^\n]*\n)?', '')"


@query(f"WITH {_REV} SELECT id, md5({_HEADLESS}) AS body FROM rev WHERE searchable_text IS NOT NULL")
def compact_excerpts(spark, d):
    from palimpsest.operators import shape

    texts = records.once(delivered(spark, d, "searchable_text").filter("searchable_text IS NOT NULL"))
    return texts.select("id", F.md5(shape.without_head("searchable_text")).alias("body"))


@query(f"WITH {_REV}, w AS (SELECT memory_id FROM rev GROUP BY 1 ORDER BY count(*) DESC, memory_id LIMIT 1) SELECT id, revision_number, md5(content_json) AS content, len(sources)::INTEGER AS n_sources FROM rev WHERE memory_id = (SELECT memory_id FROM w) ORDER BY revision_number DESC, id DESC LIMIT 21")
def history_content(spark, d):
    """A page of a memory's history with the columns a caller has to ask for."""
    r = delivered(spark, d, "memory_id")
    longest = r.groupBy("memory_id").agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), "memory_id").limit(1).select("memory_id")
    own = records.once(delivered(spark, d, "memory_id", "revision_number", "content_json", "sources").join(F.broadcast(longest), "memory_id", "left_semi"))
    page = paging.page(own, [("revision_number", False), ("id", False)], 20)
    return page.select("id", "revision_number", F.md5("content_json").alias("content"), F.when(F.col("sources").isNotNull(), F.size("sources")).alias("n_sources"))


@query(f"WITH {_BASE}, {_ELIGIBLE} SELECT id, space_id FROM eligible WHERE space_id IN ('default', 'field-ops')")
def candidate_scoped(spark, d):
    """Candidates of two spaces, and of none, which are none."""
    two = records._eligible(spark, d, spaces=["default", "field-ops"])
    return two.unionByName(records._eligible(spark, d, spaces=[])).select("id", "space_id")


@query(f"""WITH {_REV}, {_HEADS}, q AS (SELECT trim(min(title)) AS q FROM heads) SELECT id, 2 AS rank_value, id || ':0' AS segment_id FROM heads, q
WHERE translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = translate(q.q, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ORDER BY recorded_at DESC, id LIMIT 10""")
def exact_segments(spark, d):
    """Exact hits with the first segment of each."""
    h = heads(spark, d)
    wanted = h.agg(F.min("title")).first()[0] or "none"
    found = lexical.exact(h, records.memories(spark, d), wanted, 10)
    few = h.join(F.broadcast(found.select("id")), "id", "left_semi")
    return found.join(projection.first_segments(projection.field_segments(few)), F.col("id") == F.col("record_id")).select("id", "rank_value", "segment_id")


@query()
def bm25_segments(spark, d):
    """The best segments of the fields of all revisions, by an inverted index of their own."""
    def build() -> postings.Index:
        r = records.once(delivered(spark, d))
        built = projection.field_segments(r).join(r.select(F.col("id").alias("record_id"), "title", F.array_join("tags", " ").alias("tag_text")), "record_id")
        return postings.build(built, ["title", "text", "tag_text"], "segment_id")

    index = records.kept_index(spark, f"{d} segments", build)
    return lexical.top(postings.search(index, list(search.WEIGHTS.values()), QUERY), 100, "id").withColumnRenamed("id", "segment_id")


@query(f"WITH {_REV} SELECT id, len(list_filter(sources, lambda s: s.observed_at IS NOT NULL AND s.observed_at IS DISTINCT FROM observed_at))::INTEGER AS n_own_times FROM rev WHERE sources IS NOT NULL")
def payload_times(spark, d):
    """How many sources of a record show a time of their own."""
    r = records.once(delivered(spark, d, "sources", "observed_at").filter("sources IS NOT NULL"))
    return r.select("id", F.size(F.filter(shape.payload_sources("sources", "observed_at"), lambda s: s["observed_at"].isNotNull())).alias("n_own_times"))


@query(f"WITH {_MEM} SELECT id, CASE WHEN index_status = 'ready' OR index_status IS NULL THEN '{{{{' || '\"state\":\"' || state || '\"}}}}' ELSE '{{{{' || '\"state\":\"' || state || '\",\"index_status\":\"' || index_status || '\"}}}}' END AS body FROM mem".replace("{{", "{").replace("}}", "}"))
def payload_status(spark, d):
    return shape.payload(records.memories(spark, d), ["state", "index_status"])


# -- search --------------------------------------------------------------------------------------

def title_scorer(hits: DataFrame, text: str) -> DataFrame:
    """Share of the query's words in a title: a scorer that SQL can repeat."""
    words = text.lower().split()
    share = sum((F.when(F.contains(F.lower("title"), F.lit(w)), 1.0).otherwise(0.0) for w in words), F.lit(0.0)) / len(words)
    return hits.select("memory_id", F.coalesce(share, F.lit(0.0)).alias("reranker"))


_WORDS = [w.lower() for w in QUERY.split()]
_SHARE = "(" + " + ".join(f"CASE WHEN contains(lower(coalesce(title, '')), '{w}') THEN 1.0 ELSE 0.0 END" for w in _WORDS) + f") / {len(_WORDS)}"
_BOOST = f"CASE WHEN lower(title) = '{QUERY.lower()}' THEN 0.04 WHEN contains(lower(title), '{QUERY.lower()}') THEN 0.02 ELSE 0 END"


def _found(source: str, rerank: bool) -> str:
    """SQL of the search over the fused channels in ``source`` (memory_id, fused, seen)."""
    titled = f"titled AS (SELECT f.memory_id, f.seen, e.title, f.fused + coalesce({_BOOST}, 0) AS fused FROM ({source}) f JOIN eligible e USING (memory_id))"
    if not rerank:
        return f"{_FUSED}, {titled} SELECT memory_id, round(fused, 9) AS fused, row_number() OVER (ORDER BY titled.fused DESC, seen)::INTEGER AS place FROM titled ORDER BY titled.fused DESC, seen LIMIT 5"
    return f"""{_FUSED}, {titled}, numbered AS (SELECT *, row_number() OVER (ORDER BY fused DESC, seen) AS n FROM titled),
rescored AS (SELECT memory_id, seen, CASE WHEN n <= 10 THEN {_SHARE} END AS reranker, fused + CASE WHEN n <= 10 THEN 0.05 * ({_SHARE}) ELSE 0 END AS fused FROM numbered),
again AS (SELECT *, row_number() OVER (ORDER BY fused DESC, seen) AS n FROM rescored), best AS (SELECT max(reranker) FILTER (n = 1) AS w, coalesce(max(reranker) FILTER (n > 1), 0) AS o FROM again)
SELECT memory_id, round(fused, 9) AS fused, n::INTEGER AS place FROM again, best WHERE n <= 5 AND (n = 1 OR NOT coalesce(w >= 0.5 AND o < 0.02 * w, FALSE)) ORDER BY n"""


_BOTH = "SELECT * FROM fused"
_ONE = "SELECT memory_id, 1.0 / (60 + rank) AS fused, {c} * 1000 + rank AS seen FROM {t}"


def _search(spark, d, mode, **more):
    profile, vector = records._query_vector(spark, d)
    found = search.search(records._tables(spark, d), filters.Candidates(now=NOW, **more), QUERY, vector, profile, 5, mode=mode, scorer=title_scorer)
    return found.select("memory_id", F.round("fused", 9).alias("fused"), "place")


@query(_found(_BOTH, False))
def search_fast(spark, d):
    return _search(spark, d, "fast")


@query(_found(_BOTH, False))
def search_hybrid(spark, d):
    """Automatic mode without a reranker: it says so and keeps the fused order."""
    profile, vector = records._query_vector(spark, d)
    found = search.search(records._tables(spark, d), filters.Candidates(now=NOW), QUERY, vector, profile, 5)
    return found.select("memory_id", F.round("fused", 9).alias("fused"), "place")


@query(_found(_BOTH, True))
def search_quality(spark, d):
    return _search(spark, d, "quality")


@query(_found(_BOTH, True))
def search_auto(spark, d):
    """Without a scope nothing but an exact hit is beyond doubt."""
    return _search(spark, d, "auto")


@query(_found(_ONE.format(c=1, t="lex"), False))
def search_lexical(spark, d):
    return _search(spark, d, "lexical")


@query(_found(_ONE.format(c=2, t="sem"), False))
def search_semantic(spark, d):
    return _search(spark, d, "semantic")


@query()
def search_expanded(spark, d):
    """Search with relation expansion, reranked by the stand-in model, with excerpts."""
    t = records._tables(spark, d)
    moved = memory_redirects(spark, d).select(F.col("source_memory_id").alias("src"), F.col("canonical_memory_id").alias("dst"), F.col("id").alias("link_id"), F.lit("merged-into").alias("relation"), "created_at")
    edges = graph.directed(moved).select("a", "b", "created_at", "link_id")
    tables = search.Tables(t.memories, t.revisions, t.events, t.spaces, t.vectors, t.index, edges)
    profile, vector = records._query_vector(spark, d)
    found = search.search(tables, filters.Candidates(now=NOW), QUERY, vector, profile, 10, mode="quality", scorer=search.model_scorer(tables.revisions, models.OverlapReranker(), records.unit_index(spark, d, search.segment_units)), expand=True)
    shown = search.excerpts(records.revisions(spark, d), found.select(F.col("evidence").alias("id")), QUERY, records.unit_index(spark, d, search.line_units))
    return found.join(shown.withColumnRenamed("id", "evidence"), "evidence", "left")


# -- traversal -----------------------------------------------------------------------------------

def _walk(spark, d):
    edges = graph.directed(graph.live_links(records.links(spark, d), LINK_AT), "both")
    return graph.traverse(edges, "P1", 2, traversal.MOST_RANKED)


_WALK = f"""{_LINKS}, {_LIVE}, e AS (SELECT src AS a, dst AS b, created_at, link_id FROM live UNION ALL SELECT dst, src, created_at, link_id FROM live),
one AS (SELECT b AS id, row_number() OVER (ORDER BY min(struct_pack(c := created_at, l := link_id))) AS place FROM e WHERE a = 'P1' GROUP BY b),
touched AS (SELECT e.b AS id, o.place AS parent, e.created_at, e.link_id FROM e JOIN one o ON e.a = o.id ORDER BY e.created_at, e.link_id, e.a LIMIT (SELECT least(greatest(4 * (500 - count(*)), 100), 20000) FROM one)),
cand AS (SELECT * FROM touched WHERE id <> 'P1' AND id NOT IN (SELECT id FROM one)),
two AS (SELECT id, row_number() OVER (ORDER BY min(struct_pack(p := parent, c := created_at, l := link_id))) + (SELECT count(*) FROM one) AS place FROM cand GROUP BY id),
walk AS (SELECT * FROM (SELECT 'P1' AS memory_id, 0 AS depth, 0 AS place UNION ALL SELECT id, 1, place FROM one UNION ALL SELECT id, 2, place FROM two) WHERE place < 500)"""


@query(f"WITH {_WALK} SELECT memory_id, depth, place::INTEGER AS place FROM walk WHERE place >= 20 AND place < 40")
def traverse_page(spark, d):
    """The second page of a traversal, by the cursor of the first."""
    walked, asked = _walk(spark, d), {"root": "P1", "depth": 2}
    _, cursor, _ = traversal.page(walked, asked, LINK_AT, 20)
    rows, _, _ = traversal.page(walked, asked, LINK_AT, 20, cursor)
    return rows.select("memory_id", "depth", F.col("place").cast("int").alias("place"))


_NODES = "nodes AS (SELECT 'P' || p_partkey AS memory_id, p_name AS txt, 0.5 AS salience FROM part UNION ALL SELECT 'S' || s_suppkey, s_name, NULL FROM supplier)"


def _nodes(spark, d):
    none = F.lit(None).cast("double")
    p = read(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("memory_id"), F.col("p_name").alias("searchable_text"), F.lit(0.5).alias("salience"), none.alias("confidence"))
    return p.unionByName(read(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("memory_id"), F.col("s_name").alias("searchable_text"), none.alias("salience"), none.alias("confidence")))


_LEX = "0.35 * CASE WHEN contains(lower(coalesce(txt, '')), 'red widget') THEN 1.0 ELSE 0.0 END + 0.40 * (CASE WHEN contains(lower(coalesce(txt, '')), 'red') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(coalesce(txt, '')), 'widget') THEN 1.0 ELSE 0.0 END) / 2 + 0.15 / (depth + 1) + 0.05 * coalesce(salience, 0.5) + 0.05 * 0.5"


@query(f"WITH {_WALK}, {_NODES}, r AS (SELECT memory_id, depth, round({_LEX}, 6) AS relevance FROM walk LEFT JOIN nodes USING (memory_id)) SELECT memory_id, relevance FROM r")
def traverse_ranked(spark, d):
    return traversal.ranked(_walk(spark, d), _nodes(spark, d), "Red widget").select("memory_id", "relevance")


@query(f"""WITH {_WALK}, {_NODES}, r AS (SELECT memory_id, depth, {_LEX} AS lex FROM walk LEFT JOIN nodes USING (memory_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY depth > 0 ORDER BY round(lex, 12) DESC, depth, memory_id) AS n FROM r),
b AS (SELECT memory_id, depth, CASE WHEN depth > 0 AND n <= 30 THEN 0.4 * lex + 0.6 * (length(memory_id) / 10.0) ELSE lex END AS v FROM n)
SELECT memory_id, round(v, 6) AS relevance FROM b""")
def traverse_reranked(spark, d):
    walked = _walk(spark, d)
    scores = walked.select("memory_id", (F.length("memory_id") / 10.0).alias("reranker"))
    return traversal.ranked(walked, _nodes(spark, d), "Red widget", scores).select("memory_id", "relevance")


def _operations(spark, d):
    r = memory_redirects(spark, d)
    return r.select(F.col("operation_id").alias("id"), F.lit("merger").alias("actor_id"), F.concat(F.lit("same as "), "operation_id").alias("reason")).distinct()


@query(f"""WITH {_MEM}, {_RED2}, {_LINKS}, {_LIVE} SELECT link_id, src, dst, relation, NULL AS reason FROM live
UNION ALL SELECT id, source_memory_id, canonical_memory_id, 'merged-into', 'same as ' || operation_id FROM red WHERE created_at <= {_ts(NOW)} AND {_ts(LINK_AT)} < {_ts(NOW)}""")
def all_edges(spark, d):
    live = graph.live_links(records.links(spark, d), LINK_AT).withColumns({"deleted_at": F.lit(None).cast("timestamp"), "valid_from": F.lit(None).cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})
    edges = traversal.edges(live, memory_redirects(spark, d), _operations(spark, d), NOW)
    return edges.select("link_id", "src", "dst", "relation", F.get_json_object("metadata", "$.reason").alias("reason"))


@query(f"WITH {_LINKS}, {_LIVE} SELECT link_id, relation FROM live WHERE src = 'S1' OR dst = 'S1' ORDER BY created_at, link_id LIMIT 100")
def links_of_node(spark, d):
    live = graph.live_links(records.links(spark, d), LINK_AT)
    return traversal.links_of(live, "S1").select("link_id", "relation")


# -- write commands ------------------------------------------------------------------------------

@query(f"""WITH {_MEM}, old AS (SELECT * FROM mem WHERE state = 'archived'), c AS (SELECT id AS command_id, created_at AS arrival, space_id, idempotency_key AS ik, logical_key AS lk FROM mem),
a AS (SELECT c.*, ik IS NOT NULL AND ((space_id, ik) IN (SELECT (space_id, idempotency_key) FROM old WHERE idempotency_key IS NOT NULL AND space_id IS NOT NULL)
  OR row_number() OVER (PARTITION BY space_id, coalesce(ik, '_' || command_id) ORDER BY arrival, command_id) > 1) AS again FROM c),
b AS (SELECT a.*, lk IS NOT NULL AND ((space_id, lk) IN (SELECT (space_id, logical_key) FROM old WHERE logical_key IS NOT NULL AND space_id IS NOT NULL)
  OR row_number() OVER (PARTITION BY again, space_id, coalesce(lk, '_' || command_id) ORDER BY arrival, command_id) > 1) AS taken FROM a)
SELECT command_id, CASE WHEN again THEN 'repeated' WHEN taken THEN 'conflict' ELSE 'created' END AS outcome FROM b""")
def create_memories(spark, d):
    m = records.memories(spark, d)
    asked = m.select(F.col("id").alias("command_id"), F.col("created_at").alias("arrival"), "space_id", "idempotency_key", "logical_key")
    return commands.create(m.filter("state = 'archived'"), asked).select("command_id", "outcome")


@query(f"""WITH {_REV}, {_HEADS}, t AS (SELECT id, unnest(list_distinct({_TAGS})) AS tag FROM heads)
SELECT 'tags' AS t, count(*) AS n FROM t UNION ALL SELECT 'sources', coalesce(sum(len(sources)), 0)::BIGINT FROM heads UNION ALL SELECT 'revisions', count(*) FROM heads UNION ALL SELECT 'events', count(*) FROM heads UNION ALL SELECT 'jobs', count(*) FROM heads""")
def create_rows(spark, d):
    """How many rows the creation of every head's content appends to each table."""
    asked = heads(spark, d, "space_id", "title", "kind", "tags", "sources", "recorded_at").select(
        F.col("id").alias("command_id"), F.col("recorded_at").alias("arrival"), "space_id", F.lit(None).cast("string").alias("idempotency_key"), F.lit(None).cast("string").alias("logical_key"), "title", "kind", "tags", "sources"
    )
    rows = commands.first_rows(commands.create(records.memories(spark, d).limit(0), asked))
    counts = [df.agg(F.lit(name).alias("t"), F.count(F.lit(1)).alias("n")) for name, df in rows.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def _feedback_commands(spark, d):
    e = records.events(spark, d)
    b = F.conv(F.substring(F.md5("id"), 1, 2), 16, 10).cast("int")
    return e.select(
        F.col("id").alias("command_id"), F.col("recorded_at").alias("arrival"), "memory_id", F.lit(None).cast("string").alias("revision_id"), F.lit("content").alias("scope"),
        F.when(b % 4 == 0, "relevant").when(b % 4 == 1, "stale").otherwise("verified").alias("signal"), F.lit(None).cast("string").alias("query"), F.when(b % 2 == 1, F.col("state")).alias("idempotency_key"),
    )


@query(f"""WITH {_BASE}, c AS (SELECT id AS command_id, recorded_at AS arrival, memory_id, ('0x' || substr(md5(id), 1, 2))::INTEGER AS b, state FROM st),
k AS (SELECT command_id, arrival, c.memory_id, CASE WHEN b % 4 = 0 THEN 'relevant' WHEN b % 4 = 1 THEN 'stale' ELSE 'verified' END AS signal, CASE WHEN b % 2 = 1 THEN state END AS ik, h.id AS head FROM c LEFT JOIN heads h USING (memory_id)),
s AS (SELECT *, signal <> 'relevant' AND head IS NOT NULL AS sound FROM k),
w AS (SELECT *, CASE WHEN ik IS NOT NULL AND row_number() OVER p > 1 THEN first_value(signal) OVER p END AS before FROM s WINDOW p AS (PARTITION BY memory_id, ik, sound ORDER BY arrival, command_id))
SELECT command_id, CASE WHEN signal = 'relevant' THEN 'invalid' WHEN NOT sound THEN 'unknown' WHEN before IS NOT NULL THEN CASE WHEN before = signal THEN 'repeated' ELSE 'conflict' END ELSE 'recorded' END AS outcome FROM w""")
def record_feedback(spark, d):
    none = spark.createDataFrame([], "memory_id string, idempotency_key string, request_hash string")
    return commands.record_feedback(none, delivered(spark, d, "memory_id"), heads(spark, d, "recorded_at"), _feedback_commands(spark, d)).select("command_id", "outcome")


@query(f"""SELECT id, CASE WHEN substr(md5(id), 1, 1) < '8' AND id <> 'default' THEN epoch_us(coalesce(deleted_at, {_ts(NOW)})) WHEN substr(md5(id), 1, 1) >= 'c' THEN NULL ELSE epoch_us(deleted_at) END AS deleted_us FROM spaces
UNION ALL SELECT 'new-space', NULL""")
def change_spaces(spark, d):
    s = read(spark, d, "spaces")
    digit = F.substring(F.md5("id"), 1, 1)
    action = F.when(digit < "8", "delete").when(digit >= "c", "restore")
    asked = s.select(F.concat(F.lit("c-"), "id").alias("command_id"), temporal.instant(NOW).alias("arrival"), F.col("id").alias("space_id"), action.alias("action")).filter("action IS NOT NULL")
    made = spark.range(1).select(F.lit("c-new").alias("command_id"), temporal.instant(NOW).alias("arrival"), F.lit("new-space").alias("space_id"), F.lit("create").alias("action"))
    again = s.limit(1).select(F.concat(F.lit("a-"), "id").alias("command_id"), temporal.instant(NOW).alias("arrival"), F.col("id").alias("space_id"), F.lit("create").alias("action"))
    return commands.change_spaces(s, asked.unionByName(made).unionByName(again)).select("id", us("deleted_at").alias("deleted_us"))


@query(f"""WITH {_BASE}, {_RED2}, c AS (SELECT r.id AS command_id, r.memory_id, r.parent_revision_id AS expected, r.recorded_at AS arrival, h.id AS head, h.revision_number AS n FROM rev r LEFT JOIN heads h USING (memory_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY memory_id, head = expected ORDER BY arrival, command_id) AS place FROM c)
SELECT command_id, CASE WHEN memory_id IN (SELECT source_memory_id FROM red) THEN 'merged' WHEN head IS NULL THEN 'unknown' WHEN head = expected AND place = 1 THEN 'applied' ELSE 'stale' END AS outcome FROM p""")
def revise_unless_merged(spark, d):
    r = delivered(spark, d, "memory_id", "revision_number", "parent_revision_id", "recorded_at")
    asked = records.once(r).select(F.col("id").alias("command_id"), "memory_id", F.col("parent_revision_id").alias("expected_revision_id"), F.col("recorded_at").alias("arrival"))
    return commands.revise(temporal.revisions_as_of(r), memory_redirects(spark, d), asked).select("command_id", "outcome")


def _merges(spark, d):
    """Each active memory is to take up the next one of its space by id, in the order of ids."""
    m = records.memories(spark, d)
    h = heads(spark, d, "recorded_at").select(F.col("memory_id").alias("id"), F.col("id").alias("head"))
    after = Window.partitionBy("space_id").orderBy("id")
    both = m.join(h, "id", "left").select("id", "head", "state", F.lead("id").over(after).alias("next"), F.lead("head").over(after).alias("next_head"))
    return both.filter("next IS NOT NULL AND state <> 'deleted'").select(
        F.concat(F.lit("op-"), "id").alias("operation_id"), temporal.instant(NOW).alias("arrival"), F.col("id").alias("canonical_id"), F.col("head").alias("canonical_revision_id"),
        F.col("next").alias("duplicate_id"), F.coalesce("next_head", F.lit("none")).alias("duplicate_revision_id"),
    )


_MERGES = f"""{_BASE}, {_RED2}, mm AS (SELECT m.id, m.state, h.id AS head, lead(m.id) OVER (PARTITION BY m.space_id ORDER BY m.id) AS nxt, lead(h.id) OVER (PARTITION BY m.space_id ORDER BY m.id) AS nxt_head, lead(m.state) OVER (PARTITION BY m.space_id ORDER BY m.id) AS nxt_state FROM mem m LEFT JOIN heads h ON h.memory_id = m.id WHERE m.space_id IS NOT NULL),
ops AS (SELECT *, 'op-' || id AS operation_id, coalesce(state = 'active' AND head IS NOT NULL AND nxt_head IS NOT NULL AND id NOT IN (SELECT source_memory_id FROM red) AND nxt NOT IN (SELECT source_memory_id FROM red), FALSE) AS sound FROM mm WHERE nxt IS NOT NULL AND state <> 'deleted'),
uses AS (SELECT operation_id, nxt AS m, TRUE AS d FROM ops WHERE sound UNION ALL SELECT operation_id, id, FALSE FROM ops WHERE sound),
late AS (SELECT *, max(d::INT) OVER w AS before, count(*) OVER w AS used FROM uses WINDOW w AS (PARTITION BY m ORDER BY operation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT o.*, CASE WHEN sound AND operation_id NOT IN (SELECT operation_id FROM late WHERE before = 1 OR (d AND used > 0)) THEN 'applied' ELSE 'rejected' END AS outcome FROM ops o)"""


@query(f"WITH {_MERGES} SELECT operation_id, nxt AS duplicate_id, outcome FROM judged")
def merge_memories(spark, d):
    done = commands.merge(heads(spark, d, "recorded_at"), records.memories(spark, d), memory_redirects(spark, d), _merges(spark, d))
    return done.select("operation_id", "duplicate_id", "outcome")


@query(f"""WITH {_MERGES}, a AS (SELECT * FROM judged WHERE outcome = 'applied'), l AS (SELECT memory_id, max(recorded_at) AS last, max(event_number) AS n FROM st GROUP BY 1)
SELECT 'redirect' AS kind, nxt AS memory_id, id AS target, 1 AS number FROM a UNION ALL SELECT 'redirect', r.source_memory_id, a.id, 0 FROM red r JOIN a ON r.canonical_memory_id = a.nxt
UNION ALL SELECT 'event', nxt, epoch_us(greatest({_ts(NOW)}, last + INTERVAL 1 MILLISECOND))::VARCHAR, coalesce(n, 0) + 1 FROM a LEFT JOIN l ON l.memory_id = a.nxt WHERE nxt_state = 'active'""")
def merge_rows(spark, d):
    red = memory_redirects(spark, d)
    done = commands.merge(heads(spark, d, "recorded_at"), records.memories(spark, d), red, _merges(spark, d))
    rows = commands.merge_rows(done, red, records.events(spark, d))
    moved = rows["redirects"].select(F.lit("redirect").alias("kind"), F.col("source_memory_id").alias("memory_id"), F.col("canonical_memory_id").alias("target"), F.col("direct").cast("int").alias("number"))
    return moved.unionByName(rows["events"].select(F.lit("event").alias("kind"), "memory_id", us("recorded_at").cast("string").alias("target"), F.col("event_number").alias("number")))


@query(f"""WITH {_BASE}, {_FB2}, {_RED2}, gone AS (SELECT id FROM mem WHERE state = 'deleted'), keep AS (SELECT * FROM red WHERE source_memory_id NOT IN (SELECT id FROM gone) AND canonical_memory_id NOT IN (SELECT id FROM gone)),
vec AS (SELECT DISTINCT v.segment_id, r.memory_id FROM memory_vectors v JOIN rev r ON r.id = split_part(v.segment_id, ':', 1))
SELECT 'memories' AS t, count(*) AS n FROM mem WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'revisions', count(*) FROM rev WHERE memory_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'events', count(*) FROM st WHERE memory_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'feedback', count(*) FROM fb WHERE memory_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'redirects', count(*) FROM keep UNION ALL SELECT 'merge_members', count(*) FROM red WHERE source_memory_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'merge_operations', count(DISTINCT operation_id) FROM red WHERE source_memory_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'vectors', count(*) FROM vec WHERE memory_id NOT IN (SELECT id FROM gone)""")
def purge_cascade(spark, d):
    m, red = records.memories(spark, d), memory_redirects(spark, d)
    r = records.once(delivered(spark, d, "memory_id"))
    vectors = read(spark, d, "memory_vectors").select("segment_id", F.substring_index("segment_id", ":", 1).alias("id")).distinct().join(r, "id")
    tables = {
        "memories": m, "revisions": r, "events": records.events(spark, d), "feedback": memory_feedback(spark, d), "redirects": red, "vectors": vectors,
        "merge_members": red.select("operation_id", F.col("source_memory_id").alias("duplicate_memory_id")),
        "merge_operations": red.select(F.col("operation_id").alias("id"), F.lit("none").alias("canonical_memory_id")).distinct(),
    }
    left = commands.cascade(tables, m.filter("state = 'deleted'").select(F.col("id").alias("memory_id")))
    counts = [df.agg(F.lit(name).alias("t"), F.count(F.lit(1)).alias("n")) for name, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def _jobs(spark, d):
    """An index job for each memory: its state from the index status, its age from the record's."""
    m = records.memories(spark, d)
    status = F.when(F.col("index_status") == "pending", F.when(F.substring(F.md5("id"), 1, 1) < "8", "running").otherwise("pending")).when(F.col("index_status") == "failed", "failed").otherwise("complete")
    return m.select(
        "id", F.col("current_revision_id").alias("revision_id"), F.substring(F.md5("id"), 2, 1).alias("generation_id"), status.alias("status"),
        (F.ascii(F.substring(F.md5("id"), 3, 1)) % 4).alias("attempts"), "created_at", "updated_at",
    )


_JOBS = """jobs AS (SELECT id, current_revision_id AS revision_id, substr(md5(id), 2, 1) AS generation_id, CASE WHEN index_status = 'pending' THEN CASE WHEN substr(md5(id), 1, 1) < '8' THEN 'running' ELSE 'pending' END WHEN index_status = 'failed' THEN 'failed' ELSE 'complete' END AS status,
ascii(substr(md5(id), 3, 1)) % 4 AS attempts, created_at, updated_at FROM mem)"""


@query(f"WITH {_MEM}, {_JOBS} SELECT id, attempts + 1 AS attempts FROM jobs WHERE (status = 'pending' OR (status = 'running' AND updated_at < {_ts(NOW)} - INTERVAL 15 MINUTE)) AND attempts < 3 ORDER BY created_at, id LIMIT 100")
def claim_jobs(spark, d):
    return commands.claim(_jobs(spark, d), NOW, 100).select("id", "attempts")


@query(f"WITH {_MEM}, {_JOBS} SELECT id, CASE WHEN substr(md5(id), 4, 1) < '8' THEN 'complete' WHEN attempts < 3 THEN 'pending' ELSE 'failed' END AS status FROM jobs WHERE status = 'running'")
def finish_jobs(spark, d):
    jobs = _jobs(spark, d)
    ended = jobs.select("id", F.when(F.substring(F.md5("id"), 4, 1) >= "8", "out of memory").alias("error"))
    return commands.finish(jobs, ended, NOW).select("id", "status")


@query(f"WITH {_MEM}, {_JOBS} SELECT generation_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed FROM jobs GROUP BY 1")
def generation_progress(spark, d):
    return commands.progress(_jobs(spark, d))


@query(f"WITH {_MEM}, {_JOBS} SELECT m.id, CASE WHEN j.status = 'complete' THEN 'ready' WHEN j.status = 'failed' THEN 'failed' WHEN j.status IS NOT NULL THEN 'pending' ELSE m.index_status END AS index_status FROM mem m LEFT JOIN (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY revision_id ORDER BY updated_at DESC, id DESC) = 1) j ON j.revision_id = m.current_revision_id")
def mark_index_status(spark, d):
    return commands.index_status(records.memories(spark, d), _jobs(spark, d))


@query("""WITH v AS (SELECT DISTINCT ON (segment_id) segment_id, model_profile_id FROM memory_vectors)
SELECT segment_id, CASE WHEN substr(md5(segment_id), 1, 1) < '8' THEN 'new' ELSE model_profile_id END AS model_profile_id FROM v""")
def upsert_vectors(spark, d):
    """Half of the segments get vectors of a new profile; vectors of segments that are gone do not come in."""
    v = read(spark, d, "memory_vectors").select("segment_id", "model_profile_id").dropDuplicates(["segment_id"])
    fresh = v.filter(F.substring(F.md5("segment_id"), 1, 1) < "8").select("segment_id", F.lit("new").alias("model_profile_id"))
    gone = fresh.select(F.concat("segment_id", F.lit(":gone")).alias("segment_id"), "model_profile_id")
    return mutate.upsert(v, fresh.unionByName(gone), ["segment_id"], parents=v)


@query(f"WITH {_REV} SELECT id AS record_id, 1 AS n FROM rev WHERE substr(md5(id), 1, 1) < '4' UNION ALL SELECT id, 0 FROM rev WHERE substr(md5(id), 1, 1) >= '4'")
def replace_segments(spark, d):
    """A quarter of the revisions are indexed again; none keeps a segment of before."""
    ids = records.once(delivered(spark, d)).select("id")
    old = ids.select(F.col("id").alias("record_id"), F.lit(0).alias("n"))
    fresh = ids.filter(F.substring(F.md5("id"), 1, 1) < "4").select(F.col("id").alias("record_id"), F.lit(1).alias("n"))
    return mutate.replace(old, fresh, "record_id")


# -- reports and exports -------------------------------------------------------------------------

@query(f"""WITH {_BASE}, {_FB2}, {_RED2}, s AS (SELECT id FROM spaces WHERE deleted_at IS NULL), m AS (SELECT * FROM mem WHERE space_id IN (SELECT id FROM s))
SELECT (SELECT count(*) FROM m) AS memories, (SELECT count(*) FROM rev WHERE memory_id IN (SELECT id FROM m)) AS revisions, (SELECT count(*) FROM st WHERE memory_id IN (SELECT id FROM m)) AS state_events,
(SELECT count(*) FROM fb WHERE memory_id IN (SELECT id FROM m)) AS feedback, (SELECT count(*) FROM red WHERE source_memory_id IN (SELECT id FROM m)) AS redirects, (SELECT count(DISTINCT operation_id) FROM red WHERE source_memory_id IN (SELECT id FROM m)) AS merges,
(SELECT count(*) FROM m WHERE logical_key IS NOT NULL) AS logical_keys, (SELECT count(*) FROM m WHERE index_status = 'pending') AS pending_jobs""")
def status_scoped(spark, d):
    """The counts of a status report over the spaces in use."""
    scope = read(spark, d, "spaces").filter("deleted_at IS NULL").select(F.col("id").alias("space_id"))
    return snapshot.scoped_counts(records.memories(spark, d), records.once(delivered(spark, d, "memory_id")), records.events(spark, d), memory_feedback(spark, d), memory_redirects(spark, d), scope)


@query(f"""WITH {_BASE}, {_FB2}, {_RED2}, {_LINKS} SELECT 'space' AS kind, id FROM spaces UNION ALL SELECT 'memory', id FROM mem UNION ALL SELECT 'revision', id FROM rev UNION ALL SELECT 'event', id FROM st
UNION ALL SELECT 'feedback', id FROM fb UNION ALL SELECT 'redirect', id FROM red UNION ALL SELECT 'link', link_id FROM links UNION ALL SELECT DISTINCT 'merge', operation_id FROM red""")
def export_snapshot(spark, d):
    """Every row of the store as one JSON line, in a fixed order."""
    tables = {
        "space": read(spark, d, "spaces"), "memory": records.memories(spark, d), "revision": records.revisions(spark, d), "event": records.events(spark, d), "feedback": memory_feedback(spark, d),
        "redirect": memory_redirects(spark, d), "link": records.links(spark, d).withColumnRenamed("link_id", "id"), "merge": _operations(spark, d),
    }
    return snapshot.export_lines(tables).select("kind", "id")
