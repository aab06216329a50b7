"""The queries of the library over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchmill.functions import quality, tags, text
from parchmill.operators import accounts, chunking, control, documents, keywords, library, ranking, reconcile, settings
from parchmill.session import materialise, scratch_dir
from parchmill.sources import snapshots, tables
from parchmill.sources.tables import SQL
from parchmill.streaming import failures, sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Register a query; ctes names the stand-ins that its SQL uses."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH " + ", ".join(SQL[c] for c in ctes) + " " if ctes else "") + sql
        return f

    return add


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, embedding): every vector whose id is divisible by 50."""
    return tables.read(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest chunks of each of them, as ranked lists."""
    return ranking.nearest_of_all(asked(spark, sf_dir), tables.chunks(spark, sf_dir), 20, 64).withColumnRenamed("query_id", "list_no")


COSINE = "1 - list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
KNN = f"""q AS (SELECT vec_id AS list_no, embedding FROM embeddings WHERE vec_id % 50 = 0),
 d AS (SELECT q.list_no, c.chunk_id, c.document_id, {COSINE} AS distance FROM chunks c, q),
 r AS (SELECT *, row_number() OVER (PARTITION BY list_no ORDER BY distance, chunk_id) AS rank FROM d)"""


@query(
    f"SELECT c.chunk_id, c.document_id, round({COSINE}, 6) AS distance, row_number() OVER (ORDER BY {COSINE}, c.chunk_id)::INTEGER AS rank FROM chunks c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE c.label = (SELECT label FROM embeddings WHERE vec_id = 0) ORDER BY rank LIMIT 10",
    "chunks",
)
def knn_filtered_topk(spark, sf_dir):
    """The ten nearest chunks with the query's label, filtered before they are ranked."""
    e = tables.read(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding", "label").first()
    inside = tables.chunks(spark, sf_dir).filter(F.col("label") == e.label)
    return ranking.nearest(inside, [e.embedding], 10).select("chunk_id", "document_id", F.round("distance", 6).alias("distance"), "rank")


@query(None)
def knn_multi_query(spark, sf_dir):
    return lists(spark, sf_dir).select("list_no", "rank", "chunk_id", "document_id", F.round("distance", 6).alias("distance"))


ORACLES["knn_multi_query"] = f"WITH {SQL['chunks']}, {KNN} SELECT list_no, rank::INTEGER AS rank, chunk_id, document_id, round(distance, 6) AS distance FROM r WHERE rank <= 20"
@query(
    f"SELECT * FROM (SELECT q.vec_id AS query_id, c.chunk_id, c.document_id, round({COSINE}, 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE}, c.chunk_id)::INTEGER AS rank FROM chunks c, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 10",
    "chunks",
)
def knn_all_queries(spark, sf_dir):
    """Every vector whose id is divisible by 50 against all vectors."""
    return ranking.nearest_of_all(asked(spark, sf_dir), tables.chunks(spark, sf_dir), 10, 64).withColumn("distance", F.round("distance", 6))


FUSED = """f AS (SELECT chunk_id, any_value(document_id) AS document_id, sum(1.0 / (60 + rank)) AS rrf, min(list_no * 1000000 + rank) AS seen FROM r WHERE rank <= 20 GROUP BY chunk_id),
 t AS (SELECT document_id, max(rrf) AS best, min(seen) AS seen FROM f GROUP BY document_id ORDER BY round(best, 12) DESC, seen LIMIT 10)"""


@query(None)
def rrf_fusion(spark, sf_dir):
    """A ranked list for each query, fused; all fused chunks of the ten best documents."""
    return ranking.top_documents(ranking.fuse(lists(spark, sf_dir)), 10).select("chunk_id", "document_id", F.round("rrf_score", 9).alias("rrf_score"))


ORACLES["rrf_fusion"] = f"WITH {SQL['chunks']}, {KNN}, {FUSED} SELECT chunk_id, document_id, round(rrf, 9) AS rrf_score FROM f WHERE document_id IN (SELECT document_id FROM t)"


@query(None)
def source_assembly(spark, sf_dir):
    """One source for each of the ten best documents."""
    fused = materialise(ranking.top_documents(ranking.fuse(lists(spark, sf_dir)), 10), "fused")
    ids = fused.select(F.col("document_id").alias("id")).distinct()  # ten, so no text is shuffled
    docs = materialise(tables.docs(spark, sf_dir).join(F.broadcast(ids), "id", "left_semi"), "best-documents")
    words = fused.join(docs.select(F.col("id").alias("document_id"), "content"), "document_id", "left").select("chunk_id", F.col("content").alias("text"))
    return ranking.sources(fused, words, docs, "https://archive").withColumn("score", F.round("score", 9))


ORACLES["source_assembly"] = f"""WITH {SQL['chunks']}, {SQL['docs']}, {KNN}, {FUSED},
 b AS (SELECT document_id, max(rrf) AS score FROM f WHERE document_id IN (SELECT document_id FROM t) GROUP BY document_id),
 s AS (SELECT b.*, d.title, d.created, trim(regexp_replace(d.content, '\\s+', ' ', 'g')) AS flat FROM b LEFT JOIN docs d ON d.id = b.document_id)
SELECT document_id, title, created, CASE WHEN length(flat) > 280 THEN rtrim(left(flat, 280)) || '…' ELSE flat END AS snippet, round(score, 9) AS score, 'https://archive/documents/' || document_id || '/' AS url FROM s"""

BM25 = """u AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t, generate_subscripts(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), 1) AS i FROM documents),
 v AS (SELECT doc_id, t, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS t2 FROM u),
 c AS (SELECT doc_id, count(*) AS dl, count(*) FILTER (WHERE t = 'the') AS f0, count(*) FILTER (WHERE t = 'of' AND t2 = 'the') AS f1 FROM v GROUP BY doc_id),
 s AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (WHERE f0 > 0) AS n0, count(*) FILTER (WHERE f1 > 0) AS n1 FROM c),
 i AS (SELECT *, greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 1e-6) AS i0, greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 1e-6) AS i1 FROM s)"""


@query(f"""WITH {BM25} SELECT doc_id AS chunk_id, doc_id AS document_id, round(-(i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / m)) + i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / m))), 6) AS score
FROM c, i WHERE f0 > 0 AND f1 > 0 ORDER BY -(i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / m)) + i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / m))), chunk_id LIMIT 20""")
def keyword_bm25(spark, sf_dir):
    """Two phrases ANDed; the twenty best by BM25 over the whole table's statistics."""
    index = keywords.KeywordIndex.build(tables.text_chunks(spark, sf_dir))
    return keywords.keyword_search(index, [["the"], ["of", "the"]], 20).withColumn("score", F.round("score", 6))


HYBRID = f"""h AS (SELECT d.id, d.document_type_id, d.title, d.created, d.content, e.embedding FROM docs d JOIN embeddings e ON e.vec_id = d.id),
 hu AS (SELECT id, list_filter(regexp_split_to_array(strip_accents(lower(content)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM h),
 hv AS (SELECT id, len(w) AS dl, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS f FROM hu),
 hs AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (WHERE f > 0) AS df FROM hv),
 hq AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS list_no, embedding FROM embeddings WHERE vec_id % 50 = 0),
 hw AS (SELECT (SELECT count(*) FROM hq) AS list_no, hv.id, row_number() OVER (ORDER BY -greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / m)), hv.id) AS rank FROM hv JOIN h USING (id), hs WHERE f > 0 AND h.document_type_id = 2),
 hk AS (SELECT q.list_no, c.id, row_number() OVER (PARTITION BY q.list_no ORDER BY {COSINE}, c.id) AS rank FROM h c, hq q WHERE c.document_type_id = 2),
 hr AS (SELECT id, sum(1.0 / (60 + rank)) AS rrf, min(list_no * 1000000 + rank) AS seen FROM (SELECT * FROM hk WHERE rank <= 10 UNION ALL SELECT * FROM hw WHERE rank <= 10) GROUP BY id ORDER BY round(rrf, 12) DESC, seen LIMIT 10),
 hf AS (SELECT h.*, hr.rrf, trim(regexp_replace(h.content, '\\s+', ' ', 'g')) AS flat FROM hr JOIN h USING (id))"""


@query(f"WITH {SQL['docs']}, {SQL['taxonomy']}, {HYBRID} SELECT id AS document_id, title, NULL::VARCHAR AS correspondent, 'en' AS document_type, created, CASE WHEN length(flat) > 280 THEN rtrim(left(flat, 280)) || '…' ELSE flat END AS snippet, round(rrf, 9) AS score, 'https://archive/documents/' || id || '/' AS url FROM hf")
def hybrid_search(spark, sf_dir):
    """Filters, all vectors whose id is divisible by 50 and a phrase in one plan: fused lists, the ten best documents and their sources."""
    docs = tables.docs(spark, sf_dir)
    both = docs.join(tables.read(spark, sf_dir, "embeddings"), F.col("id") == F.col("vec_id")).select(F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), F.col("content").alias("text"), "embedding")
    given = {str(r.query_id): r.embedding for r in asked(spark, sf_dir).orderBy("query_id").collect()}  # a plan holds its vectors
    kinds = tables.taxonomy(spark, sf_dir).filter("kind = 'document_type'")
    engine = ranking.SearchEngine(both, keywords.KeywordIndex.build(both), docs, given.__getitem__, taxonomy=kinds, base_url="https://archive")
    plan = ranking.QueryPlan(tuple(given), ("of the",), (), ranking.SearchFilters(document_type_id=2))
    return engine.retrieve(plan).withColumn("score", F.round("score", 9))


@query("SELECT t AS term, count(DISTINCT doc_id) AS chunks, count(*) AS occurrences FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM documents) GROUP BY t")
def keyword_index(spark, sf_dir):
    """Builds the postings; the chunks and occurrences of every term in them."""
    index = keywords.KeywordIndex.build(tables.text_chunks(spark, sf_dir))
    return index.postings.groupBy("term").agg(F.sum("n").cast("long").alias("chunks"), (F.sum(F.octet_length("at")) / 4).cast("long").alias("occurrences"))


@query(
    "SELECT id, title, correspondent, document_type, created FROM (SELECT d.*, a.name AS correspondent, b.name AS document_type FROM docs d LEFT JOIN taxonomy a ON a.kind = 'correspondent' AND a.id = d.correspondent_id LEFT JOIN taxonomy b ON b.kind = 'document_type' AND b.id = d.document_type_id WHERE d.created >= '2021-01-01' AND d.created <= '2024-06-01') ORDER BY created DESC, id DESC LIMIT 24 OFFSET 24",
    "docs", "taxonomy",
)
def browse_page(spark, sf_dir):
    f = ranking.SearchFilters(date_from="2021-01-01", date_to="2024-06-01")
    page, _ = library.browse(tables.docs(spark, sf_dir), tables.taxonomy(spark, sf_dir), library.BrowseQuery(where=f.predicate(), offset=24))
    return page.select("id", "title", "correspondent", "document_type", "created")


@query("""SELECT p, id, place FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey DESC) - 1 AS place, count(*) OVER () AS n FROM orders) JOIN (VALUES (0, 0), (1, 1), (2, 9)) f(p, tenths) ON place BETWEEN n * tenths // 10 AND n * tenths // 10 + 99""")
def browse_deep_pages(spark, sf_dir):
    """Pages of a hundred orders by priority: the first, one after a tenth of all, one after nine tenths."""
    rows = tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    held, n = library.SortedPages.build(rows, "title"), rows.count()
    pages = [held.page(n * tenths // 10, 100).select(F.lit(p).alias("p"), "id", F.col("__at").alias("place")) for p, tenths in enumerate((0, 1, 9))]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


TEXT_SEARCH = "FROM docs d LEFT JOIN taxonomy a ON a.kind = 'correspondent' AND a.id = d.correspondent_id LEFT JOIN taxonomy b ON b.kind = 'document_type' AND b.id = d.document_type_id WHERE contains(translate(d.title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the of') OR contains(a.name, 'the of') OR contains(b.name, 'the of')"


@query(f"SELECT d.id, d.title {TEXT_SEARCH} ORDER BY d.title, d.id LIMIT 50", "docs", "taxonomy")
def browse_text_search(spark, sf_dir):
    q = library.BrowseQuery(text="The Of", sort="title", descending=False, limit=50)
    return library.browse(tables.docs(spark, sf_dir), tables.taxonomy(spark, sf_dir), q)[0].select("id", "title")


@query(f"SELECT count(*) AS total {TEXT_SEARCH}", "docs", "taxonomy")
def browse_count(spark, sf_dir):
    return library.browse(tables.docs(spark, sf_dir), tables.taxonomy(spark, sf_dir), library.BrowseQuery(text="The Of"))[1]


@query("SELECT kind, id, name FROM taxonomy", "taxonomy")
def facets(spark, sf_dir):
    return library.facets(tables.taxonomy(spark, sf_dir))


@query(
    "SELECT d.id, d.title, a.name AS correspondent, b.name AS document_type, coalesce((SELECT string_agg(t.name, ',' ORDER BY list_position(d.tag_ids, t.id)) FROM taxonomy t WHERE t.kind = 'tag' AND list_contains(d.tag_ids, t.id)), '') AS tags, d.created FROM docs d LEFT JOIN taxonomy a ON a.kind = 'correspondent' AND a.id = d.correspondent_id LEFT JOIN taxonomy b ON b.kind = 'document_type' AND b.id = d.document_type_id WHERE d.id IN (0, 3, 5, 77, 123, -1)",
    "docs", "taxonomy",
)
def document_lookup(spark, sf_dir):
    """Documents by id with all their names; ids that are not there are left out."""
    got = library.get_documents(tables.docs(spark, sf_dir), tables.taxonomy(spark, sf_dir), [0, 3, 5, 77, 123, -1])
    return got.withColumn("tags", F.array_join("tags", ","))


@query("SELECT doc_id AS chunk_id, doc_id AS document_id, text, NULL::INTEGER AS page_hint, 0.0::DOUBLE AS score FROM documents WHERE doc_id IN (1, 2, 150, -7)")
def chunk_lookup(spark, sf_dir):
    return library.get_chunks(tables.text_chunks(spark, sf_dir), [1, 2, 150, -7])


@query("SELECT kind, id, name FROM taxonomy WHERE kind = 'correspondent'", "taxonomy")
def taxonomy_list(spark, sf_dir):
    return library.get_taxonomy(tables.taxonomy(spark, sf_dir), "correspondent")


@query("SELECT setting, tag_id FROM (VALUES ('PRE', 1), ('POST', 3), ('ERROR', 8), ('CLAIM', 10)) v(setting, tag_id) WHERE tag_id NOT IN (SELECT unnest(tag_ids) FROM docs)", "docs")
def tag_preflight(spark, sf_dir):
    """Configured tags that no document has."""
    held = tables.docs(spark, sf_dir).select(F.explode("tag_ids").alias("id")).distinct().select(F.lit("tag").alias("kind"), "id", F.col("id").cast("string").alias("name"))
    return settings.missing_tags({"PRE": 1, "POST": 3, "ERROR": 8, "CLAIM": 10, "OTHER": None}, held).select("setting", F.col("tag_id").cast("int").alias("tag_id"))


@query("SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM chunks) AS chunks", "docs", "chunks")
def index_stats(spark, sf_dir):
    return library.stats(tables.docs(spark, sf_dir), tables.chunks(spark, sf_dir))


@query("SELECT min(nullif(created, '')) AS date_from, max(nullif(created, '')) AS date_to FROM docs", "docs")
def date_range(spark, sf_dir):
    return library.date_range(tables.docs(spark, sf_dir))


@query("SELECT id FROM docs WHERE list_has_all(tag_ids, [2, 14])", "docs")
def tag_all_match(spark, sf_dir):
    return tables.docs(spark, sf_dir).filter(ranking.SearchFilters(tag_ids=(2, 14)).predicate()).select("id")


@query("SELECT d.id, coalesce(array_to_string(list(t.name ORDER BY u.pos) FILTER (WHERE t.name IS NOT NULL), ','), '') AS tags FROM docs d, LATERAL (SELECT unnest(d.tag_ids) AS tag, unnest([1, 2]) AS pos) u LEFT JOIN taxonomy t ON t.kind = 'tag' AND t.id = u.tag GROUP BY d.id", "docs", "taxonomy")
def tag_name_resolution(spark, sf_dir):
    return library.tag_names(tables.docs(spark, sf_dir), tables.taxonomy(spark, sf_dir)).select("id", F.array_join("tag_names", ",").alias("tags"))


USAGE = "u AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS name, o_orderkey % 97 AS usage, o_orderkey AS position FROM orders)"


@query(f"WITH {USAGE} SELECT arg_min(name, position) AS name, max(usage) AS usage FROM u WHERE length(trim(name)) > 0 GROUP BY lower(name) ORDER BY usage DESC, lower(arg_min(name, position)) LIMIT 4")
def taxonomy_top_names(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority"))
    return library.top_names(o.select(name.alias("name"), (F.col("o_orderkey") % 97).alias("usage"), F.col("o_orderkey").alias("position")), 4)


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, trim(regexp_replace(regexp_replace(lower(p_name), '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS simple FROM part")
def taxonomy_match(spark, sf_dir):
    """Both keys under which names are matched."""
    return tables.read(spark, sf_dir, "part").select("p_partkey", text.normalise_key("p_name").alias("key"), text.normalise_simple("p_name").alias("simple"))


@query("SELECT vec_id // 3 AS id FROM embeddings WHERE vec_id // 3 NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0) GROUP BY 1")
def deletion_candidates(spark, sf_dir):
    """Stored documents that the source no longer has."""
    stored = tables.chunks(spark, sf_dir).select(F.col("document_id").alias("id")).distinct()
    source = tables.docs(spark, sf_dir).filter("id % 5 <> 0")
    return reconcile.sweep(stored, source, complete=True)


def _outcomes(spark, sf_dir):
    docs = tables.docs(spark, sf_dir)
    stored = docs.filter("id % 3 <> 0").select("id", F.when(F.col("id") % 4 == 0, F.lit("old")).otherwise(reconcile.content_hash("content")).alias("content_hash"), F.lit("m/64").alias("embed_key"))
    return reconcile.outcomes(docs, stored, "m/64", error_tag=15)


OUTCOME = "o AS (SELECT id, sha256(content) AS content_hash, CASE WHEN length(trim(content)) = 0 OR list_contains(tag_ids, 15) THEN 'SKIPPED' WHEN id % 3 <> 0 AND id % 4 <> 0 THEN 'METADATA_ONLY' ELSE 'INDEXED' END AS outcome FROM docs)"


@query(None)
def incremental_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("id", "content_hash", "outcome")


@query(None)
def sync_tally(spark, sf_dir):
    return reconcile.tally(_outcomes(spark, sf_dir))


ORACLES["incremental_outcomes"] = f"WITH {SQL['docs']}, {OUTCOME} SELECT id, content_hash, outcome FROM o"
ORACLES["sync_tally"] = f"WITH {SQL['docs']}, {OUTCOME} SELECT count(*) AS seen, count(*) FILTER (WHERE outcome = 'INDEXED') AS indexed, count(*) FILTER (WHERE outcome = 'METADATA_ONLY') AS metadata_only, count(*) FILTER (WHERE outcome = 'SKIPPED') AS skipped, 0::BIGINT AS failed FROM o"


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT') || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':30:00' || z.zone AS modified FROM orders JOIN (VALUES (0, '+00:00', 0), (1, '-02:00', 120), (2, '+05:30', -330), (3, 'Z', 0)) z(k, zone, minutes) ON o_orderkey % 4 = z.k
 WHERE o_orderdate + to_hours(o_orderkey % 24) + to_minutes(30 + z.minutes) > TIMESTAMP '1995-06-17 01:00:00'""")
def watermark_slice(spark, sf_dir):
    """Documents after a watermark, as instants: their times have several offsets."""
    o, k = tables.read(spark, sf_dir, "orders"), F.col("o_orderkey")
    zone = F.element_at(F.array(*map(F.lit, ["+00:00", "-02:00", "+05:30", "Z"])), (k % 4 + 1).cast("int"))
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":30:00"), zone)
    return reconcile.since(o.select(k.alias("id"), at.alias("modified")), "1995-06-16T23:00:00-02:00").select("id", "modified")


@query("SELECT strftime(max(o_orderdate) - INTERVAL 10 SECOND, '%Y-%m-%dT%H:%M:%S+00:00') AS watermark FROM orders")
def watermark_advance(spark, sf_dir):
    return reconcile.next_watermark(tables.read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("modified")))


@query("""SELECT id, failures FROM (SELECT coalesce(s.id, r.id) AS id, (coalesce(s.failures, 0) + CASE WHEN r.bad THEN 1 ELSE 0 END)::INTEGER AS failures, r.bad
 FROM (SELECT doc_id AS id, doc_id % 5 AS failures FROM documents WHERE doc_id % 2 = 0) s FULL JOIN (SELECT doc_id AS id, doc_id % 7 < 3 AS bad FROM documents WHERE doc_id % 3 = 0) r ON s.id = r.id) WHERE (bad IS NULL OR bad) AND failures < 5""")
def failed_retry_state(spark, sf_dir):
    """Failure counts after one cycle; a fifth failure leaves them."""
    return reconcile.fold_failures(*_failures(spark, sf_dir))


def _failures(spark, sf_dir):
    d = tables.docs(spark, sf_dir).select("id")
    state = d.filter("id % 2 = 0").withColumn("failures", (F.col("id") % 5).cast("int"))
    return state, d.filter("id % 3 = 0").withColumn("outcome", F.when(F.col("id") % 7 < 3, "FAILED").otherwise("INDEXED"))


@query("SELECT doc_id AS id, 5::INTEGER AS failures FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 = 4 AND doc_id % 3 = 0 AND doc_id % 7 < 3")
def dead_letters(spark, sf_dir):
    """Documents given up in one cycle."""
    return reconcile.dead_letters(*_failures(spark, sf_dir))


@query("SELECT doc_id + d.shift AS document_id, CASE WHEN d.shift = 0 THEN left(split_part(text, chr(10), 1), 40) END AS title, (doc_id % 5)::INTEGER AS failure_count FROM documents, (SELECT unnest([0, 10000000]) AS shift) d WHERE doc_id % 2 = 0")
def failed_documents(spark, sf_dir):
    """Failed documents with their titles, and some that were never stored."""
    state = _failures(spark, sf_dir)[0]
    return reconcile.failed_documents(state.unionByName(state.withColumn("id", F.col("id") + 10000000)), tables.docs(spark, sf_dir))


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0 AND NOT (doc_id % 700 >= 350)")
def retry_set(spark, sf_dir):
    """Failed documents that the page since the watermark does not hold."""
    page = reconcile.since(tables.docs(spark, sf_dir), "2020-12-15T00:00:00+00:00")
    return reconcile.retry_ids(_failures(spark, sf_dir)[0], page)


@query("SELECT doc_id, length(trim(text)) > 0 AS indexable, contains(text, '[OCR ERROR]') OR regexp_matches(text, '(?i)\\[[^\\]]*redacted[^\\]]*\\]') OR contains(lower(text), 'i cannot assist') AS has_errors, lang IN ('na', 'none', 'other') AS generic FROM documents")
def quality_gate(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    return d.select("doc_id", quality.is_indexable("text", F.array().cast("array<bigint>"), None).alias("indexable"), quality.has_ocr_errors("text").alias("has_errors"), quality.is_generic_type("lang").alias("generic"))


@query("SELECT conv_id, turn, regexp_matches(x, '(?i)\\[[^\\]]*redacted[^\\]]*\\]') OR contains(lower(x), 'i can''t assist') OR contains(lower(x), 'i cannot assist') AS refusal FROM (SELECT *, CASE conv_id % 9 WHEN 0 THEN text || ' [Name REDACTED]' WHEN 1 THEN 'I CANNOT assist. ' || text WHEN 2 THEN text || ' I can''t assist' ELSE text END AS x FROM conversations)")
def refusal_scan(spark, sf_dir):
    c, k = tables.read(spark, sf_dir, "conversations"), F.col("conv_id") % 9
    x = F.when(k == 0, F.concat("text", F.lit(" [Name REDACTED]"))).when(k == 1, F.concat(F.lit("I CANNOT assist. "), "text")).when(k == 2, F.concat("text", F.lit(" I can't assist"))).otherwise(F.col("text"))
    return c.withColumn("x", x).select("conv_id", "turn", quality.is_refusal("x").alias("refusal"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS simple FROM documents")
def normalise_simple(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", text.normalise_simple("text").alias("simple"))


@query("SELECT c_custkey, trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(c_name || CASE c_custkey % 4 WHEN 0 THEN ' Ltd.' WHEN 1 THEN ' Co. Inc' WHEN 2 THEN ' & Sons' ELSE '' END), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), '( (ab|as|bv|co|company|corp|corporation|gmbh|inc|incorporated|limited|llc|ltd|oy|plc|sa|sarl|spa))+$', '')) AS company FROM customer")
def normalise_company(spark, sf_dir):
    c, k = tables.read(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    end = F.when(k == 0, " Ltd.").when(k == 1, " Co. Inc").when(k == 2, " & Sons").otherwise("")
    return c.select("c_custkey", text.normalise_company(F.concat("c_name", end)).alias("company"))


@query("""WITH w AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 2 = 0 THEN '2024' ELSE '2025' END AS year, list_concat(string_split_regex(trim(text), '\\s+'), ['AI', ' New ', upper(source), lang || ' ', '2024', 'gb']) AS raw FROM documents),
 u AS (SELECT doc_id, source, lang, year, lower(trim(unnest(raw))) AS k, generate_subscripts(raw, 1) AS i FROM w),
 f AS (SELECT doc_id, year, k, min(i) AS i FROM u WHERE k NOT IN ('', 'ai', 'error', 'indexed', 'new', 'gpt-a', 'gpt-b', 'gb') AND k <> source AND k <> lang AND k <> year GROUP BY doc_id, year, k),
 g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT w.doc_id, 'gpt-a,gpt-b,' || w.year || ',gb' || coalesce(',' || string_agg(g.k, ',' ORDER BY g.n), '') AS tags FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.n <= 3 GROUP BY w.doc_id, w.year""")
def tag_rules(spark, sf_dir):
    """All words of each text as tags: blacklist, redundancy and enrichment in turn."""
    d = tables.read(spark, sf_dir, "documents")
    more = [F.lit("AI"), F.lit(" New "), F.upper("source"), F.concat("lang", F.lit(" ")), F.lit("2024"), F.lit("gb")]
    raw = F.concat(F.split(text.strip("text"), r"\s+"), F.array(*more))
    date = F.when(F.col("doc_id") % 2 == 0, "2024-05-06T00:00:00").otherwise("nonsense")
    out = tags.ruled(raw, F.col("source"), F.col("lang"), F.lit(""), F.concat("text", F.lit("\n\nTranscribed by model: gpt-a, GPT-A, gpt-b")), date, "GB", 3, "2025-01-15")
    return d.select("doc_id", F.array_join(out, ",").alias("tags"))


@query("""SELECT conv_id, string_agg(CASE WHEN n > 1 THEN '--- Page ' || (turn + 1) || ' ---' || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Transcribed by model: ' || array_to_string(list_sort(list_distinct(list(role))), ', ') AS full_text
 FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE length(trim(text)) > 0 GROUP BY conv_id""")
def page_assembly(spark, sf_dir):
    """Turns as pages, roles as models."""
    c = tables.read(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("turn") + 1).alias("page"), "text", F.col("role").alias("model")))).alias("pages"), F.count("*").alias("n"))
    return g.select("conv_id", text.assemble_pages("pages", F.col("n")).alias("full_text"))


@query("SELECT doc_id, left(text, 500) || CASE WHEN doc_id % 2 = 0 AND length(text) + 27 > 500 THEN chr(10) || chr(10) || 'Transcribed by model: x-1' WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Transcribed by model: x-1' ELSE '' END AS cut FROM documents")
def truncate_chars(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    x = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n\nTranscribed by model: x-1"))).otherwise(F.col("text"))
    return d.select("doc_id", text.truncate_chars(x, 500).alias("cut"))


@query("SELECT doc_id, CASE WHEN length(f) > 280 THEN rtrim(left(f, 280)) || '…' ELSE f END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)")
def snippet(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", text.snippet("text").alias("snippet"))


PAGE = "'--- Page ' || i || ' ---' || chr(10) || l[i] || chr(10)"


@query(f"""SELECT doc_id, array_to_string([({PAGE}) FOR i IN (CASE WHEN n <= 4 THEN range(1, n + 1) ELSE [1, 2, 3, n] END)], '') AS cut,
 CASE WHEN n > 4 THEN 'NOTE: The document transcription below was truncated to reduce cost. Included pages (from OCR headers): 1-3, ' || n || '. Total pages with OCR headers: ' || n || '.' END AS note FROM (SELECT doc_id, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) AS n FROM documents)""")
def truncate_pages(spark, sf_dir):
    """Each line of a text as a page: the first three and the last one."""
    d = tables.read(spark, sf_dir, "documents")
    pages = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), x, F.lit("\n")))
    cut, note = text.truncate_pages(F.col("x"), 3, 1, 1000)
    return d.select("doc_id", F.array_join(pages, "").alias("x")).select("doc_id", cut.alias("cut"), note.alias("note"))


@query(None)
def chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(tables.docs(spark, sf_dir).select("id", "content"))


@query(None)
def embed_documents(spark, sf_dir):
    """Chunks with hashed embeddings."""
    c = chunking.chunk_documents(tables.docs(spark, sf_dir).select("id", "content"))
    return chunking.embed_chunks(c, lambda texts: [chunking.hash_embedding(t) for t in texts]).select("document_id", "chunk_index", F.size("embedding").alias("width"), "error")


@query("SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN lang WHEN 2 THEN 'und' WHEN 3 THEN NULL ELSE 'und' END AS code FROM documents")
def language_codes(spark, sf_dir):
    d, k = tables.read(spark, sf_dir, "documents"), F.col("doc_id") % 5
    x = F.when(k == 0, F.concat(F.lit(" "), F.upper("lang"))).when(k == 1, F.concat("lang", F.lit("-XX"))).when(k == 2, "english").when(k == 3, "").otherwise("und")
    return d.select("doc_id", "lang", text.language_code(x).alias("code"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def date_parse(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    x = F.when(k == 0, F.date_format("o_orderdate", " yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return tables.read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(text.iso_date(x), "yyyy-MM-dd").alias("day"))


@query("SELECT user_id, query, id, n::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS n FROM (SELECT user_id, query, max(created_at) AS created_at, arg_max(id, (created_at, id)) AS id FROM (SELECT user_id, event_type || '-' || (event_id % 13) AS query, ts AS created_at, event_id AS id FROM events) GROUP BY user_id, query)) WHERE n <= 20")
def recent_searches_topn(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    rows = e.select("user_id", F.concat_ws("-", "event_type", (F.col("event_id") % 13).cast("string")).alias("query"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    return control.recent_searches(rows).select("user_id", "query", "id", "n")


NOW = "(SELECT max(ts) FROM events)"
STATES = f"s AS (SELECT k.name, CASE WHEN b.t IS NULL OR epoch({NOW}) - epoch(b.t) > 5000 THEN 'stopped' WHEN b.name = 'click' THEN 'idle' ELSE 'running' END AS state FROM (SELECT unnest(['click', 'purchase', 'signup', 'never']) AS name) k LEFT JOIN (SELECT event_type AS name, date_trunc('second', max(ts)) AS t FROM events GROUP BY 1) b USING (name))"


def _states(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    beats = e.groupBy(F.col("event_type").alias("name")).agg(F.max("ts").alias("t"), F.count("*").alias("processed_count"))
    beats = beats.select("name", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss").alias("last_heartbeat"), F.when(F.col("name") == "click", " idle ").otherwise("busy").alias("detail"), "processed_count")
    return control.latest_heartbeats(beats, ["click", "purchase", "signup", "never"], now, 5000).select("name", "state")


@query(f"WITH {STATES} SELECT name, state FROM s")
def daemon_state(spark, sf_dir):
    return _states(spark, sf_dir)


@query(f"WITH {STATES} SELECT CASE WHEN count(*) FILTER (WHERE state = 'stopped') = 0 THEN 'ok' WHEN count(*) FILTER (WHERE state = 'stopped') = count(*) THEN 'down' ELSE 'degraded' END AS health FROM s")
def overall_health(spark, sf_dir):
    return control.overall_health(_states(spark, sf_dir))


@query("SELECT event_id AS id, event_id * 2 AS indexed, NULL::BIGINT AS bad, trunc(value)::BIGINT AS cut, (event_id % 2)::BIGINT AS flag, event_id AS said FROM events ORDER BY event_id DESC LIMIT 50")
def activity_summary(spark, sf_dir):
    """Numbers of the newest fifty summaries: fractions are cut, true is 1, digits count; other values are left out."""
    k = F.col("event_id")
    held = F.struct((k * 2).alias("indexed"), F.lit("x1").alias("bad"), F.col("value").alias("cut"), (k % 2 == 1).alias("flag"), F.concat(F.lit(" "), k.cast("string")).alias("said"), F.array(k).alias("list"))
    m = control.summary_numbers("summary")
    e = tables.read(spark, sf_dir, "events").select(k.alias("id"), F.to_json(held).alias("summary"))
    return e.orderBy(F.desc("id")).limit(50).select("id", *[F.try_element_at(m, F.lit(c)).alias(c) for c in ("indexed", "bad", "cut", "flag", "said")])


@query("SELECT s_suppkey AS id, 'u' || s_suppkey AS username, 'member' AS role FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 = 2")
def live_sessions(spark, sf_dir):
    """Sessions that are live: not ended, readable, with an active user."""
    s, k = tables.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id")), F.col("user_id")
    ends = F.when(k % 4 == 0, "2020-01-01T00:00:00+00:00").when(k % 4 == 1, "soon").when(k % 4 == 2, "2030-01-01T00:00:00+02:00")
    users = s.select(k.alias("id"), F.concat(F.lit("u"), k.cast("string")).alias("username"), F.lit("member").alias("role"), F.when(k % 3 == 0, "suspended").otherwise("active").alias("status"))
    return control.live_sessions(s.withColumn("expires_at", ends), users, F.lit("2024-06-01T00:00:00+00:00").cast("timestamp")).select(k.alias("id"), "username", "role")


@query("SELECT id, array_to_string(list_sort(list_distinct(list_concat(list_filter(tag_ids, lambda x: x NOT IN (1, 12)), [99]))), ',') AS tags FROM docs", "docs")
def array_set_algebra(spark, sf_dir):
    return tables.docs(spark, sf_dir).select("id", F.array_join(tags.swap("tag_ids", [1, 12], [99]).cast("array<string>"), ",").alias("tags"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'read,search' WHEN 1 THEN 'write' WHEN 2 THEN '' ELSE 'read,admin' END AS scopes FROM customer")
def scope_check(spark, sf_dir):
    k = F.col("c_custkey") % 4
    x = F.when(k == 0, "search, read,other").when(k == 1, "write,write").when(k == 2, "").otherwise("admin,read")
    return tables.read(spark, sf_dir, "customer").select("c_custkey", F.array_join(control.scopes(x), ",").alias("scopes"))


@query("SELECT c_custkey, c_custkey % 4 IN (1, 2) AS allowed FROM customer")
def role_check(spark, sf_dir):
    k = F.col("c_custkey") % 4
    role = F.when(k == 0, "readonly").when(k == 1, "member").when(k == 2, "admin").otherwise("root")
    return tables.read(spark, sf_dir, "customer").select("c_custkey", control.role_allows(role, "member").alias("allowed"))


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 2 END AS first_list, round(1.0 / (60 + vec_id % 17), 9) AS rrf_score FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def merge_rounds(spark, sf_dir):
    e = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.round(1.0 / (60 + F.col("vec_id") % 17), 9).alias("rrf_score"))
    one, two = (e.filter(f"chunk_id % {m} = 0").withColumn("first_list", F.lit(i)) for i, m in ((1, 2), (2, 3)))
    return ranking.merge_rounds(one, two)


@query("SELECT s_suppkey AS id, 'member' AS role FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 NOT IN (1, 2)")
def key_validity(spark, sf_dir):
    """API keys that are live: not revoked, not expired, owner active."""
    s, k = tables.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), F.col("id") % 5
    keys = s.withColumn("owner_user_id", F.col("id")).withColumn("revoked_at", F.when(F.col("id") % 4 == 0, "2024-01-01")).withColumn("expires_at", F.when(k == 1, "2020-01-01T00:00:00+00:00").when(k == 2, "soon").when(k == 3, "2030-01-01T00:00:00+00:00"))
    users = s.withColumn("status", F.when(F.col("id") % 3 == 0, "suspended").otherwise("active")).withColumn("role", F.lit("member"))
    return control.valid_keys(keys, users, F.lit("2024-06-01T00:00:00+00:00").cast("timestamp")).select("id", "role")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS active, count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0) AS admins, count(*) FILTER (WHERE c_custkey % 3 = 0) AS suspended FROM customer")
def user_counts(spark, sf_dir):
    k = F.col("c_custkey")
    return control.user_counts(tables.read(spark, sf_dir, "customer").select(F.when(k % 3 == 0, "suspended").otherwise("active").alias("status"), F.when(k % 2 == 0, "admin").otherwise("member").alias("role")))


@query("SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 172800 THEN 'yesterday' WHEN s < 604800 THEN (s // 86400) || ' days ago' ELSE (s // 604800) || CASE WHEN s // 604800 = 1 THEN ' week ago' ELSE ' weeks ago' END END AS label FROM (SELECT event_id, (floor(epoch(now_)) - floor(epoch(ts)))::BIGINT AS s FROM events, (SELECT max(ts) AS now_ FROM events))")
def relative_time(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    return e.select("event_id", text.relative_time(F.col("ts"), F.lit(e.agg(F.max("ts")).first()[0])).alias("label"))


@query("SELECT conv_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM (SELECT conv_id, min(turn) AS a, max(turn) AS b FROM (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations WHERE turn % 3 <> 1) GROUP BY conv_id, g) GROUP BY conv_id")
def page_ranges(spark, sf_dir):
    c = tables.read(spark, sf_dir, "conversations").filter("turn % 3 <> 1")
    return c.groupBy("conv_id").agg(F.collect_list("turn").alias("p")).select("conv_id", text.page_ranges("p").alias("ranges"))


@query("SELECT id, title FROM docs WHERE list_contains(tag_ids, 3) AND NOT list_contains(tag_ids, 12) AND NOT list_contains(tag_ids, 14)", "docs")
def queue_filter(spark, sf_dir):
    return documents.queue(tables.docs(spark, sf_dir), 3, 12, 14)[0].select("id", "title")


@query("SELECT id, array_to_string(list_filter(tag_ids, lambda x: x <> 3), ',') AS tags FROM docs WHERE list_contains(tag_ids, 3) AND list_contains(tag_ids, 12)", "docs")
def queue_stale_tags(spark, sf_dir):
    stale = documents.queue(tables.docs(spark, sf_dir), 3, 12, 14)[1]
    return stale.select("id", F.array_join(F.col("tag_ids").cast("array<string>"), ",").alias("tags"))


@query("SELECT id, array_to_string(list_sort(list_distinct(list_concat(list_filter(tag_ids, lambda x: x <> 12), [2]))), ',') AS tags FROM docs WHERE list_contains(tag_ids, 12)", "docs")
def stale_locks(spark, sf_dir):
    return documents.stale_locks(tables.docs(spark, sf_dir), 12, 2).select("id", F.array_join(F.col("tag_ids").cast("array<string>"), ",").alias("tags"))


@query("SELECT 'correspondent' AS kind, CASE WHEN id % 2 = 0 THEN name ELSE upper(name) || '!' END AS name, id FROM taxonomy WHERE kind = 'correspondent'", "taxonomy")
def filter_resolution(spark, sf_dir):
    """Candidate names to ids: exact, else by key; what matches nothing is left out."""
    t = tables.taxonomy(spark, sf_dir)
    some = t.filter("kind = 'correspondent'").select("kind", F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.concat(F.upper("name"), F.lit("!"))).alias("name"))
    none = some.select("kind", F.concat(F.lit("no such "), "name").alias("name"))
    return documents.match_names(some.unionByName(none), t)


WANTED = """w AS (SELECT 'correspondent' AS kind, CASE c_custkey % 3 WHEN 0 THEN upper(c_mktsegment) || ' Trading ' || (c_custkey % 40 + 10) || ' Ltd' WHEN 1 THEN 'House of src' || (c_custkey % 7) ELSE c_mktsegment || ' trading ' || (c_custkey % 40 + 10) || CASE WHEN c_custkey % 2 = 0 THEN ' and Partners' ELSE '.' END END AS name, c_custkey AS position FROM customer),
 k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]', '', 'g'), '( ltd)+$', '')) AS key FROM w),
 t AS (SELECT name AS entry, min(id) AS id FROM taxonomy WHERE kind = 'correspondent' GROUP BY name),
 f AS (SELECT key, arg_min(id, id) AS id FROM (SELECT DISTINCT key FROM k), t WHERE contains(key, entry) OR contains(entry, key) GROUP BY key),
 m AS (SELECT key, min(position) AS position FROM k WHERE key NOT IN (SELECT key FROM f) GROUP BY key),
 r AS (SELECT a.key, arg_min(b.key, b.position) AS lead FROM m a, m b WHERE b.position < a.position AND (contains(a.key, b.key) OR contains(b.key, a.key)) GROUP BY a.key),
 n AS (SELECT key, 1000 + row_number() OVER (ORDER BY position) - 1 AS id FROM m WHERE key NOT IN (SELECT key FROM r))"""


@query(None)
def taxonomy_get_or_create(spark, sf_dir):
    """Names of correspondents: some hold a known one, some are spellings of one another, some hold an earlier new one."""
    c, k = tables.read(spark, sf_dir, "customer"), F.col("c_custkey")
    n = (k % 40 + 10).cast("string")
    name = F.when(k % 3 == 0, F.concat(F.upper("c_mktsegment"), F.lit(" Trading "), n, F.lit(" Ltd"))).when(k % 3 == 1, F.concat(F.lit("House of src"), (k % 7).cast("string"))).otherwise(F.concat("c_mktsegment", F.lit(" trading "), n, F.when(k % 2 == 0, " and Partners").otherwise(".")))
    return documents.get_or_create(c.select(F.lit("correspondent").alias("kind"), name.alias("name"), k.alias("position")), tables.taxonomy(spark, sf_dir), 1000)[0]


ORACLES["taxonomy_get_or_create"] = f"WITH {SQL['taxonomy']}, {WANTED} SELECT DISTINCT k.kind, k.name, coalesce(f.id, n.id, o.id) AS id FROM k LEFT JOIN f USING (key) LEFT JOIN n USING (key) LEFT JOIN r USING (key) LEFT JOIN n o ON o.key = r.lead"


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey WHEN 1 THEN 7 WHEN 2 THEN 2 ELSE 0 END AS usage FROM supplier")
def usage_counts(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    count = F.when(k == 0, F.col("s_suppkey").cast("string")).when(k == 1, "many")
    return tables.read(spark, sf_dir, "supplier").select("s_suppkey", documents.usage_count(count, F.when(k == 1, "7"), F.when(k == 2, F.array(F.lit(1), F.lit(2)))).alias("usage"))


@query("""SELECT doc_id AS id, CASE doc_id % 10 WHEN 0 THEN 'error_tag' WHEN 1 THEN 'requeue' WHEN 2 THEN 'refusal' WHEN 3 THEN 'empty' WHEN 4 THEN 'generic' WHEN 5 THEN 'refusal' ELSE 'applied' END AS disposition,
 CASE WHEN doc_id % 10 > 5 THEN 'm-1,' || CASE WHEN doc_id % 2 = 0 THEN '2024' ELSE '2019' END || ',invoice tag' END AS tags,
 CASE WHEN doc_id % 10 IN (6, 7) THEN 'NOTE: The document transcription below was truncated to reduce cost. Included pages (from OCR headers): 1-3, 5-6. Total pages with OCR headers: 6.|' || CASE WHEN doc_id % 10 = 7 THEN 'NOTE: The document transcription below was further truncated to the first 60 characters due to the max character limit.' ELSE '' END WHEN doc_id % 10 IN (4, 8, 9) THEN CASE WHEN length(text) + 7 > 15000 THEN 'NOTE: The document transcription below was truncated because page headers were not found. Included the first 15000 characters.|' ELSE 'case|' END END AS title FROM documents""")
def classification(spark, sf_dir):
    """Gates, cuts, a scripted model that tells the notes it got, and the tag rules."""
    k = F.col("doc_id") % 10
    body = F.concat(F.lit("case "), k.cast("string"), F.lit(" "))
    body = F.when(k == 2, F.concat(F.lit("I cannot assist. "), "text")).when(k == 5, F.concat("text", F.lit(" [Name REDACTED] "), body)).when(k.isin(6, 7), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("--- Page "), i.cast("string"), F.lit(" ---\nline\n"))), "")).otherwise(F.concat(body, "text"))
    content = F.when(k == 1, " \n").otherwise(F.concat(body, F.lit("\n\nTranscribed by model: m-1")))
    d = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), content.alias("content"), F.when(k == 0, F.array(F.lit(9).cast("bigint"))).alias("tag_ids"), F.when(F.col("doc_id") % 2 == 0, "2024-03-01").otherwise("2019-07-07T00:00:00").alias("created"), k.alias("k"))
    some = [documents.classify(d.filter(where), _scripted, tail_pages=2, error_tag=9, max_chars=most) for where, most in (("k = 7", 60), ("k <> 7", 0))]
    return some[0].unionByName(some[1]).select("id", "disposition", F.array_join("tags", ",").alias("tags"), "title")


def _scripted(prompt: str) -> str:
    if "case 3 " in prompt[:400]:
        return "no json"
    kind = "Document" if "case 4 " in prompt[:400] else "Invoice"
    notes = [x for x in prompt.split("\n") if x.startswith("NOTE: ")] or ["case"]
    return 'Sure: {"title": "%s", "correspondent": null, "tags": ["Invoice", "Invoice Tag", "AI"], "document_date": "later", "document_type": "%s", "language": "EN"}' % ("|".join([*notes, ""][:2]), kind)


@query("""SELECT conv_id AS id, string_agg(CASE WHEN n > 1 THEN '--- Page ' || (turn + 1) || ' ---' || chr(10) ELSE '' END || CASE WHEN m = 'broken' THEN '[OCR ERROR] Failed to OCR page ' || (turn + 1) || '.' ELSE text END, chr(10) || chr(10) ORDER BY turn)
 || coalesce(chr(10) || chr(10) || 'Transcribed by model: ' || string_agg(DISTINCT CASE m WHEN 'first' THEN 'a' WHEN 'second' THEN 'b' END, ', ' ORDER BY CASE m WHEN 'first' THEN 'a' WHEN 'second' THEN 'b' END), '') AS content
 FROM (SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS text, count(*) OVER (PARTITION BY conv_id) AS n, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'broken' WHEN (conv_id + turn) % 5 = 0 OR (conv_id + turn) % 11 = 0 THEN 'second' ELSE 'first' END AS m FROM conversations) GROUP BY conv_id""")
def ocr_pages(spark, sf_dir):
    """Turns as page images: the first model refuses or redacts some, a page that breaks is marked."""
    c = tables.read(spark, sf_dir, "conversations")
    mark = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "broken").when((F.col("conv_id") + F.col("turn")) % 5 == 0, "refuse").when((F.col("conv_id") + F.col("turn")) % 11 == 0, "hide").otherwise("")
    pages = c.select(F.col("conv_id").alias("id"), (F.col("turn") + 1).cast("int").alias("page"), F.concat(mark, F.lit("|"), "text").cast("binary").alias("image"))
    return documents.transcribe(pages, [("a", _reader_a), ("b", _reader_b)]).select("id", "content")


def _reader_a(image: bytes) -> str:
    mark, _, said = image.decode().partition("|")
    if mark == "broken":
        raise ValueError("broken image")
    return {"refuse": "I cannot assist", "hide": f"{said} [Name REDACTED]"}.get(mark, said)


def _reader_b(image: bytes) -> str:
    return image.decode().partition("|")[2]


@query("SELECT p_brand AS key, CASE WHEN hash_ = 0 THEN 'own' WHEN hash_ = 1 THEN 'env' ELSE 'd' END AS value, CASE WHEN hash_ = 0 THEN 'stored' WHEN hash_ = 1 THEN 'environment' ELSE 'default' END AS source FROM (SELECT p_brand, min(p_partkey) % 3 AS hash_ FROM part GROUP BY p_brand)")
def settings_precedence(spark, sf_dir):
    k = tables.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key")).agg((F.min("p_partkey") % 3).alias("m"))
    return documents.settings_view(k.select("key", F.lit("d").alias("default")), k.filter("m < 2").select("key", F.lit("env").alias("value")), k.filter("m = 0").select("key", F.lit("own").alias("value")))


@query("SELECT conv_id AS document_id, '[' || conv_id || ']' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def prompt_context(spark, sf_dir):
    return documents.contexts(tables.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), "text"))


@query("SELECT id, title, correspondent_id FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 'new ' || title ELSE title END AS title, correspondent_id FROM docs WHERE id % 5 <> 0)", "docs")
def snapshot_rewrite(spark, sf_dir):
    """Metadata update of some rows and deletion of others, as the store's anti joins do them."""
    base = tables.docs(spark, sf_dir).select("id", "title", "correspondent_id")
    patch = base.filter("id % 4 = 0").withColumn("title", F.concat(F.lit("new "), "title"))
    return snapshots.delete(snapshots.update_columns(base, patch, "id", ["title"]), base.filter("id % 5 = 0"), "id")


@query("SELECT id, content_hash FROM (SELECT id, CASE WHEN id % 3 = 0 THEN sha256(title) ELSE sha256(content) END AS content_hash FROM docs)", "docs")
def snapshot_upsert(spark, sf_dir):
    d = tables.docs(spark, sf_dir)
    base = d.select("id", reconcile.content_hash("content").alias("content_hash"))
    return snapshots.upsert(base, d.filter("id % 3 = 0").select("id", reconcile.content_hash("title").alias("content_hash")), "id")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'username' WHEN 2 THEN 'password,email' ELSE 'role' END AS errors FROM customer")
def account_errors(spark, sf_dir):
    c, k = tables.read(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    name = F.when(k == 1, "a b").otherwise(F.concat(F.lit("user."), F.col("c_custkey").cast("string")))
    errors = control.account_errors(name, F.when(k == 2, "short").otherwise("long enough"), F.col("c_name"), F.when(k == 2, "no mail").when(k == 3, "a@b.co"), F.when(k == 3, "root").otherwise("member"))
    return c.select("c_custkey", F.array_join(errors, ",").alias("errors"))


@query("SELECT c_custkey, sha256(c_name) AS digest FROM customer")
def key_digests(spark, sf_dir):
    return tables.read(spark, sf_dir, "customer").select("c_custkey", control.key_digest("c_name").alias("digest"))


@query("SELECT event_id, coalesce(floor(epoch(now_)) - floor(epoch(ts)) >= 60, true) AS touch FROM events, (SELECT max(ts) AS now_ FROM events)")
def touch_throttle(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    return e.select("event_id", control.should_touch(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(e.agg(F.max("ts")).first()[0])).alias("touch"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '1:old,7:new' WHEN c_custkey % 3 = 1 THEN '7:new,2:kept' ELSE '7:new' END AS fields FROM customer")
def custom_fields(spark, sf_dir):
    """A field replaced in its place, or appended."""
    c, k = tables.read(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    held = lambda *pairs: F.array(*[F.struct(F.lit(i).cast("bigint").alias("field"), F.lit(v).alias("value")) for i, v in pairs])
    fields = tags.upsert_field(F.when(k == 0, held((1, "old"))).when(k == 1, held((7, "was"), (2, "kept"))), 7, F.lit("new"))
    return c.select("c_custkey", F.array_join(F.transform(fields, lambda f: F.concat_ws(":", f["field"].cast("string"), f["value"])), ",").alias("fields"))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region")
def conditional_insert(spark, sf_dir):
    """Regions go into an empty table, and not into the nations."""
    n = tables.read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    r = tables.read(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast("int").alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return control.insert_if_empty(n, r).unionByName(control.insert_if_empty(n.filter("n_nationkey < 0"), r))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'renamed' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def sparse_update(spark, sf_dir):
    c, k = tables.read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("c_custkey")
    name = F.when(k % 3 == 0, F.create_map(F.lit("c_name"), F.lit("renamed"))).otherwise(F.create_map().cast("map<string,string>"))
    segment = F.when(k % 5 == 0, F.create_map(F.lit("c_mktsegment"), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return control.sparse_update(c, c.select("c_custkey", F.map_concat(name, segment).alias("fields")), "c_custkey")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts)::VARCHAR IS NOT NULL AS seen FROM events GROUP BY user_id")
def config_latest(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return control.keep_latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", F.col("ts").isNotNull().alias("seen"))


@query("SELECT id, cycle, coalesce(sum(f) OVER (PARTITION BY id, g ORDER BY cycle), 0)::INTEGER AS failures FROM (SELECT *, sum(1 - f) OVER (PARTITION BY id ORDER BY cycle) AS g FROM (SELECT user_id AS id, event_id AS cycle, CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS f FROM events))")
def consecutive_failures(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    return control.consecutive_failures(e.select(F.col("user_id").alias("id"), F.col("event_id").alias("cycle"), (F.col("event_id") % 3 != 0).alias("failed")))


@query("""SELECT id, event, failures, count(*) AS n FROM (SELECT id, CASE WHEN f = 0 THEN 'done' WHEN r % 5 = 0 THEN 'given_up' ELSE 'failed' END AS event, (CASE WHEN f = 0 THEN 0 ELSE (r - 1) % 5 + 1 END)::INTEGER AS failures
 FROM (SELECT *, sum(f) OVER (PARTITION BY id, g ORDER BY cycle) AS r FROM (SELECT *, sum(1 - f) OVER (PARTITION BY id ORDER BY cycle) AS g FROM (SELECT user_id AS id, event_id AS cycle, CASE WHEN event_id % 7 <> 0 THEN 1 ELSE 0 END AS f FROM events)))) GROUP BY ALL""")
def streaming_failures(spark, sf_dir):
    """Outcomes as a stream in two batches: failures in a row as keyed state, the fifth is given up."""
    e, root = tables.read(spark, sf_dir, "events"), scratch_dir(spark, "streaming-failures")
    results = e.select(F.col("user_id").alias("id"), F.when(F.col("event_id") % 7 != 0, "FAILED").otherwise("INDEXED").alias("outcome"), F.lpad(F.col("event_id").cast("string"), 15, "0").alias("cycle"))
    half = e.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    first = F.col("event_id") <= half
    for i, part in enumerate([e.filter(first), e.filter(~first)]):
        ids = part.select(F.lpad(F.col("event_id").cast("string"), 15, "0").alias("cycle"))
        results.join(ids, "cycle", "left_semi").write.mode("append").parquet(f"{root}/in")
        events = failures.failure_events(spark.readStream.schema(failures.RESULTS).parquet(f"{root}/in"), seconds=86400)
        write = lambda batch, n, i=i: batch.write.mode("overwrite").parquet(f"{root}/out/run={i}-{n}")
        events.writeStream.option("checkpointLocation", f"{root}/check").foreachBatch(write).trigger(once=True).start().awaitTermination()  # timers keep availableNow from ending
    return spark.read.schema(failures.EVENTS).parquet(f"{root}/out").groupBy("id", "event", "failures").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), '1 b')")
def user_search(spark, sf_dir):
    u = tables.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("username"), F.lit(None).cast("string").alias("email"))
    return control.user_search(u, " 1 B ").select("c_custkey")


@query("""SELECT id, CASE WHEN id % 13 <> 0 THEN CASE WHEN id % 4 = 1 THEN 'new ' || title ELSE title END END AS title, CASE WHEN id % 13 <> 0 THEN sha256(CASE WHEN id % 4 = 0 THEN 'changed ' || content ELSE content END) END AS content_hash,
 CASE WHEN id % 13 <> 0 THEN 1 ELSE 0 END::BIGINT AS chunks, CASE WHEN id % 13 = 0 THEN CASE WHEN id % 10 <> 9 AND id % 4 < 2 THEN 2 ELSE 1 END END::INTEGER AS failures FROM docs WHERE (id % 13 = 0 OR id % 17 <> 0) AND length(trim(content)) > 0""", "docs")
def streaming_sync(spark, sf_dir):
    """Two file streams into one store (new, changed and renamed documents, some that the model fails on), then a sweep."""
    store, _ = _synced(spark, sf_dir)
    chunks = store.read("chunks").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunks"))
    held = store.read("documents").select("id", "title", "content_hash").join(store.read("failures"), "id", "full").join(chunks, "id", "left")
    return held.select("id", "title", "content_hash", F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"), "failures")


def _synced(spark, sf_dir) -> tuple[snapshots.SnapshotStore, keywords.Keywords]:
    docs = tables.docs(spark, sf_dir).select("id", "title", "content", "tag_ids", "created", "modified")
    k, root = F.col("id"), scratch_dir(spark, "streaming-sync")
    later = docs.withColumns({"title": F.when(k % 4 == 1, F.concat(F.lit("new "), "title")).otherwise(F.col("title")), "content": F.when(k % 4 == 0, F.concat(F.lit("changed "), "content")).otherwise(F.col("content")), "modified": F.lit("2023-01-01T00:00:00+00:00")})
    store = snapshots.SnapshotStore(spark, f"{root}/store", reconcile.KEYS)
    kept = keywords.Keywords(store, fanout=2)
    none = lambda schema: spark.createDataFrame([], schema)
    fields = ", ".join(f"{c} {t}" for c, t in docs.dtypes)
    store.commit(replace={"documents": none(f"{fields}, content_hash string, chunk_count int, embed_key string"), "chunks": none("document_id long, chunk_index int, text string, embedding array<float>"), "failures": none("id long, failures int"), "meta": none("key string, value string"), "taxonomy": none("kind string, id long, name string"), **kept.empty()})
    one = lambda d: d.select(k.alias("document_id"), F.lit(0).alias("chunk_index"), F.col("content").alias("text"))
    model = lambda c: c.withColumns({"embedding": F.array(F.length("text").cast("float")), "error": F.when(F.col("document_id") % 13 == 0, "the model is down")})
    job = reconcile.Reconciler(store, one, model, "length/1", keywords=kept)
    for i, batch in enumerate([docs.filter(k % 10 != 9), later.filter((k % 4 < 2) | (k % 10 == 9))]):
        batch.write.parquet(f"{root}/in{i}")
        sync.stream_sync(spark.readStream.schema(batch.schema).parquet(f"{root}/in{i}"), job, f"{root}/check{i}").awaitTermination()
    job.sweep(docs.filter(k % 17 != 0), complete=True)
    return store, kept


WORDS = "list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(f"""WITH {SQL["docs"]}, w AS (SELECT id, {WORDS.format("CASE WHEN id % 4 = 0 THEN 'changed ' || content ELSE content END")} AS w FROM docs WHERE id % 13 <> 0 AND id % 17 <> 0 AND length(trim(content)) > 0),
 c AS (SELECT id, len(w) AS dl, len(list_filter(w, lambda x: x = 'changed')) AS f0, len(list_filter(w, lambda x: x = 'the')) AS f1, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS f2 FROM w),
 s AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (WHERE f0 > 0) AS n0, count(*) FILTER (WHERE f1 > 0) AS n1, count(*) FILTER (WHERE f2 > 0) AS n2 FROM c),
 p AS (SELECT id, f0, f1, f2, ln((n - n0 + 0.5) / (n0 + 0.5)) AS i0, ln((n - n1 + 0.5) / (n1 + 0.5)) AS i1, ln((n - n2 + 0.5) / (n2 + 0.5)) AS i2, 1.2 * (0.25 + 0.75 * dl / m) AS d FROM c, s),
 r AS (SELECT 0 AS search, id, -(greatest(i0, 1e-6) * f0 * 2.2 / (f0 + d) + greatest(i1, 1e-6) * f1 * 2.2 / (f1 + d)) AS score FROM p WHERE f0 > 0 AND f1 > 0 UNION ALL SELECT 1, id, -(greatest(i2, 1e-6) * f2 * 2.2 / (f2 + d)) FROM p WHERE f2 > 0)
SELECT search, id AS document_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY search ORDER BY score, id) AS rank FROM r) WHERE rank <= 50""")
def synced_keyword_search(spark, sf_dir):
    """Keyword searches after the syncs and the sweep of ``streaming_sync``: new and changed chunks are found, deleted ones are not."""
    index = _synced(spark, sf_dir)[1].index()
    found = [keywords.keyword_search(index, p, 50).select(F.lit(i).alias("search"), "document_id", F.round("score", 6).alias("score")) for i, p in enumerate([[["changed"], ["the"]], [["of", "the"]]])]
    return found[0].unionByName(found[1])


@query("""SELECT 'user' AS kind, (n_nationkey + 1)::VARCHAR AS id, CASE WHEN n_nationkey + 1 = 4 THEN 'suspended' WHEN n_nationkey + 1 = 7 THEN 'admin' ELSE 'active' END AS state FROM nation WHERE n_nationkey + 1 <> 3
 UNION ALL SELECT 'session', (n_nationkey + 1)::VARCHAR, NULL FROM nation WHERE n_nationkey + 1 NOT IN (3, 4) AND n_nationkey % 4 <> 0
 UNION ALL SELECT 'key', (n_nationkey + 1)::VARCHAR, CASE WHEN n_nationkey + 1 = 9 THEN 'revoked ' ELSE '' END || (SELECT count(*) FROM events WHERE user_id = n_nationkey + 1) FROM nation WHERE n_nationkey + 1 NOT IN (3, 10)
 UNION ALL SELECT 'config', 'version', '2' UNION ALL SELECT 'config', 'top_k', '20' UNION ALL SELECT 'config', 'port', '8080'""")
def control_writes(spark, sf_dir):
    """Nations as users with a session and a key each: guarded updates, a cascading delete, touches, pruning, configuration."""
    held = accounts.Control(snapshots.SnapshotStore(spark, scratch_dir(spark, "control"), accounts.KEYS))
    n = tables.read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("bigint").alias("id"), "n_name", (F.col("n_nationkey") % 4).alias("k"))
    as_rows = lambda df, name: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in held.table(name).dtypes])
    users = n.withColumns({"username": F.col("n_name"), "role": F.when(F.col("id") < 3, "admin").otherwise("member"), "status": F.lit("active")})
    sessions = n.withColumns({"token_hash": F.sha2("n_name", 256), "user_id": F.col("id"), "expires_at": F.when(F.col("k") == 0, "2020-01-01").otherwise("2030-01-01")})
    keys = n.withColumns({"key_hash": F.sha2("n_name", 256), "owner_user_id": F.col("id"), "request_count": F.lit(0)})
    held.store.commit(upsert={"users": as_rows(users, "users"), "sessions": as_rows(sessions, "sessions"), "api_keys": as_rows(keys, "api_keys")})
    now = "2024-06-01T00:00:00+00:00"
    held.delete_user(3, actor=1)
    held.update_user(4, actor=1, now=now, status="suspended")
    held.update_user(7, actor=1, now=now, role="admin")
    held.prune_sessions("2024-06-01")
    held.revoke_key(9, now)
    held.delete_key(10)
    held.touch_keys(tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at")))
    held.seed_config({"top_k": "10", "port": "8080"}, now)
    held.set_config({"top_k": "20"}, now)
    text_id = F.col("id").cast("string").alias("id")
    state = F.when(F.col("role") == "admin", F.when(F.col("id") > 2, "admin").otherwise("active")).otherwise(F.col("status"))
    out = held.users().select(F.lit("user").alias("kind"), text_id, state.alias("state"))
    out = out.unionByName(held.table("sessions").select(F.lit("session").alias("kind"), F.col("user_id").cast("string").alias("id"), F.lit(None).cast("string").alias("state")))
    out = out.unionByName(held.table("api_keys").select(F.lit("key").alias("kind"), text_id, F.concat(F.when(F.col("revoked_at").isNotNull(), "revoked ").otherwise(""), F.col("request_count").cast("string")).alias("state")))
    version, values = held.config()
    return out.unionByName(spark.createDataFrame([("config", "version", str(version)), *(("config", k, v) for k, v in values.items())], "kind string, id string, state string"))
