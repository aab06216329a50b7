"""Browse, facets, statistics and look-ups over the document table."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchmill.functions.text import ascii_lower
from parchmill.session import scratch_dir

SORTS = {"created": "created", "title": "title", "indexed_at": "indexed_at", "added": "indexed_at"}


#: Bounds of a request's page and page size, of a query's length.
MOST_PAGE, MOST_PAGE_SIZE, MOST_QUERY = 10_000, 100, 4000


def bounded_page(page: int, size: int) -> tuple[int, int]:
    """(offset, limit) of a page from 1 on; what lies outside the bounds is an error."""
    if not 1 <= page <= MOST_PAGE or not 1 <= size <= MOST_PAGE_SIZE:
        raise ValueError(f"page must be 1 to {MOST_PAGE}, page size 1 to {MOST_PAGE_SIZE}")
    return (page - 1) * size, size


def bounded_query(text: str) -> str:
    if not text.strip() or len(text) > MOST_QUERY:
        raise ValueError(f"a query has 1 to {MOST_QUERY} characters")
    return text


def names_of(taxonomy: DataFrame, kind: str) -> DataFrame:
    return taxonomy.filter(F.col("kind") == kind).select(F.col("id").alias(f"{kind}_id"), F.col("name").alias(kind))


def with_names(documents: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Correspondent and document type names; ids that the taxonomy lacks give null.

    A taxonomy is broadcast where the planner sees that it is small (its threshold), else joined by id.
    """
    return documents.join(names_of(taxonomy, "correspondent"), "correspondent_id", "left").join(names_of(taxonomy, "document_type"), "document_type_id", "left")


def tag_names(documents: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(id, tag_names): names in the order of tag_ids, unknown ids dropped."""
    one = documents.select("id", F.posexplode("tag_ids").alias("pos", "tag_id")).join(names_of(taxonomy, "tag"), "tag_id")
    got = one.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("tag_names"))
    return documents.select("id").join(got, "id", "left").withColumn("tag_names", F.coalesce("tag_names", F.array().cast("array<string>")))


def text_filter(text: str) -> Column:
    """Substring of title, correspondent or type; only A-Z fold."""
    term = F.lit("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    out = F.lit(False)
    for c in ("title", "correspondent", "document_type"):
        out = out | F.coalesce(ascii_lower(c).contains(term), F.lit(False))
    return out


@dataclass(frozen=True)
class BrowseQuery:
    text: str = ""
    where: Column | None = None
    sort: str = "created"
    descending: bool = True
    limit: int = 24
    offset: int = 0


#: Rows up to which the front of a listing is taken by one sort and limit.
DEEP = 10_000


@dataclass(frozen=True)
class SortedPages:
    """The ids of a listing in its order, in parts by range: ``starts`` has the number of each part's first row, and of the end."""

    rows: DataFrame
    by: list[Column]
    starts: list[int]

    @classmethod
    def build(cls, rows: DataFrame, sort: str, descending: bool = True, path: str | None = None) -> SortedPages:
        """Sorted by range and written in its narrow columns; the driver gets a count for each part."""
        spark, path = rows.sparkSession, path or scratch_dir(rows.sparkSession, "sorted-pages")
        by = _order(sort, descending)
        narrow = rows.select("id", sort) if sort != "id" else rows.select("id")
        narrow.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()).write.partitionBy("__part").parquet(path)
        held = spark.read.schema(", ".join(f"`{n}` {t}" for n, t in narrow.dtypes) + ", __part int").parquet(path)
        count = {r["__part"]: r["count"] for r in held.groupBy("__part").count().collect()}
        return cls(held, by, [0, *accumulate(count.get(i, 0) for i in range(max(count, default=-1) + 1))])

    def page(self, offset: int, limit: int) -> DataFrame:
        """(id, __at) of the rows from offset on: only the parts that hold them are read."""
        parts = [i for i, (a, b) in enumerate(zip(self.starts, self.starts[1:])) if a < offset + limit and b > offset]
        at = F.row_number().over(W.orderBy(*self.by)) - 1 + F.lit(self.starts[parts[0]] if parts else 0)  # one task, the rows of these parts
        return self.rows.filter(F.col("__part").isin(parts)).select("id", at.cast("bigint").alias("__at")).filter(F.col("__at").between(offset, offset + limit - 1))


def _order(sort: str, descending: bool) -> list[Column]:
    return [c.desc() if descending else c.asc() for c in (F.col(sort), F.col("id"))]


def browse(documents: DataFrame, taxonomy: DataFrame, query: BrowseQuery) -> tuple[DataFrame, DataFrame]:
    """(page, total): both from the same filtered frame. Ids are unique. A page far behind is found by counts of sorted parts (``SortedPages``)."""
    if query.sort not in SORTS:
        raise ValueError(f"unknown sort: {query.sort}")
    rows = documents if query.where is None else documents.filter(query.where)
    if query.text:  # only then do names decide which rows there are
        rows = with_names(rows, taxonomy).filter(text_filter(query.text))
    by = _order(SORTS[query.sort], query.descending)
    if query.offset + query.limit > DEEP:
        few = SortedPages.build(rows, SORTS[query.sort], query.descending).page(query.offset, query.limit)
        page = rows.join(few, "id")
    else:
        page = rows.orderBy(*by)
        page = (page.offset(query.offset) if query.offset else page).limit(query.limit)
        page = page.withColumn("__at", F.row_number().over(W.orderBy(*by)))  # the rows of one page
    # sorted by that number, for a sort by the same columns above the joins may be dropped as if the joins kept the order
    page = (page if query.text else with_names(page, taxonomy)).orderBy("__at").drop("__at")
    return page, rows.agg(F.count("*").alias("total"))


def get_documents(documents: DataFrame, taxonomy: DataFrame, ids: list[int]) -> DataFrame:
    """(id, title, correspondent, document_type, tags, created) of those of the ids that are there."""
    rows = documents.filter(F.col("id").isin(ids))
    return with_names(rows, taxonomy).join(tag_names(rows, taxonomy), "id", "left").select("id", "title", "correspondent", "document_type", F.col("tag_names").alias("tags"), "created")


def document_summary(documents: DataFrame, taxonomy: DataFrame, document_id: int) -> DataFrame:
    """One document as in the list, with its number of pages; no row if it is not there."""
    pages = documents.filter(F.col("id") == document_id).select("id", F.col("page_count") if "page_count" in documents.columns else F.lit(None).cast("int").alias("page_count"))
    return get_documents(documents, taxonomy, [document_id]).join(pages, "id")


def get_chunks(chunks: DataFrame, ids: list[int]) -> DataFrame:
    """(chunk_id, document_id, text, page_hint, score) of those of the ids that are there; a look-up has score 0."""
    hint = F.col("page_hint") if "page_hint" in chunks.columns else F.lit(None).cast("int").alias("page_hint")
    return chunks.filter(F.col("chunk_id").isin(ids)).select("chunk_id", "document_id", "text", hint, F.lit(0.0).alias("score"))


def exists(documents: DataFrame, document_id: int) -> bool:
    return bool(documents.filter(F.col("id") == document_id).limit(1).count())


def get_taxonomy(taxonomy: DataFrame, kind: str) -> DataFrame:
    return taxonomy.filter(F.col("kind") == kind).select("kind", "id", "name").orderBy("name", "id")


def facets(taxonomy: DataFrame) -> DataFrame:
    """(kind, id, name) of the whole taxonomy, by kind and name; one row for each entry, so that no kind is one row."""
    return taxonomy.select("kind", "id", "name").orderBy("kind", "name", "id")


def date_range(documents: DataFrame) -> DataFrame:
    created = F.nullif(F.col("created"), F.lit(""))
    return documents.agg(F.min(created).alias("date_from"), F.max(created).alias("date_to"))


def stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    d, c = documents.agg(F.count("*").alias("documents")), chunks.agg(F.count("*").alias("chunks"))
    return d.withColumn("one", F.lit(1)).join(c.withColumn("one", F.lit(1)), "one").drop("one")


def quick_check(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts that must be zero: repeated ids, orphan chunks, chunks out of order."""
    repeated = documents.groupBy("id").count().filter("count > 1").agg(F.count("*").alias("n")).withColumn("check", F.lit("repeated document ids"))
    orphans = chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti").agg(F.count("*").alias("n")).withColumn("check", F.lit("orphan chunks"))
    order = chunks.groupBy("document_id").agg((F.max("chunk_index") + 1 != F.count("*")).alias("bad")).agg(F.count_if("bad").alias("n")).withColumn("check", F.lit("chunk index gaps"))
    return repeated.unionByName(orphans).unionByName(order).select("check", "n")


def top_names(taxonomy_usage: DataFrame, limit: int) -> DataFrame:
    """Names by usage (most first), then by name; spellings that differ by case are one, the first seen."""
    one = taxonomy_usage.filter(F.length(F.trim("name")) > 0).groupBy(F.lower("name").alias("folded")).agg(F.min_by("name", "position").alias("name"), F.max("usage").alias("usage"))
    out = one.orderBy(F.desc("usage"), "folded").select("name", "usage")
    return out.limit(limit) if limit > 0 else out
