"""Document work queues, classification and OCR: rules as columns, models as injected callables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchmill.functions import quality, tags, text
from parchmill.session import bounded_batches, materialise, numbered

CLASSIFICATION = "title string, correspondent string, tags array<string>, document_date string, document_type string, language string, person string"


def queue(docs: DataFrame, pre: int, post: int | None, claim: int | None) -> tuple[DataFrame, DataFrame]:
    """(documents to work on, tag changes): those with the pre tag, neither done nor claimed; done ones lose the pre tag."""
    has = lambda t: F.coalesce(F.array_contains("tag_ids", F.lit(t).cast("bigint")), F.lit(False)) if t is not None else F.lit(False)
    waiting = docs.filter(has(pre) & F.col("id").isNotNull())
    stale = waiting.filter(has(post)).select("id", tags.swap("tag_ids", [pre], []).alias("tag_ids"))
    return waiting.filter(~has(post) & ~has(claim)), stale


def stale_locks(docs: DataFrame, claim: int, pre: int) -> DataFrame:
    """Claims left behind: the claim tag goes, the pre tag comes back."""
    return docs.filter(F.array_contains("tag_ids", F.lit(claim).cast("bigint"))).select("id", tags.swap("tag_ids", [claim], [pre]).alias("tag_ids"))


def to_error(docs: DataFrame, pipeline: list[int], error: int) -> DataFrame:
    return docs.select("id", tags.swap("tag_ids", pipeline, [error]).alias("tag_ids"))


def first_answer(models: list[Callable[[str], str | None]]) -> Callable[[str], str | None]:
    """The first model that answers; a model that fails or says nothing passes to the next; none gives None."""

    def ask(prompt: str) -> str | None:
        for m in models:
            try:
                if said := m(prompt):
                    return said
            except Exception:  # noqa: BLE001  the model is foreign code
                continue
        return None

    return ask


def json_object(said: str | None) -> dict | None:
    """An object, if need be from the first brace to the last."""
    said = said or ""
    for part in (said, said[said.find("{") : said.rfind("}") + 1]):
        try:
            if isinstance(out := json.loads(part), dict):
                return out
        except ValueError:
            continue
    return None


def parse_classification(said: str | None) -> dict | None:
    """Fields as text, null as empty, a single tag as a list of one."""
    got = json_object(said)
    if got is None:
        return None
    out = {k: "" if got.get(k) is None else str(got[k]).strip() for k in ("title", "correspondent", "document_date", "document_type", "language", "person")}
    own = got.get("tags")
    out["tags"] = [own.strip()] if isinstance(own, str) else [str(t).strip() for t in own if t is not None] if isinstance(own, list) else []
    return out


def classify(docs: DataFrame, model: Callable[[str], str | None], max_pages: int = 3, tail_pages: int = 1, max_chars: int = 0, headerless: int = 15000, country: str = "", tag_limit: int = 5, today: str = "1970-01-01", error_tag: int | None = None) -> DataFrame:
    """id, disposition and the result. Gates in order: error tag, empty, refusal, then the model, then an empty or generic result.

    Only documents that pass the first gates reach the model, cut to pages and then characters, below the notes of these cuts.
    """
    error = F.coalesce(F.array_contains("tag_ids", F.lit(error_tag).cast("bigint")), F.lit(False)) if error_tag is not None else F.lit(False)
    blank = F.length(text.strip(F.coalesce("content", F.lit("")))) == 0
    gate = F.when(error, "error_tag").when(blank, "requeue").when(quality.is_refusal("content"), "refusal")
    created = F.col("created") if "created" in docs.columns else F.lit(None).cast("string")
    gated = docs.select("id", "content", created.alias("created"), gate.alias("disposition"))
    cut, note = text.truncate("content", max_pages, tail_pages, headerless, max_chars)
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "content": f["content"], "created": f["created"], "result": [parse_classification(model(p)) for p in f["prompt"]]})

    todo = gated.filter("disposition is null").select("id", "content", "created", F.concat_ws("\n\n", note, cut).alias("prompt"))
    done = todo.mapInPandas(run, f"id long, content string, created string, result struct<{CLASSIFICATION.replace(' string', ':string').replace(' array', ':array')}>")
    r = F.col("result")
    empty = r.isNull() | quality.is_empty_classification([r[c] for c in ("title", "correspondent", "document_date", "document_type", "language", "person")], r["tags"])
    verdict = F.when(empty, "empty").when(quality.is_generic_type(r["document_type"]), "generic").otherwise("applied")
    named = tags.ruled(r["tags"], r["correspondent"], r["document_type"], r["person"], "content", tags.date_for_tags(r["document_date"], "created", today), country, tag_limit, today)
    columns = [r["title"].alias("title"), r["correspondent"].alias("correspondent"), r["document_type"].alias("document_type"), text.language_code(r["language"]).alias("language"), F.date_format(text.iso_date(r["document_date"]), "yyyy-MM-dd").alias("document_date")]
    out = done.select("id", verdict.alias("disposition"), *columns, F.when(verdict == "applied", named).alias("tags"))
    rest = gated.filter("disposition is not null").select("id", "disposition", *[F.lit(None).cast("string").alias(c) for c in ("title", "correspondent", "document_type", "language", "document_date")], F.lit(None).cast("array<string>").alias("tags"))
    return out.unionByName(rest)


def transcribe(pages: DataFrame, models: list[tuple[str, Callable[[bytes], str]]], with_models: bool = False) -> DataFrame:
    """id, content, has_errors of (id, page, image): a refusal or a redaction goes to the next model, a failed page is marked, pages join in order.

    ``models`` are (name, callable) in order of preference; a name counts once. A null image is a blank page.
    """
    models = list({name: (name, model) for name, model in reversed(models)}.values())[::-1]
    bounded_batches(pages.sparkSession)

    def one(page: int, image: bytes | None) -> tuple[str, str]:
        if image is None:
            return "", ""
        try:
            for name, model in models:
                said = model(bytes(image)).strip()
                if not quality.refuses(said):
                    return said, name if said else ""
            return "CHATGPT REFUSED TO TRANSCRIBE", ""
        except Exception:  # noqa: BLE001  one page's failure stays with the page
            return f"[OCR ERROR] Failed to OCR page {page}.", ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = [one(p, i) for p, i in zip(f["page"], f["image"])]
            yield pd.DataFrame({"id": f["id"], "page": f["page"], "text": [s[0] for s in said], "model": [s[1] for s in said]})

    done = pages.select("id", "page", "image").mapInPandas(run, "id long, page int, text string, model string")
    whole = done.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("page", "text", "model"))).alias("pages"), F.count("*").alias("n"))
    content = text.assemble_pages("pages", F.col("n"), with_models)
    return whole.select("id", content.alias("content")).withColumn("has_errors", quality.has_ocr_errors("content"))


def usage_count(count: Column, alternatives: Column, documents: Column) -> Column:
    """The first usable of two count fields (number or digits) and the length of a list; else 0."""
    number = lambda c: F.when(c.cast("string").rlike(r"^[0-9]+$"), c.try_cast("bigint"))
    return F.coalesce(number(count), number(alternatives), F.when(documents.isNotNull(), F.size(documents)).cast("bigint"), F.lit(0).cast("bigint"))


def match_names(wanted: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(kind, name, id) of (kind, name): exact names first, then equal keys; the first by name. Empty keys match nothing."""
    t = taxonomy.select("kind", F.col("id"), F.col("name").alias("entry"), text.normalise_key("name").alias("key"))
    w = wanted.select("kind", "name", text.normalise_key("name").alias("key")).distinct()
    exact = w.join(t.drop("key").withColumnRenamed("entry", "name"), ["kind", "name"]).select("kind", "name", "id", F.lit(0).alias("pass"), F.col("name").alias("entry"))
    keyed = w.filter("key <> ''").join(t, ["kind", "key"]).select("kind", "name", "id", F.lit(1).alias("pass"), "entry")
    best = W.partitionBy("kind", "name").orderBy("pass", "entry", "id")
    return exact.unionByName(keyed).withColumn("n", F.row_number().over(best)).filter("n = 1").select("kind", "name", "id")


def _name_key(kind: Column, name: Column) -> Column:
    return F.when(kind == "correspondent", text.normalise_company(name)).otherwise(text.normalise_simple(name))


#: Characters of a seed by which containments are found.
SEED = 6


def _seeds(key: Column, sizes: Sequence[int]) -> Column:
    """The distinct substrings of these sizes (and, at the end, shorter ones), cut from the characters in linear time and memory."""
    cut = lambda c: F.flatten(F.transform(c, lambda _, i: F.transform(F.array(*map(F.lit, sizes)), lambda n: F.array_join(F.slice(c, i + 1, n), ""))))
    return F.array_distinct(F.transform(F.array(F.split(key, "")), cut)[0])


def containments(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs of rows where ``inner_key`` lies in ``outer_key`` (neither empty).

    An outer key gives its substrings of up to ``SEED`` characters (a few rows for each character, without the key), an inner key one
    of them: itself if it is short, else the one that fewest outer keys have. Keys that share a seed are compared whole.
    """
    number = F.xxhash64("outer_key").alias("__outer")
    outer, inner = outer.filter("outer_key <> ''"), inner.filter("inner_key <> ''")
    parts = materialise(outer.select("outer_key").distinct().select(number, F.explode(_seeds(F.col("outer_key"), range(1, SEED + 1))).alias("__seed")), "seeds")
    common = parts.groupBy("__seed").agg(F.count("*").alias("n"))
    keys = inner.select("inner_key").distinct()
    own = F.when(F.length("inner_key") <= SEED, F.array("inner_key")).otherwise(F.filter(_seeds(F.col("inner_key"), [SEED]), lambda x: F.length(x) == SEED))
    rare = keys.select("inner_key", F.explode(own).alias("__seed")).join(common, "__seed", "left")  # a seed that no outer key has is the rarest
    rare = rare.groupBy("inner_key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "__seed")).alias("s")).select("inner_key", "s.__seed")
    near = rare.join(parts, "__seed").select("inner_key", "__outer")
    pairs = near.join(outer.select("outer_key").distinct().select(number, "outer_key"), "__outer").filter(F.col("outer_key").contains(F.col("inner_key"))).select("inner_key", "outer_key")
    return outer.join(pairs, "outer_key").join(inner, "inner_key")


def _related(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, entry, position) where a's key and b's entry hold one another; b has entry and position."""
    one = containments(a.select(F.col("key").alias("inner_key")), b.select(F.col("entry").alias("outer_key"), "position")).select(F.col("inner_key").alias("key"), F.col("outer_key").alias("entry"), "position")
    other = containments(b.select(F.col("entry").alias("inner_key"), "position"), a.select(F.col("key").alias("outer_key"))).select(F.col("outer_key").alias("key"), F.col("inner_key").alias("entry"), "position")
    return one.unionByName(other).distinct()


def get_or_create(wanted: DataFrame, taxonomy: DataFrame, first_new_id: int) -> tuple[DataFrame, DataFrame]:
    """(name to id, new entries) of (kind, name, position): known names first, then new entries in the order of positions.

    A name is known if its key is; of entries with equal keys the one of the greatest id counts. A correspondent is also
    known if its key and an entry's hold one another: the entry of the smallest id is taken, and new correspondents count
    as entries for those after them. New ids follow the positions within each kind, the smallest position's spelling wins.
    Names without a key (no letter or digit) make no entry; an entry without a key lies in every correspondent's.
    """
    key = _name_key(F.col("kind"), F.col("name")).alias("key")
    keyed = materialise(wanted.select("kind", "name", "position", key).filter("key <> ''"), "wanted-names")
    entries = taxonomy.select("kind", "id", key)
    known = entries.groupBy("kind", "key").agg(F.max("id").alias("id"), F.min("id").alias("first"))
    miss = materialise(keyed.join(known, ["kind", "key"], "left_anti").groupBy("kind", "key").agg(F.min(F.struct("position", "name")).alias("m")).select("kind", "key", "m.position", "m.name"), "missing-names")
    who, held = miss.filter("kind = 'correspondent'"), known.filter("kind = 'correspondent'").select(F.col("key").alias("entry"), F.col("first").alias("position"), "id")
    bare = held.filter("entry = ''").select(F.lit("correspondent").alias("kind"), "entry", "position")  # one row at most
    near = _related(who, held.select("entry", "position").filter("entry <> ''")).unionByName(who.select("kind", "key").join(F.broadcast(bare), "kind").select("key", "entry", "position"))
    near = near.groupBy("key").agg(F.min_by("entry", "position").alias("entry"))
    found = materialise(near.join(held, "entry").select("key", "id"), "contained-names")
    new = miss.join(found.select(F.lit("correspondent").alias("kind"), "key"), ["kind", "key"], "left_anti")
    follow = _followers(new.filter("kind = 'correspondent'"))
    new = new.join(follow.select(F.lit("correspondent").alias("kind"), "key"), ["kind", "key"], "left_anti")
    every = numbered(new, ["kind", "position", "key"], "at")
    start = every.groupBy("kind").agg(F.min("at").alias("start"))
    new = materialise(every.join(F.broadcast(start), "kind").select("kind", "key", "name", (F.lit(first_new_id).cast("bigint") + F.col("at") - F.col("start")).alias("id")), "new-names")
    own = new.select("kind", "key", "id")
    led = follow.join(own.filter("kind = 'correspondent'").select(F.col("key").alias("entry"), "id"), "entry").select(F.lit("correspondent").alias("kind"), "key", "id")
    ids = known.select("kind", "key", "id").unionByName(found.select(F.lit("correspondent").alias("kind"), "key", "id")).unionByName(own).unionByName(led)
    return keyed.join(ids, ["kind", "key"]).select("kind", "name", "id").distinct(), new.select("kind", "id", "name")


def _followers(new: DataFrame) -> DataFrame:
    """(key, entry) of new correspondents that an earlier new one holds, or that hold it.

    A name follows the first of its earlier relatives that is an entry; it is settled once all of these are, so rounds end.
    """
    mine = new.select("key", F.col("position").alias("own"))
    pairs = _related(new.select("key"), new.select(F.col("key").alias("entry"), "position")).join(mine, "key").filter("position < own or (position = own and entry < key)")
    pairs = materialise(pairs.select("key", "entry", "position"), "related-names")
    empty = new.sparkSession.createDataFrame([], "key string, entry string")
    settled = empty
    while pairs.limit(1).count():
        free = pairs.select(F.col("entry").alias("key")).distinct().join(pairs.select("key").distinct(), "key", "left_anti").join(settled.select("key").distinct(), "key", "left_anti")  # entries of their own
        state = settled.select("key").distinct().withColumn("leads", F.lit(False)).unionByName(free.withColumn("leads", F.lit(True)))
        marked = pairs.join(state.select(F.col("key").alias("entry"), "leads"), "entry", "left")
        judged = marked.groupBy("key").agg(F.bool_and(F.col("leads").isNotNull()).alias("ready"), F.min_by(F.when(F.col("leads"), F.col("entry")), F.when(F.col("leads"), F.struct("position", "entry"))).alias("entry"))
        ready = materialise(judged.filter("ready"), "judged-names")
        settled = materialise(settled.unionByName(ready.filter("entry is not null").select("key", "entry")), "followers")
        pairs = materialise(pairs.join(ready.select("key"), "key", "left_anti"), "related-names")
    return settled


def settings_view(known: DataFrame, environment: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, value, source): stored values before the environment before defaults."""
    e, s = environment.withColumnRenamed("value", "env"), stored.withColumnRenamed("value", "own")
    j = known.join(e, "key", "left").join(s, "key", "left")
    source = F.when(F.col("own").isNotNull(), "stored").when(F.col("env").isNotNull(), "environment").otherwise("default")
    return j.select("key", F.coalesce("own", "env", "default").alias("value"), source.alias("source"))


def needs_reindex(changed: Column) -> Column:
    return F.arrays_overlap(changed, F.array(*map(F.lit, ["EMBEDDING_MODEL", "CHUNK_SIZE", "CHUNK_OVERLAP"])))


def contexts(chunks: DataFrame) -> DataFrame:
    """(document_id, context): the document's id in brackets and its chunks in order, for a prompt."""
    g = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    return g.select("document_id", F.concat(F.lit("["), F.col("document_id").cast("string"), F.lit("]\n"), F.array_join(F.transform("c", lambda x: x["text"]), "\n\n")).alias("context"))
