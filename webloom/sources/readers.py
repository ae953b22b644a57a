"""Readers for pages, URL lists, logs, recordings, sitemaps and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.sqltext import lit
from webloom.operators.ordinals import with_offsets
from webloom.session import checkpointed

PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"
REQUEST_SCHEMA = "url STRING, method STRING, headers MAP<STRING,STRING>"
HAR_SCHEMA = (
    "log STRUCT<version: STRING, creator: STRUCT<name: STRING, version: STRING>, entries: ARRAY<STRUCT<"
    "url: STRING, method: STRING, headers: MAP<STRING,STRING>, postData: STRING, timestamp: DOUBLE, "
    "response: STRUCT<status: INT, statusText: STRING, headers: MAP<STRING,STRING>>>>>"
)
RECORDING_SCHEMA = (
    "version STRING, startUrl STRING, duration DOUBLE, actions ARRAY<STRUCT<type: STRING, selector: STRING, value: STRING, "
    "key: STRING, x: DOUBLE, y: DOUBLE, url: STRING, timestamp: DOUBLE>>"
)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """The stored pages; the size of a split is the reader's setting (spark.sql.files.maxPartitionBytes)."""
    return spark.read.schema(PAGE_SCHEMA).parquet(f"{folder}/pages.parquet")


def page_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(PAGE_SCHEMA).option("pathGlobFilter", pattern).parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The files of table ``name`` below ``folder`` as a stream, whether it is one file of that name or a folder of files."""
    path = f"{folder}/{name}"
    files = spark.read.schema(schema).parquet(path).inputFiles()
    stream = spark.readStream.schema(schema)
    # a stream reads folders only
    if len(files) == 1 and files[0].endswith(f"/{name}") and not files[0].endswith(f"/{name}/{name}"):
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, url): trimmed, blank lines dropped, duplicates kept; line_no is the line's place from 0, files in order of their names.

    A split of a file counts its lines, and the lines before it are added from one number per split; no line moves.
    """
    piece = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = spark.read.text(path).select(F.trim("value").alias("url"), *[F.col(c).alias(c.split(".")[1]) for c in piece], F.monotonically_increasing_id().alias("place_"))
    keys = ["file_path", "file_block_start"]
    # the places of a split's lines follow on from its first one
    sizes = lines.groupBy(*keys).agg(F.min("place_").alias("first_"), F.count("*").alias("n_"))
    firsts = {(r[0], r[1]): r[2] for r in sizes.select(*keys, "first_").collect()}
    starts = spark.createDataFrame([(*k, v) for k, v in firsts.items()], "file_path STRING, file_block_start BIGINT, first_ BIGINT")
    placed = with_offsets(lines.join(F.broadcast(starts), keys), sizes, keys, "n_")
    return placed.where("url <> ''").select((F.col("offset_") + F.col("place_") - F.col("first_")).alias("line_no"), "url")


def request_log(df: DataFrame) -> DataFrame:
    """(seq, url, method, headers) of request events in arrival order."""
    return df.select("seq", "url", "method", "headers")


def har_entries(documents: DataFrame, column: str = "json") -> DataFrame:
    """(keep…, entry_no, request columns, response columns) from HAR-shaped JSON documents."""
    keep = [c for c in documents.columns if c != column]
    parsed = documents.withColumn("h_", F.from_json(column, HAR_SCHEMA))
    out = parsed.select(*keep, F.posexplode_outer("h_.log.entries").alias("entry_no", "e")).where("e IS NOT NULL")
    return out.select(
        *keep, "entry_no", "e.url", "e.method", "e.headers", F.col("e.postData").alias("post_data"), F.col("e.timestamp").alias("ts"),
        "e.response.status", F.col("e.response.statusText").alias("status_text"), F.col("e.response.headers").alias("response_headers"),
    )


def har_documents(requests: DataFrame, key: str | None = None, name: str = "webloom", version: str = "1.2", most: int = 100_000) -> DataFrame:
    """(key, part, json): requests with their responses as HAR documents, the inverse of ``har_entries``.

    One document per value of ``key`` (one in all without it), entries in the order of ``seq``; its part is 0.  A key with more than
    ``most`` entries has a document for each range of ``most`` values of ``seq`` instead, numbered in their order, so a
    row holds ``most`` entries at most as long as ``seq`` tells a key's entries apart.  Expects the columns of ``netlog.har_join``: url, method, headers, post_data, ts, status, status_text,
    response_headers; those that are missing are left out of the entries.
    """
    given = set(requests.columns)
    own = [("url", "url"), ("method", "method"), ("headers", "headers"), ("post_data", "postData"), ("ts", "timestamp")]
    answer = [("status", "status"), ("status_text", "statusText"), ("response_headers", "headers")]
    response = F.struct(*[F.col(c).alias(n) for c, n in answer if c in given])
    fields = [F.col(c).alias(n) for c, n in own if c in given]
    if "status" in given:
        fields.append(F.when(F.col("status").isNotNull(), response).alias("response"))
    keyed = requests.withColumn("key_", F.lit(None).cast("string") if key is None else F.col(key))
    # written, so that the planner knows how many there are: sent to every task if few, met by key if not
    large = keyed.groupBy("key_").agg(F.count("*").alias("n_")).where(F.col("n_") > most).select(F.col("key_").alias("large_"), F.lit(True).alias("is_large_"))
    split = keyed.join(checkpointed(large), F.col("key_").eqNullSafe(F.col("large_")), "left")
    split = split.withColumn("part", F.expr(f"IF(is_large_, (seq - pmod(seq, {most}L)) DIV {most}L, 0L)"))
    entries = split.groupBy("key_", "part").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("e"))), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)).alias("s"))
    log = F.struct(F.lit(version).alias("version"), F.struct(F.lit(name).alias("name"), F.lit("1.0").alias("version")).alias("creator"), F.transform("s", lambda x: x["e"]).alias("entries"))
    return entries.select(F.col("key_").alias(key or "key"), "part", F.to_json(F.struct(log.alias("log"))).alias("json"))


def recording_actions(documents: DataFrame, column: str = "json") -> DataFrame:
    """(keep…, start_url, duration, action_no, action columns); recordings without actions give no rows."""
    keep = [c for c in documents.columns if c != column]
    parsed = documents.withColumn("r_", F.from_json(column, RECORDING_SCHEMA))
    out = parsed.select(
        *keep, F.col("r_.startUrl").alias("start_url"), F.col("r_.duration").alias("duration"),
        F.posexplode_outer("r_.actions").alias("action_no", "a"),
    )
    return out.where("a IS NOT NULL").select(*keep, "start_url", "duration", "action_no", "a.*")


_URL_ROW = "STRUCT<loc: STRING, lastmod: STRING, changefreq: STRING, priority: STRING>"


def _without_prefixes(xml: str) -> str:
    """XML with namespace prefixes of element names dropped."""
    return f"regexp_replace({xml}, {lit(r'(</?)[A-Za-z_][\w.-]*:(?=[A-Za-z_])')}, '$1')"


def sitemap_urls(documents: DataFrame) -> DataFrame:
    """(url, entry_no, type, loc, lastmod, changefreq, priority) from (url, xml).

    An index gives its sitemaps only; anything else gives its URLs.  XML that does not parse gives an ``error`` row.
    """
    schema = lit(f"url ARRAY<{_URL_ROW}>, sitemap ARRAY<{_URL_ROW}>")
    parsed = documents.select("url", F.expr(f"from_xml({_without_prefixes('xml')}, {schema}, map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', 'bad'))").alias("d"), "xml")
    well_formed = "xml RLIKE '(?s)^\\\\s*(?:<[?!].*?>\\\\s*)*<([A-Za-z_:][^\\\\s>/]*)(?:\\\\s[^>]*)?(?:/>|>.*</\\\\1\\\\s*>)\\\\s*(?:<!--.*-->\\\\s*)?$'"
    locs = "filter(d.sitemap, s -> s.loc IS NOT NULL)"
    entries = (
        f"CASE WHEN size({locs}) > 0 THEN transform({locs}, s -> struct('sitemap' AS type, s.loc AS loc, CAST(NULL AS STRING) AS lastmod, "
        "CAST(NULL AS STRING) AS changefreq, CAST(NULL AS STRING) AS priority)) "
        "ELSE transform(d.url, u -> struct('url' AS type, u.loc AS loc, u.lastmod AS lastmod, u.changefreq AS changefreq, u.priority AS priority)) END"
    )
    out = parsed.withColumn("ok", F.expr(f"coalesce({well_formed}, false)"))
    out = out.select("url", "ok", F.posexplode_outer(F.expr(f"IF(ok, {entries}, NULL)")).alias("entry_no", "e"))
    out = out.where("e IS NOT NULL OR NOT ok")
    return out.select("url", "entry_no", "e.*", F.expr("IF(ok, NULL, 'Failed to parse sitemap')").alias("error"))


def sitemap_pick(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """(url, sitemap_url, xml, error): the sitemap document of each site.

    Candidates in order are the URL itself when it ends in .xml, else /sitemap.xml, then /sitemap_index.xml and
    /sitemap-index.xml; the first with status 200 is taken, and an empty body there means there is no sitemap.
    """
    places = sites.select("url").distinct().select(
        "url",
        F.posexplode(
            F.array(
                F.when(F.col("url").endswith(".xml"), F.col("url")).otherwise(F.concat("url", F.lit("/sitemap.xml"))),
                F.concat("url", F.lit("/sitemap_index.xml")),
                F.concat("url", F.lit("/sitemap-index.xml")),
            )
        ).alias("priority", "place"),
    )
    # the choice needs no bodies; they are fetched for the chosen places only
    answers = responses.where("status = 200").select(F.col("url").alias("place")).distinct()
    best = places.join(answers, "place").groupBy("url").agg(F.min_by("place", "priority").alias("place"))
    chosen = checkpointed(best.select("place").distinct())
    bodies = responses.where("status = 200").join(chosen, responses["url"] == chosen["place"], "left_semi")
    bodies = bodies.groupBy(F.col("url").alias("place")).agg(F.min("xml").alias("xml"))
    best = best.join(bodies, "place").select("url", F.struct("place", "xml").alias("b"))
    out = sites.select("url").distinct().join(best, "url", "left")
    found = F.coalesce(F.col("b.xml"), F.lit("")) != ""
    return out.select(
        "url", F.when(found, F.col("b.place")).alias("sitemap_url"), F.when(found, F.col("b.xml")).alias("xml"),
        F.when(~found, F.lit("Sitemap not found")).alias("error"),
    )


_RSS = "STRUCT<title: STRING, link: STRING, description: STRING, item: ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, pubDate: STRING, guid: STRING>>>"
_LINK = "ARRAY<STRUCT<_href: STRING>>"
_ATOM = f"title STRING, link {_LINK}, entry ARRAY<STRUCT<title: STRING, link: {_LINK}, summary: STRING, published: STRING, id: STRING>>"


def _feed(documents: DataFrame) -> DataFrame:
    root = f"regexp_extract(xml, {lit(r'(?s)^\s*(?:<[?!].*?>\s*)*<([A-Za-z_][\w.:-]*)')}, 1)"
    is_rss = f"({root} = 'rss' OR xml RLIKE {lit(r'(?s)<channel[\s>]')})"
    options = "map('mode', 'PERMISSIVE', 'valueTag', 'text_')"
    rss_schema = lit("channel " + _RSS)
    # attributes of text elements are dropped so that text reads as a plain string
    plain = f"regexp_replace(xml, {lit(r'<(guid|title|description|pubDate)\s[^>]*[^>/]>')}, '<$1>')"
    texts = rf"regexp_replace(regexp_replace({_without_prefixes('xml')}, {lit(r'<(title|summary|id|published)\s[^>]*[^>/]>')}, '<$1>'), '^\\\\s+', '')"
    return documents.select(
        "url",
        F.expr(is_rss).alias("rss"),
        F.expr(f"IF({is_rss}, from_xml({plain}, {rss_schema}, {options}).channel, NULL)").alias("c"),
        F.expr(f"IF({is_rss}, NULL, from_xml({texts}, {lit(_ATOM)}, {options}))").alias("a"),
    )


def feed_info(documents: DataFrame) -> DataFrame:
    """(url, type, title, link, description) from (url, xml): RSS channels and Atom feeds."""
    return _feed(documents).select(
        "url",
        F.expr("IF(rss, 'rss', 'atom')").alias("type"),
        F.expr("IF(rss, c.title, a.title)").alias("title"),
        F.expr("IF(rss, c.link, get(a.link, 0)._href)").alias("link"),
        F.expr("IF(rss, c.description, NULL)").alias("description"),
    )


def feed_items(documents: DataFrame) -> DataFrame:
    """(url, type, item_no, title, link, description, pub_date, guid, summary, published, id) from (url, xml)."""
    feed = _feed(documents)
    rss = feed.where("rss").select("url", F.lit("rss").alias("type"), F.posexplode_outer("c.item").alias("item_no", "i")).where("i IS NOT NULL")
    atom = feed.where("NOT rss").select("url", F.lit("atom").alias("type"), F.posexplode_outer("a.entry").alias("item_no", "i")).where("i IS NOT NULL")
    rss = rss.select("url", "type", "item_no", "i.title", "i.link", "i.description", F.col("i.pubDate").alias("pub_date"), "i.guid")
    atom = atom.select("url", "type", "item_no", "i.title", F.expr("get(i.link, 0)._href").alias("link"), "i.summary", "i.published", "i.id")
    return rss.unionByName(atom, allowMissingColumns=True)


def typed_sitemap(entries: DataFrame) -> DataFrame:
    """Typed companions of the text columns: lastmod_ts and priority_value, NULL where the text does not fit."""
    return entries.withColumn("lastmod_ts", F.expr("try_to_timestamp(lastmod)")).withColumn("priority_value", F.expr("try_cast(priority AS DOUBLE)"))
