"""Landed JSON lines, feeds, filings and registrant maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.text import plain_text, safe_text
from barloom.functions.times import mail_date, offset_instant
from barloom.functions.urls import url_issue
from barloom.operators.documents import availability, feed_hash, filing_hash, news_hash, plausible
from barloom.operators.layout import AUTO, Layout, arrange
from barloom.operators.quality import implausible

#: a longer identifier is refused, never cut
IDENTIFIER_CHARS = 512
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"


def numbered_lines(spark: SparkSession, path: str, layout: Layout = AUTO) -> DataFrame:
    """Lines of landed files with file, 1-based line number and whether it is the last.

    A file may be read in several splits. Splits of a file are ordered by their
    start and lines by position inside the split, so numbering needs no task to
    hold a file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_place"),
        F.col("value").alias("line"),
    )
    arranged = arrange(lines, ("file",), ("_split", "_place"), layout=layout).own()
    totals = arranged.df.groupBy("file").agg(F.max("_rn").alias("_total"))
    return arranged.df.join(totals, "file").select(
        "file", F.col("_rn").alias("line_number"), (F.col("_rn") == F.col("_total")).alias("is_last"), "line"
    )


def read_jsonl(spark: SparkSession, path: str, schema: str, layout: Layout = AUTO) -> tuple[DataFrame, DataFrame]:
    """Parsed records and located corrupt lines (``corrupt_tail`` only for the last line)."""
    lines = numbered_lines(spark, path, layout).filter(F.trim("line") != "")
    parsed = lines.withColumn(
        "_r",
        F.from_json("line", f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}),
    )
    is_object = F.trim("line").startswith("{")
    good = F.col("_r._corrupt").isNull() & F.col("_r").isNotNull() & is_object
    records = parsed.filter(good).select("file", "line_number", "_r.*").drop("_corrupt")
    corrupt = parsed.filter(~F.coalesce(good, F.lit(False))).select(
        "file", "line_number", F.when(F.col("is_last"), "corrupt_tail").otherwise("corrupt_interior").alias("kind"), "line"
    )
    return records, corrupt


def append_jsonl(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def ledger_issues(records: DataFrame, key: str, recomputed: Column, version: int = 1, record_type: str | None = None, partition: Column | None = None) -> DataFrame:
    """Strict ledger rules: version, type, key content, partition and repeats."""
    checks = [
        F.when(~F.col("schema_version").eqNullSafe(F.lit(version)), "unsupported_schema"),
        F.when(F.col(key) != recomputed, "key_mismatch"),
    ]
    if record_type is not None:
        checks.append(F.when(~F.col("record_type").eqNullSafe(F.lit(record_type)), "wrong_record_type"))
    if partition is not None:
        checks.append(F.when(~partition, "foreign_partition"))
    bad = records.withColumn("issue", F.explode(F.array_compact(F.array(*checks)))).select(key, "issue")
    twice = records.groupBy(key).count().filter("count > 1").select(key, F.lit("duplicate_key").alias("issue"))
    return bad.unionByName(twice)


def unterminated_files(spark: SparkSession, path: str) -> DataFrame:
    """Files whose last line has no line end (sizes compared, nothing gathered)."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.octet_length("value").alias("n")
    )
    used = lines.groupBy("file", "size").agg(F.sum(F.col("n") + 1).alias("used"))
    return used.filter(F.col("used") > F.col("size")).select("file")


def capped_per_key(df: DataFrame, key: str, order: list, limit: int) -> DataFrame:
    """First ``limit`` entries per source, as the source orders them; for reports that ask for a number of entries."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit).drop("_k")


RSS_ITEM = (
    "title STRING, link STRING, guid STRUCT<_VALUE: STRING, _isPermaLink: STRING>, description STRING, "
    "source STRUCT<_VALUE: STRING, _url: STRING>, pubDate STRING"
)
ATOM_ENTRY = (
    "title STRING, id STRING, summary STRUCT<_VALUE: STRING, _type: STRING, div: STRING>, "
    "content STRUCT<_VALUE: STRING, _type: STRING, div: STRING>, author STRUCT<name: STRING>, "
    "link ARRAY<STRUCT<_href: STRING, _rel: STRING>>, published STRING, updated STRING"
)


def rss_fields(items: DataFrame) -> DataFrame:
    """RSS 2.0 items as raw entries; only an item's own date is used."""
    link = F.trim("link")
    guid = F.trim("guid._VALUE")
    return items.select(
        F.col("file").alias("feed_file"), "title", link.alias("link"),
        F.when(F.coalesce(guid, F.lit("")) != "", guid).otherwise(link).alias("feed_item_id"),
        F.col("source._VALUE").alias("publisher"), F.col("description").alias("excerpt"),
        mail_date(F.col("pubDate")).alias("published"), F.lit(None).cast("timestamp").alias("updated"),
    )


def atom_text(name: str) -> Column:
    """A text construct: as it stands, or what stands between the tags of one that holds markup."""
    inside = F.regexp_replace(F.col(f"{name}.div"), r"</?[A-Za-z][^<>]*>", "")
    return F.coalesce(inside, F.col(f"{name}._VALUE"))


def atom_fields(entries: DataFrame) -> DataFrame:
    """Atom 1.0 entries as raw entries; the first alternate link wins."""
    alternate = F.filter("link", lambda x: (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate") & x["_href"].isNotNull())
    link = F.trim(F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get("link", F.lit(0))["_href"]))
    ident = F.trim("id")
    return entries.select(
        F.col("file").alias("feed_file"), "title", link.alias("link"),
        F.when(F.coalesce(ident, F.lit("")) != "", ident).otherwise(link).alias("feed_item_id"),
        F.col("author.name").alias("publisher"), F.coalesce(atom_text("summary"), atom_text("content")).alias("excerpt"),
        offset_instant(F.col("published")).alias("published"), offset_instant(F.col("updated")).alias("updated"),
    )


def read_feed(spark: SparkSession, path: str, feed_format: str) -> DataFrame:
    """Raw entries of landed RSS or Atom files."""
    tag, schema, fields = {"rss": ("item", RSS_ITEM, rss_fields), "atom": ("entry", ATOM_ENTRY, atom_fields)}[feed_format]
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return fields(rows.withColumn("file", F.input_file_name()))


def normalize_feed(entries: DataFrame, now: Column, ipv6: bool = True, read_at: Column | None = None) -> DataFrame:
    """Entries as feed items with ``rejected`` set where they cannot be kept.

    ``now`` is what entries without a time get. Times are held against
    ``read_at``, the clock of the job that reads the files (by default ``now``).
    """
    clock = now if read_at is None else read_at
    published, updated = plausible(F.col("published"), clock), plausible(F.col("updated"), clock)
    at, basis = availability(published, updated, now)
    title = plain_text(F.col("title"))
    ident = F.col("feed_item_id")
    rejected = (
        F.when(F.coalesce(ident, F.lit("")) == "", "identity_unsafe").when(F.length(ident) > IDENTIFIER_CHARS, "identity_unsafe")
        .when(title == "", "no_title").when(F.coalesce(F.col("link"), F.lit("")) == "", "no_link")
        .when(url_issue(F.col("link"), feeds=ipv6).isNotNull(), "bad_url")
    )
    kept = [c for c in entries.columns if c not in ("title", "link", "publisher", "excerpt", "published", "updated")]
    out = entries.select(
        *kept, title.alias("title"), F.trim("link").alias("canonical_url"),
        plain_text(F.col("publisher"), default="unknown publisher").alias("publisher"),
        plain_text(F.col("excerpt")).alias("excerpt"),
        published.alias("source_published_at"),
        F.when(published.isNull() | ~updated.eqNullSafe(published), updated).alias("source_edited_at"),
        now.alias("retrieved_at"), at.alias("available_from"), basis.alias("availability_basis"), rejected.alias("rejected"),
        updated.alias("_updated"),
    )
    return out.withColumn("content_hash", feed_hash(F.col("_updated"))).drop("_updated")


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """Rows of column-oriented filing indexes.

    Columns whose length differs from ``form``'s are ignored, as absent.
    """
    fields = ("accessionNumber", "form", "filingDate", "reportDate", "acceptanceDateTime", "primaryDocument", "items")
    recent = ", ".join(f"{f}: ARRAY<STRING>" for f in fields)
    raw = spark.read.schema(f"cik STRING, filings STRUCT<recent: STRUCT<{recent}>>").json(path)
    n = F.size("filings.recent.form")
    arrays = [
        F.when(F.size(f"filings.recent.{f}") == n, F.col(f"filings.recent.{f}")).otherwise(
            F.array_repeat(F.lit(None).cast("string"), n)
        ).alias(f)
        for f in fields
    ]
    zipped = raw.filter(n > 0).select("cik", *arrays)
    return zipped.select("cik", F.posexplode(F.arrays_zip(*fields)).alias("position", "r")).select("cik", "position", "r.*")


def normalize_filings(rows: DataFrame, now: Column) -> DataFrame:
    """Filing records with links built from trusted identifiers; unusable rows are rejected, none is left out."""
    accession, form = safe_text(F.col("accessionNumber")), safe_text(F.col("form"))
    accepted = offset_instant(F.col("acceptanceDateTime"))
    number = F.col("cik").try_cast("bigint").cast("string")
    base = F.concat(F.lit(ARCHIVE), number, F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"))
    primary = safe_text(F.col("primaryDocument"))
    at, basis = availability(accepted, F.lit(None).cast("timestamp"), now, "source_event")
    items = F.filter(F.transform(F.split(safe_text(F.col("items")), ","), lambda x: F.trim(x)), lambda x: x != "")
    rejected = (
        F.when((accession == "") | (form == "") | (F.length(accession) > IDENTIFIER_CHARS), "identity_unsafe").when(implausible(accepted, now), "implausible_time")
        .when(number.isNull(), "bad_registrant")
    )
    out = rows.select(
        F.lit("edgar").alias("source"), accession.alias("source_item_id"), F.lit("official_filing").alias("source_class"),
        F.lpad(number, 10, "0").alias("cik"), form.alias("form"), base.alias("canonical_url"),
        F.when(primary != "", F.concat(base, primary)).otherwise(base).alias("primary_document_url"), items.alias("items"),
        safe_text(F.col("filingDate")).alias("filing_date"), safe_text(F.col("reportDate")).alias("report_date"),
        accepted.alias("source_event_time"), now.alias("retrieved_at"), at.alias("available_from"),
        basis.alias("availability_basis"), rejected.alias("rejected"),
    )
    return out.withColumn("content_hash", filing_hash())


NEWS_JSON = (
    "id STRING, title STRING, link STRING, publisher STRING, content STRUCT<id: STRING, title: STRING, summary: STRING, "
    "description: STRING, pubDate: STRING, displayTime: STRING, provider: STRUCT<displayName: STRING>, "
    "canonicalUrl: STRUCT<url: STRING>, clickThroughUrl: STRUCT<url: STRING>>"
)


def normalize_news(raw: DataFrame, now: Column) -> DataFrame:
    """Nested articles to news records; the URL order is canonical, click-through, link."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    ident = safe_text(F.coalesce(filled("id"), filled("content.id")))
    headline = safe_text(F.coalesce(filled("content.title"), filled("title")))
    url = F.coalesce(filled("content.canonicalUrl.url"), filled("content.clickThroughUrl.url"), filled("link"))
    when_text = F.coalesce(filled("content.pubDate"), filled("content.displayTime"))
    published = F.coalesce(offset_instant(when_text), F.timestamp_seconds(when_text.try_cast("bigint")))
    at, basis = availability(published, F.lit(None).cast("timestamp"), now)
    rejected = (
        F.when((ident == "") | (F.length(ident) > IDENTIFIER_CHARS), "identity_unsafe").when(headline == "", "no_headline").when(url.isNull(), "no_link")
        .when(url_issue(url).isNotNull(), "bad_url").when(implausible(published, now), "implausible_time")
    )
    publisher = F.when(F.col("content.provider").isNotNull(), F.col("content.provider.displayName")).otherwise(F.col("publisher"))
    extra = [c for c in raw.columns if c not in ("id", "title", "link", "publisher", "content")]
    out = raw.select(
        *extra, F.lit("yahoo").alias("source"), ident.alias("source_item_id"), F.lit("secondary_news").alias("source_class"),
        headline.alias("headline"), url.alias("canonical_url"), safe_text(publisher, default="unknown publisher").alias("publisher"),
        safe_text(F.coalesce(filled("content.summary"), filled("content.description"))).alias("summary"),
        published.alias("source_published_at"), now.alias("retrieved_at"), at.alias("available_from"),
        basis.alias("availability_basis"), rejected.alias("rejected"),
    )
    return out.withColumn("content_hash", news_hash())


def read_registrants(spark: SparkSession, path: str) -> DataFrame:
    """Symbol to zero-padded registrant number; bad rows skipped, later repeats win."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "MAP<STRING, STRUCT<cik_str: STRING, ticker: STRING>>")
    rows = raw.select(F.posexplode(entries).alias("place", "_key", "r"))
    symbol = F.upper(F.trim("r.ticker"))
    number = F.when(F.col("r.cik_str").rlike(r"^[0-9]+$"), F.col("r.cik_str").try_cast("bigint"))
    usable = rows.select("place", symbol.alias("symbol"), number.alias("n")).filter(
        symbol.rlike(r"^[A-Z0-9.\-]{1,32}$") & (F.col("n") > 0)
    )
    return usable.groupBy("symbol").agg(F.lpad(F.max_by("n", "place").cast("string"), 10, "0").alias("cik"))


def read_run_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Run starts and run records of one log, told apart by their tag, in file order."""
    from barloom.operators.provenance import RUN_LOG

    records, corrupt = read_jsonl(spark, path, RUN_LOG.replace("position BIGINT, ", ""))
    return records.withColumn("position", F.col("line_number")).drop("line_number"), corrupt
