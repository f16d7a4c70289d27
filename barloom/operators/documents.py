"""Revisioned records: point-in-time views, revision classification, links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.identity import instant_text, short_hash
from barloom.functions.urls import url_host
from barloom.operators.layout import AUTO, Layout, arrange, running
from barloom.operators.quality import implausible

ITEM = ("source", "source_item_id")
# --- fixed values: fields that may not change under one identifier ----------
IMMUTABLE = {"filing": ("cik", "form", "filing_date"), "news": ("canonical_url",)}

# --- fixed values: counter an ingestion outcome adds to ----------------------
COUNTER_OF = {
    "accepted": "accepted", "duplicate": "duplicate", "revision": "revision", "rejected": "rejected",
    "id_reuse_conflict": "errors", "identity_unsafe": "errors",
}


def available_at() -> Column:
    return F.coalesce("available_from", "retrieved_at")


def availability(published: Column, updated: Column, now: Column, published_basis: str = "source_published") -> tuple[Column, Column]:
    """When a record counts as available, and on what basis."""
    at = F.coalesce(published, updated, now)
    basis = (
        F.when(published.isNotNull(), published_basis).when(updated.isNotNull(), "source_updated").otherwise("system_observed")
    )
    return at, basis


def plausible(moment: Column, now: Column) -> Column:
    """The moment, or NULL when it lies implausibly far ahead."""
    return F.when(~implausible(moment, now), moment)


def availability_issues(docs: DataFrame) -> DataFrame:
    """Availability fields that contradict each other."""
    basis, at = F.col("availability_basis"), F.col("available_from")
    issue = (
        F.when((basis == "unknown") & at.isNotNull(), "unknown_with_time")
        .when((basis != "unknown") & at.isNull(), "basis_without_time")
        .when((basis == "source_published") & F.col("source_published_at").isNull(), "published_without_time")
        .when((basis == "source_updated") & F.col("source_edited_at").isNull(), "updated_without_time")
        .when((basis == "source_updated") & F.col("source_published_at").isNotNull(), "updated_despite_published")
    )
    return docs.withColumn("issue", issue).filter("issue IS NOT NULL")


def visible_at(as_of: Column, mode: str = "strict_causal", trust: str = "source_asserted") -> Column:
    """Whether a record may be shown for a point in time."""
    if mode == "source_time":
        return F.coalesce(F.col("source_time") <= as_of, F.lit(False))
    if mode != "strict_causal" or trust not in ("source_asserted", "system_observed"):
        raise ValueError(f"unknown mode {mode!r} or trust {trust!r}")
    at = F.col("available_from")
    known = at.isNotNull() & (F.col("availability_basis") != "unknown")
    moment = at if trust == "source_asserted" else F.greatest(at, F.col("retrieved_at"))
    return known & F.coalesce(moment <= as_of, F.lit(False))


def filter_documents(
    docs: DataFrame, start: Column | None = None, end: Column | None = None, as_of: Column | None = None,
    mode: str = "strict_causal", trust: str = "source_asserted", **equal: str | None,
) -> DataFrame:
    """Class, source, window and point-in-time filters (``equal``: column -> value)."""
    for name, value in equal.items():
        if value is not None:
            docs = docs.filter(F.col(name) == value)
    if start is not None:
        docs = docs.filter(available_at() >= start)
    if end is not None:
        docs = docs.filter(available_at() <= end)
    if as_of is not None:
        docs = docs.filter(visible_at(as_of, mode, trust))
    return docs


def newest_first(docs: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    return docs.orderBy(available_at().desc(), *item)


def latest_records(docs: DataFrame, limit: int, item: Sequence[str] = ITEM) -> DataFrame:
    """The newest ``limit`` records."""
    return newest_first(docs, item).limit(limit)


def latest_revisions(docs: DataFrame, as_of: Column | None = None, item: Sequence[str] = ITEM, seq: str = "seq") -> DataFrame:
    """Highest revision per item among what had been retrieved by ``as_of``.

    An aggregate, so an item with very many revisions is reduced map-side.
    """
    if as_of is not None:
        docs = docs.filter(F.col("retrieved_at") <= as_of)
    rest = [c for c in docs.columns if c not in item]
    best = docs.groupBy(*item).agg(F.max_by(F.struct(*rest), F.struct("revision", -F.col(seq))).alias("_r"))
    return best.select(*item, "_r.*")


def classify_revisions(
    stored: DataFrame | None, incoming: DataFrame, item: Sequence[str] = ITEM, signature: str = "immutable_signature",
    content: str = "content_hash", seq: str = "seq", layout: Layout = AUTO,
) -> DataFrame:
    """Outcome and revision number of every arriving record.

    accepted / duplicate / revision / id_reuse_conflict, in arrival order, with
    any number of versions of one item in the batch. All accepted versions share
    the first version's signature, so a conflict is decided by that one alone;
    among the rest a changed hash is a revision and its number a running count.
    """
    item = list(item)
    cols = [*item, signature, content, seq]
    # an arriving record is carried through the order as it is and gets its verdict there
    carried = F.struct(*[F.col(c) for c in incoming.columns if c != "revision"])
    rows = incoming.select(*cols, F.lit(1).alias("_stage"), F.lit(0).alias("_rev"), carried.alias("_row"))
    if stored is not None:
        newest = latest_revisions(stored, item=item, seq=seq)
        rows = rows.unionByName(newest.select(*cols, F.lit(0).alias("_stage"), F.col("revision").cast("int").alias("_rev"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")))
    first = rows.groupBy(*item).agg(F.min_by(F.struct(F.col(signature).alias("s")), F.struct("_stage", seq)).alias("_first"))
    judged = rows.join(first, item).withColumn("_conflict", ~F.col("_first.s").eqNullSafe(F.col(signature))).drop("_first")
    arranged = arrange(judged.filter(~F.col("_conflict")), item, ("_stage", seq), before=1, layout=layout)
    previous = F.lag(content).over(arranged.window)
    changed = previous.isNull() | (previous == "") | ~previous.eqNullSafe(F.col(content))
    step = F.when(F.col("_stage") == 0, F.col("_rev")).when(changed, 1).otherwise(0)
    arranged = running(arranged.with_columns({"_changed": changed, "_step": step.cast("long")}), {"_revision": ("_step", "sum")})
    outcome = F.when(F.col("_rn") == 1, "accepted").when(F.col("_changed"), "revision").otherwise("duplicate")
    kept = arranged.df.filter("_stage = 1").select("_row.*", outcome.alias("outcome"), F.col("_revision").alias("revision"))
    refused = judged.filter("_conflict AND _stage = 1").select(
        "_row.*", F.lit("id_reuse_conflict").alias("outcome"), F.lit(None).cast("long").alias("revision")
    )
    return kept.unionByName(refused)


def to_append(classified: DataFrame) -> DataFrame:
    """Records an append-only store keeps."""
    return classified.filter(F.col("outcome").isin("accepted", "revision"))


def ingestion_counters(classified: DataFrame, source: str = "source", associations: DataFrame | None = None) -> DataFrame:
    """Counters per source and in total (source NULL)."""
    o = F.col("outcome")
    names = sorted(set(COUNTER_OF.values()))
    out = classified.rollup(source).agg(
        F.count(F.lit(1)).alias("fetched"),
        *[F.count_if(o.isin(*[k for k, v in COUNTER_OF.items() if v == n])).alias(n) for n in names],
    )
    if associations is not None:
        linked = associations.rollup(source).agg(F.count(F.lit(1)).alias("associations"))
        out = out.alias("a").join(linked.alias("b"), F.col(f"a.{source}").eqNullSafe(F.col(f"b.{source}")), "left").select(
            "a.*", F.coalesce("b.associations", F.lit(0)).alias("associations")
        )
    return out


def overall_status(results: DataFrame, healthy: Column, feeds: bool = False) -> DataFrame:
    """all_ok / partial / all_failed; switched-off feeds are not counted."""
    rows = results.filter(F.col("outcome") != "unconfigured") if feeds else results
    good, n = F.count_if(healthy), F.count(F.lit(1))
    status = F.when(n == 0, "all_ok" if feeds else "all_failed").when(good == n, "all_ok").when(good > 0, "partial").otherwise("all_failed")
    counted = rows.agg(status.alias("status"))
    if not feeds:
        return counted
    every = results.agg(F.count(F.lit(1)).alias("_n"))
    return counted.crossJoin(every).select(F.when(F.col("_n") == 0, "nothing_configured").otherwise(F.col("status")).alias("status"))


def new_links(stored: DataFrame, incoming: DataFrame, key: Sequence[str] = ("source", "source_item_id", "symbol", "association")) -> DataFrame:
    """Links whose key is not stored yet, each once."""
    return incoming.dropDuplicates(list(key)).join(stored.select(*key), list(key), "left_anti")


def linked_documents(docs: DataFrame, links: DataFrame, symbol: str, item: Sequence[str] = ITEM) -> DataFrame:
    """Documents with a link to the symbol."""
    wanted = links.filter(F.col("symbol") == symbol.strip().upper()).select(*item)
    return docs.join(wanted, list(item), "left_semi")


def symbols_per_item(links: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    """Distinct symbols of each item, sorted (bounded by the universe)."""
    return links.select(*item, "symbol").distinct().groupBy(*item).agg(
        F.sort_array(F.collect_set("symbol")).alias("symbols")
    )


def class_counts(docs: DataFrame) -> DataFrame:
    """Official and secondary records."""
    return docs.groupBy("source_class").agg(F.count(F.lit(1)).alias("documents"))


def registrants_of(symbols: DataFrame, registrants: DataFrame) -> DataFrame:
    """Registrant number per symbol; NULL means unsupported, not "no news"."""
    return symbols.join(registrants, "symbol", "left")


def immutable_signature(kind: str) -> Column:
    if kind == "feed":
        return url_host(F.col("canonical_url"))
    return F.concat_ws("\u001f", *[F.coalesce(F.col(c), F.lit("")) for c in IMMUTABLE.get(kind, ())])


def news_hash() -> Column:
    return short_hash(
        *[F.col(c) for c in ("headline", "summary", "canonical_url", "publisher")], instant_text(F.col("source_published_at"))
    )


def filing_hash() -> Column:
    return short_hash(
        F.col("cik"), F.col("form"), F.array_join("items", "\u001f"), F.col("filing_date"), F.col("report_date"),
        F.col("primary_document_url"), instant_text(F.col("source_event_time")),
    )


def feed_hash(updated: Column) -> Column:
    """Digest of a feed entry; ``updated`` is the entry's own, also where it equals the publication."""
    return short_hash(
        *[F.col(c) for c in ("title", "excerpt", "canonical_url", "publisher")],
        instant_text(F.col("source_published_at")), instant_text(updated),
    )
