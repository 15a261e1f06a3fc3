"""WARC: resolving not-modified revisits.

A crawl log has full responses and revisit records, which a server answered
with "not modified" and which carry no body.  Each revisit is matched to the
latest earlier full response of the same canonical URL (an as-of join), its
validators are checked against that response, and a complete record is made
from the stored body and the headers that such an answer may update.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Headers that a not-modified answer may update (RFC 9110, 15.4.5); others stay as stored.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

#: Query parameters that only track where a visit came from.
TRACKING = "utm_[a-z_]+|gclid|fbclid"
#: Seconds of a URL's log that one window goes over; what is known at its start is carried in.
SLOT = 3600


def canonical_url(url: Column) -> Column:
    """The URL in one form for all that name the same resource.

    Scheme and host are in lower case, and http and https are one; a leading
    ``www.``, the default port, the fragment, tracking parameters (``TRACKING``)
    and slashes at the path's end go; parameters are in order.  Case counts in
    path and query.
    """
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(whole, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]|:(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(bare, "^[^?]*[?](.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda x: (x != "") & ~x.rlike(f"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def canonical_sql(url: str) -> str:
    """``canonical_url`` in DuckDB."""
    bare = f"regexp_replace(regexp_replace(trim({url}), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    kept = f"list_sort(list_filter(string_split(regexp_extract({bare}, '^[^?]*[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^({TRACKING})(=|$)')))"
    host = f"regexp_replace(lower(regexp_extract({bare}, '^[^/?]*')), '^www[.]|:(80|443)?$', '', 'g')"
    path = f"regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/+$', '')"
    return f"{host} || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"


def capture_log(pages: DataFrame) -> DataFrame:
    """A crawl log over the table ``pages``, which has only bodies.

    Each page is a full response, fetched at ``page_id`` * 10 seconds with its
    md5 as ETag; pages whose number divides by 7 carry no ETag, only a
    Last-Modified.  Each is visited again 5 seconds after its own fetch and
    once much later, when another page with the same canonical URL may have
    replaced it; each 11th later revisit quotes an ETag that was never stored.
    Columns: ``record_id, url, kind, at, headers, body``; a null ``page_id`` has
    null times and is never matched.
    """
    page = F.col("page_id")
    etag = F.when(page % 7 != 0, F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"')))
    modified = F.when(page % 7 == 0, F.concat(F.lit("t"), page.cast("string")))

    def headers(*pairs):
        return F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs])), lambda k, v: v.isNotNull())

    def at(x):
        return F.timestamp_seconds(F.lit(1_700_000_000) + x)

    stamp = lambda x: (F.lit(1_700_000_000) + x).cast("string")
    first, soon, late = page * 10, page * 10 + 5, page * 10 + 3_000_000
    full = F.struct(
        (page * 3).alias("record_id"), F.lit("response").alias("kind"), at(first).alias("at"),
        headers(("content-type", F.lit("text/html")), ("content-length", F.length("html").cast("string")), ("date", stamp(first)), ("etag", etag), ("last-modified", modified)).alias("headers"), F.col("html").alias("body"),
    )
    none = F.lit(None).cast("string").alias("body")
    again = F.struct(
        (page * 3 + 1).alias("record_id"), F.lit("revisit").alias("kind"), at(soon).alias("at"),
        headers(("content-length", F.lit("0")), ("date", stamp(soon)), ("expires", stamp(soon + 60)), ("etag", etag), ("last-modified", modified)).alias("headers"), none,
    )
    stale = F.when(page % 11 == 0, F.lit('"stale"')).otherwise(etag)
    later = F.struct(
        (page * 3 + 2).alias("record_id"), F.lit("revisit").alias("kind"), at(late).alias("at"),
        headers(("content-length", F.lit("0")), ("date", stamp(late)), ("cache-control", F.lit("max-age=60")), ("etag", stale), ("last-modified", modified)).alias("headers"), none,
    )
    return pages.select("url", F.explode(F.array(full, again, later)).alias("r")).select("r.record_id", "url", "r.kind", "r.at", "r.headers", "r.body")


def _lower_names(headers: Column) -> Column:
    """Headers with their names in lower case; of names that then are equal the first in order of (name, value)."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    first = F.transform(names, lambda n: F.filter(entries, lambda e: F.lower(e["key"]) == n)[0]["value"])
    return F.when(headers.isNull(), F.expr("cast(map() as map<string,string>)")).otherwise(F.map_from_arrays(names, first))


def latest_earlier(slim: DataFrame, full: Column) -> DataFrame:
    """The revisits with ``stored``, the latest response of their URL before them, as of their time.

    A URL's log is cut into slots of time.  A window goes over one slot, and
    what was last stored before a slot comes from a window over a row for each
    slot, so that a URL that is visited all the time is sorted in many tasks.
    """
    slotted = slim.withColumn("slot", F.floor(F.col("at").cast("double") / SLOT))
    rank = F.struct("at", F.col("record_id").isNotNull().alias("known"), "record_id")
    ends = slotted.where("is_full").groupBy("canonical", "slot").agg(F.max_by(full, rank).alias("stored_last"))
    slots = ends.unionByName(slotted.where("NOT is_full").select("canonical", "slot").distinct(), allowMissingColumns=True)
    slots = slots.groupBy("canonical", "slot").agg(F.max("stored_last").alias("stored_last"))
    before = Window.partitionBy("canonical").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("canonical", "slot", F.last("stored_last", ignorenulls=True).over(before).alias("carried"))
    # at equal times revisits come first, so that "earlier" is strict
    order = Window.partitionBy("canonical", "slot").orderBy("at", "is_full", F.col("record_id").asc_nulls_first())
    here = F.last(F.when(F.col("is_full"), full), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = slotted.withColumn("here", here).where("NOT is_full").join(carried, ["canonical", "slot"], "left")
    return found.withColumn("stored", F.coalesce("here", "carried")).drop("here", "carried", "slot")


def resolve_revisits(log: DataFrame) -> DataFrame:
    """Complete records for the revisits: ``record_id, canonical, at, status, source_id, headers, body``.

    ``status`` is ``resolved``; ``no-earlier-response`` (none of this canonical
    URL at a time before the revisit's); ``etag-mismatch`` or
    ``date-mismatch`` (both records have the validator and it differs; a weak
    ETag equals its strong form); or ``no-validator`` (no validator that both
    records have).  An ETag decides before Last-Modified.  Unless resolved,
    ``source_id`` and the body are null and the headers are the revisit's own.
    A resolved record has the stored headers, with those of ``PERMITTED`` that
    the revisit carries in place of the stored ones; a name that isn't permitted
    is never taken from it.

    Names of headers compare and come out in lower case.  Of responses at the
    same time the one with the largest ``record_id`` is the latest, nulls being
    the smallest; a response at the revisit's own time isn't earlier.  A revisit
    without URL or time has no earlier response; null headers are empty.
    Repeated revisits give repeated results; responses with one ``record_id``
    are one response, with the smallest of their bodies.  An empty log gives an
    empty result.  ``at`` is a time or a number of seconds.  Other columns are
    not read, whatever they are called.

    Only slim rows (URL, time, headers) are sorted; bodies are joined by
    ``record_id`` afterwards, and only those of responses that a revisit needs.
    """
    slim = log.select("record_id", F.col("kind"), F.col("at"), _lower_names(F.col("headers")).alias("headers"), canonical_url(F.col("url")).alias("canonical"))
    slim = slim.withColumn("is_full", F.col("kind") == "response").where("is_full OR kind = 'revisit'")
    # entries in place of a map, so that rows can be compared
    full = F.struct("record_id", F.map_entries("headers").alias("entries"))
    usable = F.col("canonical").isNotNull() & F.col("at").isNotNull()
    dated = latest_earlier(slim.where(usable), full)
    kind = dated.schema["stored"].dataType
    revisits = dated.unionByName(slim.where(~usable & ~F.col("is_full")).withColumn("stored", F.lit(None).cast(kind)))
    bare = lambda x: F.regexp_replace(x, "^W/", "")
    mine, theirs = F.col("headers"), F.map_from_entries("stored.entries")
    tag, old_tag, date, old_date = mine["etag"], theirs["etag"], mine["last-modified"], theirs["last-modified"]
    status = (
        F.when(F.col("stored").isNull(), "no-earlier-response")
        .when(tag.isNotNull() & old_tag.isNotNull(), F.when(bare(tag) == bare(old_tag), "resolved").otherwise("etag-mismatch"))
        .when(date.isNotNull() & old_date.isNotNull(), F.when(date == old_date, "resolved").otherwise("date-mismatch"))
        .otherwise("no-validator")
    )
    permitted = F.array(*[F.lit(h) for h in PERMITTED])
    update = F.map_filter(mine, lambda k, v: F.array_contains(permitted, k) & v.isNotNull())
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(update, k)), update)
    resolved = F.col("status") == "resolved"
    found = revisits.withColumn("status", status).select(
        "record_id",
        "canonical",
        "at",
        "status",
        F.when(resolved, F.col("stored.record_id")).alias("source_id"),
        F.when(resolved, merged).otherwise(mine).alias("headers"),
    )
    # written once: the sources are asked for first, and then take their bodies to the records
    found = materialise(found)
    wanted = found.where("source_id IS NOT NULL").select(F.col("source_id").alias("w_id")).distinct()
    stored = log.where("kind = 'response' AND record_id IS NOT NULL").select(F.col("record_id").alias("b_id"), "body")
    bodies = stored.join(wanted, F.col("b_id") == F.col("w_id"), "left_semi").groupBy("b_id").agg(F.min("body").alias("body"))
    return found.join(bodies, F.col("source_id") == F.col("b_id"), "left").drop("b_id")


def header_lines(headers: Column) -> Column:
    """A header map as text, a line for each name in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def resolve_pages(pages: DataFrame) -> DataFrame:
    """``resolve_revisits`` over the log of ``capture_log``, with times in seconds and headers as lines.

    Each row of ``pages`` gives two revisits, repeated rows too; a null
    ``page_id`` or ``url`` gives two without an earlier response, an empty table
    none.  A null ``html`` is stored as a null body.
    """
    out = resolve_revisits(capture_log(pages))
    return out.select("record_id", "canonical", F.unix_seconds("at").alias("at_seconds"), "status", "source_id", header_lines(F.col("headers")).alias("headers"), "body")


def resolve_pages_sql() -> str:
    names = ", ".join(f"'{h}'" for h in PERMITTED)
    return f"""
WITH base AS (
  SELECT page_id AS p, {canonical_sql('url')} AS canonical, html,
    CASE WHEN page_id % 7 <> 0 THEN '"' || md5(html) || '"' END AS etag, CASE WHEN page_id % 7 = 0 THEN 't' || page_id END AS modified
  FROM pages),
log AS (
  SELECT p * 3 AS record_id, canonical, TRUE AS is_full, 1700000000 + p * 10 AS at, etag, modified,
    [('content-type', 'text/html'), ('content-length', length(html)::VARCHAR), ('date', (1700000000 + p * 10)::VARCHAR), ('etag', etag), ('last-modified', modified)] AS h, html AS body FROM base
  UNION ALL SELECT p * 3 + 1, canonical, FALSE, 1700000000 + p * 10 + 5, etag, modified,
    [('content-length', '0'), ('date', (1700000000 + p * 10 + 5)::VARCHAR), ('expires', (1700000000 + p * 10 + 65)::VARCHAR), ('etag', etag), ('last-modified', modified)], NULL FROM base
  UNION ALL SELECT p * 3 + 2, canonical, FALSE, 1700000000 + p * 10 + 3000000, CASE WHEN p % 11 = 0 THEN '"stale"' ELSE etag END, modified,
    [('content-length', '0'), ('date', (1700000000 + p * 10 + 3000000)::VARCHAR), ('cache-control', 'max-age=60'), ('etag', CASE WHEN p % 11 = 0 THEN '"stale"' ELSE etag END), ('last-modified', modified)], NULL FROM base),
matched AS (
  SELECT v.*, r.record_id AS r_id, r.etag AS r_etag, r.modified AS r_modified, r.h AS r_h, r.body AS r_body
  FROM (SELECT * FROM log WHERE NOT is_full) v ASOF LEFT JOIN (SELECT * FROM log WHERE is_full) r ON v.canonical = r.canonical AND v.at > r.at),
judged AS (
  SELECT *, CASE WHEN r_id IS NULL THEN 'no-earlier-response'
    WHEN etag IS NOT NULL AND r_etag IS NOT NULL THEN CASE WHEN etag = r_etag THEN 'resolved' ELSE 'etag-mismatch' END
    WHEN modified IS NOT NULL AND r_modified IS NOT NULL THEN CASE WHEN modified = r_modified THEN 'resolved' ELSE 'date-mismatch' END
    ELSE 'no-validator' END AS status FROM matched),
pairs AS (
  SELECT record_id, 1 AS own, unnest(h) AS e FROM judged
  UNION ALL SELECT record_id, 0, unnest(r_h) FROM judged WHERE status = 'resolved'),
picked AS (
  SELECT record_id, e[1] AS k, arg_max(e[2], own) AS v FROM pairs JOIN judged USING (record_id)
  WHERE e[2] IS NOT NULL AND (own = 0 OR status <> 'resolved' OR e[1] IN ({names})) GROUP BY 1, 2),
texts AS (SELECT record_id, string_agg(k || ': ' || v, chr(10) ORDER BY k) AS headers FROM picked GROUP BY 1)
SELECT j.record_id, j.canonical, j.at AS at_seconds, j.status, CASE WHEN status = 'resolved' THEN r_id END AS source_id, t.headers, CASE WHEN status = 'resolved' THEN r_body END AS body
FROM judged j JOIN texts t USING (record_id)"""
