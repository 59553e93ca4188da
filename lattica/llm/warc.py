"""WARC captures: resolving not-modified revisits to the responses they stand for.

A server that answers 304 leaves a `revisit` record without a body. `resolve` finds for each the latest earlier full
response of the same canonical URL (as-of join), checks the validators that both name (ETag, weakly compared, or where
not both have one Last-Modified; and the payload digest), and merges the headers that a 304 may update into those of
the response. Revisits of the profile `identical-payload-digest` (the server sent the whole response again) keep their
own headers and are resolved only where the digests are equal. A full response is one with status 200; without a column
`status`, any response.

The as-of join has two levels, so that a URL with a third of all captures, or many of one instant, is no one task's
work: captures are dealt by ranges of URL, time and record, where a running maximum gives the latest response in the
range; the latest response of earlier ranges comes from one pre-aggregated row for each URL and range. Bodies are neither
read nor moved: results name the record that holds the body. Everything is DataFrame operations.

Records: record_id, type (`response` or `revisit`), uri, captured (timestamp), headers (map of lower-case names),
digest, and, if there are such columns, status (integer) and profile (text). Defined results: a revisit without an
earlier full response is `missing`; one whose validators differ is `changed` (nothing is merged); else `resolved`.
Captures of one instant are ordered by record_id, a response never resolves a revisit of the same instant and a smaller
id before it. A null uri or time can't be resolved (`missing`). Null headers count as none, and so do null validators; a
null status is no 200, a null profile is a 304, a record of another or no type is left out. Repeated rows resolve each.
Very long URIs are read whole. An empty table gives an empty result. Extra columns pass through; where one has the name
of a new column, the new one takes an underscore in front (`free_name`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, ranged, table

#: Headers that a 304 response carries about the stored one (fixed values, RFC 9110 and 9111).
MERGED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
IDENTICAL = "identical-payload-digest"
_TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(uri: Column) -> Column:
    """Host and path as captures are keyed: no scheme, `www.`, default port, fragment, tracking or final slash; query sorted."""
    rest = F.regexp_replace(F.regexp_replace(uri, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.translate(F.regexp_extract(rest, "^([^/?]*)", 1), _UPPER, _LOWER)
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda x: (x != "") & ~x.rlike(_TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """The revisits of records, with url (canonical), source_id, outcome and merged headers."""
    url, part, here, before = (free_name(records, c) for c in ("url", "part", "here", "before"))
    outcome_, source_id, merged_ = (free_name(records, c) for c in ("outcome", "source_id", "merged"))
    none = F.create_map().cast("map<string,string>")
    rows = records.where(F.col("type").isin("response", "revisit")).withColumn(url, canonical(F.col("uri")))
    response = F.col("type") == "response"
    full = response & F.coalesce(F.col("status") == 200, F.lit(False)) if "status" in records.columns else response
    body = F.struct("captured", "record_id", F.coalesce("headers", none).alias("headers"), "digest")
    # responses that aren't full are no one's source, and aren't dealt
    lean = ranged(rows.where((full | ~response) & F.col(url).isNotNull() & F.col("captured").isNotNull()), [url, "captured", "record_id"], part)
    # the latest response of each URL and range, and from these the latest of earlier ranges: a row for each URL and range
    key = F.struct("captured", "record_id")
    last = lean.where(response).groupBy(url, part).agg(F.max_by(body, key).alias("b"))
    asked = lean.where(~response).select(url, part).distinct()
    w = Window.partitionBy(url).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.join(asked, [url, part], "full").withColumn(before, F.last("b", ignorenulls=True).over(w)).where(F.col(before).isNotNull()).select(url, part, before)
    inner = Window.partitionBy(url, part).orderBy("captured", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = lean.withColumn(here, F.last(F.when(response, body), ignorenulls=True).over(inner)).where(~response)
    found = found.join(carried, [url, part], "left")
    lost = rows.where(~response & (F.col(url).isNull() | F.col("captured").isNull()))
    found = found.unionByName(lost, allowMissingColumns=True)
    source = F.coalesce(here, before)
    own, theirs = F.coalesce("headers", none), source["headers"]
    differs = lambda a, b: F.coalesce(a != b, F.lit(False))
    tags = own["etag"].isNotNull() & theirs["etag"].isNotNull()
    changed = F.when(tags, _weak(own["etag"]) != _weak(theirs["etag"])).otherwise(differs(own["last-modified"], theirs["last-modified"])) | differs(F.col("digest"), source["digest"])
    whole = F.coalesce(F.col("profile").endswith(IDENTICAL), F.lit(False)) if "profile" in records.columns else F.lit(False)
    changed = F.when(whole, ~F.coalesce(F.col("digest") == source["digest"], F.lit(False))).otherwise(changed)
    outcome = F.when(source.isNull(), "missing").when(changed, "changed").otherwise("resolved")
    update = F.map_filter(own, lambda k, _: k.isin(*MERGED))
    merged = F.when(whole, own).otherwise(F.map_concat(F.map_filter(theirs, lambda k, _: ~F.map_contains_key(update, k)), update))
    out = found.withColumns({outcome_: outcome, source_id: F.when(outcome != "missing", source["record_id"]), merged_: F.when(outcome == "resolved", merged)})
    return out.select(*(F.col(f"`{c}`") for c in (*records.columns, url, outcome_, source_id, merged_)))


def captures(pages: DataFrame) -> DataFrame:
    """Four captures of each page, as a crawler would have left them: two responses, a revisit after each.

    Times, validators and the page's version follow from the page's id and content alone. By page number, the first
    revisit comes before any response (11), the last names a new validator (7), the server sends Last-Modified and no
    ETag (5), the second response is a 404 (13), the last revisit is of an identical payload (3) or of another one (9).
    """
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    day = F.pmod(F.col("page_id") * 7919, F.lit(90))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("type")) for k, t in ((0, "response"), (1, "revisit"), (2, "response"), (3, "revisit")))))
    rows = pages.select("page_id", "url", digest.alias("d"), day.alias("day"), each.alias("x"))
    k, page = F.col("x.k"), F.col("page_id")
    at = F.col("day") * 86400 + k * 30_000 - F.when((k == 1) & (page % 11 == 0), 60_000).otherwise(0)
    version = F.concat(F.substring("d", 1, 8), F.when((k == 3) & (page % 7 == 0), "-new").otherwise(""))
    tag = F.when(page % 5 == 0, version).otherwise(F.concat(F.when(k % 2 == 1, "W/").otherwise(""), F.lit('"'), version, F.lit('"')))
    names = [F.when(page % 5 == 0, "last-modified").otherwise("etag"), tag, F.lit("date"), F.concat(F.lit("t"), at.cast("string")), F.lit("x-served-by"), F.concat(F.lit("n"), k.cast("string"))]
    headers = F.when(k % 2 == 0, F.create_map(*names, F.lit("content-type"), F.lit("text/html"))).otherwise(F.create_map(*names))
    same = (k == 3) & (page % 3 == 0)
    digest = F.when(k % 2 == 0, F.col("d")).when(same, F.concat("d", F.when(page % 9 == 0, "x").otherwise("")))
    status = F.when((k == 2) & (page % 13 == 0), 404).when(k % 2 == 0, 200).otherwise(304)
    return rows.select((page * 4 + k).alias("record_id"), F.col("x.type").alias("type"), F.col("url").alias("uri"), F.timestamp_seconds(at + 1_700_000_000).alias("captured"), headers.alias("headers"), digest.alias("digest"), status.alias("status"), F.when(same, IDENTICAL).alias("profile"))


def op8_warc_revisits(spark, sf_dir: str) -> DataFrame:
    got = resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return got.select("record_id", "url", "outcome", "source_id", F.coalesce(flat, F.lit("")).alias("merged"))


QUERIES = {"op8_warc_revisits": op8_warc_revisits}
ORACLE_SQL = {
    "op8_warc_revisits": r"""
with base as (
  select page_id, url as uri, md5(coalesce(html, '')) as d, (page_id * 7919) % 90 as day, unnest([0, 1, 2, 3]) as k from pages
), cap as (
  select page_id * 4 + k as record_id, k, uri, page_id, day * 86400 + k * 30000 - case when k = 1 and page_id % 11 = 0 then 60000 else 0 end as t,
    substr(d, 1, 8) || case when k = 3 and page_id % 7 = 0 then '-new' else '' end as version, page_id % 5 = 0 as dated,
    k % 2 = 0 and not (k = 2 and page_id % 13 = 0) as whole, k = 3 and page_id % 3 = 0 as same,
    case when k % 2 = 0 then d when k = 3 and page_id % 3 = 0 then d || case when page_id % 9 = 0 then 'x' else '' end end as digest,
    regexp_replace(regexp_replace(uri, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest
  from base
), canon as (
  select * exclude (rest),
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[.]', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'), lambda x: x != '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&'), ''), '') as url
  from cap
), picked as (
  select r.*, (select arg_max(s.record_id, (s.t, s.record_id)) from canon s where s.url = r.url and s.whole and (s.t < r.t or s.t = r.t and s.record_id < r.record_id)) as source_id
  from canon r where r.k % 2 = 1
), best as (
  select p.*, s.version as v, s.dated as sdated, s.digest as sdigest, s.k as sk, s.t as st,
    case when source_id is null then 'missing' when p.same then case when p.digest = s.digest then 'resolved' else 'changed' end
      when p.dated = s.dated and p.version != s.version or p.digest != s.digest then 'changed' else 'resolved' end as outcome
  from picked p left join canon s on s.record_id = p.source_id
)
select record_id, url, outcome, source_id, case when outcome != 'resolved' then '' when same then
    'date=t' || t || case when dated then ';last-modified=' || version else ';etag=W/"' || version || '"' end || ';x-served-by=n' || k
  else 'content-type=text/html;date=t' || t || case when not dated then ';etag=W/"' || version || '"' when not sdated then ';etag="' || v || '"' else '' end
    || case when dated then ';last-modified=' || version when sdated then ';last-modified=' || v else '' end || ';x-served-by=n' || sk end as merged
from best""",
}
