"""Queries over addresses, captures, fetch events, names and overlaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import dates, text, urls
from lexmill.operators import entities, history, overlap, records, search
from lexmill.plans.corpus import ART, art, iso
from lexmill.sources.tables import table
from lexmill.streaming import limiter


def url_clean(spark, d):
    u = table(spark, d, "capture_rows").select("original").distinct()
    c = u.withColumn("clean", urls.clean_url(F.col("original")))
    return c.select("original", "clean", urls.canonical(F.col("clean")).alias("key"), urls.slugify(F.col("clean")).alias("slug"), urls.path_of(F.col("clean")).alias("path"))


def url_kind(spark, d):
    u = table(spark, d, "url_entries").select("url").distinct()
    return u.select("url", urls.kind(F.col("url"), urls.clean_url(F.col("url"))).alias("kind"))


def url_views(spark, d):
    u = table(spark, d, "url_entries").select("url").distinct().withColumn("clean", urls.clean_url(F.col("url")))
    v = lambda view: urls.legacy_view(F.col("clean"), view, "https://www.pigskin-ledger.example")
    return u.select("url", v("article").alias("body_url"), v("comments").alias("comments_url"), urls.content_id(F.col("clean")).alias("content_id"))


def url_merge(spark, d):
    return records.merge_entries(table(spark, d, "url_entries").unionByName(table(spark, d, "capture_rows").select(F.col("original").alias("url")), allowMissingColumns=True))


def first_capture_of_month(spark, d):
    """The archive's own reduction: of successful captures of an address the first in each month."""
    c = table(spark, d, "capture_rows").where("statuscode = '200'").select(urls.clean_url(F.col("original")).alias("url"), F.substring("timestamp", 1, 6).alias("month"), "timestamp")
    return c.groupBy("url", "month").agg(F.min("timestamp").alias("timestamp"))


def earliest_capture(spark, d):
    c = table(spark, d, "capture_rows").where("timestamp is not null").select(urls.canonical(urls.clean_url(F.col("original"))).alias("key"), "timestamp", "original")
    return records.first_per(c, ["key"], ["timestamp", "original"])


def captures_by_day(spark, d):
    """Every day of 2014, with captures or without; ``captures_by_every_day`` has all days."""
    c = table(spark, d, "capture_rows").where("timestamp rlike '^[0-9]{14}$'").select(F.try_to_date(F.substring("timestamp", 1, 8), "yyyyMMdd").alias("day")).groupBy("day").agg(F.count("*").alias("captures"))
    days = records.calendar(spark, "2014-01-01", "2014-12-31")
    return days.join(c, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("captures", F.lit(0)).alias("captures"), F.when(F.col("captures").isNull(), "no_capture").otherwise("captured").alias("state"))


def captures_by_every_day(spark, d):
    """Every day from the first capture's to the last one's, with captures or without."""
    c = table(spark, d, "capture_rows").where("timestamp rlike '^[0-9]{14}$'").select(F.try_to_date(F.substring("timestamp", 1, 8), "yyyyMMdd").alias("day")).where("day is not null").groupBy("day").agg(F.count("*").alias("captures"))
    days = c.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))  # one row a day
    return days.join(c, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("captures", F.lit(0)).alias("captures"), F.when(F.col("captures").isNull(), "no_capture").otherwise("captured").alias("state"))


def unfetched(spark, d):
    """Addresses of article kind without a successful fetch."""
    u = table(spark, d, "url_entries").where("kind not in ('index', 'nav', 'pagination')").select("url").distinct()
    return u.join(table(spark, d, "fetch_events").where("outcome = 'ok'").select("url").distinct(), "url", "left_anti")


def _events(spark, d):
    """Each event once, however often it was delivered."""
    return table(spark, d, "fetch_events").dropDuplicates(["fetch_id"])


def status_counts(spark, d):
    u = table(spark, d, "url_entries").groupBy("kind", "status").agg(F.count("*").alias("n"))
    return u


def outcome_counts(spark, d):
    return _events(spark, d).groupBy("phase", "outcome").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))


def latest_event(spark, d):
    return _events(spark, d).where("url is not null").groupBy("url").agg(F.max(F.struct("at", "fetch_id", "phase", "outcome")).alias("x")).select("url", "x.at", "x.fetch_id", "x.phase", "x.outcome")


def tail_events(spark, d):
    return _events(spark, d).select("fetch_id", "at", "phase", "outcome", "url").orderBy(F.desc("at"), F.desc("fetch_id")).limit(120)  # the log's tail


def retryable(spark, d):
    e = _events(spark, d).where(F.col("http_status").isin(429, 503) | F.col("error_type").isin("ConnectionError", "Timeout"))
    return e.groupBy("error_type", "http_status").agg(F.count("*").alias("n"))


def fixed_failures(spark, d):
    """Failures that a later success of the same address made up for, by kind."""
    e = _events(spark, d).where("url is not null")
    ok = e.where("outcome = 'ok'").groupBy("url").agg(F.max("at").alias("ok_at"))
    bad = e.where(F.col("outcome").startswith("failed")).groupBy("url", "outcome").agg(F.min("at").alias("bad_at"))
    return bad.join(ok, "url").where("ok_at > bad_at").groupBy("outcome").agg(F.count("*").alias("urls"))


def milestones(spark, d):
    """Every two hundredth address that was recovered, in order of its first success."""
    ok = _events(spark, d).where("outcome = 'ok' and phase = 'fetch' and url is not null").groupBy("url").agg(F.min(F.struct("at", "fetch_id")).alias("x")).select("url", "x.at", "x.fetch_id")
    n = records.numbered(ok, [F.col("at"), F.col("fetch_id"), F.col("url")], "pos")
    return n.withColumn("recovered", F.col("pos") + 1).where("recovered % 200 = 0").select("recovered", "at", "url")


def byline_split(spark, d):
    """Verdicts per source, and how many bylines are joint."""
    a = art(spark, d).join(table(spark, d, "articles").groupBy("slug").agg(F.min("byline_source").alias("source")), "slug")
    v = F.coalesce("byline_verdict", F.lit("unparsed"))
    return a.groupBy("source").agg(
        F.count_if(v == "varrick").alias("target"), F.count_if(v == "other").alias("other"), F.count_if(v == "unparsed").alias("unread"),
        F.count_if(F.size(entities.byline_names(F.coalesce("byline_raw", F.lit("")))) > 1).alias("joint"), F.round(100 * F.avg(F.when(v == "varrick", 1.0).otherwise(0.0)), 1).alias("percent"),
    )


def byline_names(spark, d):
    n = art(spark, d).where("byline_raw is not null").select("slug", F.explode(entities.byline_names(F.col("byline_raw"))).alias("name"))
    return n.groupBy("name").agg(F.count("*").alias("n"))


def norm_dates(spark, d):
    return art(spark, d).select("slug", dates.norm_date(F.coalesce("date", F.lit(""))).alias("iso"))


def decile_bands(spark, d):
    a = art(spark, d).select("slug")
    total = a.count()
    return records.bands(a, [F.col("slug")], 10, total).groupBy("band").agg(F.count("*").alias("n"), F.min("slug").alias("first"), F.max("slug").alias("last"))


def systematic_sample(spark, d):
    a = art(spark, d).select("slug")
    return records.systematic(a, [F.col("slug")], 50, a.count()).select("slug", "pos")


def stratified_sample(spark, d):
    a = art(spark, d).select("slug")
    return records.stratified(records.bands(a, [F.col("slug")], 10, a.count()), "band", "slug", 10, 20260907)


def team_entities(spark, d):
    """Teams of the entity lists found in titles and bodies by full name or nickname (the last word or two)."""
    teams = table(spark, d, "articles").select(F.explode("entities.teams").alias("team")).where("team is not null").distinct()
    words = F.split("team", " ")
    nick = F.when(F.col("team").endswith("Dust Devils"), F.lit("Dust Devils")).otherwise(F.element_at(words, -1))
    dictionary = entities.aliases(teams.select("team", F.explode(F.array("team", nick)).alias("alias")), "team", "alias")
    a = art(spark, d)
    m = entities.matches(a, "slug", F.concat_ws(" ", "title", "body"), dictionary)
    return m.groupBy("name").agg(F.count("*").alias("articles"))


def player_entities(spark, d):
    """Roster names of two words or more in the bodies."""
    r = table(spark, d, "roster")
    names = F.array("full_name", F.concat_ws(" ", "first_name", "last_name"), F.concat_ws(" ", "football_name", "last_name"))
    dictionary = entities.aliases(r.select(F.coalesce("full_name", F.concat_ws(" ", "first_name", "last_name")).alias("name"), F.explode(names).alias("alias")), "name", "alias")
    m = entities.matches(art(spark, d), "slug", F.col("body"), dictionary, 4, 2)
    return m.groupBy("name").agg(F.count("*").alias("articles"))


def title_rules(spark, d):
    a = art(spark, d)
    return a.select("slug", entities.series(F.col("title")).alias("series"), entities.article_format(F.col("title"), F.col("body")).alias("format"))


def overlap_pairs(spark, d):
    docs = overlap.words(table(spark, d, "documents").where("text is not null"), "doc_id", text.canon(F.col("text")))
    items = overlap.words(table(spark, d, "eval_items"), "item_id", text.canon(F.col("text")))
    return overlap.pairs(items, docs, "item_id", "doc_id", 8)


def overlap_runs(spark, d):
    docs = overlap.words(table(spark, d, "documents").where("text is not null"), "doc_id", text.canon(F.col("text")))
    items = overlap.words(table(spark, d, "eval_items"), "item_id", text.canon(F.col("text")))
    return overlap.maximal_runs(items, docs, "item_id", "doc_id", 8)


def verbatim_audit(spark, d):
    """Items by how they stand in the documents: whole, in part, or not at all."""
    r = overlap_runs(spark, d).groupBy("item_id").agg(F.max("words").alias("longest"))
    n = overlap.words(table(spark, d, "eval_items"), "item_id", text.canon(F.col("text"))).select("item_id", F.size("w").cast("bigint").alias("words"))
    c = n.join(r, "item_id", "left").withColumn("class", F.when(F.col("longest") == F.col("words"), "verbatim").when(F.col("longest").isNotNull(), "partial").otherwise("absent"))
    return c.groupBy("class").agg(F.count("*").alias("items"), F.sum("words").alias("words"), F.coalesce(F.max("longest"), F.lit(0)).alias("longest"))


def limiter_windows(spark, d):
    return limiter.windows(table(spark, d, "events").select(F.col("user_id").cast("string").alias("client"), "ts"), 86400, 3)


def limiter_decisions(spark, d):
    return limiter.decisions(table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("client"), "ts"), "event_id", 86400, 3).groupBy("allowed").agg(F.count("*").alias("n"))


def session_valid(spark, d):
    """Events within twelve hours after their user's first event of the day, as a session token would allow."""
    e = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    first = e.groupBy("user_id", "day").agg(F.min("ts").alias("issued"))
    return e.join(first, ["user_id", "day"]).groupBy((F.col("ts") < F.col("issued") + F.expr("interval 12 hours")).alias("valid")).agg(F.count("*").alias("n"))


def json_props(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "struct<k: bigint>")["k"].alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


def best_retrieval(spark, d):
    """Of each article's retrievals the live one before the archive's, of those the earliest."""
    p = table(spark, d, "provenance").where("slug is not null").select("slug", "prov_id", "source_type", "retrieved_at")
    return history.best_route(p, "slug", F.when(F.col("source_type") == "live", 0).otherwise(1), "retrieved_at")


def byline_rules(spark, d):
    """Verdict, source and scope of each article by its byline and the places it was discovered at."""
    src = table(spark, d, "provenance").where("slug is not null").groupBy("slug").agg(F.collect_set("discovered_via").alias("sources"))
    a = art(spark, d).join(src, "slug", "left")
    f = history.byline_fields(history.tidy_byline(F.col("byline_raw")), F.coalesce("sources", F.array().cast("array<string>")), "varrick", "around-the-gridiron")
    return a.select("slug", f.alias("f")).groupBy("f.verdict", "f.source", "f.scope").agg(F.count("*").alias("n"))


def leak_check(spark, d):
    """Runs of eight words or more of the evaluation items in the documents, without one approved phrase."""
    docs = overlap.words(table(spark, d, "documents").where("text is not null"), "doc_id", text.canon(F.col("text")))
    items = overlap.words(table(spark, d, "eval_items"), "item_id", text.canon(F.col("text")))
    return overlap.leak_check(docs, items, "doc_id", "item_id", 8, ["using only the passage above"])


def year_band(spark, d):
    a = art(spark, d).withColumn("year", F.substring(dates.norm_date(F.coalesce("date", F.lit(""))), 1, 4))
    return search.year_band(a, {"year": F.col("year") == "2018", "format": F.col("format") == "ranking"}, "year")


def search_page(spark, d):
    """The third page of sixty of the articles in order of date."""
    a = art(spark, d).select("slug", dates.norm_date(F.coalesce("date", F.lit(""))).alias("iso"))
    return search.page(records.numbered(a, [F.desc("iso"), F.desc("slug")], "search_id"), "search_id", 2)


# --- SQL --------------------------------------------------------------------------------------------------------------


def clean(u: str) -> str:
    x = f"case when regexp_matches(trim({u}), '/web/\\d+(?:[a-z]+_)?/(https?://.*)$') then regexp_extract(trim({u}), '/web/\\d+(?:[a-z]+_)?/(https?://.*)$', 1) else trim({u}) end"
    x = f"rtrim(trim(string_split(string_split({x}, '?')[1], '#')[1]), '/')"
    x = f"regexp_replace({x}, '^(https?://[^/:]+):(?:80|443)(/|$)', '\\1\\2')"
    return f"regexp_replace(regexp_replace({x}, '^http://', 'https://'), '^https://pigskin-ledger\\.example(/|$)', 'https://www.pigskin-ledger.example\\1')"


_LEG = "(?i)^/news/story/([^/]+)(?:/(article|comments)(?:/(.*))?)?/?$"
_PATH = "regexp_extract(clean, '^[a-z]+://[^/]*(/.*)?$', 1)"
_KEY = f"case when regexp_extract({_PATH}, '{_LEG}', 1) <> '' then 'legacy:' || lower(regexp_extract({_PATH}, '{_LEG}', 1)) else clean end"
_TAIL = "left(regexp_replace(regexp_replace(lower(string_split(rtrim(clean, '/'), '/')[-1]), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), 90)"
_NAVS = ", ".join(repr(x) for x in urls.NAV_PARTS)
_EV = "ev as (select distinct on (fetch_id) * from fetch_events order by fetch_id)"
_CANON = "lower(trim(regexp_replace(regexp_replace(translate(text, '‘’“”–—', '''''\"\"--'), '[^\\p{L}\\p{N}_\\s''-]', ' ', 'g'), '[\\s\\v\\x1c-\\x1f\\x85   -     　]+', ' ', 'g'), ' '))"
_OV = (
    f"with d as (select doc_id, list_filter(string_split({_CANON}, ' '), lambda x: x <> '') w from documents where text is not null), i as (select item_id, list_filter(string_split({_CANON}, ' '), lambda x: x <> '') w from eval_items)"
    ", gd as (select doc_id, k - 1 pos, array_to_string(list_slice(w, k, k + 7), ' ') gram from (select *, unnest(range(1, len(w) - 6)) k from d)), gi as (select item_id, k - 1 pos, array_to_string(list_slice(w, k, k + 7), ' ') gram from (select *, unnest(range(1, len(w) - 6)) k from i))"
)
_RUNS = _OV + ", h as (select item_id, doc_id, gi.pos a_pos, gd.pos b_pos, gd.pos - gi.pos diag from gi join gd using (gram)), z as (select *, a_pos - row_number() over (partition by item_id, doc_id, diag order by a_pos) isle from h), r as (select item_id, doc_id, min(a_pos)::bigint a_pos, min(b_pos)::bigint b_pos, (count(*) + 7)::bigint words from z group by item_id, doc_id, diag, isle)"
_NORMAL = "trim(regexp_replace(lower(regexp_replace(strip_accents(replace(regexp_replace({}, '[  -   　]', ' ', 'g'), '…', '...')), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'), ' ')"
_MATCH = (
    "al as (select alias, min(name) as name from (select name, {norm} alias from raw where name is not null) where alias <> '' group by alias), w as (select slug, string_split({body}, ' ') w from art)"
    ", g as (select distinct slug, array_to_string(list_slice(w, i, i + n - 1), ' ') alias from (select slug, w, n, unnest(range(1, len(w) - n + 2)) i from w, (select unnest(range({lo}, 5)) n))) select name, count(distinct slug)::bigint articles from g join al using (alias) group by name"
)
SQL = {
    "url_clean": f"with u as (select distinct original, {clean('original')} clean from capture_rows) select original, clean, {_KEY} \"key\", case when {_TAIL} = '' then 'article' else {_TAIL} end || '-' || left(md5(clean), 6) slug, {_PATH} path from u",
    "url_kind": f"with u as (select distinct url, {clean('url')} clean from url_entries), p as (select *, {_PATH} path from u), q as (select *, string_split(trim(path, '/'), '/') parts from p) select url, case when regexp_matches(url, '[{{}}]') or list_has_any(parts, [{_NAVS}]) then 'nav' when path in ('/news', '/news/story', '/blogs/around-the-gridiron', '/news/around-the-gridiron') then 'index' when regexp_matches(path, '^/news/around-the-gridiron_\\d+/\\d+$') then 'pagination' when regexp_matches(path, '^/(?:news|blogs)/around-the-gridiron/\\d+$') then 'index' when regexp_matches(array_to_string(parts[3:], '/'), '^(?:\\d{{1,4}}[-/]){{2}}\\d{{1,4}}$') then 'index' when regexp_matches(path, '{_LEG}') then case when regexp_extract(path, '{_LEG}', 3) <> '' then 'article' else 'index' end when len(parts) = 2 and parts[1] = 'news' and contains(parts[2], '-') then 'article' else 'unknown' end kind from q",
    "url_views": f"with u as (select distinct url, {clean('url')} clean from url_entries), p as (select *, {_PATH} path from u), q as (select *, regexp_extract(path, '{_LEG}', 1) id, regexp_extract(path, '{_LEG}', 3) s from p) select url, case when id <> '' then 'https://www.pigskin-ledger.example/news/story/' || id || '/article' || case when s <> '' then '/' || s else '' end else clean end body_url, case when id <> '' then 'https://www.pigskin-ledger.example/news/story/' || id || '/comments' || case when s <> '' then '/' || s else '' end end comments_url, lower(id) content_id from q",
    "url_merge": f"with e as (select url, coalesce(title, '') title, observed_urls from url_entries union all select original, '', null from capture_rows), c as (select *, {clean('url')} clean from e), k as (select *, {_KEY} \"key\" from c), o as (select distinct \"key\", trim(unnest(list_append(coalesce(observed_urls, []), clean))) u from k), b as (select \"key\", min(clean) url, max({{'n': len(title), 't': title}}) t, count(*) entries from k group by 1) select b.\"key\", url, t.t title, entries::bigint entries, count(*)::bigint observed, min(u) first_seen from b join o on b.\"key\" = o.\"key\" group by 1, 2, 3, 4",
    "first_capture_of_month": f"select {clean('original')} url, left(timestamp, 6) \"month\", min(timestamp) \"timestamp\" from capture_rows where statuscode = '200' group by 1, 2",
    "earliest_capture": f"with c as (select {clean('original')} clean, timestamp ts, original from capture_rows where timestamp is not null), k as (select {_KEY} \"key\", ts, original from c) select \"key\", min({{'t': ts, 'o': original}}).t \"timestamp\", min({{'t': ts, 'o': original}}).o original from k group by 1",
    "captures_by_day": "with c as (select try_strptime(left(timestamp, 8), '%Y%m%d')::date \"day\", count(*) n from capture_rows where regexp_matches(timestamp, '^[0-9]{14}$') group by 1), days as (select unnest(generate_series(date '2014-01-01', date '2014-12-31', interval 1 day))::date \"day\") select strftime(days.\"day\", '%Y-%m-%d') \"day\", coalesce(n, 0)::bigint captures, case when n is null then 'no_capture' else 'captured' end state from days left join c on days.\"day\" = c.\"day\"",
    "captures_by_every_day": "with c as (select try_strptime(left(timestamp, 8), '%Y%m%d')::date \"day\", count(*) n from capture_rows where regexp_matches(timestamp, '^[0-9]{14}$') group by 1), days as (select unnest(generate_series(min(\"day\"), max(\"day\"), interval 1 day))::date \"day\" from c) select strftime(days.\"day\", '%Y-%m-%d') \"day\", coalesce(n, 0)::bigint captures, case when n is null then 'no_capture' else 'captured' end state from days left join c on days.\"day\" = c.\"day\"",
    "unfetched": "select distinct url from url_entries where kind not in ('index', 'nav', 'pagination') and not exists (select 1 from fetch_events f where f.url = url_entries.url and f.outcome = 'ok')",
    "status_counts": "select kind, status, count(*)::bigint n from url_entries group by 1, 2",
    "outcome_counts": f"with {_EV} select phase, outcome, count(*)::bigint n, count(distinct url)::bigint urls from ev group by 1, 2",
    "latest_event": f"with {_EV}, m as (select url, max({{'at': \"at\", 'id': fetch_id, 'p': phase, 'o': outcome}}) x from ev where url is not null group by url) select url, x.\"at\" \"at\", x.id fetch_id, x.p phase, x.o outcome from m",
    "tail_events": f"with {_EV} select fetch_id, \"at\", phase, outcome, url from ev order by \"at\" desc, fetch_id desc limit 120",
    "retryable": f"with {_EV} select error_type, http_status, count(*)::bigint n from ev where http_status in (429, 503) or error_type in ('ConnectionError', 'Timeout') group by 1, 2",
    "fixed_failures": f"with {_EV}, ok as (select url, max(\"at\") ok_at from ev where outcome = 'ok' group by url), bad as (select url, outcome, min(\"at\") bad_at from ev where starts_with(outcome, 'failed') group by 1, 2) select outcome, count(*)::bigint urls from bad join ok using (url) where ok_at > bad_at group by 1",
    "milestones": f"with {_EV}, ok as (select url, min({{'a': \"at\", 'f': fetch_id}}) x from ev where outcome = 'ok' and phase = 'fetch' and url is not null group by url), n as (select row_number() over (order by x.a, x.f, url) recovered, x.a \"at\", url from ok) select recovered::bigint recovered, \"at\", url from n where recovered % 200 = 0",
    "byline_split": "with " + ART + ", s as (select slug, min(byline_source) source from articles group by slug), a as (select source, coalesce(byline_verdict, 'unparsed') v, len(list_distinct(list_filter(list_transform(string_split_regex(coalesce(byline_raw, ''), ',\\s*|\\s+and\\s+|\\s*&\\s*'), lambda x: trim(x, ' ')), lambda x: x <> ''))) n from art join s using (slug)) select source, count(case when v = 'varrick' then 1 end)::bigint target, count(case when v = 'other' then 1 end)::bigint other, count(case when v = 'unparsed' then 1 end)::bigint unread, count(case when n > 1 then 1 end)::bigint joint, round(100 * avg(case when v = 'varrick' then 1.0 else 0.0 end), 1) percent from a group by source",
    "byline_names": "with " + ART + ", n as (select slug, unnest(list_distinct(list_filter(list_transform(string_split_regex(byline_raw, ',\\s*|\\s+and\\s+|\\s*&\\s*'), lambda x: trim(x, ' ')), lambda x: x <> ''))) as name from art where byline_raw is not null) select name, count(*)::bigint n from n group by name",
    "norm_dates": "with " + ART + f" select slug, {iso('coalesce(date, ' + repr('') + ')')} iso from art",
    "decile_bands": "with " + ART + ", r as (select slug, row_number() over (order by slug) rn, count(*) over () n from art) select (ceil(10 * rn / n) - 1)::bigint band, count(*)::bigint n, min(slug) \"first\", max(slug) \"last\" from r group by 1",
    "systematic_sample": "with " + ART + ", r as (select slug, row_number() over (order by slug) - 1 pos, count(*) over () n from art) select slug, pos::bigint pos from r where pos = 0 or floor(pos * least(50, n) / n) <> floor((pos - 1) * least(50, n) / n)",
    "team_entities": "with " + ART + ", t as (select distinct unnest(entities.teams) team from articles), raw as (select team as name, unnest([team, case when team like '%Dust Devils' then 'Dust Devils' else string_split(team, ' ')[-1] end]) a from t where team is not null), " + _MATCH.format(norm=_NORMAL.format("a"), body=_NORMAL.format("concat_ws(' ', title, body)"), lo=1),
    "player_entities": "with " + ART + ", raw as (select coalesce(full_name, concat_ws(' ', first_name, last_name)) as name, unnest([full_name, concat_ws(' ', first_name, last_name), concat_ws(' ', football_name, last_name)]) a from roster), " + _MATCH.format(norm=_NORMAL.format("a"), body=_NORMAL.format("body"), lo=2),
    "title_rules": "with " + ART + ", s as (select slug, title, body, case when regexp_matches(title, '(?i)^QB Almanac\\b') then 'QB Almanac' when regexp_matches(title, '(?i)^Roster Reset\\b') then 'Roster Reset' when regexp_matches(title, '(?i)^Hot or Not\\b') then 'Hot or Not' else '' end series from art) select slug, series, case when regexp_matches(title, '(?i)\\b(dies|died|obituary|remembering|passes away|dead at)\\b') then 'obituary' when regexp_matches(title, '(?i)\\b(rankings?|ranking|ranked|top \\d+|QB Index|best and worst)\\b') then 'ranking' when regexp_matches(title, '(?i)\\b(dispatch|from the (?:combine|sidelines)|on the scene|training camp report)\\b') then 'dispatch' when series <> '' or len(regexp_extract_all(coalesce(body, ''), '[^\\s\\v\\x1c-\\x1f\\x85   -     　]+')) >= 700 or regexp_matches(title, '(?i)\\b(on my radar|why|what we learned|my favorite)\\b') then 'column' else 'news brief' end format from s",
    "overlap_pairs": _OV + " select item_id, doc_id, count(distinct gram)::bigint grams from gi join gd using (gram) group by 1, 2",
    "overlap_runs": _RUNS + " select item_id, doc_id, a_pos, b_pos, words from r",
    "verbatim_audit": _RUNS + ", m as (select item_id, max(words) longest from r group by 1), c as (select len(w)::bigint words, longest, case when longest = len(w) then 'verbatim' when longest is not null then 'partial' else 'absent' end \"class\" from i left join m using (item_id)) select \"class\", count(*)::bigint items, sum(words)::bigint words, coalesce(max(longest), 0)::bigint longest from c group by 1",
    "limiter_windows": "select user_id::varchar client, floor(epoch(ts) / 86400)::bigint bucket, count(*)::bigint attempts, least(count(*), 3)::bigint stored from events group by 1, 2",
    "limiter_decisions": "with r as (select row_number() over (partition by user_id, floor(epoch(ts) / 86400) order by ts, event_id) <= 3 allowed from events) select allowed, count(*)::bigint n from r group by 1",
    "session_valid": "with f as (select user_id, date_trunc('day', ts) d, min(ts) i from events group by 1, 2) select ts < i + interval 12 hours \"valid\", count(*)::bigint n from events e join f on e.user_id = f.user_id and date_trunc('day', e.ts) = f.d group by 1",
    "best_retrieval": "with m as (select slug, min({'p': case when source_type = 'live' then 0 else 1 end, 's': retrieved_at, 'i': prov_id, 't': source_type}) x from provenance where slug is not null group by slug) select slug, x.i prov_id, x.t source_type, x.s retrieved_at from m",
    "byline_rules": "with " + ART + ", t as (select slug, trim(regexp_replace(coalesce(byline_raw, ''), '(?i)^By\\s+', ''), ' ') b from art), r as (select slug, case when lower(b) in ('no author name', 'unknown', 'n/a', 'none') then '' else b end b from t), s as (select slug, coalesce(bool_or(contains(discovered_via, 'varrick') and (contains(discovered_via, '/author/') or contains(discovered_via, '/writer/'))), false) a, coalesce(bool_or(regexp_matches(discovered_via, '/(?:news|blogs)/around-the-gridiron(?:[/_]|$)')), false) i from provenance group by slug)"
    " select case when regexp_matches(b, '(?i)\\bvarrick\\b') then 'varrick' when b <> '' then 'other' else 'unparsed' end verdict, case when coalesce(a, false) then 'author-page' else 'section-page' end source, case when regexp_matches(b, '(?i)\\bvarrick\\b') then 'varrick' when b <> '' and coalesce(i, false) then 'section' else 'unresolved' end scope, count(*)::bigint n from r left join s using (slug) group by 1, 2, 3",
    "year_band": "with " + ART + f" select left({iso('coalesce(date, ' + repr('') + ')')}, 4) \"year\", count(*)::bigint n from art where format = 'ranking' group by 1",
    "search_page": "with " + ART + f", i as (select slug, {iso('coalesce(date, ' + repr('') + ')')} iso from art), n as (select slug, iso, (row_number() over (order by iso desc, slug desc) - 1)::bigint search_id from i) select * from n where search_id between 120 and 179",
    "json_props": "select event_type, (props->>'$.k')::bigint k, count(*)::bigint n from events group by 1, 2",
}
SQL["leak_check"] = _RUNS + ", s as (select doc_id, item_id, array_to_string(list_slice(d.w, r.b_pos + 1, r.b_pos + r.words), ' ') run, words from r join d using (doc_id)) select doc_id, item_id, run, words from s where not contains('using only the passage above', run) and not contains(run, 'using only the passage above')"
QUERIES = {f.__name__: f for f in (
    url_clean, url_kind, url_views, url_merge, first_capture_of_month, earliest_capture, captures_by_day, captures_by_every_day, unfetched, status_counts, outcome_counts, latest_event, tail_events, retryable, fixed_failures, milestones,
    byline_split, byline_names, norm_dates, decile_bands, systematic_sample, stratified_sample, team_entities, player_entities, title_rules, overlap_pairs, overlap_runs, verbatim_audit,
    best_retrieval, byline_rules, leak_check, year_band, search_page, limiter_windows, limiter_decisions, session_valid, json_props,
)}
