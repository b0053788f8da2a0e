"""Queries over the recovered corpus: decomposed index, mentions, matched cohorts, merged records, candidates, shared runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import dates, text, urls
from lexmill.operators import cohorts, entities, overlap, records, search
from lexmill.plans.corpus import _WORDS, ART, SIDE, art, iso, sides
from lexmill.plans.records import _CANON, _EV, _KEY, _MATCH, _NORMAL, _RUNS, _events, clean
from lexmill.plans.records import SQL as _RECORDS
from lexmill.sources.tables import table


def index_terms(spark, d):
    """The reader's index: decomposed tokens without the reader's stop words."""
    docs = art(spark, d).select(F.col("slug").alias("id"), F.col("body").alias("text"))
    p = search.postings(docs, search.READER_STOP, tokens=text.index_tokens)
    return p.groupBy("term").agg(F.count("*").alias("df"), F.min("id").alias("first"), F.max("id").alias("last"))


def index_shards(spark, d):
    """The same index with posting lists in shards of about a hundred: what the shards of each term hold together."""
    docs = art(spark, d).select(F.col("slug").alias("id"), F.col("body").alias("text"))
    s = search.shards(search.postings(docs, search.READER_STOP, tokens=text.index_tokens), 100)
    return s.groupBy("term").agg(F.sum(F.size("ids")).cast("bigint").alias("df"))


def player_mentions(spark, d):
    """Roster names of two words or more, of any length, in titles and bodies."""
    r = table(spark, d, "roster")
    name = F.coalesce("full_name", "player_name", F.concat_ws(" ", "first_name", "last_name"))
    names = r.select(name.alias("name"), F.explode(F.array(name, F.concat_ws(" ", "football_name", "last_name"))).alias("alias"))
    return entities.mentions(art(spark, d), "slug", F.concat_ws(" ", "title", "body"), names, 2).groupBy("name").agg(F.count("*").alias("articles"))


def _matched(spark, d):
    a = sides(spark, d).where("body is not null").withColumn("year", F.substring(dates.norm_date(F.coalesce("date", F.lit(""))), 1, 4))
    form = a.where("year <= '2018' and format = 'news brief'").withColumn("set", F.lit("matched form"))
    return form.unionByName(a.where("coalesce(word_count, 0) >= 1200").withColumn("set", F.lit("matched length")))


def matched_rates(spark, d):
    """Rates of all matched terms per 10,000 words on both matched sets and sides."""
    kinds = F.create_map(*[F.lit(x) for label, _, kind in cohorts.MATCHED for x in (label, kind)])
    return cohorts.measure(_matched(spark, d), ["set", "side"], cohorts.MATCHED).withColumn("kind", kinds[F.col("label")])


def matched_members(spark, d):
    """The articles of both matched sets with their words."""
    return _matched(spark, d).select("set", "side", "slug", text.word_count("body").cast("bigint").alias("words"))


def url_records(spark, d):
    """Merged records of the harvest state, lists as text."""
    m = records.merged_records(table(spark, d, "url_entries").select("url", "title", "status", "discovered_via", "observed_urls"))
    return m.select("key", "url", "title", "entries", "status", F.array_join("statuses", ",").alias("statuses"), F.array_join("observed_urls", " ").alias("observed_urls"), F.size("records").cast("bigint").alias("records"))


def result_lookup(spark, d):
    """Fetch results by the kind and status of the entry whose url or body_url they carry."""
    r = records.by_either_address(_events(spark, d).where("url is not null").select("fetch_id", "url", "outcome"), table(spark, d, "url_entries"))
    return r.groupBy("outcome", F.coalesce("entry_kind", F.lit("no entry")).alias("kind"), F.coalesce("entry_status", F.lit("")).alias("status")).agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))


def daily_outcomes(spark, d):
    """Every day of five years in order of trying, with what the listing of its year says: years without a listed row failed."""
    c = table(spark, d, "capture_rows").where("timestamp rlike '^[0-9]{14}$' and statuscode = '200'").select(F.try_to_date(F.substring("timestamp", 1, 8), "yyyyMMdd").alias("day")).where("day is not null")
    days = records.calendar(spark, "2014-01-01", "2018-12-31")
    out = records.daily_outcomes(days, c.select(F.year("day").alias("year")), c.groupBy("day").agg(F.count("*").alias("captures")))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("year").cast("bigint").alias("year"), F.col("place").cast("bigint").alias("place"), "outcome", "captures")


def halved_sample(spark, d):
    """Two hundred pending entries: half legacy, half modern, topped up."""
    u = table(spark, d, "url_entries").where("status = 'pending' and kind not in ('index', 'nav', 'pagination')").select("url").distinct()
    return records.halves(u, F.contains("url", F.lit("/news/story/")), [F.col("url")], 200)  # a sampling operator


def content_ids(spark, d):
    """Content ids by legacy path or by suffix."""
    u = table(spark, d, "url_entries").select("url").distinct().withColumn("clean", urls.clean_url(F.col("url")))
    return u.select("url", urls.any_content_id(F.col("clean")).alias("content_id"))


def fetchable(spark, d):
    """Entries on the whitelisted hosts and paths, by kind."""
    u = table(spark, d, "url_entries").select("url").distinct().withColumn("clean", urls.clean_url(F.col("url")))
    ok = urls.allowed(F.col("clean"), ["www.pigskin-ledger.example", "blogs.pigskin-ledger.example"], ["/news"], ["/news/", "/blogs/around-the-gridiron"])
    return u.select("url", urls.kind(F.col("url"), F.col("clean")).alias("kind"), ok.alias("allowed")).groupBy("kind", "allowed").agg(F.count("*").alias("n"))


def _runs(spark, d):
    docs = overlap.words(table(spark, d, "documents").where("text is not null"), "doc_id", text.canon(F.col("text")))
    items = overlap.words(table(spark, d, "eval_items"), "item_id", text.canon(F.col("text")))
    return overlap.leak_check(docs, items, "doc_id", "item_id", 8, [])


QUOTED = ["using only the passage above", "in the second quarter"]


def run_classes(spark, d):
    """Shared runs by what they are, the titles of the documents being the headlines."""
    t = table(spark, d, "documents").select("doc_id", F.array(text.canon(F.coalesce("title", F.lit("")))).alias("h"))
    r = _runs(spark, d).join(t, "doc_id")
    return r.groupBy(overlap.classify(F.col("run"), QUOTED, F.col("h")).alias("class")).agg(F.count("*").alias("runs"), F.sum("words").cast("bigint").alias("words"))


def leak_report(spark, d):
    """Shared runs without those in the document's own title and without runs of entity names only."""
    docs = table(spark, d, "documents").where("text is not null")
    r = overlap.own_matter(_runs(spark, d), docs, "doc_id", text.canon(F.coalesce("title", F.lit(""))))
    e = table(spark, d, "articles").select(F.explode(F.concat(F.coalesce("entities.teams", F.array().cast("array<string>")), F.coalesce("entities.players", F.array().cast("array<string>")))).alias("n"))
    names = overlap.name_words(e.distinct().select(text.canon(F.col("n")).alias("n")), "n")
    return r.where(~overlap.entity_only(F.col("run"), F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")))


def reader_records(spark, d):
    """The reader's short records: year ('undated' without), route and words derived, the teaser blanked."""
    p = table(spark, d, "provenance").where("slug is not null").groupBy("slug").agg(F.max_by("source_type", F.struct("retrieved_at", "prov_id")).alias("st"))
    a = art(spark, d).join(p, "slug", "left").withColumn("iso", dates.norm_date(F.coalesce("date", F.lit(""))))
    return a.select(F.col("slug").alias("id"), F.coalesce("title", F.lit("")).alias("t"), F.lit("").alias("d"), F.when(F.col("iso") == "", "undated").otherwise(F.substring("iso", 1, 4)).alias("y"), F.when(F.col("st") == "wayback", "wayback").otherwise("live").alias("src"), F.coalesce("word_count", F.lit(0)).alias("wc"))


_INDEXED = "regexp_extract_all(lower(array_to_string(list_transform(regexp_extract_all(body, '(?s).'), lambda c: case when strip_accents(c) <> c then strip_accents(c) || ' ' else c end), '')), '[\\p{L}\\p{N}]+')"
_STOPS = ", ".join(repr(w) for w in search.READER_STOP)
_MSETS = SIDE + f", y as (select *, left({iso('coalesce(date, ' + repr('') + ')')}, 4) yr from sides where body is not null), sets as (select *, 'matched form' \"set\" from y where yr <= '2018' and format = 'news brief' union all select *, 'matched length' from y where coalesce(word_count, 0) >= 1200)"
_CTITLE = _CANON.replace("translate(text,", "translate(coalesce(title, ''),")
_SPELLED = _RUNS + f", s as (select doc_id, item_id, array_to_string(list_slice(d.w, r.b_pos + 1, r.b_pos + r.words), ' ') run, words from r join d using (doc_id)), t as (select doc_id, {_CTITLE} h from documents)"
SQL = {
    "index_terms": "with " + ART + f", p as (select slug, unnest(list_distinct({_INDEXED})) term from art where body is not null) select term, count(*)::bigint df, min(slug) \"first\", max(slug) \"last\" from p where len(term) >= 3 and term not in ({_STOPS}) group by term",
    "index_shards": "with " + ART + f", p as (select slug, unnest(list_distinct({_INDEXED})) term from art where body is not null) select term, count(*)::bigint df from p where len(term) >= 3 and term not in ({_STOPS}) group by term",
    "player_mentions": "with " + ART + ", raw as (select n as name, unnest([n, concat_ws(' ', football_name, last_name)]) a from (select *, coalesce(full_name, player_name, concat_ws(' ', first_name, last_name)) n from roster)), " + _MATCH.format(norm=_NORMAL.format("a"), body=_NORMAL.format("concat_ws(' ', title, body)"), lo=2).replace("range(2, 5)", "range(2, 9)"),
    "matched_rates": "with " + _MSETS + f', w as (select "set", side, sum({_WORDS.format("body")}) words from sets group by 1, 2), m as (' + " union all ".join(
        f"select \"set\", side, '{label}' label, '{kind}' kind, sum(len(regexp_extract_all(body, '{pattern.replace(chr(39), chr(39) * 2)}')))::bigint occurrences from sets group by 1, 2" for label, pattern, kind in cohorts.MATCHED
    ) + ') select "set", side, label, kind, occurrences, words::bigint words, round(10000.0 * occurrences / words, 3) per_10k from m join w using ("set", side)',
    "matched_members": "with " + _MSETS + f' select "set", side, slug, {_WORDS.format("body")} words from sets',
    "url_records": f"with c as (select *, {clean('url')} clean from url_entries), k as (select *, {_KEY} \"key\", not regexp_matches(clean, '(?i)/article(?:/|$)') other from c), b as (select \"key\", max({{'n': len(coalesce(title, '')), 't': coalesce(title, '')}}).t title, min({{'o': other, 'u': clean}}).u url, count(*) entries, coalesce(string_agg(distinct status, ',' order by status), '') statuses, coalesce(bool_or(status = 'ok'), false) ok, min(status) st, count(distinct {{'u': url, 't': coalesce(title, ''), 'd': coalesce(discovered_via, '')}}) records from k group by 1), o as (select \"key\", string_agg(distinct u, ' ' order by u) observed_urls from (select \"key\", trim(unnest(list_append(coalesce(observed_urls, []), clean)), ' ') u from k) group by 1)"
    " select \"key\", url, title, entries::bigint entries, case when ok then 'ok' else coalesce(st, 'pending') end status, statuses, observed_urls, records::bigint records from b join o using (\"key\")",
    "result_lookup": f"with {_EV}, k as (select k, min({{'u': url, 'k': kind, 's': status}}) e from (select unnest([url, body_url]) k, url, kind, status from url_entries) where k is not null group by k) select outcome, coalesce(e.k, 'no entry') kind, coalesce(e.s, '') status, count(*)::bigint n, count(distinct url)::bigint urls from ev left join k on ev.url = k.k where url is not null group by 1, 2, 3",
    "daily_outcomes": "with c as (select try_strptime(left(timestamp, 8), '%Y%m%d')::date \"day\", count(*) n from capture_rows where regexp_matches(timestamp, '^[0-9]{14}$') and statuscode = '200' group by 1), days as (select unnest(generate_series(date '2014-01-01', date '2018-12-31', interval 1 day))::date \"day\"), j as (select days.\"day\" dd, year(days.\"day\") yy, n, year(days.\"day\") in (select year(\"day\") from c where \"day\" is not null) ok from days left join c on days.\"day\" = c.\"day\") select strftime(dd, '%Y-%m-%d') \"day\", yy::bigint \"year\", row_number() over (partition by yy order by month(dd) not in (8, 9, 10, 11, 12, 1, 2), dd)::bigint place, case when not ok then 'query_failed' when n is null then 'no_capture' else 'captured' end outcome, case when ok then coalesce(n, 0) else 0 end::bigint captures from j",
    "halved_sample": "with u as (select distinct url, case when contains(url, '/news/story/') then 'legacy' else 'modern' end kind from url_entries where status = 'pending' and kind not in ('index', 'nav', 'pagination')), n as (select *, row_number() over (partition by kind order by url) - 1 pos, count(*) over (partition by kind) total from u), w as (select *, least(100, total) k from n), t as (select w.*, exists (select 1 from range(k) x(i) where i * total // k = pos) taken from w), r as (select *, row_number() over (partition by taken order by url) rn from t), m as (select least(200, count(*)) - count(case when taken then 1 end) missing from t) select url, kind, pos::bigint pos, not taken topped_up from r where taken or rn <= (select missing from m)",
    "content_ids": f"with u as (select distinct url, {clean('url')} clean from url_entries), k as (select *, {_KEY} \"key\" from u) select url, case when starts_with(\"key\", 'legacy:') then substr(\"key\", 8) else regexp_extract(clean, '-(0ap[0-9]+|09000[a-f0-9]+)$', 1) end content_id from k",
    "run_classes": _SPELLED + ", c as (select case when " + " or ".join(f"contains('{q}', run) or contains(run, '{q}')" for q in QUOTED) + " then 'quotation' when h <> '' and (contains(h, run) or contains(run, h)) then 'headline' else 'collision' end \"class\", words from s join t using (doc_id)) select \"class\", count(*)::bigint runs, sum(words)::bigint words from c group by 1",
    "leak_report": _SPELLED + f", nm as (select distinct unnest(string_split({_CANON.replace('translate(text,', 'translate(n,')}, ' ')) w from (select unnest(list_concat(coalesce(entities.teams, []), coalesce(entities.players, []))) n from articles)) select doc_id, item_id, run, words from s join t using (doc_id) where not contains(h, run) and exists (select 1 from (select unnest(string_split(run, ' ')) w) x where x.w not in (select w from nm))",
    "reader_records": "with " + ART + f", p as (select slug, max_by(source_type, {{'a': retrieved_at, 'b': prov_id}}) st from provenance group by slug), x as (select art.*, st, {iso('coalesce(date, ' + repr('') + ')')} iso from art left join p using (slug)) select slug id, coalesce(title, '') t, '' d, case when iso = '' then 'undated' else left(iso, 4) end y, case when st = 'wayback' then 'wayback' else 'live' end src, coalesce(word_count, 0)::bigint wc from x",
}
_KINDS = _RECORDS["url_kind"]
SQL["fetchable"] = (
    f"with u as (select distinct url, {clean('url')} clean from url_entries), k as (select url, kind from ({_KINDS}) q), a as (select url, regexp_extract(clean, '^[a-z]+://([^/:?#]*)', 1) in ('www.pigskin-ledger.example', 'blogs.pigskin-ledger.example') and (regexp_extract(clean, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '/news' or starts_with(regexp_extract(clean, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/news/') or starts_with(regexp_extract(clean, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/blogs/around-the-gridiron')) allowed from u)"
    " select kind, allowed, count(*)::bigint n from k join a using (url) group by 1, 2"
)
QUERIES = {f.__name__: f for f in (
    index_terms, index_shards, player_mentions, matched_rates, matched_members, url_records, result_lookup, daily_outcomes, halved_sample, content_ids, fetchable, run_classes, leak_report, reader_records,
)}
