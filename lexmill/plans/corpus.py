"""Queries over the article corpus: counts, distinctive terms, cohorts, search, facets."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import dates, text
from lexmill.operators import cohorts, corpus, search
from lexmill.session import cut
from lexmill.sources.tables import table

TARGET = "varrick"
SECTION = "around the gridiron"


def art(spark: SparkSession, d: str) -> DataFrame:
    return corpus.articles(table(spark, d, "articles"))


def sides(spark: SparkSession, d: str) -> DataFrame:
    """Target and control articles; other verdicts are in neither."""
    a = art(spark, d)
    return a.withColumn("side", F.when(F.col("byline_verdict") == TARGET, "target").when(F.col("byline_verdict") == "other", "control")).where("side is not null")


def _runs(spark: SparkSession, d: str, clean: bool = False, proper: bool = False) -> DataFrame:
    a = sides(spark, d)
    body = text.strip_furniture(F.col("body"), SECTION) if clean else F.col("body")
    a = a.select(F.struct("slug", "side").alias("doc"), body.alias("body"))
    s = corpus.sentence_tokens(a, "doc", "body")
    names = corpus.case_profile(s) if proper else None
    return corpus.runs(s, "doc", names).select(F.col("doc.slug").alias("slug"), F.col("doc.side").alias("side"), "s", "run", "tokens")


def _scored(spark: SparkSession, d: str, measure: str, sizes: tuple[int, ...]) -> DataFrame:
    return corpus.log_odds(corpus.whole_term_counts(sides(spark, d), ["side"], "body", sizes), measure)


def term_freq(spark, d):
    return corpus.whole_term_counts(art(spark, d), [], "body", (1,))


def doc_freq(spark, d):
    return corpus.document_counts(art(spark, d), "body", (1, 2, 3)).where("df >= 3")


def bigram_postings(spark, d):
    """Posting lists of the bigrams in three to twenty documents, which bounds a list."""
    a = art(spark, d).where("body is not null")
    few = corpus.document_counts(a, "body", (2,)).where("df between 3 and 20")
    g = a.select("slug", F.explode(F.array_distinct(corpus.document_grams(F.col("body"), (2,)))).alias("term"))
    return g.join(few, "term").groupBy("term", "df").agg(F.array_join(F.sort_array(F.collect_list("slug")), ",").alias("slugs"))


def proper_nouns(spark, d):
    return corpus.case_profile(corpus.sentence_tokens(art(spark, d), "slug", "body"))


def _round(df: DataFrame) -> DataFrame:
    return df.withColumn("z", F.round("z", 6))


def distinctive_terms_tf(spark, d):
    return _round(_scored(spark, d, "tf", (1, 2, 3)))


def distinctive_terms_df(spark, d):
    return _round(_scored(spark, d, "df", (1, 2, 3)))


def top_distinctive(spark, d):
    w = Window.orderBy(F.desc("z"), "term")
    top = _round(_scored(spark, d, "df", (1, 2))).orderBy(F.desc("z"), "term").limit(50)  # a top-k report
    return top.withColumn("rank", F.row_number().over(w).cast("bigint"))


def collapse_maximal(spark, d):
    return _round(corpus.collapse_nested(cut(_scored(spark, d, "df", (1, 2, 3)), "scored")))


def collapse_strict(spark, d):
    return _round(corpus.collapse_nested(cut(_scored(spark, d, "df", (1, 2, 3)), "scored"), strict=True))


def voice_terms(spark, d):
    """The full preset: furniture stripped, proper nouns and years breaking runs, 1- to 4-grams, per article, collapsed."""
    scored = corpus.log_odds(corpus.term_counts(_runs(spark, d, clean=True, proper=True), "slug", "side", (1, 2, 3, 4)), "df")
    return _round(corpus.collapse_nested(cut(scored, "scored")))


def maximal_phrases(spark, d):
    runs = cut(_runs(spark, d, clean=True, proper=True).where("side = 'target'"), "runs")
    both = corpus.log_odds(corpus.term_counts(_runs(spark, d, clean=True, proper=True), "slug", "side", (1, 2, 3, 4)), "df")
    return _round(corpus.ranked_phrases(corpus.collapse_nested(cut(both, "scored")), runs, "slug", cut))


def break_runs(spark, d):
    s = corpus.sentence_tokens(art(spark, d), "slug", "body")
    r = corpus.runs(s, "slug", corpus.case_profile(s))
    return r.groupBy("slug").agg(F.count("*").alias("runs"), F.sum(F.size("tokens")).cast("bigint").alias("tokens"), F.max(F.size("tokens")).cast("bigint").alias("longest"))


def era_matched(spark, d):
    """Articles whose year both sides have, with each side's span."""
    a = sides(spark, d).withColumn("year", F.substring(dates.norm_date(F.col("date")), 1, 4)).where("year <> ''")
    both = a.where("side = 'target'").select("year").intersect(a.where("side = 'control'").select("year"))
    kept = a.join(both, "year", "left_semi")
    return kept.groupBy("side").agg(F.count("*").alias("articles"), F.concat(F.min("year"), F.lit("-"), F.max("year")).alias("span"))


def furniture_stripped(spark, d):
    a = art(spark, d)
    return a.select("slug", F.coalesce(text.word_count("body"), F.lit(0)).cast("bigint").alias("words"), text.word_count(text.strip_furniture(F.col("body"), SECTION)).cast("bigint").alias("kept"))


def line_dedup(spark, d):
    lines = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    a = art(spark, d).where("body is not null").withColumn("ls", lines)
    return a.select("slug", F.size("ls").cast("bigint").alias("lines"), F.size(text.drop_repeats(F.col("ls"))).cast("bigint").alias("kept"))


def measures(spark, d):
    a = sides(spark, d).where("body is not null")
    return cohorts.measure(a, ["side"], cohorts.TERMS)


def _sets(spark, d) -> DataFrame:
    a = sides(spark, d).withColumn("year", F.substring(dates.norm_date(F.col("date")), 1, 4))
    briefs = a.where("year <= '2018' and format = 'news brief'").withColumn("set", F.lit("briefs"))
    long = a.where("coalesce(word_count, 0) >= 400").withColumn("set", F.lit("long"))
    return briefs.unionByName(long)


def matched_sets(spark, d):
    """Articles and words of each cohort and side."""
    return _sets(spark, d).groupBy("set", "side").agg(F.count("*").alias("articles"), F.sum(text.word_count("body")).cast("bigint").alias("words"))


def final_sentences(spark, d):
    return cohorts.final_profile(_sets(spark, d), ["set", "side"], text.strip_furniture(F.col("body"), SECTION))


def search_postings(spark, d):
    return search.postings(art(spark, d).select(F.col("slug").alias("id"), F.col("body").alias("text"))).groupBy("term").agg(F.count("*").alias("df"), F.min("id").alias("first"), F.max("id").alias("last"))


QUESTION = ["the", "scout", "named", "quarter"]


def and_search(spark, d):
    p = search.postings(art(spark, d).select(F.col("slug").alias("id"), F.col("body").alias("text")), stop=())
    return search.all_of(p, QUESTION)


def title_phrase(spark, d):
    return art(spark, d).where(F.contains(F.lower("title"), F.lit("dust devils"))).select("slug", "title")


def search_order(spark, d):
    a = art(spark, d).select("slug", dates.norm_date(F.col("date")).alias("iso"))
    return search.numbered(a, [F.desc("iso"), F.desc("slug")], "search_id")


def facets(spark, d):
    """Counts per facet value; articles have one year, series, format and byline, and many teams and players."""
    raw = table(spark, d, "articles").where("slug is not null")
    ent = raw.groupBy("slug").agg(F.min(F.struct(F.col("entities").isNull().alias("none"), F.to_json("entities").alias("e"))).alias("x"))
    ent = ent.select("slug", F.from_json("x.e", "struct<teams: array<string>, players: array<string>>").alias("entities"))
    a = art(spark, d).join(ent, "slug").withColumn("year", F.substring(dates.norm_date(F.coalesce("date", F.lit(""))), 1, 4))
    one = F.array(*[F.struct(F.lit(n).alias("facet"), F.col(c).alias("value")) for n, c in (("year", "year"), ("series", "series"), ("format", "format"), ("byline", "byline_raw"))])
    tagged = lambda n: lambda v: F.struct(F.lit(n).alias("facet"), v.alias("value"))
    many = [F.transform(F.coalesce(F.col(f"entities.{c}"), F.array().cast("array<string>")), tagged(n)) for n, c in (("team", "teams"), ("player", "players"))]
    v = a.select("slug", F.explode(F.concat(one, *many)).alias("v")).select("slug", "v.facet", "v.value").where("value <> ''").distinct()
    return v.groupBy("facet", "value").agg(F.count("*").alias("n"))


def year_spine(spark, d):
    """Articles per year and route, without gaps in the years."""
    a = art(spark, d).select("slug", F.substring(dates.norm_date(F.coalesce("date", F.lit(""))), 1, 4).alias("year")).where("year <> ''")
    p = table(spark, d, "provenance").where("slug is not null").groupBy("slug").agg(F.max(F.when(F.col("discovered_via").startswith("/author/"), 1).otherwise(0)).alias("seed"))
    y = a.join(p, "slug", "left").groupBy(F.col("year").cast("int").alias("year")).agg(F.count("*").alias("n"), F.sum(F.coalesce("seed", F.lit(0))).alias("seeds"))
    spine = y.agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return spine.join(y, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("seeds", F.lit(0)).alias("seeds"))


def manifest(spark, d):
    a = art(spark, d).withColumn("year", F.nullif(F.substring(dates.norm_date(F.coalesce("date", F.lit(""))), 1, 4), F.lit("")))
    return a.agg(
        F.count("*").alias("articles"), F.count_if(F.col("byline_verdict") == TARGET).alias("target"), F.count_if(F.coalesce("dek", F.lit("")) != "").alias("with_dek"),
        F.count_if(F.col("format") == "ranking").alias("rankings"), F.countDistinct("content_id").alias("content_ids"), F.concat(F.min("year"), F.lit("-"), F.max("year")).alias("span"),
    )


def metadata(spark, d):
    """Public metadata: defaults for what is missing, the retrieval's fields flattened, body and dek left out."""
    p = table(spark, d, "provenance").where("slug is not null").groupBy("slug").agg(F.max_by(F.struct("original_url", "source_type", "http_status"), F.struct("retrieved_at", "prov_id")).alias("p"))
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    return art(spark, d).join(p, "slug", "left").select("slug", *[e(c).alias(c) for c in ("title", "site", "byline_verdict", "content_id", "series", "format")], F.coalesce("word_count", F.lit(0)).alias("word_count"), e("p.original_url").alias("original_url"), e("p.source_type").alias("source_type"), F.col("p.http_status").alias("http_status"))


def voice_payload(spark, d):
    """Terms of up to seven words with the numbers of their articles, those without any left out."""
    ids = search_order(spark, d).select("slug", "search_id")
    v = table(spark, d, "analysis_voice").where("term is not null and z is not null").groupBy("run_id", "term").agg(F.max("z").alias("z"), F.flatten(F.collect_list("articles")).alias("articles"))
    v = v.where(F.size(F.split(F.trim("term"), r"\s+")) <= 7).select("run_id", "term", F.round("z", 3).alias("z"), F.explode(F.array_distinct("articles")).alias("slug"))
    return v.join(ids, "slug").groupBy("run_id", "term", "z").agg(F.count("*").alias("n"), F.min("search_id").alias("first"), F.max("search_id").alias("last"))


# --- SQL --------------------------------------------------------------------------------------------------------------

ART = "art as (select slug, min(site) site, min(title) title, min(dek) dek, min(date) date, min(byline_raw) byline_raw, min(byline_verdict) byline_verdict, min(content_id) content_id, min(series) series, min(format) format, min(word_count) word_count, min(body) body from articles where slug is not null group by slug)"
_FOLD = "regexp_replace(strip_accents(replace(regexp_replace(body, '[  -   　]', ' ', 'g'), '…', '...')), '[^\\x00-\\x7F]', '', 'g')"
SIDE = ART + f", sides as (select *, case when byline_verdict = '{TARGET}' then 'target' when byline_verdict = 'other' then 'control' end side from art where byline_verdict in ('{TARGET}', 'other'))"
_TOK = r"[A-Za-z0-9]+(?:''[A-Za-z]+)*"


def _sents(source: str, extra: str = "") -> str:
    return (
        f"chunks as (select slug{extra}, unnest(string_split_regex(replace({_FOLD}, '`', ''''), '[.!?;:]+|\\n+|\\s--\\s')) c, generate_subscripts(string_split_regex(replace({_FOLD}, '`', ''''), '[.!?;:]+|\\n+|\\s--\\s'), 1) s from {source} where body is not null)"
        f", sents as (select slug{extra}, s, regexp_extract_all(c, '{_TOK}') t from chunks where len(regexp_extract_all(c, '{_TOK}')) > 0)"
    )


def _grams(source: str, lo: int, hi: int, extra: str = "") -> str:
    return f"gram as (select slug{extra}, s, array_to_string(list_slice(t, i, i + n - 1), ' ') term from (select slug{extra}, s, t, n, unnest(range(1, len(t) - n + 2)) i from (select slug{extra}, s, list_transform(t, lambda x: lower(x)) t from {source}), (select unnest(range({lo}, {hi + 1})) n)))"


def _counts(hi: int) -> str:
    return "with " + SIDE + ", " + _sents("sides", ", side") + ", " + _grams("sents", 1, hi, ", side") + (
        ", per as (select side, term, slug, count(*) n from gram group by all)"
        ", cnt as (select term, sum(case when side = 'target' then n else 0 end) tt, sum(case when side = 'control' then n else 0 end) tc, count(case when side = 'target' then 1 end) dt, count(case when side = 'control' then 1 end) dc from per group by term having count(case when side = 'target' then 1 end) >= 3)"
    )


def _z(yt: str, yc: str) -> str:
    return (
        f", v as (select term, {yt}::double yt, {yc}::double yc, dt from cnt), n as (select sum(yt) nt, sum(yc) nc from v)"
        ", scored as (select term, yt::bigint n_target, yc::bigint n_control, dt::bigint df, (ln((2*yt+yc)/(2*nt+nc-2*yt-yc)) - ln((yt+2*yc)/(nt+2*nc-yt-2*yc))) / sqrt(1/(2*yt+yc) + 1/(yt+2*yc)) z from v, n)"
    )


def _collapse(strict: bool) -> str:
    return (
        ", w as (select df wdf, z wz, string_split(term, ' ') w from scored where contains(term, ' '))"
        ", part as (select wdf, wz, array_to_string(list_slice(w, i, i + n - 1), ' ') term from (select *, unnest(range(1, len(w) - n + 2)) i from (select *, unnest(range(1, len(w))) n from w)))"
        f", gone as (select distinct term from part join scored using (term) where wdf > 0.8 * df{' and z < wz' if strict else ''})"
        " select term, n_target, n_control, df, round(z, 6) z from scored where term not in (select term from gone)"
    )


_ISO_TRIES = [
    (r"\b(\d{4}-\d{1,2}-\d{1,2})(?:[^\d]|$)", ["%Y-%m-%d"]), (r"\b(\d{4}/\d{1,2}/\d{1,2})\b", ["%Y/%m/%d"]), (r"\b(\d{1,2}/\d{1,2}/\d{4})\b", ["%m/%d/%Y"]),
    (r"\b(\d{1,2}-\d{1,2}-\d{4})\b", ["%m-%d-%Y"]), (r"\b([A-Za-z]+\.?\s+\d{1,2}(?:st|nd|rd|th)?[,]?\s+\d{4})\b", ["%b %d %Y", "%B %d %Y"]), (r"\b(\d{1,2}\s+[A-Za-z]+\.?[,]?\s+\d{4})\b", ["%d %b %Y", "%d %B %Y"]),
]


@lru_cache
def iso(col: str = "date") -> str:
    """SQL of dates.norm_date."""
    tries = []
    for p, fs in _ISO_TRIES:
        v = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract({col}, '{p}', 1, 'i'), '(\\d)(st|nd|rd|th)\\b', '\\1', 'gi'), '\\bSept\\b', 'Sep', 'gi'), '[,.]', '', 'g'), '\\s+', ' ', 'g')"
        tries += [f"try_strptime({v}, '{f}')" for f in fs]
    return f"coalesce(strftime(coalesce({', '.join(tries)}), '%Y-%m-%d'), '')"


_PROMO = "(?im)^\\s*(?:follow .{0,60}? on twitter.*|the latest (?:edition of )?.{0,4}?" + SECTION + " podcast.*|find more " + SECTION + " content.*|download the .{0,40}?podcast.*|listen to the episode.*|subscribe on .*)\\s*$"
_STRIP = (
    f"array_to_string(list_filter(string_split(regexp_replace(regexp_replace(body, '{_PROMO}', '', 'g'), '(?im)^\\s*\\d{{4}}\\s+(?:stats|final ranking)\\s*:.*$', '', 'g'), chr(10)), lambda l: "
    "not (starts_with(trim(l, ' '), '- ') and (regexp_matches(l, '[▶▷▹◀▸]') or len(trim(l, ' ')) - len(replace(l, '|', '')) >= 2 and len(l) - len(replace(l, '|', '')) >= 2))"
    " and not (len(l) - len(replace(l, '|', '')) >= 2 and len(regexp_extract_all(l, '\\S+')) > 0 and len(list_filter(regexp_extract_all(l, '\\S+'), lambda t: regexp_matches(t, '^[\\d,.\\-]+$'))) > 0.25 * len(regexp_extract_all(l, '\\S+')))), chr(10))"
)
_WORDS = "len(regexp_extract_all({}, '[^\\s\\v\\x1c-\\x1f\\x85   -     　]+'))::bigint"
SETS = SIDE + f", y as (select *, left({iso()}, 4) yr from sides), sets as (select *, 'briefs' \"set\" from y where coalesce(yr, '') <= '2018' and format = 'news brief' union all select *, 'long' from y where coalesce(word_count, 0) >= 400)"
_SEARCH = "list_distinct(regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+'))"

SQL = {
    "term_freq": "with " + ART + ", " + _sents("art") + ", t as (select slug, lower(unnest(t)) term from sents) select term, count(*)::bigint tf, count(distinct slug)::bigint df from t group by term",
    "doc_freq": "with " + ART + ", " + _sents("art") + ", " + _grams("sents", 1, 3) + " select term, count(distinct slug)::bigint df from gram group by term having count(distinct slug) >= 3",
    "bigram_postings": "with " + ART + ", " + _sents("art") + ", " + _grams("sents", 2, 2) + " select term, count(distinct slug)::bigint df, string_agg(distinct slug, ',' order by slug) slugs from gram group by term having count(distinct slug) between 3 and 20",
    "proper_nouns": "with " + ART + ", " + _sents("art") + ", x as (select unnest(t[2:]) t from sents) select lower(t) token, count(case when regexp_matches(t, '^[A-Z]') then 1 end)::bigint caps, count(*)::bigint total from x group by 1 having count(case when regexp_matches(t, '^[A-Z]') then 1 end) > 0.7 * count(*)",
    "distinctive_terms_tf": _counts(3) + _z("tt", "tc") + " select term, n_target, n_control, df, round(z, 6) z from scored",
    "distinctive_terms_df": _counts(3) + _z("dt", "dc") + " select term, n_target, n_control, df, round(z, 6) z from scored",
    "top_distinctive": _counts(2) + _z("dt", "dc") + " select term, n_target, n_control, df, round(z, 6) z, row_number() over (order by round(z, 6) desc, term) rank from scored order by round(z, 6) desc, term limit 50",
    "collapse_maximal": _counts(3) + _z("dt", "dc") + _collapse(False),
    "collapse_strict": _counts(3) + _z("dt", "dc") + _collapse(True),
    "break_runs": "with " + ART + ", " + _sents("art") + ", x as (select unnest(t[2:]) t from sents), proper as (select lower(t) token from x group by 1 having count(case when regexp_matches(t, '^[A-Z]') then 1 end) > 0.7 * count(*)), tok as (select slug, s, lower(unnest(t)) token, generate_subscripts(t, 1) pos from sents), m as (select *, (token in (select token from proper) or regexp_matches(token, '^(?:19|20)\\d{2}$'))::int gone from tok), r as (select slug, s, gone, sum(gone) over (partition by slug, s order by pos) run from m), g as (select slug, s, run, count(*) n from r where gone = 0 group by all) select slug, count(*)::bigint runs, sum(n)::bigint tokens, max(n)::bigint longest from g group by slug",
    "era_matched": "with " + SIDE + f", y as (select *, left({iso()}, 4) yr from sides where {iso()} <> '') select side, count(*)::bigint articles, min(yr) || '-' || max(yr) span from y where yr in (select yr from y where side = 'target') and yr in (select yr from y where side = 'control') group by side",
    "furniture_stripped": "with " + ART + f" select slug, coalesce({_WORDS.format('body')}, 0) words, {_WORDS.format(_STRIP)} kept from art",
    "line_dedup": "with " + ART + ", l as (select slug, list_filter(string_split(body, chr(10)), lambda x: trim(x, ' ') <> '') ls from art where body is not null), u as (select slug, unnest(ls) x, generate_subscripts(ls, 1) i from l), p as (select *, lag(x) over (partition by slug order by i) before from u) select slug, count(*)::bigint lines, count(case when before is null or x <> before then 1 end)::bigint kept from p group by slug",
    "matched_sets": "with " + SETS + f' select "set", side, count(*)::bigint articles, sum({_WORDS.format("body")})::bigint words from sets group by "set", side',
    "search_postings": "with " + ART + f", p as (select slug, unnest({_SEARCH}) term from art where body is not null) select term, count(*)::bigint df, min(slug) \"first\", max(slug) \"last\" from p where len(term) >= 3 and term not in ({', '.join(repr(w) for w in search.STOP)}) group by term",
    "and_search": "with " + ART + f", p as (select slug, unnest({_SEARCH}) term from art where body is not null) select slug id from p where term in ({', '.join(repr(w) for w in QUESTION)}) group by slug having count(distinct term) = {len(QUESTION)}",
    "title_phrase": "with " + ART + " select slug, title from art where contains(lower(title), 'dust devils')",
    "search_order": "with " + ART + f", i as (select slug, {iso('coalesce(date, ' + repr('') + ')')} iso from art) select slug, iso, (row_number() over (order by iso desc, slug desc) - 1)::bigint search_id from i",
    "year_spine": "with " + ART + f", y as (select slug, left({iso('coalesce(date, ' + repr('') + ')')}, 4) yr from art), p as (select slug, max(case when starts_with(discovered_via, '/author/') then 1 else 0 end) seed from provenance group by slug), c as (select yr::int \"year\", count(*) n, sum(coalesce(seed, 0)) seeds from y left join p using (slug) where yr <> '' group by 1), sp as (select unnest(range((select min(\"year\") from c), (select max(\"year\") from c) + 1))::int \"year\") select sp.\"year\", coalesce(n, 0)::bigint n, coalesce(seeds, 0)::bigint seeds from sp left join c on sp.\"year\" = c.\"year\"",
    "manifest": "with " + ART + f", y as (select *, nullif(left({iso('coalesce(date, ' + repr('') + ')')}, 4), '') yr from art) select count(*)::bigint articles, count(case when byline_verdict = '{TARGET}' then 1 end)::bigint target, count(case when coalesce(dek, '') <> '' then 1 end)::bigint with_dek, count(case when format = 'ranking' then 1 end)::bigint rankings, count(distinct content_id)::bigint content_ids, min(yr) || '-' || max(yr) span from y",
    "metadata": "with " + ART + ", p as (select slug, max_by({'u': original_url, 's': source_type, 'h': http_status}, {'a': retrieved_at, 'b': prov_id}) p from provenance group by slug) select art.slug, coalesce(title, '') title, coalesce(site, '') site, coalesce(byline_verdict, '') byline_verdict, coalesce(content_id, '') content_id, coalesce(series, '') series, coalesce(format, '') format, coalesce(word_count, 0)::bigint word_count, coalesce(p.p.u, '') original_url, coalesce(p.p.s, '') source_type, p.p.h http_status from art left join p using (slug)",
}
_LAST = "trim(regexp_extract(regexp_replace(x.p, '\\s+$', ''), '((?:[^.!?]|[.!?]+[^\\s.!?])*[.!?]*)$', 1))"
SQL["final_sentences"] = (
    "with " + SETS + f', c as (select "set", side, {_STRIP} b from sets where body is not null), x as (select "set", side, list_filter(string_split(trim(b, \' \'), chr(10)), lambda q: trim(q, \' \') <> \'\')[-1] p from c)'
    f", l as (select \"set\", side, {_LAST} s from x where p is not null), m as (select \"set\", side, s, {_WORDS.format('s')} w, regexp_matches(s, '\\b(I|we|We|my|our|I''m|I''d|we''ll|We''ll|don''t|Don''t)\\b') fp from l)"
    ' select "set", side, count(*)::bigint n, list_sort(list(w))[(count(*) // 2 + 1)::int]::bigint median_words, round(100.0 * count(case when w <= 12 then 1 end) / count(*), 1) pct_short, round(100.0 * count(case when fp then 1 end) / count(*), 1) pct_first_person from m group by "set", side'
)
SQL["voice_terms"] = (
    "with " + SIDE + f", clean as (select slug, side, {_STRIP} body from sides), " + _sents("clean", ", side").replace("sents as", "whole as")
    + ", x as (select unnest(t[2:]) t from whole), proper as (select lower(t) token from x group by 1 having count(case when regexp_matches(t, '^[A-Z]') then 1 end) > 0.7 * count(*)), tok as (select slug, side, s, lower(unnest(t)) token, generate_subscripts(t, 1) pos from whole)"
    ", m as (select *, (token in (select token from proper) or regexp_matches(token, '^(?:19|20)\\d{2}$'))::int gone from tok), r as (select *, sum(gone) over (partition by slug, s order by pos) run from m)"
    ", sents as (select slug, side, s, list(token order by pos) t from r where gone = 0 group by slug, side, s, run), " + _grams("sents", 1, 4, ", side") + _counts(3).partition(", per as")[1] + _counts(3).partition(", per as")[2] + _z("dt", "dc") + _collapse(False)
)
SQL["facets"] = (
    "with " + ART + f", y as (select *, left({iso('coalesce(date, ' + repr('') + ')')}, 4) yr from art), v as (select slug, 'year' facet, yr \"value\" from y union all select slug, 'series', series from y union all select slug, 'format', format from y union all select slug, 'byline', byline_raw from y"
    " union all select slug, 'team', unnest(entities.teams) from (select slug, min(entities) entities from articles group by slug) union all select slug, 'player', unnest(entities.players) from (select slug, min(entities) entities from articles group by slug))"
    " select facet, \"value\", count(distinct slug)::bigint n from v where \"value\" <> '' group by 1, 2"
)
SQL["voice_payload"] = (
    SQL["search_order"].replace("select slug, iso, (row_number", ", ids as (select slug, (row_number").replace("search_id from i", "search_id from i)")
    + ", g as (select run_id, term, max(z) z, flatten(list(articles)) a from analysis_voice where term is not null and z is not null group by 1, 2), u as (select distinct run_id, term, round(z, 3) z, unnest(a) slug from g where len(regexp_extract_all(trim(term, ' '), '\\s+')) + 1 <= 7)"
    ' select run_id, term, z, count(*)::bigint n, min(search_id) "first", max(search_id) "last" from u join ids using (slug) group by 1, 2, 3'
)
QUERIES = {f.__name__: f for f in (
    top_distinctive, term_freq, doc_freq, bigram_postings, proper_nouns, distinctive_terms_tf, distinctive_terms_df, collapse_maximal, collapse_strict, voice_terms, maximal_phrases, break_runs, era_matched,
    furniture_stripped, line_dedup, measures, matched_sets, final_sentences, search_postings, and_search, title_phrase, search_order, facets, year_spine, manifest, metadata, voice_payload,
)}
_T = [(label, pattern) for label, pattern, _ in cohorts.TERMS]
SQL["measures"] = "with " + SIDE + f", w as (select side, sum({_WORDS.format('body')}) words from sides where body is not null group by side), m as (" + " union all ".join(
    f"select side, '{label}' label, sum(len(regexp_extract_all(body, '{pattern}')))::bigint occurrences from sides where body is not null group by side" for label, pattern in _T
) + ") select side, label, occurrences, words::bigint words, round(10000.0 * occurrences / words, 3) per_10k from m join w using (side)"
