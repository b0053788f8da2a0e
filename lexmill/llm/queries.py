"""Queries of the problems for training text, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import boilerplate, leaks, lines, mixing, names, spam, spans, terms
from lexmill.session import cut
from lexmill.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.boilerplate_lines(table(spark, d, "articles"), table(spark, d, "provenance"))


def p1_bodies(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_bodies(table(spark, d, "articles"), table(spark, d, "provenance"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "articles"), cut)


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles")
    return spans.shared_amounts(a, spans.shared_spans(a, cut))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_name_pairs(names.entities(table(spark, d, "articles"), table(spark, d, "roster"), cut))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entities(table(spark, d, "articles"), table(spark, d, "roster"), cut)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(table(spark, d, "articles"), cut)


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """Each body without the lines that are excessive in its source, alone or with their near-duplicates, and these."""
    a = table(spark, d, "articles")
    start = lines.frequent_lines(a, cut)
    return lines.without_lines(a, lines.repeated_lines(a, cut, start=start).unionByName(lines.near_lines(a, cut, start=start)).distinct())


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "articles"), table(spark, d, "analysis_voice")).where("mark is not null").select("field", "term", "mark")


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "articles"), table(spark, d, "analysis_voice"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), cut=cut)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), cut=cut)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_scores(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_bodies": p1_bodies, "p3_found": p3_found, "p3_entities": p3_entities, "p2_found": p2_found, "p2_shares": p2_shares, "p5_found": p5_found, "p5_clean": p5_clean, "p9_found": p9_found, "p9_scores": p9_scores, "p6_found": p6_found, "p6_terms": p6_terms, "p7_found": p7_found, "p8_mix": p8_mix, "p8_shares": p8_shares}
_ART = "art as (select slug, min(site) site, min(byline_verdict) v, min(body) body from articles where slug is not null group by slug)"
_WORDS = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x))"
_BLANK = "[\\s\\v\\x1c-\\x1f\\x85   -     　]+"
SQL: dict[str, str] = {
    "p5_found": "with " + _ART + ", l as (select slug, site, v, unnest(string_split(body, chr(10))) l, generate_subscripts(string_split(body, chr(10)), 1) - 1 line_no from art where body is not null)"
    f", k as (select slug, site, v, line_no, regexp_replace(trim(regexp_replace(lower(l), '{_BLANK}', ' ', 'g'), ' '), '[0-9]+', '0', 'g') k from l), n as (select site, v, count(*) n from art group by all)"
    ", f as (select site, v, k, count(distinct slug) c from k where k <> '' group by all) select distinct slug, line_no::bigint line_no from k join f on k.k = f.k and k.site is not distinct from f.site and k.v is not distinct from f.v join n on k.site is not distinct from n.site and k.v is not distinct from n.v where c >= 4 and c >= 0.04 * n",
    "p6_found": "with " + _ART + ", t as (select distinct slug, unnest(regexp_extract_all(lower(replace(replace(nfc_normalize(body), chr(173), ''), chr(8203), '')), '[\\p{L}\\p{N}]+')) term from art where body is not null)"
    f", v as (select distinct run_id, trim(regexp_replace(lower(term), '{_BLANK}', ' ', 'g'), ' ') term from analysis_voice where term is not null and run_id is not null)"
    ", c as (select 'articles.body' field, term, count(*) n, (select count(*) from art) total from t group by term union all select 'analysis_voice.term', term, count(*), (select count(distinct run_id) from analysis_voice) from v where term <> '' group by term)"
    " select field, term, case when n < 3 then 'rare' else 'common' end mark from c where n < 3 or n > 0.6 * total",
    "p7_found": f"with d as (select doc_id, {_WORDS} w from documents where text is not null), i as (select item_id, {_WORDS} w from eval_items), gd as (select distinct doc_id, array_to_string(list_slice(w, k, k + 9), ' ') g from (select *, unnest(range(1, len(w) - 8)) k from d)), gi as (select distinct item_id, array_to_string(list_slice(w, k, k + 9), ' ') g from (select *, unnest(range(1, len(w) - 8)) k from i)) select distinct doc_id, item_id from gd join gi using (g)",
    "p6_terms": "with " + _ART + ", t as (select slug, unnest(regexp_extract_all(lower(replace(replace(nfc_normalize(body), chr(173), ''), chr(8203), '')), '[\\p{L}\\p{N}]+')) term from art where body is not null)"
    f", v as (select run_id, trim(regexp_replace(lower(term), '{_BLANK}', ' ', 'g'), ' ') term from analysis_voice where term is not null and run_id is not null)"
    ", c as (select 'articles.body' field, term, count(*) o, count(distinct slug) n, (select count(*) from art) total from t group by term union all select 'analysis_voice.term', term, count(*), count(distinct run_id), (select count(distinct run_id) from analysis_voice) from v where term <> '' group by term)"
    " select field, term, o::bigint occurrences, n::bigint records, case when n < 3 then 'rare' when n > 0.6 * total then 'common' end mark from c",
}
