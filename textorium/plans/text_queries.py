"""Scalar functions and predicates over texts, URLs, dates and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, ids, text, urls
from ..operators import chunking, filters
from ..sources.tables import spread, table
from .base import CHUNKS, DOCS, chunks, documents, query, rounded

WS = r"'^\s+|\s+$'"
TOK = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


@query(r"select count(*) as n from documents where text is not null")
def a03_document_count(spark, d):
    return table(spark, d, "documents").filter("text is not null").agg(F.count("*").alias("n"))


@query("select doc_id, text from documents where doc_id in (3, 14, 159, 265)")
def a04_text_lookup(spark, d):
    return table(spark, d, "documents").filter(F.col("doc_id").isin(3, 14, 159, 265)).select("doc_id", "text")


@query("select doc_id from documents where exists (select 1 from labels where labels.doc_id = documents.doc_id)")
def a07_existence(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id")


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by user_id")
def a02_last_line_wins(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query("select doc_id, sha1(text) as fingerprint from documents")
def a09_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1("text").alias("fingerprint"))


@query("select doc_id, contains(lower(text), 'worthless') or contains(lower(text), 'idiot') as matched, contains(text, 'The') as matched_case from documents")
def b01_contains_any(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", text.contains_any("text", ["Worthless", "idiot"]).alias("matched"), text.contains_any("text", ["The"], True).alias("matched_case"))


@query(r"select doc_id, regexp_matches(text, '(?i)the\s*[-–—\n\s]*of\s*[-–—\n\s]*(and|&)') as matched from documents")
def b02_organisation(spark, d):
    return table(spark, d, "documents").select("doc_id", text.organisation("text", "QZXW", ["the", "of", "and"]).alias("matched"))


@query("""select doc_id, coalesce(lang = 'en', false) as is_eq, coalesce(lang <> 'en', false) as is_ne, coalesce(n_chars > 2000, false) as is_gt,
coalesce(lang in ('de', 'fr'), false) as is_in, coalesce(contains(source, '1'), false) as has from documents""")
def b03_metadata_comparison(spark, d):
    t = table(spark, d, "documents")
    f = filters.metadata
    return t.select(
        "doc_id", f("lang", "en").alias("is_eq"), f("lang", "en", "ne").alias("is_ne"), f("n_chars", 2000, "gt").alias("is_gt"),
        f("lang", ["de", "fr"], "in").alias("is_in"), f("source", "1", "contains").alias("has"),
    )


@query("select doc_id from documents where lang = 'en' and n_chars > 1000 and contains(lower(text), 'tion')")
def b04_composite(spark, d):
    t = table(spark, d, "documents")
    return t.filter(filters.every(filters.metadata("lang", "en"), filters.metadata("n_chars", 1000, "gt"), text.contains_any("text", ["tion"]))).select("doc_id")


CLEAN = r"""with s as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents),
c as (select doc_id, regexp_replace(case when strpos(lower(t), 'license') > 0 then substr(t, 1, strpos(lower(t), 'license') - 1) else t end, '^\s+|\s+$', '', 'g') as t from s)
select doc_id, sha1(t) as cleaned from c where t <> '' and not regexp_matches(t, '(?i)!!') and (length(lower(t)) - length(replace(lower(t), '***', ''))) / 3 < 4"""


@query(CLEAN)
def b05_clean(spark, d):
    c = spread(table(spark, d, "documents")).select("doc_id", text.clean("text", ["License"], ["!!", "("], {"***": 4}).alias("t"))
    return c.filter("t is not null").select("doc_id", F.sha1("t").alias("cleaned"))


@query(f"""select doc_id, contains(lower(text), 'enti') as plain, list_contains({TOK}, 'that') as whole, regexp_matches(text, '(?i)th[ai]t') as pattern from documents""")
def b07_keyword_matcher(spark, d):
    t = table(spark, d, "documents")
    m = text.keyword_match
    return t.select("doc_id", m("text", "Enti").alias("plain"), m("text", "word:that").alias("whole"), m("text", "regex:th[ai]t").alias("pattern"))


@query(f"with {CHUNKS} select doc_id, cast(count(*) as bigint) as n from chunks where not regexp_matches(chunk, '(?i)(xyz|tion the)') group by doc_id")
def b08_chunk_filter(spark, d):
    c = chunks(spark, d).withColumn("chunk", text.clean("chunk", exclude=["(xyz|tion the)"])).filter("chunk is not null")
    return c.groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"with {CHUNKS} select distinct doc_id from chunks where regexp_matches(chunk, '(?i)th[ai]t') or contains(lower(chunk), 'ñue')")
def b09_any_chunk_matches(spark, d):
    t = documents(spark, d).withColumn("cs", chunking.sentences("text"))
    return t.filter(F.exists("cs", lambda c: text.keyword_match(c, "regex:th[ai]t") | text.keyword_match(c, "ñue"))).select("doc_id")


@query(f"with {DOCS} select doc_id from docs where contains(lower(text), 'sh') and published_at >= '2024-01-01' and domain in ('src1', 'src2')")
def b11_b12_b15_document_filters(spark, d):
    t = documents(spark, d)
    return t.filter(text.contains_any("text", ["sh"]) & filters.since("published_at", "2024-01-01") & F.col("domain").isin("src1", "src2")).select("doc_id")


@query(f"with {DOCS} select doc_id, published_at from docs where published_at between '2023-02-01' and '2023-02-20' or published_at between '2023-11-15' and '2024-01-10' or published_at between '2024-11-15' and '2025-01-10'")
def b13_b14_date_windows(spark, d):
    w = dates.windows([("2023-02-01", "2023-02-20")], ("11-15", "01-10"), [2023, 2024])
    return documents(spark, d).filter(dates.in_windows("published_at", w)).select("doc_id", "published_at")


@query("select page_id from pages where contains(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), 'blog.') or contains(lower(url), '/fr/')")
def b16_blacklist(spark, d):
    return table(spark, d, "pages").filter(urls.blocked("url", ["blog."], ["/fr/"])).select("page_id")


@query("""select event_id from events where (event_type in ('click', 'view')) and not (event_type in ('view') and user_id % 2 = 0)
and (value is null or value = 0 or value >= 20) and (ts is null or ts between timestamp '2024-01-05' and timestamp '2024-01-25')""")
def b17_finding_filters(spark, d):
    e = table(spark, d, "events")
    keep = F.col("event_type").isin("click", "view") & ~((F.col("event_type") == "view") & (F.col("user_id") % 2 == 0))
    return e.filter(keep & filters.lenient_confidence("value", 20) & filters.lenient_between("ts", "2024-01-05 00:00:00", "2024-01-25 00:00:00")).select("event_id")


@query("select event_id from events where event_type = 'click' and value >= 20 and value <> 0 and contains(lower(coalesce(props, '')), '1')")
def b18_finding_search(spark, d):
    return table(spark, d, "events").filter((F.col("event_type") == "click") & filters.strict_confidence("value", 20) & text.contains_any("props", ["1"])).select("event_id")


@query("select page_id from (select page_id, row_number() over (partition by url order by page_id) as k from pages where contains(lower(html), 'tion') or contains(lower(url), 'shop')) where k = 1")
def b19_store_search(spark, d):
    from ..operators.dedup import first_by

    p = table(spark, d, "pages").filter(text.contains_any("html", ["tion"]) | text.contains_any("url", ["shop"]))
    return first_by(p, ["url"], "page_id").select("page_id")


@query(f"with {DOCS} select doc_id from docs where published_at is null or substr(published_at, 1, 10) between '2023-05-01' and '2023-08-31'")
def b20_date_range_null_passes(spark, d):
    return documents(spark, d).filter(filters.lenient_between(F.substring("published_at", 1, 10), "2023-05-01", "2023-08-31")).select("doc_id")


@query(r"""select doc_id, length(text) >= 100 and len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) >= 10 and not contains(lower(text), 'please wait')
and not contains(lower(text), 'captcha') and not contains(lower(text), 'to respond') as valid, length(text) >= 400 as long_400, length(text) >= 200 as long_200 from documents""")
def b22_b23_valid_content(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", text.valid_content("text").alias("valid"), (F.length("text") >= 400).alias("long_400"), (F.length("text") >= 200).alias("long_200"))


@query("""select doc_id, case when (lang = 'en' and contains(lower(text), 'that')) or (lang = 'de' and contains(lower(text), 'nicht')) or lang not in ('en', 'de') then 'annotate' else 'zero' end as route from documents""")
def b24_relevance_partition(spark, d):
    route = filters.relevance("text", "lang", {"en": ["that"], "de": ["nicht"]})
    return table(spark, d, "documents").select("doc_id", F.when(route, "annotate").otherwise("zero").alias("route"))


@query("""select count(*) as total, cast(count_if(n_chars > 1500) as bigint) as passed, cast(count_if(not (n_chars > 1500)) as bigint) as failed, round(100.0 * count_if(n_chars > 1500) / count(*), 6) as success from documents""")
def b25_d09_pipeline_counts(spark, d):
    return rounded(filters.counts(filters.split(table(spark, d, "documents"), F.col("n_chars") > 1500)), "success")


@query("""with h as (select regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from pages) select host, cast(count(*) as bigint) as n from h group by host having count(*) >= 3 order by n desc, host limit 8""")
def b28_top_domains(spark, d):
    h = table(spark, d, "pages").groupBy(urls.netloc("url").alias("host")).agg(F.count("*").alias("n"))
    return h.filter("n >= 3").orderBy(F.desc("n"), "host").limit(8)


@query("select page_id from pages where starts_with(lower(url), 'https://') and (contains(lower(url), '/en/') or contains(lower(url), '/de/'))")
def b29_a32_publication_url(spark, d):
    return table(spark, d, "pages").filter(urls.is_publication("url", "https://", ("/en/", "/de/"))).select("page_id")


@query(r"""select doc_id, cast(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) as bigint) as word_count, cast(length(text) as bigint) as char_count,
cast(len(list_filter(string_split(text, '.'), lambda s: length(regexp_replace(s, '\s+', '', 'g')) > 0)) as bigint) as sentence_count,
case when len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) > 0 then round(cast(length(text) as double) / len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')), 2) else 0 end as avg_word_length from documents""")
def h01_h02_text_statistics(spark, d):
    return table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in text.statistics("text").items()))


@query(f"""select doc_id, cast(len(list_filter({TOK}, lambda t: t = 'that')) as bigint) as n_that, cast(len(list_filter({TOK}, lambda t: t = 'nicht')) as bigint) as n_nicht from documents""")
def h03_keyword_counts(spark, d):
    c = lambda k: text.keyword_count("text", k, hyphenation=False)
    return spread(table(spark, d, "documents")).select("doc_id", c("that").alias("n_that"), c("nicht").alias("n_nicht"))


@query("select doc_id, cast(strpos(lower(text), 'ention') - 1 as bigint) as at from documents where contains(lower(text), 'ention')")
def h04_keyword_position(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.keyword_position("text", "ention", whole_word=False, hyphenation=False).alias("at"))
    return t.filter("at is not null")


@query(r"""select doc_id, cast(len(regexp_extract_all(text, '(?i)(?:tion|ti\s*[-\n]\s*on)')) as bigint) as loose, cast(len(regexp_extract_all(text, 'The')) as bigint) as cased from documents""")
def h05_h06_keyword_modes(spark, d):
    t = table(spark, d, "documents")
    return t.select(
        "doc_id", text.keyword_count("text", "tion", whole_word=False).alias("loose"),
        text.keyword_count("text", "The", whole_word=False, hyphenation=False, case_sensitive=True).alias("cased"),
    )


HOST = "regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1)"


@query(f"select page_id, list_extract(string_split({HOST}, '.'), -2) || '.' || list_extract(string_split({HOST}, '.'), -1) as source from pages")
def h07_media_source(spark, d):
    return table(spark, d, "pages").select("page_id", urls.media_source("url").alias("source"))


@query(f"select page_id, list_extract(string_split({HOST}, '.'), -2) || '.' || list_extract(string_split({HOST}, '.'), -1) as domain, {HOST} as host, split_part({HOST}, ':', 1) as bare from pages")
def h08_h09_h10_domains(spark, d):
    return table(spark, d, "pages").select("page_id", urls.base_domain("url").alias("domain"), urls.host_or_unknown("url").alias("host"), urls.host_without_port("url").alias("bare"))


CANON = r"""with p as (select page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) as s, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) as h,
regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '[?]([^#]*)', 1) as q from pages),
c as (select page_id, lower(s) || '://' || split_part(lower(h), ':', 1) || case when path = '' then '/' else path end as b,
array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: contains(x, '=') and split_part(x, '=', 1) not in ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid'))), '&') as q from p)
select page_id, b || case when q <> '' then '?' || q else '' end as canonical, sha1(b || case when q <> '' then '?' || q else '' end) as stable_id from c"""


@query(CANON)
def h11_h12_canonical_urls(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical("url").alias("canonical"), urls.stable_id("url").alias("stable_id"))


@query("select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(date_trunc('week', ts), '%Y-%m-%d') as week, strftime(date_trunc('month', ts), '%Y-%m-%d') as month, strftime(ts, '%d %b %Y') as label from events")
def h14_h15_h17_dates(spark, d):
    e = table(spark, d, "events")
    day = dates.normalised(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.select("event_id", dates.period(day, "day").alias("day"), dates.period(day, "week").alias("week"), dates.period(day, "month").alias("month"), F.date_format(day, "dd MMM yyyy").alias("label"))


@query(f"with {DOCS} select doc_id, substr(published_at, 1, 10) as day, corpus || '@@' || doc_id as global_id, corpus || '@@' || doc_id || ':chunk' || '007' as passage_id, cast(doc_id as varchar) as local_id from docs")
def h16_h22_ids(spark, d):
    t = documents(spark, d).withColumn("g", ids.global_id(F.col("corpus"), F.col("doc_id").cast("string")))
    return t.select(
        "doc_id", F.substring("published_at", 1, 10).alias("day"), F.col("g").alias("global_id"),
        ids.passage_id(F.col("corpus"), F.col("doc_id").cast("string"), F.lit(7)).alias("passage_id"), ids.split_global(F.col("g"))[1].alias("local_id"),
    )


@query("select conv_id, turn, cast(conv_id as varchar) as doc, cast(turn as bigint) as number from conversations")
def h23_chunk_ids(spark, d):
    c = table(spark, d, "conversations")
    doc, n = ids.parse_chunk_id(ids.chunk_id(F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return c.select("conv_id", "turn", doc.alias("doc"), n.cast("long").alias("number"))


@query("select event_id, nullif(trim(json_extract_string(props, '$.' || json_keys(props)[1])), '') as v from events where props is not null")
def h24_nested_metadata(spark, d):
    e = table(spark, d, "events").filter("props is not null")
    first = F.element_at(F.json_object_keys("props"), 1)
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.nullif(F.trim(F.try_element_at(m, first)), F.lit("")).alias("v"))


@query(r"""select page_id, nullif(regexp_replace(coalesce(nullif(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1), ''), regexp_extract(html, '(?i)<h1[^>]*>([^<]+)</h1>', 1)), '^\s+|\s+$', '', 'g'), '') as title,
sha1(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g'), '^\s+|\s+$', '', 'g')) as plain from pages""")
def h39_h40_html(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_title("html").alias("title"), F.sha1(text.html_plain("html")).alias("plain"))


@query(r"""with p as (select page_id, html from pages union all select -1 - doc_id, text || ' ' || case doc_id % 3 when 0 then strftime(date '2023-01-01' + cast(doc_id * 7 % 730 as integer), '%d/%m/%Y')
  when 1 then strftime(date '2023-01-01' + cast(doc_id * 7 % 730 as integer), '%-d %B %Y') else strftime(date '2023-01-01' + cast(doc_id * 7 % 730 as integer), '%B %-d, %Y') end from documents),
f as (select page_id, list_concat(list_transform(regexp_extract_all(html, '(\d{4}-\d{2}-\d{2})', 1), lambda x: try_strptime(x, '%Y-%m-%d')),
  list_transform(regexp_extract_all(html, '(\d{4}/\d{2}/\d{2})', 1), lambda x: try_strptime(x, '%Y/%m/%d')), list_transform(regexp_extract_all(html, '(\d{2}/\d{2}/\d{4})', 1), lambda x: try_strptime(x, '%m/%d/%Y')),
  list_transform(regexp_extract_all(html, '(\d{1,2}\s+\w+\s+\d{4})', 1), lambda x: try_strptime(regexp_replace(x, '\s+', ' ', 'g'), '%d %B %Y')),
  list_transform(regexp_extract_all(html, '(\w+\s+\d{1,2},?\s+\d{4})', 1), lambda x: try_strptime(regexp_replace(x, '\s+', ' ', 'g'), ['%B %d, %Y', '%B %d %Y']))) as l from p)
select page_id, strftime(list_filter(l, lambda x: x is not null)[1], '%Y-%m-%d') as found from f""")
def h41_date_in_text(spark, d):
    """Dates in whole pages, and in texts that end with one in words, or by slashes with the day first (which reads as no date beyond the 12th)."""
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") * 7 % 730).cast("int"))
    k = F.col("doc_id") % 3
    said = F.when(k == 0, F.date_format(day, "dd/MM/yyyy")).when(k == 1, F.date_format(day, "d MMMM yyyy")).otherwise(F.date_format(day, "MMMM d, yyyy"))
    p = table(spark, d, "pages").select("page_id", "html")
    p = p.union(table(spark, d, "documents").select(-1 - F.col("doc_id"), F.concat("text", F.lit(" "), said)))
    return p.select("page_id", text.date_in("html").alias("found"))


@query(r"select doc_id, case when length(text) <= 60 then text else regexp_replace(substr(text, 1, 60), '\s\S*$', '') || '...' end as short, md5(text) as key, sha256(text) as sha from documents")
def h43_h44_shortened(spark, d):
    return table(spark, d, "documents").select("doc_id", text.shortened("text", 60).alias("short"), F.md5("text").alias("key"), F.sha2("text", 256).alias("sha"))


_CONNECTORS = ", ".join(f"'{w}'" for w in text.CONNECTORS)


@query(rf"""with {CHUNKS} select doc_id, cast(count(*) as bigint) as n_chunks, cast(count_if(regexp_replace(lower(regexp_extract(chunk, '^\s*(\S+)', 1)), '[.,!?:;]+$', '') in ({_CONNECTORS})) as bigint) as n
from chunks group by doc_id""")
def i05_connectors(spark, d):
    c = chunks(spark, d)
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_if(text.starts_with_connector("chunk")).alias("n"))


@query(f"""with {CHUNKS}, n as (select doc_id, floor((row_number() over (partition by doc_id order by chunk_id) - 1) / 8) as batch from chunks)
select doc_id, cast(batch as bigint) as batch, cast(count(*) as bigint) as n from n group by all""")
def i07_batches(spark, d):
    return chunking.batches(chunks(spark, d), "chunk_id", 8, "doc_id")


@query()
def i02_packed_chunks(spark, d):
    return chunking.explode_chunks(documents(spark, d), chunking.packed("text", 80), "doc_id")


@query()
def i06_windows(spark, d):
    return chunking.windows(documents(spark, d), "doc_id", "text")


@query("select row_number() over (partition by doc_id order by pos) - 1 as chunk_id, doc_id, w as line from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as w from documents)")
def e10_ordinals(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_id", "line")).withColumn("chunk_id", F.col("chunk_id").cast("long"))
