"""The named queries of the core, each with the SQL that gives the same rows where SQL can say it over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions.numerals import ordinal_words, parse_numeral, parse_ordinal, parse_roman, roman
from lexmill.functions.staging import new_path
from lexmill.operators import chapters, dates, lookups, records, retrieval, review, segments, tagging
from lexmill.sources import files, sinks
from lexmill.sources.tables import table
from lexmill.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "lexmill/chunk")
DOSHAS = ["vata", "pitta", "kapha"]
CHUNKS = "c as (select chunk_id, any_value(source) as source, any_value(chapter) as chapter, any_value(chunk_index) as chunk_index, any_value(text) as text, any_value(herbs) as herbs, any_value(diseases) as diseases, any_value(doshas_mentioned) as doshas_mentioned, any_value(n_tokens) as n_tokens, any_value(section_role) as section_role from all_chunks group by chunk_id)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """all_chunks, one row per chunk_id: re-appended rows equal the first but for their load time."""
    return table(spark, folder, "all_chunks").select("chunk_id", *columns).dropDuplicates(["chunk_id"])


# Retrieval

_TERMS = f"ts as (select doc_id as id, {T.tokens_sql('text')} as t from documents), w as (select id, unnest(t) as term from ts), p as (select id, term, count(*) as tf from w group by 1, 2), l as (select id, len(t) as dl from ts where len(t) > 0), st as (select count(*) as n, avg(dl) as avg_dl from l)"
_BM25 = f"""{_TERMS}, df as (select term, count(*) as df from p group by 1), q as (select id as query_id, term from p where id % 100 = 0),
s as (select q.query_id, p.id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.dl / st.avg_dl))), 6) as score
from q join p using (term) join df using (term) join l on l.id = p.id cross join st group by 1, 2),
lex as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) - 1 as rank from s)"""
_DENSE = """v as (select vec_id as id, embedding::double[] as e from embeddings), cs as (select a.id as query_id, b.id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) as score
from v a join v b on a.id % 100 = 0), den as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) - 1 as rank from cs)"""


def _fusion(k: int = 20, limit: str = "rank < 20") -> str:
    return f"""u as (select query_id, id, rank from lex where rank < {k} union all select query_id, id, rank from den where {limit}),
f as (select query_id, id, round(sum(1 / (2.0 + rank)), 6) as score from u group by 1, 2)"""


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")


def _lexical(spark: SparkSession, folder: str, k: int = 20, among: DataFrame | None = None) -> DataFrame:
    return retrieval.bm25(table(spark, folder, "documents"), "doc_id", "text", _queries(spark, folder), k, among)


def _dense(spark: SparkSession, folder: str, k: int = 20) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.cosine(vectors, "vec_id", "embedding", asked, k)


@query(f"with {_BM25} select query_id, id, score, rank from lex where rank < 20")
def bm25_topk(spark, folder):
    return _lexical(spark, folder)


@query(f"with {_DENSE} select query_id, id, score, rank from den where rank < 20")
def dense_topk(spark, folder):
    return _dense(spark, folder)


@query(f"with {_BM25}, {_DENSE}, {_fusion()}, r as (select *, row_number() over (partition by query_id order by score desc, id) - 1 as rank from f) select query_id, id, score, rank from r where rank < 5")
def hybrid_rrf_topk(spark, folder):
    return retrieval.fused(_lexical(spark, folder), _dense(spark, folder), k=5)


_DOC_TAGS = f"tg as (select distinct doc_id as id from documents, (select distinct unnest([{T.fold_sql('form')}, {T.fold_sql('form')} || 's']) as form from gazetteer_terms where canonical in ('vata')) f where list_contains({T.tokens_sql('text')}, f.form))"


def _doc_tags(spark: SparkSession, folder: str) -> DataFrame:
    tags = tagging.tagged(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "gazetteer_terms"))
    return tags.select("id", F.col("canonical").alias("tag"))


@query(f"with {_BM25}, {_DENSE}, {_fusion()}, {_DOC_TAGS}, r as (select *, row_number() over (partition by query_id order by score desc, id) - 1 as rank from f) select query_id, id, score from r where rank < 5 and id in (select id from tg)")
def rrf_filter_post(spark, folder):
    """The filter after fusion: fewer than k hits may be left."""
    return retrieval.having_any(hybrid_rrf_topk(spark, folder), _doc_tags(spark, folder), ["vata"]).select("query_id", "id", "score")


@query(
    f"with {_BM25.replace('from q join p using (term)', 'from q join p using (term) join tg on tg.id = p.id').replace('with ', '')}".replace("with ts as", f"with {_DOC_TAGS}, ts as", 1)
    + f", {_DENSE.replace('from v a join v b on', 'from v a join v b on b.id in (select id from tg) and')}, {_fusion()}, r as (select *, row_number() over (partition by query_id order by score desc, id) - 1 as rank from f) select query_id, id, score from r where rank < 5"
)
def rrf_filter_pre(spark, folder):
    """The filter before each list is cut, so that k hits are left where there are as many."""
    docs, vectors, tags = table(spark, folder, "documents"), table(spark, folder, "embeddings"), _doc_tags(spark, folder)
    lexical = _lexical(spark, folder, 20, tags.where("tag = 'vata'").select("id").distinct())
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    held = retrieval.having_any(vectors.withColumnRenamed("vec_id", "id"), tags, ["vata"])
    return retrieval.fused(lexical, retrieval.cosine(held, "id", "embedding", asked, 20), k=5).select("query_id", "id", "score")


@query(f"with {_TERMS} select term, count(*) as df, sum(tf)::bigint as cf from p group by 1")
def bm25_term_stats(spark, folder):
    return retrieval.term_stats(retrieval.postings(table(spark, folder, "documents"), "doc_id", "text"))


@query(f"with {_TERMS} select n, round(avg_dl, 6) as avg_dl from st")
def bm25_corpus_stats(spark, folder):
    return retrieval.corpus_stats(table(spark, folder, "documents"), "text").select("n", F.round("avg_dl", 6).alias("avg_dl"))


_ASKED = f"""with {CHUNKS}, ts as (select chunk_id as id, {T.tokens_sql('text')} as t from c), w as (select id, unnest(t) as term from ts), p as (select id, term, count(*) as tf from w group by 1, 2),
l as (select id, len(t) as dl from ts where len(t) > 0), st as (select count(*) as n, avg(dl) as avg_dl from l), df as (select term, count(*) as df from p group by 1),
m as (select artifact_dir, any_value(query) as query from manifests group by 1), q as (select distinct artifact_dir as query_id, unnest({T.tokens_sql('query')}) as term from m),
s as (select q.query_id, p.id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.dl / st.avg_dl))), 6) as score
from q join p using (term) join df using (term) join l on l.id = p.id cross join st group by 1, 2),
lex as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) - 1 as rank from s)"""


@query(f"{_ASKED} select query_id, id, score, rank from lex where rank < 6")
def manifest_search(spark, folder):
    """The query of every manifest against all chunks."""
    asked = table(spark, folder, "manifests").dropDuplicates(["artifact_dir"]).select(F.col("artifact_dir").alias("query_id"), F.col("query").alias("text"))
    texts = records.once(table(spark, folder, "all_chunks").select("chunk_id", "text"), "chunk_id")
    return retrieval.bm25(texts, "chunk_id", "text", asked, 6)


@query(
    f"{_ASKED}, h as (select query_id, id, rank from lex where rank < 6), wn as (select distinct artifact_dir as query_id, r.chunk_id as id from (select artifact_dir, unnest(retrieved_chunks) as r from manifests)), "
    "g as (select h.query_id, count(*) as hits, count(wn.id) as found, min(case when wn.id is not null then rank end) as first from h left join wn on wn.query_id = h.query_id and wn.id = h.id group by 1), "
    "z as (select query_id, count(*) as wanted from wn group by 1) select query_id, coalesce(hits, 0) as hits, wanted, coalesce(found, 0) as found, first from z left join g using (query_id)"
)
def retrieval_eval(spark, folder):
    """How much of each manifest's evidence its query finds among six hits."""
    wanted = review.evidence(table(spark, folder, "manifests")).select(F.col("artifact_dir").alias("query_id"), F.col("chunk_id").alias("id")).distinct()
    return retrieval.evaluated(manifest_search(spark, folder), wanted)


_CASES = """cs as (select artifact_dir as query_id, split_part(retrieved_chunks[1].chunk_id, '-ch', 1) as prefix, split_part(trim(query), ' ', 1) as keyword,
case dosha when 'vata' then 'pitta' when 'pitta' then 'kapha' when 'kapha' then 'vata' end as forbidden from (select * from manifests qualify row_number() over (partition by artifact_dir) = 1))"""


@query(
    f"{_ASKED}, {_CASES}, h as (select query_id, id, text, doshas_mentioned from lex join c on c.chunk_id = id where rank < 6) select cs.query_id, count(h.id) as hits, case when prefix is not null then coalesce(bool_or(starts_with(h.id, prefix)), false) end as prefix_found, "
    "case when keyword is not null then coalesce(bool_or(contains(lower(h.text), lower(keyword))), false) end as keyword_found, count(*) filter (h.doshas_mentioned = [forbidden]) as forbidden_only from cs left join h on h.query_id = cs.query_id group by cs.query_id, prefix, keyword"
)
def retrieval_checks(spark, folder):
    """What must be, and must not be, among the hits of each manifest's query: the volume of its first evidence, the first word of the query, and no record
    that is tagged with nothing but a dosha other than the manifest's."""
    rows = table(spark, folder, "manifests").dropDuplicates(["artifact_dir"])
    other = F.create_map(*[F.lit(x) for x in ("vata", "pitta", "pitta", "kapha", "kapha", "vata")])
    cases = rows.select(
        F.col("artifact_dir").alias("query_id"), F.split_part(F.get("retrieved_chunks", 0)["chunk_id"], F.lit("-ch"), F.lit(1)).alias("prefix"),
        F.split_part(F.trim("query"), F.lit(" "), F.lit(1)).alias("keyword"), F.try_element_at(other, F.col("dosha")).alias("forbidden"),
    )
    return retrieval.checked(manifest_search(spark, folder), cases, chunks(spark, folder, "text", "doshas_mentioned"), "chunk_id", "text", "doshas_mentioned")


# Tagging

_TAGS = f"""with {CHUNKS}, fm as (select distinct category, canonical, unnest([{T.fold_sql('form')}, {T.fold_sql('form')} || 's']) as form from gazetteer_terms),
wd as (select distinct chunk_id as id, unnest(regexp_extract_all({T.fold_sql('text')}, '[\\p{{L}}\\p{{N}}_]+')) as form from c), t as (select distinct id, category, canonical from wd join fm using (form))"""


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.tagged(chunks(spark, folder, "text"), "chunk_id", "text", table(spark, folder, "gazetteer_terms"))


@query(f"{_TAGS} select * from t")
def tag_chunks(spark, folder):
    return _tags(spark, folder)


@query(f"{_TAGS} select category, canonical, count(*) as n from t group by 1, 2")
def tag_histogram(spark, folder):
    return tagging.histogram(_tags(spark, folder))


@query(f"{_TAGS}, h as (select category, canonical, count(*) as n from t group by 1, 2), r as (select *, row_number() over (partition by category order by n desc, canonical) as place from h) select * from r where place <= 12")
def tag_top12(spark, folder):
    return tagging.top_terms(_tags(spark, folder), 12)


@query(f"{_TAGS} select distinct category, canonical from gazetteer_terms except select category, canonical from t")
def tag_unused(spark, folder):
    return tagging.unused(_tags(spark, folder), table(spark, folder, "gazetteer_terms"))


@query(
    f"{_TAGS}, u as (select category, count(distinct id) as texts_tagged, count(distinct canonical) as terms_used from t group by 1), g as (select category, count(distinct canonical) as terms from gazetteer_terms group by 1) "
    "select category, coalesce(texts_tagged, 0) as texts_tagged, coalesce(terms_used, 0) as terms_used, terms, (select count(*) from c) as texts from g left join u using (category)"
)
def tag_coverage(spark, folder):
    return tagging.coverage(chunks(spark, folder), "chunk_id", _tags(spark, folder), table(spark, folder, "gazetteer_terms"))


@query(f"{_TAGS}, n as (select count(*) as texts, count(*) filter (chunk_id not in (select id from t)) as untagged from c) select untagged, texts, round(untagged / texts, 6) as share from n")
def tag_untagged(spark, folder):
    return tagging.untagged(chunks(spark, folder), "chunk_id", _tags(spark, folder))


# Words that name a combination without its parts.
DUAL, ALL_THREE = ["dvandvaja", "samsarga", "samsargaja"], ["sannipata", "sannipataja", "tridosha", "tridoshaja"]


def _said(forms: list[str]) -> str:
    return f"regexp_matches(f, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(forms)})s?($|[^\\p{{L}}\\p{{N}}_])')"


@query(
    f"{_TAGS}, fo as (select chunk_id as id, {T.fold_sql('text')} as f from c where text is not null), "
    "two as (select id, string_agg(canonical, '-' order by case canonical when 'vata' then 1 when 'pitta' then 2 else 3 end) as pair from t where category = 'doshas' and canonical in ('vata', 'pitta', 'kapha') group by 1 having count(*) = 2) "
    + " union ".join(f"select id, '{a}-{b}' as combination from fo where {_said([f'{a}-{b}', a + b])}" for i, a in enumerate(DOSHAS) for b in DOSHAS[i + 1 :])
    + f" union select id, 'tridosha' from fo where {_said(ALL_THREE)} union select id, pair from fo join two using (id) where {_said(DUAL)}"
)
def tag_combinations(spark, folder):
    found = _tags(spark, folder).where("category = 'doshas'")
    return tagging.combinations(chunks(spark, folder, "text"), "chunk_id", "text", found, DOSHAS, DUAL, ALL_THREE, "tridosha")


@query(f"with {CHUNKS} select chunk_id from c where list_has_any(doshas_mentioned, ['vata', 'pitta'])")
def dosha_filter(spark, folder):
    """The hard filter: records whose tags hold any of a list."""
    return chunks(spark, folder, "doshas_mentioned").where(F.arrays_overlap("doshas_mentioned", F.array(F.lit("vata"), F.lit("pitta")))).select("chunk_id")


# Text functions

@query(f"select doc_id, {T.fold_sql('text')} as folded from documents")
def fold_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query(f"select doc_id, len(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\x0b]+')) as words, left({T.squeezed_sql('text')}, 120) as snippet from documents")
def snippets(spark, folder):
    words = F.regexp_count("text", F.lit(r"[^ \t\r\n\f\x0b]+"))
    return table(spark, folder, "documents").select("doc_id", words.cast("bigint").alias("words"), F.left(T.squeezed(F.col("text")), F.lit(120)).alias("snippet"))


def _spoken_sql() -> str:
    t = "text"
    for word, said in T.SPOKEN.items():
        for _ in range(2):  # a word may end where the next begins
            t = rf"regexp_replace({t}, '(?i)(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])', '\1{said}\2', 'g')"
    return t


@query(f"select doc_id, {_spoken_sql()} as spoken from documents")
def spoken_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.spoken(F.col("text")).alias("spoken"))


# Volumes, lines and chapters

_LINES = f"""with {CHUNKS}, ll as (select chunk_id as id, source, chapter, chunk_index, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\f\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') as a from c where text is not null),
lt as (select id, source, chapter, chunk_index, unnest(range(n))::int as line_no, a[unnest(range(n)) + 1] as line from (select *, case when a[-1] = '' then len(a) - 1 else len(a) end as n from ll))"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return segments.line_table(chunks(spark, folder, "text", "source", "chapter", "chunk_index"), "chunk_id", "text", "source", "chapter", "chunk_index")


@query(f"{_LINES} select source, count(*) as n_lines, count(*) filter (trim(line) = '') as n_blank, max(length(line)) as longest from lt group by 1")
def line_counts(spark, folder):
    return _lines(spark, folder).groupBy("source").agg(F.count("*").alias("n_lines"), F.count_if(F.trim("line") == "").alias("n_blank"), F.max(F.char_length("line")).cast("bigint").alias("longest"))


@query(f"{_LINES}, z as (select id, line_no, line, {segments.noise_rule_sql('line')} as rule from lt) select * from z where rule is not null")
def noise_lines(spark, folder):
    """Lines that carry no text in the first family of print, with the rule that says so."""
    return _lines(spark, folder).select("id", "line_no", "line", segments.noise_rule(F.col("line")).alias("rule")).where("rule is not null")


SECTIONS = ["adisthana", "lakshasthana", "upayasthana", "antasthana"]
SECTION_LABELS = {"adi": "adisthana", "laksha": "lakshasthana", "upaya": "upayasthana", "anta": "antasthana"}


@query(f"{_LINES}, z as (select id, line_no, line, {segments.noise_rule_2_sql('line', SECTIONS)} as rule from lt) select * from z where rule is not null")
def noise_lines_2(spark, folder):
    """The same for the second family."""
    return _lines(spark, folder).select("id", "line_no", "line", segments.noise_rule_2(F.col("line"), SECTIONS).alias("rule")).where("rule is not null")


_STRIP = "regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _cleaning_sql() -> str:
    """The steps of cleaning for an engine without look-around: what follows is caught and put back, twice where one match may end where the next begins."""
    t = "coalesce(t, '')"
    for old, new in segments.CLEANING:
        flags = "'g'" if not old.startswith("(?i)^") else "''"
        if old.startswith("(?<="):
            for _ in range(2):
                t = rf"regexp_replace({t}, '([\p{{L}}\p{{N}}_])\s*--\s*([\p{{L}}\p{{N}}_])', '\1—\2', 'g')"
        elif "(?=" in old:
            t = rf"regexp_replace({t}, ':\s*-+(\s*\S)', ':—\1', 'g')"
        else:
            put = new.replace("$1", r"\1").replace("$2", r"\2")
            t = f"regexp_replace({t}, '{old}', '{put}', {flags})"
    return rf"regexp_replace(regexp_replace({t}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '^[. ]+', '')"


@query(f"{_LINES}, k as (select id, string_agg({_STRIP.format('line')}, ' ' order by line_no) filter ({segments.noise_rule_sql('line')} is null) as t from lt group by 1), d as (select id, {_cleaning_sql()} as t from k) select chunk_id, case when text is null then null else coalesce(t, '') end as text from c left join d on d.id = c.chunk_id")
def cleaned_texts(spark, folder):
    return chunks(spark, folder, "text").select("chunk_id", segments.cleaned(F.col("text")).alias("text"))


@query(
    f"{_LINES}, k as (select id, string_agg(line, chr(10) order by line_no) filter ({segments.noise_rule_2_sql('line', SECTIONS)} is null) as t from lt group by 1), "
    r"d as (select id, regexp_replace(regexp_replace(coalesce(t, ''), '\n{3,}', chr(10) || chr(10), 'g'), '(?im)^CHAPTER\s*[IVXLC\d]+\s*[-–.]?\s*', '', 'g') as t from k) "
    r"select chunk_id, case when text is null then null else regexp_replace(coalesce(t, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') end as text from c left join d on d.id = c.chunk_id"
)
def cleaned_texts_2(spark, folder):
    return chunks(spark, folder, "text").select("chunk_id", segments.cleaned_2(F.col("text"), SECTIONS).alias("text"))


_NUMBERS = "num(numeral, number) as (values " + ", ".join(f"('{r}', {n})" for n, r in ((n, roman(n)) for n in range(1, 61))) + ")"
_HEADINGS = f"""{_LINES}, h as (select *, regexp_extract(line, '(?i)\\bchap(?:ter|\\.)?\\s+([ivxlc1|]{{1,7}})\\b', 1) as numeral from lt), {_NUMBERS},
hn as (select h.id, h.source, h.chapter, h.chunk_index, h.line_no, h.numeral, n.number from h left join num n on n.numeral = regexp_replace(upper(h.numeral), '[^IVXLC]', '', 'g') where h.numeral <> '')"""


@query(f"{_HEADINGS} select id, line_no, numeral, number from hn")
def chapter_headings(spark, folder):
    return segments.headings(_lines(spark, folder)).select("id", "line_no", "numeral", "number")


@query(f"{_HEADINGS}, m as (select lt.id, lt.line_no, hn.numeral from lt left join hn on hn.id = lt.id and hn.line_no = lt.line_no), k as (select id, line_no, last_value(numeral ignore nulls) over (partition by id order by line_no rows between 10 preceding and 1 preceding) as seen from m) select * from k where seen is not null")
def heading_lookback(spark, folder):
    """Lines with the nearest heading among the ten lines before them."""
    rows = segments.line_table(chunks(spark, folder, "text"), "chunk_id", "text")
    numeral = F.regexp_extract("line", r"(?i)\bchap(?:ter|\.)?\s+([ivxlc1|]{1,7})\b", 1)
    return segments.lookback(rows, F.nullif(numeral, F.lit(""))).where("seen is not null").select("id", "line_no", "seen")


_PLACE = "chapter::bigint * 1000000000 + chunk_index::bigint * 100000 + line_no"


@query(
    f"{_HEADINGS}, f as (select source as volume, number, min({_PLACE}) as start from hn where number is not null group by 1, 2), e as (select source as volume, max({_PLACE}) as last from lt group by 1) "
    'select volume, number, start, coalesce(lead(start) over (partition by volume order by start, number) - 1, last) as "end" from f join e using (volume)'
)
def chapter_spans(spark, folder):
    place = F.expr("cast(chapter as bigint) * 1000000000 + cast(chunk_index as bigint) * 100000 + line_no")
    rows = _lines(spark, folder).withColumn("place", place)
    ends = rows.groupBy(F.col("source").alias("volume")).agg(F.max("place").alias("last"))
    return segments.chapter_spans(segments.headings(rows), "source", "place", "number", ends)


@query(f"{_HEADINGS}, k as (select source as volume, number::varchar as section, min({_PLACE}) as start from hn where number is not null group by 1, 2) select * from k")
def section_entries(spark, folder):
    """Where the numbers of headings are first entered in each volume, none twice."""
    place = F.expr("cast(chapter as bigint) * 1000000000 + cast(chunk_index as bigint) * 100000 + line_no")
    return segments.one_way_sections(segments.headings(_lines(spark, folder).withColumn("place", place)), "source", "place", "number")


_RAW = f"{_LINES}, w as (select distinct unnest(regexp_extract_all(line, '(?i)\\bchap\\S*\\s+(\\S+)', 1)) as token from lt)"
_FOLDED = f"upper(translate(split_part(token, '.', 1), '{T.ACCENTED}', '{T.PLAIN}'))"


def _heading_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct tokens that stand behind a word like `Chap.` on any line."""
    found = F.regexp_extract_all("line", F.lit(r"(?i)\bchap\S*\s+(\S+)"), F.lit(1))
    return _lines(spark, folder).select(F.explode(found).alias("token")).distinct()


@query(f"{_RAW}, {_NUMBERS} select token, number from w left join num on num.numeral = regexp_replace({_FOLDED}, '[^IVXLC]', '', 'g')")
def roman_parse(spark, folder):
    """Roman numerals of running heads, misread ones included."""
    return _heading_tokens(spark, folder).select("token", parse_roman(F.col("token")).alias("number"))


_TO_200 = "big(numeral, number) as (values " + ", ".join(f"('{roman(n)}', {n})" for n in range(1, 201)) + ")"


@query(
    f"{_RAW}, {_TO_200}, k as (select token, regexp_replace(upper(token), '[^IVXLC0-9]', '', 'g') as kept from w), "
    "m as (select token, kept, regexp_replace(case when regexp_matches(kept, '^1[VXLCI]') then 'I' || substr(kept, 2) else kept end, '[0-9]', '', 'g') as mended from k) "
    "select token, case when regexp_matches(kept, '^[0-9]{1,6}$') then case when try_cast(kept as int) between 1 and 200 then try_cast(kept as int) end else big.number end as number from m left join big on big.numeral = mended"
)
def numeral_parse(spark, folder):
    """Roman and arabic numerals of running heads."""
    return _heading_tokens(spark, folder).select("token", parse_numeral(F.col("token")).alias("number"))


_ORDINALS = "ord(word, number) as (values " + ", ".join(f"('{w}', {n})" for w, n in ordinal_words().items()) + ")"


@query(
    f"with {CHUNKS}, w as (select distinct unnest(regexp_extract_all(lower(text), '(?:^|[^\\p{{L}}\\p{{N}}_])([a-z]+(?:[ -][a-z]+)?)[ \\n]+(?:day|dose|watch|rains)(?:$|[^\\p{{L}}\\p{{N}}_])', 1)) as phrase from c), {_ORDINALS}, "
    "k as (select phrase, trim(regexp_replace(regexp_replace(regexp_replace(phrase, '[^a-z]+', ' ', 'g'), '\\bthe\\b', ' ', 'g'), '\\s+', ' ', 'g')) as said from w) select phrase, number from k left join ord on ord.word = said"
)
def ordinal_parse(spark, folder):
    """Ordinals in the phrases before days, doses, watches and rains."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"(?:^|[^\p{L}\p{N}_])([a-z]+(?:[ -][a-z]+)?)[ \n]+(?:day|dose|watch|rains)(?:$|[^\p{L}\p{N}_])"), F.lit(1))
    return chunks(spark, folder, "text").select(F.explode(found).alias("phrase")).distinct().select("phrase", parse_ordinal(F.col("phrase")).alias("number"))


# Printed volumes: every record under the name of its section, every chapter under its header

def _printed(spark: SparkSession, folder: str, bare: bool = False) -> DataFrame:
    """The lines of each work's volume, its sections interleaved by chapter, so that sections are left and named again. Chapters without a numeral (0, beyond
    60) have no header; with bare their first record is printed all the same, else, as in SQL, it has no lines."""
    rows = chunks(spark, folder, "source", "chapter", "chunk_index", "text").where("text is not null")
    rows = rows.withColumn("section", F.regexp_extract("source", r"-([a-z]+sthana)$", 1)).withColumn("volume", F.regexp_replace("source", r"-[a-z]+sthana$", ""))
    first = table(spark, folder, "all_chunks").where("text is not null").groupBy("source", "chapter")  # repeated rows change no least one
    first = first.agg(F.min(F.struct("chunk_index", "chunk_id"))["chunk_id"].alias("first_id")).select("first_id")
    rows = rows.join(first, rows["chunk_id"] == first["first_id"], "left")
    numeral = F.when(F.col("chapter") != 0, F.try_element_at(F.array(*[F.lit(roman(n)) for n in range(1, 61)]), F.col("chapter")))
    header = F.when(F.col("first_id").isNotNull(), F.concat(F.lit("CHAPTER "), numeral, F.lit(".\n"))).otherwise("")
    header = F.coalesce(header, F.lit("")) if bare else header
    name = F.when(F.col("section") != "", F.concat(F.upper("section"), F.lit(".\n"))).otherwise("")
    rows = rows.select("volume", "chapter", "section", "chunk_index", "chunk_id", F.concat(name, header, F.col("text")).alias("text"))
    return chapters.volume_lines(rows, "volume", ["chapter", "section", "chunk_index", "chunk_id"], "text")


_ROMANS = "[" + ", ".join(f"'{roman(n)}'" for n in range(1, 61)) + "]"
_PRINTED = rf"""with {CHUNKS}, p0 as (select *, regexp_extract(source, '-([a-z]+sthana)$', 1) as section, regexp_replace(source, '-[a-z]+sthana$', '') as volume, row_number() over (partition by source, chapter order by chunk_index, chunk_id) as place from c where text is not null),
p1 as (select volume, chapter, section, chunk_index, chunk_id, case when section <> '' then upper(section) || '.' || chr(10) else '' end || case when place = 1 then 'CHAPTER ' || {_ROMANS}[chapter] || '.' || chr(10) else '' end || text as text from p0),
p2 as (select *, regexp_split_to_array(text, '\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') as a from p1), p3 as (select *, case when a[-1] = '' then len(a) - 1 else len(a) end as n from p2),
p4 as (select volume, chapter, section, chunk_index, chunk_id, unnest(range(n)) as k, a[unnest(range(n)) + 1] as line from p3),
pl as (select volume, row_number() over w - 1 as line_no, line, lead(line) over w as next_line from p4 window w as (partition by volume order by chapter, section, chunk_index, chunk_id, k)), pe as (select volume, max(line_no) as last from pl group by 1)"""


@query(f"{_PRINTED} select volume, count(*) as n, max(line_no) as last, sum(line_no * (1 + length(line)) % 1000003)::bigint as mixed from pl group by 1")
def printed_volumes(spark, folder):
    """Lines of the printed volumes, their last number and a sum that tells a line out of place."""
    mixed = F.sum(F.col("line_no") * (1 + F.char_length("line")) % 1000003)
    return _printed(spark, folder).groupBy("volume").agg(F.count("*").alias("n"), F.max("line_no").alias("last"), mixed.alias("mixed"))


def _numeral(column: str) -> str:
    return f"regexp_replace(upper(translate(split_part({column}, '.', 1), '{T.ACCENTED}', '{T.PLAIN}')), '[^IVXLC]', '', 'g')"


_MARKS = rf"""{_PRINTED}, {_NUMBERS}, {_ORDINALS}, k0 as (select volume, line_no, regexp_extract(line, '{chapters.OPENING}', 1) as o, regexp_extract(concat_ws(' ', line, next_line), '{chapters.COLOPHON}', 1) as q, regexp_extract(line, '{chapters.RUNNING}', 1) as r from pl),
k1 as (select volume, line_no, 'open' as kind, number as n from k0 join num on numeral = {_numeral('o')} union all select volume, line_no, 'run', number from k0 join num on numeral = {_numeral('r')}
union all select volume, line_no, 'close', number from k0 join ord on word = trim(regexp_replace(regexp_replace(regexp_replace(lower(q), '[^a-z]+', ' ', 'g'), '\bthe\b', ' ', 'g'), '\s+', ' ', 'g'))),
k2 as (select volume, max(line_no) as body from k1 where kind = 'open' and n = 1 group by 1), f1 as (select k1.volume, kind, n, min(line_no) as at from k1 left join k2 using (volume) where line_no >= coalesce(body, 0) group by 1, 2, 3)"""


_BOUNDS = (
    f"{_MARKS}, v as (select volume, unnest(range(1, max(n) + 1))::int as n, max(n) as most from f1 group by volume), j as (select v.volume, v.n, v.most, last, o0.at as o0, o1.at as o1, o2.at as o2, r0.at as r0, r1.at as r1, c0.at as c0, c1.at as c1, cb.at as cb from v join pe using (volume) "
    + " ".join(f"left join f1 {name} on {name}.volume = v.volume and {name}.kind = '{kind}' and {name}.n = v.n + {ahead}" for name, kind, ahead in (("o0", "open", 0), ("o1", "open", 1), ("o2", "open", 2), ("r0", "run", 0), ("r1", "run", 1), ("c0", "close", 0), ("c1", "close", 1), ("cb", "close", -1)))
    + "), e as (select volume, n, case when o0 is not null then o0 when cb is not null then cb + 1 else r0 end as s, case when c0 is not null then c0 when o1 is not null then o1 - 1 when r1 is not null then r1 - 1 when c1 is not null then c1 when o2 is not null then o2 - 1 when n = most then last end as t, "
    "(o0 is not null or cb is not null) and (c0 is not null or o1 is not null) as exact from j)"
)
_NOTED = "select volume, n, case when s < t then s end as start, case when s < t then t end as \"end\", case when not coalesce(s < t, false) then 'unresolved' when not exact then 'approximate' end as note from e"


@query(f"{_BOUNDS} {_NOTED}")
def chapter_bounds(spark, folder):
    """Chapters of the printed volumes by openings, colophons and running heads."""
    rows = _printed(spark, folder)
    return chapters.chapter_bounds(chapters.marks(rows), chapters.last_lines(rows))


@query(f"{_BOUNDS}, w as ({_NOTED}) select volume, n, note from w where note is not null order by volume, n limit 20")
def first_warnings(spark, folder):
    """The first 20 chapters, by volume, whose bounds are not exact."""
    return chapter_bounds(spark, folder).where("note is not null").select("volume", "n", "note").orderBy("volume", "n").limit(20)


@query()
def rechunked_volumes(spark, folder):
    """The printed volumes cut into chunks anew, from their lines to names, roles and sizes."""
    rows = _printed(spark, folder, bare=True)
    bounds = chapters.chapter_bounds(chapters.marks(rows), chapters.last_lines(rows))
    return segments.volume_chunks(rows, bounds, 100, MARKERS)


@query(
    f"{_PRINTED}, {_NUMBERS}, o as (select volume, line_no as at from pl join num on numeral = {_numeral(f"regexp_extract(trim(line), '{chapters.OPENING}', 1)")} and number = 1), "
    "h as (select volume, line_no, case " + " ".join(f"when regexp_matches(line, '(?i){k}') then '{k}'" for k in SECTIONS) + " end as section, lower(line) as low, lower(concat_ws(' ', line, next_line)) as wide from pl), "
    "b as (select o.volume, o.at, h.line_no, h.section, h.low, h.wide from o join h on h.volume = o.volume and h.line_no between o.at - 10 and o.at - 1), "
    "x as (select distinct b.volume, b.at from b where b.line_no >= b.at - 8 and (contains(low, 'end of the content') or contains(low, 'contents of') or (b.line_no < b.at - 1 and (contains(wide, 'end of the content') or contains(wide, 'contents of'))))), "
    "s as (select o.volume, o.at, arg_max(b.section, b.line_no) filter (b.section is not null) as section from o left join b on b.volume = o.volume and b.at = o.at where not exists (select 1 from x where x.volume = o.volume and x.at = o.at) group by 1, 2), "
    "l as (select volume, section, max(s.at) as start from s where section is not null group by 1, 2) "
    'select volume, section, start, coalesce(lead(start) over (partition by volume order by start) - 1, last) as "end", null::varchar as note from l join pe using (volume) union all select volume, section, s.at, null, \'orphan\' from s where section is null'
)
def section_bounds(spark, folder):
    """Sections of the printed volumes by the names before an opening of chapter 1."""
    return chapters.section_bounds(_printed(spark, folder), {k: k for k in SECTIONS})


@query(
    f"{_PRINTED}, {_TO_200}, h as (select volume, line_no, case when regexp_matches(lower(line), '{'|'.join(SECTIONS)}') then case " + " ".join(f"when contains(lower(line), '{k}') then '{v}'" for k, v in SECTION_LABELS.items()) + f" end end as hint, regexp_extract(trim(line), '{chapters.HEADER}', 1) as numeral from pl), "
    "bd as (select volume, min(line_no) as body from h where numeral <> '' group by 1), s as (select h.* from h join bd using (volume) where line_no >= body), "
    "en as (select volume, hint, min(line_no) as at from s where hint is not null and hint <> 'adisthana' group by 1, 2), "
    "hd as (select volume, line_no, number as n from s join big on big.numeral = upper(s.numeral) where hint is null), "
    "ps as (select hd.volume, hd.line_no, hd.n, coalesce(arg_max(en.hint, en.at), 'adisthana') as section from hd left join en on en.volume = hd.volume and en.at <= hd.line_no group by 1, 2, 3), "
    "fi as (select volume, section, n, min(line_no) as start from ps group by 1, 2, 3), z as (select volume, section, n, start, coalesce(lead(start) over (partition by volume order by start) - 1, last) as \"end\" from fi join pe using (volume)) "
    "select *, case when start >= \"end\" then 'empty' end as note from z"
)
def section_chapters(spark, folder):
    """Chapters of the printed volumes where numbers start anew in each section and no section is entered twice."""
    return chapters.section_chapters(_printed(spark, folder), "adisthana", SECTIONS, SECTION_LABELS)


@query(f"{_BOUNDS}, bo as (select volume, n, s, t from e where s < t) select bo.volume, bo.n, count(*) as n_lines, sum(len(regexp_extract_all(line, '[^ \\t\\r\\n\\f\\x0b]+')))::bigint as n_words from bo join pl on pl.volume = bo.volume and pl.line_no between s and t group by 1, 2")
def chapter_words(spark, folder):
    """Words of each chapter of the printed volumes, between its bounds."""
    rows = _printed(spark, folder)
    found = chapters.chapter_texts(rows, chapters.chapter_bounds(chapters.marks(rows), chapters.last_lines(rows)))
    return found.groupBy("volume", "n").agg(F.count("*").alias("n_lines"), F.sum(T.word_count(F.col("line"))).cast("bigint").alias("n_words"))


# Chunks

_WORDS = "len(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\x0b]+'))"


@query(f"with {CHUNKS} select chunk_id, case when regexp_matches(left(text, 200), '(?m)\\d+[-–]\\d+[ \\t]*$') then 'verse_summary' when {_WORDS} < 120 then 'prose' else 'topic' end as role, printf('%s-ch%02d-%03d', source, chapter, chunk_index) as name from c where text is not null")
def chunk_roles(spark, folder):
    words = F.regexp_count("text", F.lit(r"[^ \t\r\n\f\x0b]+"))
    rows = chunks(spark, folder, "text", "source", "chapter", "chunk_index").where("text is not null")
    return rows.select("chunk_id", segments.role(F.col("text"), words).alias("role"), segments.chunk_name(F.col("source"), F.col("chapter"), F.col("chunk_index")).alias("name"))


@query(f"with {CHUNKS} select source, chapter, count(*) as n, sum(n_tokens)::bigint as tokens, min(n_tokens) as least, max(n_tokens) as most, (sum(n_tokens) // count(n_tokens))::bigint as mean from c group by 1, 2")
def chunk_stats(spark, folder):
    rows = chunks(spark, folder, "source", "chapter", "n_tokens").groupBy("source", "chapter")
    mean = F.expr("sum(n_tokens) div count(n_tokens)")
    return rows.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.min("n_tokens").alias("least"), F.max("n_tokens").alias("most"), mean.alias("mean"))


@query(f"with {CHUNKS} select coalesce(section_role, '(none)') as role, count(*) as n from c group by 1")
def role_counts(spark, folder):
    return chunks(spark, folder, "section_role").groupBy(F.coalesce("section_role", F.lit("(none)")).alias("role")).agg(F.count("*").alias("n"))


@query(
    f"with recursive {CHUNKS}, nb as (select source, chapter, text, len(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\x0b]+'))::bigint as n, row_number() over (partition by source, chapter order by chunk_index, chunk_id) as rn from c where text is not null), "
    "b as (select source, chapter, rn, n, text, n as total, n >= 100 as closed, 0 as place from nb where rn = 1 union all select nb.source, nb.chapter, nb.rn, nb.n, nb.text, case when closed then total else total + nb.n end, closed or total + nb.n >= 100, case when closed and nb.n >= 100 then place + 1 else place end "
    "from b join nb on nb.source = b.source and nb.chapter = b.chapter and nb.rn = b.rn + 1), g as (select source, chapter, place, sum(n)::bigint as n_tokens, string_agg(text, ' ' order by rn) as text from b group by 1, 2, 3) "
    "select *, " + "case when regexp_matches(text, '(?i)^(?:Authoritative verses?|Metrical texts?|Additional texts?)') then 'verse_summary' when regexp_matches(text, '(?i)^(?:Now we shall (?:discuss|discourse|describe))') then 'topic' else 'prose' end as role from g"
)
def merged_fragments(spark, folder):
    words = F.regexp_count("text", F.lit(r"\S+"))
    rows = chunks(spark, folder, "text", "source", "chapter", "chunk_index").where("text is not null").withColumn("n_words", words)
    merged = segments.merged_fragments(rows.withColumn("o", F.struct("chunk_index", "chunk_id")), ["source", "chapter"], "o", "n_words", "text", 100)
    return merged.withColumn("role", segments.role_by_opening(F.col("text")))


#: Most tokens of a batch: a share of the service's limit that leaves room for what counting in words misses; most texts of a batch.
BATCH_TOKENS, BATCH_TEXTS = int(120_000 * 0.15), 20
_BATCHES = f"""with recursive {CHUNKS}, nb as (select source, chapter, chunk_id, greatest(coalesce(n_tokens, 0), 0)::bigint as n_tokens, row_number() over (partition by source, chapter order by chunk_id) as rn from c),
b as (select source, chapter, chunk_id, n_tokens, rn, n_tokens as total, 1 as texts, 0 as batch from nb where rn = 1 union all
select nb.source, nb.chapter, nb.chunk_id, nb.n_tokens, nb.rn, case when full_ then nb.n_tokens else total + nb.n_tokens end, case when full_ then 1 else texts + 1 end, batch + case when full_ then 1 else 0 end
from (select b.*, z.n_tokens as more, z.rn as at, b.total + z.n_tokens > {BATCH_TOKENS} or b.texts >= {BATCH_TEXTS} as full_ from b join nb z on z.source = b.source and z.chapter = b.chapter and z.rn = b.rn + 1) x
join nb on nb.source = x.source and nb.chapter = x.chapter and nb.rn = x.at)"""


@query(f"{_BATCHES} select source, chapter, chunk_id, n_tokens, batch from b")
def token_batches(spark, folder):
    rows = chunks(spark, folder, "source", "chapter", "n_tokens").withColumn("n_tokens", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)))
    return segments.batches(rows, ["source", "chapter"], "chunk_id", "n_tokens", BATCH_TOKENS, BATCH_TEXTS)


@query(f"{_BATCHES} select (select sum(n_tokens)::bigint from b) as tokens, (select count(*) from (select distinct source, chapter, batch from b)) as batches, (select count(*) from c where text is null or len({T.tokens_sql('text')}) = 0) as without_terms")
def index_totals(spark, folder):
    """Tokens and batches that an index takes, and records that have no term."""
    cut = token_batches(spark, folder)
    sizes = cut.groupBy("source", "chapter", "batch").agg(F.sum("n_tokens").alias("n"))
    empty = chunks(spark, folder, "text").agg(F.count_if(F.coalesce(F.size(T.tokens(F.col("text"))), F.lit(0)) <= 0).alias("without_terms"))
    return sizes.agg(F.sum("n").alias("tokens"), F.count("*").alias("batches")).join(F.broadcast(empty))


MARKERS = f"{segments.VERSE}|{segments.OPENER}|three signs are|as a rule"
_ROLE = "case when regexp_matches({0}, '(?i)^(?:" + segments.VERSE + ")') then 'verse_summary' when regexp_matches({0}, '(?i)^(?:" + segments.OPENER + ")') then 'topic' else 'prose' end"


@query(
    f"with {CHUNKS}, p as (select chunk_id, list_filter(list_transform(string_split(regexp_replace(text, '(?i)({MARKERS})', chr(1) || '\\1', 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') as ps from c where text is not null), "
    f"q as (select chunk_id, unnest(range(len(ps)))::int as place, unnest(ps) as part from p) select chunk_id, place, part, {_ROLE.format('part')} as role from q"
)
def marker_parts(spark, folder):
    """Texts cut before what opens a verse or a topic, and at some phrases of these volumes, with the role that the opening gives."""
    markers = MARKERS
    rows = chunks(spark, folder, "text").select("chunk_id", F.posexplode(segments.marker_parts(F.col("text"), markers)).alias("place", "part"))
    return rows.withColumn("role", segments.role_by_opening(F.col("part")))


@query("select chunk_id as id, source, text from (select chunk_id, any_value(source) as source, any_value(text) as text from all_chunks group by 1) union all select doc_id::varchar, source, text from documents")
def corpus_union(spark, folder):
    """Two corpora of different schemas as one."""
    a = chunks(spark, folder, "source", "text").withColumnRenamed("chunk_id", "id").withColumn("unit", F.lit("words"))
    b = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", "text")
    return a.unionByName(b, allowMissingColumns=True).drop("unit")


# Index upkeep

@query(
    f"with h as (select chunk_id, sha1(unhex('{SPACE.hex}') || chunk_id::blob) as h from (select distinct chunk_id from all_chunks)) select chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || "
    "printf('%02x', (('0x' || substr(h, 17, 2))::int & 63) | 128) || substr(h, 19, 2) || '-' || substr(h, 21, 12) as point_id from h"
)
def point_ids(spark, folder):
    return chunks(spark, folder).select("chunk_id", records.point_id(F.col("chunk_id"), SPACE).alias("point_id"))


@query("select chunk_id, epoch_us(loaded_at) as loaded_us, n_tokens from all_chunks qualify row_number() over (partition by chunk_id order by loaded_at desc, n_tokens desc nulls last) = 1")
def upsert_last_wins(spark, folder):
    rows = table(spark, folder, "all_chunks").select("chunk_id", "loaded_at", "n_tokens")
    return records.upserted(rows, "chunk_id", "loaded_at").select("chunk_id", F.unix_micros("loaded_at").alias("loaded_us"), "n_tokens")


@query("select chunk_id, (row_number() over (order by chunk_id) - 1) // 200 as batch from (select distinct chunk_id from all_chunks)")
def upsert_batches(spark, folder):
    return records.upsert_batches(chunks(spark, folder), "chunk_id", 200)


@query("select n, n as expected, true as same from (select count(distinct chunk_id) as n from all_chunks)")
def verify_count(spark, folder):
    """A version of the index is written and counted as read back, against the distinct keys of the source."""
    path = records.publish(chunks(spark, folder, "source"), spark, new_path(spark, "index"), "chunk_index", "v1")
    return records.verified(spark.read.parquet(path), table(spark, folder, "all_chunks").select("chunk_id").distinct().count())


@query("select source as name, p::int as part, (p - 1) * 15 + 1 as first, least(p * 15, n) as last, printf('%s_part%03d_p%04d-%04d', source, p, (p - 1) * 15 + 1, least(p * 15, n)) as part_name from (select source, n, unnest(range(1, (n + 14) // 15 + 1)) as p from (select source, count(distinct chunk_id) as n from all_chunks group by 1))")
def page_ranges(spark, folder):
    """Fixed ranges over each source, with a record for a page."""
    sizes = chunks(spark, folder, "source").groupBy("source").agg(F.count("*").alias("n"))
    return files.page_ranges(sizes, "source", "n").select("name", "part", F.col("first").cast("bigint"), F.col("last").cast("bigint"), "part_name")


@query("select chunk_id from (select distinct chunk_id from all_chunks) where chunk_id not in (select c.chunk_id from (select unnest(retrieved_chunks) as c from manifests))")
def pending_records(spark, folder):
    """Records that no manifest has used yet."""
    done = review.evidence(table(spark, folder, "manifests")).select("chunk_id").distinct()
    return files.pending(chunks(spark, folder), done, "chunk_id")


@query(f"with {CHUNKS} select source || '/' || chapter as volume, count(*) as n, string_agg(chr(10) || chr(10) || '========== ' || chunk_id || ' ==========' || chr(10) || chr(10) || coalesce(text, ''), '' order by chunk_index, chunk_id) as text from c group by 1")
def stitched_chapters(spark, folder):
    rows = chunks(spark, folder, "source", "chapter", "chunk_index", "text").withColumn("volume", F.concat_ws("/", "source", F.col("chapter").cast("string")))
    return files.stitched(rows.withColumn("o", F.struct("chunk_index", "chunk_id")), "volume", "o", "chunk_id", "text")


def _listed(category: str) -> str:
    return f"(select id, string_agg(canonical, ',' order by canonical) as v from t where category = '{category}' group by 1)"


@query(
    f"{_TAGS}, fo as (select chunk_id as id, {T.fold_sql('text')} as f from c where text is not null), two as (select id, string_agg(canonical, '-' order by case canonical when 'vata' then 1 when 'pitta' then 2 else 3 end) as pair from t where category = 'doshas' and canonical in ('vata', 'pitta', 'kapha') group by 1 having count(*) = 2), co as ("
    + " union ".join(f"select id, '{a}-{b}' as combination from fo where {_said([f'{a}-{b}', a + b])}" for i, a in enumerate(DOSHAS) for b in DOSHAS[i + 1 :])
    + f" union select id, 'tridosha' from fo where {_said(ALL_THREE)} union select id, pair from fo join two using (id) where {_said(DUAL)}), cc as (select id, string_agg(combination, ',' order by combination) as v from co group by 1), "
    "dd as (select id, string_agg(canonical, ',' order by case canonical when 'vata' then 1 when 'pitta' then 2 else 3 end) as v from t where category = 'doshas' and canonical in ('vata', 'pitta', 'kapha') group by 1) "
    f"select c.chunk_id, coalesce(dd.v, '') as doshas_mentioned, coalesce(cc.v, '') as dosha_combinations, coalesce(h.v, '') as herbs, coalesce(i.v, '') as diseases, source from c left join dd on dd.id = c.chunk_id left join cc on cc.id = c.chunk_id left join {_listed('herbs')} h on h.id = c.chunk_id left join {_listed('diseases')} i on i.id = c.chunk_id"
)
def retagged(spark, folder):
    """The four tag columns of each record replaced by what its text holds; the others stay."""
    rows = chunks(spark, folder, "source", "text", "doshas_mentioned", "herbs", "diseases").withColumn("dosha_combinations", F.array().cast("array<string>"))
    fresh = tagging.tag_columns(rows, "chunk_id", _tags(spark, folder), tag_combinations(spark, folder), DOSHAS).withColumnRenamed("id", "chunk_id")
    tags = ["doshas_mentioned", "dosha_combinations", "herbs", "diseases"]
    return sinks.replace_columns(rows, fresh, "chunk_id").select("chunk_id", *[F.array_join(c, ",").alias(c) for c in tags], "source")


# Dates

_SEASON = "sm as (select key as season_key, unnest(months) as m from seasons)"


@query(f"with {_SEASON} select season_key, count(*) as n, round(sum(o_totalprice), 2) as total from orders join sm on month(o_orderdate) = m group by 1")
def orders_by_season(spark, folder):
    rows = dates.with_season(table(spark, folder, "orders"), "o_orderdate", table(spark, folder, "seasons"))
    return rows.groupBy("season_key").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"with {_SEASON} select r::int as month, count(m) as n from range(1, 13) t(r) left join sm on m = r group by 1")
def season_cover(spark, folder):
    return dates.season_cover(table(spark, folder, "seasons"))


@query("select o_orderkey, case when isodow(o_orderdate) > 5 then (o_orderdate::date + (8 - isodow(o_orderdate))::int) else o_orderdate::date end::date::varchar as posting_day, (select count(*) from generate_series(0, 6) g(i) where isodow(o_orderdate::date + i::int) <= 5 and i < o_orderkey % 7) as weekdays from orders")
def posting_days(spark, folder):
    day = F.to_date("o_orderdate")
    until = F.date_add(day, (F.col("o_orderkey") % 7).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", dates.next_weekday(day).cast("string").alias("posting_day"), dates.weekdays_between(day, until).alias("weekdays"))


@query("select date_trunc('month', d)::date::varchar as month, ((day(d) - 1 + isodow(date_trunc('month', d)) - 1) // 7)::int as week, (isodow(d) - 1)::int as slot, d::varchar as day from (select distinct unnest(generate_series(date_trunc('month', loaded_at AT TIME ZONE 'UTC')::date, last_day((loaded_at AT TIME ZONE 'UTC')::date), interval 1 day))::date as d from all_chunks)")
def month_grid(spark, folder):
    """The days of every month in which records were loaded, as places of a Monday-first calendar."""
    months = table(spark, folder, "all_chunks").select(F.trunc(F.to_date("loaded_at"), "month").alias("m")).distinct()
    grid = dates.month_grid(months, "m").where("day is not null")
    return grid.select(F.col("month").cast("string"), "week", "slot", F.col("day").cast("string"))


@query("select distinct date_trunc('month', d)::date::varchar as month, (date_trunc('month', d) - interval 1 month)::date::varchar as before, (date_trunc('month', d) + interval 1 month)::date::varchar as after from (select (loaded_at AT TIME ZONE 'UTC')::date as d from all_chunks)")
def month_neighbours(spark, folder):
    """Every month in which records were loaded with the months around it, over ends of years."""
    month = F.trunc(F.to_date("loaded_at"), "month")
    rows = table(spark, folder, "all_chunks").select(month.alias("m")).distinct()
    return rows.select(F.col("m").cast("string").alias("month"), F.add_months("m", -1).cast("string").alias("before"), F.add_months("m", 1).cast("string").alias("after"))


# Drafts and audits

_MANIFESTS = "m as (select * from manifests qualify row_number() over (partition by artifact_dir) = 1)"
_DRAFTS = f"""{_MANIFESTS}, d as (select artifact_dir, (try_strptime(regexp_replace(generated_at, ':(\\d\\d)$', '\\1'), '%Y-%m-%dT%H:%M:%S%z') AT TIME ZONE 'UTC')::date::varchar as day, coalesce(pillar, 'seasonal') as pillar,
coalesce(case when pillar is null or pillar = 'seasonal' then season.label else label end, artifact_dir) as label from m where contains(status, 'DRAFT') and artifacts.script is not null and artifacts.reel is not null)"""


@query(f"with {_DRAFTS} select * from d where day is not null")
def draft_discovery(spark, folder):
    return review.drafts(table(spark, folder, "manifests")).withColumn("day", F.col("day").cast("string"))


@query(f"with {_DRAFTS} select day, count(*) as n, min(artifact_dir) as first from d where day is not null group by 1")
def drafts_by_day(spark, folder):
    return review.drafts_by_day(review.drafts(table(spark, folder, "manifests"))).withColumn("day", F.col("day").cast("string"))


_EVIDENCE = f"{_MANIFESTS}, e as (select artifact_dir, unnest(range(len(retrieved_chunks)))::int as place, unnest(retrieved_chunks) as r from m), ev as (select artifact_dir, place, r.chunk_id as chunk_id, r.score as score from e)"


@query(f"with {_EVIDENCE} select * from ev")
def evidence(spark, folder):
    return review.evidence(table(spark, folder, "manifests"))


@query(f"with {_EVIDENCE}, {CHUNKS} select artifact_dir, place, ev.chunk_id, case when c.chunk_id is null then '(not found)' else text end as text from ev left join c on c.chunk_id = ev.chunk_id")
def cited_texts(spark, folder):
    return review.cited_texts(review.evidence(table(spark, folder, "manifests")), chunks(spark, folder, "text"))


@query(f"with {_EVIDENCE}, {CHUNKS} select artifact_dir, count(*) as n, string_agg('[' || ev.chunk_id || ']' || chr(10) || coalesce(case when c.chunk_id is null then '(not found)' else text end, ''), chr(10) || chr(10) order by place) as context from ev left join c on c.chunk_id = ev.chunk_id group by 1")
def context_blocks(spark, folder):
    return review.context_blocks(cited_texts(spark, folder))


@query(f"with {_EVIDENCE} select distinct artifact_dir, chunk_id from ev where chunk_id not in (select chunk_id from all_chunks)")
def unknown_citations(spark, folder):
    return review.unknown_citations(review.evidence(table(spark, folder, "manifests")), chunks(spark, folder))


@query(
    f"with {_MANIFESTS}, {CHUNKS}, q as (select artifact_dir, coalesce(query, '') as query, n_scenes, [x.chunk_id for x in coalesce(retrieved_chunks, [])] as ids from m), "
    "sc as (select artifact_dir, 0 as scene_index, query as said, []::varchar[] as ids from q union all select artifact_dir, i::int, topic, ids[(i - 1) * 2 + 1 : i * 2] from (select artifact_dir, query as topic, ids, unnest(range(1, coalesce(n_scenes, 0) + 1)) as i from q)), "
    "x as (select artifact_dir, scene_index, unnest(ids) as id, unnest(range(len(ids))) as place from sc), g as (select artifact_dir, scene_index, string_agg('  [' || x.id || ']: ' || case when c.chunk_id is null then '(not found)' else coalesce(text, '') end, chr(10) order by place) as texts from x left join c on c.chunk_id = x.id group by 1, 2) "
    "select sc.artifact_dir, sc.scene_index, scene_index = 0 as exempt, 'SCENE ' || sc.scene_index || chr(10) || said || chr(10) || case when scene_index = 0 then '  (none by design)' else coalesce(texts, '  (no ids cited)') end as block from sc left join g using (artifact_dir, scene_index)"
)
def audit_blocks(spark, folder):
    """What an auditor reads of each draft: the hook, which need not be grounded, and every scene with the texts that it cites."""
    rows = table(spark, folder, "manifests").dropDuplicates(["artifact_dir"])
    rows = rows.select("artifact_dir", F.coalesce("query", F.lit("")).alias("said"), F.coalesce("n_scenes", F.lit(0)).alias("n"), F.coalesce(F.col("retrieved_chunks.chunk_id"), F.array().cast("array<string>")).alias("ids"))
    scenes = rows.select("artifact_dir", "said", "ids", F.explode(F.sequence(F.lit(0), F.greatest("n", F.lit(0)))).alias("scene_index"))
    cited = F.when(F.col("scene_index") > 0, F.slice("ids", F.greatest((F.col("scene_index") - 1) * 2 + 1, F.lit(1)), F.lit(2))).otherwise(F.array().cast("array<string>"))
    return review.audit_blocks(scenes.select("artifact_dir", "scene_index", "said", cited.alias("ids")), chunks(spark, folder, "text"))


@query(f"with {_DRAFTS} select artifact_dir, concat_ws('-', pillar, nullif(array_to_string(m.season.aggravated_dosha, '-'), ''), m.dosha, m.topic, m.service) || '-' || strftime(try_strptime(regexp_replace(m.generated_at, ':(\\d\\d)$', '\\1'), '%Y-%m-%dT%H:%M:%S%z') AT TIME ZONE 'UTC', '%Y%m%d-%H%M%S') as slug from d join (select * exclude (pillar, label) from m) m using (artifact_dir) where d.day is not null")
def draft_slugs(spark, folder):
    """Names of folders from what a draft is about and the UTC time of its generation."""
    return review.slugs(table(spark, folder, "manifests"))


_REPORTS = "a as (select * from audit_reports qualify row_number() over (partition by artifact_dir) = 1)"


@query(f"with {_REPORTS}, s as (select artifact_dir, unnest(scenes) as s from a) select artifact_dir, s.scene_index as scene_index, s.grounded as grounded, s.compliance_ok as compliance_ok, coalesce(len(s.issues), 0)::int as n_issues from s")
def scene_verdicts(spark, folder):
    return review.scene_verdicts(table(spark, folder, "audit_reports"))


@query(f"with {_REPORTS} select artifact_dir, overall_pass as stated, len(list_filter(coalesce(scenes, []), lambda s: not (coalesce(s.grounded, false) and coalesce(s.compliance_ok, false)))) = 0 as computed, coalesce(len(scenes), 0)::int as n_scenes from a")
def audit_rollup(spark, folder):
    return review.audit_rollup(table(spark, folder, "audit_reports"))


@query(f"with {_REPORTS} select count(*) as n, count(*) filter (overall_pass) as passed, count(*) filter (not overall_pass) as failed from a")
def audit_totals(spark, folder):
    rows = table(spark, folder, "audit_reports").dropDuplicates(["artifact_dir"])
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("overall_pass")).alias("passed"), F.count_if(~F.col("overall_pass")).alias("failed"))


@query(
    f"with {_MANIFESTS}, f as (select artifact_dir, list_filter([case when coalesce(trim(query), '') = '' then 'no query' end, case when coalesce(len(retrieved_chunks), 0) = 0 then 'no evidence' end, "
    "case when coalesce(n_scenes, 0) > 0 and coalesce(len(artifacts.clips), 0) <> n_scenes then 'clips differ from scenes' end, case when coalesce(len(artifacts.clips), 0) <> coalesce(len(artifacts.audio), 0) then 'clips and audio differ' end, "
    "case when artifacts.reel is null then 'no reel' end], lambda x: x is not null) as f from m) select artifact_dir, len(f) = 0 as passed, coalesce(array_to_string(f, '; '), '') as failures from f"
)
def structure_failures(spark, folder):
    return review.structure_failures(table(spark, folder, "manifests"))


@query(f"with {_MANIFESTS}, k as (select artifact_dir, unnest(range(len(artifacts.clips)))::int as place, unnest(artifacts.clips) as clip from m) select artifact_dir, place, clip, case when place = 0 then 0.0 else 5.5 + (place - 1) * 7.5 end::double as starts from k")
def clip_timeline(spark, folder):
    return review.clip_timeline(table(spark, folder, "manifests"))


@query(f"with {_MANIFESTS} select artifact_dir, coalesce(len(artifacts.clips), 0)::int as n, case when coalesce(len(artifacts.clips), 0) = 0 then 0.0 else 6.0 + (len(artifacts.clips) - 1) * 7.5 end::double as length from m")
def reel_lengths(spark, folder):
    return review.reel_lengths(table(spark, folder, "manifests"))


@query(f"with {_MANIFESTS} select artifact_dir, ['low', 'high'][(('0x' || substr(md5(artifact_dir), 1, 8))::bigint % 2 + 1)::int] as voice from m")
def voices(spark, folder):
    """A voice for each draft, the same in every run."""
    return table(spark, folder, "manifests").select("artifact_dir").distinct().select("artifact_dir", review.voice(F.col("artifact_dir"), ["low", "high"]).alias("voice"))


@query("with s as (select distinct unnest(months) as month, key, label from seasons) select o_orderkey, key as season, label from orders join s on month(o_orderdate) = s.month")
def required_seasons(spark, folder):
    """The season of every order; a month without one, or with two, stops the job."""
    seasons = table(spark, folder, "seasons").select(F.explode("months").alias("month"), F.col("key").alias("season"), "label")
    rows = table(spark, folder, "orders").select("o_orderkey", F.month("o_orderdate").alias("month"))
    return lookups.required(rows, seasons, "month").select("o_orderkey", "season", "label")


@query(f"with {_MANIFESTS}, k as (select artifact_dir, unnest(range(len(artifacts.clips)))::int as place, unnest(artifacts.clips) as clip, unnest(artifacts.audio) as audio from m where len(artifacts.clips) = len(artifacts.audio)) select * from k")
def paired_media(spark, folder):
    return review.paired_media(table(spark, folder, "manifests"))


# Streams

@query("select distinct chunk_id, source from all_chunks")
def stream_first_arrivals(spark, folder):
    """all_chunks read as a stream of files; re-appended rows are dropped as they arrive."""
    return ingest.drained(ingest.first_arrivals(ingest.arriving(spark, folder, "all_chunks").select("chunk_id", "source", "loaded_at"), "chunk_id", "loaded_at")).select("chunk_id", "source")


@query("select date_trunc('day', ts) as start, event_type, count(*) as n from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) group by 1, 2")
def stream_event_counts(spark, folder):
    """Daily counts by type of event, of the days that the watermark has closed."""
    return ingest.drained(ingest.windowed_counts(ingest.arriving(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "1 day", "event_type")).withColumn("start", F.col("start").cast("timestamp_ntz"))
