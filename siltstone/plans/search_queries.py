"""Search queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collections, search, versions
from ..tables import read
from .base import Book

BOOK = Book()
QUERIES, ORACLE = BOOK.queries, BOOK.oracle
ASKED = ["orders", "region", "limit"]

#: The SQL has a list of its own.
STOP = ", ".join(
    f"'{w}'" for w in """a an the is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into through
during before after above below between out off over under again further then once here there when where why how all each every both few more most other some such no nor not only own same so
than too very just because but and or if while about up this that these those it its he she they we you me him her us them my your his our their what which""".split()
)
TOKENS = "list_filter(string_split_regex(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9_\\s-]', ' ', 'g'), '\\s+'), lambda t: length(t) > 1 and t not in (" + STOP + "))"
INDEX = """
posted as (select doc_id, term, count(*) as n from (select doc_id, unnest({1}) as term from {0}) group by all),
idfs as (select term, count(*) as df, ln(((select count(*) from {0}) + 1) / (count(*) + 1)) + 1 as idf from posted group by term),
w as (select p.doc_id, p.term, p.n / max(p.n) over (partition by p.doc_id) * i.idf as w from posted p join idfs i using (term))
"""
POSTED = "with " + INDEX.format("documents", TOKENS.format("text"))
#: Documents with their first line, without the marks of a heading, as title.
TITLED = """
titled as (select doc_id, lower(trim(source)) as kind, repo, regexp_replace(string_split(text, chr(10))[1], '^#+ *', '') as title, substr(text, length(string_split(text, chr(10))[1]) + 2) as content from documents where text is not null)
"""


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind, repo, title, content) of the documents: the first line is the title."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    first = F.substring_index("text", "\n", 1)
    content = F.expr("substr(text, length(substring_index(text, '\n', 1)) + 2)")
    return docs.select("doc_id", F.lower(F.trim("source")).alias("kind"), "repo", F.regexp_replace(first, "^#+ *", "").alias("title"), content.alias("content"))


def _asked(docs: DataFrame) -> DataFrame:
    """A query out of every document whose id is divisible by 100: its title."""
    return docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.col("title").alias("text"))


@BOOK.query(POSTED + "select term, df, round(idf, 6) as idf from idfs")
def search_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and idf of every term."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return search.idf(search.postings(docs, "doc_id", "text"), docs).withColumn("idf", F.round("idf", 6))


@BOOK.query("select doc_id, len(t) as tokens, list_aggregate(t, 'string_agg', ' ') as text from (select doc_id, " + TOKENS.format("text") + " as t from documents)")
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", search.tokens_of(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("tokens"), F.nullif(F.array_join("t", " "), F.lit("")).alias("text"))


@BOOK.query(
    "with w as (select doc_id, unnest(t) as term, generate_subscripts(t, 1) - 1 as position from (select doc_id, " + TOKENS.format("text") + """ as t from documents))
select term, doc_id as first_doc, position::int as position from w qualify row_number() over (partition by term order by doc_id, position) = 1"""
)
def search_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with the place where it stands first."""
    return search.vocabulary(read(spark, sf_dir, "documents").select("doc_id", "text"))


@BOOK.query(
    POSTED
    + """, q as (select term, coalesce(idf, 1) as qw from (select unnest(['orders', 'region', 'limit']) as term) left join idfs using (term))
select doc_id, round(sum(w * qw) / (sqrt(sum(w * w)) * (select sqrt(sum(qw * qw)) from q)), 6) as score
from w left join q using (term) group by doc_id having sum(w * qw) is not null order by score desc, doc_id limit 10"""
)
def search_tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for a query by TF-IDF cosine."""
    return search.search(read(spark, sf_dir, "documents").select("doc_id", "text"), ASKED)


@BOOK.query(
    """select vec_id, label, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = (select min(vec_id) from embeddings))), 5) as score
from embeddings order by score desc, vec_id limit 20"""
)
def search_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty vectors nearest to the first one."""
    vectors = read(spark, sf_dir, "embeddings")
    asked = vectors.agg(F.min_by("embedding", "vec_id").alias("q"))
    # One row.
    return vectors.join(F.broadcast(asked)).select("vec_id", "label", F.round(search.cosine(F.col("embedding"), F.col("q")), 5).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


@BOOK.query(
    """select query, vec_id, score from (select q.vec_id as query, e.vec_id as vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 5) as score
from embeddings e, embeddings q where q.vec_id % 100 = 0) qualify row_number() over (partition by query order by score desc, vec_id) <= 20"""
)
def search_embedding_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty vectors nearest to each one whose id is divisible by 100."""
    vectors = read(spark, sf_dir, "embeddings")
    return search.nearest(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding")


@BOOK.query(
    POSTED
    + """, u as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as w from w)
select query, doc_id, score from (select q.doc_id as query, u.doc_id as doc_id, round(sum(u.w * q.w), 6) as score from u join u q using (term) where q.doc_id % 100 = 0 group by all)
qualify row_number() over (partition by query order by score desc, doc_id) <= 10"""
)
def search_related_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by TF-IDF cosine for the text of each document whose id is divisible by 100."""
    return search.related(read(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id") % 100 == 0)


LEXICAL = (
    "with "
    + TITLED
    + ", texts as (select doc_id, kind, title, concat_ws(' ', title, content) as text from titled), "
    + INDEX.format("texts", TOKENS.format("text"))
    + """, asked as (select doc_id as query, title as text, """ + TOKENS.format("title") + """ as ts from titled where doc_id % 100 = 0),
qc as (select query, term, count(*) as n from (select query, unnest(ts) as term from asked) group by all),
q as (select query, term, n / max(n) over (partition by query) * coalesce(idf, 1) as qw from qc left join idfs using (term)),
qn as (select query, sqrt(sum(qw * qw)) as qnorm from q group by 1), dn as (select doc_id, sqrt(sum(w * w)) as norm from w group by 1),
lex as (select query, doc_id, dot / (norm * qnorm) as lexical from (select query, doc_id, sum(w * qw) as dot from w join q using (term) group by all) join dn using (doc_id) join qn using (query)),
tt as (select doc_id, title, """ + TOKENS.format("title") + """ as ts from titled),
boost as (select query, doc_id, case when contains(lower(t.title), lower(a.text)) then 1.0::double else len(list_filter(a.ts, lambda x: len(list_filter(t.ts, lambda y: contains(x, y) or contains(y, x))) > 0)) / len(a.ts)::double end as boost
  from asked a, tt t where len(a.ts) > 0 and len(t.ts) > 0)
"""
)


@BOOK.query(LEXICAL + "select query, doc_id, round(boost, 6) as boost from boost where boost > 0")
def search_title_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each document's title meets the title of each document whose id is divisible by 100."""
    docs = titled(spark, sf_dir)
    return search.title_boosts(docs, _asked(docs), places=6)


@BOOK.query(
    LEXICAL + """select query, doc_id, score from (select query, doc_id, round(0.7 * coalesce(lexical, 0) + 0.3 * coalesce(boost, 0), 6) as score from boost full join lex using (query, doc_id)) where score >= 0.1
qualify row_number() over (partition by query order by score desc, doc_id) <= 10"""
)
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each query by words and title."""
    docs = titled(spark, sf_dir)
    return search.hybrid(docs, _asked(docs))


@BOOK.query(
    LEXICAL + """select query, doc_id, score from (select query, doc_id, round(0.7 * coalesce(lexical, 0) + 0.3 * coalesce(boost, 0), 6) as score from boost full join lex using (query, doc_id))
where score >= 0.1 and doc_id in (select doc_id from texts where kind in ('guide', 'readme')) qualify row_number() over (partition by query order by score desc, doc_id) <= 10"""
)
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among two kinds of documents."""
    docs = titled(spark, sf_dir)
    return search.hybrid(docs, _asked(docs), only=F.col("kind").isin("guide", "readme"))


@BOOK.query(
    LEXICAL + """select query, doc_id, score from (select query, doc_id, round(0.7 * coalesce(lexical, 0) + 0.3 * coalesce(boost, 0), 6) as score from boost full join lex using (query, doc_id)) where score >= 0.05
qualify row_number() over (partition by query order by score desc, doc_id) <= 6 and query <> doc_id"""
)
def search_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related documents: the best six by title, the document itself left out."""
    docs = titled(spark, sf_dir)
    return search.hybrid(docs, _asked(docs), limit=6, threshold=0.05).where("query <> doc_id")


VECTORS = """, vecs as (select vec_id as doc_id, embedding::double[] as v from embeddings),
near as (select q.doc_id as query, d.doc_id as doc_id, list_cosine_similarity(q.v, d.v) as e from vecs q, vecs d where q.doc_id % 100 = 0)
"""


@BOOK.query(
    LEXICAL + VECTORS + """select query, doc_id, score from (select a.query, t.doc_id, round(0.5 * coalesce(lexical, 0) + 0.2 * coalesce(boost, 0) + 0.3 * coalesce(e, 0), 6) as score
  from asked a cross join (select doc_id from texts union select doc_id from vecs) t left join lex using (query, doc_id) left join boost using (query, doc_id) left join near using (query, doc_id)) where score >= 0.1 qualify row_number() over (partition by query order by score desc, doc_id) <= 10"""
)
def search_hybrid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each query by words, title and vector."""
    docs, vectors = titled(spark, sf_dir), read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    asked = _asked(docs)
    of_queries = vectors.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), "embedding").join(asked.select("query"), "query", "left_semi")
    return search.hybrid(docs, asked, vectors, of_queries)


@BOOK.query(
    LEXICAL + VECTORS + """, found as (select query, doc_id, round(0.7 * coalesce(lexical, 0) + 0.3 * coalesce(boost, 0), 6) as score from boost full join lex using (query, doc_id)),
hits as (select * from found where score >= 0.6 qualify row_number() over (partition by query order by score desc, doc_id) <= 10),
near5 as (select query, doc_id, round(e, 5) as score from near qualify row_number() over (partition by query order by round(e, 5) desc, doc_id) <= 20),
more as (select query, doc_id, score from near5 where score > 0.3 and query not in (select query from hits group by 1 having count(*) >= 10) and (query, doc_id) not in (select query, doc_id from hits))
select query, doc_id, score from (select * from hits union all select * from more) qualify row_number() over (partition by query order by score desc, doc_id) <= 10"""
)
def search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with fewer than ten good hits, filled up by vectors."""
    docs, vectors = titled(spark, sf_dir), read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    near = search.nearest(vectors, vectors.where("doc_id % 100 = 0"), "doc_id", "embedding", 20)
    return search.with_fallback(search.hybrid(docs, _asked(docs), threshold=0.6), near)


@BOOK.query(
    LEXICAL + """, parts as (select query, ts[len(ts)][1:3] as last, list_aggregate(ts[1:len(ts) - 1], 'string_agg', ' ') as first from asked where len(ts) > 0)
select query, suggestion from (select query, term, idf, concat_ws(' ', nullif(first, ''), term) as suggestion from parts, idfs where starts_with(term, last) and term <> last)
qualify row_number() over (partition by query order by round(idf, 6) desc, term) <= 5"""
)
def search_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of each query whose last word is cut after three letters."""
    docs = titled(spark, sf_dir).select("doc_id", "title", F.concat_ws(" ", "title", "content").alias("text"))
    words = search.tokens_of(F.col("title"))
    cut = F.array_append(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), F.substring(F.try_element_at(words, F.lit(-1)), 1, 3))
    asked = docs.where((F.col("doc_id") % 100 == 0) & (F.size(words) > 0)).select(F.col("doc_id").alias("query"), F.array_join(cut, " ").alias("text"))
    return search.suggest(search.idf(search.postings(docs, "doc_id", "text"), docs), asked)


@BOOK.query(
    """with p as (select doc_id, text, list_concat(list_filter(range(1, length(text) + 1), lambda i: substr(lower(text), i, 6) = 'region'), list_filter(range(1, length(text) + 1), lambda i: substr(lower(text), i, 5) = 'limit')) as pos from documents where contains(lower(text), 'region') or contains(lower(text), 'limit'))
select doc_id, list_aggregate(pos, 'string_agg', ',') as positions, case when pos[1] > 41 then '...' else '' end || substr(text, greatest(1, pos[1] - 40), least(length(text), pos[1] + 119) - greatest(1, pos[1] - 40) + 1) || case when pos[1] + 119 < length(text) then '...' else '' end as snippet from p"""
)
def search_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of two words, and a snippet around the first."""
    return search.highlights(read(spark, sf_dir, "documents").select("doc_id", "text"), ["region", "limit"])


HEADINGS = "list_transform(regexp_extract_all(text, '(?m)^#{1,6} +([^\\n]*)', 1), lambda h: trim(h, ' ' || chr(13)))"


@BOOK.query(
    "with " + TITLED + ", p as (select doc_id, title, content as text, " + HEADINGS.replace("text,", "d.text,") + """ as hs from titled join (select doc_id, text from documents) d using (doc_id))
select doc_id, (case when contains(lower(title), 'order') then 10 else 0 end + case when contains(lower(text), 'order') then 1 else 0 end + 5 * len(list_filter(hs, lambda h: contains(lower(h), 'order'))))::bigint as score from p
where score > 0 order by score desc, doc_id limit 8"""
)
def search_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best pages for a query by title, headings and text."""
    docs = titled(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", F.expr(r"regexp_extract_all(text, '(?m)^#{1,6} +([^\\n]*)', 1)").alias("headings")), "doc_id")
    return search.client_search(docs.withColumnRenamed("content", "text"), "order")


LAST = """
with held as (select * from endpoints where project is not null and snapshot_no is not null qualify row_number() over (partition by project, snapshot_no,
  case when protocol = 'rest' then coalesce(httpMethod, 'undefined') || ':' || coalesce(path, 'undefined') when protocol = 'graphql' then coalesce(operationType, 'undefined') || ':' || coalesce(fieldName, 'undefined') else coalesce(name, 'undefined') end
  order by received_at desc nulls last, row_id desc) = 1 and snapshot_no = max(snapshot_no) over (partition by project)),
"""


@BOOK.query(
    LAST + """
svc as (select project, handlerClass as name, list_sort(list_distinct(list(name))) as methods, list_sort(list_distinct(list(serviceRef) filter (serviceRef is not null))) as deps from held where handlerClass is not null group by all)
select project, 'ep:' || coalesce(handlerClass, 'undefined') || ':' || coalesce(name, 'undefined') as id, name as title, 'endpoint' as type, filePath as path,
  concat(coalesce(description, ''), ' ', coalesce(httpMethod, operationType, ''), ' ', coalesce(path, fieldName, ''), ' Handler: ', coalesce(handler, 'undefined'), ' Returns: ', coalesce(returnType, 'undefined'), ' ',
    coalesce(list_aggregate(list_transform(parameters, lambda p: coalesce(p.name, 'undefined') || ': ' || coalesce(p.type, 'undefined')), 'string_agg', ', '), ''), ' ', coalesce(list_aggregate(tags, 'string_agg', ' '), '')) as content from held
union all select project, 'svc:' || name, name, 'service', null, concat(' Methods: ', list_aggregate(methods, 'string_agg', ', '), ' Dependencies: ', coalesce(list_aggregate(deps, 'string_agg', ', '), '')) from svc
union all select repo, 'type:' || coalesce(name, 'undefined'), name, 'type', filePath, concat(coalesce(description, ''), ' Kind: ', coalesce(kind, 'undefined'), ' ', coalesce(list_aggregate(list_transform(fields, lambda f: coalesce(f.name, 'undefined') || ': ' || coalesce(f.type, 'undefined')), 'string_agg', ', '), '')) from type_infos"""
)
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints and services of each project's last version, and all types, as documents for search."""
    text = lambda c: F.coalesce(F.col(c), F.lit("undefined"))
    listed = lambda c: F.coalesce(F.array_join(F.transform(c, lambda p: F.concat(F.coalesce(p["name"], F.lit("undefined")), F.lit(": "), F.coalesce(p["type"], F.lit("undefined")))), ", "), F.lit(""))
    endpoints = read(spark, sf_dir, "endpoints")
    held = versions.items(endpoints, versions.endpoint_id(), (*collections.COLUMNS, "description", "tags", "filePath"))
    last = held.join(versions.versions(endpoints).where("next is null"), [*versions.AT], "left_semi")

    def document(df: DataFrame, id_: Column, title: str, kind: str, path: Column, *parts: Column) -> DataFrame:
        return df.select("project", id_.alias("id"), F.col(title).alias("title"), F.lit(kind).alias("type"), path.alias("path"), F.concat(*parts).alias("content"))

    blank = F.lit(" ")
    eps = last.select("project", "item.*")
    eps = document(
        eps, F.concat(F.lit("ep:"), text("handlerClass"), F.lit(":"), text("name")), "name", "endpoint", F.col("filePath"),
        F.coalesce("description", F.lit("")), blank, F.coalesce("httpMethod", "operationType", F.lit("")), blank, F.coalesce("path", "fieldName", F.lit("")), F.lit(" Handler: "), text("handler"), F.lit(" Returns: "), text("returnType"), blank, listed("parameters"), blank, F.coalesce(F.array_join("tags", " "), F.lit("")),
    )
    svcs = document(collections.services(last), F.concat(F.lit("svc:"), "name"), "name", "service", F.lit(None).cast("string"), F.lit(" Methods: "), F.array_join("methods", ", "), F.lit(" Dependencies: "), F.array_join("dependencies", ", "))
    types = read(spark, sf_dir, "type_infos").withColumnRenamed("repo", "project")
    types = document(types, F.concat(F.lit("type:"), text("name")), "name", "type", F.col("filePath"), F.coalesce("description", F.lit("")), F.lit(" Kind: "), text("kind"), blank, listed("fields"))
    return eps.unionByName(svcs).unionByName(types)
