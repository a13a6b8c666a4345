"""The registered queries of the engine's own operators, and their SQL.

Tables stand in for the engine's relations: `embeddings` for passage vectors (idx = vec_id, article = label), `documents`
for article bodies, `pages` for raw pages with links, `benchmark` for query texts, lineitem, orders and part for the rows
of SQL dumps. Searches ask every vector whose vec_id is divisible by 100. Sizes that only make sense on a full corpus
(rank bands, probes, codes) are set to what these tables hold; everything else keeps its default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Mining, Rerank
from ..functions import text as T
from ..functions import vector as V
from ..operators import contain, encode, export, index, linkgraph, metrics, mining, passages, search
from ..sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EVERY = 100
PARTS, CODES, DIM = 16, 16, 64
BAND = Mining(rank_min=100, rank_max=200, pool=10)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- shared relations

def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), "embedding", F.col("label").cast("long").alias("label"))


def _asked(spark, sf):
    return _vectors(spark, sf).where(F.col("idx") % EVERY == 0).select(F.col("idx").alias("qid"), F.col("embedding").alias("vec"))


def _links(spark, sf):
    return readers.page_links(table(spark, sf, "pages"))


def _counts(spark, sf):
    return linkgraph.backlink_counts(_links(spark, sf).select(F.col("target").alias("to_title")))


def _titles(spark, sf):
    """(label, title): the article of a label is the linked title at that place by count."""
    most = _vectors(spark, sf).agg(F.coalesce(F.max("label"), F.lit(-1))).first()[0] + 1  # labels are small numbers
    order = [F.col("count").desc(), F.col("title")]
    # Each partition passes on as many titles as there are labels; only these stand in one window.
    first = _counts(spark, sf).orderBy(*order).limit(most)
    return first.select("title", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("label"))


def _page_title(c):
    return F.regexp_extract(c, "<title>([^<]*)</title>", 1)


def _query_texts(spark, sf):
    """(qid, query, vec): the text of a query is the title of the page numbered as many hundredths."""
    pages = table(spark, sf, "pages").select((F.col("page_id") * EVERY).alias("page_qid"), _page_title(F.col("html")).alias("query"))
    return _asked(spark, sf).join(pages, F.col("qid") == F.col("page_qid")).select("qid", "query", "vec")


def _passages(spark, sf):
    return _vectors(spark, sf).join(_titles(spark, sf).withColumnRenamed("label", "of_label"), F.col("label") == F.col("of_label")).select("idx", "title", F.concat(F.lit("passage "), F.col("idx").cast("string")).alias("text"), "embedding", F.lit(None).cast("long").alias("curid"))


_FLAT = f"""
flat as (select q.vec_id as qid, e.vec_id as idx, e.label, list_distance(q.embedding::double[], e.embedding::double[]) ** 2 as distance,
                list_dot_product(q.embedding::double[], e.embedding::double[]) as dot,
                sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) as norms
         from embeddings q, embeddings e where q.vec_id % {EVERY} = 0),
near as (select *, (row_number() over (partition by qid order by distance, idx) - 1)::int as rank_pos from flat)"""
_LINKS = """
hrefs as (select page_id, regexp_extract_all(html, 'href="/([^"]*)"', 1) as targets from pages),
links as (select page_id, i - 1 as pos, targets[i] as target from hrefs, unnest(range(1, len(targets) + 1)) as u(i)),
counts as (select target as title, count(*) as count from links group by target)"""
_TITLES = "titles as (select title, row_number() over (order by count desc, title) - 1 as label from counts)"
_BEST = """
scored as (select qid, idx, rank_pos, title, dot / norms as score from near join titles using (label) where rank_pos < 50),
best as (select * from (select *, row_number() over (partition by qid, title order by score desc, rank_pos) as place,
                               min(rank_pos) over (partition by qid, title) as first_pos from scored) where place = 1)"""
_TEXTS = f"texts as (select page_id * {EVERY} as qid, regexp_extract(html, '<title>([^<]*)</title>', 1) as query from pages)"


# ---- vectors and indexes

@query(f"with {_FLAT} select qid, idx, rank_pos, round(distance, 6) as distance from near where rank_pos < 50")
def knn_flat(spark, sf):
    found = index.search_flat(_vectors(spark, sf), _asked(spark, sf), 50)
    return found.select("qid", "idx", "rank_pos", F.round("distance", 6).alias("distance"))


@query(SQL["knn_flat"])
def knn_blocks(spark, sf):
    found = index.search_blocks(_vectors(spark, sf), _asked(spark, sf), 50)
    return found.select("qid", "idx", "rank_pos", F.round("distance", 6).alias("distance"))


@query("select vec_id as idx, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm from embeddings")
def vector_norms(spark, sf):
    return _vectors(spark, sf).select("idx", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query(f"with {_FLAT} select qid, idx, round(dot / norms, 6) as cosine from flat")
def cosine_pairs(spark, sf):
    asked = _asked(spark, sf)
    return _vectors(spark, sf).join(asked, how="cross").select("qid", "idx", F.round(V.cosine(F.col("vec"), F.col("embedding")), 6).alias("cosine"))


_PARAMETERS = "p as (select count(*) as rows, max(len(embedding)) as dim from embeddings)"


@query(f"""with {_PARAMETERS} select rows, dim::bigint as dim, (rows * dim * 4)::bigint as flat_bytes, case when rows * dim * 4 <= 4294967296 then 'flat' else 'ivfpq' end as index_type,
  least(greatest(floor(4 * sqrt(rows)), 100), 65536)::bigint as n_lists, least(rows, greatest(100000, 40 * least(greatest(floor(4 * sqrt(rows)), 100), 65536)))::bigint as n_training from p""")
def index_params(spark, sf):
    return index.parameters(_vectors(spark, sf))


@query(f"""with {_PARAMETERS}, c as (select unnest([4294967296, 1048576, 65536]) as ceiling)
select ceiling::bigint as ceiling, (rows * dim * 4)::bigint as flat_bytes, case when rows * dim * 4 <= ceiling then 'flat' else 'ivfpq' end as index_type from p, c""")
def index_size_plan(spark, sf):
    size = index.parameters(_vectors(spark, sf)).select("flat_bytes")
    ceilings = spark.createDataFrame([(4 << 30,), (1 << 20,), (1 << 16,)], "ceiling long")
    return size.join(ceilings, how="cross").select("ceiling", "flat_bytes", F.when(F.col("flat_bytes") <= F.col("ceiling"), "flat").otherwise("ivfpq").alias("index_type"))


@query(f"""with {_PARAMETERS} select rows, dim::bigint as dim, (rows * dim * 4)::bigint as flat_bytes, 'flat' as index_type,
  least(greatest(floor(4 * sqrt(rows)), 100), 65536)::bigint as n_lists, least(rows, greatest(100000, 40 * least(greatest(floor(4 * sqrt(rows)), 100), 65536)))::bigint as n_training,
  (dim * 4)::bigint as flat_vector_bytes, 16.0::double as code_bytes, (dim * 4 / 16.0)::double as compression, (rows * dim * 4)::double as memory_bytes from p""")
def inspect_index(spark, sf):
    return index.inspect(_vectors(spark, sf))


@query("select count(*) as index_rows, count(*) as passage_rows, 0::bigint as only_index, 0::bigint as only_passages, true as aligned from embeddings")
def index_alignment(spark, sf):
    rows = _vectors(spark, sf)
    return index.alignment(rows.select("idx"), rows.select("idx"))


def _fixed_centroids(spark, sf):
    """The vector of the smallest idx of each label, whose centroid it is."""
    return _vectors(spark, sf).groupBy(F.col("label").cast("int").alias("list_id")).agg(F.min_by("embedding", "idx").cast("array<double>").alias("centroid"))


_CENTROIDS = "centroids as (select label as list_id, arg_min(embedding, vec_id)::double[] as centroid from embeddings group by label)"
_LISTED = f"""
{_CENTROIDS},
listed as (select idx, embedding, list_id from (select vec_id as idx, e.embedding, list_id, row_number() over (partition by vec_id order by list_distance(e.embedding::double[], centroid) ** 2, list_id) as place
           from embeddings e, centroids) where place = 1)"""


@query(f"with {_LISTED} select idx, list_id from listed")
def ivf_assign(spark, sf):
    return index.assign_lists(_vectors(spark, sf), _fixed_centroids(spark, sf)).select("idx", "list_id")


@query(f"with {_LISTED} select list_id, count(*) as n from listed group by list_id")
def ivf_list_sizes(spark, sf):
    return index.assign_lists(_vectors(spark, sf), _fixed_centroids(spark, sf)).groupBy("list_id").agg(F.count("*").alias("n"))


@query(f"""with {_LISTED},
probes as (select vec_id as qid, q.embedding as vec, list_id from (select vec_id, embedding, list_id, row_number() over (partition by vec_id order by list_distance(embedding::double[], centroid) ** 2, list_id) as place
           from embeddings, centroids where vec_id % {EVERY} = 0) q where place <= 3),
f as (select qid, idx, list_distance(vec::double[], embedding::double[]) ** 2 as distance from probes join listed using (list_id)),
r as (select *, (row_number() over (partition by qid order by distance, idx) - 1)::int as rank_pos from f)
select qid, idx, rank_pos, round(distance, 6) as distance from r where rank_pos < 50""")
def knn_ivf_fixed(spark, sf):
    centroids = _fixed_centroids(spark, sf)
    listed = index.assign_lists(_vectors(spark, sf), centroids)
    found = index.search_lists(listed, centroids, _asked(spark, sf), 50, nprobe=3)
    return found.select("qid", "idx", "rank_pos", F.round("distance", 6).alias("distance"))


def _fixed_codebook(spark, sf):
    """The parts of the vectors with the CODES smallest idx as centres: the codebook's size is fixed."""
    size = DIM // PARTS
    some = _vectors(spark, sf).where(F.col("idx") < CODES)
    return some.select(F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.col("idx").cast("int").alias("code"), "embedding").select("part", "code", F.slice("embedding", F.col("part") * size + 1, F.lit(size)).cast("array<double>").alias("centre"))


_BOOK = f"""
parts as (select unnest(range(0, {PARTS})) as part),
book as (select part, vec_id as code, embedding[part * {DIM // PARTS} + 1:part * {DIM // PARTS} + {DIM // PARTS}]::double[] as centre from embeddings, parts where vec_id < {CODES}),
coded as (select idx, list(code order by part) as codes, flatten(list(centre order by part)) as decoded from (
  select vec_id as idx, p.part, code, centre, row_number() over (partition by vec_id, p.part order by list_distance(embedding[p.part * {DIM // PARTS} + 1:p.part * {DIM // PARTS} + {DIM // PARTS}]::double[], centre) ** 2, code) as place
  from embeddings, parts p join book b on b.part = p.part) where place = 1 group by idx)"""


@query(f"with {_BOOK} select idx, array_to_string(codes, ',') as codes from coded")
def pq_encode_fixed(spark, sf):
    coded = index.pq_encode(_vectors(spark, sf), _fixed_codebook(spark, sf), DIM, PARTS)
    return coded.select("idx", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query(f"with {_BOOK} select idx, round(list_distance(embedding::double[], decoded) ** 2, 6) as error, round(decoded[1], 6) as first, round(decoded[{DIM}], 6) as last from coded join embeddings on vec_id = idx")
def pq_reconstruct(spark, sf):
    book = _fixed_codebook(spark, sf)
    back = index.pq_decode(index.pq_encode(_vectors(spark, sf), book, DIM, PARTS), book)
    return back.select("idx", F.round(V.l2_squared(F.col("embedding"), F.col("decoded")), 6).alias("error"), F.round(F.col("decoded")[0], 6).alias("first"), F.round(F.col("decoded")[DIM - 1], 6).alias("last"))


@query(f"""with {_BOOK},
lookup as (select q.vec_id as qid, part, code, list_distance(q.embedding[part * {DIM // PARTS} + 1:part * {DIM // PARTS} + {DIM // PARTS}]::double[], centre) ** 2 as d from embeddings q, book where q.vec_id % {EVERY} = 0),
flat_codes as (select idx, i - 1 as part, codes[i] as code from coded, unnest(range(1, {PARTS} + 1)) as u(i)),
f as (select qid, idx, sum(d) as distance from flat_codes join lookup using (part, code) group by qid, idx),
r as (select *, (row_number() over (partition by qid order by round(distance, 9), idx) - 1)::int as rank_pos from f)
select qid, idx, rank_pos, round(distance, 6) as distance from r where rank_pos < 10""")
def pq_adc_topk(spark, sf):
    book = _fixed_codebook(spark, sf)
    coded = index.pq_encode(_vectors(spark, sf), book, DIM, PARTS)
    found = index.search_codes(coded, book, _asked(spark, sf), (1 << 31) - 1, DIM, PARTS)
    # equal codes give equal distances but for the last bits: ties are broken after rounding, on both sides
    return index.top_by(found.drop("rank_pos").withColumn("distance", F.round("distance", 9)), 10).select("qid", "idx", "rank_pos", F.round("distance", 6).alias("distance"))


@query(f"""with {_LISTED}, {_BOOK},
probes as (select vec_id as qid, list_id from (select vec_id, list_id, row_number() over (partition by vec_id order by list_distance(embedding::double[], centroid) ** 2, list_id) as place
           from embeddings, centroids where vec_id % {EVERY} = 0) where place <= 3),
lookup as (select q.vec_id as qid, part, code, list_distance(q.embedding[part * {DIM // PARTS} + 1:part * {DIM // PARTS} + {DIM // PARTS}]::double[], centre) ** 2 as d from embeddings q, book where q.vec_id % {EVERY} = 0),
flat_codes as (select idx, list_id, i - 1 as part, codes[i] as code from coded join listed using (idx), unnest(range(1, {PARTS} + 1)) as u(i)),
f as (select qid, idx, sum(d) as distance from probes join flat_codes using (list_id) join lookup using (qid, part, code) group by qid, idx),
r as (select *, (row_number() over (partition by qid order by round(distance, 9), idx) - 1)::int as rank_pos from f)
select qid, idx, rank_pos, round(distance, 6) as distance from r where rank_pos < 50""")
def knn_ivfpq_fixed(spark, sf):
    """Search over an inverted and product-quantised index: codes within the probed lists, no vectors."""
    centroids, book = _fixed_centroids(spark, sf), _fixed_codebook(spark, sf)
    coded = index.pq_encode(index.assign_lists(_vectors(spark, sf), centroids), book, DIM, PARTS).select("list_id", "idx", "codes")
    found = index.search_ivfpq(coded, centroids, book, _asked(spark, sf), 50, DIM, PARTS, nprobe=3, digits=9)
    return found.select("qid", "idx", "rank_pos", F.round("distance", 6).alias("distance"))


@query()
def ivf_kmeans(spark, sf):
    rows = _vectors(spark, sf)
    centroids = index.train_lists(rows, 16)
    return index.assign_lists(rows, centroids).groupBy("list_id").agg(F.count("*").alias("n"))


@query()
def pq_kmeans(spark, sf):
    rows = _vectors(spark, sf)
    book = index.train_codebook(rows, DIM, parts=4, codes=16)
    back = index.pq_decode(index.pq_encode(rows, book, DIM, 4), book)
    return back.select("idx", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"), F.round(V.l2_squared(F.col("embedding"), F.col("decoded")), 6).alias("error"))


@query("""select (select count(*) from embeddings where vec_id % 10 <> 3) as index_rows, (select count(*) from embeddings where vec_id % 10 <> 7) as passage_rows,
  (select count(*) from embeddings where vec_id % 10 = 7) as only_index, (select count(*) from embeddings where vec_id % 10 = 3) as only_passages, false as aligned""")
def index_misalignment(spark, sf):
    """An index that lacks some passages and holds others too many."""
    rows = _vectors(spark, sf).select("idx")
    return index.alignment(rows.where("idx % 10 <> 3"), rows.where("idx % 10 <> 7"))


# ---- search

def _candidates(spark, sf):
    return index.search_flat(_vectors(spark, sf), _asked(spark, sf), search.pool_size(5)).select("qid", "idx", "rank_pos")


@query(f"with {_FLAT}, {_LINKS}, {_TITLES}, {_BEST} select qid, title, idx, rank_pos, first_pos, round(score, 6) as score from best")
def best_paragraph_per_article(spark, sf):
    best = search.best_per_article(search.scored(_candidates(spark, sf), _passages(spark, sf), _asked(spark, sf)))
    return best.select("qid", "title", "idx", "rank_pos", "first_pos", F.round("score", 6).alias("score"))


@query(f"""with {_FLAT}, {_LINKS}, {_TITLES}, {_BEST},
r as (select *, row_number() over (partition by qid order by score desc, first_pos) as rank from best)
select qid, rank::int as rank, title, '' as url, round(score, 6) as score, round(score, 6) as cosine, 'passage ' || idx as snippet, idx, false as reranked from r where rank <= 5""")
def search_topk(spark, sf):
    found = search.search(_passages(spark, sf), _candidates(spark, sf), _asked(spark, sf), 5)
    return found.withColumns({"score": F.round("score", 6), "cosine": F.round("cosine", 6)})


_MATCH = """(len(list_intersect(list_distinct(regexp_extract_all(lower(title), '\\S+')), list_distinct(regexp_extract_all(lower(query), '\\S+'))))::double
  / nullif(len(list_distinct(regexp_extract_all(lower(query), '\\S+'))), 0))"""
_P99 = "p99 as (select coalesce((select count from counts order by count desc limit 1 offset (select cast(floor(count(*) * 0.01) as int) from counts)), 1)::bigint as max_backlinks)"


@query(f"""with {_FLAT}, {_LINKS}, {_TITLES}, {_BEST}, {_TEXTS}, {_P99},
s as (select best.*, score + 0.5::double * coalesce({_MATCH}, 0) + 0.3::double * (ln(1 + coalesce(count, 0)) / ln(1 + max_backlinks)) as final
      from best join texts using (qid) left join counts using (title), p99),
r as (select *, row_number() over (partition by qid order by final desc, first_pos) as rank from s)
select qid, rank::int as rank, title, '' as url, round(final, 6) as score, round(score, 6) as cosine, 'passage ' || idx as snippet, idx, true as reranked from r where rank <= 5""")
def search_reranked(spark, sf):
    asked = _query_texts(spark, sf)
    found = search.search(_passages(spark, sf), _candidates(spark, sf), asked, 5, counts=_counts(spark, sf), settings=Rerank(enabled=True, max_backlinks=0))
    return found.withColumns({"score": F.round("score", 6), "cosine": F.round("cosine", 6)})


@query(f"""with q as (select item_id, text as query from benchmark), p as (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages)
select page_id, item_id, round(coalesce({_MATCH}, 0), 6) as title_match from p, q where coalesce({_MATCH}, 0) > 0""")
def title_match(spark, sf):
    """By tokens: a title and a query without a common one never meet."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("key"), _page_title(F.col("html")).alias("title"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return search.title_matches(pages, asked).select(F.col("key").alias("page_id"), F.col("qid").alias("item_id"), F.round("title_match", 6).alias("title_match"))


@query(f"with {_LINKS}, {_P99} select title, count, round(ln(1 + count) / ln(1 + max_backlinks), 6) as boost from counts, p99")
def backlink_boost(spark, sf):
    counts = _counts(spark, sf)
    held = counts.join(F.broadcast(linkgraph.top_percentile(counts)), how="cross")  # one row
    return held.select("title", "count", F.round(search.backlink_boost(F.col("count"), F.col("max_backlinks")), 6).alias("boost"))


# ---- evaluation: an article is relevant to a query if it is that of its label or of the next one

def _judgements(spark, sf):
    titles = _titles(spark, sf).withColumnRenamed("label", "of_label")
    asked = _vectors(spark, sf).where(F.col("idx") % EVERY == 0).select(F.col("idx").alias("qid"), F.explode(F.array(F.col("label"), (F.col("label") + 1) % 10)).alias("label"))
    named = asked.join(titles, F.col("label") == F.col("of_label"))
    return named.groupBy("qid").agg(F.collect_list("title").alias("relevant_articles"))


def _ranking(spark, sf):
    found = search.search(_passages(spark, sf), index.search_flat(_vectors(spark, sf), _asked(spark, sf), 100), _asked(spark, sf), 10)
    return found.select("qid", "rank", "title")


_RANKING = f"""{_FLAT}, {_LINKS}, {_TITLES}, {_BEST.replace("rank_pos < 50", "rank_pos < 100")},
ranking as (select * from (select qid, lower(title) as title, row_number() over (partition by qid order by score desc, first_pos) as rank from best) where rank <= 10),
relevant as (select distinct vec_id as qid, lower(title) as title from embeddings join titles t on t.label = embeddings.label or t.label = (embeddings.label + 1) % 10 where vec_id % {EVERY} = 0),
sizes as (select qid, count(*) as n_relevant from relevant group by qid),
judged as (select r.qid, r.rank, r.title, (v.qid is not null)::int as hit, sum((v.qid is not null)::int) over (partition by r.qid order by rank) as hits, n_relevant
           from ranking r left join relevant v using (qid, title) left join sizes using (qid)),
each as (select qid, coalesce(1.0::double / min(rank) filter (where hit = 1), 0) as reciprocal,
                coalesce(sum(hits::double / rank) filter (where hit = 1) / any_value(n_relevant), 0) as ap,
                coalesce((count(distinct title) filter (where hit = 1 and rank <= n_relevant))::double / any_value(n_relevant), 0) as rp,
                coalesce(min(rank) filter (where hit = 1), 1000000) as first, sum(hit) as n_hits, any_value(n_relevant) as n_relevant,
                coalesce(sum(1.0::double / log2(rank + 1)) filter (where hit = 1), 0) as gain, coalesce(sum(hits::double / rank) filter (where hit = 1), 0) as precisions
         from judged group by qid)"""
_METRICS = {"MRR": "avg(reciprocal)", "R-Precision": "avg(rp)", "MAP": "avg(ap)"} | {f"Top-{k} Accuracy": f"avg((first <= {k})::int)" for k in metrics.KS}


def _metric_sql(*names: str) -> str:
    return f"with {_RANKING} " + " union all ".join(f"select '{n}' as metric, round({_METRICS[n]}, 4) as value from each" for n in names)


def _evaluated(spark, sf):
    asked = _judgements(spark, sf)
    return metrics.evaluate(asked, _ranking(spark, sf), metrics.relevant_titles(asked))


@query(_metric_sql(*_METRICS))
def eval_all(spark, sf):
    return _evaluated(spark, sf)


@query(_metric_sql("MRR"))
def eval_mrr(spark, sf):
    return _evaluated(spark, sf).where("metric = 'MRR'")


@query(_metric_sql("MAP"))
def eval_map(spark, sf):
    return _evaluated(spark, sf).where("metric = 'MAP'")


@query(_metric_sql("R-Precision"))
def eval_rprecision(spark, sf):
    return _evaluated(spark, sf).where("metric = 'R-Precision'")


@query(_metric_sql(*[f"Top-{k} Accuracy" for k in metrics.KS]))
def eval_topk(spark, sf):
    return _evaluated(spark, sf).where("metric like 'Top-%'")


@query(f"with {_RANKING}, ideals as (select *, list_sum([1.0::double / log2(x + 1) for x in range(1, least(n_relevant, 10) + 1)]) as ideal from each) " + " union all ".join(
    f"select '{n}@10' as metric, round({e}, 6) as value from ideals"
    for n, e in {"accuracy": "avg((n_hits > 0)::int)", "precision": "avg(n_hits / 10.0::double)", "recall": "avg(n_hits::double / n_relevant)", "mrr": "avg(reciprocal)", "map": "avg(precisions / least(n_relevant, 10))", "ndcg": "avg(gain / ideal)"}.items()))
def eval_at_10(spark, sf):
    asked = _judgements(spark, sf)
    return metrics.at_k(asked, _ranking(spark, sf), metrics.relevant_titles(asked), 10)


# ---- texts: documents are articles, their lines paragraphs

def _articles(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("http://x.example.com/?curid="), F.col("doc_id").cast("string")).alias("url"), F.concat_ws("-", F.lit("doc"), "source", F.pmod(F.col("doc_id"), F.lit(50)).cast("string")).alias("title"), F.col("text").alias("content"), "doc_id")


_SPLIT = r"d as (select *, string_split(text, chr(10)) as lines from documents)"


@query(f"with {_SPLIT} select doc_id, (i - 1)::int as pos, lines[i] as text from d, unnest(range(1, len(lines) + 1)) as u(i) where trim(lines[i]) <> ''")
def paragraph_positions(spark, sf):
    joined = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    lines = passages.explode_paragraphs(table(spark, sf, "documents").select("doc_id", joined.alias("content")))
    return lines.select("doc_id", "pos", "text")


@query(f"""with {_SPLIT}, l as (select doc_id, i, trim(lines[i]) as line from d, unnest(range(1, len(lines) + 1)) as u(i))
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as pos, line as text from l where line <> ''""")
def paragraphs(spark, sf):
    joined = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.split_paragraphs(joined)).alias("pos", "text"))


@query(f"""with {_SPLIT}, l as (select doc_id, i, trim(regexp_replace(lines[i], '[ \t]+', ' ', 'g')) as line from d, unnest(range(1, len(lines) + 1)) as u(i)),
c as (select doc_id, string_agg(line, chr(10) || chr(10) order by i) as content from l where length(line) >= 70 and not regexp_matches(line, '^\\s*[!|]') group by doc_id)
select doc_id, content from c where len(regexp_extract_all(content, '\\S+')) >= 100""")
def clean_articles(spark, sf):
    fragments = _articles(spark, sf).select("id", "url", "title", F.col("content").alias("raw"))
    return readers.articles(fragments, DEFAULT.extract).select(F.col("id").cast("long").alias("doc_id"), "content")


_ENTITIES = "html"
for _entity, _char in T.COMMON_ENTITIES:
    _ENTITIES = f"replace({_ENTITIES}, '{_entity.replace(chr(39), chr(39) * 2)}', '{_char.replace(chr(39), chr(39) * 2)}')"


@query(rf"""with c as (select page_id, regexp_replace(regexp_replace({_ENTITIES}, '(?is)<ref\b[^>]*>.*?</ref>', ' ', 'g'), '<[^>]+>', ' ', 'g') as body from pages),
s as (select page_id, regexp_replace(regexp_replace(body, '\s*\n\s*\n\s*', chr(10), 'g'), '[ \t]+', ' ', 'g') as body from c)
select page_id, trim(array_to_string([trim(x) for x in string_split(body, chr(10))], chr(10)), ' ' || chr(10)) as text from s""")
def clean_html(spark, sf):
    # All entities of HTML5; SQL has only the closed set.
    return table(spark, sf, "pages").select("page_id", T.clean_text(F.col("html")).alias("text"))


#: Markup put around documents, by doc_id, so that every kind of it comes up; the same on both sides.
_DECORATE = [
    "'[[File:a.jpg|thumb]] ' || text", "'| ' || text", "'== Heading == ' || text", "'see [[Target page|the target]] and [[Plain]] ' || text", "'[[Inner|]] ''''''bold'''''' ' || text",
    "'[http://a.example.com/x link text] [https://b.example.com] ' || text", "'{{cite}} ' || text", "text || ' [[A|[[B]]]] ]] {| x |}'", "'  ' || text", "'! ' || text",
]


def _decorated_sql(column: str = "text") -> str:
    return "case " + " ".join(f"when doc_id % 10 = {k} then {x}" for k, x in enumerate(_DECORATE)) + " end"


def _decorated(spark, sf):
    # Spark takes \\' and not '' inside a string
    expr = _decorated_sql().replace("''''''", "\\'\\'\\'")
    return table(spark, sf, "documents").select("doc_id", F.expr(expr).alias("marked"))


_FURNITURE = r"regexp_matches(marked, '(?i)^\s*(?:\[\[\s*(?:File|Image|Media)\s*:|[!|]|\{\||\{\{|==)')"


@query(f"with m as (select doc_id, {_decorated_sql()} as marked from documents) select doc_id, {_FURNITURE} as furniture from m")
def furniture_filter(spark, sf):
    return _decorated(spark, sf).select("doc_id", T.is_furniture(F.col("marked")).alias("furniture"))


_UNLINK = r"marked"
for _ in range(3):
    _UNLINK = rf"regexp_replace({_UNLINK}, '\[\[(?:[^\[\]|]*\|([^\[\]]+)|([^\[\]|]*)\|?)\]\]', '\1\2', 'g')"
_STRIPPED = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_UNLINK}, '\[(?:https?|ftp)://[^\s\]]*(?:\s+([^\]]*))?\]', '\1', 'g'), '''{{2,5}}', '', 'g'), '\[\[|\]\]|\{{\{{|\}}\}}|\{{\||\|\}}', '', 'g'), '[ \t]+', ' ', 'g'))"


@query(f"with m as (select doc_id, {_decorated_sql()} as marked from documents) select doc_id, {_STRIPPED} as prose from m")
def strip_markup(spark, sf):
    return _decorated(spark, sf).select("doc_id", T.strip_markup(F.col("marked"), nested=False).alias("prose"))


@query()
def strip_markup_whole(spark, sf):
    """strip_markup with embedded media and templates removed first, which its SQL leaves out."""
    return _decorated(spark, sf).select("doc_id", T.strip_markup(F.col("marked")).alias("prose"))


@query(rf"""with m as (select doc_id, {_decorated_sql()} as marked from documents),
n as (select doc_id, regexp_replace(regexp_replace(marked, '\[\[\s*(?i:File|Image|Media)\s*:[^\[\]]*\]\]', '', 'g'), '\{{\{{[^{{}}]*\}}\}}', '', 'g') as marked from m)
select doc_id, marked as kept from n""")
def remove_nested(spark, sf):
    return _decorated(spark, sf).select("doc_id", T.drop_spans(F.col("marked")).alias("kept"))


@query(r"""select doc_id, trim(case when regexp_extract(substr(text, 1, 200), '(?s)^(.*?[.!?])\s', 1) <> '' then regexp_extract(substr(text, 1, 200), '(?s)^(.*?[.!?])\s', 1)
  else substr(text, 1, 200) end, ' ' || chr(10)) as first_sentence from documents""")
def first_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("first_sentence"))


@query(r"""with f as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat from documents)
select doc_id, case when length(flat) <= 220 then flat else rtrim(substr(flat, 1, 220)) || '...' end as snippet from f""")
def snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


_CURID = "try_cast(nullif(regexp_extract(replace(url, 'page=', 'curid='), 'curid=(\\d+)', 1), '') as bigint)"


@query(f"select page_id, {_CURID} as curid from pages where {_CURID} is not null")
def curid(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.curid(F.replace(F.col("url"), F.lit("page="), F.lit("curid="))).alias("curid")).where("curid is not null")


@query(f"select page_id, coalesce('{T.ARTICLE_URL}' || {_CURID}, url, '') as result_url from pages")
def result_url(spark, sf):
    known = T.curid(F.replace(F.col("url"), F.lit("page="), F.lit("curid=")))
    return table(spark, sf, "pages").select("page_id", T.result_url(known, F.col("url")).alias("result_url"))


@query("select doc_id from documents where len(regexp_extract_all(text, '\\S+')) > 3 and len(regexp_extract_all(lang || ' ' || source, '\\S+')) > 1")
def triplet_word_filter(spark, sf):
    rows = table(spark, sf, "documents")
    return rows.where(T.enough_words([F.col("text")]) & T.enough_words([F.concat_ws(" ", "lang", "source")], 1)).select("doc_id")


# ---- SQL dumps and the link graph

def _insert(spark, sf, name: str, tuple_of: str, key: str):
    """INSERT lines of up to 100 tuples made of a table's rows."""
    rows = table(spark, sf, name).select(F.floor(F.col(key) / 100).alias("line_no"), F.expr(tuple_of).alias("t"))
    return rows.groupBy("line_no").agg(F.concat(F.lit("INSERT INTO `x` VALUES "), F.array_join(F.sort_array(F.collect_list("t")), ","), F.lit(";")).alias("line"))


def _page_lines(spark, sf):
    return _insert(spark, sf, "part", rf"concat('(', p_partkey, ',0,\'', replace(p_name, ' ', '_'), '_\\\'s_', p_partkey, '\',0)')", "p_partkey")


def _link_lines(spark, sf):
    return _insert(spark, sf, "lineitem", "concat('(', l_partkey, ',', if(l_linenumber = 4, 1, 0), ',', l_orderkey, ')')", "l_orderkey")


def _target_lines(spark, sf):
    return _insert(spark, sf, "orders", r"concat('(', o_orderkey, ',', pmod(o_orderkey, 3), ',\'', replace(o_orderpriority, ' ', '_'), '_', pmod(o_orderkey, 97), '\')')", "o_orderkey")


_PAGES = "dump_pages as (select p_partkey as page_id, replace(p_name, '_', ' ') || ' ''s ' || p_partkey as title from part)"
_PAGELINKS = "dump_links as (select l_partkey as from_id, l_orderkey as to_id from lineitem where l_linenumber <> 4)"
_TARGETS = "dump_targets as (select o_orderkey as lt_id, replace(o_orderpriority, '_', ' ') || ' ' || (o_orderkey % 97) as lt_title from orders)"
_EDGES = "edges as (select title as from_title, lt_title as to_title from dump_links join dump_pages on from_id = page_id join dump_targets on to_id = lt_id)"


@query(f"with {_PAGES} select page_id, title from dump_pages")
def dump_page(spark, sf):
    return readers.parse_pages(_page_lines(spark, sf), whole_titles=True)


@query(f"with {_PAGELINKS} select from_id, to_id from dump_links")
def dump_pagelinks(spark, sf):
    return readers.parse_page_links(_link_lines(spark, sf))


@query(f"with {_TARGETS} select lt_id, lt_title from dump_targets")
def dump_linktarget(spark, sf):
    return readers.parse_link_targets(_target_lines(spark, sf))


@query(r"""select doc_id, text as unescaped from documents""")
def mysql_unescape(spark, sf):
    """Every text, escaped as a dump does and unescaped again."""
    c = F.col("text")
    for plain, escape in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(escape))
    return table(spark, sf, "documents").select("doc_id", T.sql_unescape(c).alias("unescaped"))


def _edges(spark, sf):
    return linkgraph.edges(readers.parse_pages(_page_lines(spark, sf)), readers.parse_page_links(_link_lines(spark, sf)), readers.parse_link_targets(_target_lines(spark, sf)))


@query(f"with {_PAGES}, {_PAGELINKS}, {_TARGETS}, {_EDGES} select from_title, to_title, count(*) as n from edges group by 1, 2")
def linkgraph_join(spark, sf):
    return _edges(spark, sf).groupBy("from_title", "to_title").agg(F.count("*").alias("n"))


@query(f"with {_PAGES}, {_PAGELINKS}, {_TARGETS}, {_EDGES} select from_title, string_agg(to_title, '|' order by to_title) as linked_titles from edges group by 1")
def adjacency(spark, sf):
    return linkgraph.adjacency(_edges(spark, sf)).select("from_title", F.array_join("linked_titles", "|").alias("linked_titles"))


@query(f"with {_LINKS} select page_id, pos::int as pos, target from links")
def page_links(spark, sf):
    return _links(spark, sf)


@query(f"with {_LINKS} select title, count from counts")
def backlink_counts(spark, sf):
    return _counts(spark, sf)


@query(f"with {_LINKS}, {_P99} select max_backlinks from p99")
def backlink_p99(spark, sf):
    return linkgraph.top_percentile(_counts(spark, sf))


@query(f"""with {_LINKS}, p as (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages),
o as (select title, string_agg(distinct target, '|' order by target) as linked_titles from p left join links using (page_id) group by title)
select page_id, coalesce(linked_titles, '') as linked_titles from p join o using (title)""")
def outlinks_lookup(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", _page_title(F.col("html")).alias("title"))
    lists = linkgraph.adjacency(_links(spark, sf).join(pages, "page_id").select(F.col("title").alias("from_title"), F.col("target").alias("to_title")))
    return linkgraph.outlinks(pages, lists).select("page_id", F.array_join("linked_titles", "|").alias("linked_titles"))


# ---- passages

def _lines(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.concat_ws("-", F.lit("doc"), "source").alias("article_title"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.where(F.trim("text") != "")


_DENSE = f"""{_SPLIT}, l as (select doc_id, 'doc-' || source as article_title, i - 1 as pos, lines[i] as text from d, unnest(range(1, len(lines) + 1)) as u(i) where trim(lines[i]) <> ''),
dense as (select row_number() over (order by doc_id, pos) - 1 as idx, doc_id, article_title, pos, text from l)"""


@query(f"with {_DENSE} select idx, doc_id, pos::int as pos from dense")
def dense_ids(spark, sf):
    return passages.dense_ids(_lines(spark, sf), ["doc_id", "pos"]).select("idx", "doc_id", "pos")


@query(f"with {_DENSE} select idx // 4096 as seq, min(idx) as first_idx, count(*) as row_count from dense group by 1")
def batch_manifest(spark, sf):
    return passages.batch_manifest(passages.dense_ids(_lines(spark, sf), ["doc_id", "pos"]))


@query(f"with {_DENSE} select idx, article_title, text from dense where idx in (select vec_id * 3 from embeddings)")
def meta_lookup(spark, sf):
    rows = passages.dense_ids(_lines(spark, sf), ["doc_id", "pos"])
    return passages.lookup(rows, table(spark, sf, "embeddings").select((F.col("vec_id") * 3).alias("idx"))).select("idx", "article_title", "text")


_HASHED = lambda source, key: f"""
tokens as (select {key}, unnest(regexp_extract_all(lower(text), '[^ \\t\\n]+')) as w from {source}),
buckets as (select {key}, (('0x' || substr(md5(w), 1, 8))::bigint % 64) as b, count(*)::double as n from tokens group by 1, 2),
norms as (select {key}, sqrt(sum(n * n)) as norm from buckets group by 1)"""  # noqa: E731


@query(f"with {_HASHED('documents', 'doc_id')} select doc_id, b as bucket, round(n / norm, 6) as weight from buckets join norms using (doc_id)")
def encode_hashed(spark, sf):
    encoded = table(spark, sf, "documents").select("doc_id", encode.hashed_words(F.col("text")).alias("vec"))
    rows = encoded.select("doc_id", F.posexplode("vec").alias("bucket", "weight"))
    return rows.where("weight > 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("weight", 6).alias("weight"))


@query(f"""with {_HASHED('documents', 'doc_id')}, {_HASHED('benchmark', 'item_id').replace('tokens', 'q_tokens').replace('buckets', 'q_buckets').replace('norms', 'q_norms')},
s as (select item_id, doc_id, round(sum(q.n * d.n / (qn.norm * dn.norm)), 9) as score from q_buckets q join buckets d on q.b = d.b join q_norms qn using (item_id) join norms dn using (doc_id) group by 1, 2),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s)
select item_id, rank::int as rank, doc_id, round(score, 6) as score from r where rank <= 5""")
def text_search_hashed(spark, sf):
    # a null text has no words to share, and no vector
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("idx"), encode.hashed_words(F.col("text")).alias("embedding"))
    asked = table(spark, sf, "benchmark").where("text is not null").select(F.col("item_id").alias("qid"), encode.hashed_words(F.col("text")).alias("vec"))
    top = index.search_blocks(docs, asked, 5, measure="dot").where("distance < 0")
    return top.select(F.col("qid").alias("item_id"), (F.col("rank_pos") + 1).alias("rank"), F.col("idx").alias("doc_id"), F.round(-F.col("distance"), 6).alias("score"))


# ---- evaluation corpus: benchmark items ask for the articles that hold them

def _benchmark_queries(spark, sf):
    docs = table(spark, sf, "documents").select(F.struct("doc_id", F.concat_ws("-", F.lit("doc"), "source").alias("title")).alias("key"), F.col("text").alias("body"))
    asked = table(spark, sf, "benchmark")
    met = contain.containing(docs, asked.select(F.col("item_id").alias("item"), F.col("text").alias("part")))
    titles = met.groupBy("item").agg(F.array_sort(F.collect_set("key.title")).alias("found"))
    every = asked.join(titles, F.col("item_id") == F.col("item"), "left")
    return every.select(F.col("item_id").alias("qid"), F.col("text").alias("query"), F.coalesce("found", F.array().cast("array<string>")).alias("relevant_articles"))


_ASKED = "asked as (select distinct item_id, 'doc-' || source as title from benchmark b join documents d on contains(d.text, b.text))"


@query(f"""with {_DENSE}, {_ASKED},
own as (select idx, row_number() over (partition by article_title order by idx) as place from dense where article_title in (select title from asked)),
firsts as (select idx from own where place <= 20),
others as (select idx from dense where idx not in (select idx from firsts) order by md5(concat_ws('|', '42', idx::varchar)), idx limit 500)
select idx, true as relevant from firsts union all select idx, false from others""")
def ir_corpus(spark, sf):
    rows = passages.dense_ids(_lines(spark, sf), ["doc_id", "pos"])
    return metrics.evaluation_corpus(rows, _benchmark_queries(spark, sf), distractors=500).select("idx", "relevant")


@query(f"with {_ASKED} select item_id as qid, string_agg(title, '|' order by title) as relevant_articles from asked group by 1")
def ir_answerable_queries(spark, sf):
    found = metrics.answerable(_benchmark_queries(spark, sf), _lines(spark, sf))
    return found.select("qid", F.array_join("relevant_articles", "|").alias("relevant_articles"))


# ---- mining

_MINED = f"""{_SPLIT}, l as (select doc_id, i, trim(lines[i]) as line from d, unnest(range(1, len(lines) + 1)) as u(i) where length(text) >= 100),
p as (select doc_id, i, line, row_number() over (partition by doc_id order by i) - 1 as pos, count(*) over (partition by doc_id) as n from l where length(line) > 30 and len(regexp_extract_all(line, '\\S+')) >= 15)"""


def _minable(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("title"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("content"), F.length("text").alias("size"))
    return mining.mining_articles(rows.where(F.col("size") >= DEFAULT.mining.min_text_chars))


@query(f"with {_MINED} select doc_id, count(*)::int as n_paragraphs from p where n >= 2 group by 1")
def mining_articles(spark, sf):
    return _minable(spark, sf).select(F.col("title").cast("long").alias("doc_id"), F.size("paragraphs").alias("n_paragraphs"))


@query(f"with {_MINED} select doc_id, doc_id::varchar as anchor, pos::int as pos, line as positive from p where n >= 2 and pos < 10")
def mining_anchors(spark, sf):
    return mining.anchors(_minable(spark, sf)).select(F.col("title").cast("long").alias("doc_id"), "anchor", "pos", "positive")


def _band(spark, sf):
    return mining.negative_band(index.search_flat(_vectors(spark, sf), _asked(spark, sf), BAND.rank_max), BAND)


@query(f"with {_FLAT} select qid, idx, rank_pos from near where rank_pos >= {BAND.rank_min} and rank_pos < {BAND.rank_max}")
def negative_band(spark, sf):
    return _band(spark, sf).select("qid", "idx", "rank_pos")


def _long_passages(spark, sf):
    return _passages(spark, sf).select("idx", "title", F.concat(F.col("text"), F.lit(" with enough characters to be mined")).alias("text"), "embedding")


def _triplets(spark, sf):
    """The positives of each query: the other passages of its article with the smallest idx, as many as an article may have."""
    rows = _long_passages(spark, sf)
    own = rows.join(_asked(spark, sf).select(F.col("qid").alias("of_qid")), F.col("idx") == F.col("of_qid")).select(F.col("idx").alias("qid"), F.col("title").alias("of_title"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("idx"))
    met = own.join(rows, F.col("title") == F.col("of_title")).where(F.col("idx") != F.col("qid")).withColumn("place", place).where(F.col("place") <= DEFAULT.mining.triplets_per_article)
    positives = met.select((F.col("qid") * 100 + F.col("place")).alias("key"), "qid", "title", F.col("title").alias("anchor"), F.col("text").alias("positive"), F.col("idx").alias("positive_idx"))
    linked = _links(spark, sf).join(_titles(spark, sf), F.pmod(F.col("page_id"), F.lit(10)) == F.col("label")).select(F.col("title").alias("from_title"), F.col("target").alias("to_title"))
    found = mining.triplets(positives.drop("positive_idx"), _band(spark, sf), rows, linked, settings=BAND)
    return found, positives


_TRIPLETS = f"""{_FLAT}, {_LINKS}, {_TITLES},
passage as (select vec_id as idx, title, 'passage ' || vec_id || ' with enough characters to be mined' as text, embedding from embeddings join titles using (label)),
positives as (select qid * 100 + place as key, qid, title, text as positive, idx as positive_idx from (
  select q.idx as qid, p.idx, p.title, p.text, row_number() over (partition by q.idx order by p.idx) as place from passage q join passage p on p.title = q.title and p.idx <> q.idx where q.idx % {EVERY} = 0) where place <= {DEFAULT.mining.triplets_per_article}),
band as (select qid, idx from near where rank_pos >= {BAND.rank_min} and rank_pos < {BAND.rank_max}),
sampled as (select * from (select key, title, positive, positive_idx, qid, idx, row_number() over (partition by key order by md5(concat_ws('|', '42', key::varchar, idx::varchar)), idx) as place from positives join band using (qid)) where place <= {BAND.pool}),
linked as (select distinct t.title as from_title, target as to_title from links join titles t on t.label = page_id % 10),
free as (select s.*, p.text as negative from sampled s join passage p using (idx) where p.title <> s.title and p.text <> s.positive and length(p.text) > 30
         and not exists (select 1 from linked where from_title = s.title and to_title = p.title)),
triplets as (select * from (select *, row_number() over (partition by key order by md5(concat_ws('|', '42', 'pick', key::varchar, idx::varchar)), idx) as pick from free) where pick = 1)"""


@query(f"with {_TRIPLETS} select key, idx, title as anchor, positive, negative, title as source, '' as url from triplets")
def triplets(spark, sf):
    return _triplets(spark, sf)[0]


@query(f"with {_TRIPLETS} select distinct title as anchor from triplets")
def distinct_anchors(spark, sf):
    return mining.distinct_anchors(_triplets(spark, sf)[0])


def _triplet_vectors(spark, sf):
    found, positives = _triplets(spark, sf)
    rows = _vectors(spark, sf)
    vector = lambda name, key: rows.select(F.col("idx").alias(key), F.col("embedding").alias(name))
    met = found.join(positives.select("key", "qid", "positive_idx"), "key")
    return met.join(vector("a", "ia"), F.col("qid") == F.col("ia")).join(vector("p", "ip"), F.col("positive_idx") == F.col("ip")).join(vector("n", "in"), F.col("idx") == F.col("in")).select("a", "p", "n")


_MEASURED = f"""with {_TRIPLETS}, v as (select list_cosine_similarity(a.embedding::double[], p.embedding::double[]) as pos, list_cosine_similarity(a.embedding::double[], n.embedding::double[]) as neg,
  greatest(list_distance(a.embedding::double[], p.embedding::double[]) ** 2 - list_distance(a.embedding::double[], n.embedding::double[]) ** 2 + 0.3, 0) as loss
  from triplets t join embeddings a on a.vec_id = t.qid join embeddings p on p.vec_id = positive_idx join embeddings n on n.vec_id = idx)"""


@query(f"""{_MEASURED} select count(*) as triplets, round(avg(pos), 6) as cos_positive, round(avg(neg), 6) as cos_negative, round(avg((neg > pos)::int), 6) as inverted,
  round(avg((neg > 0.9)::int), 6) as near_duplicate, round(avg((pos > neg)::int), 6) as accuracy, round(avg(loss), 6) as loss from v""")
def triplet_diagnostics(spark, sf):
    return metrics.triplet_measures(_triplet_vectors(spark, sf))


@query(f"{_MEASURED} select round(avg((pos > neg)::int), 6) as accuracy from v")
def triplet_accuracy(spark, sf):
    return metrics.triplet_measures(_triplet_vectors(spark, sf)).select("accuracy")


@query(f"{_MEASURED} select round(avg(loss), 6) as loss from v")
def triplet_loss(spark, sf):
    return metrics.triplet_measures(_triplet_vectors(spark, sf)).select("loss")


@query("""with f as (select *, dense_rank() over (order by source) as file_no from documents)
select doc_id, case when file_no <= least(3, (select count(distinct source) from documents) - 1) then 'held out' else 'train' end as split from f""")
def holdout_split(spark, sf):
    """Sources stand for files: the first three by name are held out, but never all."""
    rows = table(spark, sf, "documents").select("doc_id", "source")
    names = rows.select("source").distinct()
    # the first four tell whether there are more than three
    first = names.orderBy("source").limit(4)
    some = first.withColumn("n", F.count("*").over(Window.partitionBy())).withColumn("place", F.row_number().over(Window.orderBy("source"))).where(F.col("place") <= F.least(F.lit(3), F.col("n") - 1))
    held = some.select(F.col("source").alias("held"))
    return rows.join(held, F.col("source") == F.col("held"), "left").select("doc_id", F.when(F.col("held").isNotNull(), "held out").otherwise("train").alias("split"))


# ---- exports

_TITLE = "'doc-' || source || '-' || (doc_id % 50)"


@query(f"select {_TITLE} as title, 'http://x.example.com/?curid=' || max(doc_id) as url from documents group by 1")
def article_titles(spark, sf):
    return export.article_titles(_articles(spark, sf), F.col("doc_id"))


def _kv(spark, sf, whole=False):
    rows = _decorated(spark, sf).join(_articles(spark, sf).select("doc_id", "title"), "doc_id")
    every = rows.select(F.col("doc_id").alias("idx"), F.col("title").alias("article_title"), F.col("marked").alias("text"))
    ids = export.curids(export.article_titles(_articles(spark, sf), F.col("doc_id")))
    return export.key_values(every, ids if whole else ids.where(F.col("curid") % 7 != 0), nested=whole)


_KV = f"""with m as (select doc_id, {_TITLE} as title, {_decorated_sql()} as marked from documents),
ids as (select title, curid from (select {_TITLE} as title, max(doc_id) as curid from documents group by 1) where curid % 7 <> 0),
kv as (select doc_id as idx, m.title, marked, curid, case when not {_FURNITURE} and {_STRIPPED} <> '' then {_STRIPPED} end as prose from m left join ids using (title))"""


@query(f"""{_KV} select idx, case when curid is null then to_json({{'Item': {{'idx': {{'N': idx::varchar}}, 'text': {{'S': prose}}, 'title': {{'S': title}}}}}})::varchar
  else to_json({{'Item': {{'idx': {{'N': idx::varchar}}, 'text': {{'S': prose}}, 'title': {{'S': title}}, 'curid': {{'N': curid::varchar}}}}}})::varchar end as item from kv where prose is not null""")
def kv_export(spark, sf):
    return export.items(_kv(spark, sf))


@query()
def kv_export_whole(spark, sf):
    """kv_export with embedded media and templates removed from its prose and with all curids, which its SQL leaves out."""
    return export.items(_kv(spark, sf, whole=True))


@query(f"""{_KV} select count(*) as n_read, count(prose) as n_written, count(*) - count(prose) as n_dropped, count(*) filter (where prose <> marked) as n_cleaned,
  count(*) filter (where prose is not null and curid is null) as n_missing_curid from kv""")
def kv_export_counters(spark, sf):
    return export.counters(_kv(spark, sf))


@query()
def kv_export_counters_whole(spark, sf):
    """The counters of kv_export_whole."""
    return export.counters(_kv(spark, sf, whole=True))
