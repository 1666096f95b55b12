"""Named analyses over `documents` (author = source, work = doc_id, factor = lang), each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import corpus as C
from quillmark.operators import delta as D
from quillmark.operators import segments as S
from quillmark.operators import vocabulary as V
from quillmark.plans import studies as ST
from quillmark.queries.evaluation import _VALUES, SCORES, scores
from quillmark.queries.models import UNIT
from quillmark.queries.registry import ORACLE_SQL, documents, query, works
from quillmark.queries.vocabulary import REL, STATS

# French documents are outsiders to a panel of three languages.
PANEL = ["de", "en", "es"]
INSIDE = f"{SCORES}, ins AS (SELECT work_id, true_label <> 'fr' AS member, label, p / sum(p) OVER (PARTITION BY work_id) AS p FROM sc WHERE label IN ('de', 'en', 'es')), ty AS (SELECT work_id, any_value(member) AS member, max(p) AS max_prob, list_sum((list(p ORDER BY p DESC))[1:2]) AS top2_mass, (list(p ORDER BY p DESC))[1] - (list(p ORDER BY p DESC))[2] AS margin, sum(p * ln(p)) AS neg_entropy FROM ins GROUP BY work_id)"


def inside(spark, d):
    return S.restrict(scores(spark, d), PANEL, ["work_id"])


@query(f"WITH {INSIDE} SELECT work_id, max_prob, top2_mass, margin, neg_entropy FROM ty", "max_prob top2_mass margin neg_entropy")
def typicality(spark, d):
    return ST.typicality(inside(spark, d))


@query(f"WITH {SCORES} SELECT work_id, -sum(p * log2(p)) AS bits FROM sc GROUP BY work_id", "bits")
def posterior_entropy(spark, d):
    return ST.posterior_entropy(scores(spark, d))


@query(f"WITH {INSIDE}, lo AS (SELECT measure, round(score, 9) AS s, member FROM (UNPIVOT (SELECT * EXCLUDE (work_id) FROM ty) ON max_prob, top2_mass, margin, neg_entropy INTO NAME measure VALUE score)), g AS (SELECT measure, s, count(*) FILTER (member) AS p, count(*) FILTER (NOT member) AS q FROM lo GROUP BY ALL), a AS (SELECT measure, sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS auc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY measure ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) GROUP BY measure) SELECT measure, auc, median(s) FILTER (member) AS median_member, median(s) FILTER (NOT member) AS median_outsider FROM lo JOIN a USING (measure) GROUP BY ALL", "auc median_member median_outsider")
def outsider_auc(spark, d):
    member = scores(spark, d).select("work_id", (F.col("true_label") != "fr").alias("member")).distinct()
    return ST.outsider_auc(ST.typicality(inside(spark, d)).join(member, "work_id"))


def level_scores(spark, d):
    """Candidates and each work's scores by works of other languages."""
    return ST.cross_level_shares(C.works(documents(spark, d), keep=[F.coalesce("lang", F.lit("<missing>")).alias("level")]), 150)


def by_delta(spark, d):
    return D.nearest(D.distances(D.space(works(spark, d), 150), held_out=True))


@query(f"SELECT author, count(*) FILTER (author = candidate) AS \"right\", count(*) AS works, avg(CAST(author = candidate AS INT)) AS rate FROM ({ORACLE_SQL['delta_held_out']}) GROUP BY author", "rate")
def self_attribution(spark, d):
    return ST.self_rate(by_delta(spark, d))


@query(f"WITH <works>, <counts>, {STATS}, s AS (SELECT author AS candidate, term, sum(z) AS s, count(*) AS n FROM z GROUP BY ALL), x AS (SELECT work_id, z.author, candidate, z, CASE WHEN z.author = candidate THEN (s - z) / (n - 1) ELSE s / n END AS c FROM z JOIN s USING (term) WHERE z.author <> candidate OR n > 1) SELECT work_id, author, candidate, 1 - sum(z * c) / (sqrt(sum(z * z)) * sqrt(sum(c * c))) AS distance FROM x GROUP BY ALL", "distance")
def delta_cosine_held_out(spark, d):
    return D.distances(D.space(works(spark, d), 150), "cosine", held_out=True)


@query("WITH f AS (SELECT 'lang' AS factor, source AS a, nullif(lang, '') AS v FROM documents UNION ALL SELECT 'own', source, 's_' || source FROM documents), c AS (SELECT factor, count(*) = count(v) AS complete FROM f GROUP BY factor), fa AS (SELECT factor, bool_and(k = 1) AS fa FROM (SELECT factor, v, count(DISTINCT a) AS k FROM f GROUP BY ALL) GROUP BY factor), af AS (SELECT factor, bool_and(k = 1) AS af FROM (SELECT factor, a, count(DISTINCT v) AS k FROM f GROUP BY ALL) GROUP BY factor) SELECT factor, complete, complete AND fa AS author_determined_by_factor, complete AND af AS factor_determined_by_author, complete AND fa AND af AS perfect_confound FROM c JOIN fa USING (factor) JOIN af USING (factor)")
def factor_identifiability(spark, d):
    rows = documents(spark, d).select(F.col("source").alias("author"), "lang", F.concat(F.lit("s_"), "source").alias("own"))
    return ST.identifiability(rows, ["lang", "own"])


@query(f"WITH <works>, <counts>, {REL}, {UNIT}, lv AS (SELECT doc_id AS work_id, coalesce(lang, '<missing>') AS level FROM documents), part AS (SELECT author AS candidate, level, term, sum(value) AS s FROM unit JOIN lv USING (work_id) GROUP BY ALL), rest AS (SELECT candidate, e.level, term, sum(s) AS s FROM part JOIN (SELECT DISTINCT level FROM lv) e ON part.level <> e.level GROUP BY ALL), q AS (SELECT candidate, level, sqrt(sum(s * s)) AS q FROM rest GROUP BY ALL), sc AS (SELECT work_id, author, level, candidate, sum(value * coalesce(rest.s, 0)) / any_value(q) AS score FROM unit JOIN lv USING (work_id) JOIN (SELECT DISTINCT candidate, term FROM part) USING (term) JOIN q USING (candidate, level) LEFT JOIN rest USING (candidate, level, term) GROUP BY ALL) SELECT work_id, author, level, candidate, score FROM sc", "score")
def cross_level_scores(spark, d):
    return ST.long_scores(*level_scores(spark, d))


@query(f"SELECT author, level, count(*) AS works, count(*) FILTER (candidate = author) AS \"right\" FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY score DESC, candidate) AS r FROM ({ORACLE_SQL['cross_level_scores']})) WHERE r = 1 GROUP BY ALL")
def cross_level_recall(spark, d):
    return ST.best_of_scores(*level_scores(spark, d), 6)


@query(f"WITH da AS ({ORACLE_SQL['delta_held_out']}), co AS (SELECT work_id, author, candidate FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY score DESC, candidate) AS r FROM ({ORACLE_SQL['cosine_held_out']})) WHERE r = 1), j AS (SELECT da.author, CAST(da.candidate = da.author AS INT) AS x, CAST(co.candidate = co.author AS INT) AS y FROM da JOIN co USING (work_id)), s AS (SELECT author, row_number() OVER (ORDER BY author) - 1 AS u, sum(x - y) AS num, count(*) AS den FROM j GROUP BY author), dr(draw, u, times) AS (VALUES {_VALUES}), v AS (SELECT draw, sum(num * times) / sum(den * times) AS v FROM s JOIN dr USING (u) GROUP BY draw), e AS (SELECT median(v) AS median, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, avg(CAST(v <= 0 AS INT)) AS share_at_most_zero FROM v), n AS (SELECT count(*) AS works, avg(x) AS accuracy_a, avg(y) AS accuracy_b, CAST(sum(x * (1 - y)) AS BIGINT) AS only_a, CAST(sum((1 - x) * y) AS BIGINT) AS only_b FROM j), m AS (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) AS tail FROM (SELECT only_a AS b, only_b AS c, unnest(range(0, least(only_a, only_b) + 1)) AS i FROM n)) SELECT works, accuracy_a, accuracy_b, only_a, only_b, CASE WHEN only_a + only_b = 0 THEN 1 ELSE least(1, 2 * tail) END AS mcnemar_p, median, lo, hi, NOT (lo <= 0 AND hi >= 0) AS significant, share_at_most_zero FROM n, m, e", "accuracy_a accuracy_b mcnemar_p median lo hi share_at_most_zero")
def clustered_comparison(spark, d):
    """Frequency distance against cosine, both on held-out works; 100 draws, so that SQL can list them."""
    space = D.space(works(spark, d), 150)
    best = F.min(F.struct((-F.round("score", 6)).alias("neg"), F.col("candidate")))
    cosine = D.held_out_cosines(space).groupBy("work_id", "author").agg(best["candidate"].alias("candidate"))
    mark = lambda p: V.hoisted(p.select("work_id", "author", (F.col("candidate") == F.col("author")).alias("correct")))
    return ST.clustered_comparison(mark(D.nearest(D.distances(space, held_out=True))), mark(cosine), 100)
