"""All queries of the engine and their SQL.

Each entry is a function of (spark, sf_dir) and, where SQL can express it, the same in DuckDB's SQL. Scores are rounded to six
places on both sides; ranking uses unrounded values.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import distances as D
from lodestar.functions import pixels as P
from lodestar.functions import scalar as S
from lodestar.functions import stemming
from lodestar.functions.arrays import drop_range, subtract, total, zero_dimension
from lodestar.operators import clustering as C
from lodestar.operators import evaluate as V
from lodestar.operators import features as X
from lodestar.operators import named as N
from lodestar.operators import rerank as RR
from lodestar.operators import retrieval as R
from lodestar.operators import sparse as SP
from lodestar.operators.steps import shared_folder
from lodestar.plans.fixtures import EU, FID, JSD, OBJ, QS, centres, local_rows, objects, parts, queries as examples, r6, s6, table, zs
from lodestar.sources import formats as FM
from lodestar.streaming import ingest as ST

Q: dict = {}
SQL: dict[str, str] = {}


def add(name: str, f, sql: str | None = None) -> None:
    Q[name] = f
    if sql:
        SQL[name] = sql


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict:
    return dict(SQL)


# Distances: the first three objects against all.


def _asked(spark):
    return spark.createDataFrame([(i, i, 1) for i in range(3)], "qid int, idx long, sign int")


def _dist(column, f):
    def run(spark, sf):
        return R.distances(objects(spark, sf), _asked(spark), [(column, f)]).select("q", "idx", r6(F.col("d0")).alias("dist"))

    return run


def _dist_sql(expr: str) -> str:
    return f"WITH {OBJ} SELECT q.idx AS q, o.idx AS idx, {s6(expr)} AS dist FROM obj o, obj q WHERE q.idx IN (0, 1, 2)"


_F = zs(FID, "o.h", "q.h")
_N = "sqrt(list_sum(list_transform({0}, lambda x: x*x)))"
for _name, _col, _f, _expr in (
    ("base", "v", D.zero, "0.0::DOUBLE"),
    ("euclidean", "v", D.euclidean, zs(EU, "o.v", "q.v")),
    ("l1", "v", D.l1, zs("abs(t[1]-t[2])", "o.v", "q.v")),
    ("weightedeuclidean", "v", lambda a, b: D.weighted_euclidean(a, b, 0.9), f"2*0.1*{zs(EU, 'o.v[1:62]', 'q.v[1:62]')}+2*0.9*{zs(EU, 'o.v[63:64]', 'q.v[63:64]')}"),
    ("weightedl1", "v", lambda a, b: D.weighted_l1(a, b, [1 / (i + 1) for i in range(64)]), "list_sum(list_transform(list_zip(o.v, q.v, range(64)), lambda t: abs(t[1]-t[2])/(t[3]+1)))"),
    ("chisquare", "h", D.chisquare, zs("CASE WHEN t[1]+t[2]<>0 THEN (t[1]-t[2])*(t[1]-t[2])/(t[1]+t[2]) ELSE 0 END", "o.h", "q.h")),
    ("his", "h", D.histogram_intersection, f"1-{zs('least(t[1],t[2])', 'o.h', 'q.h')}"),
    ("jsd", "h", D.jsd, zs(JSD, "o.h", "q.h")),
    ("kld", "h", D.kld, zs("CASE WHEN t[1]>0 AND t[2]>0 THEN t[1]*ln(t[1]/t[2]) ELSE 0 END", "o.h", "q.h")),
    ("reldev", "v", D.relative_deviation, f"coalesce(sqrt({zs(EU, 'o.v', 'q.v')})/nullif(0.5*({_N.format('o.v')}+{_N.format('q.v')}),0),0)"),
    ("relbindev", "h", D.relative_bin_deviation, f"{zs('coalesce(abs(t[1]-t[2])/nullif(0.5*(t[1]*t[1]+t[2]*t[2]),0),0)', 'o.h', 'q.h')}/64"),
    ("fidelity", "h", D.one_minus_fidelity, f"1-{_F}"),
    ("sqrtfid", "h", D.sqrt_one_minus_fidelity, f"sqrt(greatest(1-{_F},0))"),
    ("logfid", "h", D.log_two_minus_fidelity, f"ln(2-{_F})"),
    ("arccosfid", "h", D.arccos_fidelity, f"2/pi()*acos(least({_F},1))"),
    ("sinfid", "h", D.sin_fidelity, f"sqrt(greatest(1-{_F}*{_F},0))"),
    ("sinfid_compat", "h", lambda a, b: D.sin_fidelity(a, b, compat=True), f"sqrt(greatest(1-{_F},0))"),
    ("binary", "flag", D.binary, "CASE WHEN (o.v[1]>0)=(q.v[1]>0) THEN 0.0 ELSE 1.0 END"),
    ("crosscorrelation", "v", lambda a, b: D.cross_correlation_1d(a, b, 2), f"1-coalesce(greatest({', '.join(zs('t[1]*t[2]', f'o.v[{1 + max(s, 0)}:{64 - max(-s, 0)}]', f'q.v[{1 + max(-s, 0)}:{64 - max(s, 0)}]') for s in range(-2, 3))})/nullif({_N.format('o.v')}*{_N.format('q.v')},0),0)"),
    ("face_one", "lf", lambda a, b: D.faces(a, b, "one"), f"(SELECT min({zs(EU, 'o.v[1+8*i:8+8*i]', 'q.v[1+8*j:8+8*j]')}) FROM range(8) a(i), range(8) b(j))"),
    ("face_all", "lf", lambda a, b: D.faces(a, b, "all"), f"(SELECT sum(m) FROM (SELECT j, min({zs(EU, 'o.v[1+8*i:8+8*i]', 'q.v[1+8*j:8+8*j]')}) AS m FROM range(8) a(i), range(8) b(j) GROUP BY j))"),
):
    add(f"dist_{_name}", _dist(_col, _f), _dist_sql(_expr))


def _histpair(spark, sf):
    o = objects(spark, sf).select("idx", F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.struct(F.transform("h", lambda x, k: F.when(k % 2 == i, x).otherwise(F.lit(0.0))).alias("fg"), F.transform("h", lambda x, k: F.when(k % 2 == i, F.lit(0.0)).otherwise(x)).alias("bg"))).alias("pair"))
    return R.distances(o, _asked(spark), [("pair", D.histogram_pair)]).select("q", "idx", r6(F.col("d0")).alias("dist"))


_even, _odd = ("list_transform(list_zip({0}.h, range(64)), lambda t: CASE WHEN t[2]%2=" + str(i) + " THEN t[1] ELSE 0.0 END)" for i in (0, 1))
_pair = [f"0.5*{zs(JSD, a.format('o'), b.format('q'))}+0.5*{zs(JSD, c.format('o'), d.format('q'))}" for a, c in ((_even, _odd), (_odd, _even)) for b, d in ((_even, _odd), (_odd, _even))]
add("dist_histpair", _histpair, _dist_sql(f"least({', '.join(_pair)})"))


def _meta(spark, sf):
    p = parts(spark, sf)
    return R.distances(p, spark.createDataFrame([(i, i, 1) for i in (1, 2, 3)], "qid int, idx long, sign int"), [("meta", D.meta)]).select("q", "idx", F.col("d0").alias("dist"))


add("dist_meta", _meta, "SELECT q.p_partkey AS q, o.p_partkey AS idx, (CASE WHEN o.p_brand=q.p_brand THEN 0.0 ELSE 1.0 END)::DOUBLE+(CASE WHEN o.p_type=q.p_type THEN 0 ELSE 1 END)+(CASE WHEN o.p_size=q.p_size THEN 0 ELSE 1 END) AS dist FROM part o, part q WHERE q.p_partkey IN (1,2,3)")


def _glfd(spark, sf):
    local = local_rows(objects(spark, sf))
    asked = local.where("idx in (0, 1)").select(F.col("idx").alias("q"), F.col("x").alias("f"), "v")
    return X.local_hits(local.select("idx", "v"), asked, "v", 10).select("q", "idx", F.col("d").alias("dist"))


add("dist_glfd", _glfd, f"""WITH {OBJ}, lf AS (SELECT idx, i, v[1+8*i:8+8*i] AS v FROM obj, range(8) r(i)),
n AS (SELECT q.idx AS q, q.i AS f, o.idx, row_number() OVER (PARTITION BY q.idx, q.i ORDER BY {zs(EU, 'o.v', 'q.v')}, o.idx) AS r FROM lf o, lf q WHERE q.idx IN (0,1)),
c AS (SELECT q, idx, count(*) AS hits FROM n WHERE r <= 10 GROUP BY 1, 2), t AS (SELECT q, sum(hits) AS total FROM c GROUP BY 1)
SELECT t.q AS q, o.idx AS idx, CAST(total-coalesce(hits,0) AS DOUBLE) AS dist FROM obj o CROSS JOIN t LEFT JOIN c ON c.q=t.q AND c.idx=o.idx""")


# The retrieval pipeline on two features.

FEATURES = [("v", D.euclidean), ("h", D.jsd)]
WEIGHTS = [1.0, 0.5]
LAMBDAS = [[0.2, -0.1, 0.3], [-0.4, 0.1, 0.2]]
LAMBDAS2 = [[0.2, -0.1, 0.05, 0.3], [-0.4, 0.1, 0.02, 0.2]]
LAMBDAS12 = [[0.2, -0.1, 0.05, 0.3, 0.1, 0.2], [-0.4, 0.1, 0.02, 0.2, -0.1, 0.1]]

_D = f"d AS (SELECT qs.qid, qs.sign, qs.q, o.idx, {zs(EU, 'o.v', 'qo.v')} AS d0, {zs(JSD, 'o.h', 'qo.h')} AS d1 FROM qs JOIN obj qo ON qo.idx=qs.q CROSS JOIN obj o)"
_NORM = "n AS (SELECT qid, sign, q, idx, coalesce(d0/nullif(m0,0),d0) AS d0, coalesce(d1/nullif(m1,0),d1) AS d1 FROM (SELECT *, avg(d0) OVER (PARTITION BY qid,q) AS m0, avg(d1) OVER (PARTITION BY qid,q) AS m1 FROM d))"
_S = "s AS (SELECT qid, sign, q, idx, exp(-(1.0*d0+0.5*d1)) AS s FROM n)"
BASE = f"WITH {OBJ}, {QS}, {_D}, {_NORM}, {_S}"


def _normalized(spark, sf):
    return R.normalize(R.distances(objects(spark, sf), examples(spark), FEATURES))


def _scored(spark, sf):
    return R.scored(_normalized(spark, sf), R.linear, WEIGHTS)


add("normalize", lambda sp, sf: _normalized(sp, sf).select("qid", "q", "idx", r6(F.col("d0")).alias("d0"), r6(F.col("d1")).alias("d1")), f"{BASE} SELECT qid, q, idx, {s6('d0')} AS d0, {s6('d1')} AS d1 FROM n")
for _action, _expr in (("min", "least(d0,d1)"), ("max", "greatest(d0,d1)"), ("mul", "d0*d1")):
    add(f"interact_{_action}", lambda sp, sf, a=_action: R.interact(_normalized(sp, sf), f"ACTION={a}(0,1)").select("qid", "q", "idx", r6(F.col("d0")).alias("d0"), r6(F.col("d1")).alias("d1")), f"{BASE} SELECT qid, q, idx, {s6(_expr)} AS d0, {s6(_expr)} AS d1 FROM n")


def _soft(fs: list[str], lam: list[list[float]]) -> str:
    z = ["exp(" + "+".join([*(f"({w})*({f})" for f, w in zip(fs, own, strict=False)), f"({own[-1]})"]) + ")" for own in lam]
    return f"{z[1]}/({z[0]}+{z[1]})"


_products = ["d0*d0", "d0*d1", "d1*d1"]
for _name, _f, _arg, _expr in (
    ("linear", R.linear, (WEIGHTS,), "exp(-(1.0*d0+0.5*d1))"),
    ("maxent", R.maxent, (LAMBDAS,), _soft(["d0", "d1"], LAMBDAS)),
    ("maxent2nd", R.maxent_second, (LAMBDAS2,), _soft(_products, LAMBDAS2)),
    ("maxent1st2nd", R.maxent_first_second, (LAMBDAS12,), _soft(["d0", "d1", *_products], LAMBDAS12)),
    ("svm", R.svm_score, ([-0.5, -0.25], 0.1), "exp(0.1-0.5*d0-0.25*d1)"),
):
    add(f"score_{_name}", lambda sp, sf, f=_f, a=_arg: R.scored(_normalized(sp, sf), f, *a).select("qid", "q", "idx", r6(F.col("s")).alias("score")), f"{BASE} SELECT qid, q, idx, {s6(_expr)} AS score FROM n")

_P, _NG = "CASE WHEN sign>0 THEN {0} END", "CASE WHEN sign<0 THEN {0} END"
_EACH = "1.0/nullif(ln(greatest(s,1e-300))+0.0001,0)"
_MAXP, _MAXN = f"max({_P.format('s')})", f"max({_NG.format('s')})"
SCORESUM = f"coalesce(1.0*sum({_P.format('s')})/nullif(count(*) FILTER (sign>0),0),0)+coalesce(0.8333*sum({_NG.format('1-s')})/nullif(count(*) FILTER (sign<0),0),0)"
COMBINED = {
    "scoresum": (R.score_sum, SCORESUM),
    "nnquot": (R.nearest_quotient, f"coalesce({_MAXP},0)/coalesce(nullif({_MAXN},0),1)"),
    "sumquot": (R.sum_quotient, f"coalesce(sum({_P.format('s')}),0)/coalesce(nullif(sum({_NG.format('s')}),0),1)"),
    "relevance": (R.relevance_score, f"coalesce(1/nullif(1+ln(greatest(coalesce({_MAXP},0),{R.TINY}))/nullif(ln(CASE WHEN count(*) FILTER (sign<0)=0 THEN 1e-200 ELSE greatest({_MAXN},{R.TINY}) END),0),0),0)"),
    "distsumquot_neg": (lambda s: R.distance_sum_quotient(s, "NEGDENOM"), f"coalesce(1/nullif(1+coalesce(sum({_P.format(_EACH)}),0)/nullif(coalesce(sum({_NG.format(_EACH)}),0),0),0),0)"),
    "distsumquot_all": (lambda s: R.distance_sum_quotient(s, "ALLDENOM"), f"coalesce(coalesce(sum({_P.format(_EACH)}),0)/nullif(coalesce(sum({_NG.format(_EACH)}),0)+coalesce(sum({_P.format(_EACH)}),0),0),0)"),
}
for _name, (_f, _expr) in COMBINED.items():
    add(f"comb_{_name}", lambda sp, sf, f=_f: f(_scored(sp, sf)).select("qid", "idx", r6(F.col("score")).alias("score")), f"{BASE} SELECT qid, idx, {s6(_expr)} AS score FROM s GROUP BY qid, idx")

_RANK = "CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx DESC) AS INT)"
_ALL = f"{BASE}, c AS (SELECT qid, idx, {SCORESUM} AS score FROM s GROUP BY qid, idx), r AS (SELECT *, {_RANK} AS rank FROM c)"


def _results(spark, sf):
    return R.score_sum(_scored(spark, sf))


def _shown(df):
    return df.select("qid", "idx", "rank", r6(F.col("score")).alias("score"))


add("retrieve_topk", lambda sp, sf: _shown(R.top(_results(sp, sf), 10)), f"{_ALL} SELECT qid, idx, rank, {s6('score')} AS score FROM r WHERE rank<=10")
add("retrieve_page", lambda sp, sf: _shown(R.page(_results(sp, sf), 2, 10)), f"{_ALL} SELECT qid, idx, rank, {s6('score')} AS score FROM r WHERE rank BETWEEN 21 AND 30")
_AGAIN = _D.replace("d AS", "d2 AS").replace("qs.sign, ", "1 AS sign, ").replace("FROM qs JOIN obj qo ON qo.idx=qs.q", "FROM (SELECT qid, idx AS q FROM r WHERE rank<=3) qs JOIN obj qo ON qo.idx=qs.q")
add(
    "retrieve_expansion",
    lambda sp, sf: _shown(R.top(R.expanded(objects(sp, sf), _results(sp, sf), FEATURES, WEIGHTS, 3), 10)),
    f"{_ALL}, {_AGAIN}, {_NORM.replace('n AS', 'n2 AS').replace('FROM d)', 'FROM d2)')}, c2 AS (SELECT qid, idx, sum(exp(-(1.0*d0+0.5*d1))) AS score FROM n2 GROUP BY 1,2), r2 AS (SELECT *, {_RANK} AS rank FROM c2) SELECT qid, idx, rank, {s6('score')} AS score FROM r2 WHERE rank<=10",
)


def _resolved(spark, sf):
    names = spark.createDataFrame([(0, "o0", 1), (0, "o3", 1), (1, "o5", -1), (1, "nothere", 1)], "qid int, name string, sign int")
    return R.resolve_names(names, objects(spark, sf))


add("resolve_names", _resolved, "SELECT qid, vec_id AS idx, sign FROM (VALUES (0,'o0',1),(0,'o3',1),(1,'o5',-1),(1,'nothere',1)) t(qid,name,sign) JOIN embeddings ON name = 'o'||vec_id")


def _rocchio(spark, sf, compat=False):
    q = R.rocchio_queries(objects(spark, sf), examples(spark), "v", compat=compat)
    pairs = objects(spark, sf).select("idx", F.col("v").alias("a")).crossJoin(F.broadcast(q))
    d = pairs.select("qid", F.lit(1).alias("sign"), F.lit(0).alias("q"), "idx", D.euclidean(F.col("a"), F.col("v")).alias("d0"))
    return _shown(R.top(R.score_sum(R.scored(R.normalize(d), R.linear, [1.0])), 10))


def _rocchio_sql(first: str) -> str:
    return f"""WITH {OBJ}, {QS}, f AS (SELECT qid, min(q) FILTER (sign>0) AS first, count(*) FILTER (sign>0) AS p, count(*) FILTER (sign<0) AS m FROM qs GROUP BY qid),
w AS (SELECT qs.qid, i, sum((CASE WHEN sign<0 THEN -1.0/m WHEN qs.q=first THEN {first} ELSE 1.0/p END)*v[i+1]) AS x FROM qs JOIN f USING (qid) JOIN obj ON obj.idx=qs.q, range(64) r(i) GROUP BY 1,2),
nq AS (SELECT qid, list(x ORDER BY i) AS v FROM w GROUP BY 1), d AS (SELECT qid, o.idx, {zs(EU, 'o.v', 'nq.v')} AS d0 FROM nq, obj o),
c AS (SELECT qid, idx, exp(-d0/avg(d0) OVER (PARTITION BY qid)) AS score FROM d), r AS (SELECT *, {_RANK} AS rank FROM c) SELECT qid, idx, rank, {s6('score')} AS score FROM r WHERE rank<=10"""


add("comb_rocchio", _rocchio, _rocchio_sql("1.0"))
add("comb_rocchio_compat", lambda sp, sf: _rocchio(sp, sf, True), _rocchio_sql("1.0+1.0/p"))
_WD = f"WITH {OBJ}, {QS}, d AS (SELECT qs.qid, qs.sign, o.idx, sqrt({zs(EU, 'o.v', 'qo.v')}) AS d FROM qs JOIN obj qo ON qo.idx=qs.q CROSS JOIN obj o)"
for _name, _mode, _agg in (("wd_unit", "WDRelevanceScore", "min"), ("wd_sumquot", "WDDistSumQuotient", "sum")):
    add(f"comb_{_name}", lambda sp, sf, m=_mode: R.weighted_distance_scores(objects(sp, sf), examples(sp), "v", m).select("qid", "idx", r6(F.col("score")).alias("score")),
        f"{_WD} SELECT qid, idx, {s6(f'coalesce(coalesce({_agg}(CASE WHEN sign<0 THEN d END),1)/nullif({_agg}(CASE WHEN sign>0 THEN d END),0),1e300)')} AS score FROM d GROUP BY 1,2")

_CAS = f"""WITH {OBJ}, {QS}, {_D}, a AS (SELECT qid, sign, q, idx, d1 AS e1, d0/avg(d0) OVER (PARTITION BY qid,q) AS n0 FROM d),
b AS (SELECT *, row_number() OVER (PARTITION BY qid,q ORDER BY exp(-(1.0*n0+0.5*1.0)) DESC, idx DESC)<=100 AS alive FROM a),
g AS (SELECT *, CASE WHEN alive THEN e1 ELSE 1.2*max(e1) FILTER (alive) OVER (PARTITION BY qid,q) END AS x1 FROM b),
s AS (SELECT qid, sign, q, idx, exp(-(1.0*n0/avg(n0) OVER (PARTITION BY qid,q)+0.5*x1/avg(x1) OVER (PARTITION BY qid,q))) AS s FROM g)
SELECT qid, idx, {s6('sum(CASE WHEN sign>0 THEN s ELSE 1-s END)')} AS score FROM s GROUP BY 1,2"""
add("cascade_2stage", lambda sp, sf: R.cascade(objects(sp, sf), examples(sp), [(0, 100), (1, 20)], FEATURES, WEIGHTS).select("qid", "idx", r6(F.col("score")).alias("score")), _CAS)
add("cascade_1stage", lambda sp, sf: R.cascade(objects(sp, sf), examples(sp), [(1, 50)], FEATURES, WEIGHTS).select("qid", "idx", r6(F.col("score")).alias("score")),
    f"WITH {OBJ}, {QS}, {_D}, s AS (SELECT qid, sign, idx, exp(-(1.0+0.5*d1/avg(d1) OVER (PARTITION BY qid,q))) AS s FROM d) SELECT qid, idx, {s6('sum(CASE WHEN sign>0 THEN s ELSE 1-s END)')} AS score FROM s GROUP BY 1,2")
add("proxy_global", lambda sp, sf: _shown(R.federated(objects(sp, sf), F.pmod("idx", F.lit(3)), examples(sp), FEATURES, WEIGHTS, 10)), SQL["retrieve_topk"])
add("proxy_pershard", lambda sp, sf: _shown(R.federated(objects(sp, sf), F.pmod("idx", F.lit(3)), examples(sp), FEATURES, WEIGHTS, 10, True)), SQL["retrieve_topk"].replace("PARTITION BY qid,q)", "PARTITION BY qid,q,idx%3)"))


def _merged(spark, sf):
    a = R.normalize(R.distances(objects(spark, sf), examples(spark), FEATURES[:1]))
    b = R.normalize(R.distances(objects(spark, sf), examples(spark), FEATURES[1:]))
    return R.merge_distances([a, b])


add("merge_distances", lambda sp, sf: _merged(sp, sf).select("qid", "q", "idx", r6(F.col("d0")).alias("d0"), r6(F.col("d1")).alias("d1")), SQL["normalize"])
add("dist_distfile", lambda sp, sf: R.file_distance(_merged(sp, sf), WEIGHTS).select("qid", "q", "idx", r6(F.col("d0")).alias("dist")), f"{BASE} SELECT qid, q, idx, {s6('d0+0.5*d1')} AS dist FROM n")


# Text ranking on documents; queries are benchmark items.

_W = r"[\p{L}\p{N}]+"
_TF = f"tf AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '{_W}')) AS term FROM documents) GROUP BY 1,2)"
_ASK = f"ask AS (SELECT q, term, count(*) AS tf FROM (SELECT item_id AS q, unnest(regexp_extract_all(lower(text), '{_W}')) AS term FROM benchmark WHERE item_id<3) GROUP BY 1,2)"
_DF = "df AS (SELECT term, count(*) AS df, pow(ln((SELECT count(DISTINCT id) FROM tf)/count(*)),2) AS idf FROM tf GROUP BY 1)"
TEXT = f"WITH {_TF}, {_ASK}, {_DF}"


def _tf(spark, sf):
    return SP.terms(table(spark, sf, "documents"), "doc_id", F.col("text"))


def _ask(spark, sf):
    return SP.terms(table(spark, sf, "benchmark").where("item_id < 3"), "item_id", F.col("text")).withColumnRenamed("id", "q")


add("text_tf", _tf, f"{TEXT} SELECT id, term, tf FROM tf")
add("text_idf", lambda sp, sf: SP.document_frequency(_tf(sp, sf)).select("term", "df", r6(F.col("idf")).alias("idf")), f"{TEXT} SELECT term, df, {s6('idf')} AS idf FROM df")
_shared = "{0} FROM tf JOIN ask ON tf.term=ask.term"
_TFIDF = f"{TEXT}, l AS (SELECT id, sum(tf) AS n FROM tf GROUP BY 1), m AS (SELECT q, sum(tf) AS n FROM ask GROUP BY 1) SELECT ask.q AS q, tf.id AS id, {s6('1-sum(sqrt(tf.tf/l.n*(ask.tf/m.n)))')} AS dist FROM tf JOIN ask ON tf.term=ask.term JOIN l ON l.id=tf.id JOIN m ON m.q=ask.q GROUP BY 1,2"
add("text_tfidf", lambda sp, sf: SP.tfidf_distance(_tf(sp, sf), _ask(sp, sf)).select("q", "id", r6(F.col("d")).alias("dist")), _TFIDF)
_LEN = "l AS (SELECT id, sum(tf) AS len, sqrt(sum(tf*tf)) AS dn FROM tf GROUP BY 1), m AS (SELECT q, sqrt(sum(tf*tf)) AS qn FROM ask GROUP BY 1)"
_BM = "bm AS (SELECT ask.q AS q, tf.id AS id, 1-sum(df.idf*2.5*tf.tf/(1.5*(0.32+0.68*l.len/(SELECT avg(len) FROM l))+tf.tf)*9.0*ask.tf/(8.0+ask.tf))/(any_value(m.qn)*any_value(l.dn)) AS d FROM tf JOIN ask ON tf.term=ask.term JOIN df ON df.term=tf.term JOIN l ON l.id=tf.id JOIN m ON m.q=ask.q GROUP BY 1,2)"
add("text_bm25", lambda sp, sf: SP.bm25_distance(_tf(sp, sf), _ask(sp, sf)).select("q", "id", r6(F.col("d")).alias("dist")), f"{TEXT}, {_LEN}, {_BM} SELECT q, id, {s6('d')} AS dist FROM bm")
_SM = f"""{TEXT}, st AS (SELECT id, avg(tf) AS mtf, count(*) FILTER (tf=1) AS singles FROM tf GROUP BY 1)
SELECT ask.q AS q, tf.id AS id, {s6('1-coalesce(sum(((1+(1+ln(tf.tf)))/(1+st.mtf))/nullif(0.8*(SELECT avg(singles) FROM st)+0.3*st.singles,0))/nullif(sum((1+ln(ask.tf))*df.df),0),0)')} AS dist FROM tf JOIN ask ON tf.term=ask.term JOIN df ON df.term=tf.term JOIN st ON st.id=tf.id GROUP BY 1,2"""
add("text_smart2", lambda sp, sf: SP.smart2_distance(_tf(sp, sf), _ask(sp, sf)).select("q", "id", r6(F.col("d")).alias("dist")), _SM)
add("text_retrieve", lambda sp, sf: SP.text_scores(_tf(sp, sf), _ask(sp, sf)).select("q", "id", r6(F.col("score")).alias("score")), f"{TEXT}, {_LEN}, {_BM} SELECT q, id, {s6('exp(-coalesce(d/nullif(avg(d) OVER (PARTITION BY q),0),d))')} AS score FROM bm")


def _xlang(spark, sf):
    ask = _ask(spark, sf).withColumn("lang", F.explode(F.array(F.lit("en"), F.lit("fr"))))
    langs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return SP.text_scores(_tf(spark, sf), ask, langs).select("q", "id", r6(F.col("score")).alias("score"))


add("text_xlang", _xlang, f"{TEXT}, {_LEN}, {_BM}, x AS (SELECT bm.q, bm.id, bm.d, documents.lang FROM bm JOIN documents ON doc_id=bm.id WHERE lang IN ('en','fr')), y AS (SELECT q, id, exp(-coalesce(d/nullif(avg(d) OVER (PARTITION BY q,lang),0),d)) AS s FROM x) SELECT q, id, {s6('sum(s)')} AS score FROM y GROUP BY 1,2")

add("meta_retrieve", lambda sp, sf: SP.meta_scores(parts(sp, sf), "meta", {"brand": "Brand#11", "size": "10"}).select("idx", r6(F.col("score")).alias("score")),
    f"WITH d AS (SELECT p_partkey AS idx, (CASE WHEN p_brand='Brand#11' THEN 0.0 ELSE 1.0 END)::DOUBLE+(CASE WHEN p_size=10 THEN 0 ELSE 1 END) AS d FROM part), n AS (SELECT idx, coalesce(d/nullif(avg(d) OVER (),0),d) AS n FROM d) SELECT idx, {s6('exp(-n)')} AS score FROM n WHERE n<2")
add("meta_keys", lambda sp, sf: SP.meta_keys(parts(sp, sf), "meta"), "SELECT key, count(*) AS n, arg_min(value, idx) AS example FROM (SELECT p_partkey AS idx, 'brand' AS key, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part) GROUP BY 1")


# Sparse and dense histograms.

_H = "hist AS (SELECT user_id, event_type||':'||hour(ts) AS bin, count(*) AS n FROM events GROUP BY 1,2)"
_REL = "rel AS (SELECT *, n/sum(n) OVER (PARTITION BY user_id) AS f FROM hist)"


def _users(spark, sf):
    return SP.feed(table(spark, sf, "events"), ["user_id"], F.concat_ws(":", "event_type", F.hour("ts").cast("string")))


def _shares(spark, sf):
    return SP.relative(_users(spark, sf), ["user_id"])


add("sparse_feed", lambda sp, sf: _shares(sp, sf).select("user_id", "bin", "n", r6(F.col("f")).alias("f")), f"WITH {_H}, {_REL} SELECT user_id, bin, n, {s6('f')} AS f FROM rel")
add("sparse_prune", lambda sp, sf: SP.pruned(_users(sp, sf), ["user_id"], 2).select("user_id", "bin", "n", r6(F.col("f")).alias("f")), f"WITH {_H}, hist2 AS (SELECT * FROM hist WHERE n>=2) SELECT user_id, bin, n, {s6('n/sum(n) OVER (PARTITION BY user_id)')} AS f FROM hist2")
add("sparse_merge_prefix", lambda sp, sf: SP.merged_by_prefix(_users(sp, sf), F.pmod("user_id", F.lit(10))).select("prefix", "bin", "n"), f"WITH {_H} SELECT user_id%10 AS prefix, bin, CAST(sum(n) AS BIGINT) AS n FROM hist GROUP BY 1,2")
for _m, _v in (("fidelity", "1-sum(sqrt(coalesce(a.f,0)*coalesce(b.f,0)))"), ("jsd", "sum((CASE WHEN a.f>0 THEN a.f*ln(2*a.f/(a.f+coalesce(b.f,0))) ELSE 0 END)+(CASE WHEN b.f>0 THEN b.f*ln(2*b.f/(coalesce(a.f,0)+b.f)) ELSE 0 END))")):
    add(
        f"sparse_{_m}",
        lambda sp, sf, m=_m: SP.sparse_distances(_shares(sp, sf).select(F.col("user_id").alias("id"), F.col("bin").alias("term"), "f"), _shares(sp, sf).where("user_id in (1, 2, 3)").select(F.col("user_id").alias("q"), F.col("bin").alias("term"), F.col("f").alias("g")), m).select("q", "id", r6(F.col("d")).alias("dist")),
        f"WITH {_H}, {_REL}, k AS (SELECT DISTINCT bin FROM hist), u AS (SELECT DISTINCT user_id FROM hist), a2 AS (SELECT u.user_id AS id, q.user_id AS q FROM u, u q WHERE q.user_id IN (1,2,3)) SELECT a2.q AS q, a2.id AS id, {s6(_v)} AS dist FROM a2 CROSS JOIN k LEFT JOIN rel a ON a.user_id=a2.id AND a.bin=k.bin LEFT JOIN rel b ON b.user_id=a2.q AND b.bin=k.bin GROUP BY 1,2",
    )


def _diff(spark, sf):
    m = _shares(spark, sf).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "f"))).alias("m"))
    one = m.where("user_id = 1").select(F.col("m").alias("b"))
    return m.where("user_id in (2, 3)").crossJoin(F.broadcast(one)).select("user_id", F.explode(SP.difference(F.col("m"), F.col("b"))).alias("bin", "d")).select("user_id", "bin", r6(F.col("d")).alias("d"))


add("sparse_diff", _diff, f"WITH {_H}, {_REL}, one AS (SELECT * FROM rel WHERE user_id=1), k AS (SELECT DISTINCT u.user_id, bin FROM (SELECT user_id, bin FROM rel WHERE user_id IN (2,3) UNION SELECT u.x, bin FROM one, (VALUES (2),(3)) u(x)) u) SELECT k.user_id AS user_id, k.bin AS bin, {s6('abs(coalesce(a.f,0)-coalesce(b.f,0))')} AS d FROM k LEFT JOIN rel a ON a.user_id=k.user_id AND a.bin=k.bin LEFT JOIN one b ON b.bin=k.bin")


def _supplier(spark, sf):
    li = table(spark, sf, "lineitem")
    at = S.positions_to_bin([S.point_to_position(F.col("l_quantity"), 0.0, 50.0, 10), S.point_to_position(F.col("l_discount"), 0.0, 0.1, 5)], [10, 5])
    return SP.feed(li, ["l_suppkey"], at)


_SUPP = "sup AS (SELECT l_suppkey, CAST(least(greatest(floor((l_quantity-0.0::DOUBLE)/5.0::DOUBLE),0),9)+10*least(greatest(floor((l_discount-0.0::DOUBLE)/0.02::DOUBLE),0),4) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1,2)"
add("histo_feed", _supplier, f"WITH {_SUPP} SELECT l_suppkey, bin, n FROM sup")
add("sparse_dense", lambda sp, sf: SP.dense(_supplier(sp, sf), ["l_suppkey"], 50).select("l_suppkey", F.posexplode("data").alias("bin", "n")), f"WITH {_SUPP} SELECT k.l_suppkey AS l_suppkey, CAST(r.i AS INT) AS bin, coalesce(n,0) AS n FROM (SELECT DISTINCT l_suppkey FROM sup) k CROSS JOIN range(50) r(i) LEFT JOIN sup ON sup.l_suppkey=k.l_suppkey AND sup.bin=r.i")


def _smooth(compat):
    def run(spark, sf):
        li = table(spark, sf, "lineitem")
        h = SP.feed(li, ["l_suppkey"], F.array(S.point_to_position(F.col("l_quantity"), 0.0, 50.0, 10), S.point_to_position(F.col("l_discount"), 0.0, 0.1, 5)))
        s = SP.smoothed(SP.relative(h, ["l_suppkey"]), ["l_suppkey"], [10, 5], 0.5, compat)
        # A share that lies between two roundings may miss it by an ulp, depending on the order of its sum.
        return s.select("l_suppkey", F.col("bin")[0].alias("x"), F.col("bin")[1].alias("y"), r6(F.round("f", 12)).alias("f"))

    return run


for _compat, _div in ((False, "nn"), (True, "2")):
    add(f"sparse_smooth{'_compat' if _compat else ''}", _smooth(_compat), f"""WITH {_SUPP}, h AS (SELECT l_suppkey, bin%10 AS x, bin//10 AS y, n/sum(n) OVER (PARTITION BY l_suppkey) AS f FROM sup),
nb AS (SELECT h.*, x+dx AS nx, y+dy AS ny, count(*) OVER (PARTITION BY l_suppkey,x,y) AS nn FROM h, (VALUES (-1,0),(1,0),(0,-1),(0,1)) o(dx,dy) WHERE x+dx BETWEEN 0 AND 9 AND y+dy BETWEEN 0 AND 4),
a AS (SELECT l_suppkey, x, y, 0.5*f AS f FROM h UNION ALL SELECT l_suppkey, nx, ny, 0.5*f/{_div} FROM nb) SELECT l_suppkey, x, y, {s6('sum(f)')} AS f FROM a GROUP BY 1,2,3""")  # fmt: skip


# Evaluation.


def _ranking(spark, sf):
    o = objects(spark, sf)
    q = o.where("idx < 20").select(F.col("idx").cast("int").alias("qid"), "idx", F.lit(1).alias("sign"))
    d = R.distances(o, q, [("v", D.euclidean)])
    return d.select("q", "idx", (F.row_number().over(Window.partitionBy("q").orderBy("d0", "idx")) - 1).alias("rank"))


def _truth(spark, sf):
    return V.truth_by_class(objects(spark, sf), objects(spark, sf).where("idx < 20"))


_E = f"""WITH {OBJ}, rk AS (SELECT q.idx AS q, o.idx AS idx, o.class=q.class AND o.idx<>q.idx AS rel, o.class AS oc, q.class AS qc, row_number() OVER (PARTITION BY q.idx ORDER BY {zs(EU, 'o.v', 'q.v')}, o.idx)-1 AS rank FROM obj o, obj q WHERE q.idx<20),
sz AS (SELECT q, count(*) AS n, count(*) FILTER (rel) AS r FROM rk GROUP BY 1),
h AS (SELECT rk.*, sum(CASE WHEN rel THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY rank) AS i, row_number() OVER (PARTITION BY q ORDER BY rank) AS k FROM rk WHERE idx<>q)"""
_CURVE = f"{_E}, cv AS (SELECT h.q, rank, i/k AS p, i/r AS rc FROM h JOIN sz ON sz.q=h.q), ci AS (SELECT *, max(p) OVER (PARTITION BY q ORDER BY rank DESC) AS ip FROM cv)"
add("eval_er", lambda sp, sf: V.summary(_ranking(sp, sf), _truth(sp, sf)).select("q", "er"), f"{_E} SELECT q, arg_min(CASE WHEN rel THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END, rank) AS er FROM h WHERE q IN (SELECT q FROM sz WHERE r>0) GROUP BY 1")
for _name, _expr in (
    ("ap", "coalesce(sum(CASE WHEN rel THEN 100.0::DOUBLE*i/rank END)/any_value(r),0)"),
    ("amp", "coalesce(sum(CASE WHEN rel THEN 100.0::DOUBLE*(n-rank)/nullif(n-i,0) END)/any_value(r),0)"),
    ("are", "coalesce(sum(CASE WHEN rel THEN rank END)/nullif(sum(CASE WHEN rel THEN i END),0),0)::DOUBLE"),
    ("rank_tilde", "((coalesce(sum(CASE WHEN rel THEN rank END),0)-any_value(r)*(any_value(r)-1)/2)/(any_value(n)*any_value(r)))::DOUBLE"),
):
    add(f"eval_{_name}", lambda sp, sf, n=_name: V.summary(_ranking(sp, sf), _truth(sp, sf)).select("q", r6(F.col(n).cast("double")).alias(n)), f"{_E} SELECT h.q AS q, {s6(_expr)} AS {_name} FROM h JOIN sz ON sz.q=h.q WHERE r>0 GROUP BY 1")
add("eval_rank1", lambda sp, sf: V.summary(_ranking(sp, sf), _truth(sp, sf)).select("q", F.col("rank1").cast("long").alias("rank1")), f"{_E} SELECT q, min(rank) FILTER (rel) AS rank1 FROM h WHERE q IN (SELECT q FROM sz WHERE r>0) GROUP BY 1")
add("eval_map", lambda sp, sf: V.summary(_ranking(sp, sf), _truth(sp, sf)).agg(r6(F.avg("ap")).alias("map"), r6(F.avg("er")).alias("er")), f"{_E}, a AS (SELECT h.q, sum(CASE WHEN rel THEN 100.0::DOUBLE*i/rank END)/any_value(r) AS ap, arg_min(CASE WHEN rel THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END, rank) AS er FROM h JOIN sz ON sz.q=h.q WHERE r>0 GROUP BY 1) SELECT {s6('avg(ap)')} AS map, {s6('avg(er)')} AS er FROM a")
_pr = lambda sp, sf: V.precision_recall(_ranking(sp, sf), _truth(sp, sf))
add("eval_prcurve", lambda sp, sf: _pr(sp, sf).select("q", F.col("rank").cast("long").alias("rank"), r6(F.col("precision")).alias("p"), r6(F.col("recall")).alias("r"), r6(F.col("interpolated")).alias("ip")), f"{_CURVE} SELECT q, rank, {s6('p')} AS p, {s6('rc')} AS r, {s6('ip')} AS ip FROM ci")
_P11 = "pt AS (SELECT q, level, coalesce(max(CASE WHEN rc>=level-1e-12 THEN ip END),0) AS p FROM ci, (SELECT i/10 AS level FROM range(11) r(i)) GROUP BY 1,2)"
add("eval_pr11", lambda sp, sf: V.eleven_points(_pr(sp, sf)).select("q", "level", r6(F.col("precision")).alias("p")), f"{_CURVE}, {_P11} SELECT q, level, {s6('p')} AS p FROM pt")
add("eval_prarea", lambda sp, sf: V.area(V.eleven_points(_pr(sp, sf))).select("q", r6(F.col("area")).alias("area")), f"{_CURVE}, {_P11} SELECT q, {s6('sum((CASE WHEN level IN (0,1) THEN 0.5 ELSE 1.0 END)*p*0.1)')} AS area FROM pt GROUP BY 1")
for _k, _compat in ((1, False), (20, False), (20, True), (50, False)):
    add(f"eval_p{_k}{'_compat' if _compat else ''}", lambda sp, sf, k=_k, c=_compat: V.precision_at(_ranking(sp, sf), _truth(sp, sf), k, c).select("q", r6(F.col("p")).alias("p")), f"{_E} SELECT q, {s6(f'sum(CASE WHEN rel THEN 1 ELSE 0 END)/{_k + _compat}')} AS p FROM h WHERE rank<={_k + _compat} GROUP BY 1")
add("eval_r100", lambda sp, sf: V.recall_at(_ranking(sp, sf), _truth(sp, sf)).select("q", r6(F.col("recall")).alias("recall")), f"{_E} SELECT h.q AS q, {s6('sum(CASE WHEN rel THEN 1 ELSE 0 END)/any_value(r)')} AS recall FROM h JOIN sz ON sz.q=h.q WHERE rank<=100 AND r>0 GROUP BY 1")
add("eval_breakeven", lambda sp, sf: V.precision_at_recall(_pr(sp, sf)).select("q", r6(F.col("r_at_half")).alias("r_at_half"), r6(F.col("break_even")).alias("break_even")), f"{_CURVE} SELECT q, {s6('coalesce(max(CASE WHEN p>=0.5 THEN rc END),0)')} AS r_at_half, {s6('coalesce(max(least(p,rc)),0)')} AS break_even FROM cv GROUP BY 1")
add("eval_loo", lambda sp, sf: V.nearest_class(_ranking(sp, sf), objects(sp, sf)), f"{_E} SELECT q, any_value(qc) AS truth, arg_min(oc, rank) AS prediction FROM h GROUP BY 1")
add("eval_confusion", lambda sp, sf: V.confusion(V.nearest_class(_ranking(sp, sf), objects(sp, sf))), f"{_E}, g AS (SELECT q, any_value(qc) AS truth, arg_min(oc, rank) AS prediction FROM h GROUP BY 1) SELECT truth, prediction, count(*) AS n FROM g GROUP BY 1,2")
add("gt_class", lambda sp, sf: V.truth_by_class(objects(sp, sf)), "SELECT a.vec_id AS q, b.vec_id AS idx FROM embeddings a JOIN embeddings b ON a.label=b.label AND a.vec_id<>b.vec_id")
add("gt_query_class", _truth, "SELECT a.vec_id AS q, b.vec_id AS idx FROM embeddings a JOIN embeddings b ON a.label=b.label AND a.vec_id<>b.vec_id WHERE a.vec_id<20")
add("gt_overlap", lambda sp, sf: V.truth_by_overlap(table(sp, sf, "part").select(F.col("p_partkey").alias("idx"), F.split("p_name", " ").alias("w")), "w"),
    "WITH w AS (SELECT DISTINCT p_partkey AS idx, unnest(string_split(p_name,' ')) AS w FROM part) SELECT DISTINCT a.idx AS q, b.idx AS idx FROM w a JOIN w b ON a.w=b.w AND a.idx<>b.idx")


# Images and scalar functions.

_PIX = "px AS (SELECT vec_id AS idx, list_transform(e, lambda x: (x-list_min(e))/(list_max(e)-list_min(e))) AS d FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"
_data = "image.data"


def _pixels(f, alias="x"):
    return lambda sp, sf: objects(sp, sf).select("idx", F.posexplode(f(F.col(_data))).alias("p", alias)).select("idx", "p", r6(F.col(alias)).alias(alias))


def _pix_sql(expr: str) -> str:
    return f"WITH {_PIX} SELECT idx, CAST(i AS INT) AS p, {s6(expr)} AS x FROM px, range(64) r(i)"


for _name, _f, _expr in (
    ("normalize", P.normalize, "d[i+1]"),
    ("threshold", lambda d: P.threshold(d, 0.5), "CASE WHEN d[i+1]>=0.5 THEN 1.0 ELSE 0.0 END"),
    ("gamma", lambda d: P.gamma(d, 2.0), "pow(d[i+1],0.5)"),
    ("contrast", lambda d: P.contrast(d, 0.2, 0.8), "greatest(0.0,least(1.0,(d[i+1]-0.2)/(0.8-0.2)))"),
    ("cutoff", lambda d: P.cutoff(d, 0.3, 0.7), "greatest(0.3,least(0.7,d[i+1]))"),
    ("signedpower", lambda d: P.signed_power(P.shift(d, -0.5), 3.0), "sign(d[i+1]-0.5)*pow(abs(d[i+1]-0.5),3)"),
    ("multiply", lambda d: P.multiply(P.absolute(d), 2.5), "abs(d[i+1])*2.5"),
    ("add", lambda d: P.add(d, P.power(d, 2.0)), "d[i+1]+pow(d[i+1],2)"),
    ("divide", lambda d: P.divide(d, P.shift(d, 1.0)), "d[i+1]/(d[i+1]+1)"),
    ("standardize", P.standardize, "(d[i+1]-list_avg(d))/sqrt(list_sum(list_transform(d,lambda x:x*x))/64-pow(list_avg(d),2))"),
    ("histeq", lambda d: P.equalized(d, 16), "len(list_filter(d, lambda x: least(floor(x*16),15)<=least(floor(d[i+1]*16),15)))/64"),
):
    add(f"img_{_name}", _pixels(_f), _pix_sql(_expr))
add("img_meanvar", lambda sp, sf: objects(sp, sf).select("idx", P.mean_variance(F.col(_data)).alias("s"), P.extrema(F.col(_data)).alias("e")).select("idx", r6(F.col("s.mean")).alias("mean"), r6(F.col("s.variance")).alias("variance"), F.col("e.at_high").alias("at_high"), F.col("e.at_low").alias("at_low")),
    f"WITH {_PIX} SELECT idx, {s6('list_avg(d)')} AS mean, {s6('list_sum(list_transform(d,lambda x:x*x))/64-pow(list_avg(d),2)')} AS variance, CAST(list_position(d,list_max(d))-1 AS BIGINT) AS at_high, CAST(list_position(d,list_min(d))-1 AS BIGINT) AS at_low FROM px")


def _channels(spark, sf):
    return objects(spark, sf).select("idx", *[F.col(_data)[i].alias(c) for i, c in enumerate("rgb")])


add("img_gray", lambda sp, sf: _channels(sp, sf).select("idx", *[r6(S.gray(F.col("r"), F.col("g"), F.col("b"), m)).alias(m) for m in ("luminance", "mean", "max")]), f"WITH {_PIX} SELECT idx, {s6('0.3*d[1]+0.59*d[2]+0.11*d[3]')} AS luminance, {s6('(d[1]+d[2]+d[3])/3')} AS mean, {s6('greatest(d[1],d[2],d[3])')} AS max FROM px")


def _hsv(spark, sf):
    h, s, v = S.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    a, b, c = S.hsv_complex(h, s, v)
    return _channels(spark, sf).select("idx", r6(h).alias("h"), r6(s).alias("s"), r6(v).alias("v"), r6(a).alias("re"), r6(b).alias("im"))


_MX, _MN = "greatest(r,g,b)", "least(r,g,b)"
_SIX = f"CASE WHEN {_MX}=r THEN (((g-b)/nullif({_MX}-{_MN},0))%6+6)%6 WHEN {_MX}=g THEN (b-r)/nullif({_MX}-{_MN},0)+2 ELSE (r-g)/nullif({_MX}-{_MN},0)+4 END"
add("img_hsv", _hsv, f"WITH {_PIX}, c AS (SELECT idx, d[1] AS r, d[2] AS g, d[3] AS b FROM px), k AS (SELECT idx, coalesce(({_SIX})*pi()/3,0) AS h, coalesce(({_MX}-{_MN})/nullif({_MX},0),0) AS s, {_MX} AS v FROM c) SELECT idx, {s6('h')} AS h, {s6('s')} AS s, {s6('v')} AS v, {s6('s*cos(h)')} AS re, {s6('s*sin(h)')} AS im FROM k")
add("img_isgray", lambda sp, sf: objects(sp, sf).select("idx", P.is_gray(F.col(_data), 1).alias("one"), P.is_gray(F.col(_data), 2).alias("two")), f"WITH {_PIX} SELECT idx, true AS one, len(list_filter(range(32), lambda i: d[2*i+1]<>d[2*i+2]))=0 AS two FROM px")
add("histo_color", lambda sp, sf: X.color_histogram(objects(sp, sf), "idx", "image", 1, 8), f"WITH {_PIX} SELECT idx, CAST(least(greatest(floor((x-0.0::DOUBLE)/0.125::DOUBLE),0),7) AS INT) AS bin, count(*) AS n FROM (SELECT idx, unnest(d) AS x FROM px) GROUP BY 1,2")
add("histo_color2d", lambda sp, sf: X.color_histogram(objects(sp, sf), "idx", "image", 2, 4), f"WITH {_PIX} SELECT idx, CAST(least(floor(d[2*i+1]/0.25),3)+4*least(floor(d[2*i+2]/0.25),3) AS INT) AS bin, count(*) AS n FROM px, range(32) r(i) GROUP BY 1,2")
_LO, _HI = "CASE WHEN x<=0.25 THEN 1.0 WHEN x<0.5 THEN (0.5-x)/0.25 ELSE 0.0 END", "CASE WHEN x>=0.75 THEN 1.0 WHEN x>0.5 THEN (x-0.5)/0.25 ELSE 0.0 END"
add("histo_fuzzy3", lambda sp, sf: X.fuzzy_histogram(objects(sp, sf), "idx", "image").select("idx", *[r6(F.col(c)).alias(c) for c in ("low", "middle", "high")]), f"WITH {_PIX}, e AS (SELECT idx, unnest(d) AS x FROM px) SELECT idx, {s6(f'sum({_LO})')} AS low, {s6(f'sum(1-({_LO})-({_HI}))')} AS middle, {s6(f'sum({_HI})')} AS high FROM e GROUP BY 1")


def _sparse_vectors(spark, sf):
    local = local_rows(objects(spark, sf))
    return X.sparse_histogram(local, ["idx"], "v", X.sparse_bounds(local, "v"), 4)


add("histo_sparse_vectors", _sparse_vectors, f"""WITH {OBJ}, lf AS (SELECT idx, i, j, v[8*i+j+1] AS x FROM obj, range(8) r(i), range(8) t(j)), b AS (SELECT j, min(x) AS lo, max(x) AS hi FROM lf GROUP BY 1),
c AS (SELECT idx, i, string_agg(chr(CAST(48+greatest(0,least(3,floor((x-lo)/((hi-lo)/4.0::DOUBLE)))) AS INT)), '' ORDER BY lf.j) AS bin FROM lf JOIN b ON b.j=lf.j GROUP BY 1,2) SELECT idx, bin, count(*) AS n FROM c GROUP BY 1,2""")
add("options", lambda sp, sf: table(sp, sf, "part").select("p_partkey", F.concat(F.lit("SIZE="), F.col("p_size").cast("string"), F.lit(":PRICE=-"), F.col("p_retailprice").cast("string"), F.lit(":NAME="), "p_name").alias("o")).select("p_partkey", S.int_after(F.col("o"), "SIZE=", 0).alias("size"), r6(S.double_after(F.col("o"), "PRICE=", 0.0)).alias("price"), S.string_after(F.col("o"), "NAME=", "").alias("name"), S.string_after(F.col("o"), "MISSING=", "none").alias("missing")),
    "SELECT p_partkey, p_size AS size, round(-p_retailprice,6)+0.0 AS price, p_name AS name, 'none' AS missing FROM part")
add("event_meta", lambda sp, sf: table(sp, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m")).select("event_id", F.element_at("m", "k").alias("k")), "SELECT event_id, props->>'$.k' AS k FROM events")


# Clustering.

_CEN = "cen AS (SELECT idx AS c, v FROM obj WHERE idx<8)"
_ASSIGN = f"asg AS (SELECT idx, v, c AS cluster FROM (SELECT o.idx, o.v, c, row_number() OVER (PARTITION BY o.idx ORDER BY {zs(EU, 'o.v', 'cen.v')}, c) AS r FROM obj o, cen) WHERE r=1)"
_STATS = "st AS (SELECT cluster, j, count(*) AS n, avg(v[j+1]) AS mean, greatest(var_pop(v[j+1]),0) AS variance FROM asg, range(64) t(j) GROUP BY 1,2)"


def _assigned(spark, sf):
    o = objects(spark, sf)
    return C.assign(o.select("idx", "v"), "v", centres(o, 8))


add("cluster_assign", lambda sp, sf: _assigned(sp, sf).select("idx", "cluster"), f"WITH {OBJ}, {_CEN}, {_ASSIGN} SELECT idx, CAST(cluster AS INT) AS cluster FROM asg")
add("cluster_reestimate", lambda sp, sf: C.reestimate(_assigned(sp, sf), "v").select("cluster", "d", "n", r6(F.col("mean")).alias("mean"), r6(F.col("variance")).alias("variance")), f"WITH {OBJ}, {_CEN}, {_ASSIGN}, {_STATS} SELECT CAST(cluster AS INT) AS cluster, CAST(j AS INT) AS d, n, {s6('mean')} AS mean, {s6('variance')} AS variance FROM st")
for _mode, _keys in (("none", "CAST(cluster AS INT) AS cluster, CAST(j AS INT) AS d, "), ("cluster", "CAST(j AS INT) AS d, "), ("dimension", "CAST(cluster AS INT) AS cluster, "), ("both", "")):
    _by = {"none": "GROUP BY cluster, j", "cluster": "GROUP BY j", "dimension": "GROUP BY cluster", "both": ""}[_mode]
    add(f"cluster_pool_{_mode}", lambda sp, sf, m=_mode: (lambda p: p.select(*[c for c in p.columns if c != "variance"], r6(F.col("variance")).alias("variance")))(C.pooled(C.reestimate(_assigned(sp, sf), "v"), m)), f"WITH {OBJ}, {_CEN}, {_ASSIGN}, {_STATS} SELECT {_keys}{s6('sum(n*variance)/sum(n)')} AS variance FROM st {_by}")


def _words(alpha):
    def run(spark, sf):
        o = objects(spark, sf)
        cen = centres(o.select("idx", F.slice("v", 1, 8).alias("v")), 6)
        out = C.visual_words(local_rows(o).select("idx", "v"), ["idx"], "v", cen, alpha)
        return out.select("idx", "bin", (r6(F.col("n")) if alpha else F.col("n")).alias("n"))

    return run


_LF = f"lf AS (SELECT idx, i, v[8*i+1:8*i+8] AS v FROM obj, range(8) r(i)), cen AS (SELECT idx AS c, v[1:8] AS v FROM obj WHERE idx<6), dd AS (SELECT lf.idx, i, c, {zs(EU, 'lf.v', 'cen.v')} AS d FROM lf, cen)"
add("cluster_words_hard", _words(None), f"WITH {OBJ}, {_LF}, g AS (SELECT idx, i, c, row_number() OVER (PARTITION BY idx,i ORDER BY d,c) AS r FROM dd) SELECT idx, CAST(c AS INT) AS bin, count(*) AS n FROM g WHERE r=1 GROUP BY 1,2")
add("cluster_words_fuzzy", _words(0.5), f"WITH {OBJ}, {_LF}, w AS (SELECT idx, i, c, exp(-(d-min(d) OVER (PARTITION BY idx,i))/0.5) AS w FROM dd), x AS (SELECT idx, c, w/sum(w) OVER (PARTITION BY idx,i) AS x FROM w) SELECT idx, CAST(c AS INT) AS bin, {s6('sum(x)')} AS n FROM x GROUP BY 1,2")
add("cluster_core_counts", lambda sp, sf: C.neighbour_counts(objects(sp, sf), "v", 1.3, 5), f"WITH {OBJ} SELECT a.idx AS idx, count(*) AS n, count(*)>=5 AS core FROM obj a JOIN obj b ON {zs(EU, 'a.v', 'b.v')}<=1.3 GROUP BY 1")
add("gaussian_logpdf", lambda sp, sf: objects(sp, sf).select("idx", r6(C.gaussian_log_density(F.col("v"), np.zeros(64), np.full(64, 0.02))).alias("logpdf")), f"WITH {OBJ} SELECT idx, {s6(f'-0.5*({64 * math.log(2 * math.pi * 0.02)!r}+list_sum(list_transform(v, lambda x: x*x/0.02)))')} AS logpdf FROM obj")


# Tables and arrays.

add("db2jf", lambda sp, sf: objects(sp, sf).select("class", "idx", F.posexplode(F.concat("v", "h")).alias("p", "x")).select("class", "idx", "p", r6(F.col("x")).alias("x")), f"WITH {OBJ} SELECT class, idx, CAST(i AS INT) AS p, {s6('list_concat(v,h)[i+1]')} AS x FROM obj, range(128) r(i)")
add("row_difference", lambda sp, sf: objects(sp, sf).select("idx", F.posexplode(subtract(F.col("v"), F.col("h"))).alias("p", "x")).select("idx", "p", r6(F.col("x")).alias("x")), f"WITH {OBJ} SELECT idx, CAST(i AS INT) AS p, {s6('v[i+1]-h[i+1]')} AS x FROM obj, range(64) r(i)")
add("discard_range", lambda sp, sf: objects(sp, sf).select("idx", total(drop_range(F.col("v"), 3, 10)).alias("a"), total(zero_dimension(F.col("v"), 5)).alias("b")).select("idx", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b")), f"WITH {OBJ} SELECT idx, {s6('list_sum(v[1:3])+list_sum(v[12:64])')} AS a, {s6('list_sum(v)-v[6]')} AS b FROM obj")
add("consistency", lambda sp, sf: objects(sp, sf).agg((F.min(F.size("v")) == F.max(F.size("v"))).alias("same_size"), F.count_if(F.exists("v", F.isnan)).alias("nans"), F.count("*").alias("n")), "SELECT min(len(embedding))=max(len(embedding)) AS same_size, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x)))>0) AS nans, count(*) AS n FROM embeddings")
add("random_access", lambda sp, sf: objects(sp, sf).join(sp.createDataFrame([(5,), (17,), (400,), (10**9,)], "idx long"), "idx", "left_semi").select("idx", "class"), "SELECT vec_id AS idx, label AS class FROM embeddings WHERE vec_id IN (5,17,400,1000000000)")
add("vector_stats", lambda sp, sf: objects(sp, sf).select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(r6(F.min("x")).alias("low"), r6(F.max("x")).alias("high"), r6(F.avg("x")).alias("mean")), f"WITH {OBJ} SELECT CAST(i AS INT) AS d, {s6('min(v[i+1])')} AS low, {s6('max(v[i+1])')} AS high, {s6('avg(v[i+1])')} AS mean FROM obj, range(64) r(i) GROUP BY 1")
add("covariance2d", lambda sp, sf: objects(sp, sf).groupBy("class").agg(r6(F.covar_pop(F.col("v")[0], F.col("v")[1])).alias("cov"), F.count("*").alias("n")), f"WITH {OBJ} SELECT class, {s6('covar_pop(v[1],v[2])')} AS cov, count(*) AS n FROM obj GROUP BY 1")
add("distinct_words", lambda sp, sf: table(sp, sf, "part").select(F.explode(F.array_distinct(F.split("p_name", " "))).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "SELECT w, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name,' ')) AS w FROM part) GROUP BY 1")


# Queries that SQL cannot express: iterative, learned or two-dimensional.


def _reranked(f):
    return lambda sp, sf: R.top(f(R.top(_results(sp, sf), 50).drop("rank"), objects(sp, sf)), 20)


add("rerank_greedy", _reranked(lambda r, o: RR.greedy(r, o, "v", 50)))
add("rerank_dp", _reranked(lambda r, o: RR.dynamic(r, o, "v", 20)))
add("rerank_monodp", _reranked(lambda r, o: RR.monotone(r, o, "v", 20)))
add("rerank_cluster", lambda sp, sf: R.top(RR.by_cluster(_results(sp, sf), _assigned(sp, sf).select("idx", "cluster"), 50), 20))


def _em(spark, sf):
    o = objects(spark, sf)
    n, mean, var = C.fit_splitting(o, "v", 2, 3)
    return C.assign(o.select("idx", "v"), "v", mean).select("idx", "cluster")


add("em_full", _em)
add("dbscan", lambda sp, sf: C.dbscan(objects(sp, sf), "v", 1.3, 5))


def _pca(spark, sf):
    o = objects(spark, sf)
    mean, axes, _ = C.pca(o, "v", 5)
    back = C.back_project(C.project(F.col("v"), mean, axes), mean, axes)
    return o.select("idx", r6(D.euclidean(F.col("v"), back)).alias("error"))


add("pca", _pca)


def _lda(spark, sf):
    o = objects(spark, sf)
    mean, axes = C.lda(o, "v", "class", 2)
    return o.select("idx", C.project(F.col("v"), mean, axes).alias("p"))


add("lda", _lda)


def _pairs(column):
    def run(spark, sf):
        o = objects(spark, sf)
        return o.select("idx", F.col(column).alias("a")).crossJoin(F.broadcast(o.where("idx < 2").select(F.col("idx").alias("q"), F.col(column).alias("b"))))

    return run


add("hungarian", lambda sp, sf: X.edge_cover(_pairs("lf")(sp, sf), ["q", "idx"]))
add("idm", lambda sp, sf: X.image_distortion(_pairs("image")(sp, sf), ["q", "idx"]))
add("xcorr", lambda sp, sf: X.cross_correlation(_pairs("image")(sp, sf), ["q", "idx"]))


def _emd(spark, sf):
    def signature(side: str):
        return F.transform(side, lambda v, i: F.struct((i + 1).cast("double").alias("weight"), v.alias("v")))

    return X.earth_mover(_pairs("lf")(spark, sf).withColumns({"a": signature("a"), "b": signature("b")}), ["q", "idx"])


add("emd", _emd)
add("tamura", lambda sp, sf: X.tamura(objects(sp, sf), "idx", "image", 4))
add("gabor", lambda sp, sf: X.gabor(objects(sp, sf), "idx", "image"))
add("invariant", lambda sp, sf: X.invariant(objects(sp, sf), "idx", "image"))
add("relational", lambda sp, sf: X.invariant(objects(sp, sf), "idx", "image", "relational"))
add("local_grid", lambda sp, sf: X.local_features(objects(sp, sf), "idx", "image", "grid"))
add("local_dog", lambda sp, sf: X.local_features(objects(sp, sf), "idx", "image", "dog", 5))
add("local_orientation", lambda sp, sf: X.local_features(objects(sp, sf), "idx", "image", "grid", 2, 8, "orientation"))


def _tuned(spark, sf):
    o = objects(spark, sf)
    pos, neg = RR.examples(o, examples(spark).where("qid = 2"), "v")
    w = RR.tune_weighted_l1(pos, neg)
    asked = examples(spark).where("qid = 2")
    return R.top(R.score_sum(R.scored(R.normalize(R.distances(o, asked, [("v", lambda a, b: D.weighted_l1(a, b, w.tolist()))])), R.linear, [1.0])), 20)


add("tune_wl1", _tuned)


def _svm(spark, sf):
    o = objects(spark, sf)
    few = o.where("idx < 100")
    w, b = C.fit_linear_svm(few, "v", (F.col("class") == 0).cast("double"), 20)
    return o.select("idx", R.svm_score([F.col("v")[i] for i in range(64)], w.tolist(), b).alias("score"))


add("svm", _svm)
add("retrieve_random", lambda sp, sf: objects(sp, sf).orderBy(F.rand(7)).select("idx", "name").limit(10))


def _learned(separate):
    def run(spark, sf):
        o, asked = objects(spark, sf), examples(spark).where("qid = 2")
        pos, neg = RR.examples(o, asked, "v")
        w, n = RR.tune_class_weights(pos, neg) if separate else (RR.tune_dimension_weights(pos, neg), None)
        return R.top(R.learned_distance_scores(o, asked, "v", w.tolist(), None if n is None else n.tolist()), 20)

    return run


add("comb_wd", _learned(False))
add("comb_cdwd", _learned(True))


def _query_weighted(spark, sf):
    asked = examples(spark).where("qid = 2")
    o = objects(spark, sf)
    rows = o.join(F.broadcast(asked), "idx").orderBy("idx").select("idx", "sign", "v").collect()
    x, signs = np.array([r["v"] for r in rows]), np.array([r["sign"] for r in rows])
    w = RR.tune_query_weights(RR.pairwise(x), signs)
    s = R.scored(R.normalize(R.distances(o, asked, FEATURES)), R.linear, WEIGHTS)
    return R.top(R.weighted_query_scores(s, {int(r["idx"]): float(v) for r, v in zip(rows, w, strict=True)}), 20)


add("comb_queryweighting", _query_weighted)


def _svm_feedback(spark, sf):
    o, asked = objects(spark, sf), examples(spark).where("qid = 2")
    w, b = C.fit_linear_svm(o.join(F.broadcast(asked), "idx"), "v", (F.col("sign") > 0).cast("double"), 20)
    return R.top(o.select(F.lit(2).alias("qid"), "idx", R.svm_score([F.col("v")[i] for i in range(64)], w.tolist(), b).alias("score")), 20)


add("comb_svm", _svm_feedback)
add("lf_signature", lambda sp, sf: C.signatures(local_rows(objects(sp, sf)), "idx", "v"))
add("position_clusters", lambda sp, sf: C.position_clusters(objects(sp, sf).select("idx", F.explode("lf").alias("l")).select("idx", F.col("l")[0].alias("x"), F.col("l")[1].alias("y")), "idx", 1))


def _gaussian_classes(spark, sf):
    o = objects(spark, sf)
    return V.confusion(C.classify_gaussian(o, "v", C.class_gaussians(o, "v", "class")).select(F.col("class").alias("truth"), "prediction"))


add("gaussian_classifier", _gaussian_classes)
add("gt_stemmed_overlap", lambda sp, sf: V.truth_by_overlap(table(sp, sf, "part").select(F.col("p_partkey").alias("idx"), stemming.stems(F.split("p_name", " ")).alias("w")), "w"))
add("train_test_split", lambda sp, sf: C.split(objects(sp, sf), "idx", 0.7)[0].select("idx", "class"))
add("tamura_pairs", lambda sp, sf: X.tamura_pairs(objects(sp, sf), "idx", "image", [0.5, 1.0]))
add("sparse_gabor", lambda sp, sf: X.sparse_gabor(objects(sp, sf), "idx", "image"))
for _n, _points in ((1, [(4.0, 0.0)]), (3, [(4.0, 0.0), (0.0, 8.0), (2.0, 2.0)])):
    add(f"invariant_monomial{_n}", lambda sp, sf, p=_points: X.kernel_histogram(objects(sp, sf), "idx", "image", p))
add("remove_rows", lambda sp, sf: R.without_rows(objects(sp, sf), ["o3", "o10"]).select("idx", "name"), "SELECT row_number() OVER (ORDER BY vec_id)-1 AS idx, 'o'||vec_id AS name FROM embeddings WHERE vec_id NOT IN (3,10)")
add("box_predicate", lambda sp, sf: objects(sp, sf).select("idx", S.inside(F.struct(F.lit(-0.1).alias("xmin"), F.lit(-0.1).alias("ymin"), F.lit(0.1).alias("xmax"), F.lit(0.1).alias("ymax")), F.col("v")[0], F.col("v")[1]).alias("inside")), f"WITH {OBJ} SELECT idx, v[1]>=-0.1 AND v[1]<=0.1 AND v[2]>=-0.1 AND v[2]<=0.1 AS inside FROM obj")


def _cached(spark, sf):
    o = objects(spark, sf)

    def compute(pairs):
        a, b = o.select("idx", F.col("v").alias("a")), o.select(F.col("idx").alias("q"), F.col("v").alias("b"))
        return pairs.join(a, "idx").join(F.broadcast(b.where("q < 2")), "q").select("q", "idx", D.euclidean(F.col("a"), F.col("b")).alias("d"))

    wanted = o.select("idx").crossJoin(F.broadcast(spark.createDataFrame([(0,), (1,)], "q long")))
    cache = compute(wanted.where("idx % 2 = 0"))
    return R.cached_distances(wanted, cache, compute)[0].select("q", "idx", r6(F.col("d")).alias("dist"))


add("cached_distances", _cached, f"WITH {OBJ} SELECT q.idx AS q, o.idx AS idx, {s6(zs(EU, 'o.v', 'q.v'))} AS dist FROM obj o, obj q WHERE q.idx IN (0, 1)")


# Smoothed divergences, text distances with a default, further pages, metrics over all queries, examples of several objects.


def _smoothed_jsd(share):
    def run(spark, sf):
        h = SP.feed(table(spark, sf, "lineitem"), ["l_suppkey"], F.array(S.point_to_position(F.col("l_quantity"), 0.0, 50.0, 10), S.point_to_position(F.col("l_discount"), 0.0, 0.1, 5)))
        f = SP.relative(h, ["l_suppkey"]).select(F.col("l_suppkey").alias("id"), "bin", "f")
        d = SP.smoothed_divergence(f, f.where("id in (1, 2, 3)").withColumnRenamed("id", "q"), [10, 5], share)
        return d.select("q", "id", r6(F.col("d")).alias("dist"))

    return run


for _name, _share in (("sf05", 0.5), ("sf0", 0.0)):
    _near = f" UNION ALL SELECT l_suppkey, nx, ny, {_share}*f/nn FROM nb" if _share else ""
    add(f"dist_jsd_sparse_{_name}", _smoothed_jsd(_share), f"""WITH {_SUPP}, h AS (SELECT l_suppkey, bin%10 AS x, bin//10 AS y, n/sum(n) OVER (PARTITION BY l_suppkey) AS f FROM sup),
nb AS (SELECT h.*, x+dx AS nx, y+dy AS ny, count(*) OVER (PARTITION BY l_suppkey,x,y) AS nn FROM h, (VALUES (-1,0),(1,0),(0,-1),(0,1)) o(dx,dy) WHERE x+dx BETWEEN 0 AND 9 AND y+dy BETWEEN 0 AND 4),
a AS (SELECT l_suppkey, x, y, {1 - _share}*f AS f FROM h{_near}), sm AS (SELECT l_suppkey AS id, x, y, sum(f) AS f FROM a GROUP BY 1,2,3),
k AS (SELECT p.id, q.id AS q, x, y FROM (SELECT DISTINCT id FROM sm) p, (SELECT DISTINCT id FROM sm WHERE id IN (1,2,3)) q, (SELECT DISTINCT x, y FROM sm) xy)
SELECT k.q AS q, k.id AS id, {s6("sum((CASE WHEN l.f>0 THEN l.f*ln(2*l.f/(l.f+coalesce(r.f,0))) ELSE 0 END)+(CASE WHEN r.f>0 THEN r.f*ln(2*r.f/(coalesce(l.f,0)+r.f)) ELSE 0 END))")} AS dist
FROM k LEFT JOIN sm l ON l.id=k.id AND l.x=k.x AND l.y=k.y LEFT JOIN sm r ON r.id=k.q AND r.x=k.x AND r.y=k.y GROUP BY 1,2""")  # fmt: skip

add("text_default", lambda sp, sf: SP.text_distance(_tf(sp, sf), _ask(sp, sf), table(sp, sf, "documents").select(F.col("doc_id").alias("id"))).select("q", "id", r6(F.col("d")).alias("dist")),
    f"{TEXT}, {_LEN}, {_BM}, t AS (SELECT ask.q, max(1-d) AS top FROM (SELECT DISTINCT q FROM ask) ask LEFT JOIN bm ON bm.q=ask.q GROUP BY 1) SELECT t.q AS q, o.id AS id, {s6('coalesce(top-coalesce(1-d,0),10000.0)')} AS dist FROM t CROSS JOIN (SELECT DISTINCT doc_id AS id FROM documents) o LEFT JOIN bm ON bm.q=t.q AND bm.id=o.id")


def _rounded_page(scores, step):
    return R.page(scores.select("qid", "idx", F.round("score", 9).alias("score")), step, 10).select("qid", "idx", "rank", r6(F.col("score")).alias("score"))


_NEXT = f"SELECT qid, idx, CAST(rank AS INT) AS rank, {s6('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx DESC) AS rank FROM sc) WHERE rank BETWEEN 11 AND 20"
add("text_expand", lambda sp, sf: _rounded_page(SP.text_scores(_tf(sp, sf), _ask(sp, sf)).select(F.col("q").alias("qid"), F.col("id").alias("idx"), "score"), 1),
    f"{TEXT}, {_LEN}, {_BM}, sc AS (SELECT q AS qid, id AS idx, round(exp(-coalesce(d/nullif(avg(d) OVER (PARTITION BY q),0),d)),9) AS score FROM bm) {_NEXT}")
add("meta_expand", lambda sp, sf: _rounded_page(SP.meta_scores(parts(sp, sf), "meta", {"brand": "Brand#11", "size": "10"}).withColumn("qid", F.lit(0)), 1),
    f"WITH d AS (SELECT p_partkey AS idx, (CASE WHEN p_brand='Brand#11' THEN 0.0 ELSE 1.0 END)::DOUBLE+(CASE WHEN p_size=10 THEN 0 ELSE 1 END) AS d FROM part), n AS (SELECT idx, coalesce(d/nullif(avg(d) OVER (),0),d) AS n FROM d), sc AS (SELECT 0 AS qid, idx, round(exp(-n),9) AS score FROM n WHERE n<2) {_NEXT}")

for _compat in (False, True):
    add(f"eval_pnrel{'_compat' if _compat else ''}", lambda sp, sf, c=_compat: V.precision_at_relevant(_ranking(sp, sf), _truth(sp, sf), c).select("q", r6(F.col("p")).alias("p")),
        f"{_E} SELECT h.q AS q, {s6(f'sum(CASE WHEN rel THEN 1 ELSE 0 END)/any_value(r+{int(_compat)})')} AS p FROM h JOIN sz ON sz.q=h.q WHERE r>0 AND rank<=r+{int(_compat)} GROUP BY 1")

_MEANS = f"""{_CURVE}, {_P11}, one AS (SELECT h.q, arg_min(CASE WHEN rel THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END, rank) AS er, coalesce(sum(CASE WHEN rel THEN 100.0::DOUBLE*i/rank END)/any_value(r),0) AS map,
coalesce(sum(CASE WHEN rel THEN 100.0::DOUBLE*(n-rank)/nullif(n-i,0) END)/any_value(r),0) AS amp, coalesce(sum(CASE WHEN rel THEN rank END)/nullif(sum(CASE WHEN rel THEN i END),0),0) AS are, min(rank) FILTER (rel) AS rank1,
(coalesce(sum(CASE WHEN rel THEN rank END),0)-any_value(r)*(any_value(r)-1)/2)/(any_value(n)*any_value(r)) AS rank_tilde,
count(*) FILTER (rel AND rank<=1)/1 AS p1, count(*) FILTER (rel AND rank<=20)/20 AS p20, count(*) FILTER (rel AND rank<=50)/50 AS p50, count(*) FILTER (rel AND rank<=r)/any_value(r) AS pnrel, count(*) FILTER (rel AND rank<=100)/any_value(r) AS r100
FROM h JOIN sz ON sz.q=h.q WHERE r>0 GROUP BY 1), ar AS (SELECT q, sum((CASE WHEN level IN (0,1) THEN 0.5 ELSE 1.0 END)*p*0.1) AS prarea FROM pt GROUP BY 1),
be AS (SELECT q, coalesce(max(CASE WHEN p>=0.5 THEN rc END),0) AS r_at_half, coalesce(max(least(p,rc)),0) AS break_even FROM cv GROUP BY 1)"""
_METRICS = ["er", "map", "amp", "are", "rank1", "rank_tilde", "p1", "p20", "p50", "pnrel", "r100", "prarea", "r_at_half", "break_even"]
add("eval_averages", lambda sp, sf: V.averages(_ranking(sp, sf), _truth(sp, sf)).select(*[r6(F.col(c).cast("double")).alias(c) for c in _METRICS], "queries"),
    f"{_MEANS} SELECT {', '.join(f'{s6(f"avg({c})::DOUBLE")} AS {c}' for c in _METRICS)}, count(*) AS queries FROM one JOIN ar ON ar.q=one.q JOIN be ON be.q=one.q")


def _example_truth(spark, sf):
    """Objects of the class of a query's first example, the examples left out."""
    o, asked = objects(spark, sf), examples(spark)
    first = asked.groupBy("qid").agg(F.min("idx").alias("idx")).join(o.select("idx", "class"), "idx").select("qid", "class")
    return o.select("idx", "class").join(first, "class").join(asked, ["qid", "idx"], "left_anti").select((-1 - F.col("qid")).cast("long").alias("q"), "idx")


add("eval_examples", lambda sp, sf: V.summary(V.example_ranking(_results(sp, sf), examples(sp)), _example_truth(sp, sf)).select("q", r6(F.col("ap")).alias("ap"), F.col("rank1").cast("long").alias("rank1"), "relevant"),
    f"""{_ALL}, kept AS (SELECT c.qid, c.idx, c.score FROM c LEFT JOIN qs ON qs.qid=c.qid AND qs.q=c.idx WHERE qs.q IS NULL), fc AS (SELECT qid, class FROM (SELECT qid, min(q) AS q FROM qs GROUP BY 1) f JOIN obj ON obj.idx=f.q),
rk AS (SELECT kept.qid, obj.class=fc.class AS rel, row_number() OVER (PARTITION BY kept.qid ORDER BY score DESC, kept.idx DESC) AS rank FROM kept JOIN obj ON obj.idx=kept.idx JOIN fc ON fc.qid=kept.qid),
h AS (SELECT *, sum(CASE WHEN rel THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) AS i FROM rk)
SELECT CAST(-1-qid AS BIGINT) AS q, {s6('sum(CASE WHEN rel THEN 100.0::DOUBLE*i/rank END)/count(*) FILTER (rel)')} AS ap, min(rank) FILTER (rel) AS rank1, count(*) FILTER (rel) AS relevant FROM h GROUP BY 1""")  # fmt: skip


# Distances chosen by name, and tables by the engine's own readers and writers.

for _name, _spec in (("lfhungarian", "hungarian"), ("lfsigemd", "emd"), ("glfd", None)):
    add(f"named_{_name}", lambda sp, sf, n=_name: N.distances(objects(sp, sf), _asked(sp), [("lf", n)]).select("q", "idx", r6(F.col("d0")).alias("dist")))
add("named_mixed", lambda sp, sf: N.distances(objects(sp, sf), examples(sp), [("v", ""), ("h", "jd")]).select("qid", "q", "idx", r6(F.col("d0")).alias("d0"), r6(F.col("d1")).alias("d1")), f"WITH {OBJ}, {QS}, {_D} SELECT qid, q, idx, {s6('d0')} AS d0, {s6('d1')} AS d1 FROM d")


def _documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "text")


_NAMED = f"WITH {_TF}, ask AS (SELECT id AS q, term, tf FROM tf WHERE id IN (SELECT doc_id FROM documents WHERE doc_id IN (0,1,2))), {_DF}"
add("named_bm25", lambda sp, sf: N.distances(_documents(sp, sf), _asked(sp), [("text", "bm25")]).select("q", "idx", r6(F.col("d0")).alias("dist")),
    f"{_NAMED}, {_LEN}, {_BM} SELECT a.doc_id AS q, b.doc_id AS idx, {s6('coalesce(d,1.0)')} AS dist FROM documents a CROSS JOIN documents b LEFT JOIN bm ON bm.q=a.doc_id AND bm.id=b.doc_id WHERE a.doc_id IN (0,1,2)")


def _through_files(make):
    def run(spark, sf):
        path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
        return make(spark, sf, path)

    return run


def _feature_rows(spark, sf, path):
    FM.write_features(objects(spark, sf).select("idx", "class", "v"), path)
    return FM.read_rows(spark, path, spark.createDataFrame([(3,), (7,), (11,)], "idx long")).select("idx", "class", F.posexplode("v").alias("p", "x")).select("idx", "class", "p", r6(F.col("x")).alias("x"))


def _jf_rows(spark, sf, path):
    FM.write_jf(objects(spark, sf).select("class", "v"), path)
    back = FM.read_jf(spark, path)
    return back.groupBy("class").agg(F.count("*").alias("n"), r6(F.sum(F.col("v")[0])).alias("x"))


def _saved_distances(spark, sf, path):
    R.save_distances(_normalized(spark, sf), path)
    return spark.read.parquet(path).select("qid", "q", "idx", r6(F.col("d0")).alias("d0"), r6(F.col("d1")).alias("d1"))


def _saved_ranks(spark, sf, path):
    FM.write_ranks(R.top(_results(spark, sf).where("qid = 0"), 10).join(objects(spark, sf).select("idx", "name"), "idx"), path, "retrieve")
    w = F.split("value", " ")
    return spark.read.text(path).where("value not like '#%'").select(w[0].cast("int").alias("rank"), w[1].alias("name"), r6(w[2].cast("double")).alias("score"))


add("io_features", _through_files(_feature_rows), f"WITH {OBJ} SELECT idx, class, CAST(i AS INT) AS p, {s6('v[i+1]')} AS x FROM obj, range(64) r(i) WHERE idx IN (3,7,11)")
add("io_jf", _through_files(_jf_rows), f"WITH {OBJ} SELECT class, count(*) AS n, {s6('sum(v[1])')} AS x FROM obj GROUP BY 1")
add("io_distances", _through_files(_saved_distances), SQL["normalize"])
add("io_ranks", _through_files(_saved_ranks), f"{_ALL} SELECT rank, 'o'||idx AS name, {s6('score')} AS score FROM r WHERE qid=0 AND rank<=10")
add("event_windows", lambda sp, sf: ST.event_histograms(table(sp, sf, "events")).select(F.col("window.start").cast("string").alias("start"), "event_type", "n", r6(F.round("total", 4)).alias("total")),
    "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value),4)+0.0 AS total FROM events GROUP BY 1,2")
add("strings", lambda sp, sf: table(sp, sf, "part").select("p_partkey", F.size(S.tokens(F.col("p_name"))).alias("n"), F.lower("p_type").alias("kind")), "SELECT p_partkey, CAST(len(string_split(trim(p_name),' ')) AS INT) AS n, lower(p_type) AS kind FROM part")


def _singular(spark, sf):
    """How far V V' is from one and what the values leave of the squared norms: all 64 values give the whole."""
    values, axes = C.svd(objects(spark, sf), "v", 64)
    return objects(spark, sf).agg(r6(F.sum(total(F.transform("v", lambda x: x * x)))).alias("energy"), r6(F.lit(float((values**2).sum()))).alias("values"), r6(F.lit(float(np.abs(axes @ axes.T - np.eye(64)).max()))).alias("off"))


add("svd_energy", _singular, f"WITH {OBJ} SELECT {s6('sum(list_sum(list_transform(v, lambda x: x*x)))')} AS energy, {s6('sum(list_sum(list_transform(v, lambda x: x*x)))')} AS \"values\", 0.0::DOUBLE AS off FROM obj")
