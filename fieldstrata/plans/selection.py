"""Queries of fold-safe transforms, acquisition scores, the audit draw and leave-location-time-out validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import key
from ..operators import acquisition as Q
from ..operators import audit, folded, validation
from .registry import query, read
from .roles import POP, labelled, population


def K(seed: int, ident: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {seed}, {ident})), 1, 13))::bigint"


def vectors(spark, d):
    e = read(spark, d, "embeddings")
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double") * 10)
    return e.select("vec_id", (F.col("vec_id") % 5).alias("fold"), (F.col("vec_id") % 3 != 0).alias("covered"), part(1, 2).alias("x"), part(3, 1).alias("y"))


_VECTORS = "e as (select vec_id, vec_id % 5 as fold, vec_id % 3 <> 0 as covered, embedding[1]::double * 10 as x1, embedding[2]::double * 10 as x2, embedding[3]::double * 10 as y from embeddings), folds as (select distinct fold as k from e)"
_COV = "s as (select k, avg(x1) as m1, avg(x2) as m2, avg(y) as my, count(*) as n, covar_pop(x1, x1) * count(*) as a, covar_pop(x1, x2) * count(*) as b, covar_pop(x2, x2) * count(*) as c, covar_pop(x1, y) * count(*) as p, covar_pop(x2, y) * count(*) as q from e join folds on fold <> k where covered group by k)"


@query("c45_fold_pca", f"with {_VECTORS}, {_COV}, t as (select k, m1, m2, 0.5 * atan2(2 * b, a - c) as th from s), u as (select k, m1, m2, cos(th) as u1, sin(th) as u2 from t), w as (select k, m1, m2, u1 * case when abs(u1) >= abs(u2) then sign(u1) else sign(u2) end as a1, u2 * case when abs(u1) >= abs(u2) then sign(u1) else sign(u2) end as a2, -u2 * case when abs(u2) >= abs(u1) then sign(-u2) else sign(u1) end as b1, u1 * case when abs(u2) >= abs(u1) then sign(-u2) else sign(u1) end as b2 from u) select vec_id, round(case when covered then (x1 - m1) * a1 + (x2 - m2) * a2 end, 6) as pc1, round(case when covered then (x1 - m1) * b1 + (x2 - m2) * b2 end, 6) as pc2 from e join w on fold = k")
def c45(spark, d):
    t = folded.fold_pca(vectors(spark, d), "fold", "x", F.col("covered"), 2)
    return t.select("vec_id", F.get("pca", F.lit(0)).alias("pc1"), F.get("pca", F.lit(1)).alias("pc2"))


@query("c46_fold_ridge", f"with {_VECTORS}, {_COV}, r as (select k, m1, m2, my, ((c + 10) * p - b * q) / ((a + 10) * (c + 10) - b * b) as w1, ((a + 10) * q - b * p) / ((a + 10) * (c + 10) - b * b) as w2 from s) select vec_id, round(case when covered then y else my + (x1 - m1) * w1 + (x2 - m2) * w2 end, 6) as y, (not covered)::int::bigint as synthetic from e join r on fold = k")
def c46(spark, d):
    t = folded.fold_ridge(vectors(spark, d), "fold", "x", "y", F.col("covered"), 10.0)
    return t.select("vec_id", F.get("y", F.lit(0)).alias("y"), "synthetic")


_SIL = f"""s as (select vec_id as i, embedding::double[] as v, label::varchar as by_label, (vec_id % 3)::varchar as by_rest, case when label < 5 then 'low' else 'high' end as by_half from embeddings order by {K(71, 'vec_id')}, vec_id limit 10000),
ds as materialized (select a.i, b.i as j, sqrt(list_sum(list_transform(range(1, 65), lambda k: pow(a.v[k] - b.v[k], 2)))) as dist from s a, s b),
cl as (select i, 'by_label' as clustering, by_label as c from s union all select i, 'by_rest', by_rest from s union all select i, 'by_half', by_half from s),
m as (select x.clustering, ds.i, x.c as own, y.c as other, sum(dist) as total, count(*) as n from ds join cl x on x.i = ds.i join cl y on y.i = ds.j and y.clustering = x.clustering group by all),
ab as (select clustering, i, sum(case when own = other then case when n > 1 then total / (n - 1) else 0 end end) as a, min(case when own <> other then total / n end) as b from m group by all),
si as (select clustering, count(*) as n, avg(case when b is null then 0 else (b - a) / greatest(a, b, 1e-12) end) as silhouette from ab group by 1)"""


def clusterings(spark, d):
    e = read(spark, d, "embeddings")
    return e.select("vec_id", "embedding", F.col("label").alias("by_label"), (F.col("vec_id") % 3).alias("by_rest"), F.when(F.col("label") < 5, "low").otherwise("high").alias("by_half"))


@query("c5_silhouettes", f"with {_SIL} select clustering, n, round(silhouette, 6) as silhouette from si")
def c5(spark, d):
    return Q.silhouettes(clusterings(spark, d), "vec_id", "embedding", ["by_label", "by_rest", "by_half"], seed=71)


@query("c5_chosen_clustering", f"with {_SIL} select clustering, round(silhouette, 6) as silhouette from si order by round(abs(silhouette), 9), clustering limit 1")
def c5_chosen(spark, d):
    return Q.least_separated(Q.silhouettes(clusterings(spark, d), "vec_id", "embedding", ["by_label", "by_rest", "by_half"], seed=71))


def changes(spark, d):
    e = read(spark, d, "embeddings")
    pairs = e.join(e.select((F.col("vec_id") - 250).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    share = lambda a, m: (F.col("vec_id") * a % m) / float(m)
    return pairs.select("vec_id", "label", F.zip_with("embedding", "b", lambda x, y: y.cast("double") - x.cast("double")).alias("v"), (share(7, 20) - 0.2).alias("lost"), share(3, 11).alias("destination"), share(5, 13).alias("novelty"))


def _prototypes(rounds: int = 4) -> str:
    unit = "list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))"
    steps = [f"""ch as (select a.vec_id, a.label, list_transform(range(1, 65), lambda i: b.embedding[i]::double - a.embedding[i]::double) as v, (a.vec_id * 7 % 20) / 20.0::double - 0.2 as lost, (a.vec_id * 3 % 11) / 11.0::double as destination, (a.vec_id * 5 % 13) / 13.0::double as novelty from embeddings a join embeddings b on b.vec_id = a.vec_id + 250),
un as materialized (select * exclude (v), {unit} as v from ch), own as (select * from un where label < 3), p0 as (select row_number() over (order by {K(72, 'vec_id')}, vec_id) - 1 as c, v from own qualify c < 3)"""]
    for r in range(rounds):
        steps += [
            f"n{r} as (select vec_id, v, c from (select own.vec_id, own.v, p.c, row_number() over (partition by own.vec_id order by round(list_dot_product(own.v, p.v), 9) desc, p.c) as rn from own, p{r} p) where rn = 1)",
            f"s{r} as (select c, list(x order by i) as v from (select c, i, sum(x) as x from (select c, unnest(range(1, 65)) as i, unnest(v) as x from n{r}) group by 1, 2) group by 1)",
            f"p{r + 1} as materialized (select c, {unit} as v from s{r} union all select c, v from p{r} where c not in (select c from s{r}))",
        ]
    steps.append(f"sim as (select un.vec_id, any_value(lost) as lost, any_value(destination) as destination, any_value(novelty) as novelty, max(list_dot_product(un.v, p.v)) as similarity from un, p{rounds} p group by 1)")
    return "with " + ", ".join(steps) + " select vec_id, round(similarity, 6) as similarity, similarity >= 0.3 and lost > 0.05 as eligible, round(case when similarity >= 0.3 and lost > 0.05 then (similarity * 2 + destination + novelty * 0.5) / 3.5 end, 6) as acquisition from sim"


@query("c9_prototype_similarity", _prototypes())
def c9(spark, d):
    t = changes(spark, d)
    own = Q.prototypes(t.filter("label < 3"), "vec_id", "v", 3, 4, 72)
    return Q.prototype_scores(t, "v", own, F.col("destination"), F.col("novelty"), F.col("lost"), (2.0, 1.0, 0.5)).select("vec_id", "similarity", "eligible", "acquisition")


LEGEND = ["Nature", "Cropland", "Artificial"]
_AUDIT = f"""po as (select case when cell % 2 = 0 then 'orig' else 'b1' end as pool, id as plot, before || ' -> ' || after as assigned, score, stratum, y, yhat from pop),
dis as (select case when cell % 2 = 0 then 'orig' else 'b1' end as pool, id as plot, before || ' -> ' || after as assigned from labelled where y <> yhat),
fl as (select pool, plot, assigned from po where (pool, plot) not in (select (pool, plot) from dis) order by score desc, {K(81, "concat_ws('|', pool, plot)")}, pool, plot limit greatest(0, 500 - (select count(*) from dis))),
sup as (select 'sup' as "set", pool, plot, 'disagreement' as stratum, assigned, 1.0::double as incl_prob from dis union all select 'sup', pool, plot, 'uncertain', assigned, 1.0 from fl),
rest as (select * from po where pool = 'orig' and plot not in (select plot from sup where pool = 'orig')),
sz as (select stratum, count(*) as size, least(count(*), 10) as take from rest group by 1), rm as (select *, size - take as room, 300 - sum(take) over () as left_ from sz), sh as (select *, coalesce(room / nullif(sum(room) over (), 0) * left_, 0) as x from rm),
qt as (select stratum, size, (take + least(floor(x) + (row_number() over (order by round(x - floor(x), 9) desc, stratum) <= left_ - sum(floor(x)) over ())::int, room))::bigint as quota from sh),
rk as (select rest.*, row_number() over (partition by stratum order by {K(82, 'plot')}, plot) as rn from rest),
reg as (select 'reg' as "set", pool, plot, 'random' as stratum, assigned, quota / size as incl_prob from rk join qt using (stratum) where rn <= quota),
bo as (select *, pool || '_' || plot as id from (select * from sup union all select * from reg))"""


@query("s19_audit_draw", f"with {POP}, {_AUDIT} select \"set\", pool, plot, stratum, assigned, round(incl_prob, 6) as incl_prob, id, row_number() over (partition by \"set\" order by {K(83, 'concat_ws(chr(124), chr(34), id)')}, id) as rank from bo".replace("chr(34)", '"set"'))
def s19(spark, d):
    named = lambda t: t.select(F.when(F.col("cell") % 2 == 0, "orig").otherwise("b1").alias("pool"), F.col("id").alias("plot"), F.concat_ws(" -> ", "before", "after").alias("assigned"), "score", "stratum", "y", "yhat")
    dis = named(labelled(spark, d)).filter("y <> yhat").select("pool", "plot", "assigned")
    return audit.audit_draw(dis, named(population(spark, d)), F.col("score"), "stratum", 500, 300, 10, LEGEND, "cannot interpret", 81)


def states(spark, d, odd: int):
    li = read(spark, d, "lineitem").filter(F.col("l_orderkey") % 2 == odd)
    return li.select(F.col("l_suppkey").alias("loc"), F.year("l_shipdate").alias("year"), (F.col("l_linenumber") % 3).cast("int").alias("state"), F.when(F.col("l_partkey") % 7 == 0, "pseudo").otherwise("observed").alias("kind"), (F.col("l_returnflag") == "R").alias("changed"), (F.col("l_quantity") / 10).alias("f0"), (F.col("l_tax") * 50).alias("f1"), (F.col("l_discount") * 50).alias("f2"))


def validated(spark, d):
    test = states(spark, d, 0)
    folds = states(spark, d, 1).select("loc").union(test.select("loc")).distinct().withColumn("fold", key(47, "loc") % 4)
    return validation.leave_out(states(spark, d, 1), test, folds, 4, ["f0", "f1", "f2"], test_year=1995)


_D = "(pow(t.f0 - c.f0, 2) + pow(t.f1 - c.f1, 2) + pow(t.f2 - c.f2, 2))"
_LLTO = f"""st as (select l_suppkey as loc, year(l_shipdate) as year, l_linenumber % 3 as state, case when l_partkey % 7 = 0 then 'pseudo' else 'observed' end as kind, l_returnflag = 'R' as changed, l_quantity / 10 as f0, l_tax * 50 as f1, l_discount * 50 as f2, l_orderkey % 2 as odd, row_number() over () as rid, {K(47, 'l_suppkey')} % 4 as fold from lineitem),
k as (select unnest(range(0, 4)) as k), tr as (select st.*, k from st, k where odd = 1 and year <> 1995 and fold <> k),
c1 as (select k, state, avg(f0) as f0, avg(f1) as f1, avg(f2) as f2 from tr where kind <> 'pseudo' group by 1, 2),
br as (select t.k, t.rid, any_value(t.f0) as f0, any_value(t.f1) as f1, any_value(t.f2) as f2, min({{'d': round({_D}, 9), 's': c.state}}).s as state from tr t join c1 c on c.k = t.k where t.kind = 'pseudo' group by 1, 2),
c2 as (select k, state, avg(f0) as f0, avg(f1) as f1, avg(f2) as f2 from (select k, state, f0, f1, f2 from tr where kind <> 'pseudo' union all select k, state, f0, f1, f2 from br) group by 1, 2),
sc as (select t.fold, t.rid, any_value(t.state) as truth, any_value(t.changed) as changed, min({{'d': round({_D}, 9), 's': c.state}}).s as pred from st t join c2 c on c.k = t.fold where odd = 0 and kind = 'observed' and year = 1995 group by 1, 2)"""


def _scores(by: str, source: str) -> str:
    return f"cls as (select {by}, c, count(*) filter (truth = c) as support, count(*) filter (pred = c) as called, count(*) filter (truth = c and pred = c) as tp from {source}, (select unnest([0, 1, 2]) as c) group by all having support > 0), me as (select {by}, avg(tp / support) as balanced, avg(2 * tp / (support + called)) as macro_f1 from cls group by 1), al as (select {by}, count(*) as n, avg((truth = pred)::int) as accuracy from {source} group by 1)"


@query("c33_leave_out_reads", f"with {_LLTO}, rd as (select unnest(['all', case when changed then 'changed' else 'stable' end]) as read, truth, pred from sc), {_scores('read', 'rd')} select read, n, round(accuracy, 6) as accuracy, round(balanced, 6) as balanced, round(macro_f1, 6) as macro_f1 from al join me using (read)")
def c33(spark, d):
    return validation.reads(validated(spark, d))


@query("c33_leave_out_folds", f"with {_LLTO}, {_scores('fold', 'sc')} select al.fold, n, (select count(*) from tr where tr.k = al.fold) as n_train, round(accuracy, 6) as accuracy, round(balanced, 6) as balanced, round(macro_f1, 6) as macro_f1 from al join me using (fold)")
def c33_folds(spark, d):
    return validation.fold_rows(validated(spark, d))
