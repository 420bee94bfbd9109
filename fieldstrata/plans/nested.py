"""Queries of choices made without the rows they are applied to: decision costs, conformal levels, e-values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.keyed import uniform
from ..operators import conformal as C
from ..operators import gates as G
from ..operators import metrics as M
from .registry import query
from .roles import POSTERIORS, posteriors

PROBS = ["p0", "p1", "p2"]
_GRID = "grid as (select round(0.8 + 0.2 * k, 2)::double as m from (select unnest(range(0, 12)) as k))"
_LAC = "round(1 - case truth when 0 then p0 when 1 then p1 else p2 end, 6)"


def _largest(a: str, b: str, c: str) -> str:
    return f"case when {a} >= {b} and {a} >= {c} then 0 when {b} >= {c} then 1 else 2 end"


def _f1(of: str, by: str) -> str:
    """Mean F1 of the classes in the truth, from counts ``of`` (truth, pred, n) by some columns."""
    counts = f"select {by}, cls, sum(case when truth = cls and pred = cls then n else 0 end) as tp, sum(case when truth = cls then n else 0 end) as support, sum(case when pred = cls then n else 0 end) as called from {of}, (select unnest([0, 1, 2]) as cls) group by all"
    return f"select {by}, avg(2 * tp / greatest(support + called, 1)) as score from ({counts}) where support > 0 group by all"


def _ascent(steps: list[str], start: str, other: str) -> list[str]:
    """The common table expressions of coordinate ascent: s0, s1, ... have the costs w0, w1, w2 by fold after each step. A
    step's class is a number, or a column of a table targets (fold, turn, cls) by its turn."""
    out = [f"s0 as ({start})"]
    for i, cls in enumerate(steps):
        j = cls if cls.isdigit() else "cls"
        at = f"s{i}" if cls.isdigit() else f"(select s{i}.*, cls from s{i} join targets using (fold) where turn = {cls[1:]})"
        own = f"case {j} when 0 then w0 when 1 then w1 else w2 end"
        w = [f"p.p{k} * case when c.j = {k} then c.m else c.w{k} end" for k in range(3)]
        out += [
            f"o{i} as (select a.*, {j} as j, m, 0 as base from {at} a, grid union all select a.*, {j}, {own}, 1 from {at} a)",
            f"t{i} as materialized (select c.fold, c.m, c.base, truth, {_largest(*w)} as pred, count(*) as n from post p join o{i} c on {other} group by all)",
            f"r{i} as (select *, row_number() over (partition by fold order by round(score, 9) desc, base desc, m) as rn from ({_f1(f't{i}', 'fold, m, base')}))",
            f"s{i + 1} as materialized (select o.fold, " + ", ".join(f"case when o.j = {k} then o.m else o.w{k} end as w{k}" for k in range(3)) + f" from o{i} o join r{i} r on o.fold is not distinct from r.fold and o.m = r.m and o.base = r.base where rn = 1)",
        ]
    return out


_START = "select fold, 1.0::double as w0, 1.0::double as w1, 1.0::double as w2 from (select distinct fold from post)"
_HITS = f"count(*) as n, count(*) filter (truth = {_largest('p0 * w0', 'p1 * w1', 'p2 * w2')}) as hits"


def _table(spark, costs, head="fold bigint"):
    return spark.createDataFrame([(f, *c) for f, c in costs.items()], f"{head}, w0 double, w1 double, w2 double")


def _applied(spark, d, costs):
    t = G.gated(posteriors(spark, d), PROBS, "fold", costs).groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("truth")).alias("hits"))
    return _table(spark, costs).join(t, "fold")


@query("c24_nested_costs", f"with {POSTERIORS}, {_GRID}, " + ", ".join(_ascent(["0", "1", "2"] * 2, _START, "p.fold <> c.fold")) + f" select s.fold, w0, w1, w2, {_HITS} from s6 s join post on post.fold = s.fold group by all")
def c24_all(spark, d):
    return _applied(spark, d, G.nested_costs(posteriors(spark, d), PROBS, "truth", "fold"))


@query("c24_single_cost", f"with {POSTERIORS}, {_GRID}, " + ", ".join(_ascent(["2"], _START, "p.fold <> c.fold")) + f" select s.fold, w0, w1, w2, {_HITS} from s1 s join post on post.fold = s.fold group by all")
def c24_one(spark, d):
    return _applied(spark, d, G.nested_costs(posteriors(spark, d), PROBS, "truth", "fold", [2], passes=1))


@query("c24_shipped_costs", f"with {POSTERIORS}, {_GRID}, " + ", ".join(_ascent(["1", "2"] * 2, "select null::bigint as fold, 1.0::double as w0, 1.0::double as w1, 1.0::double as w2", "true")) + f" select w0, w1, w2, {_HITS} from s4 s, post group by all")
def c24_shipped(spark, d):
    costs = G.nested_costs(posteriors(spark, d), PROBS, "truth", None, [1, 2])
    t = G.gated(posteriors(spark, d), PROBS, None, costs).agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("truth")).alias("hits"))
    return _table(spark, costs).drop("fold").crossJoin(t)  # one row each


_COUNTS = f"cnt as materialized (select fold, truth as cls, {_LAC} as s, count(*) as n from post group by all), folds as (select distinct fold from post)"
_PAIRS = "pr as (select a.fold as lo, b.fold as hi from folds a join folds b on a.fold < b.fold), both_ as (select lo, hi, lo as outer_, hi as inner_ from pr union all select lo, hi, hi, lo from pr)"


def _quantiles(name: str, source: str, by: str, levels: str) -> str:
    """Thresholds q by some columns and alpha, from counted scores."""
    run = f"select {by}, s, sum(n) over (partition by {by} order by s) as upto, sum(n) over (partition by {by}) as n_all from (select {by}, s, sum(n) as n from {source} group by all)"
    return f"{name} as materialized (select {by}, alpha, coalesce(min(case when upto >= ceil(round((n_all + 1) * (1 - alpha), 9)) then s end), 'infinity'::double) as q from ({run}), (select unnest({levels}::double[]) as alpha) group by all)"


_SHORT = f"""{_COUNTS}, {_PAIRS}, {_quantiles('q', '(select lo, hi, cls, s, n from cnt join pr on fold <> lo and fold <> hi)', 'lo, hi, cls', '[0.1]')},
cov as (select outer_ as fold, inner_, q.cls, sum(case when s <= least(q, 1) then n else 0 end) / sum(n) as c from q join both_ using (lo, hi) join cnt on cnt.fold = inner_ and cnt.cls = q.cls group by all),
short as (select fold, cls, 0.9::double - avg(c) as shortfall from cov group by all),
targets as materialized (select fold, cls, shortfall, row_number() over (partition by fold order by round(shortfall, 9) desc, cls) - 1 as turn from short qualify turn < 2)"""


@query("c25_focus_gate", f"with {POSTERIORS}, {_GRID}, {_SHORT}, " + ", ".join(_ascent(["t0", "t1"] * 2, _START, "p.fold <> c.fold")) + " select fold, turn::bigint as turn, cls::bigint as cls, round(shortfall, 6) as shortfall, case cls when 0 then w0 when 1 then w1 else w2 end as cost from targets join s4 using (fold)")
def c25(spark, d):
    t = posteriors(spark, d)
    score = F.round(1 - F.get(F.array(*PROBS), F.col("truth")), 6)
    targets, costs = G.focus_costs(t, PROBS, "truth", "fold", score, 0.1, 2)
    rows = spark.createDataFrame([(f, i, c, costs[f][c]) for f, own in targets.items() for i, c in enumerate(own)], "fold bigint, turn bigint, cls bigint, cost double")
    return rows.join(C.shortfall(t, "fold", "truth", score, 0.1).withColumnRenamed("outer", "fold"), ["fold", "cls"])


ALPHAS = [0.01, 0.05, 0.1, 0.2, 0.3, 0.5]
_LIST = str(ALPHAS)
_GAP = "least(q{k}, 1) - round(1 - p{k}, 6)"
_WIDE = ", ".join(f"coalesce(max(q) filter (cls = {k}), 'infinity'::double) as q{k}" for k in range(3))


@query("c21_nested_alpha", f"""with {POSTERIORS}, {_COUNTS}, {_PAIRS}, {_quantiles('q', '(select lo, hi, cls, s, n from cnt join pr on fold <> lo and fold <> hi)', 'lo, hi, cls', _LIST)},
w as (select outer_, inner_, alpha, {_WIDE} from q join both_ using (lo, hi) group by all),
lab as materialized (select outer_, alpha, truth, {_largest(*[_GAP.format(k=k) for k in range(3)])} as pred, count(*) as n from post join w on post.fold = inner_ group by all),
best as (select *, row_number() over (partition by outer_ order by round(score, 9) desc, alpha) as rn from ({_f1('lab', 'outer_, alpha')})),
{_quantiles('f', '(select o.fold as outer_, cls, s, n from cnt join folds o on cnt.fold <> o.fold)', 'outer_, cls', _LIST)},
fw as (select f.outer_, f.alpha, any_value(score) as score, {_WIDE} from f join best on best.outer_ = f.outer_ and best.alpha = f.alpha and rn = 1 group by all)
select fold, alpha, round(score, 6) as macro_f1, count(*) as n, count(*) filter (truth = {_largest(*[_GAP.format(k=k) for k in range(3)])}) as hits from post join fw on fold = outer_ group by all""")
def c21(spark, d):
    t = posteriors(spark, d).withColumn("scores", F.array(*[F.round(1 - F.col(p), 6) for p in PROBS]))
    labelled, chosen = C.nested_alpha(t, "fold", "truth", "scores", 3, ALPHAS)
    hits = labelled.groupBy("fold", "alpha").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("truth")).alias("hits"))
    return hits.join(chosen.select(F.col("outer").alias("fold"), "macro_f1"), "fold")


_SCORE = "round((1 - {p}) * (1 + {k} / 100.0::double), 3)"
_SOFT = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
_LOGE = "exp(-ln(0.1::double) + " + _SOFT.format(x="({c} * (0.1 - s_))") + " - " + _SOFT.format(x="({c} * ({p} - s_))") + ")"
_MEAN = "list_sum(list_transform(range(1, m + 2), lambda k: " + _LOGE.format(c="pow(10, {x})", p="k / (m + 1)") + ")) / (m + 1) - 1"


def _e_values() -> str:
    asked = " union all ".join(f"select id, truth, k as fold, {c} as cls, {_SCORE.format(p=f'p{c}', k='k')} as s from post, (select unnest(range(1, 5)) as k) where post.fold = 0" for c in range(3))
    return f"""with recursive {POSTERIORS}, cal as materialized (select fold, truth as cls, {_SCORE.format(p='case truth when 0 then p0 when 1 then p1 else p2 end', k='fold')} as s from post where fold > 0),
sz as (select fold, cls, count(*) as m, 0.1 + 0.5 * (ceil(0.1::double * (count(*) + 1)) / (count(*) + 1) - 0.1) as s_ from cal group by all having ceil(0.1::double * (count(*) + 1)) / (count(*) + 1) > 0.1),
top as materialized (select fold, cls, m, s_, min(h)::double as hi from sz, (select unnest(range(3, 13)) as h) where {_MEAN.format(x='h')} <= 0 group by all),
bis as (select fold, cls, m, s_, -8.0::double as lo, hi, 0 as i from top union all select fold, cls, m, s_, case when up then mid else lo end, case when up then hi else mid end, i + 1 from (select *, (lo + hi) / 2 as mid, {_MEAN.format(x='((lo + hi) / 2)')} > 0 as up from bis where i < 60)),
con as (select fold, cls, m, s_, pow(10, (lo + hi) / 2) as c from bis where i = 60),
asked as materialized ({asked}),
reach as (select fold, cls, s, sum(n) over (partition by fold, cls order by s desc) as above from (select fold, cls, s, sum(n) as n from (select fold, cls, s, 1 as n from cal union all select distinct fold, cls, s, 0 from asked) group by all)),
n as (select fold, cls, count(*) as m_all from cal group by all),
e as (select id, truth, cls, a.fold, case when c is null then 1.0 else {_LOGE.format(c='c', p='((above + 1) / (m_all + 1))')} end as e from asked a join reach using (fold, cls, s) join n using (fold, cls) left join con using (fold, cls)),
g as (select id, truth, cls, e, avg(e) over (partition by id, cls order by fold) as run, avg(e) over (partition by id, cls) as mean from e),
v as (select 'rand' as variant, truth, cls, any_value(mean) as e, any_value(mean) < (('0x' || substr(md5('53|' || id), 1, 13))::bigint / 4503599627370496.0) / 0.1 as inside_ from g group by id, truth, cls union all select 'max', truth, cls, max(run), max(run) < 10 from g group by id, truth, cls)
select variant, cls::bigint as cls, count(*) as n, count(*) filter (inside_) as inside, count(*) filter (truth = cls) as own, count(*) filter (truth = cls and inside_) as covered from v group by all"""


@query("c18_e_values", _e_values())
def c18(spark, d):
    t = posteriors(spark, d)
    score = lambda p, k: F.round((1 - p) * (1 + k / 100.0), 3)
    cal = t.filter("fold > 0").select("fold", F.col("truth").alias("cls"), score(F.get(F.array(*PROBS), F.col("truth")), F.col("fold")).alias("s"))
    models = F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(c).alias("cls"), score(F.col(p), F.lit(k)).alias("s")) for k in range(1, 5) for c, p in enumerate(PROBS)])
    asked = t.filter("fold = 0").select(F.struct("id", "truth").alias("row"), F.explode(models).alias("x")).select("row", "x.*")
    values = C.e_values(cal, asked, 0.1)
    out = C.e_value_both(values, "row", 0.1, uniform(53, F.col("row.id"))).select("variant", "row.truth", "cls", "inside")
    own = F.col("truth") == F.col("cls")
    return out.groupBy("variant", "cls").agg(F.count("*").alias("n"), F.count_if("inside").alias("inside"), F.count_if(own).alias("own"), F.count_if(own & F.col("inside")).alias("covered"))
