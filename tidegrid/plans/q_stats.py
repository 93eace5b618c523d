"""Queries of the statistical operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidegrid.functions.stats import TAIL_DENOMINATOR, TAIL_NUMERATOR
from tidegrid.operators import bootstrap as bs, dm, joins, mcs, metrics as me, series_tests as st
from tidegrid.operators.chunked import join_null_safe
from tidegrid.plans import derive
from tidegrid.plans.derive import MODELS, PN, PR, with_cte
from tidegrid.plans.q_eval import _RG, SERIES, _r, regimes
from tidegrid.plans.registry import query


def _horner_sql(x: str, cs: list[float]) -> str:
    out = repr(cs[0]) + "::DOUBLE"
    for c in cs[1:]:
        out = f"({out}) * {x} + {c!r}::DOUBLE"
    return out


def _p_sql(z: str) -> str:
    return (
        f"2 * CASE WHEN abs({z}) < 7.07106781186547 THEN exp(-{z} * {z} / 2) * ({_horner_sql(f'abs({z})', TAIL_NUMERATOR)}) "
        f"/ ({_horner_sql(f'abs({z})', TAIL_DENOMINATOR)}) ELSE exp(-{z} * {z} / 2) / (abs({z}) + 1 / (abs({z}) + 2 / (abs({z}) + 3 / (abs({z}) + 4 / (abs({z}) + 0.65))))) / {math.sqrt(2 * math.pi)!r} END"
    )


_DMCORE = (
    "lg AS (SELECT *, " + ", ".join(f"lag(d, {k}) OVER w AS d{k}" for k in range(1, 24))
    + " FROM dd WINDOW w AS (PARTITION BY {k} ORDER BY ds)),\n"
    "vr AS (SELECT {k}, avg(d) AS m, count(*) AS n, var_samp(d) + "
    + " + ".join(f"2 * (1 - {k} / 24.0::DOUBLE) * covar_samp(d{k}, d)" for k in range(1, 24))
    + " AS v FROM lg GROUP BY ALL),\n"
    "ts_ AS (SELECT {k}, CASE WHEN v > 0 THEN m / sqrt(v / n) END AS dm_statistic FROM vr)"
)
_DM2 = """
dd AS (SELECT a.tso, a.unique_id, a.model, a.ds, (a.y - a.y_pred) * (a.y - a.y_pred) - (a.y - b.p2) * (a.y - b.p2) AS d
 FROM pr a JOIN (SELECT tso, unique_id, ds, model, y_pred * 0.9 + 2 AS p2 FROM pr) b USING (tso, unique_id, ds, model))
"""


def _second(p):
    return p.withColumn("y_pred", F.col("y_pred") * 0.9 + 2)


@query(
    "sta1_sta2_dm_two_sets",
    with_cte(PN, PR, _DM2, _DMCORE.replace("{k}", "tso, unique_id, model"))
    + f"SELECT tso, unique_id, model, round(dm_statistic, 5) AS dm_statistic, round({_p_sql('dm_statistic')}, 5) AS p_value FROM ts_",
)
def sta2(spark, d):
    p = derive.predictions(spark, d)
    out = dm.compare_sets(p, _second(p), dense=True).drop("n")
    return _r(out, "dm_statistic", "p_value", n=5)


_PAIR = """
wd AS (SELECT tso, unique_id, ds, max(y) AS y, max(y_pred) FILTER (WHERE model = 'blend') AS m0, max(y_pred) FILTER (WHERE model = 'damped') AS m1,
 max(y_pred) FILTER (WHERE model = 'naive') AS m2, max(y_pred) FILTER (WHERE model = 'seasonal') AS m3 FROM pr GROUP BY ALL),
dd AS (SELECT tso, unique_id, ds, 'blend' AS model, 'damped' AS rival, (y-m0)*(y-m0)-(y-m1)*(y-m1) AS d FROM wd
 UNION ALL SELECT tso, unique_id, ds, 'blend', 'naive', (y-m0)*(y-m0)-(y-m2)*(y-m2) FROM wd UNION ALL SELECT tso, unique_id, ds, 'blend', 'seasonal', (y-m0)*(y-m0)-(y-m3)*(y-m3) FROM wd
 UNION ALL SELECT tso, unique_id, ds, 'damped', 'naive', (y-m1)*(y-m1)-(y-m2)*(y-m2) FROM wd UNION ALL SELECT tso, unique_id, ds, 'damped', 'seasonal', (y-m1)*(y-m1)-(y-m3)*(y-m3) FROM wd
 UNION ALL SELECT tso, unique_id, ds, 'naive', 'seasonal', (y-m2)*(y-m2)-(y-m3)*(y-m3) FROM wd)
"""


@query(
    "sta3_pairwise_dm",
    with_cte(PN, PR, _PAIR, _DMCORE.replace("{k}", "tso, unique_id, model, rival"))
    + f"""SELECT tso, unique_id, model, rival, round(dm_statistic, 5) AS dm_statistic, round({_p_sql('dm_statistic')}, 5) AS p_value FROM ts_
UNION ALL SELECT tso, unique_id, model, model, 0.0, 1.0 FROM (SELECT DISTINCT tso, unique_id, model FROM pr)""",
)
def sta3(spark, d):
    out = dm.pairwise(derive.predictions(spark, d), SERIES, MODELS, dense=True)
    return _r(out, "dm_statistic", "p_value", n=5)


@query(
    "sta4_rejection_shares",
    with_cte(PN, PR, _DM2, _DMCORE.replace("{k}", "tso, unique_id, model"))
    + f""", t AS (SELECT *, {_p_sql('dm_statistic')} AS p FROM ts_),
c AS (SELECT tso, unique_id, CASE WHEN avg(CASE WHEN y = 0 THEN 1 ELSE 0 END) >= 0.35 THEN 'Sparse' ELSE 'Dense' END AS sparsity_class FROM pn GROUP BY ALL)
SELECT model, sparsity_class, round(avg(CASE WHEN p < 0.05 AND dm_statistic > 0 THEN 1 ELSE 0 END), 8) AS expected, round(avg(CASE WHEN p < 0.05 AND dm_statistic < 0 THEN 1 ELSE 0 END), 8) AS unexpected
FROM t JOIN c USING (tso, unique_id) GROUP BY ALL""",
)
def sta4(spark, d):
    p = derive.predictions(spark, d)
    tests = dm.compare_sets(p, _second(p), dense=True)
    classes = me.series_class(derive.panel(spark, d), SERIES, 0.35)
    return _r(dm.rejection_shares(tests, classes, SERIES), "expected", "unexpected")


# bootstrap with starts by integer arithmetic, resampled row by row in the SQL
REPS = 20
# a whole Model Confidence Set, as many as in the results to match
MCS_REPS = 5000


def _resample(slice_cte: str, keys: str, block: str, circular: bool, reps: int = REPS) -> str:
    room = "n" if circular else "n - bl + 1"
    return f"""
{slice_cte},
nn AS (SELECT {keys}, count(*) AS n, CAST({block} AS BIGINT) AS bl FROM rowsx GROUP BY ALL),
ix AS (SELECT {keys}, rep, t, ((rep * 7919 + (t // bl) * 104729 + 17) % ({room}) + t % bl) % n AS pos
 FROM nn, range({reps}) r(rep), LATERAL (SELECT unnest(range(n)) AS t))
"""


_WIDE_SQL = """
wx AS (SELECT {keys}, ds, max(y) AS y, max(y_pred) FILTER (WHERE model = 'blend') AS m0, max(y_pred) FILTER (WHERE model = 'damped') AS m1,
 max(y_pred) FILTER (WHERE model = 'naive') AS m2, max(y_pred) FILTER (WHERE model = 'seasonal') AS m3 FROM {src} GROUP BY ALL),
rowsx AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ds) - 1 AS pos FROM wx)
"""


def _fb(i: int) -> str:
    tp = f"sum(CASE WHEN y > 0 AND m{i} > 0 THEN 1 ELSE 0 END)"
    fp = f"sum(CASE WHEN y <= 0 AND m{i} > 0 THEN 1 ELSE 0 END)"
    fn = f"sum(CASE WHEN y > 0 AND m{i} <= 0 THEN 1 ELSE 0 END)"
    return f"coalesce(5.0::DOUBLE * {tp} / nullif(5.0 * {tp} + 4.0 * {fn} + {fp}, 0), 0) AS f{i}"


def _fb_cte(keys: str, src: str = "pr", block: str = "24") -> str:
    return (
        _resample(_WIDE_SQL.format(keys=keys, src=src).strip(), keys, block, False).strip()
        + f""",
fr AS (SELECT {keys}, rep, {', '.join(_fb(i) for i in range(4))} FROM ix JOIN rowsx USING ({keys}, pos) GROUP BY ALL),
fl AS (SELECT {keys}, rep, greatest(f0, f1, f2, f3) AS best, unnest(['blend', 'damped', 'naive', 'seasonal']) AS model, unnest([f0, f1, f2, f3]) AS f FROM fr)"""
    )


def _replicates(df, keys, block=24):
    return bs.fbeta_replicates(df, keys, MODELS, block, REPS, 2.0, bs.integer_draw(17))


@query(
    "sta5_sta6_bootstrap_deltas",
    with_cte(PN, PR, _fb_cte("tso, unique_id"))
    + "SELECT tso, unique_id, CAST(rep AS INT) AS rep, model, round(f - best, 8) AS delta FROM fl",
)
def sta6(spark, d):
    reps = _replicates(derive.predictions(spark, d), SERIES)
    return _r(bs.fbeta_deltas(reps, SERIES, MODELS), "delta")


_SUP = """
sp AS (SELECT {keys}, a.model, b.model AS rival, avg(CASE WHEN a.f > b.f THEN 1.0 WHEN a.f = b.f THEN 0.5 ELSE 0.0 END) AS p
 FROM fl a JOIN fl b USING ({keys}, rep) GROUP BY ALL)
"""


@query(
    "sta7_paired_superiority",
    with_cte(PN, PR, _fb_cte("tso, unique_id"), _SUP.format(keys="tso, unique_id"))
    + "SELECT tso, unique_id, model, rival, round(p, 8) AS p FROM sp",
)
def sta7(spark, d):
    return _r(bs.superiority(_replicates(derive.predictions(spark, d), SERIES), SERIES, MODELS), "p")


@query(
    "sta8_sta9_acceptance",
    with_cte(PN, PR, _fb_cte("tso, unique_id"))
    + """SELECT tso, unique_id, model, round(avg(CASE WHEN f - best >= -0.02 THEN 1 ELSE 0 END), 8) AS share, avg(CASE WHEN f - best >= -0.02 THEN 1 ELSE 0 END) >= 0.9 AS accepted FROM fl GROUP BY ALL""",
)
def sta8(spark, d):
    reps = _replicates(derive.predictions(spark, d), SERIES)
    return _r(bs.acceptance(reps, SERIES, MODELS, 0.02, 0.1), "share")


@query(
    "sta10_per_window_superiority",
    with_cte(PN, PR, _fb_cte("window_index, tso, unique_id"), _SUP.format(keys="window_index, tso, unique_id"))
    + "SELECT window_index, tso, unique_id, model, rival, round(p, 8) AS p FROM sp",
)
def sta10(spark, d):
    keys = ["window_index", *SERIES]
    return _r(bs.superiority(_replicates(derive.predictions(spark, d), keys), keys, MODELS), "p")


_DOM = """
dm_ AS (SELECT {keys}, model, sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) / 3.0 AS d FROM sp GROUP BY ALL)
"""


@query(
    "sta11_model_dominance",
    with_cte(PN, PR, _fb_cte("tso, unique_id"), _SUP.format(keys="tso, unique_id"), _DOM.format(keys="tso, unique_id"))
    + "SELECT model, round(avg(d), 8) AS dominance FROM dm_ GROUP BY model",
)
def sta11(spark, d):
    sup = bs.superiority(_replicates(derive.predictions(spark, d), SERIES), SERIES, MODELS)
    return _r(bs.dominance(sup, SERIES), "dominance")


@query(
    "sta11_dominance_per_regime",
    with_cte(
        PN, PR, _RG, "rp AS (SELECT regime, pr.* FROM pr JOIN rg ON ds >= lo AND ds < hi)",
        _fb_cte("regime, tso, unique_id", "rp"), _SUP.format(keys="regime, tso, unique_id"), _DOM.format(keys="regime, tso, unique_id"),
    )
    + "SELECT regime, model, round(avg(d), 8) AS dominance FROM dm_ GROUP BY ALL",
)
def sta11_regime(spark, d):
    rows = joins.in_windows(derive.predictions(spark, d), regimes(spark), "ds", "lo", "hi")
    keys = ["regime", *SERIES]
    return _r(bs.dominance(bs.superiority(_replicates(rows, keys), keys, MODELS), SERIES, ["regime"]), "dominance")


@query(
    "sta11_dominance_per_horizon",
    with_cte(
        PN, PR, _fb_cte("horizon, tso, unique_id", "pr", "5"),
        _SUP.format(keys="horizon, tso, unique_id"), _DOM.format(keys="horizon, tso, unique_id"),
    )
    + "SELECT horizon, model, round(avg(d), 8) AS dominance FROM dm_ GROUP BY ALL",
)
def sta11_horizon(spark, d):
    keys = ["horizon", *SERIES]
    reps = _replicates(derive.predictions(spark, d), keys, 5)
    return _r(bs.dominance(bs.superiority(reps, keys, MODELS), SERIES, ["horizon"]), "dominance")


@query(
    "sta11_dominance_by_sparsity",
    with_cte(PN, PR, _fb_cte("tso, unique_id"), _SUP.format(keys="tso, unique_id"), _DOM.format(keys="tso, unique_id"))
    + """, c AS (SELECT tso, unique_id, CASE WHEN avg(CASE WHEN y = 0 THEN 1 ELSE 0 END) >= 0.35 THEN 'Sparse' ELSE 'Dense' END AS sparsity_class FROM pn GROUP BY ALL)
SELECT sparsity_class, model, round(avg(d), 8) AS dominance FROM dm_ JOIN c USING (tso, unique_id) GROUP BY ALL""",
)
def sta11_class(spark, d):
    sup = bs.superiority(_replicates(derive.predictions(spark, d), SERIES), SERIES, MODELS)
    classes = me.series_class(derive.panel(spark, d), SERIES, 0.35)
    return _r(bs.dominance(sup.join(classes, SERIES), SERIES, ["sparsity_class"]), "dominance")


# model confidence set, elimination written out round by round
_MODELS_SQL = "['blend', 'damped', 'naive', 'seasonal']"


_STATIONARY = f"""
bk AS (SELECT *, (rep * 7919 + 2 * block * 104729 + 17) % n AS start, CAST(floor(ln(1 - ((rep * 7919 + (2 * block + 1) * 104729 + 17) % 1000003) / 1000003.0::DOUBLE) / ln(1 - 1.0::DOUBLE / bl)) + 1 AS BIGINT) AS len
 FROM nn, range({REPS}) r(rep), LATERAL (SELECT unnest(range(n)) AS block)),
bc AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY {{keys}}, rep ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM bk),
ix AS (SELECT {{keys}}, rep, (start + k) % n AS pos FROM bc, LATERAL (SELECT unnest(range(CAST(least(len, n - done) AS BIGINT))) AS k) WHERE done < n)
"""


def _mcs_cte(keys: str, src: str = "pr", stationary: bool = False, reps: int = REPS) -> str:
    pairs = [(i, j) for i in range(4) for j in range(4)]
    on = keys.replace(" ", "").split(",")
    eq = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in on)
    first = _resample(_WIDE_SQL.format(keys=keys, src=src).strip(), keys, "floor(sqrt(count(*)))", True, reps).strip()
    if stationary:
        first = first[: first.index(",\nix AS")] + ",\n" + _STATIONARY.format(keys=keys).strip()
    parts = [
        first,
        f"ml AS (SELECT {keys}, [{', '.join(f'avg(abs(y - m{i}))' for i in range(4))}] AS d FROM rowsx GROUP BY ALL)",
        f"bl AS (SELECT {keys}, rep, [{', '.join(f'avg(abs(y - m{i}))' for i in range(4))}] AS b FROM ix JOIN rowsx USING ({keys}, pos) GROUP BY ALL)",
        f"pj AS (SELECT ml.*, p.i, p.j, rep, b[p.j] - b[p.i] AS db, d[p.j] - d[p.i] AS dd FROM bl JOIN ml USING ({keys}), "
        f"(VALUES {', '.join(f'({i + 1}, {j + 1})' for i, j in pairs)}) p(i, j))",
        f"sd AS (SELECT {keys}, i, j, any_value(dd) AS dd, sqrt(avg((db - dd) * (db - dd)) + CASE WHEN i = j THEN 1 ELSE 0 END) AS s FROM pj GROUP BY {keys}, i, j)",
        f"z0 AS (SELECT pj.*, sd.s FROM pj JOIN sd USING ({keys}, i, j))",
        f"in1 AS (SELECT {keys}, unnest([1, 2, 3, 4]) AS m FROM ml)",
    ]
    for r in (1, 2, 3):
        k = 5 - r
        parts += [
            f"zz{r} AS (SELECT z.* FROM z0 z JOIN in{r} a ON {eq('a', 'z')} AND a.m = z.i JOIN in{r} b ON {eq('b', 'z')} AND b.m = z.j)",
            *(
                [
                    f"tr{r} AS (SELECT {keys}, sum(dd / s * dd / s) / 2 AS tr FROM zz{r} GROUP BY ALL)",
                    f"tb{r} AS (SELECT {keys}, rep, sum((db - dd) / s * (db - dd) / s) / 2 AS tb FROM zz{r} GROUP BY ALL)",
                ]
                if stationary
                else [
                    f"tr{r} AS (SELECT {keys}, max(dd / s) AS tr FROM zz{r} GROUP BY ALL)",
                    f"tb{r} AS (SELECT {keys}, rep, max(abs((db - dd) / s)) AS tb FROM zz{r} GROUP BY ALL)",
                ]
            ),
            f"pv{r} AS (SELECT {keys}, avg(CASE WHEN tb > tr THEN 1.0 ELSE 0.0 END) AS p FROM tb{r} JOIN tr{r} USING ({keys}) GROUP BY ALL)",
            f"di{r} AS (SELECT {keys}, j, rep, sum(db) / {k - 1}.0 AS dib, sum(dd) / {k - 1}.0 AS di FROM zz{r} GROUP BY ALL)",
            f"ti{r} AS (SELECT {keys}, j, any_value(di) / sqrt(avg((dib - di) * (dib - di))) AS t FROM di{r} GROUP BY ALL)",
            f"ex{r} AS (SELECT {keys}, arg_max(j, t) AS m FROM ti{r} GROUP BY ALL)",
            f"in{r + 1} AS (SELECT a.* FROM in{r} a LEFT JOIN ex{r} e ON {eq('a', 'e')} AND a.m = e.m WHERE e.m IS NULL)",
        ]
    parts.append(
        "ms_ AS ("
        + " UNION ALL ".join(
            f"SELECT {keys}, {_MODELS_SQL}[m] AS model, {r - 1} AS round, p FROM ex{r} JOIN pv{r} USING ({keys})" for r in (1, 2, 3)
        )
        + f" UNION ALL SELECT {keys}, {_MODELS_SQL}[m], 3, 1.0 FROM in4)"
    )
    parts.append(
        f"mc AS (SELECT {keys}, model, CAST(round AS INT) AS round, max(p) OVER (PARTITION BY {keys} ORDER BY round) AS p_value FROM ms_)"
    )
    return ",\n".join(parts)


def _mcs(df, keys, reps=REPS, **kw):
    return mcs.model_confidence_set(df, keys, MODELS, 0.25, reps=reps, draw=bs.integer_draw(17), **kw)


@query(
    "sta13_sta14_sta15_model_confidence_set",
    with_cte(PN, PR, _mcs_cte("tso, unique_id", reps=MCS_REPS))
    + "SELECT tso, unique_id, model, round, round(p_value, 8) AS p_value, p_value >= 0.25 AS included FROM mc",
)
def sta14(spark, d):
    return _r(_mcs(derive.predictions(spark, d), SERIES, MCS_REPS), "p_value")


@query(
    "sta16_mcs_inclusion_rate",
    with_cte(PN, PR, _mcs_cte("tso, unique_id"))
    + "SELECT model, round(avg(CASE WHEN p_value >= 0.25 THEN 1 ELSE 0 END), 8) AS inclusion FROM mc GROUP BY model",
)
def sta16(spark, d):
    return _r(mcs.inclusion_rate(_mcs(derive.predictions(spark, d), SERIES)), "inclusion")


@query(
    "sta16_mcs_by_sparsity",
    with_cte(PN, PR, _mcs_cte("tso, unique_id"))
    + """, c AS (SELECT tso, unique_id, CASE WHEN avg(CASE WHEN y = 0 THEN 1 ELSE 0 END) >= 0.35 THEN 'Sparse' ELSE 'Dense' END AS sparsity_class FROM pn GROUP BY ALL)
SELECT sparsity_class, model, round(avg(CASE WHEN p_value >= 0.25 THEN 1 ELSE 0 END), 8) AS inclusion FROM mc JOIN c USING (tso, unique_id) GROUP BY ALL""",
)
def sta16_class(spark, d):
    out = _mcs(derive.predictions(spark, d), SERIES).join(
        me.series_class(derive.panel(spark, d), SERIES, 0.35), SERIES
    )
    return _r(mcs.inclusion_rate(out, ["sparsity_class"]), "inclusion")


@query(
    "sta16_mcs_per_regime",
    with_cte(
        PN, PR, _RG, "rp AS (SELECT regime, pr.* FROM pr JOIN rg ON ds >= lo AND ds <= hi)",
        _mcs_cte("regime, tso, unique_id", "rp"),
    )
    + "SELECT regime, model, round(avg(CASE WHEN p_value >= 0.25 THEN 1 ELSE 0 END), 8) AS inclusion FROM mc GROUP BY ALL",
)
def sta16_regime(spark, d):
    rows = joins.in_windows(derive.predictions(spark, d), regimes(spark), "ds", "lo", "hi", closed=True)
    return _r(mcs.inclusion_rate(_mcs(rows, ["regime", *SERIES]), ["regime"]), "inclusion")


@query(
    "sta16_mcs_marks",
    with_cte(PN, PR, _mcs_cte("tso, unique_id", reps=MCS_REPS))
    + """SELECT tso, unique_id, max(CASE WHEN model = 'blend' AND p_value >= 0.25 THEN 'x' ELSE '' END) AS blend, max(CASE WHEN model = 'damped' AND p_value >= 0.25 THEN 'x' ELSE '' END) AS damped,
 max(CASE WHEN model = 'naive' AND p_value >= 0.25 THEN 'x' ELSE '' END) AS naive, max(CASE WHEN model = 'seasonal' AND p_value >= 0.25 THEN 'x' ELSE '' END) AS seasonal FROM mc GROUP BY ALL""",
)
def sta16_marks(spark, d):
    return mcs.inclusion_marks(_mcs(derive.predictions(spark, d), SERIES, MCS_REPS), SERIES, MODELS)


@query(
    "sta16_glued_summary",
    with_cte(PN, PR, _mcs_cte("tso, unique_id"), _fb_cte("tso, unique_id").replace("wx AS", "wx2 AS").replace("FROM wx)", "FROM wx2)")
             .replace("rowsx", "rowsy").replace("nn AS", "nn2 AS").replace("FROM nn,", "FROM nn2,").replace("ix AS", "ix2 AS").replace("FROM ix ", "FROM ix2 "),
             _SUP.format(keys="tso, unique_id"), _DOM.format(keys="tso, unique_id"))
    + """, a AS (SELECT model, avg(CASE WHEN p_value >= 0.25 THEN 1 ELSE 0 END) AS inclusion FROM mc GROUP BY model), b AS (SELECT model, avg(d) AS dominance FROM dm_ GROUP BY model)
SELECT model, round(inclusion, 8) AS inclusion, round(dominance, 8) AS dominance FROM a JOIN b USING (model)""",
)
def sta16_glued(spark, d):
    p = derive.predictions(spark, d)
    inc = mcs.inclusion_rate(_mcs(p, SERIES))
    dom = bs.dominance(bs.superiority(_replicates(p, SERIES), SERIES, MODELS), SERIES)
    return _r(inc.join(dom, "model"), "inclusion", "dominance")


@query(
    "sta12_mcs_stationary_bootstrap",
    with_cte(PN, PR, _mcs_cte("tso, unique_id", stationary=True))
    + "SELECT tso, unique_id, model, round, round(p_value, 8) AS p_value, p_value >= 0.25 AS included FROM mc",
)
def sta12(spark, d):
    return _r(_mcs(derive.predictions(spark, d), SERIES, variant="stationary", method="SQ"), "p_value")


_ACF = """
cn AS (SELECT tso, unique_id, ds, y - avg(y) OVER (PARTITION BY tso, unique_id) AS c FROM pn),
lc AS (SELECT *, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3 FROM cn WINDOW w AS (PARTITION BY tso, unique_id ORDER BY ds)),
ac AS (SELECT tso, unique_id, count(*) AS n, sum(c * c1) / sum(c * c) AS r1, sum(c * c2) / sum(c * c) AS r2, sum(c * c3) / sum(c * c) AS r3 FROM lc GROUP BY ALL),
ph AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS p2, r1 * (1 - r2) / (1 - r1 * r1) AS q1 FROM ac)
"""


@query(
    "sta17_acf_pacf",
    with_cte(PN, _ACF)
    + """SELECT tso, unique_id, CAST(unnest([0, 1, 2, 3]) AS INT) AS lag, round(unnest([1.0, r1, r2, r3]), 8) AS acf,
 round(unnest([1.0, r1, p2, (r3 - q1 * r2 - p2 * r1) / (1 - q1 * r1 - p2 * r2)]), 8) AS pacf, round(1.96 / sqrt(n), 8) AS bound FROM ph""",
)
def sta17(spark, d):
    return _r(st.acf_pacf(derive.panel(spark, d), SERIES, 3), "acf", "pacf", "bound")


@query(
    "sta18_kpss",
    with_cte(PN)
    + """, cn AS (SELECT tso, unique_id, ds, y - avg(y) OVER (PARTITION BY tso, unique_id) AS c FROM pn),
s AS (SELECT *, sum(c) OVER w AS cs, """
    + ", ".join(f"lag(c, {k}) OVER w AS c{k}" for k in range(1, 25))
    + " FROM cn WINDOW w AS (PARTITION BY tso, unique_id ORDER BY ds)), k AS (SELECT tso, unique_id, sum(cs * cs) / (count(*) * count(*)) / ((sum(c * c) + "
    + " + ".join(f"2 * (1 - {k} / 25.0::DOUBLE) * sum(c * c{k})" for k in range(1, 25))
    + ") / count(*)) AS kp FROM s GROUP BY ALL) SELECT tso, unique_id, round(kp, 8) AS kpss, kp > 0.463 AS rejects_level FROM k",
)
def sta18_kpss(spark, d):
    return _r(st.kpss(derive.panel(spark, d), SERIES, 24), "kpss")


@query(
    "sta18_adf",
    with_cte(PN)
    + """, a AS (SELECT tso, unique_id, ds, lag(y) OVER w AS x1, y - lag(y) OVER w AS dy FROM pn WINDOW w AS (PARTITION BY tso, unique_id ORDER BY ds)),
b AS (SELECT *, lag(dy) OVER (PARTITION BY tso, unique_id ORDER BY ds) AS x2 FROM a),
s AS (SELECT tso, unique_id, count(*) AS n, covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12, covar_pop(x2, x2) AS s22, covar_pop(x1, dy) AS s1y, covar_pop(x2, dy) AS s2y, var_pop(dy) AS syy
 FROM b WHERE x2 IS NOT NULL GROUP BY ALL),
c AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s),
e AS (SELECT *, b1 / sqrt((syy - b1 * s1y - b2 * s2y) / (n - 3) * s22 / det) AS t FROM c)
SELECT tso, unique_id, n, round(t, 5) AS adf, t < -2.86 AS rejects_unit_root FROM e""",
)
def sta18_adf(spark, d):
    return _r(st.adf(derive.panel(spark, d), SERIES, 1), "adf", n=5)


def _lb_term() -> str:
    term, out = "1.0", "1.0"
    for i in range(1, 12):
        term = f"({term}) * (q / 2) / {i}.0"
        out += f" + pow(q / 2, {i}) / {math.factorial(i)}.0::DOUBLE"
    return f"exp(-q / 2) * ({out})"


@query(
    "sta19_prewhitening_ljung_box",
    with_cte(PN, _ACF)
    + """, rs AS (SELECT lc.tso, lc.unique_id, lc.ds, c - q1 * c1 - p2 * c2 AS e FROM lc JOIN ph USING (tso, unique_id) WHERE c2 IS NOT NULL),
ec AS (SELECT *, e - avg(e) OVER (PARTITION BY tso, unique_id) AS f FROM rs), el AS (SELECT *, """
    + ", ".join(f"lag(f, {k}) OVER w AS f{k}" for k in range(1, 25))
    + " FROM ec WINDOW w AS (PARTITION BY tso, unique_id ORDER BY ds)), lb AS (SELECT tso, unique_id, avg(e) AS m, stddev_samp(e) AS sd, count(*) * (count(*) + 2) * ("
    + " + ".join(f"pow(sum(f * f{k}) / sum(f * f), 2) / (count(*) - {k})" for k in range(1, 25))
    + f") AS q FROM el GROUP BY ALL) SELECT tso, unique_id, round(q, 5) AS ljung_box, round({_lb_term()}, 8) AS p_value, round(m, 8) AS residual_mean, round(sd, 8) AS residual_std FROM lb",
)
def sta19(spark, d):
    res = st.ar_residuals(derive.panel(spark, d), SERIES, 2)
    out = st.ljung_box(res, SERIES, 24)
    return _r(_r(out, "ljung_box", n=5), "p_value", "residual_mean", "residual_std")


@query(
    "sta20_mean_interval",
    with_cte(PN)
    + """, rw AS (SELECT *, row_number() OVER (PARTITION BY tso, unique_id ORDER BY ds) - 1 AS pos FROM pn), nn AS (SELECT tso, unique_id, count(*) AS n FROM rw GROUP BY ALL),
ix AS (SELECT tso, unique_id, rep, (rep * 7919 + t * 104729 + 5) % n AS pos FROM nn, range(40) r(rep), LATERAL (SELECT unnest(range(n)) AS t)),
ms AS (SELECT tso, unique_id, rep, avg(y) AS m FROM ix JOIN rw USING (tso, unique_id, pos) GROUP BY ALL)
SELECT tso, unique_id, round(quantile_cont(m, 0.025), 8) AS low, round(quantile_cont(m, 0.975), 8) AS high FROM ms GROUP BY ALL""",
)
def sta20(spark, d):
    out = bs.mean_interval(
        derive.panel(spark, d), SERIES, "y", ["ds"], F.date_trunc("month", "ds"), 40, draw=bs.integer_draw(5)
    )
    return _r(out, "low", "high")


@query(
    "sta20_mean_interval_of_counts",
    with_cte(PN) + "SELECT tso, unique_id, count(*) AS n, round(avg(y), 8) AS mean, true AS holds_mean, true AS as_wide_as_normal FROM pn GROUP BY ALL",
)
def sta20_counts(spark, d):
    """Draws differ from any other engine's, so the interval is held against the normal one: within a quarter of its width."""
    p = derive.panel(spark, d)
    found = bs.mean_interval(p, SERIES, "y", ["ds"], F.date_trunc("month", "ds"), 500)
    own = p.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"))
    normal = 2 * 1.959964 * F.col("sd") / F.sqrt("n")
    wide = F.col("high") - F.col("low")
    out = join_null_safe(own, found, SERIES).select(
        *SERIES, "n", "mean", F.col("mean").between(F.col("low") - 1e-9, F.col("high") + 1e-9).alias("holds_mean"),
        wide.between(0.75 * normal - 1e-9, 1.25 * normal + 1e-9).alias("as_wide_as_normal"),
    )
    return _r(out, "mean")
