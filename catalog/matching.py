"""Pair features and the unsupervised matcher."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.cluster import sql_scores
from catalog.data import PART_COLUMNS, SQL_PARTS, aggregated_parts, part_truth, rounded, sql_overlap
from kindred.operators import em
from kindred.operators import evaluate as ev
from kindred.operators import features as ft
from kindred.operators import prepare as prep
from kindred.operators import transitivity as tr
from kindred.operators.blocking import blocking_words, expand_pairs, group_sizes, overlap_block
from kindred.plans import pipeline
from kindred.runtime import cut_lineage

TYPES = {"p_name": "str_bt_1w_5w", "p_brand": "str_eq_1w", "p_type": "str_eq_1w", "p_size": "numeric"}
PLAN = ft.feature_plan(TYPES)
JVM_PLAN = ft.feature_plan(TYPES, {"jaccard", "cosine", "dice", "overlap_coeff", "lev_sim", "exact_match", "abs_norm"})
EM_PLAN = ft.feature_plan(TYPES, {"jaccard", "lev_sim", "abs_norm"})


def candidates(spark, sf, n=3):
    l, r = aggregated_parts(spark, sf)
    return overlap_block(l, r, "aggregate value", n).drop("overlap"), l, r


def compared(spark, sf, plan, n=3, digits=None):
    """Features of groups of equal records, and the members of both sides' groups."""
    l, r = aggregated_parts(spark, sf)
    return ft.block_and_compare(l, r, "aggregate value", n, plan, digits)


def table_of(spark, sf, plan, n=3, digits=None):
    return expand_pairs(*compared(spark, sf, plan, n, digits))


# ------------------------------------------------------------ the same measures in SQL

def _sql_tokens(v: str, tok: str) -> str:
    if tok == "dlm_dc0":
        return f"list_filter(regexp_split_to_array({v}, '\\s+'), lambda x: x <> '')"
    q = int(tok[-1])
    s = f"('{'#' * (q - 1)}' || {v} || '{'$' * (q - 1)}')"
    return f"[substring({s}, i, {q}) for i in range(1, length({s}) - {q} + 2)]"


def _sql_winkler(x: str, y: str) -> str:
    steps = " ".join(f"WHEN left({x}, {i}) <> left({y}, {i}) THEN {i - 1}" for i in range(1, 5))
    j = f"jaro_similarity({x}, {y})"
    return f"({j} + (CASE {steps} ELSE 4 END) * 0.1::DOUBLE * (1 - {j}))"


def _sql_measure(attr: str, measure: str, tok: str | None) -> str:
    a, b = f"l_{attr}", f"r_{attr}"
    if tok:
        ta, tb = _sql_tokens(a, tok), _sql_tokens(b, tok)
        if measure == "monge_elkan":
            inner = _sql_winkler("x", "y")
            return f"list_avg([list_max([{inner} for y in {tb}]) for x in {ta}])"
        i, na, nb = f"len(list_intersect({ta}, {tb}))::DOUBLE", f"len(list_distinct({ta}))", f"len(list_distinct({tb}))"
        return {"jaccard": f"{i} / ({na} + {nb} - {i})", "cosine": f"{i} / sqrt(({na} * {nb})::DOUBLE)",
                "dice": f"2 * {i} / ({na} + {nb})", "overlap_coeff": f"{i} / least({na}, {nb})"}[measure]
    return {
        "lev_sim": f"1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))",
        "exact_match": f"({a} = {b})::INT::DOUBLE",
        "abs_norm": f"1 - least(1.0::DOUBLE, abs({a}::DOUBLE - {b}::DOUBLE) / greatest(abs({a}::DOUBLE), abs({b}::DOUBLE)))",
        "jaro": f"jaro_similarity({a}, {b})",
        "jaro_winkler": _sql_winkler(a, b),
    }[measure]


_PAIRS = f"""{SQL_PARTS}, {sql_overlap('pl', 'pr', 3)},
joined AS MATERIALIZED (SELECT l_id, r_id, """ + ", ".join(f"a.{c} AS l_{c}, b.{c} AS r_{c}" for c in TYPES) + """
  FROM cand JOIN pl a ON a.id = l_id JOIN pr b ON b.id = r_id)"""


def _sql_features(plan, digits: int | None = 6) -> str:
    def one(name, attr, measure, tok):
        e = _sql_measure(attr, measure, tok)
        return f'round({e}, {digits}) AS "{name}"' if digits else f'{e} AS "{name}"'
    return "SELECT l_id, r_id, " + ", ".join(one(*p) for p in plan) + " FROM joined"


@query("x1_label_candidates", f"""WITH {SQL_PARTS}, {sql_overlap('pl', 'pr', 3)}
SELECT l_id, r_id, (g.l_id IS NOT NULL)::INT AS gold FROM cand LEFT JOIN pgt g USING (l_id, r_id)""")
def _(spark, sf):
    cand, _, _ = candidates(spark, sf)
    return ft.label(cand, part_truth(spark, sf))


@query("x2_feature_table", f"WITH {_PAIRS} {_sql_features(PLAN)}")
def _(spark, sf):
    return table_of(spark, sf, PLAN, digits=6)


@query("x2_feature_table_with_inferred_types", f"WITH {_PAIRS} {_sql_features(PLAN)}")
def _(spark, sf):
    """The plan follows from the content of both sides: attributes of one name, the wider of their types."""
    l, r = aggregated_parts(spark, sf)
    found = prep.corresponding_types(prep.infer_types(l, PART_COLUMNS), prep.infer_types(r, PART_COLUMNS)).collect()  # one row an attribute
    return table_of(spark, sf, ft.feature_plan({t["attr"]: t["type"] for t in found}), digits=6)


@query("m9_fit_of_the_whole_plan")
def _(spark, sf):
    """Block, compare by every measure of the inferred types, fit without copies on either side, decide."""
    l, r = aggregated_parts(spark, sf)
    found = prep.corresponding_types(prep.infer_types(l, PART_COLUMNS), prep.infer_types(r, PART_COLUMNS)).collect()
    params, scored = pipeline.unsupervised_match(l, r, "aggregate value", 3, {t["attr"]: t["type"] for t in found})
    return rounded(scored.select("l_id", "r_id", "p", "pred"), 4).withColumn("converged", F.lit(params.converged))


def _register_measure(name: str, measures: set[str]):
    plan = ft.feature_plan(TYPES, measures)

    @query(name, f"WITH {_PAIRS} {_sql_features(plan)}")
    def _(spark, sf):
        return table_of(spark, sf, plan, digits=6)


_register_measure("x4_jaccard", {"jaccard"})
_register_measure("x5_cosine", {"cosine"})
_register_measure("x6_dice", {"dice"})
_register_measure("x7_overlap_coefficient", {"overlap_coeff"})
_register_measure("x8_levenshtein", {"lev_sim"})
_register_measure("x9_jaro_and_jaro_winkler", {"jaro", "jaro_winkler"})
_register_measure("x10_monge_elkan", {"monge_elkan"})
_register_measure("x11_exact_match", {"exact_match"})
_register_measure("x12_absolute_norm", {"abs_norm"})


@query("x14_scaled_features_only", f"WITH {_PAIRS} SELECT l_id, r_id, round({_sql_measure('p_name', 'lev_sim', None)}, 6) AS p_name_p_name_lev_sim FROM joined")
def _(spark, sf):
    t = table_of(spark, sf, ft.feature_plan({"p_name": TYPES["p_name"]}, {"lev_sim"}))
    t = t.withColumn("p_name_p_name_lev_dist", F.lit(1.0)).withColumn("p_name_p_name_sw", F.lit(2.0))
    cols = [c for c in t.columns if c not in ("l_id", "r_id")]
    return rounded(t.select("l_id", "r_id", *ft.scaled_only(cols)))


@query("x15_missing_features_to_zero", f"""WITH {_PAIRS} SELECT l_id, r_id, round(CASE WHEN l_p_size = '1' OR r_p_size = '1' THEN 0
  ELSE {_sql_measure('p_name', 'jaccard', 'dlm_dc0')} END, 6) AS p_name_p_name_jac_dlm_dc0_dlm_dc0 FROM joined""")
def _(spark, sf):
    cand, l, r = candidates(spark, sf)
    hide = lambda e: e.withColumn("p_name", F.when(F.col("p_size") != "1", F.col("p_name")))
    plan = [p for p in ft.feature_plan(TYPES, {"jaccard"}) if p[1] == "p_name" and p[3] == "dlm_dc0"]
    return rounded(ft.pair_features(cand, hide(l), hide(r), plan))


@query("x16_drop_constant_features", f"WITH {_PAIRS} {_sql_features(JVM_PLAN)}")
def _(spark, sf):
    t, lm, rm = compared(spark, sf, JVM_PLAN)
    t = t.withColumn("constant_one", F.lit(0.5)).withColumn("constant_two", F.lit(0.0))
    cols = [c for c in t.columns if c not in ("l_id", "r_id")]
    return expand_pairs(rounded(ft.drop_constant(cut_lineage(t, "features"), cols)), lm, rm)


@query("x17_mean_per_attribute", f"""WITH {_PAIRS}, f AS ({_sql_features(ft.feature_plan({'p_name': 'str_bt_1w_5w'}, {'jaccard', 'dice'}), None)})
SELECT l_id, r_id, round((""" + " + ".join(f'"{p[0]}"' for p in ft.feature_plan({'p_name': 'str_bt_1w_5w'}, {'jaccard', 'dice'})) + """) / 4, 6) AS p FROM f""")
def _(spark, sf):
    plan = ft.feature_plan({"p_name": TYPES["p_name"]}, {"jaccard", "dice"})
    return rounded(ft.mean_by_attr(table_of(spark, sf, plan), [p[0] for p in plan]))


# ------------------------------------------------------------ matcher

_NAMES = [p[0] for p in EM_PLAN]
_F = f"{_PAIRS}, f AS MATERIALIZED ({_sql_features(EM_PLAN, None)})"
_START = _F + """,
b AS (SELECT """ + ", ".join(f'min("{c}") AS lo{i}, max("{c}") AS hi{i}' for i, c in enumerate(_NAMES)) + """ FROM f),
sm AS (SELECT f.*, """ + " + ".join(f'coalesce(("{c}" - lo{i}) / nullif(hi{i} - lo{i}, 0), 0)' for i, c in enumerate(_NAMES)) + """ AS total FROM f, b),
st AS (SELECT *, (total - min(total) OVER ()) / (max(total) OVER () - min(total) OVER ()) AS score FROM sm),
started AS MATERIALIZED (SELECT *, CASE WHEN score > 0.8 THEN 1 ELSE 0 END AS start FROM st)"""


def em_table(spark, sf):
    return table_of(spark, sf, EM_PLAN)


def em_groups(spark, sf, n=3):
    """Features of groups of equal records, in ``pairs`` how many record pairs each row stands for, and both sides' members."""
    table, lm, rm = compared(spark, sf, EM_PLAN, n)
    return cut_lineage(group_sizes(table, lm, rm, "pairs"), "counted"), lm, rm


@query("m1_initial_labels", f"WITH {_START} SELECT l_id, r_id, start, round(score, 6) AS start_score FROM started")
def _(spark, sf):
    X, lm, rm = em_groups(spark, sf)
    return expand_pairs(rounded(em.initial_labels(X, _NAMES).select("l_id", "r_id", "start", "start_score")), lm, rm)


@query("m3_class_moments", f"WITH {_START} SELECT start, count(*) AS n, " + ", ".join(
    [f'round(avg("{c}"), 6) AS "mean_{c}"' for c in _NAMES] + [f'round(stddev_pop("{c}"), 6) AS "std_{c}"' for c in _NAMES]) +
    " FROM started GROUP BY start")
def _(spark, sf):
    X, _, _ = em_groups(spark, sf)
    return rounded(em.class_moments(em.initial_labels(X, _NAMES), _NAMES, weight="pairs"))


def _sql_start() -> str:
    """CTEs ``par`` (one row: start prior, means and variances) and ``post`` (every pair with ``p``, ``lm``, ``lu`` under them)."""
    moments = ", ".join(f"""avg("{c}") FILTER (start = {k}) AS mu_{t}{i}, var_pop("{c}") FILTER (start = {k}) + 1e-6::DOUBLE AS s_{t}{i}"""
                        for i, c in enumerate(_NAMES) for t, k in (("m", 1), ("u", 0)))
    log = lambda t: " + ".join(f"""-0.5::DOUBLE * (ln(2 * pi()) + ln(s_{t}{i} + 1e-8::DOUBLE) + ("{c}" - mu_{t}{i}) ** 2 / (s_{t}{i} + 1e-8::DOUBLE))"""
                               for i, c in enumerate(_NAMES))
    return f"""par AS (SELECT avg(start) AS prior, {moments} FROM started),
dens AS (SELECT *, {log('m')} AS lm, {log('u')} AS lu FROM started, par),
post AS MATERIALIZED (SELECT *, prior / (prior + (1 - prior) * exp(least(greatest(lu - lm, -500::DOUBLE), 500::DOUBLE))) AS p FROM dens)"""


def _sql_maximised() -> str:
    """The parameters after one maximisation, as ``kind, a, b, value``."""
    n = range(len(_NAMES))
    sums = ", ".join(f"""sum(p * "{c}") AS sm{i}, sum("{c}") AS sx{i}, sum(p * "{c}" * "{c}") AS qm{i}, sum("{c}" * "{c}") AS qx{i}""" for i, c in enumerate(_NAMES))
    corr = ", ".join(f"""covar_pop("{_NAMES[i]}", "{_NAMES[j]}") / (stddev_pop("{_NAMES[i]}") * stddev_pop("{_NAMES[j]}")) AS r{i}_{j}""" for i in n for j in n if i < j)
    means = ", ".join(f"""sm{i} / nm AS am{i}, (sx{i} - sm{i}) / nu AS au{i}, greatest(qm{i} / nm - (sm{i} / nm) ** 2, 0) AS vm{i},
greatest((qx{i} - qm{i}) / nu - ((sx{i} - sm{i}) / nu) ** 2, 0) AS vu{i}""" for i in n)
    over = lambda i, x: f"""((vm{i} + {x}) / (vm{i} + vu{i} + 2 * ({x})) * (vu{i} + {x}) / (vm{i} + vu{i} + 2 * ({x})) * exp(-g{i} / (vm{i} + vu{i} + 2 * ({x}))))"""
    # one secant step: all steps are below 1 at once, as variances and means are within [0, 1]
    first = ", ".join(f"(am{i} - au{i}) ** 2 AS g{i}" for i in n)
    goal = ", ".join(f"CASE WHEN {over(i, '0')} + 0.1::DOUBLE < 1 THEN {over(i, '0')} + 0.1::DOUBLE ELSE ({over(i, '0')} + 1) / 2 END AS t{i}, 0.15::DOUBLE * g{i} AS x{i}, "
                     f"0.15::DOUBLE * g{i} * (1 + e) + e AS y{i}" for i in n)
    step = ", ".join(f"({over(i, f'x{i}')} - t{i}) AS f{i}, ({over(i, f'y{i}')} - t{i}) AS h{i}" for i in n)
    add = ", ".join(f"least(greatest(CASE WHEN f{i} = h{i} THEN (x{i} + y{i}) / 2 ELSE y{i} - h{i} * (y{i} - x{i}) / (h{i} - f{i}) END, 0), 1) AS k{i}" for i in n)
    rows = ["('pi', '', '', nm / n)"]
    for i in n:
        rows += [f"('mu_{t}', '{_NAMES[i]}', '', a{t}{i})" for t in "mu"]
        for j in n:
            cell = f"v{{t}}{i} + k{i}" if i == j else f"r{min(i, j)}_{max(i, j)} * sqrt(v{{t}}{i}) * sqrt(v{{t}}{j})"
            rows += [f"('cov_{t}', '{_NAMES[i]}', '{_NAMES[j]}', {cell.format(t=t)})" for t in "mu"]
    listed = ", ".join(f"{{'kind': {k}, 'a': {x}, 'b': {y}, 'value': {v}}}" for k, x, y, v in (r[1:-1].split(", ", 3) for r in rows))
    return f"""s0 AS (SELECT count(*) AS n, sum(p) AS nm, count(*) - sum(p) AS nu, {sums}, {corr} FROM post),
s1 AS (SELECT *, {means} FROM s0), s2 AS (SELECT *, {first}, pow(2.220446049250313e-16::DOUBLE, 0.33::DOUBLE) AS e FROM s1), s3 AS (SELECT *, {goal} FROM s2),
s4 AS (SELECT *, {step} FROM s3), s5 AS (SELECT *, {add} FROM s4), s6 AS (SELECT unnest([{listed}]) AS c FROM s5)
SELECT c.kind AS kind, c.a AS a, c.b AS b, round(c.value, 5) AS value FROM s6"""


@query("m4_block_diagonal_covariance", f"WITH {_START}, {_sql_start()}, {_sql_maximised()}")
def _(spark, sf):
    """The parameters after the first maximisation: full blocks inside an attribute, shared extra variance."""
    X, _, _ = em_groups(spark, sf)
    params, _ = em.em_fit(X, _NAMES, max_iter=1, weight="pairs")
    return rounded(params.table(spark), 5)


@query("m5_posterior", f"WITH {_START}, {_sql_start()} SELECT l_id, r_id, round(p, 6) AS p FROM post")
def _(spark, sf):
    X, lm, rm = em_groups(spark, sf)
    return expand_pairs(rounded(em.em_expect(X, em.em_init(X, _NAMES, "pairs")).select("l_id", "r_id", "p")), lm, rm)


@query("m7_weighted_moments", f"WITH {_START}, w AS (SELECT *, score AS w FROM started) SELECT round(avg(w), 6) AS prior, " + ", ".join(
    f"""round(sum({k} * "{c}") / sum({k}), 6) AS "mean_{t}_{c}", round(sum({k} * "{c}" * "{c}") / sum({k}) - (sum({k} * "{c}") / sum({k})) ** 2, 6) AS "var_{t}_{c}\""""
    for c in _NAMES for t, k in (("m", "w"), ("u", "(1 - w)"))) + " FROM w")
def _(spark, sf):
    X, _, _ = em_groups(spark, sf)
    return rounded(em.weighted_moments(em.initial_labels(X, _NAMES), _NAMES, "start_score", "pairs"))


def fitted(spark, sf):
    """A fit over groups of equal records: parameters, scored pairs of groups, both sides' members."""
    X, lm, rm = em_groups(spark, sf)
    params, scored = em.em_fit(X, _NAMES, weight="pairs")
    return params, scored.drop("pairs"), lm, rm


@query("m9_fit")
def _(spark, sf):
    """The whole fit: until it has converged, 40 rounds at most."""
    params, scored, lm, rm = fitted(spark, sf)
    return expand_pairs(rounded(em.decide(scored), 4).withColumn("converged", F.lit(params.converged)), lm, rm)


@query("m10_fit_with_transitivity")
def _(spark, sf):
    params, scored = em.em_fit(em_table(spark, sf), _NAMES, constraint="dup_free")
    return rounded(em.decide(scored), 4).withColumn("converged", F.lit(params.converged))


_SIDES = {"x": ("pl", "pr"), "l": ("pl", "pl"), "r": ("pr", "pr")}


def _sql_shared(kind: str) -> str:
    a, b = _SIDES[kind]
    ends = ("'l' || l_id", "'r' || r_id") if kind == "x" else (f"least('{kind}' || l_id, '{kind}' || r_id)", f"greatest('{kind}' || l_id, '{kind}' || r_id)")
    only = "" if kind == "x" else "WHERE l_id < r_id"
    return f"""SELECT '{kind}' AS kind, {ends[0]} AS u, {ends[1]} AS v, l_id, r_id, overlap / (len(a.toks) + len(b.toks) - overlap)::DOUBLE AS j
FROM c{kind} JOIN {a} a ON a.id = l_id JOIN {b} b ON b.id = r_id {only}"""


_WEDGES = f"""{SQL_PARTS}, {', '.join(sql_overlap(a, b, 4, f'c{k}') for k, (a, b) in _SIDES.items())},
e0 AS ({' UNION ALL '.join(_sql_shared(k) for k in _SIDES)}),
e AS MATERIALIZED (SELECT kind, u, v, l_id, r_id, least(greatest(1.1::DOUBLE * j, 0.05::DOUBLE), 0.95::DOUBLE) AS p FROM e0),
h0 AS (SELECT *, u AS n, v AS x FROM e WHERE p > 0.5 UNION ALL SELECT *, v, u FROM e WHERE p > 0.5),
h AS MATERIALIZED (SELECT *, d(0, p) AS loss FROM h0),
w AS MATERIALIZED (SELECT a.kind, a.n, a.x, b.x AS y, a.u AS au, a.v AS av, b.u AS bu, b.v AS bv, a.p AS ap, b.p AS bp, a.loss AS al, b.loss AS bl,
  t.kind AS tk, t.u AS tu, t.v AS tv, t.p AS tp FROM h a JOIN h b ON a.kind = b.kind AND a.n = b.n AND (a.loss, a.x) < (b.loss, b.x)
  LEFT JOIN e t ON t.u = least(a.x, b.x) AND t.v = greatest(a.x, b.x)),
mv AS (SELECT *, d(tp / bp, ap) AS da, d(tp / ap, bp) AS db, d(ap * bp, tp) AS dt FROM w WHERE tp IS NOT NULL AND ap * bp > tp + 1e-12),
mo AS (SELECT *, CASE WHEN da > 1e-5 THEN -1e300 ELSE da END AS ga, CASE WHEN db > 1e-5 THEN -1e300 ELSE db END AS gb, CASE WHEN dt > 1e-5 THEN -1e300 ELSE dt END AS gt FROM mv),
top AS (SELECT kind, n, arg_min(x, (loss, x)) AS top FROM h GROUP BY kind, n),
near AS MATERIALIZED (SELECT h.kind, h.n, h.x FROM h JOIN top USING (kind, n) WHERE h.x = top OR EXISTS (FROM w WHERE w.kind = h.kind AND w.n = h.n AND w.x = top AND w.y = h.x AND tp IS NOT NULL)),
lack AS (SELECT DISTINCT kind, bu AS u, bv AS v, bl AS loss FROM w JOIN top USING (kind, n)
  WHERE tp IS NULL AND (x = top OR ((kind, n, x) IN (FROM near) AND (kind, n, y) IN (FROM near)))),
pr0 AS (SELECT kind, au AS u, av AS v, tp / bp AS low, NULL::DOUBLE AS high FROM mo WHERE ga > gb AND ga >= gt
  UNION ALL SELECT kind, bu, bv, tp / ap, NULL FROM mo WHERE gb >= ga AND gb >= gt AND gb > -1e300
  UNION ALL SELECT tk, tu, tv, NULL, ap * bp FROM mo WHERE gt > ga AND gt > gb
  UNION ALL SELECT kind, u, v, 0, NULL FROM lack WHERE loss <= 1e-5)"""


def _inline_change(sql: str) -> str:
    """Writes out ``d(q, p)``: the change of the free energy from p to q, with log densities ln p and ln(1 - p) and prior 0.3."""
    import re
    g = lambda p, prior, log: f"({p}) * (ln({prior} + 1e-300::DOUBLE) + {log} - ln(({p}) + 1e-300::DOUBLE))"
    energy = lambda q, p: f"({g(q, '0.3::DOUBLE', f'ln({p})')} + {g(f'1 - ({q})', '0.7::DOUBLE', f'ln(1 - {p})')})"
    return re.sub(r"\bd\(([^,()]+), ([^,()]+)\)", lambda m: f"({energy(f'({m[1]})::DOUBLE', m[2])} - {energy(m[2], m[2])})", sql)


def shared_words(spark, sf):
    """Edges between part records of both sides and of each side, with the share of common words as probability."""
    l, r = aggregated_parts(spark, sf)
    token = lambda e: e.select("id", "aggregate value")
    out = None
    for kind, (a, b) in {"x": (l, r), "l": (l, l), "r": (r, r)}.items():
        cand = overlap_block(token(a), token(b), "aggregate value", 4)
        cand = cand if kind == "x" else cand.where(F.col("l_id") < F.col("r_id"))
        size = lambda e, c: e.select(F.col("id").alias(c), F.size(blocking_words(F.col("aggregate value"))).alias(f"n_{c}"))
        j = F.col("overlap") / (F.col("n_l_id") + F.col("n_r_id") - F.col("overlap"))
        p = F.least(F.greatest(F.lit(1.1) * j, F.lit(0.05)), F.lit(0.95))
        scored = cand.join(size(a, "l_id"), "l_id").join(size(b, "r_id"), "r_id").withColumn("p", p).select(
            "l_id", "r_id", "p", F.log("p").alias("log_m"), F.log(1 - F.col("p")).alias("log_u"))
        mine = tr.edges(scored, kind, 0.3)
        out = mine if out is None else out.unionByName(mine)
    return cut_lineage(out, "shared_words")


@query("m10_transitivity_round", _inline_change(f"""WITH {_WEDGES}
SELECT kind, u, v, round(coalesce(min(low), max(high)), 6) AS p_new FROM pr0 GROUP BY kind, u, v"""))
def _(spark, sf):
    """One round of mending over three tables: moves of the cheapest of three edges of each broken wedge."""
    return rounded(tr.proposals(shared_words(spark, sf)))


@query("m10_transitivity_settled", _inline_change(f"""WITH {_WEDGES}
SELECT kind, count(*) AS edges, 0::BIGINT AS broken_wedges FROM e GROUP BY kind"""))
def _(spark, sf):
    """Four rounds of mending, then lowering until no predicted wedge is broken."""
    table = shared_words(spark, sf)
    for step in (tr.constrain, tr.settle):
        moved = step(table)
        table = cut_lineage(table.join(moved, ["kind", "l_id", "r_id"], "left").withColumn("p", F.coalesce("p_new", "p")).drop("p_new"), "mended")
    left = tr.broken(table).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return (table.groupBy("kind").agg(F.count(F.lit(1)).alias("edges")).join(left, "kind", "left")
            .select("kind", "edges", F.coalesce("n", F.lit(0)).alias("broken_wedges")))


@query("m10_fit_linked_tables")
def _(spark, sf):
    """Cross table and both sides' own tables fitted in lockstep, four rounds of mending a step."""
    l, r = aggregated_parts(spark, sf)
    tables = {}
    for kind, (a, b) in {"x": (l, r), "l": (l, l), "r": (r, r)}.items():
        cand = overlap_block(a, b, "aggregate value", 4).drop("overlap")
        cand = cand if kind == "x" else cand.where(F.col("l_id") < F.col("r_id"))
        tables[kind] = ft.pair_features(cand, a, b, EM_PLAN)
    out = None
    for kind, (params, scored) in em.em_fit_linked(tables["x"], tables["l"], tables["r"], _NAMES).items():
        mine = rounded(em.decide(scored), 4).withColumns({"kind": F.lit(kind), "converged": F.lit(params.converged if params else None).cast("boolean")})
        out = mine if out is None else out.unionByName(mine)
    return out


@query("m12_decide_and_score", f"""WITH {_START}, d AS (SELECT l_id, r_id, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred,
  (g.l_id IS NOT NULL)::INT AS gold FROM started LEFT JOIN pgt g USING (l_id, r_id)),
s AS (SELECT CAST(sum(pred * gold) AS BIGINT) AS tp, CAST(sum(pred) AS BIGINT) AS predicted, CAST(sum(gold) AS BIGINT) AS known FROM d)
SELECT tp, predicted, known, {sql_scores('tp', 'predicted', 'known', 1, 6)} FROM s""")
def _(spark, sf):
    X, lm, rm = em_groups(spark, sf)
    marked = em.decide(em.initial_labels(X, _NAMES).withColumnRenamed("start_score", "p")).select("l_id", "r_id", "pred")
    return ev.evaluate_labels(ft.label(expand_pairs(marked, lm, rm), part_truth(spark, sf)), "gold", "pred")


@query("m13_score_new_pairs")
def _(spark, sf):
    params, _, _, _ = fitted(spark, sf)
    wide, lm, rm = compared(spark, sf, EM_PLAN, 2)
    return expand_pairs(em.em_score(wide, params).select("l_id", "r_id", "pred"), lm, rm)


@query("m13_score_with_given_parameters", f"""WITH {_START}, {_sql_start()} SELECT l_id, r_id, round(p, 6) AS p, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS pred FROM post""")
def _(spark, sf):
    """Decisions of a model that was saved as a table and read back."""
    X, lm, rm = em_groups(spark, sf)
    saved = cut_lineage(em.em_init(X, _NAMES, "pairs").table(spark), "parameters")
    return expand_pairs(rounded(em.em_score(X.drop("pairs"), em.read_params(saved, _NAMES))), lm, rm)
