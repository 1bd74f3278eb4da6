"""DuckDB SQL for the queries. Formulations of their own: lists and recursive closures, not the engine's expressions."""

from __future__ import annotations

import json

from ..operators.catalogue import EXPORT_COLUMNS
from .queries import FILTERS, FIRST_FOUR, LA_DEPTH, SEEDS

TYPES = ("view", "click", "signup", "purchase", "error")


def _mat(m) -> str:
    return json.dumps(m)


def js(m: str) -> str:
    """Compact JSON of a nested list."""
    return f"to_json({m})::VARCHAR"


def relabel(m: str, p: str) -> str:
    return f"list_transform({p}, lambda i: list_transform({p}, lambda j: {m}[i][j]))"


def mutated(m: str, n: str, k: str) -> str:
    return f"list_transform(range(1, {n} + 1), lambda i: list_transform(range(1, {n} + 1), lambda j: CASE WHEN i = {k} OR j = {k} THEN -{m}[i][j] ELSE {m}[i][j] + (abs({m}[i][{k}]) * {m}[{k}][j] + {m}[i][{k}] * abs({m}[{k}][j])) // 2 END))"


def maxabs(m: str) -> str:
    return f"list_max(list_transform(flatten({m}), lambda x: abs(x)))"


def qid(c: str, prefix: str = "Q") -> str:
    return f"'{prefix}.n' || len({c}) || '.' || left(sha256({js(c)}), 16)"


#: Permutations of up to five things, from 1.
PERM = """perm AS MATERIALIZED (SELECT 1 AS n, [1] AS p UNION ALL SELECT 2, [a, b] FROM range(1, 3) t(a), range(1, 3) u(b) WHERE a <> b
UNION ALL SELECT 3, [a, b, c] FROM range(1, 4) t(a), range(1, 4) u(b), range(1, 4) v(c) WHERE a <> b AND a <> c AND b <> c
UNION ALL SELECT 4, [a, b, c, d] FROM range(1, 5) t(a), range(1, 5) u(b), range(1, 5) v(c), range(1, 5) w(d) WHERE a <> b AND a <> c AND b <> c AND d NOT IN (a, b, c)
UNION ALL SELECT 5, [a, b, c, d, e] FROM range(1, 6) t(a), range(1, 6) u(b), range(1, 6) v(c), range(1, 6) w(d), range(1, 6) x(e) WHERE a <> b AND a <> c AND b <> c AND d NOT IN (a, b, c) AND e NOT IN (a, b, c, d)),
pl AS MATERIALIZED (SELECT n, list(p) AS ps FROM perm GROUP BY n)"""


def canon(d: str) -> str:
    """The least relabeling of ``d``, with ``ps`` of its size from ``pl``."""
    return f"list_min(list_transform(ps, lambda p: {relabel(d, 'p')}))"


def _events() -> str:
    net = lambda i, j: "0" if i == j else f"greatest(-2, least(2, c{i}{j} - c{j}{i}))"
    counts = ", ".join(f"count(*) FILTER (a = '{TYPES[i]}' AND b = '{TYPES[j]}')::INTEGER AS c{i}{j}" for i in range(5) for j in range(5) if i != j)
    matrix = "[" + ", ".join("[" + ", ".join(net(i, j) for j in range(5)) + "]" for i in range(5)) + "]"
    return f"""ev AS MATERIALIZED (SELECT user_id, {matrix} AS m FROM (SELECT user_id, {counts}
FROM (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY user_id))"""


EV = _events()
_flow = lambda i, j: "0" if i == j else f"greatest(-2, least(2, count(*) FILTER (i = {i} AND j = {j}) - count(*) FILTER (i = {j} AND j = {i})))::INTEGER"
_FLOWS = "[" + ", ".join("[" + ", ".join(_flow(i, j) for j in range(5)) + "]" for i in range(5)) + "]"
FLOW = f"""flow AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sn.n_regionkey AS i, cn.n_regionkey AS j FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey), fl AS MATERIALIZED (SELECT month, {_FLOWS} AS m FROM flow GROUP BY month)"""
#: Quivers of users and months, and their induced subquivers on up to five vertices.
OWN = f"""{EV}, {FLOW}, own AS MATERIALIZED (SELECT 'user ' || user_id AS owner, m FROM ev UNION ALL SELECT 'month ' || month, m FROM fl),
sub AS MATERIALIZED (SELECT owner, l, {relabel('m', 'l')} AS s FROM own, (SELECT list_filter(range(1, 6), lambda v: (x >> (v - 1)::INTEGER) & 1 = 1) AS l FROM range(1, 32) t(x)))"""
#: Reachability of vertices by arrows: acyclic if no vertex reaches itself.
REACH = """step AS (SELECT user_id, i, j FROM ev, range(1, 6) t(i), range(1, 6) u(j) WHERE m[i][j] > 0),
closed AS (SELECT user_id, i, j FROM step UNION SELECT c.user_id, c.i, s.j FROM closed c JOIN step s ON c.user_id = s.user_id AND c.j = s.i),
cyc AS (SELECT DISTINCT user_id FROM closed WHERE i = j)"""
CANON = f"cf AS MATERIALIZED (SELECT user_id, any_value(m) AS m, min({relabel('m', 'p')}) AS c FROM ev, perm WHERE n = 5 GROUP BY user_id)"


def _order(p: str = "p") -> str:
    """The least k for which the k-th power of a permutation of up to five things changes nothing."""
    powers, at = [], p
    for k in range(1, 6):
        powers.append(f"WHEN {at} = range(1, len({p}) + 1) THEN {k}")
        at = f"list_transform({at}, lambda i: {p}[i])"
    return "CASE " + " ".join(powers) + " ELSE 6 END"


AUT = f"aut AS MATERIALIZED (SELECT user_id, p FROM ev, perm WHERE n = 5 AND {relabel('m', 'p')} = m), og AS (SELECT user_id, count(*) AS o, max({_order()}) AS k FROM aut GROUP BY user_id)"
#: All groups of order 8, 12 and 24 on up to five things but the cyclic ones are not commutative.
NAME = "CASE WHEN o = 1 THEN '1' WHEN k = o THEN 'Z/' || o WHEN o = 4 THEN 'Z/2 x Z/2' WHEN o = 6 THEN 'S_3' WHEN o = 8 THEN 'D_4' WHEN o = 12 THEN 'A_4' WHEN o = 24 THEN 'S_4' ELSE 'order ' || o END"


def _det(a, rows: list[int]) -> str:
    """Expansion along the first row."""
    if not rows:
        return "1"
    return _expand(a, rows, rows)


def _expand(a, rows, cols) -> str:
    if len(rows) == 1:
        return a(rows[0], cols[0])
    return "(" + " ".join(f"{'-' if k % 2 else '+'} {a(rows[0], c)} * {_expand(a, rows[1:], [x for x in cols if x != c])}" for k, c in enumerate(cols)) + ")"


def tits(m: str, n: int) -> tuple[str, str]:
    a = lambda i, j: "2" if i == j else f"(-abs({m}[{i}][{j}]))"
    subsets = [[i for i in range(1, n + 1) if x >> (i - 1) & 1] for x in range(1, 1 << n)]
    return " AND ".join(f"{_det(a, [*range(1, k + 1)])} > 0" for k in range(1, n + 1)), " AND ".join(f"{_det(a, s)} >= 0" for s in subsets)


PD, PSD = tits("m", 5)
REP = f"CASE WHEN user_id IN (SELECT user_id FROM cyc) THEN NULL WHEN {PD} THEN 'finite' WHEN {PSD} THEN 'tame' ELSE 'wild' END"
BIP = "len(list_filter(m, lambda r: list_max(r) > 0 AND list_min(r) < 0)) = 0"
ABU = " AND ".join(f"abs(m[{i}][{j}]) >= 2" for i in range(1, 6) for j in range(i + 1, 6))
DET = _det(lambda i, j: f"m[{i}][{j}]::BIGINT", [*range(1, 6)])
FORM = _det(lambda i, j: "2" if i == j else f"(-abs(m[{i}][{j}])::BIGINT)", [*range(1, 6)])
#: Components of each user's vertices: the smallest vertex that each reaches either way.
PARTS = """adj AS (SELECT user_id, i, j FROM ev, range(1, 6) t(i), range(1, 6) u(j) WHERE m[i][j] <> 0 OR i = j),
meet AS (SELECT user_id, i, j FROM adj UNION SELECT c.user_id, c.i, s.j FROM meet c JOIN adj s ON c.user_id = s.user_id AND c.j = s.i),
part AS (SELECT user_id, i, min(j) AS root FROM meet GROUP BY user_id, i)"""


def ev(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([EV, *more]) + " " + select


SQL = {
    "is_skew_symmetric": ev("SELECT user_id, len(list_filter(range(25), lambda x: m[x // 5 + 1][x % 5 + 1] <> -m[x % 5 + 1][x // 5 + 1])) = 0 AS is_skew_symmetric FROM ev"),
    "max_edge": ev(f"SELECT user_id, {maxabs('m')} AS max_edge FROM ev"),
    "is_bounded": ev(f"SELECT user_id, {maxabs('m')} <= 1 AS bounded1, {maxabs('m')} <= 2 AS bounded2 FROM ev"),
    "is_connected": ev("SELECT user_id, count(DISTINCT root) = 1 AS is_connected FROM part GROUP BY user_id", PARTS),
    "is_acyclic": ev("SELECT user_id, user_id NOT IN (SELECT user_id FROM cyc) AS is_acyclic FROM ev", REACH),
    "apply_permutation": ev(f"SELECT user_id, {js(relabel('m', '[3, 1, 5, 4, 2]'))} AS relabeled FROM ev"),
    "canonical_form": ev(f"SELECT user_id, {js('c')} AS canonical FROM cf", PERM, CANON),
    "certificate": ev(f"SELECT user_id, sha256({js('c')}) AS certificate FROM cf", PERM, CANON),
    "quiver_id": ev(f"SELECT user_id, {qid('c')} AS quiver_id FROM cf", PERM, CANON),
    "mutation_class_id": ev(f"SELECT user_id, {qid('c', 'MC')} AS id_of_form FROM cf", PERM, CANON),
    "is_bipartite": ev(f"SELECT user_id, {BIP} AS is_bipartite FROM ev"),
    "is_abundant": ev(f"SELECT user_id, {ABU} AS is_abundant FROM ev"),
    "is_planar": ev("SELECT user_id, NULL::BOOLEAN AS is_planar, true AS four_of_it FROM ev"),
    "determinant": ev(f"SELECT user_id, {DET} AS determinant, {FORM} AS of_form FROM ev"),
    "representation_type": ev(f"SELECT user_id, {REP} AS representation_type FROM ev", REACH),
    "rep_finite": ev(f"SELECT user_id, ({REP}) = 'finite' AS rep_finite FROM ev", REACH),
    "rep_tame": ev(f"SELECT user_id, ({REP}) = 'tame' AS rep_tame FROM ev", REACH),
    "symmetry_order": ev("SELECT user_id, o::INTEGER AS symmetry_order FROM og", PERM, AUT),
    "symmetry_name": ev(f"SELECT user_id, {NAME} AS symmetry_name FROM og", PERM, AUT),
    "quiver_invariants": ev(f"SELECT user_id, {BIP} AS is_bipartite, {ABU} AS is_abundant, NULL::BOOLEAN AS is_planar, {REP} AS representation_type, o::INTEGER AS symmetry_order, {NAME} AS symmetry_name FROM ev JOIN og USING (user_id)", REACH, PERM, AUT),
    "connected_components": ev(f"SELECT user_id, to_json(list({relabel('m', 'l')} ORDER BY root))::VARCHAR AS components FROM (SELECT user_id, root, any_value(m) AS m, list(i ORDER BY i) AS l FROM part JOIN ev USING (user_id) GROUP BY user_id, root) GROUP BY user_id", PARTS),
    "sources": ev("SELECT user_id, to_json(list_filter(range(5), lambda k: list_min(m[k + 1]) >= 0))::VARCHAR AS sources FROM ev"),
    "matrix_roundtrip": ev(f"SELECT user_id, {js('m')} AS matrix FROM ev"),
    # the first permutation to the canonical form, after two vertices change places
    "compose": ev(f"SELECT user_id, to_json([p[2] - 1, p[1] - 1, p[3] - 1, p[4] - 1, p[5] - 1])::VARCHAR AS composed FROM (SELECT user_id, min(p) AS p FROM cf, perm WHERE n = 5 AND {relabel('m', 'p')} = c GROUP BY user_id)", PERM, CANON),
    "mutate": ev(f"SELECT user_id, (k - 1)::INTEGER AS k, {js(mutated('m', '5', 'k'))} AS mutated FROM ev, range(1, 6) t(k)"),
    "delete_vertex": ev(f"SELECT user_id, (k - 1)::INTEGER AS k, {js(relabel('m', 'list_filter(range(1, 6), lambda v: v <> k)'))} AS deleted FROM ev, range(1, 6) t(k)"),
    "are_isomorphic": ev("SELECT a.user_id, a.c = b.c AS isomorphic FROM cf a LEFT JOIN cf b ON a.user_id = b.user_id + 1", PERM, CANON),
    "trade_quiver_ids": f"WITH {FLOW}, {PERM} SELECT month, {js('any_value(m)')} AS matrix, {qid(f"min({relabel('m', 'p')})")} AS quiver_id FROM fl, perm WHERE n = 5 GROUP BY month",
}

#: The catalogue over the tables: canonical forms reached from subquivers of up to four vertices, their components, orbits of representatives.
GEN = f"""{OWN}, {PERM},
sc AS (SELECT DISTINCT {canon('s')} AS c FROM (SELECT DISTINCT s, len(s) AS n FROM sub WHERE len(s) <= 4) JOIN pl USING (n)),
unl AS (SELECT c FROM sc UNION SELECT {canon('d')} FROM (SELECT {mutated('c', 'len(c)', 'k')} AS d, len(c) AS n FROM unl, range(1, 5) t(k) WHERE k <= len(c)) JOIN pl USING (n) WHERE {maxabs('d')} <= 2),
uedge AS MATERIALIZED (SELECT DISTINCT c AS x, {canon('d')} AS y FROM (SELECT c, {mutated('c', 'len(c)', 'k')} AS d, len(c) AS n FROM unl, range(1, 5) t(k) WHERE k <= len(c)) JOIN pl USING (n) WHERE {maxabs('d')} <= 2),
reach AS (SELECT c AS x, c AS y FROM unl UNION SELECT r.x, u.y FROM reach r JOIN uedge u ON r.y = u.x),
cls AS MATERIALIZED (SELECT x AS c, min(y) AS rep FROM reach GROUP BY x),
orb AS MATERIALIZED (SELECT rep AS r, rep AS m FROM (SELECT DISTINCT rep FROM cls) UNION SELECT r, d FROM (SELECT r, {mutated('m', 'len(m)', 'k')} AS d FROM orb, range(1, 5) t(k) WHERE k <= len(m)) WHERE {maxabs('d')} <= 2),
esc AS MATERIALIZED (SELECT r, m, any_value({canon('m')}) AS c, bool_or({maxabs(mutated('m', 'len(m)', 'k'))} > 2) AS esc FROM orb JOIN pl ON n = len(m), range(1, 5) t(k) WHERE k <= len(m) GROUP BY r, m),
mem AS MATERIALIZED (SELECT r, m, c, esc FROM esc),
mc AS MATERIALIZED (SELECT r, bool_or(esc) AS is_open, count(*)::INTEGER AS labeled_size, count(DISTINCT c)::INTEGER AS dq, (count(*) FILTER (esc))::INTEGER AS frontier FROM mem GROUP BY r)"""
#: Acyclicity of canonical forms by reachability, their other invariants, and Dynkin types of closed classes.
_tits = {n: tits("c", n) for n in range(1, 5)}
_REPC = "CASE WHEN NOT acyc THEN NULL " + " ".join(f"WHEN len(c) = {n} AND {pd} THEN 'finite' WHEN len(c) = {n} AND {psd} THEN 'tame'" for n, (pd, psd) in _tits.items()) + " ELSE 'wild' END"
INV = f"""arrow AS (SELECT c, i, j FROM cls, range(1, 5) t(i), range(1, 5) u(j) WHERE i <= len(c) AND j <= len(c) AND c[i][j] > 0),
along AS (SELECT * FROM arrow UNION SELECT a.c, a.i, b.j FROM along a JOIN arrow b ON a.c = b.c AND a.j = b.i),
touch AS (SELECT c, i, j FROM cls, range(1, 5) t(i), range(1, 5) u(j) WHERE i <= len(c) AND j <= len(c) AND (c[i][j] <> 0 OR i = j)),
touched AS (SELECT * FROM touch UNION SELECT a.c, a.i, b.j FROM touched a JOIN touch b ON a.c = b.c AND a.j = b.i),
parts AS MATERIALIZED (SELECT c, i, min(j) AS root FROM touched GROUP BY c, i),
acy AS (SELECT c, c NOT IN (SELECT c FROM along WHERE i = j) AS acyc FROM cls),
grp AS (SELECT c, count(*) AS o, max({_order()}) AS k FROM cls JOIN perm ON n = len(c) WHERE {relabel('c', 'p')} = c GROUP BY c),
cnt AS (SELECT c, count(*)::INTEGER AS lc FROM mem GROUP BY c),
q AS MATERIALIZED (SELECT c, rep, acyc, {maxabs('c')} AS max_edge, (SELECT count(DISTINCT root) = 1 FROM parts p WHERE p.c = cls.c) AS connected,
 len(list_filter(c, lambda r: list_max(r) > 0 AND list_min(r) < 0)) = 0 AS bip, len(c) > 1 AND len(list_filter(flatten(c), lambda x: abs(x) < 2)) = len(c) AS abu, {_REPC} AS rt, o::INTEGER AS so, {NAME} AS sn, lc
 FROM cls JOIN acy USING (c) JOIN grp USING (c) LEFT JOIN cnt USING (c)),
ref(name, m) AS (VALUES ('A1', [[0]]), ('A2', [[0, 1], [-1, 0]]), ('A3', [[0, 1, 0], [-1, 0, 1], [0, -1, 0]]), ('A4', [[0, 1, 0, 0], [-1, 0, 1, 0], [0, -1, 0, 1], [0, 0, -1, 0]]), ('D4', [[0, 1, 0, 0], [-1, 0, 1, 1], [0, -1, 0, 0], [0, -1, 0, 0]])),
rq AS MATERIALIZED (SELECT name, {canon('m')} AS c FROM ref JOIN pl ON n = len(m) UNION SELECT name, {canon('d')} FROM (SELECT name, {mutated('c', 'len(c)', 'k')} AS d, len(c) AS n FROM rq, range(1, 5) t(k) WHERE k <= len(c)) JOIN pl USING (n) WHERE {maxabs('d')} <= 2),
pieces AS (SELECT r, {relabel('r', 'l')} AS s FROM (SELECT r, list(i ORDER BY i) AS l FROM mc JOIN parts ON parts.c = r WHERE NOT is_open GROUP BY r, root)),
dyn AS MATERIALIZED (SELECT r, CASE WHEN count(name) = count(*) THEN string_agg(name, ' + ' ORDER BY name) END AS dynkin_type FROM (SELECT r, {canon('s')} AS c FROM pieces JOIN pl ON n = len(s)) LEFT JOIN rq USING (c) GROUP BY r),
base AS (SELECT rep AS r, CASE WHEN bool_or(acyc) THEN true WHEN NOT any_value(is_open) THEN false END AS base FROM q JOIN mc ON r = rep GROUP BY rep),
low AS (SELECT c FROM cls JOIN base ON r = rep WHERE base IS FALSE AND len(c) = 3),
hit AS (SELECT DISTINCT rep AS r FROM (SELECT rep, {relabel('c', 'list_filter(range(1, 5), lambda v: v <> k)')} AS s FROM cls, range(1, 5) t(k) WHERE len(c) = 4) JOIN pl ON n = 3 WHERE {canon('s')} IN (SELECT c FROM low)),
ma AS (SELECT r, coalesce(base, CASE WHEN len(r) = 4 AND r IN (SELECT r FROM hit) THEN false END) AS ma FROM base)"""


def gen(select: str, invariants: bool = False) -> str:
    return "WITH RECURSIVE " + GEN + (", " + INV if invariants else "") + " " + select


CQ, CM = qid("c"), qid("r", "MC")
SQL |= {
    "seed_enumeration": f"""WITH {OWN}, {PERM}, lab AS (SELECT 1 AS n, [[0]] AS m UNION ALL SELECT 2, [[0, a], [-a, 0]] FROM range(-2, 3) t(a)
UNION ALL SELECT 3, [[0, a, b], [-a, 0, c], [-b, -c, 0]] FROM range(-2, 3) t(a), range(-2, 3) u(b), range(-2, 3) v(c)
UNION ALL SELECT 4, [[0, a, b, c], [-a, 0, d, e], [-b, -d, 0, f], [-c, -e, -f, 0]] FROM range(-2, 3) t(a), range(-2, 3) u(b), range(-2, 3) v(c), range(-2, 3) w(d), range(-2, 3) x(e), range(-2, 3) y(f)),
seed AS (SELECT DISTINCT n, min({relabel('m', 'p')}) AS c FROM lab JOIN perm USING (n) GROUP BY n, m),
of_data AS (SELECT c, count(*) AS found FROM (SELECT {canon('s')} AS c FROM sub JOIN pl ON n = len(s) WHERE len(s) <= 4) GROUP BY c)
SELECT n::INTEGER AS n, {js('c')} AS matrix, coalesce(found, 0)::BIGINT AS found FROM seed LEFT JOIN of_data USING (c)""",
    "run_generation_n4": gen(f"SELECT len(r)::INTEGER AS n, {CM} AS mc_id, {js('r')} AS canonical_rep, is_open, labeled_size, dq AS distinct_quiver_count, 1 AS merged_orbit_count, frontier FROM mc"),
    "run_generation_n3": gen(f"SELECT len(r)::INTEGER AS n, {CM} AS mc_id, {js('r')} AS canonical_rep, is_open, labeled_size, dq AS distinct_quiver_count, 1 AS merged_orbit_count, frontier FROM mc WHERE len(r) <= 3"),
    "mutation_components": gen(f"SELECT len(c)::INTEGER AS n, {CQ} AS qid, {qid('rep', 'MC')} AS mc_id FROM cls"),
    "membership": gen(f"SELECT DISTINCT {CQ} AS qid, {CM} AS mc_id FROM mem"),
    "consistency_violations": gen(f"SELECT 'representative' AS what, {CM} AS id FROM (SELECT r, min(c) AS least FROM mem GROUP BY r) WHERE least <> r UNION ALL SELECT 'membership', {CQ} FROM cls WHERE rep NOT IN (SELECT r FROM mc) UNION ALL SELECT 'quiver id', {CQ} FROM cls JOIN pl ON n = len(c) WHERE {canon('c')} <> c"),
    "generated_gluing": gen("""SELECT (count(*) FILTER (closed > 1))::BIGINT AS closed_closed, (count(*) FILTER (closed > 0 AND closed < orbits))::BIGINT AS closed_open, (count(*) FILTER (orbits - closed > 1))::BIGINT AS open_open
FROM (SELECT c, count(DISTINCT r) AS orbits, count(DISTINCT CASE WHEN NOT is_open THEN r END) AS closed FROM mem JOIN mc USING (r) GROUP BY c)"""),
    "generation_summary": gen("SELECT len(r)::INTEGER AS n, count(*) FILTER (NOT is_open) AS closed, count(*) FILTER (is_open) AS open FROM mc GROUP BY 1"),
    "labeling_counts": gen(f"SELECT {CQ} AS quiver_id, count(*) AS labeling_count FROM mem GROUP BY c"),
    "class_sizes": gen(f"SELECT {CM} AS mc_id, labeled_size, dq AS distinct_quiver_count FROM mc"),
    "class_openness": gen(f"SELECT {CM} AS mc_id, is_open FROM mc"),
    "class_size": gen(f"SELECT {CQ} AS quiver_id, CASE WHEN NOT is_open THEN labeled_size END AS class_size FROM cls JOIN mc ON r = rep"),
    "frontier_size": gen(f"SELECT {CM} AS mc_id, frontier AS size_of_explored_frontier, frontier AS boundary FROM mc"),
    "distinct_quivers": gen(f"SELECT {CM} AS mc_id, {CQ} AS quiver_id, {js('c')} AS matrix, count(*)::INTEGER AS labeling_count, c = r AS is_canonical FROM mem GROUP BY r, c"),
    "class_mutation_acyclic_base": gen(f"SELECT {CM} AS mc_id, base FROM base", True),
    "resolve_mutation_acyclic": gen(f"SELECT {CM} AS mc_id, ma AS is_mutation_acyclic FROM ma", True),
    "dynkin_reference": gen(f"SELECT name, {qid('any_value(rep)', 'MC')} AS mc_id, count(owner) AS found FROM (SELECT name, c, min(c) OVER (PARTITION BY name) AS rep FROM rq) LEFT JOIN (SELECT owner, {canon('s')} AS c FROM sub JOIN pl ON n = len(s) WHERE n <= 4) USING (c) GROUP BY name", True),
    "dynkin_classify": gen(f"SELECT {CM} AS mc_id, dynkin_type FROM dyn", True),
    "nation_components": """WITH RECURSIVE e AS (SELECT n_nationkey AS x, n_regionkey * 5 AS y FROM nation UNION SELECT n_regionkey * 5, n_nationkey FROM nation),
g AS (SELECT n_nationkey AS node, n_nationkey AS y FROM nation UNION SELECT g.node, e.y FROM g JOIN e ON g.y = e.x) SELECT node::BIGINT AS node, min(y)::BIGINT AS root FROM g GROUP BY node""",
}
_FAMILIES = ", ".join(
    f"('{f}{n}', {n}, {json.dumps([[(1 if i < j else -1) if ((abs(i - j) == 1 and not (f == 'D' and max(i, j) == n - 1)) or (f == 'D' and (min(i, j), max(i, j)) == (n - 3, n - 1))) else 0 for j in range(n)] for i in range(n)])})"
    for f in "AD" for n in range(1 if f == "A" else 4, 6))
SQL["dynkin_seeds"] = f"""WITH {OWN}, {PERM}, fam(name, n, m) AS (VALUES {_FAMILIES}), of_data AS (SELECT {canon('s')} AS c, count(*) AS found FROM sub JOIN pl ON n = len(s) GROUP BY 1)
SELECT name, fam.n::INTEGER AS n, {js('m')} AS matrix, coalesce(found, 0)::BIGINT AS found FROM fam JOIN pl ON pl.n = fam.n LEFT JOIN of_data ON c = {canon('m')}"""


def orbits(start: str) -> str:
    """What is reached from the different matrices ``start(m)``, each for itself, and which of it a mutation takes out of the bound."""
    return f"""{PERM}, start AS ({start}),
reached AS (SELECT m AS s, m FROM start UNION SELECT s, d FROM (SELECT s, {mutated('m', 'len(m)', 'k')} AS d FROM reached, range(1, 6) t(k) WHERE k <= len(m)) WHERE {maxabs('d')} <= 2),
found AS MATERIALIZED (SELECT s, m, bool_or({maxabs(mutated('m', 'len(m)', 'k'))} > 2) AS esc FROM reached, range(1, 6) t(k) WHERE k <= len(m) GROUP BY s, m)"""


SQL["bfs_orbit"] = f"WITH RECURSIVE {OWN}, {orbits('SELECT DISTINCT m FROM own')} SELECT owner, {js('f.m')} AS matrix, esc AS is_boundary FROM own JOIN found f ON s = own.m"
for _name, _seed in (("explore_a3", "A3"), ("explore_d4", "D4"), ("explore_open3", "open3")):
    _start = f"SELECT DISTINCT s AS m FROM sub JOIN pl ON n = len(s) WHERE {canon('s')} = (SELECT {canon('t')} FROM (SELECT {_mat(SEEDS[_seed])} AS t) JOIN pl ON n = len(t))"
    SQL[_name] = f"""WITH RECURSIVE {OWN}, {orbits(_start)}, forms AS (SELECT s, m, esc, {canon('m')} AS c FROM found JOIN pl ON n = len(m))
SELECT {js('s')} AS seed, {qid('min(c)', 'MC')} AS mc_id, {js('min(c)')} AS canonical_rep, bool_or(esc) AS is_open, count(*)::INTEGER AS labeled_size, count(DISTINCT c)::INTEGER AS distinct_quiver_count, (count(*) FILTER (esc))::INTEGER AS frontier FROM forms GROUP BY s"""
_FOURS = relabel("m", _mat([v + 1 for v in FIRST_FOUR]))
SQL["merge_orbits"] = f"""WITH RECURSIVE {OWN}, {orbits(f'SELECT DISTINCT {_FOURS} AS m FROM own')}, forms AS MATERIALIZED (SELECT s, m, esc, {canon('m')} AS c FROM found JOIN pl ON n = len(m)),
kind AS (SELECT s, min(c) AS rep, bool_or(esc) AS is_open FROM forms GROUP BY s), raw AS (SELECT owner, s, rep, is_open FROM (SELECT owner, {_FOURS} AS s FROM own) JOIN kind USING (s)),
named AS (SELECT *, min(owner) OVER (PARTITION BY rep) AS class FROM raw)
SELECT class, {qid('any_value(rep)', 'MC')} AS mc_id, {js('any_value(rep)')} AS canonical_rep, bool_or(is_open) AS is_open, count(DISTINCT forms.m)::INTEGER AS labeled_size, count(DISTINCT c)::INTEGER AS distinct_quiver_count, count(DISTINCT owner)::INTEGER AS merged_orbit_count, (count(DISTINCT forms.m) FILTER (esc))::INTEGER AS frontier
FROM named JOIN forms USING (s) GROUP BY class"""
#: Canonical forms that each owner's quiver of five vertices reaches.
FIVE = f"""{OWN}, {PERM}, oc AS MATERIALIZED (SELECT owner, {canon('m')} AS c FROM own JOIN pl ON n = 5),
unl5 AS (SELECT c FROM oc UNION SELECT {canon('d')} FROM (SELECT {mutated('c', '5', 'k')} AS d FROM unl5, range(1, 6) t(k)) JOIN pl ON n = 5 WHERE {maxabs('d')} <= 2),
step5 AS MATERIALIZED (SELECT c AS x, {maxabs('d')} <= 2 AS stays, {canon('d')} AS y FROM (SELECT c, {mutated('c', '5', 'k')} AS d FROM unl5, range(1, 6) t(k)) JOIN pl ON n = 5),
from5 AS (SELECT DISTINCT c AS x, c AS y FROM oc UNION SELECT f.x, s.y FROM from5 f JOIN step5 s ON f.y = s.x WHERE stays),
open5 AS (SELECT f.x, bool_or(NOT stays) AS is_open FROM from5 f JOIN step5 s ON s.x = f.y GROUP BY f.x),
raw AS MATERIALIZED (SELECT owner AS orbit, is_open, y AS c FROM oc JOIN from5 f ON f.x = oc.c JOIN open5 o ON o.x = oc.c)"""
SQL["canonical_class_rep"] = f"WITH RECURSIVE {FIVE} SELECT orbit AS owner, {js('min(c)')} AS canonical_rep FROM raw GROUP BY orbit"
SQL["orbit_overlap"] = f"WITH RECURSIVE {FIVE} SELECT a, orbit AS b, count(*)::BIGINT AS quivers FROM (SELECT orbit, c, min(orbit) OVER (PARTITION BY c) AS a FROM raw) WHERE a <> orbit GROUP BY a, orbit"
# orbits that share one quiver share all, so components are orbits with the same least form
SQL["gluing_counters"] = f"""WITH RECURSIVE {FIVE}, kind AS (SELECT orbit, any_value(is_open) AS is_open, min(c) AS rep FROM raw GROUP BY orbit), n AS (SELECT count(*) FILTER (NOT is_open) AS c, count(*) FILTER (is_open) AS o, count(DISTINCT CASE WHEN NOT is_open THEN rep END) AS ck, count(DISTINCT CASE WHEN is_open THEN rep END) AS ok, count(DISTINCT rep) AS k FROM kind)
SELECT (c - ck)::BIGINT AS closed_closed, (ck + ok - k)::BIGINT AS closed_open, (o - ok)::BIGINT AS open_open FROM n"""
#: Customers and suppliers of a month, linked by its order lines; roots by the smallest reached in rounds that the graph's width doesn't exceed.
SQL["trade_components"] = """WITH RECURSIVE line AS MATERIALIZED (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') || printf('/c%09d', o_custkey) AS a, strftime(o_orderdate, '%Y-%m') || printf('/s%09d', l_suppkey) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS MATERIALIZED (SELECT a AS x, b AS y FROM line UNION ALL SELECT b, a FROM line),
g AS (SELECT DISTINCT x AS node, x AS y FROM e UNION SELECT g.node, e.y FROM g JOIN e ON g.y = e.x) SELECT node, min(y) AS root FROM g GROUP BY node"""

# an element is a generator if those before it don't generate it
_THEN = "list_transform(h.p, lambda i: c.x[i])"
SQL["symmetry_generators"] = f"""WITH RECURSIVE {OWN}, {PERM}, oaut AS MATERIALIZED (SELECT owner, p FROM own, perm WHERE n = 5 AND {relabel('m', 'p')} = m),
made AS (SELECT owner, p AS g, [1, 2, 3, 4, 5] AS x FROM oaut UNION SELECT c.owner, c.g, {_THEN} FROM made c JOIN oaut h ON c.owner = h.owner AND h.p < c.g),
chosen AS (SELECT owner, p FROM oaut ANTI JOIN made ON oaut.owner = made.owner AND oaut.p = made.g AND oaut.p = made.x),
said AS (SELECT owner, count(*) AS o, max({_order()}) AS k FROM oaut GROUP BY owner)
SELECT owner, o::VARCHAR AS "order", {NAME} AS name, coalesce(generators, '[]') AS generators FROM said LEFT JOIN (SELECT owner, to_json(list(list_transform(p, lambda i: i - 1) ORDER BY p))::VARCHAR AS generators FROM chosen GROUP BY owner) USING (owner)"""
NATIONS = """nflow AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, s_nationkey AS i, c_nationkey AS j FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
net AS (SELECT month, i, j, sum(n)::INTEGER AS n FROM (SELECT month, i, j, count(*) AS n FROM nflow GROUP BY ALL UNION ALL SELECT month, j, i, -count(*) FROM nflow GROUP BY ALL) GROUP BY ALL),
cell AS (SELECT month, a.n_nationkey AS i, b.n_nationkey AS j FROM (SELECT DISTINCT month FROM nflow), nation a, nation b),
nq AS MATERIALIZED (SELECT month, list(r ORDER BY i) AS m FROM (SELECT month, i, list(coalesce(n, 0) ORDER BY j) AS r FROM cell LEFT JOIN net USING (month, i, j) GROUP BY month, i) GROUP BY month)"""
SQL["canonical_verify"] = f"""WITH {NATIONS}, p6 AS MATERIALIZED (SELECT list([a, b, c, d, e, f]) AS ps FROM range(1, 7) t(a), range(1, 7) u(b), range(1, 7) v(c), range(1, 7) w(d), range(1, 7) x(e), range(1, 7) y(f) WHERE len(list_distinct([a, b, c, d, e, f])) = 6),
six AS (SELECT month || ' ' || k AS key, list_transform(m[k + 1:k + 6], lambda r: r[k + 1:k + 6]) AS s FROM nq, range(0, 20) t(k)) SELECT key, {js(canon('s'))} AS canonical, true AS agree FROM six, p6"""
# row by row: of the vertices that stand first by their entries in the rows so far, those whose own row is least; of equal ones the first
_ROW = "list_concat(list_transform(placed, lambda p: m[v][p]), [0], list_transform(list_sort(list_transform(list_filter(rest, lambda w: w <> v), lambda w: {'s': sig[w], 'x': m[v][w]})), lambda z: z.x))"
SQL["canonical_nations"] = f"""WITH RECURSIVE {NATIONS},
st AS (SELECT month, m, []::INTEGER[] AS placed, list_transform(range(1, len(m) + 1), lambda w: []::INTEGER[]) AS sig FROM nq
UNION ALL SELECT month, m, list_append(placed, v::INTEGER), list_transform(range(1, len(m) + 1), lambda w: list_append(sig[w], m[v][w])) FROM (SELECT *, {_ROW} AS r FROM (
  SELECT *, list_filter(range(1, len(m) + 1), lambda w: NOT list_contains(placed, w::INTEGER)) AS rest, unnest(range(1, len(m) + 1)) AS v FROM st WHERE len(placed) < len(m))
  WHERE list_contains(rest, v) AND sig[v] = list_min(list_transform(rest, lambda w: sig[w])) AND len(list_filter(rest, lambda u: u < v AND m[u] = m[v])) = 0) QUALIFY r = min(r) OVER (PARTITION BY month))
SELECT month, len(any_value(m))::INTEGER AS n, sha256({js(f"min({relabel('m', 'placed')})")}) AS certificate FROM st WHERE len(placed) = len(m) GROUP BY month"""

#: The joined listing.
VIEW = f", v AS MATERIALIZED (SELECT q.*, {CQ} AS quiver_id, {CM} AS mc_id, is_open, labeled_size, dq, frontier, dynkin_type, ma FROM q JOIN mc ON r = rep LEFT JOIN dyn USING (r) LEFT JOIN ma USING (r))"
ITEM = "quiver_id, len(c)::INTEGER AS num_vertices, dynkin_type, rt AS representation_type, max_edge, acyc AS is_acyclic, connected AS is_connected, bip AS is_bipartite, is_open, CASE WHEN NOT is_open THEN labeled_size END AS class_size"


def view(select: str) -> str:
    return "WITH RECURSIVE " + GEN + ", " + INV + VIEW + " " + select


_WHERE = {
    "rank": "len(c) = {}", "max_edge": "max_edge = {}", "is_acyclic": "acyc = {}", "is_connected": "connected = {}", "is_simply_laced": "(max_edge <= 1) = {}", "is_open": "is_open = {}", "is_mutation_finite": "is_open <> {}",
    "dynkin_type": "dynkin_type = '{}'", "representation_type": "rt = '{}'", "orbit_min": "labeled_size >= {}", "orbit_max": "labeled_size <= {}",
}
for _name, _filters in FILTERS.items():
    SQL[_name] = view("SELECT quiver_id, lc AS labeling_count FROM v WHERE " + " AND ".join(_WHERE[k].format(x) for k, x in _filters.items()))
_LABELINGS = "SELECT v.*, m AS labeling FROM v LEFT JOIN (SELECT r AS lr, m, c AS lc_ FROM mem) l ON l.lr = v.rep AND l.lc_ = v.c"
SQL |= {
    "join_quiver_class": view(f"SELECT {ITEM}, {js('c')} AS exchange_matrix, mc_id FROM v"),
    "list_quivers": view(f"SELECT {ITEM}, {js('c')} AS exchange_matrix, mc_id FROM v WHERE len(c) = 3 AND acyc ORDER BY len(c), quiver_id LIMIT 50"),
    "list_sorted": view(f"SELECT {ITEM}, {js('c')} AS exchange_matrix, mc_id FROM v ORDER BY labeled_size DESC NULLS FIRST, quiver_id"),
    "list_page": view(f"SELECT {ITEM}, {js('c')} AS exchange_matrix, mc_id FROM v ORDER BY max_edge DESC NULLS FIRST, quiver_id LIMIT 30 OFFSET 20"),
    "labelings_scope": view(f"SELECT {ITEM}, {js('coalesce(labeling, c)')} AS exchange_matrix, mc_id FROM ({_LABELINGS})"),
    "labelings_page": view(f"SELECT {ITEM}, {js('coalesce(labeling, c)')} AS exchange_matrix, mc_id FROM ({_LABELINGS}) ORDER BY quiver_id, coalesce(labeling, c) LIMIT 50 OFFSET 100"),
    "search": view(f"SELECT {ITEM}, {js('c')} AS exchange_matrix, mc_id FROM v WHERE max_edge <= 1 AND connected ORDER BY len(c), quiver_id LIMIT 100"),
    "quiver_detail": view(f"SELECT {ITEM}, {js('c')} AS exchange_matrix, mc_id, dynkin_type AS label, abu AS is_abundant, true AS is_planar, so AS symmetry_order, sn AS symmetry_name, 0 AS tags FROM v WHERE quiver_id = 'Q.n3.760c251bd59844de'"),
    "class_detail": view(f"""SELECT {CM} AS mc_id, len(r)::INTEGER AS num_vertices, {js('r')} AS canonical_rep, is_open, CASE WHEN NOT is_open THEN labeled_size END AS class_size, labeled_size, dq AS distinct_quiver_count, {qid('r')} AS canonical_qid, dynkin_type, labeled_size AS size_of_explored_mutation_class, labeled_size AS labelings,
 (SELECT to_json(list(quiver_id ORDER BY c <> rep, -lc, quiver_id))::VARCHAR FROM v WHERE v.rep = mc.r) AS distinct_ids FROM mc LEFT JOIN dyn USING (r) WHERE {CM} = 'MC.n3.b381eb01e067a126'"""),
    "totals": view("SELECT count(*) AS total, count(*) AS distinct_total, coalesce(sum(lc), 0)::BIGINT AS labeled_total FROM v WHERE len(c) = 4 AND connected"),
    "export_cell_format": view("SELECT quiver_id, coalesce(rt, '') AS representation_type, max_edge::VARCHAR AS max_edge, upper(acyc::VARCHAR) AS is_acyclic, '' AS class_size, 'TRUE' AS is_planar FROM v WHERE is_open"),
    "upsert_merge": view("SELECT quiver_id AS quiver_id, len(c)::INTEGER AS n_vertices, CASE WHEN len(c) = 2 THEN -2 ELSE lc END AS labeling_count FROM v"),
    "backfill_labeling_count": view("SELECT quiver_id AS quiver_id, CASE WHEN mc_id < 'MC.n4.8' THEN lc ELSE 1 END AS labeling_count FROM v"),
    "backfill_mutation_acyclic": gen(f"SELECT {CM} AS mc_id, base AS was, ma AS now FROM base JOIN ma USING (r) WHERE base IS DISTINCT FROM ma", True),
    "join_events_catalogue": view(f"""SELECT user_id, k, {qid('e.c')} AS quiver_id, mc_id, rt AS representation_type, is_open, dynkin_type
FROM (SELECT user_id, (k - 1)::INTEGER AS k, {canon('d')} AS c FROM (SELECT user_id, k, {relabel('m', 'list_filter(range(1, 6), lambda v: v <> k)')} AS d FROM ev, range(1, 6) t(k)) JOIN pl ON n = 4) e LEFT JOIN v ON v.c = e.c"""),
}
# A class with an acyclic member meets all conditions, a closed one without none. Of the open ones without, those do that have a
# member with a source that leaves a class that does, and for two of the conditions a neighbour of it that does, too.
# Members are looked for beyond the bound, too, up to entries of 8 and four mutations away.
LA = f"""far AS (SELECT rep, c AS m, 0 AS d FROM cls JOIN base ON r = rep WHERE base IS NULL UNION SELECT rep, {mutated('m', '4', 'k')}, d + 1 FROM far, range(1, 5) t(k) WHERE d < 4 AND {maxabs(mutated('m', '4', 'k'))} <= 8),
members AS MATERIALIZED (SELECT DISTINCT rep, m AS c FROM far),
deletions AS MATERIALIZED (SELECT rep, c, k, {relabel('c', 'list_filter(range(1, 5), lambda v: v <> k)')} AS s FROM members, range(1, 5) t(k)),
below AS (SELECT s AS o, s, 0 AS d FROM (SELECT DISTINCT s FROM deletions) UNION SELECT o, {mutated('s', '3', 'k')}, d + 1 FROM below, range(1, 4) t(k) WHERE d < 3 AND {maxabs(mutated('s', '3', 'k'))} <= 8),
good AS MATERIALIZED (SELECT DISTINCT o FROM below WHERE NOT (s[1][2] * s[2][3] > 0 AND s[2][3] * s[3][1] > 0)),
deleted AS MATERIALIZED (SELECT rep, c, k, s IN (SELECT o FROM good) AS ok FROM deletions),
sourced AS (SELECT * FROM deleted WHERE ok AND list_min(c[k]) >= 0),
pprime AS (SELECT DISTINCT rep AS r FROM sourced),
banff AS (SELECT DISTINCT s.rep AS r FROM sourced s JOIN deleted d ON s.c = d.c AND d.ok AND s.c[s.k][d.k] <> 0),
la AS (SELECT r, coalesce(base, CASE WHEN r IN (SELECT r FROM banff) THEN true END) AS is_banff, coalesce(base, CASE WHEN r IN (SELECT r FROM pprime) THEN true END) AS is_p_prime FROM base)"""


def conditions(select: str) -> str:
    return "WITH RECURSIVE " + GEN + ", " + INV + VIEW + ", " + LA + " " + select


SQL["local_acyclicity"] = conditions(f"SELECT {CM} AS mc_id, is_banff, is_banff AS is_louise, is_p_prime FROM la")
SQL["local_acyclicity_all"] = conditions(f"SELECT {CM} AS mc_id, is_banff, is_banff AS is_louise, is_p_prime, nullif(is_banff, false) AS banff_proved, nullif(is_banff, false) AS louise_proved, nullif(is_p_prime, false) AS p_prime_proved FROM la")
_SAID = "coalesce({0}::VARCHAR, 'unknown')"
SQL["provenance"] = conditions(f"SELECT {CM} AS mc_id, {_SAID.format('is_banff')} AS banff, {_SAID.format('is_banff')} AS louise, {_SAID.format('is_p_prime')} AS p_prime, CASE WHEN is_open THEN 'Derksen-Owen: a bounded mutation reached |b_ij| >= 3' END AS method FROM la JOIN mc USING (r)")
# how far the first member that meets a condition is: an acyclic one, else one with a source as above; members up to entries of 8
STEPS = f"""walk AS MATERIALIZED (SELECT r, r AS m, 0 AS d FROM base WHERE base IS DISTINCT FROM false UNION SELECT r, {mutated('m', 'len(m)', 'k')}, d + 1 FROM walk, range(1, 5) t(k) WHERE k <= len(m) AND d < 4 AND {maxabs(mutated('m', 'len(m)', 'k'))} <= 8),
wa AS (SELECT m, i, j FROM (SELECT DISTINCT m FROM walk), range(1, 5) t(i), range(1, 5) u(j) WHERE i <= len(m) AND j <= len(m) AND m[i][j] > 0),
wr AS (SELECT * FROM wa UNION SELECT a.m, a.i, b.j FROM wr a JOIN wa b ON a.m = b.m AND a.j = b.i),
ends AS (SELECT r, min(d) AS steps FROM walk WHERE m NOT IN (SELECT m FROM wr WHERE i = j) GROUP BY r),
deep AS (SELECT r, m, min(d) AS d FROM walk GROUP BY r, m),
meets_p AS (SELECT r, min(d) AS steps FROM deep JOIN sourced s ON s.rep = r AND s.c = deep.m GROUP BY r),
meets_b AS (SELECT r, min(d) AS steps FROM deep JOIN (SELECT DISTINCT s.rep, s.c FROM sourced s JOIN deleted e ON s.c = e.c AND e.ok AND s.c[s.k][e.k] <> 0) s ON s.rep = r AND s.c = deep.m GROUP BY r)"""
_DOC = lambda c, state, steps: f"""'"is_{c}":{{"state":"' || {_SAID.format(state)} || '","witness":' || CASE WHEN {state} THEN coalesce(e.steps, {steps})::VARCHAR ELSE 'null' END || '}}'"""
SQL["provenance_all"] = "WITH RECURSIVE " + GEN + ", " + INV + VIEW + ", " + LA + ", " + STEPS + f""" SELECT {qid('la.r', 'MC')} AS mc_id, '{{' || {_DOC('banff', 'is_banff', 'b.steps')} || ',' || {_DOC('louise', 'is_banff', 'b.steps')} || ',' || {_DOC('p_prime', 'is_p_prime', 'p.steps')}
|| CASE WHEN is_open THEN ',"is_infinite_confirmed":{{"method":"Derksen-Owen: a bounded mutation reached |b_ij| >= 3"}}' ELSE '' END || '}}' AS document FROM la JOIN mc USING (r) LEFT JOIN ends e USING (r) LEFT JOIN meets_p p USING (r) LEFT JOIN meets_b b USING (r)"""
SQL["la_path"] = f"""WITH RECURSIVE {EV}, go AS MATERIALIZED (SELECT m AS s, m, 0 AS d FROM (SELECT DISTINCT m FROM ev) UNION SELECT s, {mutated('m', '5', 'k')}, d + 1 FROM go, range(1, 6) t(k) WHERE d < {LA_DEPTH} AND {maxabs(mutated('m', '5', 'k'))} <= 8),
near AS MATERIALIZED (SELECT s, m, min(d) AS d FROM go GROUP BY s, m), ga AS (SELECT m, i, j FROM (SELECT DISTINCT m FROM near), range(1, 6) t(i), range(1, 6) u(j) WHERE m[i][j] > 0), gr AS (SELECT * FROM ga UNION SELECT a.m, a.i, b.j FROM gr a JOIN ga b ON a.m = b.m AND a.j = b.i),
hit AS (SELECT s, min(d) AS steps FROM near WHERE m NOT IN (SELECT m FROM gr WHERE i = j) GROUP BY s),
cut AS (SELECT s, bool_or(d = {LA_DEPTH} OR {maxabs(mutated('m', '5', 'k'))} > 8) AS cut FROM near, range(1, 6) t(k) GROUP BY s)
SELECT user_id, CASE WHEN steps IS NOT NULL THEN 'true' WHEN cut THEN 'unknown' ELSE 'false' END AS state, steps, CASE WHEN steps IS NOT NULL THEN true END AS replayed FROM ev JOIN cut ON cut.s = ev.m LEFT JOIN hit ON hit.s = ev.m"""
_EXPORT = "quiver_id, len(c)::INTEGER AS num_vertices, {matrix} AS exchange_matrix, rt AS representation_type, max_edge, acyc AS is_acyclic, connected AS is_connected, bip AS is_bipartite, abu AS is_abundant, true AS is_planar, so AS symmetry_order, sn AS symmetry_name, mc_id, dynkin_type, is_open, CASE WHEN NOT is_open THEN labeled_size END AS class_size, labeled_size, dq AS distinct_quiver_count, 1 AS merged_orbit_count, NOT is_open AS is_finite_confirmed, is_open AS is_infinite_confirmed, false AS is_infinite_expected, frontier AS size_of_explored_frontier, ma AS is_mutation_acyclic, la.is_banff, la.is_banff AS is_louise, la.is_p_prime"
SQL["export_distinct"] = conditions(f"SELECT {_EXPORT.format(matrix=js('c'))} FROM v LEFT JOIN la ON la.r = rep")
SQL["export_labelings"] = conditions(f"SELECT {_EXPORT.format(matrix=js('coalesce(labeling, c)'))} FROM ({_LABELINGS}) x LEFT JOIN la ON la.r = x.rep")
_LINE = ", ".join(f"""coalesce({f'upper({c}::VARCHAR)' if c.startswith('is_') else f"CASE WHEN {c} LIKE '%,%' THEN '\"' || {c} || '\"' ELSE {c} END" if c == 'exchange_matrix' else f'{c}::VARCHAR'}, '')""" for c in EXPORT_COLUMNS)
SQL["export_csv"] = f"SELECT concat_ws(',', {_LINE}) AS line FROM ({SQL['export_distinct']})"
SQL["download_log"] = """SELECT CASE WHEN event_id % 2 = 0 THEN 'csv' ELSE 'xlsx' END AS fmt, event_id % 100 AS row_count, CASE WHEN user_id % 3 > 0 THEN '{"rank":"' || (user_id % 3) || '","scope":"distinct"}' ELSE '{"scope":"distinct"}' END AS filters,
CASE WHEN user_id % 2 = 1 THEN user_id || '@example.org' END AS email, NULL::VARCHAR AS name, CASE WHEN event_id % 5 > 0 THEN '10.0.0.' || (event_id % 5) ELSE '127.0.0.1' END AS ip, NULL::VARCHAR AS user_agent, event_id::VARCHAR AS referer FROM events"""
SQL["client_ip"] = "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN '10.0.0.' || (event_id % 5) ELSE '127.0.0.1' END AS ip FROM events"
SQL["logged_filters"] = """SELECT event_id, CASE WHEN user_id % 3 > 0 THEN '{"rank":"' || (user_id % 3) || '","scope":"distinct"}' ELSE '{"scope":"distinct"}' END AS filters FROM events"""

ORACLES: dict[str, str] = SQL
