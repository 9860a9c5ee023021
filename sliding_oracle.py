"""DuckDB SQL of whole sliding runs with two components and a 3-wide sketch (k=2, subsample=1, one round, G3 seed).

A recursive CTE keeps each key's window as a list of rows. The round is taken
in closed form: 3 x 3 Cholesky of the sketch's Gram, then the eigenvalues of the
3 x 3 Gram of the orthonormalised columns by the trigonometric formula and its
eigenvectors by cross products. Weakest kept against strongest new component, swap, scores
and the spectral error (ten 2-wide rounds on the deflated window) follow the run.

``tab`` is SQL giving ``label, rid, y``: rows numbered from 0 within each label.
"""

from __future__ import annotations


def _dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def _combine(weights: list[str], vectors: list[str], over: str = "1.0") -> str:
    """Elementwise ``sum(weight * vector) / over`` of equally long lists."""
    terms = " + ".join(f"({w}) * {v}[p + 1]" for w, v in zip(weights, vectors))
    return f"list_transform(range(len({vectors[0]})), lambda p: ({terms}) / ({over}))"


def _stage(inner: str, **columns: str) -> str:
    """All columns of ``inner`` and some made from them."""
    return "(select *, " + ", ".join(f"{expr} as {name}" for name, expr in columns.items()) + f" from {inner})"


def _deflated(rows: str, first: str, second: str) -> str:
    """Every row less its parts along two orthonormal vectors."""
    return (f"list_transform({rows}, lambda r: list_transform(range(len(r)), lambda p: r[p + 1] - "
            f"{_dot('r', first)} * {first}[p + 1] - {_dot('r', second)} * {second}[p + 1]))")


def _centred_gram(src: str) -> str:
    src = _stage(src, mu="list_transform(range(len(w[1])), lambda j: list_avg(list_transform(w, lambda r: r[j + 1])))")
    return _stage(src, c="list_transform(range(len(mu)), lambda i: list_transform(range(len(mu)), lambda j: "
                         "list_sum(list_transform(w, lambda r: (r[i + 1] - mu[i + 1]) * (r[j + 1] - mu[j + 1])))))")


def _seed(column: int) -> str:
    return f"list_transform(range(len(w[1])), lambda x: ((x + {column}) % 10 + 1)::DOUBLE)"


def _cross(a: str, b: str) -> str:
    """Cross product of two lists of three numbers."""
    return f"[{a}[2] * {b}[3] - {a}[3] * {b}[2], {a}[3] * {b}[1] - {a}[1] * {b}[3], {a}[1] * {b}[2] - {a}[2] * {b}[1]]"


def _round3(src: str) -> str:
    """``src`` with ``n0, n1, n2`` (all singular values of a 3-wide round) and the first two vectors ``va_new, vb_new``."""
    s = _stage(_centred_gram(src), b1=_seed(0), b2=_seed(1), b3=_seed(2))
    s = _stage(s, **{f"y{j}": f"list_transform(c, lambda r: list_inner_product(r, b{j}))" for j in (1, 2, 3)})
    s = _stage(s, **{f"z{i}{j}": _dot(f"b{i}", f"y{j}") for i in (1, 2, 3) for j in range(i, 4)})
    s = _stage(s, l11="sqrt(z11)", l21="z12 / sqrt(z11)", l31="z13 / sqrt(z11)")
    s = _stage(s, l22="sqrt(z22 - l21 * l21)")
    s = _stage(s, l32="(z23 - l31 * l21) / l22")
    s = _stage(s, l33="sqrt(z33 - l31 * l31 - l32 * l32)", q1=_combine(["1.0"], ["y1"], "l11"))
    s = _stage(s, q2=_combine(["1.0", "-l21"], ["y2", "q1"], "l22"))
    s = _stage(s, q3=_combine(["1.0", "-l31", "-l32"], ["y3", "q1", "q2"], "l33"))
    s = _stage(s, **{f"g{i}{j}": _dot(f"q{i}", f"q{j}") for i in (1, 2, 3) for j in range(i, 4)})
    # eigenvalues of a symmetric 3 x 3 matrix
    s = _stage(s, mid="(g11 + g22 + g33) / 3")
    s = _stage(s, size="sqrt(((g11 - mid) ^ 2 + (g22 - mid) ^ 2 + (g33 - mid) ^ 2 + 2 * (g12 ^ 2 + g13 ^ 2 + g23 ^ 2)) / 6)")
    s = _stage(s, half="((g11 - mid) * ((g22 - mid) * (g33 - mid) - g23 * g23) - g12 * (g12 * (g33 - mid) - g23 * g13) "
                       "+ g13 * (g12 * g23 - (g22 - mid) * g13)) / (2 * size ^ 3)")
    s = _stage(s, phi="acos(greatest(-1.0, least(1.0, half))) / 3")
    s = _stage(s, e1="mid + 2 * size * cos(phi)", e3="mid + 2 * size * cos(phi + 2 * pi() / 3)")
    s = _stage(s, e2="3 * mid - e1 - e3")
    for e, v in (("e1", "va_new"), ("e2", "vb_new")):
        s = _stage(s, r1=f"[g11 - {e}, g12, g13]", r2=f"[g12, g22 - {e}, g23]", r3=f"[g13, g23, g33 - {e}]")
        s = _stage(s, x12=_cross("r1", "r2"), x13=_cross("r1", "r3"), x23=_cross("r2", "r3"))
        s = _stage(s, m12=_dot("x12", "x12"), m13=_dot("x13", "x13"), m23=_dot("x23", "x23"))
        s = _stage(s, u="case when m12 >= m13 and m12 >= m23 then x12 when m13 >= m23 then x13 else x23 end")
        s = _stage(s, raw=_combine(["u[1]", "u[2]", "u[3]"], ["q1", "q2", "q3"]))
        s = _stage(s, largest="raw[list_position(list_transform(raw, lambda x: abs(x)), list_max(list_transform(raw, lambda x: abs(x))))]")
        s = _stage(s, **{v: "list_transform(raw, lambda x: x * sign(largest) / sqrt(list_inner_product(raw, raw)))"})
        s = (f"(select * exclude (r1, r2, r3, x12, x13, x23, m12, m13, m23, u, raw, largest) from {s})")
    return _stage(s, n0="sqrt(e1)", n1="sqrt(greatest(e2, 0))", n2="sqrt(greatest(e3, 0))")


def run_ctes(block: int, stride: int, tab: str) -> str:
    """CTEs up to ``st``: per label and step the deflated window, both components and their values, and if one was swapped."""
    start = f"(select label, list(y order by rid) as w from tab where rid < {block} and label in (select label from nn) group by label)"
    slid = ("(select st.label, st.t, st.va, st.vb, st.sa, st.sb, "
            + _deflated("list_concat(list_slice(st.w, e.n + 1, len(st.w)), e.ys)", "st.va", "st.vb")
            + " as w from st join entering e on e.label = st.label and e.step = st.t + 1)")
    return f"""
with recursive tab as ({tab}),
nn as (select label, count(*) as n from tab group by label having count(*) >= {block}),
steps as (
  select label, 0 as step, 0::BIGINT as enter_lo, {block}::BIGINT as enter_hi from nn
  union all
  select label, t::INTEGER, ({block} + (t - 1) * {stride})::BIGINT, least({block} + t * {stride}, n)::BIGINT
  from nn, range(1, n + 1) r(t) where {block} + (t - 1) * {stride} < n
),
entering as (select s.label, s.step, list(t.y order by t.rid) as ys, count(*) as n
             from steps s join tab t on t.label = s.label and t.rid >= s.enter_lo and t.rid < s.enter_hi
             where s.step > 0 group by s.label, s.step),
st(label, t, w, va, vb, sa, sb, s2, swapped) as (
  select label, 0, w, va_new, vb_new, n0, n1, n2, false from {_round3(start)}
  union all
  select label, t + 1, w,
         case when n0 > least(sa, sb) and sa <= sb then va_new else va end,
         case when n0 > least(sa, sb) and sa > sb then va_new else vb end,
         case when n0 > least(sa, sb) and sa <= sb then n0 else sa end,
         case when n0 > least(sa, sb) and sa > sb then n0 else sb end, n2, n0 > least(sa, sb)
  from {_round3(slid)}
)"""


def _rounded(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def scores(block: int, stride: int, tab: str, label: bool = False) -> str:
    dots = f"[{_dot('tab.y', 'st.va')}, {_dot('tab.y', 'st.vb')}]"
    return run_ctes(block, stride, tab) + f"""
select {'label, ' if label else ''}row_id, step, comp, {_rounded('v')} as v from (
  select tab.label, tab.rid as row_id, st.t::INTEGER as step, unnest([0, 1])::INTEGER as comp, unnest({dots}) as v
  from tab join st on st.label = tab.label
    and st.t = case when tab.rid < {block} then 0 else floor((tab.rid - {block}) / {stride})::INTEGER + 1 end)"""


def model(block: int, stride: int, tab: str) -> str:
    return run_ctes(block, stride, tab) + f""",
m as (select t, 0 as comp, sa as sigma, va as v from st union all select t, 1, sb, vb from st)
select t::INTEGER as step, comp::INTEGER as comp, {_rounded('sigma')} as sigma, i::INTEGER as i, {_rounded('x')} as x
from (select t, comp, sigma, unnest(range(len(v))) as i, unnest(v) as x from m)"""


def changes(block: int, stride: int, tab: str) -> str:
    return run_ctes(block, stride, tab) + """
select st.t::INTEGER as step, steps.enter_lo::BIGINT as row_id from st join steps on steps.label = st.label and steps.step = st.t
where st.swapped"""


def stats(block: int, stride: int, tab: str, digits: bool = True) -> str:
    """Per step the window's rows, the third singular value and the spectral error of the window without both components."""
    fmt = _rounded if digits else str
    left = "(select t, " + _deflated("w", "va", "vb") + " as w from st)"
    return run_ctes(block, stride, tab) + f""",
cm as (select * from {_stage(_centred_gram(left), b1=_seed(0), b2=_seed(1))}),
rec(t, it, b1, b2, top) as (
  select t, 0, b1, b2, null::DOUBLE from cm
  union all
  select t, it + 1, q1, q2, sqrt((g11 + g22) / 2 + sqrt(((g11 - g22) / 2) ^ 2 + g12 ^ 2)) from {_two_wide()}
)
select st.t::INTEGER as step, len(st.w)::BIGINT as n_rows, {fmt('st.s2')} as sigma_k1, {fmt('rec.top')} as spectral_error
from st join rec on rec.t = st.t and rec.it = 10"""


def mean_error(block: int, stride: int, tab: str) -> str:
    inner = stats(block, stride, tab, digits=False)
    return f"select {_rounded('avg(spectral_error)')} as mean_spectral_error from ({inner})"


def window_errors(block: int, stride: int, tab: str, deflate_row: str) -> str:
    """The spectral error of every raw window of the schedule for a fixed model: ``deflate_row`` deflates a row ``y``."""
    return f"""
with recursive tab as ({tab}),
nn as (select count(*) as n from tab),
steps as (
  select 0 as step, 0::BIGINT as lo, {block}::BIGINT as hi from nn
  union all
  select t::INTEGER, least({block} + t * {stride}, n)::BIGINT - {block}, least({block} + t * {stride}, n)::BIGINT
  from nn, range(1, n + 1) r(t) where {block} + (t - 1) * {stride} < n
),
win as (select s.step as t, list({deflate_row} order by rid) as w from steps s join tab on rid >= lo and rid < hi group by s.step),
cm as (select * from {_stage(_centred_gram('win'), b1=_seed(0), b2=_seed(1))}),
rec(t, it, b1, b2, top) as (
  select t, 0, b1, b2, null::DOUBLE from cm
  union all
  select t, it + 1, q1, q2, sqrt((g11 + g22) / 2 + sqrt(((g11 - g22) / 2) ^ 2 + g12 ^ 2)) from {_two_wide()}
)
select t::INTEGER as step, {_rounded('top')} as spectral_error from rec where it = 10"""


def _two_wide() -> str:
    one = _stage("(select rec.t, rec.it, rec.b1, rec.b2, cm.c from rec join cm on cm.t = rec.t where rec.it < 10)",
                 y1="list_transform(c, lambda r: list_inner_product(r, b1))",
                 y2="list_transform(c, lambda r: list_inner_product(r, b2))")
    one = _stage(one, z11=_dot("b1", "y1"), z12=_dot("b1", "y2"), z22=_dot("b2", "y2"))
    one = _stage(one, l11="sqrt(z11)", l21="z12 / sqrt(z11)")
    one = _stage(one, l22="sqrt(z22 - l21 * l21)", q1=_combine(["1.0"], ["y1"], "l11"))
    one = _stage(one, q2=_combine(["1.0", "-l21"], ["y2", "q1"], "l22"))
    return _stage(one, g11=_dot("q1", "q1"), g12=_dot("q1", "q2"), g22=_dot("q2", "q2"))
