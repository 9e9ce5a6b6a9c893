"""Aggregates of the last n rows at a cost a row that doesn't depend on n.

A frame of n rows is evaluated anew for each row, n steps each.  Here a series is cut into blocks of n rows, and each
row gets the running aggregate from its block's start and, in the other direction, from its block's
end.  The last n rows are the end of one block and the start of the next, so two running aggregates put
together give theirs; nothing is ever taken out again, so minima work, and sums lose no digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tarnlight.functions.frames import DATE, KEY

#: Running aggregates of each kind, as SQL over a value.
PARTS = {
    "range": {"lo": "min({v})", "hi": "max({v})"},
    "mean": {"sum": "sum({v})"},
    "deviation": {"lo": "min({v})", "hi": "max({v})", "sum": "sum({v})", "var": "var_pop({v})"},
    "slope": {"sum": "sum({v})", "cov": "covar_pop({v}, _row)"},
}


def sliding(frame: DataFrame, wanted: dict[str, tuple[str, str, int]], row: str, whole: dict[str, str], key: str = KEY, date: str = DATE) -> DataFrame:
    """``frame`` with ``wanted`` columns: name -> (``min``, ``max``, ``mean``, ``deviation`` or ``slope``, column, rows).

    ``row`` is a column of row numbers (from 1), and ``whole[column]`` one of how many rows in a row up to each hold a
    value; where that is below the window's length, the aggregate is null.  A deviation is that of a sample; a slope is that against the row numbers.
    """
    kinds = {"min": "range", "max": "range"}
    needed: dict[tuple[str, int], dict[str, str]] = {}
    for kind, v, n in wanted.values():
        needed.setdefault((v, n), {}).update(PARTS[kinds.get(kind, kind)])
    lengths = sorted({n for _, n in needed})
    kept = frame.columns
    out = frame.selectExpr("*", f"cast({row} as double) AS _row", *[f"({row} - 1) div {n} AS _block{n}" for n in lengths])
    running = []
    for (v, n), parts in needed.items():
        for part, made in parts.items():
            for side, order in (("p", ""), ("s", "DESC")):
                running.append(f"{made.format(v=f'`{v}`')} OVER (PARTITION BY {key}, _block{n} ORDER BY {date} {order} ROWS UNBOUNDED PRECEDING) AS `_{side}_{part}_{v}_{n}`")
    out = out.selectExpr("*", *running)
    out = out.selectExpr("*", *[f"lag(`_s_{part}_{v}_{n}`, {n - 1}) OVER (PARTITION BY {key} ORDER BY {date}) AS `_l_{part}_{v}_{n}`" for (v, n), parts in needed.items() for part in parts])

    def joined(name: str, kind: str, v: str, n: int) -> str:
        # Rows of the block so far, and of the block before that the window still holds.
        own, rest = f"({row} - _block{n} * {n})", f"({n} - ({row} - _block{n} * {n}))"
        p, s = lambda part: f"`_p_{part}_{v}_{n}`", lambda part: f"`_l_{part}_{v}_{n}`"
        gap = f"({p('sum')} / {own} - try_divide({s('sum')}, {rest}))"
        size = f"{own} * {rest} / {n}"
        if kind in ("min", "max"):
            whole_block, both = p("lo" if kind == "min" else "hi"), f"{'least' if kind == 'min' else 'greatest'}({p('lo' if kind == 'min' else 'hi')}, {s('lo' if kind == 'min' else 'hi')})"
        elif kind == "mean":
            whole_block, both = f"{p('sum')} / {n}", f"({s('sum')} + {p('sum')}) / {n}"
        elif kind == "deviation":
            flat = f"{p('lo')} = {p('hi')} AND ({rest} = 0 OR {s('lo')} = {s('hi')} AND {s('lo')} = {p('lo')})"
            whole_block, both = (f"CASE WHEN {flat} THEN 0D ELSE sqrt(({m}) / {n - 1}) END" for m in (f"{p('var')} * {n}", f"{s('var')} * {rest} + {p('var')} * {own} + {gap} * {gap} * {size}"))
        else:
            spread = n * (n * n - 1) / 12
            # The mean row of the block so far lies n / 2 rows after that of the rest.
            whole_block, both = f"{p('cov')} * {n} / {spread}D", f"({s('cov')} * {rest} + {p('cov')} * {own} + {gap} * {n / 2}D * {size}) / {spread}D"
        return f"CASE WHEN `{whole[v]}` < {n} THEN NULL WHEN {rest} = 0 THEN {whole_block} ELSE {both} END AS `{name}`"

    return out.selectExpr(*[f"`{c}`" for c in kept], *[joined(name, *w) for name, w in wanted.items()])
