"""Independent SQL (DuckDB) for the registered queries."""

from __future__ import annotations

from tarnlight.plans.queries import CUTOFFS, FOLDS, REPORTED, SCALE, SHORTLIST, SIGNAL_QUERIES
from tarnlight.sources.panel import COUNTRY_BY_CORRIDOR, HOLIDAYS

S = "PARTITION BY currency ORDER BY effective_date"

PANEL = """
raw_rates AS (SELECT r_name AS currency, r_regionkey, CAST(o_orderdate AS DATE) AS effective_date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
panel AS (SELECT *, cents / 100.0::DOUBLE AS p, 1.0::DOUBLE / (cents / 100.0::DOUBLE) AS r FROM raw_rates)"""

CONTEXT = """
context AS (SELECT CASE l_returnflag WHEN 'A' THEN 'USD' WHEN 'N' THEN 'EUR' WHEN 'R' THEN 'CNY' END AS currency, CAST(l_shipdate AS DATE) AS effective_date,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cents, cents / 100.0::DOUBLE AS p FROM lineitem GROUP BY ALL)"""

EXTERNAL = """
external AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS event_date, CAST(o_orderdate AS DATE) + 2 AS available_at,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*) AS BIGINT) / 100.0::DOUBLE AS value FROM orders GROUP BY ALL)"""

SERIES_NAME = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"


def q(select: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(ctes)} {select}"


def frame(n: int) -> str:
    return f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


def after(n: int) -> str:
    return f"ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING"


def full(agg: str, x: str, rows: str, n: int, by: str = S) -> str:
    return f"CASE WHEN count({x}) OVER ({by} {rows}) = {n} THEN {agg} OVER ({by} {rows}) END"


def change(x: str, n: int = 1, by: str = S) -> str:
    return f"({x} / nullif(lag({x}, {n}) OVER ({by}), 0) - 1)"


def share(x: str, cells: str, n: int) -> str:
    return f"CASE WHEN len({cells}) = {n} THEN len(list_filter({cells}, lambda _e: _e <= {x})) / {n}.0::DOUBLE END"


# --- labels ------------------------------------------------------------------------


def targets(h: int) -> str:
    return f"""labels AS (SELECT *, p = {full('min(p)', 'p', f'ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING', 2 * h + 1)} AS local_min,
  {full('min(p)', 'p', after(h), h)} >= p AS stay, {full('avg(p)', 'p', after(h), h)} AS fwd, lead(p, {h}) OVER ({S}) > p AS closing,
  {full('avg(p)', 'p', f'ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING', 2 * h + 1)} AS smean, {full('min(p)', 'p', after(h), h)} AS best FROM %s),
outcomes AS (SELECT *, (smean / p - 1) * 10000 AS adv, CASE WHEN best IS NOT NULL THEN greatest((p / best - 1) * 10000, 0) END AS reg, (fwd / p - 1) * 10000 AS bps FROM labels)"""


HOLIDAY = "years AS (SELECT unnest(range(1994, 2004)) AS y), holidays AS (" + " UNION ALL ".join(f"SELECT '{c}' AS country, make_date(CAST(y AS INTEGER), {m}, {d}) AS holiday FROM years" for c, days in HOLIDAYS.items() for m, d in days) + ")"
COUNTRY = "CASE currency " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COUNTRY_BY_CORRIDOR.items()) + " END"
GAPS = f"{HOLIDAY}, homes AS (SELECT *, {COUNTRY} AS country FROM panel), gaps AS (SELECT a.currency, a.effective_date, CAST(datediff('day', a.effective_date, h.holiday) AS DOUBLE) AS days_gap FROM homes a ASOF LEFT JOIN holidays h ON a.country = h.country AND a.effective_date <= h.holiday)"

BASE = f"""{GAPS},
base0 AS (SELECT a.*, days_gap, coalesce(a.p < lag(a.p) OVER w, false) AS fall, {full('quantile_cont(p, 0.1)', 'p', frame(90), 90, 'PARTITION BY a.currency ORDER BY a.effective_date')} AS q,
  {full('min(p)', 'p', 'ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING', 20, 'PARTITION BY a.currency ORDER BY a.effective_date')} AS low, lag(a.p) OVER w AS pp,
  a.r / lag(a.r, 3) OVER w - 1 AS e_mom, a.r / lag(a.r) OVER w - 1 AS e_rev
  FROM panel a JOIN gaps g ON a.currency = g.currency AND a.effective_date = g.effective_date WINDOW w AS (PARTITION BY a.currency ORDER BY a.effective_date)),
base AS (SELECT *, coalesce(sum(CAST(fall AS INTEGER)) OVER ({S} {frame(3)}) = 3, false) AS signal_momentum, e_mom AS signal_momentum_effect, p <= q AS signal_level, q / p - 1 AS signal_level_effect,
  CASE WHEN low IS NOT NULL THEN pp = low AND p > pp END AS signal_reversal, e_rev AS signal_reversal_effect, coalesce(days_gap <= 7, false) AS signal_seasonality, CAST(NULL AS DOUBLE) AS signal_seasonality_effect FROM base0)"""

RESEARCH = f"""
yr AS (SELECT a.currency, a.effective_date, CASE WHEN datediff('day', b.effective_date, CAST(a.effective_date - INTERVAL 1 YEAR AS DATE)) <= 7 THEN b.r END AS ref FROM panel a ASOF LEFT JOIN panel b ON a.currency = b.currency AND CAST(a.effective_date - INTERVAL 1 YEAR AS DATE) >= b.effective_date),
r1 AS (SELECT base.*, ref, datediff('day', DATE '1970-01-01', effective_date) AS dn, r / lag(r) OVER w - 1 AS mv, r - lag(r) OVER w AS st, r / ref - 1 AS yg, 1 - r / ref AS yl,
  {full('min(r)', 'r', frame(3), 3)} / {full('max(r)', 'r', 'ROWS BETWEEN 9 PRECEDING AND 3 PRECEDING', 7)} - 1 AS rg, r / lag(r, 5) OVER w - 1 AS g5, 1 - r / lag(r, 5) OVER w AS l5
  FROM base JOIN yr USING (currency, effective_date) WINDOW w AS ({S})),
r2 AS (SELECT *, {full('quantile_cont(abs(mv), 0.5)', 'mv', 'ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING', 10)} AS us, avg(r) OVER t AS m30, count(r) OVER t AS n30, min(dn) OVER t AS o30,
  {full('sum(CAST(st > 0 AS INTEGER))', 'st', frame(5), 5)} AS ups, {full('sum(CAST(st < 0 AS INTEGER))', 'st', frame(5), 5)} AS dns FROM r1 WINDOW t AS (PARTITION BY currency ORDER BY dn RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)),
r3 AS (SELECT *, CASE WHEN n30 >= 15 AND dn - o30 >= 25 THEN r / m30 - 1 END AS a30, rg > 0 AS c_rg, CASE WHEN mv IS NOT NULL AND us IS NOT NULL THEN mv > 0 AND mv >= 2 * greatest(us, 1e-12) END AS c_us,
  CASE WHEN ups IS NOT NULL AND g5 IS NOT NULL THEN ups >= 4 AND g5 > 0 END AS c_up, CASE WHEN dns IS NOT NULL AND l5 IS NOT NULL THEN dns >= 4 AND l5 > 0 END AS c_dn FROM r2),
signals AS (SELECT *, CASE WHEN yg IS NOT NULL AND lag(yg) OVER w IS NOT NULL THEN yg > 0 AND lag(yg) OVER w <= 0 END AS signal_better_than_one_year_ago, yg AS signal_better_than_one_year_ago_effect,
  CASE WHEN yl IS NOT NULL AND lag(yl) OVER w IS NOT NULL THEN yl > 0 AND lag(yl) OVER w <= 0 END AS signal_less_than_one_year_ago, yg AS signal_less_than_one_year_ago_effect,
  CASE WHEN a30 IS NOT NULL AND lag(a30) OVER w IS NOT NULL THEN a30 > 0 AND lag(a30) OVER w <= 0 END AS signal_better_than_30_day_average, a30 AS signal_better_than_30_day_average_effect,
  CASE WHEN c_rg IS NOT NULL THEN c_rg AND NOT coalesce(lag(c_rg) OVER w, false) END AS signal_better_range_held, rg AS signal_better_range_held_effect,
  CASE WHEN c_us IS NOT NULL THEN c_us AND NOT coalesce(lag(c_us) OVER w, false) END AS signal_larger_than_usual_latest_improvement, mv AS signal_larger_than_usual_latest_improvement_effect,
  CASE WHEN c_up IS NOT NULL THEN c_up AND NOT coalesce(lag(c_up) OVER w, false) END AS signal_most_recent_changes_favourable, g5 AS signal_most_recent_changes_favourable_effect,
  CASE WHEN c_dn IS NOT NULL THEN c_dn AND NOT coalesce(lag(c_dn) OVER w, false) END AS signal_most_recent_changes_unfavourable, g5 AS signal_most_recent_changes_unfavourable_effect
  FROM r3 WINDOW w AS ({S}))"""

NAMES = ("signal_momentum", "signal_level", "signal_reversal", "signal_seasonality", "signal_better_than_one_year_ago", "signal_better_range_held", "signal_larger_than_usual_latest_improvement", "signal_better_than_30_day_average", "signal_most_recent_changes_favourable", "signal_less_than_one_year_ago", "signal_most_recent_changes_unfavourable")

# --- features ------------------------------------------------------------------------

FEATURES = f"""
f0 AS (SELECT *, coalesce(p < lag(p) OVER w, false) AS fall, {change('p')} AS ret_1, list(p) OVER (w {frame(90)}) AS l90, list(p) OVER (w {frame(20)}) AS l20, row_number() OVER w AS i FROM panel WINDOW w AS ({S})),
f1 AS (SELECT *, sum(CAST(NOT fall AS INTEGER)) OVER ({S} ROWS UNBOUNDED PRECEDING) AS isle FROM f0),
f2 AS (SELECT *, CAST(sum(CAST(fall AS INTEGER)) OVER (PARTITION BY currency, isle ORDER BY effective_date ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS down_streak, {share('p', 'l90', 90)} AS price_percentile,
  CASE WHEN len(l20) = 20 THEN CAST(20 - list_position(l20, list_min(l20)) AS DOUBLE) END AS days_since_min, CASE WHEN len(l20) = 20 THEN p / list_min(l20) - 1 END AS rebound_pct,
  {full('stddev_samp(ret_1)', 'ret_1', frame(20), 20)} AS vol_20, {full('regr_slope(p, i)', 'p', frame(20), 20)} AS slope_20, {', '.join(f"{change('p', n)} AS ret_{n}" for n in (3, 5, 10, 20))} FROM f1)"""

CTX = f"""
grid AS (SELECT effective_date, ctx FROM (SELECT DISTINCT effective_date FROM panel), (SELECT unnest(['USD', 'EUR', 'CNY']) AS ctx)),
c0 AS (SELECT g.effective_date, g.ctx AS currency, c.p AS v0 FROM grid g LEFT JOIN context c ON c.effective_date = g.effective_date AND c.currency = g.ctx),
c1 AS (SELECT *, last_value(v0 IGNORE NULLS) OVER ({S} ROWS UNBOUNDED PRECEDING) AS v FROM c0),
c2 AS (SELECT *, {change('v')} AS ret_1, {change('v', 5)} AS ret_5, list(v) FILTER (WHERE v IS NOT NULL) OVER ({S} {frame(90)}) AS l90 FROM c1),
c3 AS (SELECT *, {share('v', 'l90', 90)} AS percentile, {full('stddev_samp(ret_1)', 'ret_1', frame(20), 20)} AS vol_20 FROM c2),
wide AS (SELECT effective_date, {', '.join(f"max(CASE WHEN currency = '{c}' THEN {s} END) AS {c.lower()}_{s}" for c in ('USD', 'EUR', 'CNY') for s in ('ret_1', 'ret_5', 'percentile', 'vol_20'))} FROM c3 GROUP BY effective_date)"""

SE = "PARTITION BY series ORDER BY effective_date"
EXT = f"""
named AS (SELECT *, {SERIES_NAME.format('series_id')} AS series FROM external),
probes AS (SELECT effective_date, series FROM (SELECT DISTINCT effective_date FROM panel), (SELECT DISTINCT series FROM named)),
e0 AS (SELECT a.effective_date, a.series, b.value, CAST(datediff('day', b.available_at, a.effective_date) AS DOUBLE) AS staleness_days FROM probes a ASOF LEFT JOIN named b ON a.series = b.series AND a.effective_date >= b.available_at),
e1 AS (SELECT *, {change('value', 1, SE)} AS ret_1, {change('value', 5, SE)} AS ret_5, list(value) FILTER (WHERE value IS NOT NULL) OVER ({SE} {frame(90)}) AS l90 FROM e0)"""

WEEK = "CAST(date_trunc('week', effective_date) AS DATE)"
WEEKS = f"(datediff('day', min({WEEK}), max({WEEK})) / 7 + 1)"
LIFT = "avg(CASE WHEN {s} THEN CAST({t} AS INTEGER) END) / nullif(avg(CAST({t} AS INTEGER)), 0)"


def lift_rows(source: str, target: str, names: tuple[str, ...], extra: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT currency, '{n}' AS indicator, count(*) AS eligible_days, count(*) FILTER (WHERE {n}) AS signal_count, count(*) FILTER (WHERE {target}) AS target_positives,
  round(avg(CASE WHEN {n} THEN CAST({target} AS INTEGER) END), 8) AS signal_hit_rate, round(avg(CAST({target} AS INTEGER)), 8) AS random_hit_rate, round({LIFT.format(s=n, t=target)}, 8) AS lift,
  round(count(*) FILTER (WHERE {n}) / {WEEKS}, 8) AS signals_per_week{extra} FROM {source} WHERE {target} IS NOT NULL GROUP BY currency"""
        for n in names
    )


def weekly(source: str, signal: str) -> str:
    return f"""wk AS (SELECT currency, {WEEK} AS week, count(*) FILTER (WHERE {signal}) AS n FROM {source} GROUP BY ALL),
span AS (SELECT currency, unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS week FROM wk GROUP BY currency),
counts AS (SELECT s.currency, CAST(s.week AS DATE) AS week, coalesce(n, 0) AS pushes FROM span s LEFT JOIN wk ON wk.currency = s.currency AND wk.week = s.week)"""


def worst(source: str, loss: str, by: str, name: str, where: str = "true") -> str:
    return f"""(SELECT {by}, avg(x) AS {name} FROM (SELECT {by}, {loss} AS x, row_number() OVER (PARTITION BY {by} ORDER BY {loss} DESC) AS k, count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE {loss} IS NOT NULL AND {where}) WHERE k <= greatest(1, ceil(n * (1 - 0.95) - 1e-12)) GROUP BY {by})"""


def path(h: int, gap: float | None, source: str, tag: str = "") -> str:
    """CTEs down to ``paths<tag>``: path outcomes of a source's series."""
    w = "1.0" if gap is None else f"exp(-datediff('day', dl[1], dl[j]) / {gap}::DOUBLE)"
    return f"""pa{tag} AS (SELECT *, list(p) OVER ({S} {after(h)}) AS pl, list(effective_date) OVER ({S} {after(h)}) AS dl FROM {source}),
pj{tag} AS (SELECT *, unnest(range(1, {h} + 1)) AS j FROM pa{tag} WHERE len(pl) = {h}),
pv{tag} AS (SELECT currency, effective_date, sum((pl[j] / p - 1) * 10000 * {w}) / sum({w}) AS path_value, max(greatest((p / pl[j] - 1) * 10000, 0) * {w}) AS path_regret FROM pj{tag} GROUP BY ALL),
paths{tag} AS (SELECT a.*, path_value, path_regret FROM {source} a LEFT JOIN pv{tag} USING (currency, effective_date))"""


FOLD = "CASE " + " ".join(f"WHEN effective_date >= DATE '{f.test_start}' AND effective_date < DATE '{f.test_end}' THEN '{f.name}'" for f in FOLDS) + " END"


def sliced(names: tuple[str, ...], horizons: tuple[int, ...], source: str, folds=FOLDS, control: bool = False) -> str:
    """CTEs down to ``own``: eligible rows of each method, fold, corridor and horizon as a series of its own, whose key stands in ``currency``.

    The columns are those of a corridor's labelled rows, with what is sent as ``signal_momentum``.
    """
    fold = "CASE " + " ".join(f"WHEN effective_date >= DATE '{f.test_start}' AND effective_date < DATE '{f.test_end}' THEN '{f.name}'" for f in folds) + " END"
    parts, made = [], []
    random = """row_number() OVER (PARTITION BY fold, currency ORDER BY md5(concat_ws(':', 'random', 1, fold, currency, effective_date))) <=
      least(round_even(1.5 * greatest(datediff('day', min(effective_date) OVER c, max(effective_date) OVER c) / 7.0::DOUBLE, 1), 0), count(*) OVER c)"""
    for h in horizons:
        parts.append(targets(h).replace("labels", f"labels{h}").replace("outcomes", f"outcomes{h}") % source)
        parts.append(f"tested{h} AS (SELECT *, {random} AS random_signal FROM (SELECT *, {fold} AS fold FROM outcomes{h}) WHERE fold IS NOT NULL WINDOW c AS (PARTITION BY fold, currency))")
        rows = " UNION ALL ".join(f"SELECT '{m}' AS method, {m} AS sent, * FROM tested{h} WHERE stay IS NOT NULL" for m in (*names, *(["random_signal"] if control else [])))
        parts.append(f"sl{h} AS (SELECT concat_ws(':', method, CASE WHEN fold = 'oot' THEN 'oot' ELSE 'wf_oos' END, fold, currency, {h}) AS currency, effective_date, p, stay, adv, reg, bps, coalesce(sent, false) AS signal_momentum FROM ({rows}))")
        parts.append(path(h, None, f"sl{h}", str(h)))
        made.append(f"SELECT * FROM paths{h}")
    return ", ".join(parts) + f", own AS ({' UNION ALL '.join(made)})"


#: The parts of a slice's key, as columns.
PARTS = "split_part(currency, ':', 1) AS method, split_part(currency, ':', 2) AS split, split_part(currency, ':', 3) AS fold, split_part(currency, ':', 4) AS currency, CAST(split_part(currency, ':', 5) AS INTEGER) AS horizon"


def slices() -> str:
    """CTEs down to ``slices``: the report's metrics of the two rules."""
    gaps = f"SELECT currency, datediff('day', lag(effective_date) OVER ({S}), effective_date) AS g FROM own WHERE signal_momentum"
    return f"""{sliced(REPORTED, (1, 5, 10), 'base')}, {lar_draws(50, 'own')},
slices AS (SELECT {PARTS}, * EXCLUDE (currency) FROM (SELECT currency, {LIFT.format(s='signal_momentum', t='stay')} AS lift, avg(CASE WHEN signal_momentum THEN adv END) AS moment_advantage_bps, avg(CASE WHEN signal_momentum THEN reg END) AS customer_regret_bps_mean,
  count(*) FILTER (WHERE signal_momentum) AS signal_count, count(*) FILTER (WHERE signal_momentum) / {WEEKS} AS signals_per_week FROM own GROUP BY currency)
  LEFT JOIN (SELECT currency, count(*) FILTER (WHERE g <= 3) / count(*) AS cluster_rate FROM ({gaps}) GROUP BY currency) USING (currency) LEFT JOIN (SELECT currency, {LAR} AS lift_at_risk FROM lar) USING (currency))"""


def rule_list() -> tuple[str, list[tuple[str, str]]]:
    """The windows of the rule catalog as CTEs, and (rule, condition)."""
    pct = (20, 60, 90, 120, 250)
    w4 = (10, 20, 60, 120)
    cols = [f"list(p) OVER ({S} {frame(w)}) AS l{w}" for w in pct]
    for w in w4:
        cols += [f"{full('min(p)', 'p', frame(w), w)} AS lo{w}", f"{full('max(p)', 'p', frame(w), w)} AS hi{w}", f"{full('avg(p)', 'p', frame(w), w)} AS av{w}", f"{full('stddev_samp(p)', 'p', frame(w), w)} AS sd{w}"]
    cols += [f"{full('regr_slope(p, i)', 'p', frame(w), w)} AS sl{w}" for w in (5, 10, 20, 60)]
    cols += [f"{full('stddev_samp(r1)', 'r1', frame(w), w)} AS vo{w}" for w in (5, 10, 20, 60)]
    cols += [f"{full(f'avg({e})', 'd', frame(w), w)} AS {n}{w}" for w in (5, 10, 14, 20) for n, e in (("ga", "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END"), ("lo_", "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END"))]
    cols += [f"{full(f'quantile_cont(r{h}, {x})', f'r{h}', frame(w), w)} AS q{h}_{w}_{round(x * 100)}" for h in (1, 3, 5, 10, 20) for w in (60, 120) for x in (0.1, 0.2)]
    ctes = f"""g0 AS (SELECT *, p - lag(p) OVER w AS d, row_number() OVER w AS i, {', '.join(f"{change('p', h)} AS r{h}" for h in (1, 3, 5, 10, 20))} FROM panel WINDOW w AS ({S})),
g1 AS (SELECT *, sum(CASE WHEN r1 < 0 THEN 0 ELSE 1 END) OVER ({S} ROWS UNBOUNDED PRECEDING) AS isle FROM g0),
g2 AS (SELECT *, {', '.join(cols)}, sum(CASE WHEN r1 < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY currency, isle ORDER BY effective_date ROWS UNBOUNDED PRECEDING) AS streak FROM g1),
em AS (SELECT currency, i, p, {', '.join(f'p AS m{w}' for w in w4)} FROM g0 WHERE i = 1 UNION ALL SELECT g.currency, g.i, g.p, {', '.join(f'{2 / (w + 1)!r} * g.p + {1 - 2 / (w + 1)!r} * e.m{w}' for w in w4)} FROM em e JOIN g0 g ON g.currency = e.currency AND g.i = e.i + 1),
g3 AS (SELECT g2.*, {', '.join(f'{share("g2.p", f"l{w}", w)} AS pc{w}' for w in pct)}, {', '.join(f'CASE WHEN g2.i >= {w} THEN m{w} END AS em{w}' for w in w4)} FROM g2 JOIN em ON em.currency = g2.currency AND em.i = g2.i)"""
    tag = lambda x: str(abs(x)).replace(".", "p")
    out = [(f"level__pct_w{w}_p{round(x * 100):02d}", f"pc{w} <= {x}") for w in pct for x in (0.05, 0.1, 0.2)]
    out += [(f"level__near_min_w{w}_bp{b}", f"(p / lo{w} - 1) * 10000 <= {b}") for w in (20, 60, 120) for b in (0, 10, 25, 50)]
    out += [(f"level__z_{k}_w{w}_m{tag(x)}", f"(p - {c}{w}) / nullif(sd{w}, 0) <= {x}") for k, c in (("sma", "av"), ("ema", "em")) for w in w4 for x in (-0.5, -1.0, -1.5)]
    out += [(f"level__boll_w{w}_k{tag(x)}", f"p <= av{w} - {x} * sd{w}") for w in (10, 20, 60) for x in (1.0, 1.5, 2.0)]
    out += [(f"momentum__down_streak_{n}", f"streak >= {n}") for n in (2, 3, 4, 5)]
    out += [(f"momentum__ret_h{h}_w{w}_p{x}", f"r{h} <= q{h}_{w}_{x}") for h in (1, 3, 5, 10, 20) for w in (60, 120) for x in (10, 20)]
    out += [(f"momentum__slope_w{w}_m{tag(x)}", f"sl{w} / nullif(vo{w} * p, 0) <= {x}") for w in (5, 10, 20, 60) for x in (-0.5, -1.0)]
    out += [(f"oversold__rsi_w{w}_p{x}", f"CASE WHEN ga{w} = 0 THEN 0 WHEN lo_{w} = 0 THEN 100 ELSE 100 - 100 / (1 + ga{w} / nullif(lo_{w}, 0)) END <= {x}") for w in (5, 10, 14, 20) for x in (20, 30, 40)]
    out += [(f"oversold__stoch_w{w}_p{round(x * 100)}", f"(p - lo{w}) / nullif(hi{w} - lo{w}, 0) <= {x}") for w in (10, 20, 60) for x in (0.1, 0.2)]
    out += [(f"confirmation__stabilize_h{h}", f"pc60 <= 0.2 AND r{h} < 0 AND r1 >= 0") for h in (3, 5, 10)]
    out += [(f"regime__cheap_{n}", f"pc60 <= 0.2 AND {c}") for n, c in (("calm", "vo5 / nullif(vo20, 0) <= 0.8"), ("normal", "vo5 / nullif(vo20, 0) > 0.8 AND vo5 / nullif(vo20, 0) < 1.2"), ("volatile", "vo5 / nullif(vo20, 0) >= 1.2"))]
    return ctes, out


RULE_CTES, RULES = rule_list()


def screening() -> str:
    """CTEs down to ``screened`` for all price rules."""
    t = targets(5).replace("labels", "labs") % "panel"
    flags = ", ".join(f"coalesce({c}, false) AS \"{n}\"" for n, c in RULES)
    names = ", ".join(f'"{n}"' for n, _ in RULES)
    return f"""{RULE_CTES}, {t},
flagged AS (SELECT o.currency, o.effective_date, o.stay, o.bps, {flags} FROM g3 JOIN (SELECT currency, effective_date, stay, bps FROM outcomes) o USING (currency, effective_date) WHERE o.stay IS NOT NULL AND o.bps IS NOT NULL),
long AS (UNPIVOT flagged ON {names} INTO NAME rule_id VALUE sent),
seen AS (SELECT *, sent AND coalesce(lag(sent) OVER (PARTITION BY rule_id, currency ORDER BY effective_date), false) AS next FROM long),
cells AS (SELECT rule_id, currency, count(*) FILTER (WHERE sent) AS n, {LIFT.format(s='sent', t='stay')} AS lift, avg(CASE WHEN sent THEN bps END) AS bps, count(*) FILTER (WHERE sent) / {WEEKS} AS weekly, count(*) FILTER (WHERE next) / nullif(count(*) FILTER (WHERE sent), 0) AS cl FROM seen GROUP BY ALL),
sums AS (SELECT rule_id, CAST(sum(n) AS BIGINT) AS signal_count, count(*) FILTER (WHERE n > 0) AS corridors_with_signals, avg(lift) FILTER (WHERE n > 0) AS mean_lift, quantile_cont(lift, 0.5) FILTER (WHERE n > 0) AS median_lift, avg(bps) FILTER (WHERE n > 0) AS mean_bps, avg(weekly) AS mean_signals_per_week,
  coalesce(avg(CAST(coalesce(lift > 1, false) AS INTEGER)) FILTER (WHERE n > 0), 0) AS positive_share, avg(cl) FILTER (WHERE n > 0) AS mean_cluster_share FROM cells GROUP BY rule_id),
screened AS (SELECT *, split_part(rule_id, '__', 1) AS family, coalesce(signal_count >= 50 AND corridors_with_signals >= 4 AND median_lift > 1 AND mean_bps > 0 AND positive_share >= 0.6, false) AS passed FROM sums)"""


SCREEN = screening()
#: A value to nine significant digits.
NINE = "CASE WHEN {0} IS NOT NULL THEN CAST(printf('%.8e', {0}) AS DOUBLE) END"


def sends(extra: str) -> str:
    """A one-fall momentum series for the policy queries."""
    return f"cand AS (SELECT currency, effective_date, coalesce(p < lag(p) OVER ({S}), false) AS c, row_number() OVER ({S}) AS i, {WEEK} AS wk FROM panel){extra}"


CALENDAR = """rec AS (SELECT DISTINCT currency, 0::BIGINT AS i, CAST(NULL AS DATE) AS last, CAST(NULL AS DATE) AS lw, 0 AS n, false AS sent FROM cand UNION ALL
      SELECT currency, i, CASE WHEN ok THEN d ELSE last END, CASE WHEN ok THEN wk ELSE lw END, CASE WHEN ok THEN u + 1 ELSE n END, ok FROM (SELECT *, c AND (last IS NULL OR datediff('day', last, d) > 3) AND u < 2 AS ok FROM (SELECT b.currency, b.i, b.effective_date AS d, b.c, b.wk, r.last, r.lw, r.n, CASE WHEN r.lw = b.wk THEN r.n ELSE 0 END AS u FROM rec r JOIN cand b ON b.currency = r.currency AND b.i = r.i + 1)))"""


CLARITY = {"signal_seasonality": 1.0, "signal_better_than_30_day_average": 1.0, "signal_better_than_one_year_ago": 0.95, "signal_less_than_one_year_ago": 0.95, "signal_better_range_held": 0.8, "signal_level": 0.75, "signal_larger_than_usual_latest_improvement": 0.7, "signal_reversal": 0.7, "signal_momentum": 0.65, "signal_most_recent_changes_favourable": 0.65, "signal_most_recent_changes_unfavourable": 0.65}
DECIDED = f"""
sc AS (SELECT *, 1 - {share('p', 'l20', 20)} AS score FROM (SELECT *, list(p) OVER ({S} {frame(20)}) AS l20 FROM signals)),
act AS ({' UNION ALL '.join(f"SELECT currency, effective_date, {i} AS ord, '{n}' AS sig, {n}_effect AS eff, {CLARITY[n]}::DOUBLE AS cla, abs({n}_effect) * {CLARITY[n]}::DOUBLE AS val FROM sc WHERE {n}" for i, n in enumerate(NAMES))}),
agg AS (SELECT currency, effective_date, count(*) AS k, string_agg(sig, ',' ORDER BY ord) AS active, count(*) FILTER (WHERE eff IS NOT NULL OR sig = 'signal_seasonality') AS ns, bool_or(sig = 'signal_seasonality') AS seas, count(*) FILTER (WHERE val IS NULL) AS bad,
  first(sig ORDER BY val DESC NULLS LAST, cla DESC, abs(eff) DESC NULLS LAST, ord) AS bs, first(eff ORDER BY val DESC NULLS LAST, cla DESC, abs(eff) DESC NULLS LAST, ord) AS be, first(val ORDER BY val DESC NULLS LAST, cla DESC, abs(eff) DESC NULLS LAST, ord) AS bv FROM act GROUP BY ALL),
why AS (SELECT sc.currency, sc.effective_date, CASE WHEN score IS NULL THEN 'invalid_market_score' WHEN score < 0.5 THEN 'below_market_threshold' WHEN k IS NULL THEN 'no_active_signal' WHEN k = 1 THEN 'selected_single_signal' WHEN seas THEN 'selected_seasonality_priority' WHEN bad > 0 THEN 'invalid_signal_effect' ELSE 'selected_by_effect' END AS meta_reason, agg.* EXCLUDE (currency, effective_date), score FROM sc LEFT JOIN agg USING (currency, effective_date)),
decided AS (SELECT *, starts_with(meta_reason, 'selected') AS meta_should_send, CASE meta_reason WHEN 'selected_single_signal' THEN bs WHEN 'selected_seasonality_priority' THEN 'signal_seasonality' WHEN 'selected_by_effect' THEN bs END AS meta_selected_signal,
  CASE WHEN meta_reason IN ('selected_single_signal', 'selected_by_effect') THEN be END AS meta_selected_effect, CASE WHEN meta_reason IN ('selected_single_signal', 'selected_by_effect') THEN bv END AS meta_selection_score FROM why)"""

THRESHOLDS = f"""
sc AS (SELECT *, 1 - {share('p', 'l20', 20)} AS score, {' OR '.join(f'coalesce({n}, false)' for n in NAMES)} AS has_fact FROM (SELECT *, list(p) OVER ({S} {frame(20)}) AS l20 FROM signals)),
{targets(5) % 'sc'},
facts AS (SELECT score FROM outcomes WHERE stay IS NOT NULL AND score IS NOT NULL AND has_fact),
ths AS (SELECT unnest([0.2, 0.5, 0.75, 0.9]::DOUBLE[]) AS th UNION SELECT quantile_cont(score, 0.9) FROM facts UNION SELECT quantile_cont(score, 0.85) FROM facts UNION SELECT quantile_cont(score, 0.8) FROM facts),
tried AS (SELECT *, score >= th AND has_fact AS sent FROM outcomes, ths WHERE stay IS NOT NULL AND score IS NOT NULL),
thr AS (SELECT th AS threshold, count(*) FILTER (WHERE sent) / {WEEKS} AS weekly, coalesce({LIFT.format(s='sent', t='stay')}, 0) AS metric, avg(CASE WHEN sent THEN bps END) AS mean_bps FROM tried GROUP BY th HAVING count(*) FILTER (WHERE sent) > 0)"""

#: Each (threshold, corridor) of the grid as a series whose key stands in ``currency``; paths run over the corridor.
MACRO = f"""
judged AS (SELECT * FROM outcomes WHERE stay IS NOT NULL AND score IS NOT NULL), {path(5, None, 'judged')},
tried_paths AS (SELECT concat_ws(':', th, currency) AS currency, effective_date, stay, path_value, path_regret, score >= th AND has_fact AS signal_momentum FROM paths, (SELECT unnest([0.2, 0.5, 0.75, 0.9]::DOUBLE[]) AS th))"""

RULE_STREAM = f"""
cand AS (SELECT currency, effective_date, p, score, meta_reason, meta_selected_signal, meta_selected_effect, meta_selection_score, coalesce(score >= 0.5 AND k IS NOT NULL AND meta_should_send, false) AS c, row_number() OVER ({S}) AS i, {WEEK} AS wk FROM decided JOIN (SELECT currency, effective_date, p FROM panel) USING (currency, effective_date))"""


def snapshots() -> str:
    """The latest row of each corridor on each cutoff day, if it is fresh and sent."""
    days = ", ".join(f"DATE '{d}'" for d in CUTOFFS)
    text = "CASE WHEN meta_selected_effect IS NULL THEN '—' ELSE printf('%.2f', abs(meta_selected_effect) * 100) END"
    return f"""SELECT CAST(day AS VARCHAR) AS as_of, CAST(effective_date AS VARCHAR) AS effective_date, 'RUB->' || currency AS corridor, meta_selected_signal AS indicator, 'down' AS direction, round(abs(meta_selected_effect), 8) AS strength, 'slow' AS speed, 'now_cheap' AS recommended_scenario,
  currency || ': a good day' AS push_title, currency || ' moved by ' || {text} || '%: ' || replace(replace(meta_selected_signal, 'signal_', ''), '_', ' ') AS push_body, round(score, 8) AS market_score, 0.5::DOUBLE AS market_threshold, round(meta_selected_effect, 8) AS selected_effect, round(meta_selection_score, 8) AS selection_score, meta_reason AS decision_reason
  FROM (SELECT *, row_number() OVER (PARTITION BY day, currency ORDER BY effective_date DESC) AS latest FROM (SELECT day, cand.*, rec.sent FROM rec JOIN cand USING (currency, i), (SELECT unnest([{days}]) AS day) WHERE effective_date <= day)) WHERE latest = 1 AND sent AND datediff('day', effective_date, day) <= 3"""


#: Given draws: of each series as many judged rows as were sent, by the MD5 of draw and key.
GIVEN = """gelig AS (SELECT *, count(*) FILTER (WHERE signal_momentum) OVER (PARTITION BY currency) AS k FROM paths WHERE stay IS NOT NULL AND path_value IS NOT NULL),
gpick AS (SELECT * FROM (SELECT gelig.*, draw, row_number() OVER (PARTITION BY currency, draw ORDER BY md5(concat_ws(':', 'given', draw, currency, effective_date))) AS place FROM gelig, (SELECT unnest(range(1, 21)) AS draw)) WHERE place <= k)"""


def lar_draws(draws: int, source: str = "paths", picked: str = "dr WHERE place <= k") -> str:
    """CTEs down to ``lar``: what was sent in each series of ``source``, and random draws of as many a week, or those ``picked``."""
    return f"""
elig AS (SELECT *, {WEEK} AS wk FROM {source} WHERE stay IS NOT NULL AND path_value IS NOT NULL AND path_regret IS NOT NULL),
nw AS (SELECT *, count(*) FILTER (WHERE signal_momentum) OVER (PARTITION BY currency, wk) AS k FROM elig),
dr AS (SELECT nw.*, draw, row_number() OVER (PARTITION BY currency, draw, wk ORDER BY md5(concat_ws(':', 'lar', draw, currency, effective_date))) AS place FROM nw, (SELECT unnest(range(1, {draws + 1})) AS draw) WHERE k > 0),
pick AS (SELECT * FROM {picked}),
each AS (SELECT a.currency, a.draw, h, v, w FROM (SELECT currency, draw, avg(CAST(stay AS INTEGER)) AS h, avg(path_value) AS v FROM pick GROUP BY ALL) a JOIN {worst('pick', 'path_regret', 'currency, draw', 'w')} b USING (currency, draw)),
rnd AS (SELECT currency, avg(h) AS random_hit_rate, avg(v) AS random_value_bps, avg(w) AS random_tail_regret_bps FROM each GROUP BY currency),
lsent AS (SELECT currency, avg(CAST(stay AS INTEGER)) AS signal_hit_rate, avg(path_value) AS signal_value_bps FROM elig WHERE signal_momentum GROUP BY currency),
cnt AS (SELECT currency, count(*) FILTER (WHERE stay IS NOT NULL AND path_value IS NOT NULL) AS eligible_count, count(*) FILTER (WHERE stay IS NOT NULL AND path_value IS NOT NULL AND signal_momentum) AS signal_count, count(*) FILTER (WHERE (stay IS NULL OR path_value IS NULL) AND signal_momentum) AS excluded_signal_count FROM {source} GROUP BY currency),
lar AS (SELECT *, signal_hit_rate / nullif(random_hit_rate, 0) AS lift, (signal_value_bps - random_value_bps) - 2 * (signal_tail_regret_bps - random_tail_regret_bps) AS delta_utility_bps FROM cnt LEFT JOIN lsent USING (currency) LEFT JOIN {worst('elig', 'path_regret', 'currency', 'signal_tail_regret_bps', 'signal_momentum')} USING (currency) LEFT JOIN rnd USING (currency))"""


#: Lift-at-risk of a row of ``lar``, at the reports' scale.
LAR = f"lift * exp(delta_utility_bps / {SCALE!r})"


_HELD = {n: f"coalesce({c}, false)" for n, c in RULES if n in SHORTLIST}


def ensemble_rows() -> str:
    """Counts of each AND, OR and vote of the shortlist; ORs of strongly correlated pairs are left out."""
    level, other = [[n for n in SHORTLIST if n.startswith("level") is kind] for kind in (True, False)]
    made = [(f"and__{x}__{y}", f'"{x}" AND "{y}"', "true") for x in level for y in other]
    made += [(f"or__{x}__{y}", f'"{x}" OR "{y}"', f'(SELECT coalesce(abs(corr(CAST("{x}" AS INTEGER), CAST("{y}" AS INTEGER))) < 0.7, true) FROM held)') for i, x in enumerate(SHORTLIST) for y in SHORTLIST[i + 1 :]]
    made += [(f"vote2__top{k}", " + ".join(f'CAST("{x}" AS INTEGER)' for x in SHORTLIST[:k]) + " >= 2", "true") for k in (3, 5)]
    return " UNION ALL ".join(f"SELECT currency, '{n}' AS candidate, count(*) FILTER (WHERE {x}) AS n FROM held WHERE {keep} GROUP BY currency" for n, x, keep in made)


CTX_NAMES = ("1_urgent", "2_high", "3_medium", "4_not_specified", "5_low")
RELATIVE = {**{f"{c}_ret_1": f"ret_1 - {c}_ret_1" for c in ("usd", "eur", "cny")}, "residual_usd_1": "ret_1 - usd_ret_1"}
CONTEXT_RULES = f"""
known AS (SELECT effective_date, {', '.join(f"max(CASE WHEN series = '{n}' THEN value END) AS ctx_{n}" for n in CTX_NAMES)} FROM e0 GROUP BY effective_date),
k0 AS (SELECT f2.*, list(f2.p) OVER (PARTITION BY f2.currency ORDER BY f2.effective_date {frame(60)}) AS l60, {', '.join(f'{x} AS rel_{c}' for c, x in RELATIVE.items())}, {', '.join(f'ctx_{n}' for n in CTX_NAMES)} FROM f2 LEFT JOIN wide USING (effective_date) LEFT JOIN known USING (effective_date)),
k1 AS (SELECT *, {share('p', 'l60', 60)} AS pc60, {', '.join(f"{change('ctx_' + n)} AS chg_{n}" for n in CTX_NAMES)} FROM k0),
k2 AS (SELECT *, {', '.join(f"{full(f'quantile_cont(rel_{c}, 0.1)', f'rel_{c}', frame(w), w)} AS lim_{c}_{w}" for c in RELATIVE for w in (60, 120))}, {', '.join(f"{full(f'quantile_cont(chg_{n}, {x})', f'chg_{n}', frame(120), 120)} AS lim_{n}_{d}" for n in CTX_NAMES for d, x in (('low', 0.1), ('high', 0.9)))} FROM k1)"""


CONTEXT_LIST = [(f"relative__{c}_w{w}_p10", f"rel_{c} <= lim_{c}_{w}") for c in RELATIVE for w in (60, 120)]
CONTEXT_LIST += [(f"context__cheap_ctx_{n}_{d}", f"pc60 <= 0.2 AND chg_{n} {op} lim_{n}_{d}") for n in CTX_NAMES for d, op in (("low", "<="), ("high", ">="))]


def held_rows(source: str, listed: list[tuple[str, str]]) -> str:
    bits = [f"CAST(coalesce({c}, false) AS INTEGER)" for _, c in listed]
    return f"SELECT currency, effective_date, {' + '.join(bits)} AS n_rules, md5(concat({', '.join(bits)})) AS rules_md5 FROM {source}"


def context_rule_counts() -> str:
    return " UNION ALL ".join(f"SELECT currency, '{n}' AS rule_id, count(*) FILTER (WHERE {x}) AS n FROM k2 GROUP BY currency" for n, x in CONTEXT_LIST)


def method_metrics(draws: int) -> str:
    """All metrics of what is sent in each series of ``own``, each part a query of its own."""
    m = "signal_momentum"
    gaps = f"SELECT currency, datediff('day', lag(effective_date) OVER ({S}), effective_date) AS g FROM own WHERE {m}"
    parts = [
        f"SELECT currency, count(adv) AS value_observations, round(avg(adv), 6) AS moment_advantage_bps, count(reg) AS regret_observations, round(avg(reg), 6) AS customer_regret_bps_mean, round(max(reg), 6) AS customer_regret_bps_max, round(avg(CASE WHEN k <= 5 THEN reg END), 6) AS customer_regret_worst_five_mean_bps, round(any_value(w), 6) AS customer_regret_cvar_95_bps FROM (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY reg DESC NULLS LAST) AS k FROM own WHERE {m}) LEFT JOIN {worst('own', 'reg', 'currency', 'w', m)} USING (currency) GROUP BY currency",
        q("SELECT currency, round(sum(pushes) / count(*), 6) AS useful_signals_per_week, round(sum(pushes) / count(*) * 100, 6) AS useful_signals_per_100_weeks FROM counts GROUP BY currency", weekly("own", f"(stay AND {m})")),
        q("SELECT currency, CAST(sum(pushes) AS BIGINT) AS signal_count, count(*) AS eligible_weeks, round(avg(pushes), 6) AS pushes_per_week, round(quantile_cont(pushes, 0.5), 6) AS pushes_p50_per_week, round(quantile_cont(pushes, 0.9), 6) AS pushes_p90_per_week, round(avg(CAST(pushes = 0 AS INTEGER)), 6) AS zero_push_week_rate, round(avg(CAST(pushes > 2 AS INTEGER)), 6) AS over_budget_week_rate, round(avg(pushes), 6) AS signals_per_week FROM counts GROUP BY currency", weekly("own", m)),
        f"SELECT currency, round(count(*) FILTER (WHERE g <= 3) / count(*), 6) AS cluster_rate FROM ({gaps}) GROUP BY currency",
        f"SELECT currency, round(count(*) FILTER (WHERE s AND b) / nullif(count(*) FILTER (WHERE s), 0), 6) AS cluster_share FROM (SELECT currency, {m} AS s, coalesce(lag({m}) OVER ({S}), false) AS b FROM own) GROUP BY currency",
        q(f"SELECT currency, round({LAR}, 6) AS lift_at_risk, eligible_count AS lar_eligible_count, signal_count AS lar_signal_count, excluded_signal_count AS lar_excluded_signal_count, " + ", ".join(f"round({c}, 6) AS lar_{c}" for c in ("signal_hit_rate", "signal_value_bps", "signal_tail_regret_bps", "random_hit_rate", "random_value_bps", "random_tail_regret_bps", "lift", "delta_utility_bps")) + " FROM lar", lar_draws(draws, "own")),
    ]
    joins = " ".join(f"LEFT JOIN ({x}) p{i} USING (currency)" for i, x in enumerate(parts))
    hit = f"(SELECT currency, avg(h) AS fm FROM (SELECT currency, draw, avg(CAST(stay AS INTEGER)) AS h FROM (SELECT *, row_number() OVER (PARTITION BY currency, draw ORDER BY md5(concat_ws(':', 'hit', draw, currency, effective_date))) AS place FROM (SELECT *, count(*) FILTER (WHERE {m}) OVER (PARTITION BY currency) AS k FROM own), (SELECT unnest(range(1, 51)) AS draw)) WHERE place <= k GROUP BY ALL) GROUP BY currency)"
    first = f"(SELECT currency, count(*) AS eligible_days, count(*) FILTER (WHERE stay) AS target_positives, avg(CASE WHEN {m} THEN CAST(stay AS INTEGER) END) AS shr, count(*) FILTER (WHERE {m}) AS ns, round(avg(CAST(stay AS INTEGER)), 6) AS random_hit_rate, round({LIFT.format(s=m, t='stay')}, 6) AS lift, round(avg(CASE WHEN {m} THEN bps END), 6) AS bps_forward FROM own GROUP BY currency)"
    return f"SELECT f.* EXCLUDE (shr, ns), round(shr, 6) AS signal_hit_rate, {', '.join(f'p{i}.* EXCLUDE (currency)' for i in range(len(parts)))}, round(fm, 6) AS freq_matched_hit_rate, CASE WHEN ns > 0 THEN round(shr / nullif(fm, 0), 6) END AS lift_freq_matched FROM {first} f {joins} LEFT JOIN {hit} h USING (currency)"


def oot_columns(horizons: tuple[int, ...]) -> str:
    return ", ".join(f"round(avg(lift) FILTER (WHERE horizon = {h}), 6) AS lift_h{h}, round(avg(lift_at_risk) FILTER (WHERE horizon = {h}), 6) AS lar_h{h}, count(lift_at_risk) FILTER (WHERE horizon = {h}) AS corridors_with_lar_h{h}" for h in horizons)


def rounding(columns: str, digits: int = 8) -> str:
    return ", ".join(f"round({c.strip()}, {digits}) AS {c.strip()}" for c in columns.split(","))


ID = "currency, effective_date"
B = (PANEL, BASE)
R = (PANEL, BASE, RESEARCH)
T5 = targets(5) % "base"

ORACLE_SQL: dict[str, str] = {
    "momentum_lift": q(lift_rows("outcomes", "stay", ("signal_momentum",)), *B, T5),
    "rates_panel": q("SELECT currency, effective_date, cents, CAST(power(10, r_regionkey % 3) AS INTEGER) AS nominal, cents * CAST(power(10, r_regionkey % 3) AS BIGINT) / 100.0::DOUBLE AS value_rub, p AS rub_per_unit, round(r, 10) AS recipient_per_rub FROM panel", PANEL),
    "context_panel": q("SELECT currency, effective_date, cents, p AS rub_per_unit FROM context", CONTEXT),
    "external_long": q("SELECT series_id, event_date, available_at, value FROM external", EXTERNAL),
    "external_validation": q(f"""SELECT count(*) FILTER (WHERE event_date IS NULL OR available_at IS NULL) AS missing_dates, count(*) FILTER (WHERE value IS NULL) AS missing_values, count(*) FILTER (WHERE available_at < event_date) AS available_early,
      (SELECT count(*) FROM (SELECT 1 FROM external GROUP BY series_id, event_date, available_at HAVING count(*) > 1)) AS repeated_keys, (SELECT count(*) FROM (SELECT 1 FROM (SELECT DISTINCT series_id FROM external) GROUP BY {SERIES_NAME.format('series_id')} HAVING count(*) > 1)) AS colliding_names FROM external""", EXTERNAL),
    "panel_validation": q("SELECT count(*) FILTER (WHERE currency IS NULL) AS missing_keys, count(*) FILTER (WHERE effective_date IS NULL) AS missing_dates, count(*) FILTER (WHERE n > 1) AS repeated_keys FROM (SELECT currency, effective_date, count(*) AS n FROM panel GROUP BY ALL)", PANEL),
    "data_audit": q("""SELECT kind, series_id, min(d) AS start, max(d) AS "end", count(*) AS observations, round(quantile_cont(lag_days, 0.5), 8) AS median_publication_lag_days,
      round(count(*) / (SELECT count(*) FROM (SELECT unnest(generate_series(min(a.d), max(a.d), INTERVAL 1 DAY)) AS x) WHERE dayofweek(x) BETWEEN 1 AND 5), 8) AS business_day_coverage
      FROM (SELECT 'target' AS kind, currency AS series_id, effective_date AS d, 0.0::DOUBLE AS lag_days FROM panel UNION ALL SELECT 'context', currency, effective_date, 0.0::DOUBLE FROM context UNION ALL SELECT 'external', series_id, event_date, 2.0::DOUBLE FROM external) a GROUP BY kind, series_id""", PANEL, CONTEXT, EXTERNAL),
    "quality_profile": q("SELECT currency, min(effective_date) AS first, max(effective_date) AS last, count(*) AS n, count(*) - count(p) AS missing, round(min(p), 8) AS low, round(max(p), 8) AS high, count(local_min) AS target_n, count(*) FILTER (WHERE local_min) AS target_sum, round(avg(CAST(local_min AS INTEGER)), 8) AS target_mean FROM labels GROUP BY currency", PANEL, targets(3) % "panel"),
    "target_local_min": q(f"SELECT {ID}, local_min AS target_local_min_h3 FROM labels", PANEL, targets(3) % "panel"),
    "target_stay_not_worse": q(f"SELECT {ID}, stay AS target_stay_not_worse_h5 FROM labels", PANEL, targets(5) % "panel"),
    "target_window_closing": q(f"SELECT {ID}, closing AS target_window_closing_h5 FROM labels", PANEL, targets(5) % "panel"),
    "forward_mean": q(f"SELECT {ID}, round(fwd, 8) AS forward_mean_h5 FROM labels", PANEL, targets(5) % "panel"),
    "customer_outcomes": q(f"SELECT {ID}, round(smean, 6) AS surrounding_mean_h3, round(best, 6) AS future_best_h3, round(adv, 6) AS moment_advantage_bps_h3, round(reg, 6) AS customer_regret_bps_h3 FROM outcomes", PANEL, targets(3) % "panel"),
    "lar_path_fixed": q(f"SELECT {ID}, round(path_value, 6) AS path_value_bps, round(path_regret, 6) AS path_regret_bps FROM paths", PANEL, path(5, None, "panel")),
    "lar_path_discounted": q(f"SELECT {ID}, round(path_value, 6) AS path_value_bps, round(path_regret, 6) AS path_regret_bps FROM paths", PANEL, path(5, 2.0, "panel")),
    "future_prices": q(f"SELECT {ID}, CASE WHEN l3 IS NOT NULL THEN l1 END AS lead_1, CASE WHEN l3 IS NOT NULL THEN l2 END AS lead_2, l3 AS lead_3 FROM (SELECT {ID}, lead(p, 1) OVER ({S}) AS l1, lead(p, 2) OVER ({S}) AS l2, lead(p, 3) OVER ({S}) AS l3 FROM panel)", PANEL),
    **{name: q(f"SELECT {ID}, {s} AS signal, round({s}_effect, 8) AS effect FROM {'base' if s in NAMES[:4] else 'signals'}", *(B if s in NAMES[:4] else R)) for name, s in SIGNAL_QUERIES.items()},
    "has_fact": q(f"SELECT {ID}, {' OR '.join(f'coalesce({n}, false)' for n in NAMES)} AS has_fact FROM signals", *R),
    **{name: q(f"SELECT {ID}, {rounding(c, d)} FROM f2", PANEL, FEATURES) for name, c, d in (("down_streak", "down_streak", 8), ("price_percentile", "price_percentile", 8), ("days_since_min", "days_since_min", 8), ("rebound", "rebound_pct", 8), ("returns", "ret_1, ret_3, ret_5, ret_10, ret_20", 8), ("vol20", "vol_20", 6), ("slope20", "slope_20", 4))},
    "calendar": q(f"SELECT {ID}, CAST(month(effective_date) AS DOUBLE) AS month, CAST(isodow(effective_date) - 1 AS DOUBLE) AS weekday FROM panel", PANEL),
    "days_to_holiday": q(f"SELECT {ID}, days_gap AS days_to_holiday FROM gaps", PANEL, GAPS),
    "annual_reference": q("SELECT a.currency, a.effective_date, round(CASE WHEN datediff('day', b.effective_date, CAST(a.effective_date - INTERVAL 1 YEAR AS DATE)) <= 7 THEN b.p END, 8) AS annual_reference FROM panel a ASOF LEFT JOIN panel b ON a.currency = b.currency AND CAST(a.effective_date - INTERVAL 1 YEAR AS DATE) >= b.effective_date", PANEL),
    "context_features": q("SELECT effective_date, " + rounding(", ".join(f"{c}_{s}" for c in ("usd", "eur", "cny") for s in ("ret_1", "ret_5", "percentile", "vol_20"))) + " FROM wide", PANEL, CONTEXT, CTX),
    "synthetic_cross": q(f"""SELECT {ID}, round(ret_1 - usd_ret_1, 8) AS residual_usd_1, {', '.join(f"round({c}_ret_1 - ret_1, 8) AS local_per_{c}_ret_1, round({c}_ret_5 - ret_5, 8) AS local_per_{c}_ret_5, round({c}_v, 8) AS local_per_{c}_vol_20" for c in ('usd', 'cny'))}
      FROM (SELECT *, {', '.join(f"{full('stddev_samp(' + c + '_ret_1 - ret_1)', c + '_ret_1 - ret_1', frame(20), 20)} AS {c}_v" for c in ('usd', 'cny'))} FROM f2 LEFT JOIN wide USING (effective_date))""", PANEL, CONTEXT, CTX, FEATURES),
    "external_features": q(f"SELECT effective_date, series, round(value, 8) AS value, round(ret_1, 8) AS ret_1, round(ret_5, 8) AS ret_5, round({share('value', 'l90', 90)}, 8) AS percentile, round({full('stddev_samp(ret_1)', 'ret_1', frame(20), 20, SE)}, 8) AS vol_20, staleness_days FROM e1", PANEL, EXTERNAL, EXT),
    "causal_context": q(f"SELECT p.currency, p.effective_date, {', '.join(f'''max(CASE WHEN e.series = '{s}' THEN value END) AS ctx_{s}''' for s in ('1_urgent', '2_high', '3_medium', '4_not_specified', '5_low'))} FROM panel p LEFT JOIN e0 e ON e.effective_date = p.effective_date GROUP BY ALL", PANEL, EXTERNAL, EXT),
    "cross_rates": q("SELECT a.effective_date, round(CASE WHEN b.p > 0 THEN a.p / b.p END, 8) AS usd_per_eur FROM context a JOIN context b ON a.effective_date = b.effective_date AND a.currency = 'USD' AND b.currency = 'EUR'", CONTEXT),
    "text_scalars": f"SELECT DISTINCT o_orderpriority, o_orderstatus, {SERIES_NAME.format('o_orderpriority')} AS series, 'RUB->' || o_orderstatus AS corridor, CASE WHEN o_orderstatus <> 'F' THEN upper({SERIES_NAME.format('o_orderpriority')}) || ' ' || o_orderstatus ELSE replace({SERIES_NAME.format('o_orderpriority')}, '_', ' ') END AS label FROM orders",
    "rolling_quantile": q(f"SELECT {ID}, round({full('quantile_cont(p, 0.1)', 'p', frame(90), 90)}, 8) AS q10 FROM panel", PANEL),
    "ema": q(f"SELECT currency, effective_date, round(CASE WHEN i >= 10 THEN m10 END, 4) AS ema_10, round(CASE WHEN i >= 60 THEN m60 END, 4) AS ema_60 FROM em JOIN n USING (currency, i)", PANEL, f"n AS (SELECT *, row_number() OVER ({S}) AS i FROM panel)", "em AS (SELECT currency, i, p AS m10, p AS m60 FROM n WHERE i = 1 UNION ALL SELECT n.currency, n.i, 2.0::DOUBLE / 11 * n.p + 9.0::DOUBLE / 11 * m10, 2.0::DOUBLE / 61 * n.p + 59.0::DOUBLE / 61 * m60 FROM em JOIN n ON n.currency = em.currency AND n.i = em.i + 1)", recursive=True),
    "lift_by_indicator": q(lift_rows("outcomes", "local_min", NAMES[:4]), *B, targets(3) % "base"),
    "tail_regret": q(f"SELECT currency, round(cvar, 6) AS cvar FROM {worst('outcomes', 'reg', 'currency', 'cvar')}", *B, T5),
    "customer_metrics": q(f"""SELECT currency, count(adv) AS value_observations, round(avg(adv), 6) AS moment_advantage_bps, count(reg) AS regret_observations, round(avg(reg), 6) AS customer_regret_bps_mean, round(max(reg), 6) AS customer_regret_bps_max,
      round(avg(CASE WHEN k <= 5 THEN reg END), 6) AS customer_regret_worst_five_mean_bps, round(any_value(w), 6) AS customer_regret_cvar_95_bps FROM (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY reg DESC NULLS LAST) AS k FROM outcomes WHERE signal_level) LEFT JOIN {worst('outcomes', 'reg', 'currency', 'w', 'signal_level')} USING (currency) GROUP BY currency""", *B, T5),
    "weekly_counts": q("SELECT * FROM counts", *B, weekly("base", "signal_momentum")),
    "frequency_summary": q("""SELECT currency, CAST(sum(pushes) AS BIGINT) AS signal_count, count(*) AS eligible_weeks, round(avg(pushes), 8) AS pushes_per_week, round(quantile_cont(pushes, 0.5), 8) AS pushes_p50_per_week, round(quantile_cont(pushes, 0.9), 8) AS pushes_p90_per_week,
      round(avg(CAST(pushes = 0 AS INTEGER)), 8) AS zero_push_week_rate, round(avg(CAST(pushes > 2 AS INTEGER)), 8) AS over_budget_week_rate, round(any_value(cr), 8) AS cluster_rate FROM counts LEFT JOIN
      (SELECT currency, count(*) FILTER (WHERE g <= 3) / count(*) AS cr FROM (SELECT currency, datediff('day', lag(effective_date) OVER w, effective_date) AS g FROM base WHERE signal_momentum WINDOW w AS (PARTITION BY currency ORDER BY effective_date)) GROUP BY currency) USING (currency) GROUP BY currency""", *B, weekly("base", "signal_momentum")),
    "cluster_rate": q(f"""SELECT currency, round(cr, 8) AS cluster_rate, round(cs, 8) AS cluster_share FROM (SELECT currency, count(*) FILTER (WHERE g <= 3) / count(*) AS cr FROM (SELECT currency, datediff('day', lag(effective_date) OVER ({S}), effective_date) AS g FROM base WHERE signal_level) GROUP BY currency)
      JOIN (SELECT currency, count(*) FILTER (WHERE s AND b) / nullif(count(*) FILTER (WHERE s), 0) AS cs FROM (SELECT currency, coalesce(signal_level, false) AS s, coalesce(lag(signal_level) OVER ({S}), false) AS b FROM base) GROUP BY currency) USING (currency)""", *B),
    "useful_signals": q("SELECT currency, round(sum(pushes) / count(*), 8) AS useful_signals_per_week, round(sum(pushes) / count(*) * 100, 8) AS useful_signals_per_100_weeks FROM counts GROUP BY currency", *B, T5, "good AS (SELECT currency, effective_date, stay AND signal_momentum AS u FROM outcomes WHERE stay IS NOT NULL)", weekly("good", "u")),
    "random_signal": q(f"SELECT {ID}, row_number() OVER (PARTITION BY currency ORDER BY md5(concat_ws(':', 'random', 1, currency, effective_date))) <= least(round_even(1.5 * greatest(datediff('day', min(effective_date) OVER c, max(effective_date) OVER c) / 7.0::DOUBLE, 1), 0), count(*) OVER c) AS random_signal FROM panel WINDOW c AS (PARTITION BY currency)", PANEL),
    "matched_hit_rate": q("""SELECT currency, round(avg(h), 8) AS freq_matched_hit_rate FROM (SELECT currency, draw, avg(CAST(stay AS INTEGER)) AS h FROM (SELECT *, row_number() OVER (PARTITION BY currency, draw ORDER BY md5(concat_ws(':', 'hit', draw, currency, effective_date))) AS place FROM
      (SELECT *, count(*) FILTER (WHERE signal_momentum) OVER (PARTITION BY currency) AS k FROM outcomes WHERE stay IS NOT NULL), (SELECT unnest(range(1, 51)) AS draw)) WHERE place <= k GROUP BY ALL) GROUP BY currency""", *B, T5),
    "matched_draws": q(f"SELECT currency, effective_date, CAST(draw AS INTEGER) AS draw FROM (SELECT *, row_number() OVER (PARTITION BY currency, draw, wk ORDER BY md5(concat_ws(':', 'lar', draw, currency, effective_date))) AS place FROM (SELECT *, count(*) FILTER (WHERE signal_momentum) OVER (PARTITION BY currency, wk) AS k FROM (SELECT *, {WEEK} AS wk FROM base)), (SELECT unnest(range(1, 51)) AS draw)) WHERE place <= k", *B),
    **{name: q("SELECT currency, eligible_count, signal_count, excluded_signal_count, " + rounding("signal_hit_rate, signal_value_bps, signal_tail_regret_bps, random_hit_rate, random_value_bps, random_tail_regret_bps, lift, delta_utility_bps", 7) + f", round({LAR}, 7) AS lift_at_risk FROM lar", *B, T5, path(5, gap, "outcomes"), lar_draws(200)) for name, gap in (("lift_at_risk", None), ("lift_at_risk_discounted", 2.0))},
    "method_metrics": q(f"SELECT *, 5 AS horizon FROM ({method_metrics(200)})", *B, T5, path(5, None, "outcomes"), "own AS (SELECT * FROM paths WHERE stay IS NOT NULL)"),
    "rule_backtest": q(f"SELECT {PARTS}, 'RUB->' || split_part(currency, ':', 4) AS corridor, * EXCLUDE (currency) FROM ({method_metrics(50)})", *R, sliced(NAMES, (5,), "signals", control=True)),
    "baseline_lift": q(" UNION ALL ".join(f"SELECT * FROM ({lift_rows(f'outcomes{h}', 'local_min', NAMES[:4], f', {h} AS horizon')})" for h in (1, 3, 5)), *B, *[(targets(h).replace("labels", f"labels{h}").replace("outcomes", f"outcomes{h}")) % "base" for h in (1, 3, 5)]),
    "slices": q("SELECT method, split, fold, currency, horizon, signal_count, " + rounding("lift, moment_advantage_bps, customer_regret_bps_mean, signals_per_week, cluster_rate, lift_at_risk", 6) + " FROM slices", *B, slices()),
    "stability": q(" UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS slice_count, round({w}({m}), 6) AS worst, round(quantile_cont({m}, 0.5), 6) AS median, round({b}({m}), 6) AS best FROM slices" for m, w, b in (("lift", "min", "max"), ("lift_at_risk", "min", "max"), ("moment_advantage_bps", "min", "max"), ("customer_regret_bps_mean", "max", "min"))), *B, slices()),
    "oot_summary": q("SELECT method, " + oot_columns((1, 5, 10)) + ", round(avg(signals_per_week) FILTER (WHERE horizon = 5), 6) AS signals_per_week, round(avg(cluster_rate) FILTER (WHERE horizon = 5), 6) AS cluster_rate FROM slices WHERE split = 'oot' GROUP BY method", *B, slices()),
    "oot_ranking": q("SELECT CAST(row_number() OVER (ORDER BY corridors_with_lar_h5 DESC NULLS LAST, l5 DESC NULLS LAST, corridors_with_lar_h10 DESC NULLS LAST, l10 DESC NULLS LAST, method) AS INTEGER) AS place, method, corridors_with_lar_h5, corridors_with_lar_h10 FROM (SELECT method, " + ", ".join(f"avg(lf) FILTER (WHERE horizon = {h}) AS l{h}, count(lr) FILTER (WHERE horizon = {h}) AS corridors_with_lar_h{h}" for h in (5, 10)) + f" FROM (SELECT {PARTS}, lf, lr FROM (SELECT currency, {LIFT.format(s='signal_momentum', t='stay')} AS lf FROM own GROUP BY currency) LEFT JOIN (SELECT currency, {LAR} AS lr FROM lar) USING (currency)) GROUP BY method)", *R, sliced(NAMES, (5, 10), "signals", FOLDS[-1:], True), lar_draws(50, "own")),
    "with_diagnostics": q("SELECT a.method, a.fold, a.currency, a.horizon, round(a.lift, 6) AS lift, a.signal_count, b.signal_count * 2 AS signal_count_diag, b.lift > 1 AS better FROM slices a LEFT JOIN slices b ON a.method = b.method AND a.fold = b.fold AND a.currency = b.currency AND a.horizon = b.horizon AND b.signal_count > 20", *B, slices()),
    "method_summary": q("""SELECT a.method, round(lm, 6) AS oos_lift_mean, round(lw, 6) AS oos_lift_worst, round(ls, 6) AS oos_lift_13_share, round(la, 6) AS oos_lar_mean, round(spw, 6) AS signals_per_week, round(cr, 6) AS cluster_rate, vs AS valid_slices, round(ol, 6) AS oot_lift, round(oa, 6) AS oot_lar,
      CASE WHEN lm >= 1.3 AND val > 0 AND spw BETWEEN 1 AND 2 THEN 'PASS' ELSE 'REVIEW' END AS status FROM (SELECT method, avg(lift) AS lm, min(lift) AS lw, avg(CAST(lift >= 1.3 AS INTEGER)) AS ls, avg(lift_at_risk) FILTER (WHERE lift IS NOT NULL) AS la, avg(moment_advantage_bps) FILTER (WHERE lift IS NOT NULL) AS val, avg(signals_per_week) AS spw, avg(cluster_rate) AS cr, count(lift) AS vs FROM slices WHERE horizon = 5 AND split <> 'oot' GROUP BY method) a
      LEFT JOIN (SELECT method, avg(lift) AS ol, avg(lift_at_risk) AS oa FROM slices WHERE horizon = 5 AND split = 'oot' GROUP BY method) b USING (method)""", *B, slices()),
    "gate_shares": q("SELECT method, split, round(avg(CAST(coalesce(lift >= 1.3, false) AS INTEGER)) * 100, 6) AS lift_ok, round(avg(CAST(coalesce(moment_advantage_bps > 0, false) AS INTEGER)) * 100, 6) AS value_ok, round(avg(CAST(coalesce(signals_per_week BETWEEN 1 AND 2, false) AS INTEGER)) * 100, 6) AS frequency_ok FROM slices GROUP BY ALL", *B, slices()),
    "heatmap": q("SELECT currency, " + ", ".join(f"round(avg(lift) FILTER (WHERE horizon = {h}), 6) AS lift_h{h}" for h in (1, 5, 10)) + " FROM slices GROUP BY currency", *B, slices()),
    "median_ranking": q("SELECT slice, round(median, 6) AS median FROM (SELECT method || '|' || currency AS slice, quantile_cont(lift, 0.5) AS median FROM slices GROUP BY 1) WHERE median IS NOT NULL ORDER BY median DESC, slice LIMIT 5", *B, slices()),
    "experiment_summary": q("SELECT method, horizon, CAST(sum(signal_count) AS BIGINT) AS signals, count(*) FILTER (WHERE signal_count > 0) AS corridors, round(avg(lift), 3) AS mean_lift, round(avg(moment_advantage_bps), 3) AS mean_bps, round(avg(signals_per_week), 3) AS mean_per_week FROM slices WHERE split = 'oot' GROUP BY ALL", *B, slices()),
    "market_components": q(f"""SELECT 'RUB->' || c AS corridor, d || '/RUB' AS driver, n AS observations, round(k, 6) AS correlation, round(b, 6) AS beta, round(1 - greatest(vy - b * b * vx, 0) / nullif(vy, 0), 6) AS variance_explained_r2, round(sqrt(greatest(vy - b * b * vx, 0)), 6) AS residual_volatility
      FROM (SELECT y.currency AS c, x.currency AS d, count(*) AS n, corr(y.v, x.v) AS k, covar_samp(y.v, x.v) / var_samp(x.v) AS b, var_samp(x.v) AS vx, var_samp(y.v) AS vy FROM (SELECT currency, effective_date, {change('p')} AS v FROM panel) y JOIN (SELECT currency, effective_date, {change('p')} AS v FROM context) x ON y.effective_date = x.effective_date AND y.v IS NOT NULL AND x.v IS NOT NULL GROUP BY ALL) WHERE vx > 0""", PANEL, CONTEXT),
    "paired_effect": q("""SELECT currency, round(CASE WHEN n1 > 0 AND n0 > 0 THEN l1 - l0 END, 6) AS delta_lift, round(CASE WHEN n1 > 0 AND n0 > 0 AND l1 - l0 IS NOT NULL THEN b1 - b0 END, 6) AS delta_bps FROM (SELECT currency, count(*) FILTER (WHERE signal_level) AS n1, count(*) FILTER (WHERE signal_momentum) AS n0,
      """ + LIFT.format(s="signal_level", t="stay") + " AS l1, " + LIFT.format(s="signal_momentum", t="stay") + " AS l0, avg(bps) FILTER (WHERE signal_level) AS b1, avg(bps) FILTER (WHERE signal_momentum) AS b0 FROM outcomes WHERE stay IS NOT NULL GROUP BY currency)", *B, T5),
    "research_decisions": q("""SELECT fold, count(*) FILTER (WHERE dec = 'unusable') AS unusable, count(*) FILTER (WHERE dec = 'insufficient_frequency') AS insufficient_frequency, count(*) FILTER (WHERE dec = 'adopt') AS adopt, count(*) FILTER (WHERE dec = 'reject') AS reject FROM
      (SELECT a.fold, CASE WHEN a.signal_count = 0 THEN 'unusable' WHEN a.signals_per_week < 0.5 THEN 'insufficient_frequency' WHEN a.lift - b.lift > 0 AND a.moment_advantage_bps - b.moment_advantage_bps >= 0 THEN 'adopt' ELSE 'reject' END AS dec FROM slices a JOIN slices b ON a.fold = b.fold AND a.currency = b.currency AND a.horizon = 5 AND b.horizon = 5 AND a.method = 'signal_level' AND b.method = 'signal_momentum') GROUP BY fold""", *B, slices()),
    "rule_counts": q("SELECT currency, rule_id, n FROM (UNPIVOT cells ON " + ", ".join(f'"{n}"' for n, _ in RULES) + " INTO NAME rule_id VALUE n)", PANEL, RULE_CTES, "cells AS (SELECT currency, " + ", ".join(f'count(*) FILTER (WHERE {c}) AS "{n}"' for n, c in RULES) + " FROM g3 GROUP BY currency)", recursive=True),
    "ensembles": q(ensemble_rows(), PANEL, RULE_CTES, "held AS (SELECT currency, " + ", ".join(f'{c} AS "{n}"' for n, c in _HELD.items()) + " FROM g3)", recursive=True),
    "rule_rows": q(held_rows("g3", RULES), PANEL, RULE_CTES, recursive=True),
    "context_rule_counts": q(context_rule_counts(), PANEL, CONTEXT, CTX, FEATURES, EXTERNAL, EXT, CONTEXT_RULES),
    "context_rule_rows": q(held_rows("k2", CONTEXT_LIST), PANEL, CONTEXT, CTX, FEATURES, EXTERNAL, EXT, CONTEXT_RULES),
    "discovery_effect": q(f"SELECT round(avg(l), 6) AS lift_point, round(avg(b), 6) AS bps_point FROM (SELECT {LIFT.format(s='signal_momentum', t='stay')} AS l, avg(CASE WHEN signal_momentum THEN bps END) AS b, count(*) FILTER (WHERE signal_momentum) AS n, avg(CAST(stay AS INTEGER)) AS pr FROM outcomes WHERE stay IS NOT NULL GROUP BY currency) WHERE n > 0 AND pr > 0", *B, T5),
    "compact_outcomes": q("SELECT currency, effective_date, CAST(CAST(stay AS INTEGER) AS DOUBLE) AS y, round(bps, 6) AS v, round(reg, 6) AS r, round(adv, 6) AS m FROM outcomes", PANEL, targets(5) % "panel"),
    "fold_calendar": q("SELECT 'wf_' || y AS fold, 'wf_oos' AS split, make_date(y - 1, 1, 1) AS train_end, make_date(y - 1, 1, 1) AS val_start, make_date(y, 1, 1) AS val_end, make_date(y, 1, 1) AS test_start, least(make_date(y + 1, 1, 1), DATE '2000-09-01') AS test_end FROM (SELECT CAST(unnest(range(1996, 2001)) AS INTEGER) AS y), (SELECT min(effective_date) AS a FROM panel) WHERE make_date(y - 1, 1, 1) > a + INTERVAL 6 MONTH UNION ALL SELECT 'oot', 'oot', DATE '1999-09-01', DATE '1999-09-01', DATE '2000-09-01', DATE '2000-09-01', CAST(max(effective_date) + 1 AS DATE) FROM panel HAVING max(effective_date) >= DATE '2000-09-01'", PANEL),
    "candidates": q("SELECT 'random' AS method, 'random' AS kind, '' AS groups, (SELECT CAST(sum(CAST(least(round_even(1.5 * w, 0), k) AS BIGINT)) AS BIGINT) FROM (SELECT greatest(datediff('day', min(effective_date), max(effective_date)) / 7.0::DOUBLE, 1) AS w, count(*) AS k FROM panel GROUP BY currency)) AS n" + "".join(f" UNION ALL SELECT '{n}', 'rule', '', (SELECT count(*) FROM signals WHERE {n})" for n in NAMES) + "".join(f" UNION ALL SELECT 'logreg_{g}', 'model', '{g}', (SELECT count(*) FROM signals WHERE {' OR '.join(f'coalesce({n}, false)' for n in NAMES)})" for g in ("AB", "ABC")), *R),
    "merged_segments": "SELECT c_mktsegment, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "feature_frame": q(f"SELECT currency, effective_date, {', '.join(NAMES[:4])}, " + rounding("down_streak, price_percentile, days_since_min, rebound_pct, ret_1, ret_3, ret_5, ret_10, ret_20, vol_20", 6) + ", days_gap AS days_to_holiday, round(slope_20, 3) AS slope_20, CAST(month(effective_date) AS DOUBLE) AS month, CAST(isodow(effective_date) - 1 AS DOUBLE) AS weekday, ext.* EXCLUDE (effective_date) FROM base JOIN (SELECT * EXCLUDE (p, r, cents, r_regionkey) FROM f2) f USING (currency, effective_date) JOIN ext USING (effective_date)", *B, FEATURES, EXTERNAL, EXT,
      f"e2 AS (SELECT *, {share('value', 'l90', 90)} AS percentile, {full('stddev_samp(ret_1)', 'ret_1', frame(20), 20, SE)} AS vol_20 FROM e1), ext AS (SELECT effective_date, " + ", ".join(f"round(max(CASE WHEN series = '{n}' THEN {c} END), 6) AS ext_{n}_{c}" for n in CTX_NAMES for c in ("ret_1", "ret_5", "percentile", "vol_20", "staleness_days")) + " FROM e2 GROUP BY effective_date)"),
    "xml_rates": q("SELECT currency, effective_date, CAST(power(10, r_regionkey % 3) AS INTEGER) AS nominal, cents * CAST(power(10, r_regionkey % 3) AS BIGINT) / 100.0::DOUBLE AS value_rub, round(p, 6) AS rub_per_unit FROM panel", PANEL),
    "fetched_rates": q("SELECT currency, effective_date, 'R' || lpad(CAST(r_regionkey AS VARCHAR), 5, '0') AS cbr_id, CAST(power(10, r_regionkey % 3) AS INTEGER) AS nominal, round(cents * CAST(power(10, r_regionkey % 3) AS BIGINT) / 100.0::DOUBLE, 2) AS value_rub, round(p, 6) AS rub_per_unit FROM panel", PANEL),
    "csv_rates": q("SELECT currency, effective_date, effective_date AS available_at, CAST(power(10, r_regionkey % 3) AS INTEGER) AS nominal, cents * CAST(power(10, r_regionkey % 3) AS BIGINT) / 100.0::DOUBLE AS value_rub, p AS rub_per_unit, true AS is_fresh FROM panel", PANEL),
    "public_csv": q("SELECT effective_date AS event_date, effective_date + 3 AS available_at, 'public' AS source, 'usd' AS series_id, CAST(cents AS DOUBLE) AS value FROM context WHERE currency = 'USD' AND cents % 7 <> 0", CONTEXT),
    "csv_external": q("SELECT series_id, event_date, available_at, value FROM external", EXTERNAL),
    "file_digest": "SELECT CAST(strlen(t) AS BIGINT) AS bytes, sha256(t) AS sha256 FROM (SELECT 'r_regionkey,r_name' || chr(10) || string_agg(r_regionkey || ',' || r_name || chr(10), '' ORDER BY r_regionkey) AS t FROM region)",
    "report_table": q("SELECT CAST(row_number() OVER (ORDER BY o, text) - 1 AS INTEGER) AS line, text FROM (SELECT 0 AS o, '| currency | n | high | low |' AS text UNION ALL SELECT 1, '| --- | --- | --- | --- |' UNION ALL SELECT 2, '| ' || currency || ' | ' || count(*) || ' | ' || printf('%.3f', max(cents * CAST(power(10, r_regionkey % 3) AS BIGINT) / 100.0::DOUBLE)) || ' | — |' FROM panel GROUP BY currency)", PANEL),
    "resumed": q("SELECT currency, effective_date, cents FROM panel", PANEL),
    "rule_screen": q("SELECT rule_id, signal_count, corridors_with_signals, " + rounding("mean_lift, median_lift, mean_bps, mean_signals_per_week, positive_share, mean_cluster_share", 6) + ", family, passed FROM screened", PANEL, SCREEN, recursive=True),
    "rule_shortlist": q(f"""SELECT rule_id, family, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY f DESC, l DESC, b DESC, z DESC, nth) AS place FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY f DESC, l DESC, b DESC, z DESC, nth) AS kf
      FROM (SELECT *, coalesce(CAST(wk BETWEEN 0.8 AND 2.5 AND vb > 0 AS INTEGER), 0) AS f, coalesce(vl, -1) AS l, coalesce(vb, -1e9) AS b, -round(abs(wk - 1.5), 9) AS z FROM (SELECT *, {NINE.format('median_lift')} AS vl, {NINE.format('mean_bps')} AS vb, {NINE.format('mean_signals_per_week')} AS wk, list_position({[n for n, _ in RULES]}, rule_id) AS nth, bool_or(passed) OVER () AS any_passed FROM screened) WHERE passed OR NOT any_passed)) WHERE kf <= 5) WHERE place <= 20""", PANEL, SCREEN, recursive=True),
    "policy_calendar": q("SELECT currency, effective_date, sent AS policy_signal FROM rec JOIN cand USING (currency, i)", PANEL, sends(""), CALENDAR, recursive=True),
    "rule_policy_stream": q("SELECT currency, effective_date, meta_reason, sent AS policy_signal FROM rec JOIN cand USING (currency, i)", *R, DECIDED, RULE_STREAM, CALENDAR, recursive=True),
    "rule_snapshots": q(snapshots(), *R, DECIDED, RULE_STREAM, CALENDAR, recursive=True),
    "policy_prints": q("SELECT currency, effective_date, sent AS policy_signal FROM rec JOIN cand USING (currency, i)", PANEL, sends(""), """rec AS (SELECT DISTINCT currency, 0::BIGINT AS i, CAST(NULL AS BIGINT) AS lp, CAST(NULL AS DATE) AS d1, CAST(NULL AS DATE) AS d2, false AS sent FROM cand UNION ALL
      SELECT currency, i, CASE WHEN ok THEN i ELSE lp END, CASE WHEN ok THEN d ELSE d1 END, CASE WHEN ok THEN d1 ELSE d2 END, ok FROM (SELECT b.currency, b.i, b.effective_date AS d, r.lp, r.d1, r.d2, b.c AND (r.lp IS NULL OR b.i - r.lp > 1) AND (r.d2 IS NULL OR r.d2 < b.effective_date - 6) AS ok FROM rec r JOIN cand b ON b.currency = r.currency AND b.i = r.i + 1))""", recursive=True),
    "meta_decisions": q(f"SELECT {ID}, meta_should_send, meta_selected_signal, meta_reason, round(meta_selected_effect, 8) AS meta_selected_effect, round(meta_selection_score, 8) AS meta_selection_score, coalesce(active, '') AS active, CASE WHEN meta_reason IN ('invalid_market_score', 'below_market_threshold', 'no_active_signal') THEN 0 ELSE ns END AS n_scores FROM decided", *R, DECIDED),
    "push_messages": q("SELECT currency, effective_date, currency || ': a good day' AS title, currency || ' moved by ' || CASE WHEN meta_selected_effect IS NULL THEN '—' ELSE printf('%.2f', abs(meta_selected_effect) * 100) END || '%: ' || replace(replace(meta_selected_signal, 'signal_', ''), '_', ' ') AS body FROM decided WHERE meta_should_send", *R, DECIDED),
    "explanations": q(f"""SELECT {ID}, fact AS chosen_indicator, CASE WHEN fact IS NOT NULL THEN 'down' END AS direction, round(CASE fact WHEN 'level' THEN 1 - price_percentile WHEN 'momentum' THEN down_streak WHEN 'seasonality' THEN coalesce(-days_gap, '-infinity'::DOUBLE) END, 8) AS strength, CASE WHEN fact = 'momentum' THEN 'fast' WHEN fact IS NOT NULL THEN 'slow' END AS speed, CASE WHEN fact IS NOT NULL THEN 'now_cheap' END AS scenario
      FROM (SELECT *, CASE WHEN price_percentile <= 0.3 THEN CASE WHEN signal_level THEN 'level' WHEN signal_momentum THEN 'momentum' WHEN signal_seasonality THEN 'seasonality' END END AS fact FROM base JOIN (SELECT currency, effective_date, price_percentile, down_streak FROM f2) USING (currency, effective_date))""", *B, FEATURES),
    "split_sizes": q(" UNION ALL ".join(f"SELECT '{f.name}' AS fold, '{part}' AS part, currency, count(*) AS n, min(effective_date) AS first, max(effective_date) AS last FROM (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY effective_date DESC) AS b FROM panel WHERE {cond}) WHERE b > {h} GROUP BY currency" for f in FOLDS for part, cond, h in (("train", f"effective_date < DATE '{f.train_end}'", 5), ("validation", f"effective_date >= DATE '{f.val_start}' AND effective_date < DATE '{f.val_end}'", 5), ("test", f"effective_date >= DATE '{f.test_start}' AND effective_date < DATE '{f.test_end}'", 0))), PANEL),
    "fold_assignment": q(f"SELECT fold, CASE WHEN fold = 'oot' THEN 'oot' ELSE 'wf_oos' END AS split, currency, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM (SELECT *, {FOLD} AS fold FROM panel) WHERE fold IS NOT NULL GROUP BY ALL", PANEL),
    "threshold_macro_lar": q(f"SELECT threshold, round(weekly, 6) AS weekly, round(lr, 6) AS metric, round(mean_bps, 6) AS mean_bps FROM thr JOIN (SELECT CAST(split_part(currency, ':', 1) AS DOUBLE) AS threshold, avg({LAR}) AS lr FROM lar WHERE lift IS NOT NULL AND delta_utility_bps IS NOT NULL GROUP BY 1) USING (threshold)", *R, THRESHOLDS, MACRO, lar_draws(50, "tried_paths")),
    "threshold_scores": q("SELECT threshold, " + rounding("weekly, metric, mean_bps", 6) + " FROM thr", *R, THRESHOLDS),
    "threshold_choice": q(f"SELECT max(threshold) AS threshold FROM (SELECT threshold FROM thr WHERE mean_bps > 0 ORDER BY weekly <= 2.5 DESC, {NINE.format('metric * least(weekly, 1)')} DESC, {NINE.format('mean_bps')} DESC, threshold LIMIT 1)", *R, THRESHOLDS),
    "upsert_journal": "WITH o AS (SELECT o_orderkey, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders) SELECT * FROM o WHERE y < 2000 AND o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 'X', y FROM o WHERE o_orderkey % 10 = 0",
    "append_journal": "SELECT o_orderkey, o_orderstatus, CAST(NULL AS VARCHAR) AS o_orderpriority FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderstatus = 'P'",
    "new_dates": q("SELECT DISTINCT effective_date FROM context EXCEPT SELECT effective_date FROM panel", PANEL, CONTEXT),
}

#: The queries of series in chunks and of joins in spans give what whole ones give.
ORACLE_SQL |= {
    "cut_labels": q(f"SELECT {ID}, local_min AS target_local_min_h5, stay AS target_stay_not_worse_h5, round(fwd, 6) AS forward_mean_h5, closing AS target_window_closing_h5, round(smean, 6) AS surrounding_mean_h5, round(best, 6) AS future_best_h5, round(adv, 6) AS moment_advantage_bps_h5, round(reg, 6) AS customer_regret_bps_h5, round(path_value, 6) AS path_value_bps, round(path_regret, 6) AS path_regret_bps FROM outcomes JOIN (SELECT {ID}, path_value, path_regret FROM paths) USING ({ID})", PANEL, targets(5) % "panel", path(5, 2.0, "panel")),
    "cut_features": q(f"SELECT {ID}, {rounding('price_percentile, days_since_min, rebound_pct, ret_1, ret_3, ret_5, ret_10, ret_20, vol_20, slope_20, down_streak', 4)}, CAST(month(effective_date) AS DOUBLE) AS month, CAST(isodow(effective_date) - 1 AS DOUBLE) AS weekday FROM f2", PANEL, FEATURES),
    "cut_signals": q(f"SELECT {ID}, {', '.join(f'{s}, round({s}_effect, 8) AS {s}_effect' for s in NAMES)} FROM signals", *R),
    "cut_context": ORACLE_SQL["context_features"],
    "cut_external": ORACLE_SQL["external_features"],
    "cut_rules": ORACLE_SQL["rule_rows"],
    "span_asof": f"SELECT {ID}, annual_reference, c.* EXCLUDE ({ID}) FROM ({ORACLE_SQL['annual_reference']}) JOIN ({ORACLE_SQL['causal_context']}) c USING ({ID})",
    "lift_at_risk_given": q("SELECT currency, eligible_count, signal_count, excluded_signal_count, " + rounding("signal_hit_rate, signal_value_bps, signal_tail_regret_bps, random_hit_rate, random_value_bps, random_tail_regret_bps, lift, delta_utility_bps", 7) + f", round({LAR}, 7) AS lift_at_risk FROM lar", *B, T5, path(5, None, "outcomes"), GIVEN, lar_draws(1, picked="gpick")),
    "given_violations": q("""SELECT CAST(20 AS BIGINT) AS other_length, (SELECT count(*) FROM g WHERE year(effective_date) = 1996) AS outside, (SELECT count(*) FROM g WHERE year(effective_date) = 1998) AS ineligible,
      (SELECT count(*) FROM (SELECT currency, draw, count(*) FILTER (WHERE year(effective_date) NOT IN (1996, 1998)) AS had FROM g GROUP BY ALL) JOIN (SELECT currency, count(*) FILTER (WHERE signal_momentum AND year(effective_date) NOT IN (1996, 1998)) AS want FROM gelig GROUP BY currency) USING (currency) WHERE had <> want) AS other_count""", *B, T5, path(5, None, "outcomes"), GIVEN, "g AS (SELECT * FROM gpick WHERE draw <> 3 OR year(effective_date) <> 1997)"),
    "stream_calendar": ORACLE_SQL["policy_calendar"],
    "stream_weeks": q(f"SELECT currency, {WEEK} AS week, count(*) FILTER (WHERE c) AS pushes FROM cand GROUP BY ALL", PANEL, sends("")),
    **{name: q("SELECT CAST(effective_date AS VARCHAR) AS date, p AS value FROM context WHERE currency = 'USD'", CONTEXT) for name in ("paged_context", "paged_stream")},
}
