"""Equivalent SQL for the registered queries, for an engine with list lambdas and `lgamma`.

Written from the definitions, by other means than the DataFrame plans wherever
there is a choice: ranks by window over rows, letters by listing all level sets,
tails by power series.
"""

from __future__ import annotations


from ..functions import normal

ASSAY = """assay AS (
  SELECT l_linestatus AS pathogen, l_returnflag AS experiment, o_orderpriority AS treatment,
         l_quantity AS diam_mm, l_extendedprice AS value2,
         l_quantity + CAST(0.4 AS DOUBLE) * (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) AS diam_shift
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
BY = "pathogen, experiment"


def r(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0 AS {name}"


def tail2(z: str) -> str:
    """Two-sided normal tail by the series of the density."""
    x = f"greatest(abs({z}), 1e-300)"
    terms = (
        f"list_sum(list_transform(range(0, 200), lambda j: exp((2 * j + 1) * ln({x}) - (j + 1) * ln(2.0)"
        f" - lgamma(j + 1.5) + 0.5 * ln(pi()))))"
    )
    return (
        f"CASE WHEN {z} IS NULL THEN NULL WHEN abs({z}) > 9 THEN 0.0 "
        f"ELSE greatest(0.0, 1 - 2 * exp(-0.5 * {x} * {x}) / sqrt(2 * pi()) * {terms}) END"
    )


def tail1(z: str) -> str:
    return f"CASE WHEN {z} >= 0 THEN ({tail2(z)}) / 2 ELSE 1 - ({tail2(z)}) / 2 END"


def chi2(x: str, df: str) -> str:
    """Upper chi-square tail by the series of the incomplete gamma function."""
    a, h = f"({df} / 2.0)", f"greatest({x} / 2.0, 1e-300)"
    terms = f"list_sum(list_transform(range(0, 600), lambda j: exp(({a} + j) * ln({h}) - {h} - lgamma({a} + j + 1))))"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 300 THEN 0.0 ELSE greatest(0.0, 1 - {terms}) END"


def f_tail(f: str, d1: str, d2: str) -> str:
    """Upper F tail by the power series of the incomplete beta function."""
    a, b = f"({d1} / 2.0)", f"({d2} / 2.0)"
    x = f"({d1} * {f} / ({d1} * {f} + {d2}))"
    terms = (
        f"list_sum(list_transform(range(0, 1500), lambda j: exp(lgamma({a} + {b} + j) - lgamma({a} + j + 1)"
        f" - lgamma({b}) + ({a} + j) * ln({x}) + {b} * ln(1 - {x}))))"
    )
    return (
        f"CASE WHEN {f} IS NULL THEN NULL WHEN {f} <= 0 THEN 1.0 WHEN {d1} * {f} > 400 THEN 0.0 "
        f"ELSE greatest(0.0, 1 - {terms}) END"
    )


def poly(coefficients: list[float], x: str) -> str:
    return " + ".join(f"({c!r}::DOUBLE) * pow({x}, {i})" for i, c in enumerate(coefficients))


def quantile(p: str) -> str:
    """Standard normal quantile."""
    q = f"({p} - 0.5)"
    rr = f"(0.180625 - {q} * {q})"
    s = f"sqrt(-ln(least({p}, 1 - {p})))"
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * ({poly(normal.MID_TOP, rr)}) / ({poly(normal.MID_BOTTOM, rr)}) "
        f"ELSE sign({q}) * CASE WHEN {s} <= 5 "
        f"THEN ({poly(normal.NEAR_TOP, f'({s} - 1.6)')}) / ({poly(normal.NEAR_BOTTOM, f'({s} - 1.6)')}) "
        f"ELSE ({poly(normal.FAR_TOP, f'({s} - 5)')}) / ({poly(normal.FAR_BOTTOM, f'({s} - 5)')}) END END"
    )


def summary(source: str, keys: str, value: str, extra: str = "") -> str:
    return (
        f"SELECT {keys}, {r(f'avg({value})', 'mean')}, {r(f'stddev_samp({value})', 'sd')}, "
        f"count(*) AS n, {r(f'stddev_samp({value}) / sqrt(count(*))', 'se')}{extra} FROM {source} GROUP BY {keys}"
    )


def stars(p: str) -> str:
    return (
        f"CASE WHEN {p} <= 1e-4 THEN '****' WHEN {p} <= 1e-3 THEN '***' WHEN {p} <= 0.01 THEN '**' "
        f"WHEN {p} <= 0.05 THEN '*' WHEN {p} IS NOT NULL THEN 'ns' END"
    )


# ---------------------------------------------------------------- rank test building blocks


def ranks(source: str, keys: str, group: str, value: str) -> str:
    """CTEs ranked, grp (group sizes and rank sums) and tot (slice size and tie sum). `keys` may be empty."""
    part = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""ranked AS (
      SELECT {k}{group} AS g, rank() OVER ({part} ORDER BY {value})
             + (count(*) OVER (PARTITION BY {k}{value}) - 1) / 2.0 AS rk,
             count(*) OVER (PARTITION BY {k}{value})::DOUBLE AS t
      FROM {source} WHERE {value} IS NOT NULL),
    grp AS (SELECT {k}g, count(*) AS size, sum(rk) AS rs FROM ranked GROUP BY {k}g),
    tot AS (SELECT {k}count(*)::DOUBLE AS n, sum(t * t - 1) AS ties, count(DISTINCT g) AS k FROM ranked {by})"""


def kruskal_cte(source: str, keys: str, group: str, value: str) -> str:
    k = f"{keys}, " if keys else ""
    join = f"USING ({keys})" if keys else "ON true"
    extra = f"GROUP BY {k}n, ties, k"
    return f"""{ranks(source, keys, group, value)},
    kw AS (SELECT {k}n, ties, k,
             (12 / (n * (n + 1)) * sum(rs * rs / size) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h
           FROM grp JOIN tot {join} {extra})"""


def kruskal_sql(source: str, keys: str, group: str, value: str, head: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""WITH {head}{kruskal_cte(source, keys, group, value)}
    SELECT {k}n::BIGINT AS n, k AS groups, {r('h', 'statistic')}, k - 1 AS df, {r(chi2('h', '(k - 1)'), 'p')}
    FROM kw"""


def adjust(source: str, keys: str, columns: str) -> str:
    """BH over `source` with column p."""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""bh1 AS (SELECT *, row_number() OVER ({part} ORDER BY p) AS i, count(*) OVER ({part}) AS m FROM {source}),
    bh AS (SELECT {columns}, least(1.0, min(p * m / i) OVER ({part} ORDER BY i
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj FROM bh1)"""


def dunn_cte(source: str, keys: str, group: str, value: str) -> str:
    k = f"{keys}, " if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    a = ", ".join(f"a.{c.strip()}" for c in keys.split(",")) + ", " if keys else ""
    return f"""{ranks(source, keys, group, value)},
    zz AS (SELECT {a}a.g AS g1, b.g AS g2,
             (a.rs / a.size - b.rs / b.size)
             / sqrt((n * (n + 1) / 12 - ties / (12 * (n - 1))) * (1.0 / a.size + 1.0 / b.size)) AS z
           FROM grp a JOIN grp b {using + (' AND ' if 'ON' in using else '')}{'' if 'ON' in using else ''}
           {('JOIN tot ' + using) if keys else 'a.g < b.g JOIN tot ON true'} {'WHERE a.g < b.g' if keys else ''}),
    raw AS (SELECT *, {tail2('z')} AS p FROM zz),
    {adjust('raw', keys, f'{k}g1, g2, z, p')}"""


def ranksum_cte(source: str, keys: str, group: str, value: str, only: str = "a.g < b.g") -> str:
    """CTE raw: rank-sum statistic, z and p for pairs, from cumulative value counts."""
    k = f"{keys}, " if keys else ""
    ak = ", ".join(f"a.{c.strip()}" for c in keys.split(",")) + ", " if keys else ""
    same = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in keys.split(",")) + " AND " if keys else ""
    slices = f"(SELECT DISTINCT {k}g FROM vc)"
    values = f"(SELECT DISTINCT {k}v FROM vc)"
    grid_on = " AND ".join(f"s.{c.strip()} = w.{c.strip()}" for c in keys.split(",")) if keys else "true"
    sk = ", ".join(f"s.{c.strip()}" for c in keys.split(",")) + ", " if keys else ""
    vc_on = " AND ".join([f"vc.{c.strip()} = s.{c.strip()}" for c in keys.split(",")] if keys else ["true"])
    return f"""vc AS (SELECT {k}{group} AS g, {value} AS v, count(*)::DOUBLE AS c FROM {source}
                    WHERE {value} IS NOT NULL GROUP BY {k}{group}, {value}),
    grid AS (SELECT {sk}s.g, w.v, coalesce(vc.c, 0) AS c
             FROM {slices} s JOIN {values} w ON {grid_on}
             LEFT JOIN vc ON {vc_on} AND vc.g = s.g AND vc.v = w.v),
    cum AS (SELECT *, sum(c) OVER (PARTITION BY {k}g ORDER BY v) AS upto, sum(c) OVER (PARTITION BY {k}g) AS size
            FROM grid),
    u AS (SELECT {ak}a.g AS g1, b.g AS g2, max(a.size) AS n1, max(b.size) AS n2,
                 sum(a.c * (b.upto - b.c / 2)) AS w, sum(pow(a.c + b.c, 3) - (a.c + b.c)) AS ties
          FROM cum a JOIN cum b ON {same}a.v = b.v AND {only} GROUP BY {ak}a.g, b.g),
    zz AS (SELECT *, sign(w - n1 * n2 / 2) * greatest(abs(w - n1 * n2 / 2) - 0.5, 0)
             / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u),
    raw AS (SELECT *, {tail2('z')} AS p FROM zz)"""


def letters_cte(keys: str) -> str:
    """CTEs from bh(keys, g1, g2, p_adj) to letters(keys, g, letters), by listing every set of levels."""
    k = [c.strip() for c in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in k)
    cols = lambda a: ", ".join(f"{a}.{c}" for c in k)
    return f"""lev AS (SELECT {keys}, g, row_number() OVER (PARTITION BY {keys} ORDER BY g) - 1 AS ix
             FROM (SELECT {keys}, g1 AS g FROM bh UNION SELECT {keys}, g2 AS g FROM bh)),
    sig AS (SELECT {cols('bh')}, (1::BIGINT << a.ix::INTEGER) + (1::BIGINT << b.ix::INTEGER) AS pair
            FROM bh JOIN lev a ON {on('a', 'bh')} AND a.g = bh.g1 JOIN lev b ON {on('b', 'bh')} AND b.g = bh.g2
            WHERE bh.p_adj < 0.05),
    cnt AS (SELECT {keys}, count(*) AS k FROM lev GROUP BY {keys}),
    masks AS (SELECT {keys}, k, unnest(range(1, (1::BIGINT << k::INTEGER))) AS mask FROM cnt),
    okay AS (SELECT * FROM masks m WHERE NOT EXISTS (
               SELECT 1 FROM sig WHERE {on('sig', 'm')} AND (m.mask & sig.pair) = sig.pair)),
    largest AS (SELECT * FROM okay m WHERE NOT EXISTS (
               SELECT 1 FROM okay o WHERE {on('o', 'm')} AND o.mask <> m.mask AND (o.mask & m.mask) = m.mask)),
    named AS (SELECT {cols('m')}, m.mask, string_agg(lev.ix::VARCHAR, '' ORDER BY lev.ix) AS members
              FROM largest m JOIN lev ON {on('lev', 'm')} AND (m.mask >> lev.ix::INTEGER) % 2 = 1
              GROUP BY {cols('m')}, m.mask),
    lettered AS (SELECT *, chr((96 + row_number() OVER (PARTITION BY {keys} ORDER BY members))::INTEGER) AS letter
                 FROM named),
    letters AS (SELECT {cols('lev')}, lev.g, string_agg(m.letter, '' ORDER BY m.letter) AS letters
                FROM lev JOIN lettered m ON {on('lev', 'm')} AND (m.mask >> lev.ix::INTEGER) % 2 = 1
                GROUP BY {cols('lev')}, lev.g)"""


# ---------------------------------------------------------------- linear model building blocks


def oneway_cte(source: str, keys: str, group: str, value: str) -> str:
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    return f"""gm AS (SELECT {k}{group} AS g, count(*) AS n, avg({value}) AS m, var_pop({value}) AS v
            FROM {source} GROUP BY {k}{group}),
    gt AS (SELECT {k}sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS grand FROM gm {by}),
    ow AS (SELECT {k}max(nn)::BIGINT AS n, (max(k) - 1)::BIGINT AS df_group,
             sum(n * (m - grand) * (m - grand)) AS ss_group,
             (max(nn) - max(k))::BIGINT AS df_resid, sum(n * v) AS ss_resid
           FROM gm JOIN gt {using} {by}),
    owf AS (SELECT *, ss_group / df_group AS ms_group, ss_resid / df_resid AS ms_resid,
              (ss_group / df_group) / (ss_resid / df_resid) AS f FROM ow)"""


def oneway_select(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return (
        f"SELECT {k}n, df_group, {r('ss_group', 'ss_group', 4)}, {r('ms_group', 'ms_group', 4)}, df_resid, "
        f"{r('ss_resid', 'ss_resid', 4)}, {r('ms_resid', 'ms_resid', 4)}, {r('f', 'f', 4)}, "
        f"{r(f_tail('f', 'df_group', 'df_resid'), 'p', 4)} FROM owf"
    )


def levene_sql(source: str, keys: str, group: str, value: str, head: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""WITH {head}med AS (SELECT {k}{group}, median({value}) AS md FROM {source} GROUP BY {k}{group}),
    dist AS (SELECT {k}{group}, abs({value} - md) AS d FROM {source} JOIN med USING ({k}{group})),
    {oneway_cte('dist', keys, group, 'd')} {oneway_select(keys)}"""


# ---------------------------------------------------------------- normality


def shapiro_sql(source: str, keys: str, value: str, head: str = "") -> str:
    """W from explicit weights per row."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    last = "(-2.706056 * pow(u, 5) + 4.434685 * pow(u, 4) - 2.071190 * pow(u, 3) - 0.147981 * u * u + 0.221157 * u + mn / sqrt(ss))"
    second = "(-3.582633 * pow(u, 5) + 5.682633 * pow(u, 4) - 1.752461 * pow(u, 3) - 0.293762 * u * u + 0.042981 * u + mp / sqrt(ss))"
    small = (
        "(-ln(-2.273 + 0.459 * n - ln(1 - w)) - (0.5440 - 0.39978 * n + 0.025054 * n * n - 0.0006714 * n * n * n))"
        " / exp(1.3822 - 0.77857 * n + 0.062767 * n * n - 0.0020322 * n * n * n)"
    )
    large = (
        "(ln(1 - w) - (-1.5861 - 0.31082 * ln(n) - 0.083751 * pow(ln(n), 2) + 0.0038915 * pow(ln(n), 3)))"
        " / exp(-0.4803 - 0.082676 * ln(n) + 0.0030302 * pow(ln(n), 2))"
    )
    p = (
        f"CASE WHEN n = 3 THEN 6 / pi() * (asin(sqrt(least(w, 1))) - asin(sqrt(0.75))) WHEN w >= 1 THEN 1 "
        f"ELSE {tail1('z')} END"
    )
    return f"""WITH {head}base AS (SELECT {k}{value} AS x FROM {source} WHERE {value} IS NOT NULL),
    o AS (SELECT {k}x, row_number() OVER ({part} ORDER BY x) AS i, count(*) OVER ({part})::DOUBLE AS n,
            avg(x) OVER ({part}) AS xbar FROM base),
    m AS (SELECT *, {quantile('((i - 0.375) / (n + 0.25))')} AS m, 1 / sqrt(n) AS u,
            {quantile('((n - 0.375) / (n + 0.25))')} AS mn, {quantile('((n - 1.375) / (n + 0.25))')} AS mp FROM o),
    s AS (SELECT *, sum(m * m) OVER ({part}) AS ss FROM m),
    a AS (SELECT *, {last} AS an, {second} AS ap FROM s),
    f AS (SELECT *, CASE WHEN n > 5 THEN (ss - 2 * mn * mn - 2 * mp * mp) / (1 - 2 * an * an - 2 * ap * ap)
                    ELSE (ss - 2 * mn * mn) / (1 - 2 * an * an) END AS phi FROM a),
    wt AS (SELECT *, CASE WHEN n = 3 THEN (i - 2) * sqrt(0.5) WHEN i = n THEN an WHEN i = 1 THEN -an
             WHEN n > 5 AND i = n - 1 THEN ap WHEN n > 5 AND i = 2 THEN -ap
             WHEN phi > 0 THEN m / sqrt(phi) END AS wgt FROM f),
    ww AS (SELECT {k}max(n) AS n, pow(sum(wgt * x), 2) / nullif(sum((x - xbar) * (x - xbar)), 0) AS w FROM wt
           {'GROUP BY ' + keys if keys else ''}),
    sz AS (SELECT *, CASE WHEN n < 4 OR w >= 1 THEN NULL WHEN n <= 11 THEN {small} ELSE {large} END AS z
           FROM ww WHERE n >= 3),
    sizes AS (SELECT {k}count(x) AS n, CASE WHEN count(x) < 3 THEN 'fewer than 3 values'
                WHEN min(x) = max(x) THEN 'all values equal' WHEN count(x) > 5000 THEN 'p extrapolated beyond 5000 values' END AS reason
              FROM base {by}),
    joined AS (SELECT {k}sizes.n AS n, reason, CASE WHEN reason IS NULL OR reason LIKE 'p %' THEN w END AS w,
                 CASE WHEN reason IS NULL OR reason LIKE 'p %' THEN z END AS z
               FROM sizes LEFT JOIN (SELECT {k}w, z FROM sz) q {f'USING ({keys})' if keys else 'ON true'})
    SELECT {k}n, {r('w', 'w')}, {r(p, 'p')}, reason FROM joined"""


def qq_sql(source: str, keys: str, value: str, head: str = "", places: int = 6) -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    p = "((i - CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END) / (n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END))"
    return f"""WITH {head}o AS (SELECT {k}{value} AS x, row_number() OVER ({part} ORDER BY {value}) AS i,
      count(*) OVER ({part})::DOUBLE AS n FROM {source} WHERE {value} IS NOT NULL)
    SELECT {k}i, {r(quantile(p), 'theoretical', places)}, {r('x', 'sample', places)} FROM o"""


def inhibition_sql(max_keys: str, keys: str) -> str:
    return f"""WITH {ASSAY}, top AS (SELECT {max_keys}, max(diam_mm) AS top FROM assay GROUP BY {max_keys}),
    rows_ AS (SELECT assay.*, 100 * (top - diam_mm) / top AS perc_in FROM assay JOIN top USING ({max_keys}))
    {summary('rows_', keys, 'perc_in')}"""


RESID = """rs AS (SELECT *, avg(c_acctbal) OVER (PARTITION BY {keys}) AS fitted,
  count(*) OVER (PARTITION BY {keys}) AS cell FROM customer),
  sd AS (SELECT *, c_acctbal - fitted AS residual FROM rs),
  noise AS (SELECT sqrt(sum(residual * residual) / (count(*) - count(DISTINCT c_mktsegment))) AS s FROM sd),
  rr AS (SELECT sd.*, residual / (s * sqrt(1 - 1.0 / cell)) AS std_residual FROM sd, noise)"""

#: The strain label of each order priority.
LABELLED = """CASE substr(treatment, 1, 1) WHEN '1' THEN 'CTRL' WHEN '2' THEN 'JB543' WHEN '3' THEN 'JB524'
    WHEN '4' THEN 'JB624' WHEN '5' THEN 'JB767' END"""

CONFRONTATION = """plates AS (
  SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CTRL' WHEN '2' THEN 'JB543' WHEN '3' THEN 'JB524'
           WHEN '4' THEN 'JB624' WHEN '5' THEN 'JB767' END AS treatmnt,
         l_linestatus AS pathogen, l_returnflag AS experiment, l_discount AS iz, l_tax AS ydiam_mm,
         ((l_quantity + CAST(0.4 AS DOUBLE) * (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) + 5) / 2) * 2 - 5
           AS diam_mm
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
clean AS (SELECT *, max(diam_mm) OVER (PARTITION BY pathogen, experiment) AS max_diam FROM plates),
resp AS (SELECT *, 100 * (max_diam - diam_mm) / max_diam AS perc_in FROM clean)"""

RATINGS = """ratings AS (SELECT p_type AS treatment, p_brand, p_size % 5 + 1 AS rating_scale, count(*) AS total_rating
  FROM part GROUP BY p_type, p_brand, p_size % 5 + 1)"""

OMNIBUS_TWO = f"""ow2 AS (SELECT experiment, n, ties, g, size, rs FROM grp JOIN tot USING (experiment)),
  two AS (SELECT a.experiment, a.rs - a.size * (a.size + 1) / 2.0 AS w, a.size AS n1, b.size AS n2, a.n, a.ties
          FROM ow2 a JOIN ow2 b ON a.experiment = b.experiment AND a.g < b.g),
  z2 AS (SELECT *, sign(w - n1 * n2 / 2.0) * greatest(abs(w - n1 * n2 / 2.0) - 0.5, 0)
          / sqrt(n1 * n2 / 12.0 * (n + 1 - ties / (n * (n - 1)))) AS z FROM two)"""


def describe_sql(source: str, keys: str, value: str) -> str:
    return f"""WITH med AS (SELECT {keys}, median({value}) AS md, count({value}) AS n FROM {source} GROUP BY {keys}),
    o AS (SELECT {keys}, {value} AS x, md, n, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS i
          FROM {source} JOIN med USING ({keys})),
    tr AS (SELECT {keys}, avg(x) AS trimmed FROM o WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1) GROUP BY {keys}),
    dev AS (SELECT {keys}, 1.4826 * median(abs(x - md)) AS mad FROM o GROUP BY {keys})
    SELECT {keys}, count({value}) AS n, {r(f'avg({value})', 'mean')}, {r(f'stddev_samp({value})', 'sd')},
      {r('max(md)', 'median')}, {r('max(trimmed)', 'trimmed')}, {r('max(mad)', 'mad')}, {r(f'min({value})', 'min')},
      {r(f'max({value})', 'max')}, {r(f'max({value}) - min({value})', 'range')},
      {r(f'skewness({value})', 'skew')}, {r(f'kurtosis({value})', 'kurtosis')},
      {r(f'stddev_samp({value}) / sqrt(count({value}))', 'se')}
    FROM {source} JOIN med USING ({keys}) JOIN tr USING ({keys}) JOIN dev USING ({keys}) GROUP BY {keys}"""


def yearly_cte(key: str) -> str:
    return f"""m AS (SELECT {key}, d.day, avg(CASE WHEN extract(year FROM o_orderdate) = 1994 + d.day THEN o_totalprice END) AS price
                 FROM orders, (SELECT unnest(range(1, 8))::INTEGER AS day) d GROUP BY 1, 2)"""


def factorial_sql(source: str, factors: list[str], value: str, keys: str = "", interactions: bool = True, head: str = "") -> str:
    """Sequential sums of squares by orthogonalising the weighted cell vectors of the columns one after the other."""
    from itertools import combinations

    k = f"{keys}, " if keys else ""
    top = len(factors) if interactions else 1
    terms = [c for size in range(1, top + 1) for c in combinations(factors, size)]
    sl = keys or "0"
    parts = ["SELECT s, cid, 0 AS t, '' AS lev, sqrt(n) AS x FROM num"]
    parts += [f"SELECT s, cid, {i}, concat_ws('|', {', '.join(t)}), sqrt(n) FROM num" for i, t in enumerate(terms, 1)]
    names = ", ".join(f"({i}, '{':'.join(t)}')" for i, t in enumerate(terms, 1)) + f", ({len(terms) + 1}, 'Residuals')"
    back = f"s AS {keys}, " if keys else ""
    return f"""WITH RECURSIVE {head}cell AS (SELECT {sl} AS s, {', '.join(factors)}, count(*) AS n, avg({value}) AS m, count(*) * var_pop({value}) AS v
             FROM {source} WHERE {value} IS NOT NULL GROUP BY {k}{', '.join(factors)}),
    num AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY {', '.join(factors)}) AS cid,
              m - sum(n * m) OVER (PARTITION BY s) / sum(n) OVER (PARTITION BY s) AS gap FROM cell),
    cc AS ({' UNION ALL '.join(parts)}),
    col AS (SELECT s, t, lev, row_number() OVER (PARTITION BY s ORDER BY t, lev) - 1 AS c FROM (SELECT DISTINCT s, t, lev FROM cc)),
    vec AS (SELECT col.s, col.c, col.t, list(coalesce(cc.x, 0.0) ORDER BY num.cid) AS x
            FROM col JOIN num ON num.s = col.s LEFT JOIN cc ON cc.s = col.s AND cc.t = col.t AND cc.lev = col.lev AND cc.cid = num.cid
            GROUP BY ALL
            UNION ALL SELECT s, 1000000, -1, list(sqrt(n) * gap ORDER BY cid) FROM num GROUP BY s),
    g AS (SELECT 0 AS step, s, c, t, x, list_dot_product(x, x) AS w0 FROM vec
          UNION ALL
          SELECT g.step + 1, g.s, g.c, g.t,
            CASE WHEN list_dot_product(q.x, q.x) > 1e-9 * q.w0 THEN
              list_transform(list_zip(g.x, q.x), lambda z: z[1] - z[2] * (list_dot_product(g.x, q.x) / list_dot_product(q.x, q.x)))
            ELSE g.x END, g.w0
          FROM g JOIN g q ON q.s = g.s AND q.c = g.step AND g.c > g.step),
    piv AS (SELECT q.s, q.t, list_dot_product(q.x, q.x) > 1e-9 * q.w0 AS used,
              pow(list_dot_product(y.x, q.x), 2) / nullif(list_dot_product(q.x, q.x), 0) AS ss
            FROM g q JOIN g y ON y.s = q.s AND y.step = q.step AND y.c = 1000000 WHERE q.c = q.step AND q.t > 0),
    tt AS (SELECT s, t, count(*) FILTER (used) AS df, coalesce(sum(ss) FILTER (used), 0) AS ss FROM piv GROUP BY s, t),
    tot AS (SELECT s, sum(n) AS n, sum(v) AS within, sum(n * gap * gap) AS between FROM num GROUP BY s),
    res AS (SELECT s, any_value(n) - 1 - sum(df) AS dfr, any_value(within) + greatest(0, any_value(between) - sum(ss)) AS ssr
            FROM tot JOIN tt USING (s) GROUP BY s),
    al AS (SELECT s, t, df, ss, (ss / nullif(df, 0)) / (ssr / dfr) AS f, dfr FROM tt JOIN res USING (s)
           UNION ALL SELECT s, {len(terms) + 1}, dfr, ssr, NULL, dfr FROM res)
    SELECT {back}term, t::INTEGER AS term_ord, df::BIGINT AS df, {r('ss', 'ss', 4)}, {r('ss / nullif(df, 0)', 'ms', 4)}, {r('f', 'f', 4)},
      {r(f_tail('f', 'df', 'dfr'), 'p', 4)} FROM al JOIN (VALUES {names}) nm(t, term) USING (t)"""


def build() -> dict[str, str]:
    a = f"WITH {ASSAY}"
    sql: dict[str, str] = {}
    sql["inhibition_summary"] = inhibition_sql(BY, f"{BY}, treatment")
    sql["inhibition_pooled_max"] = inhibition_sql("pathogen", "pathogen, treatment")
    sql["inhibition_experiment_max_pooled"] = inhibition_sql(BY, "pathogen, treatment")
    sql["inhibition_rows"] = f"""
      SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag, {r('l_quantity', 'l_quantity')},
        {r('max(l_quantity) OVER w', 'max_diam')},
        {r('100 * (max(l_quantity) OVER w - l_quantity) / max(l_quantity) OVER w', 'perc_in')}
      FROM lineitem WINDOW w AS (PARTITION BY l_linestatus, l_returnflag)"""
    stats = (
        f"{r('avg(diam_mm)', 'mean')}, {r('stddev_samp(diam_mm)', 'sd')}, count(*) AS n, "
        f"{r('stddev_samp(diam_mm) / sqrt(count(*))', 'se')}"
    )
    sql["sliced_and_pooled"] = f"""{a} SELECT pathogen, experiment, treatment, grouping(experiment)::INTEGER AS pooled,
      {stats} FROM assay
      GROUP BY GROUPING SETS ((pathogen, experiment, treatment), (pathogen, treatment))"""
    sql["treatment_summary"] = f"{a} {summary('assay', f'{BY}, treatment', 'value2')}"
    sql["transforms"] = f"""
      SELECT l_orderkey, l_linenumber, {r('d', 'diam_mm')},
        {r('CASE WHEN d > 0 THEN log10(CASE WHEN d > 0 THEN d ELSE 1 END) END', 'log_diam')},
        {r('CASE WHEN d >= 0 THEN sqrt(CASE WHEN d >= 0 THEN d ELSE 0 END) END', 'sqrt_diam')},
        {r('log10(greatest(d, 0) + 1)', 'log1_diam')}
      FROM (SELECT l_orderkey, l_linenumber, l_quantity - 5 AS d FROM lineitem)"""
    sql["window_aggregates"] = f"""
      SELECT event_id, event_type, {r('value', 'value')}, {r('max(value) OVER (PARTITION BY event_type)', 'top')},
        {r('avg(value) OVER (PARTITION BY event_type)', 'average')} FROM events"""
    sql["recode_labels"] = """
      SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'car' WHEN 'BUILDING' THEN 'house'
        WHEN 'MACHINERY' THEN 'machine' END AS label FROM customer"""
    sql["recode_from_table"] = """
      SELECT c_custkey, c_nationkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""
    sql["derived_columns"] = f"""
      SELECT l_orderkey, l_linenumber, {r('l_quantity', 'l_quantity')}, {r('l_discount', 'l_discount')},
        {r('l_quantity * 2 - 5', 'diam')}, {r('l_quantity * 2', 'doubled')},
        {r('l_quantity * l_discount', 'weighted')} FROM lineitem"""
    sql["select_positions"] = "SELECT p_partkey, p_brand FROM part"
    sql["drop_columns"] = "SELECT s_suppkey, s_nationkey FROM supplier"
    sql["keep_columns"] = "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders"
    sql["move_and_rename"] = (
        "SELECT s_suppkey, s_acctbal AS balance, s_name AS supplier_name, s_nationkey FROM supplier"
    )
    sql["clean_names"] = (
        "SELECT s_suppkey AS supplier_key, s_name AS supplier_key_2, s_nationkey AS nation_key_id, "
        "s_acctbal AS percent_balance FROM supplier"
    )
    sql["factor_levels"] = """
      SELECT o_orderkey, o_orderstatus, o_orderpriority,
        (dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority))::INTEGER AS level_ord FROM orders"""
    sql["level_order"] = """
      SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2
        WHEN '1-URGENT' THEN 3 END AS level_ord FROM orders"""
    sql["reorder_levels"] = """
      WITH m AS (SELECT o_orderpriority, median(o_totalprice) AS md FROM orders GROUP BY 1),
      p AS (SELECT o_orderpriority, (row_number() OVER (ORDER BY md DESC, o_orderpriority))::INTEGER AS level_ord FROM m)
      SELECT o_orderkey, o_orderpriority, o_totalprice, level_ord FROM orders JOIN p USING (o_orderpriority)"""
    sql["level_medians"] = f"""
      WITH m AS (SELECT c_mktsegment, median(c_acctbal) AS md FROM customer GROUP BY 1)
      SELECT c_mktsegment, {r('md', 'median')}, (row_number() OVER (ORDER BY md DESC, c_mktsegment))::INTEGER AS level_ord FROM m"""
    sql["to_long"] = """
      SELECT l_orderkey, l_linenumber, 'l_discount' AS measure, l_discount AS value FROM lineitem UNION ALL
      SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem UNION ALL
      SELECT l_orderkey, l_linenumber, 'l_quantity', l_quantity FROM lineitem"""
    sql["baseline_delta"] = f"""
      WITH days AS (SELECT unnest(range(1, 8)) AS day), sup AS (SELECT DISTINCT l_suppkey FROM lineitem),
      m AS (SELECT l_suppkey, l_linenumber AS day, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)
      SELECT sup.l_suppkey, days.day::INTEGER AS day, {r('b.price - m.price', 'weight', 4)}
      FROM sup CROSS JOIN days LEFT JOIN m ON m.l_suppkey = sup.l_suppkey AND m.day = days.day
      LEFT JOIN m b ON b.l_suppkey = sup.l_suppkey AND b.day = 1"""
    sql["baseline_delta_long"] = f"""
      SELECT user_id, event_id, {r('value', 'value')},
        {r('first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) - value', 'delta')} FROM events"""
    sql["filter_slice"] = """
      SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag FROM lineitem
      WHERE l_linestatus = 'F' AND l_returnflag = 'A'"""
    sql["filters_in_notnull_range"] = """
      SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders
      WHERE o_orderpriority IS NOT NULL AND o_orderstatus <> 'P'
        AND o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW') AND o_totalprice > 100000"""
    sql["filter_factor_number"] = """
      SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS dpi, l_quantity FROM lineitem WHERE l_linenumber = 7"""
    sql["flag_threshold"] = (
        "SELECT event_id, value, CASE WHEN value < 20 THEN 0 WHEN value >= 20 THEN 1 END AS present FROM events"
    )
    first = "row_number() OVER (PARTITION BY {} ORDER BY event_id) AS i"
    sql["distinct_first_count"] = f"""
      SELECT event_type, count(*) AS n FROM (SELECT event_type, {first.format('user_id')} FROM events
        WHERE user_id IS NOT NULL AND event_type <> 'purchase') WHERE i = 1 GROUP BY event_type"""
    sql["distinct_first_rows"] = f"""
      SELECT event_id, user_id, event_type, value FROM (
        SELECT *, {first.format('user_id, event_type')} FROM events) WHERE i = 1"""
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    sql["profile"] = " UNION ALL ".join(
        f"SELECT {i + 1}::INTEGER AS position, '{c}' AS \"column\", count(*) AS \"rows\", count({c}) AS non_null FROM customer"
        for i, c in enumerate(names)
    )
    sql["staged_reread"] = (
        "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_returnflag"
    )
    sql["csv_round_trip"] = summary("customer", "c_mktsegment", "c_acctbal")
    sql["sorted_report"] = (
        "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders "
        "GROUP BY o_orderpriority, o_orderstatus ORDER BY n DESC, o_orderpriority DESC"
    )
    sql["order_index"] = """
      SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS i,
        count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer"""
    sql["germination_rate"] = f"""
      SELECT source, lang, {r('avg(quality)', 'mean')}, {r('stddev_samp(quality)', 'sd')}, count(*) AS n,
        {r('stddev_samp(quality) / sqrt(count(*))', 'se')}, {r('100.0 * sum(quality) / count(*) + 0.5', 'rate')}
      FROM documents JOIN labels USING (doc_id) GROUP BY source, lang"""
    sql["incidence"] = f"""{a} SELECT treatment, pathogen, count(*) AS n,
      {r('100.0 * sum(CASE WHEN diam_mm < 10 THEN 0 ELSE 1 END) / count(*)', 'incidence')}
      FROM assay GROUP BY treatment, pathogen"""
    sql["severity_index"] = f"""WITH {RATINGS} SELECT treatment, count(*) AS n, max(rating_scale) AS max_rating,
      {r('100.0 * sum(rating_scale * total_rating) / (sum(total_rating) * max(rating_scale))', 'dis_sev')}
      FROM ratings GROUP BY treatment"""
    sql["severity_window"] = f"""WITH {RATINGS} SELECT treatment, p_brand, rating_scale, total_rating,
      (rating_scale * total_rating)::BIGINT AS num_ratings, max(rating_scale) OVER w AS max_rating,
      {r('100.0 * sum(rating_scale * total_rating) OVER w / (sum(total_rating) OVER w * max(rating_scale) OVER w)',
         'dis_sev')} FROM ratings WINDOW w AS (PARTITION BY treatment)"""
    sql["prescreen_summary"] = (
        f"WITH d AS (SELECT p_brand, p_type, p_size, p_retailprice * 2 AS diam_mm FROM part) "
        f"{summary('d', 'p_brand, p_type, p_size', 'diam_mm')}"
    )
    sql["summary_stats"] = f"""SELECT event_type, count(value) AS n, {r('avg(value)', 'mean')},
      {r('stddev_samp(value)', 'sd')} FROM events GROUP BY event_type"""
    sql["mean_se"] = f"""{a}, s AS (SELECT pathogen, treatment, experiment, avg(diam_mm) AS m, stddev_samp(diam_mm) AS sd,
      count(*) AS n FROM assay GROUP BY ALL)
      SELECT pathogen, treatment, experiment, {r('m', 'mean')}, {r('sd', 'sd')}, n, {r('sd / sqrt(n)', 'se')},
        {r('m - sd / sqrt(n)', 'ymin')}, {r('m + sd / sqrt(n)', 'ymax')} FROM s"""
    sql["describe"] = describe_sql("events", "event_type", "value")
    sql["shape_stats"] = f"""{a} SELECT {BY}, count(value2) AS n, {r('skewness(value2)', 'skew')},
      {r('kurtosis(value2)', 'kurtosis')} FROM assay GROUP BY {BY}"""
    sql["quantiles"] = f"""{a} SELECT {BY}, {r('quantile_cont(value2, 0.25)', 'q1')}, {r('median(value2)', 'median')},
      {r('quantile_cont(value2, 0.9)', 'q9')} FROM assay GROUP BY {BY}"""
    sql["midrank"] = """
      SELECT l_linestatus, l_returnflag, l_quantity, count(*) AS n, min(rk) + (count(*) - 1) / 2.0 AS midrank
      FROM (SELECT *, rank() OVER (PARTITION BY l_linestatus, l_returnflag ORDER BY l_quantity) AS rk FROM lineitem)
      GROUP BY l_linestatus, l_returnflag, l_quantity"""
    sql["outliers"] = """
      WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b
                 FROM events GROUP BY event_type)
      SELECT event_id, event_type, value, true AS is_outlier, (value < a - 3 * (b - a) OR value > b + 3 * (b - a)) AS is_extreme
      FROM events JOIN q USING (event_type) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)"""
    sql["anova_oneway"] = f"{a}, {oneway_cte('assay', BY, 'treatment', 'diam_shift')} {oneway_select(BY)}"
    sql["levene"] = levene_sql("events", "", "event_type", "value")
    sql["levene_sliced"] = levene_sql("assay", BY, "treatment", "diam_shift", ASSAY + ", ")
    sql["anova_factorial_ends"] = f"""{a},
      c AS (SELECT treatment, pathogen, experiment, count(*) AS n, avg(diam_shift) AS m, var_pop(diam_shift) AS v
            FROM assay GROUP BY ALL),
      t AS (SELECT treatment, sum(n * m) / sum(n) AS tm FROM c GROUP BY 1),
      g AS (SELECT sum(n * m) / sum(n) AS grand FROM c)
      SELECT sum(n)::BIGINT AS n, count(*) AS cells, {r('sum(n * (tm - grand) * (tm - grand))', 'ss_first', 4)},
        {r('sum(n * (m - grand) * (m - grand))', 'ss_cells', 4)}, {r('sum(n * v)', 'ss_resid', 4)},
        (sum(n) - count(*))::BIGINT AS df_resid FROM c JOIN t USING (treatment), g"""
    # the second factor has two levels, so its sequential sum of squares is one projection
    sql["anova_two_factors"] = f"""{a},
      y AS (SELECT treatment, pathogen, diam_shift AS y, avg(diam_shift) OVER () AS g,
              avg(diam_shift) OVER (PARTITION BY treatment) AS tm,
              avg(diam_shift) OVER (PARTITION BY treatment, pathogen) AS cm,
              (pathogen = 'F')::INTEGER - avg((pathogen = 'F')::INTEGER) OVER (PARTITION BY treatment) AS b FROM assay),
      s AS (SELECT count(*) AS n, count(DISTINCT treatment) AS k, sum((tm - g) * (tm - g)) AS sa,
              pow(sum(b * (y - g)), 2) / sum(b * b) AS sb, sum((cm - g) * (cm - g)) AS sc,
              sum((y - cm) * (y - cm)) AS sr FROM y),
      t AS (SELECT 'treatment' AS term, 1 AS term_ord, k - 1 AS df, sa AS ss, n, k, sr FROM s UNION ALL
            SELECT 'pathogen', 2, 1, sb, n, k, sr FROM s UNION ALL
            SELECT 'treatment:pathogen', 3, k - 1, sc - sa - sb, n, k, sr FROM s UNION ALL
            SELECT 'Residuals', 4, n - 2 * k, sr, n, k, NULL FROM s),
      f AS (SELECT *, (ss / df) / (sr / (n - 2 * k)) AS f FROM t)
      SELECT term, term_ord::INTEGER AS term_ord, df::BIGINT AS df, {r('ss', 'ss', 4)}, {r('ss / df', 'ms', 4)},
        {r('f', 'f', 4)}, {r(f_tail('f', 'df', '(n - 2 * k)'), 'p', 4)} FROM f"""
    resid = RESID.format(keys="c_mktsegment")
    sql["residuals"] = f"""WITH {resid} SELECT c_custkey, c_mktsegment, {r('c_acctbal', 'c_acctbal')},
      {r('fitted', 'fitted')}, {r('residual', 'residual')}, {r('std_residual', 'std_residual')} FROM rr"""
    sql["resid_data"] = f"""{a}, f AS (SELECT *, avg(value2) OVER (PARTITION BY {BY}, treatment) AS fitted FROM assay)
      SELECT {BY}, {r('fitted', 'fitted', 4)}, {r('value2 - fitted', 'residual', 4)} FROM f"""
    pear = f"""c AS (SELECT {{k}}, count(*) AS n, corr(diam_mm, value2) AS r FROM {{s}} GROUP BY {{k}}),
      tt AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c)"""
    sql["pearson"] = f"""{a}, {pear.format(k=BY, s='assay')} SELECT {BY}, n, {r('r', 'r')}, {r('t', 't')},
      n - 2 AS df, {r(f_tail('(t * t)', '1', '(n - 2)'), 'p')} FROM tt"""
    sql["ols_line"] = f"""{a} SELECT {BY}, regr_count(value2, diam_mm)::BIGINT AS n,
      {r('regr_slope(value2, diam_mm)', 'slope', 4)}, {r('regr_intercept(value2, diam_mm)', 'intercept', 4)},
      {r('regr_r2(value2, diam_mm)', 'r2', 4)}, {r('regr_avgx(value2, diam_mm)', 'x_mean', 4)},
      {r('regr_sxx(value2, diam_mm)', 'sxx', 4)}, {r('min(diam_mm)', 'x_min', 4)}, {r('max(diam_mm)', 'x_max', 4)},
      {r('sqrt((regr_syy(value2, diam_mm) - regr_slope(value2, diam_mm) * regr_sxy(value2, diam_mm)) / (count(*) - 2))',
         'resid_sd', 4)} FROM assay GROUP BY {BY}"""
    z = 1.959963984540054
    # expansion of the t quantile in 1 / df, exact to far more places than are compared
    tq = (
        f"({z} + {(z**3 + z) / 4!r} / v + {(5 * z**5 + 16 * z**3 + 3 * z) / 96!r} / (v * v)"
        f" + {(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384!r} / (v * v * v))"
    )
    sql["fit_band"] = f"""{a}, l AS (SELECT {BY}, count(*)::DOUBLE AS n, count(*) - 2.0 AS v,
        regr_slope(value2, diam_mm) AS b, regr_intercept(value2, diam_mm) AS i, avg(diam_mm) AS xm,
        regr_sxx(value2, diam_mm) AS sxx, min(diam_mm) AS x0, max(diam_mm) AS x1,
        sqrt((regr_syy(value2, diam_mm) - regr_slope(value2, diam_mm) * regr_sxy(value2, diam_mm)) / (count(*) - 2)) AS s
        FROM assay GROUP BY {BY}),
      grid AS (SELECT *, x0 + unnest(range(0, 80)) * ((x1 - x0) / 79.0) AS x FROM l),
      h AS (SELECT *, {tq} * s * sqrt(1 / n + (x - xm) * (x - xm) / sxx) AS half FROM grid)
      SELECT {BY}, {r('x', 'x', 4)}, {r('i + b * x', 'fit', 4)}, {r('i + b * x - half', 'lo', 4)},
        {r('i + b * x + half', 'hi', 4)} FROM h"""
    sql["kruskal"] = kruskal_sql("assay", BY, "treatment", "diam_shift", ASSAY + ", ")
    sql["kruskal_untied"] = kruskal_sql("assay", "pathogen", "experiment", "value2", ASSAY + ", ")
    ranksum = ranksum_cte("assay", BY, "treatment", "diam_shift")
    keep = f"{BY}, g1, g2, n1::BIGINT AS n1, n2::BIGINT AS n2, {r('w', 'w')}, {r('z', 'z')}, {r('p', 'p')}"
    sql["pairwise_ranksum"] = f"""{a}, {ranksum}, {adjust('raw', BY, f'{BY}, g1, g2, n1, n2, w, z, p')}
      SELECT {keep}, {r('p_adj', 'p_adj')} FROM bh"""
    dunn = dunn_cte("assay", BY, "treatment", "diam_shift")
    sql["dunn_bh"] = f"""{a}, {dunn} SELECT {BY}, g1, g2, {r('z', 'z')}, {r('p', 'p')}, {r('p_adj', 'p_adj')} FROM bh"""
    sql["group_pairs"] = """WITH d AS (SELECT DISTINCT c_nationkey, c_mktsegment AS g FROM customer)
      SELECT a.c_nationkey, a.g AS g1, b.g AS g2 FROM d a JOIN d b ON a.c_nationkey = b.c_nationkey AND a.g < b.g"""
    sql["vs_reference"] = "SELECT DISTINCT 'view' AS g1, event_type AS g2 FROM events WHERE event_type <> 'view'"
    lines_kw = kruskal_cte("lineitem", "l_linenumber", "l_returnflag", "l_quantity")
    sql["adjust_bh"] = f"""WITH {lines_kw}, raw AS (SELECT l_linenumber, {chi2('h', '(k - 1)')} AS p FROM kw),
      {adjust('raw', '', 'l_linenumber, p')} SELECT l_linenumber, {r('p', 'p')}, {r('p_adj', 'p_adj')} FROM bh"""
    mirrored = f"""SELECT {{k}}, g1, g2, p_adj FROM bh UNION ALL SELECT {{k}}, g2, g1, p_adj FROM bh UNION ALL
      SELECT DISTINCT {{k}}, g, g, 1.0 FROM grp"""
    sql["full_pairs"] = f"""{a}, {dunn}, fp AS ({mirrored.format(k=BY)})
      SELECT {BY}, g1, g2, {r('p_adj', 'p_adj')} FROM fp"""
    cell = "max(CASE WHEN g2 = '{0}' THEN p_adj END)"
    sql["pair_matrix"] = f"""{a}, {dunn_cte('assay', 'pathogen', 'experiment', 'diam_shift')},
      fp AS ({mirrored.format(k='pathogen')}) SELECT pathogen, g1, {r(cell.format('A'), '"A"')},
      {r(cell.format('N'), '"N"')}, {r(cell.format('R'), '"R"')} FROM fp GROUP BY pathogen, g1"""
    sql["compact_letters"] = f'{a}, {dunn}, {letters_cte(BY)} SELECT {BY}, g AS "group", letters FROM letters'
    sql["summary_with_letters"] = f"""{a}, {dunn}, {letters_cte(BY)},
      s AS ({summary('assay', f'{BY}, treatment', 'diam_shift')})
      SELECT s.*, letters FROM s JOIN letters l ON s.pathogen = l.pathogen AND s.experiment = l.experiment
        AND s.treatment = l.g"""
    ref_pairs = ranksum_cte("events", "", "event_type", "value", "a.g = 'view' AND b.g <> 'view'")
    sql["vs_reference_stars"] = f"""WITH {ref_pairs} SELECT g1, g2, n1::BIGINT AS n1, n2::BIGINT AS n2, {r('w', 'w')},
      {r('z', 'z')}, {r('p', 'p')}, {stars('p')} AS stars FROM raw"""
    urgent = ranksum_cte("assay", BY, "treatment", "diam_shift", "a.g = '1-URGENT' AND b.g <> '1-URGENT'")
    sql["compare_means"] = f"""{a}, {kruskal_cte('assay', BY, 'treatment', 'diam_shift')}, {urgent},
      every AS (SELECT {BY}, 'kruskal' AS method, NULL::VARCHAR AS g1, NULL::VARCHAR AS g2,
        {chi2('h', '(k - 1)')} AS p FROM kw UNION ALL SELECT {BY}, 'rank-sum', g1, g2, p FROM raw)
      SELECT {BY}, method, g1, g2, {r('p', 'p')}, {stars('p')} AS stars FROM every"""
    sql["compare_two_groups"] = f"""{a}, {ranks('assay', 'experiment', 'pathogen', 'diam_mm')}, {OMNIBUS_TWO}
      SELECT experiment, 'rank-sum' AS method, 2::BIGINT AS groups, {r(tail2('z'), 'p')} FROM z2"""
    sql["shapiro"] = shapiro_sql("customer", "", "c_acctbal")
    sql["shapiro_by_group"] = shapiro_sql("customer", "c_mktsegment", "c_acctbal")
    nation = RESID.format(keys="c_nationkey, c_mktsegment")
    sql["shapiro_residuals"] = shapiro_sql("rr", "c_nationkey", "residual", nation + ", ")
    sql["histogram"] = f"""
      WITH s AS (SELECT min(value) AS lo, (max(value) - min(value)) / 29.0 AS w FROM events),
      b AS (SELECT event_type, greatest(1, least(30, ceil((value - lo) / w + 0.5 - 1e-8)))::INTEGER AS bin FROM events, s),
      n AS (SELECT event_type, bin, count(*) AS c FROM b GROUP BY 1, 2),
      grid AS (SELECT event_type, unnest(range(1, 31))::INTEGER AS bin FROM (SELECT DISTINCT event_type FROM events))
      SELECT event_type, bin, {r('lo + (bin - 1.5) * w', 'lo')}, {r('lo + (bin - 0.5) * w', 'hi')},
        coalesce(c, 0)::BIGINT AS count FROM grid LEFT JOIN n USING (event_type, bin), s"""
    sql["boxplot"] = f"""
      WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS md,
                   quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
      e AS (SELECT event_type, value, q1, md, q3,
              value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events JOIN q USING (event_type))
      SELECT event_type, count(*) AS n, {r('min(value) FILTER (inside)', 'lower')}, {r('max(q1)', 'q1')},
        {r('max(md)', 'median')}, {r('max(q3)', 'q3')}, {r('max(value) FILTER (inside)', 'upper')},
        count(*) FILTER (NOT inside) AS outliers FROM e GROUP BY event_type"""
    sql["qq"] = qq_sql("events", "event_type", "value")
    sql["qq_residuals"] = qq_sql("rr", "", "std_residual", resid + ", ", 5)
    pooled = ranksum_cte("assay", "pathogen", "treatment", "diam_shift")
    bh_pooled = adjust("raw", "pathogen", "pathogen, g1, g2, p")
    sql["bars"] = f"""{a}, {pooled}, {bh_pooled}, {letters_cte('pathogen')},
      s AS (SELECT pathogen, treatment, avg(diam_shift) AS m, stddev_samp(diam_shift) / sqrt(count(*)) AS se
            FROM assay GROUP BY 1, 2)
      SELECT s.pathogen, treatment, {r('m', 'mean')}, {r('m - se', 'ymin')}, {r('m + se', 'ymax')}, letters AS label,
        6 - CAST(substr(treatment, 1, 1) AS INTEGER) AS ord
      FROM s JOIN letters l ON s.pathogen = l.pathogen AND s.treatment = l.g"""
    only = ranksum_cte("assay", "pathogen", "treatment", "diam_shift", "a.g = '1-URGENT' AND b.g <> '1-URGENT'")
    sql["grouped_bars"] = f"""{a}, {kruskal_cte('assay', 'pathogen', 'treatment', 'diam_shift')}, {only},
      md AS (SELECT pathogen, treatment, median(diam_shift) AS md FROM assay GROUP BY 1, 2),
      od AS (SELECT pathogen, treatment,
               (row_number() OVER (PARTITION BY pathogen ORDER BY md DESC, treatment))::INTEGER AS ord FROM md),
      s AS (SELECT pathogen, treatment, experiment, avg(diam_shift) AS m, stddev_samp(diam_shift) AS sd, count(*) AS n
            FROM assay GROUP BY ALL)
      SELECT s.pathogen, s.treatment, experiment, {r('m', 'mean')}, {r('sd', 'sd')}, s.n, {r('sd / sqrt(s.n)', 'se')},
        {r('m - sd / sqrt(s.n)', 'ymin')}, {r('m + sd / sqrt(s.n)', 'ymax')}, ord,
        {r(chi2('h', '(k - 1)'), 'p_omnibus')}, {r('raw.p', 'p')}, {stars('raw.p')} AS stars
      FROM s JOIN od ON od.pathogen = s.pathogen AND od.treatment = s.treatment JOIN kw ON kw.pathogen = s.pathogen
      LEFT JOIN raw ON raw.pathogen = s.pathogen AND raw.g2 = s.treatment"""
    sql["lines"] = f"""
      WITH {yearly_cte('o_orderpriority')}
      SELECT m.o_orderpriority, m.day, {r('b.price - m.price', 'weight', 4)} FROM m
      JOIN m b ON b.o_orderpriority = m.o_orderpriority AND b.day = 1"""
    sql["fermentation_lines"] = f"""
      WITH {yearly_cte('o_orderstatus')}
      SELECT m.o_orderstatus AS strain, m.day, {r('b.price - m.price', 'weight', 4)} FROM m
      JOIN m b ON b.o_orderstatus = m.o_orderstatus AND b.day = 1"""
    sql["scatter_label"] = f"""{a}, pos AS (SELECT * FROM assay WHERE diam_mm > 0), {pear.format(k='pathogen', s='pos')},
      pp AS (SELECT pathogen, r, {f_tail('(t * t)', '1', '(n - 2)')} AS p FROM tt)
      SELECT pathogen, {r('r', 'r')}, {r('p', 'p')}, {stars('p')} AS stars FROM pp"""
    sql["confrontation_clean"] = f"""WITH {CONFRONTATION} SELECT treatmnt, {BY}, count(*) AS n,
      {r('max(max_diam)', 'max_diam')}, {r('avg(perc_in)', 'perc_in')},
      {r('avg(CASE WHEN diam_mm > 0 THEN log10(CASE WHEN diam_mm > 0 THEN diam_mm ELSE 1 END) END)', 'log_fdiam')},
      {r('avg(sqrt(diam_mm))', 'sqrt_fdiam')}, {r('max(iz)', 'iz')}, {r('max(ydiam_mm)', 'ydiam_mm')}
      FROM resp GROUP BY treatmnt, {BY}"""
    conf = ranksum_cte("resp", "pathogen", "treatmnt", "perc_in")
    sql["confrontation_summary"] = f"""WITH {CONFRONTATION}, {conf}, {bh_pooled}, {letters_cte('pathogen')},
      s AS ({summary('resp', 'pathogen, treatmnt', 'perc_in')})
      SELECT s.*, letters FROM s JOIN letters l ON s.pathogen = l.pathogen AND s.treatmnt = l.g"""
    germ = "pathogen, yeast_id"
    base = "SELECT l_linestatus AS pathogen, l_returnflag AS yeast_id, '{0}' AS treatmnt, ({1})::INTEGER::DOUBLE AS value FROM lineitem"
    sql["germination_summary"] = f"""WITH g AS ({base.format('sdw', 'l_quantity > 25')} UNION ALL
        {base.format('wcs', 'l_discount > CAST(0.05 AS DOUBLE)')} UNION ALL
        {base.format('cfs', 'l_tax > CAST(0.05 AS DOUBLE)')}),
      {dunn_cte('g', germ, 'treatmnt', 'value')}, {letters_cte(germ)},
      s AS ({summary('g', f'{germ}, treatmnt', 'value', ', ' + r('100 * sum(value) / count(*) + 1', 'rate'))})
      SELECT s.*, letters FROM s JOIN letters l ON s.pathogen = l.pathogen AND s.yeast_id = l.yeast_id
        AND s.treatmnt = l.g"""
    sev = """sev AS (SELECT p_type AS pathogen, p_brand AS treatment,
      100.0 * sum((p_size % 5 + 1) * (p_partkey % 4 + 1)) / (sum(p_partkey % 4 + 1) * max(p_size % 5 + 1)) AS dis_sev
      FROM part GROUP BY 1, 2), """
    sql["anova_factorial"] = factorial_sql("assay", ["treatment", "pathogen", "experiment"], "diam_shift", head=ASSAY + ", ")
    some = """thinned AS (SELECT * FROM assay WHERE NOT (pathogen = 'F' AND treatment IN ('1-URGENT', '5-LOW'))
      AND NOT (experiment = 'R' AND treatment = '2-HIGH') AND NOT (experiment = 'N' AND pathogen = 'O' AND diam_mm > 9))"""
    sql["anova_empty_cells"] = factorial_sql("thinned", ["treatment", "pathogen", "experiment"], "diam_shift", head=f"{ASSAY}, {some}, ")
    sql["anova_sliced"] = factorial_sql("assay", ["experiment", "treatment"], "diam_shift", "pathogen", False, head=ASSAY + ", ")
    lesions = """les AS (SELECT ['357', '506', '707', '957', '461', 'none', 'other'][l_linenumber] AS treatment, l_quantity AS av_ld,
      CASE WHEN l_linestatus = 'F' THEN 'Botrytis' ELSE 'Colletotrichum' END AS pathogen,
      CASE WHEN l_returnflag = 'A' THEN '4' ELSE '7' END AS dpi FROM lineitem WHERE l_linenumber <= 5)"""
    sql["lesion_anova"] = factorial_sql("les", ["treatment", "pathogen", "dpi"], "av_ld", head=lesions + ", ")
    sql["lesion_kruskal"] = kruskal_sql("les", "pathogen", "treatment", "av_ld", lesions + ", ")
    sql["incidence_table"] = f"""WITH {lesions} SELECT treatment, pathogen, count(*) AS n,
      {r('100.0 * count(*) FILTER (av_ld >= 20) / count(*)', 'incidence')} FROM les WHERE dpi = '7' GROUP BY 1, 2"""
    sql["severity_rows"] = f"""WITH q AS (SELECT p_brand AS treatment, 7 AS dpi,
        CASE WHEN p_partkey % 2 = 0 THEN 'Botrytis' ELSE 'Colletotrichum' END AS pathogen,
        (p_size % 5 + 1)::DOUBLE AS rating_scale, (p_partkey % 4 + 1)::DOUBLE AS total_rating FROM part)
      SELECT *, rating_scale * total_rating AS num_ratings, max(rating_scale) OVER w AS max_rating,
        {r('100 * sum(rating_scale * total_rating) OVER w / (sum(total_rating) OVER w * max(rating_scale) OVER w)', 'dis_sev')}
      FROM q WINDOW w AS (PARTITION BY treatment, pathogen)"""
    sql["prescreen_table"] = f"""WITH q AS (SELECT p_brand AS sample, p_type AS isolate, p_size::VARCHAR AS name, 'Bc' AS pathogen,
        p_retailprice / 100 * 2 AS d FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 5 <> 0)
      {summary('q', 'sample, isolate, name, pathogen', 'd')}"""
    diam = f"""{ASSAY}, dm AS (SELECT pathogen, {LABELLED} AS treatmnt, diam_shift AS d FROM assay),
      resp AS (SELECT pathogen, treatmnt, 100 * (max(d) OVER (PARTITION BY pathogen) - d) / max(d) OVER (PARTITION BY pathogen) AS perc_in FROM dm)"""
    sql["diameter_summary"] = f"""WITH {diam}, {dunn_cte('resp', 'pathogen', 'treatmnt', 'perc_in')}, {letters_cte('pathogen')},
      s AS ({summary('resp', 'pathogen, treatmnt', 'perc_in')})
      SELECT s.*, letters FROM s JOIN letters l ON s.pathogen = l.pathogen AND s.treatmnt = l.g"""
    values = "SELECT l_linestatus AS pathogen, l_linenumber AS experiment, l_returnflag AS yeast_id, '{0}' AS treatmnt, {1} AS v FROM lineitem"
    rates = f"""rt AS (SELECT pathogen, experiment, yeast_id, treatmnt, 100 * sum(v) / count(*) AS rate FROM (
      {values.format('sdw', 'l_extendedprice')} UNION ALL {values.format('wcs', 'l_extendedprice * l_discount * 20')}) GROUP BY ALL)"""
    # of 20 orders of three and three values so many have a statistic up to 0, 1, ... 4
    exact = f"CASE WHEN ties = 0 AND n1 = 3 AND n2 = 3 THEN least(1.0, 2 * [1, 2, 4, 7, 10][least(w, 9 - w)::INTEGER + 1] / 20.0) ELSE p END"
    sql["rate_pairs"] = f"""WITH {rates}, {ranksum_cte('rt', 'pathogen, experiment', 'treatmnt', 'rate')},
      ex AS (SELECT * REPLACE ({exact} AS p) FROM raw), {adjust('ex', 'pathogen, experiment', '*')}
      SELECT pathogen, experiment, g1, g2, n1::BIGINT AS n1, n2::BIGINT AS n2, {r('w', 'w')}, {r('z', 'z')}, {r('p', 'p')}, {r('p_adj', 'p_adj')} FROM bh"""
    sql["p_values"] = f"""{a}, {oneway_cte('assay', BY, 'treatment', 'diam_shift')}
      SELECT {BY}, {r('f', 'f', 4)}, df_group, df_resid, {r(f_tail('f', 'df_group', 'df_resid'), 'p_f', 4)}, {r(f_tail('f', '1', 'df_resid'), 'p_t', 4)},
        {r(chi2('(f * df_group)', 'df_group'), 'p_chi2', 4)}, {r(tail2('sqrt(f)'), 'p_normal', 4)} FROM owf"""
    sql["adjust_bh_parts"] = f"""WITH pz AS (SELECT l_partkey, (avg(l_quantity) - 25.5) * sqrt(count(*)) / 14.43 AS z FROM lineitem GROUP BY 1),
      raw AS (SELECT l_partkey, {tail2('z')} AS p FROM pz), {adjust('raw', '', 'l_partkey, p')}
      SELECT l_partkey, {r('p', 'p')}, {r('p_adj', 'p_adj')} FROM bh"""
    sql["pairwise_ranksum_nations"] = f"""WITH {ranksum_cte('customer', '', 'c_nationkey', 'c_acctbal')}, {adjust('raw', '', 'g1, g2, n1, n2, w, z, p')}
      SELECT g1, g2, n1::BIGINT AS n1, n2::BIGINT AS n2, {r('w', 'w')}, {r('z', 'z')}, {r('p', 'p')}, {r('p_adj', 'p_adj')} FROM bh"""
    sql["nan_summary"] = f"""{a} SELECT {BY}, treatment, {r('avg(diam_mm)', 'mean')}, {r('stddev_samp(diam_mm)', 'sd')}, count(*) AS n,
      {r('stddev_samp(diam_mm) / sqrt(count(*))', 'se')} FROM assay WHERE diam_mm <= 45 GROUP BY {BY}, treatment"""
    sql["nan_inhibition"] = f"""{a}, low AS (SELECT * FROM assay WHERE diam_mm <= 45),
      q AS (SELECT {BY}, treatment, 100 * (max(diam_mm) OVER (PARTITION BY {BY}) - diam_mm) / max(diam_mm) OVER (PARTITION BY {BY}) AS x FROM low)
      {summary('q', f'{BY}, treatment', 'x')}"""
    sql["nan_flags"] = f"""{a}, q AS (SELECT treatment, pathogen, CASE WHEN diam_mm <= 45 THEN (diam_mm >= 10)::INTEGER END AS flag
        FROM assay WHERE treatment <> '5-LOW' OR value2 < 20000)
      SELECT treatment, pathogen, count(*) AS n, {r('CASE WHEN count(flag) = count(*) THEN 100.0 * sum(flag) / count(*) END', 'incidence')} FROM q GROUP BY 1, 2
      UNION ALL SELECT 'flag', flag::VARCHAR, count(*), NULL FROM q GROUP BY flag"""
    sql["declared_table"] = "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1"
    sql["partitioned_table"] = "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem WHERE l_returnflag = 'A'"
    sql["chart_table"] = f"""SELECT event_type, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')}, count(*) AS n,
      {r('stddev_samp(value) / sqrt(count(*))', 'se')}, {r('avg(value) - stddev_samp(value) / sqrt(count(*))', 'ymin')},
      {r('avg(value) + stddev_samp(value) / sqrt(count(*))', 'ymax')} FROM events GROUP BY 1"""
    sql["shapiro_ties"] = shapiro_sql("lineitem", "l_returnflag", "l_quantity")
    fills = ranksum_cte("assay", "pathogen, treatment", "experiment", "diam_shift", "a.g = 'A' AND b.g <> 'A'")
    sql["grouped_bars_fill"] = f"""{a}, {fills},
      md AS (SELECT pathogen, treatment, median(diam_shift) AS md FROM assay GROUP BY 1, 2),
      od AS (SELECT pathogen, treatment, (row_number() OVER (PARTITION BY pathogen ORDER BY md DESC, treatment))::INTEGER AS ord FROM md),
      s AS (SELECT pathogen, treatment, experiment, avg(diam_shift) AS m, count(*) AS n FROM assay GROUP BY ALL)
      SELECT s.pathogen, s.treatment, experiment, {r('m', 'mean')}, s.n, ord, {r('raw.p', 'fill_p')}, {stars('raw.p')} AS fill_stars
      FROM s JOIN od ON od.pathogen = s.pathogen AND od.treatment = s.treatment
      LEFT JOIN raw ON raw.pathogen = s.pathogen AND raw.treatment = s.treatment AND raw.g2 = s.experiment"""
    sql["scatter_points"] = f"{a} SELECT pathogen, diam_mm AS x, value2 AS y FROM assay WHERE diam_mm > 45"
    sql["scatter_band"] = sql["fit_band"].replace(BY, "pathogen")
    sql["germination_offsets"] = f"""
      SELECT lang, {r('avg(quality)', 'mean')}, {r('stddev_samp(quality)', 'sd')}, count(*) AS n,
        {r('stddev_samp(quality) / sqrt(count(*)) + 1', 'se')}, {r('100.0 * sum(quality) / count(*) + 1', 'rate')}
      FROM documents JOIN labels USING (doc_id) GROUP BY lang"""
    sql["severity_tests"] = kruskal_sql("sev", "", "pathogen", "dis_sev", sev)
    sql["screened_isolates"] = f"""
      SELECT event_type AS name, count(*) AS n FROM (SELECT event_type, {first.format('user_id')} FROM events
        WHERE event_type <> 'error' AND event_type <> 'signup') WHERE i = 1 GROUP BY event_type"""
    return sql


