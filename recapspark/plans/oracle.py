"""The same queries as DuckDB SQL over the same tables.

One chain of common table expressions leads from ``orders`` to clean captures; each
query adds its own end.
"""

from __future__ import annotations

from recapspark.sources.schema import CAPTURE_COLUMNS
from recapspark.sources.standin import CAPTURES_SQL, DRAWS_SQL


def six(expr: str, name: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(28,6)) AS DOUBLE) AS {name}"


def three(expr: str, name: str) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,12)), 3) AS DOUBLE) AS {name}"


CHAIN: list[tuple[str, str]] = [
    ("stand", CAPTURES_SQL.format(orders="orders")),
    (
        "draw0",
        """
SELECT Longitude, Latitude, SiteLen, Discharge, WaterTemp, GearType, TimeFish, FishNum,
  SpeciesCd, Length, Weight, Wild, Stage, MarkAppCd, MarkPreCd, Water, tblSL_SL_ID, Rep,
  "Date" AS dateC, day AS date, day + to_seconds(clock) AS dateTime,
  strftime(day, '%Y-%m') AS dateYM, clock AS timeSeconds,
  CASE SpeciesCd WHEN 326 THEN 'rainbow trout' WHEN 328 THEN 'brown trout'
       WHEN 329 THEN 'brook trout' END AS species,
  lower(coalesce(MarkAppCd, MarkPreCd)) AS tag, 1 AS enc
FROM (SELECT *, CAST(try_strptime("Date", '%d-%m-%Y') AS DATE) AS day,
        CAST(split_part("Time", ':', 1) AS INT) * 3600
        + CAST(split_part("Time", ':', 2) AS INT) * 60
        + CAST(split_part("Time", ':', 3) AS INT) AS clock
      FROM stand)""",
    ),
    (
        "tagged",
        """
SELECT *, CASE WHEN Water IS NULL THEN NULL WHEN Water = 'West Br Delaware River'
            THEN 'main' ELSE 'trib' END AS mainTrib,
  CASE WHEN Water IS NULL THEN NULL WHEN Water = 'West Br Delaware River'
            THEN 1 ELSE 2 END AS mainTribN,
  CASE WHEN Length IS NULL THEN NULL WHEN Length < 230 THEN 1 WHEN Length < 380 THEN 2
       ELSE 3 END AS sizeState
FROM draw0 WHERE tag IS NOT NULL AND tag NOT IN ('', 'ad')""",
    ),
    (
        "iv",
        """
SELECT dateYM, CAST(row_number() OVER (ORDER BY dateYM) AS INT) AS occ, m AS dateMedian,
  lead(m) OVER (ORDER BY dateYM) - m AS dateMedianDiff,
  (lead(m) OVER (ORDER BY dateYM) - m) / 30.5 AS dateMedianDiffMonth
FROM (SELECT dateYM, median(CAST(date - DATE '1970-01-01' AS BIGINT)) AS m FROM tagged
      WHERE date IS NOT NULL GROUP BY dateYM)""",
    ),
    (
        "rivers",
        """
SELECT Water, CAST(row_number() OVER (ORDER BY Water) AS INT) AS riverN
FROM (SELECT DISTINCT Water FROM tagged WHERE Water IS NOT NULL)""",
    ),
    (
        "draw1",
        """
SELECT t.*, occ, dateMedianDiff, dateMedianDiffMonth, riverN,
  sizeState + (mainTribN - 1) * 3 AS state
FROM tagged t LEFT JOIN iv USING (dateYM) LEFT JOIN rivers USING (Water)""",
    ),
    (
        "draw",
        """
SELECT d.*, firstObserved, lastObserved, 1 AS knownZ,
  occ = firstObserved AS isFirstObserved, occ = lastObserved AS isLastObserved
FROM draw1 d LEFT JOIN (SELECT tag, min(occ) AS firstObserved, max(occ) AS lastObserved
                        FROM draw1 GROUP BY tag) f USING (tag)""",
    ),
    (
        "multi",
        "SELECT date, tag, count(*) AS n FROM tagged GROUP BY date, tag HAVING count(*) > 1",
    ),
    (
        "badtags",
        """
SELECT DISTINCT tag FROM tagged WHERE date IS NOT NULL
  AND tag IN (SELECT tag FROM multi) AND date IN (SELECT date FROM multi)""",
    ),
    ("target", "SELECT * FROM draw WHERE tag NOT IN (SELECT tag FROM badtags)"),
    (
        "grow",
        """
SELECT *, CAST(substr(dateYM, 1, 4) AS INT) AS year, CAST(substr(dateYM, 6, 2) AS INT) AS month,
  CAST(date - dateLag AS DOUBLE) AS dateDiff,
  (Length - LengthLag) / CAST(date - dateLag AS DOUBLE) AS growth
FROM (SELECT *, lag(Length) OVER w AS LengthLag, lag(date) OVER w AS dateLag FROM target
      WINDOW w AS (PARTITION BY tag ORDER BY date NULLS LAST, FishNum))""",
    ),
]


def chain(upto: str, *more: tuple[str, str]) -> str:
    """WITH clause up to a named step, then further steps."""
    steps = []
    for name, text in CHAIN:
        steps.append((name, text))
        if name == upto:
            break
    else:
        raise KeyError(upto)
    steps += more
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({t})" for n, t in steps) + "\n"


def thinning(source: str) -> tuple[tuple[str, str], ...]:
    return (
        (
            "latest",
            f"""
SELECT tag, dateYM, CASE WHEN count(*) = count(dateTime) THEN max(dateTime) END AS dt
FROM {source} GROUP BY tag, dateYM HAVING count(*) > 1""",
        ),
        (
            "kept",
            f"""
SELECT d.* FROM {source} d WHERE NOT EXISTS (
  SELECT 1 FROM latest k WHERE k.tag = d.tag AND k.dt IS NOT DISTINCT FROM d.dateTime)""",
        ),
    )


BASE = (
    (
        "base",
        """
SELECT * FROM target WHERE NOT coalesce(firstObserved = (
  SELECT CASE WHEN count(*) = count(occ) THEN max(occ) END FROM target), false)""",
    ),
    *thinning("base"),
)
RIVER = {"all": "true", "main": "mainTrib = 'main'", "trib": "mainTrib = 'trib'"}


def cells(subset: str, states: str = "sizeState") -> tuple[tuple[str, str], ...]:
    return (
        *BASE,
        (
            "cell",
            f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag, dateYM
    ORDER BY dateTime NULLS LAST, FishNum) AS rn
  FROM kept WHERE {RIVER[subset]} AND species = 'brown trout' AND tag <> 'ad719472')
WHERE rn = 1""",
        ),
        (
            "mon",
            """
SELECT dateYM, CAST(row_number() OVER (ORDER BY dateYM NULLS LAST) AS INT) AS j
FROM (SELECT DISTINCT dateYM FROM cell)""",
        ),
        (
            "long",
            """
SELECT f.tag, m.j, m.dateYM, CASE WHEN c.tag IS NULL THEN 0 ELSE c.enc END AS enc, c.Water,
  CASE WHEN c.tag IS NULL THEN 0 ELSE c.riverN END AS riverN,
  CASE WHEN c.tag IS NULL THEN 0 ELSE c.state END AS state,
  CASE WHEN c.tag IS NULL THEN 0 ELSE c.sizeState END AS sizeState, c.dateMedianDiffMonth
FROM (SELECT DISTINCT tag FROM cell) f CROSS JOIN mon m
LEFT JOIN cell c ON c.tag = f.tag AND c.dateYM IS NOT DISTINCT FROM m.dateYM""",
        ),
        (
            "fish",
            f"""
SELECT tag, min(CASE WHEN enc = 1 THEN j END) AS first, CAST(max(j) AS INT) AS last,
  bool_or({states} IS NULL) AS incomplete FROM long GROUP BY tag""",
        ),
        (
            "obs",
            f"""
SELECT tag, j, {states} + 1 AS y, first, last FROM long JOIN fish USING (tag)
WHERE NOT incomplete""",
        ),
    )


#: Six states: same, grow by 1, grow by 2 | smaller | other river (rows sum to ``total``).
_SIX = [
    (0.75, 0.025, 0.001, 0.025, 0.025, 0.025),
    (0.01, 0.75, 0.025, 0.01, 0.025, 0.025),
    (0.01, 0.01, 0.75, 0.01, 0.01, 0.025),
    (0.025, 0.025, 0.025, 0.75, 0.025, 0.001),
    (0.01, 0.025, 0.025, 0.01, 0.75, 0.025),
    (0.01, 0.01, 0.025, 0.01, 0.01, 0.75),
]
#: Per number of states: change of state, chances at first capture, slope.
MODELS = {
    1: ([(1.0,)], (1.0,), 0.1),
    3: ([(0.8, 0.1, 0.1), (0.1, 0.8, 0.1), (0.1, 0.1, 0.8)], (0.5, 0.3, 0.2), 0.1),
    6: ([tuple(v / sum(r) for v in r) for r in _SIX], (0.3, 0.2, 0.1, 0.2, 0.1, 0.1), 0.05),
}


def likelihood(
    subset: str = "main", states: str = "sizeState", n: int = 3, logit: bool = True
) -> tuple[tuple[str, str], ...]:
    """Forward recursion, one row per fish and month, for parameters by formula."""
    psi, delta, slope = MODELS[n]
    live_states, dead = range(1, n + 1), n + 1
    p = {s: f"({slope}*{s} + 0.05*(t % 7))" for s in live_states}
    if logit:
        p = {s: f"(1/(1+exp(-{x})))" for s, x in p.items()}
    phi = {s: f"(0.55 + {slope}*{s} + 0.01*(t % 5))" for s in live_states}
    arrive = {
        s: " + ".join(f"a{r}*{phi[r]}*{psi[r - 1][s - 1]!r}" for r in live_states)
        for s in live_states
    }
    die = f"a{dead} + " + " + ".join(f"a{r}*(1-{phi[r]})" for r in live_states)
    live = ", ".join(
        f"({arrive[s]}) * CASE WHEN y = 1 THEN 1-{p[s]} WHEN y = {s + 1} THEN {p[s]}"
        f" ELSE 0 END AS b{s}"
        for s in live_states
    )
    start = ", ".join(f"CAST(y = {s + 1} AS DOUBLE) AS a{s}" for s in live_states)
    chance = " ".join(f"WHEN {s + 1} THEN {d}" for s, d in zip(live_states, delta))
    everyone = [*live_states, dead]
    scaled = ", ".join(f"b{s}/tot" for s in everyone)
    total = " + ".join(f"b{s}" for s in everyone)
    return (
        *cells(subset, states),
        (
            "fwd",
            f"""
SELECT tag, first, last, j AS t, {start}, CAST(0 AS DOUBLE) AS a{dead},
  ln(CASE y {chance} END) AS ll
FROM obs WHERE j = first
UNION ALL
SELECT tag, first, last, t + 1, {scaled}, ll + ln(tot)
FROM (SELECT *, {total} AS tot
      FROM (SELECT fwd.tag, fwd.first, fwd.last, t, ll, {live},
              ({die}) * CASE WHEN y = 1 THEN 1 ELSE 0 END AS b{dead}
            FROM fwd JOIN obs ON obs.tag = fwd.tag AND obs.j = fwd.t + 1))""",
        ),
    )


def count_steps() -> tuple[tuple[str, str], ...]:
    """Forward-backward sums over all fish of the three-state example; ``byt`` has a row per time."""
    psi, _, slope = MODELS[3]
    states = (1, 2, 3)
    p = {s: f"(1/(1+exp(-({slope}*{s} + 0.05*(t % 7)))))" for s in states}
    phi = {s: f"(0.55 + {slope}*{s} + 0.01*(t % 5))" for s in states}
    sees = {
        s: f"CASE WHEN y = 1 THEN 1-{p[s]} WHEN y = {s + 1} THEN {p[s]} ELSE 0 END"
        for s in states
    }
    sees[4] = "CASE WHEN y = 1 THEN 1 ELSE 0 END"
    ahead = ", ".join(f"{sees[s]} * b{s} AS e{s}" for s in (*states, 4))
    back = ", ".join(
        " + ".join(f"{phi[r]}*{psi[r - 1][s - 1]!r}*e{s}" for s in states)
        + f" + (1-{phi[r]})*e4 AS c{r}"
        for r in states
    )
    pair = {(r, s): f"a{r}*{phi[r]}*{psi[r - 1][s - 1]!r}*e{s}" for r in states for s in states}
    pair |= {(r, 4): f"a{r}*(1-{phi[r]})*e4" for r in states}
    pair[4, 4] = "a4*e4"
    named = ", ".join(f"{q} AS q{r}{s}" for (r, s), q in pair.items())
    total = " + ".join(f"q{r}{s}" for r, s in pair)
    into = {s: " + ".join(f"q{r}{s}" for r in states) for s in states}
    sums = [f"sum(q{r}{s}/tot) AS q{r}{s}" for r, s in pair if r != 4]
    sums += [f"sum(CASE WHEN y > 1 THEN ({into[s]})/tot ELSE 0 END) AS seen{s}" for s in states]
    sums += [f"sum(CASE WHEN y = 1 THEN ({into[s]})/tot ELSE 0 END) AS missed{s}" for s in states]
    return (
        *likelihood(),
        (
            "bwd",
            f"""
SELECT tag, j AS t, CAST(1 AS DOUBLE) AS b1, CAST(1 AS DOUBLE) AS b2, CAST(1 AS DOUBLE) AS b3,
  CAST(1 AS DOUBLE) AS b4 FROM obs WHERE j = last
UNION ALL
SELECT tag, t, c1/m, c2/m, c3/m, e4/m FROM (
  SELECT *, greatest(c1, c2, c3, e4) AS m FROM (
    SELECT tag, t, e4, {back} FROM (
      SELECT tag, t, y, {ahead} FROM (
        SELECT bwd.tag, CAST(bwd.t - 1 AS INT) AS t, y, b1, b2, b3, b4
        FROM bwd JOIN obs ON obs.tag = bwd.tag AND obs.j = bwd.t WHERE bwd.t > first))))""",
        ),
        (
            "pairs",
            f"""
SELECT t, y, {named} FROM (SELECT t, y, a1, a2, a3, a4, {ahead} FROM (
  SELECT f.t, y, a1, a2, a3, a4, b1, b2, b3, b4 FROM fwd f
  JOIN bwd b ON b.tag = f.tag AND b.t = f.t + 1
  JOIN obs o ON o.tag = f.tag AND o.j = f.t + 1))""",
        ),
        (
            "sums",
            f"SELECT t, {', '.join(sums)} FROM (SELECT *, {total} AS tot FROM pairs)"
            " GROUP BY t",
        ),
        (
            "byt",
            """
SELECT g.t, sums.* EXCLUDE (t) FROM (
  SELECT DISTINCT j AS t FROM obs WHERE j < last) g LEFT JOIN sums ON sums.t = g.t""",
        ),
    )


def expected_counts() -> str:
    """Expected moves, detections and misses in long form."""
    states = (1, 2, 3)
    parts = [("move", r, s, f"q{r}{s}") for r in states for s in (*states, 4)]
    parts += [(kind, s, 0, f"{kind}{s}") for kind in ("seen", "missed") for s in states]
    rows = " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, t, CAST({r} AS INT) AS s_from, CAST({s} AS INT) AS s_to,"
        f" {six(f'coalesce({q}, 0)', 'value')} FROM byt"
        for kind, r, s, q in parts
    )
    return (
        chain("target", *count_steps())
        + rows
        + f"""
UNION ALL SELECT 'loglik', CAST(0 AS INT), CAST(0 AS INT), CAST(0 AS INT),
  {six("sum(ll)", "value")} FROM fwd WHERE t = last"""
    )


def em_step() -> str:
    """The closed-form maximum over the expected counts of the three-state example."""
    psi, delta, slope = MODELS[3]
    states = (1, 2, 3)
    out = []

    def row(name, r, to, value):
        out.append(
            f"SELECT '{name}' AS name, CAST({r} AS INT) AS s_from, CAST({to} AS INT) AS s_to, t,"
            f" {six(value, 'value')} FROM known"
        )

    for r in states:
        alive = " + ".join(f"q{r}{s}" for s in states)
        risk = f"({alive} + q{r}4)"
        row("betaPhi", r, "NULL", f"CASE WHEN {risk} > 0 THEN ({alive}) / {risk}"
            f" ELSE 0.55 + {slope}*{r} + 0.01*(t % 5) END")  # fmt: skip
        p = f"least(greatest(seen{r} / (seen{r} + missed{r}), 0.5), 1 / (1 + exp(-1)))"
        row("betaP", r, "NULL", f"CASE WHEN seen{r} + missed{r} > 0 THEN ln({p} / (1 - {p}))"
            f" ELSE {slope}*{r} + 0.05*(t % 7) END")  # fmt: skip
        weights = sum(psi[r - 1])
        for s in states:
            row("psi", r, s, f"(q{r}{s} + {psi[r - 1][s - 1]}) / ({alive} + {weights!r})")
    counts = [f"q{r}{s}" for r in states for s in (*states, 4)]
    counts += [f"{k}{s}" for k in ("seen", "missed") for s in states]
    known = ", ".join(f"coalesce({c}, 0) AS {c}" for c in counts)
    chance = " ".join(f"WHEN {s + 1} THEN {d}" for s, d in zip(states, delta))
    prior = " + ".join(f"{w}*ln({w!r})" for r in psi for w in r)
    return (
        chain(
            "target",
            *count_steps(),
            ("known", f"SELECT t, {known} FROM byt"),
            (
                "share",
                """SELECT state, count(*) / sum(count(*)) OVER () AS share FROM long
WHERE state > 0 GROUP BY state""",
            ),
            (
                "starts",
                f"""SELECT sum(ln(share / CASE y {chance} END)) AS more
FROM obs JOIN share ON share.state + 1 = obs.y WHERE j = first""",
            ),
        )
        + " UNION ALL ".join(out)
        + f"""
UNION ALL SELECT 'logPosterior', 0, NULL, 0,
  {six(f"sum(ll) + any_value(more) + any_value(times) * ({prior})", "value")}
FROM fwd CROSS JOIN starts CROSS JOIN (SELECT count(*) AS times FROM known) WHERE t = last"""
    )


NAME_RE = r"'^([A-Za-z]\w*)\[(\d+), ?(\d+)(?:, ?(\d+))?\]$'"
RAW_DRAWS = DRAWS_SQL.format(
    events="events", idiv="(event_id // 15)", idiv2="(event_id // 30)"
)
DRAWS = (
    ("rawdraws", RAW_DRAWS),
    (
        "draws",
        f"""
SELECT chain, iter, value, regexp_extract(parameter, {NAME_RE}, 1) AS name,
  CAST(regexp_extract(parameter, {NAME_RE}, 2) AS INT) AS s_from,
  CASE WHEN parameter LIKE 'psi%'
       THEN CAST(regexp_extract(parameter, {NAME_RE}, 3) AS INT) END AS s_to,
  CASE WHEN parameter LIKE 'psi%' THEN CAST(regexp_extract(parameter, {NAME_RE}, 4) AS INT)
       ELSE CAST(regexp_extract(parameter, {NAME_RE}, 3) AS INT) END AS t
FROM rawdraws""",
    ),
)
PARAM = "name, s_from, s_to, t"
PRIOR = (
    "prior",
    """
SELECT sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) / sqrt(0.1) AS value
FROM (SELECT ((k * 7919) % 104729 + 0.5) / 104729 AS u1,
             ((k * 104723) % 15485863 + 0.5) / 15485863 AS u2
      FROM (SELECT DISTINCT chain, iter, CAST(iter AS BIGINT) * 2 + chain AS k FROM draws))""",
)
#: Deviations of every chain from its mean, as a list in order of its iterations.
DEVIATIONS = (
    "deviations",
    f"""
SELECT {PARAM}, chain, count(*) AS n, list(x ORDER BY iter) AS xs
FROM (SELECT *, value - avg(value) OVER (PARTITION BY {PARAM}, chain) AS x FROM draws)
GROUP BY {PARAM}, chain""",
)


def covariances(lags: str) -> tuple[tuple[str, str], ...]:
    """Covariances at lags 0 to an expression over ``n``, then as a list per chain."""
    return (
        DEVIATIONS,
        (
            "cov",
            f"""
SELECT {PARAM}, chain, n, lag,
  CASE WHEN lag < n THEN list_dot_product(xs[1:n - lag], xs[lag + 1:n]) / n ELSE 0 END AS c
FROM (SELECT *, CAST(unnest(range(0, {lags} + 1)) AS INT) AS lag FROM deviations)""",
        ),
        (
            "acf",
            f"SELECT {PARAM}, chain, n, list(c ORDER BY lag) AS r FROM cov GROUP BY {PARAM}, chain, n",
        ),
    )


#: Autoregressions of rising order, from the covariances.
MOST = "least(CAST(floor(10 * log10(n)) AS INT), n - 2)"
RECURSION = (
    "ar",
    f"""
SELECT {PARAM}, chain, n, r, 0 AS p, r[1] AS v, CAST([] AS DOUBLE[]) AS a FROM acf
UNION ALL
SELECT {PARAM}, chain, n, r, p + 1, v * (1 - k * k),
  list_append(list_transform(range(1, p + 1), lambda j: a[j] - k * a[p + 1 - j]), k)
FROM (SELECT *, (r[p + 2]
        - coalesce(list_sum(list_transform(range(1, p + 1), lambda j: a[j] * r[p - j + 2])), 0)) / v AS k
      FROM ar WHERE p < {MOST})""",
)


def density(source: str, keys: str) -> str:
    """Kernel density of a table of values at quarters of the bandwidth."""
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    match = " AND ".join(f"w.{k} IS NOT DISTINCT FROM d.{k}" for k in keys.split(", ")) if keys else "true"
    own = "".join(f"d.{k}, " for k in keys.split(", ")) if keys else ""
    return f"""
SELECT {by}h, cell + away AS pt, sum(c / (n * h) * exp(-pow(away / 4, 2) / 2) / sqrt(2 * pi())) AS density
FROM (SELECT {own}h, n, CAST(round(value / h * 4) AS BIGINT) AS cell, count(*) AS c
      FROM {source} d JOIN (SELECT {by}count(*) AS n, 1.06 * stddev_samp(value) * pow(count(*), -0.2) AS h
                            FROM {source} {group}) w ON {match}
      GROUP BY ALL) CROSS JOIN (SELECT unnest(range(-16, 17)) AS away)
GROUP BY {by}h, pt"""


def plain(*steps: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in steps) + "\n"


def summary(source: str, extra: str = "", digits=three) -> str:
    by = f"{extra}{PARAM}"
    return f"""
SELECT {by}, {digits("avg(value)", "mean")}, {digits("stddev_samp(value)", "sd")},
  {digits("quantile_cont(value, 0.025)", "lo")}, {digits("quantile_cont(value, 0.5)", "med")},
  {digits("quantile_cont(value, 0.975)", "hi")}
FROM {source} GROUP BY {by}"""


#: Columns of the wide table: all calendar months of the orders. Cells of any other go to one column.
MONTHS = [f"{year}-{month:02}" for year in range(1992, 2002) for month in range(1, 13)]


def labelled() -> tuple[tuple[str, str], ...]:
    return (
        *cells("main"),
        (
            "tribmonths",
            chain("target", *cells("trib"))
            + "SELECT j, dateYM, min(dateMedianDiffMonth) AS months FROM long GROUP BY j, dateYM",
        ),
        (
            "bothmonths",
            """
SELECT 1 AS chain, j, dateYM, min(dateMedianDiffMonth) AS months FROM long GROUP BY j, dateYM
UNION ALL SELECT 2, j, dateYM, months FROM tribmonths""",
        ),
        *DRAWS,
        (
            "alldraws",
            """
SELECT chain, iter, value, name, s_from, s_to, t FROM draws
UNION ALL
SELECT draws.chain, iter, pow(value, months), 'betaPhiMonthly', s_from, s_to, t
FROM draws JOIN bothmonths v ON v.j = draws.t AND v.chain = least(draws.chain, 2)
WHERE name = 'betaPhi'""",
        ),
        ("summ", summary("alldraws", "chain, ")),
        (
            "lab",
            """
SELECT s.* EXCLUDE (chain), dateYM, CAST(substr(dateYM, 1, 4) AS INT) AS year,
  CAST(substr(dateYM, 6, 2) AS INT) AS month,
  CASE s.chain WHEN 1 THEN 'main' ELSE 'trib' END AS river
FROM summ s LEFT JOIN bothmonths mon ON mon.j = s.t AND mon.chain = least(s.chain, 2)""",
        ),
        (
            "phiboth",
            """
SELECT a.river, a.s_from, a.t, a.dateYM, a.year, a.month, a.mean, a.sd, a.lo, a.med, a.hi,
  b.mean AS mean_1, b.sd AS sd_1, b.lo AS lo_1, b.med AS med_1, b.hi AS hi_1
FROM lab a JOIN lab b ON a.river = b.river AND a.s_from = b.s_from AND a.t = b.t
WHERE a.name = 'betaPhi' AND b.name = 'betaPhiMonthly'""",
        ),
    )


#: Student's t for 95 %, by degrees of freedom from 1 on.
STUDENT = [
    12.706204736, 4.30265273, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252,
    2.306004135, 2.262157163, 2.228138852, 2.20098516, 2.17881283, 2.160368656, 2.144786688,
    2.131449546, 2.119905299, 2.109815578, 2.10092204, 2.093024054, 2.085963447,
]
MEANS = ", ".join(
    [
        six("avg(mean)", "meanPhi"),
        six("stddev_samp(mean)", "sdPhi"),
        six("avg(lo)", "meanLo"),
        six("avg(med)", "meanMed"),
        six("avg(hi)", "meanHi"),
    ]
)
CLEAN = f"""SELECT tag, FishNum, date, dateYM, dateTime, species, Length, Water, enc, occ,
  knownZ, firstObserved, lastObserved, isFirstObserved, isLastObserved, riverN, mainTrib,
  mainTribN, sizeState, state, {six("dateMedianDiff", "dateMedianDiff")},
  {six("dateMedianDiffMonth", "dateMedianDiffMonth")} FROM """
GROWTH_OK = "dateDiff < 300 AND growth > 0 AND growth < 3"


def per_fish(*by: str) -> str:
    keys = ", ".join(("tag", *by))
    return f"SELECT {keys}, count(*) AS n FROM target GROUP BY {keys}"


def xtab(source: str, a: str, b: str) -> str:
    return f"""
SELECT l.{a}, r.{b}, coalesce(n, 0) AS n
FROM (SELECT DISTINCT {a} FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) l
CROSS JOIN (SELECT DISTINCT {b} FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) r
LEFT JOIN (SELECT {a}, {b}, count(*) AS n FROM {source} GROUP BY {a}, {b}) c
  ON c.{a} = l.{a} AND c.{b} = r.{b}"""


def xtab_n(*by: str) -> str:
    source = per_fish(*by).replace("AS n", "AS nCaptures")
    return chain("target", ("pf", source)) + xtab("pf", "nCaptures", by[0])


def growth_summary(keys: str, more_than: int, sd: bool, having: str = "") -> str:
    measures = six("avg(growth)", "mean")
    if sd:
        measures += ", " + six("stddev_samp(growth)", "sd")
    return (
        chain("grow")
        + f"""SELECT {keys}, {measures}, count(*) AS n FROM grow WHERE {GROWTH_OK}
GROUP BY {keys} HAVING count(*) > {more_than} {having}"""
    )


def long(subset: str) -> str:
    return (
        chain("target", *cells(subset))
        + f"""SELECT tag, j, dateYM, enc, Water, riverN, state, sizeState,
  {six("dateMedianDiffMonth", "dateMedianDiffMonth")} FROM long"""
    )


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["prepare_raw"] = chain("draw0") + (
        "SELECT Longitude, Latitude, SiteLen, Discharge, WaterTemp, GearType, TimeFish,"
        " FishNum, SpeciesCd, Length, Weight, Wild, Stage, MarkAppCd, MarkPreCd, Water,"
        " tblSL_SL_ID, Rep, dateC, date, dateTime, dateYM, species, tag, enc, timeSeconds"
        " FROM draw0"
    )
    sql["prepare_captures"] = chain("draw") + CLEAN + "draw"
    sql["month_intervals"] = chain("iv") + f"""
SELECT dateYM, occ, dateMedian, {six("dateMedianDiff", "dateMedianDiff")},
  {six("dateMedianDiffMonth", "dateMedianDiffMonth")},
  CAST(day(DATE '1970-01-01' + CAST(floor(dateMedian) AS INT)) AS INT) AS dayMedian,
  CAST(dateYM || '-01' AS DATE) AS date FROM iv"""
    sql["gt_one_capture"] = chain("multi") + "SELECT date, tag, n FROM multi"
    sql["gt_once_per_day_tags"] = chain("badtags") + "SELECT tag FROM badtags"
    sql["target_d"] = chain("target") + CLEAN + "target"
    sql["remove_same_day"] = chain("target") + (
        "SELECT tag, FishNum, date, species, Length, Water FROM target"
    )

    for name, column in (("date", "date"), ("species", "species"), ("month", "dateYM")):
        sql[f"counts_by_{name}"] = chain("target") + (
            f"SELECT {column}, count(*) AS n FROM target WHERE {column} IS NOT NULL"
            f" GROUP BY {column}"
        )
    sql["n_unique_tags"] = chain("target") + (
        "SELECT count(DISTINCT tag) AS nTags FROM target"
    )
    sql["tag_counts_water"] = chain("target") + per_fish("Water")
    sql["tag_counts_state"] = chain("target") + per_fish("state")
    sql["tag_counts_maintrib_species"] = chain("target") + per_fish("mainTrib", "species")
    sql["tag_counts_maintrib"] = chain("target") + per_fish("mainTrib")
    for name, by in {
        "capture_count_freq": ["Water"],
        "capture_count_freq_state": ["state"],
        "capture_count_freq_maintrib": ["mainTrib", "species"],
    }.items():
        sql[name] = chain("target", ("pf", per_fish(*by))) + (
            "SELECT n, count(*) AS freq FROM pf GROUP BY n"
        )
    sql["xtab_water_river"] = chain("target") + xtab("target", "Water", "riverN")
    sql["xtab_water_n"] = xtab_n("Water")
    sql["xtab_state_n"] = xtab_n("state")
    sql["xtab_maintrib_n"] = xtab_n("mainTrib", "species")
    pf = ("pf", per_fish("mainTrib", "species"))
    sql["counts_by_species_fish"] = chain("target", pf) + (
        "SELECT species, count(*) AS n FROM pf WHERE species IS NOT NULL GROUP BY species"
    )
    sql["xtab_maintrib_species"] = chain("target", pf) + xtab("pf", "mainTrib", "species")
    kinds = ", ".join(
        f"count(*) FILTER (species = '{k} trout') AS {k}_trout"
        for k in ("brook", "brown", "rainbow")
    )
    sql["xtab_maintrib_species_wide"] = chain("target", pf) + (
        f"SELECT mainTrib, {kinds} FROM pf WHERE mainTrib IS NOT NULL"
        " AND species IS NOT NULL GROUP BY mainTrib"
    )
    sql["length_histogram"] = chain("target", (
        "len", "SELECT mainTrib, Length FROM target"
        " WHERE species = 'brown trout' AND Length IS NOT NULL",
    ), ("rng", "SELECT min(Length) AS lo, max(Length) AS hi FROM len")) + f"""
SELECT mainTrib, bin, {six("lo + bin * ((hi - lo) / 30)", "binStart")}, count(*) AS n
FROM (SELECT mainTrib, lo, hi,
        CAST(least(floor((Length - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin
      FROM len CROSS JOIN rng) GROUP BY mainTrib, bin, lo, hi"""
    sql["locations_export"] = chain("target") + (
        "SELECT Latitude, Longitude, tag, dateTime, species, Length, Weight FROM target"
    )

    sql["growth_rows"] = chain("grow") + f"""
SELECT tag, FishNum, date, year, month, Length, LengthLag, dateLag, dateDiff,
  growth FROM grow"""
    sql["growth_month"] = growth_summary("mainTrib, year, month, sizeState", 3, False)
    sql["growth_month_clipped"] = growth_summary(
        "mainTrib, year, month, sizeState", 3, False, "AND avg(growth) BETWEEN -0.3 AND 0.4"
    )
    sql["growth_size"] = growth_summary("mainTrib, sizeState", 5, True)
    sql["growth_size_year"] = growth_summary("mainTrib, sizeState, year", 5, True)
    sql["growth_one_year"] = growth_summary(
        "mainTrib, sizeState, year", 20, True, "AND year = 1999"
    )
    sql["growth_drilldown"] = chain("grow") + """
SELECT growth, count(*) AS n FROM grow
WHERE year = 2000 AND mainTrib = 'main' AND sizeState = 2 AND growth IS NOT NULL
GROUP BY growth"""

    sql["never_captured"] = chain("target") + (
        "SELECT tag FROM target GROUP BY tag HAVING coalesce(sum(enc), 0) = 0"
    )
    on_last = """
SELECT DISTINCT tag FROM {t} WHERE firstObserved = (
  SELECT CASE WHEN count(*) = count(occ) THEN max(occ) END FROM {t})"""
    sql["first_on_last_occ"] = chain("target") + on_last.format(t="target")
    sql["first_on_last_occ_dated"] = chain(
        "target", ("dated", "SELECT * FROM target WHERE date IS NOT NULL")
    ) + on_last.format(t="dated")
    sql["gt1_obs_per_occ"] = chain("target") + (
        "SELECT tag, dateYM, count(*) AS n FROM target GROUP BY tag, dateYM"
        " HAVING count(*) > 1"
    )
    sql["keep_first_obs"] = chain("target", *thinning("target")) + (
        "SELECT tag, FishNum, dateYM, dateTime FROM kept"
    )
    sql["keep_first_obs_only"] = chain("target") + """
SELECT tag, FishNum, dateYM, dateTime FROM (SELECT *, row_number() OVER (
  PARTITION BY tag, dateYM ORDER BY dateTime NULLS LAST, FishNum) AS rn FROM target)
WHERE rn = 1"""
    sql["eh_data_main"] = chain("target", *BASE) + (
        "SELECT tag, FishNum, date, species, sizeState FROM kept WHERE mainTrib = 'main'"
    )
    for subset in RIVER:
        sql[f"eh_long_{subset}"] = long(subset)
    main = chain("target", *cells("main"))
    sql["eh_cells_main"] = main + f"""
SELECT tag, j, dateYM, enc, Water, state, sizeState,
  {six("dateMedianDiffMonth", "dateMedianDiffMonth")} FROM long WHERE enc = 1"""
    columns = ", ".join(
        f"CASE WHEN count(*) FILTER ({cell}) > 0 THEN max(sizeState) FILTER ({cell}) ELSE 0 END"
        f' AS "date_{month}"'
        for month, cell in [(m, f"dateYM = '{m}'") for m in MONTHS] + [("NA", "dateYM IS NULL")]
    )
    months = ", ".join(f"'{m}'" for m in MONTHS)
    other = f"""string_agg(dateYM || ':' || coalesce(CAST(sizeState AS VARCHAR), 'NA'), ','
  ORDER BY dateYM) FILTER (enc = 1 AND dateYM NOT IN ({months})) AS date_other"""
    sql["eh_wide_main"] = main + f"SELECT tag, {columns}, {other} FROM long GROUP BY tag"
    kinds = ("tag, j, dateYM, enc, Water, riverN, state, sizeState, "
             + six("dateMedianDiffMonth", "dateMedianDiffMonth"))
    sql["eh_store"] = chain(
        "target", *cells("main"), ("triblong", chain("target", *cells("trib")) + "SELECT * FROM long")
    ) + (
        f"SELECT {kinds}, 'main' AS river FROM long"
        f" UNION ALL SELECT {kinds}, 'trib' AS river FROM triblong"
    )
    sql["eh_bundle_main"] = main + " UNION ALL ".join(
        f"""
SELECT tag, '{name}' AS matrix, first, last,
  string_agg(coalesce(CAST({column} AS VARCHAR), 'NA'), ',' ORDER BY j) AS cells
FROM long JOIN fish USING (tag) GROUP BY tag, first, last"""
        for name, column in {
            "eh": "enc", "riverMatrix": "Water", "riverNMatrix": "riverN",
            "stateMatrix": "state", "sizeStateMatrix": "sizeState",
        }.items()
    )
    sql["median_dates_given"] = chain("iv") + f"""
SELECT tag, FishNum, dateYM, occ, {six("dateMedianDiff", "dateMedianDiff")},
  {six("dateMedianDiffMonth", "dateMedianDiffMonth")} FROM tagged LEFT JOIN iv USING (dateYM)"""
    sql["eh_head"] = main + """
SELECT tag, first, string_agg(CAST(enc AS VARCHAR), ',' ORDER BY j) AS eh
FROM long JOIN fish USING (tag) GROUP BY tag, first ORDER BY first, tag LIMIT 8"""
    sql["eh_first_last_main"] = main + "SELECT tag, first, last FROM fish"
    sql["occasion_labels"] = main + f"""
SELECT j AS t, dateYM, 'date_' || coalesce(dateYM, 'NA') AS "column",
  CAST(substr(dateYM, 1, 4) AS INT) AS year, CAST(substr(dateYM, 6, 2) AS INT) AS month,
  {six("min(dateMedianDiffMonth)", "dateMedianDiffMonth")}
FROM long GROUP BY j, dateYM"""
    sql["known_state"] = main + """
SELECT tag, j, CASE WHEN max(enc) OVER (PARTITION BY tag ORDER BY j
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) = 0 THEN NULL
  ELSE max(enc) OVER (PARTITION BY tag ORDER BY j
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS known FROM long"""
    sql["interval_vector"] = main + f"""
SELECT j, dateYM, {six("min(dateMedianDiffMonth)", "dateMedianDiffMonth")}
FROM long GROUP BY j, dateYM"""
    kept_main = chain("target", *BASE)
    sql["date_median"] = kept_main + f"""
SELECT DISTINCT dateYM, {six("dateMedianDiffMonth", "dateMedianDiffMonth")}
FROM kept WHERE mainTrib = 'main'"""
    sql["n_states"] = kept_main + """
SELECT CAST(count(*) AS INT) AS nStates
FROM (SELECT DISTINCT sizeState FROM kept WHERE mainTrib = 'main')"""
    everything = chain("target", *cells("all"))
    sql["state_proportions"] = everything + f"""
SELECT state, count(*) AS n, {six("count(*) / sum(count(*)) OVER ()", "proportion")}
FROM long WHERE state > 0 GROUP BY state"""
    sql["state_trajectories"] = everything + """
SELECT trajectory, count(*) AS n FROM (
  SELECT tag, coalesce(string_agg(CASE WHEN state > 0 THEN CAST(state AS VARCHAR) END, ''
    ORDER BY j), '') AS trajectory FROM long GROUP BY tag) GROUP BY trajectory"""
    for name, subset in {
        "first_last_freq": "all", "first_last_freq_main": "main", "first_last_freq_trib": "trib"
    }.items():
        sql[name] = chain("target", *cells(subset)) + """
SELECT CAST(first AS VARCHAR) || '_' || CAST(last AS VARCHAR) AS firstLast, count(*) AS n
FROM fish GROUP BY first, last"""
    sql["history_counts"] = main + """
SELECT first, y, count(*) AS n FROM (
  SELECT tag, first, string_agg(CAST(y AS VARCHAR), ',' ORDER BY j) AS y FROM obs
  GROUP BY tag, first) GROUP BY first, y"""
    sql["incomplete_histories"] = main + """
SELECT count(*) FILTER (incomplete) AS nIncomplete, count(*) AS nFish FROM fish"""
    forward = chain("target", *likelihood())
    scores = f"SELECT tag, first, {six('ll', 'loglik')} FROM fwd WHERE t = last"
    for name, model in {
        "hmm_loglik": ("main", "sizeState", 3),
        "hmm_loglik_trib": ("trib", "sizeState", 3),
        "hmm_loglik_alive_dead": ("main", "enc", 1),
        "hmm_loglik_alive_dead_direct": ("main", "enc", 1, False),
        "hmm_loglik_six_states": ("all", "state", 6),
    }.items():
        sql[name] = chain("target", *likelihood(*model)) + scores
    sql["hmm_expected_counts"] = expected_counts()
    sql["em_step"] = em_step()
    sql["hmm_loglik_total"] = forward + (
        "SELECT round(sum(ll), 4) AS loglik, count(*) AS nFish FROM fwd WHERE t = last"
    )

    columns = {c: c for c in CAPTURE_COLUMNS} | {"Date": '"Date"', "Time": '"Time"'}
    told = []
    for name, (number, text, kind) in {
        "Length": (101, "12.5cm", "double"),
        "Rep": (211, "2.x", "int"),
        "SpeciesCd": (103, "brown", "int"),
    }.items():
        columns[name] = f"CASE WHEN FishNum % {number} <> 0 THEN {name} END AS {name}"
        told.append(f"CASE WHEN FishNum % {number} = 0 THEN '{name} {text} {kind}' END")
    sql["csv_problems"] = chain("stand") + (
        f"SELECT {', '.join(columns.values())}, concat_ws(', ', {', '.join(told)}) AS problems FROM stand"
    )
    draws = plain(*DRAWS)
    sql["model_run_store"] = draws + f"SELECT chain, iter, {six('value', 'value')}, {PARAM} FROM draws"
    sql["posterior_draws"] = draws + (
        f"SELECT chain, iter, {six('value', 'value')}, {PARAM} FROM draws"
    )
    sql["posterior_summary"] = plain(
        *DRAWS,
        ("thinned", "SELECT * FROM draws WHERE iter > 20 AND (iter - 20) % 5 = 0"),
    ) + summary("thinned")
    sql["posterior_phi"] = plain(
        *DRAWS, ("phi", "SELECT * FROM draws WHERE name = 'betaPhi'")
    ) + summary("phi")
    quantiles = ", ".join(
        three(f"quantile_cont(value, {q})", n).replace(", 3)", ", 6)")
        for q, n in (
            (0.025, "lo95"), (0.25, "lo50"), (0.5, "med"), (0.75, "hi50"), (0.975, "hi95"),
        )
    )
    sql["caterpillar"] = draws + (
        f"SELECT {PARAM}, {quantiles} FROM draws GROUP BY {PARAM}"
    )
    sql["posterior_rhat"] = draws + f"""
SELECT {PARAM}, {six("sqrt(((n - 1) / n * w + b) / w)", "rhat")}
FROM (SELECT {PARAM}, avg(n) AS n, avg(v) AS w, var_samp(m) AS b
      FROM (SELECT {PARAM}, chain, count(*) AS n, avg(value) AS m, var_samp(value) AS v
            FROM draws GROUP BY {PARAM}, chain) GROUP BY {PARAM})"""
    sql["posterior_neff"] = draws + f"""
SELECT {PARAM}, round(total * (sq - mu * mu) / (size * b), 3) AS nEff
FROM (SELECT {PARAM}, sum(n) AS total, avg(n) AS size, var_samp(m) AS b,
        sum(n * (v + m * m)) / sum(n) AS sq, sum(n * m) / sum(n) AS mu
      FROM (SELECT {PARAM}, chain, floor((iter - lo) * 20 / (hi - lo + 1)) AS batch,
              count(*) AS n, avg(value) AS m, var_pop(value) AS v
            FROM draws CROSS JOIN (SELECT min(iter) AS lo, max(iter) AS hi FROM draws)
            GROUP BY {PARAM}, chain, batch)
      GROUP BY {PARAM})"""
    sql["prior_overlap"] = plain(
        *DRAWS,
        PRIOR,
        (
            "pb",
            f"""SELECT bin, n / sum(n) OVER () AS share
FROM (SELECT floor(value / 0.1) AS bin, count(*) AS n FROM prior GROUP BY 1)""",
        ),
        (
            "db",
            f"""SELECT {PARAM}, bin, n / sum(n) OVER (PARTITION BY {PARAM}) AS share
FROM (SELECT {PARAM}, floor(value / 0.1) AS bin, count(*) AS n FROM draws GROUP BY ALL)""",
        ),
    ) + f"""
SELECT {PARAM}, {six("sum(least(db.share, coalesce(pb.share, 0)))", "overlap")}
FROM db LEFT JOIN pb USING (bin) GROUP BY {PARAM}"""
    sql["posterior_autocovariance"] = plain(*DRAWS, *covariances("10")) + (
        f"SELECT {PARAM}, chain, n, lag, {six('c', 'covariance')} FROM cov"
    )
    sql["posterior_neff_spectral"] = plain(*DRAWS, *covariances(MOST), RECURSION).replace(
        "WITH", "WITH RECURSIVE", 1
    ) + f"""
SELECT {PARAM}, round(sum(eff), 3) AS nEff FROM (
  SELECT {PARAM}, chain, arg_min(n * (r[1] * n / (n - 1)) * pow(1 - coalesce(list_sum(a), 0), 2)
      / (v * n / (n - p - 1)), n * ln(v) + 2 * p) AS eff
  FROM ar GROUP BY {PARAM}, chain) GROUP BY {PARAM}"""
    sql["prior_density_overlap"] = plain(
        *DRAWS, PRIOR, ("post", density("draws", PARAM)), ("around", density("prior", ""))
    ) + f"""
SELECT {PARAM}, {six("sum(least(density, coalesce(l, 0) * (1 - x + f) + coalesce(r, 0) * (x - f)) * h / 4)", "overlap")}
FROM (SELECT *, floor(x) AS f FROM (
        SELECT *, pt * h / (SELECT max(h) FROM around) AS x FROM post))
LEFT JOIN (SELECT pt AS lf, density AS l FROM around) ON lf = f
LEFT JOIN (SELECT pt - 1 AS rf, density AS r FROM around) ON rf = f
GROUP BY {PARAM}"""
    lab = chain("target", *labelled())
    sql["posterior_labelled"] = lab + (
        f"SELECT {PARAM}, mean, sd, lo, med, hi, dateYM, year, month, river FROM lab"
        " WHERE name <> 'betaPhiMonthly'"
    )
    sql["phi_means"] = lab + (
        f"SELECT river, s_from, {MEANS} FROM lab WHERE name = 'betaPhi' GROUP BY river, s_from"
    )
    sql["psi_means"] = lab + (
        f"SELECT river, s_from, s_to, {MEANS} FROM lab WHERE name = 'psi'"
        " GROUP BY river, s_from, s_to"
    )
    sql["phi_vs_monthly"] = lab + "SELECT * FROM phiboth"
    sql["phi_line"] = lab + f"""
SELECT s_from, {six("regr_slope(med_1, med)", "slope")},
  {six("regr_intercept(med_1, med)", "intercept")}, count(*) AS n
FROM phiboth GROUP BY s_from"""
    sql["phi_line_band"] = (
        chain(
            "target",
            *labelled(),
            (
                "fits",
                f"""
SELECT *, ({STUDENT})[CAST(n - 2 AS INT)] AS q FROM (
  SELECT s_from, count(*) AS n, avg(med) AS mx, regr_sxx(med_1, med) AS sxx,
    regr_slope(med_1, med) AS b, regr_intercept(med_1, med) AS a,
    greatest(regr_syy(med_1, med) - regr_slope(med_1, med) * regr_sxy(med_1, med), 0) AS sse
  FROM phiboth WHERE med IS NOT NULL AND med_1 IS NOT NULL GROUP BY s_from)""",
            ),
            (
                "band",
                """
SELECT river, s_from, t, med AS x, a + b * med AS fit, q,
  CASE WHEN n > 2 THEN sqrt(sse / (n - 2) * (1 / n + pow(med - mx, 2) / sxx)) END AS se
FROM phiboth JOIN fits USING (s_from) WHERE med IS NOT NULL AND med_1 IS NOT NULL""",
            ),
        )
        + f"SELECT river, s_from, t, x, {six('fit', 'fit')}, {six('se', 'se')},"
        f" {six('fit - q * se', 'lo')}, {six('fit + q * se', 'hi')} FROM band"
    )
    sql["phi_by_year"] = lab + f"""
SELECT river, s_from, year, {six("product(mean)", "phiProd")}, min(dateYM) AS firstDate,
  max(dateYM) AS lastDate
FROM (SELECT *, max(t) OVER (PARTITION BY river, s_from, year) AS last_t FROM lab
      WHERE name = 'betaPhi') WHERE t < last_t GROUP BY river, s_from, year"""
    sql["p_by_year"] = lab + f"""
SELECT river, s_from, year, {six("avg(mean)", "pMean")}, min(dateYM) AS firstDate,
  max(dateYM) AS lastDate
FROM lab WHERE name = 'betaP' GROUP BY river, s_from, year"""
    return sql
