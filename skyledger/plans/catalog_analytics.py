"""Registered queries: mining, profile, correlation, diagnostics and the sensor dimension."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import correlation, mining, profile, sensors
from ..schemas import RANGE_SPEC
from .catalog_tables import _NEWEST, _issue_sql
from .comprehensive import comprehensive
from .oracle import CTES, with_views
from .registry import query
from .views import NOW, Tables, mac_sql

ENV = ["temperature", "humidity", "pressure"]
BINS = [f"{c}_binned" for c in ENV]
PAIRS = list(combinations(ENV, 2))


# --- mining ------------------------------------------------------------------

@query("j01_discretize", with_views("binned", "SELECT * FROM binned"))
def _(t: Tables) -> DataFrame:
    return mining.discretize(t.env_wide, ENV)


_COMPLETE = " AND ".join(f"{b} IS NOT NULL" for b in BINS)
_ITEMS = "'humidity_' || humidity_binned || ',pressure_' || pressure_binned || ',temperature_' || temperature_binned"


def _baskets(t: Tables) -> DataFrame:
    return mining.transactions(mining.discretize(t.env_wide, ENV))


@query("j02_transactions", with_views(
    "binned", f"SELECT l_orderkey, l_linenumber, {_ITEMS} AS items FROM binned WHERE {_COMPLETE}"
))
def _(t: Tables) -> DataFrame:
    return _baskets(t).select("l_orderkey", "l_linenumber", F.array_join("items", ",").alias("items"))


# Itemsets as one nullable column per variable; support over complete rows.
_SETS = (
    f"SELECT temperature_binned AS t, humidity_binned AS h, pressure_binned AS p, count(*) AS n, count(*) / (SELECT count(*) "
    f"FROM binned WHERE {_COMPLETE})::DOUBLE AS support FROM binned WHERE {_COMPLETE} "
    f"GROUP BY CUBE (t, h, p) HAVING coalesce(t, h, p) IS NOT NULL AND support >= 0.05"
)


def _text(a: str) -> str:
    return f"concat_ws(',', 'humidity_' || {a}h, 'pressure_' || {a}p, 'temperature_' || {a}t)"


@query("j03_frequent_itemsets", with_views("binned", f"SELECT {_text('')} AS items, n, support FROM sets", sets=_SETS), "support", 9)
def _(t: Tables) -> DataFrame:
    return mining.frequent_itemsets(_baskets(t)).withColumn("items", F.array_join("items", ","))


# Twelve items a row, so that baskets are wider than any list of columns.
_WIDE_ITEMS = [f"concat('k{k}_', cast((l_orderkey * 7 + l_partkey * {k} + l_linenumber) % {k} as {{text}}))" for k in range(3, 15)]


@query("j03_itemsets_wide", (
    f"WITH baskets AS (SELECT row_number() OVER () AS b, [{', '.join(i.format(text='varchar') for i in _WIDE_ITEMS)}] AS items FROM lineitem), "
    "each AS (SELECT b, unnest(items) AS item FROM baskets), total AS (SELECT count(*) AS n FROM baskets), "
    "sets AS (SELECT item AS items, count(*) AS n FROM each GROUP BY 1 UNION ALL "
    "SELECT x.item || ',' || y.item, count(*) FROM each x JOIN each y ON x.b = y.b AND x.item < y.item GROUP BY 1) "
    "SELECT sets.items, sets.n, sets.n / total.n AS support FROM sets, total WHERE sets.n / total.n >= 0.08"
), "support", 9)
def _(t: Tables) -> DataFrame:
    """Itemsets of one and two items among baskets of twelve."""
    items = F.array(*[F.expr(i.format(text="string")) for i in _WIDE_ITEMS])
    sets = mining.frequent_itemsets(t.raw("lineitem").select(items.alias("items")), 0.08)
    return sets.filter(F.size("items") <= 2).withColumn("items", F.array_join("items", ","))


def _part(a: str, z: str) -> str:
    return " AND ".join(f"({a}.{c} IS NULL OR {a}.{c} IS NOT DISTINCT FROM {z}.{c})" for c in "thp")


_RULES = (
    f"SELECT {_text('a.')} AS antecedents, {_text('c.')} AS consequents, a.support AS antecedent_support, "
    "c.support AS consequent_support, z.support AS support, z.support / a.support AS confidence, "
    "z.support / a.support / c.support AS lift, z.support - a.support * c.support AS leverage, "
    "CASE WHEN z.support / a.support >= 1 THEN 'infinity'::DOUBLE ELSE (1 - c.support) / (1 - z.support / a.support) END "
    f"AS conviction FROM sets z JOIN sets a ON {_part('a', 'z')} JOIN sets c ON "
    + " AND ".join(f"c.{x} IS NOT DISTINCT FROM (CASE WHEN a.{x} IS NULL THEN z.{x} END)" for x in "thp")
    + " WHERE z.support / a.support >= 0.3"
)
_METRICS = "antecedent_support consequent_support support confidence lift leverage conviction"


def _rules(t: Tables) -> DataFrame:
    """The columns are close to independent here, so the confidence bound is lowered to get rules."""
    return mining.association_rules(mining.frequent_itemsets(_baskets(t)), 0.3)


def _joined(rules: DataFrame) -> DataFrame:
    return rules.withColumns({c: F.array_join(c, ",") for c in ("antecedents", "consequents")})


@query("j04_association_rules", with_views(
    "binned", "SELECT antecedents, consequents, confidence FROM rules", sets=_SETS, rules=_RULES
), "confidence")
def _(t: Tables) -> DataFrame:
    return _joined(_rules(t)).select("antecedents", "consequents", "confidence")


@query("j05_rule_metrics", with_views("binned", "SELECT * FROM rules", sets=_SETS, rules=_RULES), _METRICS)
def _(t: Tables) -> DataFrame:
    return _joined(_rules(t))


_TOP_RULES = (
    "SELECT * FROM rules WHERE lift >= 1 ORDER BY round(lift, 12) DESC, round(confidence, 12) DESC, antecedents, consequents LIMIT 10")
_RULE_SUMMARY = (
    "SELECT count(*) AS rules, avg(confidence) AS mean_confidence, avg(lift) AS mean_lift, max(lift) AS max_lift FROM rules")


@query("j06_top_rules", with_views("binned", _TOP_RULES, sets=_SETS, rules=_RULES), _METRICS)
def _(t: Tables) -> DataFrame:
    # a rule and its reverse have equal lift up to the last bit: settle it before the sort
    settled = _rules(t).withColumns({c: F.round(c, 12) for c in ("lift", "confidence")})
    return _joined(mining.top_rules(settled, 1.0, 10))


@query("j07_rule_summary", with_views("binned", _RULE_SUMMARY, sets=_SETS, rules=_RULES), "mean_confidence mean_lift max_lift")
def _(t: Tables) -> DataFrame:
    return mining.rule_summary(_rules(t))


@query("j08_require_rows", with_views("env_wide", "SELECT count(*) AS n FROM env_wide"))
def _(t: Tables) -> DataFrame:
    return mining.require_rows(t.env_wide, 20).agg(F.count("*").alias("n"))


# --- profile -------------------------------------------------------------------

_OVERVIEW = (
    "SELECT cast(sum(n) AS BIGINT) AS n_rows, cast(3 AS BIGINT) AS n_columns, cast(sum(n * ((temperature IS NULL)::INT + "
    "(humidity IS NULL)::INT + (pressure IS NULL)::INT)) AS BIGINT) AS missing_cells, count(*) FILTER (n > 1) AS duplicate_groups, "
    "cast(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT temperature, humidity, pressure, count(*) AS n FROM env_wide GROUP BY ALL)"
)


@query("j09_profile_overview", with_views("env_wide", _OVERVIEW))
def _(t: Tables) -> DataFrame:
    return profile.profile_overview(t.env_wide.select(*ENV))


_NUMERIC = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS missing, min({c}) AS min, max({c}) AS max, "
    f"avg({c}) AS mean, stddev_samp({c}) AS std, var_samp({c}) AS variance, "
    f"skewness({c}) AS skewness, kurtosis({c}) AS kurtosis, "
    f"count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives, count(DISTINCT {c}) AS \"distinct\", "
    + ", ".join(f"quantile_cont({c}, {p}) AS p{round(p * 100)}" for p in profile.QUANTILES)
    + f", quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, stddev_samp({c}) / avg({c}) AS cv FROM env_wide"
    for c in ENV
)


@query("j10_profile_numeric", with_views("env_wide", f"SELECT * REPLACE (variance / 1e6 AS variance) FROM ({_NUMERIC})"),
       "min max mean std variance skewness kurtosis p5 p25 p50 p75 p95 iqr cv")
def _(t: Tables) -> DataFrame:
    """The variance in millions, so that six digits are more than its sums can differ by."""
    return profile.profile_numeric(t.env_wide, ENV).withColumn("variance", F.col("variance") / 1e6)


def _bin(c: str) -> str:
    return (f"least(cast(floor(({c} - (SELECT min({c}) FROM env_wide)) * 10.0e0 / (SELECT max({c}) - min({c}) FROM env_wide)) "
            "AS INT), 9)")


@query("j11_profile_histogram", with_views("env_wide", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {_bin(c)} AS bin, count(*) AS n FROM env_wide WHERE {c} IS NOT NULL GROUP BY ALL" for c in ENV
)))
def _(t: Tables) -> DataFrame:
    return profile.profile_histogram(t.env_wide, ENV)


def _pair_sql(body: str) -> str:
    return " UNION ALL ".join(body.format(a=a, b=b) for a, b in PAIRS)


@query("j12_corr_pearson", with_views(
    "env_wide", _pair_sql("SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM env_wide")
), "corr")
def _(t: Tables) -> DataFrame:
    return correlation.corr_pearson(t.env_wide, ENV)


_PAIR_ROWS = _pair_sql(
    "SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM env_wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
)


_RANKED = (
    "SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0e0 AS rx, "
    "rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0e0 AS ry FROM pair_rows")
_SPEARMAN = "SELECT a, b, corr(rx, ry) AS corr FROM ranked GROUP BY a, b"


@query("j13_corr_spearman", with_views("env_wide", _SPEARMAN, pair_rows=_PAIR_ROWS, ranked=_RANKED), "corr")
def _(t: Tables) -> DataFrame:
    return correlation.corr_spearman(t.env_wide, ENV)


# The first column of every pair has few levels: rows below and above are counted per level along y.
@query("j14_corr_kendall", with_views(
    "env_wide",
    "SELECT s.a, s.b, s.s / sqrt((n.n * (n.n - 1) / 2 - tx.ties) * (n.n * (n.n - 1) / 2 - ty.ties)) AS corr FROM score s "
    "JOIN (SELECT a, b, count(*)::DOUBLE AS n FROM pair_rows GROUP BY a, b) n ON n.a = s.a AND n.b = s.b "
    "JOIN (SELECT a, b, sum(t * (t - 1) / 2) AS ties FROM (SELECT a, b, x, count(*)::DOUBLE AS t FROM pair_rows GROUP BY ALL) "
    "GROUP BY a, b) tx ON tx.a = s.a AND tx.b = s.b "
    "JOIN (SELECT a, b, sum(t * (t - 1) / 2) AS ties FROM (SELECT a, b, y, count(*)::DOUBLE AS t FROM pair_rows GROUP BY ALL) "
    "GROUP BY a, b) ty ON ty.a = s.a AND ty.b = s.b",
    pair_rows=_PAIR_ROWS,
    cells="SELECT a, b, x, y, count(*)::DOUBLE AS n FROM pair_rows GROUP BY ALL",
    grid="SELECT l.a, l.b, l.x, d.y, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT a, b, x FROM cells) l "
    "JOIN (SELECT DISTINCT a, b, y FROM cells) d ON d.a = l.a AND d.b = l.b "
    "LEFT JOIN cells c ON c.a = l.a AND c.b = l.b AND c.x = l.x AND c.y = d.y",
    cumulated="SELECT *, sum(n) OVER (PARTITION BY a, b, x ORDER BY y) AS upto, sum(n) OVER (PARTITION BY a, b, x) AS total FROM grid",
    score="SELECT c.a, c.b, sum(c.n * sign(c.x - g.x) * ((g.upto - g.n) - (g.total - g.upto))) / 2 AS s FROM cells c "
    "JOIN cumulated g ON g.a = c.a AND g.b = c.b AND g.y = c.y GROUP BY c.a, c.b",
), "corr")
def _(t: Tables) -> DataFrame:
    return correlation.corr_kendall(t.env_wide, ENV)


_BIN_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM binned WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for a, b in combinations(BINS, 2)
)


@query("j15_corr_cramers", with_views(
    "binned",
    "SELECT a, b, chi2, sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) / least(k - (k - 1) * (k - 1) / (n - 1) - 1, "
    "r - (r - 1) * (r - 1) / (n - 1) - 1)) AS cramers_v FROM stats",
    rows="SELECT * FROM (" + _BIN_PAIRS + ")",
    # a combination that never occurs still has an expected count
    cells="SELECT l.a, l.b, l.x, r.y, count(c.x)::DOUBLE AS o FROM (SELECT DISTINCT a, b, x FROM rows) l "
    "JOIN (SELECT DISTINCT a, b, y FROM rows) r ON r.a = l.a AND r.b = l.b "
    "LEFT JOIN rows c ON c.a = l.a AND c.b = l.b AND c.x = l.x AND c.y = r.y GROUP BY ALL",
    expected="SELECT *, sum(o) OVER (PARTITION BY a, b, x) * sum(o) OVER (PARTITION BY a, b, y) / sum(o) OVER (PARTITION BY a, b) AS e "
    "FROM cells",
    stats="SELECT a, b, sum((o - e) * (o - e) / e) AS chi2, sum(o) AS n, count(DISTINCT x)::DOUBLE AS r, count(DISTINCT y)::DOUBLE AS k "
    "FROM expected GROUP BY a, b",
), "chi2 cramers_v")
def _(t: Tables) -> DataFrame:
    return correlation.corr_cramers(mining.discretize(t.env_wide, ENV), BINS)


@query("j15_contingency", with_views("binned", f"SELECT a, b, x, y, count(*) AS n FROM ({_BIN_PAIRS}) GROUP BY ALL"))
def _(t: Tables) -> DataFrame:
    return correlation.contingency(mining.discretize(t.env_wide, ENV), BINS)


_MISSING_BAR = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS present FROM env_wide" for c in ENV)


@query("j16_missing_bar", with_views("env_wide", _MISSING_BAR))
def _(t: Tables) -> DataFrame:
    return profile.missing_bar(t.env_wide, ENV)


@query("j16_missing_corr", with_views(
    "env_wide",
    "SELECT 'temperature' AS a, 'pressure' AS b, corr((temperature IS NULL)::INT, (pressure IS NULL)::INT) AS corr FROM env_wide",
), "corr")
def _(t: Tables) -> DataFrame:
    return correlation.missing_corr(t.env_wide, ENV)


@query("j17_missing_patterns", with_views(
    "env_wide",
    "SELECT (temperature IS NULL)::INT || '' || (humidity IS NULL)::INT || (pressure IS NULL)::INT AS pattern, count(*) AS n "
    "FROM env_wide GROUP BY pattern",
))
def _(t: Tables) -> DataFrame:
    return profile.missing_patterns(t.env_wide, ENV)


@query("j17_missing_distances", with_views("env_wide", " UNION ALL ".join(
    f"SELECT '{min(p)}' AS a, '{max(p)}' AS b, count(*) FILTER (({p[0]} IS NULL) <> ({p[1]} IS NULL)) AS differing FROM env_wide" for p in PAIRS
)))
def _(t: Tables) -> DataFrame:
    return profile.missing_distances(t.env_wide, ENV)


@query("j17_missing_dendrogram", with_views(
    "env_wide",
    "SELECT 1 AS step, a AS left, b AS right, d AS distance, 2 AS size FROM closest UNION ALL "
    "SELECT 2, least(c.c, c.a || ',' || c.b), greatest(c.c, c.a || ',' || c.b), (SELECT avg(d) FROM d WHERE d.a = c.c OR d.b = c.c), 3 FROM closest c",
    d=" UNION ALL ".join(
        f"SELECT '{min(p)}' AS a, '{max(p)}' AS b, '{min(set(ENV) - set(p))}' AS c, "
        f"sqrt(count(*) FILTER (({p[0]} IS NULL) <> ({p[1]} IS NULL))) AS d FROM env_wide" for p in PAIRS),
    closest="SELECT * FROM d ORDER BY d, a, b LIMIT 1",
), "distance")
def _(t: Tables) -> DataFrame:
    """The tree of three columns: the closest pair, then the third."""
    return profile.missing_dendrogram(t.env_wide, ENV)


@query("j18_interactions", with_views("env_wide", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {_bin(a)} AS bin_a, {_bin(b)} AS bin_b, count(*) AS n FROM env_wide "
    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL" for a, b in PAIRS
)))
def _(t: Tables) -> DataFrame:
    return profile.interactions(t.env_wide, ENV)


_ORDER = ["ts", "l_orderkey", "l_linenumber", "pressure", "temperature", "humidity"]


@query("j19_samples", with_views(
    "env_wide",
    "(SELECT *, 'head' AS sample FROM env_wide ORDER BY " + ", ".join(f"{c} ASC NULLS FIRST" for c in _ORDER) + " LIMIT 10) UNION ALL "
    "(SELECT *, 'tail' AS sample FROM env_wide ORDER BY " + ", ".join(f"{c} DESC NULLS LAST" for c in _ORDER) + " LIMIT 10)",
))
def _(t: Tables) -> DataFrame:
    return profile.samples(t.env_wide, _ORDER).filter("sample <> 'random'")


@query("j19_samples_random", with_views(
    "env_wide",
    "SELECT *, 'random' AS sample FROM env_wide ORDER BY md5(concat_ws('|', 42, " + ", ".join(_ORDER) + ")), "
    + ", ".join(f"{c} ASC NULLS FIRST" for c in _ORDER) + " LIMIT 10",
))
def _(t: Tables) -> DataFrame:
    return profile.samples(t.env_wide, _ORDER).filter("sample = 'random'")


_LIMITS = {"missing_percent": 4.0, "zeros_percent": 5.0, "correlation": 0.5, "skewness": 0.1, "outlier_percent": 0.0}


def _alerts_sql(limits: dict[str, float]) -> str:
    """Alerts over the tables ``numeric``, ``long`` and ``pearson``."""
    return (
        "SELECT alert, \"column\", value FROM (SELECT 'high_missing' AS alert, \"column\", missing * 100.0e0 / (count + missing) AS value, "
        f"{limits['missing_percent']} AS lim FROM numeric "
        "UNION ALL SELECT 'constant', \"column\", CASE WHEN \"distinct\" <= 1 THEN 1.0 ELSE 0.0 END, 0.5 FROM numeric "
        f"UNION ALL SELECT 'zeros', \"column\", zeros * 100.0e0 / (count + missing), {limits['zeros_percent']} FROM numeric "
        f"UNION ALL SELECT 'skewed', \"column\", abs(skewness), {limits['skewness']} FROM numeric "
        "UNION ALL SELECT 'outliers', n.\"column\", (SELECT count(*) FROM long l WHERE l.\"column\" = n.\"column\" AND "
        f"(l.v < n.p25 - 1.5 * n.iqr OR l.v > n.p75 + 1.5 * n.iqr)) * 100.0e0 / count, {limits['outlier_percent']} FROM numeric n "
        f"UNION ALL SELECT 'high_correlation', a || ',' || b, abs(corr), {limits['correlation']} FROM pearson) WHERE value > lim"
    )


_ALERT_TABLES = {
    "numeric": f"SELECT * FROM ({_NUMERIC})",
    "long": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM env_wide" for c in ENV),
    "pearson": _pair_sql("SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM env_wide"),
}


@query("j20_profile_alerts", with_views("env_wide", _alerts_sql(_LIMITS), **_ALERT_TABLES), "value")
def _(t: Tables) -> DataFrame:
    return profile.profile_alerts(t.env_wide, ENV, _LIMITS)


# Every part of the composed analysis as rows of part, item, measure and value: what names an item, and its measures.
_PAIR = ("a || ',' || b", ["corr"])
_MEASURED = {
    "summary": ("'all'", ["points", "first_s", "last_s"]),
    "overview": ("'all'", ["n_rows", "n_columns", "missing_cells", "duplicate_groups", "duplicate_rows"]),
    "numeric": ("{column}", "count missing min max mean std skewness kurtosis zeros negatives distinct p5 p25 p50 p75 p95 iqr cv".split()),
    "pearson": _PAIR,
    "spearman": _PAIR,
    "missing": ("{column}", ["present"]),
    "alerts": ("alert || ':' || {column}", ["value"]),
    "top_rules": ("antecedents || '>' || consequents", _METRICS.split()[:-1]),
    "rule_summary": ("'all'", ["rules", "mean_confidence", "mean_lift", "max_lift"]),
}
_ANALYSED = {
    "env_wide": f"SELECT ts, temperature, humidity, pressure FROM readings WHERE ts >= timestamp '{NOW}' - interval '31 days' "
    f"AND ts < timestamp '{NOW}' AND coalesce(temperature, humidity, pressure) IS NOT NULL",
    "edges": CTES["edges"], "binned": CTES["binned"], "sets": _SETS, "rules": f"SELECT * FROM ({_RULES}) WHERE lift >= 1",
    **_ALERT_TABLES,
    "summary": "SELECT count(*) AS points, epoch(date_trunc('second', min(ts))) AS first_s, "
    "epoch(date_trunc('second', max(ts))) AS last_s FROM env_wide",
    "overview": _OVERVIEW, "pair_rows": _PAIR_ROWS, "ranked": _RANKED, "spearman": _SPEARMAN, "missing": _MISSING_BAR,
    "alerts": _alerts_sql(profile.ALERTS), "top_rules": _TOP_RULES, "rule_summary": _RULE_SUMMARY,
}


@query("j21_comprehensive", with_views("readings", " UNION ALL ".join(
    f"SELECT '{part}' AS part, " + item.format(column='"column"') + f" AS item, '{m}' AS measure, cast(\"{m}\" AS DOUBLE) AS value FROM {part}"
    for part, (item, measures) in _MEASURED.items() for m in measures
), **_ANALYSED), "value")
def _(t: Tables) -> DataFrame:
    """Every measure of every part over the readings of 31 days."""
    results, failures = comprehensive(t.readings, NOW, 31, min_confidence=0.3)
    if failures:
        raise RuntimeError(str(failures))
    results["summary"] = results["summary"].select(
        "points", F.unix_timestamp("first_ts").alias("first_s"), F.unix_timestamp("last_ts").alias("last_s"))
    results["top_rules"] = _joined(results["top_rules"])
    parts = [
        results[part].select(F.lit(part).alias("part"), F.expr(item.format(column="`column`")).alias("item"), F.inline(F.array(*[
            F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])))
        for part, (item, measures) in _MEASURED.items()
    ]
    return reduce(DataFrame.unionByName, parts)


# --- diagnostics -----------------------------------------------------------------

def _newest(n: int, where: str = "") -> str:
    return f"SELECT * FROM readings {where} QUALIFY row_number() OVER (PARTITION BY mac ORDER BY ts DESC, event_id DESC) <= {n}"


_SIGNAL = (
    "SELECT mac, avg(rssi) AS average_rssi, max(rssi) - min(rssi) AS rssi_spread, avg(rssi) > -80 AND max(rssi) - min(rssi) < 20 "
    f"AS passed FROM ({_newest(5, 'WHERE rssi IS NOT NULL')}) GROUP BY mac"
)
_SPREAD = {c: f"coalesce(max({c}) - min({c}), 0)" for c in ENV}
_CONSISTENCY = (
    "SELECT mac, count(*) AS readings, " + ", ".join(f"{x} AS {c}_spread" for c, x in _SPREAD.items())
    + f", count(*) >= 3 AND {_SPREAD['temperature']} < 5 AND {_SPREAD['humidity']} < 10 AND {_SPREAD['pressure']} < 50 AS passed "
    f"FROM ({_newest(10)}) GROUP BY mac"
)
_RANGE = f"SELECT mac, {_issue_sql(RANGE_SPEC)} AS issues, {_issue_sql(RANGE_SPEC)} = '' AS passed FROM newest"
_V = "battery_voltage"
_BATTERY = (
    f"SELECT mac, {_V}, CASE WHEN {_V} IS NULL THEN NULL WHEN {_V} >= 3.0 THEN 'Excellent' WHEN {_V} >= 2.8 THEN 'Good' WHEN "
    f"{_V} >= 2.6 THEN 'Fair' WHEN {_V} >= 2.4 THEN 'Low' ELSE 'Critical' END AS health, "
    f"CASE WHEN {_V} IS NULL THEN NULL WHEN {_V} >= 3.0 THEN 12 WHEN {_V} >= 2.8 THEN 6 WHEN {_V} >= 2.6 THEN 3 WHEN "
    f"{_V} >= 2.4 THEN 1 ELSE 0 END AS months_left, coalesce({_V} >= 2.6, false) AS passed FROM newest"
)
_INTERVAL = (
    "SELECT mac, count(*) AS n, avg(gap) AS mean_gap, max(gap) AS max_gap, coalesce(avg(gap) < 30000 AND max(gap) < 200000, false) "
    "AS passed FROM (SELECT mac, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY mac ORDER BY ts)) / 1e6 AS gap FROM readings) GROUP BY mac"
)


@query("k01_signal_test", with_views("readings", _SIGNAL), "average_rssi")
def _(t: Tables) -> DataFrame:
    return sensors.signal_test(t.readings)


@query("k02_consistency_test", with_views("readings", _CONSISTENCY), "temperature_spread humidity_spread pressure_spread")
def _(t: Tables) -> DataFrame:
    return sensors.consistency_test(t.readings)


@query("k03_range_test", with_views("readings", _RANGE, newest=_NEWEST))
def _(t: Tables) -> DataFrame:
    return sensors.range_test(t.readings).select("mac", F.array_join("issues", ",").alias("issues"), "passed")


@query("k04_battery_test", with_views("readings", _BATTERY, newest=_NEWEST))
def _(t: Tables) -> DataFrame:
    return sensors.battery_test(t.readings)


@query("k05_interval_test", with_views("readings", _INTERVAL), "mean_gap max_gap", 4)
def _(t: Tables) -> DataFrame:
    """Limits as wide as this data's pace."""
    return sensors.interval_test(t.readings, 30000.0, 200000.0)


_CALIBRATION = (
    "SELECT *, tests_passed = 5 AS passed FROM (SELECT s.mac, s.passed AS signal, c.passed AS consistency, r.passed AS range, "
    "b.passed AS battery, i.passed AS interval, s.passed::INT + c.passed::INT + r.passed::INT + b.passed::INT + i.passed::INT "
    "AS tests_passed, 5 AS tests_total "
    "FROM sig s JOIN con c ON c.mac = s.mac JOIN ran r ON r.mac = s.mac JOIN bat b ON b.mac = s.mac JOIN gaps i ON i.mac = s.mac)"
)
_PARTS = {"newest": _NEWEST, "sig": _SIGNAL, "con": _CONSISTENCY, "ran": _RANGE, "bat": _BATTERY, "gaps": _INTERVAL}


@query("k06_calibration", with_views("readings", _CALIBRATION, **_PARTS))
def _(t: Tables) -> DataFrame:
    """Limits as wide as this data's pace, so that some sensors keep them."""
    return sensors.calibration(t.readings, 30000.0, 200000.0)


@query("d26_batch_summary", with_views(
    "readings",
    "SELECT count(*) AS total, count(*) FILTER (tests_passed >= 3) AS successful, count(*) FILTER (tests_passed < 3) AS failed "
    f"FROM ({_CALIBRATION})",
    **_PARTS,
))
def _(t: Tables) -> DataFrame:
    """A sensor counts as successful with three of the five tests."""
    report = sensors.calibration(t.readings, 30000.0, 200000.0)
    return agg.batch_summary(report.select("mac", (F.col("tests_passed") >= 3).alias("passed")))


# --- dimension -------------------------------------------------------------------

@query("k07_active_sensors", with_views("sensors", "SELECT * FROM sensors WHERE enabled AND status = 'active'"))
def _(t: Tables) -> DataFrame:
    return sensors.active(t.sensors)


@query("k08_stale_sensors", with_views(
    "sensors", f"SELECT * FROM sensors WHERE last_seen < timestamp '{NOW}' - interval '24' hour"
))
def _(t: Tables) -> DataFrame:
    return sensors.stale_sensors(t.sensors, 24, NOW)


@query("k09_lookup", with_views(
    "sensors", "SELECT * FROM sensors WHERE lower(name) = 'customer#000000007' OR lower(location) = 'machinery'"
))
def _(t: Tables) -> DataFrame:
    return sensors.by_name(t.sensors, "CUSTOMER#000000007").unionByName(sensors.by_location(t.sensors, "Machinery")).distinct()


_CHANGES = (
    f"SELECT c_custkey AS change_id, CASE c_custkey % 6 WHEN 3 THEN lower({mac_sql('c_custkey + 10000000')}) "
    f"WHEN 4 THEN {mac_sql('c_custkey + 20000000')} WHEN 5 THEN 'zz' ELSE {mac_sql('c_custkey')} END AS mac, "
    "CASE c_custkey % 6 WHEN 0 THEN 'add' WHEN 1 THEN 'update' WHEN 2 THEN 'remove' WHEN 3 THEN 'add' ELSE 'update' END AS action, "
    "concat('sensor ', c_custkey) AS name, 'moved' AS location, cast(NULL AS {text}) AS status FROM {customer} UNION ALL "
    f"SELECT c_custkey + 1000000000, {mac_sql('c_custkey')}, 'remove', NULL, NULL, NULL FROM {{customer}} WHERE c_custkey % 12 = 1"
)


def _changed(t: Tables) -> tuple[DataFrame, DataFrame]:
    changes = t.spark.sql(_CHANGES.replace("{text}", "string"), customer=t.raw("customer"))
    return sensors.apply_changes(t.sensors, changes)


_DUCK_CHANGES = _CHANGES.replace("{text}", "VARCHAR").replace("{customer}", "customer")


@query("k10_apply_changes", with_views(
    "sensors",
    "SELECT s.mac, coalesce(u.name, s.name) AS name, coalesce(u.location, s.location) AS location, s.status, s.enabled, s.last_seen, "
    "s.notes, s.battery_level FROM sensors s LEFT JOIN (SELECT * FROM changes WHERE change_id % 6 = 1 AND change_id < 1000000000) u "
    "ON u.mac = s.mac WHERE s.mac NOT IN (SELECT mac FROM changes WHERE action = 'remove') UNION ALL "
    "SELECT upper(mac), name, location, 'unknown', true, NULL, '', NULL FROM changes WHERE change_id % 6 = 3 AND change_id < 1000000000",
    changes=_DUCK_CHANGES,
))
def _(t: Tables) -> DataFrame:
    return _changed(t)[0]


@query("k10_rejected_changes", with_views(
    "",
    "SELECT change_id, mac, action, CASE change_id % 6 WHEN 0 THEN 'already_exists' WHEN 4 THEN 'not_found' ELSE 'invalid_mac' END "
    "AS reason FROM changes WHERE change_id % 6 IN (0, 4, 5) AND change_id < 1000000000",
    changes=_DUCK_CHANGES,
))
def _(t: Tables) -> DataFrame:
    return _changed(t)[1]


@query("k11_refresh_last_seen", with_views(
    "sensors readings",
    "SELECT s.* REPLACE (greatest(s.last_seen, h.heard) AS last_seen) FROM sensors s LEFT JOIN "
    "(SELECT mac, max(ts) AS heard FROM readings GROUP BY mac) h ON h.mac = s.mac",
))
def _(t: Tables) -> DataFrame:
    return sensors.refresh_last_seen(t.sensors, t.readings)


@query("k12_system_status", with_views(
    "sensors points",
    "SELECT 'sensors' AS item, count(*) AS value FROM sensors UNION ALL SELECT 'active_sensors', count(*) FROM sensors WHERE enabled "
    "AND status = 'active' UNION ALL SELECT 'points_written', count(*) FROM points UNION ALL SELECT 'devices', count(DISTINCT mac) FROM points",
))
def _(t: Tables) -> DataFrame:
    return sensors.system_status(t.sensors, t.points)
