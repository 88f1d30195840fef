"""Chart-data jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.quantiles import box_summary
from ..plans import charts
from .registry import query


@query("V1_error_bars", """
    SELECT event_type, round(m, 7) AS mean, round(m - se, 7) AS low, round(m + se, 7) AS high FROM
      (SELECT event_type, avg(value) AS m, stddev_samp(value)/sqrt(count(value)) AS se FROM events GROUP BY 1)""")
def v1(t):
    e = charts.error_bars(t.events, ["event_type"], "value")
    return e.withColumns({c: F.round(c, 7) for c in ("mean", "low", "high")})


@query("V2_box_summary", """
    SELECT event_type, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3,
           min(value) FILTER (value BETWEEN q1 - 1.5*(q3 - q1) AND q3 + 1.5*(q3 - q1)) AS whisker_low,
           max(value) FILTER (value BETWEEN q1 - 1.5*(q3 - q1) AND q3 + 1.5*(q3 - q1)) AS whisker_high,
           count(*) FILTER (value < q1 - 1.5*(q3 - q1) OR value > q3 + 1.5*(q3 - q1)) AS outliers
    FROM events JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
                             quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) USING (event_type)
    GROUP BY event_type, q1, q2, q3""")
def v2(t):
    b = box_summary(t.events, ["event_type"], "value")
    return b.withColumns({c: F.round(c, 6) for c in ("q1", "q2", "q3")})


@query("V3_histogram", """
    SELECT lang, least(29, CAST(floor((n_chars - lo) / ((hi - lo) / 30)) AS INTEGER)) AS bin, count(*) AS n
    FROM documents, (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) GROUP BY ALL""")
def v3(t):
    return charts.histogram(t.documents, ["lang"], "n_chars").select("lang", "bin", "n")


@query("V5_pair_lines", """
    SELECT l_orderkey, round(lo, 6) AS "A", round(hi, 6) AS "R" FROM
      (SELECT l_orderkey, avg(l_quantity) FILTER (l_returnflag = 'A') AS lo, avg(l_quantity) FILTER (l_returnflag = 'R') AS hi
       FROM lineitem GROUP BY 1) WHERE lo IS NOT NULL AND hi IS NOT NULL""")
def v5(t):
    means = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("q"))
    return charts.pair_lines(means, ["l_orderkey"], "l_returnflag", ["A", "R"], "q")


@query("C34_plot_slice", """
    SELECT l_linestatus, 'summary' AS kind, round(avg(l_quantity), 7) AS value, round(stddev_samp(l_quantity)/sqrt(count(*)), 8) AS se,
           'returned' AS l_returnflag FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1
    UNION ALL SELECT l_linestatus, 'raw', l_quantity, NULL, 'returned' FROM lineitem WHERE l_returnflag = 'R'""")
def c34(t):
    s = charts.plot_slice(t.lineitem, ["l_linestatus"], "l_returnflag", "R", "returned", "l_quantity")
    return s.withColumns({"value": F.round("value", 7), "se": F.round("se", 8)})
