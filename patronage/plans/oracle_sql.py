"""DuckDB twins of the Spark plans, used only to cross-check results.

Each named fragment is one CTE; ``compose`` emits the fragments a final
SELECT needs, in dependency order.  The fragments mirror the Spark
operators' definitions (same integer-cent arithmetic, same tie-breaks).
"""

from __future__ import annotations

from patronage.functions.lookups import SEGMENT_PATTERNS, DEFAULT_SEGMENT, TIER_OF_NAME


def _segment_case(score: str) -> str:
    parts = [f"WHEN regexp_matches({score}, '^(?:{p})') THEN '{n}'"
             for p, n in reversed(SEGMENT_PATTERNS)]
    return "CASE " + " ".join(parts) + f" ELSE '{DEFAULT_SEGMENT}' END"


def _tier_case(name: str) -> str:
    parts = [f"WHEN {name} = '{k}' THEN '{v}'" for k, v in TIER_OF_NAME.items()]
    return "CASE " + " ".join(parts) + " END"


def _quart(r: str, n: str) -> str:
    return ("CAST(1 + " + " + ".join(
        f"CAST(4 * ({r} - 1) > {k} * ({n} - 1) AS INTEGER)" for k in (1, 2, 3)) + " AS INTEGER)")


DAY_US = 86400000000

FRAGMENTS: dict[str, tuple[list[str], str]] = {}


def fragment(name: str, deps: list[str], sql: str) -> None:
    FRAGMENTS[name] = (deps, sql)


fragment("log", [], """
SELECT
  CASE WHEN l.l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(o.o_orderkey AS VARCHAR) AS InvoiceNo,
  CAST(l.l_partkey AS VARCHAR) AS StockCode,
  CASE WHEN l.l_returnflag = 'R' OR l.l_suppkey % 41 = 0 THEN -CAST(l.l_quantity AS BIGINT)
       ELSE CAST(l.l_quantity AS BIGINT) END AS Quantity,
  CAST(o.o_orderdate AS TIMESTAMP)
    + to_minutes(CAST((o.o_orderkey * 37) % 840 + 360 AS BIGINT)) AS InvoiceDate,
  CASE WHEN l.l_partkey % 97 = 0 THEN CAST(0 AS BIGINT)
       ELSE CAST(round(l.l_extendedprice * 100) AS BIGINT) // CAST(l.l_quantity AS BIGINT)
  END AS unit_cents,
  CASE WHEN o.o_orderkey % 50 = 0 THEN NULL ELSE o.o_custkey END AS CustomerID,
  n.n_name AS Country,
  CAST(l.l_linenumber AS BIGINT) AS line
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
""")

fragment("logx", ["log"], """
SELECT *, unit_cents / 100.0 AS UnitPrice FROM log
""")

fragment("clean", ["log"], f"""
SELECT *, unit_cents / 100.0 AS UnitPrice, Quantity * unit_cents AS spend_cents,
       (Quantity * unit_cents) / 100.0 AS TotalSpend,
       CAST(year(InvoiceDate) AS INTEGER) AS Year, CAST(month(InvoiceDate) AS INTEGER) AS Month,
       CAST(day(InvoiceDate) AS INTEGER) AS Day, CAST(isodow(InvoiceDate) - 1 AS INTEGER) AS Weekday,
       CAST(hour(InvoiceDate) AS INTEGER) AS Hour, CAST(InvoiceDate AS DATE) AS Date
FROM log
WHERE NOT starts_with(InvoiceNo, 'C') AND Quantity > 0 AND unit_cents > 0
  AND CustomerID IS NOT NULL
""")

fragment("snap", ["clean"], """
SELECT max(InvoiceDate) + INTERVAL 1 DAY AS snapshot FROM clean
""")

fragment("cust", ["clean", "snap"], f"""
SELECT CustomerID,
  (epoch_us((SELECT snapshot FROM snap)) - epoch_us(max(InvoiceDate))) // {DAY_US} AS Recency,
  count(DISTINCT InvoiceNo) AS Frequency,
  CAST(sum(spend_cents) AS BIGINT) AS monetary_cents,
  CAST(sum(spend_cents) AS BIGINT) / 100.0 AS Monetary,
  CAST(sum(Quantity) AS BIGINT) AS TotalQuantity,
  count(DISTINCT StockCode) AS UniqueProducts,
  arg_min(Country, CASE WHEN Country IS NOT NULL
          THEN {{'d': InvoiceDate, 'c': Country}} END) AS Country,
  (CAST(sum(spend_cents) AS BIGINT) / 100.0) / CAST(count(DISTINCT InvoiceNo) AS DOUBLE)
    AS AvgTransactionValue,
  CAST(sum(Quantity) AS DOUBLE) / CAST(count(DISTINCT InvoiceNo) AS DOUBLE) AS AvgItemsPerTransaction
FROM clean GROUP BY CustomerID
""")

fragment("r_edges", ["cust"], """
SELECT quantile_cont(Recency, 0.25) AS e1, quantile_cont(Recency, 0.5) AS e2,
       quantile_cont(Recency, 0.75) AS e3 FROM cust
""")

fragment("rfm", ["cust", "r_edges"], f"""
SELECT c.*,
  CAST(5 - (1 + CAST(c.Recency > e.e1 AS INTEGER) + CAST(c.Recency > e.e2 AS INTEGER)
            + CAST(c.Recency > e.e3 AS INTEGER)) AS INTEGER) AS R_Score,
  {_quart('row_number() OVER (ORDER BY c.Frequency, c.CustomerID)', 'count(*) OVER ()')} AS F_Score,
  {_quart('row_number() OVER (ORDER BY c.monetary_cents, c.CustomerID)', 'count(*) OVER ()')} AS M_Score
FROM cust c, r_edges e
""")

fragment("seg", ["rfm"], f"""
SELECT *, CAST(R_Score AS VARCHAR) || CAST(F_Score AS VARCHAR) || CAST(M_Score AS VARCHAR) AS RFM_Score,
       CAST(R_Score + F_Score + M_Score AS INTEGER) AS RFM_Sum,
       {_segment_case("CAST(R_Score AS VARCHAR) || CAST(F_Score AS VARCHAR) || CAST(M_Score AS VARCHAR)")} AS Segment
FROM rfm
""")


def compose(final: str, needs: list[str]) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in FRAGMENTS[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return final
    ctes = ",\n".join(f"{n} AS ({FRAGMENTS[n][1].strip()})" for n in order)
    body = final.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"


def np_round_sql(expr: str, decimals: int = 2) -> str:
    """DuckDB twin of ``np_round``: half-even on the binary value of x*10^d."""
    scale = float(10 ** decimals)
    return f"(CAST(round_even(CAST({expr} AS DOUBLE) * {scale}, 0) AS DOUBLE) / {scale})"


def tier_case(name: str) -> str:
    return _tier_case(name)


def segment_case(score: str) -> str:
    return _segment_case(score)


def quart(r: str, n: str) -> str:
    return _quart(r, n)


fragment("logd", ["logx"], """
SELECT g.*, p.p_name AS Description FROM logx g LEFT JOIN part p ON CAST(g.StockCode AS BIGINT) = p.p_partkey
""")


_DAYS = ", ".join(f"count(*) FILTER (WHERE Weekday = {i}) AS Day_{i}_Purchases" for i in range(7))
_HOURS = ", ".join(f"count(*) FILTER (WHERE Hour = {i}) AS Hour_{i}_Purchases" for i in range(24))

fragment("feat0", ["clean", "snap"], f"""
SELECT CustomerID, min(InvoiceDate) AS FirstPurchase, max(InvoiceDate) AS LastPurchase,
  count(*) AS PurchaseCount, CAST(sum(spend_cents) AS BIGINT) AS monetary_cents,
  CAST(sum(Quantity) AS BIGINT) AS TotalQuantity, count(DISTINCT StockCode) AS UniqueProducts,
  count(DISTINCT InvoiceNo) AS TransactionCount,
  arg_min(Country, CASE WHEN Country IS NOT NULL
          THEN {{'d': InvoiceDate, 'c': Country}} END) AS Country,
  CAST(sum(CASE WHEN InvoiceDate >= snapshot - INTERVAL 90 DAY THEN spend_cents ELSE 0 END) AS BIGINT) AS recent_cents,
  count(DISTINCT CASE WHEN InvoiceDate >= snapshot - INTERVAL 90 DAY THEN InvoiceNo END) AS Recent90DayTransactions,
  CAST(sum(CASE WHEN InvoiceDate BETWEEN snapshot - INTERVAL 90 DAY AND snapshot - INTERVAL 1 DAY
           THEN spend_cents ELSE 0 END) AS BIGINT) AS target_cents,
  {_DAYS}, {_HOURS}, max(snapshot) AS snapshot
FROM clean, snap GROUP BY CustomerID
""")

fragment("feat", ["feat0"], f"""
SELECT CustomerID, FirstPurchase, LastPurchase, PurchaseCount, monetary_cents / 100.0 AS TotalMonetary,
  TotalQuantity, UniqueProducts, TransactionCount, Country,
  (epoch_us(LastPurchase) - epoch_us(FirstPurchase)) // {DAY_US} + 1 AS CustomerLifespan,
  (monetary_cents / 100.0) / CAST(TransactionCount AS DOUBLE) AS AvgTransactionValue,
  CAST(TotalQuantity AS DOUBLE) / CAST(TransactionCount AS DOUBLE) AS AvgItemsPerTransaction,
  CAST(TransactionCount AS DOUBLE) / CAST((epoch_us(LastPurchase) - epoch_us(FirstPurchase)) // {DAY_US} + 1 AS DOUBLE)
    AS PurchaseFrequency,
  (epoch_us(snapshot) - epoch_us(LastPurchase)) // {DAY_US} AS Recency,
  {", ".join(f"Day_{i}_Purchases" for i in range(7))},
  {", ".join(f"Hour_{i}_Purchases" for i in range(24))},
  recent_cents / 100.0 AS Recent90DaySpend, Recent90DayTransactions,
  target_cents / 100.0 AS Actual_Future_Spend, monetary_cents, recent_cents, target_cents
FROM feat0
""")

fragment("hist0", ["feat"], """
SELECT CustomerID, TotalMonetary, TransactionCount, CustomerLifespan, AvgTransactionValue,
  Recent90DaySpend, Recent90DayTransactions,
  TotalMonetary / CAST(CustomerLifespan AS DOUBLE) AS DailySpend,
  TotalMonetary / CAST(CustomerLifespan AS DOUBLE) * CAST(365 AS DOUBLE) AS CLV_DailyAvg,
  CAST(TransactionCount AS DOUBLE) / CAST(CustomerLifespan AS DOUBLE) * CAST(365 AS DOUBLE)
    * AvgTransactionValue AS CLV_FrequencyBased,
  Recent90DaySpend * CAST(4 AS DOUBLE) AS CLV_RecentBased
FROM feat
""")

fragment("hist1", ["hist0"], """
SELECT *, CLV_DailyAvg * CAST(0.3 AS DOUBLE) + CLV_FrequencyBased * CAST(0.4 AS DOUBLE)
          + CLV_RecentBased * CAST(0.3 AS DOUBLE) AS CLV_Historical FROM hist0
""")


def tier_sql(src: str, col: str, out: str, lo: float = 0.33, hi: float = 0.66) -> str:
    return f"""
SELECT s.*, CASE WHEN s.{col} IS NULL THEN NULL WHEN s.{col} <= q.lo THEN 'Low'
                 WHEN s.{col} <= q.hi THEN 'Medium' ELSE 'High' END AS {out}
FROM {src} s, (SELECT quantile_cont({col}, {lo}) AS lo, quantile_cont({col}, {hi}) AS hi FROM {src}) q"""


fragment("hist", ["hist1"], tier_sql("hist1", "CLV_Historical", "CLV_Tier"))

# Stand-in scores: the ML and probabilistic CLVs come from fitted models that
# SQL cannot reproduce, so the ensemble arithmetic is cross-checked on
# deterministic stand-ins derived from the same customers.
fragment("ml_s0", ["feat"], """
SELECT CustomerID, TotalMonetary * CAST(0.5 AS DOUBLE)
  + Actual_Future_Spend * (CAST(365 AS DOUBLE) / CAST(90 AS DOUBLE)) AS CLV_ML
FROM feat WHERE CustomerID % 10 <> 0
""")
fragment("ml_s", ["ml_s0"], tier_sql("ml_s0", "CLV_ML", "CLV_Tier_ML"))
fragment("prob_s0", ["hist"], """
SELECT CustomerID, CLV_DailyAvg * CAST(0.5 AS DOUBLE) AS CLV_Probabilistic
FROM hist WHERE TransactionCount > 1
""")
fragment("prob_s", ["prob_s0"], tier_sql("prob_s0", "CLV_Probabilistic", "CLV_Tier_Prob",
                                         1 / 3, 2 / 3))
fragment("cmp", ["feat", "hist", "ml_s", "prob_s"], """
SELECT f.CustomerID, h.CLV_Historical, h.CLV_Tier, m.CLV_ML, m.CLV_Tier_ML,
       p.CLV_Probabilistic, p.CLV_Tier_Prob
FROM feat f LEFT JOIN hist h ON f.CustomerID = h.CustomerID
LEFT JOIN ml_s m ON f.CustomerID = m.CustomerID LEFT JOIN prob_s p ON f.CustomerID = p.CustomerID
""")
fragment("ens0", ["cmp", "feat"], """
SELECT c.CustomerID, coalesce(TRY_CAST(c.CLV_Historical AS DOUBLE), 0) AS CLV_Historical,
  coalesce(TRY_CAST(c.CLV_ML AS DOUBLE), 0) AS CLV_ML,
  coalesce(TRY_CAST(c.CLV_Probabilistic AS DOUBLE), 0) AS CLV_Probabilistic,
  coalesce(CAST(f.TransactionCount AS DOUBLE), 0) AS TransactionCount
FROM cmp c LEFT JOIN feat f ON c.CustomerID = f.CustomerID
""")
fragment("ens1", ["ens0"], """
SELECT *, greatest(0.0, least(TransactionCount / CAST(20 AS DOUBLE), CAST(0.6 AS DOUBLE))) AS wh,
  greatest(0.0, least(CAST(1 AS DOUBLE) - TransactionCount / CAST(20 AS DOUBLE), CAST(0.6 AS DOUBLE))) AS wp,
  CAST(0.4 AS DOUBLE) AS wm FROM ens0
""")
fragment("ens2", ["ens1"], """
SELECT CustomerID, CLV_Historical, CLV_ML, CLV_Probabilistic, TransactionCount,
  wh / (wh + wp + wm) AS weight_historical, wp / (wh + wp + wm) AS weight_probabilistic,
  wm / (wh + wp + wm) AS weight_ml,
  wh / (wh + wp + wm) * CLV_Historical + wp / (wh + wp + wm) * CLV_Probabilistic
    + wm / (wh + wp + wm) * CLV_ML AS CLV_Final
FROM ens1
""")
fragment("ens", ["ens2"], tier_sql("ens2", "CLV_Final", "CLV_Tier_Final"))


fragment("lt_daily", ["clean", "snap"], """
SELECT CustomerID, CAST(InvoiceDate AS DATE) AS d, sum(spend_cents) AS cents
FROM clean, snap WHERE InvoiceDate <= snapshot GROUP BY 1, 2
""")
fragment("lt", ["lt_daily", "snap"], """
SELECT CustomerID, CAST(count(*) - 1 AS BIGINT) AS frequency, CAST(max(d) - min(d) AS DOUBLE) AS recency,
  CAST(CAST(max(snapshot) AS DATE) - min(d) AS DOUBLE) AS T,
  CASE WHEN count(*) > 1 THEN CAST(sum(cents) - arg_min(cents, d) AS DOUBLE) / 100.0
       / CAST(count(*) - 1 AS DOUBLE) ELSE 0.0 END AS monetary_value
FROM lt_daily, snap GROUP BY CustomerID
""")
fragment("calh", ["clean", "snap"], """
WITH ce AS (SELECT snapshot - INTERVAL 90 DAY AS cal_end, snapshot FROM snap),
cd AS (SELECT CustomerID, CAST(InvoiceDate AS DATE) AS d, sum(spend_cents) AS cents
       FROM clean, ce WHERE InvoiceDate <= cal_end GROUP BY 1, 2),
cs AS (SELECT CustomerID, CAST(count(*) - 1 AS BIGINT) AS frequency_cal,
         CAST(max(d) - min(d) AS DOUBLE) AS recency_cal,
         CAST(CAST(max(cal_end) AS DATE) - min(d) AS DOUBLE) AS T_cal,
         CASE WHEN count(*) > 1 THEN CAST(sum(cents) - arg_min(cents, d) AS DOUBLE) / 100.0
              / CAST(count(*) - 1 AS DOUBLE) ELSE 0.0 END AS monetary_value_cal
       FROM cd, ce GROUP BY CustomerID),
hd AS (SELECT CustomerID, CAST(InvoiceDate AS DATE) AS d, sum(spend_cents) AS cents
       FROM clean, ce WHERE InvoiceDate > cal_end AND InvoiceDate <= snapshot GROUP BY 1, 2),
hs AS (SELECT CustomerID, count(*) AS frequency_holdout,
         CAST(sum(cents) AS DOUBLE) / 100.0 / CAST(count(*) AS DOUBLE) AS monetary_value_holdout
       FROM hd GROUP BY CustomerID)
SELECT cs.*, coalesce(CAST(hs.frequency_holdout AS DOUBLE), 0.0) AS frequency_holdout,
  coalesce(hs.monetary_value_holdout, 0.0) AS monetary_value_holdout,
  CAST(CAST(ce.snapshot AS DATE) - CAST(ce.cal_end AS DATE) AS DOUBLE) AS duration_holdout
FROM cs LEFT JOIN hs ON cs.CustomerID = hs.CustomerID, ce
""")


def p_alive_sql(r, alpha, a, b, x="frequency", tx="recency", T="T") -> str:
    return (f"CASE WHEN {x} = 0 THEN 1.0 ELSE 1.0 / (1.0 + exp(({r} + CAST({x} AS DOUBLE)) "
            f"* ln(({alpha} + {T}) / ({alpha} + {tx})) + ln({a} / ({b} + greatest(CAST({x} AS DOUBLE), 1.0) - 1))))"
            " END")


def gg_value_sql(p, q, v, x="frequency", m="monetary_value") -> str:
    w = f"({p} * CAST({x} AS DOUBLE) / ({p} * CAST({x} AS DOUBLE) + {q} - 1))"
    return f"((1.0 - {w}) * ({v} * {p} / ({q} - 1)) + {w} * {m})"


def bgnbd_ll_sql(r, alpha, a, b, x="frequency", tx="recency", T="T") -> str:
    xd = f"CAST({x} AS DOUBLE)"
    a3 = f"(-({r} + {xd}) * ln({alpha} + {T}))"
    a4 = (f"(ln({a}) - ln({b} + greatest({xd}, 1.0) - 1) - ({r} + {xd}) * ln({alpha} + {tx}))")
    lse = f"(greatest({a3}, {a4}) + ln(1 + exp(-abs({a3} - {a4}))))"
    return (f"(lgamma({r} + {xd}) - lgamma({r}) + {r} * ln({alpha}) + lgamma({a} + {b}) "
            f"+ lgamma({b} + {xd}) - lgamma({b}) - lgamma({a} + {b} + {xd}) "
            f"+ CASE WHEN {x} > 0 THEN {lse} ELSE {a3} END)")


from patronage.functions.lookups import CLUSTER_NAMES  # noqa: E402


def cluster_name_case(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {k} THEN '{v}'" for k, v in CLUSTER_NAMES.items()) + " END"


fragment("zbase", ["cust"], """
SELECT CustomerID, Recency, Frequency, Monetary, monetary_cents, TotalQuantity, UniqueProducts,
  ln(1 + CAST(Recency AS DOUBLE)) AS Recency_log, ln(1 + CAST(Frequency AS DOUBLE)) AS Frequency_log,
  ln(1 + CAST(Monetary AS DOUBLE)) AS Monetary_log FROM cust
""")
fragment("z", ["zbase"], """
SELECT b.*, CASE WHEN s.sr > 0 THEN (Recency_log - s.mr) / s.sr ELSE 0.0 END AS Recency_log_z,
  CASE WHEN s.sf > 0 THEN (Frequency_log - s.mf) / s.sf ELSE 0.0 END AS Frequency_log_z,
  CASE WHEN s.sm > 0 THEN (Monetary_log - s.mm) / s.sm ELSE 0.0 END AS Monetary_log_z
FROM zbase b, (SELECT avg(Recency_log) AS mr, stddev_pop(Recency_log) AS sr, avg(Frequency_log) AS mf,
  stddev_pop(Frequency_log) AS sf, avg(Monetary_log) AS mm, stddev_pop(Monetary_log) AS sm FROM zbase) s
""")
fragment("zr", ["z"], """
SELECT z.*, CAST(5 - (1 + CAST(z.Recency > e.e1 AS INTEGER) + CAST(z.Recency > e.e2 AS INTEGER)
            + CAST(z.Recency > e.e3 AS INTEGER)) AS INTEGER) AS R_Score
FROM z, (SELECT quantile_cont(Recency, 0.25) AS e1, quantile_cont(Recency, 0.5) AS e2,
         quantile_cont(Recency, 0.75) AS e3 FROM z) e
""")
fragment("cent", ["zr"], """
SELECT R_Score - 1 AS cluster, avg(Recency_log_z) AS c0, avg(Frequency_log_z) AS c1,
       avg(Monetary_log_z) AS c2 FROM zr GROUP BY 1
""")
fragment("clus", ["zr", "cent"], f"""
SELECT zr.*, a.Cluster, {cluster_name_case('a.Cluster')} AS Cluster_Name FROM zr JOIN (
  SELECT zr.CustomerID, CAST(arg_min(c.cluster, {{'d': (zr.Recency_log_z - c.c0) * (zr.Recency_log_z - c.c0)
        + (zr.Frequency_log_z - c.c1) * (zr.Frequency_log_z - c.c1)
        + (zr.Monetary_log_z - c.c2) * (zr.Monetary_log_z - c.c2), 'c': c.cluster}}) AS INTEGER) AS Cluster
  FROM zr, cent c GROUP BY zr.CustomerID) a ON zr.CustomerID = a.CustomerID
""")
fragment("cprof", ["clus"], f"""
SELECT Cluster, count(*) AS CustomerID, {np_round_sql('avg(CAST(Recency AS DOUBLE))')} AS Recency,
  {np_round_sql('avg(CAST(Frequency AS DOUBLE))')} AS Frequency,
  {np_round_sql('sum(monetary_cents) / 100.0 / CAST(count(*) AS DOUBLE)')} AS Monetary,
  {np_round_sql('avg(CAST(TotalQuantity AS DOUBLE))')} AS TotalQuantity,
  {np_round_sql('avg(CAST(UniqueProducts AS DOUBLE))')} AS UniqueProducts,
  {np_round_sql('CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM clus) AS DOUBLE) * 100.0', 1)} AS pct_customers,
  CAST(sum(monetary_cents) AS DOUBLE) / 100.0 AS Total_Revenue,
  {np_round_sql('CAST(sum(monetary_cents) AS DOUBLE) / CAST((SELECT sum(monetary_cents) FROM clus) AS DOUBLE) * 100.0', 1)} AS pct_revenue
FROM clus GROUP BY Cluster
""")
fragment("cmpseg", ["clus", "seg"], """
SELECT c.CustomerID, c.Recency, c.Frequency, c.Monetary, c.Cluster, c.Cluster_Name, s.Segment, s.RFM_Sum
FROM clus c LEFT JOIN seg s ON c.CustomerID = s.CustomerID
""")


_MLF = (["TransactionCount", "TotalMonetary", "TotalQuantity", "UniqueProducts", "CustomerLifespan",
         "AvgTransactionValue", "AvgItemsPerTransaction", "PurchaseFrequency", "Recency"]
        + [f"Day_{i}_Purchases" for i in range(7)]
        + [f"Hour_{i}_Purchases" for i in (9, 10, 11, 12, 13, 14, 15)])

fragment("mlds", ["feat"], "SELECT CustomerID, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _MLF)
         + ", coalesce(Actual_Future_Spend, 0.0) AS Actual_Future_Spend, "
         "CAST(('0x' || substr(md5(CAST(CustomerID AS VARCHAR)), 1, 8)) AS UBIGINT) % 100 < 80 AS is_train, "
         "CAST(TotalMonetary AS DOUBLE) / CAST(CustomerLifespan AS DOUBLE) * CAST(90 AS DOUBLE) AS baseline_90d "
         "FROM feat")
fragment("mlpred0", ["mlds"], """
SELECT CustomerID, baseline_90d AS Predicted_90Day_Spend,
       baseline_90d * (CAST(365 AS DOUBLE) / CAST(90 AS DOUBLE)) AS Predicted_CLV_1Year FROM mlds
""")
fragment("mlpred", ["mlpred0"], tier_sql("mlpred0", "Predicted_CLV_1Year", "CLV_Tier_ML"))


# the same customer plans over the second log: purchase events (one event =
# one invoice of quantity 1)
fragment("elog", [], """
SELECT CAST(event_id AS VARCHAR) AS InvoiceNo, 'event' AS StockCode, CAST(1 AS BIGINT) AS Quantity,
  CAST(ts AS TIMESTAMP) AS InvoiceDate, CAST(round(value * 100) AS BIGINT) AS unit_cents,
  CAST(user_id AS BIGINT) AS CustomerID, CAST(NULL AS VARCHAR) AS Country, CAST(1 AS BIGINT) AS line
FROM events WHERE event_type = 'purchase'
""")


def _retarget(name: str, new: str, mapping: dict[str, str]) -> None:
    deps, sql = FRAGMENTS[name]
    for old, repl in mapping.items():
        sql = sql.replace(f"FROM {old}", f"FROM {repl}").replace(f", {old} ", f", {repl} ") \
                 .replace(f"FROM {old},", f"FROM {repl},").replace(f"SELECT snapshot FROM {old}",
                                                                     f"SELECT snapshot FROM {repl}")
    fragment(new, [mapping.get(d, d) for d in deps], sql)


_EV = {"log": "elog", "clean": "eclean", "snap": "esnap", "lt_daily": "elt_daily", "cust": "ecust"}
for _src, _dst in [("clean", "eclean"), ("snap", "esnap"), ("cust", "ecust"),
                   ("lt_daily", "elt_daily"), ("lt", "elt")]:
    _retarget(_src, _dst, _EV)


def expected_purchases_sql(r, alpha, a, b, t, x="frequency", tx="recency", T="T",
                           terms: int = 4000) -> str:
    """DuckDB twin of the BG/NBD conditional expectation: the Gauss series is
    summed term by term (lgamma form) in a correlated subquery."""
    xd = f"CAST({x} AS DOUBLE)"
    A, B, C = f"({r} + {xd})", f"({b} + {xd})", f"({a} + {b} + {xd} - 1)"
    z = f"({t} / ({alpha} + {T} + {t}))"
    term = (f"exp(lgamma({A} + k) - lgamma({A}) + lgamma({B} + k) - lgamma({B}) - lgamma({C} + k) "
            f"+ lgamma({C}) - lgamma(k + 1) + k * ln({z}) + {A} * ln(1 - {z}))")
    series = f"(SELECT sum({term}) FROM range(0, {terms}) rr(k))"
    first = f"(({a} + {b} + {xd} - 1) / ({a} - 1))"
    den = (f"(CASE WHEN {x} > 0 THEN 1.0 + exp({A} * ln(({alpha} + {T}) / ({alpha} + {tx})) "
           f"+ ln({a} / ({b} + greatest({xd}, 1.0) - 1))) ELSE 1.0 END)")
    return f"({first} * (1.0 - {series}) / {den})"
