"""The adapter views and shared steps as SQL common table expressions for the oracle queries."""

from __future__ import annotations

CENTS = "CAST(round({0} * 100) AS BIGINT)"
PRICE = CENTS.format("l_extendedprice")

# name -> (needs, SQL). ``with_ctes`` adds what a query needs in order.
CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


def with_ctes(names: list[str] | str, body: str) -> str:
    """``body`` preceded by the named expressions and everything they need.

    A body that starts with a comma goes on with expressions of its own, which may be recursive.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in [names] if isinstance(names, str) else names:
        add(name)
    return ("WITH RECURSIVE " if body.startswith(",") else "WITH ") + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + body


_BAR = f"""date_trunc('week', l_shipdate) AS event_time,
 sum({PRICE})::DOUBLE / sum(CAST(l_quantity AS BIGINT))::DOUBLE / 10000 + 100 AS close,
 sum(CAST(l_quantity AS BIGINT))::DOUBLE AS volume"""

cte("sbars", [], f"SELECT 'S' || l_suppkey AS entity_id, {_BAR} FROM lineitem GROUP BY 1, 2")
cte("bbars", [], f"""SELECT p_brand AS entity_id, {_BAR}
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")


def panel_cte(prefix: str, bars: str) -> None:
    cte(f"{prefix}cal", [bars], f"""SELECT event_time, row_number() OVER (ORDER BY event_time) - 1 AS t,
 count(*) OVER () AS n_dates FROM (SELECT DISTINCT event_time FROM {bars})""")
    cte(f"{prefix}grid", [f"{prefix}cal"], f"""SELECT s.entity_id, c.t, c.event_time, c.n_dates,
 b.close AS px, last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.entity_id ORDER BY c.t
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ff
 FROM {prefix}cal c CROSS JOIN (SELECT DISTINCT entity_id FROM {bars}) s
 LEFT JOIN {bars} b ON b.entity_id = s.entity_id AND b.event_time = c.event_time""")
    cte(f"{prefix}panel", [f"{prefix}grid"], f"""SELECT *,
 ff / lag(ff) OVER (PARTITION BY entity_id ORDER BY t) - 1 AS ret FROM {prefix}grid""")


panel_cte("s", "sbars")
panel_cte("b", "bbars")

cte("sales", [], """SELECT 'warehouse' AS source, 'filing.' || l_linestatus AS dataset,
 'order' AS entity_type, 'O' || l_orderkey AS entity_id, CAST(l_linenumber AS VARCHAR) AS ref,
 o_orderdate::TIMESTAMP AS event_time, l_shipdate AS knowledge_time,
 CAST(l_partkey % 4 AS INTEGER) AS revision, l_extendedprice AS close, l_quantity AS "open",
 l_discount - 0.01 AS low
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")

# Fixed value: the id namespace, as in pitline.functions.scalars.
_ISO = """strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({0}, '%f') = '000000' THEN ''
 ELSE '.' || strftime({0}, '%f') END || '+00:00'"""
cte("obs_sha", ["sales"], f"""SELECT *, sha1(unhex('d5a7e3c21b4f4e8a9c6d2f0b8a1e7c34') ||
 encode(concat_ws('|', source, dataset, entity_id, {_ISO.format('event_time')},
 {_ISO.format('knowledge_time')}, CAST(revision AS VARCHAR), coalesce(ref, '')))) AS h FROM sales""")
cte("obs", ["obs_sha"], """SELECT * EXCLUDE (h), substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' ||
 substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1)
 || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS observation_id FROM obs_sha""")

cte("disc", [], """SELECT 'edgar' AS source, 'filing.form4' AS dataset, 'S' || l_suppkey AS entity_id,
 l_orderkey || '|' || l_linenumber AS ref, o_orderdate::TIMESTAMP AS event_time,
 l_shipdate AS knowledge_time, CAST(l_partkey % 4 AS INTEGER) AS revision,
 'C' || o_custkey AS insider_name, l_returnflag = 'R' AS is_purchase,
 CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS transaction_type,
 o_orderpriority IN ('1-URGENT', '2-HIGH') AS high_signal_role,
 l_orderkey || '|' || l_linenumber || '|' || l_suppkey || '|' || l_partkey || '|' || l_quantity
 AS observation_id
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("discv", ["disc"], """SELECT *, lead(knowledge_time) OVER (PARTITION BY entity_id, event_time, ref
 ORDER BY knowledge_time, revision, observation_id DESC) AS known_until FROM disc""")

cte("earn", [], f"""SELECT 'S' || l_suppkey AS entity_id,
 date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH AS event_time,
 date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH + INTERVAL 30 DAY AS knowledge_time,
 sum({PRICE} * ({CENTS.format('l_discount')} - 4))::DOUBLE / 1000000.0 AS eps
 FROM lineitem GROUP BY 1, 2, 3""")

cte("macro", [], f"""SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'DGS10' ELSE 'DGS2' END AS entity_id,
 date_trunc('month', o_orderdate)::TIMESTAMP AS event_time,
 (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP AS knowledge_time,
 sum({CENTS.format('o_totalprice')})::DOUBLE / count(*) / 1e7 AS value FROM orders
 WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2, 3""")

cte("news", [], f"""SELECT 'U' || user_id AS entity_id, ts AS event_time, ts AS knowledge_time,
 event_type AS title, CASE WHEN event_id % 5 <> 0 THEN 'http://n/' || event_id END AS url,
 ({CENTS.format('value')} % 21 - 10)::DOUBLE AS tone, 'e' || event_id AS observation_id FROM events""")

cte("tsig", [], f"""SELECT 'U' || user_id AS entity_id, ts AS knowledge_time, event_id AS observation_id,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50 - 1 AS score,
 ({CENTS.format('value')} % 101) / 100.0::DOUBLE AS confidence FROM events""")

cte("members", [], """SELECT 'C' || o_custkey AS symbol, min(o_orderdate)::DATE AS added,
 CASE WHEN max(o_orderdate) < TIMESTAMP '2001-06-01' THEN max(o_orderdate)::DATE END AS removed
 FROM orders GROUP BY 1""")


def schedule_cte(name: str, cal: str, warmup: int, every: int, last: int | None = None) -> None:
    """Every ``every``-th date of a calendar after ``warmup``, numbered from 0."""
    tail = f"QUALIFY row_number() OVER (ORDER BY event_time DESC) <= {last}" if last else ""
    cte(name, [cal], f"""SELECT as_of, t, row_number() OVER (ORDER BY as_of) - 1 AS k,
 lead(as_of) OVER (ORDER BY as_of) AS next_as_of FROM
 (SELECT event_time AS as_of, t FROM {cal} WHERE t >= {warmup} AND (t - {warmup}) % {every} = 0 {tail})""")


schedule_cte("sched", "scal", 60, 20)
cte("days", [], """SELECT day AS as_of, row_number() OVER (ORDER BY day) - 1 AS k FROM
 (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS day FROM events)""")

# --- features at the decision times ------------------------------------------------------------

cte("featall", ["spanel"], """SELECT *, ff / lag(ff, 60) OVER w - 1 AS mom_60,
 ff / lag(ff, 20) OVER w - 1 AS mom_20, lag(ff, 21) OVER w / lag(ff, 252) OVER w - 1 AS mom_252_skip21,
 -(ff / lag(ff, 5) OVER w - 1) AS meanrev_5,
 stddev_pop(ret) OVER (PARTITION BY entity_id ORDER BY t ROWS 19 PRECEDING) AS vol_20,
 stddev_samp(ret) OVER (PARTITION BY entity_id ORDER BY t ROWS 19 PRECEDING) AS vol_s20,
 -stddev_pop(ret) OVER (PARTITION BY entity_id ORDER BY t ROWS 119 PRECEDING) AS lowvol_120
 FROM spanel WINDOW w AS (PARTITION BY entity_id ORDER BY t)""")
cte("feat", ["featall", "sched"], """SELECT s.as_of, s.k, f.* EXCLUDE (event_time) FROM featall f
 JOIN sched s ON f.event_time = s.as_of""")
cte("netbuys", ["discv", "sched"], """SELECT as_of, entity_id,
 sum(CASE WHEN is_purchase THEN 1.0 ELSE -1.0 END) AS net FROM sched JOIN discv
 ON knowledge_time <= as_of AND knowledge_time > as_of - INTERVAL 90 DAY
 AND (known_until IS NULL OR known_until > as_of) GROUP BY 1, 2""")
cte("matrix", ["feat", "netbuys"], """SELECT f.as_of, f.k, f.t, f.entity_id, f.ff, mom_60, meanrev_5,
 vol_20, coalesce(net, 0) AS insider_net_buys_90d FROM feat f LEFT JOIN netbuys n
 ON n.as_of = f.as_of AND n.entity_id = f.entity_id""")


def zsql(x: str, by: str = "as_of") -> str:
    """Population z-score of ``x`` within ``by``; a flat column gives 0."""
    w = f"OVER (PARTITION BY {by})"
    return (f"CASE WHEN stddev_pop({x}) {w} IS NULL OR stddev_pop({x}) {w} = 0 THEN {x} * 0.0 "
            f"ELSE ({x} - avg({x}) {w}) / stddev_pop({x}) {w} END")


NAMES = ["mom_60", "meanrev_5", "vol_20", "insider_net_buys_90d"]
cte("zm", ["matrix"], "SELECT as_of, entity_id, k, t, ff, vol_20 AS vol, " + ", ".join(
    f"{zsql(n)} AS z_{n}" for n in NAMES) + " FROM matrix")
cte("score", ["zm"], "SELECT as_of, entity_id, k, t, ff, vol, (" + " + ".join(
    f"coalesce(z_{n}, 0)" for n in NAMES) + ") / 4 AS score FROM zm")
cte("equal", ["feat"], """SELECT 'equal_weight' AS strategy, as_of, k, entity_id,
 1.0 / count(*) OVER (PARTITION BY as_of) AS weight FROM feat WHERE ff IS NOT NULL""")
cte("top10", ["score"], """SELECT 'stacked' AS strategy, as_of, k, entity_id, 1.0 / count(*) OVER
 (PARTITION BY as_of) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY as_of
 ORDER BY score DESC, entity_id) AS rk FROM score WHERE ff IS NOT NULL) WHERE rk <= 10""")
cte("lspair", ["score"], """SELECT 'ls' AS strategy, as_of, k, entity_id, CASE WHEN lo <= kk THEN -1.0 ELSE 1.0
 END / (2.0 * kk) AS weight FROM (SELECT *, least(10, n // 2) AS kk FROM (SELECT *, row_number() OVER
 (PARTITION BY as_of ORDER BY score, entity_id) AS lo, row_number() OVER (PARTITION BY as_of ORDER BY
 score DESC, entity_id DESC) AS hi, count(*) OVER (PARTITION BY as_of) AS n FROM score
 WHERE ff IS NOT NULL AND score <> 0)) WHERE lo <= kk OR hi <= kk""")
cte("books", ["equal", "top10", "lspair"], """SELECT * FROM equal UNION ALL SELECT * FROM top10
 UNION ALL SELECT * FROM lspair""")
cte("turn", ["books", "sched"], """SELECT strategy, k, sum(abs(d)) AS turnover FROM (SELECT strategy, entity_id, k,
 sum(w) AS d FROM (SELECT strategy, entity_id, k, weight AS w FROM books UNION ALL SELECT strategy,
 entity_id, k + 1, -weight FROM books WHERE k + 1 < (SELECT count(*) FROM sched)) GROUP BY ALL)
 GROUP BY ALL""")
cte("bardates", ["scal", "sched"], """SELECT c.event_time, max(s.k) AS k FROM scal c JOIN sched s
 ON s.as_of < c.event_time GROUP BY 1""")
cte("rets", ["books", "turn", "bardates", "spanel", "sched"], """SELECT strategy, event_time, k, gross, cost,
 gross - cost AS net, turnover FROM (SELECT n.strategy, b.event_time, b.k, coalesce(g.gross, 0.0) AS gross,
 CASE WHEN row_number() OVER (PARTITION BY n.strategy, b.k ORDER BY b.event_time) = 1
 THEN coalesce(t.turnover, 0) * 4e-4 + coalesce(h.short, 0) * 50e-4 * (h.days / 365.0) ELSE 0.0 END AS cost,
 CASE WHEN row_number() OVER (PARTITION BY n.strategy, b.k ORDER BY b.event_time) = 1 THEN t.turnover END
 AS turnover FROM bardates b CROSS JOIN (SELECT DISTINCT strategy FROM books) n
 LEFT JOIN (SELECT strategy, p.event_time, sum(weight * ret) AS gross FROM books w JOIN bardates d
 ON d.k = w.k JOIN spanel p ON p.event_time = d.event_time AND p.entity_id = w.entity_id WHERE ret IS NOT NULL
 GROUP BY 1, 2) g ON g.strategy = n.strategy AND g.event_time = b.event_time
 LEFT JOIN turn t ON t.strategy = n.strategy AND t.k = b.k
 LEFT JOIN (SELECT strategy, s.k, sum(CASE WHEN weight < 0 THEN -weight ELSE 0 END) AS short,
 any_value(date_diff('day', s.as_of, coalesce(s.next_as_of, (SELECT max(event_time) FROM scal)))) AS days
 FROM books w JOIN sched s ON s.k = w.k GROUP BY 1, 2) h ON h.strategy = n.strategy AND h.k = b.k)""")
cte("curve", ["rets"], """SELECT *, equity / peak - 1 AS drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY
 strategy ORDER BY event_time) AS peak FROM (SELECT *, (product(1 + net) OVER (PARTITION BY strategy ORDER BY
 event_time)) AS equity FROM rets))""")
