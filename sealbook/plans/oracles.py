"""The registered queries once more, as SQL for another engine. Written apart from the operators."""

from __future__ import annotations

from hashlib import sha256

from sealbook.plans.scenarios import CUT_MS, DAILY, LINES, NOW_MS, WEEKLY
from sealbook.settings import DAY_MS

_DRAW = "CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), {at}, 4) AS BIGINT)"


def _events(customers: int | None = None) -> str:
    user = "user_id" if customers is None else f"user_id % {customers}"
    t = "(epoch_us(ts) // 1000)"
    return f"""ev AS (
      SELECT '00000000-0000-7000-8000-' || format('{{:012x}}', event_id) AS event_id,
        CAST({user} AS VARCHAR) AS customer_id,
        CASE WHEN event_type = 'view' THEN 'view_gauge' ELSE event_type END AS metric,
        CAST(CAST(value AS DECIMAL(20,6)) * 1000000 AS BIGINT) AS q,
        {t} AS t,
        {t} + {_DRAW.format(at=1)} % 3001 - 1500
          + CASE WHEN {_DRAW.format(at=5)} % 10 = 0 THEN {_DRAW.format(at=9)} * 3956 ELSE 0 END AS ing,
        props AS payload
      FROM events)"""


_LINES = """li AS (
      SELECT '00000000-0000-7000-' || format('{:04x}', l_linenumber) || '-' || format('{:012x}', l_orderkey) AS event_id,
        CAST(l_suppkey AS VARCHAR) AS customer_id, l_returnflag AS metric,
        CAST(CAST(l_quantity AS DECIMAL(20,6)) * 1000000 AS BIGINT) AS q,
        epoch_us(l_shipdate) // 1000 AS t, epoch_us(l_shipdate) // 1000 + 86400000 AS ing,
        row_number() OVER (ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                           l_discount, l_tax, l_returnflag, l_linestatus) AS arr,
        l_partkey, l_linestatus AS part
      FROM lineitem)"""

_FIRST_LINES = _LINES + """,
    fl AS (SELECT * FROM li QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arr) = 1)"""


def _windowed(name: str, source: str, w: int) -> str:
    return f"""{name} AS (
      SELECT *, t - t % {w} AS o, customer_id || ':' || metric || ':' || CAST(t - t % {w} AS VARCHAR) AS k FROM {source})"""


def _sealed(source: str, settings, now: int = NOW_MS) -> str:
    """Windows, watermarks and state of a log sealed once at its end."""
    w = settings.window_ms
    return _windowed("wl", source, w) + f""",
    wm AS (SELECT customer_id, metric, max(t) - {settings.grace_ms} AS wm FROM {source} GROUP BY ALL),
    win AS (SELECT k, customer_id, metric, o, o + {w} AS c, o + {w} <= wm AS sealed,
              CASE WHEN o + {w} <= wm THEN wm END AS swm, wm
            FROM (SELECT DISTINCT k, customer_id, metric, o FROM wl) JOIN wm USING (customer_id, metric))"""


def _money(x: str) -> str:
    d = f"lpad(CAST(abs({x}) AS VARCHAR), CAST(greatest(7, length(CAST(abs({x}) AS VARCHAR))) AS INTEGER), '0')"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || {d}[:-7] || '.' || {d}[-6:])"


_MODE = "CASE WHEN {m} IN ('active_seats', 'plan_tier', 'concurrent_connections') OR suffix({m}, '_gauge') THEN 'gauge' ELSE 'counter' END"
_VALUE = ("CASE WHEN any_value(" + _MODE.format(m="metric") + ") = 'gauge' "
          "THEN CAST(last(q ORDER BY t, event_id) AS HUGEINT) ELSE sum(q) END")

_TOTALS = f"""tot AS (
      SELECT k, {_VALUE} AS micros, count(*) AS n FROM wl GROUP BY k),
    totals AS (SELECT win.*, coalesce(micros, 0) AS micros, coalesce(n, 0) AS n FROM win LEFT JOIN tot USING (k))"""


def _chain(source: str, part: str, settings) -> str:
    """Two ingest batches of ``source``, a seal after each: disp, corr, log, win, wm."""
    w, g = settings.window_ms, settings.grace_ms
    return _windowed("d", source, w) + f""",
    d1 AS (SELECT * FROM d WHERE {part}), d2 AS (SELECT * FROM d WHERE NOT ({part})),
    f1 AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arr) = 1),
    x1 AS (SELECT d1.*, CASE WHEN d1.arr = f1.arr THEN 'accepted' ELSE 'deduped' END AS disposition,
             d1.q <> f1.q AS conflict, f1.k AS ok, f1.customer_id AS oc, f1.metric AS om, f1.t AS ot
           FROM d1 JOIN f1 USING (event_id)),
    c1 AS (SELECT event_id, ok AS k, oc AS customer_id, om AS metric, q, ot AS t, ing AS filed, 'payload_conflict' AS reason
           FROM x1 WHERE conflict QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arr) = 1),
    w1 AS (SELECT customer_id, metric, max(t) - {g} AS wm FROM f1 GROUP BY ALL),
    s1 AS (SELECT DISTINCT k, wm AS swm FROM f1 JOIN w1 USING (customer_id, metric) WHERE o + {w} <= wm),
    y2 AS (SELECT d2.*, s1.k IS NOT NULL AS hit, f1.event_id IS NOT NULL AS known,
             f1.q AS kq, f1.k AS kk, f1.customer_id AS kc, f1.metric AS km, f1.t AS kt
           FROM d2 LEFT JOIN s1 USING (k) LEFT JOIN f1 USING (event_id)),
    f2 AS (SELECT * FROM y2 WHERE NOT known AND NOT hit
           QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arr) = 1),
    x2 AS (SELECT y2.*,
             CASE WHEN y2.known THEN 'deduped' WHEN f2.arr IS NULL OR y2.arr < f2.arr THEN 'quarantined'
                  WHEN y2.arr = f2.arr THEN 'accepted' ELSE 'deduped' END AS disposition,
             coalesce(CASE WHEN y2.known THEN y2.q <> y2.kq WHEN y2.arr > f2.arr THEN y2.q <> f2.q END, false) AS conflict,
             coalesce(y2.kk, f2.k) AS ok, coalesce(y2.kc, f2.customer_id) AS oc, coalesce(y2.km, f2.metric) AS om,
             coalesce(y2.kt, f2.t) AS ot
           FROM y2 LEFT JOIN f2 USING (event_id)),
    c2 AS (SELECT event_id, CASE WHEN conflict THEN ok ELSE k END AS k,
             CASE WHEN conflict THEN oc ELSE customer_id END AS customer_id,
             CASE WHEN conflict THEN om ELSE metric END AS metric, q, CASE WHEN conflict THEN ot ELSE t END AS t,
             ing AS filed, CASE WHEN conflict THEN 'payload_conflict' ELSE 'late_after_seal' END AS reason
           FROM x2 WHERE (conflict OR disposition = 'quarantined') AND event_id NOT IN (SELECT event_id FROM c1)
           QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arr) = 1),
    disp AS (SELECT 0 AS batch_id, event_id, k, disposition, conflict FROM x1
             UNION ALL SELECT 1, event_id, k, disposition, conflict FROM x2),
    corr AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2),
    wl AS (SELECT event_id, customer_id, metric, q, t, o, k FROM f1
           UNION ALL SELECT event_id, customer_id, metric, q, t, o, k FROM f2),
    wm AS (SELECT customer_id, metric, max(t) - {g} AS wm FROM wl GROUP BY ALL),
    win AS (SELECT k, customer_id, metric, o, o + {w} AS c, coalesce(s1.swm, CASE WHEN o + {w} <= wm THEN wm END) AS swm,
              coalesce(s1.swm, CASE WHEN o + {w} <= wm THEN wm END) IS NOT NULL AS sealed, wm
            FROM (SELECT DISTINCT k, customer_id, metric, o FROM wl) JOIN wm USING (customer_id, metric)
            LEFT JOIN s1 USING (k))"""


_LINE_CHAIN = f"WITH {_LINES}, " + _chain("li", "part = 'F'", LINES)
_LATE_CHAIN = (
    f"WITH {_events()}, ea AS (SELECT *, row_number() OVER (ORDER BY ing, t, event_id) AS arr FROM ev), "
    + _chain("ea", f"ing < {CUT_MS}", DAILY)
)


def _leaf(domain: str = DAILY.domain) -> str:
    text = "event_id || '|' || CAST(t AS VARCHAR) || '|' || CAST(q AS VARCHAR)"
    return f"sha256('{domain}.leaf.v1' || chr(10) || {text})"


def _fold(name: str, source: str, key: str, domain: str = DAILY.domain) -> str:
    """Recursive CTE: rows (key, i, h, n) of every level up to one node per key."""
    return f"""{name} AS (
      SELECT {key}, i, h, n FROM {source}
      UNION ALL
      SELECT {key}, i // 2,
        CASE WHEN count(*) = 2 THEN sha256('{domain}.node.v1' || chr(10) || first(h ORDER BY i) || last(h ORDER BY i))
             ELSE any_value(h) END, (n + 1) // 2
      FROM {name} WHERE n > 1 GROUP BY {key}, i // 2, n)"""


def _hmac(text: str, key: str = DAILY.receipt_key) -> str:
    raw = key.encode()
    raw = (raw if len(raw) <= 64 else sha256(raw).digest()).ljust(64, b"\0")
    pad = {mask: bytes(b ^ mask for b in raw).hex() for mask in (0x36, 0x5C)}
    return f"sha256(unhex('{pad[0x5C]}') || unhex(sha256(unhex('{pad[0x36]}') || encode({text}))))"


_WEEKLY = f"WITH RECURSIVE {_events(10)}, " + _sealed("ev", WEEKLY)
_LEAVES = f"""lf AS (
      SELECT wl.k, wl.customer_id, metric, row_number() OVER (PARTITION BY k ORDER BY t, event_id) - 1 AS i,
        {_leaf()} AS h, count(*) OVER (PARTITION BY k) AS n, event_id, t, q
      FROM wl JOIN (SELECT k FROM win WHERE sealed) USING (k))"""
_ROOTS = f"{_WEEKLY}, {_LEAVES}, {_fold('tree', 'lf', 'k')}, roots AS (SELECT k, h AS root FROM tree WHERE n = 1), {_TOTALS}"
_INVOICE = f"""{_ROOTS},
    bills AS (SELECT * FROM totals JOIN roots USING (k)),
    rl AS (SELECT customer_id, root AS h, row_number() OVER (PARTITION BY customer_id ORDER BY root) - 1 AS i,
             count(*) OVER (PARTITION BY customer_id) AS n FROM bills),
    {_fold('forest', 'rl', 'customer_id')},
    ra AS (SELECT 0 AS one, root AS h, row_number() OVER (ORDER BY root) - 1 AS i, count(*) OVER () AS n FROM bills),
    {_fold('whole', 'ra', 'one')}"""

_QUANTITY_TEXT = """(
      SELECT l_orderkey, l_linenumber, l_partkey,
        CASE l_linenumber WHEN 1 THEN p WHEN 2 THEN '-' || p || '0005' || x WHEN 3 THEN ' +.' || x || '  '
          WHEN 4 THEN p || '0000' || x WHEN 5 THEN p || 'e2' WHEN 6 THEN ' ' ELSE split_part(p, '.', 1) || '.' END AS quantity,
        CASE l_linenumber WHEN 1 THEN p WHEN 2 THEN '-' || p || '0005' || x WHEN 3 THEN '0.' || x
          WHEN 4 THEN p || '0000' || x WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE split_part(p, '.', 1) END AS number
      FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS VARCHAR) AS p,
              substr(CAST(CAST(l_tax AS DECIMAL(20,2)) AS VARCHAR), 3, 2) AS x FROM lineitem))"""


def _hostile(seed: str, source: str) -> str:
    twice = f"CAST('0x' || substr(md5('{seed}/twice|' || event_id), 1, 4) AS BIGINT) < {int(0.25 * 65536)}"
    return f"""(SELECT event_id, copy, md5('{seed}|' || event_id || '|' || CAST(copy AS VARCHAR)) AS arrival
      FROM (SELECT event_id, CAST(unnest(CASE WHEN {twice} THEN [0, 1] ELSE [0] END) AS INTEGER) AS copy FROM {source}))"""


def _same_totals() -> str:
    return f"WITH {_events(10)}, {_sealed('ev', WEEKLY)}, {_TOTALS}"


def oracles() -> dict[str, str]:
    m, day = _money, DAILY.window_ms
    ev, wl = _events(), _windowed("wl", "ev", day)
    deep = f"{_events(10)}, " + _windowed("wl", "ev", WEEKLY.window_ms)
    daily = f"WITH {ev}, " + _sealed("ev", DAILY)
    state = "CASE WHEN sealed THEN 'sealed' ELSE 'open' END"
    place = "round((least(greatest({t}, lo), hi) - lo) / greatest(hi - lo, 1), 9)"
    short_id = "lpad(printf('%x', {ms}), 12, '0')"
    variant = "substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr({h}, 4, 1)), 1)"

    def uuid(ms: str, h: str) -> str:
        w = short_id.format(ms=ms)
        return (f"substr({w}, 1, 8) || '-' || substr({w}, 9, 4) || '-7' || substr({h}, 1, 3) || '-' || "
                f"{variant.format(h=h)} || substr({h}, 5, 3) || '-' || substr({h}, 8, 12)")

    window_totals = f"""{daily}, {_TOTALS} SELECT k AS window_key, customer_id, metric,
            {_MODE.format(m='metric')} AS mode, {m('micros')} AS billed_total, CAST(micros AS VARCHAR) AS billed_total_micros,
            n AS event_count, sealed, swm AS sealed_watermark_ms FROM totals"""

    purged = f"""{_LINE_CHAIN},
            gone AS (SELECT CAST(s_suppkey AS VARCHAR) AS customer_id FROM supplier WHERE s_acctbal < 0),
            t AS (SELECT 'event_log' AS name, customer_id FROM wl UNION ALL SELECT 'billing_window', customer_id FROM win
                  UNION ALL SELECT 'window_receipt', customer_id FROM win WHERE sealed
                  UNION ALL SELECT 'stream_watermark', customer_id FROM wm UNION ALL SELECT 'correction_epoch', customer_id FROM corr)
            SELECT name, count(*) AS rows_left, count(DISTINCT customer_id) AS customers_left FROM t
            WHERE customer_id NOT IN (SELECT customer_id FROM gone) GROUP BY name"""

    return {
        "usage_from_events": f"""WITH {ev} SELECT event_id, customer_id, metric, {m('q')} AS quantity,
            t AS event_time_ms, ing AS ingest_time_ms, payload FROM ev""",
        "validate_deliveries": f"""WITH {ev},
            b AS (SELECT CASE WHEN metric = 'error' THEN 'no_metric'
                   WHEN length(payload) = 9 THEN 'no_event_time'
                   WHEN metric = 'signup' THEN 'not_a_quantity' ELSE 'valid' END AS outcome,
                   CASE WHEN metric = 'signup' THEN NULL ELSE q END AS q FROM ev)
            SELECT outcome, count(*) AS deliveries, CAST(sum(q) AS VARCHAR) AS micros FROM b GROUP BY outcome""",
        "parse_micros": f"""SELECT l_orderkey, l_linenumber, l_partkey, quantity,
            CAST(CAST(number AS DECIMAL(20,6)) * 1000000 AS BIGINT) AS micros FROM {_QUANTITY_TEXT}""",
        "format_micros_text": f"""SELECT o_orderkey, micros, {m('micros')} AS canonical FROM (
            SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(20,2)) * 10000 AS BIGINT) - 1500000000 AS micros FROM orders)""",
        "pretty_micros_text": """WITH v AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(20,2)) * 1000000 AS BIGINT) * 1000
                 - 150000000000000 AS u FROM orders)
            SELECT o_orderkey, CASE WHEN u < 0 THEN '-' ELSE '' END || format('{:,}', abs(u) // 1000000) ||
              CASE WHEN abs(u) % 1000000 = 0 THEN ''
                   ELSE '.' || rtrim(lpad(CAST(abs(u) % 1000000 AS VARCHAR), 6, '0'), '0') END AS pretty FROM v""",
        "assign_windows": f"""WITH {ev}, {wl} SELECT event_id, k AS window_key, o AS window_open_ms,
            o + {day} AS window_close_ms FROM wl""",
        "calendar_windows": f"""WITH {_LINES},
            w AS (SELECT *, date_trunc('month', make_timestamp(t * 1000)) AS mo FROM li)
            SELECT customer_id || ':' || metric || ':' || CAST(epoch_us(mo) // 1000 AS VARCHAR) AS window_key,
              epoch_us(mo) // 1000 AS window_open_ms, epoch_us(mo + INTERVAL 1 MONTH) // 1000 AS window_close_ms,
              CAST(sum(q) AS VARCHAR) AS total_micros, count(*) AS event_count
            FROM w GROUP BY customer_id, metric, mo""",
        "leaf_hashes": f"""WITH {ev} SELECT event_id,
            event_id || '|' || CAST(t AS VARCHAR) || '|' || CAST(q AS VARCHAR) AS leaf, {_leaf()} AS hash FROM ev""",
        "clock_skew_profile": f"""WITH {ev} SELECT customer_id, metric, count(*) AS events, min(ing - t) AS min_skew_ms,
            max(ing - t) AS max_skew_ms, round(quantile_cont(ing - t, 0.5), 3) AS median_skew_ms,
            round(quantile_cont(ing - t, 0.95), 3) AS p95_skew_ms FROM ev GROUP BY ALL""",
        "counter_totals": f"""WITH {ev}, {wl} SELECT k AS window_key, {m('sum(q)')} AS billed_total,
            count(*) AS event_count FROM wl GROUP BY k""",
        "gauge_totals": f"""WITH {deep} SELECT k AS window_key, {m('last(q ORDER BY t, event_id)')} AS billed_total,
            count(*) AS event_count FROM wl WHERE metric = 'view_gauge' GROUP BY k""",
        "gauge_without_tiebreak": f"""WITH {_FIRST_LINES}, {_windowed('wl', 'fl', LINES.window_ms)}
            SELECT k AS window_key, {m('last(q ORDER BY t, arr)')} AS billed_total, count(*) AS event_count FROM wl GROUP BY k""",
        "window_totals": window_totals,
        "stream_metering": window_totals,
        "range_window_join": f"""WITH {_events(25)},
            hw AS (SELECT CAST(n_nationkey AS VARCHAR) AS customer_id, metric,
                CAST(n_nationkey AS VARCHAR) || '/' || metric AS k, 1704067200000 + n_nationkey * 3600007 AS o,
                n_nationkey % 2 = 0 AS sealed
              FROM nation, (SELECT unnest(['click', 'view_gauge', 'purchase', 'signup', 'error']) AS metric)),
            j AS (SELECT hw.k, hw.metric, event_id, q, t FROM hw JOIN ev ON ev.customer_id = hw.customer_id
                AND ev.metric = hw.metric AND t >= o AND t < o + {20 * DAY_MS} AND (NOT sealed OR t <= o + {9 * DAY_MS})),
            v AS (SELECT k, {_VALUE} AS micros, count(*) AS n FROM j GROUP BY k)
            SELECT k AS window_key, {_MODE.format(m='metric')} AS mode, {m('coalesce(micros, 0)')} AS billed_total,
              coalesce(n, 0) AS event_count, sealed FROM hw LEFT JOIN v USING (k)""",
        "running_totals": f"""WITH {deep} SELECT k AS window_key, event_id,
            row_number() OVER w - 1 AS position, CAST(sum(q) OVER w AS VARCHAR) AS running_micros FROM wl
            WINDOW w AS (PARTITION BY k ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "latest_event": f"""WITH {deep} SELECT k AS window_key, event_id, t AS event_time_ms, q AS quantity_micros FROM wl
            QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC, event_id DESC) = 1""",
        "totals_for_keys": f"""{daily}, {_TOTALS},
            a AS (SELECT DISTINCT customer_id || ':' || metric || ':1704067200000' AS k, metric AS m FROM ev)
            SELECT k AS window_key, CAST(coalesce(micros, 0) AS VARCHAR) AS billed_total_micros,
              {m('coalesce(micros, 0)')} AS billed_total, coalesce(n, 0) AS event_count, {_MODE.format(m='m')} AS mode,
              coalesce(sealed, false) AS sealed, swm AS sealed_watermark_ms FROM a LEFT JOIN totals USING (k)""",
        "invoice_totals": f"""{_same_totals()} SELECT customer_id, count(*) AS windows, CAST(sum(n) AS BIGINT) AS event_count,
            CAST(sum(micros) AS VARCHAR) AS grand_total_micros, {m('sum(micros)')} AS grand_total FROM totals GROUP BY customer_id""",
        "expected_totals": f"""WITH {ev}, {wl} SELECT k AS window_key, CAST(sum(q) AS VARCHAR) AS expected_micros FROM wl GROUP BY k""",
        "billed_as_expected": f"""WITH {ev}, {wl} SELECT count(DISTINCT k) AS windows, CAST(0 AS BIGINT) AS different,
            CAST(sum(q) AS VARCHAR) AS grand_total_micros FROM wl WHERE metric <> 'view_gauge'""",
        "trailing_usage": f"""WITH {_events(10)},
            s AS (SELECT customer_id, t - t % 600000 AS at_ms, sum(q) AS micros FROM ev GROUP BY ALL)
            SELECT customer_id, at_ms, CAST(sum(micros) OVER (PARTITION BY customer_id ORDER BY at_ms
                RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW) AS VARCHAR) AS trailing_micros,
              at_ms - lag(at_ms) OVER (PARTITION BY customer_id ORDER BY at_ms) AS gap_ms FROM s""",
        "dedup_first_delivery": f"""WITH {_FIRST_LINES}, {_windowed('wl', 'fl', LINES.window_ms)}
            SELECT event_id, k AS window_key, t AS event_time_ms, q AS quantity_micros FROM wl""",
        "ingest_dispositions": f"""WITH {_LINES}, {_windowed('d', 'li', LINES.window_ms)},
            f AS (SELECT event_id, arr, q FROM d QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arr) = 1)
            SELECT event_id, k AS window_key, CASE WHEN d.arr = f.arr THEN 'accepted' ELSE 'deduped' END AS disposition,
              d.arr <> f.arr AND d.q <> f.q AS conflict, d.q AS quantity_micros, l_partkey FROM d JOIN f USING (event_id)""",
        "ingest_counts": f"""{_LINE_CHAIN} SELECT CAST(batch_id AS BIGINT) AS batch_id, disposition, count(*) AS deliveries
            FROM disp GROUP BY ALL""",
        "payload_conflicts": f"""WITH {_LINES}, {_windowed('d', 'li', LINES.window_ms)},
            f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arr) = 1),
            c AS (SELECT f.event_id, f.k, f.customer_id, f.metric, d.q, f.t, d.ing,
                    sha256(f.event_id || '|payload_conflict') AS h FROM d JOIN f USING (event_id) WHERE d.q <> f.q
                  QUALIFY row_number() OVER (PARTITION BY d.event_id ORDER BY d.arr) = 1)
            SELECT {uuid('ing', 'h')} AS correction_id, event_id, k AS window_key, customer_id, metric, {m('q')} AS quantity,
              q AS quantity_micros, t AS event_time_ms, ing AS quarantined_at_ms, 'payload_conflict' AS reason FROM c""",
        "late_quarantine": f"""{_LATE_CHAIN} SELECT event_id, k AS window_key, q AS quantity_micros, t AS event_time_ms,
            filed AS quarantined_at_ms FROM corr WHERE reason = 'late_after_seal'""",
        "sealed_window_hits": f"""{_LATE_CHAIN} SELECT event_id, k AS window_key, hit AS sealed FROM y2""",
        "insert_if_absent_events": f"""WITH {_LINES} SELECT DISTINCT event_id FROM li WHERE part <> 'F'
            AND event_id NOT IN (SELECT event_id FROM li WHERE part = 'F')""",
        "correction_summary": f"""{_LINE_CHAIN} SELECT k AS window_key, reason, count(*) AS corrections,
            CAST(sum(q) AS VARCHAR) AS micros FROM corr GROUP BY ALL""",
        "recent_corrections": f"""{_LINE_CHAIN} SELECT event_id, k AS window_key, q AS quantity_micros,
            filed AS quarantined_at_ms, reason FROM corr ORDER BY filed DESC, event_id LIMIT 50""",
        "window_registry": f"""{_LINE_CHAIN} SELECT k AS window_key, customer_id, metric, o AS window_open_ms,
            c AS window_close_ms, {state} AS state FROM win""",
        "stream_watermarks": f"""WITH {ev} SELECT customer_id, metric, max(t) - {DAILY.grace_ms} AS watermark_ms,
            CAST({DAILY.grace_ms} AS BIGINT) AS lateness_grace_ms FROM ev GROUP BY ALL""",
        "watermark_upsert": f"""WITH {ev},
            a AS (SELECT customer_id, metric, max(t) - {DAILY.grace_ms} AS wm FROM ev WHERE ing < {CUT_MS} GROUP BY ALL),
            b AS (SELECT customer_id, metric, max(t) - {2 * DAILY.grace_ms} AS wm FROM ev WHERE ing >= {CUT_MS} GROUP BY ALL)
            SELECT customer_id, metric, greatest(coalesce(a.wm, b.wm), coalesce(b.wm, a.wm)) AS watermark_ms,
              CAST(CASE WHEN b.wm IS NULL THEN {DAILY.grace_ms} ELSE {2 * DAILY.grace_ms} END AS BIGINT) AS lateness_grace_ms
            FROM a FULL JOIN b USING (customer_id, metric)""",
        "seal_due_windows": f"""{daily} SELECT k AS window_key, {state} AS state,
            CASE WHEN sealed THEN CAST({NOW_MS} AS BIGINT) END AS sealed_at_ms, swm AS sealed_watermark_ms FROM win""",
        "newly_sealed": f"""{daily},
            half AS (SELECT customer_id, metric, max(t) - {DAILY.grace_ms} AS hwm FROM ev WHERE ing < {CUT_MS} GROUP BY ALL)
            SELECT k AS window_key, swm AS sealed_watermark_ms FROM win LEFT JOIN half USING (customer_id, metric)
            WHERE sealed AND NOT coalesce(c <= hwm, false)""",
        "watermark_timeline": f"""{daily}, ax AS (SELECT customer_id, min(o) AS lo, max(c) AS hi FROM win GROUP BY customer_id)
            SELECT k AS window_key, substr(customer_id, 1, 8) AS customer_short, metric, {state} AS state, wm AS watermark_ms,
              lo AS axis_min_ms, hi AS axis_max_ms, {place.format(t='o')} AS open_at, {place.format(t='c')} AS close_at,
              {place.format(t='wm')} AS watermark_at FROM win JOIN ax USING (customer_id)""",
        "window_state": f"""{_LATE_CHAIN}, {_TOTALS} SELECT k AS window_key, {_MODE.format(m='metric')} AS mode,
            {m('micros')} AS billed_total, n AS event_count, sealed, swm AS sealed_watermark_ms, wm AS watermark_ms FROM totals""",
        "billing_summary": f"""{_LINE_CHAIN}, {_TOTALS} SELECT CAST(sum(n) AS BIGINT) AS events_billed,
            count(*) FILTER (WHERE sealed) AS windows_sealed, count(*) AS windows,
            (SELECT count(*) FROM corr) AS corrections, {m('sum(micros)')} AS grand_total FROM totals""",
        "log_replay_state": f"""{_LATE_CHAIN}, {_TOTALS} SELECT k AS window_key, {m('micros')} AS billed_total, n AS event_count,
            sealed, swm AS sealed_watermark_ms FROM totals""",
        "purge_customers": purged,
        "purge_in_place": purged,
        "open_window_index": f"""{_LATE_CHAIN} SELECT k AS window_key, customer_id, metric, o AS window_open_ms,
            c AS window_close_ms FROM win WHERE NOT sealed""",
        "log_by_day": f"""{_LATE_CHAIN} SELECT strftime(make_timestamp(t * 1000), '%Y-%m-%d') AS day, count(*) AS events,
            CAST(sum(q) AS VARCHAR) AS micros FROM wl WHERE t >= {CUT_MS - 5 * DAY_MS} AND t < {CUT_MS + 5 * DAY_MS} GROUP BY day""",
        "concurrent_ingest": f"""{_same_totals()} SELECT k AS window_key, {m('micros')} AS billed_total, n AS event_count, sealed,
            n AS accepted, 3 * n AS deduped FROM totals""",
        "interleaved_writers": f"""{_LATE_CHAIN}, {_TOTALS},
            filed AS (SELECT k, count(*) AS late FROM corr GROUP BY k)
            SELECT k AS window_key, {m('micros')} AS billed_total, n AS event_count, sealed, coalesce(late, 0) AS late
            FROM totals LEFT JOIN filed USING (k)""",
        "store_of_many_batches": window_totals,
        "scattered_ids": f"""WITH {ev}, h AS (SELECT md5(event_id) AS h, q FROM ev WHERE metric = 'signup')
            SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' ||
              substr(h, 21, 12) AS event_id, 'deduped' AS disposition, true AS conflict, q + 1000000 AS quantity_micros FROM h""",
        "streams_and_customers": f"""{_LATE_CHAIN},
            latest AS (SELECT customer_id FROM corr ORDER BY filed DESC, event_id LIMIT 50)
            SELECT customer_id, count(DISTINCT metric) AS streams, count(*) AS windows, max(wm) AS watermark_ms,
              (SELECT count(*) FROM latest WHERE latest.customer_id = win.customer_id) AS latest FROM win GROUP BY customer_id""",
        "windows_of_a_metric": f"""{_LATE_CHAIN} SELECT k AS window_key, customer_id, {state} AS state,
            row_number() OVER (ORDER BY k) - 1 AS position FROM win WHERE metric = 'purchase'""",
        "merkle_roots_of_windows": f"{_ROOTS} SELECT k AS window_key, root AS merkle_root FROM roots",
        "receipt_signatures": f"WITH {ev} SELECT event_id, {_hmac(_leaf())} AS signature FROM ev",
        "receipts_of_windows": f"""{_ROOTS} SELECT k AS window_key, customer_id, metric, {_MODE.format(m='metric')} AS mode,
            root AS merkle_root, {_hmac('root')} AS signature, CAST(micros AS VARCHAR) AS billed_total_micros, n AS event_count,
            swm AS sealed_watermark_ms, 'event_time_ms,event_id ASC' AS leaf_order_rule, 'sha256' AS algo,
            CAST({NOW_MS} AS BIGINT) AS created_at_ms FROM totals JOIN roots USING (k)""",
        "invoice_bundles": f"""{_ROOTS} SELECT lf.k AS window_key, i AS position, event_id, t AS event_time_ms,
            CAST(q AS VARCHAR) AS quantity_micros, {_MODE.format(m='lf.metric')} AS mode, root AS merkle_root,
            {m('micros')} AS billed_total FROM lf JOIN roots USING (k) JOIN totals USING (k)""",
        "verify_receipts": f"""{_ROOTS} SELECT k AS window_key, customer_id, metric, true AS root_ok, true AS total_ok,
            true AS signature_ok, true AS metadata_ok, n AS event_count, root AS recomputed_root, root AS claimed_root,
            CAST(micros AS VARCHAR) AS recomputed_total_micros, CAST(micros AS VARCHAR) AS claimed_total_micros, true AS ok
            FROM totals JOIN roots USING (k)""",
        "verify_broken_bundles": f"""{_ROOTS},
            b AS (SELECT k, NOT (customer_id = '2' OR (customer_id IN ('0', '1') AND n > 8)) AS whole FROM totals JOIN roots USING (k))
            SELECT k AS window_key, whole AS parts_ok, true AS window_once, whole AS ok FROM b""",
        "verify_invoice": f"""{_INVOICE} SELECT count(*) AS windows, CAST(0 AS BIGINT) AS rejected,
            CAST(sum(micros) AS VARCHAR) AS grand_total_micros, true AS ok,
            (SELECT h FROM whole WHERE n = 1) AS invoice_root FROM bills""",
        "invoice_root": f"""{_INVOICE} SELECT customer_id, count(*) AS windows, CAST(0 AS BIGINT) AS rejected,
            CAST(sum(micros) AS VARCHAR) AS grand_total_micros, true AS ok, any_value(h) AS invoice_root
            FROM bills JOIN (SELECT customer_id, h FROM forest WHERE n = 1) USING (customer_id) GROUP BY customer_id""",
        "tamper_detection": f"""{_ROOTS},
            a AS (SELECT k, metric, event_id, t, CASE WHEN i = 0 THEN 999999000000 ELSE q END AS q FROM lf),
            v AS (SELECT k, {_VALUE} AS changed FROM a GROUP BY k)
            SELECT k AS window_key, false AS root_ok, changed = micros AS total_ok, false AS signature_ok,
              CAST(changed AS VARCHAR) AS recomputed_total_micros, false AS ok FROM v JOIN totals USING (k)""",
        "customer_invoices": f"""{_INVOICE} SELECT customer_id, count(*) AS lines, CAST(sum(n) AS BIGINT) AS event_count,
            {m('sum(micros)')} AS grand_total, any_value(h) AS invoice_root
            FROM bills JOIN (SELECT customer_id, h FROM forest WHERE n = 1) USING (customer_id) GROUP BY customer_id""",
        "window_by_key": f"""{_LATE_CHAIN}, {_TOTALS},
            first AS (SELECT min(k) AS k FROM totals GROUP BY metric),
            late AS (SELECT k, count(*) AS filed FROM corr GROUP BY k)
            SELECT k AS window_key, {m('micros')} AS billed_total, n AS event_count, sealed, wm AS watermark_ms,
              coalesce(filed, 0) AS corrections, CASE WHEN sealed THEN n ELSE 0 END AS leaves
            FROM totals JOIN first USING (k) LEFT JOIN late USING (k)""",
        "window_lanes": f"""{daily} SELECT k AS window_key, customer_id, metric,
            row_number() OVER (PARTITION BY customer_id, metric ORDER BY o) AS place FROM win""",
        "corrections_in_order": f"""{_LINE_CHAIN} SELECT k AS window_key, event_id, t AS event_time_ms,
            row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS place FROM corr""",
        "event_timestamps": f"""WITH {ev} SELECT event_id, strftime(make_timestamp(t * 1000), '%Y-%m-%d %H:%M:%S.%g') AS event_time FROM ev""",
        "ingest_counts_of_copies": f"""WITH {_LINES}, n AS (SELECT count(*) AS n, count(DISTINCT event_id) AS ids,
              count(*) FILTER (WHERE CAST('0x' || right(event_id, 8) AS BIGINT) % 10 = 0) AS again FROM li)
            SELECT 'accepted' AS disposition, ids AS deliveries FROM n
            UNION ALL SELECT 'deduped', n + again - ids FROM n""",
        "stream_then_seal_then_stream": f"""WITH {ev}, {wl},
            p AS (SELECT *, CAST('0x' || right(event_id, 8) AS BIGINT) % 3 AS part FROM wl),
            w1 AS (SELECT customer_id, metric, max(t) - {DAILY.grace_ms} AS wm FROM p WHERE part < 2 GROUP BY ALL),
            s1 AS (SELECT DISTINCT k FROM p JOIN w1 USING (customer_id, metric) WHERE part < 2 AND o + {day} <= wm),
            a AS (SELECT * FROM p WHERE part < 2 OR k NOT IN (SELECT k FROM s1)),
            w2 AS (SELECT customer_id, metric, max(t) - {DAILY.grace_ms} AS wm FROM a GROUP BY ALL),
            v AS (SELECT k, customer_id, metric, o, {_VALUE} AS micros, count(*) AS n FROM a GROUP BY k, customer_id, metric, o),
            l AS (SELECT k, count(*) AS late FROM p WHERE part = 2 AND k IN (SELECT k FROM s1) GROUP BY k)
            SELECT k AS window_key, {m('micros')} AS billed_total, n AS event_count, o + {day} <= wm AS sealed,
              coalesce(late, 0) AS late FROM v JOIN w2 USING (customer_id, metric) LEFT JOIN l USING (k)""",
        "hostile_arrivals": f"WITH {ev} SELECT * FROM {_hostile('one', 'ev')}",
        "replay_invariance": f"""{_same_totals()} SELECT k AS window_key, CAST(3 AS BIGINT) AS runs, {m('micros')} AS lowest,
            {m('micros')} AS highest, true AS all_equal FROM totals""",
        "parity_diff": f"""WITH {_FIRST_LINES},
            ll AS (SELECT * FROM li QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arr DESC) = 1),
            {_windowed('wf', 'fl', LINES.window_ms)}, {_windowed('wz', 'll', LINES.window_ms)},
            a AS (SELECT k, {m('sum(q)')} AS l FROM wf GROUP BY k), b AS (SELECT k, {m('sum(q)')} AS r FROM wz GROUP BY k)
            SELECT k AS window_key, l AS left_value, r AS right_value,
              CASE WHEN r IS NULL THEN 'only_left' WHEN l IS NULL THEN 'only_right' ELSE 'differs' END AS problem
            FROM a FULL JOIN b USING (k) WHERE l IS DISTINCT FROM r""",
        "crash_replay": f"""{_same_totals()} SELECT k AS window_key, {m('micros')} AS expected, {m('micros')} AS found,
            true AS same FROM totals""",
        "redelivery_convergence": f"""{_same_totals()} SELECT k AS window_key, {m('micros')} AS expected,
            {m('micros')} AS found, true AS same FROM totals""",
        "straggler_probe": f"""{daily}, {_TOTALS},
            s AS (SELECT k, o + (c - o) // 2 AS mid, sha256(k || '|straggler') AS h, micros FROM totals WHERE sealed)
            SELECT k AS window_key, {uuid('mid', 'h')} AS event_id, 'late_after_seal' AS reason, mid AS event_time_ms,
              CAST(77250000 AS BIGINT) AS quantity_micros, {m('micros')} AS before, {m('micros')} AS after FROM s""",
        "tie_sensitivity": f"""WITH {_FIRST_LINES}, {_windowed('wl', 'fl', LINES.window_ms)},
            z AS (SELECT * FROM wl QUALIFY t = max(t) OVER (PARTITION BY k)),
            g AS (SELECT k, count(*) AS tied, last(q ORDER BY event_id) AS billed,
                    last(q ORDER BY md5('one|' || event_id)) AS v0, last(q ORDER BY md5('two|' || event_id)) AS v1,
                    last(q ORDER BY md5('three|' || event_id)) AS v2 FROM z GROUP BY k HAVING count(*) > 1)
            SELECT k AS window_key, tied, {m('billed')} AS billed_total,
              CAST(len(list_distinct([v0, v1, v2])) AS INTEGER) AS distinct_values, v0 = v1 AND v1 = v2 AS stable FROM g""",
    }
