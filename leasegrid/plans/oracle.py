"""Each query's SQL: a chain of named tables, and a final select for each query."""

from __future__ import annotations


def _fixed(x: str, scale: str) -> str:
    y = f"abs({x})"
    t = f"({y}*134217729e0)"
    high = f"({t}-({t}-{y}))"
    lost = f"(({high}*{scale}-({y}*{scale}))+({y}-{high})*{scale})"
    p = f"({y}*{scale})"
    return f"(sign({x})*(floor({p})+CASE WHEN ({p}-floor({p})-0.5e0)+{lost}>=0 THEN 1e0 ELSE 0e0 END)/{scale}+0e0)"


def f2(x: str) -> str:
    return _fixed(f"({x})", "100e0")


def f6(x: str) -> str:
    return _fixed(f"({x})", "1e6")


def cents(x: str) -> str:
    return f"(coalesce(sum(CAST(round(({x})*100) AS BIGINT)),0)/100e0)"


def mi(d: str) -> str:
    return f"(year({d})*12+month({d}))"


def months_incl(s: str, e: str) -> str:
    n = f"({mi(e)}-{mi(s)})"
    return f"(CASE WHEN {e} < {s} THEN 0 ELSE {n} - (CASE WHEN CAST({s} + to_months(CAST({n} AS INTEGER)) AS DATE) > {e} THEN 1 ELSE 0 END) + 1 END)"


def add_m(d: str, n: str) -> str:
    return f"CAST({d} + to_months(CAST({n} AS INTEGER)) AS DATE)"


_CLAMP = "least(greatest(coalesce({d}, b.lease_start), b.lease_start), b.lease_end)"

TABLES: list[tuple[str, str]] = [
    ("leases", f"""SELECT o_orderkey AS lease_id, CAST(o_orderdate AS DATE) AS commence, CAST(12*(1+o_orderkey%5) AS BIGINT) AS term,
        {add_m('CAST(o_orderdate AS DATE)', '12*(1+o_orderkey%5)')} + CAST((o_orderkey*7)%28 - 1 AS INTEGER) AS expire,
        {f2('o_totalprice/12')} AS year1, (2+o_orderkey%4)/100e0 AS esc, CAST(1000+(o_custkey%40)*250 AS DOUBLE) AS square_footage,
        CASE WHEN o_orderkey%4=0 THEN 'aggregate' ELSE 'individual' END AS nnn_mode, {f2('o_totalprice/60')} AS nnn_agg_year1, 3e0 AS nnn_agg_esc_pct,
        CAST(o_orderdate AS DATE) + CAST(o_custkey%400 AS INTEGER) AS analysis_date, o_custkey AS custkey, o_orderpriority AS priority FROM orders"""),
    ("periods", f"""SELECT lease_id, CAST(k AS BIGINT) AS period_idx, {add_m('commence','12*k')} AS period_start,
        least({add_m('commence','12*(k+1)')} - 1, expire) AS period_end, floor(year1*pow(1e0+esc,k)*100e0+0.5e0)/100e0 AS monthly_rent
        FROM (SELECT *, unnest(range(0, 7)) AS k FROM leases WHERE expire >= commence) WHERE {add_m('commence','12*k')} <= expire"""),
    ("anchors", f"""SELECT lease_id, {add_m('period_start','k')} AS month_start, CASE WHEN k=n-1 THEN period_end END AS explicit_end, monthly_rent, period_idx,
        period_start AS source_start, period_end AS source_end, k FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, {months_incl('period_start','period_end')} AS n FROM periods))"""),
    ("months0", """SELECT *, row_number() OVER (PARTITION BY lease_id ORDER BY month_start) AS month_num FROM (
        SELECT *, row_number() OVER (PARTITION BY lease_id, month_start ORDER BY period_idx DESC, k DESC) AS last FROM anchors) WHERE last=1"""),
    ("months1", f"""SELECT *, (month_num-1)//12+1 AS year_num, lead(month_start) OVER w IS NULL AS is_last,
        coalesce(lead(month_start) OVER w - 1, explicit_end, {add_m('month_start','1')} - 1) AS row_end, {add_m('month_start','1')} - 1 AS natural_end
        FROM months0 WINDOW w AS (PARTITION BY lease_id ORDER BY month_start)"""),
    ("months", """SELECT *, CASE WHEN is_last AND row_end<natural_end THEN row_end-month_start+1 ELSE 1 END AS actual_days,
        CASE WHEN is_last AND row_end<natural_end THEN day(last_day(row_end)) ELSE 1 END AS cal_month_days,
        CASE WHEN is_last AND row_end<natural_end THEN (row_end-month_start+1)/CAST(day(last_day(row_end)) AS DOUBLE) ELSE 1e0 END AS factor FROM months1"""),
    ("bounds", "SELECT lease_id, min(month_start) AS lease_start, max(row_end) AS lease_end, max(month_num) AS term_months FROM months GROUP BY lease_id"),
    ("charges", f"""SELECT lease_id, ord, ['cams','insurance','taxes','security','otherItems'][ord+1] AS key, CASE WHEN ord<3 THEN 'nnn' ELSE 'other' END AS canonical_type,
        {f2('l_extendedprice/100')} AS year1, l_discount*100 AS esc_pct, CAST(l_shipdate AS DATE) AS charge_start FROM (
        SELECT *, l_orderkey AS lease_id, CAST((l_linenumber-1)%5 AS INTEGER) AS ord,
        row_number() OVER (PARTITION BY l_orderkey, (l_linenumber-1)%5 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_shipdate) AS r FROM lineitem) WHERE r=1"""),
    ("one_time", f"""SELECT e.lease_id, ord, label, CASE WHEN ord%10<>9 THEN CAST(o_orderdate AS DATE) + CAST((ord*13)%2000 AS INTEGER) END AS date, amount FROM (
        SELECT event_id%(SELECT max(o_orderkey) FROM orders)+1 AS lease_id, event_id AS ord, event_type AS label,
        {f2("CASE WHEN event_type='error' THEN -value ELSE value END")} AS amount FROM events) e JOIN orders ON o_orderkey=e.lease_id WHERE amount<>0"""),
    ("overrides", f"""SELECT lease_id, 0 AS ord, 'base_rent' AS target_key, commence+CAST(custkey%900 AS INTEGER) AS effective_date, {f2('year1*1.25e0')} AS amount FROM leases WHERE priority='1-URGENT'
        UNION ALL SELECT lease_id, 1, 'base_rent', commence+CAST(custkey%900+200 AS INTEGER), {f2('year1*1.5e0')} FROM leases WHERE priority='1-URGENT' AND custkey%2=0
        UNION ALL SELECT lease_id, 0, 'cams', commence+CAST(custkey%700 AS INTEGER), {f2('year1*0.1e0')} FROM leases WHERE priority='4-NOT SPECIFIED'"""),
    ("concessions", f"""SELECT lease_id, 0 AS ord, 'free_rent' AS type, 'monthly_row' AS scope, CAST(NULL AS VARCHAR) AS value_mode, 100e0 AS value, {add_m('commence','custkey%3')} AS effective_date, CAST(NULL AS DATE) AS start_date, CAST(NULL AS DATE) AS end_date FROM leases WHERE priority='2-HIGH'
        UNION ALL SELECT lease_id, 0, 'abatement', 'monthly_row', 'percent', CAST(25*(1+lease_id%3) AS DOUBLE), {add_m('commence','lease_id%12')}, NULL, NULL FROM leases WHERE priority='3-MEDIUM'
        UNION ALL SELECT lease_id, 0, 'abatement', 'monthly_row', 'fixed_amount', 500e0, commence+45, NULL, NULL FROM leases WHERE priority='3-MEDIUM' AND lease_id%2=0
        UNION ALL SELECT lease_id, 0, 'abatement', 'legacy_window', 'percent', 50e0, NULL, commence, commence+CAST(custkey%120 AS INTEGER) FROM leases WHERE priority='5-LOW'"""),
    ("steps", f"""SELECT lease_id, target_key, month_num, amount FROM (SELECT o.*, m.month_num, row_number() OVER (PARTITION BY o.lease_id, target_key, m.month_num ORDER BY effective_date DESC, o.ord DESC) AS r
        FROM overrides o JOIN bounds b USING (lease_id) JOIN months m ON m.lease_id=o.lease_id AND {_CLAMP.format(d='o.effective_date')} BETWEEN m.month_start AND m.row_end) WHERE r=1"""),
    ("scheduled", """SELECT *, coalesce(base_override, monthly_rent) AS scheduled, coalesce(base_override, monthly_rent)*factor AS adjusted FROM (
        SELECT m.*, last_value(s.amount IGNORE NULLS) OVER (PARTITION BY m.lease_id ORDER BY m.month_num ROWS UNBOUNDED PRECEDING) AS base_override
        FROM months m LEFT JOIN steps s ON s.lease_id=m.lease_id AND s.month_num=m.month_num AND s.target_key='base_rent')"""),
    ("explicit", f"""SELECT * FROM (SELECT c.*, m.month_num, row_number() OVER (PARTITION BY c.lease_id, m.month_num ORDER BY c.ord, c.type, c.value_mode) AS r FROM concessions c JOIN bounds b USING (lease_id)
        JOIN months m ON m.lease_id=c.lease_id AND {_CLAMP.format(d='c.effective_date')} BETWEEN m.month_start AND m.row_end WHERE c.scope='monthly_row') WHERE r=1"""),
    ("windows", """SELECT * FROM (SELECT c.*, m.month_num, greatest(least(m.row_end, c.end_date)-greatest(m.month_start, c.start_date)+1, 0) AS overlap,
        row_number() OVER (PARTITION BY c.lease_id, m.month_num ORDER BY c.ord) AS r FROM concessions c JOIN months m ON m.lease_id=c.lease_id
        AND c.start_date<=m.row_end AND c.end_date>=m.month_start WHERE c.scope='legacy_window') WHERE r=1"""),
    ("conceded0", """SELECT s.*, e.type IS NOT NULL AS is_explicit, e.type IS NULL AND w.type IS NOT NULL AS windowed, coalesce(e.type, w.type) AS ctype, coalesce(e.scope, w.scope) AS cscope,
        CASE WHEN e.type IS NOT NULL THEN e.value_mode ELSE w.value_mode END AS cmode, coalesce(CASE WHEN e.type IS NOT NULL THEN e.value ELSE w.value END, 0) AS cvalue, w.overlap, s.row_end-s.month_start+1 AS days
        FROM scheduled s LEFT JOIN explicit e ON e.lease_id=s.lease_id AND e.month_num=s.month_num LEFT JOIN windows w ON w.lease_id=s.lease_id AND w.month_num=s.month_num"""),
    ("conceded1", """SELECT *, CASE WHEN windowed THEN overlap/CAST(days AS DOUBLE) ELSE 1e0 END AS sharex FROM conceded0"""),
    ("conceded", """SELECT *, CASE WHEN ctype IS NULL THEN adjusted WHEN ctype='free_rent' THEN CASE WHEN windowed THEN adjusted*(1-sharex) ELSE 0e0 END
        WHEN cmode='fixed_amount' THEN greatest(0e0, adjusted-cvalue*sharex) WHEN cmode='percent' THEN adjusted*(1-least(greatest(cvalue,0),100)/100*sharex) ELSE adjusted END AS applied FROM conceded1"""),
    ("all_charges", """SELECT c.lease_id, c.ord, key, canonical_type, year1, esc_pct, charge_start FROM charges c JOIN (SELECT lease_id, nnn_mode FROM leases) USING (lease_id) WHERE NOT (nnn_mode='aggregate' AND canonical_type='nnn')
        UNION ALL SELECT lease_id, -1, 'nnn_aggregate', 'nnn', nnn_agg_year1, nnn_agg_esc_pct, NULL FROM leases WHERE nnn_mode='aggregate'"""),
    ("charge_rows0", """SELECT m.lease_id, m.month_num, m.year_num, m.month_start, m.factor, c.ord, c.key, c.canonical_type, c.year1, c.esc_pct, c.charge_start,
        last_value(s.amount IGNORE NULLS) OVER (PARTITION BY m.lease_id, c.key ORDER BY m.month_num ROWS UNBOUNDED PRECEDING) AS ov
        FROM months m JOIN all_charges c USING (lease_id) LEFT JOIN steps s ON s.lease_id=m.lease_id AND s.month_num=m.month_num AND s.target_key=c.key"""),
    ("charge_rows", f"""SELECT lease_id, month_num, ord, key, canonical_type, ov IS NOT NULL OR charge_start IS NULL OR month_start>=charge_start AS active, CAST(NULL AS BIGINT) AS esc_years,
        CASE WHEN ov IS NOT NULL THEN 0e0 ELSE esc_pct END AS esc_pct, ov IS NOT NULL AS override_applied,
        {f2("CASE WHEN ov IS NOT NULL THEN ov*factor WHEN charge_start IS NULL OR month_start>=charge_start THEN year1*pow(1e0+esc_pct/100, year_num-1)*factor ELSE 0e0 END")} AS amount FROM charge_rows0"""),
    ("once_rows", f"""SELECT o.lease_id, m.month_num, o.label, sum(amount) AS amount FROM one_time o JOIN bounds b USING (lease_id) JOIN months m ON m.lease_id=o.lease_id
        AND {_CLAMP.format(d='o.date')} BETWEEN m.month_start AND m.row_end GROUP BY ALL"""),
    ("ledger0", f"""SELECT c.*, coalesce(n.nnn, 0) AS nnn, coalesce(n.other, 0) AS other, coalesce(n.override_keys, '') AS override_keys, coalesce(o.once, 0) AS once, l.square_footage, l.nnn_mode
        FROM conceded c LEFT JOIN (SELECT lease_id, month_num, sum(CASE WHEN canonical_type='nnn' THEN amount ELSE 0e0 END) AS nnn, sum(CASE WHEN canonical_type='other' THEN amount ELSE 0e0 END) AS other,
        string_agg(key, '|' ORDER BY ord) FILTER (WHERE override_applied) AS override_keys FROM charge_rows GROUP BY ALL) n ON n.lease_id=c.lease_id AND n.month_num=c.month_num
        LEFT JOIN (SELECT lease_id, month_num, sum(amount) AS once FROM once_rows GROUP BY ALL) o ON o.lease_id=c.lease_id AND o.month_num=c.month_num JOIN leases l ON l.lease_id=c.lease_id"""),
    ("ledger1", f"""SELECT *, {f2('scheduled')} AS scheduled_base_rent, {f2('adjusted')} AS period_adjusted_base_rent, {f2('applied')} AS base_rent_applied,
        {f2('greatest(0e0, adjusted-applied)')} AS abatement_amount, {f2('nnn')} AS total_nnn_amount, {f2('once')} AS one_time_charges_amount FROM ledger0"""),
    ("ledger2", f"SELECT *, {f2('other+one_time_charges_amount')} AS total_other_charges_amount FROM ledger1"),
    ("ledger3", f"SELECT *, {f2('base_rent_applied+nnn+total_other_charges_amount')} AS total_monthly_obligation FROM ledger2"),
    ("ledger", f"""SELECT lease_id, month_num, year_num, month_start AS period_start, row_end AS period_end, period_idx, source_start, source_end, scheduled_base_rent, period_adjusted_base_rent, base_rent_applied, abatement_amount,
        {f6('CASE WHEN scheduled=0 THEN 0e0 ELSE applied/scheduled END')} AS base_rent_proration_factor, {f6('factor')} AS period_factor,
        CASE WHEN is_explicit THEN 'concession-event' WHEN windowed AND overlap<days THEN 'concession-boundary' WHEN factor<1 THEN 'final-month' ELSE 'full' END AS proration_basis,
        CAST(CASE WHEN windowed THEN overlap ELSE 0 END AS BIGINT) AS abatement_days, CAST(CASE WHEN windowed THEN greatest(days-overlap,0) ELSE 0 END AS BIGINT) AS full_rent_days, CAST(CASE WHEN windowed THEN days ELSE 0 END AS BIGINT) AS total_days,
        CAST(actual_days AS BIGINT) AS actual_days, CAST(cal_month_days AS BIGINT) AS cal_month_days, ctype IS NOT NULL AS is_concession_row, base_override IS NOT NULL AS base_rent_override_applied, nnn_mode,
        total_nnn_amount, one_time_charges_amount, total_other_charges_amount, total_monthly_obligation, CASE WHEN square_footage>0 THEN {f6('total_monthly_obligation/square_footage')} END AS effective_per_sf, square_footage,
        ctype AS concession_type, cscope AS concession_scope, cmode AS concession_value_mode, CASE WHEN ctype='free_rent' THEN 100e0 WHEN ctype IS NOT NULL THEN cvalue END AS concession_value, override_keys FROM ledger3"""),
    ("remaining", """SELECT *, sum(CAST(round(total_monthly_obligation*100) AS BIGINT)) OVER w/100e0 AS total_obligation_remaining, sum(CAST(round(total_nnn_amount*100) AS BIGINT)) OVER w/100e0 AS total_nnn_remaining,
        sum(CAST(round(base_rent_applied*100) AS BIGINT)) OVER w/100e0 AS total_base_rent_remaining, sum(CAST(round(total_other_charges_amount*100) AS BIGINT)) OVER w/100e0 AS total_other_charges_remaining
        FROM ledger WINDOW w AS (PARTITION BY lease_id ORDER BY month_num DESC ROWS UNBOUNDED PRECEDING)"""),
]
_ORDER = [n for n, _ in TABLES]


def sql(select: str, last: str = "remaining", instead: dict[str, str] | None = None) -> str:
    """select over the tables up to last; instead: other definitions of some of them."""
    own = dict(TABLES[: _ORDER.index(last) + 1]) | (instead or {})
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in own.items()) + "\n" + select


_CHECKPOINTS = f"""SELECT lease_id, checkpoint_date, arg_min(label, ord) AS label FROM (
  SELECT lease_id, {add_m('lease_start','12*k')} AS checkpoint_date, 'Year ' || k || ' anniversary' AS label, k AS ord, lease_start, lease_end FROM (
    SELECT lease_id, lease_start, lease_end, unnest(range(1, ({mi('lease_end')}-{mi('lease_start')})//12+1)) AS k FROM bounds)
  %s) WHERE checkpoint_date BETWEEN lease_start AND lease_end GROUP BY ALL"""
_BEFORE = f"""UNION ALL SELECT lease_id, {add_m('lease_end','-k')}, k || ' months before expiry', 1000-k, lease_start, lease_end FROM bounds, (VALUES (12),(9),(6),(3)) v(k)"""


def _checkpoints(before: str) -> str:
    return sql(f""", cp AS ({_CHECKPOINTS % before}), f AS (SELECT c.*, r.month_num, r.total_obligation_remaining, r.total_base_rent_remaining, r.total_nnn_remaining, r.total_other_charges_remaining,
      row_number() OVER (PARTITION BY c.lease_id, c.checkpoint_date ORDER BY r.month_num) AS n FROM cp c LEFT JOIN remaining r ON r.lease_id=c.lease_id AND r.period_start>=c.checkpoint_date)
    SELECT f.lease_id, checkpoint_date, label, coalesce(month_num,0) AS month_num, coalesce(total_obligation_remaining,0) AS total_obligation_remaining, coalesce(total_base_rent_remaining,0) AS total_base_rent_remaining,
      coalesce(total_nnn_remaining,0) AS total_nnn_remaining, coalesce(total_other_charges_remaining,0) AS total_other_charges_remaining, term_months-coalesce(month_num, term_months+1)+1 AS months_left
    FROM f JOIN bounds b ON b.lease_id=f.lease_id WHERE n=1""")


_SNAP = """, snap AS (SELECT lease_id, analysis_date, arg_max(struct_pack(month_num, scheduled_base_rent, total_nnn_amount, total_obligation_remaining, total_base_rent_remaining), CASE WHEN period_start<=analysis_date THEN month_num ELSE -month_num END) AS x
  FROM remaining JOIN (SELECT lease_id, analysis_date FROM leases) USING (lease_id) GROUP BY ALL)"""
_DISC = f"pow(1e0+0.07e0/12, {mi('period_start')}-{mi('analysis_date')}+1)"
_VALUES = f""", vals AS (SELECT lease_id, {cents('CASE WHEN period_start>=analysis_date THEN total_monthly_obligation END')} AS fv, {cents('CASE WHEN period_start>=analysis_date THEN base_rent_applied END')} AS fv_base,
  coalesce(sum(CASE WHEN period_start>=analysis_date THEN total_monthly_obligation/{_DISC} END),0) AS npv0, coalesce(sum(CASE WHEN period_start>=analysis_date THEN base_rent_applied/{_DISC} END),0) AS npv_base0,
  {cents('total_monthly_obligation')} AS full_fv, {cents("CASE WHEN period_start>=analysis_date AND concession_type='free_rent' THEN abatement_amount END")} AS free_total,
  {cents("CASE WHEN period_start>=analysis_date AND concession_type='abatement' THEN abatement_amount END")} AS abated_total FROM remaining JOIN (SELECT lease_id, analysis_date FROM leases) USING (lease_id) GROUP BY lease_id),
  vals2 AS (SELECT *, {f2('npv0')} AS npv, {f2('npv_base0')} AS npv_base FROM vals)"""


def _n(cte_select: str, last: str = "remaining") -> str:
    return sql(cte_select, last)


_FLAG = "SELECT lease_id, CAST({ord} AS BIGINT) AS ord, '{rule}' AS rule_id, '{sev}' AS severity FROM {rows} WHERE {cond}"


def flags(rules: list[tuple[str, str, str, str, str]]) -> str:
    return " UNION ALL ".join(_FLAG.format(rows=r, ord=o, rule=i, sev=s, cond=c) for r, o, i, s, c in rules)


_PAIRS = ", near AS (SELECT *, lag(period_end) OVER w AS before_end, lag(monthly_rent) OVER w AS before_rent FROM periods WINDOW w AS (PARTITION BY lease_id ORDER BY period_idx))"

ORACLE_SQL: dict[str, str] = {
    "quick_entry_periods": sql("SELECT * FROM periods", "periods"),
    "month_expansion": sql("SELECT lease_id, month_num, (month_num-1)//12+1 AS year_num, month_start, explicit_end, monthly_rent, period_idx, source_start, source_end FROM months0", "months0"),
    "duplicate_dates": sql("SELECT lease_id, month_start, count(*) AS n_rows FROM (SELECT * FROM anchors UNION ALL SELECT * FROM anchors WHERE period_idx=1) GROUP BY ALL HAVING count(*)>1", "anchors"),
    "row_bounds": sql("SELECT lease_id, month_num, month_start, row_end, is_last FROM months", "months"),
    "final_month_proration": sql(f"SELECT lease_id, month_num, CAST(actual_days AS BIGINT) AS actual_days, CAST(cal_month_days AS BIGINT) AS cal_month_days, {f6('factor')} AS factor FROM months WHERE is_last", "months"),
    "charge_schedule": sql("SELECT * FROM charge_rows WHERE key<>'nnn_aggregate'", "charge_rows"),
    "aggregate_nnn": sql("SELECT lease_id, month_num, amount FROM charge_rows WHERE key='nnn_aggregate'", "charge_rows"),
    "one_time_assignment": sql(f"SELECT lease_id, month_num, label, {f2('amount')} AS amount FROM once_rows", "once_rows"),
    "one_time_range_sum": sql(f"SELECT m.lease_id, m.month_num, {cents('o.amount')} AS amount FROM months m JOIN one_time o ON o.lease_id=m.lease_id AND o.date BETWEEN m.month_start AND m.row_end GROUP BY ALL", "one_time"),
    "override_ffill": sql("SELECT lease_id, month_num, base_override, scheduled FROM scheduled WHERE base_override IS NOT NULL", "scheduled"),
    "explicit_concessions": sql("SELECT lease_id, month_num, type, value_mode, value FROM explicit", "explicit"),
    "window_concessions": sql("SELECT lease_id, month_num, type, value_mode, value, CAST(overlap AS BIGINT) AS overlap FROM windows", "windows"),
    "monthly_ledger": sql("SELECT * FROM ledger", "ledger"),
    "remaining_balances": sql("SELECT lease_id, month_num, total_obligation_remaining, total_nnn_remaining, total_base_rent_remaining, total_other_charges_remaining FROM remaining"),
    "irregular_flags": sql(f""", y AS (SELECT lease_id, arg_min(scheduled_base_rent, month_num) AS y1, arg_min(scheduled_base_rent, month_num) FILTER (WHERE year_num=2 AND NOT base_rent_override_applied) AS y2 FROM ledger GROUP BY lease_id),
      x AS (SELECT l.*, {f2('y1*pow(1e0+CASE WHEN y1>0 AND y2 IS NOT NULL THEN y2/y1-1 ELSE 0e0 END, year_num-1)')} AS expected FROM ledger l JOIN y USING (lease_id)),
      z AS (SELECT *, base_rent_override_applied OR abs(scheduled_base_rent-expected)>greatest(0.01e0, abs(expected)*0.0015e0) AS irr FROM x)
      SELECT lease_id, month_num, expected AS inferred_annual_base_rent, irr AS is_irregular_base_rent, CASE WHEN irr THEN 'irregular' ELSE 'annual' END AS base_rent_escalation_type,
      concat_ws('|', CASE WHEN irr THEN 'base_rent' END, nullif(override_keys,'')) AS irregular_escalation_targets, irr OR override_keys<>'' AS has_irregular_escalation FROM z""", "ledger"),
    "annual_summary": sql(f""", a AS (SELECT lease_id, year_num, min(period_start) AS year_start, arg_max(period_end, month_num) AS year_end, count(*) AS n_months, {cents('base_rent_applied')} AS base_rent, {cents('total_nnn_amount')} AS nnn,
      {cents('total_other_charges_amount')} AS other, {cents('total_monthly_obligation')} AS obligation FROM ledger GROUP BY ALL), t AS (SELECT *, sum(CAST(round(obligation*100) AS BIGINT)) OVER (PARTITION BY lease_id)/100e0 AS total FROM a)
      SELECT lease_id, year_num, year_start, year_end, n_months, base_rent, nnn, other, obligation, CASE WHEN total=0 THEN 0e0 ELSE obligation/total END AS share FROM t""", "ledger"),
    "annual_rollup": sql(f"SELECT lease_id, year_num, grouping(year_num)=1 AS is_total, count(*) AS n_months, {cents('base_rent_applied')} AS base_rent, {cents('total_nnn_amount')} AS nnn, {cents('total_monthly_obligation')} AS obligation FROM ledger GROUP BY GROUPING SETS ((lease_id, year_num), (lease_id))", "ledger"),
    "summary_panel": sql(f"""SELECT lease_id, count(*) AS term_months, min(period_start) AS lease_start, max(period_end) AS lease_end, {cents('base_rent_applied')} AS total_base_rent, {cents('total_nnn_amount')} AS total_nnn, {cents('one_time_charges_amount')} AS total_one_time,
      {cents('total_other_charges_amount')} AS total_other, {cents('abatement_amount')} AS total_abatement, {cents('total_monthly_obligation')} AS total_obligation FROM ledger GROUP BY lease_id""", "ledger"),
    "tie_out": sql(f"""SELECT lease_id, arg_min(total_obligation_remaining, month_num) AS head_obligation, {cents('total_monthly_obligation')} AS sum_obligation, arg_min(total_base_rent_remaining, month_num) AS head_base_rent, {cents('base_rent_applied')} AS sum_base_rent, true AS ties FROM remaining GROUP BY lease_id"""),
    "assumptions": sql(f""", a AS (SELECT lease_id, count(*) AS term_months, arg_min(scheduled_base_rent, month_num) AS year1_rent, arg_min(scheduled_base_rent, month_num) FILTER (WHERE year_num=2) AS year2_rent,
      count(*) FILTER (WHERE concession_type='free_rent') AS free_months, min(period_start) FILTER (WHERE concession_type='free_rent') AS free_start, max(period_end) FILTER (WHERE concession_type='free_rent') AS free_end,
      count(*) FILTER (WHERE concession_type='abatement') AS abated_months, min(period_start) FILTER (WHERE concession_type='abatement') AS abated_start,
      arg_min(concession_value, month_num) FILTER (WHERE concession_type='abatement' AND concession_value_mode='percent') AS abated_pct, count(*) FILTER (WHERE is_concession_row AND base_rent_applied=0) AS fully_abated_months,
      arg_min(base_rent_proration_factor, month_num) FILTER (WHERE proration_basis='concession-boundary') AS boundary_factor, {cents("CASE WHEN concession_type='free_rent' THEN abatement_amount END")} AS free_total,
      {cents("CASE WHEN concession_type='abatement' THEN abatement_amount END")} AS abated_total, coalesce(max(month_num) FILTER (WHERE period_start<=analysis_date), 0) AS effective_month FROM ledger JOIN (SELECT lease_id, analysis_date FROM leases) USING (lease_id) GROUP BY lease_id)
      SELECT *, CASE WHEN year1_rent>0 AND year2_rent IS NOT NULL THEN year2_rent/year1_rent-1 ELSE 0e0 END AS inferred_escalation, term_months-effective_month AS months_remaining, CASE WHEN effective_month=0 THEN 0 ELSE 12-(effective_month-1)%12 END AS months_to_escalation FROM a""", "ledger"),
    "audit_trail": sql("""SELECT lease_id, month_num, period_start, period_end, scheduled_base_rent, period_factor, base_rent_proration_factor, proration_basis, coalesce(concession_type, CASE WHEN base_rent_override_applied THEN 'override' ELSE 'none' END) AS source,
      abatement_days, full_rent_days, total_days, period_idx, source_start, source_end FROM ledger""", "ledger"),
    "formula_eligibility": sql("""SELECT l.lease_id, l.month_num, CASE WHEN l.period_end < r.commence + 30 THEN 0e0 ELSE l.scheduled_base_rent END AS expected_scheduled, NOT l.base_rent_override_applied AND l.concession_type IS NULL AS base_rent_is_formula,
      l.override_keys='' AS charges_are_formula FROM ledger l JOIN leases r USING (lease_id)""", "ledger"),
    "inline_scenarios": sql(f"""SELECT lease_id, month_num, {', '.join(f"{f2(f'total_base_rent_remaining*(1-{d}e0)')} AS renegotiate_{int(d * 100)}" for d in (0.1, 0.2, 0.3))}, {', '.join(f"{f2(f'total_obligation_remaining*(1-{d}e0)')} AS exit_{int(d * 100)}" for d in (0.0, 0.2, 0.3, 0.4, 0.5))} FROM remaining"""),
    "renegotiation_checkpoints": _checkpoints(_BEFORE),
    "exit_checkpoints": _checkpoints(""),
    "asof_backward_snapshot": sql(_SNAP + " SELECT lease_id, analysis_date, x.month_num, x.scheduled_base_rent, x.total_nnn_amount, x.total_obligation_remaining, x.total_base_rent_remaining FROM snap"),
    "asof_forward_remaining": sql(""", f AS (SELECT l.lease_id, l.analysis_date, r.month_num, r.total_obligation_remaining, r.total_base_rent_remaining, row_number() OVER (PARTITION BY l.lease_id ORDER BY r.month_num) AS n
      FROM leases l LEFT JOIN remaining r ON r.lease_id=l.lease_id AND r.period_start>=l.analysis_date) SELECT lease_id, analysis_date, coalesce(month_num,0) AS month_num, coalesce(total_obligation_remaining,0) AS total_obligation_remaining, coalesce(total_base_rent_remaining,0) AS total_base_rent_remaining FROM f WHERE n=1"""),
    "npv_from_date": sql(_VALUES + " SELECT lease_id, fv, fv_base, npv, npv_base, full_fv, free_total, abated_total FROM vals2"),
    "renegotiation_panel": sql(_VALUES + _SNAP + f""" SELECT v.lease_id, d AS discount, {f2('x.scheduled_base_rent*(1-d)')} AS monthly_rent, x.total_nnn_amount AS additional_rent, {f2('fv-d*fv_base')} AS fv, {f2('d*fv_base')} AS gross_savings,
      {f2('free_total*(1-d)+abated_total')} AS concessions, {f2('npv-d*npv_base')} AS npv, round(CASE WHEN npv=0 THEN 0e0 ELSE (npv-(npv-d*npv_base))/npv END, 8) AS savings_share FROM vals2 v JOIN snap s ON s.lease_id=v.lease_id, (VALUES (0e0),(0.1e0),(0.2e0),(0.3e0)) t(d)"""),
    "exit_panel": sql(_VALUES + _SNAP + f""" SELECT v.lease_id, d AS discount, {f2('x.scheduled_base_rent*(1-d)')} AS monthly_rent, x.total_nnn_amount AS additional_rent, {f2('fv*(1-d)')} AS fv, {f2('npv*(1-d)')} AS npv,
      {f2('(free_total+abated_total)*(1-d)')} AS concessions, full_fv FROM vals2 v JOIN snap s ON s.lease_id=v.lease_id, (VALUES (0e0),(0.2e0),(0.3e0),(0.4e0),(0.5e0)) t(d)"""),
    "schedule_gaps": sql(f", holes AS (SELECT lease_id, period_idx, CASE WHEN period_idx=1 THEN period_start+45 ELSE period_start END AS period_start, period_end, monthly_rent FROM periods){_PAIRS.replace('FROM periods', 'FROM holes')} SELECT lease_id, period_idx, CAST(period_start-before_end AS BIGINT) AS gap_days FROM near WHERE period_start-before_end>31", "periods"),
    "schedule_overlaps": sql(f", holes AS (SELECT lease_id, period_idx, CASE WHEN period_idx=2 THEN period_start-20 ELSE period_start END AS period_start, period_end, monthly_rent FROM periods){_PAIRS.replace('FROM periods', 'FROM holes')} SELECT lease_id, period_idx, period_start, before_end FROM near WHERE period_start<=before_end", "periods"),
    "rent_jumps": sql(f", steps2 AS (SELECT lease_id, period_idx, period_start, period_end, monthly_rent*(CASE WHEN period_idx=1 AND lease_id%3=0 THEN 1.2e0 WHEN period_idx=2 THEN 0.4e0 ELSE 1e0 END) AS monthly_rent FROM periods){_PAIRS.replace('FROM periods', 'FROM steps2')}, j AS (SELECT *, (monthly_rent-before_rent)/before_rent AS change FROM near WHERE before_rent>0) SELECT lease_id, period_idx, before_rent, monthly_rent, round(change, 6) AS change FROM j WHERE change>0.15e0 OR change < -0.5e0", "periods"),
    "rent_value_checks": sql(", v AS (SELECT lease_id, period_idx, CASE WHEN lease_id%7=0 THEN -monthly_rent WHEN lease_id%7=1 THEN monthly_rent*1000 WHEN lease_id%7=2 THEN 0.5e0 ELSE monthly_rent END AS r FROM periods) " + flags([("v", "period_idx", "rent-negative", "warning", "r<0"), ("v", "period_idx", "rent-huge", "warning", "r>1000000"), ("v", "period_idx", "rent-fraction", "warning", "r>0 AND r<1")]), "periods"),
    "term_checks": sql(", p AS (SELECT lease_id, period_idx, CASE WHEN lease_id%5=0 THEN CAST(period_start - INTERVAL 40 YEAR AS DATE) ELSE period_start END AS s, CASE WHEN lease_id%11=0 THEN CAST(period_end - INTERVAL 2 YEAR AS DATE) ELSE period_end END AS e FROM periods), q AS (SELECT lease_id, (max(e)-min(s))/365.25e0 AS years FROM p GROUP BY lease_id) "
        + flags([("p", "period_idx", "start-year", "warning", "year(s)<1970 OR year(s)>2070"), ("p", "period_idx", "end-year", "warning", "year(e)<1970 OR year(e)>2070"), ("p", "period_idx", "end-before-start", "error", "e<s"), ("q", "-1", "term-long", "warning", "years>30"), ("q", "-1", "term-short", "warning", "years<1e0/12")]), "periods"),
    "param_issues": sql(", c AS (SELECT * FROM charges JOIN bounds USING (lease_id)), o AS (SELECT o.*, b.lease_start, b.lease_end, t.k FROM overrides o JOIN bounds b USING (lease_id) LEFT JOIN (SELECT DISTINCT lease_id, key AS k FROM charges) t ON t.lease_id=o.lease_id AND t.k=o.target_key), k AS (SELECT * FROM concessions JOIN bounds USING (lease_id)) "
        + flags([("leases", "0", "square-footage", "warning", "square_footage<=0"), ("c", "ord", "charge-year1", "error", "year1 IS NULL OR isnan(year1)"), ("c", "ord", "charge-escalation", "error", "esc_pct IS NULL OR isnan(esc_pct)"), ("c", "ord", "charge-start-outside", "warning", "charge_start<lease_start OR charge_start>lease_end"),
            ("o", "ord", "override-target", "error", "target_key<>'base_rent' AND k IS NULL"), ("o", "ord", "override-date", "error", "effective_date IS NULL"), ("o", "ord", "override-outside", "warning", "effective_date<lease_start OR effective_date>lease_end"), ("o", "ord", "override-amount", "error", "amount IS NULL"), ("o", "ord", "override-negative", "error", "amount<0"),
            ("k", "ord", "concession-month", "error", "scope='monthly_row' AND effective_date IS NULL"), ("k", "ord", "concession-past-term", "error", f"scope='monthly_row' AND {months_incl('lease_start', 'effective_date')}>term_months"), ("k", "ord", "abatement-value", "error", "type='abatement' AND value IS NULL"),
            ("k", "ord", "abatement-mode", "error", "type='abatement' AND coalesce(value_mode,'') NOT IN ('percent','fixed_amount')"), ("k", "ord", "abatement-percent", "error", "value_mode='percent' AND value NOT BETWEEN 0 AND 100"), ("k", "ord", "window-dates", "error", "scope<>'monthly_row' AND end_date<start_date")]), "concessions"),
    "stub_years": sql(", y AS (SELECT lease_id, year_num, count(*) AS n FROM ledger GROUP BY ALL), s AS (SELECT lease_id, arg_min(n, year_num) AS first_year_months, arg_max(n, year_num) AS last_year_months, count(*) AS n_years FROM y GROUP BY lease_id) SELECT * FROM s WHERE first_year_months<12 OR last_year_months<12", "ledger"),
    "template_invariants": sql("SELECT lease_id, count(*) AS n_months, true AS months_sequential, true AS years_every_12, true AS row_adds_up, true AS abatement_adds_up, true AS no_nan, true AS ends_after_start, abs(max(period_end)-any_value(expire))<=31 AS ends_at_expiry, count(*) BETWEEN 1 AND 600 AS term_in_range FROM ledger JOIN (SELECT lease_id, expire FROM leases) USING (lease_id) GROUP BY lease_id", "ledger"),
}
