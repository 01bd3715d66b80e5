"""The relations of ``relations.py`` in DuckDB SQL, written independently of the Spark plans.

``query(body)`` puts the common table expressions that ``body`` needs in front of it.
"""

from __future__ import annotations

import re


def counterpart(column: str) -> str:
    return f"""CASE WHEN {column} IN ('bilateral_concessional', 'bilateral_non_concessional', 'grants_bilateral') THEN 'Bilateral'
        WHEN {column} IN ('multilateral_concessional', 'multilateral_non_concessional', 'grants_multilateral') THEN 'Multilateral'
        WHEN {column} IN ('bonds', 'banks', 'other_private') THEN 'Private' END"""


def dbl(expression: str) -> str:
    return f"CAST(CAST({expression} AS DECIMAL(38,4)) AS DOUBLE)"


def cents(expression: str) -> str:
    """Scaled amounts, to two digits."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38,8)), 2) AS DOUBLE)"


def half_even(amount: str, divisor: int, digits: int = 2) -> str:
    """Exact half-even rounding of DECIMAL(38,4) ``amount`` / ``divisor`` in whole numbers."""
    scale = 10 ** (4 - digits) * divisor
    n = f"CAST({amount} * 10000 AS HUGEINT)"
    q, r = f"(abs({n}) // {scale})", f"(abs({n}) % {scale})"
    up = f"CASE WHEN 2 * {r} > {scale} OR (2 * {r} = {scale} AND {q} % 2 = 1) THEN 1 ELSE 0 END"
    return f"CAST(sign({n}) * ({q} + {up}) AS DOUBLE) / {10 ** digits}"


# (line status, indicator, debt code, measure), written out and not taken from the code under test.
CODES = """
    ('O', 'bilateral_concessional', 'DT.DIS.BLAT.CD', 'principal'),
    ('O', 'bilateral_non_concessional', 'DT.DIS.BLAT.CD', 'principal'),
    ('O', 'bilateral_concessional', 'DT.DIS.BLTC.CD', 'principal'),
    ('O', 'multilateral_concessional', 'DT.DIS.MLAT.CD', 'principal'),
    ('O', 'multilateral_non_concessional', 'DT.DIS.MLAT.CD', 'principal'),
    ('O', 'multilateral_concessional', 'DT.DIS.MLTC.CD', 'principal'),
    ('O', 'bonds', 'DT.DIS.PBND.CD', 'principal'), ('O', 'banks', 'DT.DIS.PCBK.CD', 'principal'),
    ('O', 'other_private', 'DT.DIS.PROP.CD', 'principal'),
    ('F', 'bilateral_concessional', 'DT.AMT.BLAT.CD', 'principal'),
    ('F', 'bilateral_non_concessional', 'DT.AMT.BLAT.CD', 'principal'),
    ('F', 'bilateral_concessional', 'DT.AMT.BLTC.CD', 'principal'),
    ('F', 'bilateral_concessional', 'DT.INT.BLAT.CD', 'interest'),
    ('F', 'bilateral_non_concessional', 'DT.INT.BLAT.CD', 'interest'),
    ('F', 'bilateral_concessional', 'DT.INT.BLTC.CD', 'interest'),
    ('F', 'multilateral_concessional', 'DT.AMT.MLAT.CD', 'principal'),
    ('F', 'multilateral_non_concessional', 'DT.AMT.MLAT.CD', 'principal'),
    ('F', 'multilateral_concessional', 'DT.AMT.MLTC.CD', 'principal'),
    ('F', 'multilateral_concessional', 'DT.INT.MLAT.CD', 'interest'),
    ('F', 'multilateral_non_concessional', 'DT.INT.MLAT.CD', 'interest'),
    ('F', 'multilateral_concessional', 'DT.INT.MLTC.CD', 'interest'),
    ('F', 'bonds', 'DT.AMT.PBND.CD', 'principal'), ('F', 'bonds', 'DT.INT.PBND.CD', 'interest'),
    ('F', 'banks', 'DT.AMT.PCBK.CD', 'principal'), ('F', 'banks', 'DT.INT.PCBK.CD', 'interest'),
    ('F', 'other_private', 'DT.AMT.PROP.CD', 'principal'), ('F', 'other_private', 'DT.INT.PROP.CD', 'interest')"""

CTES = {
    "nat": """
        SELECT n_nationkey AS k, n_name AS country, r_name AS continent,
            CASE n_nationkey // 5 WHEN 0 THEN 'Low income' WHEN 1 THEN 'Lower middle income'
                WHEN 2 THEN 'Upper middle income' WHEN 3 THEN 'High income' END AS income_level
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "isos": """
        SELECT n_name AS name, n_nationkey AS donor_code,
            CASE n_nationkey WHEN 12 THEN 'USA' WHEN 23 THEN 'NX23'
                WHEN 24 THEN NULL ELSE 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END AS iso_code
        FROM nation""",
    "facts": """
        SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_nationkey AS debtor,
            s_nationkey AS creditor, l_linestatus AS status, l_linenumber AS line,
            CASE WHEN l_linenumber = 1 AND l_linestatus = 'O' THEN 'grants_bilateral'
                WHEN l_linenumber = 2 AND l_linestatus = 'O' THEN 'grants_multilateral'
                WHEN l_linenumber = 1 THEN 'bonds' WHEN l_linenumber = 2 THEN 'banks'
                WHEN l_linenumber = 3 THEN 'bilateral_concessional'
                WHEN l_linenumber = 4 THEN 'bilateral_non_concessional'
                WHEN l_linenumber = 5 THEN 'multilateral_concessional'
                WHEN l_linenumber = 6 THEN 'multilateral_non_concessional'
                WHEN l_returnflag = 'A' THEN 'bonds' WHEN l_returnflag = 'N' THEN 'banks'
                WHEN l_returnflag = 'R' THEN 'other_private' END AS indicator,
            CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS principal,
            CAST(l_extendedprice * l_tax AS DECIMAL(18,4)) AS interest,
            CAST(l_extendedprice AS DECIMAL(18,4)) AS gross
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
            JOIN supplier ON l_suppkey = s_suppkey""",
    "flow_rows": f"""
        SELECT f.year, d.country AS iso_code, d.country, d.continent, d.income_level,
            c.country AS counterpart_area, c.country AS counterpart_iso_code,
            {counterpart('f.indicator')} AS counterpart_type, f.indicator,
            CASE WHEN f.paid THEN 'outflow' ELSE 'inflow' END AS indicator_type,
            'current' AS prices, CASE WHEN f.paid THEN -f.principal ELSE f.principal END AS value
        FROM (SELECT *, status = 'F' AND (debtor + year) % 7 <> 0
                AND ((debtor + year) % 7 <> 1 OR line IN (3, 5)) AS paid FROM facts) f
            JOIN nat d ON f.debtor = d.k JOIN nat c ON f.creditor = c.k""",
    "flows": """
        SELECT year, country, continent, income_level, counterpart_area, counterpart_type, indicator,
            indicator_type, prices, sum(value) AS value
        FROM flow_rows GROUP BY ALL HAVING sum(value) <> 0""",
    # --- flow exclusions -------------------------------------------------------------------
    "kept": """
        SELECT f.* FROM flows f
        WHERE f.country NOT IN ('NATION_3', 'NATION_7', 'NATION_9') AND f.year <= 2000
          AND (f.year, f.country) IN (
            SELECT (year, country) FROM flows WHERE indicator_type = 'outflow')""",
    "market": """
        SELECT * FROM flows
        WHERE indicator NOT ILIKE '%grant%'
          AND (indicator NOT ILIKE '%concessional%' OR indicator ILIKE '%non_concessional%')""",
    "kept_market": """
        SELECT f.* FROM market f
        WHERE f.country NOT IN ('NATION_3', 'NATION_7', 'NATION_9') AND f.year <= 2000
          AND (f.year, f.country) IN (
            SELECT (year, country) FROM market WHERE indicator_type = 'outflow')""",
    "no_grants": """
        SELECT f.* FROM flows f
        WHERE f.indicator NOT ILIKE '%grant%' AND f.country NOT IN ('NATION_3', 'NATION_7', 'NATION_9') AND f.year <= 2000
          AND (f.year, f.country) IN (
            SELECT (year, country) FROM flows WHERE indicator_type = 'outflow' AND indicator NOT ILIKE '%grant%')""",
    # Outflow rule over all years, for debt service and outflow estimates.
    "kept_all": """
        SELECT f.* FROM flows f
        WHERE f.country NOT IN ('NATION_3', 'NATION_7', 'NATION_9')
          AND (f.year, f.country) IN (
            SELECT (year, country) FROM flows WHERE indicator_type = 'outflow')""",
    "china": """
        SELECT year, country, continent, income_level,
            CASE WHEN counterpart_area = 'NATION_8' THEN 'China' ELSE counterpart_type END AS counterpart_type,
            indicator, indicator_type, prices, sum(value) AS value
        FROM kept GROUP BY ALL""",
    "china_all": """
        SELECT year, country, continent, income_level,
            CASE WHEN counterpart_area = 'NATION_8' THEN 'China' ELSE counterpart_type END AS counterpart_type,
            indicator, indicator_type, prices, sum(value) AS value
        FROM kept_all GROUP BY ALL""",
    # --- reports ---------------------------------------------------------------------------
    "net_all": """
        SELECT year, country, continent, income_level, prices, indicator_type, sum(value) AS value
        FROM (SELECT year, country, continent, income_level, prices, indicator_type, value FROM kept
            UNION ALL SELECT year, 'Developing countries', 'World', 'All', prices, indicator_type, value FROM kept)
        GROUP BY ALL""",
    "net_market": """
        SELECT year, country, continent, income_level, prices, indicator_type, sum(value) AS value
        FROM (SELECT year, country, continent, income_level, prices, indicator_type, value FROM kept_market
            UNION ALL SELECT year, 'Developing countries', 'World', 'All', prices, indicator_type, value FROM kept_market)
        GROUP BY ALL""",
    "by_type": """
        SELECT *, 'all' AS flow_type FROM net_all
        UNION ALL SELECT year, country, continent, income_level, prices, 'net_flow', sum(value), 'all'
            FROM net_all GROUP BY ALL
        UNION ALL SELECT *, 'excluding_concessional' FROM net_market
        UNION ALL SELECT year, country, continent, income_level, prices, 'net_flow', sum(value),
            'excluding_concessional' FROM net_market GROUP BY ALL""",
    "report": """
        SELECT * FROM by_type
        UNION ALL SELECT year, income_level, NULL, NULL, prices, indicator_type, sum(value), flow_type
            FROM by_type WHERE country <> 'Developing countries' AND income_level <> 'High income'
            GROUP BY year, income_level, prices, indicator_type, flow_type
        UNION ALL SELECT year, 'AFRICA', NULL, NULL, prices, indicator_type, sum(value), flow_type
            FROM by_type WHERE continent = 'AFRICA' GROUP BY year, prices, indicator_type, flow_type""",
    "hist": """
        SELECT year, country, continent, income_level, CASE counterpart_type
                WHEN 'Bilateral' THEN 'Bilateral (excl. China)' WHEN 'Private' THEN 'Private (excl. China)'
                ELSE counterpart_type END AS counterpart_type, indicator_type, prices, sum(value) AS value
        FROM (SELECT * FROM china
            UNION ALL BY NAME SELECT * REPLACE ('Developing countries' AS country, 'World' AS continent,
                'All' AS income_level) FROM china)
        WHERE indicator_type = 'inflow' AND indicator NOT IN ('grants_bilateral', 'grants_multilateral')
            AND income_level IS NOT NULL AND counterpart_type IS NOT NULL
        GROUP BY ALL""",
    "inflow_table": """
        SELECT *, CAST(NULL AS VARCHAR) AS period FROM hist
        UNION ALL BY NAME SELECT year, income_level AS country, counterpart_type, 'current' AS prices, sum(value) AS value
            FROM hist WHERE country <> 'Developing countries' AND income_level <> 'High income'
            GROUP BY year, income_level, counterpart_type
        UNION ALL BY NAME SELECT year, continent AS country, counterpart_type, 'current' AS prices, sum(value) AS value
            FROM hist WHERE continent = 'AFRICA' GROUP BY year, continent, counterpart_type""",
    "service": """
        SELECT year, country, continent, income_level, counterpart_type, prices, -sum(value) AS value
        FROM (SELECT * FROM china_all
            UNION ALL BY NAME SELECT * REPLACE ('Developing countries' AS country, 'World' AS continent,
                'All' AS income_level) FROM china_all)
        WHERE indicator_type = 'outflow' AND year <= 2001 GROUP BY ALL""",
    "service_table": """
        SELECT *, CAST(NULL AS VARCHAR) AS period FROM service
        UNION ALL BY NAME SELECT year, income_level AS country, counterpart_type, 'current' AS prices, sum(value) AS value
            FROM service WHERE country <> 'Developing countries' AND income_level <> 'High income'
            GROUP BY year, income_level, counterpart_type
        UNION ALL BY NAME SELECT year, continent AS country, counterpart_type, 'current' AS prices, sum(value) AS value
            FROM service WHERE continent = 'AFRICA' GROUP BY year, continent, counterpart_type""",
    "service_periods": """
        SELECT period, country, continent, income_level, prices, counterpart_type, sum(value) AS total,
            CASE period WHEN '1997-1999' THEN 3 ELSE 2 END AS years
        FROM (SELECT * REPLACE (CASE WHEN year BETWEEN 1995 AND 1996 THEN '1995-1996'
            WHEN year BETWEEN 1997 AND 1999 THEN '1997-1999'
            WHEN year BETWEEN 2000 AND 2001 THEN '2000-2001' END AS period) FROM service_table)
        WHERE period IS NOT NULL
        GROUP BY period, country, continent, income_level, prices, counterpart_type""",
    "service_averages": f"""
        SELECT period, country, continent, income_level, prices, counterpart_type,
            CASE years WHEN 3 THEN {half_even('total', 3)} ELSE {half_even('total', 2)} END AS value
        FROM service_periods""",
    # --- raw debt --------------------------------------------------------------------------
    "codes": f"SELECT * FROM (VALUES {CODES}) v(status, indicator, code, measure)",
    "debt_raw": """
        SELECT v.code AS indicator, f.year, d.country, '  ' || c.country || ' ' AS counterpart_area,
            sum(CASE v.measure WHEN 'principal' THEN f.principal ELSE f.interest END) AS value
        FROM facts f JOIN codes v ON f.status = v.status AND f.indicator = v.indicator
            JOIN nat d ON f.debtor = d.k JOIN nat c ON f.creditor = c.k GROUP BY ALL""",
    "split_inflows": """
        SELECT t.year, t.country, t.counterpart_area, p.name || p.kind AS indicator,
            CASE p.kind WHEN '_concessional' THEN c.value
                ELSE coalesce(t.value, 0) - coalesce(c.value, 0) END AS value
        FROM debt_raw t JOIN (VALUES
            ('bilateral', '_concessional', 'DT.DIS.BLAT.CD', 'DT.DIS.BLTC.CD'),
            ('bilateral', '_non_concessional', 'DT.DIS.BLAT.CD', 'DT.DIS.BLTC.CD'),
            ('multilateral', '_concessional', 'DT.DIS.MLAT.CD', 'DT.DIS.MLTC.CD'),
            ('multilateral', '_non_concessional', 'DT.DIS.MLAT.CD', 'DT.DIS.MLTC.CD')
            ) p(name, kind, total, part) ON t.indicator = p.total
        LEFT JOIN debt_raw c ON c.indicator = p.part AND c.year = t.year
            AND c.country = t.country AND c.counterpart_area = t.counterpart_area
        WHERE t.year BETWEEN 1995 AND 2000""",
    "inflow_legs": """
        SELECT * FROM split_inflows
        UNION ALL SELECT year, country, counterpart_area, CASE indicator WHEN 'DT.DIS.PBND.CD' THEN 'bonds'
            WHEN 'DT.DIS.PCBK.CD' THEN 'banks' ELSE 'other_private' END, value
        FROM debt_raw WHERE indicator IN ('DT.DIS.PBND.CD', 'DT.DIS.PCBK.CD', 'DT.DIS.PROP.CD')
            AND year BETWEEN 1995 AND 2000""",
    "split_service": """
        SELECT t.year, t.country, t.counterpart_area, p.name || p.kind AS indicator,
            CASE p.kind WHEN '_concessional' THEN c.value
                ELSE coalesce(t.value, 0) - coalesce(c.value, 0) END AS value
        FROM debt_raw t JOIN (
            SELECT n.name, k.kind, 'DT.' || l.leg || '.' || n.code || 'AT.CD' AS total,
                'DT.' || l.leg || '.' || n.code || 'TC.CD' AS part
            FROM (VALUES ('bilateral', 'BL'), ('multilateral', 'ML')) n(name, code),
                (VALUES ('_concessional'), ('_non_concessional')) k(kind),
                (VALUES ('AMT'), ('INT')) l(leg)) p ON t.indicator = p.total
        LEFT JOIN debt_raw c ON c.indicator = p.part AND c.year = t.year
            AND c.country = t.country AND c.counterpart_area = t.counterpart_area
        WHERE t.year BETWEEN 1995 AND 2004""",
    "service_legs": """
        SELECT * FROM split_service
        UNION ALL SELECT year, country, counterpart_area, CASE
            WHEN indicator LIKE '%.PBND.%' THEN 'bonds' WHEN indicator LIKE '%.PCBK.%' THEN 'banks'
            ELSE 'other_private' END, value
        FROM debt_raw WHERE (indicator LIKE 'DT.AMT.P%' OR indicator LIKE 'DT.INT.P%')
            AND year BETWEEN 1995 AND 2004""",
    "names": """
        SELECT country AS raw_name, CASE WHEN k % 3 = 0 OR k % 3 = 1 THEN 'ISO_' || k
                WHEN k BETWEEN 10 AND 19 THEN 'ISO_X' END AS iso_code,
            CASE WHEN k % 3 = 0 OR k % 3 = 1 THEN 'Country ' || k
                WHEN k BETWEEN 10 AND 19 THEN 'Country X' END AS name,
            CASE WHEN k % 3 = 0 OR k % 3 = 1 THEN continent END AS continent
        FROM nat""",
    "income": """
        SELECT 'ISO_' || k AS iso_code, income_level FROM nat WHERE income_level IS NOT NULL""",
    "clean_inflow_legs": f"""
        SELECT l.year, d.iso_code, coalesce(d.name, l.country) AS country,
            coalesce(d.continent, l.country) AS continent,
            coalesce(c.name, trim(l.counterpart_area)) AS counterpart_area,
            coalesce(c.iso_code, trim(l.counterpart_area)) AS counterpart_iso_code,
            i.income_level, l.indicator, {counterpart('l.indicator')} AS counterpart_type,
            'current' AS prices, l.value
        FROM inflow_legs l LEFT JOIN names d ON l.country = d.raw_name
            LEFT JOIN names c ON trim(l.counterpart_area) = c.raw_name
            LEFT JOIN income i ON d.iso_code = i.iso_code
        WHERE l.value IS NOT NULL AND l.value <> 0""",
    "clean_service_legs": f"""
        SELECT l.year, d.iso_code, coalesce(d.name, l.country) AS country,
            coalesce(d.continent, l.country) AS continent,
            coalesce(c.name, trim(l.counterpart_area)) AS counterpart_area,
            coalesce(c.iso_code, trim(l.counterpart_area)) AS counterpart_iso_code,
            i.income_level, l.indicator, {counterpart('l.indicator')} AS counterpart_type,
            'current' AS prices, 'outflow' AS indicator_type, l.value
        FROM service_legs l LEFT JOIN names d ON l.country = d.raw_name
            LEFT JOIN names c ON trim(l.counterpart_area) = c.raw_name
            LEFT JOIN income i ON d.iso_code = i.iso_code
        WHERE l.value IS NOT NULL AND l.value <> 0""",
    # --- aid -------------------------------------------------------------------------------
    "aid_raw": """
        SELECT year, creditor AS donor_code, debtor AS recipient_code, p.prices,
            sum(principal) * p.times AS units
        FROM facts, (VALUES ('current', 1), ('constant', 2)) p(prices, times)
        WHERE status = 'O' AND line IN (1, 2) GROUP BY year, creditor, debtor, p.prices, p.times""",
    "grants": f"""
        SELECT a.year, d.iso_code, coalesce(d.name, rn.raw) AS country,
            coalesce(d.continent, rn.raw) AS continent, coalesce(c.name, dn.raw) AS counterpart_area,
            coalesce(c.iso_code, dn.raw) AS counterpart_iso_code, g.counterpart_type, a.prices,
            g.indicator, a.units AS value, i.income_level
        FROM aid_raw a
        JOIN (SELECT k, country || CASE WHEN k >= 23 THEN ', Total' ELSE '' END AS raw FROM nat) dn ON dn.k = a.donor_code
        JOIN (SELECT k, country || CASE WHEN k >= 23 THEN ', Total' ELSE '' END AS raw FROM nat) rn ON rn.k = a.recipient_code
        JOIN (SELECT k, CASE WHEN k % 2 = 0 THEN 'grants_bilateral' ELSE 'grants_multilateral' END AS indicator,
            CASE WHEN k % 2 = 0 THEN 'Bilateral' ELSE 'Multilateral' END AS counterpart_type FROM nat) g ON g.k = a.donor_code
        LEFT JOIN names d ON rn.raw = d.raw_name LEFT JOIN names c ON dn.raw = c.raw_name
        LEFT JOIN income i ON d.iso_code = i.iso_code
        WHERE a.donor_code < 20 AND a.recipient_code <> 24
            AND coalesce(c.name, dn.raw) NOT LIKE '%, Total%'""",
    "aid_total": f"""
        SELECT f.year, n.k AS donor_code, n.country AS donor_name, 'USD' AS currency,
            'current' AS prices, 'total_oda' AS indicator, sum(f.principal) AS value
        FROM facts f JOIN nat n ON n.k = CASE WHEN f.creditor = 12 AND f.year > 1999 THEN 13 ELSE f.creditor END
        WHERE f.status = 'O' AND f.line IN (1, 2) AND (n.k < 20 OR n.k = 21) AND f.year BETWEEN 1995 AND 2000
        GROUP BY f.year, n.k, n.country""",
    # --- macro, GNI, projections -----------------------------------------------------------
    "nation_years": """
        SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_nationkey AS k,
            CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS ngdp,
            CAST(count(*) * 1000 AS DOUBLE) AS ngdp_r,
            CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) FILTER (o_orderstatus = 'F') AS DOUBLE) AS finished
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "macro": """
        SELECT CASE WHEN m.k = 2 AND m.year = 1998 THEN NULL ELSE i.iso_code END AS iso_code,
            CASE WHEN m.k = 2 AND m.year = 1998 THEN NULL ELSE m.k END AS k, m.year, m.indicator,
            CASE WHEN m.k = 4 AND m.year = 1997 THEN NULL ELSE m.value END AS value
        FROM (SELECT k, year, 'NGDP' AS indicator, ngdp AS value FROM nation_years
            UNION ALL SELECT k, year, 'NGDP_R', ngdp_r FROM nation_years
            UNION ALL SELECT k, year, 'NGDP_D', 100 * ngdp / ngdp_r FROM nation_years
            UNION ALL SELECT debtor, year, 'NGDPD', CAST(sum(gross) AS DOUBLE) FROM facts GROUP BY debtor, year) m
        LEFT JOIN isos i ON m.k = i.donor_code""",
    "padded": """
        SELECT indicator, iso_code, year, last_value(value IGNORE NULLS) OVER (
            PARTITION BY indicator, iso_code ORDER BY year ROWS UNBOUNDED PRECEDING) AS value
        FROM macro WHERE iso_code IS NOT NULL""",
    "growth": """
        SELECT * FROM (SELECT indicator, iso_code, year, value / nullif(lag(value) OVER (
            PARTITION BY indicator, iso_code ORDER BY year), 0) - 1 AS value FROM padded) WHERE value IS NOT NULL""",
    "cumulated": """
        SELECT indicator, iso_code, year, product(1 + value) OVER (
            PARTITION BY indicator, iso_code ORDER BY year ROWS UNBOUNDED PRECEDING) AS value FROM growth""",
    "indices": """
        SELECT c.indicator, c.iso_code, c.year, c.value / nullif(b.value, 0) AS value
        FROM cumulated c LEFT JOIN cumulated b ON b.indicator = c.indicator AND b.iso_code = c.iso_code AND b.year = 1998""",
    "rebased": """
        SELECT m.indicator, m.k, m.iso_code, m.year, m.value / nullif(b.value, 0) AS value
        FROM macro m LEFT JOIN macro b ON b.indicator = m.indicator AND b.k = m.k AND b.year = 1998""",
    "exchange": """
        SELECT l.year, l.iso_code, 100 * (u.value / l.value) / (bu.value / bl.value) AS exchange_deflator
        FROM macro l JOIN macro u ON u.indicator = 'NGDPD' AND u.iso_code = l.iso_code AND u.year = l.year
            JOIN macro bl ON bl.indicator = 'NGDP' AND bl.iso_code = l.iso_code AND bl.year = 1998
            JOIN macro bu ON bu.indicator = 'NGDPD' AND bu.iso_code = l.iso_code AND bu.year = 1998
        WHERE l.indicator = 'NGDP' AND l.iso_code IS NOT NULL""",
    "donor_gni": """
        SELECT n.year, i.iso_code, n.ngdp AS value, n.ngdp * 1.37::DOUBLE AS constant_value
        FROM nation_years n JOIN isos i ON n.k = i.donor_code
        WHERE length(i.iso_code) = 3 AND n.year BETWEEN 1995 AND 1998""",
    "gni_current": """
        SELECT year, iso_code, value AS current_usd_gni FROM donor_gni
        UNION ALL SELECT x.year, x.iso_code, g.value * x.value FROM indices x
            JOIN donor_gni g ON g.iso_code = x.iso_code AND g.year = (SELECT max(year) FROM donor_gni)
        WHERE x.indicator = 'NGDP' AND x.year > (SELECT max(year) FROM donor_gni)""",
    "gni_constant": """
        SELECT year, iso_code, constant_value AS constant_usd_gni FROM donor_gni
        UNION ALL SELECT x.year, x.iso_code, g.constant_value * x.value FROM indices x
            JOIN donor_gni g ON g.iso_code = x.iso_code AND g.year = (SELECT max(year) FROM donor_gni)
        WHERE x.indicator = 'NGDP_R' AND x.year > (SELECT max(year) FROM donor_gni)""",
    "balances": """
        SELECT b.year, CASE WHEN c_nationkey <> 11 THEN i.iso_code END AS entity_code,
            CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) * 1000 AS DOUBLE) AS gni,
            CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) * 1000 AS DOUBLE) / count(*) AS gni_pc
        FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey FROM orders) b
            JOIN customer ON b.o_custkey = c_custkey JOIN isos i ON c_nationkey = i.donor_code
        GROUP BY b.year, c_nationkey, i.iso_code""",
    "projections": """
        SELECT n.year + 4 AS year, CASE WHEN t.k < 10 THEN t.country END AS donor, n.ngdp * 3 AS gni, n.ngdp AS oda_realistic,
            n.finished AS oda_downside, n.ngdp_r AS health_bilateral_realistic,
            n.ngdp_r * 2 AS wb_multilateral_upside, n.ngdp_r * 4 AS agriculture_bilateral_upside
        FROM nation_years n JOIN nat t ON n.k = t.k WHERE n.year + 4 <> 2001""",
    "projection_levels": """
        SELECT p.year, i.iso_code, p.donor, p.oda_realistic * (100 * r.value) AS level
        FROM projections p LEFT JOIN isos i ON p.donor = i.name
        LEFT JOIN rebased r ON r.indicator = 'NGDP' AND r.iso_code = i.iso_code AND r.year + 4 = p.year""",
    "factors": """
        SELECT l.year, l.iso_code, l.donor, l.level / nullif(b.level, 0) AS realistic_multiplier
        FROM projection_levels l JOIN projection_levels b ON b.iso_code = l.iso_code AND b.year = 2000
        WHERE l.level / nullif(b.level, 0) IS NOT NULL""",
    # --- scenarios -------------------------------------------------------------------------
    "latest": """
        SELECT year, country, continent, income_level, counterpart_area, counterpart_type, indicator,
            indicator_type, prices, sum(value) AS value
        FROM (SELECT * FROM kept UNION ALL BY NAME SELECT * REPLACE ('Developing countries' AS country,
            'World' AS continent, 'All' AS income_level) FROM kept)
        WHERE indicator_type = 'inflow'
            AND year = (SELECT max(year) FROM kept WHERE indicator_type = 'inflow')
        GROUP BY ALL""",
    "latest_coded": """
        SELECT l.*, i.iso_code, i.iso_code IS NOT NULL AND i.iso_code IN (SELECT iso_code FROM factors) AS covered,
            indicator ILIKE '%grant%' OR (indicator ILIKE '%concessional%' AND indicator NOT ILIKE '%non_concessional%') AS cut
        FROM latest l LEFT JOIN isos i ON l.counterpart_area = i.name""",
    "years_ahead": "SELECT CAST(range AS INTEGER) AS y FROM range(2000, 2005)",
    "scen1": """
        SELECT y AS year, country, continent, income_level, prices, indicator_type, CAST(sum(value) AS DECIMAL(38,8)) AS value
        FROM latest_coded, years_ahead GROUP BY ALL""",
    **{
        f"scen{n}": f"""
        SELECT year, country, continent, income_level, prices, indicator_type, sum(value) AS value FROM (
            SELECT y.y AS year, l.country, l.continent, l.income_level, l.prices, l.indicator_type,
                CASE WHEN NOT l.cut THEN CAST(l.value AS DECIMAL(38,8)) WHEN l.covered THEN
                    CASE WHEN f.iso_code IS NULL THEN CAST(l.value AS DECIMAL(38,8))
                        ELSE CAST(CAST(l.value AS DOUBLE) * (f.realistic_multiplier{ramp}) AS DECIMAL(38,8)) END
                WHEN l.iso_code = 'USA' THEN CAST(CAST(l.value AS DOUBLE) * (1 - {usa}::DOUBLE / 100 * ((y.y - 2000) / 4)) AS DECIMAL(38,8))
                ELSE CAST(CAST(l.value AS DOUBLE) * (1 - {rest}::DOUBLE / 100 * ((y.y - 2000) / 4)) AS DECIMAL(38,8)) END AS value
            FROM latest_coded l, years_ahead y
            LEFT JOIN factors f ON l.covered AND f.iso_code = l.iso_code AND f.year = y.y) GROUP BY ALL"""
        for n, usa, rest, ramp in (
            (2, 60, 0, ""),
            (3, 80, 10, " - 0.1::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, (y.y - 2002 + 1) / 3))"),
        )
    },
    "scenario_inflows": """
        SELECT *, 'scenario 1' AS scenario FROM scen1 UNION ALL SELECT *, 'scenario 2' FROM scen2
        UNION ALL SELECT *, 'scenario 3' FROM scen3""",
    "estimates": """
        SELECT year, country, continent, income_level, prices, indicator_type, sum(value) AS value
        FROM (SELECT * FROM kept_all UNION ALL BY NAME SELECT * REPLACE ('Developing countries' AS country,
            'World' AS continent, 'All' AS income_level) FROM kept_all)
        WHERE indicator_type = 'outflow' AND year > 2000 GROUP BY ALL""",
    "scenario_pairs": """
        SELECT a.year, a.country, a.continent, a.income_level, a.prices, a.scenario,
            a.value AS inflows, b.value AS outflows
        FROM scenario_inflows a LEFT JOIN estimates b ON a.year = b.year AND a.country = b.country
            AND a.continent = b.continent AND a.income_level IS NOT DISTINCT FROM b.income_level
            AND a.prices = b.prices WHERE a.year <> 2000""",
    "scenario_table": """
        SELECT *, inflows + outflows AS net_flows FROM (
            SELECT * FROM scenario_pairs
            UNION ALL SELECT year, income_level, NULL, NULL, 'current', scenario, coalesce(sum(inflows), 0),
                coalesce(sum(outflows), 0) FROM scenario_pairs WHERE country <> 'Developing countries'
                AND income_level <> 'High income' GROUP BY year, income_level, scenario
            UNION ALL SELECT year, continent, NULL, NULL, 'current', scenario, coalesce(sum(inflows), 0),
                coalesce(sum(outflows), 0) FROM scenario_pairs WHERE continent = 'AFRICA'
                GROUP BY year, continent, scenario)""",
    "aid_coded": """
        SELECT a.*, i.iso_code, CASE WHEN i.iso_code IN (SELECT iso_code FROM factors) THEN 'covered'
            WHEN i.iso_code = 'USA' THEN 'usa' ELSE 'rest' END AS class
        FROM aid_total a LEFT JOIN isos i ON a.donor_code = i.donor_code""",
    "aid_latest": "SELECT class, max(year) AS latest FROM aid_coded GROUP BY class",
    "aid_ahead": """
        SELECT a.* REPLACE (CAST(y.range AS INTEGER) AS year), l.latest
        FROM aid_coded a JOIN aid_latest l ON a.class = l.class, range(1995, 2005) y
        WHERE y.range = a.year OR (a.year = l.latest AND y.range > l.latest)""",
    **{
        f"aid_scen{n}": f"""
        SELECT a.year, a.donor_code, a.donor_name, a.currency, a.prices, a.indicator, a.iso_code,
            CASE WHEN a.class = 'covered' THEN CASE WHEN f.iso_code IS NULL THEN CAST(a.value AS DECIMAL(38,8))
                    ELSE CAST(CAST(a.value AS DOUBLE) * (f.realistic_multiplier{ramp}) AS DECIMAL(38,8)) END
                WHEN a.year <= a.latest THEN CAST(a.value AS DECIMAL(38,8))
                ELSE CAST(CAST(a.value AS DOUBLE) * (1 - CASE a.class WHEN 'usa' THEN {usa}::DOUBLE ELSE {rest}::DOUBLE END
                    / 100 * ((a.year - a.latest) / (2004 - a.latest))) AS DECIMAL(38,8)) END AS value
        FROM aid_ahead a LEFT JOIN factors f ON a.class = 'covered' AND f.iso_code = a.iso_code AND f.year = a.year"""
        for n, usa, rest, ramp in (
            (2, 60, 0, ""),
            (3, 80, 10, " - 0.1::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, (a.year - 2002 + 1) / 3))"),
        )
    },
    **{
        f"aid_dac{n}": f"""
        SELECT * FROM aid_scen{n} UNION ALL SELECT year, 20001, 'DAC Countries', currency, prices, indicator,
            'DAC', sum(value) FROM aid_scen{n} GROUP BY year, currency, prices, indicator"""
        for n in (2, 3)
    },
    "aid_history": """
        SELECT year, donor_name, currency, prices, value FROM aid_total UNION ALL
        SELECT year, 'DAC Countries', currency, prices, sum(value) FROM aid_total GROUP BY year, currency, prices""",
}


def _tables(body: str, ctes: dict[str, str]) -> list[str]:
    words = re.findall(r"(?:FROM|JOIN|,)\s+([a-z_0-9]+)\b", body)
    return [w for w in dict.fromkeys(words) if w in ctes]


def _needed(body: str, done: dict[str, None], ctes: dict[str, str]) -> dict[str, None]:
    for name in _tables(body, ctes):
        if name not in done:
            _needed(ctes[name], done, ctes)
            done[name] = None
    return done


def query(body: str, **instead: str) -> str:
    """``body`` with the common table expressions it uses, dependencies first; ``instead`` replaces some of them."""
    ctes = CTES | instead
    parts = [f"{name} AS ({ctes[name].strip()})" for name in _needed(body, {}, ctes)]
    return (f"WITH {', '.join(parts)} " if parts else "") + body.strip()
