"""SQL twins of the statement queries, for a single-node check.

Written the plain way (self joins, range joins, list aggregates) on purpose, so
that they share no technique with the Spark operators they check.
"""

from __future__ import annotations

from ..sources.rules import RULES_V1


def _quote(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


_RULE_VALUES = ",\n    ".join(
    f"({_quote(rid)}, {pri}, {_quote(text)}, {_quote(way)}, {_quote(cls)}, {_quote(conf)}, {_quote(cp)})"
    for rid, pri, text, way, cls, conf, cp in RULES_V1
)

CHAIN: dict[str, str] = {
    "ev": """
      SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS d,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
        CAST(3 * ((year(ts) - 2024) * 12 + month(ts) - 1) + 1 + least(2, (day(ts) - 1) // 10) AS BIGINT) AS doc_index
      FROM events""",
    "raw": """
      SELECT *, CAST(0 AS BIGINT) AS part,
        (user_id % 3 = 0 AND event_type IN ('purchase', 'error', 'view'))
          OR (user_id % 3 = 1 AND event_type IN ('purchase', 'error') AND dayofweek(d) + 1 = 2 + user_id % 5)
          OR (user_id % 3 = 2 AND event_type = 'purchase') AS pays,
        CASE WHEN user_id % 6 = 3 THEN 'ACH DEBIT Acme Leasing' WHEN user_id % 3 = 0 THEN 'Credibly'
             WHEN user_id % 3 = 1 THEN '1st Alliance' ELSE 'National Funding' END AS lender,
        CAST(100 + 25 * (user_id % 5) + CASE WHEN user_id % 4 = 0 AND day(d) > 15 THEN 60 ELSE 0 END AS DECIMAL(18,2)) AS due
      FROM ev""",
    "line": """
      SELECT event_id, user_id, doc_index, part, d,
        user_id || '_' || doc_index || CASE WHEN part = 0 THEN '' ELSE '_' || part END AS key,
        CASE WHEN event_id % 991 = 0 THEN NULL WHEN event_id % 983 = 0 THEN CAST(d - 40 AS DATE) ELSE d END AS txn_date,
        CASE WHEN pays THEN lender || ' payment REF ' || event_id
             WHEN event_type = 'signup' THEN CASE
               WHEN k < 5 THEN 'Internal transfer' WHEN k < 10 THEN 'Working capital'
               WHEN k < 13 THEN lender || ' funding' WHEN k < 18 THEN 'Business loan proceeds'
               WHEN k < 40 THEN 'ACH return ' || lender ELSE 'Customer ' || k END
             WHEN event_type = 'click' THEN CASE WHEN k = 0 THEN '' ELSE 'Customer revenue #' || k END
             ELSE 'Vendor ' || substr('ABCDE', 1 + k % 5, 1) || ' invoice ' || k END AS description,
        CAST(CASE WHEN event_id % 997 = 0 THEN NULL WHEN pays THEN -due
             WHEN event_type = 'signup' AND k BETWEEN 10 AND 12 THEN 9000 + 10 * k
             WHEN event_type = 'signup' AND k BETWEEN 18 AND 39 THEN due
             WHEN event_type IN ('signup', 'click') THEN CAST(value AS DECIMAL(18,2)) * 3
             ELSE -CAST(value AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS amount
      FROM raw""",
    "sheet": """
      SELECT key, user_id, doc_index, part, CAST((doc_index - 1) % 3 AS INT) AS slot, min(d) AS any_day,
        CAST(coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS DECIMAL(18,2)) AS credits,
        CAST(coalesce(-sum(amount) FILTER (WHERE amount < 0), 0) AS DECIMAL(18,2)) AS debits,
        list({'d': txn_date, 'text': description, 'amount': amount} ORDER BY event_id) AS lines
      FROM line GROUP BY ALL""",
    "sheet2": """
      SELECT *, CASE WHEN user_id % 11 = 0 AND slot = 1 THEN NULL ELSE 1000 + 10 * (user_id % 50) END AS opening,
        CAST(date_trunc('month', any_day) AS DATE) AS month_start
      FROM sheet""",
    "extracted": """
      SELECT 'entry_' || user_id AS entry_id,
        'doc_' || key || CASE WHEN shift = -1 THEN '_x' ELSE '' END AS document_id,
        doc_index + part * 1000000 AS document_index, 'file_' || key AS file_id, key, shift,
        CASE WHEN user_id % 9 = 4 THEN NULL ELSE 'ACCT-' || user_id END AS account_number,
        'Bank ' || user_id % 3 AS bank_name, 'Company ' || user_id AS company,
        CAST(opening + CASE WHEN shift = 2 AND user_id % 26 = 0 THEN 100 ELSE 0 END AS DECIMAL(18,2)) AS start_balance,
        CASE WHEN user_id % 17 = 0 THEN NULL ELSE CAST(opening + credits - debits AS DECIMAL(18,2)) END AS end_balance,
        CAST(month_start + 10 * slot - CASE WHEN user_id % 10 = 7 AND slot = 1 THEN 3 ELSE 0 END AS DATE) AS start_date,
        CASE WHEN slot = 2 THEN last_day(any_day) ELSE CAST(month_start + 10 * slot + 9 AS DATE) END AS end_date,
        credits + CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS total_credits, debits AS total_debits, lines
      FROM sheet2, (VALUES (0), (2), (-1)) AS s(shift)
      WHERE shift = 0 OR (shift = 2 AND user_id % 13 = 0) OR (shift = -1 AND user_id % 29 = 0)""",
    "ledger": """
      SELECT 'entry_' || user_id AS entry_id, 'doc_' || key AS document_id, doc_index + part * 1000000 AS document_index,
        older, CASE WHEN older = 1 THEN 'old_' ELSE '' END ||
          CASE WHEN user_id % 19 = 0 AND slot = 2 THEN NULL
               WHEN user_id % 23 = 5 AND slot = 0 THEN 'file_' || (user_id - 1) || '_' || doc_index
               ELSE 'file_' || key END AS file_id
      FROM sheet, (VALUES (0), (1)) AS o(older) WHERE older = 0 OR user_id % 5 = 0""",
    "diagnosed": """
      SELECT file_id, count(*) AS duplicate_count,
        count(DISTINCT CAST({'a': account_number, 'b': bank_name, 'c': company, 'd': start_balance, 'e': end_balance,
          'f': start_date, 'g': end_date, 'h': total_credits, 'i': total_debits, 'l': lines} AS VARCHAR)) > 1 AS payload_conflict,
        count(DISTINCT entry_id || '/' || document_id || '/' || document_index) > 1 AS binding_conflict
      FROM extracted GROUP BY file_id""",
    "canon": """
      SELECT e.*, g.duplicate_count, g.payload_conflict, g.binding_conflict
      FROM (SELECT * FROM extracted QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY shift DESC) = 1) e
      JOIN diagnosed g USING (file_id)""",
    "tx": """
      SELECT c.entry_id, c.document_id, c.document_index, c.file_id, l.txn_date, l.description, l.amount, l.event_id,
        row_number() OVER (PARTITION BY c.file_id ORDER BY l.txn_date ASC NULLS LAST, l.event_id) AS idx,
        CASE WHEN account_number IS NOT NULL AND trim(account_number) <> ''
             THEN sha256('ENTRY|' || c.entry_id || '|ACCOUNT|' || lower(bank_name) || '|' || lower(account_number))
             ELSE sha256('DOCUMENT|' || c.entry_id || '|' || c.document_id) END AS account_key
      FROM canon c JOIN line l USING (key)""",
    "summed": """
      SELECT file_id, count(*) AS num_transactions,
        count(*) FILTER (WHERE t.amount > 0) AS num_credits, count(*) FILTER (WHERE t.amount < 0) AS num_debits,
        count(*) FILTER (WHERE t.amount IS NULL) AS missing_amounts, count(*) FILTER (WHERE txn_date IS NULL) AS missing_dates,
        count(*) FILTER (WHERE txn_date < start_date OR txn_date > end_date) AS outside,
        coalesce(sum(t.amount) FILTER (WHERE t.amount > 0), 0) AS credit_sum,
        coalesce(-sum(t.amount) FILTER (WHERE t.amount < 0), 0) AS debit_sum, coalesce(sum(t.amount), 0) AS net
      FROM tx t JOIN canon c USING (file_id) GROUP BY file_id""",
    "calc0": """
      SELECT c.*, s.* EXCLUDE (file_id),
        CASE WHEN missing_amounts = 0 THEN credit_sum END AS calc_credits,
        CASE WHEN missing_amounts = 0 THEN debit_sum END AS calc_debits,
        CASE WHEN missing_amounts = 0 THEN start_balance + net END AS calc_end
      FROM canon c JOIN summed s USING (file_id)""",
    "calc": """
      SELECT *, calc_credits - total_credits AS credits_difference, calc_debits - total_debits AS debits_difference,
        calc_end - end_balance AS ending_balance_difference,
        CASE WHEN total_credits IS NULL THEN 'PRINTED_VALUE_MISSING' WHEN calc_credits IS NULL THEN 'CALCULATION_INCOMPLETE'
             WHEN abs(calc_credits - total_credits) <= 0.01 THEN 'MATCH' ELSE 'MISMATCH' END AS credits_status,
        CASE WHEN total_debits IS NULL THEN 'PRINTED_VALUE_MISSING' WHEN calc_debits IS NULL THEN 'CALCULATION_INCOMPLETE'
             WHEN abs(calc_debits - total_debits) <= 0.01 THEN 'MATCH' ELSE 'MISMATCH' END AS debits_status,
        CASE WHEN end_balance IS NULL THEN 'PRINTED_VALUE_MISSING' WHEN calc_end IS NULL THEN 'CALCULATION_INCOMPLETE'
             WHEN abs(calc_end - end_balance) <= 0.01 THEN 'MATCH' ELSE 'MISMATCH' END AS ending_balance_status
      FROM calc0""",
    "cal": """
      WITH days AS (
        SELECT CAST(unnest(range(TIMESTAMP '2015-01-01', TIMESTAMP '2041-01-01', INTERVAL 1 DAY)) AS DATE) AS day),
      named AS (
        SELECT day, CASE
          WHEN month(day) = 1 AND day(day) = 1 THEN 'New Year''s Day'
          WHEN month(day) = 6 AND day(day) = 19 AND year(day) >= 2021 THEN 'Juneteenth National Independence Day'
          WHEN month(day) = 7 AND day(day) = 4 THEN 'Independence Day'
          WHEN month(day) = 11 AND day(day) = 11 THEN 'Veterans Day'
          WHEN month(day) = 12 AND day(day) = 25 THEN 'Christmas Day' END AS fixed,
        CASE
          WHEN month(day) = 1 AND isodow(day) = 1 AND (day(day) - 1) // 7 = 2 THEN 'Birthday of Martin Luther King, Jr.'
          WHEN month(day) = 2 AND isodow(day) = 1 AND (day(day) - 1) // 7 = 2 THEN 'Washington''s Birthday'
          WHEN month(day) = 5 AND isodow(day) = 1 AND day(day) > 24 THEN 'Memorial Day'
          WHEN month(day) = 9 AND isodow(day) = 1 AND (day(day) - 1) // 7 = 0 THEN 'Labor Day'
          WHEN month(day) = 10 AND isodow(day) = 1 AND (day(day) - 1) // 7 = 1 THEN 'Columbus Day'
          WHEN month(day) = 11 AND isodow(day) = 4 AND (day(day) - 1) // 7 = 3 THEN 'Thanksgiving Day' END AS floating
        FROM days),
      moved AS (
        SELECT day, list_sort([x FOR x IN [fixed, floating, observed] IF x IS NOT NULL]) AS names
        FROM (SELECT *, CASE WHEN isodow(day) = 1 THEN lag(fixed) OVER (ORDER BY day) || ' (Observed)' END AS observed FROM named))
      SELECT day, isodow(day) < 6 AND len(names) = 0 AS business, isodow(day) >= 6 AS weekend,
        CASE WHEN len(names) > 0 THEN array_to_string(names, '; ') END AS holiday_name,
        count(*) FILTER (WHERE isodow(day) < 6 AND len(names) = 0) OVER (ORDER BY day) AS ord
      FROM moved""",
    "rules": f"""
      SELECT * FROM (VALUES
    {_RULE_VALUES}) AS r(rule_id, priority, match_value, direction, classification, confidence, counterparty)""",
    "worded": """
      SELECT *, upper(trim(regexp_replace(lower(coalesce(description, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS words,
        CASE WHEN amount > 0 THEN 'CREDIT' WHEN amount < 0 THEN 'DEBIT' END AS way,
        sha256(file_id || ':' || lpad(CAST(idx AS VARCHAR), 20, '0')) AS tid
      FROM tx""",
    "hit": """
      SELECT w.tid, r.rule_id, r.priority, r.classification, r.confidence, r.counterparty,
        min(r.priority) OVER (PARTITION BY w.tid) AS best
      FROM worded w JOIN rules r ON (r.direction = 'EITHER' OR r.direction = w.way) AND contains(w.words, r.match_value)""",
    "verdict": """
      SELECT tid, min(best) AS matched_priority, string_agg(rule_id, ',' ORDER BY priority, rule_id) AS rule_ids,
        count(DISTINCT classification || '/' || confidence || '/' || coalesce(counterparty, '?')) FILTER (WHERE priority = best) > 1 AS conflict,
        arg_min(classification, rule_id) FILTER (WHERE priority = best) AS classification,
        arg_min(confidence, rule_id) FILTER (WHERE priority = best) AS confidence,
        first(counterparty ORDER BY priority, rule_id) FILTER (WHERE counterparty IS NOT NULL) AS counterparty,
        bool_or(classification = 'REVERSAL' AND confidence = 'CONFIRMED') AS is_marker
      FROM hit GROUP BY tid""",
    "resolved": """
      SELECT w.*, sha256(words) AS fingerprint,
        sha256(array_to_string([t FOR t IN string_split(words, ' ') IF t <> '' AND NOT regexp_full_match(t, '[0-9]+')
          AND t NOT IN ('REF', 'REFERENCE', 'TRACE', 'TRN', 'TRANSACTION', 'ID', 'CONFIRMATION')], ' ')) AS party,
        matched_priority, coalesce(rule_ids, '') AS rule_ids, coalesce(conflict, false) AS conflict,
        CASE WHEN conflict THEN 'NON_REVENUE_CANDIDATE' ELSE classification END AS classification,
        CASE WHEN conflict THEN 'CANDIDATE' ELSE confidence END AS confidence,
        CASE WHEN NOT conflict THEN counterparty END AS counterparty, coalesce(is_marker, false) AS is_marker
      FROM worded w LEFT JOIN verdict v USING (tid)""",
    "cur": "SELECT * EXCLUDE (older) FROM ledger WHERE older = 0",
    "live": "SELECT r.* FROM resolved r SEMI JOIN cur USING (entry_id, document_id, document_index, file_id)",
    "couple": """
      SELECT rev.tid AS rev_tid, rev.txn_date AS rev_date, org.tid AS org_tid
      FROM live rev JOIN live org ON rev.entry_id = org.entry_id AND rev.account_key = org.account_key
        AND rev.counterparty = org.counterparty AND rev.amount = -org.amount AND org.txn_date <= rev.txn_date
      JOIN cal a ON a.day = org.txn_date JOIN cal b ON b.day = rev.txn_date
      WHERE rev.is_marker AND NOT org.is_marker AND b.ord - a.ord <= 5
      QUALIFY row_number() OVER (PARTITION BY rev.tid ORDER BY org.txn_date DESC, org.document_index DESC, org.idx DESC, org.tid DESC) = 1""",
    "pair": "SELECT * FROM couple QUALIFY row_number() OVER (PARTITION BY org_tid ORDER BY rev_date, rev_tid) = 1",
    "classified": """
      SELECT r.*, coalesce(p.org_tid, q.rev_tid) AS partner, p.rev_tid IS NOT NULL AS is_reversal,
        q.org_tid IS NOT NULL AS is_original, q.org_tid IS NOT NULL AND amount < 0 AS is_reversed_payment
      FROM resolved r LEFT JOIN pair p ON r.tid = p.rev_tid LEFT JOIN pair q ON r.tid = q.org_tid""",
    "period0": """
      SELECT c.entry_id, c.document_id, c.document_index, c.file_id, start_date, end_date, lower(bank_name) AS bank,
        lower(company) AS company, lower(coalesce(account_number, '')) AS account
      FROM calc c SEMI JOIN cur USING (entry_id, document_id, document_index, file_id)""",
    "period1": """
      SELECT *, last_value(CASE WHEN end_date >= start_date THEN end_date END IGNORE NULLS) OVER (
          PARTITION BY entry_id, bank, company, account ORDER BY start_date NULLS FIRST, end_date NULLS FIRST, document_index, document_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM period0""",
    "period2": """
      SELECT *, sum(CASE WHEN account = '' AND bank <> '' AND company <> '' AND end_date >= start_date
            AND (before IS NULL OR start_date - before <> 1) THEN 1 ELSE 0 END) OVER (
          PARTITION BY entry_id, bank, company, account ORDER BY start_date NULLS FIRST, end_date NULLS FIRST, document_index, document_id) AS chain
      FROM period1""",
    "period": """
      SELECT entry_id, document_id, document_index, file_id, start_date, end_date,
        CASE WHEN account <> '' THEN sha256('ENTRY|' || entry_id || '|ACCOUNT|' || bank || '|' || account)
             WHEN bank <> '' AND company <> '' AND end_date >= start_date AND chain > 0
               THEN sha256('ENTRY|' || entry_id || '|INFERRED|' || bank || '|' || company || '|' || chain)
             ELSE sha256('DOCUMENT|' || entry_id || '|' || document_id) END AS account_key
      FROM period2""",
    "cover": "SELECT entry_id, account_key, min(start_date) AS c0, max(end_date) AS c1 FROM period GROUP BY ALL",
    "moved_money": """
      SELECT t.entry_id, t.document_id, t.document_index, t.file_id, t.tid, t.idx, t.txn_date, abs(t.amount) AS paid,
        p.account_key, NOT t.is_reversed_payment AS good,
        CASE WHEN amount > 0 AND partner IS NULL AND classification = 'MCA_FUNDING' AND confidence = 'CONFIRMED'
               AND counterparty IS NOT NULL THEN 'FUNDING'
             WHEN amount < 0 AND NOT is_marker AND ((classification = 'MCA_PAYMENT' AND confidence = 'CONFIRMED' AND counterparty IS NOT NULL)
               OR (classification IS NULL AND party <> sha256(''))) THEN 'PAYMENT' END AS kind,
        CASE WHEN counterparty IS NOT NULL AND classification IN ('MCA_FUNDING', 'MCA_PAYMENT') AND confidence = 'CONFIRMED'
             THEN counterparty END AS lender,
        coalesce('LENDER:' || CASE WHEN classification IN ('MCA_FUNDING', 'MCA_PAYMENT') AND confidence = 'CONFIRMED' THEN counterparty END,
                 'UNKNOWN:' || party) AS base
      FROM classified t JOIN period p USING (entry_id, document_id, document_index, file_id)
      WHERE t.txn_date IS NOT NULL""",
    "epoch": """
      SELECT *, count(*) FILTER (WHERE kind = 'FUNDING') OVER (o ROWS UNBOUNDED PRECEDING) AS epoch,
        min(txn_date) FILTER (WHERE kind = 'FUNDING') OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_funding
      FROM moved_money WHERE kind IS NOT NULL
      WINDOW o AS (PARTITION BY entry_id, account_key, base ORDER BY txn_date, document_index, idx, tid)""",
    "turn": """
      SELECT *, lag(paid) OVER o AS p0, lead(paid, 1) OVER o AS p1, lead(paid, 2) OVER o AS p2
      FROM epoch WHERE kind = 'PAYMENT' AND good
      WINDOW o AS (PARTITION BY entry_id, account_key, base, epoch ORDER BY txn_date, document_index, idx, tid)""",
    "turned": """
      SELECT * EXCLUDE (p0, p1, p2), abs(paid - p0) > greatest(1, p0 * 0.01) AND abs(p1 - paid) <= greatest(1, paid * 0.01)
          AND abs(p2 - paid) <= greatest(1, paid * 0.01) AS opens
      FROM turn
      UNION ALL BY NAME SELECT *, false AS opens FROM epoch WHERE kind = 'PAYMENT' AND NOT good""",
    "stream": """
      SELECT *, sha256(account_key || '|' || base || '|' || epoch || '|' || stream) AS pos FROM (
        SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY entry_id, account_key, base, epoch
          ORDER BY txn_date, document_index, idx, tid ROWS UNBOUNDED PRECEDING) AS stream
        FROM turned)""",
    "middle": """
      SELECT pos, CAST((v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(20,3)) AS median
      FROM (SELECT pos, list(paid ORDER BY paid) AS v FROM stream WHERE good GROUP BY pos)""",
    "pay": """
      SELECT s.*, m.median, good AND coalesce(abs(paid - median) <= greatest(1, median * 0.01), false) AS steady,
        CASE WHEN txn_date BETWEEN c0 AND c1 THEN business END AS business, CASE WHEN txn_date BETWEEN c0 AND c1 THEN ord END AS ord
      FROM stream s LEFT JOIN middle m USING (pos) JOIN cover USING (entry_id, account_key) LEFT JOIN cal ON day = txn_date""",
    "pos0": """
      SELECT entry_id, account_key, base, epoch, stream, pos, min(lender) AS lender, min(next_funding) AS next_funding,
        max(median) AS median, count(*) FILTER (WHERE good) AS n, coalesce(sum(paid) FILTER (WHERE good), 0) AS total_paid,
        min(txn_date) FILTER (WHERE good) AS d0, max(txn_date) FILTER (WHERE good) AS d1,
        count(*) FILTER (WHERE good AND NOT steady) AS changes, count(*) FILTER (WHERE steady) AS steady_n,
        count(DISTINCT txn_date) FILTER (WHERE steady AND business) AS steady_days,
        min(txn_date) FILTER (WHERE steady) AS s0, max(txn_date) FILTER (WHERE steady) AS s1
      FROM pay GROUP BY ALL""",
    "gaps": """
      SELECT pos, txn_date - lag(txn_date) OVER o AS g1, lag(txn_date) OVER o - lag(txn_date, 2) OVER o AS g2
      FROM pay WHERE steady WINDOW o AS (PARTITION BY pos ORDER BY txn_date, document_index, idx, tid)""",
    "runs": """
      SELECT pos, bool_or(g1 BETWEEN 6 AND 8 AND g2 BETWEEN 6 AND 8) AS w, bool_or(g1 BETWEEN 13 AND 15 AND g2 BETWEEN 13 AND 15) AS b,
        bool_or(g1 BETWEEN 26 AND 35 AND g2 BETWEEN 26 AND 35) AS m
      FROM gaps GROUP BY pos""",
    "pos1": """
      SELECT p.*, c0, c1, w, b, m, (SELECT count(*) FROM cal WHERE business AND day BETWEEN p.s0 AND p.s1 AND day BETWEEN c0 AND c1) AS span
      FROM pos0 p LEFT JOIN runs USING (pos) JOIN cover USING (entry_id, account_key)""",
    "pos2": """
      SELECT *, CASE WHEN steady_days >= 4 AND span > 0 AND steady_days >= 0.70 * span THEN 'BUSINESS_DAILY'
          WHEN steady_n >= 3 AND w THEN 'WEEKLY' WHEN steady_n >= 3 AND b THEN 'BIWEEKLY'
          WHEN steady_n >= 3 AND m THEN 'MONTHLY' ELSE 'UNCONFIRMED' END AS frequency
      FROM pos1""",
    "posn": """
      SELECT *, CASE WHEN lender IS NOT NULL AND (frequency <> 'UNCONFIRMED' OR epoch > 0) THEN 'CONFIRMED' ELSE 'CANDIDATE' END AS grade,
        changes > 0 OR NOT (lender IS NOT NULL AND (frequency <> 'UNCONFIRMED' OR epoch > 0)) AS review,
        CASE WHEN c1 IS NOT NULL THEN least(c1, coalesce(next_funding - 1, DATE '9999-12-31')) END AS until
      FROM pos2 WHERE lender IS NOT NULL OR frequency <> 'UNCONFIRMED'""",
    "anchor": """
      SELECT p.entry_id, p.account_key, p.pos, p.frequency, k.day AS anchor, k.ord AS anchor_ord
      FROM posn p JOIN cal k ON k.day BETWEEN p.c0 AND p.c1 AND k.day BETWEEN p.s0 AND p.until
      WHERE (frequency = 'BUSINESS_DAILY' AND k.business) OR (frequency = 'WEEKLY' AND (k.day - s0) % 7 = 0)
        OR (frequency = 'BIWEEKLY' AND (k.day - s0) % 14 = 0)
        OR (frequency = 'MONTHLY' AND k.day = CAST(s0 + to_months(CAST((year(k.day) - year(s0)) * 12 + month(k.day) - month(s0) AS INT)) AS DATE))""",
    "due": """
      SELECT a.entry_id, a.pos, a.frequency, k.day AS due, k.ord AS due_ord, w.document_index, w.document_id, w.file_id
      FROM anchor a JOIN cal k ON k.business AND CASE WHEN frequency = 'BUSINESS_DAILY' THEN k.day = a.anchor ELSE abs(k.ord - a.anchor_ord) <= 1 END
      JOIN period w ON w.entry_id = a.entry_id AND w.account_key = a.account_key AND k.day BETWEEN w.start_date AND w.end_date
      QUALIFY row_number() OVER (PARTITION BY a.pos, a.anchor ORDER BY abs(k.day - a.anchor), k.day < a.anchor, k.day,
        w.document_index, w.document_id, w.file_id) = 1""",
    "plan": """
      SELECT DISTINCT d.*, EXISTS (SELECT 1 FROM pay p WHERE p.pos = d.pos AND p.steady
          AND CASE WHEN d.frequency = 'BUSINESS_DAILY' THEN p.txn_date = d.due ELSE abs(p.ord - d.due_ord) <= 1 END) AS met
      FROM due d""",
    "last3": "SELECT pos, list(met ORDER BY due DESC) AS mets FROM plan GROUP BY pos",
    "status": """
      SELECT p.*, CASE WHEN frequency = 'UNCONFIRMED' THEN 'CADENCE_UNCONFIRMED' WHEN mets[1] THEN 'CURRENT_PAYING'
          WHEN NOT mets[1] AND (mets[2] OR mets[3]) THEN 'CURRENT_WITH_MISSES'
          WHEN NOT mets[1] AND NOT mets[2] THEN 'INACTIVE' ELSE 'CADENCE_UNCONFIRMED' END AS status
      FROM posn p LEFT JOIN last3 USING (pos)""",
    "mca": """
      SELECT s.entry_id, w.document_id, w.document_index, w.file_id, s.account_key, s.pos, coalesce(s.lender, 'Unknown recurring debit') AS lender,
        s.grade, s.review, s.status, s.median, s.frequency,
        (SELECT count(*) FROM pay p WHERE p.pos = s.pos AND p.good AND p.file_id = w.file_id) AS n,
        CASE WHEN s.frequency <> 'UNCONFIRMED' THEN (SELECT count(*) FROM plan e WHERE e.pos = s.pos AND e.file_id = w.file_id AND NOT met) END AS missed,
        coalesce((SELECT sum(paid) FROM pay p WHERE p.pos = s.pos AND p.good AND p.file_id = w.file_id), 0) AS total_paid,
        (SELECT min(txn_date) FROM pay p WHERE p.pos = s.pos AND p.good AND p.file_id = w.file_id) AS d0,
        (SELECT max(txn_date) FROM pay p WHERE p.pos = s.pos AND p.good AND p.file_id = w.file_id) AS d1
      FROM status s JOIN period w ON w.entry_id = s.entry_id AND w.account_key = s.account_key
      WHERE EXISTS (SELECT 1 FROM pay p WHERE p.pos = s.pos AND p.file_id = w.file_id)
         OR EXISTS (SELECT 1 FROM plan e WHERE e.pos = s.pos AND e.file_id = w.file_id)""",
    "metric": """
      SELECT file_id, coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS deposits,
        coalesce(sum(amount) FILTER (WHERE amount > 0 AND ((confidence = 'CONFIRMED' AND classification IN ('TRANSFER', 'MCA_FUNDING', 'OTHER_LOAN_PROCEEDS')
          AND NOT (is_marker AND NOT is_reversal)) OR is_reversal OR is_original)), 0) AS non_revenue,
        coalesce(sum(amount) FILTER (WHERE amount > 0 AND (confidence = 'CANDIDATE' OR conflict OR words = '' OR (is_marker AND NOT is_reversal))), 0) AS unclear,
        count(*) FILTER (WHERE amount > 0 AND (confidence = 'CANDIDATE' OR conflict OR words = '' OR (is_marker AND NOT is_reversal))) AS unclear_n,
        count(*) FILTER (WHERE is_marker AND partner IS NULL) AS unpaired, count(*) FILTER (WHERE conflict) AS conflicts
      FROM classified GROUP BY file_id""",
    "closing": """
      SELECT c.file_id, k.day, c.start_balance + coalesce((SELECT sum(amount) FROM tx t WHERE t.file_id = c.file_id AND t.txn_date <= k.day), 0) AS balance
      FROM canon c JOIN cal k ON k.day BETWEEN c.start_date AND c.end_date""",
    "closed": """
      SELECT file_id, count(*) AS days, CAST(sum(balance) AS DOUBLE) / count(*) AS average, CAST(sum(balance) * 100 AS HUGEINT) AS total_cents, count(*) FILTER (WHERE balance < 0) AS negative
      FROM closing GROUP BY file_id""",
    "fin": """
      SELECT c.*, m.* EXCLUDE (file_id), coalesce(days, 0) AS days, end_date - start_date + 1 AS span,
        CASE WHEN missing_amounts = 0 THEN deposits END AS total_deposits,
        CASE WHEN missing_amounts = 0 THEN non_revenue END AS confirmed_non_revenue,
        CASE WHEN missing_amounts = 0 THEN deposits - non_revenue END AS true_deposits,
        CASE WHEN missing_amounts = 0 THEN unclear END AS ambiguous,
        CASE WHEN start_balance IS NOT NULL AND missing_amounts = 0 AND missing_dates = 0 AND outside = 0 AND days = end_date - start_date + 1 THEN average END AS adb,
        CASE WHEN start_balance IS NOT NULL AND missing_amounts = 0 AND missing_dates = 0 AND outside = 0 AND days = end_date - start_date + 1 THEN negative END AS negative_days,
        CASE WHEN start_balance IS NOT NULL AND missing_amounts = 0 AND missing_dates = 0 AND outside = 0 AND days = end_date - start_date + 1 THEN (abs(total_cents) * 20000000 + days) // (2 * days) END AS adb_units,
        CASE WHEN adb_units IS NOT NULL THEN CASE WHEN total_cents < 0 AND adb_units > 0 THEN '-' ELSE '' END || adb_units // 1000000000
          || rtrim(rtrim('.' || lpad(CAST(adb_units % 1000000000 AS VARCHAR), 9, '0'), '0'), '.') END AS adb_text
      FROM calc c JOIN metric m USING (file_id) LEFT JOIN closed USING (file_id)""",
    "large": """
      SELECT t.file_id, t.counterparty AS lender, t.txn_date, t.amount, t.tid FROM classified t JOIN fin f USING (file_id)
      WHERE t.amount > 0 AND t.partner IS NULL AND t.classification = 'MCA_FUNDING' AND t.confidence = 'CONFIRMED' AND t.counterparty IS NOT NULL
        AND (t.amount >= 10000 OR t.amount >= f.total_deposits * 0.10)""",
    "held": """
      SELECT file_id, coalesce(sum(total_paid) FILTER (WHERE grade = 'CONFIRMED'), 0) AS mca_paid,
        count(*) FILTER (WHERE grade = 'CONFIRMED') AS confirmed_n, count(*) FILTER (WHERE grade = 'CANDIDATE' OR review) AS open_n
      FROM mca GROUP BY file_id""",
    "continuity": """
      SELECT entry_id, count(*) > 1 AND count(*) FILTER (WHERE account_number IS NULL) > 0 AND NOT (
          count(*) FILTER (WHERE account_number IS NOT NULL) = 0 AND count(DISTINCT bank_name || '|' || company) = 1
          AND count(*) FILTER (WHERE before IS NOT NULL AND start_date - before <> 1) = 0) AS uncertain
      FROM (SELECT *, lag(end_date) OVER (PARTITION BY entry_id ORDER BY start_date, end_date, document_index, document_id) AS before FROM canon)
      GROUP BY entry_id""",
    "overlap": """
      SELECT DISTINCT a.entry_id FROM canon a JOIN canon b ON a.entry_id = b.entry_id
        AND (a.document_index, a.document_id) < (b.document_index, b.document_id)
        AND a.start_date <= b.end_date AND b.start_date <= a.end_date
        AND (a.account_number IS NULL OR b.account_number IS NULL
          OR (lower(a.account_number) = lower(b.account_number) AND lower(a.bank_name) = lower(b.bank_name)))""",
    "graded": """
      SELECT f.*, coalesce(mca_paid, 0) AS mca_paid, coalesce(confirmed_n, 0) AS confirmed_n, coalesce(open_n, 0) AS open_n,
        CASE WHEN true_deposits > 0 THEN CAST(round(coalesce(mca_paid, 0) * 100 / true_deposits, 2) AS DECIMAL(18,2)) END AS withheld,
        [x FOR x IN [
          CASE WHEN payload_conflict THEN 'DUPLICATE_PAYLOAD_CONFLICT' END,
          CASE WHEN binding_conflict THEN 'BINDING_CONFLICT' END,
          CASE WHEN 'MISMATCH' IN (credits_status, debits_status, ending_balance_status) THEN 'RECONCILIATION_MISMATCH' END,
          CASE WHEN start_balance IS NULL OR missing_amounts > 0 OR missing_dates > 0
            OR 'CALCULATION_INCOMPLETE' IN (credits_status, debits_status, ending_balance_status)
            OR 'PRINTED_VALUE_MISSING' IN (credits_status, debits_status, ending_balance_status) THEN 'MISSING_CALCULATION_INPUT' END,
          CASE WHEN unclear_n > 0 OR unpaired > 0 OR conflicts > 0 THEN 'AMBIGUOUS_NON_REVENUE' END,
          CASE WHEN open_n > 0 THEN 'MCA_CANDIDATE_UNCONFIRMED' END,
          CASE WHEN days <> span THEN 'CALENDAR_COVERAGE_MISSING' END,
          CASE WHEN u.uncertain THEN 'ACCOUNT_CONTINUITY_UNCERTAIN' END,
          CASE WHEN o.entry_id IS NOT NULL THEN 'OVERLAPPING_STATEMENTS' END,
          CASE WHEN outside > 0 THEN 'TRANSACTION_OUTSIDE_PERIOD' END] IF x IS NOT NULL] AS reasons
      FROM fin f LEFT JOIN held USING (file_id) LEFT JOIN continuity u USING (entry_id) LEFT JOIN overlap o USING (entry_id)""",
    "doc0": """
      SELECT s.entry_id, s.document_id, s.document_index, s.file_id, c.file_id IS NOT NULL AS received,
        coalesce(c.payload_conflict, false) AS payload_conflict,
        coalesce(c.binding_conflict, false) OR coalesce(c.entry_id <> s.entry_id OR c.document_id <> s.document_id OR c.document_index <> s.document_index, false) AS binding_conflict,
        g.* EXCLUDE (entry_id, document_id, document_index, file_id, payload_conflict, binding_conflict)
      FROM cur s LEFT JOIN canon c ON c.file_id = s.file_id
      LEFT JOIN graded g ON g.file_id = s.file_id AND g.entry_id = s.entry_id AND g.document_id = s.document_id""",
    "doc_continuity": """
      SELECT entry_id, count(*) > 1 AND count(*) FILTER (WHERE account_number IS NULL) > 0 AND NOT (
          count(*) FILTER (WHERE account_number IS NOT NULL) = 0
          AND count(DISTINCT coalesce(lower(bank_name), '') || '|' || coalesce(lower(company), '')) = 1
          AND count(*) FILTER (WHERE bank_name IS NULL OR start_date IS NULL) = 0
          AND count(*) FILTER (WHERE before IS NOT NULL AND start_date - before <> 1) = 0) AS uncertain
      FROM (SELECT *, lag(end_date) OVER (PARTITION BY entry_id, account_number IS NULL ORDER BY start_date NULLS FIRST, end_date, document_index, document_id) AS before
            FROM doc0 WHERE received)
      GROUP BY entry_id""",
    "doc_overlap": """
      SELECT DISTINCT a.entry_id FROM doc0 a JOIN doc0 b ON a.entry_id = b.entry_id AND a.received AND b.received
        AND (a.document_index, a.document_id) < (b.document_index, b.document_id)
        AND a.start_date <= b.end_date AND b.start_date <= a.end_date
        AND (a.account_number IS NULL OR b.account_number IS NULL
          OR (lower(a.account_number) = lower(b.account_number) AND lower(a.bank_name) = lower(b.bank_name)))""",
    "doc": """
      SELECT * EXCLUDE (reasons), CASE WHEN NOT received THEN 'PROCESSING' WHEN len(reasons) > 0 THEN 'REVIEW_REQUIRED' ELSE 'READY' END AS quality_status, reasons
      FROM (SELECT d.* EXCLUDE (reasons), [x FOR x IN [
          CASE WHEN payload_conflict OR list_contains(reasons, 'DUPLICATE_PAYLOAD_CONFLICT') THEN 'DUPLICATE_PAYLOAD_CONFLICT' END,
          CASE WHEN binding_conflict OR list_contains(reasons, 'BINDING_CONFLICT') THEN 'BINDING_CONFLICT' END,
          CASE WHEN list_contains(reasons, 'RECONCILIATION_MISMATCH') THEN 'RECONCILIATION_MISMATCH' END,
          CASE WHEN list_contains(reasons, 'MISSING_CALCULATION_INPUT') THEN 'MISSING_CALCULATION_INPUT' END,
          CASE WHEN list_contains(reasons, 'AMBIGUOUS_NON_REVENUE') THEN 'AMBIGUOUS_NON_REVENUE' END,
          CASE WHEN list_contains(reasons, 'MCA_CANDIDATE_UNCONFIRMED') THEN 'MCA_CANDIDATE_UNCONFIRMED' END,
          CASE WHEN list_contains(reasons, 'CALENDAR_COVERAGE_MISSING') THEN 'CALENDAR_COVERAGE_MISSING' END,
          CASE WHEN c.uncertain THEN 'ACCOUNT_CONTINUITY_UNCERTAIN' END,
          CASE WHEN o.entry_id IS NOT NULL THEN 'OVERLAPPING_STATEMENTS' END,
          CASE WHEN list_contains(reasons, 'TRANSACTION_OUTSIDE_PERIOD') THEN 'TRANSACTION_OUTSIDE_PERIOD' END] IF x IS NOT NULL] AS reasons
        FROM doc0 d LEFT JOIN doc_continuity c USING (entry_id) LEFT JOIN doc_overlap o USING (entry_id))""",
    "now_paying": """
      SELECT entry_id, count(DISTINCT pos) AS paying FROM mca
      WHERE grade = 'CONFIRMED' AND status IN ('CURRENT_PAYING', 'CURRENT_WITH_MISSES') GROUP BY entry_id""",
    "sub": """
      SELECT entry_id, count(*) AS expected, count(*) FILTER (WHERE received) AS arrived, arrived = expected AS whole,
        whole AND NOT bool_or(payload_conflict OR binding_conflict) AS usable, bool_or(quality_status = 'REVIEW_REQUIRED') AS review,
        CASE WHEN usable AND count(total_deposits) = count(*) THEN CAST(sum(total_deposits) AS DOUBLE) / count(*) END AS average_deposits,
        CASE WHEN usable AND count(true_deposits) = count(*) THEN CAST(sum(true_deposits) AS DOUBLE) / count(*) END AS average_true,
        CASE WHEN usable AND count(negative_days) = count(*) THEN sum(negative_days) END AS negative_days
      FROM doc GROUP BY entry_id""",
}


def chained(select: str) -> str:
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in CHAIN.items())
    return f"WITH {ctes}\n{select}"
