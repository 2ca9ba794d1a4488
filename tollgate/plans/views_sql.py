"""The canonical views as SQL, for checking results on another engine."""

# Every oracle starts with these views; unused ones cost nothing.
BASE = """WITH txn_b AS (
  SELECT event_id AS txn_id, ts, user_id, value AS amount,
         CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS BIGINT) + 1 AS step,
         CASE event_type WHEN 'signup' THEN 'CASH_IN' WHEN 'click' THEN 'CASH_OUT' WHEN 'error' THEN 'DEBIT'
                         WHEN 'view' THEN 'PAYMENT' WHEN 'purchase' THEN 'TRANSFER' END AS type,
         CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events),
txn_c AS (
  SELECT *,
    CASE WHEN txn_id%11=0 THEN amount WHEN txn_id%5=0 THEN CAST(0 AS DOUBLE) ELSE CAST(k*10 AS DOUBLE) END AS oldbalanceOrg,
    CASE WHEN txn_id%3=0 THEN CAST(0 AS DOUBLE) ELSE CAST((txn_id*13)%997 AS DOUBLE) END AS oldbalanceDest,
    CASE WHEN type IN ('TRANSFER','CASH_OUT') AND (txn_id%11=0 OR txn_id%97=0) THEN 1 ELSE 0 END AS isFraud,
    CASE WHEN type='TRANSFER' AND amount>200 THEN 1 ELSE 0 END AS isFlaggedFraud,
    CAST((txn_id*7919)%10007 AS DOUBLE)/CAST(10007 AS DOUBLE) AS r
  FROM txn_b),
txn AS (
  SELECT *, greatest(oldbalanceOrg-amount, CAST(0 AS DOUBLE)) AS newbalanceOrig,
         oldbalanceDest+amount AS newbalanceDest,
         CASE WHEN isFraud=1 THEN CAST(0.5 AS DOUBLE)+CAST(0.5 AS DOUBLE)*r ELSE r*r END AS fraud_score
  FROM txn_c),
predictions AS (
  SELECT txn_id AS prediction_id, txn_id - txn_id%3 AS request_id, CAST(txn_id%3 AS INT) AS item_index, step,
         type AS transaction_type, amount, oldbalanceOrg AS oldbalance_origin, oldbalanceDest AS oldbalance_destination,
         fraud_score, CASE WHEN fraud_score>=CAST(0.98310834 AS DOUBLE) THEN 1 ELSE 0 END AS prediction,
         CASE WHEN fraud_score>=CAST(0.98310834 AS DOUBLE) THEN 'high' WHEN fraud_score>=CAST(0.5 AS DOUBLE) THEN 'medium' ELSE 'low' END AS risk_level,
         ts AS created_at
  FROM txn),
outcomes AS (
  SELECT txn_id AS prediction_id, isFraud AS actual_fraud, ts + to_hours(CAST(txn_id%48 AS INTEGER)) AS observed_at, 'review' AS source
  FROM txn WHERE txn_id%4<>0),
requests AS (
  SELECT request_id, min(created_at) AS created_at, count(*) AS batch_size,
         CASE WHEN count(*)=1 THEN '/predict' ELSE '/predict/batch' END AS endpoint
  FROM predictions GROUP BY request_id),
attempts AS (
  SELECT txn_id AS request_id, 1 AS attempt, amount FROM txn
  UNION ALL SELECT txn_id, 2, amount FROM txn WHERE txn_id%10=0
  UNION ALL SELECT txn_id, 3, amount+1 FROM txn WHERE txn_id%25=0),
submissions AS (
  SELECT CAST(txn_id//50 AS BIGINT) AS batch_id, txn_id*4 AS "position",
         CASE WHEN txn_id%997=0 THEN -txn_id-1 ELSE txn_id END AS prediction_id,
         CASE WHEN txn_id%1009=0 THEN 1-isFraud ELSE isFraud END AS actual_fraud,
         'desk' || CAST(txn_id%3 AS VARCHAR) AS source FROM txn
  UNION ALL
  SELECT CAST(txn_id//50 AS BIGINT), txn_id*4+1, txn_id,
         CASE WHEN txn_id%1013=0 THEN 1-isFraud ELSE isFraud END,
         'desk' || CAST(txn_id%3 AS VARCHAR) FROM txn WHERE txn_id%7=0
  UNION ALL
  SELECT CAST((txn_id+50)//50 AS BIGINT), (txn_id+50)*4+2, txn_id,
         CASE WHEN txn_id%143=0 THEN 1-isFraud ELSE isFraud END,
         'desk' || CAST(txn_id%3 AS VARCHAR) FROM txn WHERE txn_id%11=0),
stored AS (SELECT txn_id AS prediction_id, isFraud AS actual_fraud FROM txn WHERE txn_id%9=0),
log AS (
  SELECT txn_id, ts, 'POST' AS method, concat('/', type) AS route, amount/100 AS duration_seconds,
         CASE WHEN type='DEBIT' AND txn_id%2=0 THEN 503 ELSE 200 END AS status
  FROM txn),
landing AS (
  SELECT txn_id, CAST(step AS VARCHAR) AS step,
         CASE WHEN txn_id%113=0 THEN 'WIRE' WHEN txn_id%127=0 THEN NULL ELSE type END AS type,
         CASE WHEN txn_id%101=0 THEN 'n/a' WHEN txn_id%103=0 THEN NULL WHEN txn_id%107=0 THEN '-5.0' ELSE CAST(amount AS VARCHAR) END AS amount,
         'C' || CAST(user_id AS VARCHAR) AS nameOrig,
         CASE WHEN txn_id%131=0 THEN 'unknown' ELSE CAST(oldbalanceOrg AS VARCHAR) END AS oldbalanceOrg,
         CAST(newbalanceOrig AS VARCHAR) AS newbalanceOrig, 'M' || CAST(txn_id%1000 AS VARCHAR) AS nameDest,
         CAST(oldbalanceDest AS VARCHAR) AS oldbalanceDest, CAST(newbalanceDest AS VARCHAR) AS newbalanceDest,
         CASE WHEN txn_id%109=0 THEN '2' ELSE CAST(isFraud AS VARCHAR) END AS isFraud,
         CASE WHEN txn_id%139=0 THEN '9' ELSE CAST(isFlaggedFraud AS VARCHAR) END AS isFlaggedFraud
  FROM txn),
hist AS (SELECT step, count(*) AS c, sum(isFraud) AS f FROM txn GROUP BY step),
cum AS (SELECT step, c, f, sum(c) OVER (ORDER BY step) AS cc, row_number() OVER (ORDER BY step) AS rn,
               count(*) OVER () AS ns, sum(c) OVER () AS tot FROM hist),
tbound AS (SELECT step AS tb FROM cum WHERE rn <= ns-2 ORDER BY abs(cc - tot*CAST(0.70 AS DOUBLE)), step LIMIT 1),
vbound AS (SELECT step AS vb FROM cum, tbound WHERE rn > 1 AND rn < ns AND step > tb
           ORDER BY abs(cc - tot*CAST(0.85 AS DOUBLE)), step LIMIT 1),
splits AS (SELECT txn.*, CASE WHEN step <= tb THEN 'train' WHEN step <= vb THEN 'validation' ELSE 'test' END AS split
           FROM txn, tbound, vbound),
train AS (SELECT * FROM splits WHERE split = 'train'),
ibound AS (
  SELECT step AS ib FROM (
    SELECT step, sum(count(*)) OVER (ORDER BY step) AS cc, row_number() OVER (ORDER BY step) AS rn,
           count(*) OVER () AS ns, sum(count(*)) OVER () AS tot FROM train GROUP BY step)
  WHERE rn < ns ORDER BY abs(cc - tot*CAST(0.80 AS DOUBLE)), step LIMIT 1),
periods AS (
  SELECT s.*, 'train' AS period FROM splits s WHERE split = 'train'
  UNION ALL SELECT s.*, 'inner_tuning' FROM splits s, ibound WHERE split = 'train' AND step > ib
  UNION ALL SELECT s.*, 'official_validation' FROM splits s WHERE split = 'validation'),
scored AS (SELECT txn_id AS id, isFraud AS label, amount, fraud_score AS score FROM txn),
curve AS (
  SELECT score, n, pos, money,
         sum(n) OVER (ORDER BY score DESC) AS n_upto, sum(pos) OVER (ORDER BY score DESC) AS pos_upto,
         sum(money) OVER (ORDER BY score DESC) AS money_upto,
         sum(n) OVER () AS n_total, sum(pos) OVER () AS pos_total, sum(money) OVER () AS money_total
  FROM (SELECT score, count(*) AS n, sum(label) AS pos, sum(CASE WHEN label=1 THEN amount ELSE 0 END) AS money
        FROM scored GROUP BY score)),
pr AS (SELECT *, pos_upto/CAST(n_upto AS DOUBLE) AS p, pos_upto/CAST(pos_total AS DOUBLE) AS q FROM curve),
candidates AS (
  SELECT 'prior_probability' AS candidate, id, label, amount, (SELECT avg(CAST(isFraud AS DOUBLE)) FROM train) AS score FROM scored
  UNION ALL SELECT 'unweighted_logistic', id, label, amount, score FROM scored
  UNION ALL SELECT 'weighted_logistic', id, label, amount, CASE WHEN id%7=0 THEN score*CAST(0.5 AS DOUBLE) ELSE score END FROM scored),
ccurve AS (
  SELECT candidate, score, n, pos, money,
         sum(n) OVER w AS n_upto, sum(pos) OVER w AS pos_upto, sum(money) OVER w AS money_upto,
         sum(n) OVER t AS n_total, sum(pos) OVER t AS pos_total, sum(money) OVER t AS money_total
  FROM (SELECT candidate, score, count(*) AS n, sum(label) AS pos, sum(CASE WHEN label=1 THEN amount ELSE 0 END) AS money
        FROM candidates GROUP BY candidate, score)
  WINDOW w AS (PARTITION BY candidate ORDER BY score DESC), t AS (PARTITION BY candidate)),
cpr AS (SELECT *, pos_upto/CAST(n_upto AS DOUBLE) AS p, pos_upto/CAST(pos_total AS DOUBLE) AS q FROM ccurve),
cbest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY CASE WHEN 4*p+q > 0 THEN (5*p*q)/(4*p+q) ELSE 0 END DESC, score) AS rk
    FROM cpr) WHERE rk = 1),
cranked AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, id) AS rk, count(*) OVER (PARTITION BY candidate) AS n_all FROM candidates),
ctop AS (
  SELECT candidate,
    sum(CASE WHEN rk <= ceil(n_all*CAST(0.1 AS DOUBLE)/100) THEN label ELSE 0 END)/CAST(sum(label) AS DOUBLE) AS top_0_1_recall,
    sum(CASE WHEN rk <= ceil(n_all*CAST(0.1 AS DOUBLE)/100) THEN label*amount ELSE 0 END)/sum(label*amount) AS top_0_1_fraud_amount_recall,
    sum(CASE WHEN rk <= ceil(n_all*CAST(0.5 AS DOUBLE)/100) THEN label ELSE 0 END)/CAST(sum(label) AS DOUBLE) AS top_0_5_recall,
    sum(CASE WHEN rk <= ceil(n_all*CAST(0.5 AS DOUBLE)/100) THEN label*amount ELSE 0 END)/sum(label*amount) AS top_0_5_fraud_amount_recall,
    sum(CASE WHEN rk <= ceil(n_all*CAST(1.0 AS DOUBLE)/100) THEN label ELSE 0 END)/CAST(sum(label) AS DOUBLE) AS top_1_0_recall,
    sum(CASE WHEN rk <= ceil(n_all*CAST(1.0 AS DOUBLE)/100) THEN label*amount ELSE 0 END)/sum(label*amount) AS top_1_0_fraud_amount_recall
  FROM cranked GROUP BY candidate),
cbundle AS (
  SELECT c.candidate,
         sum((c.pos/CAST(c.pos_total AS DOUBLE))*c.p) AS average_precision,
         sum((c.n-c.pos)*((c.pos_upto-c.pos)+c.pos/CAST(2 AS DOUBLE)))/(max(c.pos_total)*CAST(max(c.n_total-c.pos_total) AS DOUBLE)) AS roc_auc,
         any_value(b.score) AS selected_threshold, any_value(b.pos_upto) AS tp, any_value(b.n_upto-b.pos_upto) AS fp,
         any_value(b.pos_total) AS pos_total, any_value(b.n_total) AS n_total,
         any_value(b.money_upto) AS captured, any_value(b.money_total) AS money_total,
         any_value(b.p) AS selected_precision, any_value(b.q) AS selected_recall
  FROM cpr c JOIN cbest b ON c.candidate = b.candidate GROUP BY c.candidate),
cfull AS (
  SELECT x.*, t.* EXCLUDE (candidate),
    CASE WHEN selected_precision+selected_recall > 0 THEN 2*selected_precision*selected_recall/(selected_precision+selected_recall) ELSE 0 END AS selected_f1,
    CASE WHEN 4*selected_precision+selected_recall > 0 THEN 5*selected_precision*selected_recall/(4*selected_precision+selected_recall) ELSE 0 END AS selected_f_beta,
    (tp+fp)/CAST(n_total AS DOUBLE) AS selected_alert_rate, fp/CAST(n_total-pos_total AS DOUBLE) AS selected_false_positive_rate,
    captured/money_total AS selected_fraud_amount_recall
  FROM cbundle x JOIN ctop t ON x.candidate = t.candidate)"""
