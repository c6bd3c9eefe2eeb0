"""Rules, cooldown, alert life cycle, dashboards, notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.operators import alerts, changes, cooldown, rules
from shutterlake.plans.registry import AS_OF, query

_ALL = "events_enriched objects alert_rules alert_history"
# Every (event, rule) pair whose condition holds.
_CAND = """ev AS (SELECT e.device_id, e.timestamp AS triggered_at, e.shot_id, e.image_url, e.detection_count,
    max(o.confidence) AS top, list(lower(o.species)) FILTER (o.species IS NOT NULL) AS classes,
    string_agg(o.species, ', ' ORDER BY o.pos) AS class_list
  FROM events_enriched e LEFT JOIN objects o ON o.device_id = e.device_id AND o.timestamp = e.timestamp GROUP BY ALL),
cand AS (SELECT r.rule_id, r.name, r.cond_type, r.op, r.threshold, r.severity, r.cooldown_s, ev.*
  FROM ev JOIN alert_rules r ON r.enabled AND (r.device_id IS NULL OR r.device_id = ev.device_id)
  WHERE CASE r.cond_type
    WHEN 'detection_count' THEN CASE r.op WHEN '>=' THEN detection_count >= threshold ELSE false END
    WHEN 'confidence' THEN detection_count > 0 AND CASE r.op WHEN '>' THEN top > threshold ELSE false END
    WHEN 'species' THEN detection_count > 0 AND CASE r.op WHEN 'in' THEN list_contains(classes, r.species) ELSE NOT list_contains(classes, r.species) END
    ELSE false END)"""
_FIRED = """fired AS (
  SELECT rule_id, device_id, cooldown_s, min(triggered_at) AS triggered_at FROM cand GROUP BY ALL
  UNION ALL
  SELECT c.rule_id, c.device_id, c.cooldown_s, min(c.triggered_at) FROM fired f JOIN cand c
    ON c.rule_id = f.rule_id AND c.device_id = f.device_id AND c.triggered_at > f.triggered_at + to_seconds(CAST(f.cooldown_s AS DOUBLE))
  GROUP BY c.rule_id, c.device_id, c.cooldown_s, f.triggered_at)"""


@query("j2_event_rule_pairs", """
SELECT r.rule_id, e.device_id, count(*) AS events FROM events_enriched e
JOIN alert_rules r ON r.enabled AND (r.device_id IS NULL OR r.device_id = e.device_id) GROUP BY ALL""", _ALL)
def _(t):
    facts = t.events_enriched.select("device_id")
    pairs = rules.pairs(facts, t.alert_rules.transform(_listed))
    return pairs.groupBy("rule_id", "device_id").agg(F.count("*").alias("events"))


def _listed(rule_rows):
    """The fixture's single species as a list."""
    return rule_rows.withColumn("species", F.when(F.col("species").isNotNull(), F.array("species")))


def _candidates(t):
    return rules.candidates(t.events_enriched, _listed(t.alert_rules))


@query("l1_rule_candidates", f"""
WITH {_CAND} SELECT rule_id, device_id, triggered_at, detection_count, top AS top_confidence FROM cand""", _ALL)
def _(t):
    return _candidates(t).select("rule_id", "device_id", "triggered_at", "detection_count", "top_confidence")


@query("l2_operators", """
SELECT o.shot_id, o.pos, o.device_id, o.timestamp, x.op, CASE x.op WHEN '>' THEN confidence > 0.5 WHEN '<' THEN confidence < 0.5 WHEN '>=' THEN confidence >= 0.5
  WHEN '<=' THEN confidence <= 0.5 WHEN '==' THEN confidence = 0.5 WHEN '!=' THEN confidence <> 0.5 ELSE false END AS holds
FROM objects o CROSS JOIN (SELECT unnest(['>', '<', '>=', '<=', '==', '!=', '~']) AS op) x""", "objects")
def _(t):
    operators = F.array(*[F.lit(op) for op in (">", "<", ">=", "<=", "==", "!=", "~")])
    rows = t.objects.withColumn("op", F.explode(operators))
    return rows.select(
        "shot_id", "pos", "device_id", "timestamp", "op",
        rules.compare(F.col("confidence"), F.col("op"), F.lit(0.5)).alias("holds"),
    )


@query("l3_messages", f"""
WITH {_CAND} SELECT rule_id, device_id, triggered_at, CASE cond_type
  WHEN 'detection_count' THEN concat('Alert: ', CAST(detection_count AS VARCHAR), ' objects detected (threshold: ', op, ' ', regexp_replace(CAST(threshold AS VARCHAR), '\\.0$', ''), ')')
  WHEN 'confidence' THEN concat('Alert: High confidence detection (', printf('%.1f', top * 100), '%, threshold: ', op, ' ', regexp_replace(CAST(threshold AS VARCHAR), '\\.0$', ''), ')')
  ELSE concat('Alert: Species detected: ', class_list) END AS message FROM cand""", _ALL)
def _(t):
    return _candidates(t).select("rule_id", "device_id", "triggered_at", rules.message().alias("message"))


@query("l4_alert_cooldown", f"""
WITH RECURSIVE {_CAND}, {_FIRED} SELECT DISTINCT rule_id, device_id, triggered_at FROM fired""", _ALL)
def _(t):
    # Only what the question needs is carried along.
    due = _candidates(t).select("rule_id", "device_id", "triggered_at", "cooldown_s")
    return cooldown.apply_cooldown(due).select("rule_id", "device_id", "triggered_at")


@query("j3_stored_cooldown", f"""
WITH {_CAND} SELECT rule_id, device_id, triggered_at FROM cand c WHERE NOT EXISTS (
  SELECT 1 FROM alert_history h WHERE h.rule_id = c.rule_id AND h.device_id = c.device_id
    AND h.status IN ('active', 'acknowledged')
    AND h.triggered_at >= c.triggered_at - to_seconds(CAST(c.cooldown_s AS DOUBLE)))""", _ALL)
def _(t):
    return cooldown.not_suppressed(_candidates(t), t.alert_history).select("rule_id", "device_id", "triggered_at")


@query("l5_generated_alerts", f"""
WITH RECURSIVE {_CAND}, {_FIRED}, f AS (SELECT DISTINCT rule_id, device_id, triggered_at FROM fired)
SELECT sha256(concat(f.rule_id, '|', f.device_id, '|', CAST(epoch_us(f.triggered_at) AS VARCHAR))) AS alert_id, f.rule_id,
  c.name AS rule_name, f.device_id, c.severity, f.triggered_at, 'active' AS status, detection_count,
  CAST(f.triggered_at AS DATE) AS processing_date
FROM f JOIN cand c ON c.rule_id = f.rule_id AND c.device_id = f.device_id AND c.triggered_at = f.triggered_at""", _ALL)
def _(t):
    made = rules.as_alerts(cooldown.apply_cooldown(_candidates(t)))
    return made.select(
        "alert_id", "rule_id", "rule_name", "device_id", "severity", "triggered_at", "status",
        F.get_json_object("metadata", "$.detection_count").cast("int").alias("detection_count"), "processing_date",
    )


@query("l6_alert_status", """
SELECT h.alert_id, coalesce(arg_max(c.status, c.changed_at), any_value(h.status)) AS status,
  max(c.changed_at) FILTER (c.status = 'acknowledged') AS acknowledged_at, max(c.changed_at) FILTER (c.status = 'resolved') AS resolved_at,
  arg_max(c.changed_by, c.changed_at) FILTER (c.status = 'resolved') AS resolved_by
FROM (SELECT alert_id, 'active' AS status FROM alert_history) h LEFT JOIN alert_changes c ON c.alert_id = h.alert_id GROUP BY h.alert_id""",
       "alert_history alert_changes")
def _(t):
    opened = t.alert_history.withColumn("status", F.lit("active"))
    return alerts.with_status(opened, t.alert_changes).select(
        "alert_id", "status", "acknowledged_at", "resolved_at", "resolved_by"
    )


@query("l7_rule_changes", """
SELECT 'rule-' || device_id AS rule_id, arg_max(severity, triggered_at) AS severity, true AS enabled,
  CAST(300 AS BIGINT) AS cooldown_s, min(triggered_at) AS created_at, max(triggered_at) AS updated_at
FROM alert_history GROUP BY device_id HAVING arg_max(status, triggered_at) <> 'resolved'""", "alert_history")
def _(t):
    # The first alert of a device creates a rule, later ones change its
    # severity, and a resolved one as the last deletes it.
    first = t.alert_history.groupBy("device_id").agg(F.min("triggered_at").alias("_first"))
    rows = t.alert_history.join(first, "device_id")
    created = rows.filter("triggered_at = _first").withColumn("op", F.lit("create"))
    changed = rows.withColumn("op", F.when(F.col("status") == "resolved", "delete").otherwise("update"))
    none = F.lit(None)
    changes_ = created.withColumn("seq", F.lit(0)).unionByName(changed.withColumn("seq", F.lit(1))).select(
        F.concat(F.lit("rule-"), "device_id").alias("rule_id"), "op", "seq",
        F.col("triggered_at").alias("changed_at"), F.lit("n").alias("name"), none.cast("boolean").alias("enabled"),
        F.lit("detection_count").alias("cond_type"), F.lit(">").alias("op_"), F.lit(1.0).alias("threshold"),
        none.cast("array<string>").alias("species"), none.cast("string").alias("device_id"), "severity",
        none.cast("long").alias("cooldown_s"),
    )
    return rules.current_rules(changes_.withColumnRenamed("op_", "operator")).select(
        "rule_id", "severity", "enabled", "cooldown_s", "created_at", "updated_at"
    )


@query("j8_outbox", """
SELECT h.alert_id, h.rule_id, h.severity, c.channel, c.config FROM alert_history h JOIN channels c USING (rule_id)""", "alert_history channels")
def _(t):
    return alerts.outbox(t.alert_history, t.channels).select("alert_id", "rule_id", "severity", "channel", "config")


@query("l8_in_app_rows", """
SELECT h.alert_id, h.device_id, h.severity, false AS "read", :as_of AS created_at
FROM alert_history h JOIN channels c USING (rule_id) WHERE channel = 'in_app'""", "alert_history channels")
def _(t):
    named = t.alert_history.withColumns({"rule_name": F.lit("n"), "message": F.lit("m")})
    rows = alerts.in_app(alerts.outbox(named, t.channels), AS_OF)
    return rows.select("alert_id", "device_id", "severity", "read", "created_at")


@query("l8_delivery_log", """
SELECT channel AS type, channel, alert_id, 'sent' AS status, :as_of AS created_at FROM alert_history JOIN channels USING (rule_id)""", "alert_history channels")
def _(t):
    return alerts.delivery_log(alerts.outbox(t.alert_history, t.channels), AS_OF)


@query("l9_notification_actions", """
SELECT alert_id, "read" OR severity = 'warning' OR created_at <= TIMESTAMP '2024-01-15' AS "read",
  CASE WHEN NOT "read" THEN CASE WHEN created_at <= TIMESTAMP '2024-01-15'
    THEN CASE WHEN severity = 'warning' THEN least(TIMESTAMP '2024-01-15', created_at + INTERVAL 1 HOUR) ELSE TIMESTAMP '2024-01-15' END
    WHEN severity = 'warning' THEN created_at + INTERVAL 1 HOUR END END AS read_at
FROM in_app_notifications WHERE NOT (severity = 'info' AND "read")""", "in_app_notifications")
def _(t):
    rows = t.in_app_notifications
    # Warnings are read after an hour, read infos are deleted, and once
    # everything up to a day is marked read.
    named = rows.select(
        "alert_id",
        F.when(F.col("severity") == "warning", "read").when(
            (F.col("severity") == "info") & F.col("read"), "delete"
        ).alias("action"),
        (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("acted_at"),
    ).filter("action is not null")
    sweep = rows.agg(F.lit(None).cast("string").alias("alert_id"), F.lit("read_all").alias("action")).withColumn(
        "acted_at", F.lit("2024-01-15 00:00:00").cast("timestamp")
    )
    done = alerts.after_actions(rows, named.unionByName(sweep))
    return done.select("alert_id", "read", "read_at")


@query("a17_alert_statistics", """
SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'acknowledged') AS acknowledged,
  count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (severity = 'info') AS info,
  count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'critical') AS critical FROM alert_history""", "alert_history")
def _(t):
    return alerts.statistics(t.alert_history)


@query("a18_dashboard_overview", """
SELECT 'active' AS metric, count(*) FILTER (status = 'active') AS value FROM alert_history
UNION ALL SELECT 'active_info', count(*) FILTER (status = 'active' AND severity = 'info') FROM alert_history
UNION ALL SELECT 'active_warning', count(*) FILTER (status = 'active' AND severity = 'warning') FROM alert_history
UNION ALL SELECT 'active_critical', count(*) FILTER (status = 'active' AND severity = 'critical') FROM alert_history
UNION ALL SELECT 'enabled_rules', count(*) FILTER (enabled) FROM alert_rules
UNION ALL SELECT 'unread_notifications', count(*) FILTER (NOT "read") FROM in_app_notifications""",
       "alert_history alert_rules in_app_notifications")
def _(t):
    return alerts.overview(t.alert_history, t.alert_rules, t.in_app_notifications)


@query("a19_alert_summary", """
SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'acknowledged') AS acknowledged,
  count(*) FILTER (status = 'resolved') AS resolved, count(*) AS total,
  count(*) FILTER (status = 'active' AND severity = 'info') AS active_info,
  count(*) FILTER (status = 'active' AND severity = 'warning') AS active_warning,
  count(*) FILTER (status = 'active' AND severity = 'critical') AS active_critical FROM alert_history""", "alert_history")
def _(t):
    return alerts.summary(t.alert_history)


@query("a19_busiest_devices", """
SELECT device_id, count(*) AS alert_count FROM alert_history WHERE status = 'active' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""", "alert_history")
def _(t):
    return alerts.busiest_devices(t.alert_history)


@query("a20_dashboard_counts", """
SELECT count(*) FILTER (status = 'active') AS active, count(*) AS total FROM alert_history""", "alert_history")
def _(t):
    return alerts.dashboard_counts(t.alert_history)


@query("a21_unread_count", """
SELECT count(*) AS count FROM in_app_notifications WHERE NOT "read" """, "in_app_notifications")
def _(t):
    return alerts.unread_count(t.in_app_notifications)


@query("t3_alert_page", """
SELECT * FROM alert_history WHERE severity = 'info' ORDER BY triggered_at DESC, alert_id LIMIT 20 OFFSET 20""", "alert_history")
def _(t):
    return alerts.history_page(t.alert_history, 2, severity="info")


@query("t3_alert_totals", """
SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM alert_history WHERE severity = 'info'""", "alert_history")
def _(t):
    return changes.page_totals(changes.where_eq(t.alert_history, severity="info"), 20)


@query("t4_notification_page", """
SELECT alert_id, device_id, severity, created_at FROM in_app_notifications WHERE NOT "read" ORDER BY created_at DESC, alert_id LIMIT 20""", "in_app_notifications")
def _(t):
    return alerts.notifications_page(t.in_app_notifications, read=False).select(
        "alert_id", "device_id", "severity", "created_at"
    )


@query("t3_alert_deep_page", """
SELECT * FROM alert_history ORDER BY triggered_at DESC, alert_id LIMIT 20 OFFSET 300""", "alert_history")
def _(t):
    return alerts.history_page(t.alert_history, 16, deep=100)


@query("t4_notification_totals", """
SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM in_app_notifications WHERE NOT "read" AND severity = 'warning'""", "in_app_notifications")
def _(t):
    return alerts.notifications_totals(t.in_app_notifications, read=False, severity="warning")


@query("t6_recent_alerts", """
SELECT * FROM alert_history WHERE status = 'active' AND severity = 'critical' ORDER BY triggered_at DESC, alert_id LIMIT 10""", "alert_history")
def _(t):
    return alerts.recent_active(t.alert_history, severity="critical")


@query("t9_rule_and_alert_lookup", """
SELECT 'rule' AS kind, rule_id AS id, severity FROM alert_rules WHERE rule_id = 'r2'
UNION ALL SELECT 'alert', alert_id, severity FROM alert_history WHERE rule_id = 'r2' AND status = 'acknowledged'""", "alert_rules alert_history")
def _(t):
    rule = changes.where_eq(t.alert_rules, rule_id="r2").select(F.lit("rule").alias("kind"), F.col("rule_id").alias("id"), "severity")
    found = changes.where_eq(t.alert_history, rule_id="r2", status="acknowledged")
    return rule.unionByName(found.select(F.lit("alert").alias("kind"), F.col("alert_id").alias("id"), "severity"))


@query("t9_alert_lookup", "SELECT * FROM alert_history WHERE alert_id = 'alert-0'", "alert_history")
def _(t):
    return alerts.by_id(t.alert_history, "alert-0")


@query("a18_newest_alerts", """
SELECT * FROM alert_history WHERE status = 'active' ORDER BY triggered_at DESC, alert_id LIMIT 10""", "alert_history")
def _(t):
    return alerts.recent_active(t.alert_history)


@query("p11_optional_filters", """
SELECT alert_id FROM alert_history WHERE status = 'active' AND severity = 'warning' AND rule_id = 'r4'""", "alert_history")
def _(t):
    rows = changes.where_eq(t.alert_history, status="active", severity="warning", rule_id="r4", device_id=None)
    return rows.select("alert_id")
