"""Alert routing queries A1-A17 and U2, over the static-status results of the
nations (ok, warning, critical, unknown, and one empty message)."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.q_probes import STATIC_SQL, static_results
from suite.registry import query
from vigil.plans.alerts import alert_text, route_alerts
from vigil.plans.registry import register_renderer

TEXT_SQL = ("('Pipeline: ' || pipeline || chr(10) || 'Status:   ' || upper(status) || "
            "CASE WHEN message <> '' THEN chr(10) || 'Details:  ' || message ELSE '' END)")


def base_sql(alert_on_healthy: bool) -> str:
    cond = "alert_on_failure" if alert_on_healthy else "alert_on_failure AND status <> 'ok'"
    return f"WITH a AS (SELECT *, {TEXT_SQL} AS text FROM ({STATIC_SQL}) WHERE {cond})"


def outbox(spark, sf, channels, alert_on_healthy=False):
    return route_alerts(static_results(spark, sf), channels, alert_on_healthy=alert_on_healthy)


def j(path: str):
    return F.get_json_object("payload", path)


# ---------------------------------------------------------------- A1 should_alert
@query("a01_should_alert", sql=base_sql(False) + " SELECT 'log' AS channel, pipeline, status, 'vigil-' || pipeline || '-static_status' AS dedup_key FROM a")
def a01_should_alert(spark, sf):
    return outbox(spark, sf, [{"type": "log"}]).select("channel", "pipeline", "status", "dedup_key")


# ---------------------------------------------------------------- A2 suppress (alert_on_failure = false)
@query("a02_suppress", sql=base_sql(True) + " SELECT pipeline, status FROM a")
def a02_suppress(spark, sf):
    return outbox(spark, sf, [{"type": "log"}], alert_on_healthy=True).select("pipeline", "status")


# ---------------------------------------------------------------- A3 fan_out
@query("a03_fan_out", sql=base_sql(False) + """
SELECT c.channel, count(*) AS n FROM a, (VALUES ('log'), ('slack'), ('teams'), ('pagerduty')) AS c(channel) GROUP BY 1
""")
def a03_fan_out(spark, sf):
    ob = outbox(spark, sf, [{"type": "log"}, {"type": "slack"}, {"type": "teams"}, {"type": "pagerduty"}])
    return ob.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- A4 only_failures per channel
@query("a04_only_failures", sql=base_sql(True) + """
SELECT 'webhook' AS channel, pipeline, status FROM a WHERE status <> 'ok'
UNION ALL SELECT 'webhook-all', pipeline, status FROM a
UNION ALL SELECT 'slack', pipeline, status FROM a
""")
def a04_only_failures(spark, sf):
    ob = outbox(spark, sf, [{"type": "webhook"}, {"type": "webhook", "name": "webhook-all", "only_failures": False},
                            {"type": "slack"}], alert_on_healthy=True)
    return ob.select("channel", "pipeline", "status")


# ---------------------------------------------------------------- A5 message text
@query("a05_message_text", sql=f"SELECT pipeline, {TEXT_SQL} AS text FROM ({STATIC_SQL})")
def a05_message_text(spark, sf):
    r = static_results(spark, sf)
    return r.select("pipeline", alert_text(F.col("pipeline"), F.col("status"), F.col("message")).alias("text"))


# ---------------------------------------------------------------- A6 recipients
@query("a06_recipients", sql=base_sql(False) + """
SELECT 'sms' AS channel, n.recipient, pipeline FROM a, (VALUES ('+15559990000'), ('+15558880000')) AS n(recipient)
UNION ALL SELECT 'email', 'ops@example.com, data@example.com', pipeline FROM a
""")
def a06_recipients(spark, sf):
    ob = outbox(spark, sf, [{"type": "sms", "recipients": ["+15559990000", "+15558880000"]},
                            {"type": "email", "recipients": ["ops@example.com", "data@example.com"]}])
    return ob.select("channel", "recipient", "pipeline")


# ---------------------------------------------------------------- A7 slack
@query("a07_slack", sql=base_sql(True) + """
SELECT pipeline, 'vigil' AS username, ':warning:' AS icon_emoji,
       CASE WHEN status = 'ok' THEN ':white_check_mark:' ELSE ':red_circle:' END || ' ' || text AS text FROM a
""")
def a07_slack(spark, sf):
    ob = outbox(spark, sf, [{"type": "slack"}], alert_on_healthy=True)
    return ob.select("pipeline", j("$.username").alias("username"), j("$.icon_emoji").alias("icon_emoji"),
                     j("$.text").alias("text"))


# ---------------------------------------------------------------- A8 email
@query("a08_email", sql=base_sql(False) + """
SELECT pipeline, '[vigil] Pipeline alert: ' || pipeline AS subject, 'alerts@example.com' AS sender,
       'ops@example.com, data@example.com' AS "to", text AS body FROM a
""")
def a08_email(spark, sf):
    ob = outbox(spark, sf, [{"type": "email", "recipients": ["ops@example.com", "data@example.com"],
                             "params": {"sender": "alerts@example.com"}}])
    return ob.select("pipeline", j("$.subject").alias("subject"), j("$.from").alias("sender"), j("$.to").alias("to"),
                     j("$.body").alias("body"))


# ---------------------------------------------------------------- A9 pagerduty
@query("a09_pagerduty", sql=base_sql(False) + """
SELECT pipeline, 'KEY123' AS routing_key, 'trigger' AS event_action, text AS summary, 'vigil' AS source,
       'error' AS severity, pipeline AS cd_pipeline, status AS cd_status, message AS cd_message FROM a
""")
def a09_pagerduty(spark, sf):
    ob = outbox(spark, sf, [{"type": "pagerduty", "params": {"integration_key": "KEY123"}}])
    return ob.select("pipeline", j("$.routing_key").alias("routing_key"), j("$.event_action").alias("event_action"),
                     j("$.payload.summary").alias("summary"), j("$.payload.source").alias("source"),
                     j("$.payload.severity").alias("severity"), j("$.payload.custom_details.pipeline").alias("cd_pipeline"),
                     j("$.payload.custom_details.status").alias("cd_status"),
                     j("$.payload.custom_details.message").alias("cd_message"))


# ---------------------------------------------------------------- A10 webhook
@query("a10_webhook", sql=base_sql(False) + """
SELECT pipeline, pipeline AS p, status, status = 'ok' AS healthy, text AS message FROM a
""")
def a10_webhook(spark, sf):
    ob = outbox(spark, sf, [{"type": "webhook", "params": {"url": "https://hooks.example.com/x"}}])
    return ob.select("pipeline", j("$.pipeline").alias("p"), j("$.status").alias("status"),
                     j("$.healthy").cast("boolean").alias("healthy"), j("$.message").alias("message"))


# ---------------------------------------------------------------- A11 opsgenie
@query("a11_opsgenie", sql=base_sql(True) + """
SELECT pipeline, text AS message, 'vigil-' || pipeline || '-static_status' AS alias,
       'Pipeline ''' || pipeline || ''' is in state: ' || status || '. Details: ' || CASE WHEN message <> '' THEN message ELSE 'N/A' END AS description,
       CASE WHEN status = 'critical' THEN 'P2' ELSE 'P5' END AS priority, '["etl","prod"]' AS tags, 'vigil' AS source,
       CASE WHEN status <> 'critical' THEN 'close' END AS action FROM a
""")
def a11_opsgenie(spark, sf):
    ob = outbox(spark, sf, [{"type": "opsgenie", "params": {"priority": "P2", "tags": ["etl", "prod"]}}], alert_on_healthy=True)
    return ob.select("pipeline", j("$.message").alias("message"), j("$.alias").alias("alias"),
                     j("$.description").alias("description"), j("$.priority").alias("priority"),
                     j("$.tags").alias("tags"), j("$.source").alias("source"), j("$.action").alias("action"))


# ---------------------------------------------------------------- A12 victorops
@query("a12_victorops", sql=base_sql(True) + """
SELECT pipeline, CASE status WHEN 'ok' THEN 'RECOVERY' WHEN 'critical' THEN 'CRITICAL' ELSE 'WARNING' END AS message_type,
       'vigil.' || pipeline || '.static_status' AS entity_id, 'Pipeline: ' || pipeline AS entity_display_name, text AS state_message,
       'vigil' AS monitoring_tool FROM a
""")
def a12_victorops(spark, sf):
    ob = outbox(spark, sf, [{"type": "victorops"}], alert_on_healthy=True)
    return ob.select("pipeline", j("$.message_type").alias("message_type"), j("$.entity_id").alias("entity_id"),
                     j("$.entity_display_name").alias("entity_display_name"), j("$.state_message").alias("state_message"),
                     j("$.monitoring_tool").alias("monitoring_tool"))


# ---------------------------------------------------------------- A13 teams
@query("a13_teams", sql=base_sql(True) + """
SELECT pipeline, 'MessageCard' AS card_type, CASE WHEN status = 'ok' THEN '00C853' ELSE 'D50000' END AS theme_color,
       'Vigil alert: ' || pipeline AS summary, 'Pipeline **' || pipeline || '** is **' || upper(status) || '**' AS title,
       upper(status) AS fact_status, CASE WHEN message <> '' THEN message ELSE 'No details provided.' END AS fact_message,
       3 AS n_facts FROM a
""")
def a13_teams(spark, sf):
    ob = outbox(spark, sf, [{"type": "teams"}], alert_on_healthy=True)
    return ob.select("pipeline", j("$['@type']").alias("card_type"), j("$.themeColor").alias("theme_color"),
                     j("$.summary").alias("summary"), j("$.sections[0].activityTitle").alias("title"),
                     j("$.sections[0].facts[1].value").alias("fact_status"),
                     j("$.sections[0].facts[2].value").alias("fact_message"),
                     F.json_array_length(j("$.sections[0].facts")).alias("n_facts"))


# ---------------------------------------------------------------- A14 discord
@query("a14_discord", sql=base_sql(True) + """
SELECT pipeline, 'vigil' AS username, 'Pipeline: ' || pipeline AS title, text AS description,
       CASE status WHEN 'ok' THEN 3066993 WHEN 'critical' THEN 15158332 ELSE 9807270 END AS color,
       status AS field_value, TRUE AS inline FROM a
""")
def a14_discord(spark, sf):
    ob = outbox(spark, sf, [{"type": "discord"}], alert_on_healthy=True)
    return ob.select("pipeline", j("$.username").alias("username"), j("$.embeds[0].title").alias("title"),
                     j("$.embeds[0].description").alias("description"), j("$.embeds[0].color").cast("int").alias("color"),
                     j("$.embeds[0].fields[0].value").alias("field_value"),
                     j("$.embeds[0].fields[0].inline").cast("boolean").alias("inline"))


# ---------------------------------------------------------------- A15 sms
@query("a15_sms", sql=base_sql(False) + """
SELECT pipeline, n.recipient, text AS body, n.recipient AS "to", '+15550000000' AS sender
FROM a, (VALUES ('+15559990000'), ('+15558880000')) AS n(recipient)
""")
def a15_sms(spark, sf):
    ob = outbox(spark, sf, [{"type": "sms", "recipients": ["+15559990000", "+15558880000"],
                             "params": {"from_number": "+15550000000"}}], alert_on_healthy=True)
    return ob.select("pipeline", "recipient", j("$.body").alias("body"), j("$.to").alias("to"), j("$.from").alias("sender"))


# ---------------------------------------------------------------- A16 sentry
@query("a16_sentry", sql=base_sql(True) + """
SELECT pipeline, text AS message, CASE WHEN status = 'ok' THEN 'info' ELSE 'error' END AS level,
       'staging' AS environment, pipeline AS tag_pipeline, status AS tag_status FROM a
""")
def a16_sentry(spark, sf):
    ob = outbox(spark, sf, [{"type": "sentry", "params": {"environment": "staging"}}], alert_on_healthy=True)
    return ob.select("pipeline", j("$.message").alias("message"), j("$.level").alias("level"),
                     j("$.environment").alias("environment"), j("$.tags.pipeline").alias("tag_pipeline"),
                     j("$.tags.status").alias("tag_status"))


# ---------------------------------------------------------------- A17 log
@query("a17_log", sql=base_sql(False) + """
SELECT pipeline, '[ALERT] [vigil] Pipeline ''' || pipeline || ''' is ' || status || chr(10)
       || 'Pipeline check completed with status: ' || upper(status)
       || CASE WHEN message <> '' THEN chr(10) || 'Details: ' || message ELSE '' END AS line FROM a
""")
def a17_log(spark, sf):
    ob = outbox(spark, sf, [{"type": "log"}])
    return ob.select("pipeline", j("$.line").alias("line"))


# ---------------------------------------------------------------- U2 custom renderer
def chatops_renderer(ctx):
    return F.to_json(F.struct(F.coalesce(F.element_at(ctx["params"], F.lit("room")), F.lit("#ops")).alias("room"),
                              F.concat(F.upper(ctx["status"]), F.lit(": "), ctx["pipeline"]).alias("text")))


register_renderer("chatops", chatops_renderer)


@query("u02_custom_renderer", sql=base_sql(False) + """
SELECT 'chatops' AS channel, pipeline, '#data' AS room, upper(status) || ': ' || pipeline AS text FROM a
""")
def u02_custom_renderer(spark, sf):
    ob = outbox(spark, sf, [{"type": "chatops", "params": {"room": "#data"}}])
    return ob.select("channel", "pipeline", j("$.room").alias("room"), j("$.text").alias("text"))
