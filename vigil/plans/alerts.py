"""Alert routing A1-A17: results -> outbox rows (channel, recipient, pipeline,
status, dedup_key, payload). Nothing is sent; the outbox is the product.

Channels are configuration: a short list known on the driver. They are placed in
each row as a literal array and exploded, so the fan-out of an alert to its
channels (and of an SMS to its numbers) is a per-row generator with a fan-out
fixed by the config - no join, no shuffle, and nothing collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.status import CRITICAL, OK, UNKNOWN, is_healthy
from vigil.plans.registry import get_renderer, register_renderer, renderers
from vigil.schema import OUTBOX

APP = "vigil"

# Channels that skip healthy results unless told otherwise.
ONLY_FAILURES_BY_DEFAULT = ("webhook", "sms")

# Payload constants of the built-in channels.
SLACK_ICON = ":warning:"
SLACK_OK_EMOJI = ":white_check_mark:"
SLACK_FAIL_EMOJI = ":red_circle:"
PAGERDUTY_SEVERITY = "error"
OPSGENIE_PRIORITY = "P3"
OPSGENIE_RESOLVED_PRIORITY = "P5"
VICTOROPS_TYPES = {OK: "RECOVERY", CRITICAL: "CRITICAL", UNKNOWN: "WARNING"}
VICTOROPS_DEFAULT = "WARNING"
TEAMS_OK_COLOR = "00C853"
TEAMS_FAIL_COLOR = "D50000"
TEAMS_CONTEXT = "https://schema.org/extensions"
DISCORD_COLORS = {OK: 0x2ECC71, CRITICAL: 0xE74C3C, UNKNOWN: 0x95A5A6}
DISCORD_DEFAULT_COLOR = 0x95A5A6
SENTRY_ENVIRONMENT = "production"
LOG_PREFIX = "ALERT"


def _lit_map(d: Mapping) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def alert_text(pipeline: Column, status: Column, message: Column) -> Column:
    """A5: ``Pipeline: p`` / ``Status:   S`` / ``Details:  m`` (details only when
    the message is not empty)."""
    details = F.when(F.coalesce(message, F.lit("")) != F.lit(""), F.concat(F.lit("Details:  "), message))
    return F.concat_ws("\n", F.concat(F.lit("Pipeline: "), pipeline), F.concat(F.lit("Status:   "), F.upper(status)), details)


def _param(ctx: dict, name: str, default=None) -> Column:
    v = F.element_at(ctx["params"], F.lit(name))
    return v if default is None else F.coalesce(v, F.lit(default))


def _nonempty(c: Column, fallback: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != F.lit(""), c).otherwise(F.lit(fallback))


def _incident(ctx: dict, mark: str) -> Column:
    """What an incident is known by: results are per pipeline and check."""
    return F.concat(F.lit(f"{APP}{mark}"), ctx["pipeline"], F.lit(mark), F.coalesce(ctx["check"], F.lit("")))


def render_slack(ctx: dict) -> Column:
    emoji = F.when(ctx["healthy"], F.lit(SLACK_OK_EMOJI)).otherwise(F.lit(SLACK_FAIL_EMOJI))
    return F.to_json(F.struct(
        _param(ctx, "username", APP).alias("username"),
        _param(ctx, "icon_emoji", SLACK_ICON).alias("icon_emoji"),
        F.concat(emoji, F.lit(" "), ctx["text"]).alias("text"),
    ))


def render_email(ctx: dict) -> Column:
    return F.to_json(F.struct(
        F.concat(F.lit(f"[{APP}] Pipeline alert: "), ctx["pipeline"]).alias("subject"),
        _param(ctx, "sender").alias("from"),
        F.array_join(ctx["recipients"], ", ").alias("to"),
        ctx["text"].alias("body"),
    ))


def render_pagerduty(ctx: dict) -> Column:
    return F.to_json(F.struct(
        _param(ctx, "integration_key").alias("routing_key"),
        F.lit("trigger").alias("event_action"),
        F.struct(
            ctx["text"].alias("summary"),
            _param(ctx, "source", APP).alias("source"),
            _param(ctx, "severity", PAGERDUTY_SEVERITY).alias("severity"),
            F.struct(ctx["pipeline"].alias("pipeline"), ctx["status"].alias("status"),
                     F.coalesce(ctx["message"], F.lit("")).alias("message")).alias("custom_details"),
        ).alias("payload"),
    ))


def render_webhook(ctx: dict) -> Column:
    return F.to_json(F.struct(ctx["pipeline"].alias("pipeline"), ctx["status"].alias("status"),
                              ctx["healthy"].alias("healthy"), ctx["text"].alias("message")))


def render_opsgenie(ctx: dict) -> Column:
    failing = ctx["status"] == F.lit(CRITICAL)
    tags = F.filter(F.split(_param(ctx, "tags", ""), ","), lambda x: x != F.lit(""))
    return F.to_json(F.struct(
        ctx["text"].alias("message"),
        _incident(ctx, "-").alias("alias"),
        F.concat(F.lit("Pipeline '"), ctx["pipeline"], F.lit("' is in state: "), ctx["status"],
                 F.lit(". Details: "), _nonempty(ctx["message"], "N/A")).alias("description"),
        F.when(failing, _param(ctx, "priority", OPSGENIE_PRIORITY)).otherwise(F.lit(OPSGENIE_RESOLVED_PRIORITY)).alias("priority"),
        tags.alias("tags"),
        F.lit(APP).alias("source"),
        F.when(~failing, F.lit("close")).alias("action"),
    ))


def render_victorops(ctx: dict) -> Column:
    kind = F.coalesce(F.element_at(_lit_map(VICTOROPS_TYPES), ctx["status"]), F.lit(VICTOROPS_DEFAULT))
    return F.to_json(F.struct(
        kind.alias("message_type"),
        _incident(ctx, ".").alias("entity_id"),
        F.concat(F.lit("Pipeline: "), ctx["pipeline"]).alias("entity_display_name"),
        ctx["text"].alias("state_message"),
        F.lit(APP).alias("monitoring_tool"),
    ))


def render_teams(ctx: dict) -> Column:
    label = F.upper(ctx["status"])
    facts = F.array(
        F.struct(F.lit("Pipeline").alias("name"), ctx["pipeline"].alias("value")),
        F.struct(F.lit("Status").alias("name"), label.alias("value")),
        F.struct(F.lit("Message").alias("name"), _nonempty(ctx["message"], "No details provided.").alias("value")),
    )
    section = F.struct(
        F.concat(F.lit("Pipeline **"), ctx["pipeline"], F.lit("** is **"), label, F.lit("**")).alias("activityTitle"),
        facts.alias("facts"), F.lit(True).alias("markdown"))
    return F.to_json(F.struct(
        F.lit("MessageCard").alias("@type"),
        F.lit(TEAMS_CONTEXT).alias("@context"),
        F.when(ctx["status"] == F.lit(OK), F.lit(TEAMS_OK_COLOR)).otherwise(F.lit(TEAMS_FAIL_COLOR)).alias("themeColor"),
        F.concat(F.lit(f"{APP.capitalize()} alert: "), ctx["pipeline"]).alias("summary"),
        F.array(section).alias("sections"),
    ))


def render_discord(ctx: dict) -> Column:
    color = F.coalesce(F.element_at(_lit_map(DISCORD_COLORS), ctx["status"]), F.lit(DISCORD_DEFAULT_COLOR))
    embed = F.struct(
        F.concat(F.lit("Pipeline: "), ctx["pipeline"]).alias("title"),
        ctx["text"].alias("description"),
        color.alias("color"),
        F.array(F.struct(F.lit("Status").alias("name"), ctx["status"].alias("value"), F.lit(True).alias("inline"))).alias("fields"),
    )
    return F.to_json(F.struct(_param(ctx, "username", APP).alias("username"), F.array(embed).alias("embeds")))


def render_sms(ctx: dict) -> Column:
    return F.to_json(F.struct(ctx["text"].alias("body"), _param(ctx, "from_number").alias("from"),
                              ctx["recipient"].alias("to")))


def render_sentry(ctx: dict) -> Column:
    return F.to_json(F.struct(
        ctx["text"].alias("message"),
        F.when(ctx["healthy"], F.lit("info")).otherwise(F.lit("error")).alias("level"),
        _param(ctx, "environment", SENTRY_ENVIRONMENT).alias("environment"),
        F.struct(ctx["pipeline"].alias("pipeline"), ctx["status"].alias("status")).alias("tags"),
    ))


def log_text(pipeline: Column, status: Column, message: Column, prefix: Column) -> Column:
    """The log line: prefix, then the older three-line alert form."""
    details = F.when(F.coalesce(message, F.lit("")) != F.lit(""), F.concat(F.lit("Details: "), message))
    body = F.concat_ws(
        "\n",
        F.concat(F.lit(f"[{APP}] Pipeline '"), pipeline, F.lit("' is "), status),
        F.concat(F.lit("Pipeline check completed with status: "), F.upper(status)),
        details,
    )
    return F.concat(F.lit("["), prefix, F.lit("] "), body)


def render_log(ctx: dict) -> Column:
    return F.to_json(F.struct(
        log_text(ctx["pipeline"], ctx["status"], ctx["message"], _param(ctx, "prefix", LOG_PREFIX)).alias("line")))


for _name, _fn in [("slack", render_slack), ("email", render_email), ("pagerduty", render_pagerduty),
                   ("webhook", render_webhook), ("opsgenie", render_opsgenie), ("victorops", render_victorops),
                   ("teams", render_teams), ("discord", render_discord), ("sms", render_sms),
                   ("sentry", render_sentry), ("log", render_log)]:
    register_renderer(_name, _fn)


def channels_literal(channels: Iterable[Mapping]) -> Column:
    """The channel config list as an array<struct> literal (the config is small and
    known on the driver)."""
    items = []
    for i, ch in enumerate(channels):
        kind = ch["type"]
        get_renderer(kind)
        only = ch.get("only_failures")
        if only is None:
            only = kind in ONLY_FAILURES_BY_DEFAULT
        params = {str(k): None if v is None else (",".join(v) if isinstance(v, (list, tuple)) else str(v))
                  for k, v in (ch.get("params") or {}).items()}
        recipients = [str(r) for r in ch.get("recipients") or []]
        items.append(F.struct(
            F.lit(i).alias("idx"),
            F.lit(kind).alias("type"),
            F.lit(ch.get("name") or kind).alias("name"),
            F.lit(bool(only)).alias("only_failures"),
            F.array(*[F.lit(r) for r in recipients]).cast("array<string>").alias("recipients"),
            (_lit_map(params) if params else F.create_map()).cast("map<string,string>").alias("params"),
        ))
    if not items:
        raise ValueError("no channels configured")
    return F.array(*items)


def route_alerts(results: DataFrame, channels: Iterable[Mapping], alert_on_healthy: bool = False) -> DataFrame:
    """A1-A4, A6 and the payloads A7-A17: one outbox row per send."""
    channels = list(channels)
    if not channels:
        return results.sparkSession.createDataFrame([], OUTBOX)
    healthy = is_healthy(F.col("status"))
    r = results.withColumn("_healthy", healthy)
    r = r.where(F.coalesce(F.col("alert_on_failure"), F.lit(True)))                    # A2
    if not alert_on_healthy:
        r = r.where(~F.col("_healthy"))                                                # A1
    lit_channels = channels_literal(channels)
    fan = r.select("*", F.explode(F.filter(lit_channels, lambda c: ~(c["only_failures"] & F.col("_healthy")))).alias("ch"))  # A3, A4
    per_recipient = F.when(F.col("ch.type") == F.lit("sms"), F.col("ch.recipients")) \
        .when(F.col("ch.type") == F.lit("email"), F.array(F.array_join(F.col("ch.recipients"), ", "))) \
        .otherwise(F.array(F.lit(None).cast("string")))
    sends = fan.select("*", F.explode(per_recipient).alias("recipient"))              # A6
    ctx = {
        "pipeline": F.col("pipeline"), "status": F.col("status"), "message": F.col("message"),
        "healthy": F.col("_healthy"), "params": F.col("ch.params"), "recipients": F.col("ch.recipients"),
        "recipient": F.col("recipient"), "check": F.col("check"), "value": F.col("value"),
    }
    ctx["text"] = alert_text(ctx["pipeline"], ctx["status"], ctx["message"])
    payload = F.lit(None).cast("string")
    kinds = {ch["type"] for ch in channels}
    for kind, fn in renderers().items():
        if kind in kinds:
            payload = F.when(F.col("ch.type") == F.lit(kind), fn(ctx)).otherwise(payload)
    return sends.select(
        F.col("ch.name").alias("channel"),
        F.col("recipient"),
        F.col("pipeline"),
        F.col("status"),
        _incident(ctx, "-").alias("dedup_key"),
        payload.alias("payload"),
    )
