"""Notifications as rows: one per alert and channel, ready to send."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.scalars import iso_time, lookup


def route_notifications(
    alerts: DataFrame, sns: bool = True, slack: bool = True, sender: str = "Incident Desk"
) -> DataFrame:
    """Channel, subject and payload per alert; the log channel is always on. The mail lists the fields below, one a
    line; the chat card holds the same fields as a map."""
    severity = F.col("severity")
    emoji = lookup(severity, params.SEVERITY_EMOJI, params.DEFAULT_EMOJI)
    color = lookup(severity, params.SEVERITY_COLOR, params.DEFAULT_COLOR)
    title = F.concat(emoji, F.lit(" "), F.col("title"))
    fields = {
        "what": F.col("metric_type"),
        "where": F.concat_ws(" / ", "service", "host"),
        "level": severity,
        "state": F.col("status"),
        "since": iso_time(F.col("timestamp")),
        "id": F.col("alert_id"),
    }
    listed = [F.concat(F.lit(f"{name} = "), F.coalesce(value, F.lit("?"))) for name, value in fields.items()]
    mail = F.concat_ws("\n", F.col("description"), *listed, F.lit(f"({sender})"))
    card = F.struct(color.alias("accent"), title.alias("headline"), F.col("description").alias("body"), F.struct(*(v.alias(k) for k, v in fields.items())).alias("fields"))
    chat = F.to_json(F.struct(F.lit(sender).alias("from"), card.alias("card")))
    audit = F.concat_ws(" | ", severity, "host", "metric_type", "title")

    def channel(name, subject, payload):
        return F.struct(F.lit(name).alias("channel"), subject.alias("subject"), payload.alias("payload"))

    none = F.lit(None).cast("string")
    channels = []
    if sns:
        channels.append(channel("sns", F.substring(title, 1, params.SUBJECT_LENGTH), mail))
    if slack:
        channels.append(channel("slack", none, chat))
    channels.append(channel("log", none, audit))
    return alerts.select("alert_id", "severity", "host", F.inline(F.array(*channels)))
