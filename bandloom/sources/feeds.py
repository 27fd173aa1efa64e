"""Parsers of the three feeds; all work on batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands

e = F.expr

PAYLOAD = "t long, rp int, b string, md string, sc string, rc string, sl string, rl string, f double"

# The modes of the skimmer feed's lines; the last two may have a number behind them.
RBN_MODES = ("AM", "CONTESTIA", "CW", "DIGI", "FM", "FSK441", "FST4", "FT4", "FT8", "HELL", "JS8", "JT4", "JT65", "JT9", "MSK144", "OLIVIA", "Q65", "RTTY", "SSB", "WSPR", "MFSK", "PSK")


def read_pskr(messages: DataFrame) -> DataFrame:
    """Spots from (topic, payload, arrival): JSON, with fields that it lacks taken from parts 3 to 8 of the topic.

    unknown in the topic stands for nothing, and a dot in a call for a slash. FT8 and FT4 stay; a time of 0 is the
    arrival's; rows that aren't JSON go.
    """
    m = messages.withColumn("j", F.from_json("payload", PAYLOAD)).withColumn("p", F.split("topic", "/")).where("j is not null and payload like '%{%'")

    def field(name: str, part: int, call: bool = False):
        topic = e(f"case when size(p) >= 9 and p[{part}] <> 'unknown' then p[{part}] end")
        return F.trim(F.coalesce(e(f"nullif(j.{name}, '')"), F.replace(topic, F.lit("."), F.lit("/")) if call else topic, F.lit("")))

    out = m.select(
        e("coalesce(nullif(j.t, 0), arrival)").alias("t"), "arrival", F.upper(field("sl", 7)).alias("sl"), F.upper(field("rl", 8)).alias("rl"), F.upper(field("sc", 5, True)).alias("sc"), F.upper(field("rc", 6, True)).alias("rc"),
        field("b", 3).alias("band"), F.coalesce("j.rp", F.lit(0)).alias("snr"), F.lit("mqtt").alias("source"), F.upper(field("md", 4)).alias("mode"), e("nullif(j.f, 0)").alias("freq_khz"), F.lit(0).alias("txpower"),
    )
    return out.where("mode in ('FT8', 'FT4')")


def read_rbn(lines: DataFrame) -> DataFrame:
    """Spots from (line, observed_at): the skimmer is the reporting station; other lines go. Locators come from enrich_rbn().

    A line's words are DX, de, the skimmer, kHz, the call, the mode and a number of dB. A colon ends the skimmer, with or
    without white space on either side; dB may stand right behind the number.
    """
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.upper("line"), ":", " : "), "(?<=[0-9])DB\\b", " DB")), r"\s+")
    # A generator of one row splits a line once. Spark may test a line's other words before its number of words: get() is null where there are fewer.
    w = lines.select("observed_at", F.inline(F.array(F.struct(words.alias("w"))))).where("get(w, 0) = 'DX' and get(w, 1) = 'DE' and get(w, 3) = ':' and get(w, 8) = 'DB'")
    out = w.select("observed_at", *[F.get("w", F.lit(k)).alias(name) for k, name in ((2, "sc"), (4, "khz"), (5, "rc"), (6, "mode"), (7, "db"))])
    plain = lambda c, extra: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + extra, "") == ""
    numbered = F.regexp_replace("mode", "[0-9]+$", "")
    out = out.where(plain("sc", "-/#") & plain("rc", "-/") & (F.col("mode").isin(*RBN_MODES) | numbered.isin(*RBN_MODES[-2:])) & F.col("khz").rlike("^[0-9]") & F.col("db").rlike("^[0-9]+$"))
    out = out.select("observed_at", "sc", F.col("khz").try_cast("double").alias("freq_khz"), "rc", "mode", F.col("db").try_cast("int").alias("snr")).where("freq_khz > 0 and snr is not null")
    empty = F.lit(None).cast("string")
    return out.select(F.col("observed_at").alias("t"), F.col("observed_at").alias("arrival"), empty.alias("sl"), empty.alias("rl"), "sc", "rc", e(bands.band_from_khz("freq_khz")).alias("band"), "snr", F.lit("rbn").alias("source"), "mode", "freq_khz", F.lit(0).alias("txpower"))


def read_wspr(rows: DataFrame) -> DataFrame:
    """Spots from beacon rows (time, band, rx_sign, rx_loc, tx_sign, tx_loc, frequency in Hz, power, snr, arrival).

    Unknown band codes and rows without a call go; a time that can't be read is the arrival's.
    """
    up = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    t = e("coalesce(nullif(greatest(unix_timestamp(try_to_timestamp(trim(time), 'yyyy-MM-dd HH:mm:ss')), 0), 0), arrival)")
    out = rows.select(t.alias("t"), "arrival", up("rx_loc").alias("sl"), up("tx_loc").alias("rl"), up("rx_sign").alias("sc"), up("tx_sign").alias("rc"), e(bands.band_from_wspr_code("band")).alias("band"), "snr", F.lit("wspr").alias("source"), F.lit("WSPR").alias("mode"), (F.col("frequency") / 1000.0).alias("freq_khz"), F.col("power").alias("txpower"))
    return out.where("band <> '' and sc <> '' and rc <> ''")


def dedup_wspr(spots: DataFrame, ttl: str = "600 seconds") -> DataFrame:
    """Overlapping polls bring a report again: the same time, band, stations and frequency (to the Hz) count once.

    On a stream the state of a report is kept for ``ttl`` of event time.
    """
    keyed = spots.withColumn("hz", e("cast(floor(freq_khz * 1000 + 0.5) as bigint)"))
    key = ["t", "band", "sc", "rc", "hz"]
    if not spots.isStreaming:
        return keyed.dropDuplicates(key).drop("hz")
    return keyed.withColumn("event_time", F.timestamp_seconds("t")).withWatermark("event_time", ttl).dropDuplicatesWithinWatermark(key).drop("hz", "event_time")
