"""The flagship query: for each turn the phrase that it holds or is a fragment of, the decision, and the event that would be sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decisions as dec
from ..operators import matching as mt
from .base import Registry, Tables
from .rules import HITS

R = Registry()


@R.add(HITS + """, m as (select text, max((confidence, -ord)) as best from hits group by 1),
 c as (select conv_id, turn, 'UDK_' || lpad(cast(-best[2] as varchar), 2, '0') as udk_id, best[1] as confidence from conversations join m using (text))
select conv_id as journey_id, turn, udk_id, confidence, case when confidence >= 0.85 then 'TRIGGER_ALL' else 'TRIGGER_VERIFY' end as decision, substr(sha256(conv_id || ':' || (turn * 1000) || ':' || udk_id), 1, 16) as event_id from c""")
def turn_events(d: Tables) -> DataFrame:
    c = d.conversations
    found = mt.exact_layer(c, "text", mt.derived_phrases(c, "text"))
    best = found.groupBy("text").agg(F.max_by(F.struct("udk_id", "confidence"), F.struct("confidence", -F.col("ord"))).alias("m"))
    e = c.join(best, "text").select(F.col("conv_id").alias("journey_id"), "turn", "m.udk_id", "m.confidence")
    return e.select("*", dec.tier(F.col("confidence")).alias("decision"), dec.event_id(F.col("journey_id"), F.col("turn") * 1000, F.col("udk_id")).alias("event_id"))
