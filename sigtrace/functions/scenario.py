"""What a free text says about a case: scope, request, expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# How facts are written.
FRAME_RANGE = r"\bframes?\s+([0-9]+)\s*(?:-|to|through)\s*([0-9]+)\b"
FRAME = r"\bframe\s*[=#]?\s*(?:no\.\s*)?([0-9]+)\b"
PDU_SESSION = r"\bpdu[- ]session(?:\s+id)?\s*(?:=|is|#)?\s*([0-9]+)"
DNN = r"\bdnn\s*(?:=|is|:)?\s*([a-z0-9_.-]+)"
SLICE = r"\bs-?nssai\s*(?:=|is|:)?\s*([a-z0-9_.:-]+)"
# Words and what they say; of one fact the first that is there counts.
PROCEDURES = {"registration": "INITIAL_REGISTRATION", "pdu session": "PDU_SESSION_ESTABLISHMENT", "pdu-session": "PDU_SESSION_ESTABLISHMENT"}
OUTCOMES = {"fail": "failure", "succeed": "success", "success": "success", "work": "success"}
ACCESS = {"non-3gpp": "non_3gpp", "non 3gpp": "non_3gpp", "3gpp": "3gpp"}
INITIATORS = {"network initiated": "NETWORK", "network-initiated": "NETWORK", "ue initiated": "UE", "ue-initiated": "UE"}
FACTS = ["procedure", "pdu_session", "frame_from", "dnn", "s_nssai", "expected_outcome", "access_type", "initiator", "pdu_type", "emergency", "failure_stage", "forbidden"]


def _first_of(t: Column, words: dict[str, str]) -> Column:
    return reduce(lambda c, kv: c.when(F.contains(t, F.lit(kv[0])), kv[1]), words.items(), F.when(F.lit(False), F.lit(None).cast("string")))


def facts(text: Column) -> Column:
    """A struct of the facts that a text names, null where it names none, how many there are, and the confidence of it all.

    Case and the number of blanks do not count; of a fact that is named several
    times the first counts, of frames a range before a single one. Three facts
    give high confidence, one or two medium, none low. Null texts give null.
    """
    t = F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))
    got = lambda rx, g=1: F.nullif(F.regexp_extract(t, rx, g), F.lit(""))
    has = lambda w: F.contains(t, F.lit(w))
    single = got(FRAME).try_cast("bigint")
    found = {
        "procedure": _first_of(t, PROCEDURES),
        "pdu_session": got(PDU_SESSION).try_cast("bigint"),
        "frame_from": F.coalesce(got(FRAME_RANGE).try_cast("bigint"), single),
        "frame_to": F.coalesce(got(FRAME_RANGE, 2).try_cast("bigint"), single),
        "dnn": got(DNN),
        "s_nssai": got(SLICE),
        "expected_outcome": _first_of(t, OUTCOMES),
        "access_type": _first_of(t, ACCESS),
        "initiator": _first_of(t, INITIATORS),
        "pdu_type": F.when(has("pdu") & has("ipv4"), "ipv4"),
        "emergency": F.when(has("emergency"), True),
        "failure_stage": F.when(has("smf"), "smf"),
        "forbidden": F.when(has("no registration reject") | has("without registration reject"), "REGISTRATION_REJECT"),
    }
    n = reduce(lambda a, b: a + b, [found[f].isNotNull().cast("int") for f in FACTS])
    return F.when(text.isNotNull(), F.struct(*[c.alias(k) for k, c in found.items()], n.alias("n_facts"), F.when(n >= 3, "high").when(n >= 1, "medium").otherwise("low").alias("confidence")))
