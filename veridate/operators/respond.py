"""What leaves the engine where no reader ran: rejections, the admission gate's result, and abstentions, as Columns over one row a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridate.functions.dates import let
from veridate.operators import gate

#: Reasons to turn an upload away for good, and those that a better photograph would mend.
TERMINAL = ["EMPTY_FILE", "UNSUPPORTED_TYPE"]
#: Reason code of each rejection of an upload.
REJECTION_CODES = {"UNSUPPORTED_TYPE": "UNSUPPORTED_TYPE", "CORRUPT_FILE": "CORRUPT_FILE", "ENCRYPTED_PDF": "ENCRYPTED_PDF", "RESOLUTION_TOO_LOW": "RESOLUTION_TOO_LOW"}
#: Code of each signal that is a confident negative.
GATE_CODES = [("DOCUMENT_LIKENESS", "NOT_A_DOCUMENT_IMAGE"), ("SCREEN_CAPTURE", "SCREEN_CAPTURE_NOT_DOCUMENT")]
#: Fixed value: dollars that two model calls cost at most, by estimate.
CALLS_USD = 0.08
_SIGNALS = ("DOCUMENT_LIKENESS", "SCREEN_CAPTURE", "POSITIVE_DOMAIN_SIGNAL")


def is_terminal(kind: Column) -> Column:
    return kind.isin(TERMINAL)


def signals(likeness_negative: Column, screen_negative: Column, positive: Column) -> Column:
    """Array of (signal, outcome) in order of cost; none is asked after a confident negative."""
    first = F.struct(F.lit(_SIGNALS[0]).alias("signal"), F.when(likeness_negative, "CONFIDENT_NEGATIVE").otherwise("UNCERTAIN").alias("outcome"))
    second = F.struct(F.lit(_SIGNALS[1]).alias("signal"), F.when(screen_negative, "CONFIDENT_NEGATIVE").otherwise("UNCERTAIN").alias("outcome"))
    third = F.struct(F.lit(_SIGNALS[2]).alias("signal"), F.when(positive, "CONFIDENT_POSITIVE").otherwise("NOT_FOUND").alias("outcome"))
    return F.when(likeness_negative, F.array(first)).when(screen_negative, F.array(first, second)).otherwise(F.array(first, second, third))


def gate_codes(asked: Column) -> Column:
    """Codes of the confident negatives among signals."""
    negative = lambda name: F.exists(asked, lambda s: (s["signal"] == name) & (s["outcome"] == "CONFIDENT_NEGATIVE"))
    return F.array_compact(F.array(*(F.when(negative(name), code) for name, code in GATE_CODES)))


def admission(likeness_negative: Column, screen_negative: Column, positive: Column, call_cost: Column | None = None) -> Column:
    """Struct (decision, signals, codes, spend_avoided_usd): what the gate found, and what was not spent because of it: a rejection saves the calls, a limited admission nothing yet, and a full one has no figure."""
    call_cost = F.lit(CALLS_USD) if call_cost is None else call_cost
    decision = gate.outcome(likeness_negative, screen_negative, positive)
    asked = signals(likeness_negative, screen_negative, positive)
    return let(F.struct(decision.alias("decision"), asked.alias("signals")), lambda a: F.struct(a["decision"].alias("decision"), a["signals"].alias("signals"), gate_codes(a["signals"]).alias("codes"), F.when(a["decision"] == "REJECT", call_cost).when(a["decision"] == "ADMIT_LIMITED", 0.0).alias("spend_avoided_usd")))


def rejected(kind: Column, gate_found: Column) -> Column:
    """Struct (verdict, decision, confidence, codes, delivered) of a document that no reader saw.

    kind: why the upload was turned away, or null; gate_found: codes of the gate where it turned an upload away.
    A terminal rejection and one by the gate are final and deliver nothing; other rejections go to a person.
    """
    code = F
    for name, value in REJECTION_CODES.items():
        code = code.when(kind == name, F.array(F.lit(value)))
    codes = code.otherwise(F.array(F.lit("CLASS_UNRECOGNIZED")))
    out = lambda verdict, decision, confidence, codes, delivered: F.struct(F.lit(verdict).alias("verdict"), F.lit(decision).alias("decision"), F.lit(confidence).alias("confidence"), codes.alias("codes"), F.lit(delivered).alias("delivered"))
    return (
        F.when(is_terminal(kind), out("NOT_APPLICABLE", "REJECTED", 1.0, codes, False))
        .when(kind.isNotNull(), out("INDETERMINATE", "REVIEW", 0.0, codes, True))
        .when(F.size(gate_found) > 0, out("NOT_APPLICABLE", "REJECTED", 0.9, F.array_distinct(F.concat(F.array(F.lit("OUT_OF_DOMAIN")), gate_found)), False))
    )
