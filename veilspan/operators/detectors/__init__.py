"""Registry of detectors. A detector is a function (text column, context) -> ARRAY<finding>."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.lists import Context
from veilspan.operators.detectors import identity, links, names, network, secrets
from veilspan.schema import FINDINGS

FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("detector", pa.string()),
                            ("priority", pa.int32()), ("meta", pa.map_(pa.string(), pa.string()))]))


@dataclass(frozen=True)
class Detector:
    id: str
    types: tuple
    priority: int
    expr: Callable[[Column, Context], Column]
    default: bool = True
    guarded: bool = False  # may throw: that is a warning for the text then, and the other detectors go on


# The order decides between findings of equal priority, length and start.
BUILTIN = (
    Detector("pem", ("PRIVATE_KEY", "CERTIFICATE"), 95, secrets.pem),
    Detector("tokens", ("SECRET",), 92, secrets.tokens),
    Detector("gitleaks", ("SECRET",), 91, secrets.providers),
    Detector("split-strings", ("SECRET",), 93, secrets.split_strings),
    Detector("kv-secrets", ("SECRET", "USERNAME"), 88, secrets.kv_secrets),
    Detector("hex-strings", ("SECRET",), 66, secrets.hex_strings),
    Detector("random-tokens", ("SECRET",), 63, secrets.random_tokens),
    Detector("entropy", ("SECRET",), 20, secrets.entropy, default=False),
    Detector("email", ("EMAIL",), 80, network.email),
    Detector("ipv4", ("IPV4",), 60, network.ipv4),
    Detector("ipv6", ("IPV6",), 61, network.ipv6),
    Detector("mac", ("MAC",), 62, network.mac),
    Detector("domain", ("DOMAIN",), 50, network.domain),
    Detector("hostname", ("HOSTNAME", "USERNAME"), 45, network.hostname),
    Detector("userpath", ("USERNAME", "HOSTNAME"), 56, identity.userpath),
    Detector("iban", ("IBAN",), 72, identity.iban),
    Detector("creditcard", ("CREDIT_CARD",), 70, identity.card),
    Detector("phone", ("PHONE",), 40, identity.phone),
    Detector("sid", ("SID",), 70, identity.sid),
    Detector("company", ("ORG",), 58, names.company),
    Detector("custom", ("CUSTOM",), 75, identity.custom),
    Detector("infra-names", ("IDENTIFIER",), 35, names.infra, default=False),
    Detector("fingerprints", ("FINGERPRINT",), 70, names.fingerprints, default=False),
    Detector("tracking", ("TRACKING",), 85, links.tracking),
    Detector("learned-names", ("PERSON",), 32, names.learned),
)
_registry: dict[str, Detector] = {d.id: d for d in BUILTIN}


def register(detector: Detector) -> None:
    """Add a detector or replace the one with the same id."""
    _registry[detector.id] = detector


def python_detector(detector_id: str, types: tuple, priority: int, find: Callable[[str], list], default: bool = True) -> Detector:
    """A guarded detector from a Python function text -> [(start, end, type)], which runs on Arrow batches.
    An exception, or a finding outside the text, is a failure for that text."""
    def expr(text: Column, _ctx: Context) -> Column:
        def of_batch(texts: pa.Array) -> pa.Array:
            return pa.array([_found(find, t, detector_id, priority) for t in texts.to_pylist()], FOUND)

        return F.arrow_udf(of_batch, FINDINGS)(text)

    return Detector(detector_id, types, priority, expr, default, guarded=True)


def _found(find: Callable[[str], list], text: str | None, detector_id: str, priority: int) -> list[dict] | None:
    try:
        rows = [] if text is None else sorted(find(text))
        if any(not 0 <= start < end <= len(text) for start, end, _ in rows):
            return None
        return [{"start": s, "end": e, "type": t, "text": text[s:e], "detector": detector_id, "priority": priority, "meta": []} for s, e, t in rows]
    except Exception:  # what a user's function raises is not known beforehand
        return None


def unregister(detector_id: str) -> None:
    original = {d.id: d for d in BUILTIN}.get(detector_id)
    if original is None:
        _registry.pop(detector_id, None)
    else:
        _registry[detector_id] = original


def selected(enabled=None, skip=()) -> list[Detector]:
    """The detectors of a run; only their expressions get into the plan."""
    wanted = {d.id for d in _registry.values() if d.default} if enabled is None else set(enabled)
    return [d for d in _registry.values() if d.id in wanted and d.id not in set(skip)]
