"""Plan-time configuration: which entity types are masked, and what a pattern is."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

# Entity types with their numeric ids.
ENTITY_IDS = {
    "NONE": 0,
    "PHYSICAL_ADDRESS": 1,
    "EMAIL_ADDRESS": 2,
    "ORGANIZATION": 3,
    "USER_NAME": 4,
    "PHONE_NUMBER": 5,
    "BANK_NUMBER": 6,
    "PAYMENT": 7,
    "VERIFICATION_CODE": 8,
    "PASSWORD": 9,
    "RANDOM_SEED": 10,
    "PRIVATE_KEY": 11,
    "URL_ADDRESS": 12,
}

# Switch names of the mask configuration and the types they stand for.
SWITCHES = {
    "maskAddress": ("PHYSICAL_ADDRESS",),
    "maskEmail": ("EMAIL_ADDRESS",),
    "maskOrganization": ("ORGANIZATION",),
    "maskUserName": ("USER_NAME", "PERSON"),
    "maskPhoneNumber": ("PHONE_NUMBER",),
    "maskBankNumber": ("BANK_NUMBER",),
    "maskPayment": ("PAYMENT",),
    "maskVerificationCode": ("VERIFICATION_CODE", "VERIFY_CODE"),
    "maskPassword": ("PASSWORD",),
    "maskRandomSeed": ("RANDOM_SEED",),
    "maskPrivateKey": ("PRIVATE_KEY",),
    "maskUrl": ("URL_ADDRESS", "URL"),
}
_DEFAULT = frozenset(SWITCHES) - {"maskAddress"}


@dataclass(frozen=True)
class MaskConfig:
    """An immutable set of switches; the default masks everything but addresses.

    ``everything`` is the rules profile's short cut: a boolean ``maskAll`` there
    decides for every type, mapped or not. ``None`` leaves the switches in charge.
    """

    switches: frozenset = _DEFAULT
    everything: bool | None = None

    @classmethod
    def from_dict(cls, given: Mapping[str, object] | None, profile: str = "core") -> MaskConfig:
        """Switches start from the default each time; non-boolean values and unknown keys are ignored; ``maskAll`` comes last."""
        on = set(_DEFAULT)
        for key, value in (given or {}).items():
            if key in SWITCHES and isinstance(value, bool):
                (on.add if value else on.discard)(key)
        flag = (given or {}).get("maskAll")
        if not isinstance(flag, bool):
            return cls(frozenset(on))
        return cls(frozenset(SWITCHES) if flag else frozenset(), flag if profile == "rules" else None)

    @classmethod
    def all(cls) -> MaskConfig:
        return cls(frozenset(SWITCHES))

    @classmethod
    def none(cls) -> MaskConfig:
        return cls(frozenset())

    def enable(self, *names: str) -> MaskConfig:
        return replace(self, switches=self.switches | _known(names))

    def disable(self, *names: str) -> MaskConfig:
        return replace(self, switches=self.switches - _known(names))

    def enabled_types(self) -> list[str]:
        return sorted(t for s in self.switches for t in SWITCHES[s])


def _known(names) -> frozenset:
    """Switch names as they are, or entity types translated to their switch."""
    out = set()
    for name in names:
        hit = [s for s, types in SWITCHES.items() if name == s or name in types]
        if not hit:
            raise ValueError(f"no such switch or entity type: {name}")
        out.update(hit)
    return frozenset(out)


@dataclass(frozen=True)
class PatternSpec:
    """One regular expression. ``label`` precedes the value and is not part of the span.

    ``hint`` is a cheap necessary condition (a regular expression) tried first, so
    that rows without any chance skip the pattern itself. ``fast`` is the value in a form
    with the same matches that a backtracking engine reads in linear time. ``validate`` takes
    the matched value (a column) and gives its score, or null for the score of the pattern.
    """

    name: str
    entity_type: str
    value: str
    score: float
    label: str = ""
    flags: str = ""
    hint: str = ""
    languages: tuple = ()
    fast: str = ""
    validate: Callable | None = None
