"""The two pattern profiles as data. The expressions are fixed values that results depend on."""

from __future__ import annotations

from veilframe.config import ENTITY_IDS
from veilframe.config import PatternSpec as P

# An address begins where its run of local characters begins, or where the last match ended.
_LOCAL = "A-Za-z0-9._%+-"
_MAIL_FAST = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}"
_PEM = r"(?:OPENSSH|RSA|EC|DSA) PRIVATE KEY-----"

# Order is the tie-break order of overlap resolution.
CORE = (
    P("email", "EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.90, hint="@", fast=_MAIL_FAST),
    P("phone", "PHONE_NUMBER", r"\+?\d[\d -]{7,}\d", 0.70, hint=r"\d[\d -]{7}"),
    P("bank", "BANK_NUMBER", r"\b\d{12,19}\b", 0.60, hint=r"\d{12}"),
    P("vcode", "VERIFICATION_CODE", r"\b\d{4,8}\b", 0.50, hint=r"\d{4}"),
    P("vcode_labeled", "VERIFICATION_CODE", r"[A-Za-z0-9]{4,12}", 0.80, r"\b(?:verification\s*code|verify\s*code|otp|2fa\s*code|auth(?:entication)?\s*code)\s*[:=\-]?\s*", "i", "(?i)code|otp"),
    P("password", "PASSWORD", r"\S+", 0.40, r"\bpassword\s*[:=]\s*", "i", "(?i)password"),
    P("pwd", "PASSWORD", r"\S+", 0.60, r"\b(?:pwd|pass|passwd|passcode)\s*[:=]\s*", "i", "(?i)pwd|pass"),
    P("seed_phrase", "RANDOM_SEED", r"(?:seed|mnemonic)\s*[:=]?\s*(?:[a-z]+\s+){11,23}[a-z]+", 0.70, "", "i", "(?i)seed|mnemonic"),
    P("pem_key", "PRIVATE_KEY", r"-----BEGIN " + _PEM + r"[\s\S]*?-----END " + _PEM, 0.95, hint="-----BEGIN "),
    P("hex_key", "PRIVATE_KEY", r"\b[0-9a-fA-F]{64}\b", 0.75, hint="[0-9a-fA-F]{64}"),
    P("url", "URL_ADDRESS", r"https?://[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+", 0.80, hint="http"),
)

_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
_STREET = r"(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Boulevard|Blvd\.?|Lane|Ln\.?|Drive|Dr\.?|Way|Suite|Ste\.?|Apt\.?)"

# The rules profile, all matched ignoring case.
RULES = (
    P("rule_email", "EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.85, "", "i", "@", fast=_MAIL_FAST),
    P("rule_cn_phone", "PHONE_NUMBER", r"(?:\+?86[-\s]?)?1[3-9]\d[-\s]?\d{4}[-\s]?\d{4}", 0.86, "", "i", r"1[3-9]\d"),
    P("rule_ipv4", "IP_ADDRESS", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", 0.60, "", "i", r"\d\.\d"),
    P("rule_cn_id", "CN_ID", r"\b[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[0-9Xx]\b", 0.70, "", "i", r"\d{17}"),
    P("rule_url", "URL", r"(?:https?://[^\s)]+|\b(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?:/[\w\-./?%&=+#]*)?)", 0.80, "", "i", r"[A-Za-z0-9-]\.[A-Za-z]|https?:"),
    P("rule_street", "PHYSICAL_ADDRESS", rf"\b\d{{1,5}}\s+[A-Za-z0-9 .,-]{{3,}}\s+{_STREET}\b", 0.65, "", "i", rf"(?i)\s{_STREET}\b"),
    P("rule_user_name", "USER_NAME", r"\b(?:name|username|user name|full name|姓名)\s*[:：]\s*[A-Za-z一-鿿][\w一-鿿 .-]{1,49}", 0.60, "", "i", r"(?i)name\s*[:：]|姓名"),
    P("rule_bank", "BANK_NUMBER", r"\b(?:\d[ -]?){12,19}\b", 0.65, "", "i", r"(?:\d[ -]?){12}"),
    P("rule_payment", "PAYMENT", r"\b(?:\d[ -]?){13,19}\b", 0.60, "", "i", r"(?:\d[ -]?){13}"),
    P("rule_verify_code", "VERIFY_CODE", r"\b(?:code|otp|验证码|one[- ]?time password|verification code)\b\s*[:：]?\s*[A-Za-z0-9]{4,8}\b", 0.75, "", "i", "(?i)code|otp|验证码|password"),
    P("rule_password", "PASSWORD", r"\b(?:password|pwd|pass|密码)\b\s*[:：]?\s*\S{4,}", 0.70, "", "i", "(?i)pass|pwd|密码"),
    P("rule_seed", "RANDOM_SEED", r"\b(?:seed phrase|mnemonic|随机数种子)\b\s*[:：]?\s*(?:[A-Za-z]{3,}(?:\s+|,)){5,}[A-Za-z]{3,}", 0.75, "", "i", "(?i)seed phrase|mnemonic|随机数种子"),
    P("rule_private_key", "PRIVATE_KEY", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----|\b(?:private key|私钥)\b\s*[:：]?\s*[A-Za-z0-9+/=]{40,}", 0.85, "", "i", "(?i)private key|私钥"),
    P("rule_fr_phone", "PHONE_NUMBER", r"(?:\+33|0033|0)\s?[1-9](?:[\s\.-]?\d{2}){4}", 0.75, "", "i", r"\d\d", ("fr",)),
)

# Spans of the optional fall-back pass, with their scores there.
FALLBACK = tuple(
    P(p.name, p.entity_type, p.value, score, "", "", p.hint, fast=p.fast)
    for p, score in ((RULES[0], 0.95), (RULES[1], 0.90), (RULES[2], 0.90), (RULES[3], 0.90))
)

PROFILES = {"core": CORE, "rules": RULES}


def with_extra(profile: tuple, extra=()) -> tuple:
    """A profile and further patterns: those of a type follow its own, a new type takes its place by number
    (unnumbered ones come last), and a pattern that is already there is skipped."""
    known = {(p.label, p.value, p.flags) for p in profile}
    new = [p for p in dict.fromkeys(extra) if (p.label, p.value, p.flags) not in known]
    if not new:
        return tuple(profile)
    own = [p.entity_type for p in profile]
    last = {kind: at for at, kind in enumerate(own)}

    def place(kind: str) -> int:
        if kind in last:
            return last[kind]
        lower = [at for k, at in last.items() if ENTITY_IDS.get(k, 99) < ENTITY_IDS.get(kind, 99)]
        return max(lower, default=-1)

    return tuple(p for *_, p in sorted([(at, 0, 0, p) for at, p in enumerate(profile)] + [(place(p.entity_type), 1, n, p) for n, p in enumerate(new)], key=lambda x: x[:3]))


def by_name(name: str) -> P:
    return next(p for profile in PROFILES.values() for p in profile if p.name == name)
