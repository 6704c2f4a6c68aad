"""Text patterns of the extractors and the two profiles that order them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """One text pattern.

    Tests let most texts skip the regex; they hold for every text the pattern
    matches. ``needs`` is a lower-case literal the text must hold, ``sign`` a
    character of it that prose rarely has, shared between patterns. ``hint`` is a
    regex that is cheap to search: it starts with a character class that is rare in
    prose, and needs no word boundary or case folding.
    """

    id: str
    pii_type: str
    regex: str
    group: int = 0
    needs: str = ""
    hint: str = ""

    @property
    def sign(self) -> str:
        return next((c for c in SIGNS if c in self.needs and c != self.needs), "")


HEX_RUN = r"[A-Fa-f0-9]{32}"
SIGNS = "_+="

# The patterns.
_ALL = [
    Pattern("E1", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0, "@"),
    Pattern("E2", "ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", hint=r"[0-9]\.[0-9]{1,3}\.[0-9]"),
    Pattern("E3", "username", r"(?i)User\s*['\"]([A-Za-z][A-Za-z0-9_-]*)['\"]", 1, "user"),
    Pattern("E4", "username", r"(?i)user=([A-Za-z][A-Za-z0-9_-]+)", 1, "user="),
    Pattern("E5", "phone", r"\+1-\d{3}-\d{3}-\d{4}", 0, "+1-"),
    Pattern("E6", "phone", r"\+91-\d{5}-\d{5}", 0, "+91-"),
    Pattern("E7", "phone", r"\+44-20-\d{4}-\d{4}", 0, "+44-20-"),
    Pattern("E8", "phone", r"\+1-555-\d{4}-\d{3}", 0, "+1-555-"),
    Pattern("E9", "phone", r"\+\d{1,3}-\d{3}-\d{3}-\d{4}", 0, "+"),
    Pattern("E10", "blob", r"\bb64=([A-Za-z0-9+/=]{16,})\b", 1, "b64="),
    Pattern("E12", "token", r"(?i)\bsk_(?:live|test)_[a-zA-Z0-9]{24,}\b", 0, "sk_"),
    Pattern("E13", "token", r"(?i)\bghp_[a-zA-Z0-9]{36,}\b", 0, "ghp_"),
    Pattern("E14", "token", r"(?i)\bhf_[a-zA-Z0-9]{34,}\b", 0, "hf_"),
    Pattern("E15", "token", r"(?i)\bAKIA[A-Z0-9]{16}\b", 0, "akia"),
    Pattern("E16", "token", r"(?i)\bASIA[A-Z0-9]{16}\b", 0, "asia"),
    Pattern(
        "E17",
        "token",
        r"(?i)\beyJ[a-zA-Z0-9_-]{30,}\.eyJ[a-zA-Z0-9_-]{30,}\.[a-zA-Z0-9_-]{30,}\b",
        0,
        "eyj",
    ),
    Pattern("E18", "token", r"(?i)\bapi[_-]?key[_-]?[a-zA-Z0-9]{20,}\b", 0, "api"),
    Pattern("E19", "token", r"(?i)xox[pb]-[0-9A-Za-z-]{10,}", 0, "xox"),
    Pattern(
        "E20",
        "token",
        r"(?i)(?:key|token|secret|credential|password|pwd|auth)\s*[:=]\s*[\"']?"
        r"([a-zA-Z0-9._%+-]{12,})[\"']?",
        1,
        "",
        r"[:=]\s*[\"']?[a-zA-Z0-9._%+-]{12}",
    ),
    Pattern("E21", "token", r"(?i)\b[A-Fa-f0-9]{32}\b", hint=HEX_RUN),
    Pattern("E22", "token", r"(?i)\b[A-Fa-f0-9]{40}\b", hint=HEX_RUN),
]
PATTERNS = {p.id: p for p in _ALL}

# Keywords looked for in decoded blobs, excluded addresses, pattern order.
BLOB_SECRET = {
    "demo": r"(?i)(?:token|key|secret|credential)\s*=\s*([^\s\"']{8,})",
    "server": r"(?i)(?:token|key|secret)\s*=\s*([^\s\"']{8,})",
}
EXCLUDED_IPS = {
    "demo": ["255.255.255.255", "0.0.0.0", "127.0.0.1"],
    "server": ["255.255.255.255"],
}
TOKEN_PATTERNS = ["E12", "E13", "E14", "E15", "E16", "E17", "E18", "E19", "E20", "E21", "E22"]
PROFILES = {
    "demo": ["E1", "E2", "E3", "E4", "E5", "E6", "E7", "E8", "E11", *TOKEN_PATTERNS],
    "server": ["E1", "E2", "E3", "E4", "E9", "E11", *TOKEN_PATTERNS],
}
MIN_TOKEN_LENGTH = 6

# Replacement per pattern when masking in pattern order; groups around the value stay. Blobs
# are E11: a blob that holds a secret is replaced as a whole.
MASK_ORDER = PROFILES
MASK_REGEX = {
    "E3": (r"(?i)(User\s*['\"])[A-Za-z][A-Za-z0-9_-]*(['\"])", "$1[USERNAME]$2"),
    "E4": (r"(?i)(user=)[A-Za-z][A-Za-z0-9_-]+", "$1[USERNAME]"),
    "E20": (
        r"(?i)((?:key|token|secret|credential|password|pwd|auth)\s*[:=]\s*[\"']?)"
        r"[a-zA-Z0-9._%+-]{12,}",
        "$1[TOKEN]",
    ),
}
