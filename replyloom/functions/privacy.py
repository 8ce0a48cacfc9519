"""Masking of personal data as one chain of built-in expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from replyloom import defaults as D

_OPEN, _CLOSE = "\x01", "\x02"
_MARKED = f"{_OPEN}[^{_CLOSE}]*{_CLOSE}"
#: Never occurs, as marks enclose at least one character; a plain text, which is soon searched for.
_NOTHING = (_OPEN + _CLOSE) * 4


@dataclass(frozen=True)
class MaskRules:
    """Patterns and tokens of the masking chain.

    ``flags`` is prepended to each pattern; the default makes word classes Unicode-aware.
    """

    brand: str = D.BRAND
    brand_site: str = D.BRAND_SITE
    short_sites: tuple[str, ...] = D.SHORT_SITES
    brand_url_token: str = D.TOKEN_BRAND_URL
    flight_prefix: str = D.FLIGHT_PREFIX
    url: str = D.URL
    email: str = D.EMAIL
    phone: str = D.PHONE
    card: str = D.CARD
    booking: str = D.BOOKING_CODE
    ticket: str = D.TICKET
    flight: str = D.FLIGHT
    handle: str = D.HANDLE
    flags: str = "(?U)"

    def pattern(self, raw: str, ignore_case: bool = False) -> str:
        return ("(?i)" if ignore_case else "") + self.flags + raw


def _within(marked_part: str) -> str:
    return f"(?i){_OPEN}[^{_CLOSE}]*{marked_part}[^{_CLOSE}]*{_CLOSE}"


def mask_steps(text: Column, rules: MaskRules = MaskRules()) -> tuple[Column, dict[str, Column]]:
    """The masked text, and how many entities of each kind were masked.

    Each kind is counted on the text as it stands when its turn comes: the phone rule runs
    before the card and ticket rules and may take digits from them.
    """
    counts: dict[str, Column] = {}
    # The two control characters mark the spans that are decided in a second step.
    base = out = F.translate(text, _OPEN + _CLOSE, "")

    def needs(mark: str, known: bool):
        """Gives a pattern to the texts that have ``mark``, and to the others one that never matches."""
        if not known:
            return F.lit
        has = F.contains(base, F.lit(mark))
        return lambda pattern: F.when(has, F.lit(pattern)).otherwise(F.lit(_NOTHING))

    # Only the default patterns are known to need their mark, and no token must bring it in.
    tokens = (
        rules.brand_url_token, rules.flight_prefix, D.TOKEN_SHORT_URL, D.TOKEN_OTHER_URL, D.TOKEN_EMAIL, D.TOKEN_PHONE,
        D.TOKEN_CARD, D.TOKEN_BOOKING, D.TOKEN_TICKET,
    )
    no_at = not any("@" in t for t in tokens)
    in_url = needs("://", rules.url == D.URL)
    in_email = needs("@", rules.email == D.EMAIL and no_at)
    in_handle = needs("@", rules.handle == D.HANDLE and no_at)

    url = rules.pattern(rules.url)
    counts["urls"] = F.regexp_count(out, in_url(url))
    out = F.regexp_replace(out, in_url(url), F.lit(f"{_OPEN}$0{_CLOSE}"))
    out = F.regexp_replace(out, in_url(_within(re.escape(rules.brand_site))), F.lit(rules.brand_url_token))
    short = "(?:" + "|".join(re.escape(s) for s in rules.short_sites) + ")"
    out = F.regexp_replace(out, in_url(_within(short)), F.lit(D.TOKEN_SHORT_URL))
    out = F.regexp_replace(out, in_url(_MARKED), F.lit(D.TOKEN_OTHER_URL))

    plain = (
        ("emails", rules.pattern(rules.email), D.TOKEN_EMAIL),
        ("phones", rules.pattern(rules.phone), D.TOKEN_PHONE),
        ("cards", rules.pattern(rules.card), D.TOKEN_CARD),
        ("pnrs", rules.pattern(rules.booking, True), D.TOKEN_BOOKING),
        ("tickets", rules.pattern(rules.ticket), D.TOKEN_TICKET),
        ("flights", rules.pattern(rules.flight, True), f"{rules.flight_prefix}$1>"),
    )
    for kind, pattern, token in plain:
        found = in_email(pattern) if kind == "emails" else F.lit(pattern)
        counts[kind] = F.regexp_count(out, found)
        out = F.regexp_replace(out, found, F.lit(token))

    out = F.regexp_replace(out, in_handle(rules.handle), F.lit(f"{_OPEN}$1{_CLOSE}"))
    out = F.regexp_replace(out, in_handle(f"(?i){_OPEN}{re.escape(rules.brand)}{_CLOSE}"), F.lit(f"@{rules.brand}"))
    counts["handles"] = F.regexp_count(out, in_handle(_MARKED))
    out = F.regexp_replace(out, in_handle(_MARKED), F.lit(D.TOKEN_HANDLE))
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    return out, counts


def scrub(text: Column, rules: MaskRules = MaskRules()) -> Column:
    """Masked text with whitespace collapsed."""
    return mask_steps(text, rules)[0]


def pii_counts(text: Column, rules: MaskRules = MaskRules()) -> Column:
    """Map of masked URLs and customer handles per text; kinds that do not occur are absent."""
    counts = mask_steps(text, rules)[1]
    both = F.create_map(F.lit("urls"), counts["urls"], F.lit("handles"), counts["handles"])
    return F.map_filter(both, lambda _, n: n > 0)
