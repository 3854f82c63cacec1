"""Detection rules as data: a rule is a name, a pattern and a mask."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Patterns, mask tokens and score weights that results depend on.
# ---------------------------------------------------------------------------
CARD_PATTERN = r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"
CARD16_PATTERN = r"\b\d{16}\b"
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
BOUNDED_EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
US_PHONE_PATTERN = r"\(\d{3}\) \d{3}-\d{4}"

HASH_NUMBER_PATTERN = r"#\d{4,}"
MILLION_PATTERN = r"\b\d{1,2}\.\d+ million\b"
COUNTED_PATTERN = r"\b\d{3,4} (tickets|records)\b"
PRODUCT_PATTERN = r"PRD-\d+"
FOUR_DIGIT_PATTERN = r"(?<!-)\b\d{4}\b"

CHAT_LINE_PATTERN = r"^\[\d{2}:\d{2}:\d{2}\]\s+\w+:"

CARD_MASK = "[REDACTED_CC]"
SSN_MASK = "[REDACTED_SSN]"
EMAIL_MASK = "[REDACTED_EMAIL]"
PHONE_MASK = "[REDACTED_PHONE]"
GENERIC_MASK = "[REDACTED]"

PROTECTED_COLUMNS = ("id", "first_name", "last_name", "address")
# ---------------------------------------------------------------------------

# The e-mail pattern retries at every character of every word, which makes it several
# times as slow as the others.  Two forms do the same work faster.  The first enters a
# run of local-part characters only at its start or right after the previous match, and
# finds the same texts, because ``@`` cannot be part of the run.  The second looks at each
# ``@`` and finds as many: one local-part character before it is enough, unless that
# character belongs to the previous match.
_EMAIL_RUNS = r"(?:(?<![a-zA-Z0-9._%+-])|\G)[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_EMAIL_SIGNS = r"@(?<=[a-zA-Z0-9._%+-]@)(?<!\G@)[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


@dataclass(frozen=True)
class Rule:
    """One kind of personal data.

    Three optional hints make a rule cheaper without changing its result: ``scan`` is a
    pattern with the same matches, ``tally`` one with the same number of matches, and
    ``needs`` a text without which there is no match.  ``unicode`` makes digits, spaces
    and word boundaries follow Unicode rather than ASCII.
    """

    name: str
    pattern: str
    mask: str = GENERIC_MASK
    scan: str | None = None
    tally: str | None = None
    needs: str | None = None
    unicode: bool = False

    def _flagged(self, pattern: str) -> str:
        return ("(?U)" if self.unicode else "") + pattern

    @property
    def regex(self) -> str:
        return self._flagged(self.scan or self.pattern)

    @property
    def counting_regex(self) -> str:
        return self._flagged(self.tally or self.scan or self.pattern)


@dataclass(frozen=True)
class Probe:
    """How to find, in any text, every substring that can equal a token of a rule.

    These are the matches of ``pattern``; with ``shortest`` also all their prefixes of at
    least that length, with ``width`` instead all their stretches of exactly that length.
    """

    pattern: str
    shortest: int | None = None
    width: int | None = None


@dataclass(frozen=True)
class TokenRule:
    """A number in context that masking must leave alone; ``group`` is the part that counts."""

    name: str
    pattern: str
    group: int
    probes: tuple[Probe, ...]
    needs: str | None = None

    def __post_init__(self) -> None:
        if not self.probes:  # without them every such token would count as lost
            raise ValueError(f"token rule {self.name!r} needs probes, the forms in which its tokens can occur in a text")


@dataclass(frozen=True)
class RuleSet:
    """Rules in the order in which they are applied."""

    rules: tuple[Rule, ...]

    def __iter__(self) -> Iterator[Rule]:
        return iter(self.rules)

    def masked_as(self, mask: str) -> RuleSet:
        return RuleSet(tuple(replace(r, mask=mask) for r in self.rules))

    def with_unicode(self) -> RuleSet:
        return RuleSet(tuple(replace(r, unicode=True) for r in self.rules))

    def plus(self, *rules: Rule) -> RuleSet:
        return RuleSet(self.rules + rules)


CARD = Rule("credit_card", CARD_PATTERN, CARD_MASK)
CARD16 = Rule("card16", CARD16_PATTERN, CARD_MASK)
SSN = Rule("ssn", SSN_PATTERN, SSN_MASK)
EMAIL = Rule("email", EMAIL_PATTERN, EMAIL_MASK, scan=_EMAIL_RUNS, tally=_EMAIL_SIGNS, needs="@")
PHONE = Rule("phone", PHONE_PATTERN, PHONE_MASK)

# Masking order matters: a phone rule run first would eat the tail of a card.
CORE = RuleSet((CARD, SSN, EMAIL, PHONE))
CARD_TABLE = RuleSet((CARD, CARD16))
SSN_ONLY = RuleSet((SSN,))
CARD_ONLY = RuleSet((CARD,))
GENERIC = CORE.masked_as(GENERIC_MASK)
VARIANT = RuleSet(
    (
        Rule("credit_card", CARD_PATTERN),
        Rule("ssn", SSN_PATTERN),
        Rule("email", BOUNDED_EMAIL_PATTERN, needs="@"),
        Rule("phone", US_PHONE_PATTERN),
    )
)

TOKENS = (
    TokenRule("hash_number", HASH_NUMBER_PATTERN, 0, (Probe(r"#\d{4,}", shortest=5),), needs="#"),
    TokenRule(
        "million", MILLION_PATTERN, 0, (Probe(r"\d\d\.\d+ million"), Probe(r"\d\.\d+ million")), needs=" million"
    ),
    TokenRule("counted", COUNTED_PATTERN, 1, (Probe(r"tickets"), Probe(r"records"))),
    TokenRule("product", PRODUCT_PATTERN, 0, (Probe(r"PRD-\d+", shortest=5),), needs="PRD-"),
    TokenRule("four_digit", FOUR_DIGIT_PATTERN, 0, (Probe(r"\d{4,}", width=4),)),
)
