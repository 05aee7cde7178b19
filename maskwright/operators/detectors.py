"""Entity detectors as column expressions, and the set that combines them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import fixed_values as fixed
from ..functions.entropy import may_reach, shannon_entropy, window_entropy
from ..functions.text import MARK, SPACE, WIDE_SPACES, as_column, has_any, java_pattern, java_quote, let, trim_all
from .spans import (
    claim_in_order,
    find_spans,
    greedy_cover,
    longest_cover,
    no_spans,
    resolve_overlaps,
    scan,
)

DEFAULT_TYPES = tuple(fixed.ENTITY_PRIORITY)
_BUILT: dict = {}
# Cards, SIRET, NIR and French and US numbers have ten digits or more, no two of them more than two signs
# apart (a NIR of Corsica holds a letter). SSN and a bare SIREN are cut after three digits.
_LONG_NUMBER = r"[0-9](?:[\s.\-_()ABab]{0,2}[0-9]){9}"
_UK_NUMBER = r"0[127](?:[\s.\-]?[0-9]){7}"
_BEFORE_LETTER = r"[0-9][\s.-]?[A-Da-d](?!\w)"
_DOTTED = r"[0-9]\.[0-9]"
_LONG_RUN = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{20}"
_ORG_LEAD = r"\s(?:S[AC]|EURL|GIE|Inc|L[LPit]|Co|GmbH|PLC|Holdings)"
_SPLIT_NUMBER = r"[0-9]{3}[\s.\-][0-9]{2}"


@dataclass(frozen=True)
class Gates:
    """A text and cheap facts about it that spare whole families of patterns.

    Every digit-led format needs a digit and every address an ``@``; testing that
    once costs far less than a pattern that fails at each position. ``low`` is the text in small
    letters, ``long_number`` says whether ten digits stand together, ``split_number`` whether
    three and two are set apart by one sign.
    """

    text: Column
    has_digit: Column
    has_at: Column
    low: Column
    long_number: Column
    split_number: Column

    @classmethod
    def of(cls, text) -> "Gates":
        text = as_column(text)
        digit = F.regexp_like(text, F.lit("[0-9]"))
        return cls(
            text, digit, text.contains("@"), F.lower(text),
            digit & F.regexp_like(text, F.lit(_LONG_NUMBER)), digit & F.regexp_like(text, F.lit(_SPLIT_NUMBER)),
        )

    def bound(self) -> Column:
        return F.struct(*[getattr(self, f.name).alias(f.name) for f in fields(self)])

    @classmethod
    def within(cls, bound: Column) -> "Gates":
        return cls(*[bound[f.name] for f in fields(cls)])

    def holds(self, *words: str) -> Column:
        """Whether one of the words occurs, letter for letter."""
        return has_any(self.text, words)

    def mentions(self, *words: str) -> Column:
        """Whether one of the words, given in small letters, occurs in any case. Enough for a pattern
        that minds the case of ASCII letters only."""
        return has_any(self.low, words)


def detect(text, build: Callable[[Gates], Column]) -> Column:
    """Run detectors on a text: its plain form and the gates are computed once."""

    def gated(plain: Column) -> Column:
        return let(Gates.of(plain).bound(), lambda b: build(Gates.within(b)))

    return scan(text, gated)


@dataclass(frozen=True)
class Detector:
    """A named producer of spans: ``expr(gates)`` gives an array of spans."""

    name: str
    types: tuple[str, ...]
    expr: Callable[[Gates], Column]


# Signs that a match of a pattern can begin with. Java tries word edges and branches at every character
# of a text; one class in front of them spares most of that.
_FIRST = {
    "PHONE_FR": "+0", "PHONE_US": "+(0-9", "PHONE_UK": "+0", "PHONE_INTL": "+", "PHONE_INTL_STRICT": "+", "IPV4": "0-9", "IBAN": "A-Z",
    "AMOUNT": "0-9$€£¥UEGCuegc", "NIR": "12", "SIRET": "0-9", "SIREN": "0-9Ss", "SSN": "0-9", "SSN_LABELLED": "Ss",
    "NINO_LABELLED": "Nn", "CARD": "0-9", "PERSON_TITLED": "A-Z", "PERSON_LABELLED": "PpCcSsEeWwMmUuNn",
    "ORG_SUFFIXED": "A-ZÀ-ÖØ-Þ0-9", "ORG_PREFIXED": "GgSsEeCcBbMmAaHhFf",
}
# Stretches after which nothing can match that a shorter stretch leaves over: they are not given back. A word edge
# before a class, and branches, are asked for the sign that comes next first.
_WHOLE = {
    "EMAIL": ((r"\b[A-Za-z0-9._%+-]+@", r"(?:(?=\w)(?<!\w)|(?=[.%+-])(?<=\w))[A-Za-z0-9._%+-]++@"),),
    "AMOUNT": ((r"\d+(?:[ \t.,]\d+)*(?:[.,]\d+)?", r"\d++(?:[ \t.,]\d++)*+"),),
    "ORG_SUFFIXED": ((r"[A-Za-zÀ-ÖØ-ß0-9&.\-_]*", r"[A-Za-zÀ-ÖØ-ß0-9&.\-_]*+"), (r"\s+(?:SARL|", r"\s+(?=[SEGILCPH])(?:SARL|")),
}


def _led(pattern: str, first: str) -> str:
    return f"(?=[{first}])(?:{pattern})"


def _p(name: str) -> str:
    pattern = getattr(fixed, name)
    for plain, quick in _WHOLE.get(name, ()):
        pattern = pattern.replace(plain, quick)
    return _led(java_pattern(pattern), _FIRST[name]) if name in _FIRST else java_pattern(pattern)


def _not_version(prefix: Column) -> Column:
    return ~F.regexp_like(prefix, F.lit(_p("VERSION_BEFORE")))


# --- secrets -------------------------------------------------------------------


# Each format starts with or contains one of these letters or marks.
_SECRET_LEADS = (
    "-----BEGIN ", "://", "eyJ", "k_", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "AKIA", "ASIA", "AIza", "hf_", "xox", "earer",
)


def known_secrets(g: Gates) -> Column:
    """Tokens in public formats: one scan over all formats, then a name per hit."""
    # All but one format begin at a word edge; testing it once spares ten branches.
    edged = [p[2:] for p in fixed.SECRET_FORMATS.values() if p.startswith(r"\<")]
    others = [p for p in fixed.SECRET_FORMATS.values() if not p.startswith(r"\<")]
    every = _led(java_pattern("|".join(others + [r"\<(?:" + "|".join(edged) + ")"])), "-pmraesghAxBb")

    def name(value: Column) -> Column:
        expr = None
        for label, pattern in fixed.SECRET_FORMATS.items():
            hit = F.regexp_like(value, F.lit(java_pattern(f"^(?:{pattern})$")))
            expr = F.when(hit, label) if expr is None else expr.when(hit, label)
        return expr

    return find_spans(g.text, every, "SECRET", 0.99, meta=lambda v: {"secretType": name(v)}, when=g.holds(*_SECRET_LEADS))


def _entropy(size: int) -> Callable[[Column], Column]:
    """``struct(best, window)``: the larger of whole and windowed entropy, and the latter."""

    def both(v: Column, whole: Column) -> Column:
        # a value no longer than the window is its own window
        window = F.when(F.length(v) <= size, whole).otherwise(window_entropy(v, size, 4)["max_entropy"])
        return let(window, lambda w: F.struct(F.greatest(whole, w).alias("best"), w.alias("window")))

    return lambda v: let(shannon_entropy(v), lambda whole: both(v, whole))


def _entropy_meta(encoding: str):
    return lambda v, h: {
        "detector": "ShannonEntropy",
        "encoding": encoding,
        "entropy": F.round(h["best"], 2),
        "slidingWindowMax": F.round(h["window"], 2),
    }


def _not_data_uri(prefix: Column) -> Column:
    return ~F.regexp_like(prefix, F.lit(_p("DATA_URI_BEFORE")))


def hex_secrets(g: Gates, threshold: float = fixed.HEX_ENTROPY, size: int = fixed.ENTROPY_WINDOW) -> Column:
    return find_spans(
        g.text,
        _p("HEX_TOKEN"),
        "SECRET",
        lambda v, h: F.least(F.lit(0.98), 0.75 + h["best"] / 4.0 * 0.23),
        worth=lambda v: may_reach(v, threshold),
        derive=_entropy(size),
        keep=lambda v, h: h["best"] >= threshold,
        before=(50, _not_data_uri),
        meta=_entropy_meta("hex"),
    )


def opaque_secrets(g: Gates, threshold: float = fixed.OPAQUE_ENTROPY, size: int = fixed.ENTROPY_WINDOW) -> Column:
    def varied(v: Column) -> Column:
        has = lambda cls: F.regexp_like(v, F.lit(cls)).cast("int")
        return has("[A-Z]") + has("[a-z]") + has("[0-9]") + has(r"[+/=_\-]") >= 2

    return find_spans(
        g.text,
        _p("OPAQUE_TOKEN"),
        "SECRET",
        lambda v, h: F.least(F.lit(0.98), 0.70 + h["best"] / 6.0 * 0.28),
        worth=lambda v: may_reach(v, threshold) & varied(v) & ~F.regexp_like(v, F.lit("^https?://")),
        derive=_entropy(size),
        keep=lambda v, h: h["best"] >= threshold,
        before=(50, _not_data_uri),
        meta=_entropy_meta("base64_or_alphanumeric"),
    )


def entropy_secrets(g: Gates, hex_threshold=fixed.HEX_ENTROPY, opaque_threshold=fixed.OPAQUE_ENTROPY) -> Column:
    """Hex tokens, then opaque tokens whose exact span is not taken yet."""
    both = F.struct(
        hex_secrets(g, hex_threshold).alias("hex"), opaque_secrets(g, opaque_threshold).alias("other")
    )
    merged = let(
        both,
        lambda b: F.concat(
            b["hex"],
            F.filter(
                b["other"],
                lambda s: ~F.exists(
                    b["hex"], lambda h: (h["start"] == s["start"]) & (h["end"] == s["end"])
                ),
            ),
        ),
    )
    # tried where a run begins, not at each sign of it
    long_run = F.regexp_like(g.text, F.lit(_LONG_RUN))
    return F.when(long_run, merged).otherwise(no_spans())


# --- cards, identity, finance --------------------------------------------------


def cards(g: Gates) -> Column:
    digits = lambda v: F.regexp_replace(v, f"(?:{SPACE}|-)", "")
    return find_spans(
        g.text,
        _p("CARD"),
        "CREDIT_CARD",
        0.99,
        keep=checks.luhn_ok,
        meta=lambda v: {"issuer": checks.card_issuer(digits(v))},
        when=g.long_number,
    )


def nirs(g: Gates) -> Column:
    return find_spans(
        g.text, _p("NIR"), "NIR", 0.98, keep=checks.nir_ok, meta={"country": "FR"}, when=g.long_number
    )


def sirets(g: Gates) -> Column:
    return find_spans(
        g.text, _p("SIRET"), "SIRET", 0.96, keep=checks.luhn_ok,
        meta={"country": "FR", "kind": "SIRET"}, when=g.long_number,
    )


def sirens(g: Gates) -> Column:
    pattern = _p("SIREN")
    number = lambda m: let(
        F.regexp_extract(m, pattern, 1),
        lambda one: F.when(one != "", one).otherwise(F.regexp_extract(m, pattern, 2)),
    )
    return find_spans(
        g.text, pattern, "SIRET", 0.95, group=number, keep=checks.luhn_ok,
        meta={"country": "FR", "kind": "SIREN"}, when=g.split_number | (g.has_digit & g.mentions("siren")),
    )


def ssns(g: Gates) -> Column:
    return find_spans(
        g.text, _p("SSN"), "SSN", 0.97, keep=checks.ssn_ok, meta={"country": "US"}, when=g.split_number
    )


def labelled_ssns(g: Gates) -> Column:
    return find_spans(
        g.text, _p("SSN_LABELLED"), "SSN", 0.98,
        group=lambda m: F.regexp_extract(m, _p("SSN_NUMBER"), 0),
        keep=checks.ssn_ok, meta={"country": "US", "context": "true"}, when=g.has_digit & g.mentions("ssn", "social"),
    )


def ninos(g: Gates) -> Column:
    return find_spans(
        g.text, _p("NINO"), "NINO", 0.97, keep=checks.nino_ok, meta={"country": "UK"},
        when=g.has_digit & F.regexp_like(g.text, F.lit(_BEFORE_LETTER)),
    )


def labelled_ninos(g: Gates) -> Column:
    return find_spans(
        g.text, _p("NINO_LABELLED"), "NINO", 0.98,
        group=lambda m: F.regexp_extract(m, _p("NINO_NUMBER"), 0),
        keep=checks.nino_ok, meta={"country": "UK", "context": "true"}, when=g.has_digit & g.mentions("nino", "national"),
    )


def _starts_inside(outer: Column, s: Column) -> Column:
    return F.exists(outer, lambda o: (s["start"] >= o["start"]) & (s["start"] < o["end"]))


def identity_numbers(g: Gates) -> Column:
    """NIR, SIRET, SIREN, SSN and NINO; an earlier kind keeps what it took."""
    nir_siret = let(
        F.struct(nirs(g).alias("nir"), sirets(g).alias("siret")),
        lambda b: F.concat(b["nir"], F.filter(b["siret"], lambda s: ~_starts_inside(b["nir"], s))),
    )
    return F.when(
        g.has_digit,
        claim_in_order(
            nir_siret, sirens(g), ssns(g), labelled_ssns(g), ninos(g), labelled_ninos(g)
        ),
    ).otherwise(no_spans())


def ibans(g: Gates) -> Column:
    return find_spans(g.text, _p("IBAN"), "IBAN", 0.99, keep=checks.iban_ok, when=g.has_digit)


_MONEY = ("$", "€", "£", "¥", "usd", "eur", "gbp", "chf", "dollar", "livre")


def amounts(g: Gates) -> Column:
    return find_spans(
        g.text, _p("AMOUNT"), "AMOUNT", 0.94,
        keep=lambda v: (F.length(trim_all(v)) > 1) & F.regexp_like(v, F.lit("[0-9]")),
        when=g.has_digit & g.mentions(*_MONEY),
    )


def financial(g: Gates) -> Column:
    return F.when(
        g.has_digit,
        let(
            F.struct(ibans(g).alias("iban"), amounts(g).alias("amount")),
            lambda b: F.concat(b["iban"], F.filter(b["amount"], lambda s: ~_starts_inside(b["iban"], s))),
        ),
    ).otherwise(no_spans())


# --- network -------------------------------------------------------------------


def _by_subnet(inside_label: str, version: str) -> dict:
    """Span fields that depend on whether an address is private."""
    return {
        "type_": lambda v, inside: F.when(inside, "INTERNAL_IP").otherwise("IP_ADDRESS"),
        "meta": lambda v, inside: {
            "version": version,
            "isInternal": inside,
            "subnet": F.when(inside, inside_label).otherwise("PUBLIC"),
        },
    }


def _has_dotted(g: Gates) -> Column:
    return g.has_digit & F.regexp_like(g.text, F.lit(_DOTTED))


def classified_ipv4(g: Gates) -> Column:
    return find_spans(
        g.text, _p("IPV4"), confidence=0.98, derive=checks.private_ipv4,
        before=(10, lambda pre: _not_version(pre) & ~F.regexp_like(pre, F.lit(_p("MAPPED_V4_BEFORE")))),
        when=_has_dotted(g), **_by_subnet("RFC_1918_OR_LOCAL", "v4"),
    )


def _has_ipv6(g: Gates) -> Column:
    """Every spelling holds a colon before a hex digit or a second colon."""
    return g.holds(":") & F.regexp_like(g.text, F.lit(":[0-9a-fA-F:]"))


def classified_ipv6(g: Gates) -> Column:
    return find_spans(
        g.text, _p("IPV6_CLASSIFIED"), confidence=0.96, derive=checks.private_ipv6,
        when=_has_ipv6(g), **_by_subnet("RFC_4193_OR_LOCAL", "v6"),
    )


def network_addresses(g: Gates) -> Column:
    return F.concat(classified_ipv4(g), classified_ipv6(g))


# --- contact data --------------------------------------------------------------


def emails(g: Gates) -> Column:
    return find_spans(g.text, _p("EMAIL"), "EMAIL", 0.98, when=g.has_at)


def phones(g: Gates, strict_intl: bool = False) -> Column:
    """French, US, UK, then international numbers; the first kind keeps its text."""
    one = lambda pattern, conf, country, when: find_spans(
        g.text, _p(pattern), "PHONE", conf, meta={"country": country}, when=when
    )
    plus = g.holds("+")
    uk = plus | (g.has_digit & F.regexp_like(g.text, F.lit(_UK_NUMBER)))
    return F.when(
        g.has_digit & (g.long_number | uk),
        claim_in_order(
            one("PHONE_FR", 0.95, "FR", g.long_number),
            one("PHONE_US", 0.94, "US", g.long_number),
            one("PHONE_UK", 0.93, "UK", uk),
            one("PHONE_INTL_STRICT" if strict_intl else "PHONE_INTL", 0.90, "INTL", plus),
        ),
    ).otherwise(no_spans())


def plain_ipv4(g: Gates) -> Column:
    return find_spans(
        g.text, _p("IPV4"), "IP_ADDRESS", 0.95, before=(10, _not_version),
        meta={"version": "v4"}, when=_has_dotted(g),
    )


def plain_ipv6(g: Gates) -> Column:
    return find_spans(
        g.text, _p("IPV6_GENERIC"), "IP_ADDRESS", 0.95, meta={"version": "v6"}, when=_has_ipv6(g)
    )


def contact_data(g: Gates, classified: bool = False) -> Column:
    """Addresses found by the generic patterns; classified ones outrank them. ``classified``: these are
    searched as well, so that of the plain IPv4 only those are missing that stand behind an IPv6 prefix."""
    ipv4 = F.when(g.mentions("::ffff:"), plain_ipv4(g)).otherwise(no_spans()) if classified else plain_ipv4(g)
    return F.concat(emails(g), phones(g), ipv4, plain_ipv6(g))


# --- names ---------------------------------------------------------------------


# What every title or greeting, and every word before an organisation's name, begins with or holds.
_TITLES = (
    "M.", "Mme", "Mlle", "Monsieur", "Ma", "Mr", "Ms", "Miss", "Dr", "Do", "Prof", "Me", "Sir", "Lady", "Lord",
    "Bonjour", "Salut", "Hello", "Hi", "Dear", "Ch",
)
_PREFIXES = (
    "roup", "ociété", "ntreprise", "abinet", "an", "utuelle", "ssurance", "genc", "lini", "pital", "orporation", "irm", "oldings",
)
# Letters beside K that a pattern for any case takes as ASCII ones, and that stay or come apart in small letters.
_LIKE_ASCII = ("\u017f", "\u0131", "\u0130")
_MANY_NAMES = 64


def _is_name(value: Column) -> Column:
    return ~F.lower(value).isin(fixed.NOT_A_NAME)


def titled_persons(g: Gates) -> Column:
    pattern = _p("PERSON_TITLED")
    name = lambda m: let(
        F.regexp_extract(m, pattern, 1),
        lambda one: F.when(one != "", one).otherwise(F.regexp_extract(m, pattern, 2)),
    )
    return find_spans(
        g.text, pattern, "PERSON", 0.92, group=name,
        group_offset=lambda whole, part: F.length(whole) - F.length(part), keep=_is_name,
        when=g.holds(*_TITLES),
    )


def labelled_persons(g: Gates) -> Column:
    pattern = _p("PERSON_LABELLED")
    return find_spans(
        g.text, pattern, "PERSON", 0.90, group=lambda m: F.regexp_extract(m, pattern, 1),
        keep=_is_name, when=g.text.contains(":"),
    )


def suffixed_organizations(g: Gates) -> Column:
    pattern = _p("ORG_SUFFIXED")
    # The suffix words alone are quick to look for and rare.
    lead = F.regexp_like(g.text, F.lit(_ORG_LEAD))
    return find_spans(g.text, pattern, "ORGANIZATION", 0.94, when=lead)


def prefixed_organizations(g: Gates) -> Column:
    return find_spans(g.text, _p("ORG_PREFIXED"), "ORGANIZATION", 0.93, when=g.holds(*_PREFIXES))


def _plain_parts(names: Iterable[str]) -> list[str]:
    """The longest stretch of ASCII signs of each name, in small letters."""
    return list(dict.fromkeys(max(re.findall(r"[ -~]*", n.lower()), key=len) for n in names))


def listed_names(g: Gates, names: Iterable[str], type_: str, confidence: float) -> Column:
    """Any of a list of names, any case, not inside an ASCII word; longest first."""
    ordered = sorted({n.lower() for n in names}, key=lambda n: (-len(n), n))
    if not ordered:
        return no_spans()
    # one branch per first letter, whatever its case; names of different branches never begin alike
    branches: dict[str, list[str]] = {}
    for name in ordered:
        branches.setdefault(name[0].upper()[0].lower()[0], []).append(java_quote(name))
    firsts = "".join(c if c.isalnum() else "\\" + c for c in branches)
    pattern = f"(?iu)(?=[{firsts}])(?<![a-z0-9])(?:" + "|".join("(?:" + "|".join(b) + ")" for b in branches.values()) + ")(?![a-z0-9])"
    plain = _plain_parts(ordered)
    gate = g.mentions(*plain, *_LIKE_ASCII) if all(plain) and len(plain) <= _MANY_NAMES else None
    return find_spans(g.text, pattern, type_, confidence, when=gate)


def names(g: Gates, registered: Mapping[str, str] | None = None) -> Column:
    """Persons and organisations; inside this family the longest span wins."""
    by_type: dict[str, list[str]] = {}
    for name, type_ in (registered or {}).items():
        by_type.setdefault(type_, []).append(name)
    found = [
        titled_persons(g),
        labelled_persons(g),
        suffixed_organizations(g),
        prefixed_organizations(g),
        listed_names(g, fixed.KNOWN_ORGANIZATIONS, "ORGANIZATION", 0.95),
    ] + [listed_names(g, group, type_, 0.98) for type_, group in sorted(by_type.items())]
    return greedy_cover(F.concat(*found), lambda s, i: (s["start"] - s["end"], i), sweep=False)


def occurrences(text, value, type_, confidence) -> Column:
    """Whole-word, any-case positions of the value in a column (or a constant)."""
    text = as_column(text)
    value = F.lit(value) if isinstance(value, str) else value
    from .vault import value_spans

    return value_spans(text, value, type_, confidence, edge=r"\p{L}\p{N}")


# --- user rules ----------------------------------------------------------------


@dataclass(frozen=True)
class Dictionary:
    name: str
    type: str
    terms: tuple[str, ...]
    case_sensitive: bool = False


@dataclass(frozen=True)
class PatternRule:
    name: str
    type: str
    pattern: str
    case_sensitive: bool = False


def rule_pattern(rule: PatternRule) -> str:
    return java_pattern(rule.pattern) if rule.case_sensitive else "(?iu)" + java_pattern(rule.pattern)


def user_rules(g: Gates, dictionaries: Sequence[Dictionary], patterns: Sequence[PatternRule]) -> Column:
    """Dictionary terms and patterns, longest first.

    Each term is looked for by itself, so a short term that begins earlier cannot
    hide a longer one. For lists beyond a few hundred terms give the table to
    ``anonymize(terms=…)`` or :func:`maskwright.operators.dictionary.dictionary_spans`, a join.
    """
    found = []
    for d in dictionaries:
        flags = "" if d.case_sensitive else "(?iu)"
        terms = sorted({t.strip() for t in d.terms if t and t.strip()}, key=lambda t: (-len(t), t))
        if not terms:
            continue
        edge = lambda body: rf"{flags}(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])"
        any_term = F.regexp_like(g.text, F.lit(edge("|".join(map(java_quote, terms)))))
        for term in terms:
            found.append(
                find_spans(
                    g.text, edge(java_quote(term)), d.type, 1.0,
                    meta={"source": "dictionary", "dictionary": d.name}, when=any_term,
                )
            )
    for rule in patterns:
        found.append(
            find_spans(
                g.text, rule_pattern(rule), rule.type, 0.98, keep=lambda v: v != "",
                meta={"source": "custom_pattern", "ruleName": rule.name},
            )
        )
    return longest_cover(F.concat(*found)) if found else no_spans()


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: s.withField("rank", F.lit(rank)))


# --- the set -------------------------------------------------------------------

def _one_of(words: Iterable[str]) -> str:
    """A pattern for any of the words, one branch per first letter."""
    branches: dict[str, list[str]] = {}
    for word in words:
        branches.setdefault(word[0], []).append(java_quote(word[1:]))
    return "|".join(java_quote(first) + "(?:" + "|".join(rest) + ")" for first, rest in branches.items())


# Bytes of a text that is asked first whether it can hold anything; longer ones nearly always do.
_SHORT = 400


def may_hold(text: Column) -> Column:
    """False only for a short text in which no built-in detector can find anything.

    Spark compiles this test, but not what stands inside a higher-order function, so a table of
    short texts without entities costs a fraction of the detectors.
    """
    numbers = "|".join([_LONG_NUMBER, _UK_NUMBER, _SPLIT_NUMBER, _BEFORE_LETTER, _DOTTED])
    any_case = (*_MONEY, "siren", "ssn", "social", "nino", "national", *_plain_parts(fixed.KNOWN_ORGANIZATIONS))
    return (
        (F.octet_length(text) > _SHORT)
        | F.regexp_like(text, F.lit(_one_of(("@", "+", ":", MARK, *_SECRET_LEADS, *_TITLES, *_PREFIXES))))
        | F.regexp_like(text, F.lit("(?i)" + _one_of(any_case)))
        | ((F.octet_length(text) != F.length(text)) & has_any(text, (*_LIKE_ASCII, *WIDE_SPACES)))
        | F.regexp_like(text, F.lit(f"(?=[0-9])(?:{numbers})"))
        | F.regexp_like(text, F.lit("[A-Z]{2}[0-9]{2}"))
        | F.regexp_like(text, F.lit(_LONG_RUN))
        | F.regexp_like(text, F.lit(_ORG_LEAD))
    )


def built_once(key: tuple, build: Callable[[], Column]) -> Column:
    """An expression that is built once per application: a later session of the same process gets its own."""
    session = SparkSession.getActiveSession()
    if session is None:
        return build()
    key = (session.sparkContext.applicationId, *key)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


@dataclass(frozen=True)
class DetectorSet:
    """An immutable choice of detectors, rules and enabled types.

    Detectors come in order of precedence; ``rank`` in a span is the position of
    its detector and breaks the last ties.
    """

    enabled: tuple[str, ...] = DEFAULT_TYPES
    dictionaries: tuple[Dictionary, ...] = ()
    patterns: tuple[PatternRule, ...] = ()
    registered: tuple[tuple[str, str], ...] = ()
    extra: tuple[Detector, ...] = ()
    hex_threshold: float = fixed.HEX_ENTROPY
    opaque_threshold: float = fixed.OPAQUE_ENTROPY

    def with_detector(self, detector: Detector) -> "DetectorSet":
        return replace(self, extra=self.extra + (detector,))

    def with_names(self, names_: Mapping[str, str]) -> "DetectorSet":
        return replace(self, registered=self.registered + tuple(names_.items()))

    def with_dictionary(self, *dictionaries: Dictionary) -> "DetectorSet":
        """Add dictionaries; one with a known name takes the old one's place."""
        new = {d.name for d in dictionaries}
        kept = tuple(d for d in self.dictionaries if d.name not in new)
        return replace(self, dictionaries=kept + dictionaries)

    def with_pattern(self, *patterns: PatternRule) -> "DetectorSet":
        new = {p.name for p in patterns}
        kept = tuple(p for p in self.patterns if p.name not in new)
        return replace(self, patterns=kept + patterns)

    @property
    def types(self) -> tuple[str, ...]:
        own = [d.type for d in self.dictionaries] + [p.type for p in self.patterns]
        return tuple(dict.fromkeys(self.enabled + tuple(own)))

    @property
    def detectors(self) -> tuple[Detector, ...]:
        custom = tuple(dict.fromkeys([r.type for r in (*self.dictionaries, *self.patterns)]))
        built_in = (
            Detector("known_secrets", ("SECRET",), known_secrets),
            Detector(
                "entropy", ("SECRET",), lambda g: entropy_secrets(g, self.hex_threshold, self.opaque_threshold)
            ),
            Detector("rules", custom, lambda g: user_rules(g, self.dictionaries, self.patterns)),
            Detector("cards", ("CREDIT_CARD",), cards),
            Detector("identity", ("NIR", "SIRET", "SSN", "NINO"), identity_numbers),
            Detector("financial", ("IBAN", "AMOUNT"), financial),
            Detector("network", ("INTERNAL_IP", "IP_ADDRESS"), network_addresses),
            Detector(
                "contact", ("EMAIL", "PHONE", "IP_ADDRESS"), lambda g: contact_data(g, {"IP_ADDRESS", "INTERNAL_IP"} <= set(self.types))
            ),
            Detector("names", ("PERSON", "ORGANIZATION"), lambda g: names(g, dict(self.registered))),
        )
        return built_in + self.extra

    def raw(self, gates: Gates) -> Column:
        """Union of the detectors that can yield an enabled type."""
        types = self.types
        arrays = []
        for rank, detector in enumerate(self.detectors):
            if not set(detector.types) & set(types):
                continue
            spans = detector.expr(gates)
            if not set(detector.types) <= set(types):
                spans = F.filter(spans, lambda s: s["type"].isin(*types))
            arrays.append(_ranked(spans, rank))
        return F.concat(*arrays) if arrays else no_spans()

    def _where_any(self, text, build: Callable[[Gates], Column], without: Callable[[], Column]) -> Column:
        """``detect``, or ``without`` where the built-in detectors have nothing to find and there are no others."""
        found = detect(text, build)
        if self.dictionaries or self.patterns or self.registered or self.extra:
            return found
        return F.when(may_hold(as_column(text)), found).otherwise(without())

    def find_with(self, text, extra: Column) -> Column:
        """Resolved spans of a text column and of spans found elsewhere, which rank last."""
        more = _ranked(extra, len(self.detectors))
        return self._where_any(text, lambda g: resolve_overlaps(F.concat(self.raw(g), more)), lambda: resolve_overlaps(more))

    def find(self, text) -> Column:
        """Resolved spans of a text column.

        Building the expression takes longer than planning it, so it is kept per
        session and column name.
        """
        build = lambda: self._where_any(text, lambda g: resolve_overlaps(self.raw(g)), no_spans)
        return built_once((text, self), build) if isinstance(text, str) else build()


def detector_set(enabled: Iterable[str] | None = None) -> DetectorSet:
    return DetectorSet(enabled=tuple(enabled) if enabled is not None else DEFAULT_TYPES)


def find_entities(text, enabled: Iterable[str] | None = None, detectors: DetectorSet | None = None) -> Column:
    """Resolved spans of a text column, by all or the ``enabled`` types."""
    return (detectors or detector_set(enabled)).find(text)


def entities(
    df: DataFrame, text: str = "text", keys: Sequence[str] | None = None, detectors: DetectorSet | None = None,
    enabled: Iterable[str] | None = None,
) -> DataFrame:
    """One row per entity: ``keys`` plus the span's fields."""
    spans = find_entities(text, enabled, detectors)
    keys = list(keys) if keys is not None else [c for c in df.columns if c != text]
    return df.select(*keys, F.inline(spans))
