"""Checking SQL: the same results written for a relational engine without our code."""

from __future__ import annotations

from ..functions import fixed_values as fixed
from . import seeded


def duck(sql: str) -> str:
    """Seeded SQL in the checking engine's dialect."""
    return (
        sql.replace("AS STRING)", "AS VARCHAR)")
        .replace("make_interval(0, 0, 0, 0, 0, 0, CAST(event_id * 5 AS INT))", "to_seconds(event_id * 5)")
    )


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A fixed pattern without look-around, with plain ASCII word edges."""
    return pattern.replace(r"\<", r"\b").replace(r"\>", r"\b").replace(r"(?!\w)", "")


def hits(source: str, key: str, pattern: str, text: str = "text") -> str:
    """``(key, value, start, before)`` of all matches: the text is split at marks."""
    return f"""(SELECT {key}, value, start, substr(text, greatest(start - 9, 1), least(start, 10)) AS before FROM (
      SELECT {key}, part AS value, i, text,
             CAST(sum(length(part)) OVER (PARTITION BY {key} ORDER BY i) - length(part) AS BIGINT) AS start
      FROM (SELECT {key}, text, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
            FROM (SELECT {key}, {text} AS text,
                         string_split(regexp_replace({text}, {literal(pattern)}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts
                  FROM ({source}) src))) WHERE i % 2 = 0)"""


def luhn(digits: str) -> str:
    return (
        f"(list_sum([CASE WHEN (length({digits}) - i) % 2 = 1 THEN "
        f"CASE WHEN CAST({digits}[i] AS INT) > 4 THEN CAST({digits}[i] AS INT) * 2 - 9 ELSE CAST({digits}[i] AS INT) * 2 END "
        f"ELSE CAST({digits}[i] AS INT) END FOR i IN range(1, length({digits}) + 1)]) % 10 = 0)"
    )


def compact(value: str) -> str:
    return f"regexp_replace({value}, '[\\s.-]', '', 'g')"


def private(ip: str) -> str:
    o = lambda n: f"CAST(split_part({ip}, '.', {n}) AS INT)"
    return (
        f"({o(1)} IN (10, 127) OR ({o(1)} = 172 AND {o(2)} BETWEEN 16 AND 31) OR "
        f"({o(1)} = 192 AND {o(2)} = 168) OR ({o(1)} = 169 AND {o(2)} = 254))"
    )


NOT_VERSION = "NOT regexp_matches(before, '(?i)(?:^|[\\s,;:])v(?:ersion)?[\\s.]*$')"
CORPUS = duck(seeded.CORPUS)


def entropy(value: str) -> str:
    return (
        f"(SELECT sum(-(n / length({value})) * log2(n / length({value}))) FROM "
        f"(SELECT count(*) * 1.0 AS n FROM (SELECT unnest(string_split({value}, '')) AS c) GROUP BY c))"
    )


def detected(*types: str, source: str = CORPUS, key: str = "id") -> str:
    """Spans of simple types: ``(key, type, value, start)``."""
    parts = {
        "EMAIL": f"SELECT {key}, 'EMAIL' AS type, value, start FROM {hits(source, key, re2(fixed.EMAIL))}",
        "CREDIT_CARD": f"SELECT {key}, 'CREDIT_CARD' AS type, value, start FROM {hits(source, key, re2(fixed.CARD))} WHERE {luhn(compact('value'))}",
        "IP": f"SELECT {key}, CASE WHEN {private('value')} THEN 'INTERNAL_IP' ELSE 'IP_ADDRESS' END AS type, value, start "
        f"FROM {hits(source, key, re2(fixed.IPV4))} WHERE {NOT_VERSION}",
    }
    return " UNION ALL ".join(parts[t] for t in types)


def disjoint(source: str, order: str, key: str = "id") -> str:
    """Rows ``(key, span)`` of ``(key, type, value, start, confidence, rank)``: taken in order, each if it overlaps none taken."""
    clash = "len(list_filter(acc, lambda a: greatest(a.start, x[1].start) < least(a.start + length(a.value), x[1].start + length(x[1].value)))) > 0"
    one = "[struct_pack(type := type, value := value, start := start, confidence := confidence, rank := rank)]"
    return f"""(SELECT {key}, s.type AS type, s.value AS value, s.start AS start, s.confidence AS confidence, s.rank AS rank FROM (
      SELECT {key}, unnest(list_reduce(list({one} ORDER BY {order}), lambda acc, x: CASE WHEN {clash} THEN acc ELSE list_concat(acc, x) END)) AS s
      FROM {source} GROUP BY {key}))"""


def priority(column: str = "type") -> str:
    ranks = " ".join(f"WHEN '{name}' THEN {score}" for name, score in fixed.ENTITY_PRIORITY.items())
    return f"(CASE {column} {ranks} ELSE {fixed.OTHER_TYPE_PRIORITY} END)"


def entities(queries: dict[str, str]) -> str:
    """All types over the texts with ids: the union of the detectors' own SQL with overlaps resolved.

    Kinds of spans that the given texts do not hold (labelled numbers, IPv6, other token
    formats) are left out; one that appeared would show as a difference.
    """
    part = lambda rank, kind, confidence, sql: (
        f"SELECT id, {kind} AS type, value, start, CAST({confidence} AS DOUBLE) AS confidence, {rank} AS rank FROM ({sql})"
    )
    t = literal
    overlap = "b.id = a.id AND greatest(a.start, b.start) < least(a.start + length(a.value), b.start + length(b.value))"
    starts = "b.id = a.id AND a.start >= b.start AND a.start < b.start + length(b.value)"
    without = lambda sql, taken, test=overlap: f"SELECT * FROM ({sql}) a WHERE NOT EXISTS (SELECT 1 FROM ({taken}) b WHERE {test})"
    q = {name: f"SELECT * FROM q_{name}" for name in queries}
    ctes = ", ".join(f"q_{name} AS MATERIALIZED ({sql})" for name, sql in queries.items())
    identity = [part(4, t("NIR"), 0.98, q["nir_spans"])]
    identity.append(without(part(4, t("SIRET"), 0.96, q["siret_spans"]), identity[0], starts))
    for kind, confidence, name in (("SIRET", 0.95, "siren_spans"), ("SSN", 0.97, "ssn_spans"), ("NINO", 0.97, "nino_spans")):
        identity.append(without(part(4, t(kind), confidence, q[name]), " UNION ALL ".join(identity)))
    hexes = part(1, t("SECRET"), "confidence", q["hex_secret_spans"])
    opaque = part(1, t("SECRET"), "confidence", q["opaque_secret_spans"])
    named = [
        part("rank", t("PERSON"), "confidence", q["person_spans"]), part(2, t("ORGANIZATION"), 0.94, q["suffixed_organizations"]),
        part(3, t("ORGANIZATION"), 0.93, q["prefixed_organizations"]), part(4, t("ORGANIZATION"), 0.95, q["known_organizations"]),
    ]
    names = disjoint("(" + " UNION ALL ".join(named) + ")", "-length(value), rank, start")
    parts = [
        part(0, t("SECRET"), 0.99, q["known_secret_spans"]), hexes,
        without(opaque, q["hex_secret_spans"], "b.id = a.id AND a.start = b.start AND length(a.value) = length(b.value)"),
        part(3, t("CREDIT_CARD"), 0.99, q["card_spans"]), *identity,
        part(5, t("IBAN"), 0.99, q["iban_spans"]), without(part(5, t("AMOUNT"), 0.94, q["amount_spans"]), q["iban_spans"], starts),
        part(6, "type", 0.98, q["ipv4_class"]), part(7, t("EMAIL"), 0.98, q["email_spans"]),
        part(7, t("PHONE"), "confidence", q["phones"]), f"SELECT id, type, value, start, confidence, 8 AS rank FROM {names}",
    ]
    order = f"-{priority()}, -length(value), -floor(confidence * 20 + 1e-9), start, rank"
    return f"WITH {ctes} SELECT id, type, value, start, confidence FROM {disjoint('(' + ' UNION ALL '.join(parts) + ')', order)}"
