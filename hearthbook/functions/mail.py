"""Column predicates and labels for mail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from hearthbook.functions.prefilter import contains_any
from hearthbook.rulesets import mail


def ends_with_any(c: Column, endings: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(c, F.lit(e)) for e in endings])


def domain_of(addr: Column) -> Column:
    return F.when(F.contains(addr, F.lit("@")), F.substring_index(addr, "@", -1)).otherwise("")


def is_automated(sender: Column, list_unsub: Column, precedence: Column) -> Column:
    """Automated or bulk mail by sender, domain or header."""
    s = F.lower(F.coalesce(sender, F.lit("")))
    return (
        contains_any(s, mail.AUTOMATED_SENDER_PARTS)
        | ends_with_any(domain_of(s), mail.BULK_DOMAINS)
        | (F.coalesce(list_unsub, F.lit("")) != "")
        | F.coalesce(F.lower(precedence).isin(mail.BULK_PRECEDENCE), F.lit(False))
    )


def is_service(addr: Column) -> Column:
    return addr.isin(mail.SERVICE_ADDRESSES) | ends_with_any(domain_of(addr), mail.SERVICE_DOMAINS)


def direction(sender: Column, contact: Column, own: list[str]) -> Column:
    return F.when(sender == contact, "from").when(sender.isin(own), "to").otherwise("cc")


def usable_body(body: Column, direction_: Column, min_chars: int = mail.MIN_BODY_CHARS) -> Column:
    """Body kept for mail from or to the contact, when it says more than a greeting."""
    return F.when(direction_.isin("from", "to") & (F.length(body) > min_chars), body)


def volume_tier(n: Column, a: int = 10, b: int = 5) -> Column:
    return F.when(n >= a, "A").when(n >= b, "B").otherwise("C")
