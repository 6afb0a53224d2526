"""Scalar functions on columns: names, phones, numbers. All are Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab

WHITE = r"[\s\p{Z}]+"


def first_truthy(*columns: Column) -> Column:
    """The first value that is not null and not '' (of strings)."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def zero_padded(c: Column, width: int = 9) -> Column:
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where c is computed once however often f names it."""
    return F.transform(F.array(c), f)[0]


def current_name(c: Column) -> Column:
    """Without what follows a marker of former names: the first marker of the list that occurs, not the first in the text."""
    def cut(text: Column) -> Column:
        out = text
        for marker in reversed(vocab.FORMER_NAMES):
            at = F.instr(text, marker)
            out = F.when(at > 1, squeezed(F.substring(text, F.lit(1), at - 1))).otherwise(out)
        return out

    return _once(c, cut)


def name_tokens(c: Column) -> Column:
    text = current_name(squeezed(F.lower(F.coalesce(c, F.lit("")))))
    tokens = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}_\s\p{Z}]", ""), WHITE), lambda t: t != "")
    full = F.create_map(*(F.lit(x) for kv in vocab.ABBREVIATIONS.items() for x in kv))
    return F.filter(F.transform(tokens, lambda t: F.coalesce(F.element_at(full, t), t)), lambda t: ~t.isin(vocab.STOP_WORDS))


def normalized(c: Column) -> Column:
    return F.array_join(name_tokens(c), " ")


def core_tokens(c: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(name_tokens(c), 1, n), " ")


def with_alias(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in vocab.ALIASES.items() for x in kv))
    return F.coalesce(F.element_at(table, normalized(c)), c)


def phone(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    shown = F.concat(F.lit("("), F.substring(digits, 1, 3), F.lit(") "), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 4))
    return F.when(F.length(digits) == 10, shown).otherwise(F.coalesce(c, F.lit("")))


def website(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.upper(t).isin(vocab.NO_WEBSITE), "").otherwise(t)


def whole_number(c: Column) -> Column:
    """Truncated toward zero; 0 if it is no finite number."""
    d = c.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) >= 9.2e18), F.lit(0).cast("long")).otherwise(d.cast("long"))


def number_or_null(c: Column) -> Column:
    """As ``whole_number``, but null if it is no finite number."""
    return F.when(c.try_cast("double").between(-9.2e18, 9.2e18), whole_number(c))


def utf8_text(content: Column) -> Column:
    """Bytes as text; bytes that are not UTF-8 are left out (and, in such a text, replacement characters)."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.translate(F.make_valid_utf8(text), "\ufffd", ""))


def year(c: Column) -> Column:
    return F.coalesce(F.when(c.rlike(r"^\d+$"), c.try_cast("int")), F.lit(0))


def amount(c: Column) -> Column:
    d = c.try_cast("double")
    return F.when(d.isNull() | F.isnan(d), 0.0).otherwise(d)


def application_status(invite_only: Column, has_info: Column) -> Column:
    return F.when(invite_only == 1, "Invite Only").when(has_info == 1, "Accepting Applications").otherwise("")


def object_id(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(_public)?\.xml$", 1)


def tiered(score: Column, tiers: list) -> Column:
    out = F.lit(tiers[-1][1])
    for cut, name in reversed(tiers[:-1]):
        out = F.when(score >= cut, name).otherwise(out)
    return out


def without_stub(c: Column) -> Column:
    """Without a last word of three letters or fewer that is no known short word: names are often cut off."""
    words = F.split(c, " ")
    last = F.element_at(words, -1)
    cut = (F.size(words) >= 2) & (F.length(last) <= 3) & ~last.isin(vocab.SHORT_WORDS)
    return F.when(cut, F.array_join(F.slice(words, 1, F.size(words) - 1), " ")).otherwise(c)


def invite_text(flag: Column) -> Column:
    """'' for an unknown flag."""
    return F.when(flag, "Invite Only").when(~flag, "Not Invite Only").otherwise("")


def reply_array(reply: Column) -> Column:
    """From the first [ to the last ] of a reply that may hold more words; '' without both."""
    return F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
