"""Checksum and shape checks, each one boolean SQL expression over a string expression.

All of them stay inside Catalyst. They give false (never null) for bad input, so
they can be used directly as filters. ``check("iban", "value")`` is the Column form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.spans import q

# GB/T 2260 province prefixes, ISO 7064 weights and alphabets.
PROVINCES = (
    "11", "12", "13", "14", "15", "21", "22", "23", "31", "32", "33", "34", "35", "36", "37",
    "41", "42", "43", "44", "45", "46", "50", "51", "52", "53", "54", "61", "62", "63", "64",
    "65", "71", "81", "82",
)
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECK = "10X98765432"
USCC_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
USCC_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)


def _all(*conds: str) -> str:
    return "coalesce(" + " AND ".join(f"({c})" for c in conds) + ", false)"


def _like(v: str, pattern: str) -> str:
    return f"rlike({v}, {q(pattern)})"


def _in(values) -> str:
    return "(" + ", ".join(q(x) for x in values) + ")"


def strip(v: str) -> str:
    """Trim every kind of white space at both ends."""
    return f"regexp_replace({v}, {q(r'(?U)^\s+|\s+$')}, '')"


def digits(v: str) -> str:
    return f"regexp_replace({v}, {q(r'(?U)\D')}, '')"


def _one_symbol(v: str) -> str:
    return _like(v, r"(?s)\A(.)\1*\z")


def luhn(v: str) -> str:
    d = digits(v)
    return _all(f"length({d}) BETWEEN 13 AND 19", f"NOT {_one_symbol(d)}", f"luhn_check({d})")


def bank_card(v: str) -> str:
    d = f"regexp_replace({v}, '[ -]', '')"
    return _all(_like(d, "^[3-6]"), f"length({d}) BETWEEN 13 AND 19", luhn(d))


def _real_date(v: str) -> str:
    return f"try_to_date({v}, 'yyyyMMdd') IS NOT NULL"


def cn_id_card(v: str) -> str:
    u = f"upper({strip(v)})"
    total = " + ".join(
        f"try_cast(substring({u}, {i + 1}, 1) AS int) * {w}" for i, w in enumerate(ID_WEIGHTS)
    )
    short = _all(_like(u, "^[0-9]{15}$"), _real_date(f"concat('19', substring({u}, 7, 6))"))
    full = _all(
        _like(u, "^[0-9]{17}[0-9X]$"),
        _real_date(f"substring({u}, 7, 8)"),
        f"substring('{ID_CHECK}', ({total}) % 11 + 1, 1) = substring({u}, 18, 1)",
    )
    return _all(f"substring({u}, 1, 2) IN {_in(PROVINCES)}", f"{short} OR {full}")


def cn_uscc(v: str) -> str:
    u = f"upper({strip(v)})"
    total = " + ".join(
        f"(instr('{USCC_ALPHABET}', substring({u}, {i + 1}, 1)) - 1) * {w}" for i, w in enumerate(USCC_WEIGHTS)
    )
    want = f"substring('{USCC_ALPHABET}', (31 - ({total}) % 31) % 31 + 1, 1)"
    return _all(_like(u, f"^[{USCC_ALPHABET}]{{18}}$"), f"{want} = substring({u}, 18, 1)")


def iban(v: str) -> str:
    c = f"upper(regexp_replace({v}, {q(r'(?U)\s+')}, ''))"
    chars = f"regexp_extract_all(concat(substring({c}, 5), substring({c}, 1, 4)), '[0-9A-Z]', 0)"
    rest = (
        f"aggregate({chars}, 0, (z, ch) -> if(ascii(ch) < 58, (z * 10 + ascii(ch) - 48) % 97, "
        "(z * 100 + ascii(ch) - 55) % 97))"
    )
    return _all(_like(c, "^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), f"{rest} = 1")


_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"


def ipv4(v: str) -> str:
    return _all(_like(v, rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"))


def private_ipv4(v: str) -> str:
    special = r"^(?:192\.168\.|169\.254\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.)"
    return _all(ipv4(v), _like(v, special))


def ipv6(v: str) -> str:
    u = strip(v)
    run = "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"
    packed = _all(
        _like(u, f"^(?:{run})?::(?:{run})?$"), f"size(regexp_extract_all({u}, '[0-9A-Fa-f]+', 0)) <= 7"
    )
    return f"({packed} OR {_all(_like(u, '^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$'))})"


def mac(v: str) -> str:
    u = strip(v)
    return _all(
        _like(u, "^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"),
        f"lower(translate({u}, ':-', '')) NOT IN ('{'0' * 12}', '{'f' * 12}')",
    )


def intl_phone(v: str) -> str:
    d = digits(v)
    return _all(f"length({d}) BETWEEN 7 AND 15", f"NOT {_one_symbol(d)}")


def card_expiry(v: str) -> str:
    return _all(_like(v, r"(?U)^\s*(?:0?[1-9]|1[0-2])\s*[/.-]\s*(?:\d{2}|\d{4})\s*$"))


def jwt_header(v: str) -> str:
    """The first of three segments is a base64url JSON object with a string ``alg``."""
    parts = f"split({strip(v)}, {q(r'\.')})"
    head = f"translate({parts}[0], '-_', '+/')"
    padded = f"rpad({head}, cast(ceil(length({head}) / 4) * 4 AS int), '=')"
    doc = f"try_parse_json(try_validate_utf8(cast(try_to_binary({padded}, 'base64') AS string)))"
    kind = lambda key: f"schema_of_variant(try_variant_get({doc}, '$.{key}', 'variant'))"
    return _all(
        f"size({parts}) = 3",
        f"NOT array_contains({parts}, '')",
        f"length({head}) % 4 <> 1",
        f"startswith(schema_of_variant({doc}), 'OBJECT')",
        f"{kind('alg')} = 'STRING'",
        f"length(try_variant_get({doc}, '$.alg', 'string')) > 0",
        f"coalesce({kind('typ')}, 'VOID') IN ('STRING', 'VOID')",
    )


def cn_mobile(v: str) -> str:
    """Eleven digits once one leading 0086 and then one leading 86 are taken off."""
    return _all(f"length(regexp_replace(regexp_replace({digits(v)}, '^0086', ''), '^86', '')) = 11")


# What a labelled password value may not look like.
_PW_HINTS = ("已隐藏", "未设置", "REDACTED", "placeholder", "example", "from prompt", "见保险箱", "dummy")
_PW_CODE = ("${", "{{", "os.environ", "environ[", "env[", "process.env", "⟦", "⟧")
_PW_WORDS = ("null", "none", "nil", "undefined", "true", "false", "password", "passwd", "secret")
_PW_PROSE = "的是了在和与或很不策略要求规范"


def password_ok(v: str) -> str:
    u = strip(v)
    has = " OR ".join(f"contains({u}, {q(w)})" for w in (*_PW_CODE, *_PW_HINTS))
    return _all(
        f"length({u}) BETWEEN 6 AND 256",
        f"NOT {_like(u, r'''^(?:\$\{|\{\{|[<\[("'⟦])''')}",
        f"NOT {_like(u, r'''[}>\])"'⟧]$''')}",
        f"NOT ({has})",
        f"NOT {_like(u, r'(?U)^[*•\s]+$')}",
        f"length(regexp_replace({u}, '[^*•]', '')) < length({u}) * 0.7D",
        f"lower({u}) NOT IN {_in(_PW_WORDS)}",
        f"NOT {_like(u, f'[{_PW_PROSE}]')}",
        _like(u, "[A-Za-z0-9]"),
    )


CHECKS = {
    "luhn": luhn,
    "bank_card": bank_card,
    "cn_id_card": cn_id_card,
    "cn_uscc": cn_uscc,
    "iban": iban,
    "ipv4": ipv4,
    "private_ipv4": private_ipv4,
    "ipv6": ipv6,
    "mac": mac,
    "intl_phone": intl_phone,
    "card_expiry": card_expiry,
    "jwt_header": jwt_header,
    "cn_mobile": cn_mobile,
    "password_ok": password_ok,
}



def check(name: str, column: str) -> Column:
    """One check over a named column, e.g. ``df.filter(check("iban", "value"))``."""
    return F.expr(CHECKS[name](f"`{column}`"))
