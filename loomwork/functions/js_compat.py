"""Column helpers with the string rules of JavaScript, where Spark's own differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript has it; Java's \s without (?U) is ASCII only, and (?U) lacks the byte-order mark.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, by the size of that encoding where there are characters beyond ASCII."""
    return F.when(_ascii(c), F.length(c)).otherwise((F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"))


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def space_count(c: Column) -> Column:
    """White-space characters, none of which is beyond the basic plane. In ASCII texts the engine's own class is the same."""
    return F.when(_ascii(c), F.regexp_count(c, F.lit(r"\s"))).otherwise(F.regexp_count(c, F.lit(SPACE)))


def word_count(c: Column) -> Column:
    """Runs of anything but white space, counted without making an array of them."""
    return F.when(_ascii(c), F.regexp_count(c, F.lit(r"\S+"))).otherwise(F.regexp_count(c, F.lit(f"[^{SPACE[1:-1]}]+")))


def lines(c: Column) -> Column:
    return F.split(c, "\r?\n")


def url_encode(c: Column) -> Column:
    """encodeURIComponent: form encoding, but for the space and ``! ~ ' ( )``, which stay."""
    out = F.url_encode(c)
    for code, char in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def url_decode(c: Column) -> Column:
    """decodeURIComponent, null where the text is malformed. ``+`` stays as it is."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def base64(c: Column) -> Column:
    """Base64 of the UTF-8 bytes on one line."""
    return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "[\r\n]", "")


def size_label(c: Column) -> Column:
    """Bytes as B, KB, MB or GB by powers of 1024, two decimals above B; ``0 B`` for nothing or less."""
    fixed = lambda n: F.regexp_replace(F.format_number(c / F.lit(float(n)), 2), ",", "")
    return (
        F.when(c <= 0, "0 B").when(c < 1 << 10, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1 << 20, F.concat(fixed(1 << 10), F.lit(" KB")))
        .when(c < 1 << 30, F.concat(fixed(1 << 20), F.lit(" MB"))).otherwise(F.concat(fixed(1 << 30), F.lit(" GB")))
    )


def size_unit(c: Column) -> Column:
    return F.when(c < 1 << 10, "B").when(c < 1 << 20, "KB").when(c < 1 << 30, "MB").otherwise("GB")
