"""Text helpers as Spark Column expressions: Unicode trim and HTML character references.

All patterns here are written in the regex subset shared by Java and RE2 (no look-around), so the
DuckDB oracle can use the very same strings.
"""

from __future__ import annotations

import html.entities
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
# Characters removed by Python's str.strip() with no argument (str.isspace code points).
WS_CLASS = (
    "[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
# ----------------------------------------------------------------------------------------------

TRIM_RE = f"^{WS_CLASS}+|{WS_CLASS}+$"
RTRIM_RE = f"{WS_CLASS}+$"

# Character references as the HTML tokenizer meets them inside text: a named reference is the
# longest run of name characters, optionally followed by ';'; numeric ones are decimal or hex.
TEXT_REF_RE = "&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][-.A-Za-z0-9]*;?"
# Character references inside attribute values (stdlib unescape rule).
ATTR_REF_RE = "&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\\t\\n\\f <&#;]{1,32};?"


def py_strip(col: Column) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(col, TRIM_RE, "")


def py_rstrip(col: Column) -> Column:
    return F.regexp_replace(col, RTRIM_RE, "")


@lru_cache(maxsize=1)
def named_entities() -> dict[str, str]:
    """Entity name (without ';') -> replacement text, from the HTML5 table in the stdlib."""
    out: dict[str, str] = {}
    for name, repl in html.entities.html5.items():
        out.setdefault(name.rstrip(";"), repl)
    return out


@lru_cache(maxsize=1)
def legacy_entities() -> list[str]:
    """Names the HTML5 table also accepts without ';', longest first (prefix matching)."""
    names = [k for k in html.entities.html5 if not k.endswith(";")]
    return sorted(names, key=lambda s: (-len(s), s))


@lru_cache(maxsize=1)
def cp1252_high() -> dict[int, str]:
    """Code points 0x80-0x9F read as windows-1252 bytes, as the tree builder does for &#128;..&#159;."""
    out = {}
    for n in range(0x80, 0xA0):
        try:
            out[n] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            pass
    return out


_SEP = "\u0001"


def _map_literal(d: dict) -> Column:
    """A constant map built from two joined string literals (folded once by the optimizer)."""
    keys = _SEP.join(str(k) for k in d)
    vals = _SEP.join(d.values())
    return F.map_from_arrays(F.split(F.lit(keys), _SEP), F.split(F.lit(vals), _SEP))


def _entity_map() -> Column:
    return _map_literal(named_entities())


def _cp1252_map() -> Column:
    return _map_literal({str(n): c for n, c in cp1252_high().items()})


def code_point_char(n: Column) -> Column:
    """The character for an integer code point (U+FFFD beyond the Unicode range)."""
    utf32 = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (
        F.when(n > 0x10FFFF, F.lit("�"))
        .when((n >= 0x80) & (n < 0xA0), F.coalesce(F.try_element_at(_cp1252_map(), n.cast("string")), utf32))
        .otherwise(utf32)
    )


def _numeric_ref(ref: Column) -> Column:
    digits = F.regexp_extract(ref, "^&#[xX]?0*([0-9a-fA-F]+)", 1)
    is_hex = ref.rlike("^&#[xX]")
    # long digit runs overflow: treat them as out of range
    n = F.when(F.length(digits) > 8, F.lit(0x110000).cast("long")).otherwise(
        F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
    )
    return code_point_char(n)


def _decode_text_ref(ref: Column) -> Column:
    """One reference met in text: known names map to their character, unknown ones stay as
    ``&name`` (a consumed ';' is dropped, as the tree builder does)."""
    name = F.regexp_extract(ref, "^&([-.A-Za-z0-9]+)", 1)
    return F.when(ref.startswith("&#"), _numeric_ref(ref)).otherwise(
        F.coalesce(F.try_element_at(_entity_map(), name), F.concat(F.lit("&"), name))
    )


def _decode_attr_ref(ref: Column) -> Column:
    """One reference inside an attribute value (stdlib ``html.unescape`` rule)."""
    body = F.substring(ref, 2, 1 << 20)
    has_semi = body.endswith(";")
    bare = F.regexp_replace(body, ";$", "")
    legacy = F.regexp_extract(body, "^(" + "|".join(legacy_entities()) + ")", 1)
    named = F.when(has_semi & F.try_element_at(_entity_map(), bare).isNotNull(), F.try_element_at(_entity_map(), bare)).when(
        legacy != "", F.concat(F.try_element_at(_entity_map(), legacy), F.substring(body, F.length(legacy) + 1, 1 << 20))
    ).otherwise(ref)
    return F.when(ref.startswith("&#"), _numeric_ref(ref)).otherwise(named)


def _replace_refs(col: Column, pattern: str, decode_one) -> Column:
    refs = F.regexp_extract_all(col, F.lit(pattern), 0)
    parts = F.split(col, pattern, -1)
    tail = F.zip_with(refs, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda r, p: F.concat(decode_one(r), p))
    return F.when(F.instr(col, "&") == 0, col).otherwise(F.concat(F.element_at(parts, 1), F.array_join(tail, "")))


def decode_text(col: Column) -> Column:
    """Decode character references in a text node."""
    return _replace_refs(col, TEXT_REF_RE, _decode_text_ref)


def decode_attr(col: Column) -> Column:
    """Decode character references in an attribute value."""
    return _replace_refs(col, ATTR_REF_RE, _decode_attr_ref)
