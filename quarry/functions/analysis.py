"""Text analysis as column expressions: how fields are cut into tokens, at index time and in queries.

At index time a text becomes an array of positions, each an array of the forms
under which its token is found: the token, its ASCII form, and its parts of
letters or digits. A query becomes an array of tokens. All forms share their
token's position.
"""

from __future__ import annotations

import re
import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the patterns and replacements that define the index
SOURCE_PATTERN = r"\s*(::|[\(\)\{\}\[\]\.,:\"]|[^\p{ASCII}]|((?![^\p{ASCII}])[^\(\)\{\}\[\]\.,:\"\s])+)\s*"
TYPE_PATTERN = r"\s*([\(\)\{\},⇒]|::|([^\(\)\{\},⇒\s:]|:[^\(\)\{\},⇒\s:])+)\s*"
PART_PATTERN = r"(\p{L}+|\p{N}+)"
#: In this order, before a source query is cut. As ":" comes before "~:", the latter never applies.
SOURCE_REPLACEMENTS = (
    ("(|", "⦇"), ("|)", "⦈"), ("[|", "⟦"), ("|]", "⟧"), ("{|", "⦃"), ("|}", "⦄"), (":", "∈"), ("~:", "∉"), ("(=", "⊆"),
    (")=", "⊇"), ("[=", "⊑"), ("]=", "⊒"), (".=", "≐"), ("...", "…"), ("=_(", "⇘"), ("=_)", "⇙"), ("=^(", "⇗"), ("=^)", "⇖"),
)
#: After synonyms, on each token of a source query.
TOKEN_REPLACEMENTS = (("==>", "⟹"), ("=>", "⇒"))


def _base(char: str) -> str:
    """The ASCII letters or digits that a character of a Latin script stands for, empty if there are none.

    First by its compatibility decomposition, then by its name: a letter with a
    stroke, hook or tail is that letter, a dotless one too, and a ligature is its letters.
    """
    plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
    if plain.isascii() and plain.isalnum():
        return plain
    named = re.fullmatch(r"LATIN (SMALL|CAPITAL) (?:LETTER|LIGATURE) (?:DOTLESS )?([A-Z]{1,2})(?: WITH .*)?", unicodedata.name(char, ""))
    if not named:
        return {"ß": "ss", "ẞ": "SS", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D"}.get(char, "")
    return named[2].lower() if named[1] == "SMALL" else named[2]


def _folding() -> dict[str, str]:
    """Characters beyond ASCII of the Latin blocks with what they fold to."""
    found = {chr(cp): _base(chr(cp)) for cp in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF10, 0xFF5B)]}
    return {a: b for a, b in found.items() if b}


_FOLDED = _folding()
_ACCENTED = "".join(a for a, b in _FOLDED.items() if len(b) == 1)
_PLAIN = "".join(b for b in _FOLDED.values() if len(b) == 1)
_SEVERAL = {a: b for a, b in _FOLDED.items() if len(b) > 1}


def folded(token: Column) -> Column:
    """``token`` with the ASCII letters that its accented letters, strokes and ligatures stand for."""
    several = F.create_map(*[F.lit(x) for pair in sorted(_SEVERAL.items()) for x in pair])
    spelt = F.array_join(F.transform(F.split(token, ""), lambda c: F.coalesce(F.element_at(several, c), c)), "")
    return F.translate(F.when(token.rlike(f"[{''.join(_SEVERAL)}]"), spelt).otherwise(token), _ACCENTED, _PLAIN)


def parts(token: Column) -> Column:
    """Stretches of letters, and of digits, of a token."""
    return F.regexp_extract_all(token, F.lit(PART_PATTERN), F.lit(1))


#: Named character references of HTML 4 with their characters; a space that doesn't break is a space.
_NAMED = {name: " " if name == "nbsp" else chr(code) for name, code in name2codepoint.items()}


def references_decoded(text: Column) -> Column:
    """``text`` with character references, by name or number, as characters, each decoded once; what is none stays as it is."""
    named = F.create_map(*[F.lit(x) for pair in sorted(_NAMED.items()) for x in pair])

    def char(piece: Column) -> Column:
        reference = F.regexp_extract(piece, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z0-9]{2,8});", 1)
        code = F.when(reference.startswith("#x") | reference.startswith("#X"), F.conv(F.substring(reference, 3, 6), 16, 10)).when(reference.startswith("#"), F.substring(reference, 2, 7)).cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        decoded = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.element_at(named, reference))
        return F.coalesce(F.concat(decoded, F.substr(piece, F.char_length(reference) + 2)), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    joined = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), char), ""))
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def html_stripped(text: Column) -> Column:
    """``text`` without markup: a space for each tag, comment, script and style; then character references decoded."""
    return references_decoded(F.regexp_replace(text, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " "))


def base_tokens(text: Column, kind: str) -> Column:
    """Tokens of a text as they stand, by analysis."""
    if kind == "name_text":
        return F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    return F.regexp_extract_all(text, F.lit(SOURCE_PATTERN if kind == "source_text" else TYPE_PATTERN), F.lit(1))


def index_text(text: Column, kind: str) -> Column:
    """What is left of a text before it is cut: source code loses its markup."""
    if kind != "source_text":
        return text
    return F.when(F.contains(text, F.lit("<")) | F.contains(text, F.lit("&")), html_stripped(text)).otherwise(text)


def index_length(text: Column, kind: str) -> Column:
    """Number of positions of a text."""
    return F.size(base_tokens(index_text(text, kind), kind))


def may_hold(text: Column, kind: str, piece: Column) -> Column:
    """False only for texts without a form that contains ``piece``: forms are parts of the text or of its ASCII form."""
    plain = index_text(text, kind)
    accented = F.octet_length(plain) != F.char_length(plain)
    return F.contains(F.lower(plain), piece) | (accented & F.contains(F.lower(folded(plain)), piece))


def token_forms(t: Column, kind: str) -> Column:
    """The lower-case forms of a token: itself, its ASCII form, its parts of letters or digits."""
    found = F.array(t) if kind == "name_text" else F.array(t, folded(t))
    more = parts(t) if kind == "name_text" else F.concat(parts(t), parts(folded(t)))
    # most tokens are plain words, numbers or signs, which have no form but themselves
    plain = t.rlike(r"^(?:[A-Za-z]+|[0-9]+|[^\p{L}\p{N}])$")
    return F.when(plain, F.array(F.lower(t))).otherwise(F.transform(F.array_distinct(F.concat(found, more)), lambda x: F.lower(x)))


def index_positions(text: Column, kind: str) -> Column:
    """Array of positions, each the array of its token's lower-case forms; null stays null."""
    return F.transform(base_tokens(index_text(text, kind), kind), lambda t: token_forms(t, kind))


def index_tokens(text: Column, kind: str) -> Column:
    """Distinct forms of all tokens; null stays null."""
    return F.array_distinct(F.flatten(index_positions(text, kind)))


def _replaced(token: Column) -> Column:
    for a, b in TOKEN_REPLACEMENTS:
        token = F.replace(token, F.lit(a), F.lit(b))
    return token


def query_tokens(text: Column, kind: str, synonyms: dict[str, str] | None = None) -> Column:
    """Tokens of a query, in order. ``synonyms`` maps whole tokens of source queries to characters."""
    if kind == "type_text":
        text = F.replace(text, F.lit("=>"), F.lit("⇒"))
    if kind == "source_text":
        for a, b in SOURCE_REPLACEMENTS:
            text = F.replace(text, F.lit(a), F.lit(b))
    tokens = base_tokens(text, kind)
    if kind == "source_text":
        if synonyms:
            table = F.create_map(*[F.lit(x) for pair in sorted(synonyms.items()) for x in pair])
            tokens = F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), t))
        tokens = F.transform(tokens, _replaced)
    return F.transform(tokens, lambda t: F.lower(t))


def facet_copy(value: Column, max_chars: int = 3276) -> Column:
    """The copy of a text by which it is counted as a whole, cut at ``max_chars``."""
    return F.substring(value, 1, max_chars)


def without_last_blank_lines(text: Column) -> Column:
    """``text`` without blank lines at its end."""
    return F.regexp_replace(text, r"(\n\s*)+$", "")


def command_kind(source: Column) -> Column:
    """What a block of source begins with: a brace or comment sign, else its first word."""
    t = F.regexp_replace(source, r"^\s+", "")
    first = F.element_at(F.split(t, r"\s+|\(|\"|\.|‹|\{|\[|%|✐|―"), 1)
    return F.when(t.startswith("{"), "{").when(t.startswith("(*"), "(*").otherwise(first)


def without_first_component(name: Column) -> Column:
    """A dotted name without what stands before its first dot; a name without dot becomes empty."""
    return F.array_join(F.slice(F.split(name, r"\."), F.lit(2), F.greatest(F.size(F.split(name, r"\.")) - 1, F.lit(0))), ".")


def block_id(theory: Column, start: Column, stop: Column) -> Column:
    return F.concat_ws(".", theory, start.cast("string"), stop.cast("string"))


def entity_id(kind: Column, name: Column) -> Column:
    return F.concat_ws(".", kind, name)


#: Names that belong to the logic itself and count as no reference (fixed values).
PURE_NAMES = ("prop", "fun", "itself", "Pure.eq", "Pure.imp", "Pure.all", "Pure.conjunction", "Pure.term", "Pure.type")


def without_pure(names: Column) -> Column:
    """An array of names without those of the logic itself."""
    return F.filter(names, lambda n: ~n.isin(*PURE_NAMES))
