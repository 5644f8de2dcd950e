"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that Unicode calls white space, as a Java character class.
SPACE = r"[\x09-\x0D\x20\x85\xA0  -     　]"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NOT_SPACE = SPACE.replace("[", "[^", 1)
DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity|nan)"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def to_int(text: Column) -> Column:
    """A 32-bit integer with an optional sign and nothing around it, else null."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def xml_escape(text: Column) -> Column:
    """The five characters that XML reserves, the ampersand first."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def plain_text(text: Column) -> Column:
    """Markup and entities taken out, if there is a "<" at all."""
    plain = F.regexp_replace(text, r"<[^>]*(>|$)|>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.when(F.contains(text, F.lit("<")), plain).otherwise(text)


def safe_name(text: Column) -> Column:
    """Letters, numbers, "-" and "." stay; each other character becomes "_"."""
    return F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}.-]", "_")


def symbol_number(code: Column) -> Column:
    """Up to three numbers of a code, joined by dots. What isn't a number is 0, a negative one ends the row, and a dot
    that begins a component belongs to it. A code that ends in a dot ends before it."""
    parts = F.slice(F.regexp_extract_all(code, F.lit(r"(?s)(.[^.]*)(?:\.|$)"), F.lit(1)), 1, 3)
    numbers = F.transform(parts, lambda p: F.coalesce(to_int(trimmed(p)), F.lit(0)))
    low = F.array_position(F.transform(numbers, lambda n: n < 0), True)
    return F.array_join(F.when(low > 0, F.slice(numbers, F.lit(1), low - 1)).otherwise(numbers).cast("array<string>"), ".")


def sheet_name(place: Column, kind: Column, code: Column, name: Column) -> Column:
    """Base name of a symbol's sheet: its place (from 1), type, number and name."""
    number = place.cast("string")
    return F.concat_ws("_", F.lpad(number, F.greatest(F.length(number), F.lit(3)), "0"), kind, safe_name(symbol_number(code)), safe_name(plain_text(name)))


def split_suffix(name: Column) -> tuple[Column, Column]:
    """Stem and suffix: a known suffix in any case, else from the last dot that isn't the first character."""
    known = F.regexp_extract(name, r"(?is)^.+(\.omap|\.xmap|\.png)$", 1)
    other = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    suffix = F.when(known != "", known).otherwise(other)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix)), suffix


def split_ordinal(stem: Column) -> tuple[Column, Column, Column]:
    """Leading digits, separator and the rest."""
    return tuple(F.regexp_extract(stem, r"(?s)^([0-9]*)([_\- ]*)(.*)$", i) for i in (1, 2, 3))


def no_space(rest: Column) -> Column:
    """Each white space character as "_"; "map" for nothing."""
    return F.when(rest == "", "map").otherwise(F.regexp_replace(rest, SPACE, "_"))


def byte_size(size: Column) -> Column:
    """Bytes in the unit that a person reads, of 1000 each."""
    value = size.cast("double")
    shown = lambda v, unit: F.concat(F.call_function("format_number", v, F.lit("0.0")), F.lit(f" {unit}"))
    return F.when(size < 1000, F.concat(size.cast("string"), F.lit(" bytes"))).when(value < 1e6, shown(value / 1e3, "kB")).when(value < 1e9, shown(value / 1e6, "MB")).otherwise(shown(value / 1e9, "GB"))


def clock(seconds: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on; what isn't a time is ??:??."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    short = F.concat(two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))
    good = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds != float("inf"))
    return F.when(~good, "??:??").when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), short)).otherwise(short)


def part_references(fragment: Column) -> Column:
    """Numbers of the parts that a combined symbol's text names."""
    found = F.regexp_extract_all(fragment, F.lit(r'<part symbol="([^"]*)'), F.lit(1))
    return F.filter(F.transform(found, to_int), lambda n: n.isNotNull())


def renumbered(fragment: Column, new_id: Column, mapping: Column) -> Column:
    """A symbol's text with another id in its head and its parts' numbers mapped (map<int,int>; others stay)."""
    head = F.regexp_extract(fragment, r"(?s)^([^>]*>?)", 1)
    tail = F.substring(fragment, F.length(head) + 1, F.length(fragment))
    given = F.regexp_replace(head, F.lit(r'^((?:(?! id=").)*+ id=")[^"]*'), F.concat(F.lit("$1"), new_id.cast("string")))
    fresh = F.concat(F.substring(head, 1, 7), F.lit(' id="'), new_id.cast("string"), F.lit('"'), F.substring(head, F.lit(8), F.length(head)))
    pieces = F.split(tail, '<part symbol="')
    first, rest = F.element_at(pieces, 1), F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def mapped(piece: Column) -> Column:
        old = F.regexp_extract(piece, r'^([^"]*)', 1)
        number = F.coalesce(to_int(old), F.lit(-1))
        return F.concat(F.lit('<part symbol="'), F.coalesce(F.try_element_at(mapping, number), number).cast("string"), F.substring(piece, F.length(old) + 1, F.length(piece)))

    return F.concat(F.when(F.contains(head, F.lit(' id="')), given).otherwise(fresh), first, F.array_join(F.transform(rest, mapped), ""))


def wrap(text: Column, width: int = 80, indent: str = "") -> Column:
    """Each line folded to `width` characters, the indent counted; words stay whole and blank lines stay blank."""

    def paragraph(line: Column) -> Column:
        words = F.filter(F.split(line, rf"{SPACE}+"), lambda w: w != "")
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(indent).alias("line"), F.lit(True).alias("empty"))

        def step(acc: Column, word: Column) -> Column:
            full = ~acc["empty"] & (F.length(acc["line"]) + 1 + F.length(word) > width)
            done = F.when(full, F.concat(acc["done"], F.array(acc["line"]))).otherwise(acc["done"])
            now = F.when(full, F.concat(F.lit(indent), word)).when(acc["empty"], F.concat(acc["line"], word)).otherwise(F.concat(acc["line"], F.lit(" "), word))
            return F.struct(done.alias("done"), now.alias("line"), F.lit(False).alias("empty"))

        folded = F.aggregate(words, start, step, lambda acc: F.array_join(F.concat(acc["done"], F.array(acc["line"])), "\n"))
        return F.when(F.size(words) == 0, "").otherwise(folded)

    return F.array_join(F.transform(F.split(text, "\n"), paragraph), "\n")


def settings(text: Column) -> tuple[Column, Column]:
    """Resolution and frame from an archive's info text: the first line of the header that begins with the key and has
    a number next. Both are null unless both are there."""
    lines = F.split(F.element_at(F.split(text, "\n\n"), 1), "\r?\n")

    def value(key: str) -> Column:
        found = F.transform(lines, lambda line: F.regexp_extract(trimmed(line), rf"(?s)^{key}{SPACE}*({NOT_SPACE}+)", 1))
        numbers = F.filter(found, lambda x: x.rlike(rf"^(?:{DECIMAL})$"))
        return F.try_element_at(numbers, F.lit(1)).try_cast("double")

    resolution, frame = value("resolution"), value("frame")
    both = resolution.isNotNull() & frame.isNotNull()
    return F.when(both, resolution), F.when(both, frame)


#: One coordinate record behind the one before it; possessive, so a text's length costs no stack.
_RECORD = r"\G *+([+-]?[0-9]++) ++([+-]?[0-9]++)(?![^ ;])(?: ++(?:(?!\+-)\+?+(-?[0-9]++)(?![^ ;])|[^ ;]++))?+[ ;]*+"


def with_coordinates(df: DataFrame, text: str, name: str) -> DataFrame:
    """df and, as column `name`, the array<struct<x:int,y:int,flags:int>> of a text column's "x y[ flags];" records, in
    native units, up to the first bad one. Flags that are no number are 0. A row of more than three tokens without a
    semicolon is several records. Steps are columns of their own, so each is computed once and in generated code."""
    own = [f"`{c}`" for c in df.columns]
    step = df.select(*own, F.translate(F.col(text), SPACES, " " * len(SPACES)).alias("__blank"))
    step = step.select(*own, F.col("__blank").rlike("[0-9]{10}").alias("__long"), *[F.regexp_extract_all("__blank", F.lit(_RECORD), F.lit(i)).alias(f"__{c}") for i, c in enumerate("xyf", 1)])
    # a 0 before each flag stands for missing ones
    given = F.replace(F.replace(F.concat(F.lit(","), F.array_join("__f", ",")), F.lit(","), F.lit(",0")), F.lit(",0-"), F.lit(",-0"))
    step = step.select(*own, "__long", "__x", "__y", "__f", F.split(given, ",").alias("__given"))
    # numbers of nine digits fit, so whole arrays are cast
    cast = lambda c: F.when(~F.col("__long"), c.cast("array<int>"))
    plain = F.arrays_zip(cast(F.col("__x")).alias("x"), cast(F.col("__y")).alias("y"), cast(F.slice("__given", F.lit(2), F.size("__x"))).alias("flags"))
    step = step.select(*own, plain.alias("__plain"), F.when(F.col("__long"), F.arrays_zip(F.col("__x").alias("x"), F.col("__y").alias("y"), F.col("__f").alias("flags"))).alias("__strings"))
    return step.select(*own, F.when(F.col("__strings").isNotNull(), _checked(F.col("__strings"))).otherwise(F.col("__plain")).alias(name))


def _checked(strings: Column) -> Column:
    """Records of a text whose numbers may be too large."""
    number = lambda t: F.when(t != "", t.try_cast("int"))
    # each step is bound once: lambdas don't share what they compute
    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    read = F.transform(strings, lambda p: F.struct(number(p["x"]).alias("x"), number(p["y"]).alias("y"), F.coalesce(number(p["flags"]), F.lit(0)).alias("flags")))
    good = lambda c: F.slice(c, F.lit(1), F.coalesce(F.nullif(F.array_position(F.transform(c, lambda r: r["x"].isNull() | r["y"].isNull()), True), F.lit(0)) - 1, F.size(c)).cast("int"))
    return bound(read, good)
