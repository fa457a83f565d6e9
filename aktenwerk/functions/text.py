"""Pattern matches with exact positions, and small text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    """Trimmed, with every run of white space as one blank. Single blanks are left alone: replacing them costs most."""
    return F.trim(F.regexp_replace(text, r"(?U) \s+|[^\S ]\s*", " "))


#: All white space, as the pattern ``(?U)\\s`` has it.
_WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(_WHITE))


def group(text: Column, pattern: str, number: int) -> Column:
    """A group of the first match, null where it is missing."""
    return F.nullif(F.regexp_extract(text, pattern, number), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def groups(text: Column, pattern: str, n: int) -> Column:
    """The first ``n`` groups of a text that matches as a whole, as an array; a missing group is an empty string."""
    mark = "\u0001"
    return F.split(F.regexp_replace(text, pattern, mark.join(f"${i + 1}" for i in range(n))), mark, -1)


#: Put around matches; a text that has them is split at the pattern instead.
_OPEN, _CLOSE = "\u0001", "\u0002"
_FOUND = "array<struct<text:string,s:int,e:int>>"
_FOUND_WITH_PARTS = "array<struct<text:string,s:int,e:int,parts:array<string>>>"


def matches(text: Column, pattern: str, n_groups: int = 0) -> Column:
    """All matches in order as ``array<struct<text, s, e>>`` with 0-based half-open code-point positions.

    With ``n_groups``, ``parts`` are the first groups of each match as in ``groups``, from the same run of the pattern. One replacement marks the matches, and what lies between the marks gives texts and positions: ``split`` would compile the
    pattern anew for every text. A text that the replacement leaves as it is has none.
    """

    kind = _FOUND_WITH_PARTS if n_groups else _FOUND

    def placed(pieces: Column) -> Column:
        zero = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), F.array().cast(kind).alias("out"))

        def step(acc: Column, piece: Column) -> Column:
            """``piece``: a match, the mark (with groups: each group and a mark), and the gap after it."""

            def placed_parted(p: Column) -> Column:
                m, gap = F.get(p, F.lit(0)), F.get(p, F.lit(n_groups + 1))
                end = acc["at"] + F.length(m)
                one = F.struct(m.alias("text"), acc["at"].alias("s"), end.alias("e"), F.slice(p, F.lit(2), F.lit(n_groups)).alias("parts"))
                return F.struct((end + F.length(gap)).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

            if n_groups:
                return let(F.split(piece, _CLOSE, -1), placed_parted)

            def placed_one(m: Column) -> Column:
                one = F.struct(m.alias("text"), acc["at"].alias("s"), (acc["at"] + F.length(m)).alias("e"))
                return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

            return let(F.substring_index(piece, _CLOSE, 1), placed_one)

        return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), zero, step, lambda acc: acc["out"])

    def found(marked: Column) -> Column:
        apart = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE))
        slow = _matches_apart(text, pattern)
        if n_groups:
            slow = F.transform(slow, lambda m: F.struct(m["text"].alias("text"), m["s"].alias("s"), m["e"].alias("e"), _parts(m["text"], pattern, n_groups).alias("parts")))
        return F.when(marked == text, F.array().cast(kind)).when(apart, slow).otherwise(let(F.split(marked, _OPEN, -1), placed))

    return let(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}" + "".join(f"${i + 1}{_CLOSE}" for i in range(n_groups))), found)


def _parts(text: Column, pattern: str, n: int) -> Column:
    """The same as ``groups`` for any text."""
    return F.array(*(F.regexp_extract(text, pattern, i + 1) for i in range(n)))


def _matches_apart(text: Column, pattern: str) -> Column:
    """The same for any text: the gaps between matches come from splitting at the pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the last gap is followed by no match
    steps = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"), m.alias("text")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(x["text"].alias("text"), start.alias("s"), end.alias("e")))).alias("out"))

    return F.aggregate(F.filter(steps, lambda x: x["text"].isNotNull()), zero, step, lambda acc: acc["out"])


def occurrences(text: Column, word: Column) -> Column:
    """All occurrences of a literal as a whole word, as in ``matches``; ``word`` may differ by row.

    The literal comes first and is searched for in leaps; that a word begins there is asked where it is found.
    """
    literal = F.concat(F.lit(r"\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))
    quoted = F.concat(F.lit("(?U)"), literal, F.lit(r"(?<=\b"), literal, F.lit(r")\b"))
    size = F.length(word)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc: Column, gap: Column) -> Column:
        start = acc["at"] + F.length(gap)
        return F.struct((start + size).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), (start + size).alias("e")))).alias("out"))

    before = let(F.split(text, quoted, -1), lambda gaps: F.slice(gaps, F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(0))))
    return F.aggregate(before, zero, step, lambda acc: acc["out"])


def cut(text: Column, start: Column, end: Column) -> Column:
    """Half-open 0-based slice."""
    return F.substring(text, start + 1, end - start)


def last_index(text: Column, *literals: str) -> Column:
    """0-based position of the last occurrence of any of the literals, -1 if there is none."""
    first = "".join(sorted({x[0] for x in literals}))
    # what precedes it begins with a character of its own, so that nothing found differs from found in front
    before = F.regexp_extract(F.concat(F.lit("^"), text), rf"(?s)^(.*)(?=[\Q{first}\E])(?:{'|'.join(rf'\Q{x}\E' for x in literals)})", 1)
    return F.length(before) - 1
