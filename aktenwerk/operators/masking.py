"""Personal data: zones and names of letters, detectors, merged regions, masking and its self-check.

Spans are ``struct<s, e, entity_type, score>`` with 0-based half-open positions.
"""

from __future__ import annotations

import string
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aktenwerk.functions.fixed import CLOSINGS, NAME_PREFIXES, NAME_STOPWORDS, ORGANISATIONS, PHONE, PLACEHOLDERS, REPRESENTATIVE, SIGNATURE_BLOCK, SIGNATURE_TAIL, SUBMITTER
from aktenwerk.functions.text import cut, last_index, let, matches, occurrences, stripped

SPAN = "struct<s:int,e:int,entity_type:string,score:double>"
# a prefix is a whole word: no letter, digit or hyphen follows
_PREFIX = r"(?iuU)^(?:(?:{})(?![\p{{L}}\p{{N}}-])[ .\t]*)++".format("|".join(f"\\Q{p}\\E" for p in sorted(NAME_PREFIXES, key=len, reverse=True)))


def _name(segment: Column) -> Column:
    return stripped(F.regexp_replace(stripped(segment), _PREFIX, ""))


def _segments(text: Column, anchor: str) -> Column:
    """What follows each anchor up to a comma, line end or parenthesis, with the span of both."""

    def follow(m: Column) -> Column:
        segment = F.regexp_extract(cut(text, m["e"], F.length(text)), r"^[^,\n(]*", 0)
        return let(segment, lambda x: F.struct(stripped(x).alias("segment"), m["s"].alias("s"), (m["e"] + F.length(x)).alias("e")))

    return F.transform(matches(text, anchor), follow)


def _signature(text: Column) -> Column:
    """The last closing formula to the end, else the trailing short blocks, else null."""
    marker = last_index(F.lower(text), *CLOSINGS)

    def tail(body: Column) -> Column:
        zero = F.struct(F.length(body).alias("end"), F.lit(None).cast("int").alias("zone"), F.lit(False).alias("done"))

        def climb(acc: Column, block: Column) -> Column:
            start = acc["end"] - F.length(block)
            stop = acc["done"] | (F.length(stripped(block)) > SIGNATURE_BLOCK) | (acc["zone"].isNotNull() & (F.length(body) - start > SIGNATURE_TAIL))
            return F.struct((start - 2).alias("end"), F.when(stop, acc["zone"]).otherwise(start).alias("zone"), stop.alias("done"))

        return F.when(body != "", F.aggregate(F.reverse(F.split(body, "\n\n", -1)), zero, climb, lambda acc: acc["zone"]))

    start = let(marker, lambda m: F.when(m >= 0, m).otherwise(let(F.regexp_replace(text, r"(?U)\s+$", ""), tail)))
    return let(start, lambda x: F.when(x.isNotNull(), F.struct(x.cast("int").alias("s"), F.length(text).alias("e"))))


def extract_zones(docs: DataFrame) -> DataFrame:
    """TXT-3, TXT-4: adds ``names``, ``anchor`` and ``signature`` (structs ``s``, ``e``; null where there is none)."""
    text = F.col("text")
    d = docs.withColumn("_sub", F.slice(_segments(text, SUBMITTER), 1, 1)).withColumn("_rep", _segments(text, REPRESENTATIVE))
    person = F.filter("_sub", lambda x: ~F.exists(F.array(*map(F.lit, ORGANISATIONS)), lambda o: F.contains(x["segment"], o)))
    named = F.filter(F.transform(F.concat(person, F.col("_rep")), lambda x: F.struct(_name(x["segment"]).alias("name"), x["s"].alias("s"), x["e"].alias("e"))), lambda x: x["name"] != "")
    d = d.withColumn("_named", named)
    zone = F.struct(F.array_min(F.transform("_named", lambda x: x["s"])).alias("s"), F.array_max(F.transform("_named", lambda x: x["e"])).alias("e"))
    return (
        d.withColumn("names", F.transform("_named", lambda x: x["name"]))
        .withColumn("anchor", F.when(F.size("_named") > 0, zone))
        .withColumn("signature", _signature(text))
        .drop("_sub", "_rep", "_named")
    )


def name_words(names: Column) -> Column:
    words = F.flatten(F.transform(names, lambda n: F.filter(F.split(n, r"(?U)\s+"), lambda w: w != "")))
    return F.array_distinct(F.filter(words, lambda w: ~F.lower(w).isin(*NAME_STOPWORDS)))


def _within(zone: Column, span: Column) -> Column:
    return F.coalesce((zone["s"] <= span["s"]) & (span["e"] <= zone["e"]), F.lit(False))


def anchored(text: Column, names: Column, anchor: Column, signature: Column) -> Column:
    """Words of the names inside the anchor or signature zone of one text, as ``array<SPAN>`` (each place once)."""
    places = F.flatten(F.transform(name_words(names), lambda w: occurrences(text, w)))
    # the zones are found once a text, not for each place
    inside = let(F.struct(anchor.alias("a"), signature.alias("b")), lambda z: F.array_distinct(F.filter(places, lambda o: _within(z["a"], o) | _within(z["b"], o))))
    return F.transform(inside, lambda o: F.struct(o["s"].alias("s"), o["e"].alias("e"), F.lit("PERSON").alias("entity_type"), F.lit(1.0).alias("score")))


def anchor_spans(zones: DataFrame) -> DataFrame:
    """JON-4: ``(document_id, s, e, entity_type, score)``: words of the names inside the anchor or signature zone.

    Occurrences and containment are found in the row, so the containment join needs no shuffle; rows that repeat an id give
    each place once."""
    found = zones.select("document_id", F.explode_outer(anchored(F.col("text"), F.col("names"), F.col("anchor"), F.col("signature"))).alias("o"))
    return found.where("o is not null").select("document_id", "o.*").dropDuplicates(["document_id", "s", "e"])


def _iban_valid(text: Column) -> Column:
    """Remainder 1 modulo 97 of the rearranged IBAN, digit by digit."""
    flat = F.upper(F.regexp_replace(text, r"\s", ""))
    moved = F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))
    digits = F.transform(F.split(moved, ""), lambda c: F.when(c.between("A", "Z"), F.ascii(c) - 55).when(c.between("0", "9"), F.ascii(c) - 48))
    return F.aggregate(F.filter(digits, lambda x: x.isNotNull()), F.lit(0), lambda acc, x: (F.when(x > 9, acc * 100 + x).otherwise(acc * 10 + x) % 97).cast("int")) == 1


# A mail address ends with the letters of the last label that begins with two. Labels are taken possessively, so that no
# host name, however long, needs recursion: others, and those with such letters that another one of them follows.
_LABEL, _OTHERS = r"[A-Za-z0-9-]+", r"(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]+)*+"
# A name is looked for where its characters begin, or where the match before ended.
_MAIL_NAME, _HOST = string.ascii_letters + string.digits + "._%+-", string.ascii_letters + string.digits + ".-"
EMAIL = rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@{_LABEL}(?:{_OTHERS}\.(?=[A-Za-z]{{2}}){_LABEL}(?={_OTHERS}\.[A-Za-z]{{2}}))*+{_OTHERS}\.[A-Za-z]{{2,}}"



def _around_at(text: Column) -> Column:
    """Start and end of the part that can hold mail addresses: from the name before the first ``@`` to the host after the last."""
    name = F.length(F.rtrim(F.substring_index(text, "@", 1), F.lit(_MAIL_NAME)))
    host = F.length(text) - F.length(F.ltrim(F.substring_index(text, "@", -1), F.lit(_HOST)))
    return F.when(F.contains(text, F.lit("@")), F.struct(name.alias("s"), host.alias("e")))


#: Pattern, score and check of each built-in detector, and for slow patterns the part of a text that holds all matches.
DETECTORS: dict[str, tuple] = {
    "PHONE_NUMBER": (PHONE, 0.6, None),
    "EMAIL_ADDRESS": (EMAIL, 1.0, None, _around_at),
    "IBAN_CODE": (r"(?=[A-Z])\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 1.0, _iban_valid),
}


def _detected(text: Column, kind: str, form: str, score: float, check: Callable[[Column], Column] | None, part: Callable[[Column], Column] | None = None) -> Column:
    def spans(found: Column, at: Column) -> Column:
        if check:
            found = F.filter(found, lambda m: check(m["text"]))
        return F.transform(found, lambda m: F.struct((at + m["s"]).alias("s"), (at + m["e"]).alias("e"), F.lit(kind).alias("entity_type"), F.lit(score).alias("score")))

    if not part:
        return spans(matches(text, form), F.lit(0))
    inside = let(part(text), lambda p: F.when(p.isNotNull(), let(cut(text, p["s"], p["e"]), lambda x: spans(matches(x, form), p["s"]))))
    return F.when(text.isNotNull(), F.coalesce(inside, F.array().cast(f"array<{SPAN}>")))


def detected(text: Column, detectors: dict | None = None, plugins: tuple[Callable[[Column], Column], ...] = ()) -> Column:
    """Spans of the built-in detectors and of plug-ins in one text, as ``array<SPAN>``."""
    arrays = [_detected(text, kind, *rule) for kind, rule in (DETECTORS if detectors is None else detectors).items()]
    arrays += [F.coalesce(p(text).cast(f"array<{SPAN}>"), F.array().cast(f"array<{SPAN}>")) for p in plugins]
    return F.concat(*arrays)


def detect_pii(docs: DataFrame, detectors: dict | None = None, plugins: tuple[Callable[[Column], Column], ...] = ()) -> DataFrame:
    """TXT-5: spans of the built-in detectors and of plug-ins (``text -> array<SPAN>``, see ``register_detector``)."""
    found = docs.select("document_id", F.explode_outer(detected(F.col("text"), detectors, plugins)).alias("x"))  # outer: see region_rows
    return found.where("x is not null").select("document_id", "x.*")


def register_detector(find: Callable) -> Callable[[Column], Column]:
    """UDF-1: a name detector ``Series of texts -> Series of lists of (s, e, entity_type, score)`` as an Arrow UDF."""
    @F.pandas_udf(f"array<{SPAN}>")
    def detector(texts: pd.Series) -> pd.Series:
        return find(texts).map(lambda spans: [dict(zip(("s", "e", "entity_type", "score"), x, strict=True)) for x in spans])

    return detector


def all_spans(*spans: DataFrame) -> DataFrame:
    """SET-1: union of the spans of several sources."""
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def merged(text: Column, spans: Column) -> Column:
    """The regions of one text: ``spans`` (``array<SPAN>`` in any order) sorted and folded.

    A span joins the region before it if they overlap, or if only white space is between them and its type is that of
    the region so far; the higher score decides the type, the earlier one in a tie.
    """
    empty = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        gap = stripped(cut(text, last["e"], F.greatest(x["s"], last["e"]))) == ""
        joins = (F.size(acc) > 0) & ((x["s"] < last["e"]) | ((x["entity_type"] == last["entity_type"]) & gap))
        new = F.struct(x["s"].alias("s"), x["e"].alias("e"), x["entity_type"].alias("entity_type"), x["score"].alias("score"))
        both = F.struct(
            last["s"].alias("s"),
            F.greatest(last["e"], x["e"]).alias("e"),
            F.when(x["score"] > last["score"], x["entity_type"]).otherwise(last["entity_type"]).alias("entity_type"),
            F.greatest(last["score"], x["score"]).alias("score"),
        )
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(new)))

    keyed = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.negative(x["score"]).alias("by"), x["entity_type"].alias("entity_type"), x["score"].alias("score")))
    return F.aggregate(F.sort_array(keyed), empty, step)


def merge_regions(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """WIN-1: adds ``regions`` (array of spans, see ``merged``) to ``docs``."""
    lists = spans.groupBy("document_id").agg(F.collect_list(F.struct("s", "e", "entity_type", "score")).alias("_spans"))
    d = docs.join(lists, "document_id", "left")
    return d.withColumn("regions", merged(F.col("text"), F.coalesce("_spans", F.array().cast(f"array<{SPAN}>")))).drop("_spans")


def placeholder(entity_type: Column) -> Column:
    out = F.lit("")
    for kind, mark in PLACEHOLDERS.items():
        out = F.when(entity_type == kind, mark).otherwise(out)
    return out


def rendered(text: Column, regions: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` with its regions replaced by placeholders."""

    def upto(end: Column) -> Column:
        inside = F.filter(regions, lambda r: (r["e"] > start) & (r["s"] < end))
        zero = F.struct(F.lit("").alias("out"), start.cast("int").alias("at"))

        def step(acc: Column, r: Column) -> Column:
            return F.struct(F.concat(acc["out"], cut(text, acc["at"], F.greatest(r["s"], acc["at"])), placeholder(r["entity_type"])).alias("out"), F.least(r["e"], end).cast("int").alias("at"))

        return F.aggregate(inside, zero, step, lambda acc: F.concat(acc["out"], cut(text, acc["at"], F.greatest(end, acc["at"]))))

    return let(end, upto)


def mask(merged: DataFrame) -> DataFrame:
    """TXT-6, AGG-1: adds ``clean_text`` and ``entity_counts`` (regions by placeholder label)."""
    names = F.filter(F.transform("regions", lambda r: F.regexp_replace(placeholder(r["entity_type"]), r"[\[\]]", "")), lambda x: x != "")

    def counted(labels: Column) -> Column:
        kinds = F.array_sort(F.array_distinct(labels))
        return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(labels, lambda x: x == k))))

    return merged.withColumn("clean_text", rendered(F.col("text"), F.col("regions"), F.lit(0), F.length("text"))).withColumn("entity_counts", let(names, counted))


def region_rows(merged: DataFrame) -> DataFrame:
    """``(document_id, r)``, a row a region. An outer explode: of an inner one the optimizer would infer a filter, in which
    the whole row-wise job is computed once more."""
    return merged.select("document_id", F.explode_outer("regions").alias("r")).where("r is not null")


def entity_counts(merged: DataFrame) -> DataFrame:
    """AGG-1 as rows: ``(document_id, label, n)``."""
    rows = region_rows(merged)
    return rows.groupBy("document_id", F.regexp_replace(placeholder(F.col("r.entity_type")), r"[\[\]]", "").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def coverage_anomalies(zoned: DataFrame) -> DataFrame:
    """TXT-7: documents in whose masked zones name words survive; counts only."""
    z = [F.when(F.col(n).isNotNull(), rendered(F.col("text"), F.col("regions"), F.col(f"{n}.s"), F.col(f"{n}.e"))) for n in ("anchor", "signature")]
    words = zoned.select("document_id", F.concat_ws("\n", *z).alias("zones"), F.explode(name_words(F.col("names"))).alias("word"))
    left = words.where(F.size(occurrences(F.col("zones"), F.col("word"))) > 0)
    return left.groupBy("document_id").agg(F.count_distinct("word").alias("survivor_count"))


def masked_documents(docs: DataFrame, plugins: tuple = ()) -> DataFrame:
    """The whole job row by row: zones, spans, regions, masking. It needs no join or state, so it runs in a stream too."""
    z = extract_zones(docs)
    spans = F.concat(detected(F.col("text"), None, plugins), anchored(*map(F.col, ("text", "names", "anchor", "signature"))))
    return mask(z.withColumn("_spans", F.coalesce(spans, F.array().cast(f"array<{SPAN}>"))).withColumn("regions", merged(F.col("text"), F.col("_spans"))).drop("_spans"))


def pii_eval(truth: DataFrame, masked: DataFrame) -> DataFrame:
    """AGG-18: ``truth(file, names_must_mask, must_survive)`` against ``masked(file, masked_text)``.

    A name leaks if any of its words is still there as a whole word; a term survives if it is a substring.
    """
    j = truth.join(masked, "file", "left").withColumn("_t", F.coalesce("masked_text", F.lit("")))
    word_left = lambda n: F.exists(F.filter(F.split(n, r"(?U)\s+"), lambda w: (w != "") & ~F.lower(w).isin(*NAME_STOPWORDS)), lambda w: F.size(occurrences(F.col("_t"), w)) > 0)
    j = j.withColumn("names", F.size("names_must_mask")).withColumn("leaked", F.size(F.filter("names_must_mask", word_left)))
    j = j.withColumn("terms", F.size("must_survive")).withColumn("destroyed", F.size(F.filter("must_survive", lambda t: ~F.contains(F.col("_t"), t))))
    totals = j.groupBy(F.col("file").alias("_f")).agg(*(F.sum(c).alias(c) for c in ("names", "leaked", "terms", "destroyed")))
    rolled = totals.rollup("_f").agg(*(F.sum(c).alias(c) for c in ("names", "leaked", "terms", "destroyed")))
    return rolled.select(
        F.col("_f").alias("file"), "names", "leaked", "terms", "destroyed",
        F.try_divide((F.col("names") - F.col("leaked")).cast("double"), F.col("names")).alias("recall"),
        F.try_divide((F.col("terms") - F.col("destroyed")).cast("double"), F.col("terms")).alias("precision"),
    )
