"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by containment.

All work is local to a row, so nothing is shuffled whatever the rows are. A text is normalised once
to lower-case words parted by one space; the rules run only where one of their keywords stands.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursebeacon.llm.license_rules import Rule
from coursebeacon.llm.license_rules import rules as signature_rules
from coursebeacon.llm.words import unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is not in a word, before A-Z is lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Marks a start and an end; neither can stand in a word.
START, END = "\u0001", "\u0002"
PRIORITIES = (1, 2, 3, 4)
PLACES = "array<struct<start:int,label:string>>"
ADDED = ("n_words", "base", "detections")


def word_text(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the A-Z lower-cased text, each after a space."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " ")
    return F.translate(F.concat(F.lit(" "), F.trim(spaced), F.lit(" ")), UPPER, LOWER)


def _placed(norm: Column, pattern: Column) -> Column:
    """Array of (start, end): the words at which matches of the pattern start and end."""
    marked = F.regexp_replace(norm, pattern, F.lit(f"{START}$0{END}"))
    words = F.split(marked, " ")
    at = lambda test: F.filter(
        F.transform(words, lambda w, i: F.when(test(w), i - 1)), lambda i: i.isNotNull()
    )
    starts, ends = at(lambda w: w.startswith(START)), at(lambda w: w.endswith(END))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))  # matches do not overlap


def _bounded(pattern: str) -> str:
    return rf"(?<= )(?:{pattern})(?= )"


def base_places(norm: Column, phrases: dict[str, str]) -> Column:
    """Array of (start, label) of every place where a phrase's words stand, overlapping ones too."""

    def places_of(phrase: str, label: str) -> Column:
        words = F.split(F.regexp_replace(norm, rf"(?<= )(?=\Q{phrase}\E )", START), " ")
        places = F.filter(
            F.transform(words, lambda w, i: F.when(w.startswith(START), i - 1)), lambda i: i.isNotNull()
        )
        labelled = F.transform(places, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))
        return F.when(norm.contains(f" {phrase} "), labelled).otherwise(F.array().cast(PLACES))

    return F.concat(*[places_of(*item) for item in phrases.items()])


DETECTION = "struct<start:int,length:int,priority:int,rule:int,label:string,confidence:double>"


def _detections(norm: Column, rules: list[Rule]) -> Column:
    """All matches of all rules, in the order of suppression."""
    table = F.array(*[
        F.struct(
            F.lit(label).alias("label"), F.lit(f" {keyword}").alias("keyword"),
            F.lit(f" {also}" if also else "").alias("also"), F.lit(priority).alias("priority"),
            F.lit(confidence).alias("confidence"), F.lit(_bounded(pattern)).alias("pattern"), F.lit(i).alias("rule"),
        )
        for i, (label, keyword, also, priority, confidence, pattern) in enumerate(rules)
    ])
    open_rules = F.filter(table, lambda r: F.contains(norm, r["keyword"]) & F.contains(norm, r["also"])
        & F.rlike(norm, r["pattern"]))
    each = F.transform(open_rules, lambda r: F.transform(
        _placed(norm, r["pattern"]), lambda p: F.struct(
            p["start"].alias("start"), (p["start"] - p["end"] - 1).alias("length"), (-r["priority"]).alias("priority"),
            r["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence"),
        )
    ))
    return F.array_sort(F.flatten(each))  # by start, longest, highest priority, earliest rule


def _resolved(found: Column) -> Column:
    """Without the detections that lie inside one of at least their priority found before them.

    One pass in the order of ``_detections``: whatever can contain a detection comes before it, so
    the largest end so far among detections of its priority or more decides. ``found`` is a column, not
    an expression, as it is cut into blocks: as many as each has detections, so that what is kept is
    copied for each block and each detection of a block, not for each detection of the text.
    """
    none = F.array().cast(f"array<{DETECTION}>")

    def state_of(ends: Column, kept: Column) -> Column:
        return F.struct(ends.alias("ends"), kept.alias("kept"))

    def step(state: Column, d: Column) -> Column:
        end, level = d["start"] - d["length"], -d["priority"]
        inside = F.element_at(state["ends"], level) >= end
        ends = F.transform(
            state["ends"], lambda e, i: F.when(i < level, F.greatest(e, end)).otherwise(e)
        )
        return state_of(ends, F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], F.array(d))))

    def block_step(state: Column, block: Column) -> Column:
        own = F.aggregate(block, state_of(state["ends"], none), step)
        return state_of(own["ends"], F.concat(state["kept"], own["kept"]))

    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(found))).cast("int"))
    firsts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(found)), width)
    blocks = F.transform(firsts, lambda i: F.slice(found, i, width))
    start = state_of(F.array(*[F.lit(-1)] * len(PRIORITIES)), none)
    return F.aggregate(blocks, start, block_step, lambda s: s["kept"])


def license_scan(
    docs: DataFrame, text_col: str = "text", phrases: dict[str, str] | None = None,
    rules: list[Rule] | None = None,
) -> DataFrame:
    """All rows of ``docs`` with n_words, base (places of the phrases) and detections added.

    ``detections`` are the matches of the rules after suppression, in text order: first_word,
    last_word, label, confidence, rule. A null text has no words. Rows are judged one by one, so
    null or repeated ids do not matter, and an empty table gives an empty result. Columns of
    ``docs`` named like the added ones are replaced.
    """
    rules = rules if rules is not None else signature_rules()
    phrases = phrases or {}
    names = [c for c in docs.columns if c not in ADDED]
    norm_name = unused([*names, *ADDED])
    norm, matches = F.col(norm_name), F.col(norm_name + "_found")
    needed = sorted({also or keyword for _, keyword, also, *_ in rules})
    gate = reduce(lambda a, b: a | b, [norm.contains(word) for word in needed], F.lit(False))
    none = F.array().cast(f"array<{DETECTION}>")
    # each of the two is made once per row and then used as a column, also where it is used many times
    own = [docs[f"`{c}`"] for c in names]
    rows = docs.select(*own, F.inline(F.array(F.struct(word_text(docs[f"`{text_col}`"]).alias(norm_name)))))
    found = F.when(gate, _detections(norm, rules)).otherwise(none)
    rows = rows.select("*", F.inline(F.array(F.struct(found.alias(norm_name + "_found")))))
    detections = F.transform(F.when(F.size(matches) > 0, _resolved(matches)).otherwise(none), lambda d: F.struct(
        d["start"].alias("first_word"), (d["start"] - d["length"] - 1).alias("last_word"), d["label"].alias("label"),
        d["confidence"].alias("confidence"), d["rule"].alias("rule"),
    ))
    words = F.char_length(norm) - F.char_length(F.replace(norm, F.lit(" "), F.lit(""))) - 1
    return rows.select(
        *[F.col(f"`{c}`") for c in names],
        F.when(norm == "  ", F.lit(0)).otherwise(words).cast("long").alias("n_words"),
        (base_places(norm, phrases) if phrases else F.array().cast(PLACES)).alias("base"),
        detections.alias("detections"),
    )
