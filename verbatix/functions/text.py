"""Text functions, Column to Column: representations, normalising, tokens, n-grams, cues, labels.

All are built-in expressions, so they stay inside generated code. White space is Unicode's, word borders are ASCII's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CONDEMN = ["mat", "mt", "nahi", "nai", "galat", "band", "बंद", "personal", "attack", "sahi", "jaisi", "jaise", "type", "lafz", "wajah"]
REPORT = ["bol", "diya", "likh", "kehke", "kehna", "btate", "comment", "likha", "dekh"]
TEMPLATE_SUBJECTS = ["ladkiyon", "ladkion", "ladki", "larkiyan", "larki", "aurton", "aurat", "mahilaon", "mahila", "women", "woman", "girls", "girl"]
RULE_SUBJECTS = ["ladki", "ladkiyon", "aurat", "mahila", "women", "girl", "larki", "woman"]
TOKEN = r"\[(?:FSLUR|CTX)_\d+\]"
FAMILY_TOKEN = r"\[([A-Z]+)_(\d+)\]"
PUNCTUATION = r"""[।.,!?;:"'()\[\]{}]"""

REPRESENTATIONS = ("raw", "masked", "stripped", "mask-distinct")


def whole_word(words: list[str]) -> str:
    """A pattern for any of the words between ASCII word borders."""
    return r"(?<![A-Za-z0-9_])(?:" + "|".join(words) + r")(?![A-Za-z0-9_])"


def represent(text: Column, mode: str) -> Column:
    """A text with its redaction tokens left, masked, cut out, or masked by family."""
    if mode == "raw":
        return text
    if mode == "masked":
        return F.regexp_replace(text, TOKEN, "<RDW>")
    if mode == "stripped":
        return F.regexp_replace(text, TOKEN + r"(?U)\s*", " ")
    if mode == "mask-distinct":
        return F.regexp_replace(F.regexp_replace(text, r"\[FSLUR_\d+\]", "<FSLUR>"), r"\[CTX_\d+\]", "<CTX>")
    raise ValueError(f"unknown representation {mode!r}; one of {', '.join(REPRESENTATIONS)}")


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """Lower case without punctuation, words one space apart."""
    return squeezed(F.regexp_replace(F.lower(text), PUNCTUATION, " "))


def word_tokens(text: Column) -> Column:
    """The words of the normalised text."""
    return F.filter(F.split(normalize(text), " "), lambda w: w != "")


def white_tokens(text: Column) -> Column:
    """What stands between white space, as it is."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _grams(items: Column, n: int, prefix: str, between: str) -> Column:
    # items are taken one by one: slice() copies the whole array at each place
    at = lambda i: F.concat(F.lit(prefix), F.concat_ws(between, *[F.get(items, i + k) for k in range(n)]))
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(0), F.size(items) - n), at)).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's free expressions are computed anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_ngrams(text: Column, least: int, most: int) -> Column:
    """Bag of w<n>:a_b features."""
    of = lambda words: F.concat(*[_grams(words, n, f"w{n}:", "_") for n in range(least, most + 1)])
    return let(word_tokens(text), of)


def char_ngrams(text: Column, least: int, most: int) -> Column:
    """Bag of c<n>: features of the normalised text with a space at each end; inner spaces show as _."""
    padded = F.translate(F.concat(F.lit(" "), normalize(text), F.lit(" ")), " ", "_")
    letters = F.filter(F.split(padded, ""), lambda c: c != "")  # an array: the n-th character of a string is found by walking to it
    of = lambda c: F.concat(*[_grams(c, n, f"c{n}:", "") for n in range(least, most + 1)])
    return let(letters, of)


def features(text: Column, word: tuple[int, int] | None = None, char: tuple[int, int] | None = None) -> Column:
    """Word and character features in one bag."""
    bags = ([word_ngrams(text, *word)] if word else []) + ([char_ngrams(text, *char)] if char else [])
    return F.concat(*bags) if bags else F.array().cast("array<string>")


def template_id(text: Column, drop_punctuation: bool = True) -> Column:
    """A text with tokens and subject words abstracted: the group key of disjoint folds; the profile keeps punctuation."""
    s = F.lower(F.regexp_replace(text, TOKEN, "<TOK>"))
    s = F.regexp_replace(s, whole_word(TEMPLATE_SUBJECTS), "<SUBJ>")
    return squeezed(F.regexp_replace(s, "[।.,!?]", "") if drop_punctuation else s)


def construction_group(category: Column, frame_id: Column) -> Column:
    """UC: (use and counter), IB: (implicit and overlap) or BN: (neutral) with what follows the frame's colon."""
    kind = F.when(category.isin("USE_SLUR", "COUNTER"), "UC:").when(category.isin("IMPLICIT", "BENIGN_OVERLAP"), "IB:").otherwise("BN:")
    return F.concat(kind, F.split_part(frame_id, F.lit(":"), F.lit(2)))


def cues(text: Column) -> Column:
    """CND: and REP: features of the cue words present, then HAS_CONDEMN and HAS_REPORT."""
    none = F.array().cast("array<string>")

    def of(words: Column) -> Column:
        found = [F.array_compact(F.array(*[F.when(F.array_contains(words, w), F.lit(kind + w)) for w in listed])) for kind, listed in (("CND:", CONDEMN), ("REP:", REPORT))]
        has = [F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in listed])), F.array(F.lit(name))).otherwise(none) for listed, name in ((CONDEMN, "HAS_CONDEMN"), (REPORT, "HAS_REPORT"))]
        return F.concat(*found, *has)

    return let(word_tokens(text), of)


def cue_text(text: Column) -> Column:
    """The cue features as a text, NONE where there are none."""
    return F.coalesce(F.nullif(F.array_join(cues(text), " "), F.lit("")), F.lit("NONE"))


def coerce_prediction(raw: Column) -> Column:
    """MGY if it stands anywhere in any case, else NOT."""
    return F.when(F.contains(F.upper(F.coalesce(raw, F.lit(""))), F.lit("MGY")), "MGY").otherwise("NOT")


def parse_label(raw: Column) -> Column:
    """A model's answer: the first LABEL line, else the last three words if they name one label, else the label named last."""
    up = F.upper(F.coalesce(raw, F.lit("")))
    line = F.regexp_extract(up, r"(?U)LABEL:\s*(MGY|NOT)", 1)
    words = F.split(F.trim(F.regexp_replace(up, r"(?U)\s+", " ")), " ")
    tail = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 2), F.lit(3)), " ")
    mgy, no = tail.rlike(whole_word(["MGY"])), tail.rlike(whole_word(["NOT"]))
    last = lambda label: F.when(F.contains(up, F.lit(label)), F.length(up) - F.instr(F.reverse(up), label[::-1])).otherwise(-1)
    return F.when(line != "", line).when(mgy & ~no, "MGY").when(no & ~mgy, "NOT").when(last("MGY") > last("NOT"), "MGY").otherwise("NOT")
