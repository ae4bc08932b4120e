"""Secrets in texts: patterns of known forms, and runs of high sliding-window entropy."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from spandoc.functions.text import running_offsets


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The forms of the patterns.  A failing assignment still uses up its characters, so
# its length is checked afterwards; for the other two a minimum in the pattern says the same.
_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

# Entropy: candidate runs, window in characters, bits a window must reach per character class.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
HEX_CLASS, HEX_BITS, OTHER_BITS = "^[0-9a-fA-F]+$", 3.05, 3.65
# Candidates that are known not to be secrets: identifiers, runs of the alphabet, placeholders, paths.
ALLOWED = (
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "(?i:abcdefghijklmno)", "0123456789", "(?i:example|placeholder|xxxx)",
    "^/?([a-z0-9_-]+/){3,}", "^[A-Za-z]*$", "^[0-9+/_=-]*$",
)
# Whole runs on that list are what the oracle leaves out.  Here its words and the signs of paths only end a run, so that
# what stands beside them is a run of its own: blanked words, and the slashes of three or more lower-case names.
WORDS = (("(?i:abcdefghijklmno)", 15), ("0123456789", 10), ("(?i:example)", 7), ("(?i:placeholder)", 11))
PATH = r"(?:(?<![A-Za-z0-9+/_=-])(?=/?(?:[a-z0-9_-]+/){3})(/?)|\G(?!\A))([a-z0-9_-]+)/"
BLANK = "\x02"
RUN_ALLOWED = (ALLOWED[0], *ALLOWED[-2:])
FILLER = "(?i:xxxx)"  # in the dense part
NAME = "^[a-z]+([_-][a-z]+)*$"  # in a path


def _marked(text: Column, pattern: str) -> Column:
    """``text`` cut around the matches of ``pattern``: odd places (from 0) are matches, even ones what lies between."""
    return F.split(F.regexp_replace(text, pattern, "\x01$0\x01"), "\x01")


def _matches(df: DataFrame, name: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds array ``name`` of (start, stop, piece) per match, in code points, ``stop`` exclusive."""
    parts, sizes, offsets = (f"{name}_{x}" for x in ("parts", "sizes", "offsets"))
    df = df.withColumn(parts, _marked(F.col(text), pattern))
    df = df.withColumn(sizes, F.transform(parts, F.length))
    df = df.withColumn(offsets, F.when(F.size(parts) > 1, running_offsets(F.col(sizes))))
    odd = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
    found = F.transform(odd, lambda i: F.struct(
        F.get(F.col(offsets), i).alias("start"), (F.get(F.col(offsets), i) + F.get(F.col(sizes), i)).alias("stop"),
        F.get(F.col(parts), i).alias("piece")))
    none = F.array().cast("array<struct<start:bigint,stop:bigint,piece:string>>")
    return df.withColumn(name, F.when(F.size(parts) > 1, found).otherwise(none)).drop(parts, sizes, offsets)


def _dense_part(piece: Column) -> Column:
    """(lo, hi) of the characters of ``piece`` from the first to the last window of high entropy; lo is -1 if none.

    With counts c of the window's characters the entropy is log2(w) - sum(c log2 c) / w; a step of the window
    changes two counts and the two terms of the sum that belong to them.
    """
    term = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    symbols = F.lit(SYMBOLS)
    limit = F.when(piece.rlike(HEX_CLASS), F.lit(HEX_BITS)).otherwise(F.lit(OTHER_BITS))

    def code(i: Column) -> Column:
        return F.when(i < 1, 0).otherwise(F.position(F.substring(piece, i, F.lit(1)), symbols))

    start = F.struct(
        F.array_repeat(F.lit(0), len(SYMBOLS) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))

    def move(was: Column, step: Column) -> Column:
        i, new, old = step["i"], step["new"], step["old"]
        same = new == old
        gone, come = F.get(was["counts"], old), F.get(was["counts"], new)
        total = was["sum"] + F.when(same, 0.0).otherwise(
            F.get(term, come + 1) - F.get(term, come)
            + F.when(old > 0, F.get(term, gone - 1) - F.get(term, gone)).otherwise(0.0))
        counts = F.transform(was["counts"], lambda c, k: c + F.when(k == new, 1).otherwise(0) - F.when(
            (k == old) & (old > 0), 1).otherwise(0))
        high = (i >= WINDOW) & (F.lit(log2(WINDOW)) - total / WINDOW >= limit)
        return F.struct(
            counts.alias("counts"), total.alias("sum"),
            F.when(high & (was["lo"] < 0), i - WINDOW).otherwise(was["lo"]).alias("lo"), F.when(high, i).otherwise(was["hi"]).alias("hi"))

    steps = F.transform(F.sequence(F.lit(1), F.length(piece)), lambda i: F.struct(
        i.alias("i"), code(i).alias("new"), code(i - WINDOW).alias("old")))
    return F.aggregate(steps, start, move, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))


def secret_spans(entities: DataFrame) -> DataFrame:
    """Spans of every text that look like secrets.

    ``entities`` has ``entity_id`` and ``text``; other columns are ignored.  Returns per input row entity_id
    and spans, an array of (start_at, end_at, label) in code points with inclusive ends, ordered by start and then
    by kind: ``assign`` (a name like password, a sign, a value of 6 characters or more), ``access`` (AKIA keys),
    ``hex`` (24 digits or more) and ``entropy``: the part of a long run of key characters whose windows of
    20 characters have high entropy for their character class, unless it is on the allow list or
    lies inside one of the other spans.  Known words and the slashes of a path end a run.  Null and empty texts have no spans.
    """
    # A mark that no pattern can match takes the place of the sign that cuts the texts.
    df = entities.select("entity_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\x01"), F.lit("\x02")).alias("text"))
    split = F.col("text")
    for word, size in WORDS:
        split = F.regexp_replace(split, word, BLANK * size)
    df = df.withColumn("split", F.regexp_replace(split, PATH, f"$1$2{BLANK}"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        df = _matches(df, name, pattern)
    df = _matches(df, "runs", CANDIDATE, "split")
    value = lambda m: F.length(F.regexp_extract(m["piece"], ASSIGN, 2))
    df = df.withColumn("assign", F.filter("assign", lambda m: value(m) >= 6))

    def allowed(m: Column) -> Column:
        before = F.col("split").substr(m["start"].cast("int"), F.lit(1))
        hit = m["piece"].rlike(NAME) & (m["start"] > 0) & (before == BLANK)
        for p in RUN_ALLOWED:
            hit = hit | m["piece"].rlike(p)
        return hit

    def filler(m: Column) -> Column:
        at = m["at"]
        return m["piece"].substr(at["lo"] + 1, at["hi"] - at["lo"]).rlike(FILLER)

    df = df.withColumn("parts", F.transform(F.filter("runs", lambda m: ~allowed(m)), lambda m: F.struct(
        m["start"].alias("start"), m["piece"].alias("piece"), _dense_part(m["piece"]).alias("at"))))

    def spans(name: str) -> Column:
        return F.transform(name, lambda m: F.struct(
            m["start"].alias("start_at"), F.lit(KINDS.index(name)).alias("kind"), (m["stop"] - 1).alias("end_at")))

    df = df.withColumn("base", F.concat(spans("assign"), spans("access"), spans("hex")))
    dense = F.transform(F.filter("parts", lambda m: (m["at"]["lo"] >= 0) & ~filler(m)), lambda m: F.struct(
        (m["start"] + m["at"]["lo"]).alias("start_at"), F.lit(3).alias("kind"), (m["start"] + m["at"]["hi"] - 1).alias("end_at")))
    df = df.withColumn("more", F.filter(dense, lambda m: ~F.exists("base", lambda s: (s["start_at"] <= m["start_at"]) & (
        s["end_at"] >= m["end_at"]))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return df.select("entity_id", F.transform(F.array_sort(F.concat("base", "more")), lambda s: F.struct(
        s["start_at"].alias("start_at"), s["end_at"].alias("end_at"), F.get(names, s["kind"]).alias("label"))).alias("spans"))
