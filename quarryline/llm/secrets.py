"""Secret scan with native expressions: patterns and sliding-window entropy.

Three patterns give the base spans.  The entropy method adds spans of kind
``entropy``: candidate strings are maximal runs of key-like characters with both
letters and digits; over each, a window slides one character at a time.  Its Shannon
entropy is updated by the counts of the character that leaves and of the one that
enters; no window is counted anew.  A window is hot if its entropy reaches the
threshold of the candidate's character class (hexadecimal, or letters of one case, or
mixed); windows that overlap or touch make one span.  Allow-listed candidates, and
spans within a base span, add nothing.

Offsets are code points, end exclusive.  A null text is an empty one.  All of it takes
n log n steps for a text of n matches or characters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import let

#: Fixed values of the base patterns, (kind, expression, checked group, least length).
BASE = (
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", r"([0-9a-f]+)", 1, 16),
)
#: What a text must have for the pattern to give anything; cheap, and true too often at worst.
_NEEDS = {"assign": r"""[DdTtNnYy]["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
#: For kinds whose matches are maximal runs, the least length may stand in the expression itself.
_SCAN = {"access": r"(AKIA[A-Z0-9]{14,})", "hex": r"([0-9a-f]{16,})"}
_CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
_SPAN = "array<struct<start:int,kind:int,stop:int>>"


@dataclass(frozen=True)
class EntropyRule:
    """Window length, least entropy in bits by class, and what is never reported."""

    window: int = 20
    hex_bits: float = 3.0
    one_case_bits: float = 3.5
    mixed_bits: float = 3.7
    allowed: tuple[str, ...] = field(
        default=(
            r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
            r"(?i)example|sample|dummy|placeholder|changeme|x{6}",  # documentation
            r"^[0-9_=+/-]+$",  # numbers and rules
            r"^(/[A-Za-z0-9_-]{1,16}){2,}/?$",  # paths
            r"^\d{4}-\d{2}-\d{2}[-_T]",  # dates
        )
    )


def running(values: Column, combine) -> Column:
    """Prefix sums, or other prefixes of an associative ``combine``, of an array: log n passes over it."""
    strides = F.array(*(F.lit(1 << k) for k in range(31)))

    def double(acc, d):
        def with_earlier(x, i):
            before = F.get(acc, i - d)
            return F.when(before.isNull(), x).otherwise(combine(before, x))

        return F.transform(acc, with_earlier)

    return let(values, lambda v: F.aggregate(F.filter(strides, lambda d: d < F.size(v)), v, double))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _matches(text: Column, pattern: str, whole: int, group: int):
    """Array of (start, stop, found) of the pattern's matches; found is what ``group`` holds.

    ``split`` gives the gaps between the matches that ``regexp_extract_all`` gives,
    so running lengths of both give the offsets.
    """
    pieces = F.struct(
        F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gaps"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(whole)), lambda m: F.length(m)).alias("sizes"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("found"),
    )

    def placed(p):
        stops = running(F.transform(p["sizes"], lambda n, i: F.get(p["gaps"], i) + n), _sum)
        each = F.arrays_zip(stops.alias("stop"), p["sizes"].alias("size"), p["found"].alias("found"))
        return F.transform(each, lambda x: F.struct((x["stop"] - x["size"]).alias("start"), x["stop"].alias("stop"), x["found"].alias("found")))

    return let(pieces, placed)


def _places(text: Column, pattern: str, group: int, whole: int, least: int, kind: int) -> Column:
    """Spans of the matches whose group is long enough."""
    long = F.filter(_matches(text, pattern, whole, group), lambda m: F.length(m["found"]) >= least)
    return F.transform(long, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["stop"].alias("stop")))


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind as listed; kinds are 0 assign, 1 access, 2 hex."""
    none = F.array().cast(_SPAN)
    found = []
    for kind, (name, pattern, group, least) in enumerate(BASE):
        spans = _places(text, _SCAN.get(name, pattern), group, 1, least, kind)
        found.append(F.when(text.rlike(_NEEDS[name]), spans).otherwise(none))
    return F.sort_array(F.concat(*found))


def _plogp(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(F.greatest(count, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))


def hot_stretches(run: Column, rule: EntropyRule) -> Column:
    """(start, stop) of the stretches of a candidate that hot windows cover; stretches that touch are one."""
    w = rule.window
    hex_, mixed = run.rlike("^([0-9a-f]+|[0-9A-F]+)$"), run.rlike("[A-Z]") & run.rlike("[a-z]")
    bits = F.when(hex_, rule.hex_bits).when(mixed, rule.mixed_bits).otherwise(rule.one_case_bits)
    codes = F.transform(F.filter(F.split(run, "", -1), lambda ch: ch != ""), lambda ch: F.ascii(ch))

    def scan(c):
        codes, size = c["codes"], F.size(c["codes"])

        def held(code, at):
            """How often the window from ``at`` holds a character."""
            return F.size(F.filter(F.slice(codes, at + 1, F.lit(w)), lambda x: x == code))

        def change(i):
            """What the step to window i changes of the sum of n log n."""
            out, into = F.get(codes, i - 1), F.get(codes, i + w - 1)
            n = F.struct(held(out, i - 1).alias("out"), held(into, i - 1).alias("into"))
            step = lambda n: _plogp(n["out"] - 1) - _plogp(n["out"]) + _plogp(n["into"] + 1) - _plogp(n["into"])
            return F.when(out == into, 0.0).otherwise(let(n, step))

        # Over the places of the first window, the logarithms of the counts add up to n log n.
        first = F.aggregate(F.slice(codes, 1, w), F.lit(0.0), lambda acc, x: acc + F.log2(held(x, F.lit(0)).cast("double")))
        steps = F.transform(F.sequence(F.lit(0), size - w), lambda i: F.when(i == 0, first).otherwise(change(i)))
        sums = running(steps, _sum)
        enough = F.lit(float(w)) * F.log2(F.lit(float(w))) - c["bits"] * w + 1e-9
        hot = F.filter(F.transform(sums, lambda s, i: F.when(s <= enough, i)), lambda i: i.isNotNull())

        def stretches(h):
            gap = lambda i, j: F.get(h, j) - F.get(h, i) > w
            opens = F.filter(h, lambda x, j: (j == 0) | F.coalesce(gap(j - 1, j), F.lit(False)))
            ends = F.filter(h, lambda x, j: (j == F.size(h) - 1) | F.coalesce(gap(j, j + 1), F.lit(False)))
            return F.zip_with(opens, ends, lambda a, b: F.struct(a.alias("start"), (b + w).alias("stop")))

        return let(hot, stretches)

    return let(F.struct(codes.alias("codes"), bits.alias("bits")), scan)


def entropy_spans(text: Column, base: Column, rule: EntropyRule = EntropyRule()) -> Column:
    """Spans of kind 3 that the entropy method adds to the base spans."""
    none = F.array().cast(_SPAN)

    def wanted(m):
        keep = m["found"].rlike("[0-9]") & m["found"].rlike("[A-Za-z]")
        for pattern in rule.allowed:
            keep = keep & ~m["found"].rlike(pattern)
        return keep

    def as_spans(found):
        return F.transform(F.filter(found, wanted), lambda m: F.struct(m["start"], F.lit(3).alias("kind"), m["stop"], m["found"]))

    def placed(m):
        span = lambda h: F.struct((m["start"] + h["start"]).alias("start"), F.lit(3).alias("kind"), (m["start"] + h["stop"]).alias("stop"))
        return F.transform(hot_stretches(m["found"], rule), span)

    def free(candidates):
        """Candidates within a base span need no look at their entropy."""
        known = F.transform(base, lambda s: F.struct(s["start"], s["kind"], s["stop"], F.lit("").alias("found")))
        return F.when(F.size(candidates) > 0, _beyond(F.concat(known, candidates))).otherwise(candidates)

    hot = F.flatten(F.transform(let(as_spans(_matches(text, _CANDIDATE, 0, 0)), free), placed))
    own = lambda h: F.when(F.size(h) > 0, _beyond(F.concat(base, h))).otherwise(none)
    return F.when(text.rlike(_CANDIDATE) & text.rlike(r"[0-9]"), let(hot, own)).otherwise(none)


def _beyond(spans: Column) -> Column:
    """The spans of kind 3 that end after every base span that starts before them, in order."""

    def left(s):
        # Base spans come before one of kind 3 of the same start.
        reach = running(F.transform(s, lambda x: F.when(x["kind"] < 3, x["stop"]).otherwise(-1)), lambda a, b: F.greatest(a, b))
        each = F.arrays_zip(s.alias("span"), reach.alias("reach"))
        free = F.filter(each, lambda x: (x["span"]["kind"] == 3) & (x["reach"] < x["span"]["stop"]))
        return F.transform(free, lambda x: x["span"])

    return let(F.sort_array(spans), left)


KINDS = ("assign", "access", "hex", "entropy")


def render(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find_secrets(docs: DataFrame, *, text_col: str = "text", rule: EntropyRule = EntropyRule(), out: str = "secrets") -> DataFrame:
    """Adds the struct ``out`` with base_spans and spans (base ones and the method's).

    Every row is scanned by itself, so repeated rows get equal results.  Null and empty
    texts have no spans.  A column of the name ``out`` is replaced, others stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def both(v):
        added = entropy_spans(v["t"], v["b"], rule)
        return F.struct(v["b"].alias("base_spans"), F.sort_array(F.concat(v["b"], added)).alias("spans"))

    return docs.withColumn(out, let(F.struct(text.alias("t"), base_spans(text).alias("b")), both))


def mask(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover, or several that touch, replaced by one ``mark``.

    Pieces are cut from the text as UTF-32, where a place is found without reading what is before it.
    """

    def cut(v):
        spans, data = v["spans"], v["data"]

        def joined(reach):
            fresh = lambda s, i: F.coalesce(s["start"] > F.get(reach, i - 1), F.lit(True))
            opens = F.transform(F.filter(F.transform(spans, lambda s, i: F.struct(fresh(s, i).alias("new"), i.alias("i"))), lambda x: x["new"]), lambda x: x["i"])

            def pieces(o):
                start = lambda j: F.get(spans, F.get(o, j))["start"]
                # A group reaches as far as what was reached before the next one opens.
                end = lambda j: F.get(reach, F.coalesce(F.get(o, j + 1), F.size(spans)) - 1)
                chunk = lambda a, b: _utf32(F.substring(data, a * 4 + 1, (b - a) * 4))
                before = F.transform(o, lambda _, j: F.concat(chunk(F.coalesce(end(j - 1), F.lit(0)), start(j)), F.lit(mark)))
                tail = chunk(end(F.size(o) - 1), (F.octet_length(data) / 4).cast("int"))
                return F.concat(F.array_join(before, ""), tail)

            return let(opens, pieces)

        return let(running(F.transform(spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b)), joined)

    whole = F.struct(spans.alias("spans"), F.encode(text, "UTF-32").alias("data"))
    return F.when(F.size(spans) > 0, let(whole, cut)).otherwise(text)


def _utf32(data: Column) -> Column:
    """Text of UTF-32 bytes; the mark in front keeps a first character that is a byte order mark itself."""
    return F.decode(F.concat(F.unhex(F.lit("0000FEFF")), data), "UTF-32")
