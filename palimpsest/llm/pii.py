r"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score.

All of it is column expressions. split() and regexp_extract_all() cut a text at the same matches, so the lengths of the
gaps and of the matches give each match's place in code points; they are added up in two levels, so a text's cost grows with its length and not with the square of its matches.
A look-behind with `\G` starts an email only where a run of its characters starts or where the last match ended; this changes no match, but a long run is read once.

Base kinds and rules: see KINDS. The method adds `iban` (mod-97 over the rearranged account number) and `ssn` (no checksum). Score: 0.5 for a match, 0.4 more for a passed checksum (an IBAN's counts 0.2 if its
country's length is not known or another), 0.3 more for a context word within CONTEXT characters before or after it; an added span counts from THRESHOLD on. So an ssn needs a context word, and an IBAN of no known form does. Base spans always stay.

Nulls: a null text counts as empty, and its spans are an empty array. Very long texts are read whole. Repeated rows and ties give equal results;
spans of different kinds may overlap, and are ordered by start, then kind, then end. Other columns pass through `find_spans` (but `pii` is replaced) and `redact`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTEXT, THRESHOLD = 40, 0.75
_MAIL = "A-Za-z0-9._%+-"
#: kind -> pattern, in the order of the contract, added kinds last.
KINDS = {
    "email": rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this can have no match; a cheap search spares the pattern.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
WORDS = {"iban": r"(?i)\b(iban|account|konto|cuenta|compte|bank)\b", "ssn": r"(?i)\b(ssn|social security|social-security)\b"}
#: Characters of an IBAN by country (ISO 13616): fixed values.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24}
ORDER = list(KINDS)
#: Code points in a piece of a text that redact() cuts from.
PIECE = 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each item the struct (x: the item, before: what add() makes of zero and all items before it).

    An accumulator that holds an array is copied at every step, so this goes by about the square root of the items at a time; add() must be associative over parts, as sums and maxima are:
    add(state, item) for items, and a part's state is what it gives from the state at the part's begin.
    """

    def whole(all_: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(all_))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.size(all_) - 1, step), lambda at: F.slice(all_, at + 1, step))

        def along(part: Column, start: Column) -> Column:
            first = F.struct(start.alias("at"), F.filter(F.transform(part, lambda x: F.struct(x.alias("x"), start.alias("before"))), lambda x: F.lit(False)).alias("out"))
            return F.aggregate(part, first, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(F.struct(x.alias("x"), acc["at"].alias("before")))).alias("out")))["out"]

        begins = F.aggregate(
            parts,
            F.struct(zero.alias("at"), F.filter(F.array(zero), lambda x: F.lit(False)).alias("out")),
            lambda acc, part: F.struct(F.aggregate(part, acc["at"], add).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )["out"]
        return F.flatten(F.zip_with(parts, begins, along))

    nothing = F.transform(F.slice(items, 1, 0), lambda x: F.struct(x.alias("x"), zero.alias("before")))
    return let(items, lambda all_: F.when(F.size(all_) > 0, whole(all_)).otherwise(nothing))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _mod97(plain: Column) -> Column:
    """The remainder that IBANs have at 1: the first four characters go last, letters count from 10."""
    moved = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    value = lambda ch: F.when(ch.between("0", "9"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55)
    return F.aggregate(F.split(moved, "(?<=.)(?=.)"), F.lit(0), lambda acc, ch: F.when(value(ch) > 9, acc * 100 + value(ch)).otherwise(acc * 10 + value(ch)) % 97)


def _sound(kind: str, match: Column) -> Column:
    """What a match must meet besides the pattern."""
    n = F.length(_digits(match))
    if kind == "ip":
        # Leading zeros are no part of a value; more than three significant digits are over 255.
        plain = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda x: (F.length(plain(x)) == 0) | ((F.length(plain(x)) <= 3) & (F.left(plain(x), F.lit(3)).try_cast("int") <= 255)))
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", F.when(n.between(12, 19), _digits(match)))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return let(F.regexp_replace(match, " ", ""), lambda plain: F.length(plain).between(15, 34) & (_mod97(plain) == 1))
    return F.lit(True)


def _score(kind: str, match: Column, near: Column) -> Column:
    """The score of a sound match; near: whether a context word is."""
    score = F.lit(0.5)
    if kind == "card":
        score = F.lit(0.9)
    if kind == "iban":
        lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
        known = F.coalesce(F.element_at(lengths, F.left(match, F.lit(2))) == F.length(F.regexp_replace(match, " ", "")), F.lit(False))
        score = F.when(known, 0.9).otherwise(0.7)
    return score + F.when(near, 0.3).otherwise(0.0)


def _near(kind: str, all_: Column, i: Column) -> Column:
    """Whether a context word is within CONTEXT characters of match i; all_: (gap, hit) in order. An added kind's match has 11 characters or more, so four matches to a side reach that far."""
    cells = lambda at: F.when((at >= 0) & (at < F.size(all_)), F.get(all_, at))
    side = F.lit(CONTEXT)
    before = F.right(F.concat(*[F.concat(F.right(F.coalesce(cells(i - k)["gap"], F.lit("")), side), F.lit("") if not k else F.coalesce(cells(i - k)["hit"], F.lit(""))) for k in (4, 3, 2, 1, 0)]), side)
    after = F.left(F.concat(*[F.concat(F.lit("") if k == 1 else F.coalesce(cells(i + k - 1)["hit"], F.lit("")), F.left(F.coalesce(cells(i + k)["gap"], F.lit("")), side)) for k in (1, 2, 3, 4, 5)]), side)
    return before.rlike(WORDS[kind]) | after.rlike(WORDS[kind])


def _spans(kind: str, text: Column) -> Column:
    pattern, added, rank = F.lit(KINDS[kind]), kind in WORDS, ORDER.index(kind)
    empty = F.expr("cast(array() as array<struct<start: int, rank: int, end: int, score: double>>)")
    # The gap after the last match comes with no hit.
    pairs = F.zip_with(F.split(text, KINDS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))

    def judged(all_: Column) -> Column:
        one = lambda x, i: F.struct(
            F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["hit"]), F.lit(0)).alias("hit"),
            F.coalesce(x["hit"].isNotNull() & _sound(kind, x["hit"]), F.lit(False)).alias("sound"),
            F.when(x["hit"].isNotNull(), _score(kind, x["hit"], _near(kind, all_, i) if added else F.lit(False))).alias("score"),
        )
        return F.transform(all_, one)

    placed = running(let(pairs, judged), F.lit(0), lambda at, x: at + x["gap"] + x["hit"])
    kept = F.filter(placed, lambda p: p["x"]["sound"] & ((p["x"]["score"] >= THRESHOLD) if added else F.lit(True)))
    spans = F.transform(kept, lambda p: F.struct((p["before"] + p["x"]["gap"]).alias("start"), F.lit(rank).alias("rank"), (p["before"] + p["x"]["gap"] + p["x"]["hit"]).alias("end"), p["x"]["score"].alias("score")))
    possible = text.rlike(KINDS[kind]) if kind not in NEEDS else text.contains(NEEDS[kind]) & text.rlike(KINDS[kind])
    return F.when(possible, spans).otherwise(empty)


def spans_of(text: Column) -> Column:
    """An array of (start, rank, end, score), by start, then kind, then end; the kind is ORDER[rank]."""
    t = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_spans(k, t) for k in KINDS]))


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `pii`, what spans_of() gives."""
    return docs.withColumn("pii", spans_of(F.col(text)))


def _digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cleaned(text: Column, spans: Column) -> Column:
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ORDER])
    # A span is free that starts after all before it have ended.
    free = F.filter(running(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"])), lambda p: p["x"]["start"] >= p["before"])

    def put(pieces: Column) -> Column:
        def part(low: Column, high: Column) -> Column:
            """Code points low to high: cut from the pieces that hold them, since substr() walks from where it begins."""
            a, b = F.floor(low / PIECE).cast("int"), F.floor(high / PIECE).cast("int")
            return F.substr(F.array_join(F.slice(pieces, a + 1, b - a + 1), ""), low - a * PIECE + 1, high - low)

        def all_(chosen: Column) -> Column:
            # What overlaps a chosen span goes with it, so its text ends where the last of them does.
            ends = F.concat(F.array(F.lit(0)), F.transform(F.slice(chosen, 2, F.size(chosen)), lambda p: p["before"]), F.array(F.array_max(F.transform(spans, lambda s: s["end"]))))
            starts = F.concat(F.transform(chosen, lambda p: p["x"]["start"]), F.array(F.length(text)))
            marks = F.concat(F.transform(chosen, lambda p: F.element_at(names, p["x"]["rank"] + 1)), F.array(F.lit("")))
            return F.array_join(F.transform(F.arrays_zip(ends.alias("e"), starts.alias("s"), marks.alias("m")), lambda x: F.concat(part(x["e"], x["s"]), x["m"])), "")

        return let(free, all_)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), put)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs whose text has [KIND] in place of personal data; spans that overlap become one mark, that of the first that starts (of equals, the first kind of ORDER).

    Columns stay as they are; a null text stays null.
    """
    t = F.col(text)
    return docs.withColumn(text, let(spans_of(t), lambda s: F.when(F.size(s) > 0, _cleaned(t, s)).otherwise(t)))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_spans(docs)
    count = lambda kind: F.size(F.filter("pii", lambda s: s["rank"] == ORDER.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["rank"] < 4)
    return found.select("doc_id", *[count(k) for k in ORDER[:4]], F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("pii")).alias("spans"))
