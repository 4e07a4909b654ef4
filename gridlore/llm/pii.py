r"""PII (2): patterns propose spans, checksums confirm them, context adjusts the score.

Everything is a projection of built-in functions over the whole text: no Python on
the executors, no shuffle.  Positions come from ``split`` and ``regexp_extract_all``
with one pattern: the parts between the matches and the matches alternate, so running
lengths (code points) give every start.  The sums run in blocks, as an array grows by
copying it, so a text with very many matches costs little more than its length.

Base kinds (always returned when their own check passes): ``email``, ``ip`` (each part
at most 255), ``card`` (12 to 19 digits, Luhn), ``phone`` (9 to 15 digits).  Further
kinds, returned when their score reaches ``MIN_SCORE``: ``iban`` (mod-97),
``national_id`` (ddd-dd-dddd) and ``secret`` (a run of 20 or more key characters, confirmed by
digits, letters and an entropy of ``MIN_ENTROPY`` bits a character).  Words near a span, in the ``NEAR``
code points between it and its neighbours of the same kind, raise its score.

The patterns match what the plain ones in the comments match, leftmost and
non-overlapping; possessive repeats and the look-behind only keep a long run of
characters from being tried again from each of its places.

Defined cases: a null text is empty and has no spans; a null doc_id is carried;
repeated rows are searched each; very long texts are searched whole; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

NEAR = 40  # code points of context on each side
MIN_SCORE = 0.5
MIN_ENTROPY = 3.0
RUN = 256  # lengths summed at a time


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # Java
    gate: str  # a text that doesn't match this has no such span
    score: float  # before context
    confirmed: float  # added by a checksum
    context: str  # words that add NEAR_SCORE
    base: bool = True


#: Lengths of the countries' account numbers.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
                22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
                26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
                30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban_pattern() -> str:
    """A country's own length if it fits, else any length, which may run on into later words."""
    def groups(n: int) -> str:
        return r"(?:\x20?[A-Z0-9]{4}){%d}" % (n // 4) + (r"\x20?[A-Z0-9]{%d}" % (n % 4) if n % 4 else "")

    own = "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}{groups(n - 4)}(?![A-Za-z0-9])" for n, names in IBAN_LENGTHS.items())
    return rf"(?<![A-Za-z0-9])(?:{own}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))"


NEAR_SCORE = 0.3
RULES = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Rule("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, 0.0,
         "mail|contact|write|reach"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Rule("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, 0.0, "ip|host|server|address"),
    # [0-9]([\x20-]?[0-9])+
    Rule("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?+[0-9]){11}", 0.3, 0.4, "card|visa|credit|payment"),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, 0.0, "phone|call|tel|mobile|fax"),
    Rule("iban", _iban_pattern(), r"[A-Z]{2}[0-9]{2}", 0.1, 0.5, "iban|bank|account|transfer", False),
    Rule("national_id", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         0.3, 0.0, "ssn|social|security|national", False),
    Rule("secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])",
         r"[0-9](?:[A-Za-z0-9+/_-]{10}|(?<=[A-Za-z0-9+/_-]{11}))",  # one of twenty characters has ten on one side
         0.1, 0.2, "token|secret|passw|pwd|credential|bearer|authori|api.?key|access.?key|private.?key", False),
)
BASE = tuple(r.kind for r in RULES if r.base)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(F.split(F.reverse(digits), "", -1),
                          lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                              c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN (blanks allowed) leaves 1 modulo 97."""
    plain = F.regexp_replace(account, "\x20", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = F.transform(F.split(turned, "", -1), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda s, v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, "\x20", "")).between(15, 34) & mod97(match)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (entropy(match) >= MIN_ENTROPY)
    return F.lit(True)


def entropy(match: Column) -> Column:
    """Bits a character, by the frequencies of a string's own characters."""
    def bits(chars: Column) -> Column:
        shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
        return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))

    return let(F.split(match, "", -1), lambda parts: bits(F.filter(parts, lambda x: x != "")))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def longest_account(match: Column) -> Column:
    """The longest run of whole groups from the match's start that is an IBAN, else the match."""
    groups = F.split(match, "\x20")
    runs = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, 1, n), " "))
    return F.coalesce(F.get(F.filter(runs, lambda r: _valid("iban", r)), F.lit(0)), match)


def _running(lengths: Column, base: Column) -> Column:
    """base + the sum of the lengths before each."""
    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    return F.aggregate(lengths, F.struct(base.alias("at"), F.expr("cast(array() as array<int>)").alias("out")), step)["out"]


def starts_of(lengths: Column) -> Column:
    """Running sums of an array of lengths, each before its own: by blocks of ``RUN``, then within each."""
    last = F.greatest(F.floor((F.size(lengths) - 1) / RUN), F.lit(0)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(lengths, b * RUN + 1, F.lit(RUN)))

    def within(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda s, n: s + n))
        return let(_running(totals, F.lit(0)), lambda bases: F.flatten(F.transform(blocks, lambda x, i: _running(x, F.get(bases, i)))))

    return let(blocks, within)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, hit, before, after>> of a pattern's matches; before and after are the text beside it."""
    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def place(m: Column) -> Column:
        gaps, hits = m["gaps"], m["hits"]
        lengths = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))
        return let(let(lengths, starts_of), lambda starts: F.transform(hits, lambda h, i: F.struct(
            (F.get(starts, i) + F.length(F.get(gaps, i))).alias("start"), h.alias("hit"), F.right(F.get(gaps, i), F.lit(NEAR)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(NEAR)).alias("after"))))

    return let(cut, place)


def _gate(text: Column, rule: Rule) -> Column:
    return text.contains(rule.gate) if rule.gate == "@" else text.rlike(rule.gate)


def _score(rule: Rule, before: Column, after: Column) -> Column:
    near = F.lower(F.concat_ws("\n", before, after))
    score = F.lit(rule.score + rule.confirmed) + F.when(near.rlike(rule.context), NEAR_SCORE).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 2)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, kind, end, text, score>> of one rule's confirmed spans."""
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,text:string,score:double>>)")

    def trimmed(x: Column) -> Column:
        """The match as the account number it begins with; what is cut off is context."""
        hit = longest_account(x["hit"])
        rest = F.concat(F.substr(x["hit"], F.length(hit) + 1), x["after"])
        return F.struct(x["start"].alias("start"), hit.alias("hit"), x["before"].alias("before"), F.left(rest, F.lit(NEAR)).alias("after"))

    def finish(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (x["start"] + F.length(x["hit"])).alias("end"),
                        x["hit"].alias("text"), _score(rule, x["before"], x["after"]).alias("score"))

    placed = located(text, rule.pattern)
    if rule.kind == "iban":
        placed = F.transform(placed, trimmed)
    found = F.transform(F.filter(placed, lambda x: _valid(rule.kind, x["hit"])), finish)
    if not rule.base:
        found = F.filter(found, lambda x: x["score"] >= MIN_SCORE)
    return F.when(_gate(text, rule), found).otherwise(none)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(doc_id, found): every row's spans by start, then by the rules' order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    arrays = [spans_of(F.col("text"), r, i) for i, r in enumerate(rules)]
    return rows.select("doc_id", F.array_sort(F.concat(*arrays)).alias("found"))


#: Kinds in the order in which ``redact`` replaces them: longer shapes before the digits they hold.
REDACTED = ("email", "iban", "secret", "phone", "ip", "card", "national_id")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each confirmed span replaced by ``<kind>``, one kind after the other (``REDACTED``)."""
    def replaced(text: Column, rule: Rule) -> Column:
        def cover(hit: Column, before: Column, after: Column) -> Column:
            span = longest_account(hit) if rule.kind == "iban" else hit
            enough = F.lit(True) if rule.base else _score(rule, F.right(before, F.lit(NEAR)), F.left(after, F.lit(NEAR))) >= MIN_SCORE
            return F.when(_valid(rule.kind, span) & enough, F.concat(F.lit(f"<{rule.kind}>"), F.substr(hit, F.length(span) + 1))).otherwise(hit)

        def join(m: Column) -> Column:
            gaps, hits = m["gaps"], m["hits"]
            return F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.when(i < F.size(hits), F.array(g, cover(F.get(hits, i), g, F.get(gaps, i + 1)))).otherwise(F.array(g)))), "")

        cut = F.struct(F.split(text, rule.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hits"))
        return F.when(_gate(text, rule), let(cut, join)).otherwise(text)

    out = docs
    for kind in REDACTED:
        out = out.withColumn(text_col, replaced(F.col(text_col), next(r for r in RULES if r.kind == kind)))
    return out


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(documents(spark, sf_dir))

    def line(x: Column) -> Column:
        return F.concat_ws(":", x["kind"], x["start"], x["end"])

    base = F.filter("found", lambda x: x["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in RULES]
    return out.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256).alias("base_sha256"),
                      F.array_join(F.transform("found", line), ",").alias("spans"), F.size("found").cast("long").alias("n_spans"))
