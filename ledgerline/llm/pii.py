"""Personal data: pattern spans, checksum validators and context words, in SQL functions only.

Every pattern is written with possessive quantifiers and a left guard, so that a
text of any length is scanned in linear time and without regex recursion; the
spans are those of the plain patterns in the contract. Offsets are code points,
end exclusive. A null text holds nothing; an empty text holds nothing.

Positions come from ``split`` and ``regexp_extract_all`` over the same pattern: the
gaps and the matches alternate, so running sums of their lengths are the offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import table

#: Fixed order of the kinds in results. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

#: kind -> (cheap test that any match implies, pattern, checks, context words)
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Signs of an account number by country; others have 15 to 34.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE",
    31: "MT|SC", 32: "LC", 33: "RU",
}
_FIXED = "|".join(IBAN_LENGTHS.values())
_IBAN = (
    r"(?<![A-Za-z0-9])(?:"
    + "".join(rf"(?:{codes})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}|" for n, codes in IBAN_LENGTHS.items())
    + rf"(?!{_FIXED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"
)
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE, "iban": _IBAN, "ssn": _SSN}

#: Words that make a kind likelier when they stand near a span.
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": "address|host|server|login",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social|security",
}
#: Score before context; near context words add CONTEXT_BONUS. Added kinds need ACCEPT.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
CONTEXT_BONUS, CONTEXT_CHARS, ACCEPT = 0.1, 60, 0.5
#: Items in a block of a fold, signs in a block of a text: both keep the time linear in the size of a text.
_BLOCK, _SIGNS = 256, 4096


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""

    def add(acc: Column, d: Column) -> Column:
        d = d.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.struct((acc["s"] + F.when(acc["odd"], twice).otherwise(d)).alias("s"), (~acc["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("s"), F.lit(False).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda acc: acc["s"] % 10 == 0)


def _mod97(value: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + letter) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), add, lambda rest: rest == 1)


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(value, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 4).try_cast("int"), F.lit(0)) <= 255
        )
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "iban":
        return _mod97(value)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap test that is true wherever the kind's pattern matches."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    return text.rlike({"ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}[kind])


def _folded(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], finish: Callable[[Column, Column], Column]) -> Column:
    """A fold over an array that holds one item at least, block by block.

    ``step`` gives from the place so far and an item the next place and an array of
    ``kind``; ``finish`` sees the last place and all that was given, in order.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int")), lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)))
    zero = lambda at, k: F.struct(at.alias("at"), F.expr(f"cast(array() as array<{k}>)").alias("out"))

    def one(acc: Column, item: Column) -> Column:
        at, found = step(acc["at"], item)
        return F.struct(at.alias("at"), F.concat(acc["out"], found).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(b, zero(acc["at"], kind), one)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    return F.aggregate(blocks, zero(F.lit(0), f"array<{kind}>"), block, lambda acc: finish(acc["at"], F.flatten(acc["out"])))


def _located(gaps: Column, found: Column) -> Column:
    """array<struct<start:int, end:int, value:string, around:string>> of all matches, of which there is one at least.

    ``around`` is the match with CONTEXT_CHARS signs on both sides, at most up to the next match.
    """
    n = F.size(found)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), n).alias("gap"), found.alias("value"), F.slice(gaps, F.lit(2), n).alias("behind"))

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        start = at + F.char_length(m["gap"])
        end = start + F.char_length(m["value"])
        around = F.concat(F.right(m["gap"], F.lit(CONTEXT_CHARS)), m["value"], F.left(m["behind"], F.lit(CONTEXT_CHARS)))
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"), around.alias("around")))

    return _folded(pairs, "struct<start:int,end:int,value:string,around:string>", step, lambda _, out: out)


def _iban_ends(located: Column) -> Column:
    """Matches of countries without a fixed length, cut at the last gap up to which mod-97 holds, where there is one."""

    def cut(m: Column) -> Column:
        groups = F.split(m["value"], " ")
        heads = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
        good = F.filter(heads, lambda h: (F.char_length(F.regexp_replace(h, " ", "")) >= 15) & _mod97(h))
        value = F.coalesce(F.get(good, F.lit(0)), m["value"])
        return F.when(m["value"].rlike(f"^(?:{_FIXED})"), m).otherwise(F.struct(m["start"].alias("start"), (m["start"] + F.char_length(value)).alias("end"), value.alias("value"), m["around"].alias("around")))

    return F.transform(located, cut)


def _accepted(kind: str, located: Column) -> Column:
    """Of located matches those that validators and score accept: array<struct<kind, start, end, score>>."""

    def scored(m: Column) -> Column:
        near = F.when(F.lower(m["around"]).rlike(rf"\b(?:{CONTEXT[kind]})"), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.round(F.lit(PRIOR[kind]) + near, 2).alias("score"))

    located = _iban_ends(located) if kind == "iban" else located
    spans = F.transform(F.filter(located, lambda m: _holds(kind, m["value"])), scored)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= ACCEPT)


def find_pii(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Add column ``into``: array<struct<kind, start, end, score>>, by kind in KINDS' order, then start.

    Base kinds (email, ip, card, phone) follow the contract and are never dropped;
    iban needs mod-97, ssn needs a context word nearby. Rows with a null text get
    an empty array. Row count, order of columns and all other columns are kept.

    The matches, the gaps and the spans are formed in projections of their own, so
    that each pattern runs over a text once for its matches and, only where there
    are any, once for its gaps.
    """
    body, keep = F.col(text), list(df.columns)
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")
    m, g = ({k: f"__{p}_{k}" for k in KINDS} for p in "mg")
    out = df.select("*", *(F.when(_may_hold(k, body), F.regexp_extract_all(body, F.lit(PATTERNS[k]), F.lit(0))).alias(m[k]) for k in KINDS))
    out = out.select("*", *(F.when(F.size(m[k]) > 0, F.split(body, PATTERNS[k], -1)).alias(g[k]) for k in KINDS))
    spans = (F.when(F.size(m[k]) > 0, _accepted(k, _located(F.col(g[k]), F.col(m[k])))).otherwise(none) for k in KINDS)
    return out.select(*(F.col(f"`{c}`") for c in keep if c != into), F.concat(*spans).alias(into))


def redact(df: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """Replace every span in ``text`` by its kind in brackets; ``pii`` is dropped.

    Where spans overlap, the one that starts first (then the longest) names the
    placeholder and the rest of the union is cut out. A null text stays null, an empty
    one empty; repeated rows are treated alike; an empty table stays empty.
    """
    ordered = F.array_sort(F.transform(F.col(pii), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    found = F.size(pii) > 0
    blocks, spans = F.col("__blocks"), F.col("__spans")

    def cut(start: Column, end: Column) -> Column:
        """Signs from start to end of a text that is cut into blocks."""
        first, last = F.floor(start / _SIGNS).cast("int"), F.floor(end / _SIGNS).cast("int")
        inner = F.substring(F.get(blocks, first), start % _SIGNS + 1, end - start)
        parts = F.concat(F.array(F.substring(F.get(blocks, first), start % _SIGNS + 1, F.lit(_SIGNS))), F.slice(blocks, first + 2, last - first - 1), F.array(F.coalesce(F.substring(F.get(blocks, last), F.lit(1), end % _SIGNS), F.lit(""))))
        return F.coalesce(F.when(first == last, inner).otherwise(F.array_join(parts, "")), F.lit(""))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        add = F.when(s["start"] >= at, F.array(cut(at, s["start"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.greatest(at, -s["neg"]), add

    size = F.char_length(F.col(text))
    masked = _folded(spans, "string", step, lambda at, out: F.concat(F.array_join(out, ""), F.when(at < size, cut(at, size)).otherwise("")))
    # the blocks and the spans are formed in a projection of their own, once for each text
    ready = df.withColumns({"__blocks": F.when(found, F.regexp_extract_all(F.col(text), F.lit(rf"(?s).{{1,{_SIGNS}}}"), F.lit(0))), "__spans": F.when(found, ordered)})
    return ready.withColumn(text, F.when(found, masked).otherwise(F.col(text))).drop(pii, "__blocks", "__spans")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All personal data in every whole document, one row per document."""
    found = find_pii(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


QUERIES = {"op3_pii": op3_pii}
